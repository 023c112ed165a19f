"""Lists, maps and thresholds that decide results."""

# Filler phrases, in counting order.
FILLER_PHRASES = [
    "um", "uh", "umm", "uhh", "hmm", "er", "erm",
    "you know", "i mean", "sort of", "kind of",
    "basically", "actually", "literally", "like",
]

# Misheard phrase and its repair, applied in this order.
ALIASES = {
    "get hub": "GitHub",
    "git hub": "GitHub",
    "get lab": "GitLab",
    "pool request": "pull request",
    "cooper netties": "Kubernetes",
    "kuber netties": "Kubernetes",
    "post gress": "Postgres",
    "no js": "Node.js",
    "view js": "Vue.js",
    "type script": "TypeScript",
    "java script": "JavaScript",
    "chat gpt": "ChatGPT",
    "an thropic": "Anthropic",
}

# Language code to recognizer locale.
LOCALES = {
    "en": "en-US", "hi": "hi-IN", "es": "es-ES", "fr": "fr-FR", "de": "de-DE",
    "it": "it-IT", "pt": "pt-BR", "ja": "ja-JP", "ko": "ko-KR", "zh": "zh-CN",
    "ar": "ar-SA", "ru": "ru-RU", "nl": "nl-NL",
}
DEFAULT_LOCALE = "en-US"

# Process name and meeting-app label, first match wins.
MEETING_APPS = {
    "zoom.us": "Zoom",
    "Microsoft Teams": "Teams",
    "MSTeams": "Teams",
    "Slack": "Slack",
    "FaceTime": "FaceTime",
    "Webex": "Webex",
}

# Due dates that mean "none given".
NO_DUE = ["tbd", "n/a", "na", "none", "unknown", "unspecified", "-", "—", "not specified"]
NO_DUE_PATTERN = "stated timing|empty string|omit|never invent"

# Terms a recognizer often misses, in priority order. Two product
# names of the upstream list are left out; callers may pass their own list.
DEFAULT_VOCABULARY = [
    "GitHub", "GitLab", "Bitbucket", "repo", "pull request", "merge conflict",
    "commit", "rebase", "monorepo", "code review", "changelog",
    "Python", "TypeScript", "JavaScript", "Swift", "Kotlin", "Rust", "Golang",
    "Node.js", "React", "Next.js", "Vite", "Tailwind", "SwiftUI", "Flutter",
    "Kubernetes", "Docker", "Terraform", "AWS", "GCP", "Azure", "Vercel",
    "Cloudflare", "PostgreSQL", "Postgres", "MongoDB", "Redis", "SQLite",
    "GraphQL", "gRPC", "webhook", "microservices", "serverless", "DevOps",
    "CI CD", "staging", "prod", "rollback", "canary", "load balancer",
    "latency", "throughput", "uptime", "observability", "Datadog", "Grafana",
    "Claude", "ChatGPT", "OpenAI", "Anthropic", "Gemini", "Copilot", "LLM",
    "GenAI", "RAG", "fine-tuning", "embeddings", "inference", "quantization",
    "prompt engineering", "agentic", "MCP", "tokens", "context window",
    "hallucination", "on-device", "Neural Engine", "Whisper", "transformer",
    "roadmap", "sprint", "standup", "retro", "backlog", "OKR", "KPI", "MVP",
    "beta", "launch", "onboarding", "churn", "retention", "conversion",
    "A/B test", "analytics", "dashboard", "wireframe", "Figma", "mockup",
    "user research", "PRD", "spec", "stakeholder", "deliverable",
    "Jira", "Linear", "Notion", "Slack", "Zoom", "Google Meet", "Teams",
    "Confluence", "Salesforce", "HubSpot", "Stripe", "Shopify", "Airtable",
    "Zapier", "Calendly", "Miro", "Asana",
    "API", "SDK", "CLI", "JSON", "YAML", "OAuth", "SSO", "JWT", "npm",
    "regex", "endpoint", "middleware", "backend", "frontend", "full-stack",
    "TestFlight", "App Store",
]

# Thresholds.
TURN_GAP_MS = 3000
ECHO_SLACK_MS = 1500
ECHO_LOOKBACK_MS = 30000
ECHO_DROP = 0.7
ECHO_DROP_SHORT = 0.999
ECHO_SHORT_TOKENS = 4
ECHO_TRIM = 0.35
TRIM_MIN_WORDS = 7
TRIM_MIN_EDGE = 4
TRIM_MIN_KEPT = 3
SIMILAR_RATIO = 0.87
SIMILAR_CONTAINS_CHARS = 20
SILENCE_PEAK = 0.004
NO_SPEECH = 0.85
MIN_TRACK_S = 0.3
WINDOW_MS = 2000
HOP_MS = 1000
MIN_WINDOW_MS = 400
LINKAGE_THRESHOLD = 0.6
MAX_AUTO_SPEAKERS = 8
MIN_CLUSTER_MS = 10000
TIDY_TURNS = 36
TIDY_CHARS = 8000
TIDY_TURN_COST = 40
TIDY_OVERLAP = 6
CHUNK_CHARS = 10000
TRANSCRIPT_CHARS = 240000
WAVEFORM_BINS = 700
RMS_FULL = 6000
CAPTION_RING = 400
DONE_RING = 200
VOCABULARY_CAP = 100
MAX_PAYLOAD_BYTES = 5 * 1024 * 1024
CALL_PERSIST_S = 10
CALL_COOLDOWN_S = 3600
PENDING_TTL_S = 600
