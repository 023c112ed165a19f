"""Soft-membership mixing: document rates that bring expected domain totals to their targets.
DataFrame functions only.

1. A multinomial naive Bayes classifier is counted from labelled documents (a bounded
   sample, a bounded vocabulary) whose label names their domain.
2. Every document gets the posterior probabilities p of the domains; the log likelihood
   is damped by `soft / (soft + tokens)`, so long texts keep soft memberships.
3. Projected gradient descent fits rates r >= 0, all beginning at 1, that minimise
   sum_k (sum_i r_i n_i p_ik - target_k)^2 / (2 total_k): n tokens, total_k the domain's
   tokens at rate 1. The gradient is taken per token, so a step is
   r <- max(0, r - sum_k p_k e_k), e_k = (current_k - target_k) / total_k. A round is one
   aggregate to as many sums as there are domains; only those reach the driver.

Defined results: null and empty texts have no tokens, the prior as posterior and a rate
like any other; rows with equal id and text share one rate; without labels there is one
domain "all" and all rates are 1; documents without a column lang are of no known language;
an empty table gives an empty one.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.session import cut_lineage

SAMPLE_DOCS = 20_000
VOCABULARY = 4_096
SOFT = 50.0
ROUNDS = 30
#: Rounds after which the rates are written, so that plans stay short.
WRITE_EVERY = 6

#: The label of a labelled document: its language and the quality mark.
DOMAIN = "concat(coalesce(lang, 'und'), if(quality = 1, '/good', '/poor'))"


def _key() -> list[Column]:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.col("doc_id").alias("__id"), F.xxhash64(text).alias("__a"), F.hash(text).alias("__b")]


def _words(text) -> Column:
    """Words between spaces and line ends, in lower case; empty ones are no words."""
    return F.split(F.replace(F.lower(text), F.lit("\n"), F.lit(" ")), " ")


def train(docs: DataFrame, labels: DataFrame, domain: str = DOMAIN, sample: int = SAMPLE_DOCS,
          vocabulary: int = VOCABULARY):
    """Domains with their log priors, and the table word, s0..sK-1 of log likelihoods against
    those of an unknown word. At most `sample` labelled rows and `vocabulary` words."""
    chosen = labels.orderBy(F.xxhash64("doc_id"), *labels.columns).limit(sample)
    rows = docs.select("doc_id", "text", *[c if c in docs.columns else F.lit(None).cast("string").alias(c)
                                           for c in ("lang", "source")])
    named = rows.join(F.broadcast(chosen.dropDuplicates(["doc_id"])), "doc_id").select(
        F.expr(domain).alias("domain"), F.col("text").cast("string").alias("text"))
    words = named.select("domain", F.explode(_words(F.col("text"))).alias("word")).filter("word <> ''")
    counts = cut_lineage(words.groupBy("domain", "word").agg(F.count("word").alias("n")))
    sizes = {r[0]: r[1] for r in counts.groupBy("domain").agg(F.sum("n")).orderBy("domain").collect()}
    domains = [d for d, n in sizes.items() if d is not None and n] or ["all"]
    total = sum(sizes.get(d, 0) for d in domains)
    priors = [(sizes.get(d, 0) + 1) / (total + len(domains)) for d in domains]
    top = counts.groupBy("word").agg(F.sum("n").alias("n")) \
        .orderBy(F.desc("n"), "word").limit(vocabulary).select("word")
    at = [F.log((F.coalesce(F.sum(F.when(F.col("domain") == d, F.col("n"))), F.lit(0)) + 0.5)
                / F.lit((sizes.get(d, 0) + 0.5 * vocabulary)))
          - F.log(F.lit(0.5 / (sizes.get(d, 0) + 0.5 * vocabulary))) for d in domains]
    base = [F.log(F.lit(0.5 / (sizes.get(d, 0) + 0.5 * vocabulary))) for d in domains]
    model = counts.join(F.broadcast(top), "word").groupBy("word").agg(
        *[a.alias(f"s{k}") for k, a in enumerate(at)])
    return domains, priors, base, cut_lineage(model)


def memberships(docs: DataFrame, domains, priors, base, model, soft: float = SOFT) -> DataFrame:
    """One row per distinct (id, text): the key, m (equal rows), n (tokens) and p0..pK-1."""
    ks = range(len(domains))
    keyed = docs.select(*_key(), F.col("text").cast("string").alias("text"))  # hashed once, before the words part
    words = keyed.select("__id", "__a", "__b", F.posexplode_outer(_words(F.col("text"))).alias("pos", "word"))
    found = words.join(F.broadcast(model), "word", "left")  # at most VOCABULARY rows
    sums = found.groupBy("__id", "__a", "__b").agg(
        F.count(F.when(F.coalesce("pos", F.lit(0)) == 0, 1)).alias("m"),
        F.count(F.when(F.col("word") != "", 1)).alias("t"), *[F.sum(f"s{k}").alias(f"s{k}") for k in ks])
    n = F.col("t") / F.col("m")
    score = [F.log(F.lit(priors[k])) + (F.coalesce(F.col(f"s{k}"), F.lit(0.0)) / F.col("m") + n * base[k])
             * (F.lit(soft) / (F.lit(soft) + n)) for k in ks]
    scored = sums.select("__id", "__a", "__b", "m", n.cast("long").alias("n"), F.array(*score).alias("s"))
    power = scored.withColumn("s", F.expr("transform(s, x -> exp(x - array_max(s)))"))
    whole = F.aggregate("s", F.lit(0.0), lambda a, x: a + x)
    return power.select("__id", "__a", "__b", "m", "n", *[(F.col("s")[k] / whole).alias(f"p{k}") for k in ks])


def fit(rows: DataFrame, goals, rounds: int = ROUNDS, tolerance: float = 1e-6):
    """Rates for `rows` (m, n, p0..) and the totals they give. `goals(totals)`: target tokens per domain."""
    ks = range(len([c for c in rows.columns if c[0] == "p" and c[1:].isdigit()]))
    mass = F.col("m") * F.col("n")

    def totals(frame):
        found = frame.agg(*[F.sum(mass * F.col("r") * F.col(f"p{k}")) for k in ks]).first()
        return [float(x or 0.0) for x in found]
    rows = rows.withColumn("r", F.lit(1.0))
    start = now = totals(rows)
    target = goals(start)
    for i in range(rounds):
        error = [(now[k] - target[k]) / start[k] if start[k] else 0.0 for k in ks]
        if max(map(abs, error), default=0.0) < tolerance:
            break
        step = sum((F.col(f"p{k}") * error[k] for k in ks), F.lit(0.0))
        rows = rows.withColumn("r", F.greatest(F.lit(0.0), F.col("r") - step))
        if i % WRITE_EVERY == WRITE_EVERY - 1:
            rows = cut_lineage(rows)
        now = totals(rows)
    return rows, now, target


def even_targets(power: float = 0.5):
    """Targets in proportion to the domains' tokens to the power given, adding up to all tokens."""
    def goals(totals):
        weight = [t ** power if t > 0 else 0.0 for t in totals]
        return [sum(totals) * w / sum(weight) if sum(weight) else 0.0 for w in weight]
    return goals


def rates(docs: DataFrame, labels: DataFrame, goals=None, domain: str = DOMAIN) -> DataFrame:
    """__id, __a, __b, n, p (domain to probability) and rate of every distinct (id, text)."""
    domains, priors, base, model = train(docs, labels, domain)
    rows = cut_lineage(memberships(docs, domains, priors, base, model))
    fitted, _, _ = fit(rows, goals or even_targets())
    p = F.map_from_arrays(F.array(*[F.lit(d) for d in domains]), F.array(*[f"p{k}" for k in range(len(domains))]))
    return fitted.select("__id", "__a", "__b", "n", p.alias("p"), F.col("r").alias("rate"))


def mix(docs: DataFrame, labels: DataFrame, goals=None, domain: str = DOMAIN) -> DataFrame:
    """The rows of `docs` with all columns, n_tokens, domain (the likeliest) and rate."""
    found = rates(docs, labels, goals, domain).withColumnsRenamed({"n": "__n", "p": "__p", "rate": "__r"})
    own = docs.withColumns({"__i": F.col("doc_id"), "__c": _key()[1], "__d": _key()[2]})
    same = (F.col("__i").eqNullSafe(F.col("__id")) & (F.col("__c") == F.col("__a")) & (F.col("__d") == F.col("__b")))
    likeliest = F.expr("array_max(transform(map_entries(__p), e -> struct(e.value as v, e.key as k))).k")
    kept = [c for c in docs.columns if c not in ("n_tokens", "domain", "rate")]
    return own.join(found, same).select(*kept, F.col("__n").alias("n_tokens"), likeliest.alias("domain"),
                                        F.col("__r").alias("rate"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_tokens, domain, rate of every row."""
    return mix(docs.select("doc_id", "text", *[c for c in ("lang",) if c in docs.columns]), labels).select("doc_id", "n_tokens", "domain", "rate")
