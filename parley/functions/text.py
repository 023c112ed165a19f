"""Scalar text functions, all inside the JVM."""

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.functions.constants import ALIASES, FILLER_PHRASES, NO_DUE, NO_DUE_PATTERN
from parley.functions.vectors import let

LETTER = r"\p{L}\p{N}_"
BLANKS = " \t\n\r\f\u000b"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def norm_text(text: Column, unicode: bool = False) -> Column:
    """Lower case with everything but letters, digits and spaces deleted."""
    return F.trim(deleted_text(text, unicode))


def deleted_text(text: Column, unicode: bool = False) -> Column:
    """The normal form with the spaces at its ends. What stays is extracted: Java searches the complement
    of a class several times slower than the class."""
    keep = r"[\p{L}\p{N} ]+" if unicode else "[a-z0-9 ]+"
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit(keep), F.lit(0)), "")


def split_words(text: Column) -> Column:
    """Pieces between blanks, without the empty ones."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"[{LETTER}']+"), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[{LETTER}'-]+")).cast("bigint")


def question_count(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("?"), F.lit("")))).cast("bigint")


def has_word(text: Column) -> Column:
    return text.rlike(f"[{LETTER}]")


def whole_phrase(*phrases: str) -> str:
    """Pattern of any of the phrases (texts, not patterns) as whole words, in group 1."""
    return f"(?<![{LETTER}])({'|'.join(map(re.escape, phrases))})(?![{LETTER}])"


def _overlap(p: list[str], q: list[str]) -> bool:
    """Whether q can begin inside p, so that a match of one hides one of the other."""
    return any(p[k:k + len(q)] == q[:len(p) - k] for k in range(len(p)))


def filler_hits(text: Column, phrases: list[str] = FILLER_PHRASES) -> Column:
    """Every filler in the text as an array. Phrases that cannot overlap another one are counted
    by one pass over their alternation, as one pass per phrase would; the others have their own."""
    words = {p: p.split() for p in phrases}
    apart = [p for p in phrases if any(q != p and (_overlap(words[p], words[q]) or _overlap(words[q], words[p])) for q in phrases)]
    together = [p for p in phrases if p not in apart]
    groups = ([together] if together else []) + [[p] for p in apart]
    return F.concat(*[F.regexp_extract_all(F.lower(text), F.lit(whole_phrase(*g)), F.lit(1)) for g in groups])


def fix_mishearings(text: Column, aliases: dict[str, str] = ALIASES) -> Column:
    return reduce(
        lambda t, pair: F.regexp_replace(t, "(?i)" + whole_phrase(pair[0]), re.sub(r"([\\$])", r"\\\1", pair[1])),
        aliases.items(), text)


def clock(ms: Column) -> Column:
    """mm:ss, or h:mm:ss from one hour on."""
    s = F.floor(ms / 1000).cast("bigint")
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s % 60)).otherwise(
        F.format_string("%02d:%02d", m, s % 60))


def minutes_seconds(ms: Column) -> Column:
    """m:ss; negative and missing times count as 0."""
    s = F.greatest(F.floor(F.coalesce(ms, F.lit(0)) / 1000).cast("bigint"), F.lit(0).cast("bigint"))
    return F.format_string("%d:%02d", F.floor(s / 60), s % 60)


def duration_label(ms: Column) -> Column:
    """'N min' or 'H h M min'; empty for nothing recorded."""
    m = F.floor((ms + 30000) / 60000).cast("bigint")
    return F.when(F.coalesce(ms, F.lit(0)) == 0, "").when(
        m < 60, F.format_string("%d min", m)).otherwise(
        F.format_string("%d h %d min", F.floor(m / 60), m % 60))


def date_label(ts: Column, this_year: Column) -> Column:
    day = F.when(F.year(ts) == this_year, F.date_format(ts, "MMM d")).otherwise(
        F.date_format(ts, "MMM d, yyyy"))
    return F.concat_ws(" · ", day, F.date_format(ts, "h:mm a"))


def safe_folder_title(title: Column) -> Column:
    text = F.regexp_replace(F.coalesce(title, F.lit("")), r'[<>:"/\\|?*\x00-\x1f]', "")
    text = F.btrim(F.regexp_replace(text, r"[\s\p{Z}\x85]+", " "), F.lit(" ."))
    return F.btrim(F.substring(text, 1, 60), F.lit(" ."))


def folder_name(title: Column, meeting_id: Column) -> Column:
    safe = safe_folder_title(title)
    return F.when(safe != "", F.concat(safe, F.lit(" — "), meeting_id)).otherwise(meeting_id)


def safe_file_name(title: Column, meeting_id: Column) -> Column:
    safe = F.trim(F.regexp_replace(title, f"[^{LETTER}\\- ]+", ""))
    return F.coalesce(F.nullif(safe, F.lit("")), meeting_id)


def clip(text: Column, limit: int) -> Column:
    """Stripped, then cut to the limit a field allows."""
    return F.substring(strip(F.coalesce(text, F.lit(""))), 1, limit)


def clean_due(due: Column) -> Column:
    text = clip(due, 80)
    noise = (F.lower(text).isin(NO_DUE) | (F.length(text) > 40)
             | text.rlike(f"(?i){NO_DUE_PATTERN}"))
    return F.when(noise, "").otherwise(text)


def excerpt(text: Column, limit: int = 500) -> Column:
    """Opening of a portion that could not be summarized."""
    flat = F.substring(F.regexp_replace(strip(text), r"\s+", " "), 1, limit)
    return F.concat(F.lit("- (portion kept verbatim — could not be auto-summarized): "),
                    flat, F.lit("…"))


def locale(language: Column, locales: dict[str, str], default: str) -> Column:
    """Recognizer locale: known codes by table, full ones with the region in capitals."""
    lang = F.lower(F.trim(F.coalesce(language, F.lit(""))))
    table = F.create_map(*[F.lit(x) for pair in locales.items() for x in pair])
    dash = F.instr(lang, "-")
    full = F.concat(F.substring_index(lang, "-", 1), F.lit("-"),
                    F.upper(lang.substr(dash + 1, F.length(lang))))
    return F.when(lang == "", default).when(dash > 0, full).otherwise(
        F.coalesce(F.try_element_at(table, lang), F.lit(default)))


def language_choice(language: Column) -> Column:
    """2-10 letters or hyphens; 'auto' and anything else mean no choice."""
    text = F.trim(language)
    return F.when(text.rlike("^[a-zA-Z-]{2,10}$") & (text != "auto"), text)


def ordered_subset(small: Column, big: Column) -> Column:
    """Whether `small` occurs in `big` in order, gaps allowed."""
    def walk(pair):
        want = pair["small"]
        matched = F.aggregate(
            pair["big"], F.lit(0), lambda at, token: at + F.when(
                (at < F.size(want)) & F.coalesce(F.try_element_at(want, at + 1) == token, F.lit(False)),
                1).otherwise(0))
        return matched >= F.size(want)
    return let(F.struct(small.alias("small"), big.alias("big")), walk)


def nudge_key(title: Column, start_s: Column) -> Column:
    return F.concat(F.lit("cal-"), F.substring(
        F.sha1(F.concat_ws("|", title, start_s.cast("bigint").cast("string"))), 1, 12))
