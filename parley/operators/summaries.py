"""Summary material: coercion of model replies, de-duplication, rendering."""

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from parley.functions import constants as c
from parley.functions.matching import match_ratio
from parley.functions.text import clean_due, clip, deleted_text, norm_text, strip
from parley.operators import repeats
from parley.session import cut_lineage

# Claim order of the sections, and their caps.
SECTIONS = ["action_items", "decisions", "key_points", "open_questions", "follow_ups"]
LIST_CAP = 25
ITEM_CHARS = 600
TASK_CHARS = 400
OWNER_CHARS = 60
HEADLINE_CHARS = 90
TLDR_CHARS = 1500
SUBJECT_CHARS = 200
BODY_CHARS = 4000
# Fixed value: a reply's JSON between code fences.
FENCED = re.compile(r"```(?:json)?\s*(\{.*?\})\s*```", re.S)


def _first_object(reply):
    """Text of the first JSON object in a reply, NULL when there is none."""
    if reply is None:
        return None
    fenced = FENCED.search(reply)
    text = fenced.group(1) if fenced else reply
    start = text.find("{")
    if start < 0:
        return None
    try:
        return text[start:json.JSONDecoder().raw_decode(text, start)[1]]
    except ValueError:
        return None


@F.pandas_udf(StringType())
def _objects(replies: pd.Series) -> pd.Series:
    return replies.map(_first_object)


def extract_json(replies: DataFrame, column: str = "reply") -> DataFrame:
    """Adds `json`; replies without a whole object keep NULL for quarantine."""
    return replies.withColumn("json", _objects(F.col(column)))


def _text(value: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(value, path, "string"), F.lit(""))


def _list(value: Column, path: str) -> Column:
    items = F.coalesce(F.try_variant_get(value, path, "array<string>"),
                       F.array().cast("array<string>"))
    texts = F.transform(items, lambda x: F.substring(strip(F.coalesce(x, F.lit("None"))), 1, ITEM_CHARS))
    return F.slice(F.filter(texts, lambda x: x != ""), 1, LIST_CAP)


def coerce_summary(rows: DataFrame, column: str = "json") -> DataFrame:
    """Reply JSON to the summary columns: wrong types become empty, texts are
    stripped and cut, plain-text action items get no owner and no date."""
    raw = F.try_parse_json(F.coalesce(F.col(column), F.lit("{}")))
    rows = rows.withColumn("_raw", raw)
    v = F.col("_raw")
    plain = F.struct(F.lit("—").alias("owner"), F.lit("").alias("task"), F.lit("").alias("due"))
    items = F.coalesce(F.try_variant_get(v, "$.action_items", "array<variant>"),
                       F.array().cast("array<variant>"))

    def action(x):
        owner = F.coalesce(F.nullif(clip(_text(x, "$.owner"), OWNER_CHARS), F.lit("")), F.lit("—"))
        entry = F.struct(owner.alias("owner"), clip(_text(x, "$.task"), TASK_CHARS).alias("task"),
                         clean_due(_text(x, "$.due")).alias("due"))
        bare = F.struct(F.lit("—").alias("owner"),
                        clip(x.cast("string"), TASK_CHARS).alias("task"), F.lit("").alias("due"))
        return F.when(x.isNull(), plain).when(F.schema_of_variant(x).startswith("OBJECT"), entry).otherwise(bare)

    actions = F.slice(F.filter(F.transform(items, action), lambda a: a["task"] != ""), 1, LIST_CAP)
    return rows.select(
        *[col for col in rows.columns if col not in ("_raw", column)],
        clip(_text(v, "$.headline"), HEADLINE_CHARS).alias("headline"),
        clip(_text(v, "$.tldr"), TLDR_CHARS).alias("tldr"),
        *[_list(v, f"$.{name}").alias(name) for name in ("key_points", "decisions")],
        actions.alias("action_items"),
        *[_list(v, f"$.{name}").alias(name) for name in ("follow_ups", "open_questions")],
        clip(_text(v, "$.follow_up_email.subject"), SUBJECT_CHARS).alias("email_subject"),
        clip(_text(v, "$.follow_up_email.body"), BODY_CHARS).alias("email_body"))


def summary_items(summaries: DataFrame) -> DataFrame:
    """Summary columns to rows (meeting_id, section, pos, owner, item, due)."""
    none = F.lit(None).cast("string")
    def entries(name):
        if name == "action_items":
            return F.transform(name, lambda a, i: F.struct(
                F.lit(name).alias("section"), i.alias("pos"), a["owner"].alias("owner"),
                a["task"].alias("item"), a["due"].alias("due")))
        return F.transform(name, lambda a, i: F.struct(
            F.lit(name).alias("section"), i.alias("pos"), none.alias("owner"), a.alias("item"),
            none.alias("due")))
    return summaries.select("meeting_id", F.inline(F.concat(*[entries(n) for n in SECTIONS])))


def with_items(summaries: DataFrame, items: DataFrame) -> DataFrame:
    """The summaries with `items` (as of `summary_items`) in place of their own."""
    def entries(name):
        own = F.struct("pos", *(("owner", F.col("item").alias("task"), "due") if name == "action_items" else ("item",)))
        return F.array_sort(F.collect_list(F.when(F.col("section") == name, own))).alias(f"_{name}")
    found = items.groupBy("meeting_id").agg(*[entries(name) for name in SECTIONS])

    def contents(name):
        if name == "action_items":
            return F.transform(f"_{name}", lambda a: F.struct(*[a[x].alias(x) for x in ("owner", "task", "due")]))
        return F.transform(f"_{name}", lambda a: a["item"])
    kinds = dict(summaries.dtypes)
    return summaries.join(found, "meeting_id", "left").select(*[
        F.coalesce(contents(x), F.array().cast(kinds[x])).alias(x) if x in SECTIONS else x for x in summaries.columns])


def cap_items(items: DataFrame, cap: int = LIST_CAP) -> DataFrame:
    """The first items of each section. The rank limit is pushed before the shuffle."""
    first = Window.partitionBy("meeting_id", "section").orderBy("pos")
    return items.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= cap).drop("_n")


def dedup_items(items: DataFrame, strict: bool = False, cap: int | None = None) -> DataFrame:
    """Greedy removal of repeated thoughts within and across a meeting's sections.

    An item goes when it resembles one kept before; actions are compared by owner
    and task among themselves, and their task joins the common pool. Every item is looked
    at; `cap` takes the first ones of each section only. With `strict` a task without
    letters stays in the pool as an empty key and swallows long items after it.
    """
    first = items if cap is None else cap_items(items, cap)
    owner, item = (deleted_text(F.col(x)).alias(f"_{x}") for x in ("owner", "item"))
    # forms are worked out once; only these and no texts are read again until the end
    rows = cut_lineage(first.withColumn("_id", F.monotonically_increasing_id()).select("*", owner, item))
    rank = F.array_position(F.array(*[F.lit(s) for s in SECTIONS]), F.col("section")).cast("int")
    key, whole = F.trim("_item"), F.trim(F.concat_ws(" ", "_owner", "_item"))
    action = F.col("section") == "action_items"
    # an action is compared with actions, and its task stands for it among the others
    own = F.struct(F.when(action, "tasks").otherwise("common").alias("pool"), F.lit(False).alias("old_only"),
                   F.when(action, whole).otherwise(key).alias("text"))
    task = F.struct(F.lit("common").alias("pool"), F.lit(True).alias("old_only"), key.alias("text"))
    roles = F.array_compact(F.array(F.when(action | (key != ""), own), F.when(action & (F.lit(strict) | (key != "")), task)))
    entries = rows.select("meeting_id", rank.alias("rank"), F.col("pos").cast("long").alias("pos"), F.col("_id").alias("id"),
                          F.inline(roles))
    empty = rows.filter(~action & (F.coalesce(key, F.lit("")) == "")).select(F.col("_id").alias("id"))
    gone = cut_lineage(repeats.dropped(repeats.rivals(entries)).unionByName(empty))
    return rows.join(gone.withColumnRenamed("id", "_id"), "_id", "left_anti").select(*items.columns)


def dedup_exact(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Lowest key per normal form; empty forms are dropped. Only digests shuffle."""
    # a filter before the grouping would make the scan work out each form twice
    normal = rows.select(key, norm_text(F.col(text)).alias("_n"))
    return normal.groupBy(F.sha2("_n", 256).alias("digest")).agg(
        F.min(key).alias(key), F.count(F.lit(1)).alias("copies"), F.max(F.length("_n")).alias("_chars")).filter(
        "_chars > 0").drop("digest", "_chars")


def similar(a: Column, b: Column) -> tuple[Column, Column]:
    """Cheap verdict and the matcher's, for normal forms. The matcher only sees pairs
    whose lengths can reach the limit: the ratio is at most 2·short/(long+short)."""
    la, lb = F.length(a), F.length(b)
    cheap = (a == b) | ((la > c.SIMILAR_CONTAINS_CHARS) & (F.contains(a, b) | F.contains(b, a)))
    near = ~cheap & (2 * F.least(la, lb) >= c.SIMILAR_RATIO * (la + lb))
    return cheap, match_ratio(F.when(near, a), F.when(near, b), F.lit(c.SIMILAR_RATIO))


def similar_pairs(pairs: DataFrame) -> DataFrame:
    """Adds `similar` for columns a and b; the test is not symmetric."""
    rows = pairs.withColumn("_a", norm_text(F.col("a"))).withColumn("_b", norm_text(F.col("b")))
    cheap, ratio = similar(F.col("_a"), F.col("_b"))
    return rows.withColumn("_ratio", ratio).withColumn(
        "similar", cheap | F.coalesce(F.col("_ratio") >= c.SIMILAR_RATIO, F.lit(False))).drop(
        "_a", "_b", "_ratio")


def render_notes(points: Column, decisions: Column, actions: Column, questions: Column) -> Column:
    """Notes of one portion as bullet text. Actions are structs of owner, task, due."""
    def action(a):
        due = F.when(F.coalesce(a["due"], F.lit("")) != "",
                     F.concat(F.lit(" (due "), a["due"], F.lit(")"))).otherwise("")
        owner = F.coalesce(F.nullif(a["owner"], F.lit("")), F.lit("—"))
        return F.concat(F.lit("- ACTION: "), owner, F.lit(" — "), F.coalesce(a["task"], F.lit("")), due)
    bullets = F.concat(
        F.transform(points, lambda p: F.concat(F.lit("- "), p)),
        F.transform(decisions, lambda d: F.concat(F.lit("- DECISION: "), d)),
        F.transform(actions, action),
        F.transform(questions, lambda q: F.concat(F.lit("- OPEN QUESTION: "), q)))
    return F.array_join(bullets, "\n")


def markdown_lines(s: dict[str, Column]) -> Column:
    """Summary section of an export as an array of lines, empty without a summary."""
    empty = F.array().cast("array<string>")
    line = lambda x: F.array(x if isinstance(x, Column) else F.lit(x))

    def block(title, items):
        return F.when(F.size(items) > 0, F.concat(
            F.array(F.lit(f"**{title}**"), F.lit("")), items, line(""))).otherwise(empty)

    def bullets(name):
        return F.transform(s[name], lambda p: F.concat(F.lit("- "), p))
    actions = F.transform(s["action_items"], lambda a: F.concat(
        F.lit("- **"), F.coalesce(a["owner"], F.lit("—")), F.lit(":** "), a["task"],
        F.when(a["due"] != "", F.concat(F.lit(" _(by "), a["due"], F.lit(")_"))).otherwise("")))
    subject = F.when(s["email_subject"] != "", F.array(
        F.concat(F.lit("*Subject:* "), s["email_subject"]), F.lit(""))).otherwise(empty)
    quoted = F.transform(F.split(F.regexp_replace(s["email_body"], "\n$", ""), "\n"),
                         lambda ln: F.when(ln != "", F.concat(F.lit("> "), ln)).otherwise(">"))
    email = F.when(s["email_body"] != "", F.concat(
        F.array(F.lit("**Draft follow-up email**"), F.lit("")), subject, quoted, line(""))).otherwise(empty)
    tldr = F.when(s["tldr"] != "", F.array(s["tldr"], F.lit(""))).otherwise(empty)
    return F.concat(
        F.array(F.lit("## Summary"), F.lit("")), tldr, block("Key points", bullets("key_points")),
        block("Decisions", bullets("decisions")), block("Action items", actions),
        block("Follow-ups", bullets("follow_ups")), block("Open questions", bullets("open_questions")), email)
