"""Merkle manifest of a table of documents: hash trees per source and one over the sources.

A document is a leaf. The leaves of a source, by ascending id, are reduced by runs of `ARITY`
nodes to the source's subroot, and the subroots, by source, to the root.

Leaves are computed by Spark's own functions in one pass over the texts and written as a table
of hashes, which is range-sorted by (source, id, leaf); texts are never shuffled. A leaf's place in its source follows from
the table's partitions: each says how many rows it has and where its last source begins, one
small row a partition, so a source that fills many partitions is numbered by many tasks.

Aligned runs of `SUPERBLOCK` = ARITY ** LEVELS nodes are a superblock, which is reduced on its
own. Its node is a row of the tree above; this is repeated until one node is left, so no task
ever holds a whole source. On the way back down, the nodes of each level are cogrouped by
superblock with the outer nodes that the superblock needs, the siblings on its way to
the root: one task reduces the superblock again, joins inner and outer siblings of each
node and, on the leaves, folds the (tampered) leaf up to the root. Small superblocks that
begin near each other share a group, so a table of many tiny sources does not become as many
groups; a group has at most twice `SUPERBLOCK` nodes.

Defined results: a null field counts as '-', also an id. Null ids come first in their source,
and rows with equal source and id are ordered by leaf, so equal rows are neighbours and get
their places in any order. Null is a source of its own, other than ''. A null id has no checksum
and is not tampered with. A text without a line feed (or null) is tampered with in vain and
verifies. A lone source has no siblings above its subroot; one document alone has none at all,
and its proof is the hash of nothing. An empty table gives an empty one. Columns besides
doc_id, source, lang, n_chars and text are not looked at.
"""

from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.session import cut_lineage

ARITY = 3
LEVELS = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
INDEX_BITS = 33  # of monotonically_increasing_id


def digest(parts):
    """Lower-case hex SHA-256 of the hex digests, one after the other."""
    return sha256("".join(parts).encode()).hexdigest()


def field(value):
    """A value as it enters a leaf: its bytes after their number, '-' for null."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(**changed):
    columns = [field(changed.get(name, F.col(name))) for name in FIELDS]
    return F.sha2(F.concat(*columns).cast("binary"), 256)


def leaves(docs: DataFrame, tampered) -> DataFrame:
    """source, doc_id, leaf and other (the tampered leaf; '' where it is the same)."""
    plain = docs.select(*(F.col(n).cast("long" if n in ("doc_id", "n_chars") else "string").alias(n) for n in FIELDS))
    text = F.when(tampered(F.col("doc_id")), F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    touched = F.coalesce(text != F.col("text"), F.lit(False))
    return plain.select("source", "doc_id", leaf().alias("leaf"), F.when(touched, leaf(text=text)).otherwise("").alias("other"))


def even_checksum(doc_id):
    """Ids whose decimal digits have an even CRC-32."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.lit(False))


def numbered(sorted_rows: DataFrame) -> DataFrame:
    """The rows of a table with tree (the place in the table at which the source begins) and place
    (in the source); `sorted_rows` has the column at, the row's partition and place in it."""
    part, index = F.shiftright("at", INDEX_BITS), F.col("at").bitwiseAND((1 << INDEX_BITS) - 1)
    rows = sorted_rows.withColumn("part", part).withColumn("index", index)
    runs = cut_lineage(rows.groupBy("part", "source").agg(F.min("index").alias("first"), F.count(F.lit(1)).alias("n")))
    # one row a partition: its size, first and last source, and where the last one begins
    ends = runs.groupBy("part").agg(
        F.sum("n").alias("n"), F.min_by(F.struct("source"), "first").alias("head"),
        F.max_by(F.struct("source"), "first").alias("tail"), F.max("first").alias("tail_first"))
    order = Window.orderBy("part")
    before = F.sum("n").over(order) - F.col("n")
    joined = F.coalesce(F.lag("tail").over(order) == F.col("head"), F.lit(False))
    ends = ends.withColumn("before", before).withColumn("joined", joined)
    own = F.when((F.col("tail_first") > 0) | ~F.col("joined"), F.col("before") + F.col("tail_first"))
    ends = ends.withColumn("open", F.last(own, ignorenulls=True).over(order))
    ends = ends.withColumn("head_tree", F.when(F.col("joined"), F.lag("open").over(order)).otherwise(F.col("before")))
    # one row a partition and source; each partition has its own part of a source
    trees = runs.select("part", "source", "first").join(ends.select("part", "before", "head_tree"), "part").select(
        "part", F.col("source").alias("__source"), "before",
        F.when(F.col("first") == 0, F.col("head_tree")).otherwise(F.col("before") + F.col("first")).alias("tree"))
    found = rows.join(trees.withColumnRenamed("part", "__part"),
                      (F.col("part") == F.col("__part")) & F.col("source").eqNullSafe(F.col("__source")))
    return found.select("tree", (F.col("before") + F.col("index") - F.col("tree")).alias("place"),
                        *(c for c in sorted_rows.columns if c not in ("at", "source")))


def reduced(nodes, levels, arity):
    """All levels of a superblock's nodes, the given ones first: up to `levels` more, or with None
    until one node is left."""
    out = [nodes]
    while levels is None and len(out[-1]) > 1 or levels is not None and len(out) <= levels:
        last = out[-1]
        out.append([digest(last[i:i + arity]) for i in range(0, len(last), arity)])
    return out


def blocks(frame, size):
    """(tree, number of the superblock, rows by place) of a group."""
    keyed = frame.assign(block=frame["place"] // size).sort_values(["tree", "place"], kind="stable")
    for (tree, number), rows in keyed.groupby(["tree", "block"], sort=False):
        yield tree, number, rows


def group_key(size):
    """Superblocks that begin in the same stretch of `size` rows of the whole table share a group."""
    return F.floor((F.col("tree") + F.floor(F.col("place") / size) * size) / size).alias("bundle")


def climb(nodes: DataFrame, levels: int, arity: int) -> DataFrame:
    """tree, place, node of the superblocks; tree and place stay in the units of the table below."""
    size = arity ** levels

    def run(frame):
        out = []
        for tree, number, rows in blocks(frame, size):
            top = reduced(rows["node"].tolist(), levels if number else None, arity)[-1]
            out.append((tree, number, top[0]))
        return pd.DataFrame(out, columns=["tree", "place", "node"])
    keyed = nodes.select("tree", "place", "node", group_key(size))
    return cut_lineage(keyed.groupBy("bundle").applyInPandas(run, "tree long, place long, node string"))


def siblings(levels, arity):
    """For each node of the lowest level, the (left, right) siblings of every level up to the top."""
    out = []
    for i in range(len(levels[0])):
        path = []
        for nodes in levels[:-1]:
            first = i - i % arity
            path.append(("".join(nodes[first:i]), "".join(nodes[i + 1:first + arity])))
            i //= arity
        out.append(path)
    return out


def folded(node, path):
    for left, right in path:
        node = digest([left, node, right])
    return node


def written(path):
    return ";".join(f"{left},{right}" for left, right in path)


def read(path):
    return [tuple(step.split(",")) for step in path.split(";")] if path else []


def descend(nodes: DataFrame, outer: DataFrame, levels: int, arity: int, finish, schema: str) -> DataFrame:
    """Cogroups nodes (tree, place, node, ...) with outer (tree, place of the superblock, path: the
    siblings from its node up, and whatever else goes down) and returns what `finish(row, siblings,
    outer row)` says of each node."""
    size = arity ** levels

    def run(left, right):
        wanted = {(r.tree, r.place): r for r in right.itertuples()}
        out = []
        for tree, number, rows in blocks(left, size):
            up = wanted[tree, number]
            rest = read(up.path)
            inner = siblings(reduced(rows["node"].tolist(), levels if number else None, arity), arity)
            out += [finish(row, path + rest, up) for row, path in zip(rows.itertuples(), inner)]
        return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])
    bundle = F.floor((F.col("tree") + F.col("place") * size) / size).alias("bundle")
    return nodes.select("*", group_key(size)).groupBy("bundle").cogroup(
        outer.select("*", bundle).groupBy("bundle")).applyInPandas(run, schema)


def tops(nodes: DataFrame, levels: int, arity: int):
    """The levels of superblock nodes above `nodes`, the last one with one node a tree.

    A tree's number is where it begins in the table it came from. It stays the same on the way up,
    so upper levels, which are small, keep to few groups.
    """
    found = [climb(nodes, levels, arity)]
    while found[-1].filter("place > 0").take(1):
        found.append(climb(found[-1], levels, arity))
    return found


def way_down(found, paths, levels, arity, more, kind):
    """paths (tree, place, path and `more`) of the nodes in found[0], from those of the last level."""
    for nodes in reversed(found[:-1]):
        def finish(row, path, up, more=tuple(more)):
            return (row.tree, row.place, written(path), *(getattr(up, m) for m in more))
        paths = cut_lineage(descend(nodes, paths, levels, arity, finish, f"tree long, place long, path string{kind}"))
    return paths


def manifest(docs: DataFrame, tampered=even_checksum, levels: int = LEVELS, arity: int = ARITY) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every document.

    `tampered` says of an id's column whether the document's line feeds were taken out after the
    manifest was made.
    """
    rows = cut_lineage(leaves(docs, tampered))  # sampling for the ranges would hash every text once more
    ordered = rows.repartitionByRange("source", "doc_id", "leaf").sortWithinPartitions("source", "doc_id", "leaf")
    placed = numbered(cut_lineage(ordered.withColumn("at", F.monotonically_increasing_id())))
    placed = cut_lineage(placed.withColumnRenamed("leaf", "node"))
    told = placed.withColumn("doc_id", F.col("doc_id").cast("string"))  # pandas would make a double of an id next to a null

    found = tops(placed.select("tree", "place", "node"), levels, arity)
    # the subroots are the leaves of one more tree; sources begin in their order
    subroots = found[-1].select(F.col("tree").alias("source"), F.col("node"))
    ranked = subroots.repartitionByRange("source").sortWithinPartitions("source").withColumn(
        "at", F.monotonically_increasing_id())
    one = cut_lineage(ranked.withColumn("own", F.col("source")).withColumn("source", F.lit(0)))
    upper = cut_lineage(numbered(one))
    over = tops(upper.select("tree", "place", "node"), levels, arity)
    root = over[-1].select("tree", "place", F.lit("").alias("path"), F.col("node").alias("root"))
    paths = way_down(over, root, levels, arity, ["root"], ", root string")

    def to_source(row, path, up):
        return row.own, 0, written(path), row.node, up.root
    paths = cut_lineage(descend(upper, paths, levels, arity, to_source,
                                "tree long, place long, path string, subroot string, root string"))
    paths = way_down(found, paths, levels, arity, ["subroot", "root"], ", subroot string, root string")

    def proven(row, path, up):
        proof = digest([x for step in path for x in step])
        top = folded(row.other or row.node, path)
        return row.doc_id, row.node, up.subroot, up.root, proof, top, top == up.root
    schema = ("doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
              "verified boolean")
    return descend(told, paths, levels, arity, proven, schema).withColumn("doc_id", F.col("doc_id").cast("long"))


#: The same level by level; the checksum is computed bit by bit.
ORACLE = f"""
WITH RECURSIVE e AS (
  SELECT row_number() OVER () AS r, doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) AS src, text,
         {" || ".join(f"coalesce(strlen({n}::VARCHAR)::VARCHAR || ':' || {n}::VARCHAR, '-')" for n in FIELDS[:-1])} AS head,
         xor(list_reduce(list_concat([4294967295::BIGINT],
                         list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
             lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))),
             4294967295) AS crc
  FROM documents),
d AS MATERIALIZED (
  SELECT r, doc_id, src, sha256(head || coalesce(strlen(text)::VARCHAR || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(t)::VARCHAR || ':' || t, '-')) AS other
  FROM (SELECT *, CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS t FROM e)),
p AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i,
         count(*) OVER (PARTITION BY src) AS n FROM d),
up AS (
  SELECT src, 0 AS lvl, i, n, leaf AS h FROM p
  UNION ALL
  SELECT src, lvl + 1, i // {ARITY}, (n + {ARITY - 1}) // {ARITY}, sha256(string_agg(h, '' ORDER BY i))
  FROM up WHERE n > 1 GROUP BY src, lvl, i // {ARITY}, n),
s AS MATERIALIZED (SELECT src, lvl AS k, h AS subroot, row_number() OVER (ORDER BY src) - 1 AS i, count(*) OVER () AS n
                   FROM up WHERE n = 1),
over_ AS (
  SELECT 0 AS lvl, i, n, subroot AS h FROM s
  UNION ALL
  SELECT lvl + 1, i // {ARITY}, (n + {ARITY - 1}) // {ARITY}, sha256(string_agg(h, '' ORDER BY i))
  FROM over_ WHERE n > 1 GROUP BY lvl, i // {ARITY}, n),
levels AS (
  SELECT p.r, u.lvl, u.i < p.i // ({ARITY} ** u.lvl)::BIGINT AS before, u.i, u.h
  FROM p JOIN up u ON p.src = u.src AND u.n > 1 AND u.i // {ARITY} = p.i // ({ARITY} ** (u.lvl + 1))::BIGINT
       AND u.i <> p.i // ({ARITY} ** u.lvl)::BIGINT
  UNION ALL
  SELECT p.r, s.k + o.lvl, o.i < s.i // ({ARITY} ** o.lvl)::BIGINT, o.i, o.h
  FROM p JOIN s USING (src) JOIN over_ o ON o.n > 1 AND o.i // {ARITY} = s.i // ({ARITY} ** (o.lvl + 1))::BIGINT
       AND o.i <> s.i // ({ARITY} ** o.lvl)::BIGINT),
proof AS (SELECT r, sha256(string_agg(h, '' ORDER BY lvl, i)) AS proof FROM levels GROUP BY r),
sides AS MATERIALIZED (
  SELECT r, lvl, coalesce(string_agg(h, '' ORDER BY i) FILTER (before), '') AS l,
         coalesce(string_agg(h, '' ORDER BY i) FILTER (NOT before), '') AS t FROM levels GROUP BY r, lvl),
height AS (SELECT p.r, s.k + (SELECT max(lvl) FROM over_) AS k FROM p JOIN s USING (src)),
fold AS (
  SELECT p.r, 0 AS lvl, other AS h, k FROM p JOIN height USING (r)
  UNION ALL
  SELECT f.r, f.lvl + 1, sha256(coalesce(x.l, '') || f.h || coalesce(x.t, '')), f.k
  FROM fold f LEFT JOIN sides x ON x.r = f.r AND x.lvl = f.lvl WHERE f.lvl < f.k)
SELECT p.doc_id, p.leaf, s.subroot, o.h AS root, coalesce(q.proof, sha256('')) AS proof_sha256, f.h AS folded_root,
       f.h = o.h AS verified
FROM p JOIN s USING (src) JOIN over_ o ON o.n = 1 LEFT JOIN proof q ON q.r = p.r JOIN fold f ON f.r = p.r AND f.lvl = f.k
"""
