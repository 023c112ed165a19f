"""Exact search for the largest inner products, by buckets of vectors of like length.

Queries and candidates are dealt into cells: a cell holds one block of queries and one
slice of the candidates, drawn by a hash of the row, so no length, direction or repeated
vector makes a cell hot. A task sorts its cell: the queries come first, then the candidates
by falling length, which are cut into buckets where `BUCKET` rows or a tenth of the length
is passed. Only the queries and one bucket are in memory.

Each query knows the least score that still counts, its k-th best so far. Over the query's
length times the bucket's largest length that is a local threshold on the cosine. Above 1 no
candidate of this or any later bucket counts, and the query is done. Otherwise the bucket
is pruned in one of two ways:

- by coordinate, where a high threshold confines the coordinates of unit vectors: on the
  query's `FOCUS` largest coordinates a candidate must lie in an interval around the query's
  own one; the most selective interval, found in the bucket's sorted coordinates, gives the
  candidates, and it is taken if it keeps less than `SHARE` of what length leaves;
- by length otherwise: candidates are sorted, so the ones long enough are a prefix.

What is left is verified by its whole-number product. The best of a query's cells are merged.

With A blocks of queries and B slices, each candidate is sent A times and each query B times.
A is the number of queries over `QUERIES`, so for very many queries the work and what is sent
grow with queries times candidates, as an exact search against every row must.

Defined results: a row is a query if its vec_id is divisible by `every` (null is not), and is
no candidate of its own; another row with the same id or vector is one. Ties in score go to the
smaller vec_id, a null id last. Vectors of different lengths have no product. Scores beyond a
long count as the nearest long. Equal rows that are queries get their answers each. An empty
table, or one without a query, gives an empty result; columns besides vec_id and embedding are
not looked at.
"""

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.vectors import quantised, unpack
from parley.session import cut_lineage, spread

SCALE = 64
EVERY = 20
K = 20
#: Queries of one block, and the most slices of the candidates.
QUERIES = 65_536
SLICES = 12
#: Rows of one bucket, and the share of its largest length that the shortest has at least.
BUCKET = 4_096
RATIO = 0.9
#: Coordinates looked at, and the share of the bucket below which they decide.
FOCUS = 4
SHARE = 0.125
#: Products are exact in doubles (and in floats) while lengths multiply to less than this.
DOUBLES = float(1 << 52)
FLOATS = float(1 << 23)
LONG = (1 << 63) - 1
#: Scores computed at once.
AT_ONCE = 1 << 22

FOUND = "query_row long, query_id long, vec_id long, score long"


def nearest_long(value):
    return max(-LONG - 1, min(LONG, int(value)))


def interval(own, threshold):
    """Where a unit vector's coordinate lies if its cosine with a unit vector, whose coordinate
    is `own`, is at least `threshold` (between 0 and 1); wider by a rounding error."""
    off = np.sqrt(np.maximum(0, (1 - threshold ** 2) * (1 - own ** 2)))
    low = np.where(own <= -threshold, -1.0, own * threshold - off)
    high = np.where(own >= threshold, 1.0, own * threshold + off)
    return low - 1e-9, high + 1e-9


class Bucket:
    """Candidates of like length, longest first."""

    def __init__(self, rows, ids, norms, matrix):
        self.rows, self.ids, self.norms, self.matrix = rows, ids, norms, matrix
        self.ranked = None

    def by_coordinate(self, f):
        """The order of the unit vectors on coordinate f, and the coordinate in that order."""
        if self.ranked is None:
            self.ranked = {}
            self.unit = self.matrix / np.maximum(self.norms, 1e-300)[:, None]
        if f not in self.ranked:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.ranked[f] = order, self.unit[order, f]
        return self.ranked[f]


class Cell:
    """A block of queries with the best candidates met so far.

    Sums of products are exact in floating point as long as no product of two lengths gets
    near 2^23 (floats) or 2^52 (doubles); `plain` counts with Python's numbers beyond that.
    """

    def __init__(self, rows, ids, norms, matrix, k=K):
        self.rows, self.ids, self.norms, self.matrix, self.k = rows, ids, norms, matrix, k
        n = len(rows)
        self.score = np.full((n, k), -np.inf)
        self.best = np.full((n, k), np.iinfo(np.int64).max)  # ids; null ids are the largest long
        self.row = np.full((n, k), -1, np.int64)
        self.going = np.ones(n, bool)
        self.heaps = None
        self.verified = self.pruned = 0
        focus = min(FOCUS, matrix.shape[1])
        self.focus = np.argsort(-np.abs(matrix), axis=1, kind="stable")[:, :focus]

    def meet(self, bucket):
        """Takes the bucket's candidates in; buckets come by falling length."""
        longest = bucket.norms[0]
        if self.heaps is not None or longest * self.norms.max(initial=0) >= DOUBLES:
            return self.plain(bucket)
        least = self.score[:, -1]
        reach = self.norms * longest
        self.going &= ~(least > reach * (1 + 1e-9) + 1e-9)
        at = np.flatnonzero(self.going)
        if not len(at):
            return
        # lengths fall, so the long enough ones are a prefix; a score of 0 or less rules none out
        wanted = np.where(least[at] > 0, least[at] / np.maximum(self.norms[at], 1e-300), 0) * (1 - 1e-9)
        prefix = np.searchsorted(-bucket.norms, -wanted, side="right")
        local = np.where(least[at] > 0, least[at] / np.maximum(reach[at], 1e-300), 0) * (1 - 1e-9)
        found = self.by_coordinate(bucket, at, np.clip(local, 0, 1), prefix)
        whole = at[~found]
        self.pruned += int((len(bucket.rows) - prefix).sum())
        kind = np.float32 if longest * self.norms.max() < FLOATS else np.float64
        right = bucket.matrix.astype(kind)
        step = max(1, AT_ONCE // len(bucket.rows))
        width = prefix[~found]
        for i in range(0, len(whole), step):
            part, n = whole[i:i + step], int(width[i:i + step].max())
            self.take(part, self.matrix[part].astype(kind) @ right[:n].T, bucket, n)

    def by_coordinate(self, bucket, at, local, prefix):
        """Serves the queries whose intervals are narrow; true where that was done."""
        done = np.zeros(len(at), bool)
        near = np.flatnonzero(local > 0.5)  # below that an interval holds nearly every coordinate
        if not len(near) or not self.focus.shape[1]:
            return done
        unit = self.matrix[at[near]] / np.maximum(self.norms[at[near]], 1e-300)[:, None]
        focus = self.focus[at[near]]
        own = np.take_along_axis(unit, focus, axis=1)
        low, high = interval(own, local[near][:, None])
        first, last = np.zeros(focus.shape, np.int64), np.zeros(focus.shape, np.int64)
        for f in np.unique(focus):
            values = bucket.by_coordinate(f)[1]
            hit = focus == f
            first[hit] = np.searchsorted(values, low[hit], side="left")
            last[hit] = np.searchsorted(values, high[hit], side="right")
        size = last - first
        pick = size.argmin(axis=1)
        for i in np.flatnonzero(size.min(axis=1) < SHARE * prefix[near]):
            q, c = at[near[i]], pick[i]
            order = bucket.by_coordinate(focus[i, c])[0][first[i, c]:last[i, c]]
            for g in range(focus.shape[1]):
                if g != c:
                    value = bucket.unit[order, focus[i, g]]
                    order = order[(value >= low[i, g]) & (value <= high[i, g])]
            order = np.sort(order[order < prefix[near[i]]])
            done[near[i]] = True
            self.pruned += len(bucket.rows) - len(order)
            if len(order):
                self.take(np.array([q]), self.matrix[[q]] @ bucket.matrix[order].T, bucket, order)
        return done

    def take(self, at, scores, bucket, which):
        """Merges the scores of queries `at` with the bucket's candidates `which` (a count or indices)."""
        ids = bucket.ids[:which] if np.isscalar(which) else bucket.ids[which]
        rows = bucket.rows[:which] if np.isscalar(which) else bucket.rows[which]
        self.verified += scores.size
        least, worst = self.score[at, -1], self.best[at, -1]
        if scores.shape[1] > self.k:  # the k-th best of the bucket, the query's own row aside, is a bound as well
            n = scores.shape[1]
            bound = np.partition(scores, n - self.k - 1, axis=1)[:, n - self.k - 1]
            worst = np.where(bound > least, np.iinfo(np.int64).max, worst)
            least = np.maximum(least, bound)
        q, c = np.nonzero(scores >= least[:, None].astype(scores.dtype))
        score = scores[q, c].astype(np.float64)
        keep = (rows[c] != self.rows[at[q]]) & ((score > least[q]) | (ids[c] <= worst[q]))
        q, c, score = q[keep], c[keep], score[keep]
        some = np.unique(q)
        old = self.score[at[some]] > -np.inf
        held = np.repeat(some, old.sum(axis=1))
        q = np.r_[held, q]
        score = np.r_[self.score[at[some]][old], score]
        best = np.r_[self.best[at[some]][old], ids[c]]
        row = np.r_[self.row[at[some]][old], rows[c]]
        order = np.lexsort((row, best, -score, q))
        q, order = q[order], order
        rank = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        order, q, rank = order[rank < self.k], q[rank < self.k], rank[rank < self.k]
        self.score[at[q], rank], self.best[at[q], rank], self.row[at[q], rank] = score[order], best[order], row[order]

    def plain(self, bucket):
        """Products in numbers without bound, for components that are very large."""
        if self.heaps is None:
            self.heaps = [[(int(s), -int(b), -int(r)) for s, b, r in zip(*x) if s > -np.inf]
                          for x in zip(self.score, self.best, self.row)]
            for heap in self.heaps:
                heapq.heapify(heap)
        right = [[int(x) for x in row] for row in bucket.matrix]
        for heap, mine, left in zip(self.heaps, self.rows, self.matrix):
            left = [int(x) for x in left]
            for other, number, row in zip(right, bucket.ids, bucket.rows):
                if row != mine:
                    item = nearest_long(sum(a * b for a, b in zip(left, other))), -int(number), -int(row)
                    heapq.heappush(heap, item) if len(heap) < self.k else heapq.heappushpop(heap, item)

    def answers(self):
        """query_row, query_id, vec_id, score as Arrow arrays."""
        if self.heaps is None:
            q, rank = np.nonzero(self.score > -np.inf)
            score, best = self.score[q, rank].astype(np.int64), self.best[q, rank]
        else:
            q = np.repeat(np.arange(len(self.rows)), [len(h) for h in self.heaps])
            flat = [x for h in self.heaps for x in h]
            score, best = np.array([x[0] for x in flat], np.int64), np.array([-x[1] for x in flat], np.int64)
        return [pa.array(self.rows[q]), pa.array(self.ids[q]),
                pa.array(best, mask=best == np.iinfo(np.int64).max), pa.array(score)]


def cut_buckets(norms, size=BUCKET, ratio=RATIO):
    """Where buckets end in falling lengths: after `size` rows or where the length falls below `ratio`."""
    ends, start = [], 0
    while start < len(norms):
        short = np.searchsorted(-norms, -norms[start] * ratio, side="right")
        start = min(start + size, max(int(short), start + 1))
        ends.append(start)
    return ends


def search(k):
    """The task: cells one after the other, each with its queries first, then candidates by falling length."""
    names = ["query_row", "query_id", "vec_id", "score"]

    def run(batches):
        now, cell, queries = None, None, []
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(7)]
            packed = batch.column(7).to_pylist()
            key = np.stack(columns[:3], axis=1).astype(np.int64)
            edges = np.flatnonzero((key[1:] != key[:-1]).any(axis=1) | (columns[3][1:] != columns[3][:-1])) + 1
            for a, b in zip([0, *edges], [*edges, len(key)]):
                if b <= a:
                    continue
                this = tuple(key[a])
                if this != now:
                    if cell is not None:
                        yield pa.RecordBatch.from_arrays(cell.answers(), names)
                    now, cell, queries = this, None, []
                part = [c[a:b] for c in columns[4:]] + [unpack(packed[a:b], this[0])]
                if columns[3][a] == 0:
                    queries.append(part)
                    continue
                if cell is None:
                    if not queries:
                        continue
                    cell, queries = Cell(*(np.concatenate(p) for p in zip(*queries)), k), []
                start = 0
                for end in cut_buckets(part[2]):
                    cell.meet(Bucket(*(p[start:end] for p in part)))
                    start = end
        if cell is not None:
            yield pa.RecordBatch.from_arrays(cell.answers(), names)
    return run


def top_k(embeddings: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, queries: int = QUERIES,
          slices: int = SLICES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest products of every query."""
    spark = embeddings.sparkSession
    typed = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows = cut_lineage(quantised(typed, scale, "vec_id").withColumn("row", F.monotonically_increasing_id()))
    asked = rows.filter(F.col("vec_id") % every == 0)
    blocks = max(1, math.ceil(asked.count() / queries))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(slices, math.ceil(tasks / blocks)))

    def dealt(column, n):
        return F.pmod(F.xxhash64("row", F.lit(column)), F.lit(n)).cast("int").alias(column)

    def every_one(column, n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(column)
    # a null id counts as the largest long, which puts it last
    rest = [F.coalesce("vec_id", F.lit(LONG)).alias("vec_id"), "norm", "packed"]
    cells = (asked.select("dim", dealt("block", blocks), every_one("slice", parts), F.lit(0).alias("kind"), "row", *rest)
             .union(rows.select("dim", every_one("block", blocks), dealt("slice", parts), F.lit(1), "row", *rest)))
    placed = spread(cells, "dim", "block", "slice").sortWithinPartitions(
        "dim", "block", "slice", "kind", F.desc("norm"), "vec_id")
    found = placed.mapInArrow(search(k), FOUND)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


#: Brute force over all pairs of a query and a row; `every` and `k` as above.
ORACLE = f"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % {EVERY} = 0),
n AS (
  SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM n WHERE rank <= {K}
"""
