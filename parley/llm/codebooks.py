"""Vector code compression with norm-of-sum bounds.

Vectors of whole numbers are cut into `PARTS` equal parts; each part position has a codebook
of up to `ENTRIES` entries, refined in `ROUNDS` rounds of assigning parts to their nearest
entry and moving entries to the mean of their parts, rounded down.

The driver keeps every codebook there ever was: rounds times 16 small entries a part. A part
keeps its entry, an upper bound on the distance to it and a lower bound on the distance to
every other entry, each with the stamp of the round in which it was exact. A round compares
the bounds after moving them by how far entries truly got from where they were at the stamp,
the length of the sum of their moves, which is never more and mostly much less than the sum
of the lengths that bounds carried from round to round would add up. If the upper bound is
below the lower one, the entry stays and no distance is computed. Else the distance to the
own entry is made exact, and only if that does not settle it are all entries scanned.

A round is one pass that writes the rows with their bounds to the shared folder, and with
them one row a task that holds the sums and counts of its parts, which are added up by a
group by; the driver gets one codebook's sums. The table of the round before is deleted.

Defined results: vectors that are null or hold null or non-finite components are dropped, and
so are vectors without components, of a length that parts do not divide, or of another length
than the first (the one with the least id) of those left. The first codebook is that of the
rows with the least ids, of equal ids the lesser vectors, null ids last; with fewer rows it has
fewer entries. Equal rows count as often as they occur. All numbers are exact: components up
to 2^27 in 64 bits, larger ones (up to 2^62, see `vectors`) in numbers without bound; an error
beyond a long counts as the largest long. Null labels count as one label. An empty table gives
an empty one. Columns besides vec_id, embedding and label are not looked at.
"""

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.vectors import LARGEST, quantised, unpack, usable
from parley.session import cut_lineage, discard

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
LONG = (1 << 63) - 1
#: Components up to this have exact distances in 64 bits.
SMALL = float(1 << 27)
#: A label with more than this share of the rows has its sum broadcast, so at most 1/share sums are.
HOT_LABEL = 1 / 1_000

#: Bounds of a part: its entry, and distances with the rounds in which they were exact.
BOUNDS = np.dtype([("entry", "u1"), ("upper_at", "u1"), ("lower_at", "u1"), ("upper", "<f4"), ("lower", "<f4")])
SUMS = "array<struct<part:int,entry:int,n:long,total:array<decimal(38,0)>>>"


def squares(parts, entries):
    """Exact squared distances of every row of `parts` from every entry."""
    return np.square(parts[:, None, :] - entries[None, :, :]).sum(axis=2)


def own_square(parts, entries, entry):
    return np.square(parts - entries[entry]).sum(axis=1)


def root(values):
    return np.sqrt(values.astype(np.float64))


def above(values):
    """Floats that are not less than the values."""
    return np.nextafter(np.minimum(values, 3e38).astype(np.float32), np.float32(np.inf)) if len(values) else values


def below(values):
    """Floats that are not more than the values."""
    return np.nextafter(np.minimum(values, 3e38).astype(np.float32), np.float32(0)) if len(values) else values


class History:
    """Every codebook so far, and how far entries are from where they were in each round.

    A codebook is an array (part, entry, component) of whole numbers.
    """

    def __init__(self, books):
        self.books = books
        now = books[-1]
        moved = [np.sqrt(np.square((now - b).astype(np.float64)).sum(axis=2)) * (1 + 1e-9) for b in books]
        self.moved = np.stack(moved)  # round, part, entry
        n = now.shape[1]
        others = np.where(np.eye(n, dtype=bool), 0.0, self.moved[:, :, None, :])
        self.others = others.max(axis=3)  # round, part, entry: the furthest move of any other entry


def assign(vectors, bounds, history, exact=False):
    """The bounds of this round, and how many parts were scanned.

    `vectors`: rows of whole numbers; `bounds`: their bounds of the round before, or None in the
    first. With `exact` the squared distances to the own entries come as well.
    """
    now, stamp = history.books[-1], len(history.books) - 1
    n, (parts, entries, width) = len(vectors), now.shape
    cut = vectors.reshape(n, parts, width)
    out = np.zeros((n, parts), BOUNDS) if bounds is None else bounds.copy()
    far = np.zeros((n, parts), vectors.dtype) if exact else None
    scanned = 0
    for p in range(parts):
        mine, book = cut[:, p], now[p]
        mark = out[:, p]
        if bounds is None:
            left = np.arange(n)
        else:
            entry = mark["entry"].astype(np.int64)
            upper = mark["upper"] + history.moved[mark["upper_at"], p, entry]
            lower = mark["lower"] - history.others[mark["lower_at"], p, entry]
            # computed in doubles: a part in 10^9 is far more than their error
            left = np.flatnonzero(~(upper * (1 + 1e-9) < lower)) if not exact else np.arange(n)
            square = own_square(mine[left], book, entry[left])
            mark["upper"][left], mark["upper_at"][left] = above(root(square)), stamp
            if exact:
                far[:, p] = square
            left = left[~(root(square) * (1 + 1e-9) < lower[left])]
        if not len(left):
            continue
        scanned += len(left)
        found = squares(mine[left], book)
        entry = found.argmin(axis=1)  # the first of equal ones
        rows = np.arange(len(left))
        square = found[rows, entry]
        if entries > 1:
            others = root(found)
            others[rows, entry] = np.inf
            lower = below(others.min(axis=1))
        else:
            lower = np.full(len(left), 3e38, np.float32)
        mark["entry"][left], mark["upper"][left], mark["lower"][left] = entry, above(root(square)), lower
        mark["upper_at"][left] = mark["lower_at"][left] = stamp
        if exact:
            far[left, p] = square
    return out, far, scanned


def numbers(vectors, history=()):
    """The doubles as whole numbers: 64 bits where distances fit, else without bound."""
    largest = max([np.abs(vectors).max(initial=0)] + [float(np.abs(b).max(initial=0)) for b in history])
    if largest <= SMALL:
        return vectors.astype(np.int64)
    return np.array([[int(x) for x in row] for row in vectors], object).reshape(vectors.shape)


class Sums:
    """Sums and counts of the parts of each entry."""

    def __init__(self, shape):
        self.n = np.zeros(shape[:2], np.int64)
        self.total = np.zeros(shape, object)

    def add(self, vectors, bounds):
        parts, entries, width = self.total.shape
        cut = vectors.reshape(len(vectors), parts, width)
        for p in range(parts):
            entry = bounds[:, p]["entry"].astype(np.int64)
            self.n[p] += np.bincount(entry, minlength=entries)
            part = np.zeros((entries, width), vectors.dtype)
            np.add.at(part, entry, cut[:, p])
            self.total[p] += part

    def rows(self):
        return [{"part": int(p), "entry": int(e), "n": int(self.n[p, e]), "total": [Decimal(int(x)) for x in self.total[p, e]]}
                for p, e in zip(*np.nonzero(self.n))]


def first_book(vectors, scale, parts):
    """The codebook of these vectors, lists of doubles."""
    matrix = np.clip(np.floor(np.array(vectors, np.float64) * scale), -LARGEST, LARGEST)
    whole = np.array([[int(x) for x in row] for row in matrix], object)
    return slim(whole.reshape(len(vectors), parts, -1).transpose(1, 0, 2))


def slim(book):
    """64-bit numbers where distances to others of their kind fit."""
    return book.astype(np.int64) if np.abs(book).max(initial=0) <= SMALL else book


def run_round(rows, books, last):
    """One pass over the rows: assigns all parts, and returns rows with bounds and the tasks' sums,
    or in the last round the codes and errors."""
    label = rows.schema["label"].dataType.simpleString()
    began = "bounds" in rows.columns
    sent = [np.array(b.tolist(), object) if b.dtype == object else b for b in books]
    kind = pa.list_(pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()),
                               ("total", pa.list_(pa.decimal128(38, 0)))]))

    def run(batches):
        history, wide, sums, empty = History(sent), None, Sums(sent[-1].shape), None
        for batch in batches:
            columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            n, packed = batch.num_rows, columns["packed"].to_pylist()
            if not n:
                continue
            vectors = numbers(unpack(packed, sent[-1].shape[0] * sent[-1].shape[2]), sent)
            told = history
            if vectors.dtype == object:
                wide = told = wide or History([b.astype(object) for b in sent])
            bounds = None
            if began:
                bounds = np.frombuffer(b"".join(columns["bounds"].to_pylist()), BOUNDS).reshape(n, -1)
            bounds, far, _ = assign(vectors, bounds, told, last)
            keep = [columns["vec_id"], columns["label"]]
            if last:
                error = far.sum(axis=1)
                code = [bytes(r).hex() for r in np.ascontiguousarray(bounds["entry"])]
                yield pa.RecordBatch.from_arrays(
                    [*keep, pa.array(code), pa.array([min(LONG, int(x)) for x in error], pa.int64())],
                    names=["vec_id", "label", "code", "error"])
                continue
            sums.add(vectors, bounds)
            empty = columns["label"].type
            yield pa.RecordBatch.from_arrays(
                [*keep, columns["packed"], pa.array([r.tobytes() for r in bounds], pa.binary()), pa.nulls(n, kind)],
                names=["vec_id", "label", "packed", "bounds", "sums"])
        if empty is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64()), pa.nulls(1, empty), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()),
                 pa.array([sums.rows()], kind)], names=["vec_id", "label", "packed", "bounds", "sums"])
    schema = f"vec_id long, label {label}, " + ("code string, error long" if last else f"packed binary, bounds binary, sums {SUMS}")
    return rows.mapInArrow(run, schema)


def moved_book(table, book):
    """The codebook after the tasks' sums; entries without parts stay."""
    each = table.filter("sums IS NOT NULL").select(F.explode("sums").alias("s")).select("s.*")
    flat = each.select("part", "entry", "n", F.posexplode("total").alias("place", "x"))
    out = book.astype(object)
    for r in flat.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect():
        out[r.part, r.entry, r.place] = int(r.x) // r.n
    return slim(out)


def compress(embeddings: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS):
    """(rows, codebook): vec_id, label, code (two hex digits a part) and error of every vector that
    takes part, and the final codebook, an array (part, entry, component); None without vectors."""
    typed = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "label",
                              F.col("embedding").cast("array<double>").alias("embedding"))
    fit = typed.filter(usable() & (F.size("embedding") > 0) & (F.size("embedding") % parts == 0))
    ranked = [F.asc_nulls_last("vec_id"), "embedding"]
    first = fit.orderBy(*ranked).select("embedding").take(1)
    if not first:
        none = fit.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return none.limit(0), None
    alike = fit.filter(F.size("embedding") == len(first[0][0]))
    books = [first_book([r[0] for r in alike.orderBy(*ranked).select("embedding").take(entries)], scale, parts)]
    done = cut_lineage(quantised(alike, scale, "vec_id", "label").select("vec_id", "label", "packed"))
    table = done
    for k in range(rounds + 1):
        old, done = done, cut_lineage(run_round(table, books, k == rounds))
        discard(old)
        if k < rounds:
            books.append(moved_book(done, books[-1]))
            table = done.filter("packed IS NOT NULL").select("vec_id", "label", "packed", "bounds")
    return done, books[-1]


def with_label_sums(rows: DataFrame) -> DataFrame:
    """Adds label_error, the sum of `error` over equal labels. Labels that hold more than a
    thousandth of the rows are at most a thousand; their sums are broadcast, so the join by
    shuffle that serves the others meets no large label."""
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long")
    sums = cut_lineage(rows.groupBy("label").agg(total.alias("label_error"), F.count(F.lit(1)).alias("__n"))
                       .withColumnRenamed("label", "__label"))
    n = sums.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    hot, rest = (sums.filter(c).drop("__n") for c in (F.col("__n") > n * HOT_LABEL, F.col("__n") <= n * HOT_LABEL))
    same = F.col("label").eqNullSafe(F.col("__label"))
    first = rows.join(F.broadcast(hot), same, "left")
    if not rest.take(1):
        return first.drop("__label")
    done = first.filter("label_error IS NOT NULL").drop("__label")
    left = first.filter("label_error IS NULL").drop("__label", "label_error")
    return done.unionByName(left.join(rest, same).drop("__label"))


def digest(book):
    """SHA-256 of all numbers of a codebook, in order, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for x in book.reshape(-1)).encode()).hexdigest()


def report(embeddings: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 per vector that takes part."""
    rows, book = compress(embeddings)
    return with_label_sums(rows).select(
        "vec_id", "code", "error", "label_error", F.lit(None if book is None else digest(book)).cast("string").alias("codebooks_sha256"))


def oracle(scale=SCALE, parts=PARTS, entries=ENTRIES, rounds=ROUNDS):
    """The same by scanning every entry in every round."""
    near = """
  SELECT p.r, p.part, arg_min(c.entry, (list_sum(list_transform(list_zip(p.x, c.y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c.entry)) AS entry,
         min(list_sum(list_transform(list_zip(p.x, c.y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS far
  FROM p JOIN c{k} c USING (part) GROUP BY p.r, p.part"""
    steps = []
    for k in range(rounds):
        steps.append(f"a{k} AS MATERIALIZED ({near.format(k=k)})")
        steps.append(f"""m{k} AS MATERIALIZED (
  SELECT part, entry, list(y ORDER BY i) AS y FROM (
    SELECT part, entry, i, (sum(x[i]) - ((sum(x[i]) % count(*) + count(*)) % count(*))) // count(*) AS y
    FROM (SELECT p.part, a.entry, p.x, unnest(range(1, len(p.x) + 1)) AS i FROM p JOIN a{k} a USING (r, part))
    GROUP BY part, entry, i) GROUP BY part, entry)""")
        steps.append(f"""c{k + 1} AS MATERIALIZED (
  SELECT c.part, c.entry, coalesce(m.y, c.y) AS y FROM c{k} c LEFT JOIN m{k} m USING (part, entry))""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label,
         list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::HUGEINT) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
  SELECT r, part, list_slice(e, part * len(e) // {parts} + 1, (part + 1) * len(e) // {parts}) AS x
  FROM (SELECT r, e, unnest(range(0, {parts})) AS part FROM v)),
c0 AS MATERIALIZED (SELECT part, r - 1 AS entry, x AS y FROM p WHERE r <= {entries}),
{", ".join(steps)},
f AS MATERIALIZED ({near.format(k=rounds)}),
h AS (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY part, entry, i)) AS d
      FROM (SELECT part, entry, unnest(y) AS y, unnest(range(len(y))) AS i FROM c{rounds})),
o AS (SELECT v.vec_id, v.label, string_agg(printf('%02x', entry::INTEGER), '' ORDER BY part) AS code, sum(far)::BIGINT AS error
      FROM v JOIN f USING (r) GROUP BY v.r, v.vec_id, v.label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, d AS codebooks_sha256 FROM o, h
"""


ORACLE = oracle()
