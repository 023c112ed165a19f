"""Running values and islands over long ordered groups.

A plain window over `meeting_id` sorts a whole meeting in one task. Here each
group is cut into blocks of its ordering column (ten minutes of a meeting, a day
of events). Rows are only ever gathered by (group, block); one summary row per
block then carries the state from block to block. A meeting that holds a third
of all rows is spread over as many tasks as it has blocks.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.session import spread

BLOCK = "_block"
MEETING_BLOCK_MS = 600_000
DAY_MS = 86_400_000


def time_block(column: str, size: int) -> Column:
    return F.col(column) - F.pmod(F.col(column), F.lit(size))


def _both(local: Column, carried: Column, kind: str) -> Column:
    if kind == "sum":
        return F.coalesce(local, F.lit(0)) + F.coalesce(carried, F.lit(0))
    if kind == "max":
        return F.greatest(local, carried)
    return F.coalesce(local, carried)


def running(df: DataFrame, keys: list[str], order: list[str], block: Column,
            aggregates: dict[str, tuple[str, Column]], inclusive: bool = False,
            descending: bool = False) -> DataFrame:
    """Adds running values over `order` within `keys`.

    `aggregates` maps an output column to (kind, expression); kind is "sum",
    "max" or "last" (last value that is not NULL). `block` must not decrease
    along `order`. Exclusive of the current row unless `inclusive`; with
    `descending` the rows run from the last to the first.
    """
    turn = F.desc if descending else F.asc
    before = (Window.unboundedPreceding, 0 if inclusive else -1)
    in_block = Window.partitionBy(*keys, BLOCK).orderBy(*[turn(c) for c in order]).rowsBetween(*before)
    blocks = Window.partitionBy(*keys).orderBy(turn(BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
    extreme = F.min_by if descending else F.max_by

    rows = spread(df.withColumn(BLOCK, block), *keys, BLOCK)
    per_row, per_block, over_blocks = [], [], []
    for name, (kind, value) in aggregates.items():
        fold = {"sum": F.sum, "max": F.max}.get(kind)
        if fold is not None:
            per_row.append(fold(value).over(in_block).alias(f"_row_{name}"))
            per_block.append(fold(value).alias(f"_sum_{name}"))
            over_blocks.append(fold(f"_sum_{name}").over(blocks).alias(f"_pre_{name}"))
        else:
            at = F.when(value.isNotNull(), F.struct(*order))
            per_row.append(F.last(value, ignorenulls=True).over(in_block).alias(f"_row_{name}"))
            per_block.append(extreme(value, at).alias(f"_sum_{name}"))
            over_blocks.append(
                F.last(f"_sum_{name}", ignorenulls=True).over(blocks).alias(f"_pre_{name}"))

    carried = rows.groupBy(*keys, BLOCK).agg(*per_block).select(*keys, BLOCK, *over_blocks)
    out = rows.select("*", *per_row).join(carried, [*keys, BLOCK])
    values = [_both(F.col(f"_row_{n}"), F.col(f"_pre_{n}"), k).alias(n)
              for n, (k, _) in aggregates.items()]
    return out.select(*df.columns, *values)


def numbered(df: DataFrame, keys: list[str], order: list[str], block: Column,
             name: str) -> DataFrame:
    """Dense numbers from 0 in `order` within `keys`; rows are distinct in `order`."""
    return running(df, keys, order, block, {name: ("sum", F.lit(1).cast("bigint"))})


def islands(df: DataFrame, keys: list[str], same: list[str], order: list[str], end: str,
            gap: int | None, block_ms: int, name: str = "island") -> DataFrame:
    """Adds the first `order` values of each row's island as a struct.

    An island goes on while the `same` columns stay equal and the row starts at
    most `gap` after the furthest end so far; gap None means any distance. The
    first ordering column is the start, and `end` is never before it.
    """
    start = order[0]
    limit = F.lit(gap if gap is not None else 2**62)
    here, group = F.struct(*order), F.struct(*same)
    in_block = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    to_here = in_block.rowsBetween(Window.unboundedPreceding, 0)
    to_last = in_block.rowsBetween(Window.unboundedPreceding, -1)

    rows = (spread(df.withColumn(BLOCK, time_block(start, block_ms)), *keys, BLOCK)
            .withColumn("_last", F.lag(group).over(in_block))
            .withColumn("_run", F.sum(F.when(F.col("_last").isNotNull() & ~F.col("_last").eqNullSafe(group), 1)
                                      .otherwise(0)).over(to_here))
            .withColumn("_far", F.max(F.struct("_run", F.col(end).alias("far"))).over(to_last))
            # furthest end inside the block, NULL on the first row of a run
            .withColumn("_far", F.when(F.col("_far._run") == F.col("_run"), F.col("_far.far")))
            .drop("_last"))

    breaks = F.when(F.col("_far").isNull(), F.col("_run") > 0).otherwise(
        F.col(start) - F.col("_far") > limit)
    blocks = rows.groupBy(*keys, BLOCK).agg(
        F.max("_run").alias("_runs"),
        F.min(here).alias("_first"),
        F.min_by(group, here).alias("_first_group"),
        F.max_by(group, here).alias("_last_group"),
        F.max(F.struct("_run", F.col(end).alias("far"))).getField("far").alias("_last_far"),
        F.max(F.when(breaks, here)).alias("_last_break"))

    by_block = Window.partitionBy(*keys).orderBy(BLOCK)
    carried = (blocks
               .withColumn("_joins", F.coalesce(
                   F.lag("_last_group").over(by_block).eqNullSafe(F.col("_first_group"))
                   & F.lag(F.lit(True)).over(by_block), F.lit(False)))
               .withColumn("_chain", F.sum(F.when(F.col("_joins") & (F.col("_runs") == 0), 0).otherwise(1))
                           .over(by_block.rowsBetween(Window.unboundedPreceding, 0)))
               .withColumn("_reach", F.max(F.struct("_chain", "_last_far"))
                           .over(by_block.rowsBetween(Window.unboundedPreceding, 0)).getField("_last_far"))
               .withColumn("_in", F.when(F.col("_joins"), F.lag("_reach").over(by_block))))
    far_in = F.col("_in")
    # the last break of the block still holds after what comes in from the left;
    # a run that began inside the block does not depend on it
    still = (F.col("_runs") > 0) | far_in.isNull() | (F.col(f"_last_break.{start}") - far_in > limit)
    opened = (F.when(F.col("_last_break").isNotNull() & still, F.col("_last_break"))
              .when(far_in.isNull() | (F.col(f"_first.{start}") - far_in > limit), F.col("_first")))
    carried = (carried.withColumn("_opened", opened)
               .select(*keys, BLOCK, "_in", F.last("_opened", ignorenulls=True).over(
                   by_block.rowsBetween(Window.unboundedPreceding, -1)).alias("_open")))

    far = F.when(F.col("_run") == 0, F.greatest("_far", "_in")).otherwise(F.col("_far"))
    begins = F.coalesce(F.col(start) - far > limit, F.lit(True))
    return (rows.join(carried, [*keys, BLOCK])
            .withColumn(name, F.coalesce(
                F.last(F.when(begins, here), ignorenulls=True).over(to_here), F.col("_open")))
            .select(*df.columns, BLOCK, name))


def join_text(df: DataFrame, keys: list[str], order: list[str], text: str,
              aggregates: list[Column], merge: list[Column], separator: str = " ") -> DataFrame:
    """One row per `keys`, texts joined in `order`: first inside each block, then
    the blocks. `aggregates` run per block, `merge` over their results."""
    pieces = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_piece"))))
    part = df.groupBy(*keys, BLOCK).agg(
        F.array_join(F.transform(pieces, lambda p: p["_piece"]), separator).alias("_part"), *aggregates)
    parts = F.array_sort(F.collect_list(F.struct(BLOCK, "_part")))
    return part.groupBy(*keys).agg(
        F.array_join(F.transform(parts, lambda p: p["_part"]), separator).alias(text), *merge)


def around(df: DataFrame, keys: list[str], order: list[str], block: Column, value: Column) -> DataFrame:
    """Adds `before` and `after`: the nearest value that is not NULL on the rows
    before and after each row."""
    def spans(asc):
        turn = F.asc if asc else F.desc
        rows = Window.unboundedPreceding, -1
        return (Window.partitionBy(*keys, BLOCK).orderBy(*[turn(c) for c in order]).rowsBetween(*rows),
                Window.partitionBy(*keys).orderBy(turn(BLOCK)).rowsBetween(*rows))
    (up, blocks_up), (down, blocks_down) = spans(True), spans(False)
    rows = spread(df.withColumn(BLOCK, block).withColumn("_value", value), *keys, BLOCK)
    at = F.when(F.col("_value").isNotNull(), F.struct(*order))
    carried = rows.groupBy(*keys, BLOCK).agg(
        F.max_by("_value", at).alias("_top"), F.min_by("_value", at).alias("_bottom")).select(
        *keys, BLOCK, F.last("_top", ignorenulls=True).over(blocks_up).alias("_left"),
        F.last("_bottom", ignorenulls=True).over(blocks_down).alias("_right"))
    near = rows.select("*", F.last("_value", ignorenulls=True).over(up).alias("_up"),
                       F.last("_value", ignorenulls=True).over(down).alias("_down"))
    return near.join(carried, [*keys, BLOCK]).select(
        *df.columns, F.coalesce("_up", "_left").alias("before"),
        F.coalesce("_down", "_right").alias("after"))
