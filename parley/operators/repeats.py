"""First-wins removal of texts that resemble an earlier one, without a group per meeting.

Whether a text stays depends on which earlier ones stayed, so this is done in two steps:

1. `rivals` finds every pair of a text and an earlier one that it resembles. The texts of a pool
   are dealt into blocks by a hash, and each pair of blocks is a group of its own, so a pool with
   very many texts is spread over as many tasks as it has pairs of blocks. In a group an exact bound
   on common q-grams, computed for all pairs by one product of matrices, leaves few pairs; a
   second bound, the longest common subsequence, leaves fewer; the matcher decides those.
2. `dropped` decides in rounds: a text stays once no undecided one before it is its rival, and what
   resembles it goes. The first rival of a chain is decided in every round, most are in the first.

The bound: a similarity of r or more over lengths a and b means that matching blocks, which are a common
subsequence, hold m >= r(a+b)/2 characters. Each of the a-m characters that are left out spoils at most q
of the a-q+1 runs of q characters, and each of the at most b-m gaps where b has more spoils q-1. So at least
a-q+1-q(a-m)-(q-1)(b-m) = (2q-1)m-(q-1)(a+b)-q+1 runs are common, counted as often as they occur. A text
inside another has all its runs in common.

Long earlier texts have a closer bound, for there the matcher leaves out characters that are popular in them. A
block then holds a character that is not, or is what both texts begin with: any other one would begin where a block
ended, and blocks end where the texts differ. So k such characters in common, counted as often as they occur, make
at most k+1 blocks, and blocks with m characters hold at least m-(k+1)(q-1) common runs of q characters.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions import constants as c
from parley.functions.matching import SequenceMatcher, char_places, common_length
from parley.session import cut_lineage, spread

#: Texts of one block, and the columns of the product computed at once.
BLOCK = 1_024
SLICE = 1 << 22
#: From this length on the matcher leaves out popular characters; the runs that are then counted.
LONG, RUN = 200, 4


class Kept:
    """An earlier text; its side of the matcher is prepared once."""

    def __init__(self, text):
        self.text, self._places, self._matcher = text, None, None

    def resembles(self, new):
        """Whether `new` repeats it; only the new text must be long to count as a part."""
        old, limit = self.text, c.SIMILAR_RATIO
        if new == old or (len(new) > c.SIMILAR_CONTAINS_CHARS and (new in old or old in new)):
            return True
        if 2 * min(len(new), len(old)) < limit * (len(new) + len(old)):
            return False
        if self._places is None:
            self._places = char_places(old)
        if 2 * common_length(new, self._places, len(old)) < limit * (len(new) + len(old)):
            return False
        if self._matcher is None:
            self._matcher = SequenceMatcher(None, "", old)
        self._matcher.set_seq1(new)
        return self._matcher.ratio() >= limit


def letters(texts):
    """(member, number) of every character; the numbers have no gaps."""
    size = np.array([len(t) for t in texts], np.int64)
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    seen = np.zeros(int(flat.max(initial=0)) + 1, np.int64)
    seen[flat] = 1
    return np.repeat(np.arange(len(texts)), size), (np.cumsum(seen) - 1)[flat]


def grams(texts, q):
    """(member, token) of every q neighbouring characters; a gram's further occurrences in the same
    text are tokens of their own, so common tokens count grams as often as both texts have them."""
    member, code = letters(texts)
    width, n = int(code.max(initial=0)) + 1, max(0, len(code) - q + 1)
    gram = sum((code[i:n + i] * width ** i for i in range(q)), np.zeros(n, np.int64))
    within = member[:n] == member[len(member) - n:]
    member, gram, many = member[:n][within], gram[within], width ** q
    if many >= 1 << 31:
        gram, many = np.unique(gram, return_inverse=True)[1].astype(np.int64), 1 << 31
    both = np.sort(member * many + gram)
    member, gram = both // many, both % many
    new = np.r_[True, both[1:] != both[:-1]] if len(both) else np.zeros(0, bool)
    at = np.arange(len(both))
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    return member, (gram << 31) | nth


def common_grams(texts, q):
    """How many runs of q characters each two texts have in common."""
    n = len(texts)
    member, token = grams(texts, q)
    column = np.unique(token, return_inverse=True)[1]
    several = np.bincount(column)[column] > 1 if len(column) else np.zeros(0, bool)
    names, column = np.unique(column[several], return_inverse=True)
    member, out, width = member[several], np.zeros((n, n), np.float32), max(1, min(len(names), SLICE // max(n, 1)))
    order = np.argsort(column, kind="stable")
    column, member = column[order], member[order]
    edges = np.searchsorted(column, np.arange(0, len(names) + width, width))
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        if a < b:
            part = np.zeros((n, width), np.float32)
            part[member[a:b], column[a:b] - k * width] = 1.0
            out += part @ part.T
    return out


def least_common(total, q, ratio=c.SIMILAR_RATIO):
    """Runs of q characters that texts of this length together have in common at least."""
    return ((2 * q - 1) * ratio / 2 - q + 1) * total - q + 1 - 1e-6


def candidates(texts):
    """Mask of (new, old) that may resemble each other, by length and common grams."""
    size = np.array([len(t) for t in texts])
    total, least = size[:, None] + size[None, :], np.minimum(size[:, None], size[None, :])
    pairs = common_grams(texts, 2)
    alike = (2 * least >= c.SIMILAR_RATIO * total - 1e-9) & (pairs >= least_common(total, 2))
    inside = (size[:, None] > c.SIMILAR_CONTAINS_CHARS) & (pairs >= np.maximum(least - 1, 0))
    return alike | inside


def narrowed(texts, mask):
    """The mask of candidates without pairs with a long earlier text that have too few runs in common."""
    size = np.array([len(t) for t in texts], np.int64)
    near = mask & (size >= LONG)[None, :]
    at = np.flatnonzero(near.any(axis=0) | near.any(axis=1))
    if not len(at):
        return mask
    texts, size, mask = [texts[i] for i in at], size[at], mask.copy()
    member, code = letters(texts)
    width = int(code.max()) + 1
    count = np.bincount(member * width + code, minlength=len(at) * width).reshape(len(at), width)
    q = min(RUN, int(62 / np.log2(max(width, 2))))  # such that a run is one number
    member, token = grams(texts, q)
    token = np.unique(token, return_inverse=True)[1]
    edge, held = np.searchsorted(member, np.arange(len(at) + 1)), np.zeros(len(token) + 1, bool)
    for o in np.flatnonzero(near.any(axis=0)[at]):
        new = np.flatnonzero(near[at, at[o]])
        seldom = count[o] <= size[o] // 100 + 1
        blocks = 1 + np.minimum(count[new][:, seldom], count[o, seldom]).sum(axis=1)
        own = token[edge[o]:edge[o + 1]]
        held[own] = True
        common = np.array([np.count_nonzero(held[token[edge[i]:edge[i + 1]]]) for i in new])
        held[own] = False
        alike = common + blocks * (q - 1) >= c.SIMILAR_RATIO * (size[new] + size[o]) / 2 - 1e-6
        # a text inside the other has all its runs in common
        inside = (size[new] > c.SIMILAR_CONTAINS_CHARS) & (common >= np.minimum(size[new], size[o]) - q + 1)
        mask[at[new], at[o]] = alike | inside
    return mask


def _pairs(table: pa.Table) -> pa.Table:
    """(new, old) ids of one group: a pair of blocks, or one block with itself. Equal texts are in the same
    block; copies of an earlier text take no part, and a block with itself returns them without an old one."""
    rank, pos, ids, block, old_only = (table.column(n).to_numpy() for n in ("rank", "pos", "id", "mine", "old_only"))
    texts, own = table.column("text").to_pylist(), table.column("left")[0] == table.column("right")[0]
    order, first = np.lexsort((ids, pos, rank)), {}
    copy = np.zeros(len(ids), bool)
    for i in order:
        if not old_only[i]:
            copy[i] = first.setdefault(texts[i], i) != i
    new, old = (ids[copy].tolist(), [None] * int(copy.sum())) if own else ([], [])
    order = order[~copy[order]]  # earlier ones first
    texts, ids, block, old_only = [texts[i] for i in order], ids[order], block[order], old_only[order]
    mask = np.tril(candidates(texts), -1) & ~old_only[:, None]
    if not own:
        mask &= block[:, None] != block[None, :]
    mask = narrowed(texts, mask)
    for o in np.flatnonzero(mask.any(axis=0)):
        kept = Kept(texts[o])
        hit = [int(ids[i]) for i in np.flatnonzero(mask[:, o]) if kept.resembles(texts[i])]
        new += hit
        old += [int(ids[o])] * len(hit)
    return pa.table({"new": pa.array(new, pa.int64()), "old": pa.array(old, pa.int64())})


def rivals(entries: DataFrame, block: int = BLOCK) -> DataFrame:
    """(new, old): each text and the earlier texts of its pool that it resembles; old is null for a copy of an
    earlier text. `entries` has meeting_id, pool, rank, pos, id (the order), text and old_only (a text that
    others are compared with only, which has no copies)."""
    key = ["meeting_id", "pool"]
    entries = entries.filter("meeting_id IS NOT NULL")  # what is in no meeting repeats nothing
    # only pools above a block are joined, a small table of its own, so that the texts move once
    large = cut_lineage(entries.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > block))
    blocks = F.coalesce(F.ceil(F.col("_n") / F.lit(block)), F.lit(1)).cast("int")
    placed = (entries.join(large, key, "left").withColumn("blocks", blocks)
              .withColumn("mine", F.pmod(F.xxhash64("text"), F.col("blocks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    cell = [*key, "left", "right"]
    rows = placed.select(*key, F.least("mine", "other").alias("left"), F.greatest("mine", "other").alias("right"),
                         "rank", "pos", "id", "mine", "old_only", "text")

    def run(batches: Iterator[pa.RecordBatch]):
        """Groups one after the other; a group may go on in the next batch."""
        held, now = [], None
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(4))))
            start = 0
            for i in range(len(keys) + 1):
                if i == len(keys) or keys[i] != keys[start]:
                    if keys[start:i]:
                        if now is not None and keys[start] != now:
                            yield from _pairs(pa.Table.from_batches(held)).to_batches()
                            held = []
                        now = keys[start]
                        held.append(batch.slice(start, i - start))
                    start = i
        if held:
            yield from _pairs(pa.Table.from_batches(held)).to_batches()
    return spread(rows, *cell).sortWithinPartitions(*cell).mapInArrow(run, "new long, old long")


def dropped(pairs: DataFrame) -> DataFrame:
    """Ids that go, given all (new, old) pairs: copies, and those with a rival that stays. A copy always goes: the
    first of its kind stays, or went for one that does and that resembles the copy as well."""
    whole = cut_lineage(pairs)
    copies = cut_lineage(whole.filter("old IS NULL").select("new").distinct())
    # a copy goes whatever it resembles, so what it stands for in another pool is no rival there
    left = whole.filter("old IS NOT NULL").join(copies, "new", "left_anti").join(
        copies.select(F.col("new").alias("old")), "old", "left_anti").select("new", "old")
    gone = []
    while not left.isEmpty():
        news = left.select(F.col("new").alias("old")).distinct()
        stay = left.select("old").distinct().join(news, "old", "left_anti")
        out = cut_lineage(left.join(stay, "old", "left_semi").select("new").distinct())
        left = cut_lineage(left.join(out, "new", "left_anti").join(out.select(F.col("new").alias("old")), "old", "left_anti"))
        gone.append(out)
    found = copies.select(F.col("new").alias("id"))
    for out in gone:
        found = found.union(out)
    return found
