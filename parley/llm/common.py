"""Helpers shared by the corpus operators.

Rows with equal `doc_id` and equal text are one document for every operator that has to
join something back: they share its outcome, and none of them is lost. A null text has
no words. Columns other than the named ones pass through or are left out; helper columns
begin with two underscores.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a word: 0-9, a-z after lower-casing, everything above 0x7F. The rest separates.
_WORD_TABLE = bytes(
    c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20
    for c in range(256))

MASK = (1 << 64) - 1


def words(text):
    """Lower-cased words of UTF-8 bytes; none for None."""
    return text.translate(_WORD_TABLE).split() if text else []


class Codes(dict):
    """Word to 64-bit code, computed once per word and worker; forgets all when it is full."""

    LIMIT = 1 << 19

    def __missing__(self, word):
        if len(self) >= self.LIMIT:
            self.clear()
        code = self[word] = self.code(word)
        return code

    def code(self, word):
        import xxhash
        return xxhash.xxh64_intdigest(word)


def encode(codes, tokens):
    """Codes of the tokens as an array of unsigned 64-bit numbers."""
    return np.fromiter(map(codes.__getitem__, tokens), np.uint64, len(tokens))


def mix(x):
    """Finalizer of a 64-bit hash; spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def ngram_codes(codes, n):
    """One code per run of n consecutive codes; a shorter text is one run, an empty one none."""
    if not len(codes):
        return codes
    n = min(n, len(codes))
    out = codes[:len(codes) - n + 1].copy()
    for i in range(1, n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[i:len(codes) - n + 1 + i]
    return mix(out + np.uint64(n))


def covered(starts, length, size):
    """Mask of the `size` positions that lie in a run of `length` beginning at one of the starts."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(np.asarray(starts) + length, size), -1)
    return np.cumsum(edge[:size]) > 0


def text_bytes(column):
    """An Arrow string or binary column as bytes objects."""
    return column.cast(pa.binary()).to_pylist()


def document_key():
    """Two hashes of the text; with the id they name a document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.struct(F.xxhash64(text).alias("a"), F.hash(text).alias("b"), F.col("text").isNull().alias("c"))


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """Applies `function(batch) -> columns` to the batches of every partition."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema
    kind = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)

    def run(batches):
        for batch in batches:
            columns = function(batch)
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) and c.type == f.type else pa.array(c, f.type)
                 for c, f in zip(columns, arrow)], schema=arrow)
    return df.mapInArrow(run, kind)


def clean_name(name):
    return re.sub(r"\W+", "_", str(name))
