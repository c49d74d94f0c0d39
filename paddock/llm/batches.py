"""Arrow batches of whole texts, and the words in them.

Work that Spark's expressions cannot state runs over Arrow batches inside Spark's tasks. A batch is cut
into slices of bounded size, so memory follows the slice and not the number of rows in a batch.
"""

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text in one slice; a longer text is a slice of its own.
SLICE_BYTES = 4_000_000


def texts_of(column) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    if pa.types.is_null(column.type):
        return [b""] * len(column)
    if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.binary())
    return [x if x is not None else b"" for x in column.to_pylist()]


def slices(batch, text: str):
    """Slices of a batch with at most about SLICE_BYTES of text each."""
    column = batch.column(batch.schema.get_field_index(text))
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    start, total = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        if i > start and total + n > SLICE_BYTES:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def arrow_type(kind: T.DataType) -> pa.DataType:
    return {
        "string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(),
        "binary": pa.binary(), "float": pa.float32(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64()),
        "array<string>": pa.list_(pa.string()),
    }[kind.simpleString()]


def emit(columns: dict, fields: T.StructType) -> pa.RecordBatch:
    """A record batch from lists or numpy arrays, typed as the Spark fields say."""
    arrays = []
    for f in fields:
        x = columns[f.name]
        arrays.append(x if isinstance(x, pa.Array) else pa.array(x, type=arrow_type(f.dataType)))
    return pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields])


def map_texts(df: DataFrame, fn, schema: str, keep: list[str], text: str = "text") -> DataFrame:
    """Rows made from slices of `keep` and `text`: `fn(slice, texts)` yields dicts of columns."""
    fields = T.StructType.fromDDL(schema)

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                for out in fn(part, texts_of(part.column(part.schema.get_field_index(text)))):
                    yield emit(out, fields)

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, fields)


def add_columns(df: DataFrame, fn, schema: str, text: str = "text") -> DataFrame:
    """`df` with columns computed from `text`; a column of `df` with the same name as a new one gives way."""
    new = T.StructType.fromDDL(schema)
    names = {f.name for f in new}
    kept = [c for c in df.columns if c not in names or c == text]
    if text in names:
        raise ValueError("the text column cannot be replaced here")
    fields = T.StructType([df.schema[c] for c in kept] + list(new))

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                out = fn(texts_of(part.column(part.schema.get_field_index(text))))
                cols = [part.column(part.schema.get_field_index(c)) for c in kept]
                tail = emit(out, new)
                yield pa.RecordBatch.from_arrays([*cols, *tail.columns], names=[*kept, *tail.schema.names])

    return df.select(*kept).mapInArrow(run, fields)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 32-bit hash of each word, the same in every process."""
    return np.fromiter(map(zlib.crc32, words), np.uint32, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the n-grams of a row of word hashes; empty if it has fewer than n words."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    x = h.astype(np.uint64)
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + x[k : len(x) - n + 1 + k]
    return mix(out)


def tokens_in(text: bytes) -> list[bytes]:
    """Words of a text, split at ASCII white space, A-Z lower-cased."""
    return text.lower().split()


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only if the table has at most `max_rows` rows; else the join shuffles."""
    n = df.limit(max_rows + 1).select(F.lit(1)).count()
    return F.broadcast(df) if n <= max_rows else df


def bit_table(slots: DataFrame, bits: int) -> np.ndarray:
    """2**bits bits, packed in 32-bit words, with a bit set for each value of the column `slot`.

    The table's size doesn't depend on the number of rows, so it may go to every task.
    """
    words = slots.select(F.expr("cast(slot >> 5 as int) AS w"), F.expr("shiftleft(1L, cast(slot & 31 as int)) AS b"))
    table = np.zeros(1 << (bits - 5), np.uint32)
    for r in words.groupBy("w").agg(F.bit_or("b").alias("b")).collect():  # at most 2**(bits - 5) rows
        table[r.w] = r.b
    return table


def in_table(table: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Places whose slot's bit is set."""
    return np.flatnonzero((table[slots >> slots.dtype.type(5)] >> (slots & slots.dtype.type(31)).astype(np.uint32)) & np.uint32(1))
