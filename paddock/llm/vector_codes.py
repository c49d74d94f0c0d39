"""Vector code compression: product quantisation in integers, with distances from a limb-split exact matrix product.

A vector's components become integers floor(SCALE * x). It is cut into PARTS equal consecutive parts; each part position has a
codebook of up to ENTRIES entries, first the parts of the vectors with the smallest ids, then refined ROUNDS times: every part
goes to its nearest entry (squared Euclidean distance, ties to the lower index), and an entry becomes the componentwise
floor(sum / count) of its parts. An entry without parts stays.

Exactness: `exact_dot` breaks integers into limbs so short that every float64 product sum of the BLAS stays below 2**53,
and recombines the limb products in int64; |c|^2 - 2 x.c is then compared as integers, so the result depends on no order
of summation, machine or number of tasks.

Spark deals the vectors out; a task holds one batch and the codebooks (PARTS * ENTRIES entries, whatever the number of vectors),
and hands on one sum per entry and component. The driver sees the sums of the entries, never a vector.

Defined cases. Vectors that are null or hold a null or non-finite component are dropped. So are those whose squared distances a
long cannot hold (a component beyond `bound_of(width)`, 2**27 / SCALE for parts of 16 components), those that cannot be cut into PARTS
equal parts, and those of another length than the kept vector with the smallest id. Null ids sort after all others and their rows
are coded like any other. Repeated rows count as often as they occur; equal ids are ordered by their components. With fewer than
ENTRIES vectors the codebooks are shorter; an empty table gives no rows. Columns other than id, vector and label are not read.
"""

import hashlib
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm.batches import bounded_broadcast
from paddock.session import cut

SCALE = 1024
PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Bits of a float64 that hold an integer exactly.
MANTISSA = 53
#: A table of label totals up to this many rows is broadcast.
LABEL_ROWS = 100_000
#: Vectors whose distances are computed at once.
_ROWS = 4096


def limb_bits(width: int) -> int:
    """Bits of a limb: sums of `width` products of two limbs stay below 2**MANTISSA."""
    return (MANTISSA - max(width - 1, 0).bit_length()) // 2


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """float64 limbs of an int64 array, lowest first: x = sum of limb_i * 2**(bits i); only the last may be negative."""
    out = []
    while len(x) and not (-(1 << bits) < x.min() and x.max() < (1 << bits)):
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits
    return [*out, x.astype(np.float64)]


def exact_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of int64 matrices, exact as long as the result fits in int64."""
    bits = limb_bits(a.shape[1])
    out = np.zeros((len(a), len(b)), np.int64)
    right = limbs(b, bits)
    for i, x in enumerate(limbs(a, bits)):
        for j, y in enumerate(right):
            out += (x @ y.T).astype(np.int64) << (bits * (i + j))
    return out


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first nearest entry of each row, and its squared distance."""
    d = np.einsum("ij,ij->i", entries, entries)[None, :] - 2 * exact_dot(x, entries)
    k = d.argmin(axis=1)
    return k, d[np.arange(len(x)), k] + np.einsum("ij,ij->i", x, x)


def bound_of(width: int) -> int:
    """Largest component at which squared distances of parts of `width` components, their terms and their sum over PARTS fit in int64."""
    return isqrt((1 << 62) // (4 * PARTS * max(width, 1)))


def integer_vectors(vectors: DataFrame, key: str, vector: str, label: str, parts: int = PARTS) -> tuple[DataFrame, int]:
    """(_key, _label, v) of the kept vectors, v as integers, written once; and their length (0: none is kept)."""
    x = F.col(vector)
    ok = x.isNotNull() & (F.size(x) > 0) & (F.size(x) % parts == 0) & F.forall(
        x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float(1 << 52) / SCALE)), F.lit(False)))
    rows = vectors.select(F.col(key).cast("bigint").alias("_key"), F.col(label).alias("_label"), x.cast("array<double>").alias(vector))
    rows = rows.where(ok).select("_key", "_label", F.transform(vector, lambda c: F.floor(c * F.lit(float(SCALE))).cast("bigint")).alias("v"))
    # the rule of bound_of, row by row
    bound = F.floor(F.sqrt(F.lit(float(1 << 62) / (4 * PARTS)) / (F.size("v") / parts)))
    rows = rows.where(F.forall("v", lambda c: F.abs(c) <= bound))
    first = rows.orderBy(F.col("_key").asc_nulls_last(), "v").select(F.size("v").alias("n")).first()
    return (cut(rows.where(F.size("v") == first.n)), first.n) if first else (rows, 0)


def _assigned(rows: DataFrame, books: np.ndarray, per_row, schema: str, at_end=None) -> DataFrame:
    """Rows made from batches of `rows` and, for every part, the entries and distances of its parts."""
    parts, width = len(books), books.shape[2]

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, _ROWS):
                part = batch.slice(i, _ROWS)
                v = part.column(part.schema.get_field_index("v")).flatten().to_numpy(zero_copy_only=False).reshape(-1, parts, width)
                found = [nearest(v[:, p], books[p]) for p in range(parts)]
                out = per_row(part, v, found)
                if out is not None:
                    yield out
        if at_end:
            yield from at_end()

    return rows.mapInArrow(run, schema)


def part_sums(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(slot, total): sums of the parts at each entry, by component, and their number; slots in the order part, entry, component."""
    parts, entries, width = books.shape
    # the last slot of an entry is the number of its parts
    sums = np.zeros((parts, entries, width + 1), np.int64)

    def add(_, v, found):
        for p, (k, _d) in enumerate(found):
            np.add.at(sums[p], k, np.column_stack([v[:, p], np.ones(len(v), np.int64)]))

    def hand_on():
        used = np.repeat(sums[:, :, -1:] > 0, width + 1, axis=2).ravel()
        slots = np.flatnonzero(used)
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(sums.ravel()[slots])], names=["slot", "total"])
        sums[:] = 0

    return _assigned(rows, books, add, "slot bigint, total bigint", hand_on).groupBy("slot").agg(F.sum("total").alias("total"))


def first_books(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """Codebooks [part, entry, component] from the vectors with the smallest ids."""
    start = rows.orderBy(F.col("_key").asc_nulls_last(), "v").limit(entries).select("v").collect()
    v = np.array([r.v for r in start], np.int64)
    return np.ascontiguousarray(v.reshape(len(v), parts, -1).transpose(1, 0, 2))


def refined(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: entries become the floored means of their parts."""
    found = part_sums(rows, books).collect()  # at most one number per entry and component of the codebooks, and counts
    sums = np.zeros(books.shape[0] * books.shape[1] * (books.shape[2] + 1), np.int64)
    for r in found:
        sums[r.slot] = r.total
    sums = sums.reshape(*books.shape[:2], -1)
    n = sums[:, :, -1:]
    return np.where(n > 0, sums[:, :, :-1] // np.maximum(n, 1), books)


def codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    books = first_books(rows, parts, entries)
    for _ in range(rounds):
        books = refined(rows, books)
    return books


def coded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(_key, _label, code, error): hex indexes of every part's entry, and the vector's summed squared distance."""
    digits = max(2, (books.shape[1] - 1).bit_length() + 3 >> 2)

    def code(part, _v, found):
        names = [format(i, f"0{digits}x") for i in range(books.shape[1])]
        codes = ["".join(names[i] for i in ks) for ks in zip(*(k for k, _ in found), strict=True)]
        error = sum(d for _, d in found)
        cols = [part.column(part.schema.get_field_index(c)) for c in ("_key", "_label")]
        return pa.RecordBatch.from_arrays([*cols, pa.array(codes, pa.string()), pa.array(error, pa.int64())], names=["_key", "_label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return _assigned(rows, books, code, f"_key bigint, _label {kinds['_label']}, code string, error bigint")


def digest(books: np.ndarray) -> str:
    """Lowercase SHA-256 of all entries' components in the order part, entry, position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def decoded(codes: list[str], books: np.ndarray) -> np.ndarray:
    """Integer vectors that codes stand for: the entries of their parts, side by side."""
    digits = len(codes[0]) // len(books) if codes else 2
    at = np.array([[int(c[i * digits : (i + 1) * digits], 16) for i in range(len(books))] for c in codes], np.int64).reshape(len(codes), len(books))
    return np.concatenate([books[p][at[:, p]] for p in range(len(books))], axis=1)


def vector_codes(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every kept vector."""
    rows, n = integer_vectors(vectors, key, vector, label)
    if not n:
        empty = F.lit(None).cast("string")
        return rows.select(F.col("_key").alias("vec_id"), empty.alias("code"), F.lit(0).cast("bigint").alias("error"),
                           F.lit(0).cast("bigint").alias("label_error"), empty.alias("codebooks_sha256")).limit(0)
    books = codebooks(rows)
    codes = cut(coded(rows, books))
    totals = cut(codes.groupBy("_label").agg(F.sum("error").alias("label_error")).withColumnRenamed("_label", "_l"))
    out = codes.join(bounded_broadcast(totals, LABEL_ROWS), F.col("_label").eqNullSafe(F.col("_l")))
    return out.select(F.col("_key").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
