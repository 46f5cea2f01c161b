"""Codes of vectors: integer product codebooks, with annular norm pruning in every search for the nearest entry.

Components become ``floor(256 * x)``; vectors are cut into ``PARTS`` equal parts, each with a codebook of ``ENTRIES``
entries that starts as the parts of the smallest ids and is refined by ``ROUNDS`` of k-means in whole numbers.

``nearest`` sorts the entries of a part by norm. For every part of a vector it measures the entries whose norms are
next to its own, takes the least distance d as bound, binary-searches the norms in [norm - d, norm + d] (no entry outside
can be nearer, by the triangle inequality) and measures all entries of that annulus, ends included, in whole numbers.

Vectors that are null or hold null or non-finite components are dropped. Shorter vectors, and lengths that aren't a
multiple of ``PARTS``, are filled up with zeros to one common length. Rows of equal ids are rows of their own (initial entries
of equal ids stand in the order of their vectors); null ids come after all others; with fewer than ``ENTRIES`` vectors
there are as many entries; an empty table has no codes. Components must stay below 2^16 in size, as distances are long
numbers: larger ones raise an error. Other columns may have any names: those of ``keep`` give way to added ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import beside

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
LARGEST = 1 << 16
#: Vectors that are searched at once: bounds the pairs of vectors and entries in memory.
STEP = 2048
#: Entries measured before the annulus is drawn: so many on each side of the vector's norm.
FIRST = 2


def usable(vector: Column) -> Column:
    """Not null, and all components finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def whole(vectors: pa.Array, width: int) -> np.ndarray:
    """``floor(256 * x)`` of every component, filled up with zeros to ``width``."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = np.asarray(vectors.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    flat = np.floor(np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), dtype=np.float64) * SCALE)
    if flat.size and np.abs(flat).max() > LARGEST * SCALE:
        raise ValueError(f"a component is beyond {LARGEST}")
    out = np.zeros((len(vectors), width), np.int64)
    rows = np.repeat(np.arange(len(vectors)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(axis=1)


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the index of its nearest entry (ties: the lowest) and the squared distance."""
    k = len(entries)
    norms = np.sqrt((entries**2).sum(axis=1).astype(np.float64))
    order = np.argsort(norms, kind="stable")
    sorted_norms, by_norm = norms[order], entries[order]
    index, least = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    for a in range(0, len(rows), STEP):
        x = rows[a : a + STEP]
        norm = np.sqrt((x**2).sum(axis=1).astype(np.float64))
        at = np.searchsorted(sorted_norms, norm)
        bound = np.full(len(x), np.iinfo(np.int64).max)
        for shift in range(-FIRST, FIRST):
            bound = np.minimum(bound, _distances(x, by_norm[np.clip(at + shift, 0, k - 1)]))
        reach = np.sqrt(bound.astype(np.float64))
        slack = 1e-9 * (norm + reach + 1)  # roots are rounded; the ends of the annulus must not be
        low = np.searchsorted(sorted_norms, norm - reach - slack, side="left")
        high = np.searchsorted(sorted_norms, norm + reach + slack, side="right")
        counts = high - low
        first = np.cumsum(counts) - counts
        pair_row = np.repeat(np.arange(len(x)), counts)
        pair_entry = np.arange(counts.sum()) - np.repeat(first - low, counts)
        measured = _distances(x[pair_row], by_norm[pair_entry])
        best = np.minimum.reduceat(measured, first)
        index[a : a + STEP] = np.minimum.reduceat(np.where(measured == best[pair_row], order[pair_entry], k), first)
        least[a : a + STEP] = best
    return index, least


def _searched(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows x parts) and summed squared distances of whole-number vectors."""
    parts, _, width = books.shape
    codes, error = np.zeros((len(vectors), parts), np.uint8), np.zeros(len(vectors), np.int64)
    for p in range(parts):
        found, least = nearest(vectors[:, p * width : (p + 1) * width], books[p])
        codes[:, p] = found
        error += least
    return codes, error


def _sums(books: np.ndarray):
    """A task's sums of the parts that fall to each entry."""
    parts, k, width = books.shape

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * k, width), np.int64), np.zeros(parts * k, np.int64)
        for batch in batches:
            vectors = whole(batch.column(0), parts * width)
            for p in range(parts):
                piece = vectors[:, p * width : (p + 1) * width]
                found, _ = nearest(piece, books[p])
                count[p * k : (p + 1) * k] += np.bincount(found, minlength=k)
                np.add.at(total, p * k + found, piece)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), pa.array(list(total[used]), pa.list_(pa.int64()))], ["slot", "n", "total"])

    return task


def fit(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts x entries x components of a part) after all rounds. Every round reads all vectors; a task
    returns one row per entry, and the sums of all entries, whose number doesn't grow with the table, are read back."""
    kept = rows.where(usable(F.col(vector_col))).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    length = kept.agg(F.max(F.size("v"))).first()[0] or 0
    width = max(1, -(-length // parts))
    first = kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").toArrow().column("v")
    books = whole(first, parts * width).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    if not len(first):
        return books
    k = books.shape[1]
    for _ in range(rounds):
        partial = kept.select("v").mapInArrow(_sums(books), "slot long, n long, total array<long>")
        totals = partial.groupBy("slot").agg(F.sum("n"), *[F.sum(F.get("total", F.lit(i))) for i in range(width)])
        books = books.copy()
        for slot, n, *total in totals.collect():
            books[slot // k, slot % k] = np.array(total, np.int64) // n
    return books


def encode(rows: DataFrame, books: np.ndarray, keep: list[str], vector_col: str = "embedding") -> DataFrame:
    """The columns ``keep`` of every vector that isn't dropped, with ``code`` (two hex digits per part) and ``error``
    (squared distance to the entries, in units of 1 / 256)."""
    kept = rows.where(usable(F.col(vector_col)))
    chosen, schema = beside(kept, keep, vector_col, "code string, error long")
    parts, k, width = books.shape

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, error = _searched(whole(batch.column(batch.num_columns - 1), parts * width), books)
            digits = codes.tobytes().hex()
            code = [digits[2 * parts * i : 2 * parts * (i + 1)] for i in range(len(codes))]
            names = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(code, pa.string()), pa.array(error)], [*names, "code", "error"])

    return chosen.mapInArrow(task, schema)


def decoded(code: Column, books: np.ndarray) -> Column:
    """The vector that a code stands for, as array of double: midpoints of the whole-number steps."""
    parts = books.shape[0]
    tables = [F.array(*[F.array(*[F.lit((float(x) + 0.5) / SCALE) for x in entry]) for entry in book]) for book in books]
    index = lambda p: F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int")
    return F.concat(*[F.get(tables[p], index(p)) for p in range(parts)])


def fingerprint(books: np.ndarray) -> str:
    """Digest of all entries' components by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame, label_col: str = "label") -> DataFrame:
    """Adds ``label_error``, the ``error`` summed over equal labels (nulls together)."""
    sums = coded.groupBy(F.col(label_col).alias("__label")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, coded[label_col].eqNullSafe(sums["__label"])).drop("__label")
