"""Vector codes by slice-and-intersect bitmasks: the nearest codebook entry of every part, exactly.

A part's codebook has at most 64 entries, so a set of entries is one 64-bit mask. In each dimension the
entries' coordinates are sorted, and prefix masks say which entries come before a place. The least distance
of a part to the entries next to it in each dimension is an initial radius: within it lies the nearest entry.
The radius selects a range of places in each dimension, the difference of two prefix masks is the set of
entries in it, and the sets of all dimensions ANDed leave the few candidates whose distances are worked out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regatta.operators.common import cut_lineage, spread_join

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
# A component beyond this would not leave room for exact squares and sums in 64-bit integers.
LARGEST = 1 << 27
# Vectors that are coded together; bounds the candidates a task holds.
TOGETHER = 2048


class SlicedBook:
    """One part's codebook with its sorted coordinates and prefix masks."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        n, width = entries.shape
        bits = np.left_shift(np.uint64(1), np.arange(n, dtype=np.uint64))
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.ascontiguousarray(np.take_along_axis(entries, order, axis=0).T)
        self.prefix = np.zeros((width, n + 1), np.uint64)
        np.bitwise_or.accumulate(bits[order].T, axis=1, out=self.prefix[:, 1:])
        self.order = order.T

    def radius(self, parts: np.ndarray) -> np.ndarray:
        """A whole number no less than the distance to the nearest entry."""
        squared = np.full(len(parts), np.iinfo(np.int64).max)
        for axis, (coordinates, order) in enumerate(zip(self.sorted, self.order)):
            above = np.searchsorted(coordinates, parts[:, axis])
            for place in (np.minimum(above, len(order) - 1), np.maximum(above - 1, 0)):
                gap = parts - self.entries[order[place]]
                squared = np.minimum(squared, (gap * gap).sum(1))
        root = np.sqrt(squared.astype(np.float64)).astype(np.int64)
        return root + (root * root < squared)

    def candidates(self, parts: np.ndarray) -> np.ndarray:
        """Per part the mask of the entries no further than the radius in any dimension."""
        radius = self.radius(parts)
        mask = np.full(len(parts), ~np.uint64(0))
        for axis, (coordinates, prefix) in enumerate(zip(self.sorted, self.prefix)):
            low = np.searchsorted(coordinates, parts[:, axis] - radius, "left")
            high = np.searchsorted(coordinates, parts[:, axis] + radius, "right")
            mask &= prefix[high] ^ prefix[low]
        return mask

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry (the lower one on ties) and the squared distance."""
        if not parts.shape[1]:
            return np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        mask = self.candidates(parts)
        octets = mask.astype("<u8").view(np.uint8).reshape(-1, 8)
        row, entry = np.nonzero(np.unpackbits(octets, axis=1, bitorder="little"))
        gap = parts[row] - self.entries[entry]
        squared = (gap * gap).sum(1)
        # Every part has a candidate; the first of its least distances is that of the lowest index.
        starts = np.searchsorted(row, np.arange(len(parts)))
        least = np.minimum.reduceat(squared, starts)
        hit = np.flatnonzero(squared == least[row])
        first = hit[np.searchsorted(row[hit], np.arange(len(parts)))]
        return entry[first], least


class Codebooks:
    """The books of all parts; ``entries[part, entry, position]`` are integers."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.books = [SlicedBook(book) for book in entries]

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all parts, and the squared distances summed over them."""
        n, parts = len(vectors), len(self.books)
        cut = vectors.reshape(n, parts, vectors.shape[1] // parts)
        codes, error = np.empty((n, parts), np.int64), np.zeros(n, np.int64)
        for part, book in enumerate(self.books):
            codes[:, part], squared = book.nearest(cut[:, part])
            error += squared
        return codes, error

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _vectors(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Rows of a list column as integer matrices of the width, zeros behind shorter rows."""
    for start in range(0, len(column), TOGETHER):
        part = column.slice(start, TOGETHER)
        values = part.flatten().to_numpy(zero_copy_only=False)
        sizes = np.diff(part.offsets.to_numpy())
        out = np.zeros((len(part), width), np.int64)
        row = np.repeat(np.arange(len(part)), sizes)
        out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
        yield out


def integer_vectors(rows: DataFrame) -> DataFrame:
    """The rows whose vector has no null and no non-finite component, as ``_vector`` of floor(256 x)."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    checked = F.transform(
        scaled,
        lambda x: F.when(F.abs(x) <= LARGEST, x).otherwise(
            F.raise_error(F.lit(f"a component beyond {LARGEST // SCALE} does not fit exact sums"))
        ).cast("long"),
    )
    kept = rows.where(F.col("embedding").isNotNull() & ~F.coalesce(odd, F.lit(False)))
    return kept.select("vec_id", "label", checked.alias("_vector"))


def first_books(vectors: DataFrame, width: int, parts: int, entries: int) -> np.ndarray:
    """The parts of the rows of the smallest ids; equal ids by vector. At most ``entries`` rows are read."""
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "_vector").limit(entries).select("_vector")
    rows = np.zeros((0, width), np.int64)
    for column in first.toArrow().column(0).chunks:
        rows = np.concatenate([rows, *_vectors(column, width)])
    return rows.reshape(len(rows), parts, width // parts).transpose(1, 0, 2).copy()


def refined(vectors: DataFrame, books: np.ndarray, width: int) -> np.ndarray:
    """The books after one round: means of the parts nearest to each entry; unused entries stay.

    A task adds up its own parts, so what is shuffled and comes back is the books' size per task and
    in all, whatever the number of vectors.
    """
    parts, entries, inner = books.shape

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Codebooks(books)
        sums, counts = np.zeros((parts * entries, inner), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            for rows in _vectors(batch.column(0), width):
                cell = (book.assign(rows)[0] + np.arange(parts) * entries).ravel()
                # Sums of one block stay far below 2^53, so doubles hold them exactly.
                for position, values in enumerate(rows.reshape(-1, inner).T.astype(np.float64)):
                    sums[:, position] += np.bincount(cell, values, parts * entries).astype(np.int64)
                counts += np.bincount(cell, minlength=parts * entries)
        cell = np.repeat(np.flatnonzero(counts), inner)
        position = np.tile(np.arange(inner), len(cell) // inner if inner else 0)
        columns = [cell, position, sums[cell, position], counts[cell]]
        yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["cell", "position", "total", "n"])

    each = vectors.select("_vector").mapInArrow(summed, "cell long, position long, total long, n long")
    found = each.groupBy("cell", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow()
    out = books.reshape(parts * entries, inner).copy()
    cell, position, total, n = (found[c].to_numpy() for c in ("cell", "position", "total", "n"))
    out[cell, position] = np.floor_divide(total, n)
    return out.reshape(books.shape)


def compress(
    rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, Codebooks]:
    """``(vec_id, label, code, error)`` of every kept row, codes as one array, and the books behind them.

    Rows whose vector is null or has a null or non-finite component are left out. Shorter vectors are
    filled with zeros to the longest one's length, and that to a multiple of the parts. Null ids sort
    last and are coded like others, repeated rows are rows of their own, ties go to the lower entry, an
    empty table gives no rows and empty books, other columns are not read. A component that would not
    fit exact 64-bit sums (beyond 2^19) is an error, never rounded.
    The driver holds the books alone: ``entries`` vectors, at every size of the table.
    """
    if entries > 64:
        raise ValueError("a book's entries must fit one 64-bit mask")
    vectors = integer_vectors(rows)
    longest = vectors.agg(F.max(F.size("_vector")).alias("n")).first()["n"] or 0
    width = -(-longest // parts) * parts
    books = first_books(vectors, width, parts, entries)
    for _ in range(rounds if books.size else 0):
        books = refined(vectors, books, width)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Codebooks(books)
        for batch in batches:
            done = [book.assign(part) for part in _vectors(batch.column(2), width)]
            if not done:
                continue
            codes = np.concatenate([c for c, _ in done])
            offsets = np.arange(0, codes.size + 1, parts, dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(codes.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), lists, pa.array(np.concatenate([e for _, e in done]))],
                ["vec_id", "label", "code", "error"],
            )

    kinds = dict(vectors.dtypes)
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code array<int>, error long"
    return vectors.mapInArrow(coded, schema), Codebooks(books)


def code_report(rows: DataFrame) -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)`` of every kept row; codes as hex digits.

    The errors are added up per label before they are shuffled and joined back with a salt, so a label
    that holds a third of all rows is spread; rows without a label are one group.
    """
    codes, books = compress(rows)
    codes = cut_lineage(codes.select(
        "vec_id", "error", F.col("label").isNull().alias("_none"), F.col("label").cast("string").alias("_label"),
        F.lower(F.concat_ws("", F.transform("code", lambda c: F.lpad(F.hex(c), 2, "0")))).alias("code"),
    ).withColumn("_label", F.coalesce("_label", F.lit(""))))
    sums = codes.groupBy("_none", "_label").agg(F.sum("error").alias("label_error"))
    joined = spread_join(codes, sums, ["_none", "_label"], ["vec_id", "code"])
    return joined.select(
        "vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256")
    )
