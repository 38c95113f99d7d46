"""IDX image and label files, read in parallel ranges; and written one file per partition.

A file is never loaded whole: the listing takes names and sizes only, a task reads a file's header,
and the body is cut into item ranges that are read and decoded side by side.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format: magic numbers (big-endian) and the pixel scale.
IMAGE_MAGIC, LABEL_MAGIC = 2051, 2049
IMAGE_HEADER, LABEL_HEADER = 16, 8
PIXEL_SCALE = 255.0
# Bytes of a file one task decodes at a time.
RANGE_BYTES = 8 << 20

HEADER_SCHEMA = "path string, length long, items long, width int, problem string"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), path.removeprefix("file:").replace("///", "/", 1)
    return fs.FileSystem.from_uri(path)


def _read_at(path: str, offset: int, size: int) -> bytes:
    system, name = _open(path)
    with system.open_input_file(name) as stream:
        stream.seek(offset)
        return stream.read(size)


def headers(spark: SparkSession, paths: str | list[str], kind: str) -> DataFrame:
    """``(path, length, items, width, problem)``: one row per file; ``problem`` is null if sound."""
    size = IMAGE_HEADER if kind == "images" else LABEL_HEADER

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, length in zip(pdf["path"], pdf["length"]):
                head = _read_at(path, 0, size)
                items, width, problem = 0, 0, None
                if len(head) < size:
                    problem = "truncated header"
                else:
                    fields = struct.unpack(f">{size // 4}I", head)
                    items = fields[1]
                    width = fields[2] * fields[3] if kind == "images" else 1
                    wanted = IMAGE_MAGIC if kind == "images" else LABEL_MAGIC
                    if fields[0] != wanted:
                        problem = f"magic {fields[0]}, expected {wanted}"
                    elif length < size + items * width:
                        problem = "truncated body"
                rows.append((path, length, items, width, problem))
            yield pd.DataFrame(rows, columns=["path", "length", "items", "width", "problem"])

    listed = spark.read.format("binaryFile").load(paths).select("path", "length")
    return listed.mapInPandas(look, HEADER_SCHEMA)


def _ranges(found: DataFrame) -> DataFrame:
    step = F.greatest(F.lit(1), F.floor(F.lit(RANGE_BYTES) / F.greatest(F.col("width"), F.lit(1))))
    sound = found.filter(F.col("problem").isNull() & (F.col("items") > 0)).withColumn("step", step)
    return sound.select(
        "path", "width", "items", "step",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("items") - 1, F.col("step"))).alias("start"),
    ).repartition("path", "start")


def _stem(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"[-_.](images|labels).*$", "")


def _scan(spark: SparkSession, paths, kind: str) -> tuple[DataFrame, DataFrame]:
    found = headers(spark, paths, kind)
    size = IMAGE_HEADER if kind == "images" else LABEL_HEADER

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                n = int(min(row.step, row.items - row.start))
                body = _read_at(row.path, size + int(row.start) * row.width, n * row.width)
                data = np.frombuffer(body, np.uint8).reshape(n, row.width)
                ids = np.arange(row.start, row.start + n)
                if kind == "images":
                    yield pd.DataFrame({
                        "path": row.path, "sample_id": ids, "features": list(data / PIXEL_SCALE)
                    })
                else:
                    yield pd.DataFrame({
                        "path": row.path, "sample_id": ids, "label": data[:, 0].astype("int32")
                    })

    value = "features array<double>" if kind == "images" else "label int"
    rows = _ranges(found).mapInPandas(decode, f"path string, sample_id long, {value}")
    named = rows.withColumn("split", _stem(F.col("path"))).drop("path")
    return named, found.filter(F.col("problem").isNotNull()).select("path", "problem")


def read_images(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """``(sample_id, features, split)`` with pixels in [0, 1], and ``(path, problem)`` of rejects."""
    return _scan(spark, paths, "images")


def read_labels(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """``(sample_id, label, split)``, and ``(path, problem)`` of rejects."""
    return _scan(spark, paths, "labels")


def load_dataset(spark: SparkSession, folder: str) -> DataFrame:
    """``(split, sample_id, features, label)``: image and label files of a folder, joined, kept."""
    images, _ = read_images(spark, f"{folder}/*images*")
    labels, _ = read_labels(spark, f"{folder}/*labels*")
    return images.join(labels, ["split", "sample_id"]).persist(StorageLevel.MEMORY_AND_DISK)


def write_files(df: DataFrame, folder: str, rows: int, cols: int) -> DataFrame:
    """``(name, items)``: write ``(pixels array<int>, label int)`` as image and label files.

    Each partition writes its own pair under a name of its number, so a task run again writes the
    same files over; a partition goes to disk as it streams by.
    """

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        system, base = _open(folder)
        system.create_dir(base)
        labels = bytearray()
        count = 0
        with system.open_output_stream(f"{base}/part{part:05d}-body.tmp") as body:
            for pdf in batches:
                for pixels, label in zip(pdf["pixels"], pdf["label"]):
                    body.write(np.asarray(pixels, np.uint8).tobytes())
                    labels.append(int(label))
                    count += 1
        with system.open_output_stream(f"{base}/part{part:05d}-images.idx") as out:
            out.write(struct.pack(">4I", IMAGE_MAGIC, count, rows, cols))
            with system.open_input_stream(f"{base}/part{part:05d}-body.tmp") as body:
                while chunk := body.read(RANGE_BYTES):
                    out.write(chunk)
        system.delete_file(f"{base}/part{part:05d}-body.tmp")
        with system.open_output_stream(f"{base}/part{part:05d}-labels.idx") as out:
            out.write(struct.pack(">2I", LABEL_MAGIC, count) + bytes(labels))
        yield pd.DataFrame({"name": [f"part{part:05d}"], "items": [count]})

    return df.select("pixels", "label").mapInPandas(save, "name string, items long")
