"""Shared pieces of the operators: tables, whole-text Arrow batches, components of sparse links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regatta.operators.common import cut_lineage

# Column names inside the operators start with this, so tables may bring any names of their own.
OWN = "_llm_"


def read(spark: SparkSession, sf_dir: str, table: str, *cols: str) -> DataFrame:
    """The named columns of a table; others, whatever they are called, are left out."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*cols)


def uniform(*cols: Column, seed: str = "") -> Column:
    """A hash of the columns as a number in [0, 1)."""
    bits = F.shiftrightunsigned(F.xxhash64(*cols, F.lit(seed)), 11)
    return bits.cast("double") / float(1 << 53)


def crc32_of_id(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over the links ``a``-``b``."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (jumped := label[label] != label).any():
            label = np.where(jumped, label[label], label)
        still = label[a] != label[b]
        a, b = a[still], b[still]
    return label


def sorted_runs(
    batches: Iterator[pd.DataFrame], keys: list[str]
) -> Iterator[pd.DataFrame]:
    """Cut key-sorted batches so that all rows of a key come in one frame.

    Only the last key of a batch waits for the next one; a frame holds many keys.
    """
    waiting: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        last = np.ones(len(batch), bool)
        for k in keys:
            last &= batch[k].to_numpy() == batch[k].iloc[-1]
        cut = int(len(batch) - np.argmin(last[::-1])) if not last.all() else 0
        if waiting and cut == 0 and all(waiting[-1][k].iloc[-1] == batch[k].iloc[0] for k in keys):
            waiting.append(batch)
            continue
        waiting.append(batch.iloc[:cut])
        whole = pd.concat(waiting, ignore_index=True)
        if len(whole):
            yield whole
        waiting = [batch.iloc[cut:]]
    if waiting:
        yield pd.concat(waiting, ignore_index=True)


def run_starts(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Where each key begins in a key-sorted frame, and the end."""
    new = np.ones(len(frame), bool)
    if len(frame) > 1:
        same = np.ones(len(frame) - 1, bool)
        for k in keys:
            values = frame[k].to_numpy()
            same &= values[1:] == values[:-1]
        new[1:] = ~same
    return np.append(np.flatnonzero(new), len(frame))


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` of every node in the links ``(a, b)``; one root for each component.

    Randomised contraction: every node moves to the neighbour (or itself) of the least hash in that
    round, links between merged nodes go, and the moves are followed back at the end. A round takes
    away a constant share of the nodes whatever the shape, and nothing but a count reaches the driver.
    """
    links = links.where(F.col("a") != F.col("b")).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    ).distinct()
    links = cut_lineage(links)
    moves: list[DataFrame] = []
    while not links.isEmpty():
        salt = len(moves)

        def ranked(c: str, salt: int = salt) -> Column:
            return F.struct(F.xxhash64(F.col(c), F.lit(salt)).alias("h"), F.col(c).alias("to"))

        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        move = cut_lineage(
            both.groupBy("a").agg(F.min(ranked("b")).alias("near"))
            .select(F.col("a").alias("node"), F.least(F.col("near"), ranked("a"))["to"].alias("to"))
        )
        moves.append(move)
        one = links.join(move.withColumnsRenamed({"node": "a", "to": "na"}), "a").select("na", "b")
        two = one.join(move.withColumnsRenamed({"node": "b", "to": "nb"}), "b")
        links = cut_lineage(
            two.where(F.col("na") != F.col("nb"))
            .select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"))
            .distinct()
        )
    if not moves:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = moves[-1].withColumnRenamed("to", "root")
    for move in reversed(moves[:-1]):
        later = roots.withColumnRenamed("node", "to").withColumnRenamed("root", "later")
        roots = move.join(later, "to", "left").select(
            "node", F.coalesce("later", "to").alias("root")
        )
    return roots
