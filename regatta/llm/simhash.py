"""SimHash near-duplicates: fingerprints of word shingles, linked by a forest of BK-trees.

Two fingerprints within four bits agree on at least two of six bit blocks, so every fingerprint goes
to the fifteen buckets of its block pairs and meets all its partners in one of them. In a bucket the
distinct fingerprints form BK-trees of at most ``SHARD_NODES`` nodes: a child hangs under the integer
Hamming distance to its parent, and a search follows only the edges within the radius of the distance
it has just seen. A bucket of more fingerprints has several shard trees, and each shard's fingerprints
go to every other shard's tree as a group of its own, so no bucket is cut and none is one task.
A group returns its links as edges to the local root, never as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regatta.llm.common import components, local_components, run_starts, sorted_runs
from regatta.operators.common import cut_lineage

# Fixed values of the contract.
SHINGLE_WORDS, SEED, RADIUS = 4, 42, 4
# Bit blocks: with two more blocks than the radius, two of them are always equal.
BLOCK_BITS = (11, 11, 11, 11, 10, 10)
SHARD_NODES = 4096
# Groups up to this size are searched node by node, larger ones a whole level at a time.
SMALL_GROUP = 48
CHUNK = 1 << 16


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit fingerprint of a whole text; no word: zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(SHINGLE_WORDS, len(words))
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1:].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in spans), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        octets = hashes[at: at + CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


@F.pandas_udf(T.LongType())
def fingerprint_of(texts: pd.Series) -> pd.Series:
    values = np.fromiter((fingerprint(t) for t in texts), np.uint64, len(texts))
    return pd.Series(values.view(np.int64))


class BKTree:
    """Fingerprints by integer Hamming distance to their parents."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.children: list[dict[int, int]] = [{} for _ in values]
        ints = values.tolist()
        for i in range(1, len(ints)):
            at = 0
            while True:
                d = (ints[at] ^ ints[i]).bit_count()
                below = self.children[at].get(d)
                if below is None:
                    self.children[at][d] = i
                    break
                at = below
        self.ints = ints

    def near(self, value: int, radius: int = RADIUS) -> list[int]:
        found, open_nodes = [], [0] if self.ints else []
        while open_nodes:
            at = open_nodes.pop()
            d = (self.ints[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            open_nodes += [c for key, c in self.children[at].items() if abs(key - d) <= radius]
        return found

    def near_all(
        self, queries: np.ndarray, radius: int = RADIUS
    ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(query, node)`` pairs within the radius, many queries walking down side by side."""
        table = np.full((len(self.values), 65 + 2 * radius), -1, np.int32)
        for at, below in enumerate(self.children):
            for key, child in below.items():
                table[at, key + radius] = child
        reach = np.arange(2 * radius + 1)
        for begin in range(0, len(queries), 256):
            q = np.arange(begin, min(begin + 256, len(queries)))
            node = np.zeros(len(q), np.int32)
            while len(q):
                d = np.bitwise_count(queries[q] ^ self.values[node]).astype(np.int64)
                hit = d <= radius
                if hit.any():
                    yield q[hit], node[hit]
                below = table[node[:, None], d[:, None] + reach]
                row, col = np.nonzero(below >= 0)
                q, node = q[row], below[row, col]


def _group_links(nodes: np.ndarray, queries: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Edges to local roots among ``nodes`` alone, or between them and ``queries``."""
    everything = nodes if queries is None else np.concatenate([nodes, queries])
    asked, shift = (nodes, 0) if queries is None else (queries, len(nodes))
    tree = BKTree(nodes)
    label = np.arange(len(everything))
    if len(everything) <= SMALL_GROUP:
        pairs = [(i + shift, j) for i, v in enumerate(asked.tolist()) for j in tree.near(v)]
        a = np.fromiter((p[0] for p in pairs), np.int64, len(pairs))
        b = np.fromiter((p[1] for p in pairs), np.int64, len(pairs))
        label = local_components(len(everything), a, b)
    else:
        for a, b in tree.near_all(asked):
            # Roots so far stand for their members: the links held at once stay few.
            step = local_components(len(everything), label[a + shift], label[b])
            label = step[label]
    moved = label != np.arange(len(everything))
    return everything[moved], everything[label[moved]]


def _search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    keys = ["bucket", "low", "high"]
    for frame in sorted_runs(batches, keys):
        cuts = run_starts(frame, keys)
        values = frame["fp"].to_numpy().view(np.uint64)
        own, low, high = (frame[c].to_numpy() for c in ("shard", "low", "high"))
        out_a, out_b = [], []
        for s in np.flatnonzero(np.diff(cuts) > 1):
            at = slice(cuts[s], cuts[s + 1])
            if low[at.start] == high[at.start]:
                a, b = _group_links(values[at], None)
            else:
                mine = own[at] == low[at.start]
                if mine.all() or not mine.any():
                    continue
                a, b = _group_links(values[at][mine], values[at][~mine])
            out_a.append(a)
            out_b.append(b)
        if out_a:
            yield pd.DataFrame({
                "a": np.concatenate(out_a).view(np.int64), "b": np.concatenate(out_b).view(np.int64)
            })


def _buckets(fp: Column) -> Column:
    blocks, offset = [], 0
    for bits in BLOCK_BITS:
        blocks.append((F.shiftrightunsigned(fp, offset).bitwiseAND(F.lit((1 << bits) - 1)), bits))
        offset += bits
    keys = []
    for n, ((x, _), (y, bits)) in enumerate(combinations(blocks, 2)):
        keys.append(F.lit(n << 40).cast("long") + F.shiftleft(x, bits) + y)
    return F.array(*keys)


def fingerprint_links(prints: DataFrame, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """Edges ``(a, b)`` that connect all distinct fingerprints ``fp`` within the radius."""
    members = prints.select("fp", F.explode(_buckets(F.col("fp"))).alias("bucket"))
    heavy = cut_lineage(
        members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > shard_nodes)
        .select("bucket", F.ceil(F.col("n") / shard_nodes).cast("int").alias("shards"))
    )
    placed = members.join(heavy, "bucket", "left").select(
        "bucket", "fp", F.coalesce("shards", F.lit(1)).alias("shards")
    ).withColumn("shard", F.pmod(F.xxhash64("fp"), F.col("shards")).cast("int"))
    meets = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    groups = meets.select(
        "bucket", "fp", "shard",
        F.least("shard", "other").alias("low"), F.greatest("shard", "other").alias("high"),
    )
    return (
        groups.repartition("bucket", "low", "high")
        .sortWithinPartitions("bucket", "low", "high", "fp")
        .mapInPandas(_search, "a long, b long")
    )


def near_duplicate_classes(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_nodes: int = SHARD_NODES
) -> DataFrame:
    """``(doc_id, text_hash, fp, rep)`` for every row; ``rep`` is ``(doc_id, text_hash)`` of its class.

    The representative is the row of the smallest ``doc_id``; rows without an id come after those
    with one. A null text is an empty one, and texts without a word all have the fingerprint zero and
    are one class. Repeated rows stay, each with the same class. Other columns are not read.
    """
    rows = cut_lineage(docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"),
        fingerprint_of(F.coalesce(text, F.lit(""))).alias("fp"),
    ))
    first = F.min(F.struct(
        F.col("doc_id").isNull().alias("missing"), F.col("doc_id"), F.col("text_hash")
    ))
    prints = cut_lineage(rows.groupBy("fp").agg(first.alias("first")))
    roots = cut_lineage(components(fingerprint_links(prints, shard_nodes)))
    linked = roots.join(prints, roots["node"] == prints["fp"]).select("fp", "root", "first")
    best = linked.groupBy("root").agg(F.min("first").alias("best"))
    classes = linked.select("fp", "root").join(best, "root").select("fp", "best")
    # A table of its own, so that the join below stands alone and a hot fingerprint can be split.
    known = cut_lineage(prints.join(classes, "fp", "left").select(
        "fp", F.coalesce("best", "first").alias("rep")
    ))
    return rows.join(known, "fp", "left").select(
        "doc_id", "text_hash", "fp",
        F.struct(F.col("rep")["doc_id"].alias("doc_id"), F.col("rep")["text_hash"].alias("text_hash"))
        .alias("rep"),
    )


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without near-duplicates: the representative of every class, once."""
    classes = near_duplicate_classes(docs)
    key = ["_llm_id", "_llm_named", "_llm_hash"]

    def keyed(frame: DataFrame, doc_id: Column, text_hash: Column) -> DataFrame:
        return frame.withColumns({
            "_llm_id": F.coalesce(doc_id, F.lit(0)), "_llm_named": doc_id.isNotNull(),
            "_llm_hash": text_hash,
        })

    reps = keyed(classes, F.col("rep.doc_id"), F.col("rep.text_hash")).select(*key).distinct()
    rows = keyed(docs, F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))))
    # One key for the join and for repeated rows: the texts move once.
    return rows.join(reps, key, "left_semi").dropDuplicates(key).drop(*key)


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
