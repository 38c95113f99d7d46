"""Near-duplicate vectors by exact comparison of cluster shards.

Every distinct vector goes to the shard of its nearest centre. Shards lie one after the other and are
cut into parts of bounded size, a crowded shard into several, so no group makes one task. Every two
parts meet in a task of their own. There, blocks of two shards are compared in double precision,
unless the angle between their middles shows that no vector of one can be near one of the other. So
every link is found, whatever the size of the table and of its groups.

Only counts and edges to local roots leave a task, so a group of thousands of near copies gives as
many rows as its members meet parts.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regatta.llm.common import components, local_components, uniform
from regatta.operators.common import cut_lineage

# Fixed value of the contract.
COSINE = 0.95
# Vectors per shard in the mean, most vectors compared as one block, centres at most.
SHARD_NODES, BLOCK_NODES, MAX_CENTRES = 1000, 2048, 4096
# Vectors per centre, at most, in the sample that the centres are fitted on.
SAMPLE_PER_CENTRE, ROUNDS = 24, 8
# Parts of a small table, and the numbers (rows by length) that a part of a large one holds at most.
PARTS, PART_NUMBERS = 8, 1 << 22
# Slack of the angle below which blocks are compared, far above the rounding of double precision.
ROUNDING = 1e-6

SHARDS = "cid long, unit array<double>, n long, shard long, width long"
FOUND = "cid long, links long, root long"


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """``(cid, h1, h2, unit, n, first)``: one row for each usable distinct vector.

    Vectors that are null, empty, zero, or hold null or non-finite components are left out.
    """
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = rows.where(F.col("vector").isNotNull() & ~odd).withColumn("norm", F.sqrt(square))
    usable = usable.where((F.col("norm") > 0) & (F.col("norm") < float("inf")))
    grouped = usable.groupBy("h1", "h2").agg(
        F.first("vector").alias("vector"), F.first("norm").alias("norm"),
        F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first"),
    )
    unit = F.transform("vector", lambda x: x / F.col("norm"))
    return cut_lineage(grouped.select(
        F.monotonically_increasing_id().alias("cid"), "h1", "h2", unit.alias("unit"), "n", "first"
    ))


def fit_centres(sample: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from evenly spaced members of the sample."""
    centres = sample[np.linspace(0, len(sample) - 1, k).astype(int)]
    for _ in range(ROUNDS):
        own = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-300), centres)
    return centres


def _centres_by_width(classes: DataFrame, shard_nodes: int) -> dict[int, np.ndarray]:
    """Centres for every vector length, fitted on a bounded sample in hash order."""
    counts = {r["d"]: r["n"] for r in classes.groupBy(F.size("unit").alias("d"))
              .agg(F.count(F.lit(1)).alias("n")).collect()}
    centres = {}
    for width, n in counts.items():
        k = min(MAX_CENTRES, max(1, round(n / shard_nodes)))
        wanted = k * SAMPLE_PER_CENTRE
        order = uniform(F.col("h1"), seed="centres")
        sample = classes.where((F.size("unit") == width) & (order < 2.0 * wanted / n)).orderBy(
            order, "cid").limit(wanted).select("unit").toPandas()
        points = np.stack(sample["unit"].to_numpy()) if len(sample) else np.eye(1, width)
        centres[width] = fit_centres(points, min(k, len(points)))
    return centres


def _assign(centres: dict[int, np.ndarray]):
    starts, at = {}, 0
    for width in sorted(centres):
        starts[width] = at
        at += len(centres[width])

    def assign(batches):
        for batch in batches:
            widths = batch["unit"].map(len).to_numpy()
            for width in np.unique(widths):
                part = batch[widths == width]
                near = np.stack(part["unit"].to_numpy()) @ centres[width].T
                yield part.assign(shard=near.argmax(axis=1) + starts[width], width=width)

    return assign


def _chunks(side: pd.DataFrame, block_nodes: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, float]]:
    """Places, vectors, middle and angle around it, for at most so many vectors of one shard each."""
    shard = side["shard"].to_numpy()
    out = []
    for own in np.split(np.arange(len(shard)), np.flatnonzero(shard[1:] != shard[:-1]) + 1):
        for at in range(0, len(own), block_nodes):
            part = own[at: at + block_nodes]
            units = np.stack(side["unit"].iloc[part].to_numpy())
            middle = units.sum(axis=0)
            norm = np.linalg.norm(middle)
            middle = middle / norm if norm > 0 else units[0]
            out.append((part, units, middle, float(_angle(units @ middle).max())))
    return out


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def _compare(cosine: float, block_nodes: int):
    reach = float(_angle(np.array(cosine))) + ROUNDING

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        low, high = (int(x) for x in key)
        rows = rows.sort_values(["part", "shard", "cid"], ignore_index=True)
        part, weight = rows["part"].to_numpy(), rows["n"].to_numpy(float)
        cut = int((part == low).sum()) if low != high else 0
        one = _chunks(rows.iloc[:cut], block_nodes) if cut else []
        two = _chunks(rows.iloc[cut:].reset_index(drop=True), block_nodes) if cut < len(rows) else []
        two = [(places + cut, *rest) for places, *rest in two]
        pairs = [(x, y) for x in one for y in two] if low != high else [
            (x, y) for i, x in enumerate(two) for y in two[i:]]
        links, label = np.zeros(len(rows)), np.arange(len(rows))
        for (a, of_a, mid_a, wide_a), (b, of_b, mid_b, wide_b) in pairs:
            if _angle(mid_a @ mid_b) > wide_a + wide_b + reach:
                continue
            hit = of_a @ of_b.T >= cosine
            if a is b:
                np.fill_diagonal(hit, False)
            if not hit.any():
                continue
            links[a] += hit @ weight[b]
            if a is not b:
                links[b] += weight[a] @ hit
            x, y = np.nonzero(hit)
            x, y = label[a[x]], label[b[y]]
            if (apart := x != y).any():
                label = local_components(len(rows), x[apart], y[apart])[label]
        told = (links > 0) | (label != np.arange(len(rows)))
        cid = rows["cid"].to_numpy()
        return pd.DataFrame({"cid": cid[told], "links": links[told].astype(np.int64), "root": cid[label[told]]})

    return compare


def vector_links(
    classes: DataFrame, cosine: float = COSINE, shard_nodes: int = SHARD_NODES, block_nodes: int = BLOCK_NODES,
) -> DataFrame:
    """``(cid, links, root)``: per pair of parts, how many vectors a class links with, and a local root."""
    centres = _centres_by_width(classes, shard_nodes)
    placed = cut_lineage(classes.select("cid", "unit", "n").mapInPandas(_assign(centres), SHARDS))
    sizes = placed.groupBy("width", "shard").agg(F.count(F.lit(1)).alias("size")).orderBy(
        "width", "shard").collect()
    totals = Counter()
    for r in sizes:
        totals[r["width"]] += r["size"]
    # Shards lie one after the other, so a part holds whole ones, or a slice of a crowded one.
    where, first, at, before = [], 0, 0, None
    for r in sizes:
        width = r["width"]
        if width != before:
            rows = min(max(block_nodes, -(-totals[width] // PARTS)), max(1, PART_NUMBERS // width))
            first = where[-1][5] + 1 if where else 0
            at, before = 0, width
        last = first + (totals[width] - 1) // rows
        where.append((r["shard"], at, r["size"], rows, first, last))
        at += r["size"]
    known = classes.sparkSession.createDataFrame(
        where, "shard long, at long, size long, rows long, first long, last long")
    place = F.col("at") + F.floor(uniform(F.col("cid"), seed="part") * F.col("size"))
    parts = placed.join(known, "shard").withColumn("part", F.col("first") + F.floor(place / F.col("rows")))
    meets = parts.withColumn("other", F.explode(F.sequence("first", "last"))).select(
        "cid", "unit", "n", "shard", "part",
        F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"),
    )
    return meets.groupBy("low", "high").applyInPandas(_compare(cosine, block_nodes), FOUND)


def near_duplicate_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE,
    **shape: int,
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row, whatever its vector.

    Copies are one class, which links its members with each other. Vectors that are null, empty,
    zero or hold null or non-finite components link with nothing, and so do vectors of different
    lengths. A row without an id counts as a partner but gives its component no name. Other columns
    are not read; an empty table gives no rows.
    """
    rows = vectors.select(
        F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector")
    ).withColumns({"h1": F.xxhash64("vector"), "h2": F.xxhash64("vector", F.lit(2))})
    classes = distinct_vectors(rows)
    found = cut_lineage(vector_links(classes, cosine, **shape))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    roots = cut_lineage(roots)
    least = roots.join(classes.select(F.col("cid").alias("node"), "first"), "node").groupBy("root").agg(
        F.min("first").alias("least"))
    named = roots.join(least, "root").select(F.col("node").alias("cid"), "least")
    known = classes.join(links, "cid", "left").join(named, "cid", "left").select(
        "h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("least", "first").alias("component_id"), F.lit(True).alias("usable"),
    )
    done = rows.select("vec_id", "h1", "h2").join(known, ["h1", "h2"], "left")
    component = F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("vec_id"))
    return done.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


def _plain_counts(asked: np.ndarray, cosine: float):
    def count(batches):
        for batch in batches:
            fits = batch["unit"].map(len).to_numpy() == asked.shape[1]
            part = batch[fits]
            if len(part):
                hit = asked @ np.stack(part["unit"].to_numpy()).T >= cosine
                yield pd.DataFrame({"q": np.arange(len(asked)), "n": hit @ part["n"].to_numpy()})

    return count


def audit_recall(
    vectors: DataFrame, result: DataFrame, queries: int = 1000, cosine: float = COSINE
) -> float:
    """Share of true links found, over at most so many query vectors compared with all others."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector")).withColumns(
        {"h1": F.xxhash64("vector"), "h2": F.xxhash64("vector", F.lit(2))})
    classes = distinct_vectors(rows)
    asked = classes.where(F.col("first").isNotNull()).orderBy(
        uniform(F.col("h1"), seed="audit"), "cid").limit(queries).join(
        result.select(F.col("vec_id").alias("first"), "n_links"), "first").toPandas()
    if asked.empty:
        return 1.0
    true = classes.mapInPandas(_plain_counts(np.stack(asked["unit"].to_numpy()), cosine), "q int, n long")
    wanted = true.agg(F.sum("n")).first()[0] - len(asked)
    return 1.0 if not wanted else float(asked["n_links"].sum() / wanted)
