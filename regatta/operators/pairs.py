"""Exact pairwise work over vectors in bounded blocks.

Vectors are split into cells around a few pivots. A vector visits another cell only where the
triangle inequality leaves room for a partner within ``max_distance``; every cell is then cut into
blocks of a fixed row count, and one task compares two blocks with a numpy kernel. What leaves a
task is what was asked for: the pairs inside the bound, each row's nearest few, or plain sums.
Copies of one vector are collapsed first (``collapse_copies``), so a crowd of them is one row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from regatta.functions.arrays import unit
from regatta.functions.hashing import hash_uniform

# Bytes one block of vectors may take, and the row counts it may lead to.
BLOCK_BYTES = 32 << 20
BLOCK_ROWS = (16, 1024)
# Rows of a block whose pairs leave the task strip by strip, the blocks there should be at least, and
# the distances of one strip.
STREAMED_ROWS = 16384
STREAMED_BLOCKS = 24
STRIP_CELLS = 1 << 20
# Pivots tried for pruning, and the share of the full pair count below which it is worth it.
PIVOTS = 32
PRUNE_GAIN = 0.5

EDGE_SCHEMA = "src long, dst long, d double"


def _l1(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty((len(a), len(b)))
    for i in range(0, len(a), 32):
        out[i : i + 32] = np.abs(a[i : i + 32, None, :] - b[None, :, :]).sum(-1)
    return out


def _l2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty((len(a), len(b)))
    for i in range(0, len(a), 32):
        out[i : i + 32] = np.sqrt(((a[i : i + 32, None, :] - b[None, :, :]) ** 2).sum(-1))
    return out


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1.0 - a @ b.T


def _hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    y = np.ascontiguousarray(b.T)
    rows = max(1, (1 << 16) // max(1, len(b)))
    for i in range(0, len(a), rows):
        x = a[i : i + rows].T
        # Places are counted in bytes, as many as a byte counts at a time.
        for s in range(0, len(y), 255):
            total = np.zeros((x.shape[1], len(b)), np.uint8)
            for u, v in zip(x[s : s + 255], y[s : s + 255]):
                total += (u[:, None] != v).view(np.uint8)
            out[i : i + rows] += total
    return out


# Cosine works on unit vectors, normalised once per row before the blocks are made.
KERNELS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "l1": _l1,
    "l2": _l2,
    "cosine": _cosine,
    "hamming": _hamming,
}


def _rough_l1(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """Cells that may lie within the L1 bound: single precision, with room for all of its rounding."""
    with np.errstate(over="ignore", invalid="ignore"):
        x, y = a.astype(np.float32), np.ascontiguousarray(b.T, np.float32)
        longest = np.abs(x).sum(1, dtype=float).max() + np.abs(y).sum(0, dtype=float).max()
        most = bound + (a.shape[1] + 4) * 2.0**-22 * (longest + bound)
        out = np.empty((len(a), len(b)), bool)
        rows = max(1, (1 << 16) // len(b))
        for i in range(0, len(a), rows):
            strip = x[i : i + rows]
            total, gap = np.zeros((2, len(strip), len(b)), np.float32)
            for u, v in zip(strip.T, y):
                np.subtract(u[:, None], v, out=gap)
                np.abs(gap, out=gap)
                total += gap
            # What is not a number is left to the exact comparison.
            np.logical_not(total > most, out=out[i : i + rows])
    return out


def _rough_l2(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """Cells that may lie within the L2 bound: one matrix product, with room for its rounding."""
    with np.errstate(over="ignore", invalid="ignore"):
        lengths = (a * a).sum(1)[:, None] + (b * b).sum(1)
        most = bound * bound + (a.shape[1] + 4) * 2.0**-48 * (lengths + bound * bound)
        return ~(lengths - 2.0 * (a @ b.T) > most)


ROUGH = {"l1": _rough_l1, "l2": _rough_l2}


def _near_cells(
    a: np.ndarray, b: np.ndarray, metric: str, bound: float | None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(i, j, d)`` of the cells within the bound, distances as the kernel gives them."""
    if bound is None or metric not in ROUGH:
        d = KERNELS[metric](a, b)
        i, j = np.nonzero(d <= bound) if bound is not None else map(np.ravel, np.indices(d.shape))
        return i, j, d[i, j]
    i, j = np.nonzero(ROUGH[metric](a, b, bound))
    d = np.empty(len(i))
    step = max(1, STRIP_CELLS // max(1, a.shape[1]))
    for s in range(0, len(i), step):
        gap = a[i[s : s + step]] - b[j[s : s + step]]
        d[s : s + step] = np.abs(gap).sum(-1) if metric == "l1" else np.sqrt((gap**2).sum(-1))
    near = d <= bound
    return i[near], j[near], d[near]


@dataclass(frozen=True)
class Blocks:
    """Rows ``(cell, kind, x, y, side, entity, vector...)``; one task per ``(cell, kind, x, y)``."""

    rows: DataFrame
    metric: str

    def apply(self, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
        return self.rows.groupBy("cell", "kind", "x", "y").applyInPandas(work, schema)


def collapse_copies(df: DataFrame, entity: str = "entity", vector: str = "vector") -> DataFrame:
    """``(entity, vector, copies)``: one row per distinct vector, named by its smallest entity."""
    return df.groupBy(F.col(vector).alias("vector")).agg(
        F.min(entity).cast("long").alias("entity"), F.count(F.lit(1)).alias("copies")
    ).select("entity", "vector", "copies")


def copy_members(df: DataFrame, entity: str = "entity", vector: str = "vector") -> DataFrame:
    """``(entity, rep)``: every entity with the one standing for its vector.

    The join key is a digest of the vector, salted by entity: a crowd of copies spreads out.
    """
    from regatta.operators.common import spread_join

    keyed = df.select(
        F.col(entity).cast("long").alias("entity"), F.sha2(F.to_json(vector), 256).alias("_key")
    )
    reps = keyed.groupBy("_key").agg(F.min("entity").alias("rep"))
    return spread_join(keyed, reps, ["_key"], ["entity"]).select("entity", "rep")


def relative_to(df: DataFrame, reference: DataFrame) -> DataFrame:
    """Vectors less one reference vector (the only row of ``reference``)."""
    one = reference.select("vector").scalar()
    return df.withColumn("_ref", one).withColumn(
        "vector", F.zip_with("vector", "_ref", lambda x, r: x - r)
    ).drop("_ref")


def _stack(values: pd.Series) -> np.ndarray:
    return np.stack(values.to_numpy()).astype(float)


def _to_metric(values: np.ndarray, metric: str) -> np.ndarray:
    """Distances that obey the triangle inequality (chord length stands in for cosine)."""
    return np.sqrt(np.maximum(2.0 * values, 0.0)) if metric == "cosine" else values


def _visits(
    pdf: pd.DataFrame, pivots: np.ndarray, metric: str, reach: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, cell, home)`` of a batch: where each row lives and which lower cells it visits.

    If d(x, y) <= r and y's nearest pivot is j, then d(x, p_j) <= d(x, p_home) + 2r, so x must be
    seen in cell j. A pair is judged once, in the lower cell, so visits only go downwards.
    """
    far = _to_metric(KERNELS[metric](_stack(pdf["vector"]), pivots), metric)
    home = far.argmin(1)
    own = far[np.arange(len(far)), home]
    near = far <= (own + 2.0 * reach + 1e-9 * (1.0 + own))[:, None]
    near &= np.arange(far.shape[1])[None, :] <= home[:, None]
    row, cell = np.nonzero(near)
    return row, cell, home[row] == cell


def _cell_counts(
    points: DataFrame, pivots: np.ndarray, metric: str, reach: float
) -> dict[int, tuple[int, int]]:
    """``cell -> (home rows, visits)``, counted per batch without moving a vector."""

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            _, cell, at_home = _visits(pdf, pivots, metric, reach)
            yield pd.DataFrame({
                "cell": np.arange(len(pivots), dtype="int32"),
                "h": np.bincount(cell[at_home], minlength=len(pivots)),
                "v": np.bincount(cell[~at_home], minlength=len(pivots)),
            })

    parts = points.select("vector").mapInPandas(tally, "cell int, h long, v long")
    sums = parts.groupBy("cell").agg(F.sum("h").alias("h"), F.sum("v").alias("v"))
    return {r["cell"]: (r["h"], r["v"]) for r in sums.filter(F.col("h") + F.col("v") > 0).collect()}


def _cells(points: DataFrame, pivots: np.ndarray, metric: str, reach: float) -> DataFrame:
    """Points with ``cell`` and ``home``, one row per cell a point lives in or visits."""

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            row, cell, at_home = _visits(pdf, pivots, metric, reach)
            out = pdf.iloc[row].reset_index(drop=True)
            yield out.assign(cell=cell.astype("int32"), home=at_home)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema.fields)
    return points.mapInPandas(route, f"{schema}, cell int, home boolean")


def _block_rows(dim: int) -> int:
    low, high = BLOCK_ROWS
    return max(low, min(high, BLOCK_BYTES // (8 * max(1, dim))))


def _streamed_rows(n: int, dim: int) -> int:
    """A row travels once for each block, so blocks grow with the fleet up to what a task can hold."""
    most = max(BLOCK_ROWS[0], min(STREAMED_ROWS, BLOCK_BYTES // (8 * max(1, dim))))
    return max(_block_rows(dim), min(most, -(-n // STREAMED_BLOCKS)))


def make_blocks(
    df: DataFrame,
    metric: str,
    max_distance: float | None = None,
    entity: str = "entity",
    vector: str = "vector",
    extra: list[str] | None = None,
    streamed: bool = False,
) -> Blocks | None:
    """Cells and blocks covering every pair that may lie within ``max_distance``.

    ``streamed`` makes larger blocks for work that never holds all distances of a task.
    """
    extra = extra or []
    source = F.col(vector).cast("array<double>")
    points = df.select(
        F.col(entity).cast("long").alias("entity"),
        (unit(source) if metric == "cosine" else source).alias("vector"),
        *extra,
    )
    size = points.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dim")
    ).first()
    if size["n"] == 0:
        return None
    rows = _streamed_rows(size["n"], size["dim"]) if streamed else _block_rows(size["dim"])

    plain = points.withColumns({"cell": F.lit(0), "home": F.lit(True)})
    tagged, counts = plain, {0: (size["n"], 0)}
    bounded = max_distance is not None and not (metric == "cosine" and max_distance >= 1.0)
    if bounded and size["n"] > rows:
        chosen = points.orderBy(hash_uniform(F.col("entity"), "pivot"), "entity").limit(PIVOTS)
        pivots = _stack(chosen.select("vector").toPandas()["vector"])
        reach = float(_to_metric(np.array(max_distance), metric))
        found = _cell_counts(points, pivots, metric, reach)
        cost = sum(h * (h / 2 + v) for h, v in found.values())
        if cost < PRUNE_GAIN * size["n"] ** 2 / 2:
            tagged, counts = _cells(points, pivots, metric, reach), found

    def blocks_of(n: int) -> int:
        return max(1, -(-n // rows))

    layout = [(c, blocks_of(h), blocks_of(v) if v else 0) for c, (h, v) in counts.items()]
    hb = F.create_map(*[F.lit(x) for c, h, _ in layout for x in (c, h)])[F.col("cell")]
    vb = F.create_map(*[F.lit(x) for c, _, v in layout for x in (c, v)])[F.col("cell")]
    placed = tagged.withColumns({"_hb": hb, "_vb": vb}).withColumn(
        "_b",
        F.pmod(F.xxhash64("entity"), F.when(F.col("home"), F.col("_hb")).otherwise(F.col("_vb")))
        .cast("int"),
    )
    b = F.col("_b")

    def task(kind: str, x: Column, y: Column, side: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), x.cast("int").alias("x"), y.cast("int").alias("y"),
            side.cast("int").alias("side"),
        )

    among = F.transform(
        F.sequence(F.lit(0), F.col("_hb") - 1),
        lambda c: task("h", F.least(b, c), F.greatest(b, c), F.when(b <= c, 0).otherwise(1)),
    )
    with_visitors = F.when(
        F.col("_vb") > 0,
        F.transform(F.sequence(F.lit(0), F.col("_vb") - 1), lambda c: task("v", b, c, F.lit(0))),
    ).otherwise(F.array().cast("array<struct<kind:string,x:int,y:int,side:int>>"))
    as_visitor = F.transform(
        F.sequence(F.lit(0), F.col("_hb") - 1), lambda c: task("v", c, b, F.lit(1))
    )
    spread = placed.withColumn(
        "_t", F.explode(F.when(F.col("home"), F.concat(among, with_visitors)).otherwise(as_visitor))
    ).select("cell", "_t.*", "entity", "vector", *extra)
    return Blocks(spread, metric)


def _sides(pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, bool]:
    """The two blocks of a task; a diagonal task compares one block with itself."""
    first = pdf["kind"].iat[0], pdf["x"].iat[0], pdf["y"].iat[0]
    diagonal = first[0] == "h" and first[1] == first[2]
    left = pdf[pdf["side"] == 0]
    return left, (left if diagonal else pdf[pdf["side"] == 1]), diagonal


def _task_distances(pdf: pd.DataFrame, metric: str):
    left, right, diagonal = _sides(pdf)
    if left.empty or right.empty:
        return left, right, None, None
    d = KERNELS[metric](_stack(left["vector"]), _stack(right["vector"]))
    keep = np.triu(np.ones(d.shape, bool), 1) if diagonal else np.ones(d.shape, bool)
    return left, right, d, keep


def pair_distances(
    df: DataFrame,
    metric: str = "cosine",
    max_distance: float | None = None,
    entity: str = "entity",
    vector: str = "vector",
    all_pairs: bool = False,
) -> DataFrame:
    """``(src, dst, d)`` with ``src < dst``, each pair once.

    The pairs within ``max_distance``, or with ``all_pairs`` the whole matrix: as many rows as it
    has cells, in tasks of bounded size, whatever the size of the fleet.
    """
    if max_distance is None and not all_pairs:
        raise ValueError("give max_distance, or ask for all_pairs, which are as many as the cells of the matrix")
    blocks = make_blocks(df, metric, max_distance, entity, vector, streamed=True)
    if blocks is None:
        return df.sparkSession.createDataFrame([], EDGE_SCHEMA)

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, right, diagonal = _sides(pd.concat(parts, ignore_index=True))
        if left.empty or right.empty:
            return
        a, b = left["entity"].to_numpy(), right["entity"].to_numpy()
        x, y = _stack(left["vector"]), _stack(right["vector"])
        strip = max(1, STRIP_CELLS // len(b))
        for s in range(0, len(a), strip):
            i, j, d = _near_cells(x[s : s + strip], y, metric, max_distance)
            if diagonal:
                above = j > i + s
                i, j, d = i[above], j[above], d[above]
            p, q = a[i + s], b[j]
            yield pd.DataFrame({"src": np.minimum(p, q), "dst": np.maximum(p, q), "d": d})

    return blocks.apply(work, EDGE_SCHEMA)


def _joined(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels, each the smallest place of its component, after the links ``i`` to ``j``."""
    while True:
        p, q = labels[i], labels[j]
        apart = p != q
        if not apart.any():
            return labels
        i, j, p, q = i[apart], j[apart], p[apart], q[apart]
        labels = labels.copy()
        np.minimum.at(labels, np.maximum(p, q), np.minimum(p, q))
        while (labels[labels] != labels).any():
            labels = labels[labels]


def near_forest(
    df: DataFrame, metric: str, max_distance: float, entity: str = "entity", vector: str = "vector"
) -> DataFrame:
    """``(src, dst)``: links that have the components of all pairs within ``max_distance``.

    A task joins what it finds near and tells one link a row, never its pairs.
    """
    schema = "src long, dst long"
    blocks = make_blocks(df, metric, max_distance, entity, vector, streamed=True)
    if blocks is None:
        return df.sparkSession.createDataFrame([], schema)

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, right, diagonal = _sides(pd.concat(parts, ignore_index=True))
        if left.empty or right.empty:
            return
        ids = left["entity"].to_numpy()
        if not diagonal:
            ids = np.concatenate([ids, right["entity"].to_numpy()])
        x, y = _stack(left["vector"]), _stack(right["vector"])
        labels, shift = np.arange(len(ids)), 0 if diagonal else len(x)
        strip = max(1, STRIP_CELLS // len(y))
        for s in range(0, len(x), strip):
            # What is one component already needs no comparison.
            mine, others = labels[s : min(s + strip, len(x))], labels[shift : shift + len(y)]
            common = np.bincount(mine).argmax()
            for some, rest in ((mine == common, others != common), (mine != common, others == others)):
                a, b = s + np.flatnonzero(some), np.flatnonzero(rest)
                if len(a) and len(b):
                    i, j, _ = _near_cells(x[a], y[b], metric, max_distance)
                    labels = _joined(labels, a[i], b[j] + shift)
        told = np.flatnonzero(labels != np.arange(len(ids)))
        p, q = ids[labels[told]], ids[told]
        yield pd.DataFrame({"src": np.minimum(p, q), "dst": np.maximum(p, q)})

    return blocks.apply(work, schema)


def nearest_neighbours(
    df: DataFrame, k: int, metric: str = "cosine", entity: str = "entity", vector: str = "vector"
) -> DataFrame:
    """``(src, dst, d)``: the exact ``k`` nearest others of every entity, ties to the smaller id."""
    blocks = make_blocks(df, metric, None, entity, vector)
    if blocks is None:
        return df.sparkSession.createDataFrame([], EDGE_SCHEMA)

    def best(ids: np.ndarray, others: np.ndarray, d: np.ndarray) -> pd.DataFrame:
        order = np.lexsort((np.broadcast_to(others, d.shape), d), axis=1)[:, :k]
        rows = np.repeat(np.arange(len(ids)), order.shape[1])
        cols = order.ravel()
        return pd.DataFrame({"src": ids[rows], "dst": others[cols], "d": d[rows, cols]})

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right, d, _ = _task_distances(pdf, metric)
        if d is None:
            return pd.DataFrame({"src": [], "dst": [], "d": []})
        a, b = left["entity"].to_numpy(), right["entity"].to_numpy()
        if left is right:
            d = d.copy()
            np.fill_diagonal(d, np.inf)
            out = best(a, b, d)
        else:
            out = pd.concat([best(a, b, d), best(b, a, d.T)])
        return out[np.isfinite(out["d"])]

    # A source meets each block once, so at most k rows per block reach its final ranking.
    order = W.partitionBy("src").orderBy("d", "dst")
    found = blocks.apply(work, EDGE_SCHEMA)
    return found.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_r")


def mean_pair_distance(
    df: DataFrame, metric: str, entity: str = "entity", vector: str = "vector"
) -> DataFrame:
    """``sigma`` from per-task sums: for metrics without a closed form."""
    blocks = make_blocks(df, metric, None, entity, vector)
    schema = "n long, total double"

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        _, _, d, keep = _task_distances(pdf, metric)
        if d is None:
            return pd.DataFrame({"n": [0], "total": [0.0]})
        return pd.DataFrame({"n": [int(keep.sum())], "total": [float(d[keep].sum())]})

    if blocks is None:
        sums = df.sparkSession.createDataFrame([], schema)
    else:
        sums = blocks.apply(work, schema)
    mean = F.sum("total") / F.sum("n")
    return sums.agg(
        F.when((F.sum("n") > 0) & (F.sum("total") != 0), mean).otherwise(F.lit(1.0)).alias("sigma")
    )


def cluster_distance_sums(
    df: DataFrame,
    metric: str,
    entity: str = "entity",
    vector: str = "vector",
    cluster: str = "cluster",
) -> DataFrame:
    """``(entity, cluster, other, n, total)``: distance from every entity to every cluster."""
    schema = "entity long, cluster int, other int, n long, total double"
    prepared = df.withColumn("cluster", F.col(cluster).cast("int"))
    blocks = make_blocks(prepared, metric, None, entity, vector, ["cluster"])
    if blocks is None:
        return df.sparkSession.createDataFrame([], schema)

    def sums(a: pd.DataFrame, b: pd.DataFrame, d: np.ndarray) -> pd.DataFrame:
        labels, where = np.unique(b["cluster"].to_numpy(), return_inverse=True)
        member = np.zeros((len(b), len(labels)))
        member[np.arange(len(b)), where] = 1.0
        total, size = d @ member, member.sum(0)
        n = np.tile(size, (len(a), 1))
        if a is b:
            n -= member
        return pd.DataFrame({
            "entity": np.repeat(a["entity"].to_numpy(), len(labels)),
            "cluster": np.repeat(a["cluster"].to_numpy(), len(labels)),
            "other": np.tile(labels, len(a)),
            "n": n.ravel().astype("int64"),
            "total": total.ravel(),
        })

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right, d, _ = _task_distances(pdf, metric)
        if d is None:
            return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
        if left is right:
            d = d.copy()
            np.fill_diagonal(d, 0.0)
            return sums(left, left, d)
        return pd.concat([sums(left, right, d), sums(right, left, d.T)])

    return blocks.apply(work, schema).groupBy("entity", "cluster", "other").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total")
    )


def mean_pairwise(df: DataFrame, metric: str, vector: str = "vector") -> DataFrame:
    """Kernel width: closed form for cosine and L1, block sums for the others."""
    from regatta.operators.aggregate import mean_pairwise_cosine, mean_pairwise_l1

    if metric == "cosine":
        return mean_pairwise_cosine(df, vector)
    if metric == "l1":
        return mean_pairwise_l1(df, vector)
    return mean_pair_distance(df, metric, vector=vector)
