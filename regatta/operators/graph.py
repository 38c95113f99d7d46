"""Similarity graphs, modularity and single community steps over edge tables.

Edges are ``(src, dst, w)`` with both directions present. A self edge ``(i, i, w)`` appears once
and counts in the degree of ``i``; it stands for the links among copies collapsed into ``i``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regatta.functions.hashing import hash_uniform
from regatta.operators.common import counted_join, cut_lineage, spread_join, value_rank
from regatta.operators.pairs import (
    collapse_copies,
    mean_pairwise,
    nearest_neighbours,
    pair_distances,
)

# Default resolution, the smallest gain a Leiden move needs, and the mean internal
# weight under which a community is split.
LOUVAIN_RESOLUTION = 2.0
LEIDEN_MIN_GAIN = 1e-10
SPARSE_WEIGHT = 0.1
# Gains closer than this many decimals are ties; the smaller label wins.
GAIN_DECIMALS = 12
# Values of a table over all nodes that may be broadcast in a loop, its keys counted as four values each.
BROADCAST_CELLS = 1 << 22


def both_directions(pairs: DataFrame) -> DataFrame:
    """Every row as it is and with its ends exchanged; the rows are made once."""
    rest = [c for c in pairs.columns if c not in ("src", "dst")]
    ways = [F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), *rest) for a, b in (("src", "dst"), ("dst", "src"))]
    return pairs.select(F.inline(F.array(*ways))).select(*pairs.columns)


def kernel_weights(pairs: DataFrame, sigma: Column) -> DataFrame:
    """``(src, dst, w)`` with ``w = exp(-d / sigma)``."""
    return pairs.select("src", "dst", F.exp(-F.col("d") / sigma).alias("w"))


def similarity_graph(
    df: DataFrame,
    metric: str = "cosine",
    max_distance: float | None = None,
    k: int | None = None,
    sigma: float | None = None,
    entity: str = "entity",
    vector: str = "vector",
    all_pairs: bool = False,
) -> DataFrame:
    """Exponential-kernel graph, both directions.

    ``max_distance`` keeps all pairs inside the bound, ``k`` each entity's nearest (made
    symmetric), ``all_pairs`` the full graph, quadratic in the fleet. Copies of one vector become a node with a
    self edge, and the weight of an edge between two such nodes is that of all their links.
    """
    nodes = cut_lineage(collapse_copies(df, entity, vector))
    width = F.lit(sigma) if sigma is not None else mean_pairwise(
        df.select(F.col(entity).alias("entity"), F.col(vector).alias("vector")), metric
    ).scalar()
    if k is not None:
        near = nearest_neighbours(nodes, k, metric)
        pairs = near.select(
            F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "d"
        ).groupBy("src", "dst").agg(F.min("d").alias("d"))
    else:
        pairs = pair_distances(nodes, metric, max_distance, all_pairs=all_pairs)
    weighted = kernel_weights(pairs, width)
    crowds = nodes.filter(F.col("copies") > 1).select("entity", "copies")
    if not crowds.isEmpty():
        for end in ("src", "dst"):
            size = crowds.select(F.col("entity").alias(end), "copies")
            weighted = counted_join(weighted, size, [end], ["src", "dst"], "left").select(
                "src", "dst", (F.col("w") * F.coalesce("copies", F.lit(1))).alias("w")
            )
    own = crowds.select(
        F.col("entity").alias("src"), F.col("entity").alias("dst"),
        (F.col("copies") * (F.col("copies") - 1)).cast("double").alias("w"),
    )
    return both_directions(weighted).unionByName(own)


class LaidEdges:
    """Edges laid out once for a loop whose passes bring one row per node to the edges.

    Where these rows may be broadcast (``cells`` values each), the edges lie by ``src``: a sum over the
    edges of a node moves nothing. Else they lie by ``dst``, where the rows come to them, and only what
    the edges carry on moves.
    """

    def __init__(self, edges: DataFrame, nodes: int, cells: int) -> None:
        self.small = nodes * (cells + 4) <= BROADCAST_CELLS
        self.parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.rows = edges.repartition(self.parts, "src" if self.small else "dst").persist(
            StorageLevel.MEMORY_AND_DISK
        )
        self.rows.count()

    def met(self, at: DataFrame) -> DataFrame:
        """Edges with the row of their ``dst``."""
        return self.rows.join(self._right(at), "dst")

    def by_source(self, met: DataFrame) -> DataFrame:
        """The same rows, all those of a ``src`` in one partition."""
        return met if self.small else met.repartition(self.parts, "src")

    def beside(self, rows: DataFrame, own: DataFrame) -> DataFrame:
        """Rows that lie by ``src`` with the row of that node."""
        return rows.join(self._right(own), "src")

    def _right(self, table: DataFrame) -> DataFrame:
        return F.broadcast(table) if self.small else table.hint("merge")

    def __enter__(self) -> LaidEdges:
        return self

    def __exit__(self, *_) -> None:
        self.rows.unpersist()


def degrees(edges: DataFrame) -> DataFrame:
    """``(node, k)``: weighted degree of every node with an edge."""
    return edges.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k"))


def total_weight(edges: DataFrame) -> DataFrame:
    """``m``: each undirected edge once."""
    return edges.agg((F.sum("w") / 2).alias("m"))


def community_links(
    edges: DataFrame, labels: DataFrame, keys: tuple[str, ...] = ()
) -> DataFrame:
    """``(keys..., src, community, w, self_w)``: what each node sends into each community.

    Small label tables are broadcast; else a hub's label is salted over many tasks. The links are
    summed before the next shuffle.
    """
    at = labels.select(*keys, F.col("node").alias("dst"), "community")
    own = F.col("src") == F.col("dst")
    return counted_join(edges, at, ["dst"], ["src"]).groupBy(*keys, "src", "community").agg(
        F.sum(F.when(~own, F.col("w")).otherwise(0.0)).alias("w"),
        F.sum(F.when(own, F.col("w")).otherwise(0.0)).alias("self_w"),
    )


def with_own(links: DataFrame, labels: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Links with the ``own`` community of the node they leave from."""
    own = labels.select(*keys, F.col("node").alias("src"), F.col("community").alias("own"))
    return counted_join(links, own, [*keys, "src"])


def community_sums(links_own: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``(keys..., community, inner, tot)`` over ordered pairs, from node-to-community links."""
    inside = F.col("community") == F.col("own")
    return links_own.groupBy(*keys, F.col("own").alias("community")).agg(
        F.sum(F.when(inside, F.col("w") + F.col("self_w")).otherwise(0.0)).alias("inner"),
        F.sum(F.col("w") + F.col("self_w")).alias("tot"),
    )


def modularity(
    edges: DataFrame, labels: DataFrame, resolution: float | Sequence[float] = 1.0
) -> DataFrame:
    """``q`` of a labelling (``q1``, ``q2``, ... for several resolutions); 0 without any weight.

    Grouped sums only, no pair of nodes.
    """
    sums = community_sums(with_own(community_links(edges, labels), labels))
    two_m = F.sum("tot")

    def q(gamma: float) -> Column:
        value = (F.sum("inner") - gamma * F.sum(F.col("tot") * F.col("tot")) / two_m) / two_m
        return F.when(two_m > 0, value).otherwise(F.lit(0.0))

    if isinstance(resolution, (int, float)):
        return sums.agg(q(resolution).alias("q"))
    return sums.agg(*[q(g).alias(f"q{i}") for i, g in enumerate(resolution, 1)])


def _per_node(links_own: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    inside = F.col("community") == F.col("own")
    return links_own.groupBy(*keys, "src", "own").agg(
        F.sum(F.col("w") + F.col("self_w")).alias("k"),
        F.sum(F.when(inside, F.col("w")).otherwise(0.0)).alias("w_own"),
        F.sum("self_w").alias("loop"),
    )


def node_sums(links_own: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``(keys..., node, k, inner)``: degree of every node and what of it stays in its community."""
    return _per_node(links_own, keys).select(
        *keys, F.col("src").alias("node"), "k", (F.col("w_own") + F.col("loop")).alias("inner")
    )


def owned_links(
    edges: DataFrame, labels: DataFrame, keys: tuple[str, ...] = ()
) -> DataFrame:
    """Node-to-community links with the node's own community, written out.

    A step reads them several times; the table spares it the join over all edges each time.
    """
    return cut_lineage(with_own(community_links(edges, labels, keys), labels, keys))


def move_gains(
    links_own: DataFrame,
    two_m: Column,
    resolution: Column | float = LOUVAIN_RESOLUTION,
    rule: str = "louvain",
    keys: tuple[str, ...] = (),
) -> DataFrame:
    """``(keys..., src, own, target, gain)``: every move open to every node.

    ``louvain`` measures a community, the own one included, with the node taken out of it.
    ``leiden`` measures the change against staying.
    """
    gamma = resolution if isinstance(resolution, Column) else F.lit(float(resolution))
    per_node = _per_node(links_own, keys)
    totals = per_node.groupBy(*keys, F.col("own").alias("community")).agg(F.sum("k").alias("tot"))
    own_tot = totals.select(*keys, F.col("community").alias("own"), F.col("tot").alias("own_tot"))
    nodes = spread_join(per_node, own_tot, [*keys, "own"], ["src"])
    targets = links_own.filter(F.col("w") > 0).select(
        *keys, "src", F.col("community").alias("target"), F.col("w").alias("w_in")
    )
    totals_of = totals.select(
        *keys, F.col("community").alias("target"), F.col("tot").alias("target_tot")
    )
    reach = spread_join(targets, totals_of, [*keys, "target"], ["src"]).join(nodes, [*keys, "src"])
    stays = F.col("target") == F.col("own")
    k = F.col("k")
    if rule == "louvain":
        rest = F.col("target_tot") - F.when(stays, k).otherwise(0.0)
        gain = (F.col("w_in") - gamma * k * rest / two_m) / two_m
    elif rule == "leiden":
        m = two_m / 2
        reach = reach.filter(~stays)
        gain = (F.col("w_in") - F.col("w_own")) / m - gamma * k * (
            F.col("target_tot") - F.col("own_tot") + k
        ) / (2 * m * m)
    else:
        raise ValueError(f"unknown rule {rule!r}")
    return reach.select(
        *keys, "src", "own", "target", F.round(gain, GAIN_DECIMALS).alias("gain")
    )


def all_gains(
    edges: DataFrame, labels: DataFrame, resolution: float = LOUVAIN_RESOLUTION,
    rule: str = "louvain",
) -> DataFrame:
    """``move_gains`` of one labelling."""
    links = owned_links(edges, labels)
    two_m = links.agg(F.sum(F.col("w") + F.col("self_w"))).scalar()
    return move_gains(links, two_m, resolution, rule)


def best_moves(gains: DataFrame, least: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """``(keys..., src, own, target, gain)``: best gain above ``least``, ties to the small label."""
    pick = F.max(F.struct("gain", (-F.col("target")).alias("_neg")))
    return (
        gains.filter(F.col("gain") > least)
        .groupBy(*keys, "src", "own")
        .agg(pick.alias("_b"))
        .select(*keys, "src", "own", (-F.col("_b._neg")).alias("target"), F.col("_b.gain"))
    )


def louvain_step(
    edges: DataFrame, labels: DataFrame, resolution: float = LOUVAIN_RESOLUTION
) -> DataFrame:
    """Preferred community of every node in one synchronous step."""
    return best_moves(all_gains(edges, labels, resolution, "louvain"), 0.0)


def leiden_step(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    return best_moves(all_gains(edges, labels, resolution, "leiden"), LEIDEN_MIN_GAIN)


def strongest_neighbour_refine(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``(node, community)`` after one synchronous step towards the strongest neighbour.

    A node follows its heaviest edge (smallest neighbour on ties) when its links into that
    community outweigh those into its own.
    """
    at = labels.select(F.col("node").alias("dst"), "community")
    outer = edges.filter((F.col("src") != F.col("dst")) & (F.col("w") > 0))
    joined = counted_join(outer, at, ["dst"], ["src"])
    strongest = joined.groupBy("src").agg(
        F.max(F.struct("w", (-F.col("dst")).alias("_neg"), "community"))["community"].alias("best")
    )
    sums = joined.groupBy("src", "community").agg(F.sum("w").alias("s"))
    own = labels.select(F.col("node").alias("src"), F.col("community").alias("own"))
    weights = (
        counted_join(sums.join(strongest, "src"), own, ["src"])
        .groupBy("src", "best", "own")
        .agg(
            F.sum(F.when(F.col("community") == F.col("best"), F.col("s"))).alias("there"),
            F.coalesce(
                F.sum(F.when(F.col("community") == F.col("own"), F.col("s"))), F.lit(0.0)
            ).alias("here"),
        )
    )
    moves = weights.filter(
        (F.col("best") != F.col("own")) & (F.round("there", 12) > F.round("here", 12))
    )
    towards = moves.select(F.col("src").alias("node"), "best").hint("merge")
    return labels.join(towards, "node", "left").select(
        "node", F.coalesce("best", "community").alias("community")
    )


def split_sparse(
    edges: DataFrame, labels: DataFrame, seed: int | str = 0, keys: tuple[str, ...] = ()
) -> DataFrame:
    """Split communities of over two nodes and mean internal weight under 0.1 by a fair coin.

    The half that leaves takes the old label plus one more than the largest label.
    """
    links = with_own(community_links(edges, labels, keys), labels, keys)
    return split_by_inner(labels, community_sums(links, keys), seed, keys)


def split_by_inner(
    labels: DataFrame, sums: DataFrame, seed: int | str = 0, keys: tuple[str, ...] = ()
) -> DataFrame:
    """``split_sparse`` from the ``inner`` weight of every community."""
    inner = sums.select(*keys, "community", "inner")
    sizes = labels.groupBy(*keys, "community").agg(F.count(F.lit(1)).alias("n"))
    pairs = F.col("n") * (F.col("n") - 1)
    sparse = (
        sizes.join(inner, [*keys, "community"], "left")
        .filter((F.col("n") > 2) & (F.coalesce("inner", F.lit(0.0)) / pairs < SPARSE_WEIGHT))
        .select(*keys, "community", F.lit(True).alias("_split"))
    )
    offset = labels.agg(F.max("community") + 1).scalar()
    coin = hash_uniform(F.col("node"), f"split:{seed}") > 0.5
    return spread_join(labels, sparse, [*keys, "community"], ["node"], "left").select(
        *keys, "node",
        F.when(F.col("_split") & coin, F.col("community") + offset)
        .otherwise(F.col("community"))
        .alias("community"),
    )


def normalise_labels(labels: DataFrame) -> DataFrame:
    """Contiguous labels from 0, in the order communities first appear by node."""
    first = labels.groupBy("community").agg(F.min("node").alias("_first"))
    ranked = value_rank(first, [], "_first", rank="_rank")
    names = ranked.select("community", (F.col("_rank") - 1).cast("int").alias("cluster"))
    return spread_join(labels, names, ["community"], ["node"]).select("node", "cluster")


def connected_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``(node, component)``: smallest node id reachable over the edges.

    Each round takes the smallest label among the neighbours, then jumps to the label's own label,
    so long chains shrink geometrically; every round is written out.
    """
    links = cut_lineage(both_directions(edges.select("src", "dst")).distinct())
    labels = cut_lineage(nodes.select("node", F.col("node").alias("component")).distinct())
    for _ in range(max_rounds):
        near = spread_join(
            links, labels.select(F.col("node").alias("dst"), "component"), ["dst"], ["src"]
        ).groupBy(F.col("src").alias("node")).agg(F.min("component").alias("_near"))
        hooked = labels.join(near, "node", "left").select(
            "node", F.col("component").alias("_old"),
            F.least("component", F.coalesce("_near", "component")).alias("component"),
        )
        target = hooked.select(
            F.col("node").alias("component"), F.col("component").alias("_jump")
        )
        labels = cut_lineage(
            spread_join(hooked, target, ["component"], ["node"], "left").select(
                "node", "_old", F.least("component", F.coalesce("_jump", "component"))
                .alias("component"),
            )
        )
        if labels.filter(F.col("_old") != F.col("component")).isEmpty():
            return labels.select("node", "component")
        labels = labels.select("node", "component")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
