"""Graphs, community steps and clusterings."""

from __future__ import annotations

from pyspark.sql import functions as F

from regatta.catalog.base import (
    FLEET,
    LONG,
    MEANS,
    TRADE,
    cluster_means,
    cosine_sql,
    fleet,
    l1_sql,
    query,
    rounded,
    trade_edges,
    trade_labels,
)
from regatta.functions import arrays as A
from regatta.operators import communities as C
from regatta.operators import graph as G
from regatta.operators import kmeans as KM
from regatta.operators import quality as Q
from regatta.operators import spectral as S
from regatta.operators.aggregate import to_long
from regatta.operators.common import cut_lineage
from regatta.operators.pairs import copy_members
from regatta.plans.clustering import cluster, cluster_report

# Cosine distance that keeps a pair in the fleet graph.
REACH = 0.7


def fleet_graph(spark, sf):
    return G.similarity_graph(fleet(spark, sf), "cosine", REACH)


def fleet_nodes(spark, sf):
    """All nodes of the fleet graph, those without an edge too."""
    return copy_members(fleet(spark, sf)).select(F.col("rep").alias("node")).distinct()


@query("k1_degrees", f"WITH {TRADE} SELECT node, round(k, 4) AS k FROM deg")
def _degrees(spark, sf):
    return rounded(G.degrees(trade_edges(spark, sf)), "k", digits=4)


@query("k1_total_weight", f"WITH {TRADE} SELECT round(two_m / 2, 4) AS m FROM tot")
def _total(spark, sf):
    return rounded(G.total_weight(trade_edges(spark, sf)), "m", digits=4)


@query("k2_similarity_graph", f"""WITH {FLEET},
d AS (SELECT a.entity AS a, b.entity AS b, 1 - {cosine_sql('a.vector', 'b.vector')} AS d
      FROM fleet a JOIN fleet b ON a.entity < b.entity),
s AS (SELECT avg(d) AS sigma FROM d),
reps AS (SELECT min(entity) AS entity, count(*) AS copies, vector FROM fleet GROUP BY vector),
w AS (SELECT d.a, d.b, x.copies * y.copies * exp(-d / sigma) AS w
      FROM d JOIN reps x ON x.entity = d.a JOIN reps y ON y.entity = d.b, s WHERE d <= {REACH})
SELECT a AS src, b AS dst, round(w, 6) AS w FROM w
UNION ALL SELECT b, a, round(w, 6) FROM w
UNION ALL SELECT entity, entity, (copies * (copies - 1))::DOUBLE FROM reps WHERE copies > 1""")
def _graph(spark, sf):
    return rounded(fleet_graph(spark, sf), "w")


@query("k2_nearest_neighbour_graph", f"""WITH {MEANS},
d AS (SELECT a.cluster::BIGINT AS src, b.cluster::BIGINT AS dst,
             1 - {cosine_sql('a.vector', 'b.vector')} AS d
      FROM means a JOIN means b ON a.cluster <> b.cluster),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS r FROM d),
p AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b, d FROM r WHERE r <= 3),
s AS (SELECT avg(d) AS sigma FROM d)
SELECT a AS src, b AS dst, round(exp(-d / sigma), 6) AS w FROM p, s
UNION SELECT b, a, round(exp(-d / sigma), 6) FROM p, s""")
def _knn(spark, sf):
    means = cluster_means(spark, sf).withColumnRenamed("cluster", "entity")
    return rounded(G.similarity_graph(means, "cosine", k=3), "w")


@query("k3_modularity", f"""WITH {TRADE}, inn AS (
  SELECT l.community, sum(e.w) AS inner_w FROM edges e JOIN labels l ON l.node = e.src
  JOIN labels m ON m.node = e.dst WHERE l.community = m.community GROUP BY ALL)
SELECT round(sum(coalesce(inner_w, 0) - tot * tot / two_m) / any_value(two_m), 8) AS q1,
       round(sum(coalesce(inner_w, 0) - 2 * tot * tot / two_m) / any_value(two_m), 8) AS q2
FROM csum LEFT JOIN inn USING (community), tot t(two_m)""")
def _modularity(spark, sf):
    q = G.modularity(trade_edges(spark, sf), trade_labels(spark, sf), [1.0, 2.0])
    return rounded(q, "q1", "q2", digits=8)


@query("k4_louvain_step", f"""WITH {TRADE}, g AS (
  SELECT k.src, o.community AS own, k.community AS target,
         round((k.w - 2.0 * d.k * (c.tot - CASE WHEN k.community = o.community THEN d.k ELSE 0 END)
                / two_m) / two_m, 12) AS gain
  FROM kin k JOIN labels o ON o.node = k.src JOIN deg d ON d.node = k.src
  JOIN csum c ON c.community = k.community, tot)
SELECT src, own, target, gain FROM (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY gain DESC, target) AS r FROM g WHERE gain > 0)
WHERE r = 1""")
def _louvain_step(spark, sf):
    return G.louvain_step(trade_edges(spark, sf), trade_labels(spark, sf))


@query("k7_leiden_local_move", f"""WITH {TRADE}, own AS (
  SELECT o.node AS src, o.community AS own, d.k, coalesce(k.w, 0) AS w_own, c.tot AS own_tot
  FROM labels o JOIN deg d ON d.node = o.node JOIN csum c ON c.community = o.community
  LEFT JOIN kin k ON k.src = o.node AND k.community = o.community),
g AS (
  SELECT o.src, o.own, k.community AS target,
         round((k.w - o.w_own) / (two_m / 2)
               - o.k * (c.tot - o.own_tot + o.k) / (2 * (two_m / 2) * (two_m / 2)), 12) AS gain
  FROM own o JOIN kin k ON k.src = o.src AND k.community <> o.own
  JOIN csum c ON c.community = k.community, tot)
SELECT src, own, target, gain FROM (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY gain DESC, target) AS r
  FROM g WHERE gain > 1e-10)
WHERE r = 1""")
def _leiden_step(spark, sf):
    return G.leiden_step(trade_edges(spark, sf), trade_labels(spark, sf))


@query("k6_strongest_neighbour_refine", """WITH half AS (
  SELECT o_custkey * 2 AS src, l_partkey * 2 + 1 AS dst, sum(l_quantity) AS w
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
labels AS (
  SELECT c_custkey * 2 AS node, c_nationkey::BIGINT AS community FROM customer
  UNION ALL SELECT p_partkey * 2 + 1, floor(p_size / 2)::BIGINT FROM part),
grouped AS (
  SELECT e.src, l.community, sum(e.w) AS w, max(struct_pack(w := e.w, least := -e.dst)) AS top
  FROM (SELECT src, dst, w FROM half UNION ALL SELECT dst, src, w FROM half) e
  JOIN labels l ON l.node = e.dst GROUP BY e.src, l.community),
chosen AS (SELECT src, arg_max(community, top) AS best, arg_max(w, top) AS there FROM grouped GROUP BY src),
own AS (
  SELECT l.node, l.community, coalesce(g.w, 0) AS here
  FROM labels l LEFT JOIN grouped g ON g.src = l.node AND g.community = l.community)
SELECT o.node, CASE WHEN c.best <> o.community AND c.there > o.here THEN c.best ELSE o.community END AS community
FROM own o LEFT JOIN chosen c ON c.src = o.node""")
def _refine(spark, sf):
    return G.strongest_neighbour_refine(trade_edges(spark, sf), trade_labels(spark, sf))


@query("k8_sparse_split", f"""WITH {TRADE}, inn AS (
  SELECT l.community, sum(k.w) AS inner_w FROM kin k JOIN labels l
    ON l.node = k.src AND l.community = k.community GROUP BY ALL),
size AS (SELECT community, count(*) AS n FROM labels GROUP BY ALL),
sparse AS (
  SELECT community FROM size LEFT JOIN inn USING (community)
  WHERE n > 2 AND coalesce(inner_w, 0) / (n * (n - 1)) < 0.1)
SELECT l.node, l.community + CASE WHEN s.community IS NOT NULL
    AND ('0x' || substr(md5(l.node::VARCHAR || ':split:0'), 1, 8))::BIGINT / 4294967296.0 > 0.5
  THEN (SELECT max(community) + 1 FROM labels) ELSE 0 END AS community
FROM labels l LEFT JOIN sparse s USING (community)""")
def _split(spark, sf):
    return G.split_sparse(trade_edges(spark, sf), trade_labels(spark, sf), 0)


@query("k24_label_normalization", f"""WITH {TRADE}, first AS (
  SELECT community, min(node) AS f FROM labels GROUP BY community)
SELECT l.node, (dense_rank() OVER (ORDER BY f.f) - 1)::INT AS cluster
FROM labels l JOIN first f USING (community)""")
def _normalise(spark, sf):
    return G.normalise_labels(trade_labels(spark, sf))


# Eight labellings of the fleet: which of its eight values is the largest, block by block.
RUNS = 8
BLOCK_LABELS = f"""WITH {LONG}, labels AS (
  SELECT entity AS node, r::INT AS run,
         list_position(vector[r * 8 + 1 : r * 8 + 8], list_max(vector[r * 8 + 1 : r * 8 + 8])) - 1
           AS community
  FROM fleet, range({RUNS}) t(r)),
pairs AS (
  SELECT a.node AS src, b.node AS dst, count(*)::INT AS count
  FROM labels a JOIN labels b ON a.run = b.run AND a.community = b.community AND a.node < b.node
  GROUP BY ALL HAVING count(*) >= {RUNS // 2})"""


def block_labels(spark, sf):
    rows = fleet(spark, sf).select(
        F.col("entity").alias("node"), F.posexplode(A.reshape(F.col("vector"), RUNS, 8))
        .alias("run", "part")
    )
    return rows.select("run", "node", A.argmax(F.col("part")).alias("community"))


@query("k12_agreement_table", f"""{BLOCK_LABELS}, sig AS (
  SELECT node, list(community ORDER BY run) AS s FROM labels GROUP BY node),
reps AS (SELECT min(node) AS node FROM sig GROUP BY s)
SELECT src, dst, count FROM pairs
WHERE src IN (SELECT node FROM reps) AND dst IN (SELECT node FROM reps)""")
def _agreement(spark, sf):
    return C.agreement(block_labels(spark, sf), RUNS, RUNS // 2)[0]


@query("k13_agreement_components", f"""{BLOCK_LABELS.replace('WITH fleet', 'WITH RECURSIVE fleet')},
links AS (SELECT src AS a, dst AS b FROM pairs UNION SELECT dst, src FROM pairs),
reach AS (
  SELECT entity AS node, entity AS root FROM fleet
  UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node)
SELECT node, min(root) AS component FROM reach GROUP BY node""")
def _components(spark, sf):
    return C.consensus_clusters(block_labels(spark, sf), RUNS, 0.5)


SEGMENT_LABELS = f"""{FLEET}, part AS (
  SELECT entity, ((list_position(vector, list_max(vector)) - 1) % 4)::INT AS cluster, vector FROM fleet)"""


def segmented(spark, sf):
    return fleet(spark, sf).select(
        "entity", (A.argmax(F.col("vector")) % 4).alias("cluster"), "vector"
    )


def _silhouette_sql(d: str, table: str) -> str:
    return f"""d AS (
  SELECT a.entity, a.cluster, b.cluster AS other, {d} AS d
  FROM {table} a JOIN {table} b ON a.entity <> b.entity),
m AS (SELECT entity, cluster, other, avg(d) AS d FROM d GROUP BY ALL),
ab AS (
  SELECT p.entity, p.cluster, coalesce(max(m.d) FILTER (m.other = p.cluster), 0) AS a,
         min(m.d) FILTER (m.other <> p.cluster) AS b
  FROM {table} p LEFT JOIN m ON m.entity = p.entity GROUP BY ALL),
s AS (
  SELECT cluster, CASE WHEN greatest(a, coalesce(b, a)) > 0
    THEN (coalesce(b, a) - a) / greatest(a, coalesce(b, a)) ELSE 0 END AS s FROM ab)
SELECT cluster, round(avg(s), 6) AS silhouette FROM s GROUP BY cluster"""


@query("k23_silhouette_cosine", f"""WITH {SEGMENT_LABELS},
{_silhouette_sql('1 - ' + cosine_sql('a.vector', 'b.vector'), 'part')}""")
def _silhouette(spark, sf):
    return rounded(Q.silhouette(segmented(spark, sf), "cosine"), "silhouette")


@query("k23_silhouette_l1", f"""WITH {SEGMENT_LABELS},
{_silhouette_sql(l1_sql('a.vector', 'b.vector'), 'part')}""")
def _silhouette_l1(spark, sf):
    return rounded(Q.silhouette(segmented(spark, sf), "l1"), "silhouette")


@query("k23_silhouette_of_fleet", f"""WITH {MEANS}, part AS (
  SELECT cluster AS entity, cluster % 3 AS cluster, vector FROM means),
{_silhouette_sql('list_distance(a.vector, b.vector)', 'part')}""")
def _silhouette_l2(spark, sf):
    from regatta.operators.pairs import pair_distances

    means = cut_lineage(cluster_means(spark, sf).select(
        F.col("cluster").cast("long").alias("entity"), "vector"
    ))
    part = means.select("entity", (F.col("entity") % 3).cast("int").alias("cluster"))
    return rounded(
        Q.silhouette_from_distances(pair_distances(means, "l2", all_pairs=True), part), "silhouette"
    )


@query("k16_lloyd_step", f"""WITH {MEANS}, near AS (
  SELECT f.entity, m.cluster AS centre,
         row_number() OVER (PARTITION BY f.entity
           ORDER BY round(1 - {cosine_sql('f.vector', 'm.vector')}, 12), m.cluster) AS r
  FROM fleet f, means m)
SELECT n.centre AS cluster, l.idx, round(avg(l.val), 6) AS val
FROM near n JOIN long l USING (entity) WHERE r = 1 GROUP BY ALL""")
def _lloyd(spark, sf):
    import numpy as np

    rows = cluster_means(spark, sf).orderBy("cluster").collect()
    centres = np.array([r["vector"] for r in rows])
    return rounded(KM.lloyd_step(fleet(spark, sf), centres, "cosine"), "val")


@query("k17_elbow", """WITH inertia AS (
  SELECT label + 1 AS k, (SELECT count(*) FROM embeddings b WHERE b.label >= a.label)
         * 100.0::DOUBLE / (label + 1) AS inertia
  FROM (SELECT DISTINCT label FROM embeddings) a),
g AS (SELECT k, lag(inertia) OVER (ORDER BY k) - 2 * inertia + lead(inertia) OVER (ORDER BY k) AS gap
      FROM inertia)
SELECT k::INT AS k FROM g WHERE gap > 0 ORDER BY gap DESC, k LIMIT 1""")
def _elbow(spark, sf):
    from pyspark.sql import Window as W

    per = fleet(spark, sf).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    above = W.orderBy(F.desc("cluster")).rowsBetween(W.unboundedPreceding, 0)
    table = per.select(
        (F.col("cluster") + 1).alias("k"),
        (F.sum("n").over(above) * 100.0 / (F.col("cluster") + 1)).alias("inertia"),
    )
    return KM.elbow(table)


@query("k18_normalized_laplacian", f"""WITH {TRADE}
SELECT e.src, e.dst, round(-e.w / (sqrt(a.k) * sqrt(b.k)), 8) AS value
FROM edges e JOIN deg a ON a.node = e.src JOIN deg b ON b.node = e.dst
UNION ALL SELECT node, node, 1.0::DOUBLE FROM deg""")
def _laplacian(spark, sf):
    return rounded(S.normalised_laplacian(trade_edges(spark, sf)), "value", digits=8)


def _partition_summary(labels):
    sizes = labels.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("communities"))


@query("k5_louvain_partition")
def _louvain(spark, sf):
    return _partition_summary(C.louvain(trade_edges(spark, sf)))


@query("k9_leiden_partition")
def _leiden(spark, sf):
    return _partition_summary(C.leiden(fleet_graph(spark, sf), nodes=fleet_nodes(spark, sf)))


@query("k10_louvain_with_resolution")
def _louvain_resolution(spark, sf):
    return _partition_summary(C.louvain(fleet_graph(spark, sf), resolution=0.5, nodes=fleet_nodes(spark, sf)))


@query("k11_resolution_sweep")
def _sweep(spark, sf):
    labels = C.louvain_runs(fleet_graph(spark, sf), C.sweep_resolutions())
    labels = C.with_isolated(cut_lineage(labels), fleet_nodes(spark, sf))
    return labels.groupBy("run").agg(F.countDistinct("community").alias("communities"))


@query("k14_consensus_clustering")
def _consensus(spark, sf):
    return _partition_summary(C.consensus(fleet_graph(spark, sf), "louvain", nodes=fleet_nodes(spark, sf)))


@query("k15_distance_squared_seeding")
def _seeding(spark, sf):
    centres = KM.spread_seeds(fleet(spark, sf), 4, "cosine", 42)
    near = KM.nearest_centre(fleet(spark, sf), centres, "cosine")
    return near.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("size"), F.round(F.avg("distance"), 6).alias("distance")
    )


@query("k16_kmeans")
def _kmeans(spark, sf):
    centres = KM.fit_centres(fleet(spark, sf), 5, "cosine", 100, 42)
    near = KM.nearest_centre(fleet(spark, sf), centres, "cosine")
    return near.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("size"), F.round(F.avg("distance"), 6).alias("distance")
    )


@query("k17_inertia_table")
def _inertia(spark, sf):
    return rounded(KM.inertia_table(fleet(spark, sf), "cosine", 5, 42), "inertia")


@query("k19_smallest_eigenvectors")
def _eigen(spark, sf):
    _, vectors, residual = S.eigenvectors_and_residual(fleet_graph(spark, sf), 3)
    vectors = cut_lineage(vectors)
    # The Laplacian row of a node without an edge is zero, and so is its part of these vectors.
    alone = fleet_nodes(spark, sf).join(vectors.select("node"), "node", "left_anti")
    zeros = F.array_repeat(F.lit(0.0), 3)
    found = to_long(vectors.unionByName(alone.select("node", zeros.alias("x"))), ["node"], "x")
    return rounded(found, "val", digits=4).withColumn("settled", F.lit(residual < S.TOLERANCE))


@query("k20_eigengap_k")
def _gap(spark, sf):
    # A node without an edge adds an eigenvalue of zero and a cluster of its own; k counts the others.
    k, linked, residual = S.cluster_count(fleet_graph(spark, sf))
    return fleet_nodes(spark, sf).agg(F.count(F.lit(1)).alias("nodes")).select(
        "nodes", (F.col("nodes") - linked).alias("isolated"), F.lit(k).alias("k"),
        F.lit(residual < S.TOLERANCE).alias("settled"),
    )


@query("k21_spectral_clustering")
def _spectral(spark, sf):
    return _partition_summary(S.spectral(fleet_graph(spark, sf), 3, nodes=fleet_nodes(spark, sf)))


def _report(spark, sf, **options):
    from regatta.catalog.base import DIM

    rows = fleet(spark, sf)
    part = cluster(rows, max_distance=REACH, dim=DIM, **options)
    report = cluster_report(rows, cut_lineage(part))
    return rounded(report, "weight", "mean_length", "silhouette")


@query("k22_cluster_fleet_louvain")
def _fleet_louvain(spark, sf):
    return _report(spark, sf, method="louvain")


@query("k22_cluster_fleet_kmeans")
def _fleet_kmeans(spark, sf):
    return _report(spark, sf, method="kmeans", k=4)


__all__ = ["block_labels", "fleet_graph", "segmented"]
