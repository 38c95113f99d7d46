"""Vector aggregates, distances and mixing."""

from __future__ import annotations

from pyspark.sql import functions as F

from regatta.catalog.base import (
    DIM,
    DISTANCE_SQL,
    FLEET,
    LONG,
    MEANS,
    cluster_means,
    cosine_sql,
    fleet,
    l1_sql,
    l2_sql,
    query,
    read,
    rounded,
)
from regatta.functions import arrays as A
from regatta.operators import aggregate as agg
from regatta.operators import assign, buckets, pairs

WEIGHTED = "sum(val * weight) / sum(weight)"


def _grouped_sql(expr: str) -> str:
    return f"WITH {LONG} SELECT cluster, idx, round({expr}, 6) AS val FROM long GROUP BY cluster, idx"


for _name, _how, _sql in [
    ("a1_weighted_vector_mean", "fedavg", WEIGHTED),
    ("a2_proximal_vector_mean", "fedprox", WEIGHTED),
    ("a3_simple_vector_mean", "simple", "avg(val)"),
    ("a4_vector_median", "median", "median(val)"),
]:
    @query(_name, _grouped_sql(_sql))
    def _run(spark, sf, how=_how):
        return rounded(agg.vector_aggregate(fleet(spark, sf), ["cluster"], how), "val")


LINE_PARTS = ["l_extendedprice", "l_discount", "l_tax"]
LINE_LONG = """WITH long AS (
  SELECT l_suppkey, l_quantity AS w, unnest([l_extendedprice, l_discount, l_tax]) AS val,
         unnest([0, 1, 2])::INT AS idx FROM lineitem)"""


@query("a1_weighted_vector_mean_lineitem", f"""{LINE_LONG}
SELECT l_suppkey, idx, round(sum(val * w) / sum(w), 4) AS val FROM long GROUP BY l_suppkey, idx""")
def _weighted_lines(spark, sf):
    lines = read(spark, sf, "lineitem")
    out = agg.scalar_vector_aggregate(lines, ["l_suppkey"], LINE_PARTS, "fedavg", "l_quantity")
    return rounded(out, "val", digits=4)


@query("a4_vector_median_lineitem", f"""{LINE_LONG}
SELECT l_suppkey, idx, round(median(val), 4) AS val FROM long GROUP BY l_suppkey, idx""")
def _median_lines(spark, sf):
    lines = read(spark, sf, "lineitem").select("l_suppkey", F.array(*LINE_PARTS).alias("vector"))
    return rounded(agg.vector_median(lines, ["l_suppkey"]), "val", digits=4)


@query("a4_median_of_all_lines", f"""{LINE_LONG}
SELECT idx, round(median(val), 4) AS val FROM long GROUP BY idx""")
def _median_all(spark, sf):
    """One group of all rows, refined until what is left of it fits a small task."""
    lines = read(spark, sf, "lineitem").select(F.array(*LINE_PARTS).alias("vector"))
    return rounded(agg.long_median(agg.to_long(lines, []), [], 1024), "val", digits=4)


@query("a5_cluster_weighted_mean", f"""WITH {LONG}, top AS (
  SELECT entity, (list_position(vector, list_max(vector)) - 1)::INT % 4 AS part FROM fleet)
SELECT part, idx, round({WEIGHTED}, 6) AS val, 1 AS version
FROM long JOIN top USING (entity) GROUP BY part, idx""")
def _cluster_means(spark, sf):
    part = (A.argmax(F.col("vector")) % 4).alias("part")
    rows = fleet(spark, sf).select(part, "vector", "weight")
    out = agg.vector_aggregate(rows, ["part"], "fedavg")
    return rounded(out, "val").withColumn("version", agg.version_bump(F.lit(0)))


SEGMENTS = [("W1", 0, 32), ("b1", 32, 40), ("W2", 40, 60), ("b2", 60, 64)]


def _segment_sql() -> str:
    cols = []
    for name, start, stop in SEGMENTS:
        inside = f"FILTER (idx >= {start} AND idx < {stop})"
        cols += [f"round(avg(val) {inside}, 6) AS {name}_mean",
                 f"round(stddev_pop(val) {inside}, 6) AS {name}_std"]
    return f"WITH {LONG} SELECT entity, {', '.join(cols)} FROM long GROUP BY entity"


@query("a12_segment_statistics", _segment_sql())
def _segments(spark, sf):
    stats = A.segment_stats(F.col("vector"), SEGMENTS)
    out = fleet(spark, sf).select("entity", *stats)
    return rounded(out, *[c for c in out.columns if c != "entity"])


def _sigma_sql(metric: str) -> str:
    d = DISTANCE_SQL[metric]("a.vector", "b.vector")
    return f"""WITH {FLEET} SELECT round(avg({d}), 6) AS sigma
FROM fleet a JOIN fleet b ON a.entity < b.entity"""


@query("a17_mean_pairwise_cosine", _sigma_sql("cosine"))
def _sigma_cosine(spark, sf):
    return rounded(agg.mean_pairwise_cosine(fleet(spark, sf)), "sigma")


@query("a17_mean_pairwise_l1", _sigma_sql("l1"))
def _sigma_l1(spark, sf):
    return rounded(agg.mean_pairwise_l1(fleet(spark, sf)), "sigma")


@query("p1_flatten_model", f"""WITH {LONG}
SELECT entity, idx, round(val, 6) AS val FROM long""")
def _flatten(spark, sf):
    v = F.col("vector")
    model = fleet(spark, sf).select(
        "entity", A.reshape(v, 6, 10).alias("layers"), F.slice(v, 61, 4).alias("bias")
    )
    flat = model.select("entity", A.flatten_model(F.col("layers"), F.col("bias")).alias("vector"))
    return rounded(agg.to_long(flat, ["entity"]), "val")


@query("p2_unflatten_model", f"""WITH {LONG}
SELECT entity,
       CASE WHEN idx < 30 THEN 'W1' WHEN idx < 36 THEN 'b1' WHEN idx < 60 THEN 'W2' ELSE 'b2' END AS part,
       (CASE WHEN idx < 30 THEN idx // 6 WHEN idx < 36 THEN 0 WHEN idx < 60 THEN (idx - 36) // 4
             ELSE 0 END)::INT AS row_no,
       (CASE WHEN idx < 30 THEN idx % 6 WHEN idx < 36 THEN idx - 30 WHEN idx < 60 THEN (idx - 36) % 4
             ELSE idx - 60 END)::INT AS col_no,
       round(val, 6) AS val
FROM long""")
def _unflatten(spark, sf):
    parts = fleet(spark, sf).select(
        "entity", A.unflatten_parts(F.col("vector"), 5, 6, 4).alias("m")
    )
    tables = []
    for name in ("W1", "b1", "W2", "b2"):
        grid = F.col(f"m.{name}") if name[0] == "W" else F.array(F.col(f"m.{name}"))
        tables.append(
            parts.select("entity", F.lit(name).alias("part"), F.posexplode(grid).alias("row_no", "r"))
            .select("entity", "part", "row_no", F.posexplode("r").alias("col_no", "val"))
        )
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return rounded(out, "val")


@query("p3_shape_validation", f"""WITH {FLEET}, odd AS (
  SELECT entity, CASE WHEN cluster = 3 THEN NULL
                      WHEN cluster = 5 THEN vector[1:63]
                      WHEN cluster = 7 THEN list_concat(vector[1:63], [NULL::DOUBLE])
                      ELSE vector END AS vector, cluster FROM fleet)
SELECT entity, cluster NOT IN (3, 5, 7) AS accepted FROM odd""")
def _shapes(spark, sf):
    v = F.col("vector")
    odd = fleet(spark, sf).withColumn(
        "vector",
        F.when(F.col("cluster") == 3, F.lit(None)).when(F.col("cluster") == 5, F.slice(v, 1, 63))
        .when(F.col("cluster") == 7, F.concat(F.slice(v, 1, 63), F.array(F.lit(None).cast("double"))))
        .otherwise(v),
    )
    return odd.select("entity", A.is_well_formed(F.col("vector"), DIM).alias("accepted"))


@query("p10_one_hot", """SELECT vec_id AS entity, i::INT AS idx,
  CASE WHEN i = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS val
FROM embeddings, range(10) t(i)""")
def _one_hot(spark, sf):
    rows = fleet(spark, sf).select("entity", A.one_hot(F.col("cluster"), 10).alias("vector"))
    return agg.to_long(rows, ["entity"])


CONSECUTIVE = f"""WITH {FLEET}, two AS (
  SELECT a.entity, a.vector AS x, b.vector AS y FROM fleet a JOIN fleet b ON b.entity = a.entity + 1)"""


def _consecutive(spark, sf):
    rows = fleet(spark, sf).select("entity", F.col("vector").alias("x"))
    after = rows.select((F.col("entity") - 1).alias("entity"), F.col("x").alias("y"))
    return rows.join(after, "entity")


for _name, _metric in [("v1_l1_distance", "l1"), ("v2_l2_distance", "l2"),
                       ("v3_cosine_distance", "cosine")]:
    @query(_name, f"{CONSECUTIVE} SELECT entity, round({DISTANCE_SQL[_metric]('x', 'y')}, 6) AS d FROM two")
    def _dist(spark, sf, metric=_metric):
        d = A.distance(metric, F.col("x"), F.col("y"))
        return _consecutive(spark, sf).select("entity", F.round(d, 6).alias("d"))


@query("v10_vector_arithmetic", f"""{CONSECUTIVE}
SELECT entity, round(list_sum(list_transform(list_zip(x, y), lambda p: p[1] + p[2])), 6) AS total,
       round(list_sum(list_transform(list_zip(x, y), lambda p: p[1] - p[2])), 6) AS gap,
       round(sqrt(list_dot_product(x, x)), 6) AS length FROM two""")
def _arithmetic(spark, sf):
    x, y = F.col("x"), F.col("y")
    return _consecutive(spark, sf).select(
        "entity", F.round(A.array_sum(A.add(x, y)), 6).alias("total"),
        F.round(A.array_sum(A.subtract(x, y)), 6).alias("gap"), F.round(A.norm(x), 6).alias("length"),
    )


@query("v9_update_norm", f"""{CONSECUTIVE}
SELECT entity + 1 AS entity, round({l2_sql('x', 'y')}, 6) AS norm FROM two WHERE entity % 10 <> 9""")
def _update_norm(spark, sf):
    from regatta.operators.history import update_norms

    versions = fleet(spark, sf).select(
        F.floor(F.col("entity") / 10).alias("owner"), F.col("entity").alias("round"), "vector"
    )
    out = update_norms(versions, ["owner"]).filter(F.col("norm").isNotNull())
    return out.select(F.col("round").alias("entity"), F.round("norm", 6).alias("norm"))


def _as_fleet(means):
    return means.withColumnRenamed("cluster", "entity")


def _dense_sql(metric: str) -> str:
    return f"""WITH {MEANS} SELECT a.cluster::BIGINT AS src, b.cluster::BIGINT AS dst,
  round({DISTANCE_SQL[metric]('a.vector', 'b.vector')}, 6) AS d
FROM means a JOIN means b ON a.cluster < b.cluster"""


for _metric in ("l1", "l2", "cosine"):
    @query(f"v4_fleet_distances_{_metric}", _dense_sql(_metric))
    def _dense(spark, sf, metric=_metric):
        return rounded(pairs.pair_distances(_as_fleet(cluster_means(spark, sf)), metric, all_pairs=True), "d")


def _bounded_sql(metric: str, bound: float) -> str:
    d = DISTANCE_SQL[metric]("a.vector", "b.vector")
    return f"""WITH {FLEET}, reps AS (SELECT min(entity) AS entity, vector FROM fleet GROUP BY vector)
SELECT a.entity AS src, b.entity AS dst, round({d}, 6) AS d
FROM reps a JOIN reps b ON a.entity < b.entity WHERE {d} <= {bound}"""


for _metric, _bound in [("cosine", 0.7), ("l2", 1.2), ("l1", 7.5)]:
    @query(f"j4_pairs_within_{_metric}", _bounded_sql(_metric, _bound))
    def _bounded(spark, sf, metric=_metric, bound=_bound):
        reps = pairs.collapse_copies(fleet(spark, sf))
        return rounded(pairs.pair_distances(reps, metric, bound), "d")


@query("v5_distance_to_reference", f"""WITH {MEANS}, overall AS (
  SELECT list(val ORDER BY idx) AS r FROM (SELECT idx, avg(val) AS val FROM long GROUP BY idx)),
moved AS (
  SELECT cluster, list_transform(list_zip(vector, r), lambda p: p[1] - p[2]) AS vector
  FROM means, overall)
SELECT a.cluster::BIGINT AS src, b.cluster::BIGINT AS dst, round(1 - {cosine_sql('a.vector', 'b.vector')}, 6) AS d
FROM moved a JOIN moved b ON a.cluster < b.cluster""")
def _relative(spark, sf):
    everything = fleet(spark, sf)
    overall = agg.to_vectors(
        agg.vector_aggregate(everything.withColumn("all", F.lit(0)), ["all"], "simple"), ["all"]
    )
    means = pairs.relative_to(_as_fleet(cluster_means(spark, sf)), overall)
    return rounded(pairs.pair_distances(means, "cosine", all_pairs=True), "d")


@query("v6_exponential_kernel", f"""WITH {MEANS}, d AS (
  SELECT a.cluster::BIGINT AS src, b.cluster::BIGINT AS dst, {cosine_sql('a.vector', 'b.vector')} AS s
  FROM means a JOIN means b ON a.cluster < b.cluster)
SELECT src, dst, round(exp(-(1 - s) / (SELECT avg(1 - s) FROM d)), 6) AS w FROM d""")
def _kernel(spark, sf):
    from regatta.operators.graph import kernel_weights

    means = _as_fleet(cluster_means(spark, sf))
    d = pairs.pair_distances(means, "cosine", all_pairs=True)
    return rounded(kernel_weights(d, pairs.mean_pairwise(means, "cosine").scalar()), "w")


@query("v7_similarity_matrix", f"""WITH {MEANS}, d AS (
  SELECT a.cluster::BIGINT AS src, b.cluster::BIGINT AS dst, {l2_sql('a.vector', 'b.vector')} AS d
  FROM means a JOIN means b ON a.cluster < b.cluster),
w AS (SELECT src, dst, exp(-d / (SELECT avg(d) FROM d)) AS w FROM d)
SELECT src, dst, round(w * 100, 6) AS pct FROM w
UNION ALL SELECT dst, src, round(w * 100, 6) FROM w
UNION ALL SELECT cluster::BIGINT, cluster::BIGINT, 100.0::DOUBLE FROM means""")
def _matrix(spark, sf):
    from regatta.operators.graph import both_directions, kernel_weights

    means = _as_fleet(cluster_means(spark, sf))
    d = pairs.pair_distances(means, "l2", all_pairs=True)
    w = both_directions(kernel_weights(d, pairs.mean_pairwise(means, "l2").scalar()))
    own = means.select(
        F.col("entity").cast("long").alias("src"), F.col("entity").cast("long").alias("dst"),
        F.lit(1.0).alias("w"),
    )
    return w.unionByName(own).select("src", "dst", F.round(F.col("w") * 100, 6).alias("pct"))


@query("v8_model_difference", f"""WITH {MEANS}
SELECT a.cluster::BIGINT AS src, b.cluster::BIGINT AS dst, round({l1_sql('a.vector', 'b.vector')}, 6) AS d
FROM means a JOIN means b ON a.cluster < b.cluster""")
def _difference(spark, sf):
    parts = cluster_means(spark, sf).select(
        F.col("cluster").alias("entity"),
        A.reshape(F.col("vector"), 4, 8).alias("w1"), F.slice("vector", 33, 8).alias("b1"),
        A.reshape(F.col("vector"), 5, 4, 40).alias("w2"), F.slice("vector", 61, 4).alias("b2"),
    )
    flat = parts.select(
        "entity",
        A.flatten_parts(F.col("w1"), F.col("b1"), F.col("w2"), F.col("b2")).alias("vector"),
    )
    return rounded(pairs.pair_distances(flat, "l1", all_pairs=True), "d")


MIX = f"""WITH {FLEET}, prev AS (
  SELECT entity + 1 AS entity, vector AS prev FROM fleet WHERE cluster <> 0),
overall AS (SELECT vector AS g FROM fleet ORDER BY entity LIMIT 1),
mix AS (
  SELECT f.entity, f.vector AS received, p.prev, o.g,
         coalesce(f.weight >= 1.2 * q.weight, false) AS rising
  FROM fleet f LEFT JOIN prev p USING (entity) LEFT JOIN fleet q ON q.entity = f.entity - 1, overall o)"""


def _mixed(spark, sf, method):
    rows = fleet(spark, sf)
    before = rows.select(
        (F.col("entity") + 1).alias("entity"),
        F.when(F.col("cluster") != 0, F.col("vector")).alias("prev"),
        F.col("weight").alias("prev_weight"),
    )
    overall = rows.agg(F.min_by("vector", "entity")).scalar()
    out = rows.join(before, "entity", "left").withColumn("overall", overall).select(
        "entity",
        assign.mix(
            method, F.col("vector"), F.col("prev"), F.col("overall"),
            assign.has_risen(F.col("weight"), F.col("prev_weight")),
        ).alias("vector"),
    )
    return rounded(agg.to_long(out, ["entity"]), "val")


MIX_SQL = {
    "none": "received",
    "50-50": "CASE WHEN prev IS NULL THEN received ELSE list_transform(list_zip(received, prev),"
             " lambda p: (p[1] + p[2]) / 2) END",
    "gravity": "CASE WHEN prev IS NOT NULL AND rising THEN g ELSE received END",
}

for _name, _method in [("v11_fifty_fifty_mix", "50-50"), ("v12_pass_through_mix", "none"),
                       ("v13_drift_guarded_mix", "gravity")]:
    @query(_name, f"""{MIX}, out AS (SELECT entity, {MIX_SQL[_method]} AS v FROM mix)
SELECT entity, unnest(range(len(v)))::INT AS idx, round(unnest(v), 6) AS val FROM out""")
    def _mixing(spark, sf, method=_method):
        return _mixed(spark, sf, method)


@query("x1_registered_aggregate", f"""WITH {LONG}
SELECT cluster, idx, round(max(val) - min(val), 6) AS val FROM long GROUP BY cluster, idx""")
def _user_aggregate(spark, sf):
    agg.register_aggregate("range", lambda val, weight: F.max(val) - F.min(val))
    return rounded(agg.vector_aggregate(fleet(spark, sf), ["cluster"], "range"), "val")


@query("x2_registered_mix", f"""{MIX}, out AS (
  SELECT entity, list_transform(list_zip(received, g), lambda p: 0.75 * p[1] + 0.25 * p[2]) AS v FROM mix)
SELECT entity, unnest(range(len(v)))::INT AS idx, round(unnest(v), 6) AS val FROM out""")
def _user_mix(spark, sf):
    assign.register_mixer(
        "towards", lambda received, previous, overall, rising:
        F.zip_with(received, overall, lambda x, y: 0.75 * x + 0.25 * y),
    )
    return _mixed(spark, sf, "towards")


@query("x3_registered_distance", f"""{CONSECUTIVE}
SELECT entity, round(list_max(list_transform(list_zip(x, y), lambda p: abs(p[1] - p[2]))), 6) AS d
FROM two""")
def _user_distance(spark, sf):
    A.register_distance(
        "chebyshev", lambda a, b: F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    )
    d = A.distance("chebyshev", F.col("x"), F.col("y"))
    return _consecutive(spark, sf).select("entity", F.round(d, 6).alias("d"))


# -- near pairs by hash buckets -----------------------------------------------------------------

# Four drifted versions of every vector: each raises another quarter of its components by a half, so
# versions of one vector lie about 0.05 apart and everything else far off.
VERSIONS, NEAR_BOUND, BUCKET_RECALL = 4, 0.1, 0.97


def drifted(spark, sf):
    """``(entity, vector)``: the fleet at four stages of drift."""
    stage = F.explode(F.sequence(F.lit(0), F.lit(VERSIONS - 1))).alias("stage")
    return fleet(spark, sf).select("entity", "vector", stage).select(
        (F.col("entity") * VERSIONS + F.col("stage")).alias("entity"),
        F.transform(
            "vector", lambda x, i: F.when(i % VERSIONS == F.col("stage"), x * 1.5).otherwise(x)
        ).alias("vector"),
    )


DRIFTED = f"""{FLEET}, drifted AS (
  SELECT entity * {VERSIONS} + stage AS entity,
         [CASE WHEN i % {VERSIONS} = stage THEN vector[i + 1] * 1.5 ELSE vector[i + 1] END
          FOR i IN range(len(vector))] AS vector
  FROM fleet, range({VERSIONS}) t(stage))"""

PLANES = f"""{DRIFTED}, size AS (
  SELECT greatest(1, ceil(log2(greatest(2, count(*) / {buckets.BUCKET_ROWS}.0))))::INT AS bits FROM drifted),
planes AS (
  SELECT bits, ceil(ln(1 - {BUCKET_RECALL}) / ln(1 - pow(1 - acos(1 - {NEAR_BOUND}) / pi(), bits)))::INT AS tables
  FROM size),
digest AS (
  SELECT i, b, md5(i::VARCHAR || ':' || b || ':planes') AS hex
  FROM planes, range({DIM}) t(i), unnest(range((tables * bits + 127) // 128)) u(b)),
signs AS (
  SELECT j, list(CASE WHEN (('0x' || substr(hex, 1 + (j % 128)::INT // 4, 1))::INT >> (3 - j % 4)::INT) & 1 = 1
                      THEN 1 ELSE -1 END ORDER BY i)::DOUBLE[] AS plane
  FROM planes, unnest(range(tables * bits)) t(j) JOIN digest ON b = j // 128 GROUP BY j),
codes AS (
  SELECT entity, j // bits AS tab,
         string_agg(CASE WHEN list_dot_product(vector, plane) >= 0 THEN '1' ELSE '0' END, '' ORDER BY j) AS code
  FROM drifted, signs, planes GROUP BY entity, tab),
met AS (
  SELECT DISTINCT a.entity AS src, b.entity AS dst FROM codes a JOIN codes b
    ON a.tab = b.tab AND a.code = b.code AND a.entity < b.entity),
near AS (
  SELECT src, dst, {DISTANCE_SQL['cosine']('a.vector', 'b.vector')} AS d
  FROM met JOIN drifted a ON a.entity = src JOIN drifted b ON b.entity = dst
  WHERE d <= {NEAR_BOUND})"""


LINKS = f"""{PLANES}, links AS (
  SELECT entity, count(*) AS n_links, min(d) AS nearest
  FROM (SELECT src AS entity, d FROM near UNION ALL SELECT dst, d FROM near) GROUP BY entity)"""


@query("j4_near_links_by_planes", f"WITH {LINKS} SELECT entity, n_links, round(nearest, 6) AS nearest FROM links")
def _near_links(spark, sf):
    return rounded(buckets.near_links(drifted(spark, sf), NEAR_BOUND, BUCKET_RECALL), "nearest")


@query("v4_planes_audit", f"""WITH {LINKS}, wanted AS (
  SELECT a.entity, count(*) AS n FROM drifted a JOIN drifted b ON a.entity <> b.entity
  WHERE a.entity % 20 = 0 AND {DISTANCE_SQL['cosine']('a.vector', 'b.vector')} <= {NEAR_BOUND} GROUP BY a.entity)
SELECT (SELECT sum(n) FROM wanted)::BIGINT AS wanted,
       (SELECT sum(n_links) FROM links WHERE entity % 20 = 0)::BIGINT AS found,
       (SELECT sum(n * (n - 1) / 2)::BIGINT FROM (SELECT count(*) AS n FROM codes GROUP BY tab, code)) AS compared""")
def _planes_audit(spark, sf):
    """Recall for ids divisible by 20 against all rows, and the comparisons made."""
    rows = drifted(spark, sf)
    planes = buckets.plan_planes(rows.count(), NEAR_BOUND, BUCKET_RECALL)
    audit = buckets.recall_of(buckets.near_links(rows, NEAR_BOUND, BUCKET_RECALL), rows, NEAR_BOUND)
    compared = buckets.compared_pairs(buckets.coded_rows(rows, planes, DIM))
    return audit.withColumn("compared", compared.scalar())
