"""Joins against centres, assignment, sampling, scoring, training and projection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from regatta.catalog.base import (
    DIM,
    FLEET,
    LONG,
    MEANS,
    cluster_means,
    cosine_sql,
    fleet,
    query,
    read,
    rounded,
    uniform_sql,
)
from regatta.functions import arrays as A
from regatta.functions.hashing import hash_uniform
from regatta.operators import aggregate as agg
from regatta.operators import assign, gradient, projection, quality, sampling, scoring
from regatta.operators.common import cut_lineage

# -- joins and assignment -----------------------------------------------------------------------


@query("j1_members_of_clusters", """SELECT l_suppkey AS entity, s_nationkey AS cluster,
  count(*) AS n, round(sum(l_quantity), 4) AS quantity
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal > 0 GROUP BY ALL""")
def _members(spark, sf):
    lines = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("entity"), "l_quantity")
    rows = lines.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity")
    )
    part = read(spark, sf, "supplier").filter(F.col("s_acctbal") > 0).select(
        F.col("s_suppkey").alias("entity"), F.col("s_nationkey").alias("cluster")
    )
    return rounded(assign.member_rows(rows, part), "quantity", digits=4)


@query("j2_cluster_vector_or_global", f"""WITH {MEANS}, overall AS (
  SELECT list(val ORDER BY idx) AS g FROM (SELECT idx, avg(val) AS val FROM long GROUP BY idx))
SELECT f.entity, f.cluster, unnest(range({DIM}))::INT AS idx,
       round(unnest(coalesce(m.vector, g)), 6) AS val
FROM fleet f LEFT JOIN (
  SELECT * FROM means WHERE cluster IN (SELECT cluster FROM fleet GROUP BY cluster HAVING count(*) >= 50)
) m ON m.cluster = f.cluster, overall""")
def _fallback(spark, sf):
    rows = fleet(spark, sf)
    large = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= 50)
    known = cluster_means(spark, sf).join(large.select("cluster"), "cluster", "left_semi")
    overall = agg.to_vectors(
        agg.vector_aggregate(rows.withColumn("all", F.lit(0)), ["all"], "simple"), ["all"]
    )
    out = assign.cluster_vector_or_global(rows.select("entity", "cluster"), known, overall)
    return rounded(agg.to_long(out, ["entity", "cluster"]), "val")


CENTRES = f"""WITH {MEANS}, d AS (
  SELECT f.entity, m.cluster, 1 - {cosine_sql('f.vector', 'm.vector')} AS d FROM fleet f, means m)"""


@query("j3_centre_distances", f"{CENTRES} SELECT entity, cluster, round(d, 6) AS d FROM d")
def _theta(spark, sf):
    return rounded(assign.centre_distances(fleet(spark, sf), cluster_means(spark, sf)), "d")


@query("w8_nearest_centre", f"""{CENTRES}, r AS (
  SELECT *, row_number() OVER (PARTITION BY entity ORDER BY d, cluster) AS r FROM d)
SELECT entity, cluster, round(d, 6) AS d FROM r WHERE r = 1""")
def _nearest(spark, sf):
    return rounded(assign.nearest(fleet(spark, sf), cluster_means(spark, sf)), "d")


PROBS = f"""{CENTRES}, s AS (
  SELECT entity, cluster, d, sum(d) OVER w AS total, count(*) OVER w AS n,
         count(*) FILTER (d < 1e-6) OVER w AS zeros FROM d WINDOW w AS (PARTITION BY entity)),
raw AS (
  SELECT *, CASE WHEN zeros > 0 THEN CASE WHEN d < 1e-6 THEN 1.0 / zeros ELSE 0 END
                 WHEN total = 0 THEN 1.0 / n ELSE greatest(0, 1 - d / total) END AS q FROM s),
p AS (
  SELECT entity, cluster, CASE WHEN sum(q) OVER w > 0 THEN q / sum(q) OVER w ELSE 1.0 / n END AS p
  FROM raw WINDOW w AS (PARTITION BY entity)),
cum AS (
  SELECT *, sum(p) OVER (PARTITION BY entity ORDER BY cluster) AS cum,
         {uniform_sql('entity', 'draw')} AS u FROM p),
drawn AS (
  SELECT entity, coalesce(min(cluster) FILTER (u <= cum), min(cluster)) AS cluster
  FROM cum GROUP BY entity)"""


@query("r7_assignment_probabilities", f"{PROBS} SELECT entity, cluster, round(p, 6) AS p FROM p")
def _probabilities(spark, sf):
    out = assign.assignment_probabilities(fleet(spark, sf), cluster_means(spark, sf))
    return rounded(out, "p")


@query("r8_probabilistic_assignment", f"{PROBS} SELECT entity, cluster FROM drawn")
def _draw(spark, sf):
    return assign.assign(fleet(spark, sf), cluster_means(spark, sf), "probabilistic", seed="draw")


@query("w5_cumulative_draw", f"""{PROBS}
SELECT cum.entity, cum.cluster, round(cum, 6) AS cum, drawn.cluster AS chosen
FROM cum JOIN drawn USING (entity)""")
def _cumulative(spark, sf):
    probs = assign.assignment_probabilities(fleet(spark, sf), cluster_means(spark, sf))
    chosen = assign.draw_cluster(probs, "draw").withColumnRenamed("cluster", "chosen")
    return rounded(sampling.running_share(probs).drop("p").join(chosen, "entity"), "cum")


@query("x4_registered_assignment", f"""{CENTRES}, r AS (
  SELECT *, row_number() OVER (PARTITION BY entity ORDER BY d DESC, cluster DESC) AS r FROM d)
SELECT entity, cluster FROM r WHERE r = 1""")
def _user_assignment(spark, sf):
    def farthest(entities, centres, metric, seed, round_no):
        d = assign.centre_distances(entities, centres, metric)
        return d.groupBy("entity").agg(F.max(F.struct("d", "cluster"))["cluster"].alias("cluster"))

    assign.register_assignment("farthest", farthest)
    return assign.assign(fleet(spark, sf), cluster_means(spark, sf), "farthest")


# -- sampling -----------------------------------------------------------------------------------


@query("r1_seeded_shuffle_and_take", f"""WITH r AS (
  SELECT l_returnflag, o_orderkey AS entity,
         row_number() OVER (PARTITION BY l_returnflag ORDER BY {uniform_sql('o_orderkey', 7)}, o_orderkey) AS rank
  FROM (SELECT DISTINCT l_returnflag, l_orderkey AS o_orderkey FROM lineitem))
SELECT * FROM r WHERE rank <= 500""")
def _shuffle(spark, sf):
    rows = read(spark, sf, "lineitem").select(
        "l_returnflag", F.col("l_orderkey").alias("entity")
    ).distinct()
    return sampling.shuffle_and_take(rows, "entity", 500, 7, ["l_returnflag"])


def _wants(spark, sf):
    """Suppliers as entities that want 10 to 49 samples each."""
    n = (F.floor(hash_uniform(F.col("s_suppkey"), "n") * 40) + 10).cast("int")
    return read(spark, sf, "supplier").select(F.col("s_suppkey").alias("entity"), n.alias("n"))


def _samples(spark, sf):
    return fleet(spark, sf).select(F.col("entity").alias("sample_id"), F.col("cluster").alias("label"))


WANTS = f"""wants AS (
  SELECT s_suppkey AS entity, (floor({uniform_sql('s_suppkey', 'n')} * 40) + 10)::INT AS n FROM supplier)"""
SAMPLES = """samples AS (
  SELECT vec_id AS sample_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS pos,
         row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS label_pos
  FROM embeddings)"""


def _draws_sql(name: str, table: str, key: str, seed: str) -> str:
    """CTEs that end in ``name``: the first ``need`` cells within ``size`` of each key's permuted grid.

    ``table`` is ``(entity, label, need, size)``.
    """
    out = [f"""{name}_grid AS (
  SELECT *, a * ceil(size / a)::BIGINT - size AS over, ceil(size / a)::BIGINT AS b FROM (
    SELECT *, unnest(range(greatest(side - 63, side // 2 + 1), side + 1)) AS a
    FROM (SELECT *, ceil(sqrt(size))::BIGINT AS side FROM {table} WHERE size > 0 AND need > 0))
  QUALIFY row_number() OVER (PARTITION BY entity ORDER BY a * ceil(size / a)::BIGINT - size, a) = 1),
{name}0 AS (
  SELECT *, cell // b AS x, cell % b AS y FROM (
    SELECT *, unnest(range(least(need, size) + over)) AS cell FROM {name}_grid))"""]
    for turn in range(6):
        m = "ab"[turn % 2]
        shift = uniform_sql(f"({key}::VARCHAR || ':{turn}:' || y)", seed)
        out.append(f"""{name}{turn + 1} AS (
  SELECT * EXCLUDE (x, y), y AS x, (x + floor({shift} * {m})::BIGINT) % {m} AS y FROM {name}{turn})""")
    out.append(f"""{name} AS (
  SELECT entity, label, x * b + y AS pos FROM {name}6 WHERE x * b + y < size
  QUALIFY row_number() OVER (PARTITION BY entity ORDER BY cell) <= need)""")
    return ",\n".join(out)


def _iid_sql(key: str) -> str:
    return f"""WITH {WANTS}, {SAMPLES}, asked AS (
  SELECT entity, NULL AS label, n AS need, (SELECT count(*) FROM embeddings) AS size FROM wants),
{_draws_sql("draws", "asked", key, "11:all")}
SELECT entity, sample_id FROM draws JOIN samples USING (pos)"""


@query("r2_iid_sample", _iid_sql("entity"))
def _iid(spark, sf):
    return sampling.iid_sample(_wants(spark, sf), _samples(spark, sf), 11)


@query("r2_iid_sample_shared", _iid_sql("'shared'"))
def _iid_shared(spark, sf):
    return sampling.iid_sample(_wants(spark, sf), _samples(spark, sf), 11, shared=True)


LABELLED = f"""{WANTS}, grouped AS (SELECT *, floor(entity / 2)::INT AS grp FROM wants),
ranks AS (SELECT grp, row_number() OVER (ORDER BY grp) AS r FROM (SELECT DISTINCT grp FROM grouped)),
labelled AS (
  SELECT entity, n, grp, (CASE WHEN r <= 10 THEN r - 1 ELSE grp % 10 END)::INT AS label
  FROM grouped JOIN ranks USING (grp))"""


def _skew_sql(n: str, seed: int) -> str:
    return f"""WITH {LABELLED}, {SAMPLES}, sized AS (
  SELECT entity, label, {n} AS n, floor({n} * 70 / 100)::BIGINT AS want,
         (SELECT count(*) FROM embeddings e WHERE e.label = l.label) AS size FROM labelled l),
one AS (SELECT entity, label, least(want, size) AS need, size FROM sized),
two AS (SELECT entity, label, n - least(want, size) AS need, (SELECT count(*) FROM embeddings) AS size FROM sized),
{_draws_sql("own", "one", "entity", f"{seed}:primary")},
{_draws_sql("other", "two", "entity", f"{seed}:all")}
SELECT entity, sample_id, 'primary' AS part FROM own d JOIN samples s ON s.label = d.label AND s.label_pos = d.pos
UNION ALL SELECT entity, sample_id, 'any' FROM other d JOIN samples s ON s.pos = d.pos"""


@query("r3_skewed_sample", _skew_sql("n", 13))
def _skewed(spark, sf):
    named = sampling.primary_labels(_wants(spark, sf), "pairs")
    return sampling.skewed_sample(named, _samples(spark, sf), 13)


@query("r5_matched_test_split", _skew_sql("greatest(50, floor(n * 20 / 100)::INT)", 17))
def _test_split(spark, sf):
    named = sampling.primary_labels(_wants(spark, sf), "pairs").withColumn(
        "n", sampling.test_size(F.col("n"))
    )
    return sampling.skewed_sample(named, _samples(spark, sf), 17)


@query("r4_primary_labels", f"""WITH {LABELLED}, three AS (
  SELECT entity, CASE WHEN entity <= 2 THEN 0 WHEN entity <= 5 THEN 1 ELSE 2 END AS grp FROM wants)
SELECT l.entity, l.label AS pair_label, t.grp::INT AS group_label
FROM labelled l JOIN three t USING (entity)""")
def _labels(spark, sf):
    entities = _wants(spark, sf).select("entity")
    a = sampling.primary_labels(entities, "pairs").select("entity", F.col("label").alias("pair_label"))
    b = sampling.primary_labels(entities).select("entity", F.col("label").alias("group_label"))
    return a.join(b, "entity")


@query("r6_random_weights", f"""SELECT s_suppkey AS entity,
  floor({uniform_sql('s_suppkey', 'size')} * 400) + 200 AS weight FROM supplier""")
def _weights(spark, sf):
    entities = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("entity"))
    return sampling.random_weights(entities, "size")


@query("r9_run_seeds", f"""SELECT event_type AS experiment, run::INT AS run,
  floor({uniform_sql('run', 'run:42')} * 100000)::INT AS seed, events
FROM (SELECT event_type, count(*) AS events FROM events GROUP BY ALL), range(5) t(run)""")
def _seeds(spark, sf):
    """The (experiment, run) table: as many runs per experiment of the log as there are seeds."""
    per = read(spark, sf, "events").groupBy(F.col("event_type").alias("experiment")).agg(
        F.count(F.lit(1)).alias("events")
    )
    runs = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("run")
    return per.select("experiment", "events", runs).join(sampling.run_seeds(spark, 42, 5), "run")


# -- scoring, training, projection --------------------------------------------------------------

HIDDEN, OUT = 3, 10
SMALL_SHAPE = (DIM, HIDDEN, OUT)


def every(step: int, first: int) -> Column:
    """Sum of every ``step``-th value of the vector from the place ``first`` on."""
    return A.array_sum(F.filter("vector", lambda _, i: F.pmod(i, F.lit(step)) == first))


def every_sql(step: int, first: str | int) -> str:
    return f"list_sum(list_slice(vector, {first} + 1, len(vector), {step}))"


def _probs(spark, sf):
    """Class probabilities of every row: softmax over the sums of every tenth value of its vector."""
    logits = F.array(*[every(10, r) * 4 for r in range(10)])
    return fleet(spark, sf).select(
        "entity", F.col("cluster").alias("label"), A.softmax(logits).alias("probs")
    )


PROBS_SQL = f"""{FLEET}, logit AS (
  SELECT entity, cluster AS label, list_transform(range(10),
         lambda r: {every_sql(10, 'r')} * 4) AS z FROM fleet),
ex AS (SELECT entity, label, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM logit),
pred AS (SELECT entity, label, list_transform(e, lambda x: x / list_sum(e)) AS probs FROM ex),
scored AS (
  SELECT entity, label, CASE WHEN list_position(probs, list_max(probs)) - 1 = label THEN 1.0 ELSE 0.0 END AS hit,
         -ln(greatest(1e-7, least(1 - 1e-7, probs[label + 1]))) AS loss FROM pred)"""


@query("a13_accuracy", f"WITH {PROBS_SQL} SELECT round(avg(hit), 6) AS accuracy FROM scored")
def _accuracy(spark, sf):
    return rounded(quality.accuracy(_probs(spark, sf)), "accuracy")


@query("a14_cross_entropy", f"WITH {PROBS_SQL} SELECT label, round(avg(loss), 6) AS loss FROM scored GROUP BY label")
def _loss(spark, sf):
    return rounded(quality.mean_loss(_probs(spark, sf), ["label"]), "loss")


POOL = f"""WITH {PROBS_SQL}, owner AS (SELECT *, entity % 50 AS owner FROM scored),
part AS (SELECT s_suppkey AS entity, s_nationkey AS cluster FROM supplier)"""


@query("j5_pooled_rows_per_cluster", f"""{POOL}
SELECT cluster, count(o.owner) AS rows FROM part p LEFT JOIN owner o ON o.owner = p.entity GROUP BY cluster""")
def _pool(spark, sf):
    return _pooled(spark, sf).select("cluster", "rows")


@query("a15_cluster_accuracy", f"""{POOL}
SELECT cluster, round(coalesce(avg(hit), 0), 6) AS accuracy, count(o.owner) AS rows
FROM part p LEFT JOIN owner o ON o.owner = p.entity GROUP BY cluster""")
def _cluster_accuracy(spark, sf):
    return rounded(_pooled(spark, sf), "accuracy")


def _pooled(spark, sf):
    owned = _probs(spark, sf).withColumn("entity", F.col("entity") % 50)
    part = read(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("entity"), F.col("s_nationkey").alias("cluster")
    )
    return quality.pooled_accuracy(owned, part)


MODEL_SIZE = scoring.model_size(*SMALL_SHAPE)


def _xavier_sql(seed: str) -> str:
    w1, b1 = DIM * HIDDEN, DIM * HIDDEN + HIDDEN
    w2 = b1 + HIDDEN * OUT
    return f"""model AS (
  SELECT i::INT AS idx, ({uniform_sql('i', seed)} * 2 - 1) * CASE
    WHEN i < {w1} THEN sqrt(2.0 / {DIM + HIDDEN}) WHEN i < {b1} THEN 0
    WHEN i < {w2} THEN sqrt(2.0 / {HIDDEN + OUT}) ELSE 0 END AS val
  FROM range({MODEL_SIZE}) t(i))"""


@query("t4_xavier_vector_distance", f"""WITH {LONG}, {_xavier_sql('init')}
SELECT entity, round(sum(l.val * m.val), 6) AS along FROM long l JOIN model m USING (idx) GROUP BY entity""")
def _xavier(spark, sf):
    """The start vector, checked through its products with every row of the fleet."""
    start = scoring.xavier_vector(spark, *SMALL_SHAPE, "init").withColumnRenamed("val", "m")
    rows = agg.to_long(fleet(spark, sf), ["entity"])
    return rounded(
        rows.join(start, "idx").groupBy("entity").agg(F.sum(F.col("val") * F.col("m")).alias("along")),
        "along",
    )


@query("t2_score_samples", f"""WITH {LONG}, {_xavier_sql('init')},
hid AS (
  SELECT entity, j, 1 / (1 + exp(-sum(l.val * m.val))) AS h FROM long l, range({HIDDEN}) t(j)
  JOIN model m ON m.idx = l.idx * {HIDDEN} + j GROUP BY entity, j),
z AS (
  SELECT entity, o, sum(h * m.val) AS z FROM hid, range({OUT}) t(o)
  JOIN model m ON m.idx = {DIM * HIDDEN + HIDDEN} + j * {OUT} + o GROUP BY entity, o)
SELECT entity, o::INT AS class, round(exp(z) / sum(exp(z)) OVER (PARTITION BY entity), 6) AS p FROM z""")
def _score(spark, sf):
    from regatta.operators.common import ensure_checkpoint_dir

    samples = fleet(spark, sf).select("entity", F.col("vector").alias("features"))
    ensure_checkpoint_dir(samples)
    model = scoring.xavier_vector(spark, *SMALL_SHAPE, "init").orderBy("idx").toPandas()["val"]
    out = scoring.score(samples, model.to_numpy(), *SMALL_SHAPE)
    return rounded(
        out.select("entity", F.posexplode("probs").alias("class", "p")), "p"
    )


def _training_rows(spark, sf):
    return fleet(spark, sf).select(
        (F.col("entity") % 5).alias("entity"), F.col("entity").alias("sample_id"),
        F.col("vector").alias("features"), F.col("cluster").alias("label"),
    )


def _start_vectors(spark, entities):
    start = scoring.xavier_vector(spark, *SMALL_SHAPE, "init").withColumn("all", F.lit(0))
    one = agg.to_vectors(start, ["all"]).select("vector")
    return entities.withColumn("vector", one.scalar())


@query("t1_train_per_entity")
def _train(spark, sf):
    rows = _training_rows(spark, sf)
    starts = _start_vectors(spark, rows.select("entity").distinct())
    out = scoring.train_per_entity(rows, starts, SMALL_SHAPE)
    return out.select("entity", "n", F.round("loss", 6).alias("loss"),
                      F.round(A.norm(F.col("vector")), 6).alias("length"))


STEP_RATE, STEP_EPOCHS, STEP_BATCHES = 0.5, 2, 2


def _gradient_step_sql(n: int) -> str:
    """SQL of step ``n``: outputs, errors and summed gradients of one mini-batch, and the models after it."""
    first, second = DIM * HIDDEN, DIM * HIDDEN + HIDDEN
    ins, hid, out = f"range(1, {DIM + 1})", f"range(1, {HIDDEN + 1})", f"range(1, {OUT + 1})"
    return f"""
hid{n} AS (
  SELECT r.*, m.w, [1 / (1 + exp(-(list_sum([r.x[i] * m.w[(i - 1) * {HIDDEN} + j] FOR i IN {ins}])
                                   + m.w[{first} + j]))) FOR j IN {hid}] AS h
  FROM rows r JOIN m{n} m USING (entity) WHERE r.batch = {n % STEP_BATCHES}),
z{n} AS (
  SELECT *, [exp(list_sum([h[j] * w[{second} + (j - 1) * {OUT} + o] FOR j IN {hid}])
                 + w[{second + HIDDEN * OUT} + o]) FOR o IN {out}] AS e FROM hid{n}),
d{n} AS (
  SELECT *, -ln(greatest(1e-7, least(1 - 1e-7, e[label + 1] / list_sum(e)))) AS loss,
         [e[o] / list_sum(e) - (o = label + 1)::INT FOR o IN {out}] AS d FROM z{n}),
back{n} AS (
  SELECT *, [list_sum([w[{second} + (j - 1) * {OUT} + o] * d[o] FOR o IN {out}]) * h[j] * (1 - h[j])
             FOR j IN {hid}] AS dh FROM d{n}),
long{n} AS (
  SELECT entity, unnest(g) AS val, unnest(range(len(g))) AS idx FROM (
    SELECT entity, flatten([[x[i] * dh[j] FOR j IN {hid}] FOR i IN {ins}]) || dh
                   || flatten([[h[j] * d[o] FOR o IN {out}] FOR j IN {hid}]) || d AS g FROM back{n})),
g{n} AS (
  SELECT entity, list(val ORDER BY idx) AS g FROM (
    SELECT entity, idx, avg(val) AS val FROM long{n} GROUP BY ALL) GROUP BY entity),
l{n} AS (SELECT entity, sum(loss) AS lost, count(*) AS seen FROM d{n} GROUP BY entity),
m{n + 1} AS MATERIALIZED (
  SELECT entity, CASE WHEN g IS NULL THEN w ELSE
    [w[i] - {STEP_RATE} * g[i] FOR i IN range(1, {MODEL_SIZE + 1})] END AS w
  FROM m{n} LEFT JOIN g{n} USING (entity))"""


STEPS = STEP_EPOCHS * STEP_BATCHES
LAST_LOSSES = " UNION ALL ".join(f"SELECT * FROM l{n}" for n in range(STEPS - STEP_BATCHES, STEPS))


@query("t1_train_by_gradients", f"""WITH {FLEET}, {_xavier_sql('init')},
rows AS MATERIALIZED (
  SELECT entity % 5 AS entity, vector AS x, cluster AS label,
         floor({uniform_sql('entity', 'batch:0')} * {STEP_BATCHES})::INT AS batch FROM fleet),
m0 AS MATERIALIZED (
  SELECT entity, list(val ORDER BY idx) AS w FROM (SELECT DISTINCT entity FROM rows), model GROUP BY entity),
{','.join(_gradient_step_sql(n) for n in range(STEPS))},
sizes AS (SELECT entity, count(*) AS n FROM rows GROUP BY entity),
losses AS (SELECT entity, sum(lost) / sum(seen) AS loss FROM ({LAST_LOSSES}) GROUP BY entity)
SELECT entity, n, round(loss, 6) AS loss, unnest(range({MODEL_SIZE}))::INT AS idx, round(unnest(w), 6) AS val
FROM m{STEPS} JOIN sizes USING (entity) JOIN losses USING (entity)""")
def _train_by_gradients(spark, sf):
    rows = _training_rows(spark, sf)
    starts = _start_vectors(spark, rows.select("entity").distinct())
    out = gradient.train_by_gradients(
        rows, starts, SMALL_SHAPE, STEP_RATE, STEP_EPOCHS, STEP_BATCHES
    )
    return rounded(out.select("entity", "n", "loss", F.posexplode("vector").alias("idx", "val")), "loss", "val")


@query("t3_parameter_averaging_rounds")
def _rounds(spark, sf):
    from regatta.plans.rounds import fit_rounds

    history, _ = fit_rounds(
        _training_rows(spark, sf), SMALL_SHAPE, rounds=5, method="kmeans", k=2, seed=1
    )
    return rounded(history, "loss", "accuracy", "silhouette")


SQUARINGS = 14


def _leading_sql(c: int) -> str:
    """SQL of component ``c``: the covariance left, squared until one direction stands, and its variance."""
    squares = "".join(f"""
p{c}_{i + 1} AS MATERIALIZED (
  SELECT a, b, v / t AS v FROM (
    SELECT x.a, y.b, sum(x.v * y.v) AS v FROM p{c}_{i} x JOIN p{c}_{i} y ON x.b = y.a GROUP BY ALL),
    (SELECT sum(v * v) AS t FROM p{c}_{i})),""" for i in range(SQUARINGS))
    last = f"p{c}_{SQUARINGS}"
    return f"""
p{c}_0 AS MATERIALIZED (SELECT a, b, v / (SELECT sum(v) FROM c{c} WHERE a = b) AS v FROM c{c}),{squares}
e{c} AS MATERIALIZED (
  SELECT sum(c.v * p.v) AS variance FROM c{c} c JOIN {last} p ON p.a = c.b AND p.b = c.a),
d{c} AS MATERIALIZED (
  SELECT a AS idx, p.v / sqrt(peak.v) AS v FROM {last} p
  JOIN (SELECT b, v FROM {last} WHERE a = b ORDER BY v DESC, b LIMIT 1) peak USING (b)),
c{c + 1} AS MATERIALIZED (
  SELECT c.a, c.b, c.v - e.variance * p.v AS v FROM c{c} c JOIN {last} p USING (a, b), e{c} e)"""


def _components_sql(elements: str) -> str:
    """SQL of three components of ``elements (row, idx, val)``: ``c0``, variances ``e``, directions ``d``."""
    return f"""
centre AS (SELECT idx, avg(val) AS m FROM {elements} GROUP BY idx),
away AS MATERIALIZED (SELECT row, idx, val - m AS val FROM {elements} JOIN centre USING (idx)),
c0 AS MATERIALIZED (
  SELECT x.idx AS a, y.idx AS b, sum(x.val * y.val) / ((SELECT count(DISTINCT row) FROM {elements}) - 1) AS v
  FROM away x JOIN away y USING (row) GROUP BY ALL),
{','.join(_leading_sql(c) for c in range(3))}"""


PLACED_SQL = """
raw AS (
  SELECT row, sum(val * d0.v) AS x, sum(val * d1.v) AS y, sum(val * d2.v) AS z
  FROM away JOIN d0 USING (idx) JOIN d1 USING (idx) JOIN d2 USING (idx) GROUP BY row),
box AS (SELECT 5 / greatest(max(greatest(abs(x), abs(y), abs(z))), 1) AS f FROM raw),
placed AS (SELECT row, round(x * f, 6) AS x, round(y * f, 6) AS y, round(z * f, 6) AS z FROM raw, box)"""
FLEET_COMPONENTS = f"""{LONG}, elements AS (SELECT entity AS row, idx, val FROM long),
{_components_sql('elements')}"""


@query("t5_pca_positions", f"""WITH {FLEET_COMPONENTS}, {PLACED_SQL}
SELECT entity, cluster, x, y, z FROM fleet JOIN placed ON row = entity""")
def _pca(spark, sf):
    return rounded(projection.pca_positions(fleet(spark, sf), ["entity", "cluster"]), "x", "y", "z")


@query("t5_explained_variance", f"""WITH {FLEET_COMPONENTS},
total AS (SELECT sum(v) AS total FROM c0 WHERE a = b),
every AS ({' UNION ALL '.join(f'SELECT {c}::INT AS component, variance FROM e{c}' for c in range(3))})
SELECT component, round(variance, 6) AS variance, round(variance / total, 6) AS share FROM every, total""")
def _explained(spark, sf):
    return rounded(projection.explained_variance(fleet(spark, sf)), "variance", "share")


@query("t6_scale_to_box", f"""WITH {FLEET}, c AS (
  SELECT entity, {every_sql(3, 0)} * 9 AS x, {every_sql(3, 1)} * 9 AS y, {every_sql(3, 2)} * 9 AS z FROM fleet),
f AS (SELECT 5 / greatest(max(greatest(abs(x), abs(y), abs(z))), 1) AS f FROM c)
SELECT entity, round(x * f, 6) AS x, round(y * f, 6) AS y, round(z * f, 6) AS z FROM c, f""")
def _box(spark, sf):
    raw = fleet(spark, sf).select("entity", *[(every(3, i) * 9).alias(a) for i, a in enumerate("xyz")])
    return rounded(projection.scale_to_box(raw), "x", "y", "z")


def _axis(a: str) -> str:
    return f"{uniform_sql('i', f'5:{a}')} * 2 - 1"


@query("t7_random_projection", f"""WITH {LONG}, raw AS (
  SELECT i::INT AS idx, {_axis('x')} AS x, {_axis('y')} AS y, {_axis('z')} AS z FROM range({DIM}) t(i)),
n AS (SELECT sqrt(sum(x * x)) AS nx, sqrt(sum(y * y)) AS ny, sqrt(sum(z * z)) AS nz FROM raw)
SELECT entity, round(sum(val * x / nx), 6) AS x, round(sum(val * y / ny), 6) AS y,
       round(sum(val * z / nz), 6) AS z
FROM long JOIN raw USING (idx), n GROUP BY entity""")
def _random(spark, sf):
    return rounded(projection.random_projection(fleet(spark, sf), DIM, 5, ["entity"]), "x", "y", "z")


KINDS = """kinds AS (
  SELECT 'client' AS kind, entity::VARCHAR AS entity, vector FROM fleet
  UNION ALL SELECT 'cluster', 'cluster-' || cluster, vector FROM means
  UNION ALL SELECT 'global', 'global', list(val ORDER BY idx) FROM (
    SELECT idx, avg(val) AS val FROM long GROUP BY idx))"""


def _kinds(spark, sf):
    rows = fleet(spark, sf)
    clusters = cluster_means(spark, sf).select(
        F.concat(F.lit("cluster-"), F.col("cluster")).alias("entity"), "vector"
    )
    overall = agg.to_vectors(
        agg.vector_aggregate(rows.withColumn("entity", F.lit("global")), ["entity"], "simple"),
        ["entity"],
    )
    return projection.with_kind(**{"client": rows, "cluster": clusters, "global": overall})


@query("u2_union_of_kinds", f"""WITH {MEANS}, {KINDS}
SELECT kind, entity, round(list_sum(vector), 6) AS total FROM kinds""")
def _union(spark, sf):
    return _kinds(spark, sf).select("kind", "entity", F.round(A.array_sum(F.col("vector")), 6).alias("total"))


ROUND_COUNT = 10


@query("t8_positions_by_round", f"""WITH {LONG}, states AS (
  SELECT entity % {ROUND_COUNT} AS round, entity // {ROUND_COUNT} AS entity, cluster, idx, val FROM long),
kinds AS (
  SELECT round, 'client' AS kind, entity::VARCHAR AS entity, idx, val FROM states
  UNION ALL SELECT round, 'cluster', 'cluster-' || cluster, idx, avg(val) FROM states GROUP BY ALL
  UNION ALL SELECT round, 'global', 'global', idx, avg(val) FROM states GROUP BY ALL),
elements AS MATERIALIZED (SELECT {{'r': round, 'k': kind, 'e': entity}} AS row, idx, val FROM kinds),
{_components_sql('elements')}, {PLACED_SQL}
SELECT row.r AS round, row.k AS kind, row.e AS entity, x, y, z FROM placed""")
def _positions(spark, sf):
    """Entities, clusters and the whole in every round, in one frame for all rounds."""
    rows = fleet(spark, sf).select(
        (F.col("entity") % ROUND_COUNT).alias("round"),
        F.floor(F.col("entity") / ROUND_COUNT).alias("entity"), "cluster", "vector",
    )
    clusters = agg.to_vectors(
        agg.vector_aggregate(rows, ["round", "cluster"], "simple", weight=None), ["round", "cluster"]
    ).withColumn("entity", F.concat(F.lit("cluster-"), F.col("cluster")))
    overall = agg.to_vectors(
        agg.vector_aggregate(rows, ["round"], "simple", weight=None), ["round"]
    ).withColumn("entity", F.lit("global"))
    states = projection.with_kind("round", client=rows, cluster=clusters, **{"global": overall})
    placed = projection.pca_positions(cut_lineage(states), ["round", "kind", "entity"])
    return rounded(projection.positions_by_round(placed), "x", "y", "z")
