from __future__ import annotations

from pyspark.sql import functions as F

from regatta.operators import common, graph


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def tables(spark):
    facts = spark.range(3000).select((F.col("id") % 300).alias("k"), F.col("id").alias("row"))
    return facts, spark.range(290).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))


def test_salted_copies_are_never_broadcast(spark):
    facts, unique = tables(spark)
    joined = common.spread_join(facts, unique, ["k"], ["row"])
    assert "Broadcast" not in plan_of(joined)
    assert joined.count() == 2900


def test_only_counted_small_tables_are_broadcast(spark, monkeypatch):
    facts, unique = tables(spark)
    small = common.counted_join(facts, unique, ["k"], ["row"], "left")
    assert "BroadcastHashJoin" in plan_of(small)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 100)
    for spread in ([], ["row"]):
        large = common.counted_join(facts, unique, ["k"], spread, "left")
        assert "Broadcast" not in plan_of(large)
        assert large.exceptAll(small).isEmpty() and large.count() == 3000


def test_steps_do_not_broadcast_large_label_tables(spark, triangles, singletons, monkeypatch):
    steps = {
        "modularity": lambda: graph.modularity(triangles, singletons, [1.0, 2.0]),
        "louvain": lambda: graph.louvain_step(triangles, singletons),
        "leiden": lambda: graph.leiden_step(triangles, singletons),
        "refine": lambda: graph.strongest_neighbour_refine(triangles, singletons),
        "split": lambda: graph.split_sparse(triangles, singletons),
    }
    small = {name: sorted(map(tuple, step().collect())) for name, step in steps.items()}
    monkeypatch.setattr(common, "BROADCAST_ROWS", 1)
    links = graph.with_own(graph.community_links(triangles, singletons), singletons)
    assert "BroadcastHashJoin" not in plan_of(links)
    assert {name: sorted(map(tuple, step().collect())) for name, step in steps.items()} == small
