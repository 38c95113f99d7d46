"""Experiment documents: one nested record per run, read, guarded, flattened, pruned and written."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: version written into every document.
VERSION = "1.0"

MODEL = "struct<layers:array<array<double>>,bias:array<double>,version:int>"
POSITION = (
    "struct<id:string,name:string,type:string,position:array<double>,color:string,"
    "roundIndex:int,clusterIdx:int>"
)
CLUSTER = f"struct<clusterId:int,accuracy:double,clientIds:array<string>,weights:{MODEL}>"
CLIENT = (
    "struct<clientId:string,clientName:string,loss:double,accuracy:double,testAccuracy:double,"
    f"gradientNorm:double,weights:{MODEL}>"
)
ROUND = (
    "struct<round:int,globalLoss:double,globalAccuracy:double,participatingClients:array<string>,"
    "aggregationTime:double,timestamp:bigint,"
    "weightsSnapshot:struct<W1Mean:double,W1Std:double,W2Mean:double,W2Std:double,b1Mean:double,"
    "b2Mean:double>,distanceMatrix:array<array<double>>,agreementMatrix:array<array<int>>,"
    f"clusters:array<array<string>>,silhouetteAvg:double,clusterMetrics:array<{CLUSTER}>,"
    f"clientMetrics:array<{CLIENT}>,globalModelWeights:{MODEL}>"
)
CONFIG = (
    "struct<aggregationMethod:string,clientAggregationMethod:string,modelAssignmentMethod:string,"
    "distanceMetric:string,clusteringMethod:string,kmeansNumClusters:int,spectralNumClusters:int,"
    "useAgreementMatrix:boolean,clientsPerRound:int,totalRounds:int,minClientsRequired:int,"
    "modelArchitecture:string,seed:bigint,clientCount:int>"
)
DOCUMENT = (
    f"version string, savedAt string, serverConfig {CONFIG}, globalModel {MODEL}, "
    f"roundHistory array<{ROUND}>, "
    f"clientModels array<struct<clientId:string,weights:{MODEL}>>, "
    f"visualizations3D array<struct<round:int,models:array<{POSITION}>>>"
)


def read_documents(
    spark: SparkSession, paths: str | Sequence[str], multi_line: bool = True
) -> DataFrame:
    """Documents with ``experiment`` and ``_corrupt_record``.

    The experiment is the file name without its ending, or the folder ``write_documents`` made.

    A saved file is one pretty-printed document (``multi_line``); documents written by
    ``write_documents`` are one per line and split freely.
    """
    raw = spark.read.schema(f"{DOCUMENT}, _corrupt_record string").option("multiLine", multi_line).option(
        "mode", "PERMISSIVE"
    ).json(paths)
    if "experiment" in raw.columns:
        return raw
    name = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.json$", "")
    return raw.withColumn("experiment", name)


def is_document(df: DataFrame) -> Column:
    ok = F.col("version").isNotNull() & F.col("roundHistory").isNotNull()
    if "_corrupt_record" in df.columns:
        ok = ok & F.col("_corrupt_record").isNull()
    return ok


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted documents and rejected ones (no version, no history, or not readable)."""
    ok = is_document(df)
    return df.filter(ok), df.filter(~ok)


def summarise(df: DataFrame) -> DataFrame:
    return df.select(
        "experiment", F.size("roundHistory").alias("rounds"),
        F.greatest(F.size("clientModels"), F.lit(0)).alias("entities"),
        F.col("serverConfig.aggregationMethod").alias("aggregation"),
        F.to_timestamp("savedAt").alias("saved_at"),
    )


def rounds_of(df: DataFrame) -> DataFrame:
    """``(experiment, seed, round, loss, accuracy, agg_ms, silhouette)``, one row per round."""
    rows = df.select("experiment", F.col("serverConfig.seed").alias("seed"),
                     F.explode("roundHistory").alias("r"))
    return rows.select(
        "experiment", "seed", F.col("r.round").alias("round"), F.col("r.globalLoss").alias("loss"),
        F.col("r.globalAccuracy").alias("accuracy"), F.col("r.aggregationTime").alias("agg_ms"),
        F.col("r.silhouetteAvg").alias("silhouette"),
    )


def cluster_rows_of(df: DataFrame) -> DataFrame:
    """``(experiment, seed, round, pos, accuracy, members)``."""
    rows = df.select("experiment", F.col("serverConfig.seed").alias("seed"),
                     F.explode("roundHistory").alias("r"))
    flat = rows.select("experiment", "seed", F.col("r.round").alias("round"),
                       F.posexplode("r.clusterMetrics").alias("pos", "c"))
    return flat.select("experiment", "seed", "round", "pos", F.col("c.accuracy").alias("accuracy"),
                       F.col("c.clientIds").alias("members"))


def entity_rows_of(df: DataFrame) -> DataFrame:
    """``(experiment, seed, round, entity, name, loss, accuracy, test_accuracy, update_norm)``."""
    rows = df.select("experiment", F.col("serverConfig.seed").alias("seed"),
                     F.explode("roundHistory").alias("r"))
    flat = rows.select("experiment", "seed", F.col("r.round").alias("round"),
                       F.explode("r.clientMetrics").alias("c"))
    return flat.select(
        "experiment", "seed", "round", F.col("c.clientId").alias("entity"),
        F.col("c.clientName").alias("name"), F.col("c.loss").alias("loss"),
        F.col("c.accuracy").alias("accuracy"), F.col("c.testAccuracy").alias("test_accuracy"),
        F.col("c.gradientNorm").alias("update_norm"),
    )


def without_weights(df: DataFrame) -> DataFrame:
    """Drop the vectors of every round; the final models of the document stay."""

    def slim(r: Column) -> Column:
        r = r.dropFields("globalModelWeights")
        for name in ("clientMetrics", "clusterMetrics"):
            r = r.withField(name, F.transform(r[name], lambda m: m.dropFields("weights")))
        return r

    return df.withColumn("roundHistory", F.transform("roundHistory", slim))


def slug(name: Column) -> Column:
    return F.regexp_replace(F.trim(name), r"\s+", "-")


def write_documents(df: DataFrame, path: str, by: str = "experiment") -> None:
    """One JSON document per line, weights pruned, one folder per run."""
    kept = [c for c in df.columns if c != "_corrupt_record"]
    without_weights(df.select(*kept)).write.mode("overwrite").partitionBy(by).json(path)


def benchmark_name(experiment: Column, seeds: Column, stamp: str) -> Column:
    return F.concat(F.lit("benchmark-"), slug(experiment), F.lit("-avg"), seeds.cast("string"),
                    F.lit(f"seeds-{stamp}"))


def write_averages(df: DataFrame, path: str, stamp: str) -> DataFrame:
    """Write averaged rounds ``(experiment, seeds, ...)``, a folder per experiment file name."""
    named = df.withColumn("file", benchmark_name(F.col("experiment"), F.col("seeds"), stamp))
    named.write.mode("overwrite").partitionBy("file").json(path)
    return df.sparkSession.read.schema(named.schema).json(path)
