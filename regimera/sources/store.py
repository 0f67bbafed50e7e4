"""Sinks: the pattern library, metric reports, table summaries and the tables behind charts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIBRARY_SCHEMA = T.StructType(
    [
        T.StructField("conflict_vector", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("vector_normalized", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("outcome_label", T.StringType()),
        T.StructField("dataset_source", T.StringType()),
        T.StructField("risk_score", T.DoubleType()),
        T.StructField("confirmed", T.BooleanType()),
    ]
)


def load_library(spark: SparkSession, path: str) -> DataFrame:
    """The library's rows; a missing folder is an empty library, broken lines are left out."""
    try:
        rows = spark.read.schema(LIBRARY_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException:
        return spark.createDataFrame([], LIBRARY_SCHEMA)
    return rows.where(F.col("vector_normalized").isNotNull())


def append_library(entries: DataFrame, path: str) -> None:
    """Adds rows; nothing already there is rewritten."""
    entries.select(*LIBRARY_SCHEMA.names).write.mode("append").json(path)


def write_report(metrics: DataFrame, path: str) -> None:
    """metrics: (metric, value) rows, few; one text file, a line each, in order of name."""
    metrics.orderBy("metric").select(F.format_string("%s: %s", "metric", F.col("value").cast("string"))).coalesce(1).write.mode("overwrite").text(path)


def describe(df: DataFrame) -> DataFrame:
    """(column, type, rows, missing): the shape of a table."""
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col("_n").alias("rows"), F.col(c).alias("missing")) for c, t in df.dtypes])
    return counts.select(F.inline(pairs))


def heatmap(matrix: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """A long matrix as a wide table for display; absent cells are 0."""
    return matrix.groupBy(row).pivot(column).agg(F.first(value)).na.fill(0.0).orderBy(row)


def density_curve(df: DataFrame, column: str, points: int = 50) -> DataFrame:
    """(x, density): a Gaussian kernel estimate on an even grid, bandwidth by Scott's rule, summed per grid point."""
    stats = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count(column).alias("n"), F.stddev_samp(column).alias("sd"))
    h = F.greatest(F.lit(1e-12), F.col("sd") * F.pow(F.col("n").cast("double"), -0.2))
    grid = stats.select("*", h.alias("h"), F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    grid = grid.withColumn("x", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (points - 1))
    spread = df.select(F.col(column).alias("v")).where("v is not null").join(F.broadcast(grid))  # `points` rows
    return spread.groupBy("x").agg((F.sum(F.exp(-0.5 * F.pow((F.col("x") - F.col("v")) / F.col("h"), 2))) / (F.first("n") * F.first("h") * 2.5066282746310002)).alias("density"))
