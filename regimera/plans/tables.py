"""How the test tables play the roles of sensor tables: cycles, windows, votes, centroids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Risk of each event type when it plays a mode.
RISK = {"click": 0.1, "view": 0.3, "purchase": 0.55, "signup": 0.7, "error": 0.9}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit_id, cycle, value, k, mode): events as per-cycle rows, a unit for each user."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        F.col("user_id").alias("unit_id"), F.row_number().over(w).cast("long").alias("cycle"), F.col("value").cast("double").alias("value"),
        F.get_json_object("props", "$.k").cast("double").alias("k"), F.col("event_type").alias("mode"), "event_id",
    )


CYCLES_SQL = """SELECT user_id AS unit_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS cycle, value,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, event_type AS mode, event_id FROM events"""


def risk_of(mode: str = "mode"):
    """A risk for each mode name, from its length: deterministic and in (0, 1)."""
    return F.length(mode) / 10.0


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, v, label): the whole embeddings."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("int").alias("label"))


POINTS_SQL = "SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings"


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, modality, label, prob): three labelings of the embeddings, two of them with noise."""
    e = table(spark, sf_dir, "embeddings")
    i = F.col("vec_id")
    rows = F.array(
        F.struct(F.lit("vibration").alias("modality"), F.col("label").cast("int").alias("label"), ((i * 37) % 101 / 100.0).alias("prob")),
        F.struct(F.lit("current").alias("modality"), ((i * 7) % 5 - 1).cast("int").alias("label"), ((i * 53) % 97 / 96.0).alias("prob")),
        F.struct(F.lit("temperature").alias("modality"), (i % 4 - 1).cast("int").alias("label"), ((i * 71) % 89 / 88.0).alias("prob")),
    )
    return e.select(i.alias("row_id"), F.inline(rows))


VOTES_SQL = """SELECT vec_id AS row_id, 'vibration' AS modality, 0 AS ord, CAST(label AS INTEGER) AS label, (vec_id * 37) % 101 / 100.0 AS prob FROM embeddings
  UNION ALL SELECT vec_id, 'current', 1, CAST((vec_id * 7) % 5 - 1 AS INTEGER), (vec_id * 53) % 97 / 96.0 FROM embeddings
  UNION ALL SELECT vec_id, 'temperature', 2, CAST(vec_id % 4 - 1 AS INTEGER), (vec_id * 71) % 89 / 88.0 FROM embeddings"""


def motor_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mode_id, q): a centroid for each part size, from averages of its line items."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    g = li.join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_size").cast("long").alias("mode_id"))
    a = g.agg(F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"), F.avg("l_extendedprice").alias("e"))
    m = {
        "temperature": F.col("q") * 1.4 + F.col("mode_id") % 7, "current": F.col("q") / 10 + F.col("mode_id") % 3, "vibration_rms": F.col("d") * 8 + F.col("mode_id") % 5 / 20.0,
        "thermal_rate": F.col("t") * 30 + F.col("mode_id") % 4 * 0.5, "efficiency": F.lit(0.8) + F.col("mode_id") % 6 * 0.02, "correlation_I_T": F.lit(0.3) + F.col("mode_id") % 8 * 0.05,
    }
    return a.select("mode_id", F.create_map(*[x for k, v in m.items() for x in (F.lit(k), v.cast("double"))]).alias("q"))


MOTOR_SQL = """SELECT mode_id, q * 1.4 + mode_id % 7 AS temperature, q / 10 + mode_id % 3 AS current, d * 8 + mode_id % 5 / 20.0 AS vibration,
  t * 30 + mode_id % 4 * 0.5 AS thermal_rate, 0.8 + mode_id % 6 * 0.02 AS efficiency, 0.3 + mode_id % 8 * 0.05 AS correlation
  FROM (SELECT CAST(p_size AS BIGINT) AS mode_id, avg(l_quantity) AS q, avg(l_discount) AS d, avg(l_tax) AS t FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)"""


def engine_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mode_id, q): a centroid for each nation, from averages of its customers' orders."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    a = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").cast("long").alias("mode_id")).agg(F.avg("o_totalprice").alias("p"), F.avg("c_acctbal").alias("b"))
    i = F.col("mode_id")
    m = {"Nf": F.lit(2200.0) + i % 6 * 90 + F.col("b") / 1000, "Nc": F.lit(8600.0) + i % 5 * 150, "T50": F.lit(1350.0) + i % 7 * 50 + F.col("p") / 100000, "correlation_fuel_T50": F.lit(0.35) + i % 4 * 0.08}
    return a.select("mode_id", F.create_map(*[x for k, v in m.items() for x in (F.lit(k), v.cast("double"))]).alias("q"))


ENGINE_SQL = """SELECT mode_id, 2200.0 + mode_id % 6 * 90 + b / 1000 AS nf, 8600.0 + mode_id % 5 * 150 AS nc, 1350.0 + mode_id % 7 * 50 + p / 100000 AS t50, 0.35 + mode_id % 4 * 0.08 AS correlation
  FROM (SELECT CAST(c_nationkey AS BIGINT) AS mode_id, avg(o_totalprice) AS p, avg(c_acctbal) AS b FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)"""


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events with odd and with even ids as two samples of (mode, value, k)."""
    c = cycles(spark, sf_dir).select("event_id", "mode", "value", "k")
    scaled = F.when(F.col("event_id") % 2 == 0, F.col("value") * 1.1 + 1).otherwise(F.col("value")).alias("value")
    c = c.select("event_id", "mode", scaled, "k")
    return c.where("event_id % 2 = 1"), c.where("event_id % 2 = 0")


HALVES_SQL = f"""x AS (SELECT mode, value, k FROM ({CYCLES_SQL}) WHERE event_id % 2 = 1),
  y AS (SELECT mode, value * 1.1 + 1 AS value, k FROM ({CYCLES_SQL}) WHERE event_id % 2 = 0)"""
