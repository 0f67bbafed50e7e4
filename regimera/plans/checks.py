"""Registered queries for sources and sinks, which write a table and scan it back, and for fitted models, whose results are told by what must hold of them.

A model's floats depend on its starts; that every point lies nearest to its own centre, that a criterion follows its
formula or that two tile sizes agree does not, and can be stated in SQL.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import distance
from ..operators import cluster, density, features, metrics, physics, retrieval
from ..sources import params, signals, store
from ..sources.shared import folder, settle
from . import tables as t
from .catalog import _MOTOR, q6, query, rounded


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """One small file in any store that Spark writes."""
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(context._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(content))
    out.close()


# Sources and sinks


_FOLDERS = ", ".join(f"({i}, '{kind}', {size})" for i, (_, kind, size) in enumerate(signals.FAULTS))


@query(f"""WITH f(i, fault_type, fault_diameter) AS (VALUES {_FOLDERS}), n AS (SELECT CAST(n_regionkey AS BIGINT) AS r, CAST(n_nationkey AS BIGINT) AS k FROM nation)
  SELECT 'run_' || (97 + r) || '.mat' AS source_file, CAST(count(*) AS BIGINT) AS samples, sum(CAST(k AS DOUBLE)) AS de_sum, CAST(CASE WHEN r % 2 = 0 THEN sum(2 * k) ELSE 0 END AS DOUBLE) AS fe_sum,
    any_value(fault_type) AS fault_type, any_value(fault_diameter) AS fault_diameter, CAST(CASE WHEN r < 4 THEN r ELSE -1 END AS INTEGER) AS load_hp FROM n JOIN f ON f.i = 2 * r GROUP BY r""")
def mat_scan(spark, sf_dir):
    """A level-5 MATLAB file for each region, in the folders of every other fault; odd ones have no fan end."""
    root, keys = fresh(spark, "mat"), {}
    for r in t.table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey").collect():  # 25 rows
        keys.setdefault(int(r[0]), []).append(float(r[1]))
    for r, k in keys.items():
        channels = {"X097_DE_time": k} | ({"X097_FE_time": [2 * x for x in k]} if r % 2 == 0 else {})
        write_bytes(spark, f"{root}/{signals.FAULTS[2 * r][0]}/run_{97 + r}.mat", signals.write_mat(channels))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    got = signals.vibration_signals(spark, root)
    return got.select("source_file", F.size("de").cast("long").alias("samples"), total("de").alias("de_sum"), total("fe").alias("fe_sum"), "fault_type", "fault_diameter", "load_hp")


def _cycle_lines(spark: SparkSession, sf_dir: str) -> str:
    """Orders as a table of engine cycles in text, without a header; a line too short is among them."""
    root = fresh(spark, "cycles")
    o = t.table(spark, sf_dir, "orders")
    values = [F.col("o_custkey").cast("int"), F.col("o_orderkey").cast("int")] + [(F.col("o_orderkey") % (7 + i)).cast("double") for i in range(24)]
    lines = o.select(F.concat_ws("  ", *[v.cast("string") for v in values]).alias("value"))
    lines.unionByName(spark.createDataFrame([("1 2 3",)], "value string")).write.text(f"{root}/train_FD001.txt")
    return root


@query("SELECT CAST(o_custkey AS INTEGER) AS unit_id, CAST(o_orderkey AS INTEGER) AS cycle, CAST(o_orderkey % 7 AS DOUBLE) AS op1, CAST(o_orderkey % 10 AS DOUBLE) AS s1, CAST(o_orderkey % 30 AS DOUBLE) AS s21 FROM orders")
def cycle_text_scan(spark, sf_dir):
    return signals.engine_cycles(spark, _cycle_lines(spark, sf_dir), "FD001", "train").select("unit_id", "cycle", "op1", "s1", "s21")


@query("SELECT CAST(o_custkey AS INTEGER) AS unit_id, CAST(count(*) AS BIGINT) AS cycles, sum(CAST(o_orderkey % 11 AS DOUBLE)) AS T24, sum(CAST(o_orderkey % 13 AS DOUBLE)) AS T50 FROM orders GROUP BY 1")
def sensor_groups(spark, sf_dir):
    """The thermal sensors of the cycle table under their names, by the index lists and the name map of the parameters."""
    cycles = signals.engine_cycles(spark, _cycle_lines(spark, sf_dir))
    got = signals.modality(cycles, ["unit_id", "cycle"], params.TURBOFAN, "thermal")
    return got.groupBy("unit_id").agg(F.count(F.lit(1)).alias("cycles"), F.sum("T24").alias("T24"), F.sum("T50").alias("T50"))


@query("SELECT CAST(row_number() OVER (ORDER BY n_nationkey) AS INTEGER) AS unit_id, CAST(n_nationkey * 3 + 1 AS INTEGER) AS rul FROM nation")
def remaining_life_scan(spark, sf_dir):
    path = fresh(spark, "rul") + "/RUL_FD001.txt"
    lines = t.table(spark, sf_dir, "nation").select((F.col("n_nationkey") * 3 + 1).alias("v")).orderBy("v").collect()  # 25 rows
    write_bytes(spark, path, "\n".join(str(r["v"]) for r in lines).encode() + b"\n")
    return signals.remaining_life_labels(spark, path)


@query("SELECT * FROM (VALUES ('thermal', 'T2'), ('thermal', 'T24'), ('thermal', 'T30'), ('thermal', 'T50'), ('pressure', 'P2'), ('pressure', 'P15'), ('pressure', 'P30'), ('mechanical', 'Nf'), ('mechanical', 'Nc'), ('mechanical', 'BPR')) AS v(modality, sensor)")
def parameter_scan(spark, sf_dir):
    """A parameter file in JSON, read back; its sensors by modality."""
    path = fresh(spark, "params") + "/turbofan.json"
    write_bytes(spark, path, json.dumps(params.TURBOFAN, indent=1).encode())
    groups = params.modality_columns(params.load(spark, path))
    return spark.createDataFrame([(m, s) for m, names in groups.items() for s in names], "modality string, sensor string")


@query(f"""WITH o AS (SELECT r_name AS outcome_label, CAST(count(*) AS DOUBLE) AS n, avg(CAST(n_nationkey AS DOUBLE)) / 25 AS risk FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1)
  SELECT outcome_label, 'orders' AS dataset_source, {q6('n', 'present')}, {q6('n / (n + 2.0 + 1e-10)', 'share')}, {q6('risk', 'risk')}, CAST(2 AS BIGINT) AS entries FROM o""")
def library_round_trip(spark, sf_dir):
    """Pattern entries appended twice to a library of JSON lines, beside a broken line, and loaded again."""
    path = fresh(spark, "library")
    n, r = t.table(spark, sf_dir, "nation"), t.table(spark, sf_dir, "region")
    modes = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("outcome_label"))
    modes = modes.agg(F.create_map(F.lit("a"), F.count(F.lit(1)).cast("double"), F.lit("b"), F.lit(2.0)).alias("conflict_vector"), (F.avg("n_nationkey") / 25).alias("risk_score"))
    entries = modes.select("conflict_vector", retrieval.normalise_map(F.col("conflict_vector")).alias("vector_normalized"), "outcome_label", F.lit("orders").alias("dataset_source"), "risk_score", F.lit(False).alias("confirmed"))
    store.append_library(entries, path)
    store.append_library(entries, path)
    write_bytes(spark, f"{path}/part-broken.json", b"{broken\n")
    got = store.load_library(spark, path).groupBy("outcome_label", "dataset_source")
    return rounded(got.agg(F.max(F.col("conflict_vector")["a"]).alias("present"), F.max(F.col("vector_normalized")["a"]).alias("share"), F.max("risk_score").alias("risk"), F.count(F.lit(1)).alias("entries")))


@query("SELECT r_name || ': ' || CAST(r_regionkey AS VARCHAR) AS line FROM region")
def text_report(spark, sf_dir):
    path = fresh(spark, "report")
    store.write_report(t.table(spark, sf_dir, "region").select(F.col("r_name").alias("metric"), F.col("r_regionkey").alias("value")), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("""SELECT 'o_orderkey' AS "column", count(*) AS rows, count(*) - count(o_orderkey) AS missing FROM orders UNION ALL SELECT 'o_orderstatus', count(*), count(*) - count(o_orderstatus) FROM orders
  UNION ALL SELECT 'late', count(*), count(*) - count(CASE WHEN o_orderkey % 3 = 0 THEN 1 END) FROM orders""")
def table_summary(spark, sf_dir):
    o = t.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, 1).alias("late"))
    return store.describe(o).select("column", "rows", "missing")


# Proxies, predicates and lists of modes


@query(f"""WITH p AS (SELECT CAST(p_size AS BIGINT) AS mode_id, avg(p_retailprice) / 1000 - 1 AS z, avg(p_partkey) / 1000 - 0.1 AS y FROM part GROUP BY 1)
  SELECT mode_id, {q6('abs(z)', 'vibration_rms')}, {q6('y * 10 + 40', 'temperature')}, {q6('abs(y) * 2 + 1', 'current')}, {q6('CAST(0.5 AS DOUBLE)', 'thermal_rate')}, {q6('CAST(0.84 AS DOUBLE)', 'efficiency')} FROM p""")
def motor_proxies(spark, sf_dir):
    z = t.table(spark, sf_dir, "part").groupBy(F.col("p_size").cast("long").alias("mode_id")).agg((F.avg("p_retailprice") / 1000 - 1).alias("de_rms"), (F.avg("p_partkey") / 1000 - 0.1).alias("de_mean"))
    q = physics.motor_proxies(z, params.MOTOR, "de_rms", "de_mean", None)
    return rounded(q.select("mode_id", *[F.col("q")[c].alias(c) for c in ("vibration_rms", "temperature", "current", "thermal_rate", "efficiency")]))


@query(f"{_MOTOR} SELECT mode_id, temperature <= lim + 5.0 AS allowed FROM r")
def candidate_predicate(spark, sf_dir):
    return t.motor_centroids(spark, sf_dir).select("mode_id", physics.sample_allowed(F.col("q"), params.MOTOR).alias("allowed"))


@query(f"{_MOTOR} SELECT mode_id, CASE WHEN vv THEN 'fault' ELSE 'infeasible' END AS kind FROM r WHERE vv OR vj OR vt OR ve OR vc")
def synthesis_modes(spark, sf_dir):
    """The modes that synthetic samples are drawn for."""
    return physics.synthesis_modes(physics.filter_modes(t.motor_centroids(spark, sf_dir), params.MOTOR))


@query("SELECT l_returnflag, CAST(count(*) AS BIGINT) AS outside FROM lineitem WHERE l_quantity < 5 OR l_quantity > 45 OR l_discount > 0.09 GROUP BY 1")
def out_of_range(spark, sf_dir):
    li = t.table(spark, sf_dir, "lineitem")
    return li.where(features.outside({"l_quantity": (5, 45), "l_discount": (None, 0.09)})).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("outside"))


@query("SELECT CAST(count(*) AS BIGINT) AS rows, CAST(6 AS BIGINT) AS regimes, true AS nearest FROM lineitem")
def regime_cells(spark, sf_dir):
    """Settings of more than six values: six k-means cells, and (up to the last step of the fit) each row in the nearest."""
    li = t.table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 100).alias("a"), (F.col("l_tax") * 100).alias("b"))
    cells = settle(features.regimes(li, ["a", "b"]), "regime-cells")
    return _own_cell(cells.select("regime", F.array("a", "b").alias("v")), "regime").select("rows", F.col("cells").alias("regimes"), "nearest")


# Fitted models


def _own_cell(rows: DataFrame, label: str) -> DataFrame:
    """(rows, cells, nearest): whether nearly all rows lie nearest to the mean of their own cell. Means are a row for each cell."""
    named = rows.select(F.col(label).cast("int").alias("label"), F.col("v").cast("array<double>").alias("v"))
    means = metrics.centroids(named, "label", "v").groupBy().agg(F.collect_list(F.struct("label", "centroid")).alias("all"))
    away = F.transform("all", lambda m: F.struct(distance(F.col("v"), m["centroid"]).alias("d"), m["label"].alias("m")))
    own = F.array_min(F.transform(F.filter(away, lambda x: x["m"] == F.col("label")), lambda x: x["d"]))
    met = named.crossJoin(F.broadcast(means)).select(F.size("all").alias("cells"), (own <= F.array_min(F.transform(away, lambda x: x["d"])) * 1.05 + 1e-9).alias("ok"))
    return met.agg(F.count(F.lit(1)).alias("rows"), F.max("cells").cast("long").alias("cells"), (F.avg(F.col("ok").cast("double")) >= 0.98).alias("nearest"))


@query("SELECT CAST(count(*) AS BIGINT) AS rows, CAST(5 AS BIGINT) AS cells, true AS nearest FROM embeddings")
def kmeans_cells(spark, sf_dir):
    return _own_cell(settle(cluster.kmeans_labels(t.points(spark, sf_dir).select("vec_id", "v"), "v", 5), "kmeans-cells"), "label")


@query("SELECT * FROM (VALUES (2, true, true), (3, true, true)) AS v(k, below_one_cell, marked)")
def kmeans_scan_facts(spark, sf_dir):
    """Inertia is below the spread about one mean, and the highest silhouette is the one marked."""
    p = t.points(spark, sf_dir)
    scan = settle(cluster.kmeans_scan(p, "vec_id", "v", k_max=3, restarts=2), "kmeans-facts")
    top = scan.agg(F.max("silhouette").alias("top"))
    mean = metrics.centroids(p.withColumn("label", F.lit(0)), "label", "v").select("centroid")
    one = p.crossJoin(F.broadcast(mean)).agg(F.sum(F.pow(distance(F.col("v"), F.col("centroid")), 2)).alias("one"))  # one row each
    return scan.crossJoin(F.broadcast(top)).crossJoin(F.broadcast(one)).select("k", (F.col("inertia") < F.col("one")).alias("below_one_cell"), (F.col("best") == (F.col("silhouette") == F.col("top"))).alias("marked"))


@query("SELECT * FROM (VALUES (2, true, true, true), (3, true, true, true)) AS v(k, bic_holds, aic_holds, marked)")
def mixture_scan_facts(spark, sf_dir):
    """The criteria follow their formulas from the likelihood, and the lowest one is marked."""
    p = t.points(spark, sf_dir)
    n, d = p.count(), 64
    scan = settle(cluster.mixture_scan(p, "v", k_max=3, iterations=3, restarts=1), "mixture-facts")
    free = F.col("k") * d + F.col("k") * d * (d + 1) / 2 + F.col("k") - 1
    close = lambda a, b: F.abs(a - b) <= 1e-6 * F.greatest(F.lit(1.0), F.abs(b))
    low = scan.agg(F.min("bic").alias("low"))
    return scan.crossJoin(F.broadcast(low)).select(
        "k", close(F.col("bic"), free * F.log(F.lit(float(n))) - 2 * F.col("log_likelihood")).alias("bic_holds"),
        close(F.col("aic"), 2 * free - 2 * F.col("log_likelihood")).alias("aic_holds"), (F.col("best") == (F.col("bic") == F.col("low"))).alias("marked"),
    )


@query("""SELECT label, CAST(count(*) AS BIGINT) AS rows, CAST(CASE WHEN label IN (1, 4, 7) THEN 2 ELSE 1 END AS BIGINT) AS parts, CAST(CASE label WHEN 1 THEN top + 1 WHEN 4 THEN top + 3 WHEN 7 THEN top + 5 ELSE label END AS INTEGER) AS first
  FROM (SELECT CAST(label AS INTEGER) AS label, max(CAST(label AS INTEGER)) OVER () AS top FROM embeddings) GROUP BY label, top""")
def split_parts(spark, sf_dir):
    p = t.points(spark, sf_dir)
    c = metrics.centroids(p, "label", "v").select(F.col("label").alias("mode_id"), "centroid")
    got = cluster.refine(p, "vec_id", "v", "label", c, [1, 4, 7], "split")
    return got.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("refined").alias("parts"), F.min("refined").cast("int").alias("first"))


@query("SELECT m AS modality, CAST(count(*) AS BIGINT) AS rows, true AS large, true AS bounded FROM embeddings, (VALUES ('current'), ('vibration')) AS v(m) GROUP BY 1")
def density_facts(spark, sf_dir):
    """Every row of a modality is labelled, clusters have the least size or more, memberships and outlier scores lie in [0, 1]."""
    p = t.points(spark, sf_dir)
    both = p.withColumn("modality", F.lit("vibration")).unionByName(p.withColumn("modality", F.lit("current")))
    got = settle(density.density_modes(both, "vec_id", "v", "modality", min_size=15), "density-facts")
    sizes = got.groupBy("modality", "label").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("prob").between(0, 1) & F.col("outlier").between(0, 1)).alias("ok"))
    return sizes.groupBy("modality").agg(F.sum("n").alias("rows"), F.bool_and((F.col("label") == -1) | (F.col("n") >= 15)).alias("large"), F.bool_and("ok").alias("bounded"))


@query("SELECT true AS in_range, true AS same_in_any_tiles")
def density_validity_facts(spark, sf_dir):
    p = t.points(spark, sf_dir)
    one, many = (density.density_validity(p, "v", "label", size=s).select(F.col("dbcv").alias(f"d{s}")) for s in (1024, 128))
    return one.crossJoin(many).select(F.col("d1024").between(-1, 1).alias("in_range"), (F.abs(F.col("d1024") - F.col("d128")) < 1e-9).alias("same_in_any_tiles"))


@query("SELECT CAST(100 AS BIGINT) AS samples, true AS allowed, true AS whole")
def synthesis_facts(spark, sf_dir):
    """Accepted samples meet the predicate; all have every component."""
    got = cluster.bounded_samples(t.points(spark, sf_dir).where("label = 1"), "vec_id", "v", 100, lambda v: F.get(v, 0) <= 0.15)
    return got.agg(F.count(F.lit(1)).alias("samples"), F.bool_and(~F.col("accepted") | (F.get("v", 0) <= 0.15)).alias("allowed"), F.bool_and(F.size("v") == 64).alias("whole"))


@query("SELECT CAST(count(*) AS BIGINT) AS rows, true AS small, true AS centred, true AS same_on_any_partitions FROM events")
def jitter_facts(spark, sf_dir):
    """Noise of the asked scale around each value, the same however the rows are dealt."""
    c = t.cycles(spark, sf_dir).select("event_id", "value")
    one, two = (cluster.jitter(x, ["value"], 0.01, key=["event_id"]).withColumnRenamed("value", n) for x, n in ((c, "a"), (c.repartition(7), "b")))
    met = c.join(one, "event_id").join(two, "event_id")
    noise = F.col("a") - F.col("value")
    return met.agg(F.count(F.lit(1)).alias("rows"), (F.max(F.abs(noise)) < 0.08).alias("small"), (F.abs(F.avg(noise)) < 0.001).alias("centred"), F.bool_and(F.col("a") == F.col("b")).alias("same_on_any_partitions"))


@query("SELECT CAST(count(*) AS BIGINT) AS rows, true AS ordered, true AS uncorrelated FROM embeddings")
def pca_facts(spark, sf_dir):
    got = cluster.pca(t.points(spark, sf_dir), "v").select(F.get("latent", 0).alias("x"), F.get("latent", 1).alias("y"))
    return got.agg(F.count(F.lit(1)).alias("rows"), (F.var_pop("x") >= F.var_pop("y")).alias("ordered"), (F.abs(F.corr("x", "y")) < 1e-6).alias("uncorrelated"))

