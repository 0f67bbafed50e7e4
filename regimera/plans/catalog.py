"""Registered queries over the test tables and the DuckDB SQL that states the same result.

Doubles are rounded to six places on both sides, as engines add in different orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import r6, text2
from ..operators import causal, cluster, consensus, density, features, metrics, physics, retrieval, temporal, tiles, windows
from ..sources import params, signals
from . import tables as t

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
UNIT, ORDER = ["unit_id"], ["cycle"]


def query(oracle: str | None = None):
    """Registers a function under its name, with its oracle."""

    def keep(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return keep


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(F.col(c)).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def q6(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"


EV = f"ev AS ({t.CYCLES_SQL})"
RISK_SQL = "CASE mode WHEN 'click' THEN 0.1 WHEN 'view' THEN 0.3 WHEN 'purchase' THEN 0.55 WHEN 'signup' THEN 0.7 ELSE 0.9 END"


def _risky(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t.cycles(spark, sf_dir)
    exact = lambda x: F.lit(str(x)).cast("decimal(3,2)")  # noqa: E731  as SQL reads such numbers
    risk = exact(t.RISK["error"])
    for name, value in t.RISK.items():
        risk = F.when(F.col("mode") == name, exact(value)).otherwise(risk)
    return c.withColumn("risk", risk)


# Windows and features


_W30 = "OVER (PARTITION BY unit_id ORDER BY cycle ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"


@query(f"""WITH {EV}, w AS (SELECT unit_id, cycle, row_number() OVER (PARTITION BY unit_id ORDER BY cycle) AS n,
  lag(cycle, 14) OVER (PARTITION BY unit_id ORDER BY cycle) AS c, avg(value) {_W30} AS m, stddev_pop(value) {_W30} AS s, regr_slope(value, cycle) {_W30} AS b,
  max(value) {_W30} - min(value) {_W30} AS r, quantile_cont(value, 0.75) {_W30} - quantile_cont(value, 0.25) {_W30} AS q FROM ev)
  SELECT unit_id, c AS cycle, {q6('m', 'signal_value_mean')}, {q6('s', 'signal_value_std')}, {q6('CASE WHEN s > 1e-12 THEN b ELSE 0 END', 'signal_value_slope')},
  {q6('r', 'signal_value_range')}, {q6('q', 'signal_value_iqr')} FROM w WHERE n >= 30""")
def rolling_stats(spark, sf_dir):
    return rounded(features.rolling(t.cycles(spark, sf_dir), UNIT, "cycle", {"signal": ["value"]}))


@query(f"""WITH {EV}, w AS (SELECT unit_id, row_number() OVER (PARTITION BY unit_id ORDER BY cycle) AS n, lag(cycle, 14) OVER (PARTITION BY unit_id ORDER BY cycle) AS c,
  avg(value * k) {_W30} AS xy, avg(value) {_W30} AS x, avg(k) {_W30} AS y, stddev_pop(value) {_W30} AS sx, stddev_pop(k) {_W30} AS sy FROM ev)
  SELECT unit_id, c AS cycle, {q6('coalesce((xy - x * y) / nullif(sx * sy, 0), 0)', 'correlation')} FROM w WHERE n >= 30""")
def rolling_intra_corr(spark, sf_dir):
    got = features.rolling(t.cycles(spark, sf_dir), UNIT, "cycle", {"signal": ["value", "k"]})
    return rounded(got.select("unit_id", "cycle", F.col("signal_avg_intra_correlation").alias("correlation")))


_CROSS = f"""WITH {EV}, f AS (SELECT unit_id, cycle, row_number() OVER (PARTITION BY unit_id ORDER BY cycle) AS n, lag(cycle, 14) OVER (PARTITION BY unit_id ORDER BY cycle) AS c,
  avg(value) {_W30} AS a, avg(k) {_W30} AS b FROM ev), g AS (SELECT unit_id, c AS cycle, a, b FROM f WHERE n >= 30)
  SELECT unit_id, cycle, {q6('a * b', 'cross_signal_load_product')},
  {q6('coalesce(a - lag(a) OVER w, 0) * coalesce(b - lag(b) OVER w, 0)', 'cross_signal_load_diff_product')} FROM g"""


def _rolled(spark, sf_dir):
    return features.rolling(t.cycles(spark, sf_dir), UNIT, "cycle", {"signal": ["value"], "load": ["k"]})


@query(_CROSS + " WINDOW w AS (PARTITION BY unit_id ORDER BY cycle)")
def cross_modal_features(spark, sf_dir):
    return rounded(features.cross_modal(_rolled(spark, sf_dir), UNIT, "cycle", ["signal", "load"]))


@query(_CROSS + " WINDOW w AS (ORDER BY unit_id, cycle)")
def cross_modal_across_units(spark, sf_dir):
    return rounded(features.cross_modal(_rolled(spark, sf_dir), UNIT, "cycle", ["signal", "load"], across_units=True))


@query(f"""WITH {EV}, raw AS (SELECT unit_id, cycle, CASE WHEN CAST(k AS BIGINT) % 7 <> 0 THEN value END AS x FROM ev),
  f AS (SELECT unit_id, cycle, last_value(x IGNORE NULLS) OVER (PARTITION BY unit_id ORDER BY cycle ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a,
    first_value(x IGNORE NULLS) OVER (PARTITION BY unit_id ORDER BY cycle ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM raw),
  i AS (SELECT unit_id, cycle, coalesce(a, b, (SELECT avg(x) FROM raw), 0) AS x FROM f), z AS (SELECT unit_id, cycle, (x - (SELECT avg(x) FROM i)) / (SELECT stddev_samp(x) FROM i) AS z FROM i),
  q AS (SELECT quantile_cont(z, 0.25) AS l, quantile_cont(z, 0.75) AS h FROM z)
  SELECT unit_id, cycle, {q6('least(greatest(z, greatest(l - 1.5 * (h - l), -3.0)), least(h + 1.5 * (h - l), 3.0))', 'x')} FROM z, q""")
def impute_zscore_clip(spark, sf_dir):
    c = t.cycles(spark, sf_dir).select("unit_id", "cycle", F.when(F.col("k").cast("long") % 7 != 0, F.col("value")).alias("x"))
    return rounded(features.preprocess(c, ["x"], ORDER, UNIT))


@query(f"WITH {EV} SELECT unit_id, cycle, {q6('value', 'value')}, {q6('k', 'k')} FROM ev")
def denormalise_roundtrip(spark, sf_dir):
    c = t.cycles(spark, sf_dir).select("unit_id", "cycle", "value", "k")
    stats = features.scaler(c, ["value", "k"])
    return rounded(features.denormalise(features.zscore(c, ["value", "k"], stats), ["value", "k"], stats))


_AMEAN = "list_sum(a) / len(a)"
_TIME = """WITH e AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS a FROM embeddings), u AS (SELECT vec_id, unnest(a) AS x, unnest(range(1, len(a) + 1)) AS i FROM e),
  m AS (SELECT vec_id, count(*) AS n, avg(x) AS m1, avg(x * x) AS s2, max(abs(x)) AS pk, max(x) - min(x) AS rg, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iq FROM u GROUP BY 1),
  c AS (SELECT vec_id, n, m1, s2, pk, rg, iq, avg(power(x - m1, 2)) AS c2, avg(power(x - m1, 3)) AS c3, avg(power(x - m1, 4)) AS c4 FROM u JOIN m USING (vec_id) GROUP BY ALL),
  p AS (SELECT vec_id, i, x, x - m1 AS d, lag(x - m1) OVER (PARTITION BY vec_id ORDER BY i) AS dp, lag(x) OVER (PARTITION BY vec_id ORDER BY i) AS xp FROM u JOIN m USING (vec_id)),
  z AS (SELECT vec_id, sum(CASE WHEN dp IS NOT NULL AND sign(d) <> sign(dp) THEN 1 ELSE 0 END) AS zc, avg(CASE WHEN xp IS NOT NULL THEN x * xp END) AS xy, avg(CASE WHEN xp IS NOT NULL THEN x END) AS y,
    avg(xp) AS xx, stddev_pop(CASE WHEN xp IS NOT NULL THEN x END) AS sy, stddev_pop(xp) AS sx FROM p GROUP BY 1)"""


@query(f"""{_TIME} SELECT vec_id, {q6('sqrt(s2)', 'w_rms')}, {q6('pk', 'w_peak')}, {q6('pk / sqrt(s2)', 'w_crest_factor')}, {q6('c3 / power(c2, 1.5)', 'w_skewness')}, {q6('c4 / (c2 * c2) - 3', 'w_kurtosis')},
  {q6('m1', 'w_mean')}, {q6('c2', 'w_variance')}, {q6('rg', 'w_range')}, {q6('iq', 'w_iqr')}, {q6('zc / CAST(n AS DOUBLE)', 'w_zero_crossing_rate')},
  {q6('coalesce((xy - xx * y) / nullif(sx * sy, 0), 0)', 'w_autocorrelation_lag1')} FROM c JOIN z USING (vec_id)""")
def array_time_features(spark, sf_dir):
    e = t.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("w"))
    got = features.vibration(e, ["vec_id"], ["w"])
    names = ["rms", "peak", "crest_factor", "skewness", "kurtosis", "mean", "variance", "range", "iqr", "zero_crossing_rate", "autocorrelation_lag1"]
    return rounded(got.select("vec_id", *[f"w_{n}" for n in names]))


_SPECTRUM = """WITH u AS (SELECT vec_id, unnest([CAST(x AS DOUBLE) FOR x IN embedding]) AS x, unnest(range(0, 64)) AS j FROM embeddings), b AS (SELECT unnest(range(1, 33)) AS k),
  d AS (SELECT vec_id, k, sqrt(power(sum(x * cos(2 * pi() * j * k / 64.0)), 2) + power(sum(x * sin(2 * pi() * j * k / 64.0)), 2)) AS m FROM u, b GROUP BY 1, 2),
  s AS (SELECT vec_id, k, m, m * m / sum(m * m) OVER (PARTITION BY vec_id) AS p, row_number() OVER (PARTITION BY vec_id ORDER BY m DESC, k DESC) AS r FROM d)"""


@query(f"""{_SPECTRUM} SELECT vec_id, {q6('max(CASE WHEN r = 1 THEN k * 187.5 END)', 'w_dominant_freq')}, {q6('sum(k * 187.5 * p)', 'w_spectral_centroid')}, {q6('-sum(p * log2(p))', 'w_spectral_entropy')},
  {', '.join(q6(f'max(CASE WHEN r = {i + 1} THEN k * 187.5 END)', f'w_harmonic_{i}_freq') + ', ' + q6(f'max(CASE WHEN r = {i + 1} THEN m END)', f'w_harmonic_{i}_mag') for i in range(5))} FROM s GROUP BY 1""")
def spectral_features(spark, sf_dir):
    e = t.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("w"))
    got = features.vibration(e, ["vec_id"], ["w"])
    return rounded(got.select("vec_id", *[c for c in got.columns if any(x in c for x in ("freq", "centroid", "entropy", "harmonic"))]))


@query(f"""WITH s AS (SELECT vec_id, embedding, unnest(range(0, 49, 8)) AS start FROM embeddings)
  SELECT vec_id, CAST(start / 8 AS BIGINT) AS window_id, CAST(start AS BIGINT) AS start, {q6('list_sum([CAST(x AS DOUBLE) FOR x IN embedding[start + 1:start + 16]])', 'total')} FROM s""")
def array_windows(spark, sf_dir):
    e = t.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("samples"))
    got = windows.array_windows(e, "samples", 16, 0.5)
    return rounded(got.select("vec_id", "window_id", F.col("start").cast("long").alias("start"), F.aggregate("samples", F.lit(0.0), lambda a, x: a + x).alias("total")))


# Sequences of modes


_PAIRS = f"WITH {EV}, p AS (SELECT mode AS a, lead(mode) OVER (PARTITION BY unit_id ORDER BY cycle) AS b FROM ev), c AS (SELECT a, b, count(*) AS n FROM p WHERE b IS NOT NULL GROUP BY 1, 2), m AS (SELECT a, b, n, n / CAST(sum(n) OVER (PARTITION BY a) AS DOUBLE) AS p FROM c)"
_RUNS = f"""WITH {EV}, f AS (SELECT unit_id, cycle, mode, CASE WHEN lag(mode) OVER (PARTITION BY unit_id ORDER BY cycle) = mode THEN 0 ELSE 1 END AS nw FROM ev),
  g AS (SELECT unit_id, cycle, mode, sum(nw) OVER (PARTITION BY unit_id ORDER BY cycle) AS run FROM f), r AS (SELECT unit_id, run, any_value(mode) AS mode, count(*) AS len FROM g GROUP BY 1, 2)"""


@query(f"{_PAIRS} SELECT a AS from_mode, b AS to_mode, n, {q6('p', 'p')} FROM m")
def transition_matrix(spark, sf_dir):
    return rounded(temporal.transition_matrix(t.cycles(spark, sf_dir), UNIT, ORDER, "mode"))


@query(f"{_RUNS} SELECT mode, count(*) AS runs, {q6('avg(len)', 'mean_length')} FROM r GROUP BY 1")
def run_durations(spark, sf_dir):
    return rounded(temporal.mean_durations(t.cycles(spark, sf_dir), UNIT, ORDER, "mode"))


@query(f"""{_RUNS}, s AS (SELECT mode AS g0, lead(mode, 1) OVER (PARTITION BY unit_id ORDER BY run) AS g1, lead(mode, 2) OVER (PARTITION BY unit_id ORDER BY run) AS g2, count(*) OVER (PARTITION BY unit_id) AS c FROM r)
  SELECT g0, g1, g2, count(*) AS n FROM s WHERE g2 IS NOT NULL AND c > 3 GROUP BY 1, 2, 3 ORDER BY n DESC, g0, g1, g2 LIMIT 5""")
def ngram_top5(spark, sf_dir):
    return temporal.top_sequences(t.cycles(spark, sf_dir), UNIT, ORDER, "mode")


@query(f"{_PAIRS}, h AS (SELECT a, sum(-p * log2(p)) AS h FROM m GROUP BY 1), o AS (SELECT mode AS a, count(*) AS c FROM ev GROUP BY 1) SELECT {q6('sum(c * coalesce(h, 0)) / sum(c)', 'transition_entropy')} FROM o LEFT JOIN h USING (a)")
def transition_entropy(spark, sf_dir):
    return rounded(temporal.transition_entropy(t.cycles(spark, sf_dir), UNIT, ORDER, "mode"))


@query(f"{_PAIRS} SELECT {q6('sum(CASE WHEN p > 0 AND p < 0.2 THEN n ELSE 0 END) / CAST(greatest(1, sum(n)) AS DOUBLE)', 'rare_transition_rate')} FROM m WHERE a <> b")
def rare_transitions(spark, sf_dir):
    return rounded(temporal.rare_transition_rate(t.cycles(spark, sf_dir), UNIT, ORDER, "mode", below=0.2))


@query(f"{_PAIRS} SELECT {q6('sum(CASE WHEN a = b THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE)', 'stability_index')} FROM m")
def stability_index(spark, sf_dir):
    return rounded(temporal.stability_index(t.cycles(spark, sf_dir), UNIT, ORDER, "mode"))


def _imdti(window: int, clipped: bool) -> str:
    w = f"OVER (PARTITION BY unit_id ORDER BY cycle ROWS BETWEEN {window} PRECEDING AND 1 PRECEDING)"
    kinds = list(t.RISK)
    counts = ", ".join(f"sum(CASE WHEN mode = '{k}' THEN 1 ELSE 0 END) {w} AS c{i}, min(CASE WHEN mode = '{k}' THEN cycle END) {w} AS f{i}" for i, k in enumerate(kinds))
    h = " + ".join(f"CASE WHEN c{i} > 0 THEN -(c{i} / {window}.0) * ln(c{i} / {window}.0 + 1e-10) ELSE 0 END" for i in range(5))
    best = f"greatest({', '.join(f'c{i} * 1000000 - coalesce(f{i}, 0)' for i in range(5))})"
    dom = "CASE " + " ".join(f"WHEN c{i} * 1000000 - coalesce(f{i}, 0) = {best} THEN '{k}'" for i, k in enumerate(kinds)) + " END"
    op = ">= 0.6" if clipped else "> 0.5"
    clip = (lambda e: f"least(1.0, greatest(0.0, {e}))") if clipped else (lambda e: e)
    value = clip(f"0.5 * {clip('ar')} + 0.25 * {clip('h / ln(5 + 1e-10)')} + 0.25 * dw")
    return f"""WITH {EV}, k AS (SELECT unit_id, cycle, mode, {RISK_SQL} AS risk FROM ev),
  w AS (SELECT unit_id, row_number() OVER (PARTITION BY unit_id ORDER BY cycle) - 1 AS t, avg(risk) {w} AS ar, avg(CASE WHEN risk {op} THEN 1.0 ELSE 0.0 END) {w} AS dw, {counts} FROM k),
  d AS (SELECT unit_id, t, ar, dw, {h} AS h, {dom} AS dom FROM w WHERE t >= {window}), j AS (SELECT unit_id, t, {value} AS imdti, ar, h, dw, dom FROM d)"""


@query(_imdti(10, False) + f" SELECT unit_id, t, {q6('imdti', 'imdti')}, {q6('ar', 'avg_risk')}, {q6('h', 'entropy')}, {q6('dw', 'dwell')}, dom AS dominant_mode FROM j")
def imdti_trajectory(spark, sf_dir):
    return rounded(temporal.degradation(_risky(spark, sf_dir), UNIT, ORDER, "mode", "risk", 10, 5, known=list(t.RISK)))


@query(_imdti(20, True) + f" SELECT {q6('avg(imdti)', 'imdti')} FROM j")
def imdti_clipped_mean(spark, sf_dir):
    got = temporal.degradation(_risky(spark, sf_dir), UNIT, ORDER, "mode", "risk", 20, 5, clipped=True, high=0.6, known=list(t.RISK))
    return rounded(got.agg(F.coalesce(F.avg("imdti"), F.lit(0.0)).alias("imdti")))


@query(_imdti(10, False) + f""", x AS (SELECT unit_id, imdti, t, CAST(row_number() OVER (PARTITION BY unit_id ORDER BY t) - 1 AS DOUBLE) AS x, row_number() OVER (PARTITION BY unit_id ORDER BY t DESC) AS r FROM j),
  f AS (SELECT unit_id, count(*) AS points, regr_slope(imdti, x) AS m, regr_intercept(imdti, x) AS b, max(x) AS l FROM x GROUP BY 1),
  s AS (SELECT unit_id, CASE WHEN count(*) >= 50 THEN regr_slope(imdti, x) ELSE 0 END AS dr FROM x WHERE r <= 50 GROUP BY 1)
  SELECT unit_id, points, {q6('dr', 'degradation_rate')}, CASE WHEN points >= 10 THEN CASE WHEN m <= 0 THEN 'inf' ELSE CAST(round(greatest(0.0, (0.85 - b) / m - l), 2) AS VARCHAR) END END AS rul FROM f JOIN s USING (unit_id)""")
def degradation_summary(spark, sf_dir):
    got = temporal.remaining_life(temporal.degradation(_risky(spark, sf_dir), UNIT, ORDER, "mode", "risk", 10, 5, known=list(t.RISK)), UNIT)
    return got.select("unit_id", "points", r6(F.col("degradation_rate")).alias("degradation_rate"), text2(F.col("rul")).alias("rul"))


_EDGES = f"""WITH {EV}, v AS (SELECT unit_id, cycle, 'high_value' AS e FROM ev WHERE value > 60 UNION ALL SELECT unit_id, cycle, 'high_load' FROM ev WHERE k > 90 UNION ALL SELECT unit_id, cycle, 'error' FROM ev WHERE mode = 'error'),
  f AS (SELECT unit_id, e, min(cycle) AS c FROM v GROUP BY 1, 2), p AS (SELECT a.e AS a, b.e AS b, CAST(b.c - a.c AS DOUBLE) AS lead FROM f a JOIN f b ON a.unit_id = b.unit_id AND (a.c < b.c OR a.c = b.c AND a.e < b.e)),
  g AS (SELECT a, b, avg(lead) AS m, stddev_pop(lead) AS s, count(*) AS n, quantile_cont(lead, 0.1) AS q, (SELECT count(DISTINCT unit_id) FROM ev) AS u FROM p GROUP BY 1, 2)"""


@query(f"{_EDGES} SELECT a, b, {q6('m', 'mean_lead')}, {q6('s', 'std_lead')}, {q6('n / CAST(u AS DOUBLE)', 'support')}, {q6('q', 'p10_lead')} FROM g WHERE n / CAST(u AS DOUBLE) >= 0.3")
def causality_edges(spark, sf_dir):
    c = t.cycles(spark, sf_dir)
    found = F.array_compact(F.array(F.when(F.col("value") > 60, F.lit("high_value")), F.when(F.col("k") > 90, F.lit("high_load")), F.when(F.col("mode") == "error", F.lit("error"))))
    return rounded(causal.precedence_edges(c.select("unit_id", "cycle", found.alias("v")), "unit_id", "cycle", "v", 0.3).drop("text"))


# Consensus


_MODS = ["vibration", "current", "temperature"]
_VOTE = f"""WITH v AS ({t.VOTES_SQL}), w AS (SELECT row_id, modality, ord, label, CASE WHEN label = -1 THEN 0.0 ELSE prob END AS w, CASE WHEN label <> -1 THEN modality || ':' || label END AS key FROM v),
  r AS (SELECT row_id, modality, w, key, sum(w) OVER (PARTITION BY row_id) AS tot, row_number() OVER (PARTITION BY row_id ORDER BY CASE WHEN key IS NULL THEN 1 ELSE 0 END, w DESC, ord) AS rk FROM w),
  b AS (SELECT row_id, max(tot) AS tot, max(CASE WHEN rk = 1 THEN key END) AS key, max(CASE WHEN rk = 1 AND key IS NOT NULL THEN w END) AS best,
    max(CASE WHEN modality = 'vibration' THEN w END) AS wv, max(CASE WHEN modality = 'current' THEN w END) AS wc, max(CASE WHEN modality = 'temperature' THEN w END) AS wt FROM r GROUP BY 1),
  s AS (SELECT row_id, CASE WHEN tot >= 1e-12 THEN key END AS winner, coalesce(best / nullif(CASE WHEN tot < 1e-12 THEN 0 ELSE tot END, 0) < 0.7, true) AS conflict,
    coalesce(wv / nullif(CASE WHEN tot < 1e-12 THEN 0 ELSE tot END, 0), 0) AS dv, coalesce(wc / nullif(CASE WHEN tot < 1e-12 THEN 0 ELSE tot END, 0), 0) AS dc, coalesce(wt / nullif(CASE WHEN tot < 1e-12 THEN 0 ELSE tot END, 0), 0) AS dt FROM b),
  l AS (SELECT winner, dense_rank() OVER (ORDER BY winner) - 1 AS label FROM (SELECT DISTINCT winner FROM s WHERE winner IS NOT NULL))"""


def _consensus(spark, sf_dir):
    return consensus.arbitrate(t.votes(spark, sf_dir), _MODS)


@query(f"{_VOTE} SELECT row_id, winner, coalesce(label, -1) AS label, conflict, {q6('dv', 'vibration')}, {q6('dc', 'current')}, {q6('dt', 'temperature')} FROM s LEFT JOIN l USING (winner)")
def consensus_votes(spark, sf_dir):
    return rounded(_consensus(spark, sf_dir).select("row_id", "winner", "label", "conflict", *[F.col("dominance")[m].alias(m) for m in _MODS]))


@query(f"{_VOTE} SELECT {q6('avg(CASE WHEN conflict THEN 1.0 ELSE 0.0 END)', 'conflict_rate')}, count(DISTINCT winner) AS n_modes FROM s")
def conflict_rate(spark, sf_dir):
    return rounded(_consensus(spark, sf_dir).agg(F.avg(F.col("conflict").cast("double")).alias("conflict_rate"), F.count_distinct("winner").alias("n_modes")))


@query(f"""{_VOTE}, m AS (SELECT CAST(e.label AS BIGINT) AS mode_id, avg(dv) AS vibration, avg(dc) AS current, avg(dt) AS temperature FROM s JOIN embeddings e ON e.vec_id = s.row_id GROUP BY 1)
  SELECT mode_id, modality, round(d, 6) + 0.0 AS dominance FROM (SELECT mode_id, 'vibration' AS modality, vibration AS d FROM m UNION ALL SELECT mode_id, 'current', current FROM m UNION ALL SELECT mode_id, 'temperature', temperature FROM m)""")
def dominance_by_mode(spark, sf_dir):
    modes = t.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("label").cast("long").alias("mode_id"))
    return rounded(consensus.dominance_by_mode(_consensus(spark, sf_dir), modes, _MODS))


_WIDE = """WITH w AS (SELECT CAST(label AS INTEGER) AS a, CAST((vec_id * 7) % 5 - 1 AS INTEGER) AS b, CAST(vec_id % 4 - 1 AS INTEGER) AS c, (vec_id * 37) % 101 / 100.0 AS pa, (vec_id * 53) % 97 / 96.0 AS pb, (vec_id * 71) % 89 / 88.0 AS pc FROM embeddings),
  x AS (SELECT a, b, c, greatest(pa, pb, pc) AS top, CASE WHEN pa = greatest(pa, pb, pc) THEN 0 WHEN pb = greatest(pa, pb, pc) THEN 1 ELSE 2 END AS f FROM w),
  y AS (SELECT avg(CASE WHEN b = c AND a <> b THEN 1.0 ELSE 0.0 END) AS odd_0, avg(CASE WHEN a = c AND b <> c THEN 1.0 ELSE 0.0 END) AS odd_1, avg(CASE WHEN a = b AND a <> c THEN 1.0 ELSE 0.0 END) AS odd_2,
    avg(CASE WHEN a <> b AND a <> c AND b <> c THEN 1.0 ELSE 0.0 END) AS dis, avg(top) AS mt, stddev_samp(top) AS st, avg(CASE WHEN f = 0 THEN 1.0 ELSE 0.0 END) AS d0, avg(CASE WHEN f = 1 THEN 1.0 ELSE 0.0 END) AS d1, avg(CASE WHEN f = 2 THEN 1.0 ELSE 0.0 END) AS d2 FROM x)"""


def _wide(spark, sf_dir):
    i = F.col("vec_id")
    e = t.table(spark, sf_dir, "embeddings")
    return e.select(
        i, F.col("label").cast("int").alias("a"), ((i * 7) % 5 - 1).cast("int").alias("b"), (i % 4 - 1).cast("int").alias("c"),
        ((i * 37) % 101 / 100.0).alias("pa"), ((i * 53) % 97 / 96.0).alias("pb"), ((i * 71) % 89 / 88.0).alias("pc"),
    )


@query(f"""{_WIDE} SELECT {q6('odd_0', 'odd_0')}, {q6('odd_1', 'odd_1')}, {q6('odd_2', 'odd_2')}, {q6('dis', 'disagreement')}, {q6('mt', 'mean_confidence')}, {q6('st', 'std_confidence')},
  {q6('d0', 'dominance_0')}, {q6('d1', 'dominance_1')}, {q6('d2', 'dominance_2')}, {q6('-(d0 * log2(d0) + d1 * log2(d1) + d2 * log2(d2))', 'dominance_entropy')}, 1.0 AS voting_consistency FROM y""")
def conflict_pattern(spark, sf_dir):
    return rounded(consensus.agreement(_wide(spark, sf_dir), ["a", "b", "c"], ["pa", "pb", "pc"]))


@query(f"{_WIDE.split('x AS')[0].rstrip().rstrip(',')} SELECT vec_id, CASE WHEN pa = greatest(pa, pb, pc) THEN a WHEN pb = greatest(pa, pb, pc) THEN b ELSE c END AS label FROM w".replace("SELECT CAST(label", "SELECT vec_id, CAST(label"))
def voted_labels(spark, sf_dir):
    return _wide(spark, sf_dir).select("vec_id", consensus.voted_label(["a", "b", "c"], ["pa", "pb", "pc"]).alias("label"))


@query(f"WITH v AS ({t.VOTES_SQL}) SELECT modality, count(DISTINCT CASE WHEN label <> -1 THEN label END) AS n_clusters, {q6('avg(CASE WHEN label = -1 THEN 1.0 ELSE 0.0 END)', 'noise_ratio')} FROM v GROUP BY 1")
def modality_summary(spark, sf_dir):
    return rounded(t.votes(spark, sf_dir).groupBy("modality").agg(consensus.n_clusters().alias("n_clusters"), consensus.noise_ratio().alias("noise_ratio")))


# Constraints


_MOTOR = f"""WITH c AS ({t.MOTOR_SQL}), l AS (SELECT *, 25 + current * current * 2.1 / (15 * 0.18) AS lim FROM c),
  s AS (SELECT *, temperature > lim + 5.0 AS vj, vibration > 0.46 AS vv, abs(thermal_rate) > 2.0 AS vt, efficiency > 0.84 + 0.05 AS ve, correlation < 0.5 AS vc,
    greatest(0.0, (temperature - lim) / lim) AS sj, greatest(0.0, (vibration - 0.46) / 0.46) AS sv, CASE WHEN correlation < 0.5 THEN (0.5 - correlation) / 0.5 ELSE 0.0 END AS sc FROM l),
  r AS (SELECT *, least(1.0, (sj * 0.35 + sv * 0.30 + sc * 0.35) / 1.0) AS risk FROM s)"""


@query(f"""{_MOTOR} SELECT mode_id, concat_ws(',', CASE WHEN vj THEN 'joule_heating' END, CASE WHEN vv THEN 'vibration_bounds' END, CASE WHEN vt THEN 'thermal_rate' END, CASE WHEN ve THEN 'efficiency' END, CASE WHEN vc THEN 'cross_modal_coherence' END) AS violated,
  {q6('risk', 'risk_score')}, CASE WHEN sj >= sv AND sj >= sc THEN 'joule_heating' WHEN sv >= sc THEN 'vibration_bounds' ELSE 'cross_modal_coherence' END AS dominant_risk, vv AS is_fault_state, vv OR NOT (vj OR vt OR ve OR vc) AS feasible,
  CASE WHEN vj AND vv AND vc THEN 'Complete System Degradation' WHEN vj AND vv THEN 'Coupled Electromechanical Fault' WHEN vj AND vc THEN 'Thermal Runaway Onset' WHEN vv AND vc THEN 'Mechanical Fault with Sensor Artifact'
    WHEN vj THEN 'Electrothermal Stress' WHEN vv THEN 'Mechanical Imbalance / Bearing Wear' WHEN vc THEN 'Sensor Disagreement / Mixed-Regime Cluster' ELSE 'Normal Operation' END AS label,
  CASE WHEN vj AND (vv OR vc) THEN 'CRITICAL' WHEN vv OR vj THEN 'WARNING' WHEN vc THEN 'DATA_QUALITY' ELSE 'NOMINAL' END AS severity, row_number() OVER (ORDER BY risk DESC, mode_id) AS risk_rank FROM r""")
def constraint_filter_motor(spark, sf_dir):
    got = physics.filter_modes(t.motor_centroids(spark, sf_dir), params.MOTOR)
    return rounded(got.select("mode_id", F.array_join("violated", ",").alias("violated"), "risk_score", "dominant_risk", "is_fault_state", "feasible", "label", "severity", "risk_rank"))


_ENGINE = f"""WITH c AS ({t.ENGINE_SQL}), s AS (SELECT *, correlation < 0.5 AS vc, nf > 2500 OR nc > 9100 AS vs, t50 > 1600 AS ve, greatest(0.0, (nf - 2500) / 2500) AS ss, greatest(0.0, (t50 - 1600) / 1600) AS se,
  CASE WHEN correlation < 0.5 THEN (0.5 - correlation) / 0.5 ELSE 0.0 END AS sc FROM c), r AS (SELECT *, least(1.0, (ss * 0.4 + se * 0.4 + sc * 0.2) / 1.0) AS risk FROM s)"""


@query(f"""{_ENGINE} SELECT mode_id, concat_ws(',', CASE WHEN vc THEN 'cross_modal_coherence' END, CASE WHEN vs THEN 'speed_bounds' END, CASE WHEN ve THEN 'egt_limit' END) AS violated, {q6('risk', 'risk_score')},
  CASE WHEN ss >= se AND ss >= sc THEN 'speed_bounds' WHEN se >= sc THEN 'egt_limit' ELSE 'cross_modal_coherence' END AS dominant_risk, false AS is_fault_state, NOT (vc OR vs OR ve) AS feasible,
  CASE WHEN vs OR ve THEN 'Unknown State' WHEN vc THEN 'Sensor Disagreement / Mixed-Regime Cluster' ELSE 'Normal Operation' END || ' [THERMAL-dominant]' AS label,
  CASE WHEN vs OR ve THEN 'UNCLASSIFIED' WHEN vc THEN 'DATA_QUALITY' ELSE 'NOMINAL' END AS severity, row_number() OVER (ORDER BY risk DESC, mode_id) AS risk_rank FROM r""")
def constraint_filter_engine(spark, sf_dir):
    c = t.engine_centroids(spark, sf_dir)
    lead = c.select("mode_id", F.create_map(F.lit("thermal"), F.lit(0.6), F.lit("pressure"), F.lit(0.4)).alias("signature"))
    got = physics.filter_modes(c, params.TURBOFAN, lead)
    return rounded(got.select("mode_id", F.array_join("violated", ",").alias("violated"), "risk_score", "dominant_risk", "is_fault_state", "feasible", "label", "severity", "risk_rank"))


@query(f"{_MOTOR} SELECT {q6('avg(CASE WHEN vv OR NOT (vj OR vt OR ve OR vc) THEN 1.0 ELSE 0.0 END)', 'coherence_rate')} FROM r")
def coherence_rate(spark, sf_dir):
    return rounded(physics.coherence_rate(physics.filter_modes(t.motor_centroids(spark, sf_dir), params.MOTOR)))


_PHYS = f"""WITH {EV}, d AS (SELECT unit_id, cycle, mode, value AS temperature, k / 10 AS current, k / 50 AS vibration, coalesce(value - lag(value) OVER (PARTITION BY unit_id ORDER BY cycle), 0) AS dt,
  coalesce(k / 10 - lag(k / 10) OVER (PARTITION BY unit_id ORDER BY cycle), 0) AS di FROM ev),
  f AS (SELECT *, abs(dt - (0.05 * current * current - 0.05 * (temperature - 25.0))) AS er FROM d), v AS (SELECT *, abs(dt) > 5.0 AS vt, er > 10.0 AS ve, vibration > 1.5 AS vv FROM f), x AS (SELECT *, vt OR ve OR vv AS va FROM v)"""


def _physical(spark, sf_dir):
    c = t.cycles(spark, sf_dir).select("unit_id", "cycle", "mode", F.col("value").alias("temperature"), (F.col("k") / 10).alias("current"), (F.col("k") / 50).alias("vibration"))
    return c


@query(f"""{_PHYS} SELECT {q6('avg(er)', 'mean_energy_error')}, {', '.join(q6(f'avg(CASE WHEN {a} THEN 1.0 ELSE 0.0 END)', f'{b}_rate') for a, b in (('vt', 'thermal_violation'), ('ve', 'energy_violation'), ('vv', 'vibration_violation'), ('va', 'violation')))} FROM x""")
def physics_row_metrics(spark, sf_dir):
    return rounded(physics.violation_summary(physics.row_metrics(_physical(spark, sf_dir), UNIT, "cycle")))


@query(f"{_PHYS} SELECT unit_id, cycle, {q6('dt', 'dT')}, {q6('er', 'energy_error')}, vt AS thermal_violation, ve AS energy_violation, vv AS vibration_violation, va AS violation FROM x")
def physics_rows(spark, sf_dir):
    got = physics.row_metrics(_physical(spark, sf_dir), UNIT, "cycle")
    return rounded(got.select("unit_id", "cycle", "dT", "energy_error", "thermal_violation", "energy_violation", "vibration_violation", "violation"))


@query(f"{_PHYS} SELECT {q6('(avg(dt * di) - avg(dt) * avg(di)) / (stddev_pop(dt) * stddev_pop(di))', 'coupling')} FROM x")
def channel_coupling(spark, sf_dir):
    return rounded(physics.coupling(_physical(spark, sf_dir), UNIT, "cycle", "temperature", "current"))


@query(f"{_PHYS} SELECT mode, {q6('avg(CASE WHEN va THEN 0.0 ELSE 1.0 END)', 'feasibility')} FROM x GROUP BY 1")
def cluster_feasibility(spark, sf_dir):
    return rounded(physics.feasibility_by_mode(physics.row_metrics(_physical(spark, sf_dir), UNIT, "cycle"), "mode"))


@query(f"{_PHYS}, g AS (SELECT mode, avg(CASE WHEN va THEN 0.0 ELSE 1.0 END) AS f FROM x GROUP BY 1) SELECT {q6('avg(CASE WHEN f < 0.95 THEN 1.0 ELSE 0.0 END)', 'rejected_share')} FROM g")
def rejected_share(spark, sf_dir):
    got = physics.feasibility_by_mode(physics.row_metrics(_physical(spark, sf_dir), UNIT, "cycle"), "mode")
    return rounded(physics.rejected_share(got))


# Retrieval and alignment


_LIB = """WITH c AS (SELECT s_nationkey AS e, l_returnflag AS f, sum(l_quantity) AS q FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
  v AS (SELECT e, f, q / (sum(q) OVER (PARTITION BY e) + 1e-10) AS x FROM c), n AS (SELECT CAST(n_nationkey AS BIGINT) AS e, r_name AS lab FROM nation JOIN region ON n_regionkey = r_regionkey),
  qv AS (SELECT 0 AS query_id, 'A' AS f, 0.5 / (1.0 + 1e-10) AS x UNION ALL SELECT 0, 'R', 0.3 / (1.0 + 1e-10) UNION ALL SELECT 0, 'X', 0.2 / (1.0 + 1e-10) UNION ALL SELECT 1, 'N', 2.0 / (3.0 + 1e-10) UNION ALL SELECT 1, 'R', 1.0 / (3.0 + 1e-10)),
  d AS (SELECT query_id, v.e, sum(v.x * qv.x) AS dot FROM v JOIN qv ON v.f = qv.f GROUP BY 1, 2), nv AS (SELECT e, sqrt(sum(x * x)) AS nx FROM v GROUP BY 1), nq AS (SELECT query_id, sqrt(sum(x * x)) AS ny FROM qv GROUP BY 1),
  s AS (SELECT query_id, e AS entry_id, lab AS outcome_label, round(dot / (nx * ny), 9) AS sim FROM d JOIN nv USING (e) JOIN nq USING (query_id) JOIN n USING (e)),
  k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, entry_id DESC) AS rank FROM s)"""


def _matches(spark, sf_dir):
    li, s = t.table(spark, sf_dir, "lineitem"), t.table(spark, sf_dir, "supplier")
    n, r = t.table(spark, sf_dir, "nation"), t.table(spark, sf_dir, "region")
    c = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("s_nationkey").cast("long").alias("entry_id"), "l_returnflag").agg(F.sum("l_quantity").alias("q"))
    v = c.groupBy("entry_id").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "q"))).alias("conflict_vector"))
    names = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("long").alias("entry_id"), F.col("r_name").alias("outcome_label"))
    lib = v.join(names, "entry_id").select("entry_id", "outcome_label", F.lit("orders").alias("dataset_source"), F.lit(0.0).alias("risk_score"), retrieval.normalise_map(F.col("conflict_vector")).alias("vector_normalized"))
    queries = spark.createDataFrame([(0, {"A": 0.5, "R": 0.3, "X": 0.2}), (1, {"N": 2.0, "R": 1.0})], "query_id int, vector map<string,double>")
    return retrieval.matches(queries, lib, 3)


@query(f"{_LIB} SELECT query_id, entry_id, outcome_label, {q6('sim', 'similarity')}, rank FROM k WHERE rank <= 3")
def pattern_query_topk(spark, sf_dir):
    got = _matches(spark, sf_dir)
    return rounded(got.select("query_id", "entry_id", "outcome_label", "similarity", F.col("rank").cast("long").alias("rank")))


@query(f"""{_LIB}, g AS (SELECT query_id, outcome_label, sum(sim) AS s, min(rank) AS r FROM k WHERE rank <= 3 GROUP BY 1, 2), h AS (SELECT *, sum(s) OVER (PARTITION BY query_id) AS tot, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, r) AS o FROM g)
  SELECT query_id, outcome_label AS predicted, {q6('s / tot', 'confidence')} FROM h WHERE o = 1""")
def pattern_prediction(spark, sf_dir):
    return rounded(retrieval.predict(_matches(spark, sf_dir)))


_FP = f"""{_MOTOR}, fp AS (SELECT mode_id, [CASE WHEN vj THEN 1.0 ELSE 0.0 END, CASE WHEN vv THEN 1.0 ELSE 0.0 END, CASE WHEN vc THEN 1.0 ELSE 0.0 END, 0.0, 0.0,
  (mode_id % 5 + 1.0) / (mode_id % 5 + 1.0 + 2.0 + mode_id % 3), 2.0 / (mode_id % 5 + 1.0 + 2.0 + mode_id % 3), (mode_id % 3) / (mode_id % 5 + 1.0 + 2.0 + mode_id % 3), risk] AS v FROM r)"""


def _fingerprints(spark, sf_dir):
    got = physics.filter_modes(t.motor_centroids(spark, sf_dir), params.MOTOR)
    i = F.col("mode_id")
    dom = F.create_map(F.lit("temperature"), (i % 5 + 1).cast("double"), F.lit("current"), F.lit(2.0), F.lit("vibration"), (i % 3).cast("double"))
    return got.select("mode_id", retrieval.fingerprint(F.col("violated"), dom, F.col("risk_score")).alias("fp"))


@query(f"""{_FP}, p AS (SELECT a.mode_id AS mode_a, b.mode_id AS mode_b, round(list_sum([x * b.v[i] FOR x, i IN a.v]) / (sqrt(list_sum([x * x FOR x IN a.v])) * sqrt(list_sum([x * x FOR x IN b.v]))), 9) AS sim FROM fp a, fp b WHERE a.mode_id % 2 = 0 AND b.mode_id % 2 = 1),
  k AS (SELECT *, row_number() OVER (PARTITION BY mode_a ORDER BY sim DESC, mode_b) AS r FROM p WHERE sim > 0) SELECT mode_a, mode_b, {q6('sim', 'similarity')} FROM k WHERE r = 1 AND sim >= 0.75""")
def fingerprint_alignment(spark, sf_dir):
    fp = _fingerprints(spark, sf_dir)
    return rounded(retrieval.align(fp.where("mode_id % 2 = 0"), fp.where("mode_id % 2 = 1")))


# Distances between samples


_CDF = """, u AS (SELECT 'value' AS feature, value AS v, 1 AS a, 0 AS b FROM x UNION ALL SELECT 'value', value, 0, 1 FROM y UNION ALL SELECT 'k', k, 1, 0 FROM x UNION ALL SELECT 'k', k, 0, 1 FROM y),
  g AS (SELECT feature, v, sum(a) AS a, sum(b) AS b FROM u GROUP BY 1, 2),
  c AS (SELECT feature, v, abs(sum(a) OVER w / CAST(sum(a) OVER (PARTITION BY feature) AS DOUBLE) - sum(b) OVER w / CAST(sum(b) OVER (PARTITION BY feature) AS DOUBLE)) AS gap, coalesce(lead(v) OVER w, v) - v AS step FROM g WINDOW w AS (PARTITION BY feature ORDER BY v))"""


@query(f"WITH {t.HALVES_SQL}{_CDF} SELECT feature, {q6('sum(gap * step)', 'wasserstein')}, {q6('max(gap)', 'ks')} FROM c GROUP BY 1")
def distribution_shift(spark, sf_dir):
    x, y = t.halves(spark, sf_dir)
    return rounded(metrics.distribution_shift(x, y, ["value", "k"]))


_SHIFT = f"""WITH {t.HALVES_SQL}, a AS (SELECT mode, avg(value) AS m1, avg(k) AS m2, var_pop(value) AS v1, var_pop(k) AS v2 FROM x GROUP BY 1), b AS (SELECT mode, avg(value) AS m1, avg(k) AS m2, var_pop(value) AS v1, var_pop(k) AS v2 FROM y GROUP BY 1),
  s AS (SELECT a.mode, sqrt(power(a.m1 - b.m1, 2) + power(a.m2 - b.m2, 2)) AS cs, ((b.v1 + b.v2) / 2) / greatest(1e-9, (a.v1 + a.v2) / 2) AS dg FROM a JOIN b ON a.mode = b.mode)"""


@query(f"{_SHIFT} SELECT mode, {q6('cs', 'centroid_shift')}, {q6('dg', 'diversity_gain')}, {q6('abs(1 - dg)', 'deformation')} FROM s")
def mode_shift(spark, sf_dir):
    return rounded(metrics.mode_shift(*t.halves(spark, sf_dir), "mode", ["value", "k"]))


@query(f"{_SHIFT} SELECT {q6('avg(cs)', 'centroid_shift')}, {q6('avg(dg)', 'diversity_gain')}, {q6('avg(abs(1 - dg))', 'deformation')} FROM s")
def mean_mode_shift(spark, sf_dir):
    got = metrics.mode_shift(*t.halves(spark, sf_dir), "mode", ["value", "k"])
    return rounded(got.agg(*[F.avg(c).alias(c) for c in ("centroid_shift", "diversity_gain", "deformation")]))


@query(f"WITH {t.HALVES_SQL}, p AS (SELECT mode, count(*) / CAST((SELECT count(*) FROM x) AS DOUBLE) AS p FROM x GROUP BY 1), q AS (SELECT mode, count(*) / CAST((SELECT count(*) FROM y) AS DOUBLE) AS q FROM y GROUP BY 1) SELECT {q6('sum(p * ln((p + 1e-9) / (q + 1e-9)))', 'kl')} FROM p JOIN q USING (mode)")
def kl_mode_shift(spark, sf_dir):
    return rounded(metrics.mode_kl(*t.halves(spark, sf_dir), "mode"))


@query(f"""WITH {t.HALVES_SQL}, a AS (SELECT min(value) AS l1, max(value) AS h1, min(k) AS l2, max(k) AS h2 FROM x), b AS (SELECT min(value) AS m1, max(value) AS n1, min(k) AS m2, max(k) AS n2 FROM y)
  SELECT {q6('(greatest(h1, n1) - least(l1, m1)) * (greatest(h2, n2) - least(l2, m2)) / greatest(1e-9, (h1 - l1) * (h2 - l2)) - 1', 'coverage_increase')} FROM a, b""")
def coverage_ratio(spark, sf_dir):
    return rounded(metrics.coverage_increase(*t.halves(spark, sf_dir), ["value", "k"]))


# Cluster validity and refinement


def _nmi(a: str, b: str) -> str:
    return f"""t AS (SELECT {a} AS a, {b} AS b, CAST(count(*) AS DOUBLE) AS n FROM l WHERE {a} <> -1 AND {b} <> -1 GROUP BY 1, 2), ra AS (SELECT a, sum(n) AS r FROM t GROUP BY 1), rb AS (SELECT b, sum(n) AS r FROM t GROUP BY 1),
  s AS (SELECT (SELECT sum(n) FROM t) AS n, (SELECT sum(t.n / z.n * ln(t.n * z.n / (ra.r * rb.r))) FROM t JOIN ra ON t.a = ra.a JOIN rb ON t.b = rb.b, (SELECT sum(n) AS n FROM t) z) AS mi,
    (SELECT -sum(r / z.n * ln(r / z.n)) FROM ra, (SELECT sum(n) AS n FROM t) z) AS ha, (SELECT -sum(r / z.n * ln(r / z.n)) FROM rb, (SELECT sum(n) AS n FROM t) z) AS hb,
    (SELECT sum(n * (n - 1) / 2) FROM t) AS ix, (SELECT sum(r * (r - 1) / 2) FROM ra) AS pa, (SELECT sum(r * (r - 1) / 2) FROM rb) AS pb)"""


_LABELS = "WITH l AS (SELECT CAST(label AS INTEGER) AS x, CAST((vec_id * 7) % 5 - 1 AS INTEGER) AS y, CAST(label / 2 AS INTEGER) AS z FROM embeddings), "
_ARI = "(ix - pa * pb / (n * (n - 1) / 2)) / (0.5 * (pa + pb) - pa * pb / (n * (n - 1) / 2))"


@query(f"{_LABELS}{_nmi('x', 'y')} SELECT {q6('mi / (0.5 * (ha + hb))', 'nmi')}, {q6(_ARI, 'ari')} FROM s")
def nmi_ari(spark, sf_dir):
    return rounded(metrics.agreement_scores(_wide(spark, sf_dir), "a", "b"))


@query(f"{_LABELS}{_nmi('x', 'y')} SELECT {q6(f'({_ARI} + {_ARI}) / 2', 'stability')} FROM s")
def labeling_stability(spark, sf_dir):
    return rounded(metrics.labeling_stability(_wide(spark, sf_dir).withColumn("a2", F.col("a")), ["a", "b", "a2"]))


_PTS = f"p AS ({t.POINTS_SQL})"
_DIST = "sqrt(list_sum([power(x - b.v[i], 2) FOR x, i IN a.v]))"


@query(f"""WITH {_PTS}, d AS (SELECT a.vec_id AS i, a.label AS la, b.label AS lb, sum({_DIST}) AS s, count(*) AS n FROM p a, p b GROUP BY 1, 2, 3), r AS (SELECT i, max(CASE WHEN la = lb THEN CASE WHEN n > 1 THEN s / (n - 1) END END) AS ca, min(CASE WHEN la <> lb THEN s / n END) AS cb FROM d GROUP BY 1)
  SELECT {q6('avg(CASE WHEN ca IS NULL THEN 0 ELSE (cb - ca) / greatest(ca, cb) END)', 'silhouette')} FROM r""")
def silhouette(spark, sf_dir):
    return rounded(metrics.silhouette(t.points(spark, sf_dir), "vec_id", "v", "label"))


_CENT = f"""WITH {_PTS}, u AS (SELECT label, vec_id, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM p), c AS (SELECT label, i, avg(x) AS m, count(*) AS n FROM u GROUP BY 1, 2),
  e AS (SELECT u.label, u.vec_id, sqrt(sum(power(x - m, 2))) AS d, sum(power(x - m, 2)) AS d2 FROM u JOIN c ON u.label = c.label AND u.i = c.i GROUP BY 1, 2)"""


@query(f"""{_CENT}, s AS (SELECT label, avg(d) AS s FROM e GROUP BY 1), g AS (SELECT a.label AS i, b.label AS j, sqrt(sum(power(a.m - b.m, 2))) AS d FROM c a JOIN c b ON a.i = b.i AND a.label <> b.label GROUP BY 1, 2),
  r AS (SELECT i, max((x.s + y.s) / d) AS r FROM g JOIN s x ON x.label = i JOIN s y ON y.label = j GROUP BY 1) SELECT {q6('avg(r)', 'davies_bouldin')} FROM r""")
def davies_bouldin(spark, sf_dir):
    return rounded(metrics.davies_bouldin(t.points(spark, sf_dir), "v", "label"))


@query(f"""{_CENT}, g AS (SELECT i, avg(x) AS gm FROM u GROUP BY 1), b AS (SELECT sum(n * power(m - gm, 2)) AS b FROM c JOIN g USING (i)), w AS (SELECT sum(d2) AS w, count(*) AS n FROM e), k AS (SELECT count(DISTINCT label) AS k FROM p)
  SELECT {q6('(b / (k - 1)) / (w / (n - k))', 'calinski_harabasz')} FROM b, w, k""")
def calinski_harabasz(spark, sf_dir):
    return rounded(metrics.calinski_harabasz(t.points(spark, sf_dir), "v", "label"))


@query(f"WITH {_PTS}, d AS (SELECT a.vec_id AS id, b.vec_id AS other, {_DIST} AS dist FROM p a, p b), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, other) AS rank FROM d) SELECT id, other, {q6('dist', 'dist')}, rank FROM k WHERE rank <= 5")
def knn_edges(spark, sf_dir):
    got = cluster.neighbours(t.points(spark, sf_dir), "vec_id", "v", 5)
    return rounded(got.select("id", "other", "dist", F.col("rank").cast("long").alias("rank")))


_BAD = [1, 4, 7]
_NEAR = f"""{_CENT}, q AS (SELECT label, i, m FROM c), cd AS (SELECT a.label AS l, b.label AS t, sqrt(sum(power(a.m - b.m, 2))) AS d FROM q a JOIN q b ON a.i = b.i WHERE a.label IN (1, 4, 7) AND b.label NOT IN (1, 4, 7) GROUP BY 1, 2),
  mm AS (SELECT l, t FROM (SELECT *, row_number() OVER (PARTITION BY l ORDER BY d, t) AS r FROM cd) WHERE r = 1),
  pd AS (SELECT vec_id, t.label AS t, sqrt(sum(power(x - m, 2))) AS d FROM u JOIN q t ON u.i = t.i WHERE u.label IN (1, 4, 7) AND t.label NOT IN (1, 4, 7) GROUP BY 1, 2), pm AS (SELECT vec_id, t FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, t) AS r FROM pd) WHERE r = 1)"""


def _refined(spark, sf_dir, strategy):
    p = t.points(spark, sf_dir)
    c = metrics.centroids(p, "label", "v").select(F.col("label").alias("mode_id"), "centroid")
    return cluster.refine(p, "vec_id", "v", "label", c, _BAD, strategy).select("vec_id", F.col("refined").cast("int").alias("refined"))


@query(f"{_NEAR} SELECT vec_id, CAST(coalesce(t, label) AS INTEGER) AS refined FROM p LEFT JOIN mm ON label = l")
def merge_nearest(spark, sf_dir):
    return _refined(spark, sf_dir, "merge")


@query(f"{_NEAR} SELECT p.vec_id, CAST(coalesce(t, label) AS INTEGER) AS refined FROM p LEFT JOIN pm ON p.vec_id = pm.vec_id")
def gradient_reassign(spark, sf_dir):
    return _refined(spark, sf_dir, "gradient")


@query(f"WITH {_PTS} SELECT vec_id, CAST(CASE WHEN label IN (1, 4, 7) THEN -2 ELSE label END AS INTEGER) AS refined FROM p")
def fault_relabel(spark, sf_dir):
    return _refined(spark, sf_dir, "fault")


@query()
def split_refine(spark, sf_dir):
    return _refined(spark, sf_dir, "split")


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_discount >= 0.05 THEN 1.0 ELSE 0.0 END AS a, CASE WHEN l_tax >= 0.04 THEN 1.0 ELSE 0.5 END AS b FROM lineitem)
  SELECT l_orderkey, l_linenumber, CAST(dense_rank() OVER (ORDER BY a, b) - 1 AS INTEGER) AS regime FROM s""")
def regime_labels(spark, sf_dir):
    s = t.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_discount") >= 0.05, 1.0).otherwise(0.0).alias("a"), F.when(F.col("l_tax") >= 0.04, 1.0).otherwise(0.5).alias("b"))
    return features.regimes(s, ["a", "b"]).select("l_orderkey", "l_linenumber", F.col("regime").cast("int").alias("regime"))


@query()
def kmeans_scan(spark, sf_dir):
    return cluster.kmeans_scan(t.points(spark, sf_dir), "vec_id", "v")


@query()
def gmm_scan(spark, sf_dir):
    return cluster.mixture_scan(t.points(spark, sf_dir), "v")


@query()
def hdbscan_modes(spark, sf_dir):
    p = t.points(spark, sf_dir).withColumn("modality", F.lit("vibration"))
    return density.density_modes(p.unionByName(t.points(spark, sf_dir).withColumn("modality", F.lit("current"))), "vec_id", "v", "modality")


@query()
def dbcv(spark, sf_dir):
    return density.density_validity(t.points(spark, sf_dir), "v", "label")


@query()
def synthetic_sampling(spark, sf_dir):
    allowed = lambda v: F.get(v, 0) <= 0.15
    return cluster.bounded_samples(t.points(spark, sf_dir).where("label = 1"), "vec_id", "v", 100, allowed)


@query()
def jitter_synthesis(spark, sf_dir):
    return cluster.jitter(t.cycles(spark, sf_dir).select("unit_id", "cycle", "value"), ["value"])


@query()
def pca_latent(spark, sf_dir):
    return cluster.pca(t.points(spark, sf_dir), "v").select("vec_id", "latent")


@query("""WITH f AS (SELECT CAST(n_nationkey AS BIGINT) AS i FROM nation) SELECT i, CAST(CASE (i * 4 + 97) WHEN 97 THEN 0 WHEN 105 THEN 0 WHEN 169 THEN 0 WHEN 209 THEN 0 WHEN 121 THEN 3 WHEN 133 THEN 3 ELSE -1 END AS INTEGER) AS load_hp FROM f""")
def load_from_file_number(spark, sf_dir):
    i = F.col("n_nationkey").cast("long")
    stem = F.concat(F.lit("run_"), (i * 4 + 97).cast("string"))
    return t.table(spark, sf_dir, "nation").select(i.alias("i"), signals.load_hp(stem).alias("load_hp"))


from . import checks  # noqa: E402  registers its queries here

__all__ = ["ORACLES", "QUERIES", "SparkSession", "checks", "tiles"]
