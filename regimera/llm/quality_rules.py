"""Quality rules with risk-controlled cutoffs.

Each document gets a few badness statistics in [0, 1]. For every stratum (language) and rule, labelled
documents form a holdout; the cutoffs of the rule are tested from the most lenient to the strictest (a
fixed sequence), each against the null hypothesis "this cutoff rejects more than its share of good
documents", with the exact binomial tail as p-value. The share alpha is split over the rules, the error
level delta over rules x strata (Bonferroni), so with probability 1 - delta no stratum loses more than
alpha of its good documents to the rules. Among the certified cutoffs the one that best separates the
labels is used; a rule with no certified cutoff never rejects.

Copies of a text among the labelled documents of a stratum count once, as good only if every copy is.

Cases: a null, empty or blank text has no words, zero statistics and fails the base rule. Repeated rows each
get their own row. A document whose stratum has no labels is judged by the base rule alone. Ties at a cutoff
are rejected (statistic >= cutoff). An empty table gives an empty result. Clashing column names in extra
columns are avoided by keeping the caller's columns in one struct.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CHARS, let, materialise, words

#: Fixed values of the base rule.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rules: larger is worse, each in [0, 1].
RULES = ("symbol", "upper", "dup_line", "repeat", "few_distinct")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
LEVELS = 100
#: Terms of a tail below this share of its first are not summed.
TERM_SHARE = 1e-18
ALPHA = 0.02
DELTA = 0.05
#: A good document lost weighs as much as this many times the same share of bad ones caught.
GOOD_WEIGHT = 5.0


def _repeat_words(w: Column) -> Column:
    """Words lying in a 5-word window that occurs at least twice in the same array."""
    n = F.size(w)
    hashed = F.transform(w, lambda x: F.xxhash64(x))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW)))

    def covered(u: Column) -> Column:
        keyed = F.array_sort(F.transform(u, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

        def places(s: Column) -> Column:
            last = F.size(s) - 1
            twin = F.filter(
                s,
                lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | ((i < last) & (F.get(s, i + 1)["h"] == x["h"])),
            )
            return F.array_sort(F.transform(twin, lambda x: x["p"]))

        def total(p: Column) -> Column:
            step = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
            return F.aggregate(step, F.lit(0), lambda a, b: a + b)

        return let(let(keyed, places), total)

    def if_any(u: Column) -> Column:
        return F.when(F.size(F.array_distinct(u)) < F.size(u), covered(u)).otherwise(0)

    return F.when(n > WINDOW, let(let(hashed, windows), if_any)).otherwise(0).cast("long")


def base_features(df: DataFrame, text: str = "text") -> DataFrame:
    """Columns of df plus the base counts, the base verdict and the rule statistics."""
    t = F.coalesce(F.col(text), F.lit(""))
    got = df.withColumn("_w", words(F.col(text)))
    w = F.col("_w")
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACE_CHARS, "")) > 0)
    facts = F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.translate(t, SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(t) - F.length(F.translate(t, UPPER, ""))).cast("long").alias("n_upper"),
        let(lines, lambda x: F.struct(F.size(x).alias("all"), F.size(F.array_distinct(x)).alias("distinct"))).alias("lines"),
        F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
        _repeat_words(w).alias("n_repeat_words"),
    )
    return got.withColumn("_q", facts).drop("_w")


def _finish(q: Column) -> dict[str, Column]:
    n, rep = q["n_words"], q["n_repeat_words"]
    failed = (n < MIN_WORDS) | (100 * rep > MAX_REPEAT_PERCENT * n)

    def share(a: Column, b: Column) -> Column:
        return F.floor(LEVELS * F.coalesce(F.least(F.lit(1.0), a / F.nullif(b, F.lit(0))), F.lit(0.0))).cast("int")

    zero = F.lit(0)
    stats = {
        "symbol": share(q["n_symbols"], q["word_chars"]),
        "upper": share(q["n_upper"], q["word_chars"]),
        "dup_line": share(q["lines"]["all"] - q["lines"]["distinct"], q["lines"]["all"]),
        "repeat": share(rep, n),
        "few_distinct": share(n - q["n_distinct"], n),
    }
    return {"base_failed": failed, "stats": F.array(*[F.coalesce(stats[r], zero) for r in RULES])}


def _ln_gamma(x: Column) -> Column:
    """Stirling's series after a shift by 8: error below 1e-12 for x >= 1."""
    shift = sum((F.ln(x + i) for i in range(1, 8)), F.ln(x))
    z = x + 8
    series = (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    return series - shift


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k) for k below the mean n p; 1.0 elsewhere, which certifies nothing.

    Summed downward from k to the last term that a double's sum still shows: each term is at most the ratio at k of the
    one before, and terms past TERM_SHARE of the first change no digit, so their number grows with the root of n p.
    """
    k, n = k.cast("double"), n.cast("double")
    log_top = _ln_gamma(n + 1) - _ln_gamma(k + 1) - _ln_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def step(a: Column, i: Column) -> Column:
        x = k - i + 1
        t = a["t"] * x * (1 - p) / ((n - x + 1) * p)
        return F.struct(t.alias("t"), (a["s"] + t).alias("s"))

    # After j terms the product of ratios is below exp(-j (j - 1) / (2 (k + 1))), as ratio i is at most 1 - (i - 1) / (k + 1).
    stop = F.least(k, F.ceil(F.sqrt(2 * (k + 1) * -math.log(TERM_SHARE))) + 2).cast("int")
    run = F.aggregate(F.when(stop > 0, F.sequence(F.lit(1), stop)).otherwise(F.array().cast("array<int>")), start, step, lambda a: a["s"])
    return F.when((n <= 0) | (k >= n * p), F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(log_top) * run))


def cutoffs(labelled: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """labelled: stratum, good (boolean), stats (array<int>, one of each rule). Returns (stratum, rule, cutoff, n_good, lost, caught).

    The result has at most one row for each stratum and rule; the table that is summed has LEVELS + 1 rows for each.
    """
    share = alpha / len(RULES)
    long = labelled.select("stratum", "good", F.posexplode("stats").alias("rule", "level"))
    counts = long.groupBy("stratum", "rule", "level").agg(
        F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b")
    )
    by = Window.partitionBy("stratum", "rule")
    upper = by.orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)
    n_strata = counts.select("stratum").distinct().agg(F.count(F.lit(1)).alias("n_strata"))
    tested = (
        counts.withColumn("n_good", F.sum("g").over(by))
        .withColumn("n_bad", F.sum("b").over(by))
        .withColumn("lost", F.sum("g").over(upper))
        .withColumn("caught", F.sum("b").over(upper))
        .crossJoin(F.broadcast(n_strata))  # one row
        .where("level > 0")
        .withColumn("p", binomial_tail(F.col("lost"), F.col("n_good"), share))
        .withColumn("fails", (F.col("p") > delta / (F.lit(len(RULES)) * F.col("n_strata"))).cast("int"))
        .withColumn("open", F.sum("fails").over(upper) == 0)
    )
    gain = F.col("caught") / F.greatest(F.col("n_bad"), F.lit(1)) - GOOD_WEIGHT * F.col("lost") / F.col("n_good")
    return (
        tested.where("open and caught > 0")
        .withColumn("gain", gain)
        .where("gain > 0")
        .groupBy("stratum", "rule")
        .agg(F.max(F.struct("gain", F.col("level").alias("cutoff"), "n_good", "lost", "caught")).alias("best"))
        .select("stratum", "rule", "best.cutoff", "best.n_good", "best.lost", "best.caught")
    )


def judge(docs: DataFrame, labels: DataFrame, keep: list[str], stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Columns `keep` of docs, of names other than those added, with the base counts, base_failed and kept."""
    return _judged(docs, labels, keep, stratum, alpha, delta).select("row.*", *COUNTS, "base_failed", "kept")


def kept_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of docs that are kept, with its columns, whatever their names."""
    return _judged(docs, labels, docs.columns, stratum, alpha, delta).where("kept").select("row.*")


def _judged(docs: DataFrame, labels: DataFrame, keep: list[str], stratum: str, alpha: float, delta: float) -> DataFrame:
    """(row, base counts, base_failed, kept).

    docs needs doc_id, text and the stratum column; labels needs doc_id and quality (1 is good). The counts are
    computed once and written to the shared folder, then the cutoffs are set from the labelled rows and applied.
    """
    text = F.col("text")
    row = docs.select(F.struct(*keep).alias("row"), F.col("doc_id").alias("_id"), text.alias("text"), F.coalesce(F.col(stratum), F.lit("")).alias("stratum"), F.xxhash64(text).alias("same"))
    q = F.col("_q")
    done = _finish(q)
    facts = base_features(row).select(
        "row", "_id", "stratum", "same",
        *[q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_repeat_words")],
        (q["lines"]["all"] - q["lines"]["distinct"]).cast("long").alias("n_dup_lines"),
        done["base_failed"].alias("base_failed"), done["stats"].alias("stats"),
    )
    facts = materialise(facts, "quality-rules")
    marks = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("quality")).where("quality is not null")
    held = facts.where(~F.col("base_failed")).select("_id", "stratum", "same", "stats").join(marks, "_id")
    # Copies are one trial: the binomial bound counts independent documents. One that is bad in any copy is bad.
    held = held.groupBy("stratum", "same").agg(F.min("quality").alias("quality"), F.first("stats").alias("stats"))
    found = cutoffs(held.select("stratum", (F.col("quality") == 1).alias("good"), "stats"), alpha, delta)
    # One row for each stratum: an array with a cutoff (or none) for each rule.
    limits = found.groupBy("stratum").agg(
        F.array(*[F.min(F.when(F.col("rule") == i, F.col("cutoff"))) for i in range(len(RULES))]).alias("limits")
    )
    # Written, so that its size is known: a few strata are then broadcast below the engine's threshold.
    judged = facts.join(materialise(limits, "quality-limits"), "stratum", "left")
    hit = F.exists(F.arrays_zip("stats", "limits"), lambda x: F.coalesce(x["stats"] >= x["limits"], F.lit(False)))
    bad = F.col("base_failed") | F.coalesce(hit, F.lit(False))
    return judged.select("row", *COUNTS, "base_failed", (~bad).alias("kept"))
