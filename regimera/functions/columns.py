"""Column expressions that stay in the JVM: guarded statistics over rows and over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def r6(c: Column) -> Column:
    """Rounded to six places, without a negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def text2(c: Column) -> Column:
    """A double rounded to two places, as text in plain digits below 1e16; the shortest digits that tell it."""
    x = F.round(c * 100) / 100
    plain = F.regexp_replace(x.cast("decimal(38,2)").cast("string"), "0$", "")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lower(F.regexp_replace(x.cast("string"), "inity", ""))).when(F.abs(x) < 1e16, plain).otherwise(F.regexp_replace(x.cast("string"), r"(\.0)?E", "e+"))


def fma(a: Column, b: Column, c: Column) -> Column:
    """a * b + c rounded once, from error-free products and sums of doubles."""

    def halves(v: Column) -> tuple[Column, Column]:
        t = v * F.lit(134217729.0)
        high = t - (t - v)
        return high, v - high

    (ah, al), (bh, bl), p = halves(a), halves(b), a * b
    s = p + c
    back = s - p
    return s + ((p - (s - back)) + (c - back) + (((ah * bh - p) + ah * bl + al * bh) + al * bl))


def a_moments(pairs: Column) -> Column:
    """(n, c, s) of an array of structs (x, y): their number, the sum of (x - mean x)(y - mean y) and that of (x - mean x)^2, in order."""

    def step(m: Column, p: Column) -> Column:
        n, dx = m["n"] + 1.0, p["x"] - m["mx"]
        mx, my = m["mx"] + dx / n, m["my"] + (p["y"] - m["my"]) / n
        return F.struct(n.alias("n"), mx.alias("mx"), my.alias("my"), fma(dx, p["y"] - my, m["c"]).alias("c"), fma(p["x"] - mx, dx, m["s"]).alias("s"))

    return F.aggregate(pairs, F.struct(*[F.lit(0.0).alias(k) for k in ("n", "mx", "my", "c", "s")]), step)


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def over(c: Column, w) -> Column:
    return c if w is None else c.over(w)


def corr0(x: Column, y: Column, w=None) -> Column:
    """Pearson correlation, 0 where either side is constant or missing; over window w or as an aggregate."""
    dx, dy = over(F.stddev_pop(x), w), over(F.stddev_pop(y), w)
    safe = F.when((dx > TINY) & (dy > TINY), dx * dy)
    return F.coalesce(over(F.covar_pop(x, y), w) / safe, F.lit(0.0))


def slope0(y: Column, x: Column, w=None) -> Column:
    """Least-squares slope of y on x, 0 where y is constant."""
    return F.when(over(F.stddev_pop(y), w) > TINY, over(F.regr_slope(y, x), w)).otherwise(F.lit(0.0))


def iqr(x: Column, w=None) -> Column:
    """Distance of the exact quartiles, linearly interpolated."""
    q = over(F.percentile(x, F.array(F.lit(0.25), F.lit(0.75))), w)
    return F.get(q, 1) - F.get(q, 0)


def a_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def a_mean(a: Column) -> Column:
    return a_sum(a) / F.size(a)


def a_quantile(a: Column, p: float) -> Column:
    """Linear-interpolation quantile of an array of doubles."""

    def at(s: Column) -> Column:
        h = (F.size(s) - 1) * F.lit(p)
        low = F.floor(h).cast("int")
        a0, a1 = F.get(s, low), F.get(s, F.least(low + 1, F.size(s) - 1))
        return a0 + (a1 - a0) * (h - low)

    return let(F.array_sort(a), at)


def a_time_features(a: Column) -> dict[str, Column]:
    """Time-domain and statistical features of one window held as an array of doubles.

    rms, peak, crest_factor (0 for a silent window), population skewness and excess kurtosis (null where constant), mean,
    population variance, range, iqr, zero crossings of the centred signal by window length, lag-1 autocorrelation.
    """
    n = F.size(a)

    def central(x: Column, m: Column, k: int) -> Column:
        return a_mean(F.transform(x, lambda v: F.pow(v - m, F.lit(float(k))))).alias(f"m{k}")

    def moments(x: Column) -> Column:
        return let(a_mean(x), lambda m: F.struct(m.alias("m"), *[central(x, m, k) for k in (2, 3, 4)]))

    rms = F.sqrt(a_mean(F.transform(a, lambda v: v * v)))
    peak = F.array_max(F.transform(a, F.abs))
    head, tail = F.slice(a, F.lit(1), n - 1), F.slice(a, F.lit(2), n - 1)

    def auto(p: Column) -> Column:
        x, y = p["x"], p["y"]
        means = F.struct(a_mean(x).alias("mx"), a_mean(y).alias("my"))

        def close(m: Column) -> Column:
            cov = a_mean(F.zip_with(x, y, lambda u, v: (u - m["mx"]) * (v - m["my"])))
            sx = F.sqrt(a_mean(F.transform(x, lambda u: (u - m["mx"]) * (u - m["mx"]))))
            sy = F.sqrt(a_mean(F.transform(y, lambda v: (v - m["my"]) * (v - m["my"]))))
            return F.coalesce(cov / F.when((sx > TINY) & (sy > TINY), sx * sy), F.lit(0.0))

        return let(means, close)

    def crossings(x: Column) -> Column:
        signs = let(a_mean(x), lambda m: F.transform(x, lambda v: F.signum(v - m)))
        changed = let(signs, lambda s: F.size(F.filter(F.sequence(F.lit(1), F.size(s) - 1), lambda i: F.get(s, i) != F.get(s, i - 1))))
        return changed.cast("double") / F.size(x)

    mom = moments(a)
    return {
        "rms": rms,
        "peak": peak,
        "crest_factor": F.when(rms > TINY, peak / F.when(rms > TINY, rms)).otherwise(F.lit(0.0)),
        "skewness": let(mom, lambda q: F.try_divide(q["m3"], F.pow(q["m2"], F.lit(1.5)))),
        "kurtosis": let(mom, lambda q: F.try_divide(q["m4"], q["m2"] * q["m2"]) - 3.0),
        "mean": a_mean(a),
        "variance": mom["m2"],
        "range": F.array_max(a) - F.array_min(a),
        "iqr": a_quantile(a, 0.75) - a_quantile(a, 0.25),
        "zero_crossing_rate": F.when(n > 1, crossings(a)).otherwise(F.lit(0.0)),
        "autocorrelation_lag1": F.when(n > 1, auto(F.struct(head.alias("x"), tail.alias("y")))).otherwise(F.lit(0.0)),
    }


def a_spectral_features(mag: Column, rate: float, n: Column, top: int = 5) -> dict[str, Column]:
    """Features of the magnitudes of bins 1..n/2; all 0 for a silent spectrum.

    dominant_freq (first maximum), spectral_centroid and entropy (bits) of the power shares, and the `top` strongest
    bins as harmonic_{i}_freq / harmonic_{i}_mag, ties to the higher frequency.
    """
    loud = a_sum(mag) >= TINY
    step = F.lit(float(rate)) / n

    def shares(m: Column) -> Column:
        power = F.transform(m, lambda x: x * x)
        return let(a_sum(power), lambda t: F.transform(power, lambda x: F.try_divide(x, t)))

    def guarded(c: Column) -> Column:
        return F.when(loud, c).otherwise(F.lit(0.0))

    p = shares(mag)
    entropy = a_sum(F.transform(F.filter(p, lambda x: x > 0), lambda x: -x * F.log2(x)))
    centroid = a_sum(F.transform(p, lambda x, i: x * (i + 1))) * step
    dominant = F.array_position(mag, F.array_max(mag)) * step
    ranked = F.array_sort(F.transform(mag, lambda x, i: F.struct((-x).alias("m"), (-(i + 1)).alias("k"))))
    out = {"dominant_freq": guarded(dominant), "spectral_centroid": guarded(centroid), "spectral_entropy": guarded(entropy)}
    for i in range(top):
        item = F.get(ranked, i)
        out[f"harmonic_{i}_freq"] = guarded(F.coalesce(-item["k"] * step, F.lit(0.0)))
        out[f"harmonic_{i}_mag"] = guarded(F.coalesce(-item["m"], F.lit(0.0)))
    return out


def cosine_maps(a: Column, b: Column) -> Column:
    """Cosine similarity of two sparse vectors held as maps, over the union of their keys; null where either is zero."""
    both = F.map_values(F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0.0)) * F.coalesce(y, F.lit(0.0))))
    norm = lambda m: F.sqrt(a_sum(F.transform(F.map_values(m), lambda x: x * x)))
    return F.try_divide(a_sum(both), norm(a) * norm(b))


def cosine_arrays(a: Column, b: Column) -> Column:
    dot = a_sum(F.zip_with(a, b, lambda x, y: x * y))
    norm = lambda m: F.sqrt(a_sum(F.transform(m, lambda x: x * x)))
    return F.try_divide(dot, norm(a) * norm(b))


def normalise_map(m: Column) -> Column:
    """Values divided by their sum plus 1e-10."""
    return let(a_sum(F.map_values(m)) + 1e-10, lambda t: F.transform_values(m, lambda k, v: v / t))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays."""
    return F.sqrt(a_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))
