"""A robust local trend of rates per group, with a band of local dispersion.

Local linear regression with tricube weights over the nearest span * n observations, and bisquare weights on the residuals in
two more passes, scaled by their exact median.  Equal rates of a group's day are one point with their number, and dates have day resolution, so that
each pass works on (group, day) sums: their number is bounded by the calendar, however many observations there are; only these sums meet in one task per
group, and only they are sent to the points.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetspan.functions.scalars import positive
from assetspan.session import cut, kept, small

PASSES = 3
BINS = 4096
LEAST_ROWS, LEAST_DATES, LEAST_SPAN = 5, 4, 0.3


def _reach(x: np.ndarray, m: np.ndarray, count: float) -> np.ndarray:
    """For each of the sorted days the least distance within which `count` observations lie, or all."""
    upto = np.concatenate(([0.0], np.cumsum(m)))
    low, high = np.zeros(len(x), np.int64), np.full(len(x), int(x[-1] - x[0]))
    while (low < high).any():
        middle = (low + high) // 2
        inside = upto[np.searchsorted(x, x + middle, "right")] - upto[np.searchsorted(x, x - middle, "left")]
        low, high = np.where(inside >= count, low, middle + 1), np.where(inside >= count, middle, high)
    return np.minimum(low, np.maximum(x - x[0], x[-1] - x))


def _smooth(by: str):
    """Fits of one group's days (x, m rows, w and wy their weights and weighted rates); a group has at most as many rows as its calendar has days."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x")
        x = pdf["x"].to_numpy(np.int64)
        m, w, wy = (pdf[c].to_numpy(float) for c in ("m", "w", "wy"))
        reach = _reach(x, m, float(pdf["window"].iloc[0]))
        first, last = np.searchsorted(x, x - np.maximum(reach - 1, 0), "left"), np.searchsorted(x, x + np.maximum(reach - 1, 0), "right")
        fit = np.full(len(x), np.nan)
        for i, (h, a, b) in enumerate(zip(reach.tolist(), first.tolist(), last.tolist())):
            z = (x[a:b] - x[i]).astype(float)
            k = (1 - (np.abs(z) / h) ** 3) ** 3 if h > 0 else np.ones(b - a)
            kw, kt = k * w[a:b], k * wy[a:b]
            s0, s1, s2, t0, t1 = kw.sum(), kw @ z, kw @ (z * z), kt.sum(), kt @ z
            det = s0 * s2 - s1 * s1
            if s0 > 0:
                fit[i] = t0 / s0 if abs(det) <= 1e-9 * max(1.0, s0 * s2) else (s2 * t0 - s1 * t1) / det
        return pd.DataFrame({by: pdf[by], "x": pdf["x"], "fit": fit}).dropna()

    return run


def _spread(by: str):
    """Band half-widths of one group's days from their residuals' counts, sums and sums of squares."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x")
        x = pdf["x"].to_numpy(np.int64)
        m, r1, r2 = (pdf[c].to_numpy(float) for c in ("m", "r1", "r2"))
        k = float(pdf["k"].iloc[0])
        reach = _reach(x, m, k)
        first, last = np.searchsorted(x, x - reach + 1, "left"), np.searchsorted(x, x + reach - 1, "right")
        first, last = np.minimum(first, last), last  # at distance 0 nothing is inside
        left = np.full(len(x), k)
        total = np.zeros((3, len(x)))
        for j, v in enumerate((m, r1, r2)):
            upto = np.concatenate(([0.0], np.cumsum(v)))
            total[j] = upto[last] - upto[first]
        left -= total[0]
        for side in (-1, 1):  # on the edge the earlier day counts first
            at = np.minimum(np.searchsorted(x, x + side * reach), len(x) - 1)
            on = (x[at] == x + side * reach) & ((side < 0) | (reach > 0))
            share = np.where(on, np.clip(left / m[at], 0, 1), 0.0)
            for j, v in enumerate((m, r1, r2)):
                total[j] += share * v[at]
            left = left - share * m[at]
        c, s1, s2 = total
        sd = np.sqrt(np.maximum(0.0, (s2 - s1 * s1 / np.maximum(c, 1e-300)) / np.where(c > 1, c - 1, 1)))
        return pd.DataFrame({by: pdf[by], "x": pdf["x"], "sd": np.where(c > 1, sd, 0.0)})

    return run


def medians(df: DataFrame, by: str, value: str, times: str | None = None) -> DataFrame:
    """(by, median) of each group, exactly, without gathering it: values are counted into BINS ranges, and only the ranges that hold the middle are ranked.

    A row counts as often as its column `times` says.  df is read three times, so it had better be stored or cheap.
    """
    times = F.lit(1) if times is None else F.col(times)
    stats = cut(df.groupBy(by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.sum(F.when(F.col(value).isNotNull(), times)).alias("_n")))
    at = F.when(F.col("_hi") > F.col("_lo"), F.least(F.lit(BINS - 1), F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * BINS))).otherwise(0)
    binned = df.where(F.col(value).isNotNull()).join(small(stats), by).select(by, value, "_n", times.alias("_t"), at.cast("int").alias("_bin"))
    upto = lambda c: F.sum("_k").over(Window.partitionBy(by).orderBy(c))
    lower, upper = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1
    counts = binned.groupBy(by, "_n", "_bin").agg(F.sum("_t").alias("_k")).withColumn("_upto", upto("_bin"))
    middle = counts.where((F.col("_upto") >= lower) & (F.col("_upto") - F.col("_k") < upper))
    middle = small(cut(middle.withColumn("_before", F.min(F.col("_upto") - F.col("_k")).over(Window.partitionBy(by))).select(by, "_bin", "_before")))
    inside = binned.join(middle, [by, "_bin"]).groupBy(by, "_n", "_before", value).agg(F.sum("_t").alias("_k"))
    ranked = inside.withColumn("_upto", F.col("_before") + upto(value))
    middles = [F.min(F.when(F.col("_upto") >= r, F.col(value))) for r in (lower, upper)]
    return ranked.groupBy(by).agg(((middles[0] + middles[1]) / 2).alias("median"))


def rate_trend(observations: DataFrame, by: str = "generation") -> DataFrame:
    """(by, n, span, reason, date, rate, band_lo, band_hi), a row per fitted date; a group with too few observations has one row with a reason.

    The band is the fit plus and minus the sample deviation of the nearest residuals (as many as the window), not a confidence interval,
    and not below 0.
    """
    rows = observations.where(positive(F.col("rate")) & F.col("start_date").isNotNull()).select(by, F.unix_date("start_date").alias("x"), F.col("rate").alias("y"))
    points = kept(rows.groupBy(by, "x", "y").agg(F.count("*").alias("c")))
    days = cut(points.groupBy(by, "x").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("y")).alias("wy")))
    sizes = days.groupBy(by).agg(F.sum("m").alias("n"), F.count("*").alias("dates"))
    span = F.greatest(F.lit(LEAST_SPAN), F.least(F.lit(1.0), F.lit(4.0) / F.col("n")))
    sizes = sizes.withColumn("span", span).withColumn("few", (F.col("n") < LEAST_ROWS) | (F.col("dates") < LEAST_DATES))
    window = F.greatest(F.lit(2), F.floor(F.col("span") * F.col("n"))).alias("window")
    sizes = cut(sizes)
    enough = small(sizes.where("not few").select(by, "n", "span", window))  # one row per group that is charted
    days = days.join(enough, by)
    counts = days.select(by, "x", "window", "m")
    weights = days.select(by, "x", F.col("m").cast("double").alias("w"), "wy")
    fits = None
    for p in range(PASSES):
        fits = cut(counts.join(weights, [by, "x"]).groupBy(by).applyInPandas(_smooth(by), f"{by} string, x int, fit double"))
        # Days are few beside points, which stay where they are and are not written again.
        residual = points.join(small(fits), [by, "x"]).withColumn("r", F.col("y") - F.col("fit"))
        if p == PASSES - 1:
            break
        scale = cut(medians(residual.select(by, F.abs("r").alias("a"), "c"), by, "a", "c").withColumnRenamed("median", "s"))
        ratio = F.abs("r") / (6 * F.col("s"))
        bisquare = F.when(F.col("s") < 1e-9, 1.0).when(ratio >= 1, 0.0).otherwise(F.pow(1 - ratio * ratio, 2))
        weighed = residual.join(small(scale), by).withColumn("b", F.col("c") * bisquare)
        weights = weighed.groupBy(by, "x").agg(F.sum("b").alias("w"), F.sum(F.col("b") * F.col("y")).alias("wy"))
    nearest = F.greatest(F.lit(4), F.ceil(F.col("n") * F.col("span"))).alias("k")
    sums = residual.groupBy(by, "x").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("r")).alias("r1"), F.sum(F.col("c") * F.col("r") * F.col("r")).alias("r2"))
    sums = sums.join(enough, by).select(by, "x", nearest, "m", "r1", "r2")
    band = sums.groupBy(by).applyInPandas(_spread(by), f"{by} string, x int, sd double")
    # a day whose whole neighbourhood was weighed down to nothing has no fit, and its group then no valid trend
    whole = counts.groupBy(by).agg(F.count("*").alias("_days")).join(fits.groupBy(by).agg(F.count("*").alias("_fits")), by, "left")
    broken = small(cut(whole.where("not _days <=> _fits").select(by)))  # one row per group at most
    fitted = fits.join(band, [by, "x"]).join(enough.select(by, "n", "span"), by).join(broken, by, "left_anti")
    sd = F.col("sd")
    out = fitted.select(
        by, "n", "span", F.lit(None).cast("string").alias("reason"), F.date_from_unix_date("x").alias("date"), F.col("fit").alias("rate"),
        F.greatest(F.lit(0.0), F.col("fit") - sd).alias("band_lo"), (F.col("fit") + sd).alias("band_hi"),
    )
    none = [F.lit(None).cast(t).alias(c) for c, t in (("date", "date"), ("rate", "double"), ("band_lo", "double"), ("band_hi", "double"))]
    invalid = enough.join(broken, by, "left_semi").select(by, "n", "span", F.lit("no valid trend").alias("reason"), *none)
    return out.union(sizes.where("few").select(by, "n", "span", F.lit("too few observations").alias("reason"), *none)).union(invalid)
