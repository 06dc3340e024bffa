"""Labels and what factors say about them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.rolling import by_symbol, pearson, rank_average, rank_share
from barloom.operators.ranking import pooled_ranks
from barloom.session import cut_lineage


def future(horizon: int) -> Column:
    return F.try_divide(F.lead("close", horizon).over(by_symbol()), F.col("close")) - 1


def return_labels(bars: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """(date, symbol) with future and excess returns, the worst and best close ahead, and whether the close rises."""
    out = bars.select("date", "symbol", "close", *[future(h).alias(f"future_return_{h}d") for h in horizons], *[F.lead("close", h).over(by_symbol()).alias(f"next_{h}") for h in horizons])
    columns = []
    for h in horizons:
        ahead = by_symbol().rowsBetween(1, h)
        columns += [
            f"future_return_{h}d",
            (F.col(f"future_return_{h}d") - F.avg(f"future_return_{h}d").over(Window.partitionBy("date"))).alias(f"excess_return_{h}d"),
            (F.try_divide(F.min("close").over(ahead), F.col("close")) - 1).alias(f"future_downside_{h}d"),
            (F.try_divide(F.max("close").over(ahead), F.col("close")) - 1).alias(f"future_upside_{h}d"),
            (F.col(f"next_{h}") > F.col("close")).cast("double").alias(f"direction_up_{h}d"),
        ]
    return out.select("date", "symbol", *columns)


def long_form(panel: DataFrame, factors: Sequence[str], label: str) -> DataFrame:
    return panel.select("date", "symbol", F.col(label).alias("label"), *factors).unpivot(["date", "symbol", "label"], list(factors), "factor", "value")


def ic_series(long: DataFrame) -> DataFrame:
    """(date, factor, ic, rank_ic): daily correlation of factor values, and of their ranks, with the label."""
    pairs = long.where("value IS NOT NULL AND label IS NOT NULL")
    ranked = pairs.withColumns({"value_rank": rank_average(F.col("value"), "date", "factor"), "label_rank": rank_average(F.col("label"), "date", "factor")})
    daily = ranked.groupBy("date", "factor").agg(pearson("value", "label").alias("ic"), pearson("value_rank", "label_rank").alias("rank_ic"))
    return daily.where("ic IS NOT NULL AND rank_ic IS NOT NULL")


def ic_summary(series: DataFrame, factors: Sequence[str]) -> DataFrame:
    got = series.groupBy("factor").agg(F.avg("ic").alias("ic_mean"), F.avg("rank_ic").alias("rank_ic_mean"), F.stddev_pop("ic").alias("s"), F.count(F.lit(1)).alias("observations"))
    every = series.sparkSession.createDataFrame([(f,) for f in factors], "factor string")
    zero = F.lit(0.0)
    return every.join(got, "factor", "left").select(
        "factor", F.coalesce("ic_mean", zero).alias("ic_mean"), F.coalesce("rank_ic_mean", zero).alias("rank_ic_mean"), F.coalesce(F.try_divide("ic_mean", "s"), zero).alias("ic_ir"), F.coalesce("observations", F.lit(0)).alias("observations")
    )


def ic_yearly(series: DataFrame) -> DataFrame:
    return series.groupBy("factor", F.year("date").alias("year")).agg(
        F.avg("rank_ic").alias("rank_ic_mean"), F.avg("ic").alias("ic_mean"), F.avg((F.col("rank_ic") > 1e-9).cast("double")).alias("positive_rank_ic_ratio"), F.count(F.lit(1)).alias("observations")
    )


def quantile_returns(long: DataFrame, quantiles: int = 5) -> DataFrame:
    """(date, factor, quantile, mean_forward_return): mean label by bucket of the factor's daily order; ties in order of symbol."""
    known = long.where("value IS NOT NULL AND label IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("date", "factor").orderBy("value", "symbol"))
    n = F.count(F.lit(1)).over(Window.partitionBy("date", "factor"))
    placed = known.withColumns({"place": place, "n": n}).where("n >= 2")
    bucket = F.least(F.lit(quantiles), F.floor((F.col("place") - 1) / F.col("n") * quantiles) + 1).cast("int")
    return placed.groupBy("date", "factor", bucket.alias("quantile")).agg(F.avg("label").alias("mean_forward_return"))


def coverage(long: DataFrame) -> DataFrame:
    share = F.count_if(F.col("value").isNotNull() & F.col("label").isNotNull()) / F.count(F.lit(1))
    return long.groupBy("factor").agg(share.alias("coverage")).withColumn("missing_ratio", 1 - F.col("coverage"))


def monotonicity(buckets: DataFrame) -> DataFrame:
    """Rank correlation of bucket and mean return; 0 below three buckets."""
    means = buckets.groupBy("factor", "quantile").agg(F.avg("mean_forward_return").alias("m"))
    ranked = means.select("factor", F.col("quantile").cast("double").alias("q"), rank_average(F.col("m"), "factor").alias("mr"))
    per = ranked.groupBy("factor").agg(F.count(F.lit(1)).alias("n"), pearson("q", "mr").alias("c"))
    return per.select("factor", F.when(F.col("n") >= 3, F.coalesce("c", F.lit(0.0))).otherwise(0.0).alias("quantile_monotonicity"))


def rank_turnover(long: DataFrame) -> DataFrame:
    """Mean daily change of a symbol's rank share."""
    shares = long.select("date", "symbol", "factor", rank_share(F.col("value"), "date", "factor").alias("share"))
    moved = shares.withColumn("step", F.abs(F.col("share") - F.lag("share").over(Window.partitionBy("factor", "symbol").orderBy("date"))))
    return moved.groupBy("factor", "date").agg(F.avg("step").alias("step")).groupBy("factor").agg(F.coalesce(F.avg("step"), F.lit(0.0)).alias("rank_turnover"))


def half_life(long: DataFrame) -> DataFrame:
    """Days until a factor's average lag-1 autocorrelation halves, from 0 to 252."""
    pairs = long.withColumn("previous", F.lag("value").over(Window.partitionBy("factor", "symbol").orderBy("date")))
    each = pairs.groupBy("factor", "symbol").agg(pearson("value", "previous").alias("rho"))
    mean = each.groupBy("factor").agg(F.avg(F.when(F.col("rho").isNotNull(), F.least(F.greatest("rho", F.lit(0.0)), F.lit(0.999)))).alias("rho"))
    days = F.when(F.col("rho") > 0, F.log(F.lit(0.5)) / F.log("rho")).otherwise(0.0)
    return mean.select("factor", F.least(F.lit(252.0), F.greatest(F.lit(0.0), days)).alias("half_life_days"))


def cost_adjusted_spread(buckets: DataFrame, turnover: DataFrame, cost_rate: float = 0.0016) -> DataFrame:
    means = buckets.groupBy("factor", "quantile").agg(F.avg("mean_forward_return").alias("m"))
    ends = means.groupBy("factor").agg((F.max_by("m", "quantile") - F.min_by("m", "quantile")).alias("gross_top_bottom_spread"))
    drag = F.col("rank_turnover") * cost_rate
    return ends.join(turnover, "factor").select("factor", "gross_top_bottom_spread", drag.alias("estimated_cost_drag"), (F.col("gross_top_bottom_spread") - drag).alias("cost_adjusted_spread"))


def market_regimes(panel: DataFrame) -> DataFrame:
    """(date, regime) by terciles of the daily market return. One row per date."""
    daily = panel.groupBy("date").agg(F.avg("market_mean_return").alias("m"))
    cuts = daily.agg(F.percentile("m", 0.33).alias("lo"), F.percentile("m", 0.67).alias("hi"))
    lo, hi = cuts.select("lo").scalar(), cuts.select("hi").scalar()
    regime = F.when(F.col("m") <= lo, "bearish").when(F.col("m") >= hi, "bullish").otherwise("sideways")
    return daily.where("m IS NOT NULL").select("date", regime.alias("regime"))


def regime_rank_ic(long: DataFrame, regimes: DataFrame, least: int = 10) -> DataFrame:
    """(factor, regime, rows, rank_ic): rank correlation over all rows of a regime, ranks pooled over its dates."""
    pooled = cut_lineage(long.where("value IS NOT NULL AND label IS NOT NULL").join(regimes, "date").select("factor", "regime", "value", "label"))
    groups = ["factor", "regime"]
    ranked = pooled_ranks(pooled_ranks(pooled, groups, "value", "value_rank"), groups, "label", "label_rank")
    return ranked.groupBy(*groups).agg(F.count(F.lit(1)).alias("rows"), pearson("value_rank", "label_rank").alias("rank_ic")).where(F.col("rows") >= least)


def regime_stability(per_regime: DataFrame) -> DataFrame:
    """Per factor of regime_rank_ic: regimes, share of them with a positive rank correlation, and the worst one; ties in order of name."""
    ic = F.coalesce("rank_ic", F.lit(0.0))
    worst = F.min(F.struct(F.round(ic, 9).alias("ic"), "regime"))
    return per_regime.groupBy("factor").agg(F.count(F.lit(1)).alias("regimes"), F.avg((ic > 1e-9).cast("double")).alias("positive_ratio"), worst["ic"].alias("worst_rank_ic"), worst["regime"].alias("worst_regime"))


def moved_sums(sums: np.ndarray, my, sy, mx, sx, my_to, sy_to, mx_to, sx_to) -> np.ndarray:
    """Sums (n, x, y, xx, yy, xy) over pairs of values standardised by means m and deviations s, as sums of values standardised by those to."""
    n, x, y, xx, yy, xy = sums
    a, d = sx / sx_to, (mx - mx_to) / sx_to
    b, e = sy / sy_to, (my - my_to) / sy_to
    return np.stack([n, a * x + d * n, b * y + e * n, a * a * xx + 2 * a * d * x + d * d * n, b * b * yy + 2 * b * e * y + e * e * n, a * b * xy + a * e * x + d * b * y + d * e * n])


def factor_correlations(panel: DataFrame, factors: Sequence[str]) -> DataFrame:
    """(factor, max_abs_correlation, max_corr_factor, vif_proxy), pairwise over rows where both are known.

    The panel is read once. Each batch is standardised by its own means and deviations and its sums of products of all
    pairs are moved to those of the first batch, so factors^2 numbers per task are shuffled. Correlations equal to ten
    digits tie, and the smaller name wins. A factor without a partner that varies gives no row.
    """
    names = list(factors)
    p = len(names)
    known = [F.when(~F.isnan(f), F.col(f)).alias(f) for f in names]
    wide = panel.select(*[F.col(f).cast("double").alias(f) for f in names]).select(*known)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, mean, scale, seen = np.zeros((6, p, p)), np.zeros(p), np.ones(p), np.zeros(p, bool)
        for batch in batches:
            x = batch.to_numpy(dtype=np.float64, na_value=np.nan)
            k = ~np.isnan(x)
            n = np.maximum(k.sum(0), 1)
            m, top = np.where(k, x, 0.0).sum(0) / n, np.where(k, x, -np.inf).max(0, initial=-np.inf)
            still = top == np.where(k, x, np.inf).min(0, initial=np.inf)
            m[still] = top[still]  # exactly, so that a constant leaves no residue
            x = np.where(k, x - m, 0.0)
            s = np.sqrt((x * x).sum(0) / n)
            s[~(s > 0)] = 1.0
            x, k = x / s, k.astype(np.float64)
            first = k.any(0) & ~seen
            mean[first], scale[first], seen = m[first], s[first], seen | first
            kx, kxx = k.T @ x, k.T @ (x * x)
            total += moved_sums(np.stack([k.T @ k, kx.T, kx, kxx.T, kxx, x.T @ x]), m, s, m[:, None], s[:, None], mean, scale, mean[:, None], scale[:, None])
        yield pd.DataFrame({"i": np.arange(p, dtype=np.int32), "s": [np.concatenate([total[:, i].ravel(), mean, scale, seen]).tobytes() for i in range(p)]})

    def best(group: pd.DataFrame) -> pd.DataFrame:
        i = int(group.i.iloc[0])
        total, mean, scale, seen = np.zeros((6, p)), np.zeros(p), np.ones(p), np.zeros(p, bool)
        for part in map(np.frombuffer, group.s):
            m, s, some = part[6 * p : 7 * p], part[7 * p : 8 * p], part[8 * p :] > 0
            first = some & ~seen
            mean[first], scale[first], seen = m[first], s[first], seen | first
            total += moved_sums(part[: 6 * p].reshape(6, p), m, s, m[i], s[i], mean, scale, mean[i], scale[i])
        n, sx, sy, sxx, syy, sxy = total
        with np.errstate(invalid="ignore", divide="ignore"):
            vx, vy = sxx / n - (sx / n) ** 2, syy / n - (sy / n) ** 2
            r = np.abs(sxy / n - sx / n * (sy / n)) / np.sqrt(vx * vy)
            varied = (n > 1) & (vx > 1e-12 * sxx / n) & (vy > 1e-12 * syy / n)
        places = [j for j in range(p) if j != i and varied[j]]
        if not places:
            return pd.DataFrame(columns=["factor", "max_abs_correlation", "max_corr_factor"], dtype=object)
        j = min(places, key=lambda j: (-round(float(r[j]), 10), names[j]))
        return pd.DataFrame({"factor": [names[i]], "max_abs_correlation": [float(r[j])], "max_corr_factor": [names[j]]}, dtype=object)

    parts = wide.mapInPandas(sums, "i int, s binary")
    found = parts.groupBy("i").applyInPandas(best, "factor string, max_abs_correlation double, max_corr_factor string")
    capped = F.least("max_abs_correlation", F.lit(0.999))
    return found.withColumn("vif_proxy", 1.0 / F.greatest(F.lit(0.05), 1 - capped * capped))


def factor_scores(panel: DataFrame, weights: dict[str, float], keep: Sequence[str] = ()) -> DataFrame:
    """(date, symbol, score, close, amount, *keep): weighted sum of daily rank shares, a missing rank counting 0."""
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.coalesce(rank_share(F.col(name), "date"), F.lit(0.0)) * weight
    return panel.select("date", "symbol", total.alias("score"), "close", "amount", *keep)


def rebalance_dates(dates: DataFrame, rule: str = "week") -> DataFrame:
    """Last known date of each week ending on Friday, or of each month."""
    bucket = F.next_day(F.date_sub("date", 1), "FRI") if rule == "week" else F.last_day("date")
    return dates.groupBy(bucket.alias("period")).agg(F.max("date").alias("date"))


def top_targets(scores: DataFrame, days: DataFrame, n: int, cap: float, least_amount: float = 0.0) -> DataFrame:
    """(date, symbol, weight): the n best of each rebalance date in equal weights up to cap; ties in order of symbol."""
    candidates = scores.join(days.select("date"), "date").where(F.col("score").isNotNull() & (F.col("amount") >= least_amount))
    best = candidates.withColumn("place", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("score"), "symbol"))).where(F.col("place") <= n)
    held = F.count(F.lit(1)).over(Window.partitionBy("date"))
    return best.select("date", "symbol", F.least(1.0 / held, F.lit(cap)).alias("weight"))
