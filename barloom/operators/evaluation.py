"""Walk-forward folds, baseline predictions, their metrics and calibration, and nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.rolling import pearson, rank_share
from barloom.operators.ranking import pooled_quantiles, pooled_ranks
from barloom.session import cut_lineage


def numbered_dates(dates: DataFrame) -> DataFrame:
    """(date, i): the distinct dates numbered from 0. A calendar, so one task may order it."""
    return dates.select("date").distinct().select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("i"))


def walk_forward_folds(dates: DataFrame, train_days: int, test_days: int, embargo: int) -> DataFrame:
    """(fold, role, date): test spans follow one another; each trains on the train_days before it less the embargo."""
    numbered = numbered_dates(dates)
    last = numbered.agg(F.max("i").alias("last"))
    folds = last.select(F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("last") - train_days) / test_days)).cast("int"))).alias("fold"), "last").where(F.col("last") >= train_days)
    spans = folds.select("fold", (F.lit(train_days) + F.col("fold") * test_days).alias("start"))
    roles = F.explode(F.array(F.struct(F.lit("train").alias("role"), (F.col("start") - train_days).alias("lo"), (F.col("start") - embargo).alias("hi")), F.struct(F.lit("test").alias("role"), F.col("start").alias("lo"), (F.col("start") + test_days).alias("hi")))).alias("s")
    places = spans.select("fold", roles).select("fold", "s.role", F.explode(F.sequence(F.col("s.lo"), F.col("s.hi") - 1)).alias("i"))
    return places.join(numbered, "i").select("fold", "role", "date")


def baseline_predictions(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """(fold, date, symbol, label, direction, prob_up, predicted_return) of the test rows.

    rows: date, symbol, score, label, direction. The training rows of a fold count only through daily sums.
    """
    known = rows.where("score IS NOT NULL AND label IS NOT NULL AND direction IS NOT NULL")
    daily = known.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.sum("direction").alias("d"), F.sum("label").alias("s"), F.sum(F.col("label") * F.col("label")).alias("q"))
    trained = folds.where("role = 'train'").join(daily, "date").groupBy("fold").agg(
        F.try_divide(F.sum("d"), F.sum("n")).alias("base"), F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.sum("q"), F.sum("n")) - F.pow(F.try_divide(F.sum("s"), F.sum("n")), 2))).alias("spread")
    )
    tested = known.withColumn("place", rank_share(F.col("score"), "date") - 0.5).join(folds.where("role = 'test'").select("fold", "date"), "date")
    probability = F.greatest(F.lit(0.05), F.least(F.lit(0.95), F.col("base") + F.col("place") * 0.20))
    return tested.join(trained, "fold").select("fold", "date", "symbol", "label", "direction", probability.alias("prob_up"), (F.col("place") * F.col("spread")).alias("predicted_return"))


def prediction_metrics(predictions: DataFrame, groups: Sequence[str], bins: int = 5) -> DataFrame:
    """Per group: accuracy, that of the commoner direction, AUC, Brier score, calibration error, rank correlation, and mean label of the top and bottom fifth.

    predictions: groups, prob_up, direction (0 or 1), label. Ranks are pooled over a group without gathering it.
    """
    groups = list(groups)
    predictions = cut_lineage(predictions.select(*groups, "prob_up", "direction", "label"))
    ranked = pooled_ranks(pooled_ranks(predictions, groups, "prob_up", "pr", "pt"), groups, "label", "lr")
    sizes = predictions.groupBy(*groups).agg(F.count(F.lit(1)).alias("size"))
    ranked = ranked.join(sizes, groups)
    highest, lowest = F.col("pr") + (F.col("pt") - 1) / 2 - 1, F.col("pr") - (F.col("pt") - 1) / 2 - 1
    top, bottom = highest >= 0.8 * (F.col("size") - 1), lowest <= 0.2 * (F.col("size") - 1)
    up, n = F.sum("direction"), F.count(F.lit(1))
    right = ((F.col("prob_up") >= 0.5).cast("double") == F.col("direction")).cast("double")
    sums = ranked.groupBy(*groups).agg(
        n.alias("rows"),
        F.avg(right).alias("direction_accuracy"),
        F.greatest(up / n, 1 - up / n).alias("baseline_accuracy"),
        F.coalesce(F.try_divide(F.sum(F.when(F.col("direction") == 1, F.col("pr"))) - up * (up + 1) / 2, up * (n - up)), F.lit(0.0)).alias("auc"),
        F.avg(F.pow(F.col("prob_up") - F.col("direction"), 2)).alias("brier"),
        F.coalesce(pearson("pr", "lr"), F.lit(0.0)).alias("rank_ic"),
        F.coalesce(F.avg(F.when(top, F.col("label"))), F.lit(0.0)).alias("top_bucket_return"),
        F.coalesce(F.avg(F.when(bottom, F.col("label"))), F.lit(0.0)).alias("bottom_bucket_return"),
    )
    return sums.join(calibration_error(predictions, groups, bins), groups)


def reliability(predictions: DataFrame, groups: Sequence[str], bins: int = 5) -> DataFrame:
    """Per group and probability bin: rows, mean probability, observed rate."""
    bin_ = F.least(F.floor(F.col("prob_up") * bins), F.lit(bins - 1)).cast("int").alias("bin")
    return predictions.groupBy(*groups, bin_).agg(F.count(F.lit(1)).alias("rows"), F.avg("prob_up").alias("mean_probability"), F.avg("direction").alias("observed_rate"))


def calibration_error(predictions: DataFrame, groups: Sequence[str], bins: int = 5) -> DataFrame:
    gap = F.col("rows") * F.abs(F.col("mean_probability") - F.col("observed_rate"))
    return reliability(predictions, groups, bins).groupBy(*groups).agg((F.sum(gap) / F.sum("rows")).alias("ece"))


def size_buckets(rows: DataFrame, cap: str | None, liquidity: str | None, amount: str | None) -> DataFrame:
    """rows with size_bucket and size_source: terciles of market capitalisation where known, else of the liquidity rank share by its value, else of the mean amount.

    Terciles of capitalisation and amount are over all rows that fall to them, ties by value alike; ranks are pooled.
    """
    out = rows.withColumns({"size_bucket": F.lit("market_cap_unavailable"), "size_source": F.lit("market_cap_unavailable")})

    def terciles(df: DataFrame, column: str, names: tuple[str, str, str], source: str) -> DataFrame:
        free = (F.col("size_source") == "market_cap_unavailable") & F.col(column).isNotNull()
        df = df.withColumn("t_", F.when(free, F.col(column)))
        ends = pooled_quantiles(df.where("t_ IS NOT NULL").select(F.lit(1).alias("g_"), "t_"), ["g_"], "t_", {"lo_": 1 / 3, "hi_": 2 / 3})
        lo, hi = ends.select("lo_").scalar(), ends.select("hi_").scalar()
        name = F.when(F.col("t_") <= lo, names[0]).when(F.col("t_") <= hi, names[1]).otherwise(names[2])
        return df.withColumns({"size_bucket": F.when(free, name).otherwise(F.col("size_bucket")), "size_source": F.when(free, source).otherwise(F.col("size_source"))}).drop("t_")

    proxies = ("low_liquidity_proxy", "mid_liquidity_proxy", "high_liquidity_proxy")
    if cap:
        out = terciles(out, cap, ("small_cap", "mid_cap", "large_cap"), "market_cap")
    if liquidity:
        free = (F.col("size_source") == "market_cap_unavailable") & F.col(liquidity).isNotNull()
        name = F.when(F.col(liquidity) <= 1 / 3, proxies[0]).when(F.col(liquidity) >= 2 / 3, proxies[2]).otherwise(proxies[1])
        out = out.withColumns({"size_bucket": F.when(free, name).otherwise(F.col("size_bucket")), "size_source": F.when(free, f"{liquidity}_liquidity_proxy").otherwise(F.col("size_source"))})
    if amount:
        out = terciles(out, amount, proxies, f"{amount}_liquidity_proxy")
    return out


def known_regimes(rows: DataFrame) -> DataFrame:
    """rows with market_regime from what was known on the day: thirds of market return and breadth, and the most volatile quarter of rows.

    rows: market_mean_return, market_breadth, volatility_20. Quantiles are over all rows, by pooled ranks.
    """
    cuts = {}
    for column, shares in (("market_mean_return", {"lo": 0.33, "hi": 0.67}), ("market_breadth", {"lo": 0.33, "hi": 0.67}), ("volatility_20", {"hi": 0.75})):
        cuts[column] = pooled_quantiles(rows.select(F.lit(1).alias("g_"), column), ["g_"], column, shares)
    cut = lambda column, name: cuts[column].select(name).scalar()
    r, b = F.col("market_mean_return"), F.col("market_breadth")
    regime = (
        F.when(r.isNull() | b.isNull(), "regime_unavailable")
        .when(F.col("volatility_20") >= cut("volatility_20", "hi"), "high_volatility_pit")
        .when((r <= cut("market_mean_return", "lo")) & (b <= cut("market_breadth", "lo")), "bearish_pit")
        .when((r >= cut("market_mean_return", "hi")) & (b >= cut("market_breadth", "hi")), "bullish_pit")
        .otherwise("sideways_pit")
    )
    return rows.withColumn("market_regime", regime)


def slice_metrics(predictions: DataFrame, slices: Sequence[str], bins: int = 5) -> DataFrame:
    """prediction_metrics by (slice_type, slice) for several columns in one pass; a null is the slice '(null)'."""
    pairs = F.explode(F.array(*[F.struct(F.lit(x).alias("slice_type"), F.coalesce(F.col(x).cast("string"), F.lit("(null)")).alias("slice")) for x in slices])).alias("s")
    rows = predictions.select("prob_up", "direction", "label", pairs).select("s.slice_type", "s.slice", "prob_up", "direction", "label")
    return prediction_metrics(rows, ["slice_type", "slice"], bins)


class Calibrator:
    """A fit of direction on prob_up: 'identity', 'platt' (a logistic line) or 'isotonic' (pooled adjacent violators)."""

    METHODS = ("identity", "platt", "isotonic")

    def __init__(self, method: str):
        self.method, self.knots = method, None

    def fit(self, p: np.ndarray, y: np.ndarray, n: np.ndarray) -> Calibrator:
        """p: distinct probabilities in order, with the sum of directions y and rows n of each."""
        if self.method == "platt":
            a, b = 1.0, 0.0
            for _ in range(50):
                q = 1 / (1 + np.exp(-np.clip(a * p + b, -30, 30)))
                w = n * q * (1 - q)
                g = np.array([((y - n * q) * p).sum() - a, (y - n * q).sum()])
                h = np.array([[(w * p * p).sum() + 1.0, (w * p).sum()], [(w * p).sum(), w.sum() + 1e-12]])
                step = np.linalg.solve(h, g)
                a, b = a + step[0], b + step[1]
                if np.abs(step).max() < 1e-10:
                    break
            self.knots = (a, b)
        elif self.method == "isotonic":
            blocks: list[list[float]] = []
            for x, s, m in zip(p, y, n, strict=True):
                blocks.append([s, m, x, x])
                while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
                    s2, m2, _, hi = blocks.pop()
                    blocks[-1][0] += s2
                    blocks[-1][1] += m2
                    blocks[-1][3] = hi
            xs = [e for b in blocks for e in (b[2], b[3])]
            ys = [b[0] / b[1] for b in blocks for _ in (0, 1)]
            self.knots = (np.array(xs), np.array(ys))
        return self

    def __call__(self, p: np.ndarray) -> np.ndarray:
        if self.method == "platt":
            return 1 / (1 + np.exp(-np.clip(self.knots[0] * p + self.knots[1], -30, 30)))
        return np.interp(p, *self.knots) if self.method == "isotonic" else p


def _calibration_scores(q: np.ndarray, y: np.ndarray, n: np.ndarray, bins: int) -> tuple[float, float]:
    brier = float((y * (1 - q) ** 2 + (n - y) * q**2).sum() / n.sum())
    at = np.minimum((q * bins).astype(int), bins - 1)
    rows, mean, seen = (np.bincount(at, weights=x, minlength=bins) for x in (n, n * q, y))
    return brier, float(np.abs(mean - seen).sum() / n.sum())


def fold_calibrations(predictions: DataFrame, groups: Sequence[str], *, least_train: int = 80, least_eval: int = 40, share: float = 0.7, bins: int = 5, digits: int = 4) -> DataFrame:
    """(groups, method, status, rows, raw and calibrated Brier score and error, candidates, curve): the calibration chosen per group.

    predictions: groups, date, prob_up, direction. The first share of a group's rows by date fits identity, Platt and
    isotonic curves, the rest judges them; the best by Brier score, error and name is fitted again on all rows. curve
    holds it at 0, 1/200, ... 1. Probabilities are rounded to digits and summed per group, date half and value before the
    fit, so a group's task sees at most 2 * 10^digits + 2 rows, however many predictions it has. Groups with too few rows
    or a single direction keep the identity, with a status that says so. The split lies between two dates.
    """
    groups = list(groups)
    known = predictions.where("prob_up IS NOT NULL AND direction IS NOT NULL").select(*groups, "date", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "prob_up")), digits).alias("p"), "direction")
    daily = known.groupBy(*groups, "date").agg(F.count(F.lit(1)).alias("n"))
    so_far = F.sum("n").over(Window.partitionBy(*groups).orderBy("date"))
    halves = daily.select(*groups, "date", (so_far <= F.greatest(F.lit(least_train), F.floor(F.sum("n").over(Window.partitionBy(*groups)) * share))).alias("early"))
    values = known.join(halves, [*groups, "date"]).groupBy(*groups, "early", "p").agg(F.sum("direction").alias("y"), F.count(F.lit(1)).cast("double").alias("n"))
    grid = np.linspace(0, 1, 201)

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        tables = []
        for rows in (part[part.early], part[~part.early], part):
            g = rows.groupby("p", as_index=False)[["y", "n"]].sum().sort_values("p")
            tables.append(tuple(g[c].to_numpy(dtype=float) for c in ("p", "y", "n")))
        early, late, every = tables
        n, up = every[2].sum(), every[1].sum()
        raw = _calibration_scores(every[0], every[1], every[2], bins)
        status, method, best, names, chosen = "calibration_sparse", "identity_insufficient", raw, "", Calibrator("identity")
        if n >= least_train + least_eval and 0 < up < n:
            method = "identity_single_class"
            if 0 < early[1].sum() < early[2].sum() and late[2].sum() > 0:
                tried = sorted((*(round(v, 12) for v in _calibration_scores(Calibrator(m).fit(*early)(late[0]), late[1], late[2], bins)), m) for m in Calibrator.METHODS)
                raw = _calibration_scores(late[0], late[1], late[2], bins)
                status, best, method, names = "calibrated", tried[0][:2], tried[0][2], ";".join(m for *_, m in tried)
                chosen = Calibrator(method).fit(*every)
        out = {g: [part[g].iloc[0]] for g in groups}
        return pd.DataFrame({**out, "method": [method], "status": [status], "rows": [int(n)], "raw_brier": [raw[0]], "raw_ece": [raw[1]], "calibrated_brier": [best[0]], "calibrated_ece": [best[1]], "candidates": [names], "curve": [np.clip(chosen(grid), 0, 1).tolist()]})

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in known.select(*groups).schema)
    return values.groupBy(*groups).applyInPandas(choose, f"{kinds}, method string, status string, rows long, raw_brier double, raw_ece double, calibrated_brier double, calibrated_ece double, candidates string, curve array<double>")


def calibrated(predictions: DataFrame, fits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """predictions with raw_prob_up, and prob_up read off the calibration curve of its keys, interpolated; unchanged where there is none. fits: keys and curve, a row per key."""
    joined = predictions.join(F.broadcast(fits.select(*keys, "curve")), list(keys), "left")  # a row per fold
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prob_up"))) * 200
    at = F.least(F.floor(p), F.lit(199)).cast("int")
    low, high = F.get("curve", at), F.get("curve", at + 1)
    return joined.withColumns({"raw_prob_up": F.col("prob_up"), "prob_up": F.coalesce(low + (p - at) * (high - low), "prob_up")}).drop("curve")


def ridge_forecast(rows: DataFrame, features: Sequence[str], label: str, train: str) -> DataFrame:
    """rows with prediction: ridge regression on standardised features, nulls as the training mean, fitted where train is true.

    A feature without any known training value is left out. rows is read several times.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
    from pyspark.ml.regression import LinearRegression

    fitted = rows.where(F.col(train) & F.col(label).isNotNull())
    known = fitted.agg(*[F.count(f).alias(f) for f in features]).first()
    features = [f for f in features if known[f]]
    filled = [f"{f}__filled" for f in features]
    stages = [
        Imputer(inputCols=list(features), outputCols=filled, strategy="mean"),
        VectorAssembler(inputCols=filled, outputCol="raw__", handleInvalid="skip"),
        StandardScaler(inputCol="raw__", outputCol="x__", withMean=True),
        LinearRegression(featuresCol="x__", labelCol=label, predictionCol="prediction", regParam=0.1, elasticNetParam=0.0),
    ]
    model = Pipeline(stages=stages).fit(fitted)
    return model.transform(rows).drop(*filled, "raw__", "x__")


def line_by_symbol(rows: DataFrame, least: int = 20) -> DataFrame:
    """(symbol, rows, alpha, beta) of label on x; the mean alone below least rows or without variance in x."""
    known = rows.where("x IS NOT NULL AND label IS NOT NULL")
    sums = known.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.avg("x").alias("mx"), F.avg("label").alias("my"), F.covar_pop("x", "label").alias("cxy"), F.var_pop("x").alias("vx"))
    beta = F.when(F.col("rows") >= least, F.coalesce(F.try_divide("cxy", "vx"), F.lit(0.0))).otherwise(0.0)
    return sums.select("symbol", "rows", (F.col("my") - beta * F.col("mx")).alias("alpha"), beta.alias("beta"))


def conformal_width(rows: DataFrame, miss: float = 0.2, least: int = 80) -> DataFrame:
    """(symbol, rows, half_width): the ceil((n+1)(1-miss))-th smallest distance of a symbol's labels from their median; null below least rows."""
    known = rows.where("label IS NOT NULL").select("symbol", "label")
    centre = known.groupBy("symbol").agg(F.percentile("label", 0.5).alias("centre"), F.count(F.lit(1)).alias("rows"))
    far = known.join(centre, "symbol").withColumn("d", F.abs(F.col("label") - F.col("centre")))
    place = F.row_number().over(Window.partitionBy("symbol").orderBy("d"))
    wanted = F.least(F.col("rows"), F.ceil((F.col("rows") + 1) * (1 - miss)))
    return far.withColumn("place", place).groupBy("symbol", "rows").agg(F.max(F.when((F.col("rows") >= least) & (F.col("place") == wanted), F.col("d"))).alias("half_width"))


def contributors(panel: DataFrame, factors: Sequence[str], k: int = 5) -> DataFrame:
    """(symbol, factor, z, place): the k factors furthest from their own history on each symbol's latest date."""
    long = panel.select("symbol", "date", *factors).unpivot(["symbol", "date"], list(factors), "factor", "value")
    per = long.groupBy("symbol", "factor").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.max_by("value", "date").alias("last"))
    z = per.select("symbol", "factor", F.try_divide(F.col("last") - F.col("m"), F.col("s")).alias("z")).where("z IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc(F.round(F.abs("z"), 9)), "factor"))
    return z.withColumn("place", place).where(F.col("place") <= k)


def similar_states(panel: DataFrame, features: Sequence[str], k: int = 20, least: int = 5) -> DataFrame:
    """(symbol, date, distance, place): the k earlier dates of each symbol whose features are closest to its latest ones.

    Features are standardised over the symbol's earlier dates; an unknown one counts as their mean, and those unknown on the
    latest date count for nothing. Symbols with fewer than least known features there give no row. Ties, to nine digits,
    go to the earlier date. A symbol's dates are bounded by its calendar.
    """
    last = panel.groupBy("symbol").agg(F.max("date").alias("last_"), F.max_by(F.struct(*[F.col(f).alias(f) for f in features]), "date").alias("now_"))
    history = panel.join(last, "symbol").where(F.col("date") < F.col("last_"))
    stats = history.groupBy("symbol").agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_samp(f).alias(f"s_{f}") for f in features])
    total, known = F.lit(0.0), F.lit(0)
    for f in features:
        scale = F.when(F.col(f"s_{f}") > 0, F.col(f"s_{f}"))
        z = lambda x, f=f, scale=scale: F.coalesce((x - F.col(f"m_{f}")) / scale, F.lit(0.0))
        usable = F.col(f"now_.{f}").isNotNull()
        total = total + F.when(usable, F.pow(z(F.col(f)) - z(F.col(f"now_.{f}")), 2)).otherwise(0.0)
        known = known + usable.cast("int")
    far = history.join(stats, "symbol").where(known >= least).select("symbol", "date", F.sqrt(total).alias("distance"))
    place = F.row_number().over(Window.partitionBy("symbol").orderBy(F.round("distance", 9), "date"))
    return far.withColumn("place", place).where(F.col("place") <= k)


def status_summary(rows: DataFrame, groups: Sequence[str], status: str, fallback: str) -> DataFrame:
    """Per group: rows, its distinct known statuses in order, whether they are mixed, and the share of rows whose status holds fallback."""
    seen = F.array_sort(F.collect_set(status))  # as many as there are kinds of status
    share = F.avg(F.coalesce(F.col(status).contains(fallback), F.lit(False)).cast("double"))
    return rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("rows"), F.array_join(seen, ";").alias("statuses"), (F.size(seen) > 1).alias("mixed"), share.alias("fallback_rate"))


def nearest(vectors: DataFrame, queries: DataFrame, *, row_id: str, vector: str, k: int, block: int = 4096) -> DataFrame:
    """(query_id, neighbour_id, distance, place): the k nearest other vectors of every query, exactly.

    Queries are broadcast block by block; each task keeps its own k best per query, so k rows per query and task are
    shuffled. Of several blocks each is scanned, its result written and its broadcast released before the next. Null vectors are left out; ties go to the smaller id.
    """
    narrow = vectors.where(F.col(vector).isNotNull()).select(F.col(row_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(row_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    blocks = max(1, -(-asked.count() // block))
    spark, result = vectors.sparkSession, None
    for b in range(blocks):
        part = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)).toPandas()
        if part.empty:
            continue
        sent = spark.sparkContext.broadcast((part.id.to_numpy(), np.array(part.v.tolist(), dtype=np.float64)))

        def scan(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            ids, q = sent.value
            near = np.full((len(ids), 0), np.inf)
            who = np.zeros((len(ids), 0), dtype=np.int64)
            for batch in batches:
                v = np.array(batch.v.tolist(), dtype=np.float64)
                if not len(v):
                    continue
                own = batch.id.to_numpy()
                d = np.sqrt(np.maximum(0.0, np.stack([((v - x) ** 2).sum(axis=1) for x in q])))
                d[ids[:, None] == own[None, :]] = np.inf
                near, who = np.concatenate([near, d], axis=1), np.concatenate([who, np.broadcast_to(own, d.shape)], axis=1)
                order = np.lexsort((who, near), axis=1)[:, :k]
                near, who = np.take_along_axis(near, order, 1), np.take_along_axis(who, order, 1)
            keep = np.isfinite(near)
            yield pd.DataFrame({"query_id": np.repeat(ids, keep.sum(axis=1)), "neighbour_id": who[keep], "distance": near[keep]})

        local = narrow.mapInPandas(scan, "query_id long, neighbour_id long, distance double")
        if blocks > 1:
            local = cut_lineage(local)
            sent.destroy()
        result = local if result is None else result.unionByName(local)
    if result is None:
        return spark.createDataFrame([], "query_id long, neighbour_id long, distance double, place int")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbour_id"))
    return result.withColumn("place", place).where(F.col("place") <= k)
