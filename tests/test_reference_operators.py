import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import text as T
from barloom.operators import analysis, evaluation, events, portfolio, quality
from barloom.operators.factors import FACTORS, factor_panel
from barloom.operators.ranking import pooled_ranks
from barloom.sources.warehouse import Warehouse, first_available, missing, upsert
from barloom.streaming import events as streams


def make_bars(symbols=3, n=150, seed=3):
    rnd = np.random.default_rng(seed)
    days = pd.bdate_range("2022-01-03", periods=n)
    out = []
    for k in range(symbols):
        close = 20 * np.exp(np.cumsum(rnd.normal(0, 0.02, n)))
        open_ = close * (1 + rnd.normal(0, 0.005, n))
        high, low = np.maximum(open_, close) * (1 + rnd.random(n) / 50), np.minimum(open_, close) * (1 - rnd.random(n) / 50)
        volume = rnd.integers(1, 500, n) * 100.0
        out.append(pd.DataFrame({"date": days.date, "symbol": f"{k:06d}", "open": open_, "high": high, "low": low, "close": close, "volume": volume, "amount": volume * close, "turnover": rnd.random(n) * 5}))
    return pd.concat(out)


@pytest.fixture(scope="module")
def pdf():
    return make_bars()


@pytest.fixture(scope="module")
def bars(spark, pdf):
    return spark.createDataFrame(pdf)


def test_there_are_237_factors():
    assert len(FACTORS) == len(set(FACTORS)) == 237


def test_smoothed_and_path_factors_against_pandas(spark, bars, pdf):
    names = ["ema_bias_12", "macd_signal", "kdj_k_9", "kdj_j_9", "max_drawdown_20", "return_autocorr_20", "amount_percentile_20", "return_kurt_20", "up_streak"]
    got = factor_panel(bars, names).toPandas().sort_values(["symbol", "date"]).set_index("symbol").loc["000001"].reset_index()
    b = pdf[pdf.symbol == "000001"].reset_index(drop=True)
    r = b.close.pct_change()
    ema = lambda w, least: b.close.ewm(span=w, adjust=False, min_periods=least).mean()
    raw = ema(12, 10) - ema(26, 17)
    low, high = b.low.rolling(20, min_periods=13).min(), b.high.rolling(20, min_periods=13).max()
    k = ((b.close - low) / (high - low) * 100).ewm(alpha=1 / 3, adjust=False, min_periods=6).mean()
    d = k.ewm(alpha=1 / 3, adjust=False, min_periods=6).mean()
    run = (r > 0).astype(int)
    want = {
        "ema_bias_12": b.close / ema(12, 10) - 1,
        "macd_signal": raw.ewm(span=9, adjust=False, min_periods=6).mean() / b.close,
        "kdj_k_9": k,
        "kdj_j_9": 3 * k - 2 * d,
        "max_drawdown_20": b.close.rolling(20, min_periods=13).apply(lambda x: (x / np.maximum.accumulate(x) - 1).min(), raw=True),
        "return_autocorr_20": r.rolling(20, min_periods=13).apply(lambda x: x.dropna().autocorr(1), raw=False),
        "amount_percentile_20": b.amount.rolling(20, min_periods=13).apply(lambda x: x.rank(pct=True).iloc[-1], raw=False),
        "return_kurt_20": r.rolling(20, min_periods=15).kurt(),
        "up_streak": run.groupby((run != run.shift()).cumsum()).cumsum().where(run == 1, 0).astype(float),
    }
    for name, series in want.items():
        np.testing.assert_allclose(got[name].astype(float), series, rtol=1e-7, atol=1e-10, err_msg=name)


def test_both_ways_of_computing_agree(spark, pdf):
    """Window expressions and the pass per symbol, on bars with nulls, standstills and a short history."""
    from barloom.operators.factors import NODES, Columns

    dirty = pdf.copy()
    dirty.loc[dirty.symbol == "000002", ["open", "high", "low", "close"]] = 7.0
    dirty.iloc[40:44, dirty.columns.get_loc("close")] = np.nan
    dirty = pd.concat([dirty, make_bars(1, 7).assign(symbol="900009")])
    df = spark.createDataFrame(dirty).replace(float("nan"), None)
    names = []
    for name in FACTORS:
        seen, stack, smooth = set(), [name], False
        while stack:
            n = stack.pop()
            if n in NODES and n not in seen:
                seen.add(n)
                stack += NODES[n][0]
                ops = Columns()
                NODES[n][1](ops)
                smooth |= ops.rows == float("inf")
        if not smooth and not name.startswith(("cs_", "market_")):
            names.append(name)
    assert len(names) > 200
    a, b = (factor_panel(df, names, long_frames=limit).toPandas().sort_values(["symbol", "date"]).reset_index(drop=True) for limit in (float("inf"), -1))
    for name in names:
        x, y = a[name].astype(float), b[name].astype(float)
        scale = max(1.0, x.abs().max())
        np.testing.assert_allclose(x / scale, y / scale, rtol=1e-6, atol=1e-9, err_msg=name)


def test_panel_plans_only_what_is_asked(bars):
    plan = factor_panel(bars, ["momentum_20"])._jdf.queryExecution().optimizedPlan().toString()
    assert "turnover" not in plan and plan.count("Window") == 1


def test_pooled_ranks_against_pandas(spark):
    rnd = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rnd.choice(["a", "b"], 3000), "x": rnd.integers(0, 200, 3000).astype(float)})
    pdf.loc[::50, "x"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    got = pooled_ranks(df, ["g"], "x", "k", "t").toPandas()
    got["want"] = got.groupby("g").x.rank()
    np.testing.assert_allclose(got.k.astype(float), got.want)
    known = got.dropna()
    assert (known.t == known.groupby(["g", "x"]).x.transform("size")).all()
    assert pooled_ranks(df.limit(0), ["g"], "x", "k").count() == 0


def test_targets_and_simulation_keep_their_invariants(spark, bars, pdf):
    dates = sorted(pdf.date.unique())[::10]
    rows = [(d, f"{(i + j) % 3:06d}", 0.45) for i, d in enumerate(dates) for j in range(2)]
    targets = spark.createDataFrame(rows, "date date, symbol string, weight double")
    capped = portfolio.capped_targets(targets, {"tight": 0.3, "free": 9.0})
    wide = capped.toPandas().pivot_table(index=["scenario", "date"], columns="symbol", values="weight", fill_value=0.0)
    for name, cap in (("tight", 0.3), ("free", 9.0)):
        moves = wide.loc[name].diff().abs().sum(axis=1).iloc[1:]
        assert (moves <= cap + 1e-9).all()
    ledger = portfolio.simulate(capped, bars, portfolio.Costs()).toPandas()
    trades, equity = ledger[ledger.kind == "trade"], ledger[ledger.kind == "equity"]
    assert len(trades) and (trades.shares % 100 == 0).all() and (equity.cash >= -1e-6).all()
    buys = trades[trades.shares > 0]
    sells = trades[trades.shares < 0]
    assert not set(map(tuple, buys[["scenario", "date", "symbol"]].values)) & set(map(tuple, sells[["scenario", "date", "symbol"]].values))
    np.testing.assert_allclose(buys.fee / buys.value, 0.0003)
    np.testing.assert_allclose((sells.fee + sells.tax) / -sells.value, 0.0013)
    for _, part in ledger.groupby("scenario"):
        spent = (part.value + part.fee + part.tax)[part.kind == "trade"].sum()
        held = part[part.kind == "holding"].groupby("date").value.sum()
        day = part[part.kind == "equity"].set_index("date").value
        np.testing.assert_allclose(day[held.index], held)
        bought = part[(part.kind == "trade") & (part.shares > 0)].value.sum()
        paid = (-part.value - part.fee - part.tax - part.realised)[(part.kind == "trade") & (part.shares < 0)].sum()
        assert bought - paid >= -1e-6  # the cost of what is still held
    metrics = portfolio.equity_metrics(spark.createDataFrame(ledger)).toPandas()
    assert len(metrics) == 2 and (metrics.max_drawdown <= 0).all() and metrics.win_rate.between(0, 1).all() and (metrics.total_turnover > 0).all()


def test_nearest_is_exact(spark):
    rnd = np.random.default_rng(5)
    v = rnd.normal(size=(300, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(999, None)], "id long, v array<double>").repartition(5)
    got = evaluation.nearest(df, df.where("id % 20 = 0"), row_id="id", vector="v", k=4, block=6).toPandas()
    assert len(got) == 15 * 4
    for q, part in got.groupby("query_id"):
        d = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        assert list(part.sort_values("place").neighbour_id) == list(np.argsort(d)[:4])


def test_prediction_metrics_by_hand(spark):
    rows = [("a", 0.9, 1.0, 0.1), ("a", 0.8, 0.0, -0.1), ("a", 0.3, 0.0, -0.2), ("a", 0.2, 1.0, 0.05)]
    df = spark.createDataFrame(rows, "g string, prob_up double, direction double, label double")
    m = evaluation.prediction_metrics(df, ["g"]).first()
    assert (m.rows, m.direction_accuracy, m.baseline_accuracy, m.auc) == (4, 0.5, 0.5, 0.5)
    assert abs(m.brier - (0.01 + 0.64 + 0.09 + 0.64) / 4) < 1e-12
    assert m.top_bucket_return == 0.1 and m.bottom_bucket_return == 0.05


def test_prior_outcomes_are_strictly_earlier(spark):
    day = lambda k: dt.date(2023, 1, k)
    rows = [(1, "x", 5, day(1), 0.1, day(3)), (2, "x", 5, day(3), -0.2, day(5)), (3, "x", 5, day(4), None, None), (4, "x", 5, day(9), 0.3, day(11))]
    df = spark.createDataFrame(rows, "event_id int, kind string, horizon_days int, effective_date date, forward_return double, known_at date")
    got = {r.event_id: (r.prior_count, round(r.prior_mean_return, 6)) for r in events.prior_outcomes(df, ["kind"], ["event_id"]).collect()}
    assert got == {1: (0, 0.0), 2: (0, 0.0), 3: (1, 0.1), 4: (2, -0.05)}


def test_null_cohorts_stay_apart_and_medians_are_pooled(spark):
    rows = [("x", None, 0.1), (None, "x", 0.2), (None, "x", 0.4), ("x", "(null)", 0.3), (None, None, -0.1)]
    df = spark.createDataFrame([(*r, 0.0, 5, 0.5) for r in rows], "a string, b string, forward_return double, excess_return double, horizon_days int, m double")
    got = sorted((r.cohort_level, r.sample_count, round(r.median_return, 9)) for r in events.event_cohorts(df, [["a"], ["a", "b"]], ["m"]).collect())
    assert got == [("a", 2, 0.2), ("a", 3, 0.2), ("a_b", 1, -0.1), ("a_b", 1, 0.1), ("a_b", 1, 0.3), ("a_b", 2, 0.3)]
    assert events.event_cohorts(df.limit(0), [["a"]]).count() == 0


def test_last_delivery_stays_and_nulls_are_alike(spark):
    df = spark.createDataFrame([(1, "h", "s"), (2, "h", "s"), (3, None, "s"), (4, None, "s"), (5, "h", None)], "row_id long, h string, s string")
    assert sorted(r.row_id for r in events.last_deliveries(df, ["h", "s"], "row_id").collect()) == [2, 4, 5]


def test_quality_on_dirty_rows(spark):
    rows = [("2023-01-02", "1", "10", "11", "9", "10", "5", "50", "1", 1), ("2023-01-02", "1", "10", "11", "9", "10.5", "5", "50", "1", 2), ("2023-01-03", "000001", "-1", "11", "9", "10", "5", "50", "1", 3), ("2023-01-04", "x1", "bad", "1", "1", "1", "1", "1", "1", 4)]
    raw = spark.createDataFrame(rows, "date string, symbol string, open string, high string, low string, close string, volume string, amount string, turnover string, seq int")
    clean = quality.normalize_bars(raw, "seq").collect()
    assert [(r.symbol, r.close) for r in clean] == [("000001", 10.5)]
    assert {r.issue for r in quality.quality_issues(spark.createDataFrame([(dt.date(2023, 1, 2), "a", -1.0, 1.0, 2.0, 1.0, 1.0, -1.0, None)] * 2, "date date, symbol string, open double, high double, low double, close double, volume double, amount double, turnover double")).collect()} == {"duplicate_dates", "missing_cells", "non_positive_price", "high_low_error", "amount_error"}


def test_labels_at_the_end_are_null(spark, bars):
    labels = analysis.return_labels(bars, [5]).where("symbol = '000000'").orderBy("date").collect()
    assert labels[-1].future_return_5d is None and labels[-1].future_upside_5d is None and labels[-1].direction_up_5d is None
    assert labels[-2].future_downside_5d is not None


def test_text_columns(spark):
    page = "<p><A class='x' href=\"/a?b=1\">One &amp; <b>two</b></A> text <a href='c'> three </a>"
    df = spark.createDataFrame([(page, "on 2023年1月5日 600000 and 12345678 and 000001", "20230230", b"\xb9\xc9"), (None, None, None, None)], "page string, body string, other string, raw binary")
    r, empty = df.select(T.links_in(F.col("page")).alias("links"), T.date_in(F.col("body")).alias("d"), T.date_in(F.col("other")).alias("bad"), T.codes_in(F.col("body")).alias("codes"), T.unescaped(F.col("page")).alias("u"), T.decoded(F.col("raw")).alias("raw"), T.moment(F.lit("1700000000000")).alias("m")).collect()
    assert [tuple(x) for x in r.links] == [("/a?b=1", "One &amp; two"), ("c", "three")]
    assert (r.d, r.bad, r.codes, r.raw) == (dt.date(2023, 1, 5), None, ["600000", "000001"], "股") and "One & " in r.u and r.m.year == 2023
    assert empty.links is None and empty.d is None and empty.u is None


def test_warehouse_and_sources(spark, tmp_path, bars):
    w = Warehouse(spark, str(tmp_path))
    small = bars.limit(5)
    for fmt in ("parquet", "csv", "json", "orc"):
        w.write(small, "bars", fmt)
        assert w.read("bars").schema == small.schema and w.read("bars").count() == 5
    assert w.manifest().count() == 1
    with pytest.raises(KeyError):
        w.read("none")
    a, b = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "b"), (2, "b")], "k int, v string")
    got = first_available([("gone", lambda: spark.read.parquet("/nowhere")), ("a", lambda: a), ("b", lambda: b)], ["k"])
    assert sorted((r.k, r.v, r.source) for r in got.collect()) == [(1, "a", "a"), (2, "b", "b")]
    assert [r.k for r in missing(b, a, ["k"]).collect()] == [2]
    assert sorted((r.k, r.v) for r in upsert(a, b, ["k"]).collect()) == [(1, "b"), (2, "b")]


def test_streams_agree_with_batches(spark, tmp_path):
    rows = [(k % 3, dt.datetime(2023, 1, 1) + dt.timedelta(minutes=7 * k)) for k in range(200)]
    df = spark.createDataFrame(rows, "key int, ts timestamp")
    df.write.parquet(str(tmp_path / "in"))
    stream = streams.event_stream(spark, str(tmp_path / "in"), df.schema)
    counts = streams.drained(streams.windowed_counts(stream, time="ts", key="key", size="1 hour"), "complete")
    want = df.groupBy("key", F.window("ts", "1 hour").start.alias("window_start")).agg(F.count(F.lit(1)).alias("events"))
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, want.collect()))
    assert streams.drained(streams.first_deliveries(stream, time="ts", key=["key"], late="30 days")).count() == 3
    assert streams.drained(streams.session_counts(stream, time="ts", key="key", gap="22 minutes"), "complete").where("events > 1").count() == 3


def test_dense_panel_paths_and_mentions(spark):
    from barloom.operators import panels

    d = lambda k: dt.date(2023, 1, k)
    df = spark.createDataFrame([("a", d(2), 1.0), ("a", d(4), 3.0), ("b", d(3), 5.0)], "symbol string, date date, close double")
    got = sorted((r.symbol, r.date.day, r.close, r.filled) for r in panels.dense_prices(df).collect())
    assert got == [("a", 2, 1.0, False), ("a", 3, 1.0, True), ("a", 4, 3.0, False), ("b", 3, 5.0, False)]
    anchors = spark.createDataFrame([("a", 2, 1.0), ("a", 4, 3.0), ("a", None, 9.0), ("b", 3, None)], "k string, h int, v double")
    path = {r.step: r.v for r in panels.interpolated(anchors, ["k"], "h", "v", 5).collect()}
    assert path == {1: 1.0, 2: 1.0, 3: 2.0, 4: 3.0, 5: 3.0}
    rows = spark.createDataFrame([(d(1 + k // 2), float(k), 2.0 * k + 1) for k in range(8)], "date date, x double, y double")
    lines = {r.date.day: (r.known_rows, round(r.alpha, 9), round(r.beta, 9)) for r in panels.expanding_line(rows, 4).collect()}
    assert lines == {3: (4, 1.0, 2.0), 4: (6, 1.0, 2.0)}
    texts = spark.createDataFrame([(1, "on 600000,000001 600000"), (2, None), (3, "6000001")], "i int, t string")
    known = spark.createDataFrame([("600000",), ("000002",)], "symbol string")
    assert [tuple(r) for r in panels.mentioned_symbols(texts, "i", "t", known).collect()] == [(1, "600000")]


def test_every_factor_is_analysed(spark, bars):
    """Against brute force over the whole registry: the closest partner may lie outside any shortlist."""
    from barloom.plans import evaluation as plans_evaluation
    from barloom.plans import research

    names = "ic_series ic_summary ic_yearly quantile_returns factor_coverage monotonicity rank_turnover cost_adjusted_spread half_life regime_rank_ic factor_correlations".split()
    whole = {**{n: research.QUERIES[f"{n}_all"] for n in names}, "factor_contributors": plans_evaluation.QUERIES["factor_contributors_all"]}
    assert all(f.keywords["factors"] == FACTORS for f in whole.values())

    panel = factor_panel(bars, FACTORS, ("date", "symbol", "close")).withColumn("label", analysis.future(5)).persist()
    wide = panel.toPandas()
    values = wide[FACTORS].astype(float)
    want = values.corr(min_periods=2).abs().to_numpy(copy=True)
    np.fill_diagonal(want, np.nan)
    got = analysis.factor_correlations(panel, FACTORS).toPandas().set_index("factor")
    assert got.max_corr_factor["momentum_20"] == "reversal_20" and abs(got.max_abs_correlation["momentum_20"] - 1) < 1e-9
    varied = [f for f in FACTORS if values[f].nunique() > 1]
    assert set(got.index) <= set(varied) and len(got) > 200
    for f, best in got.max_abs_correlation.items():
        assert abs(best - np.nanmax(want[FACTORS.index(f)])) < 1e-6, f

    long = analysis.long_form(panel, FACTORS, "label")
    coverage = analysis.coverage(long).toPandas().set_index("factor").coverage
    assert set(coverage.index) == set(FACTORS)
    for f in FACTORS:
        assert abs(coverage[f] - (values[f].notna() & wide.label.notna()).mean()) < 1e-12


def test_ridge_takes_every_feature_with_known_values(spark, bars):
    rows = factor_panel(bars, ["momentum_20", "reversal_20", "momentum_240"], ("date", "symbol", "close")).withColumn("label", analysis.future(5)).withColumn("train", F.lit(True))
    assert evaluation.ridge_forecast(rows, ["momentum_20", "reversal_20", "momentum_240"], "label", "train").where("prediction IS NULL").count() == 0


def test_similar_events_are_searched_among_all_earlier_ones(spark):
    """Against brute force, with symbols of one to thirty events: matches lie further back and on other symbols."""
    rnd = np.random.default_rng(5)
    nouns, verbs, kinds = ["glass", "potash", "tin ingot", "benzene"], ["rumour about", "penalty for", "deal on"], ["risk", "order", ""]
    rows, symbols = [], [f"{s:06d}" for s in (1, 2, 3, 4) for _ in range(s * s * 2 - 1)]
    for i in range(60):
        at = dt.datetime(2024, 1, 1) + dt.timedelta(hours=int(rnd.integers(40))) if i % 17 else None
        rows.append((i, f"e{i % 50}", symbols[i % len(symbols)], at, str(rnd.choice(kinds)), "neutral", f"{rnd.choice(verbs)} {rnd.choice(nouns)}", f"case {rnd.integers(9)}" if i % 3 else None, None, "news"))
    names = ["row_id", "event_id", "symbol", "published_at", "event_type", "sentiment", "title", "summary", "entity_link_keywords", "source_category"]
    frame = spark.createDataFrame(rows, "row_id long, event_id string, symbol string, published_at timestamp, event_type string, sentiment string, title string, summary string, entity_link_keywords string, source_category string")
    known = [dict(zip(names, r, strict=True)) for r in rows if r[3]]
    for r in known:
        r["grams"] = events.char_grams(" ".join(r[n] or "" for n in names[4:]))
    want = {}
    for symbol in set(symbols):
        for q in sorted((r for r in known if r["symbol"] == symbol), key=lambda r: (r["published_at"], r["row_id"]))[-5:]:
            found = []
            for c in known:
                if c["published_at"] < q["published_at"] and c["event_id"] != q["event_id"]:
                    score = len(q["grams"] & c["grams"]) / len(q["grams"] | c["grams"])
                    if score >= 0.3:
                        found.append((c["symbol"] != symbol, c["event_type"] != q["event_type"], -score, -c["published_at"].timestamp(), c["row_id"]))
            for place, f in enumerate(sorted(found)[:5], 1):
                want[q["row_id"], place] = (f[4], round(-f[2], 9))
    for block in (4096, 3):
        got = {(r.query_id, r.place): (r.match_id, round(r.similarity, 9)) for r in events.similar_earlier(frame, least=0.3, block=block).collect()}
        assert got == want
    other = {r["row_id"]: r["symbol"] for r in known}
    assert any(other[q] != other[m] for (q, _), (m, _) in want.items()) and len(want) > 40


def test_vendor_layouts_and_generated_bars(spark, tmp_path):
    from barloom.operators.quality import quality_issues
    from barloom.sources import bars as B

    chinese = spark.createDataFrame([("2023-01-02", "1", "3", "0.5", "2", "10", "20", "x")], "`日期` string, `开盘` string, ` 最高 ` string, `最低` string, `收盘` string, `成交量` string, `成交额` string, `换手率` string")
    row = B.named_fields(chinese, scales={"volume": 100, "amount": 1000}).first()
    assert (str(row.date), row.open, row.high, row.volume, row.amount, row.turnover) == ("2023-01-02", 1.0, 3.0, 1000.0, 20_000.0, None)
    wide = spark.createDataFrame([tuple(["20230103", "s", *map(str, range(2, 12))])], ", ".join(f"c{k} string" for k in range(12)))
    got = B.named_fields(wide).first()
    assert (str(got.date), got.open, got.close, got.turnover) == ("2023-01-03", 2.0, 3.0, 11.0)
    with pytest.raises(ValueError):
        B.named_fields(wide.select("c0", "c1"))
    codes = spark.createDataFrame([("600000",), ("430001",), ("000001",)], "s string").select(B.exchange_code(F.col("s")).alias("c"))
    assert [r.c for r in codes.collect()] == ["600000.SH", "430001.BJ", "000001.SZ"]
    made = B.generated_bars(spark, ["000001", "600000", "000001"], "2023-01-02", "2023-03-31")
    assert made.count() == 2 * 65 and quality_issues(made).count() == 0
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, B.generated_bars(spark, ["600000", "000001"], "2023-01-02", "2023-03-31").repartition(7).collect()))
    moves = made.toPandas().sort_values(["symbol", "date"]).groupby("symbol").close.pct_change()
    assert moves.abs().max() <= 0.095 + 1e-9 and moves.std() > 0.005
    manifest = B.write_bundle({"a": made, "b": made.limit(3).select("symbol", "close")}, str(tmp_path), notes={"run": 1})
    assert sorted((r.name, r.rows) for r in manifest.collect()) == [("a", 130), ("b", 3)]
    both = B.collected_files(spark, [f"{tmp_path}/a", f"{tmp_path}/b", f"{tmp_path}/a"])
    assert both.count() == 133 and both.where("open IS NULL").count() == 3 and both.select("file").distinct().count() >= 2
