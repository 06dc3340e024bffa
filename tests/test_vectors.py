import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_reference_operators import make_bars

from barloom.operators import analysis, vectors
from barloom.operators.factors import FACTORS, factor_panel

NAMES = ["momentum_5", "volatility_20", "limit_up_count_20", "up_streak", "max_drawdown_20", "cs_momentum_rank_20", "market_breadth", "momentum_240", "positive_body_ratio_20"]


@pytest.fixture(scope="module")
def bars(spark):
    pdf = make_bars(12, 90)
    rnd = np.random.default_rng(1)
    pdf = pdf[(rnd.random(len(pdf)) > 0.1) | (pdf.symbol < "000003")]
    return spark.createDataFrame(pdf).localCheckpoint()


@pytest.fixture(scope="module")
def long(bars):
    panel = factor_panel(bars, NAMES, ("date", "symbol", "close")).withColumn("label", analysis.future(5))
    return analysis.long_form(panel, NAMES, "label").localCheckpoint()


@pytest.fixture(scope="module")
def rows(bars):
    return vectors.vectors(bars, NAMES, 5).localCheckpoint()


def same(got, want, keys):
    g, w = (df.toPandas().sort_values(keys).reset_index(drop=True) for df in (got, want))
    assert len(w) and list(g[keys].itertuples(index=False)) == list(w[keys].itertuples(index=False))
    for c in w.columns.difference(keys):
        np.testing.assert_allclose(g[c].astype(float), w[c].astype(float), rtol=1e-9, atol=1e-9, equal_nan=True, err_msg=c)


def test_daily_correlations(rows, long):
    same(vectors.ic_series(rows, NAMES), analysis.ic_series(long), ["date", "factor"])


def test_buckets(rows, long):
    same(vectors.quantile_returns(rows, NAMES), analysis.quantile_returns(long), ["date", "factor", "quantile"])


def test_turnover_and_spread(rows, long):
    turnover = analysis.rank_turnover(long)
    same(vectors.rank_turnover(rows, NAMES), turnover, ["factor"])
    same(vectors.cost_adjusted_spread(rows, NAMES), analysis.cost_adjusted_spread(analysis.quantile_returns(long), turnover), ["factor"])


def test_sums_within_symbols(bars, long):
    same(vectors.coverage(bars, NAMES, 5), analysis.coverage(long), ["factor"])
    same(vectors.half_life(bars, NAMES).where("half_life_days IS NOT NULL"), analysis.half_life(long).where("half_life_days IS NOT NULL"), ["factor"])


@pytest.mark.parametrize("most", [2_000_000, 40])
def test_ranks_pooled_over_regimes(bars, rows, long, most, monkeypatch):
    """In one range, and in many; from vectors and from columns."""
    monkeypatch.setattr(vectors, "TASK_ROWS", most)
    regimes = rows.select("date", F.when(F.dayofmonth("date") < 9, "a").when(F.dayofmonth("date") < 20, "b").otherwise("c").alias("regime")).distinct()
    want = analysis.regime_rank_ic(long, regimes)
    panel = factor_panel(bars, NAMES, ("date", "symbol", "close")).withColumn("label", analysis.future(5))
    for source in (rows, panel):
        same(vectors.regime_rank_ic(source, regimes, NAMES, 1000), want, ["factor", "regime"])


def test_blocks_hold_all_factors(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 100)
    found = lambda names: (seen.append(names), spark.createDataFrame([(n,) for n in names], "factor string"))[1]
    got = vectors.in_blocks(FACTORS, 1, 8, found)
    assert sorted(r.factor for r in got.collect()) == sorted(FACTORS) and max(map(len, seen)) <= 12 and len(seen) == 20


def test_no_bar_is_widened_between_tasks(spark):
    """All factors' statistics of a symbol or a date are made without a row per bar and factor, and a bar's factors are shuffled once at most."""
    from barloom.plans import research

    root = "/root/testdata/sf0.001"
    for name in ("cost_adjusted_spread_all", "rank_turnover_all", "regime_rank_ic_all", "factor_coverage_all", "half_life_all", "ic_summary_all", "ic_yearly_all", "ic_series_all", "quantile_returns_all", "monotonicity_all",):
        plan = research.QUERIES[name](spark, root)._jdf.queryExecution().optimizedPlan().toString()
        assert "Expand" not in plan and "lead(" not in plan, name


def test_sparse_dates():
    x = np.array([[1.0, np.nan, 1.0, 3.0]])
    assert vectors.average_ranks(x)[0].tolist()[:1] == [1.5] and np.isnan(vectors.average_ranks(x)[0][1])
    assert np.isnan(vectors.correlations(np.full((1, 3), 0.1), np.array([[1.0, 2.0, 3.0]])))[0]
    assert pd.isna(vectors.correlations(np.empty((1, 0)), np.empty((1, 0)))[0])


def test_regimes_of_few_factors_in_blocks_and_ranges(spark, monkeypatch):
    """The query itself, a factor a block and many ranges a factor: the rows of the long form."""
    from barloom.plans import research

    root = "/root/testdata/sf0.001"
    source = research.panel(spark, root, [*research.CHOSEN, "market_mean_return"])
    want = analysis.regime_rank_ic(analysis.long_form(source, research.CHOSEN, "label"), analysis.market_regimes(source))
    monkeypatch.setattr(vectors, "TASK_ROWS", 2_000)
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 300_000)
    same(research.per_regime(spark, root, research.CHOSEN), want, ["factor", "regime"])


def test_bars_are_shuffled_once_and_read_once_for_all_blocks(spark, monkeypatch):
    """Bars take one shuffle, and the panel of few factors is computed once however many blocks their ranks take."""
    from barloom.plans import research

    root = "/root/testdata/sf0.001"
    plan = research.bars(spark, root)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    made, panel = [], research.panel
    monkeypatch.setattr(research, "panel", lambda *a: (made.append(a[2]), panel(*a))[1])
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 300_000)
    assert research.per_regime(spark, root, research.CHOSEN).count() == 15 and made == [research.CHOSEN]
