import numpy as np
import pytest
from pyspark.sql import functions as F
from test_vectors import NAMES, bars, long, rows, same  # noqa: F401

from barloom.operators import analysis, kept, vectors

ACROSS = ["cs_momentum_rank_20", "cs_liquidity_risk_score", "market_breadth", "market_mean_return"]
OWN = [n for n in NAMES if n not in ACROSS]


@pytest.fixture(scope="module")
def held(bars):  # noqa: F811
    return kept.kept_bars(bars.withColumn("bucket", F.pmod(F.hash("symbol"), F.lit(3))))


@pytest.fixture(scope="module")
def every(bars):  # noqa: F811
    return [*NAMES, *(n for n in ACROSS if n not in NAMES)], vectors.vectors(bars, [*NAMES, *(n for n in ACROSS if n not in NAMES)], 5).localCheckpoint()


def test_bars_come_back_exactly(bars, held):  # noqa: F811
    """Values, nulls, gaps and the order of symbols, labels within their symbol alone."""
    want = bars.toPandas().sort_values(["symbol", "date"])
    got = [x for b in held.toArrow().to_batches() for x in kept.opened([b], ["momentum_1"], 5)]
    by = {s: (k, a) for k, (symbols, starts, *_) in enumerate(got) for s, a in zip(symbols, starts, strict=True)}
    assert len(by) == want.symbol.nunique()
    for symbol, own in want.groupby("symbol"):
        k, a = by[symbol]
        _, _, day, label, values = got[k]
        b = a + len(own)
        assert day[a:b].tolist() == own.date.to_numpy().astype("datetime64[D]").astype(int).tolist()
        for c in ("open", "close", "amount", "turnover"):
            np.testing.assert_array_equal(values[c][a:b], own[c].to_numpy(float))
        assert np.isnan(label[b - 5 : b]).all()
        np.testing.assert_allclose(label[a : b - 5], own.close.to_numpy()[5:] / own.close.to_numpy()[:-5] - 1, rtol=1e-12)


def test_packed_values():
    for v in ([1.5, np.nan, -2.000001, 0.0], [1 / 3, np.nan], [-0.0, 1e300, np.inf], []):
        v = np.array(v)
        got = kept._unpacked(kept._packed(v), len(v))
        np.testing.assert_array_equal(got, v)
        assert np.signbit(got[~np.isnan(v)]).tolist() == np.signbit(v[~np.isnan(v)]).tolist()


def test_daily_statistics(held, every):
    names, x = every
    same(kept.ic_series(held, names, 5), vectors.ic_series(x, names), ["date", "factor"])
    same(kept.quantile_returns(held, names, 5), vectors.quantile_returns(x, names), ["date", "factor", "quantile"])


@pytest.mark.parametrize("most", [2_000_000, 40])
def test_regimes(held, every, most, monkeypatch):
    """Of factors by symbol and of those across symbols, in one range and in many."""
    names, x = every
    monkeypatch.setattr(vectors, "TASK_ROWS", most)
    regimes = x.select("date", F.when(F.dayofmonth("date") < 9, "a").when(F.dayofmonth("date") < 20, "b").otherwise("c").alias("regime")).distinct()
    codes = {r.date: r.code for r in vectors._coded(regimes)[1].collect()}
    same(vectors.regime_rank_ic(held, regimes, OWN, 1000, source=kept.with_codes(codes, OWN, 5)), vectors.regime_rank_ic(x, regimes, names, 1000).where(F.col("factor").isin(OWN)), ["factor", "regime"])
    same(vectors.regime_rank_ic(kept.packed_dates(held, codes, ACROSS, 5), regimes, ACROSS, 1000), vectors.regime_rank_ic(x, regimes, names, 1000).where(F.col("factor").isin(ACROSS)), ["factor", "regime"])


def test_ties_of_large_dates():
    """Rows of ties and of none at once, against a plain count."""
    rnd = np.random.default_rng(2)
    x = np.where(rnd.random((4, 60)) < 0.1, np.nan, rnd.random((4, 60)))
    x[1::2] = np.round(x[1::2], 1)
    want = np.array([[np.nan if np.isnan(v) else (row < v).sum() + ((row == v).sum() + 1) / 2 for v in row] for row in x])
    np.testing.assert_array_equal(vectors.average_ranks(x), want)


def test_source_is_read_once_for_all_blocks(spark, monkeypatch):
    """However many blocks the factors take, bars are derived once, and once more for the regimes."""
    from barloom.plans import research

    root, made, bars_of = "/root/testdata/sf0.001", [], research.bars
    monkeypatch.setattr(research, "bars", lambda *a: (made.append(a), bars_of(*a))[1])
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 300_000)
    factors = [*research.CHOSEN, "up_streak", "cs_momentum_rank_20", "market_breadth"]
    for name, most in (("ic_series_all", 1), ("monotonicity_all", 1), ("regime_rank_ic_all", 2)):
        made.clear()
        assert research.QUERIES[name].func(spark, root, factors).count() and len(made) == most, name
