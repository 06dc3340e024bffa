import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_reference_operators import make_bars

from barloom.operators import wide
from barloom.operators.factors import FACTORS, factor_panel


@pytest.fixture(scope="module")
def bars(spark):
    """Symbols with gaps, among them one of a single bar and one of few."""
    pdf = make_bars(9, 130)
    rnd = np.random.default_rng(3)
    pdf = pdf[((rnd.random(len(pdf)) > 0.1) | (pdf.symbol < "000003")) & ((pdf.symbol != pdf.symbol.max()) | (pdf.date == pdf.date.max()))]
    return spark.createDataFrame(pdf).localCheckpoint()


@pytest.mark.parametrize(("chunk", "block"), [(25_000, 10**9), (200, 8 * 1_200 * 3)])
def test_buckets_hold_the_panel(bars, chunk, block, monkeypatch):
    """Many symbols at once give what each gives alone, in one block of ranks and in several, in one chunk and in many."""
    monkeypatch.setattr(wide, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(wide, "BLOCK_BYTES", block)

    def make(part, values, starts):
        return pa.table({"date": part["date"].cast(pa.date32()), "symbol": part["symbol"].cast(pa.string()), **{n: pa.array(values[n], from_pandas=True) for n in FACTORS}})

    schema = "date date, symbol string, " + ", ".join(f"{n} double" for n in FACTORS)
    inside = bars.withColumn("bucket", F.pmod(F.hash("symbol"), F.lit(2)))
    got = wide.over_buckets(inside, 1_200, FACTORS)(make, schema).toPandas()
    want = factor_panel(bars, FACTORS).toPandas()
    got, want = (df.sort_values(["symbol", "date"]).reset_index(drop=True) for df in (got, want))
    assert got[["symbol", "date"]].astype(str).equals(want[["symbol", "date"]].astype(str))
    for n in FACTORS:
        np.testing.assert_allclose(got[n].astype(float), want[n].astype(float), rtol=1e-7, atol=1e-9, equal_nan=True, err_msg=n)


def test_panel_is_not_shuffled_wide(spark):
    """What factor_panel_all sends between tasks are narrow columns, or bytes by date and bucket."""
    from barloom.plans.factors import factor_panel_all

    plan = factor_panel_all(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(bucket") == 2 and "hashpartitioning(symbol" not in plan and "Window [rank" not in plan


def test_ridge_from_sums_is_that_of_mllib(spark):
    """The query itself against the pipeline over a written panel."""
    from barloom.operators.evaluation import ridge_forecast
    from barloom.plans import evaluation, research

    root = "/root/testdata/sf0.001"
    rows = research.panel(spark, root, FACTORS).withColumn("train", F.col("date") < "2000-01-01").localCheckpoint()
    want = ridge_forecast(rows, FACTORS, "label", "train").where("NOT train").select("date", "symbol", "label", "prediction").toPandas()
    got = evaluation.mllib_ridge(spark, root).toPandas()
    got, want = (df.sort_values(["symbol", "date"]).reset_index(drop=True) for df in (got, want))
    assert len(want) and got[["symbol", "date"]].astype(str).equals(want[["symbol", "date"]].astype(str))
    for n in ("label", "prediction"):
        np.testing.assert_allclose(got[n].astype(float), want[n].astype(float), rtol=1e-6, atol=1e-9, equal_nan=True)


def test_ridge_writes_no_panel(spark, monkeypatch):
    """No factor reaches a table: what is kept are ranks as bytes."""
    from barloom.operators import wide as W
    from barloom.plans import evaluation

    kept, cut = [], W.cut_lineage
    monkeypatch.setattr(W, "cut_lineage", lambda df: (kept.append(df.columns), cut(df))[1])
    monkeypatch.setattr(evaluation, "cut_lineage", lambda df: pytest.fail("written"))
    assert evaluation.mllib_ridge(spark, "/root/testdata/sf0.001").columns == ["date", "symbol", "label", "prediction"]
    assert kept == [["bucket", "date", "ranks"]]


def test_what_is_ranked_takes_few_bytes():
    """Whole numbers come back exactly, and take fewer bytes than doubles in a compressed shuffle."""
    rnd = np.random.default_rng(5)
    x = np.round(rnd.normal(0, 0.1, (12, 5)) * 1e9)
    x[3, 1], x[4] = np.nan, 0.0
    for v in (x, x * 1e4, np.full((2, 3), np.nan), np.where(x > 0, 1e300, x)):
        np.testing.assert_array_equal(wide._met(wide._sent(v), v.shape[1]), v)
    many = [np.round(rnd.normal(0, 0.1, (12, 5)) * 1e9) for _ in range(500)]
    size = lambda parts: len(pa.compress(b"".join(parts), "lz4_raw", asbytes=True))
    assert size([wide._sent(v) for v in many]) < 0.75 * size([v.tobytes() for v in many])
