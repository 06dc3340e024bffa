import numpy as np
import pandas as pd

from barloom.operators import analysis


def test_correlations_read_the_panel_once(spark):
    """Batches and tasks of different levels and scales, columns first known late or constant; one pass over the panel."""
    rnd = np.random.default_rng(5)
    n = 4000
    base = rnd.normal(size=n)
    pdf = pd.DataFrame({"a": base + 30 * (np.arange(n) > 2000), "b": base * 1e-6 + rnd.normal(size=n) * 1e-6, "c": np.where(np.arange(n) > 2500, base**2, np.nan), "d": np.full(n, 0.1), "e": rnd.normal(size=n)})
    df = spark.createDataFrame(pdf).repartition(3)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = {r.factor: r for r in analysis.factor_correlations(df.mapInPandas(counted, df.schema), list(pdf)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert read.value == n
    want = pdf.corr().abs()
    np.fill_diagonal(want.values, np.nan)
    assert set(got) == set("abce")
    for f in "abce":
        assert got[f].max_corr_factor == want[f].idxmax()
        np.testing.assert_allclose(got[f].max_abs_correlation, want[f].max(), rtol=1e-8)
