import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import text as T
from barloom.operators import evaluation as V
from barloom.operators import features as X
from barloom.operators import links as L
from barloom.operators.ranking import pooled_quantiles


def day(k):
    return dt.date(2023, 1, k)


def test_event_columns_join_and_fill(spark):
    panel = spark.createDataFrame([(day(1), "a", 1.0), (day(2), "a", 2.0)], "date date, symbol string, close double")
    factors = spark.createDataFrame([(1, day(1), "a", 3, "x"), (2, day(1), "a", 5, None), (3, None, "a", 9, "y")], "row_id long, date date, symbol string, event_count_20d int, latest_event_type string")
    got = sorted((r.date.day, r.event_count_20d, r.latest_event_type) for r in X.with_event_factors(panel, factors, "row_id").collect())
    assert got == [(1, 5.0, ""), (2, 0.0, "")]
    assert X.with_event_factors(panel, factors.limit(0), "row_id").count() == 2
    assert X.feature_version(["a", "b"], [1], "s") != X.feature_version(["b", "a"], [1], "s")


def test_audit_and_coverage(spark):
    df = spark.createDataFrame([(1.0, None, 0.0), (2.0, None, 0.0), (None, 1.0, 0.0)], "good double, rare double, flat double")
    got = {r.feature: r for r in X.feature_audit(df, ["good", "rare", "flat", "gone"]).collect()}
    assert (got["good"].quality_status, got["good"].failed_reasons, got["good"].distinct_values) == ("watchlist", "low_matrix_coverage", 2)
    assert got["flat"].failed_reasons == "all_zero_event_feature;constant_event_feature" and got["gone"].failed_reasons == "missing_feature_column"
    assert {r.coverage for r in X.feature_audit(df.limit(0), ["good"]).collect()} == {0.0}
    assert X.covered(df, ["rare", "good", "flat"]) == ["good", "flat"]
    audited = X.audit_columns(df.withColumn("source", F.lit("own")), "s").first()
    assert audited.source == "own" and audited.audit_source == "s" and audited.raw_hash == audited.audit_raw_hash and audited.announce_date is None


def test_scope_forces_the_target(spark):
    events = spark.createDataFrame([(k, "b" if k else "a", 0.5, None, float(k), None) for k in range(5)], "row_id long, symbol string, source_reliability double, entity_link_confidence double, weighted_impact_score double, published_at timestamp")
    symbols = spark.createDataFrame([("a",), ("b",), ("c",)], "symbol string")
    assert [r.row_id for r in X.limited_scope(events, symbols, "a", 2, 3).collect()] == [0, 4, 3]
    assert X.limited_scope(events, symbols, "c", 1, 3).count() == 0 and X.limited_scope(events, symbols, "a", 0, 0).count() == 5


def test_session_moments(spark):
    rows = X.intraday_checkpoints(spark.createDataFrame([(1,)], "d int"), 9).collect()
    assert [r.label for r in rows] == ["09:30", "10:00", "10:30", "11:00", "11:30", "13:30", "14:00", "14:30", "15:00"] and rows[0].wave == rows[-1].wave == 0.0


def test_json_urls_and_pages(spark):
    body = '{"list": [{"name": "One", "href": "/a", "pubDate": "2023-01-02", "more": {"title": "Two"}}, {"memo": "none"}], "title": "Top", "url": "b.html"}'
    df = spark.createDataFrame([(body, "https://x.org/p/i.html", 3), ("{", "u", 1), (None, None, None), ("[" * 3000 + "]" * 3000, "u", 0)], "body string, base string, n int")
    first, bad, empty, deep = df.select(T.items_in(F.col("body"), F.col("base")).alias("i"), T.page_urls(F.col("base"), F.col("n")).alias("p"), T.joined_url(F.col("base"), F.lit("../q")).alias("j")).collect()
    assert [(r.title, r.url, r.date) for r in first.i] == [("Top", "https://x.org/p/b.html", ""), ("One", "https://x.org/a", "2023-01-02"), ("Two", "https://x.org/p/i.html", "")]
    assert first.p == ["https://x.org/p/i.html", "https://x.org/p/i_1.html", "https://x.org/p/i_2.html"] and first.j == "https://x.org/q"
    assert bad.i == [] and empty.i == [] and empty.p is None and deep.i == []


def test_links_take_the_surest_route(spark):
    texts = spark.createDataFrame([(1, "Alpha Mines and 000002", "000001", None), (2, "alpha mines up", None, ["000003", "999999"]), (3, "ZINC and tin rise", None, None), (4, None, None, None)], "id long, text string, symbol string, related array<string>")
    symbols = spark.createDataFrame([("000001", "Alpha Mines"), ("000002", None), ("000003", "Be")], "symbol string, name string")
    words = spark.createDataFrame([("zinc", "000002"), ("tin", "000002"), ("alpha", "000003")], "keyword string, symbol string")
    got = sorted((r.id, r.symbol, r.method, round(r.confidence, 2), r.keywords) for r in L.linked_symbols(texts, symbols, words).collect())
    assert got == [
        (1, "000001", "explicit_symbol", 1.0, "000001"), (1, "000002", "code_mention", 0.95, "000002"), (2, "000001", "name_mention", 0.85, "alpha mines"),
        (2, "000003", "provided_related_symbols", 0.95, "000003"), (3, "000002", "theme_keyword", 0.64, "tin,zinc"),
    ]
    blocks = {(r.id, r.phrase) for r in L.phrases_in(texts, words.select(F.col("keyword").alias("phrase")), block=1).collect()}
    assert blocks == {(r.id, r.phrase) for r in L.phrases_in(texts, words.select(F.col("keyword").alias("phrase"))).collect()} == {(1, "alpha"), (2, "alpha"), (3, "zinc"), (3, "tin")}
    assert L.phrases_in(texts, words.limit(0).select(F.col("keyword").alias("phrase"))).count() == 0


def test_pooled_quantiles_against_numpy(spark):
    rnd = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": rnd.choice(["a", "b"], 500), "x": rnd.integers(0, 40, 500).astype(float)})
    got = pooled_quantiles(spark.createDataFrame(pdf), ["g"], "x", {"lo": 0.33, "mid": 0.5, "top": 1.0}).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        np.testing.assert_allclose(got.loc[g, ["lo", "mid", "top"]].astype(float), np.quantile(part.x, [0.33, 0.5, 1.0]))


def test_calibration_is_chosen_fitted_again_and_applied(spark):
    rnd = np.random.default_rng(3)
    rows = []
    for fold in (0, 1, 2):
        for k in range(60 if fold == 2 else 900):
            p = rnd.random()
            up = rnd.random() < (0.2 + 0.3 * p if fold == 0 else p)
            rows.append((fold, dt.date(2023, 1, 1) + dt.timedelta(days=k // 10), p, float(up), "clash"))
    df = spark.createDataFrame(rows, "fold int, date date, prob_up double, direction double, curve string")
    fits = {r.fold: r for r in V.fold_calibrations(df, ["fold"]).collect()}
    assert fits[0].status == "calibrated" and fits[0].method != "identity" and fits[0].calibrated_brier < fits[0].raw_brier and len(fits[0].candidates.split(";")) == 3
    assert (fits[2].method, fits[2].status) == ("identity_insufficient", "calibration_sparse")
    assert abs(fits[0].curve[100] - 0.35) < 0.08 and fits[2].curve[100] == pytest.approx(0.5)
    out = V.calibrated(df.drop("curve"), V.fold_calibrations(df, ["fold"]).where("fold = 0"), ["fold"]).toPandas()
    assert (out.prob_up[out.fold > 0] == out.raw_prob_up[out.fold > 0]).all() and out.prob_up[out.fold == 0].between(0.1, 0.6).all()
    y, n = np.array([1.0, 0.0, 3.0]), np.array([2.0, 2.0, 3.0])
    np.testing.assert_allclose(V.Calibrator("isotonic").fit(np.array([0.1, 0.2, 0.9]), y, n)(np.array([0.1, 0.2, 0.9])), [0.25, 0.25, 1.0])
