"""Queries on bar quality, labels, factor analysis and targets over derived bars, and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import analysis as A
from barloom.operators import kept as K
from barloom.operators import quality as Q
from barloom.operators import vectors as X
from barloom.operators.factors import ACROSS, FACTORS, factor_panel
from barloom.operators.wide import bucket_count
from barloom.plans.factors import OFF_TIES, VOLS, lag, over, roll
from barloom.session import cut_lineage
from barloom.sources import table
from barloom.sources.fixtures import BARS_SQL, bars

#: The factors whose results SQL states. Each query over them has a sibling NAME_all over every factor of the registry.
CHOSEN = ["momentum_20", "reversal_5", "volatility_20", "amount_mean_20", "intraday_return"]
WEIGHTS = {"momentum_20": 0.30, "reversal_5": 0.15, "volatility_20": -0.15, "amount_mean_20": 0.10}
QUERIES: dict = {}
SQL: dict[str, str] = {}


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded away from ties and dates as text, as results are compared by value."""
    kinds = {"double": lambda n: F.round(F.col(n) + OFF_TIES, digits) + 0.0, "date": lambda n: F.date_format(n, "yyyy-MM-dd")}
    return df.select(*[kinds.get(t, F.col)(n).alias(n) for n, t in df.dtypes])


def rounded(sql: str, columns: str, digits: int = 6) -> str:
    parts = ", ".join(f"round(CAST({c} AS DOUBLE) + {OFF_TIES}, {digits}) + 0.0 AS {c}" for c in columns.split())
    return f"SELECT * REPLACE ({parts}) FROM ({sql})"


def query(sql: str | None = None, dates: str = "", every: bool | Callable[..., DataFrame] = False):
    """Register a query; dates: the result's date columns, given as text; every: also NAME_all, over all factors, by the function given."""

    def add(f):
        QUERIES[f.__name__] = f
        if every:
            QUERIES[f"{f.__name__}_all"] = partial(f if every is True else every, factors=FACTORS)
        if sql:
            text = ", ".join(f"strftime({d}, '%Y-%m-%d') AS {d}" for d in dates.split())
            SQL[f.__name__] = f"SELECT * REPLACE ({text}) FROM ({sql})" if dates else sql
        return f

    return add


def panel(spark: SparkSession, root: str, factors: Sequence[str] = CHOSEN) -> DataFrame:
    df = factor_panel(bars(spark, root), factors, ("date", "symbol", "close", "amount"))
    return df.withColumn("label", A.future(5))


def long(spark: SparkSession, root: str, factors: Sequence[str] = CHOSEN) -> DataFrame:
    return A.long_form(panel(spark, root, factors), factors, "label")


def most_bars(spark: SparkSession, root: str) -> int:
    """As many bars as there can be: a day's shipments make one. Read from the files' footers."""
    return table(spark, root, "lineitem").count()


def by_date(spark: SparkSession, root: str, factors: Sequence[str], found: Callable[[DataFrame, list[str]], DataFrame], bytes_each: int = 8) -> DataFrame:
    """found of the vectors of factors, which are shuffled by date; bytes_each: of a factor of a bar, written in all."""
    return X.in_blocks(factors, most_bars(spark, root), bytes_each, lambda names: found(X.vectors(bars(spark, root), names, 5), names))


def kept_bars(spark: SparkSession, root: str, most: int) -> tuple[DataFrame, int]:
    """Bars written once, for all blocks of factors, and how many they are."""
    kept = K.kept_bars(bars(spark, root, bucket_count(most)))
    return kept, kept.agg(F.sum("n")).first()[0] or 0


def kept_blocks(factors: Sequence[str], count: int, bytes_each: int, found: Callable[[list[str]], DataFrame]) -> DataFrame:
    """in_blocks of kept bars, which make many blocks cheap: what a block shuffles is in proportion to the bars."""
    return X.in_blocks(factors, count, bytes_each, found, max(400_000_000, 60 * count))


def all_series(spark: SparkSession, root: str, factors: Sequence[str]) -> DataFrame:
    kept, count = kept_bars(spark, root, most_bars(spark, root))
    return kept_blocks(factors, count, 8, lambda names: K.ic_series(kept, names, 5))


def all_buckets(spark: SparkSession, root: str, factors: Sequence[str]) -> DataFrame:
    kept, count = kept_bars(spark, root, most_bars(spark, root))
    return kept_blocks(factors, count, 8, lambda names: K.quantile_returns(kept, names, 5))


def regimes(spark: SparkSession, root: str) -> DataFrame:
    """(date, regime), from the mean return of each date alone."""
    returns = factor_panel(bars(spark, root), ["momentum_1"], ("date",))
    return cut_lineage(A.market_regimes(cut_lineage(returns.groupBy("date").agg(F.avg("momentum_1").alias("market_mean_return")))))


def per_regime(spark: SparkSession, root: str, factors: Sequence[str]) -> DataFrame:
    """regime_rank_ic of factors. A few are columns of windows, computed and written once for all blocks; of many the bars are written once, and each block computes its factors from them."""
    days, most = regimes(spark, root), most_bars(spark, root)
    X.release(spark)  # the bars' shuffle
    if len(factors) <= len(CHOSEN):
        kept = cut_lineage(X.packed_columns(panel(spark, root, factors), days, factors))
        X.release(spark)
        return X.in_blocks(factors, most, 17 if most <= X.TASK_ROWS else 34, lambda names: X.regime_rank_ic(kept, days, names, most))
    kept, count = kept_bars(spark, root, most)
    coded = X._coded(days)[1]
    codes = {r.date: r.code for r in coded.collect()}  # a row a date

    def own(names: list[str]) -> DataFrame:
        return X.regime_rank_ic(kept, days, names, count, source=K.with_codes(codes, names, 5))

    def across(names: list[str]) -> DataFrame:
        return X.regime_rank_ic(K.packed_dates(kept, codes, names, 5), days, names, count)

    each = 12 if count <= X.TASK_ROWS else 24  # squeezed
    parts = [kept_blocks(some, count, size, found) for some, size, found in (([f for f in factors if f not in ACROSS], each, own), ([f for f in factors if f in ACROSS], each + 8, across)) if some]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


PANEL = f"""{BARS_SQL},
p0 AS (SELECT *, close / {lag('close')} - 1 AS r FROM bars),
panel AS (SELECT date, symbol, close, amount, r, close / {lag('close', 20)} - 1 AS momentum_20, 1 - close / {lag('close', 5)} AS reversal_5, {VOLS['v20']} AS volatility_20,
          {roll('avg', 'amount', 20)} AS amount_mean_20, close / open - 1 AS intraday_return,
          lead(close, 5) OVER (PARTITION BY symbol ORDER BY date) / close - 1 AS label FROM p0)"""
LONG = f"""WITH {PANEL}, long AS (""" + " UNION ALL ".join(f"SELECT date, symbol, label, '{f}' AS factor, {f} AS value FROM panel" for f in CHOSEN) + ")"
PAIRS = LONG + ", pairs AS (SELECT * FROM long WHERE value IS NOT NULL AND label IS NOT NULL)"


def sql_corr(x: str, y: str) -> str:
    return f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"


def sql_rank(x: str, groups: str) -> str:
    return f"(rank() OVER (PARTITION BY {groups} ORDER BY {x}) + (count(*) OVER (PARTITION BY {groups}, {x}) - 1) / 2.0)"


SERIES = (
    PAIRS
    + f""", ranked AS (SELECT *, {sql_rank('value', 'date, factor')} AS vr, {sql_rank('label', 'date, factor')} AS lr FROM pairs),
series AS (SELECT * FROM (SELECT date, factor, {sql_corr('value', 'label')} AS ic, {sql_corr('vr', 'lr')} AS rank_ic FROM ranked GROUP BY 1, 2) WHERE ic IS NOT NULL AND rank_ic IS NOT NULL)"""
)
BUCKETS = (
    PAIRS
    + """, placed AS (SELECT *, row_number() OVER (PARTITION BY date, factor ORDER BY value, symbol) AS k, count(*) OVER (PARTITION BY date, factor) AS n FROM pairs),
buckets AS (SELECT date, factor, CAST(least(5, floor((k - 1) / n * 5) + 1) AS INTEGER) AS quantile, avg(label) AS mean_forward_return FROM placed WHERE n >= 2 GROUP BY 1, 2, 3)"""
)


def with_final(ctes: str, select: str, columns: str, digits: int = 6) -> str:
    return f"{ctes} {rounded(select, columns, digits)}"


@query("""
SELECT date, lpad(right(symbol, 6), 6, '0') AS symbol, COLUMNS('^(open|high|low|close|volume|amount|turnover)$')
FROM (SELECT * REPLACE (round(open + 4.3e-9, 6) AS open, round(high + 4.3e-9, 6) AS high, round(low + 4.3e-9, 6) AS low, round(close + 4.3e-9, 6) AS close, round(volume + 4.3e-9, 6) AS volume, round(amount + 4.3e-9, 6) AS amount, round(turnover + 4.3e-9, 6) AS turnover) FROM daily_bar WHERE date IS NOT NULL AND open > 0 AND high > 0 AND low > 0 AND close > 0 AND amount > 0 AND NOT isnan(close))
QUALIFY row_number() OVER (PARTITION BY date, symbol ORDER BY row_id DESC) = 1
""", dates="date")
def bars_normalize(spark: SparkSession, root: str) -> DataFrame:
    return tidy(Q.normalize_bars(table(spark, root, "daily_bar"), "row_id"))


_QUALITY = """WITH q AS (
SELECT symbol, count(*) AS rows, min(date) AS start_date, max(date) AS end_date, count(date) - count(DISTINCT date) AS duplicate_dates,
  CAST(sum(CAST(open IS NULL AS INT) + CAST(high IS NULL AS INT) + CAST(low IS NULL AS INT) + CAST(close IS NULL AS INT) + CAST(volume IS NULL AS INT) + CAST(amount IS NULL AS INT) + CAST(turnover IS NULL AS INT)) AS BIGINT) AS missing_cells,
  count(*) FILTER (WHERE open <= 0 OR high <= 0 OR low <= 0 OR close <= 0) AS non_positive_price_rows,
  count(*) FILTER (WHERE high < greatest(open, close, low) OR low > least(open, close, high)) AS high_low_error_rows,
  count(*) FILTER (WHERE amount < 0) AS amount_error_rows
FROM daily_bar GROUP BY symbol)"""
_WEEKDAYS = "greatest(1, len(list_filter(generate_series(CAST({lo} AS TIMESTAMP), CAST({hi} AS TIMESTAMP), INTERVAL 1 DAY), lambda x: isodow(x) < 6)))"


@query(with_final(_QUALITY, f"SELECT *, greatest(0.0, 1 - rows / {_WEEKDAYS.format(lo='start_date', hi='end_date')}) AS missing_ratio FROM q", "missing_ratio"), dates="start_date end_date")
def quality_summary(spark: SparkSession, root: str) -> DataFrame:
    return tidy(Q.quality_summary(table(spark, root, "daily_bar")))


@query(
    _QUALITY
    + " SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT symbol, '{k}' AS issue, {v} AS count FROM q" for k, v in (("duplicate_dates", "duplicate_dates"), ("missing_cells", "missing_cells"), ("non_positive_price", "non_positive_price_rows"), ("high_low_error", "high_low_error_rows"), ("amount_error", "amount_error_rows")))
    + ") WHERE count > 0"
)
def quality_issues(spark: SparkSession, root: str) -> DataFrame:
    return Q.quality_issues(table(spark, root, "daily_bar"))


_AUDITED = {"daily_bar": ("date, symbol", "date"), "stock_event_factors": ("date, symbol", "date"), "stock_event_store": ("raw_hash, symbol", "effective_date")}


def _audit_sql(name: str, columns: list[str]) -> str:
    key, day = _AUDITED[name]
    nulls = " + ".join(f"CAST({c} IS NULL AS INT)" for c in columns)
    return f"SELECT '{name}' AS table_name, count(*) AS rows, CAST({len(columns)} AS BIGINT) AS columns, min({day}) AS first_day, max({day}) AS last_day, sum({nulls}) / (count(*) * {len(columns)}) AS missing_ratio, count(*) - (SELECT count(*) FROM (SELECT DISTINCT {key} FROM {name})) AS duplicate_keys FROM {name}"


_COLUMNS = {
    "daily_bar": "row_id date symbol open high low close volume amount turnover source fetched_at quality_flag",
    "stock_event_factors": "row_id date symbol event_count_3d event_count_20d positive_event_count negative_event_count event_risk_count event_impact_score event_weighted_impact_score event_confidence_mean event_reliability_mean latest_event_type latest_event_title fetched_at quality_flag",
    "stock_event_store": "row_id event_id source source_url published_at fetched_at related_symbols symbol title summary entity_link_method entity_link_confidence entity_link_keywords event_type sentiment impact_score confidence source_category source_reliability weighted_impact_score source_text_status source_text_length source_text_hash effective_date raw_hash quality_flag",
}


@query(rounded(" UNION ALL ".join(_audit_sql(n, c.split()) for n, c in _COLUMNS.items()), "missing_ratio"), dates="first_day last_day")
def pit_audit(spark: SparkSession, root: str) -> DataFrame:
    return tidy(Q.table_audit({n: table(spark, root, n) for n in _AUDITED}, {n: k.split(", ") for n, (k, _) in _AUDITED.items()}, {n: d for n, (_, d) in _AUDITED.items()}))


@query(f"""
WITH m AS (SELECT *, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY date, row_id), 0) - 1 AS r FROM (SELECT * FROM daily_bar QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY row_id DESC) = 1))
SELECT * FROM (
  SELECT 'non_positive_price' AS issue, count(*) FILTER (WHERE NOT coalesce(least(open, high, low, close) > 0, false)) AS count FROM m
  UNION ALL SELECT 'abnormal_return', count(*) FILTER (WHERE abs(r) > 0.05) FROM m
  UNION ALL SELECT 'zero_or_missing_amount', count(*) FILTER (WHERE coalesce(amount, 0) <= 0) FROM m) WHERE count > 0
""")
def bar_issues(spark: SparkSession, root: str) -> DataFrame:
    raw = table(spark, root, "daily_bar")
    last = raw.groupBy("symbol", "date").agg(F.max_by(F.struct(*Q.CELLS), "row_id").alias("x")).select("symbol", "date", "x.*")
    return Q.bar_issues(last, 0.05)


@query(with_final(
    "WITH a AS (SELECT * FROM daily_bar QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY row_id DESC) = 1), b AS (SELECT * FROM daily_bar_mirror QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY row_id DESC) = 1),"
    " j AS (SELECT a.date, a.symbol, abs(a.close - b.close) / nullif(b.close, 0) AS dc, abs(a.amount - b.amount) / nullif(b.amount, 0) AS da FROM a JOIN b ON a.symbol = b.symbol AND a.date = b.date WHERE true)",
    "SELECT date, symbol, 'close' AS field, dc AS diff FROM j WHERE dc > 0.005 AND NOT isnan(dc) UNION ALL SELECT date, symbol, 'amount', da FROM j WHERE da > 0.05 AND NOT isnan(da)", "diff"), dates="date")
def cross_source_diff(spark: SparkSession, root: str) -> DataFrame:
    def last(name: str) -> DataFrame:
        clean = F.struct(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("close", "amount")])
        return table(spark, root, name).groupBy("symbol", "date").agg(F.max_by(clean, "row_id").alias("x")).select("symbol", "date", "x.*")

    return tidy(Q.relative_differences(last("daily_bar"), last("daily_bar_mirror"), {"close": 0.005, "amount": 0.05}))


@query(with_final(
    f"WITH {BARS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS n FROM bars), u AS (SELECT symbol, count(*) AS rows, min(date) AS lo, max(date) AS hi, avg(amount) FILTER (WHERE n <= 60) AS avg_amount_60 FROM n GROUP BY 1),"
    f" v AS (SELECT *, greatest(0.0, 1 - rows / {_WEEKDAYS.format(lo='lo', hi='hi')}) AS missing_ratio FROM u),"
    " w AS (SELECT *, concat_ws(';', CASE WHEN symbol IN ('000003') THEN 'excluded_by_config' END, CASE WHEN rows < 500 THEN 'insufficient_history' END, CASE WHEN missing_ratio > 0.7 THEN 'too_many_missing_days' END, CASE WHEN avg_amount_60 < 100000 THEN 'low_amount' END) AS reasons FROM v)",
    "SELECT symbol, reasons = '' AS passed, rows, missing_ratio, avg_amount_60, reasons FROM w", "missing_ratio avg_amount_60", 4))
def universe_filter(spark: SparkSession, root: str) -> DataFrame:
    return tidy(Q.universe_report(bars(spark, root), least_rows=500, most_missing=0.7, least_amount=100_000, excluded=("000003",)), 4)


def _labels_sql(h: int) -> str:
    ahead = f"OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
    nxt = f"lead(close, {h}) OVER (PARTITION BY symbol ORDER BY date)"
    return f"{nxt} / close - 1 AS future_return_{h}d, min(close) {ahead} / close - 1 AS future_downside_{h}d, max(close) {ahead} / close - 1 AS future_upside_{h}d, CASE WHEN {nxt} IS NOT NULL THEN CASE WHEN {nxt} > close THEN 1.0 ELSE 0.0 END END AS direction_up_{h}d"


@query(with_final(
    f"WITH {BARS_SQL}, l AS (SELECT date, symbol, {_labels_sql(1)}, {_labels_sql(5)} FROM bars)",
    "SELECT *, future_return_1d - avg(future_return_1d) OVER (PARTITION BY date) AS excess_return_1d, future_return_5d - avg(future_return_5d) OVER (PARTITION BY date) AS excess_return_5d FROM l",
    " ".join(f"{p}_{h}d" for h in (1, 5) for p in ("future_return", "excess_return", "future_downside", "future_upside", "direction_up"))), dates="date")
def labels_return_risk(spark: SparkSession, root: str) -> DataFrame:
    return tidy(A.return_labels(bars(spark, root), [1, 5]))


@query(with_final(SERIES, "SELECT * FROM series", "ic rank_ic", 5), dates="date", every=lambda spark, root, factors: tidy(all_series(spark, root, factors), 5))
def ic_series(spark: SparkSession, root: str, factors: Sequence[str] = CHOSEN) -> DataFrame:
    return tidy(A.ic_series(long(spark, root, factors)), 5)


@query(with_final(SERIES, f"SELECT f.factor, coalesce(avg(ic), 0) AS ic_mean, coalesce(avg(rank_ic), 0) AS rank_ic_mean, coalesce(avg(ic) / nullif(stddev_pop(ic), 0), 0) AS ic_ir, count(ic) AS observations FROM (SELECT unnest({CHOSEN}) AS factor) f LEFT JOIN series s ON s.factor = f.factor GROUP BY 1", "ic_mean rank_ic_mean ic_ir"), every=lambda spark, root, factors: tidy(A.ic_summary(all_series(spark, root, factors), factors)))
def ic_summary(spark: SparkSession, root: str, factors: Sequence[str] = CHOSEN) -> DataFrame:
    return tidy(A.ic_summary(A.ic_series(long(spark, root, factors)), factors))


@query(with_final(SERIES, "SELECT factor, CAST(year(date) AS INTEGER) AS year, avg(rank_ic) AS rank_ic_mean, avg(ic) AS ic_mean, avg(CASE WHEN rank_ic > 1e-9 THEN 1.0 ELSE 0.0 END) AS positive_rank_ic_ratio, count(*) AS observations FROM series GROUP BY 1, 2", "rank_ic_mean ic_mean positive_rank_ic_ratio", 5), every=lambda spark, root, factors: tidy(A.ic_yearly(all_series(spark, root, factors)), 5))
def ic_yearly(spark: SparkSession, root: str, factors: Sequence[str] = CHOSEN) -> DataFrame:
    return tidy(A.ic_yearly(A.ic_series(long(spark, root, factors))), 5)


@query(with_final(BUCKETS, "SELECT * FROM buckets", "mean_forward_return"), dates="date", every=lambda spark, root, factors: tidy(all_buckets(spark, root, factors)))
def quantile_returns(spark: SparkSession, root: str, factors: Sequence[str] = CHOSEN) -> DataFrame:
    return tidy(A.quantile_returns(long(spark, root, factors)))


@query(with_final(LONG, "SELECT factor, count(*) FILTER (WHERE value IS NOT NULL AND label IS NOT NULL) / count(*) AS coverage, 1 - count(*) FILTER (WHERE value IS NOT NULL AND label IS NOT NULL) / count(*) AS missing_ratio FROM long GROUP BY 1", "coverage missing_ratio"), every=lambda spark, root, factors: tidy(X.coverage(bars(spark, root), factors, 5)))
def factor_coverage(spark: SparkSession, root: str, factors: Sequence[str] = CHOSEN) -> DataFrame:
    return tidy(A.coverage(long(spark, root, factors)))


@query(with_final(BUCKETS + f", m AS (SELECT factor, quantile, avg(mean_forward_return) AS m FROM buckets GROUP BY 1, 2), mr AS (SELECT *, {sql_rank('m', 'factor')} AS k FROM m)", f"SELECT factor, CASE WHEN count(*) >= 3 THEN coalesce({sql_corr('quantile', 'k')}, 0) ELSE 0 END AS quantile_monotonicity FROM mr GROUP BY 1", "quantile_monotonicity"), every=lambda spark, root, factors: tidy(A.monotonicity(all_buckets(spark, root, factors))))
def monotonicity(spark: SparkSession, root: str, factors: Sequence[str] = CHOSEN) -> DataFrame:
    return tidy(A.monotonicity(A.quantile_returns(long(spark, root, factors))))


_TURNOVER = """, sh AS (SELECT *, CASE WHEN value IS NOT NULL THEN (rank() OVER (PARTITION BY date, factor ORDER BY value NULLS LAST) + (count(*) OVER (PARTITION BY date, factor, value) - 1) / 2.0) / count(value) OVER (PARTITION BY date, factor) END AS s FROM long),
st AS (SELECT *, abs(s - lag(s) OVER (PARTITION BY factor, symbol ORDER BY date)) AS step FROM sh),
turn AS (SELECT factor, coalesce(avg(step), 0) AS rank_turnover FROM (SELECT factor, date, avg(step) AS step FROM st GROUP BY 1, 2) GROUP BY 1)"""


@query(with_final(LONG + _TURNOVER, "SELECT * FROM turn", "rank_turnover"), every=lambda spark, root, factors: tidy(by_date(spark, root, factors, X.rank_turnover, 11)))
def rank_turnover(spark: SparkSession, root: str, factors: Sequence[str] = CHOSEN) -> DataFrame:
    return tidy(A.rank_turnover(long(spark, root, factors)))


@query(with_final(BUCKETS + _TURNOVER + ", m AS (SELECT factor, quantile, avg(mean_forward_return) AS m FROM buckets GROUP BY 1, 2), e AS (SELECT factor, arg_max(m, quantile) - arg_min(m, quantile) AS g FROM m GROUP BY 1)", "SELECT factor, g AS gross_top_bottom_spread, rank_turnover * 0.0016 AS estimated_cost_drag, g - rank_turnover * 0.0016 AS cost_adjusted_spread FROM e JOIN turn USING (factor)", "gross_top_bottom_spread estimated_cost_drag cost_adjusted_spread"), every=lambda spark, root, factors: tidy(by_date(spark, root, factors, X.cost_adjusted_spread, 11)))
def cost_adjusted_spread(spark: SparkSession, root: str, factors: Sequence[str] = CHOSEN) -> DataFrame:
    rows = long(spark, root, factors)
    return tidy(A.cost_adjusted_spread(A.quantile_returns(rows), A.rank_turnover(rows)))


@query(with_final(LONG + f", pv AS (SELECT *, lag(value) OVER (PARTITION BY factor, symbol ORDER BY date) AS prev FROM long), rh AS (SELECT factor, symbol, {sql_corr('value', 'prev')} AS rho FROM pv WHERE value IS NOT NULL AND prev IS NOT NULL GROUP BY 1, 2), mh AS (SELECT factor, avg(least(greatest(rho, 0), 0.999)) AS rho FROM rh WHERE rho IS NOT NULL GROUP BY 1)", "SELECT factor, least(252.0, greatest(0.0, CASE WHEN rho > 0 THEN ln(0.5) / ln(rho) ELSE 0 END)) AS half_life_days FROM mh", "half_life_days", 4), every=lambda spark, root, factors: tidy(X.half_life(bars(spark, root), factors), 4))
def half_life(spark: SparkSession, root: str, factors: Sequence[str] = CHOSEN) -> DataFrame:
    return tidy(A.half_life(long(spark, root, factors)), 4)


_REGIMES = ", dm AS (SELECT date, avg(r) AS m FROM panel GROUP BY 1), cut AS (SELECT quantile_cont(m, 0.33) AS lo, quantile_cont(m, 0.67) AS hi FROM dm), reg AS (SELECT date, CASE WHEN m <= lo THEN 'bearish' WHEN m >= hi THEN 'bullish' ELSE 'sideways' END AS regime FROM dm, cut WHERE m IS NOT NULL)"


@query(with_final(PAIRS + _REGIMES + f", pr AS (SELECT p.*, regime FROM pairs p JOIN reg USING (date)), rr AS (SELECT *, {sql_rank('value', 'factor, regime')} AS vr, {sql_rank('label', 'factor, regime')} AS lr FROM pr)", f"SELECT factor, regime, count(*) AS rows, {sql_corr('vr', 'lr')} AS rank_ic FROM rr GROUP BY 1, 2 HAVING count(*) >= 10", "rank_ic"), every=True)
def regime_rank_ic(spark: SparkSession, root: str, factors: Sequence[str] = CHOSEN) -> DataFrame:
    return tidy(per_regime(spark, root, factors))


@query(with_final(PAIRS + _REGIMES + f", pr AS (SELECT p.*, regime FROM pairs p JOIN reg USING (date)), rr AS (SELECT *, {sql_rank('value', 'factor, regime')} AS vr, {sql_rank('label', 'factor, regime')} AS lr FROM pr), ri AS (SELECT factor, regime, round(coalesce({sql_corr('vr', 'lr')}, 0), 9) AS ic FROM rr GROUP BY 1, 2 HAVING count(*) >= 10)",
    "SELECT factor, count(*) AS regimes, avg(CASE WHEN ic > 1e-9 THEN 1.0 ELSE 0.0 END) AS positive_ratio, min(ic) AS worst_rank_ic, list(regime ORDER BY ic, regime)[1] AS worst_regime FROM ri GROUP BY 1", "positive_ratio worst_rank_ic"))
def regime_stability(spark: SparkSession, root: str) -> DataFrame:
    return tidy(A.regime_stability(per_regime(spark, root, CHOSEN)))


_PAIRWISE = " UNION ALL ".join(f"SELECT '{a}' AS factor, '{b}' AS other, abs({sql_corr(a, b)}) AS r FROM panel WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a in CHOSEN for b in CHOSEN if a != b)


@query(with_final(f"WITH {PANEL}, c AS ({_PAIRWISE}), b AS (SELECT factor, max(r) AS max_abs_correlation, arg_max(other, r) AS max_corr_factor FROM c GROUP BY 1)", "SELECT *, 1.0 / greatest(0.05, 1 - least(max_abs_correlation, 0.999) ** 2) AS vif_proxy FROM b", "max_abs_correlation vif_proxy"), every=True)
def factor_correlations(spark: SparkSession, root: str, factors: Sequence[str] = CHOSEN) -> DataFrame:
    return tidy(A.factor_correlations(panel(spark, root, factors), factors))


_SCORE = f"WITH {PANEL}, sc AS (SELECT date, symbol, close, amount, " + " + ".join(
    f"coalesce(CASE WHEN {f} IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY {f} NULLS LAST) + (count(*) OVER (PARTITION BY date, {f}) - 1) / 2.0) / count({f}) OVER (PARTITION BY date) END, 0.0) * {w}" for f, w in WEIGHTS.items()
) + " AS score FROM panel)"
_TARGETS = _SCORE + """, days AS (SELECT max(date) AS date FROM (SELECT DISTINCT date FROM sc) GROUP BY date_trunc('week', date + 2)),
best AS (SELECT * FROM (SELECT sc.*, row_number() OVER (PARTITION BY sc.date ORDER BY round(score, 9) DESC, symbol) AS k FROM sc JOIN days USING (date) WHERE amount >= 1000) WHERE k <= 5),
tg AS (SELECT date, symbol, least(1.0 / count(*) OVER (PARTITION BY date), 0.3) AS weight FROM best)"""


def scores(spark: SparkSession, root: str) -> DataFrame:
    return A.factor_scores(panel(spark, root), WEIGHTS)


@query(with_final(_SCORE, "SELECT date, symbol, score, close, amount FROM sc", "score close amount"), dates="date")
def score(spark: SparkSession, root: str) -> DataFrame:
    return tidy(scores(spark, root))


@query(f"WITH {BARS_SQL} SELECT 'week' AS rule, max(date) AS date FROM bars GROUP BY date_trunc('week', date + 2) UNION ALL SELECT 'month', max(date) FROM bars GROUP BY date_trunc('month', date)", dates="date")
def rebalance_dates(spark: SparkSession, root: str) -> DataFrame:
    dates = bars(spark, root).select("date")
    week, month = (A.rebalance_dates(dates, rule).select(F.lit(rule).alias("rule"), "date") for rule in ("week", "month"))
    return tidy(week.unionByName(month))


def targets(spark: SparkSession, root: str) -> DataFrame:
    s = scores(spark, root).withColumn("score", F.round("score", 9))
    return A.top_targets(s, A.rebalance_dates(s.select("date")), 5, 0.3, 1000.0)


@query(with_final(_TARGETS, "SELECT * FROM tg", "weight"), dates="date")
def topn_targets(spark: SparkSession, root: str) -> DataFrame:
    return tidy(targets(spark, root))
