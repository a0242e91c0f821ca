"""ML preparation queries (M1–M7, W7) over ``events`` bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspark.functions.columns import rounded
from barspark.operators import features as ft
from barspark.plans.registry import query
from barspark.plans.sql_fragments import EVENTS_BARS, rnd
from barspark.sources.driver_tables import events_bars

W = f"WITH bars AS ({EVENTS_BARS})"
SCALED = ["open", "high", "low", "close", "vol", "openint"]
FEATS = ["open", "high", "low", "close", "vol"]


def _scaled_sql(center: dict[str, str], scale: dict[str, str]) -> str:
    stats = ", ".join(f"{center[c]} AS c_{c}, {scale[c]} AS s_{c}" for c in SCALED)
    cols = ", ".join(
        f"{rnd(f'({c} - c_{c}) / (CASE WHEN s_{c} IS NULL OR s_{c} = 0 THEN 1.0 ELSE s_{c} END)')} AS {c}"
        for c in SCALED)
    return f"{W}, st AS (SELECT {stats} FROM bars) SELECT ticker, \"timestamp\", seq, {cols} FROM bars, st"


def _scaled(spark, sf_dir, method):
    b = events_bars(spark, sf_dir)
    out = ft.normalize(b, method, SCALED)
    return out.select("ticker", "timestamp", "seq", *[rounded(c).alias(c) for c in SCALED])


@query("normalize_minmax", _scaled_sql({c: f"min({c})" for c in SCALED}, {c: f"max({c}) - min({c})" for c in SCALED}))
def q_normalize_minmax(spark, sf_dir):
    return _scaled(spark, sf_dir, "minmax")


@query("normalize_standard", _scaled_sql({c: f"avg({c})" for c in SCALED}, {c: f"stddev_pop({c})" for c in SCALED}))
def q_normalize_standard(spark, sf_dir):
    return _scaled(spark, sf_dir, "standard")


@query("normalize_robust", _scaled_sql(
    {c: f"quantile_cont({c}, 0.5)" for c in SCALED},
    {c: f"quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)" for c in SCALED}))
def q_normalize_robust(spark, sf_dir):
    return _scaled(spark, sf_dir, "robust")


@query("feature_matrix", f"""{W} SELECT seq, 5 AS n_features,
{rnd('open + high + low + close + vol')} AS feature_sum, {rnd('high')} AS feature_1 FROM bars""")
def q_feature_matrix(spark, sf_dir):
    fm = ft.feature_matrix(events_bars(spark, sf_dir), FEATS)
    return fm.select("seq", F.size("features").alias("n_features"),
                     rounded(F.aggregate("features", F.lit(0.0), lambda a, x: a + x)).alias("feature_sum"),
                     rounded(F.element_at("features", 2)).alias("feature_1"))


@query("rl_state", f"{W} SELECT seq, CAST(CAST(close AS FLOAT) AS DOUBLE) AS state_0 FROM bars")
def q_rl_state(spark, sf_dir):
    s = ft.rl_state(events_bars(spark, sf_dir))
    return s.select("seq", F.element_at("state", 1).cast("double").alias("state_0"))


@query("prepared_summary", f"""{W} SELECT 'numpy' AS format, count(DISTINCT ticker) AS size,
'numpy_arrays' AS type, count(*) AS rows FROM bars""")
def q_prepared_summary(spark, sf_dir):
    return ft.prepared_summary(events_bars(spark, sf_dir))


@query("sequences", f"""{W}, r AS (SELECT *, open + high + low + close + vol AS rs FROM bars),
w AS (SELECT ticker, seq, close AS y, count(*) OVER prev AS x_rows, sum(rs) OVER prev AS x_sum,
      lag(close, 60) OVER o AS x_first_close, lag(close, 1) OVER o AS x_last_close
      FROM r WINDOW o AS (PARTITION BY ticker ORDER BY "timestamp", seq),
                    prev AS (PARTITION BY ticker ORDER BY "timestamp", seq ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))
SELECT ticker, seq, y, x_rows, {rnd('x_sum', 4)} AS x_sum, x_first_close, x_last_close FROM w WHERE x_rows = 60""")
def q_sequences(spark, sf_dir):
    s = ft.sequences(events_bars(spark, sf_dir), FEATS, "close", 60, order=("timestamp", "seq"))
    flat = F.flatten("X")
    return s.select("ticker", "seq", "y", F.size("X").cast("long").alias("x_rows"),
                    rounded(F.aggregate(flat, F.lit(0.0), lambda a, x: a + x), 4).alias("x_sum"),
                    F.element_at(F.element_at("X", 1), 4).alias("x_first_close"),
                    F.element_at(F.element_at("X", -1), 4).alias("x_last_close"))
