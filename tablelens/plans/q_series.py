"""Registered time-series queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelens.operators import series as se
from tablelens.plans import fixtures as fx
from tablelens.plans.catalog import register

ED_SQL = "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts, avg(value) AS y FROM events GROUP BY 1"
# Monthly totals in millions, so that rounded decimals compare equal across engines.
OM_SQL = ("SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS ts, sum(o_totalprice) / 1000000.0 AS y "
          "FROM orders GROUP BY 1")
EG_SQL = f"SELECT * FROM ({ED_SQL}) WHERE day(ts) % 5 <> 0"


def ed(spark, sf):
    return fx.events_daily(spark, sf).select("ts", F.col("value").alias("y"))


def om(spark, sf):
    return fx.orders_monthly(spark, sf).select("ts", (F.col("value") / F.lit(1000000.0)).alias("y"))


def eg(spark, sf):
    return ed(spark, sf).where(F.dayofmonth("ts") % 5 != 0)


SERIES = {"events_daily": (ed, ED_SQL, "D", 7), "orders_monthly": (om, OM_SQL, "MS", 12),
          "events_gappy": (eg, EG_SQL, None, None)}


def _freq_sql(src: str) -> str:
    return f"""(WITH s AS ({src}),
d AS (SELECT ts, count(*) AS mult FROM s GROUP BY ts),
g AS (SELECT ts, mult, lag(ts) OVER (ORDER BY ts) AS prev FROM d),
f AS (SELECT ts, mult, epoch_us(ts) - epoch_us(prev) AS gap,
  (year(ts) * 12 + month(ts)) - (year(prev) * 12 + month(prev)) AS mdiff,
  day(ts) = 1 AS is_ms, last_day(ts) = CAST(ts AS DATE) AS is_me,
  strftime(ts, '%H:%M:%S.%f') = '00:00:00.000000' AS mid, isodow(ts) AS dow, isodow(prev) AS pdow FROM g),
a AS (SELECT count(*) AS n, max(mult) AS mm, min(gap) AS gmin, max(gap) AS gmax, min(mdiff) AS mmin,
  max(mdiff) AS mmax, bool_and(is_ms) AS all_ms, bool_and(is_me) AS all_me, bool_and(mid) AS all_mid,
  bool_and(dow < 6) AS weekdays,
  bool_and(gap IS NULL OR gap = 86400000000 OR (gap = 3 * 86400000000 AND pdow = 5 AND dow = 1)) AS bsteps,
  arg_min(upper(strftime(ts, '%a')), ts) AS wd, arg_min(upper(strftime(ts, '%b')), ts) AS mon,
  arg_min(month(ts), ts) AS m FROM f)
SELECT CASE WHEN n < 3 OR mm > 1 OR gmin <= 0 THEN NULL
  WHEN mmin = mmax AND mmin > 0 AND all_mid AND all_ms THEN
    CASE WHEN mmin % 12 = 0 THEN (CASE WHEN mmin = 12 THEN '' ELSE CAST(mmin // 12 AS VARCHAR) END) || 'YS-' || mon
         WHEN mmin % 3 = 0 THEN (CASE WHEN mmin = 3 THEN '' ELSE CAST(mmin // 3 AS VARCHAR) END) || 'QS-' || ['DEC', 'OCT', 'NOV'][m % 3 + 1]
         ELSE (CASE WHEN mmin = 1 THEN '' ELSE CAST(mmin AS VARCHAR) END) || 'MS' END
  WHEN mmin = mmax AND mmin > 0 AND all_mid AND all_me THEN
    CASE WHEN mmin % 12 = 0 THEN (CASE WHEN mmin = 12 THEN '' ELSE CAST(mmin // 12 AS VARCHAR) END) || 'YE-' || mon
         WHEN mmin % 3 = 0 THEN (CASE WHEN mmin = 3 THEN '' ELSE CAST(mmin // 3 AS VARCHAR) END) || 'QE-' || ['DEC', 'JAN', 'FEB'][m % 3 + 1]
         ELSE (CASE WHEN mmin = 1 THEN '' ELSE CAST(mmin AS VARCHAR) END) || 'ME' END
  WHEN gmin = gmax AND gmin % 86400000000 = 0 AND (gmin // 86400000000) % 7 = 0 THEN
    (CASE WHEN gmin // 86400000000 = 7 THEN '' ELSE CAST(gmin // 604800000000 AS VARCHAR) END) || 'W-' || wd
  WHEN gmin = gmax AND gmin % 86400000000 = 0 THEN
    (CASE WHEN gmin = 86400000000 THEN '' ELSE CAST(gmin // 86400000000 AS VARCHAR) END) || 'D'
  WHEN weekdays AND bsteps AND gmin = 86400000000 THEN 'B'
  WHEN gmin = gmax AND gmin % 3600000000 = 0 THEN
    (CASE WHEN gmin = 3600000000 THEN '' ELSE CAST(gmin // 3600000000 AS VARCHAR) END) || 'h'
  WHEN gmin = gmax AND gmin % 60000000 = 0 THEN
    (CASE WHEN gmin = 60000000 THEN '' ELSE CAST(gmin // 60000000 AS VARCHAR) END) || 'min'
  WHEN gmin = gmax AND gmin % 1000000 = 0 THEN
    (CASE WHEN gmin = 1000000 THEN '' ELSE CAST(gmin // 1000000 AS VARCHAR) END) || 's'
  END AS inferred_freq FROM a)"""


def _month_str(spark, sf):
    o = om(spark, sf)
    return o.select(F.date_format("ts", "yyyy-MM").alias("month"), F.col("y").alias("total"),
                    F.concat(F.lit("m"), F.month("ts").cast("string")).alias("tag"))


@register("t01_date_column_parsed", f"WITH s AS ({OM_SQL}), t AS (SELECT strftime(ts, '%Y-%m') AS month, y AS total, "
          "'m' || CAST(month(ts) AS VARCHAR) AS tag FROM s),\n"
          "r AS (SELECT 'month' AS c, 0 AS p, avg(CASE WHEN coalesce(try_strptime(month, '%Y-%m-%d %H:%M:%S'), "
          "try_strptime(month, '%Y-%m-%d'), try_strptime(month, '%Y-%m')) IS NOT NULL THEN 1.0 ELSE 0.0 END) AS rate FROM t "
          "UNION ALL SELECT 'tag', 1, avg(CASE WHEN coalesce(try_strptime(tag, '%Y-%m-%d %H:%M:%S'), "
          "try_strptime(tag, '%Y-%m-%d'), try_strptime(tag, '%Y-%m')) IS NOT NULL THEN 1.0 ELSE 0.0 END) FROM t)\n"
          "SELECT arg_max(c, (rate, -p)) FILTER (WHERE rate > 0.95) AS date_column, "
          "max(rate) FILTER (WHERE rate > 0.95) AS parse_rate FROM r")
def t01_date_column_parsed(spark, sf):
    return se.detect_date_column(_month_str(spark, sf), target="total")


@register("t01_date_column_typed", "SELECT 'ts' AS date_column, 1.0 AS parse_rate FROM (SELECT count(*) FROM events)")
def t01_date_column_typed(spark, sf):
    return se.detect_date_column(fx.read_table(spark, sf, "events"), target="value")


@register("t02_ordered_series", f"WITH s AS ({OM_SQL})\nSELECT CAST(ts AS VARCHAR) AS ts, round(y, 4) AS y FROM s")
def t02_ordered_series(spark, sf):
    df = _month_str(spark, sf)
    s = se.ordered_series(df, "month", "total")
    return s.select(F.col("ts").cast("string").alias("ts"), F.round("y", 4).alias("y"))


@register("t03_frequency", "\nUNION ALL\n".join(
    f"SELECT '{name}' AS series, inferred_freq FROM {_freq_sql(sql)}" for name, (_, sql, _, _) in SERIES.items()))
def t03_frequency(spark, sf):
    out = None
    for name, (fn, _, _, _) in SERIES.items():
        part = se.infer_frequency(fn(spark, sf)).select(F.lit(name).alias("series"), "inferred_freq")
        out = part if out is None else out.unionByName(part)
    return out


def _gap_sql(name: str, sql: str) -> str:
    return (f"SELECT '{name}' AS series, CAST(median(gap) AS BIGINT) AS median_gap_us, "
            f"count(*) FILTER (WHERE median_g > 0 AND gap > median_g * 1.5) AS gap_count FROM "
            f"(SELECT gap, median(gap) OVER () AS median_g FROM (SELECT epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts)) AS gap "
            f"FROM ({sql})) WHERE gap IS NOT NULL)")


@register("t04_gap_count", "\nUNION ALL\n".join(_gap_sql(n, s[1]) for n, s in SERIES.items()))
def t04_gap_count(spark, sf):
    out = None
    for name, (fn, _, _, _) in SERIES.items():
        part = se.gap_count(fn(spark, sf)).select(F.lit(name).alias("series"),
                                                  F.col("median_gap_us").cast("long").alias("median_gap_us"),
                                                  "gap_count")
        out = part if out is None else out.unionByName(part)
    return out


@register("t05_range_points", "\nUNION ALL\n".join(
    f"SELECT '{n}' AS series, count(*) AS n_points, CAST(min(ts) AS VARCHAR) AS start, CAST(max(ts) AS VARCHAR) AS \"end\" "
    f"FROM ({s[1]})" for n, s in SERIES.items()))
def t05_range_points(spark, sf):
    out = None
    for name, (fn, _, _, _) in SERIES.items():
        part = se.range_points(fn(spark, sf)).select(
            F.lit(name).alias("series"), "n_points", F.col("start").cast("string").alias("start"),
            F.col("end").cast("string").alias("end"))
        out = part if out is None else out.unionByName(part)
    return out


GRID_SQL = (f"WITH s AS ({EG_SQL}), b AS (SELECT min(ts) AS t0, datediff('day', min(ts), max(ts)) + 1 AS n FROM s),\n"
            "g AS (SELECT range AS pos, t0 + to_days(CAST(range AS INTEGER)) AS ts FROM b, range(0, (SELECT n FROM b)))\n")


@register("t06_regular_grid", GRID_SQL + "SELECT g.pos, CAST(g.ts AS VARCHAR) AS ts, round(s.y, 6) AS y "
          "FROM g LEFT JOIN s ON g.ts = s.ts")
def t06_regular_grid(spark, sf):
    g = se.regular_grid(eg(spark, sf), "D")
    return g.select("pos", F.col("ts").cast("string").alias("ts"), F.round("y", 6).alias("y"))


@register("t07_interpolate", GRID_SQL + ", j AS (SELECT g.pos, g.ts, s.y FROM g LEFT JOIN s ON g.ts = s.ts),\n"
          "k AS (SELECT pos, ts, y, last_value(CASE WHEN y IS NOT NULL THEN pos END IGNORE NULLS) OVER (ORDER BY pos) AS pp, "
          "first_value(CASE WHEN y IS NOT NULL THEN pos END IGNORE NULLS) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS pn FROM j),\n"
          "v AS (SELECT k.pos, k.ts, coalesce(k.y, CASE WHEN k.pn IS NULL THEN a.y ELSE a.y + (b.y - a.y) * (k.pos - k.pp) / (k.pn - k.pp) END) AS y "
          "FROM k LEFT JOIN j a ON a.pos = k.pp LEFT JOIN j b ON b.pos = k.pn WHERE k.pp IS NOT NULL)\n"
          "SELECT pos - (SELECT min(pos) FROM v) AS pos, round(y, 6) AS y FROM v")
def t07_interpolate(spark, sf):
    i = se.interpolate(se.regular_grid(eg(spark, sf), "D"))
    return i.select("pos", F.round("y", 6).alias("y"))


@register("t08_season_length", "SELECT series, inferred_freq, CASE regexp_replace(split_part(inferred_freq, '-', 1), '^[0-9]+', '') "
          "WHEN 'D' THEN 7 WHEN 'B' THEN 5 WHEN 'W' THEN 52 WHEN 'M' THEN 12 WHEN 'MS' THEN 12 WHEN 'ME' THEN 12 "
          "WHEN 'Q' THEN 4 WHEN 'QS' THEN 4 WHEN 'QE' THEN 4 WHEN 'A' THEN 1 WHEN 'Y' THEN 1 WHEN 'YS' THEN 1 WHEN 'YE' THEN 1 "
          "WHEN 'AS' THEN 1 WHEN 'H' THEN 24 WHEN 'h' THEN 24 WHEN 'T' THEN 60 WHEN 'min' THEN 60 END AS period FROM (" +
          "\nUNION ALL\n".join(f"SELECT '{name}' AS series, inferred_freq FROM {_freq_sql(sql)}"
                               for name, (_, sql, _, _) in SERIES.items()) + ")")
def t08_season_length(spark, sf):
    f = t03_frequency(spark, sf)
    return f.withColumn("period", se.season_length_expr(F.col("inferred_freq")))


def positioned(spark, sf, name):
    fn, _, freq, _ = SERIES[name]
    return se.prepare_regular(fn(spark, sf), freq)


def _pos_sql(name: str) -> str:
    _, sql, freq, _ = SERIES[name]
    unit = "day" if freq == "D" else "month"
    return f"p AS (SELECT datediff('{unit}', (SELECT min(ts) FROM ({sql})), ts) AS pos, y FROM ({sql}))"


def _decomp_sql(name: str) -> str:
    period = SERIES[name][3]
    h = period // 2
    if period % 2 == 0:
        ma = (f"(sum(y) OVER w - 0.5 * (lag(y, {h}) OVER w0 + lead(y, {h}) OVER w0)) / {period}")
    else:
        ma = f"sum(y) OVER w / {period}"
    return (f"{_pos_sql(name)},\n"
            f"m AS (SELECT pos, y, CASE WHEN pos >= {h} AND pos <= (SELECT max(pos) FROM p) - {h} THEN {ma} END AS ma FROM p "
            f"WINDOW w AS (ORDER BY pos ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING), w0 AS (ORDER BY pos)),\n"
            "e AS (SELECT min(pos) FILTER (WHERE ma IS NOT NULL) AS front, max(pos) FILTER (WHERE ma IS NOT NULL) AS back FROM m),\n"
            f"ff AS (SELECT regr_slope(ma, pos) AS kf, regr_intercept(ma, pos) AS nf FROM m, e WHERE pos >= front AND pos < least(front + {period}, back)),\n"
            f"fb AS (SELECT regr_slope(ma, pos) AS kb, regr_intercept(ma, pos) AS nb FROM m, e WHERE pos >= greatest(front, back - {period}) AND pos < back),\n"
            "t AS (SELECT pos, y, CASE WHEN pos < front THEN kf * pos + nf WHEN pos > back THEN kb * pos + nb ELSE ma END AS trend "
            f"FROM m, e, ff, fb),\n"
            f"sm AS (SELECT pos % {period} AS phase, avg(y - trend) AS pm FROM t GROUP BY 1),\n"
            "sc AS (SELECT phase, pm - avg(pm) OVER () AS seasonal FROM sm),\n"
            f"dd AS (SELECT t.pos, t.y, t.trend, sc.seasonal, t.y - t.trend - sc.seasonal AS resid FROM t JOIN sc ON t.pos % {period} = sc.phase)\n")


@register("t09_decompose", "\nUNION ALL\n".join(
    f"SELECT * FROM (WITH {_decomp_sql(n)} SELECT '{n}' AS series, pos, round(trend, 4) AS trend, "
    f"round(seasonal, 4) AS seasonal, round(resid, 4) AS resid FROM dd)" for n in ("events_daily", "orders_monthly")))
def t09_decompose(spark, sf):
    out = None
    for n in ("events_daily", "orders_monthly"):
        d = se.decompose(positioned(spark, sf, n), SERIES[n][3])
        part = d.select(F.lit(n).alias("series"), "pos", *[F.round(c, 4).alias(c) for c in ("trend", "seasonal", "resid")])
        out = part if out is None else out.unionByName(part)
    return out


@register("t10_strength", "\nUNION ALL\n".join(
    f"SELECT * FROM (WITH {_decomp_sql(n)}, v AS (SELECT var_samp(resid) AS vr, var_samp(trend + resid) AS vtr, "
    f"var_samp(seasonal + resid) AS vsr FROM dd) SELECT '{n}' AS series, "
    "CASE WHEN vtr > 0 THEN round(greatest(0.0, 1 - vr / vtr), 3) END AS trend_strength, "
    "CASE WHEN vsr > 0 THEN round(greatest(0.0, 1 - vr / vsr), 3) END AS seasonal_strength FROM v)"
    for n in ("events_daily", "orders_monthly")))
def t10_strength(spark, sf):
    out = None
    for n in ("events_daily", "orders_monthly"):
        part = se.strengths(se.decompose(positioned(spark, sf, n), SERIES[n][3])).select(
            F.lit(n).alias("series"), "trend_strength", "seasonal_strength")
        out = part if out is None else out.unionByName(part)
    return out


ACF_SQL = (f"WITH {_pos_sql('orders_monthly')}, st AS (SELECT avg(y) AS mu, count(*) AS n FROM p),\n"
           "d AS (SELECT pos, y - mu AS d FROM p, st),\n"
           "l AS (SELECT range AS lag FROM range(1, (SELECT least(24, n // 2 - 1) + 1 FROM st))),\n"
           "a AS (SELECT CAST(l.lag AS INTEGER) AS lag, sum(d0.d * d1.d) / (SELECT sum(d * d) FROM d) AS acf "
           "FROM l JOIN d d0 ON TRUE JOIN d d1 ON d1.pos = d0.pos + l.lag GROUP BY 1)\n")


@register("t11_acf", ACF_SQL + "SELECT lag, round(acf, 6) AS acf FROM a")
def t11_acf(spark, sf):
    a = se.acf(positioned(spark, sf, "orders_monthly"))
    return a.select("lag", F.round("acf", 6).alias("acf"))


@register("t12_pacf_lag2", ACF_SQL + "SELECT 1 AS lag, round((SELECT acf FROM a WHERE lag = 1), 6) AS pacf UNION ALL "
          "SELECT 2, round(((SELECT acf FROM a WHERE lag = 2) - pow((SELECT acf FROM a WHERE lag = 1), 2)) / "
          "(1 - pow((SELECT acf FROM a WHERE lag = 1), 2)), 6)")
def t12_pacf_lag2(spark, sf):
    p = se.pacf_from_acf(se.acf(positioned(spark, sf, "orders_monthly")))
    return p.where(F.col("lag") <= 2).select("lag", F.round("pacf", 6).alias("pacf"))


@register("t12_pacf")
def t12_pacf(spark, sf):
    return se.pacf_from_acf(se.acf(positioned(spark, sf, "orders_monthly")))


@register("t13_lag_rolling", f"WITH {_pos_sql('orders_monthly')}\n"
          "SELECT pos, round(y, 4) AS y, round(lag(y, 1) OVER w, 4) AS lag_1, round(lag(y, 12) OVER w, 4) AS lag_12, "
          "round(CASE WHEN count(*) OVER r = 12 THEN avg(y) OVER r END, 4) AS roll_mean, "
          "round(CASE WHEN count(*) OVER r = 12 THEN stddev_samp(y) OVER r END, 4) AS roll_std FROM p "
          "WINDOW w AS (ORDER BY pos), r AS (ORDER BY pos ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)")
def t13_lag_rolling(spark, sf):
    t = se.lag_rolling(positioned(spark, sf, "orders_monthly"), 12)
    return t.select("pos", *[F.round(c, 4).alias(c) for c in ("y", "lag_1", "lag_12", "roll_mean", "roll_std")])


@register("t14_time_split", f"WITH s AS ({ED_SQL})\nSELECT CAST(ts AS VARCHAR) AS ts FROM (SELECT ts, row_number() OVER "
          "(ORDER BY ts) AS rn, count(*) OVER () AS n FROM s) WHERE rn > CAST(floor(n * 0.8) AS BIGINT)")
def t14_time_split(spark, sf):
    from tablelens.operators import features as fe
    _, test = fe.time_split(ed(spark, sf), "ts", 0.2, tiebreak=["ts"])
    return test.select(F.col("ts").cast("string").alias("ts"))
