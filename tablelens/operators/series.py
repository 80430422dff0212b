"""Time-series diagnostics.

No step uses a window without ``partitionBy`` over data rows:

* consecutive gaps use ``with_prev``: range partitions by time, a lag inside
  each partition, and the last time of the previous partitions carried in
  from a table with one row per partition;
* a regular series gets an integer position (periods since the start), so
  moving averages, lags, rolling windows and autocorrelations become
  "each row contributes to a few neighbouring positions" expansions followed
  by a grouped sum — distributed by position;
* linear interpolation expands only the missing positions between two known
  points;
* seasonal means and the Durbin-Levinson recursion run on at most
  ``period`` / 24 values.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelens.functions.columns import DATETIME_TYPES, family, q
from tablelens.functions.moments import present
from tablelens.functions.ranks import order_statistics
from tablelens.session import written

# Fixed values that must equal the reference's rules.
# Season length per frequency prefix (the text before "-"):
FREQ_PERIOD = {"D": 7, "B": 5, "W": 52, "M": 12, "MS": 12, "Q": 4, "QS": 4, "A": 1, "Y": 1,
               "H": 24, "T": 60}
# Newer spellings of the same frequencies, accepted as aliases.
FREQ_ALIASES = {"ME": "M", "QE": "Q", "YE": "Y", "YS": "Y", "AS": "A", "h": "H", "min": "T"}
PARSE_RATE = 0.95
GAP_FACTOR = 1.5
MAX_ACF_LAGS = 24
#: positions of a block in the window steps
HALO_BLOCK = 65_536
MIN_ACF_POINTS = 10


def season_length(freq: str | None) -> int | None:
    """Period for a frequency string (suffix after '-' cut; count prefix ignored)."""
    if not freq:
        return None
    head = freq.split("-")[0].lstrip("0123456789")
    return FREQ_PERIOD.get(head, FREQ_PERIOD.get(FREQ_ALIASES.get(head, ""), None))


def season_length_expr(freq_col):
    """T08 as a Spark expression (map literal lookup)."""
    table = dict(FREQ_PERIOD)
    for k, v in FREQ_ALIASES.items():
        table[k] = FREQ_PERIOD[v]
    m = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
    head = F.regexp_replace(F.split(freq_col, "-")[0], "^[0-9]+", "")
    return m[head]


# ----------------------------------------------------------------------------- T01, T02

def detect_date_column(df: DataFrame, target: str | None = None) -> DataFrame:
    """First datetime column; else the string column with parse rate > 0.95 (highest,
    first on ties). One aggregate over all string columns."""
    spark = df.sparkSession
    for f in df.schema.fields:
        if f.name != target and family(f.dataType) == "datetime":
            return df.agg(F.lit(f.name).alias("date_column"), F.lit(1.0).alias("parse_rate"))
    strings = [f.name for f in df.schema.fields if f.name != target and family(f.dataType) == "string"]
    if not strings:
        return spark.createDataFrame([(None, None)], "date_column string, parse_rate double")
    one = df.agg(*[F.avg(F.when(F.try_to_timestamp(q(c)).isNotNull(), 1.0).otherwise(0.0)).alias(f"r{i}")
                   for i, c in enumerate(strings)])
    rows = F.array(*[F.struct(F.col(f"r{i}").alias("rate"), F.lit(-i).alias("neg_pos"), F.lit(c).alias("name"))
                     for i, c in enumerate(strings)])
    best = F.array_max(F.filter(rows, lambda s: s["rate"] > PARSE_RATE))
    return one.select(best["name"].alias("date_column"), best["rate"].alias("parse_rate"))


def ordered_series(df: DataFrame, date_col: str, value_col: str) -> DataFrame:
    """(ts, y) with parsed dates, null dates dropped. Order is applied by position later."""
    dt = df.schema[date_col].dataType
    ts = q(date_col) if isinstance(dt, DATETIME_TYPES) else F.try_to_timestamp(q(date_col))
    return (df.select(ts.cast("timestamp_ntz").alias("ts"), present(q(value_col)).alias("y"))
            .where(F.col("ts").isNotNull()))


# ----------------------------------------------------------------------------- ordered lag

def with_prev(df: DataFrame, col: str, partitions: int | None = None) -> DataFrame:
    """Adds ``prev`` = previous value of ``col`` in ascending order, without a global window.

    Range-partitions by ``col`` (written once); lags inside each partition; the first row of a
    partition takes the maximum of all earlier partitions from a table with one
    row per partition (broadcast; its size is the partition count).
    """
    r, before = _ranged(df, [col], partitions)
    w = Window.partitionBy("__pid").orderBy(col)
    ends = r.groupBy("__pid").agg(F.max(col).alias("__end"))
    carry = ends.select("__pid", F.max("__end").over(before).alias("__carry"))
    return (r.withColumn("prev", F.lag(col).over(w)).join(F.broadcast(carry), "__pid")      # one row per partition
            .withColumn("prev", F.coalesce("prev", "__carry")).drop("__pid", "__carry"))


def _ranged(df: DataFrame, cols: list[str], partitions: int | None = None):
    """The rows range-partitioned by ``cols`` with their partition in ``__pid``, written once, and the window of earlier partitions."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = written(df.repartitionByRange(n, *cols).withColumn("__pid", F.spark_partition_id()))
    return r, Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)             # over one row per partition


def numbered(series: DataFrame) -> DataFrame:
    """(pos, ts, y): the place of each row in the order of (ts, y), from 0, without a global window."""
    r, before = _ranged(series.select("ts", "y"), ["ts", "y"])
    counts = r.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    offset = counts.select("__pid", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__pid").orderBy("ts", "y")
    return (r.withColumn("__i", F.row_number().over(inside) - 1).join(F.broadcast(offset), "__pid")      # one row per partition
            .select((F.col("__before") + F.col("__i")).alias("pos"), "ts", "y"))


def with_halo(series: DataFrame, before: int, after: int, block: int | None = None) -> tuple[DataFrame, "Window"]:
    """Rows dealt to blocks of neighbouring positions, with border rows copied to the blocks that need them.

    A row at ``pos`` is needed by the positions pos - after .. pos + before, so it goes to their blocks (one, or
    two near a border); ``__own`` marks it in its own block. Returns the rows and the window
    over a block by position, in which every own row sees its neighbours.
    """
    size = block or max(HALO_BLOCK, 8 * (before + after))
    home = F.floor(F.col("pos") / size)
    reach = F.sequence(F.floor((F.col("pos") - after) / size), F.floor((F.col("pos") + before) / size))
    rows = series.withColumn("__block", F.explode(reach)).withColumn("__own", F.col("__block") == home)
    return rows, Window.partitionBy("__block").orderBy("pos")


def gaps(series: DataFrame) -> DataFrame:
    """Distinct times with multiplicity and the gap (microseconds) to the previous time."""
    distinct = series.groupBy("ts").agg(F.count(F.lit(1)).alias("mult"))
    p = with_prev(distinct, "ts")
    return p.withColumn("gap_us", F.expr("timestampdiff(MICROSECOND, prev, ts)"))


# ----------------------------------------------------------------------------- T03 - T05

def _weekday():
    return F.upper(F.date_format("ts", "EEE"))


def _month_name():
    return F.upper(F.date_format("ts", "MMM"))


def infer_frequency(series: DataFrame) -> DataFrame:
    """Calendar frequency of the sorted distinct times, or null when irregular.

    Rules (checked in this order, as the pandas inference does): fewer than 3
    points or repeated times -> null; equal month steps on month starts ->
    YS/QS/MS (with count), on month ends -> YE/QE/ME; equal steps in whole
    days -> W-<DAY> (multiples of 7) or D; weekdays only with 1-day steps and
    3-day steps over weekends -> B; equal sub-day steps -> h, min, s.
    """
    g = gaps(series)
    ts = F.col("ts")
    feats = g.select(
        "ts", "mult", "gap_us",
        ((F.year(ts) * 12 + F.month(ts)) - (F.year("prev") * 12 + F.month("prev"))).alias("mdiff"),
        (F.dayofmonth(ts) == 1).alias("is_ms"), (F.last_day(ts) == F.to_date(ts)).alias("is_me"),
        (F.date_format(ts, "HH:mm:ss.SSSSSS") == "00:00:00.000000").alias("midnight"),
        F.dayofweek(ts).alias("dow"), F.dayofweek("prev").alias("pdow"))
    day = 86_400_000_000
    agg = feats.agg(
        F.count(F.lit(1)).alias("n"), F.max("mult").alias("max_mult"),
        F.min("gap_us").alias("gmin"), F.max("gap_us").alias("gmax"),
        F.min("mdiff").alias("mmin"), F.max("mdiff").alias("mmax"),
        F.bool_and("is_ms").alias("all_ms"), F.bool_and("is_me").alias("all_me"),
        F.bool_and("midnight").alias("all_mid"),
        F.bool_and(~F.col("dow").isin(1, 7)).alias("weekdays"),
        F.bool_and(F.col("gap_us").isNull() | (F.col("gap_us") == day) |
                   ((F.col("gap_us") == 3 * day) & (F.col("pdow") == 6) & (F.col("dow") == 2))).alias("bsteps"),
        F.min_by(F.struct(_weekday().alias("wd"), _month_name().alias("mon"), F.month("ts").alias("m")), "ts").alias("first"))

    def count_prefix(k, alias):
        k = k.cast("long")
        return F.when(k == 1, F.lit(alias)).otherwise(F.concat(k.cast("string"), F.lit(alias)))

    mm = F.col("mmin")
    q_anchor = F.element_at(F.array(*[F.lit(x) for x in ("DEC", "OCT", "NOV")]),
                            (F.col("first.m") % 3 + 1).cast("int"))
    q_end = F.element_at(F.array(*[F.lit(x) for x in ("DEC", "JAN", "FEB")]),
                         (F.col("first.m") % 3 + 1).cast("int"))
    monthly_ok = (mm == F.col("mmax")) & (mm > 0) & F.col("all_mid")
    month_start = (F.when(mm % 12 == 0, F.concat(count_prefix(mm / 12, "YS"), F.lit("-"), F.col("first.mon")))
                   .when(mm % 3 == 0, F.concat(count_prefix(mm / 3, "QS"), F.lit("-"), q_anchor))
                   .otherwise(count_prefix(mm, "MS")))
    month_end = (F.when(mm % 12 == 0, F.concat(count_prefix(mm / 12, "YE"), F.lit("-"), F.col("first.mon")))
                 .when(mm % 3 == 0, F.concat(count_prefix(mm / 3, "QE"), F.lit("-"), q_end))
                 .otherwise(count_prefix(mm, "ME")))
    g0 = F.col("gmin")
    days = (g0 / day).cast("long")
    fixed = F.col("gmin") == F.col("gmax")
    freq = (F.when((F.col("n") < 3) | (F.col("max_mult") > 1) | (g0 <= 0), F.lit(None).cast("string"))
            .when(monthly_ok & F.col("all_ms"), month_start)
            .when(monthly_ok & F.col("all_me"), month_end)
            .when(fixed & (g0 % day == 0) & (days % 7 == 0),
                  F.concat(count_prefix((days / 7).cast("long"), "W"), F.lit("-"), F.col("first.wd")))
            .when(fixed & (g0 % day == 0), count_prefix(days, "D"))
            .when(F.col("weekdays") & F.col("bsteps") & (g0 == day), F.lit("B"))
            .when(fixed & (g0 % 3_600_000_000 == 0), count_prefix((g0 / 3_600_000_000).cast("long"), "h"))
            .when(fixed & (g0 % 60_000_000 == 0), count_prefix((g0 / 60_000_000).cast("long"), "min"))
            .when(fixed & (g0 % 1_000_000 == 0), count_prefix((g0 / 1_000_000).cast("long"), "s")))
    return agg.select(freq.alias("inferred_freq"))


def gap_count(series: DataFrame) -> DataFrame:
    """Gaps larger than 1.5 x the median gap (median over all consecutive differences,
    repeated times counting as zero gaps), only when the median is positive."""
    g = written(gaps(series))
    zeros = g.agg(F.coalesce(F.sum(F.col("mult") - 1), F.lit(0))).first()[0]

    def middle(m: int) -> list[int]:
        """The middle places among ``zeros`` zero gaps and ``m`` positive ones."""
        return [(zeros + m - 1) // 2, (zeros + m) // 2]

    m, at = order_statistics(g, {"g": F.col("gap_us")}, lambda m: [r - zeros for r in middle(m) if r >= zeros])["g"]
    median = None
    if zeros + m:
        median = sum(0.0 if r < zeros else at[r - zeros][0] for r in middle(m)) / 2
    over = g.where(F.col("gap_us") > F.lit(median) * GAP_FACTOR).count() if median else 0
    return series.sparkSession.createDataFrame([(median, over)], "median_gap_us double, gap_count long")


def range_points(series: DataFrame) -> DataFrame:
    """Number of points and the date range."""
    return series.agg(F.count(F.lit(1)).alias("n_points"), F.min("ts").alias("start"), F.max("ts").alias("end"))


# ----------------------------------------------------------------------------- T06, T07

@dataclass
class Step:
    months: int = 0
    micros: int = 0


def parse_step(freq: str) -> Step:
    """Calendar step of a frequency string (count prefix honoured)."""
    head = freq.split("-")[0]
    num = "".join(ch for ch in head if ch.isdigit())
    k = int(num) if num else 1
    unit = head[len(num):]
    months = {"MS": 1, "ME": 1, "M": 1, "QS": 3, "QE": 3, "Q": 3, "YS": 12, "YE": 12, "Y": 12, "A": 12, "AS": 12}
    micros = {"D": 86_400_000_000, "W": 7 * 86_400_000_000, "h": 3_600_000_000, "H": 3_600_000_000,
              "min": 60_000_000, "T": 60_000_000, "s": 1_000_000, "S": 1_000_000}
    if unit in months:
        return Step(months=k * months[unit])
    if unit in micros:
        return Step(micros=k * micros[unit])
    raise ValueError(f"unsupported frequency for a regular grid: {freq}")


def with_position(series: DataFrame, freq: str) -> DataFrame:
    """Period index of each time since the first time (null if off the grid)."""
    step = parse_step(freq)
    start = series.agg(F.min("ts").alias("t0"))
    s = series.crossJoin(F.broadcast(start))  # one-row side
    if step.months:
        md = ((F.year("ts") * 12 + F.month("ts")) - (F.year("t0") * 12 + F.month("t0")))
        pos = F.when(md % step.months == 0, (md / step.months).cast("long"))
    else:
        us = F.expr("timestampdiff(MICROSECOND, t0, ts)")
        pos = F.when(us % step.micros == 0, (us / step.micros).cast("long"))
    return s.withColumn("pos", pos).drop("t0")


def regular_grid(series: DataFrame, freq: str) -> DataFrame:
    """Every period between the first and last time, value null where absent (asfreq).

    The grid is generated by ``spark.range`` (distributed) against the one-row
    bounds frame (the start never leaves Spark, so no time-zone round trip),
    then left-joined on position.
    """
    spark = series.sparkSession
    step = parse_step(freq)
    pos = with_position(series, freq).where(F.col("pos").isNotNull())
    bounds = series.agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    if step.months:
        span = ((F.year("t1") * 12 + F.month("t1")) - (F.year("t0") * 12 + F.month("t0"))) / step.months
    else:
        span = F.expr("timestampdiff(MICROSECOND, t0, t1)") / step.micros
    n = bounds.select(F.floor(span).cast("long") + 1).first()[0] or 0  # one number
    grid = spark.range(0, n).select(F.col("id").alias("pos")).crossJoin(F.broadcast(bounds))  # one-row side
    if step.months:
        month_end = freq.split("-")[0].lstrip("0123456789") in ("ME", "QE", "YE", "M", "Q", "Y", "A")
        d = F.add_months(F.to_date("t0"), (F.col("pos") * step.months).cast("int"))
        d = F.last_day(d) if month_end else d
        ts = d.cast("timestamp_ntz")
    else:
        ts = F.timestamp_add("MICROSECOND", F.col("pos") * F.lit(step.micros), F.col("t0"))
    grid = grid.select("pos", ts.alias("ts"))
    vals = pos.groupBy("pos").agg(F.first("y", ignorenulls=True).alias("y"))
    return grid.join(vals, "pos", "left").select("pos", "ts", "y")


def interpolate(grid: DataFrame) -> DataFrame:
    """Linear interpolation by position; trailing nulls take the last value; leading
    nulls are dropped. Positions are re-based so the first kept point is 0."""
    known = grid.where(F.col("y").isNotNull()).select("pos", "y")
    k = with_prev(known.withColumnRenamed("pos", "p"), "p").withColumnRenamed("prev", "pp")
    k = k.join(known.select(F.col("pos").alias("pp"), F.col("y").alias("yp")), "pp", "left")
    inner = (k.where(F.col("pp").isNotNull() & (F.col("p") - F.col("pp") > 1))
             .select("p", "y", "pp", "yp", F.explode(F.sequence(F.col("pp") + 1, F.col("p") - 1)).alias("pos"))
             .select("pos", (F.col("yp") + (F.col("y") - F.col("yp")) * (F.col("pos") - F.col("pp"))
                             / (F.col("p") - F.col("pp"))).alias("y_fill")))
    last = known.agg(F.max_by(F.struct("pos", "y"), "pos").alias("l"))
    tail = (grid.crossJoin(F.broadcast(last))  # one-row side
            .where(F.col("pos") > F.col("l.pos")).select("pos", F.col("l.y").alias("y_fill")))
    fills = inner.unionByName(tail)
    first = known.agg(F.min("pos").alias("p0"))
    out = (grid.join(fills, "pos", "left").crossJoin(F.broadcast(first))  # one-row side
           .where(F.col("pos") >= F.col("p0"))
           .select((F.col("pos") - F.col("p0")).alias("pos"), "ts", F.coalesce("y", "y_fill").alias("y")))
    return out


# ----------------------------------------------------------------------------- T09, T10

def moving_average(series: DataFrame, period: int, block: int | None = None) -> DataFrame:
    """The series plus ``ma``, its centered moving average (2 x p for an even period: half weight at both ends);
    null where a neighbour is missing. One shuffle, border rows copied (see ``with_halo``)."""
    h = period // 2
    rows, w = with_halo(series, h, h, block)
    frame = w.rangeBetween(-h, h)
    total = F.sum("y").over(frame)
    if period % 2 == 0:
        total = total - 0.5 * (F.max("y").over(w.rangeBetween(-h, -h)) + F.max("y").over(w.rangeBetween(h, h)))
    ma = F.when(F.count("y").over(frame) == 2 * h + 1, total / period)
    return rows.withColumn("ma", ma).where("__own").drop("__block", "__own")


def decompose(series: DataFrame, period: int) -> DataFrame:
    """Additive decomposition of a positioned series ``(pos, y)`` (pos 0..n-1, no nulls).

    trend = centered moving average; the ``period`` undefined values at each end
    are extrapolated by a least-squares line through the nearest ``period``
    trend values; seasonal = mean of (y - trend) per phase, centered to mean 0;
    resid = y - trend - seasonal.
    """
    s = moving_average(series, period)
    ends = s.where(F.col("ma").isNotNull()).agg(F.min("pos").alias("front"), F.max("pos").alias("back"))
    s = s.crossJoin(F.broadcast(ends))  # one-row side
    fit_front = (s.where((F.col("pos") >= F.col("front")) & (F.col("pos") < F.least(F.col("front") + period, F.col("back"))))
                 .agg(F.regr_slope("ma", "pos").alias("kf"), F.regr_intercept("ma", "pos").alias("nf")))
    fit_back = (s.where((F.col("pos") >= F.greatest(F.col("front"), F.col("back") - period)) & (F.col("pos") < F.col("back")))
                .agg(F.regr_slope("ma", "pos").alias("kb"), F.regr_intercept("ma", "pos").alias("nb")))
    s = s.crossJoin(F.broadcast(fit_front)).crossJoin(F.broadcast(fit_back))  # one-row sides
    trend = (F.when(F.col("pos") < F.col("front"), F.col("kf") * F.col("pos") + F.col("nf"))
             .when(F.col("pos") > F.col("back"), F.col("kb") * F.col("pos") + F.col("nb"))
             .otherwise(F.col("ma")))
    s = s.withColumn("trend", trend).withColumn("phase", (F.col("pos") % period).cast("int"))
    means = s.groupBy("phase").agg(F.avg(F.col("y") - F.col("trend")).alias("pm"))
    wall = Window.partitionBy()  # over ``period`` rows
    means = means.withColumn("seasonal", F.col("pm") - F.avg("pm").over(wall)).select("phase", "seasonal")
    out = s.join(F.broadcast(means), "phase")  # period rows
    return out.select("pos", "y", "trend", "seasonal",
                      (F.col("y") - F.col("trend") - F.col("seasonal")).alias("resid"))


def strengths(decomp: DataFrame) -> DataFrame:
    """Trend and seasonal strength, 3 decimals; null when the denominator is 0."""
    one = decomp.agg(F.var_samp("resid").alias("vr"),
                     F.var_samp(F.col("trend") + F.col("resid")).alias("vtr"),
                     F.var_samp(F.col("seasonal") + F.col("resid")).alias("vsr"))
    return one.select(
        F.when(F.col("vtr") > 0, F.round(F.greatest(F.lit(0.0), 1 - F.col("vr") / F.col("vtr")), 3)).alias("trend_strength"),
        F.when(F.col("vsr") > 0, F.round(F.greatest(F.lit(0.0), 1 - F.col("vr") / F.col("vsr")), 3)).alias("seasonal_strength"))


# ----------------------------------------------------------------------------- T11 - T13

def acf(series: DataFrame, max_lags: int | None = None, block: int | None = None) -> DataFrame:
    """Autocorrelation (biased, as plotted by the reference) for lags 1..L,
    L = min(24, n // 2 - 1); needs >= 10 points and some spread. One shuffle, border rows copied (see ``with_halo``)."""
    stats = series.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("m"))
    row = stats.first()  # one row
    n = row["n"]
    spark = series.sparkSession
    if n < MIN_ACF_POINTS:
        return spark.createDataFrame([], "lag int, acf double")
    lags = max_lags or max(1, min(MAX_ACF_LAGS, n // 2 - 1))
    rows, w = with_halo(series.select("pos", (F.col("y") - F.lit(row["m"])).alias("d")), 0, lags, block)
    later = [F.max("d").over(w.rangeBetween(k, k)) for k in range(lags + 1)]
    seen = rows.select("d", "__own", *[x.alias(f"d{k}") for k, x in enumerate(later)]).where("__own")
    sums = seen.agg(*[F.sum(F.col("d") * F.col(f"d{k}")).alias(f"s{k}") for k in range(lags + 1)])
    out = F.array(*[F.struct(F.lit(k).alias("lag"), (F.col(f"s{k}") / F.when(F.col("s0") > 0, F.col("s0"))).alias("acf")) for k in range(1, lags + 1)])
    return sums.select(F.inline(out)).where(F.col("acf").isNotNull())


def pacf_from_acf(acf_df: DataFrame) -> DataFrame:
    """Partial autocorrelation by Durbin-Levinson on the (<= 24) biased ACF values."""
    vals = sorted((r["lag"], r["acf"]) for r in acf_df.collect())  # <= 24 rows
    spark = acf_df.sparkSession
    r = [1.0] + [v for _, v in vals]
    out = []
    phi_prev: list[float] = []
    for k in range(1, len(r)):
        if k == 1:
            phi_kk = r[1]
            phi = [phi_kk]
        else:
            num = r[k] - sum(phi_prev[j] * r[k - 1 - j] for j in range(k - 1))
            den = 1.0 - sum(phi_prev[j] * r[j + 1] for j in range(k - 1))
            phi_kk = num / den if den != 0 else float("nan")
            phi = [phi_prev[j] - phi_kk * phi_prev[k - 2 - j] for j in range(k - 1)] + [phi_kk]
        out.append((k, float(phi_kk)))
        phi_prev = phi
    return spark.createDataFrame(out, "lag int, pacf double")


def lag_rolling(series: DataFrame, period: int, block: int | None = None) -> DataFrame:
    """Lag 1, lag p, rolling mean and std (ddof 1) over the last p points (full windows).
    One shuffle, border rows copied (see ``with_halo``)."""
    rows, w = with_halo(series.select(*[c for c in ("pos", "ts", "y") if c in series.columns]), period, 0, block)
    last = w.rangeBetween(-(period - 1), 0)
    full = F.count("y").over(last) == period
    return (rows.withColumn("lag_1", F.max("y").over(w.rangeBetween(-1, -1))).withColumn(f"lag_{period}", F.max("y").over(w.rangeBetween(-period, -period)))
            .withColumn("roll_mean", F.when(full, F.avg("y").over(last))).withColumn("roll_std", F.when(full, F.stddev_samp("y").over(last)))
            .where("__own").drop("__block", "__own"))


def prepare_irregular(series: DataFrame) -> DataFrame:
    """``(pos, ts, y)`` of a series without a frequency: places in time order, missing values filled
    linearly by place, so ACF, PACF and lags work as on a regular one."""
    return written(interpolate(numbered(series)))


def prepare_regular(series: DataFrame, freq: str, checkpoint: bool = True) -> DataFrame:
    """Grid + interpolation of a series at ``freq``: ``(pos, ts, y)``.

    The result is as long as the grid; it is checkpointed (to the shared
    ``spark.checkpoint.dir``) because the decomposition reads it several times
    and its lineage holds two range shuffles.
    """
    out = interpolate(regular_grid(series, freq))
    if checkpoint:
        from tablelens.session import checkpoint_dir
        checkpoint_dir(series.sparkSession)
        out = out.checkpoint(eager=True)
    return out
