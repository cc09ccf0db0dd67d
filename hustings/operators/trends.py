"""Smoothing, house effects, decay means, outliers, sessions. All times are days; points are pre-aggregated by day, which loses nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def day_buckets(points: DataFrame, by: list[str], day: str, value: str) -> DataFrame:
    """(by, day) -> __n, __sum of v, __squares of v: all that kernels need of a day."""
    return points.groupBy(*by, day).agg(F.count(value).alias("__n"), F.sum(value).alias("__sum"), F.sum(F.col(value) * F.col(value)).alias("__squares"))


def _grid(buckets: DataFrame, by: list[str], day: str, step: int) -> DataFrame:
    span = buckets.groupBy(*by).agg(F.min(day).alias("__a"), F.max(day).alias("__b"), F.sum("__n").alias("points"))
    return span.select(*by, "points", F.explode(F.sequence("__a", "__b", F.expr(f"interval {step} day"))).alias("t"))


def kernel(buckets: DataFrame, at: DataFrame, by: list[str], day: str, bandwidth: float, t: str = "t") -> DataFrame:
    """Gaussian kernel exp(-(d / bandwidth)^2) over day buckets at the times t of each series: mean, sd and days to the nearest point."""
    b = buckets.select(*by, F.col(day).alias("__d"), "__n", "__sum", "__squares")
    d = F.datediff(F.col(t), F.col("__d"))
    w = F.exp(-(d * d) / (bandwidth * bandwidth))
    sums = at.join(b, by).groupBy(*at.columns).agg(F.sum(w * F.col("__n")).alias("__w"), F.sum(w * F.col("__sum")).alias("__s"), F.sum(w * F.col("__squares")).alias("__q"), F.min(F.abs(d)).alias("nearest"))
    mean = F.col("__s") / F.col("__w")
    return sums.withColumn("mean", mean).withColumn("sd", F.sqrt(F.greatest(F.lit(0.0), F.col("__q") / F.col("__w") - mean * mean))).drop("__w", "__s", "__q")


def kernel_smooth(points: DataFrame, by: list[str], day: str, value: str, bandwidth: float, step: int = 1, max_gap: int = 75) -> DataFrame:
    """(by, t, mean, sd, segment): a grid from first to last point; times further than max_gap days from any point break the line.

    A series of one point gives that point, its sd null, segment 1.
    """
    b = day_buckets(points, by, day, value)
    out = kernel(b, _grid(b, by, day, step), by, day, bandwidth)
    w = Window.partitionBy(*by).orderBy("t")
    out = out.withColumn("__far", F.col("nearest") > max_gap)
    out = out.withColumn("__new", (~F.col("__far") & F.coalesce(F.lag("__far").over(w), F.lit(True))).cast("int")).withColumn("segment", F.sum("__new").over(w))
    return out.filter("NOT __far").select(*by, "t", "mean", F.when(F.col("points") >= 2, F.col("sd")).alias("sd"), "segment")


def peaks(smoothed: DataFrame, by: list[str], least: float) -> DataFrame:
    """Series whose smoothed maximum reaches `least`."""
    return smoothed.groupBy(*by).agg(F.max("mean").alias("peak")).filter(F.col("peak") >= least)


def residuals(points: DataFrame, by: list[str], day: str, value: str, bandwidth: float) -> DataFrame:
    """points with residual: value less the series' trend at its day, the point itself included."""
    b = day_buckets(points, by, day, value)
    trend = kernel(b, b.select(*by, F.col(day).alias("t")), by, day, bandwidth).select(*by, F.col("t").alias(day), F.col("mean").alias("__trend"))
    return points.join(trend, [*by, day]).withColumn("residual", F.col(value) - F.col("__trend")).drop("__trend")


def house_effects(points: DataFrame, by: list[str], day: str, value: str, agency: str, sample: str | None = None, bandwidth: float = 30, shrink: float = 10, least: int = 3) -> DataFrame:
    """(agency, n, effect): mean residual weighted by the root of the sample size, shrunk by n / (n + shrink); 0 under `least` points."""
    w = F.sqrt(F.coalesce(F.nullif(F.col(sample).cast("double"), F.lit(0.0)), F.lit(1.0))) if sample else F.lit(1.0)
    r = residuals(points, by, day, value, bandwidth).groupBy(agency).agg(F.count("*").alias("n"), (F.sum(w * F.col("residual")) / F.sum(w)).alias("__m"))
    return r.select(agency, "n", F.when(F.col("n") < least, 0.0).otherwise(F.col("n") / (F.col("n") + shrink) * F.col("__m")).alias("effect"))


def without_house(points: DataFrame, effects: DataFrame, agency: str, value: str) -> DataFrame:
    """points with adjusted: value less its agency's effect (0 for one without)."""
    return points.join(effects.select(agency, "effect"), agency, "left").withColumn("adjusted", F.col(value) - F.coalesce("effect", F.lit(0.0))).drop("effect")


def decayed_top2(polls: DataFrame, region: list[str], key: Column, name: str, pct: str, end: str, sample: str, error: Column, now: str, days: float = 7, recent_days: int = 30, recent_n: int = 2) -> DataFrame:
    """Per region the two largest decay-weighted means, their gap, the gap less the mean error, and whether few polls are recent.

    Weight exp(-age / days) * (sample size, 500 if missing or 0); shares outside 0..100 are left out; names come from the key's latest poll.
    """
    today = F.lit(now).cast("date")
    age = F.greatest(F.lit(0), F.datediff(today, F.col(end)))
    w = F.exp(-age / days) * F.coalesce(F.nullif(F.col(sample).cast("double"), F.lit(0.0)), F.lit(500.0))
    p = polls.filter(F.col(pct).between(0, 100)).withColumn("__key", key).withColumn("__w", w).withColumn("__err", error)
    per = p.groupBy(*region, "__key").agg((F.sum(F.col(pct) * F.col("__w")) / F.sum("__w")).alias("mean"), F.max_by(name, F.struct(end, name)).alias("name"))
    rank = F.row_number().over(Window.partitionBy(*region).orderBy(F.col("mean").desc(), "__key"))
    two = per.withColumn("__r", rank).filter("__r <= 2").groupBy(*region).agg(
        *[F.max(F.when(F.col("__r") == i, F.col(c))).alias(f"{n}_{c}") for i, n in ((1, "first"), (2, "second")) for c in ("name", "mean")]
    )
    info = p.groupBy(*region).agg(F.avg("__err").alias("error"), F.count_if(age <= recent_days).alias("n_recent"))
    out = two.join(info, region).withColumn("gap", F.col("first_mean") - F.col("second_mean"))
    return out.withColumn("effective_gap", F.greatest(F.lit(0.0), F.col("gap") - F.coalesce("error", F.lit(0.0)))).withColumn("low_recent", F.col("n_recent") < recent_n)


def mad_outliers(samples: DataFrame, key: list[str], day: str, value: str, sample_id: str, days: int = 21, least: int = 3, least_mad: float = 2.0, floor: float = 15.0, times: float = 4.0) -> DataFrame:
    """Samples further than max(floor, times * mad) from the median of their key's samples within `days` days, themselves included.

    Needs `least` samples and a mad of `least_mad`. Values are counted by day, map-side; each count goes once to each day with samples whose window it is
    in (stretches of days meet by an equi-join), and medians are percentiles weighted by counts, which aggregate partially: no array grows with a
    window. Null keys are a key; samples without a day or a value are in no window and never outliers.
    """
    names = [f"__k{i}" for i in range(len(key))]
    on = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in names]
    own = [F.col(k).alias(n) for k, n in zip(key, names, strict=True)]
    dated = samples.filter(F.col(day).isNotNull() & F.col(value).isNotNull()).select(*own, F.unix_date(day).alias("d"), F.col(value).cast("double").alias("v"))
    counts = dated.groupBy(*names, "d", "v").agg(F.count("*").alias("n"))
    width = days + 1
    stretch = counts.withColumn("s", F.floor(F.col("d") / width)).alias("a")
    middle = counts.select(*names, "d").distinct().withColumn("s", F.explode(F.sequence(F.floor((F.col("d") - days) / width), F.floor((F.col("d") + days) / width)))).alias("b")
    near = stretch.join(middle, [*on("a", "b"), F.col("a.s") == F.col("b.s"), F.abs(F.col("a.d") - F.col("b.d")) <= days]).select(*[f"b.{k}" for k in names], F.col("b.d").alias("d"), "a.v", "a.n")
    median = near.groupBy(*names, "d").agg(F.sum("n").alias("total"), F.expr("percentile(v, 0.5, n)").alias("median")).filter(F.col("total") >= least)
    off = near.alias("a").join(median.alias("b"), [*on("a", "b"), F.col("a.d") == F.col("b.d")]).select(*[f"b.{k}" for k in names], "b.d", "total", "median", "a.n", F.abs(F.col("a.v") - F.col("median")).alias("v"))
    stats = off.groupBy(*names, F.col("d").alias("__d")).agg(F.first("total").alias("__n"), F.first("median").alias("__median"), F.expr("percentile(v, 0.5, n)").alias("__mad")).filter(F.col("__mad") >= least_mad)
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(key, names, strict=True)] + [F.unix_date(day) == F.col("__d")]
    far = F.abs(F.col(value) - F.col("__median")) > F.greatest(F.lit(floor), F.col("__mad") * times)
    out = [F.col("__n").alias("n"), F.col("__median").alias("median"), F.col("__mad").alias("mad")]
    return samples.join(stats, same).filter(far).select(*key, sample_id, day, value, *out)


def gap_sessions(points: DataFrame, by: list[str], when: str, gap_seconds: float, pos: list[str]) -> DataFrame:
    """Adds session, from 1: a new one starts after a gap longer than gap_seconds."""
    w = Window.partitionBy(*by).orderBy(when, *pos)
    gap = F.unix_micros(F.col(when).cast("timestamp")) - F.unix_micros(F.lag(F.col(when).cast("timestamp")).over(w))
    return points.withColumn("__new", (F.coalesce(gap > gap_seconds * 1_000_000, F.lit(True))).cast("int")).withColumn("session", F.sum("__new").over(w)).drop("__new")


def spearman(df: DataFrame, by: list[str], x: str, y: str, pos: list[str]) -> DataFrame:
    """Correlation of ordinal ranks, ties by position."""
    w = Window.partitionBy(*by)
    r = df.withColumn("__x", F.row_number().over(w.orderBy(x, *pos))).withColumn("__y", F.row_number().over(w.orderBy(y, *pos)))
    return r.groupBy(*by).agg(F.count("*").alias("n"), F.corr("__x", "__y").alias("rho"))


def nearest_month(df: DataFrame, candidates: DataFrame, by: list[str], month: str, other: str, take: str, pos: list[str]) -> DataFrame:
    """The take of the candidate in the same month, else the nearest in the same year, else the nearest at all; months are first days.

    Of the candidates of a month the first by pos (take, if it is listed, last) counts, so a key has one for each month; they form one
    list and each row stays one row. A row of a null month gets nothing.
    """
    order = [F.col(p).alias(f"p{i}") for i, p in enumerate(pos)]
    of_month = candidates.filter(F.col(other).isNotNull()).groupBy(*by, F.col(other).alias("__m")).agg(F.min(F.struct(*order, F.col(take).alias("take"))).alias("__first"))
    months = of_month.groupBy(*by).agg(F.collect_list(F.struct(F.col("__m").alias("m"), F.col("__first").alias("first"))).alias("__months"))
    m = F.col(month)
    near = F.transform("__months", lambda c: F.struct((m != c["m"]).alias("a"), (F.year(m) != F.year(c["m"])).alias("b"), F.abs(F.months_between(m, c["m"])).alias("c"), c["first"].alias("first")))
    return df.join(months, by, "left").select(*df.columns, F.when(m.isNotNull(), F.array_min(near)["first"]["take"]).alias(take))


def latest_series_top(points: DataFrame, series: str, value: str, day: str, now: str, n: int = 2, within: int = 14) -> DataFrame:
    """The n series of largest mean among those seen within `within` days of now."""
    s = points.groupBy(series).agg(F.avg(value).alias("mean"), F.max(day).alias("last_seen"))
    return s.filter(F.datediff(F.lit(now).cast("date"), F.col("last_seen")) <= within).orderBy(F.col("mean").desc(), series).limit(n)
