"""Period counts, gaps, time features and trends."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewell.functions.special import normal_two_sided
from casewell.functions.values import any_of
from casewell.session import stage

# Hours at which each band of the day starts.
DAY_BANDS = {0: "night", 6: "morning", 12: "afternoon", 18: "evening"}
WEEKDAYS = {1: "sun", 2: "mon", 3: "tue", 4: "wed", 5: "thu", 6: "fri", 7: "sat"}


def period_start(ts: Column, unit: str) -> Column:
    """Start of the period: a date, or a timestamp without zone for hours and minutes. Independent
    of the time zone of the session."""
    day = ts.cast("date")
    if unit in ("hour", "minute"):
        minutes = [F.minute(ts)] if unit == "minute" else []
        hours = F.make_dt_interval(F.lit(0), F.hour(ts), *minutes)
        return (day.cast("timestamp_ntz") + hours).cast("timestamp_ntz")
    return day if unit == "day" else F.trunc(day, unit)


def _step(unit: str) -> Column:
    return F.expr("interval 3 months" if unit == "quarter" else f"interval 1 {unit}")


def period_counts(df: DataFrame, ts: str, unit: str) -> DataFrame:
    timed = df.filter(F.col(ts).isNotNull())
    return timed.groupBy(period_start(F.col(ts), unit).alias("period")).agg(
        F.count(F.lit(1)).alias("n")
    )


def period_series(df: DataFrame, ts: str, unit: str = "month") -> DataFrame:
    """Rows per period from the first to the last one, empty periods as 0.

    The window runs over the counted periods only, whose number the calendar bounds:
    each found period also yields the empty ones up to the next found one.
    """
    found = period_counts(df, ts, unit)
    following = F.lead("period").over(Window.orderBy("period"))
    last = F.coalesce((following - _step(unit)).cast(found.schema["period"].dataType), "period")
    spans = found.withColumn("_last", last)
    filled = spans.select(
        "period", "n", F.explode(F.sequence("period", "_last", _step(unit))).alias("p")
    )
    return filled.select(
        F.col("p").alias("period"),
        F.when(F.col("p") == F.col("period"), F.col("n")).otherwise(0).alias("n"),
    )


def monthly_series(df: DataFrame, ts: str) -> DataFrame:
    """Rows per month, labelled with the last day of the month."""
    series = period_series(df, ts, "month")
    return series.select(F.last_day("period").alias("month_end"), "n")


def missing_periods(df: DataFrame, ts: str, unit: str) -> DataFrame:
    """Periods without a row between the first and the last one."""
    return period_series(df, ts, unit).filter(F.col("n") == 0).select("period")


def completeness(df: DataFrame, ts: str, unit: str = "month") -> DataFrame:
    """Expected and present periods, and whether the data end before the last one does."""
    timed = df.filter(F.col(ts).isNotNull())
    found = timed.groupBy(period_start(F.col(ts), unit).alias("period")).agg(
        F.count(F.lit(1)).alias("n"), F.max(ts).alias("until")
    )
    bounds = found.agg(
        F.min("period").alias("first"),
        F.max("period").alias("last"),
        F.count(F.lit(1)).alias("present"),
        F.max("until").cast("date").alias("until"),
    )
    expected = F.size(F.sequence("first", "last", _step(unit))).cast("bigint")
    period_end = F.date_sub((F.col("last") + _step(unit)).cast("date"), 1)
    return bounds.select(
        expected.alias("expected"), "present", (F.col("until") < period_end).alias("partial_last")
    )


def time_features(df: DataFrame, ts: str, bands: Mapping[int, str] = DAY_BANDS) -> DataFrame:
    """Hour, band of the day, weekday, month and year."""
    t = F.col(ts)
    band = F.lit(None).cast("string")
    for start, label in sorted(bands.items()):
        band = F.when(F.hour(t) >= start, label).otherwise(band)
    return df.withColumns(
        {
            "hour": F.hour(t),
            "band": band,
            "weekday": F.dayofweek(t),
            "month": F.month(t),
            "year": F.year(t),
        }
    )


def hour_day(df: DataFrame, ts: str) -> DataFrame:
    """Rows per hour of the day (down) and weekday (across), 0 where none."""
    parts = df.select(F.hour(ts).alias("hour"), F.dayofweek(ts).alias("day"))
    wide = parts.groupBy("hour").pivot("day", list(WEEKDAYS)).agg(F.count(F.lit(1)))
    return wide.select(
        "hour", *[F.coalesce(str(d), F.lit(0)).alias(name) for d, name in WEEKDAYS.items()]
    )


def monthly_stack(df: DataFrame, ts: str, by: str, values: Sequence[str]) -> DataFrame:
    """Rows per month with one column per listed value, 0 where none."""
    month = F.trunc(F.col(ts).cast("date"), "month")
    wide = df.groupBy(month.alias("month")).pivot(by, list(values)).agg(F.count(F.lit(1)))
    return wide.select("month", *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).alias(v) for v in values])


def yearly_share(df: DataFrame, ts: str, flags: Sequence[Column], name: str = "share") -> DataFrame:
    """Yearly percentage of rows with any of the flags."""
    hit = any_of(*flags).cast("int")
    return df.groupBy(F.year(ts).alias("year")).agg(
        F.count(F.lit(1)).alias("n"), (F.avg(hit) * 100).alias(name)
    )


def flow_edges(df: DataFrame, *stages: str) -> DataFrame:
    """Row counts between each pair of neighbouring stages, from the counted paths."""
    paths = df.groupBy(*stages).agg(F.count(F.lit(1)).alias("n"))
    steps = [
        F.struct(
            F.lit(i).alias("step"),
            F.col(a).cast("string").alias("source"),
            F.col(b).cast("string").alias("target"),
        )
        for i, (a, b) in enumerate(zip(stages, stages[1:], strict=False), start=1)
    ]
    edges = paths.select("n", F.inline(F.array(*steps)))
    return edges.groupBy("step", "source", "target").agg(F.sum("n").alias("n"))


def mann_kendall(series: DataFrame, t: str, n: str) -> DataFrame:
    """Mann-Kendall trend test of a series of period counts: S, its variance, z and p.

    S is the number of rising minus falling pairs. No pair is built: two ranks differ
    first at one bit, so per bit and common higher bits it is enough to count, in time
    order, how many zeros stood before each one and how many ones before each zero.
    """
    # One row per period, staged because it is read for the ranks and for the ties.
    series = stage(series.select(t, n), "series")
    ranked = series.select(
        F.col(t).alias("_t"), (F.dense_rank().over(Window.orderBy(n)) - 1).alias("_r")
    )
    width = F.length(F.bin(F.max("_r").over(Window.partitionBy())))
    digits = ranked.withColumn("_w", width).select(
        "_t", "_r", F.explode(F.sequence(F.lit(0), F.col("_w") - 1)).alias("_bit")
    )
    branch = digits.select(
        "_t",
        "_bit",
        F.expr("shiftright(_r, _bit + 1)").alias("_high"),
        F.expr("shiftright(_r, _bit) & 1").alias("_one"),
    )
    before = (
        Window.partitionBy("_bit", "_high").orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
    )
    zeros = F.coalesce(F.sum(1 - F.col("_one")).over(before), F.lit(0))
    ones = F.coalesce(F.sum("_one").over(before), F.lit(0))
    signed = branch.select(F.when(F.col("_one") == 1, zeros).otherwise(-ones).alias("s"))
    s = signed.agg(F.sum("s").cast("bigint").alias("s"))
    ties = series.groupBy(n).agg(F.count(F.lit(1)).alias("g"))
    spread = "g * (g - 1) * (2 * g + 5)"
    sizes = ties.agg(
        F.sum("g").alias("periods"), F.sum(F.expr(spread)).cast("double").alias("tied")
    )
    m = F.col("periods").cast("double")
    joined = sizes.select(
        "periods", ((m * (m - 1) * (2 * m + 5) - F.col("tied")) / 18).alias("variance")
    ).withColumn("s", F.coalesce(s.scalar(), F.lit(0).cast("bigint")))
    z = F.when(
        F.col("variance") > 0,
        (F.col("s") - F.signum(F.col("s").cast("double"))) / F.sqrt("variance"),
    )
    result = joined.select("periods", "s", "variance", z.alias("z"))
    return result.withColumn("p_value", normal_two_sided("z"))
