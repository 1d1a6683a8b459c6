"""As-of joins, neighbours in time, calendars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

from terraloom.schema import EPOCH_DAYS, FIRST_EPOCH, LAST_EPOCH

#: Days per bucket of an as-of join.
BUCKET_DAYS = 256


def _bucket(day: Column) -> Column:
    return F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / BUCKET_DAYS).cast("int")


def around(left: DataFrame, right: DataFrame, left_time: str, right_time: str, by: Sequence[str] = ()) -> DataFrame:
    """``left`` with the last ``right_time`` before its ``left_time`` (``before``) and the first one not before (``at_or_after``).

    Only the distinct times of both sides are matched: they are dealt by key and time bucket and meet in one sorted pass (no
    pair of rows is tested); what lies beyond a time's bucket comes from a summary of one row per bucket. Rows of
    ``left`` then find their time by equality. Times are dates; others are refused, as buckets and ``before`` go by days."""
    for side, time in ((left, left_time), (right, right_time)):
        if not isinstance(side.schema[time].dataType, DateType):
            raise TypeError(f"{time} has to be a date, not {side.schema[time].dataType.simpleString()}")
    rows = left.select(*by, F.col(left_time).alias("_day")).where(F.col(left_time).isNotNull()).distinct().withColumn("_side", F.lit(1))
    marks = right.select(*by, F.col(right_time).alias("_day")).where(F.col(right_time).isNotNull()).distinct()
    mixed = rows.unionByName(marks.select("*", F.lit(0).alias("_side")), allowMissingColumns=True).withColumn("_bucket", _bucket(F.col("_day")))
    mark = F.when(F.col("_side") == 0, F.col("_day"))
    w = Window.partitionBy(*by, "_bucket").orderBy(F.col("_day"))
    within = mixed.select(
        *by, "_day", "_side", "_bucket",
        F.max(mark).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)).alias("_upto"),
        F.min(mark).over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing)).alias("_next"),
        F.max(F.when(F.col("_side") == 0, F.col("_day"))).over(Window.partitionBy(*by, "_bucket").orderBy(F.datediff("_day", F.lit("1970-01-01").cast("date"))).rangeBetween(Window.unboundedPreceding, -1)).alias("_prev"),
    ).where("_side = 1")
    summary = mixed.groupBy(*by, "_bucket").agg(F.min(mark).alias("_lo"), F.max(mark).alias("_hi"))
    wb = Window.partitionBy(*by).orderBy("_bucket")
    carried = summary.select(
        *by, "_bucket", F.max("_hi").over(wb.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry_prev"), F.min("_lo").over(wb.rowsBetween(1, Window.unboundedFollowing)).alias("_carry_next")
    )
    told = within.join(carried, [*by, "_bucket"], "left").select(*by, F.col("_day").alias(left_time), F.coalesce("_prev", "_carry_prev").alias("before"), F.coalesce("_next", "_carry_next").alias("at_or_after"))
    return left.join(told, [*by, left_time], "left").select(*left.columns, "before", "at_or_after")


def nearest(left: DataFrame, right: DataFrame, left_time: str, right_time: str, by: Sequence[str] = (), difference: str = "days") -> DataFrame:
    """``left`` with ``nearest``, the closest ``right_time``; of two equally close ones the later. ``difference='yyyyddd'`` measures
    on year-and-day numbers, which tears the years apart, as some archives do."""
    near = around(left, right, left_time, right_time, by)
    span = F.datediff if difference == "days" else (lambda a, b: year_day(a) - year_day(b))
    before, after = F.col("before"), F.col("at_or_after")
    pre, post = F.abs(span(F.col(left_time), before)), F.abs(span(after, F.col(left_time)))
    return near.select(*left.columns, F.when(after.isNull() | (pre < post), before).otherwise(after).alias("nearest"))


def neighbours(left: DataFrame, right: DataFrame, left_time: str, right_time: str, win: int, key: str) -> DataFrame:
    """(key, side, rank, day): up to ``win`` right times before each left time (side 'pre') and ``win`` after it (side 'post'; an
    equal one counts as after). Right times are numbered once; neighbours are then numbers, joined by equality."""
    order = Window.partitionBy("_one").orderBy(right_time)
    numbered = right.select(F.lit(1).alias("_one"), right_time).where(F.col(right_time).isNotNull()).distinct().select(F.row_number().over(order).alias("no"), F.col(right_time).alias("day"))
    near = around(left, right, left_time, right_time)
    n_before = numbered.withColumnRenamed("day", "before").withColumnRenamed("no", "no_before")
    n_after = numbered.withColumnRenamed("day", "at_or_after").withColumnRenamed("no", "no_after")
    placed = near.join(n_before, "before", "left").join(n_after, "at_or_after", "left")
    sides = placed.select(key, F.explode(F.sequence(F.lit(1), F.lit(win))).alias("rank"), "no_before", "no_after").select(
        key, "rank", F.explode(F.array(F.struct(F.lit("pre").alias("side"), (F.col("no_before") - F.col("rank") + 1).alias("no")), F.struct(F.lit("post").alias("side"), (F.col("no_after") + F.col("rank") - 1).alias("no")))).alias("s")
    )
    return sides.select(key, "s.side", "rank", "s.no").join(numbered, "no").select(key, "side", "rank", "day")


def year_day(day: Column) -> Column:
    """A date as the number YYYYDDD."""
    return (F.year(day) * 1000 + F.dayofyear(day)).cast("int")


def from_year_day(number: Column) -> Column:
    return F.date_add(F.make_date(F.floor(number / 1000).cast("int"), F.lit(1), F.lit(1)), (number % 1000 - 1).cast("int"))


def calendar(spark: SparkSession, first: str = FIRST_EPOCH, last: str = LAST_EPOCH) -> DataFrame:
    """epoch_seq, epoch_date, year, doy: the epochs of the archive, every eighth day of each year from its first on."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("epoch_date"))
    kept = days.where((F.dayofyear("epoch_date") - 1) % EPOCH_DAYS == 0)
    return kept.select((F.row_number().over(Window.orderBy("epoch_date")) - 1).alias("epoch_seq"), "epoch_date", F.year("epoch_date").alias("year"), F.dayofyear("epoch_date").alias("doy"))


def latest_days(df: DataFrame, day: str, today: str, delta: int, end: str | None = None) -> DataFrame:
    """The ``delta`` latest distinct days up to ``today`` (and from ``end`` on), newest first."""
    days = df.select(day).where(F.col(day) <= F.lit(today).cast("date")).distinct()
    days = days.where(F.col(day) >= F.lit(end).cast("date")) if end else days
    return days.orderBy(F.desc(day)).limit(delta)
