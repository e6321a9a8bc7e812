"""One stable item for each topic and day."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import at, epoch_day
from ..numbering import number_rows
from ..schemas import InvalidDate, NoActivePages, ReadingNotFound, TopicNotFound


def rotation(pages: DataFrame, days: DataFrame) -> DataFrame:
    """topic_id, reading_date, page_id for each topic and day: the page in turn, by floor modulo.

    pages has topic_id, id, reading_order, active; days has topic_id and reading_date. Each day picks
    its page by an equi-join on topic and turn, so nothing multiplies."""
    own = Window.partitionBy("topic_id")
    turns = pages.filter("active").select("topic_id", F.col("id").alias("page_id"), (F.row_number().over(own.orderBy("reading_order", "id")) - 1).alias("turn"))
    counts = pages.filter("active").groupBy("topic_id").agg(F.count("*").alias("n"))
    asked = days.join(counts, "topic_id").withColumn("turn", F.pmod(F.unix_date("reading_date"), F.col("n")).cast("int"))
    return asked.join(turns, ["topic_id", "turn"]).select("topic_id", "reading_date", "page_id")


def first_writers(assignments: DataFrame) -> DataFrame:
    """Of assignments to one topic and day the least id stands."""
    return assignments.groupBy("topic_id", "reading_date").agg(F.min_by("page_id", "id").alias("page_id"), F.min("id").alias("id"))


def with_details(assignments: DataFrame, topics: DataFrame, pages: DataFrame) -> DataFrame:
    """Assignments with their topic and page; neither's status matters."""
    t = topics.select(F.col("id").alias("topic_id"), F.col("slug").alias("topic_slug"), F.col("name").alias("topic_name"))
    p = pages.select(F.col("id").alias("page_id"), "title", "url", "source", "official", "estimated_minutes", "difficulty")
    return assignments.join(t, "topic_id").join(p, "page_id")


def get_or_create(assignments: DataFrame, wanted: DataFrame, topics: DataFrame, pages: DataFrame, now: datetime) -> DataFrame:
    """The assignments after serving wanted (topic_id, reading_date): stored ones stand, missing ones of
    active topics are made and get the next ids."""
    active = topics.filter("status = 'active'").select(F.col("id").alias("topic_id"))
    missing = wanted.select("topic_id", "reading_date").distinct().join(assignments, ["topic_id", "reading_date"], "left_anti").join(active, "topic_id", "left_semi")
    return _appended(assignments, rotation(pages, missing), now)


def assign_titled(assignments: DataFrame, wanted: DataFrame, topics: DataFrame, pages: DataFrame, now: datetime) -> DataFrame:
    """The assignments with those of wanted (slug, title, reading_date), whose topic and page are found by
    slug and title. Stored ones of a topic and day stand; of several pages the least id is taken."""
    t = topics.select(F.col("id").alias("topic_id"), "slug")
    p = pages.select("topic_id", "title", F.col("id").alias("page_id"))
    made = wanted.join(t, "slug").join(p, ["topic_id", "title"]).groupBy("topic_id", "reading_date").agg(F.min("page_id").alias("page_id"))
    return _appended(assignments, made.join(assignments, ["topic_id", "reading_date"], "left_anti"), now)


def _appended(assignments: DataFrame, made: DataFrame, now: datetime) -> DataFrame:
    top = assignments.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    numbered = number_rows(made, ["topic_id", "reading_date"], "_n").crossJoin(F.broadcast(top))  # one row
    new = numbered.select((F.col("top") + F.col("_n")).cast("long").alias("id"), "topic_id", "reading_date", "page_id", at(now).alias("created_at"))
    return assignments.select("id", "topic_id", "reading_date", "page_id", "created_at").unionByName(new)


def check_date(spark, date: str) -> int:
    day = spark.range(1).select(epoch_day(F.lit(date)).alias("d")).first()["d"]
    if day is None:
        raise InvalidDate(date)
    return day


def daily_reading(assignments: DataFrame, topics: DataFrame, pages: DataFrame, slug: str, date: str):
    """The stored reading of a day; never makes one."""
    check_date(assignments.sparkSession, date)
    own = topics.filter(F.col("slug") == slug)
    row = with_details(assignments.filter(F.col("reading_date") == F.lit(date).cast("date")), own, pages).first()
    if row is None:
        raise ReadingNotFound(slug) if own.filter("status = 'active'").limit(1).count() else TopicNotFound(slug)
    return row


def daily_reading_or_new(assignments: DataFrame, topics: DataFrame, pages: DataFrame, slug: str, date: str, now: datetime) -> tuple[DataFrame, object]:
    """The assignments afterwards, and the reading."""
    spark = assignments.sparkSession
    check_date(spark, date)
    try:
        return assignments, daily_reading(assignments, topics, pages, slug, date)
    except ReadingNotFound:
        pass
    wanted = topics.filter(F.col("slug") == slug).select(F.col("id").alias("topic_id"), F.lit(date).cast("date").alias("reading_date"))
    after = get_or_create(assignments, wanted, topics, pages, now)
    row = with_details(after.filter(F.col("reading_date") == F.lit(date).cast("date")), topics.filter(F.col("slug") == slug), pages).first()
    if row is None:
        raise NoActivePages(slug)
    return after, row
