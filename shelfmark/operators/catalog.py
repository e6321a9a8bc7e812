"""Snapshot upserts: pure functions of a state and a delta. A delta with a key twice raises; see last_of."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import at, is_slug, strip, url_host, url_scheme
from ..numbering import number_in_groups, number_rows
from ..schemas import InvalidSeed


def last_of(delta: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key: what is left after one write after another."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return delta.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def upsert(state: DataFrame, delta: DataFrame, keys: list[str], insert: dict[str, Column], update: dict[str, Column], new_id: str = "id", order: list[str] | None = None, above: int = 0, by: str | None = None) -> DataFrame:
    """State after delta. insert and update give column expressions over o.* (state) and d.* (delta); a
    column that update lacks is kept. New rows get ids after the greatest of state and `above` (where state
    is a part of a table), in the order of the keys, or of `order` (columns of delta) and then the keys.

    `by` is for a delta whose keys are known to be unique and which was made by groups: this column of it,
    with few values, comes before the order, and the rows of each value are numbered in a task."""
    if by is None:
        delta = unique(delta, keys)
    top = state.agg(F.greatest(F.coalesce(F.max(new_id), F.lit(0)), F.lit(above)).alias("_top"))
    added, order = delta.join(state.select(*keys), keys, "left_anti"), [*(order or []), *keys]
    fresh = (number_rows(added, order, "_n") if by is None else number_in_groups(added, by, order, "_n")).crossJoin(F.broadcast(top)).alias("d")  # top is one row
    kinds = dict(state.dtypes)
    kept = state.alias("o").join(delta.withColumn("_touched", F.lit(True)).alias("d"), [F.col(f"o.{k}") == F.col(f"d.{k}") for k in keys], "left")

    def old(c: str) -> Column:
        return (F.when(F.col("d._touched"), update[c]).otherwise(F.col(f"o.{c}")) if c in update else F.col(f"o.{c}")).cast(kinds[c]).alias(c)

    def new(c: str) -> Column:
        made = F.col("_top") + F.col("d._n") if c == new_id else insert.get(c, F.col(f"d.{c}") if c in delta.columns else F.lit(None))
        return made.cast(kinds[c]).alias(c)

    return kept.select(*map(old, state.columns)).unionByName(fresh.select(*map(new, state.columns)))


def unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows, but a key that occurs twice raises when it is read."""
    others = [c for c in rows.columns if c not in keys]
    if not others:
        others, rows = ["_none"], rows.withColumn("_none", F.lit(True))
    one = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(F.struct(*others)).alias("_row"))
    sound = F.when(F.col("_n") == 1, F.col("_row")).otherwise(F.raise_error(F.concat_ws(" ", F.lit("key occurs twice:"), *[F.col(k).cast("string") for k in keys])))
    return one.select(*keys, sound.alias("_row")).select(*keys, "_row.*").drop("_none")


def duplicates(state: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur twice: empty if the state is sound."""
    return state.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def _topic_insert(status: Column, now: datetime | Column) -> dict[str, Column]:
    return {"description": F.lit(""), "status": status, "created_at": at(now), "updated_at": at(now)}


def ensure_topics(topics: DataFrame, delta: DataFrame, now: datetime) -> DataFrame:
    """delta: slug, name. New ones are queued; a name that is still the slug is replaced."""
    name = F.when(F.col("o.name") == F.col("o.slug"), F.col("d.name")).otherwise(F.col("o.name"))
    return upsert(topics, delta, ["slug"], _topic_insert(F.lit("queued"), now), {"name": name, "updated_at": at(now)})


def put_topics(topics: DataFrame, delta: DataFrame, now: datetime | Column, order: list[str] | None = None, above: int = 0) -> DataFrame:
    """delta: slug, name, status. As ensure_topics, and the status is set."""
    name = F.when(F.col("o.name") == F.col("o.slug"), F.col("d.name")).otherwise(F.col("o.name"))
    return upsert(topics, delta, ["slug"], _topic_insert(F.col("d.status"), now), {"name": name, "status": F.col("d.status"), "updated_at": at(now)}, order=order, above=above)


def set_status(topics: DataFrame, delta: DataFrame) -> DataFrame:
    """delta: topic_id, status, updated_at, for few topics that are there; a topic is known by its id."""
    own = delta.select(F.col("topic_id").alias("id"), F.col("status").alias("_status"), F.col("updated_at").alias("_at"))
    made = {"status": F.coalesce("_status", "status"), "updated_at": F.coalesce("_at", "updated_at")}
    return topics.join(F.broadcast(own), "id", "left").select(*[made.get(c, F.col(c)).alias(c) for c in topics.columns])


def import_topics(topics: DataFrame, delta: DataFrame, now: datetime) -> DataFrame:
    """delta: slug, name, description. Overwritten and made active; updated_at stays."""
    new = {"status": F.lit("active"), "created_at": at(now), "updated_at": at(now)}
    return upsert(topics, delta, ["slug"], new, {"name": F.col("d.name"), "description": F.col("d.description"), "status": F.lit("active")})


def put_search_pages(pages: DataFrame, delta: DataFrame, now: datetime | Column, order: list[str] | None = None, above: int = 0, by: str | None = None) -> DataFrame:
    """delta: topic_id, url, title, source, reading_order, search_run_id. A known page keeps its place,
    its metadata and its failures, and is active again."""
    new = {"official": F.lit(False), "active": F.lit(True), "discovered_at": at(now), "verification_failures": F.lit(0), "last_error": F.lit(""), "created_at": at(now), "updated_at": at(now)}
    return upsert(pages, delta, ["topic_id", "url"], new, {"title": F.col("d.title"), "source": F.col("d.source"), "active": F.lit(True), "search_run_id": F.col("d.search_run_id"), "updated_at": at(now)}, order=order, above=above, by=by)


_META = ["title", "source", "official", "estimated_minutes", "difficulty", "evergreen_score", "reading_order"]


def put_import_pages(pages: DataFrame, delta: DataFrame, now: datetime) -> DataFrame:
    """delta: topic_id, url and all metadata. Everything is overwritten."""
    new = {"active": F.lit(True), "verification_failures": F.lit(0), "last_error": F.lit(""), "created_at": at(now), "updated_at": at(now)}
    return upsert(pages, delta, ["topic_id", "url"], new, {c: F.col(f"d.{c}") for c in _META} | {"active": F.lit(True), "updated_at": at(now)})


def shift_orders(pages: DataFrame, topics: DataFrame) -> DataFrame:
    """reading_order becomes -id for the pages of topics (topic_id), to make room for an import."""
    hit = topics.select("topic_id", F.lit(True).alias("_hit")).distinct()
    return pages.join(hit, "topic_id", "left").withColumn("reading_order", F.when(F.col("_hit"), -F.col("id")).otherwise(F.col("reading_order")).cast("int")).select(*pages.columns)


def deactivate_omitted(pages: DataFrame, kept: DataFrame, now: datetime) -> DataFrame:
    """Pages of the imported topics that kept (topic_id, url) lacks, those found by search included."""
    hit = kept.select("topic_id", F.lit(True).alias("_topic")).distinct()
    own = kept.select("topic_id", "url", F.lit(True).alias("_kept")).distinct()
    gone = F.col("_topic").isNotNull() & F.col("_kept").isNull()
    rows = pages.join(hit, "topic_id", "left").join(own, ["topic_id", "url"], "left")
    return rows.withColumn("active", F.col("active") & ~gone).withColumn("updated_at", F.when(gone, at(now)).otherwise(F.col("updated_at"))).select(*pages.columns)


def put_candidates(results: DataFrame, delta: DataFrame, now: datetime | Column, order: list[str] | None = None, above: int = 0) -> DataFrame:
    """delta: topic_id, url, search_run_id, title, source, snippet, rank. A known URL loses its review."""
    blank = {"stored_as_page_id": F.lit(None), "reviewer_score": F.lit(None), "page_type": F.lit(""), "reviewer_reason": F.lit(""), "accepted": F.lit(False)}
    taken = {c: F.col(f"d.{c}") for c in ("search_run_id", "title", "source", "snippet", "rank")}
    return upsert(results, delta, ["topic_id", "url"], blank | {"created_at": at(now)}, taken | blank, order=order, above=above)


def put_reviewed(results: DataFrame, delta: DataFrame, now: datetime | Column, order: list[str] | None = None, above: int = 0, by: str | None = None) -> DataFrame:
    """delta: as put_candidates, with the review fields and stored_as_page_id."""
    names = ("search_run_id", "title", "source", "snippet", "rank", "stored_as_page_id", "reviewer_score", "page_type", "reviewer_reason", "accepted")
    return upsert(results, delta, ["topic_id", "url"], {"created_at": at(now)}, {c: F.col(f"d.{c}") for c in names}, order=order, above=above, by=by)


def seed_pages(seed: DataFrame) -> DataFrame:
    """seed: rows of topic, name, description, pages. One row a page, with its 1-based place."""
    return seed.select("topic", F.posexplode("pages").alias("_p", "page")).select("topic", (F.col("_p") + 1).cast("int").alias("page_index"), "page.*")


def page_faults(pages: DataFrame) -> DataFrame:
    """Each page's first fault, or null."""
    url, first = F.coalesce(F.col("url"), F.lit("")), Window.partitionBy("topic", "url").orderBy("page_index")
    seen = F.row_number().over(first) > 1
    fault = (
        F.when(strip(F.coalesce("title", F.lit(""))) == "", "title is required")
        .when(strip(url) == "", "url is required")
        .when((url_scheme(url) == "") | (url_host(url) == ""), "url must be absolute")
        .when(~url_scheme(url).isin("http", "https"), "url must use http or https")
        .when(F.col("estimated_minutes") < 1, "estimated_minutes must be positive")
        .when(~F.col("evergreen_score").between(0, 100), "evergreen_score must be between 0 and 100")
        .when(seen, "duplicate url")
    )
    return pages.withColumn("fault", fault)


def seed_faults(seed: DataFrame) -> DataFrame:
    """topic and its first fault: the document's own, or the first page's that has one."""
    first = page_faults(seed_pages(seed)).filter("fault is not null").groupBy("topic").agg(F.min(F.struct("page_index", "fault")).alias("_f"))
    own = (
        F.when(strip(F.coalesce("topic", F.lit(""))) == "", "topic is required")
        .when(~is_slug(F.col("topic")), "topic must be a lowercase slug")
        .when(strip(F.coalesce("name", F.lit(""))) == "", "name is required")
        .when(F.coalesce(F.size("pages"), F.lit(0)) < 1, "at least one page is required")
    )
    paged = F.when(F.col("_f").isNotNull(), F.concat(F.lit("page "), F.col("_f.page_index"), F.lit(": "), F.col("_f.fault")))
    return seed.join(first, "topic", "left").select("topic", F.coalesce(own, paged).alias("fault"))


def import_seed(topics: DataFrame, pages: DataFrame, imports: DataFrame, seed: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Topics, pages and imports after importing one seed document; a faulty one is logged and raised by
    the caller through check_seed."""
    topic = seed.select(F.col("topic").alias("slug"), "name", F.coalesce("description", F.lit("")).alias("description"))
    new_topics = import_topics(topics, topic, now)
    rows = seed_pages(seed).join(new_topics.select(F.col("slug").alias("topic"), F.col("id").alias("topic_id")), "topic")
    delta = rows.select("topic_id", "url", "title", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("official", F.lit(False)).alias("official"), "estimated_minutes", "difficulty", "evergreen_score", F.col("page_index").alias("reading_order"))
    new_pages = deactivate_omitted(put_import_pages(shift_orders(pages, delta), delta, now), delta, now)
    return new_topics, new_pages, log_import(imports, seed, "completed", "", now)


def log_import(imports: DataFrame, seed: DataFrame, status: str, error: str, now: datetime) -> DataFrame:
    top = imports.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    n = F.coalesce(F.size("pages"), F.lit(0))
    row = number_rows(seed, ["topic"], "_n").crossJoin(F.broadcast(top)).select(  # top is one row
        (F.col("top") + F.col("_n")).cast("long").alias("id"), "topic", F.lit(status).alias("status"), at(now).alias("started_at"), at(now).alias("completed_at"),
        n.alias("pages_found"), (n if status == "completed" else F.lit(0)).alias("pages_imported"), F.lit(error).alias("error"),
    )
    return imports.unionByName(row.select(*imports.columns))


def try_import(topics: DataFrame, pages: DataFrame, imports: DataFrame, seed: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame, DataFrame, InvalidSeed | None]:
    """As import_seed; a faulty document changes nothing but for a failed row in imports."""
    try:
        check_seed(seed)
    except InvalidSeed as e:
        return topics, pages, log_import(imports, seed, "failed", str(e), now), e
    return *import_seed(topics, pages, imports, seed, now), None


def delete_topics(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """The tables without the topics of gone (id) and all that belongs to them; a result that stays is
    no longer stored as a page that goes."""
    ids = gone.select(F.col("id").alias("topic_id")).distinct()
    lost = tables["pages"].join(ids, "topic_id", "left_semi").select(F.col("id").alias("stored_as_page_id"), F.lit(True).alias("_lost"))
    out = {n: df.join(ids, "topic_id", "left_anti").select(*df.columns) if "topic_id" in df.columns else df for n, df in tables.items()}
    out["topics"] = tables["topics"].join(gone.select("id"), "id", "left_anti").select(*tables["topics"].columns)
    results = out["topic_search_results"]
    cleared = F.when(F.col("_lost").isNull(), F.col("stored_as_page_id")).alias("stored_as_page_id")
    out["topic_search_results"] = results.join(lost, "stored_as_page_id", "left").select(*[cleared if c == "stored_as_page_id" else c for c in results.columns])
    return out


def check_seed(seed: DataFrame) -> None:
    row = seed_faults(seed).filter("fault is not null").first()
    if row is not None:
        raise InvalidSeed(f"{row['topic']}: {row['fault']}")
