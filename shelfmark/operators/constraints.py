"""What the tables of a catalog must obey, declared once: keys, required columns, allowed values, and
references with what a deletion does along them. One plan finds every violation; deletions follow the
references."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import RUN_STATUSES, TOPIC_STATUSES, CatalogError

CASCADE, RESTRICT, SET_NULL = "cascade", "restrict", "set null"


class Held(CatalogError):
    """Rows that should go are held by others that stay."""


@dataclass(frozen=True)
class Reference:
    """column of table refers to id of parent."""

    table: str
    column: str
    parent: str
    on_delete: str = RESTRICT


@dataclass(frozen=True)
class Rules:
    keys: tuple[tuple[str, tuple[str, ...]], ...] = ()
    required: tuple[tuple[str, tuple[str, ...]], ...] = ()
    allowed: tuple[tuple[str, str, tuple], ...] = ()
    references: tuple[Reference, ...] = ()

    def order(self) -> list[str]:
        """The tables that references join, parents before those that refer to them."""
        left = {t for r in self.references for t in (r.table, r.parent)}
        out: list[str] = []
        while left:
            ready = sorted(t for t in left if not any(r.table == t and r.parent in left for r in self.references))
            if not ready:
                raise CatalogError(f"references go in a circle: {', '.join(sorted(left))}")
            out += ready
            left -= set(ready)
        return out


# What the catalog's tables declare.
CATALOG = Rules(
    keys=(
        ("topics", ("id",)), ("topics", ("slug",)), ("pages", ("id",)), ("pages", ("topic_id", "url")), ("pages", ("topic_id", "reading_order")), ("daily_readings", ("id",)),
        ("daily_readings", ("topic_id", "reading_date")), ("imports", ("id",)), ("topic_search_runs", ("id",)), ("topic_search_results", ("id",)), ("topic_search_results", ("topic_id", "url")),
    ),
    required=(
        ("topics", ("slug", "name", "description", "status", "created_at", "updated_at")),
        ("pages", ("topic_id", "title", "url", "source", "official", "reading_order", "active", "verification_failures", "last_error", "created_at", "updated_at")),
        ("daily_readings", ("topic_id", "reading_date", "page_id", "created_at")),
        ("imports", ("topic", "status", "started_at", "pages_found", "pages_imported", "error")),
        ("topic_search_runs", ("topic_id", "provider", "query", "status", "started_at", "result_count", "stored_count", "error", "stage")),
        ("topic_search_results", ("topic_id", "search_run_id", "title", "url", "source", "snippet", "rank", "created_at", "accepted")),
    ),
    allowed=(("topics", "status", tuple(TOPIC_STATUSES)), ("topic_search_runs", "status", tuple(RUN_STATUSES)), ("imports", "status", ("running", "completed", "failed"))),
    references=(
        Reference("pages", "topic_id", "topics", CASCADE), Reference("daily_readings", "topic_id", "topics", CASCADE), Reference("daily_readings", "page_id", "pages", RESTRICT),
        Reference("topic_search_runs", "topic_id", "topics", CASCADE), Reference("topic_search_results", "topic_id", "topics", CASCADE),
        Reference("topic_search_results", "search_run_id", "topic_search_runs", CASCADE), Reference("topic_search_results", "stored_as_page_id", "pages", SET_NULL),
    ),
)

VIOLATION = "table string, rule string, key string, n long"


def _named(df: DataFrame, table: str, rule: Column | str, key: Column, n: Column) -> DataFrame:
    return df.select(F.lit(table).alias("table"), (F.lit(rule) if isinstance(rule, str) else rule).alias("rule"), key.alias("key"), n.cast("long").alias("n"))


def _text(columns: tuple[str, ...]) -> Column:
    return F.array_join(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns]), ",")


def violations(tables: dict[str, DataFrame], rules: Rules = CATALOG) -> DataFrame:
    """table, rule, key and n of everything that breaks a rule; empty if the tables are sound. The checks of
    rows are made in one pass over each table; a key that occurs n times is one row with n, and so is a
    value that n rows refer to in vain. Nulls break neither keys nor references nor allowed values. Rules
    of tables that aren't given, or of columns that a table lacks, are left out."""
    has = lambda t, *cs: t in tables and all(c in tables[t].columns for c in cs)
    out = []
    for name, df in tables.items():
        checks = [(f"{c} is required", F.col(c).isNull()) for t, cs in rules.required if t == name for c in cs if has(t, c)]
        checks += [(f"{c} is none of the allowed", ~F.col(c).isin(list(values))) for t, c, values in rules.allowed if t == name and has(t, c)]
        if checks:
            broken = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(rule)) for rule, bad in checks]), lambda x: x.isNotNull())
            rows = df.select(_text(("id",)).alias("_key"), F.explode(broken).alias("_rule"))
            out.append(_named(rows, name, F.col("_rule"), F.col("_key"), F.lit(1)))
    for table, columns in rules.keys:
        if has(table, *columns):
            whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
            twice = tables[table].filter(whole).groupBy(*columns).agg(F.count("*").alias("_n")).filter("_n > 1")
            out.append(_named(twice, table, f"{', '.join(columns)} is a key", _text(columns), F.col("_n")))
    for r in rules.references:
        if has(r.table, r.column) and has(r.parent, "id"):
            counted = tables[r.table].filter(F.col(r.column).isNotNull()).groupBy(F.col(r.column).alias("id")).agg(F.count("*").alias("_n"))
            lost = counted.join(tables[r.parent].select("id"), "id", "left_anti")
            out.append(_named(lost, r.table, f"{r.column} refers to {r.parent}", _text(("id",)), F.col("_n")))
    return reduce(DataFrame.unionByName, out)


def deleted(tables: dict[str, DataFrame], table: str, gone: DataFrame, rules: Rules = CATALOG) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables without the rows of `table` whose id gone (id) has, and without all that goes with them;
    and what holds one of these rows: table, id, column, parent, parent_id of each row that stays and refers
    to it by a reference that restricts. Where anything holds, nothing may be deleted (see `delete`). A row
    that goes itself holds nothing."""
    if table not in tables:
        raise CatalogError(f"there is no table {table}")
    lost: dict[str, DataFrame] = {table: gone.select(F.col("id").cast("long").alias("id")).distinct()}
    order = rules.order()
    for name in order[order.index(table) + 1 :] if table in order else []:
        if name not in tables:
            continue
        ways = [r for r in rules.references if r.table == name and r.on_delete == CASCADE and r.parent in lost]
        found = [tables[name].join(lost[r.parent].withColumnRenamed("id", "_p"), F.col(r.column) == F.col("_p"), "left_semi").select("id") for r in ways]
        if found:
            lost[name] = reduce(DataFrame.unionByName, found).distinct()
    after = {n: df.join(lost[n], "id", "left_anti").select(*df.columns) if n in lost else df for n, df in tables.items()}
    held = []
    for r in rules.references:
        if r.table not in tables or r.parent not in lost:
            continue
        hit = lost[r.parent].select(F.col("id").alias("_p"), F.lit(True).alias("_hit"))
        if r.on_delete == RESTRICT:
            stays = after[r.table].join(hit, F.col(r.column) == F.col("_p"))
            held.append(stays.select(F.lit(r.table).alias("table"), "id", F.lit(r.column).alias("column"), F.lit(r.parent).alias("parent"), F.col("_p").alias("parent_id")))
        elif r.on_delete == SET_NULL:
            df = after[r.table]
            cleared = F.when(F.col("_hit").isNull(), F.col(r.column)).alias(r.column)
            after[r.table] = df.join(hit, F.col(r.column) == F.col("_p"), "left").select(*[cleared if c == r.column else c for c in df.columns])
    none = gone.sparkSession.createDataFrame([], "table string, id long, column string, parent string, parent_id long")
    return after, reduce(DataFrame.unionByName, held, none)


def delete(tables: dict[str, DataFrame], table: str, gone: DataFrame, rules: Rules = CATALOG) -> dict[str, DataFrame]:
    """As deleted, but raises Held if anything holds a row that would go."""
    after, held = deleted(tables, table, gone, rules)
    row = held.first()
    if row is not None:
        raise Held(f"{row['table']} {row['id']} holds {row['parent']} {row['parent_id']}")
    return after
