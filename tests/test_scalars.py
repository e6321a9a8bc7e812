from pyspark.sql import functions as F

from shelfmark.functions import scalars as S
from shelfmark.functions.scoring import interest


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(expr.alias("x")).first()["x"]


def test_slug_and_display(spark):
    assert one(spark, S.slugify(F.col("a")), a="  C++ & Rust_lang 2! ") == "c-rust-lang-2"
    assert one(spark, S.display_name(F.col("a")), a="rust__lang-x y") == "Rust Lang X y"


def test_urls(spark):
    for url, want in {
        "HTTPS://Docs.Example.org/a/?q=1#f": "https://docs.example.org/a",
        "https://h.example.org/": "https://h.example.org/",
        "https://h.example.org": "https://h.example.org",
        "ftp://h.example.org/a": None,
        "nothing": None,
    }.items():
        assert one(spark, S.normalize_url(F.col("a")), a=url) == want


def test_text(spark):
    assert one(spark, S.sanitize_ascii(F.col("a")), a="a\nb  é c") == "ab c"
    assert one(spark, S.truncate_bytes(F.col("a"), 4), a=" abé ") == "abé"
    assert one(spark, S.truncate_bytes(F.col("a"), 3), a="abéd")[:2] == "ab"


def test_days(spark):
    for date, want in {"1970-01-02": 1, "1969-12-31": -1, "2026-6-27": None, "2026-02-30": None}.items():
        assert one(spark, S.epoch_day(F.col("a")), a=date) == want


def test_paths(spark):
    r = one(spark, S.reading_path(F.col("a")), a="/go-lang/2024-01-01/")
    assert (r["ok"], r["topic"], r["date"]) == (True, "go-lang", "2024-01-01")
    assert not one(spark, S.reading_path(F.col("a")), a="/a/b/c")["ok"]
    assert one(spark, S.topic_path(F.col("a"), "status"), a="/topics/x-1/status") == "x-1"


def test_score(spark):
    def score(title, url, snippet, provider):
        df = spark.createDataFrame([(title, url, snippet, provider)], "t string, u string, s string, p double")
        return df.select(interest(F.col("t"), F.col("u"), F.col("s"), S.url_host(F.col("u")), F.col("p")).alias("x")).first()["x"]

    # own cases: title, path and snippet words; a documentation host; a bad title on a front page; stale text
    assert score("A guide to locks", "https://docs.example.com/guide/locks/one", "explains locks", 0.0) == 24 + 20 + 12 + 24
    assert score("Locks", "https://www.example.org/a/b", "plain", 0.31) == 10 + 3
    assert score("Best locks", "https://example.com/", "a mirror of version 1.2", 1.0) == -30 - 10 - 15 + 10
    assert score("Locks", "https://example.com/blog/a/b", "plain", 0.0) == -30


def test_times(spark):
    assert str(one(spark, S.parse_time(F.col("a")), a="2024-02-29 23:59:59")) == "2024-02-29 23:59:59"
    assert one(spark, S.parse_time(F.col("a")), a="2024-2-29 23:59:59") is one(spark, S.parse_time(F.col("a")), a="2023-02-29 00:00:00") is None
    assert one(spark, S.format_time(S.parse_time(F.col("a"))), a="2024-02-29 01:02:03") == "2024-02-29 01:02:03"
