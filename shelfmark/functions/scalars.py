"""Scalar functions as Column expressions; no Python runs for a row."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)([^?#]*)"


def strip(x: Column) -> Column:
    """Trim all white space, the no-break space and its kin included."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def strip_plain(x: Column) -> Column:
    """As strip; a text that begins and ends with a visible ASCII character is taken as it is. x is read
    several times, so it should be a column as it stands."""
    bare = F.substring(x, 1, 1).between("!", "~") & F.substring(x, -1, 1).between("!", "~")
    return F.when(bare, x).otherwise(strip(x))


def slugify(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip(x)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def display_name(x: Column, fallback: Column | None = None) -> Column:
    """Words parted by - and _, each with its first letter in upper case."""
    named = F.when(strip(x) == "", fallback).otherwise(x) if fallback is not None else x
    parts = F.filter(F.split(strip(named), "[-_]"), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))), " ")


#: Fixed value: what a search asks for beside the topic's name.
QUERY_SUFFIX = " specific concept tutorial guide deep dive documentation"


def query_text(name: Column) -> Column:
    return F.concat(name, F.lit(QUERY_SUFFIX))


def _part(url: Column, trimmed: bool, n: int) -> Column:
    return F.regexp_extract(url if trimmed else strip(url), _URL, n)


def url_scheme(url: Column, trimmed: bool = False) -> Column:
    return F.lower(_part(url, trimmed, 1))


def url_authority(url: Column, trimmed: bool = False) -> Column:
    return _part(url, trimmed, 2)


def host_of(authority: Column) -> Column:
    return F.regexp_replace(authority, "^.*@", "")


def login_of(authority: Column) -> Column:
    return F.regexp_extract(authority, "^.*@", 0)


def url_host(url: Column, trimmed: bool = False) -> Column:
    """Host with its port, without a user part, in lower case; empty for a URL that isn't absolute."""
    return F.lower(host_of(url_authority(url, trimmed)))


def url_login(url: Column) -> Column:
    """The user part with its @, as it is written."""
    return login_of(url_authority(url))


def url_path(url: Column, trimmed: bool = False) -> Column:
    return _part(url, trimmed, 3)


def normal_path(path: Column) -> Column:
    """Without trailing slashes, but for the root's."""
    return F.when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))


def url_valid(url: Column) -> Column:
    return F.coalesce(url_scheme(url).isin("http", "https") & (url_host(url) != ""), F.lit(False))


def normalize_url(url: Column) -> Column:
    """Scheme and host in lower case, no query, fragment or trailing slash but for the root's;
    a user part stays; null if invalid."""
    return F.when(url_valid(url), F.concat(url_scheme(url), F.lit("://"), url_login(url), url_host(url), normal_path(url_path(url))))


def bare_host(host: Column) -> Column:
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def truncate_bytes(x: Column, n: int) -> Column:
    """Trim, cut at n bytes of UTF-8, trim; what is left of a split character is replaced."""
    cut = F.substring(F.encode(strip_plain(x), "UTF-8"), 1, n)
    return strip(F.make_valid_utf8(cut.cast("string")))


def sanitize_ascii(x: Column) -> Column:
    kept = F.regexp_replace(x, r"[^\x20-\x7E]", "")
    return F.trim(F.regexp_replace(kept, " +", " "))


def epoch_day(date: Column) -> Column:
    """Days since 1970-01-01; null unless strictly YYYY-MM-DD."""
    return F.unix_date(F.when(date.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(date, "yyyy-MM-dd")))


def null_if_blank(x: Column) -> Column:
    return F.nullif(strip(x), F.lit(""))


def at(now: datetime | Column) -> Column:
    """A clock is a literal, or a column where rows have clocks of their own."""
    if isinstance(now, Column):
        return now
    return F.lit(now).cast("timestamp_ntz") if now.tzinfo is None else F.lit(now.replace(tzinfo=None)).cast("timestamp_ntz")


def format_time(t: Column) -> Column:
    """A UTC time as YYYY-MM-DD HH:MM:SS."""
    return F.date_format(t, "yyyy-MM-dd HH:mm:ss")


def parse_time(text: Column) -> Column:
    """The time that format_time wrote; null unless written just so."""
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))).cast("timestamp_ntz")


def day_start(t: Column) -> Column:
    return F.date_trunc("DAY", t).cast("timestamp_ntz")


def is_slug(x: Column) -> Column:
    return x.rlike("^[a-z0-9][a-z0-9-]*$")


def reading_path(path: Column) -> Column:
    """struct(topic, date, ok) of /topic or /topic/date; the date isn't checked here."""
    parts = F.split(F.regexp_replace(path, "^/+|/+$", ""), "/")
    topic = F.try_element_at(parts, F.lit(1))
    ok = F.size(parts).isin(1, 2) & is_slug(topic)
    return F.struct(F.when(ok, topic).alias("topic"), F.when(ok & (F.size(parts) == 2), F.try_element_at(parts, F.lit(2))).alias("date"), F.coalesce(ok, F.lit(False)).alias("ok"))


def topic_path(path: Column, view: str) -> Column:
    """The slug of /topics/{slug}/{view}; null otherwise."""
    return F.nullif(F.regexp_extract(path, rf"^/topics/([a-z0-9][a-z0-9-]*)/{view}/?$", 1), F.lit(""))


#: How HTML text is written, the ampersand first.
HTML_TEXT = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&#34;", "'": "&#39;", "+": "&#43;", "\0": "\ufffd"}


def html_text(x: Column) -> Column:
    """A value as text of an HTML page; null is empty."""
    out = F.coalesce(x.cast("string"), F.lit(""))
    for a, b in HTML_TEXT.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def status_label(status: Column, run_status: Column, stage: Column) -> Column:
    shown = (status == "searching") & (run_status == "running") & (strip(stage) != "")
    return F.when(F.coalesce(shown, F.lit(False)), stage).otherwise(status)
