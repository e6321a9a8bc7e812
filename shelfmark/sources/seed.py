"""Seed documents in YAML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import SEED


def read_seed_file(spark: SparkSession, path: str) -> DataFrame:
    """The seed document in a file of any storage that Spark reads."""
    return read_seed(spark, spark.read.text(path, wholetext=True).first()["value"])


def read_seed(spark: SparkSession, text: str) -> DataFrame:
    """One row: topic, name, description, pages."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("seed documents need PyYAML") from e
    doc = yaml.safe_load(text) or {}
    names = ("title", "url", "source", "official", "estimated_minutes", "difficulty", "evergreen_score")
    pages = [tuple(p.get(n) for n in names) for p in doc.get("pages") or []]
    row = (doc.get("topic"), doc.get("name"), doc.get("description") or "", pages)
    return spark.createDataFrame([(row,)], f"doc {SEED}").select("doc.*")
