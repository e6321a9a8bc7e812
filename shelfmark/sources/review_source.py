"""Reviews of many topics in one job: one request a topic, made by tasks, some at once."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..numbering import shared_path
from .edges import answer_text, decode_reviews
from .remote import Caller, side_by_side
from .services import PROMPT, read_answer, review_body

ANSWERS = "topic string, model string, input_tokens int, output_tokens int, total_tokens int, attempts int, error string, body string"


def review_requests(asked: DataFrame) -> DataFrame:
    """asked (topic, name, index, title, url, source, snippet, rank) as one row a topic. A topic's
    candidates are those of one search, so a row is small."""
    one = F.struct("index", "title", "url", "source", "snippet", F.col("rank").alias("provider_rank"))
    return asked.groupBy("topic").agg(F.max("name").alias("name"), F.to_json(F.array_sort(F.collect_list(one))).alias("candidates"))


@dataclass(frozen=True)
class ReviewAll:
    """A reviewer for many topics at once. at_once bounds the requests in flight over all tasks, in_flight
    those of one task; a topic's failure is its error and leaves the others alone."""

    spark: SparkSession
    endpoint: str
    token: str
    model: str
    prompt: str = PROMPT
    timeout: float = 30.0
    attempts: int = 3
    wait: float = 0.5
    at_once: int = 8
    in_flight: int = 2

    def answers(self, asked: DataFrame) -> DataFrame:
        """ANSWERS for each topic of asked, from the shared folder: each is asked once."""
        caller = Caller(self.endpoint, self.token, self.timeout, self.attempts, self.wait)
        model, prompt, width = self.model, self.prompt, max(1, min(self.in_flight, self.at_once))

        def run(batches: Iterator) -> Iterator:
            import pandas as pd

            def one(row) -> tuple:
                body = review_body(row.name_ or row.topic, json.loads(row.candidates), model, prompt)
                reply = caller.ask(json.dumps(body).encode())
                answer, error = ({}, reply.error) if reply.error else read_answer("review", reply.status, reply.text)
                usage = answer.get("usage") if isinstance(answer.get("usage"), dict) else {}
                tokens = [int(usage.get(f"{n}_tokens") or 0) for n in ("input", "output", "total")]
                return row.topic, str(answer.get("model") or ""), *tokens, reply.attempts, error, "" if error else reply.text

            for b in batches:
                rows = [r for _, r in side_by_side(one, b.itertuples(index=False), width)]
                yield pd.DataFrame(rows, columns=[f.split()[0] for f in ANSWERS.split(", ")])

        dealt = review_requests(asked).withColumnRenamed("name", "name_").repartition(max(1, self.at_once // width))
        path = shared_path(asked, "reviews")
        dealt.mapInPandas(run, ANSWERS).write.parquet(path)
        raw = answer_text(self.spark.read.schema(ANSWERS).parquet(path))
        bad = F.when(F.trim("text") == "", "the review has no text").when(F.from_json("text", "results array<string>")["results"].isNull(), "the review can't be read")
        return raw.withColumn("error", F.when(F.col("error") != "", F.col("error")).otherwise(F.coalesce(bad, F.lit("")))).withColumn("body", F.col("text")).drop("text")

    def review_all(self, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The reviews (topic, review_position, index, score, page_type, should_store, reason), and a row
        a topic: topic, model, input_tokens, output_tokens, total_tokens, attempts, error."""
        told = self.answers(asked)
        return decode_reviews(told.filter("error = ''").select("topic", "body")), told.drop("body")
