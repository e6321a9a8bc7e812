"""Pages that moved: which may take the URL that their link now leads to.

A URL belongs to one page of a topic. Moves are made one after another in the order of the pages' ids,
so a page may take a URL that an earlier page left in the same pass, but not one that a later page
still holds, nor one that an earlier page took. The first page that comes after a URL's holder is the
only one that can get it, and gets it if the holder itself got away; so each such page points to one
holder with a smaller id, and all that can be won follows by going along these pointers. They are
followed by doubling: each round joins the pages that are undecided with what they point to, and
halves the longest way that is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..numbering import written


def resolve_moves(pages: DataFrame, moves: DataFrame) -> DataFrame:
    """id and moved for each of moves (id, final_url): whether the page gets that URL. pages: id,
    topic_id, url, of which topic_id and url are one page's. A move to the page's own URL is none and
    gets no row."""
    own = pages.select("id", F.col("topic_id").alias("_t"), F.col("url").alias("_from"))
    wanted = moves.join(own, "id").filter((F.col("final_url") != F.col("_from")) & F.col("final_url").isNotNull()).select("id", "_t", F.col("final_url").alias("_to"))
    holders = own.select("_t", F.col("_from").alias("_to"), F.col("id").alias("_holder"))
    asked = wanted.join(holders, ["_t", "_to"], "left")
    # of those that come after the holder the first one has a chance
    first = F.min(F.when(F.col("_holder").isNull() | (F.col("id") > F.col("_holder")), F.col("id")))
    chance = asked.groupBy("_t", "_to").agg(first.alias("_first"), F.max("_holder").alias("_holder")).filter("_first is not null")
    # next: the page whose move decides; state: true or false once that is known
    edges = chance.select(F.col("_first").alias("id"), F.col("_holder").alias("next"))
    known = edges.select(F.col("id").alias("next"), F.lit(True).alias("_has"))
    start = edges.join(known, "next", "left").select("id", "next", F.when(F.col("next").isNull(), F.lit(True)).when(F.col("_has").isNull(), F.lit(False)).alias("state"))
    state = _followed(start)
    return wanted.select("id").join(state.select("id", "state"), "id", "left").select("id", F.coalesce("state", F.lit(False)).alias("moved"))


def _followed(state: DataFrame) -> DataFrame:
    """state (id, next, state) with every state known, by doubling the pointers."""
    while True:
        state = written(state, "moves")
        if not state.filter("state is null").limit(1).count():
            return state
        ahead = state.select(F.col("id").alias("next"), F.col("next").alias("_next"), F.col("state").alias("_state"))
        open_ = state.filter("state is null").join(ahead, "next").select("id", F.col("_next").alias("next"), F.col("_state").alias("state"))
        state = state.filter("state is not null").unionByName(open_)
