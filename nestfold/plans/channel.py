"""The channel pipeline: free-form posts to pushes, each post handled once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nestfold.config import Destination, MatchConfig, WalkConfig
from nestfold.functions import text
from nestfold.operators import distance, enrich, metrics, similarity, state
from nestfold.session import cut


@dataclass
class ChannelOutputs:
    """``outcomes`` has every new post with its outcome; ``outbox`` the pushed ones."""

    outcomes: DataFrame
    outbox: DataFrame
    counts: DataFrame
    seen: DataFrame
    walk_cache: DataFrame


def run_channel(
    posts: DataFrame,
    seen: DataFrame,
    known_codes: DataFrame,
    walk_cache: DataFrame,
    walk_provider: "DataFrame | Callable[[DataFrame], DataFrame]",
    office: Destination | None,
    as_of: datetime,
    m2_min: float = 55.0,
    require_hashtag: str | None = None,
    facts_fn: Callable[[Column], Column] = enrich.post_facts,
    match: MatchConfig = MatchConfig(),
) -> ChannelOutputs:
    """Unseen posts, tag check, facts, filter, picture match with known listings, walking time.

    ``posts`` has the POST columns and ``code`` (fingerprint of the first picture, or null);
    ``known_codes`` has ``code``. Every unseen post is marked seen whatever its outcome.
    Posts are keyed by (channel, message): two channels may use the same number.
    """
    new = state.unseen_posts(posts, seen)
    tagged = F.lit(True) if not require_hashtag else text.has_hashtag(F.col("text"), require_hashtag)
    judged = cut(new.withColumn("facts", facts_fn(F.col("text"))).withColumn("tagged", tagged))
    f = F.col("facts")
    wanted = F.coalesce((f["pets_allowed"] == "yes") & (f["m2"] > m2_min), F.lit(False))
    open_posts = judged.filter("tagged").withColumn("wanted", wanted)
    fitting = open_posts.filter("wanted").drop("wanted")
    accepted = cut(similarity.post_dup_antijoin(fitting, known_codes, match).select(*fitting.columns))
    keys = ["channel", "message_id"]
    dups = fitting.join(accepted.select(*keys), keys, "left_anti")

    def outcome(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.lit(name).alias("outcome"))

    outcomes = (
        outcome(judged.filter("not tagged"), "untagged")
        .unionByName(outcome(open_posts.filter("not wanted"), "filtered"))
        .unionByName(outcome(dups, "deduped"))
        .unionByName(outcome(accepted, "pushed"))
    )
    outbox = accepted.select(
        *keys,
        f["m2"].alias("m2"),
        f["address"].alias("address"),
        F.concat(F.lit("https://t.me/"), F.col("channel"), F.lit("/"), F.col("message_id")).alias("permalink"),
        F.concat_ws(":", "channel", "message_id").alias("listing_key"),
        F.col("message_id").alias("seq"),
        F.lit(None).cast("double").alias("lat"),
        F.lit(None).cast("double").alias("lng"),
        F.array().cast("array<string>").alias("place_names"),
    )
    next_walks = walk_cache
    if office is not None:
        asked = outbox.filter("address is not null")
        walks, next_walks = distance.resolve_walk(
            asked, [office], walk_cache, walk_provider, as_of, WalkConfig()
        )
        outbox = outbox.join(walks.select("listing_key", "walk_min"), "listing_key", "left")
    else:
        outbox = outbox.withColumn("walk_min", F.lit(None).cast("int"))
    marked = seen.select(*keys).unionByName(judged.select(*keys)).distinct()
    return ChannelOutputs(
        outcomes,
        outbox.select(*keys, "m2", "address", "permalink", "walk_min"),
        metrics.channel_counts(outcomes),
        marked,
        next_walks,
    )
