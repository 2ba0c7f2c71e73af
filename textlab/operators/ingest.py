"""Crawl ingestion.

The reference decodes every JSON line in one Python loop, keeps a hash map
of seen retweet ids and writes the first record per id.  Here the same is a
scan with a minimal read schema (nested pruning), a left-semi join on the
community id list, a prefix filter and one grouped aggregation whose
``min_by``/``count`` buffers combine map-side, so a retweet id that carries a
third of all rows still costs one row per task before the shuffle.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlab.functions.clean import is_retweet
from textlab.functions.dates import parse_twitter_time
from textlab.operators.joins import keep_members
from textlab.sources.posts import FACE_RESPONSE


def resolve_text(df: DataFrame) -> Column:
    """Full text of a post: for a retweet the original's extended text (or
    its text), otherwise the post's own extended text (or its text)."""
    rs = F.col("retweeted_status")
    own = F.coalesce(F.col("extended_tweet.full_text"), F.col("text"))
    orig = F.coalesce(rs["extended_tweet"]["full_text"], rs["text"])
    return F.when(is_retweet(F.col("text")) & rs.isNotNull(), orig).otherwise(own)


def flatten_tweet(df: DataFrame) -> DataFrame:
    """The nested record as flat named columns (ids stay strings)."""
    return df.select(
        F.col("id_str").alias("tweet_id"),
        F.col("created_at").alias("created_date"),
        resolve_text(df).alias("full_txt"),
        F.col("retweeted_status.id_str").alias("from_id"),
        F.col("user.id_str").alias("user_id"),
        F.col("user.screen_name").alias("screen_name"),
        is_retweet(F.col("text")).alias("is_retweet"),
    )


#: A time that does not parse sorts after every time that does (seconds).
NO_TIME = 10 ** 14


def rank_key(seconds: Column | None, record_id: Column) -> Column:
    """Order of records as one decimal(38): time, then numeric id.  Unparsed
    times come last, ids that are not numbers of at most 19 digits after the numbers."""
    t = F.coalesce(seconds, F.lit(NO_TIME)) if seconds is not None else F.lit(0)
    i = F.coalesce(record_id.try_cast("decimal(19,0)"), F.lit(Decimal(10 ** 19 - 1)))
    return (t.cast("decimal(15,0)") * F.lit(Decimal(10 ** 19)) + i).cast("decimal(38,0)")


def first_and_count(df: DataFrame, key: str, record_id: str, seconds: str | None = None,
                    count_name: str = "n") -> DataFrame:
    """A4: the first row per ``key`` by time and id, and the number of rows per key.

    The winner is found on one fixed-width column, in a hash aggregation that
    combines before the shuffle; only then is its row fetched, by a join that
    AQE can split.  Of rows that tie in time and id (the same record crawled
    twice) one stays, the smallest by its other columns.  Rows without a key
    are left out."""
    others = [c for c in df.columns if c != key]
    d = (df.where(F.col(key).isNotNull())
           .withColumn("__rank", rank_key(F.col(seconds) if seconds else None, F.col(record_id).cast("string"))))
    first = d.groupBy(key).agg(F.min("__rank").alias("__rank"), F.count(F.lit(1)).alias(count_name))
    rows = d.join(first, [key, "__rank"])
    one = rows.groupBy(key).agg(F.min(F.struct(*others)).alias("__first"), F.first(count_name).alias(count_name))
    return one.select(key, *[F.col(f"__first.{c}").alias(c) for c in others], count_name)


def unique_retweets(crawl: DataFrame, members: DataFrame, member_key: str = "account_id",
                    only_retweets: bool = True) -> DataFrame:
    """Crawl -> posts of community members -> retweets -> one row per original
    tweet (its first retweet by time, then id) with the number of retweets."""
    posts = keep_members(crawl, members, "user.id_str", member_key)
    if only_retweets:
        posts = posts.where(is_retweet(F.col("text")) & F.col("retweeted_status.id_str").isNotNull())
    flat = (flatten_tweet(posts).drop("is_retweet")
            .withColumn("__ts", F.unix_seconds(parse_twitter_time(F.col("created_date")).cast("timestamp"))))
    res = first_and_count(flat, "from_id", "tweet_id", "__ts", "n_retweets")
    return res.select("tweet_id", "created_date", "full_txt", "from_id", "user_id", "screen_name", "n_retweets")


def flatten_faces(df: DataFrame, json_col: str) -> DataFrame:
    """Parse the face-service response, keep rows with exactly one face,
    add its age and gender.  Malformed responses parse to null and drop out."""
    r = F.from_json(F.col(json_col), FACE_RESPONSE)
    first = F.get(F.col("__r.faces"), 0)["attributes"]
    return (df.withColumn("__r", r)
              .where(F.col("__r.face_num") == 1)
              .withColumn("age", first["age"]["value"])
              .withColumn("gender", first["gender"]["value"])
              .drop("__r"))
