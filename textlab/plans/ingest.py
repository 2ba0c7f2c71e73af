"""Ingest queries on the driver tables.

``documents`` stands in for the crawl (exact copies play retweets of one
original, keyed by the text hash), ``labels`` for the community id list,
``events.props`` for nested JSON and ``customer`` rows for face-service
responses, whose JSON text is built from the row on both engines.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlab.functions.clean import is_retweet, strip_normal
from textlab.operators import incremental as N
from textlab.operators import ingest as I
from textlab.operators.joins import keep_members
from textlab.plans import sql as Q
from textlab.session import table_path
from textlab.sources.posts import load_table

PREFIX = "The "


def q_json_flatten(spark, sf):
    ev = load_table(spark, sf, "events").select("event_id", "props")
    parsed = F.from_json("props", T.StructType([T.StructField("k", T.IntegerType())]))
    return ev.select("event_id", parsed["k"].alias("k"))


def q_prefix_filter(spark, sf):
    """Posts whose text starts with a prefix (the reference's is 'RT @')."""
    d = load_table(spark, sf, "documents").select("doc_id", "lang", "text")
    return d.where(is_retweet(F.col("text"), PREFIX)).select("doc_id", "lang")


def q_community_filter(spark, sf):
    """Posts of members of an id list (left-semi join)."""
    d = load_table(spark, sf, "documents").select("doc_id", "source")
    members = load_table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("account_id"))  # P14
    return keep_members(d, members, "doc_id", "account_id")


def q_resolve_text(spark, sf):
    """The full text of nested records made from documents: some are
    retweets, with or without the original and its extended text."""
    d = load_table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    n = F.col("doc_id")
    ext = lambda when, value: F.struct(F.when(when, value).alias("full_text"))
    rec = d.select(
        "doc_id", F.when(n % 3 == 0, F.concat(F.lit("RT @"), F.col("source"))).otherwise(F.col("text")).alias("text"),
        ext(n % 4 == 0, F.concat("text", F.lit("!"))).alias("extended_tweet"),
        F.when(n % 5 != 0, F.struct(F.col("lang").alias("text"), ext(n % 2 == 0, F.col("text")).alias("extended_tweet")))
        .alias("retweeted_status"))
    return rec.select("doc_id", I.resolve_text(rec).alias("full_txt"))


def q_unique_retweets(spark, sf):
    """A4: first copy (smallest id) of each distinct text and its copy count."""
    d = load_table(spark, sf, "documents").select(F.md5("text").alias("text_key"), "doc_id", "source")
    return I.first_and_count(d, "text_key", "doc_id", count_name="n_copies")


def q_unique_retweets_by_crawl(spark, sf):
    """A4 over crawls that arrive one after the other (stand-in: a document's crawl is its position among three
    days); the state is compacted after the second."""
    path = table_path(spark)
    d = load_table(spark, sf, "documents").select(F.md5("text").alias("text_key"), "doc_id", "source", F.coalesce(F.col("doc_id") % 3, F.lit(0)).alias("day"))
    for day in range(3):
        N.add_crawl(d.where(F.col("day") == day).drop("day"), path, f"day{day}", "text_key", "doc_id")
        if day == 1:
            N.compact(spark, path)
    return N.first_and_count_state(spark, path, "text_key", "n_copies")


def _face_json(c):
    """A face-service response per customer: 0, 1 or 2 faces; one segment gets
    a truncated (malformed) body."""
    faces = F.array(*[F.struct(F.struct(
        F.struct(((F.col("c_custkey") + i) % 60 + 15).cast("int").alias("value")).alias("age"),
        F.struct(F.when((F.col("c_custkey") + i) % 2 == 0, F.lit("Male")).otherwise(F.lit("Female"))
                 .alias("value")).alias("gender")).alias("attributes")) for i in (0, 1)])
    body = F.to_json(F.struct((F.col("c_nationkey") % 3).cast("int").alias("face_num"), faces.alias("faces")))
    return F.when(F.col("c_mktsegment") == "BUILDING", F.substring(body, 1, 20)).otherwise(body)


def q_face_flatten(spark, sf):
    c = load_table(spark, sf, "customer")
    resp = c.select(F.col("c_custkey").cast("string").alias("id"),
                    F.concat(F.lit("https://pbs.example/p/"), F.col("c_custkey").cast("string"),
                             F.lit("_normal.jpg")).alias("image_url"),
                    _face_json(c).alias("response"))
    out = I.flatten_faces(resp, "response")
    return out.select("id", strip_normal("image_url").alias("image_url"), "age", "gender")


def q_url_normalise(spark, sf):
    p = load_table(spark, sf, "pages").select("page_id", "url")
    return p.select("page_id", strip_normal(F.concat(F.regexp_replace("url", r"[?#].*$", ""),
                                                     F.lit("_normal.png"))).alias("image_url"))


_FACE_SQL = """
  SELECT CAST(c_custkey AS VARCHAR) AS id,
         'https://pbs.example/p/' || CAST(c_custkey AS VARCHAR) || '_normal.jpg' AS image_url,
         CASE WHEN c_mktsegment = 'BUILDING' THEN substring(body, 1, 20) ELSE body END AS response
  FROM (SELECT *, CAST(json_object('face_num', c_nationkey % 3, 'faces', json_array(
          json_object('attributes', json_object('age', json_object('value', (c_custkey + 0) % 60 + 15),
                                                 'gender', json_object('value', CASE WHEN (c_custkey + 0) % 2 = 0 THEN 'Male' ELSE 'Female' END))),
          json_object('attributes', json_object('age', json_object('value', (c_custkey + 1) % 60 + 15),
                                                 'gender', json_object('value', CASE WHEN (c_custkey + 1) % 2 = 0 THEN 'Male' ELSE 'Female' END)))
        )) AS VARCHAR) AS body FROM customer)"""

SQL = {
    "json_flatten": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events",
    "prefix_filter": f"SELECT doc_id, lang FROM documents WHERE starts_with(text, {Q.q(PREFIX)})",
    "community_filter": "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "resolve_text": """
      SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 5 <> 0 THEN CASE WHEN doc_id % 2 = 0 THEN text ELSE lang END
                          WHEN doc_id % 4 = 0 THEN text || '!'
                          WHEN doc_id % 3 = 0 THEN 'RT @' || source ELSE text END AS full_txt
      FROM documents""",
    "unique_retweets": """
      SELECT md5(text) AS text_key, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source,
             count(*) AS n_copies
      FROM documents GROUP BY md5(text)""",
    "face_flatten": f"""
      SELECT id, regexp_replace(image_url, {Q.q(r'_normal(\.[A-Za-z]+)?$')}, '\\1') AS image_url,
             CAST(json_extract_string(response, '$.faces[0].attributes.age.value') AS INTEGER) AS age,
             json_extract_string(response, '$.faces[0].attributes.gender.value') AS gender
      FROM ({_FACE_SQL})
      WHERE json_valid(response) AND CAST(json_extract_string(response, '$.face_num') AS INTEGER) = 1""",
    "url_normalise": f"""
      SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', '') || '_normal.png',
                                     {Q.q(r'_normal(\.[A-Za-z]+)?$')}, '\\1') AS image_url
      FROM pages""",
}

SQL["unique_retweets_by_crawl"] = SQL["unique_retweets"]

QUERIES = {
    "json_flatten": q_json_flatten,
    "prefix_filter": q_prefix_filter,
    "community_filter": q_community_filter,
    "resolve_text": q_resolve_text,
    "unique_retweets": q_unique_retweets,
    "unique_retweets_by_crawl": q_unique_retweets_by_crawl,
    "face_flatten": q_face_flatten,
    "url_normalise": q_url_normalise,
}
