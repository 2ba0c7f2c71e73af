"""Per-post scoring on a stream.

The reference reads its post files line by line and writes a scored row per
post.  Every per-row operator here is a plain column expression, so the same
plan runs on a streaming DataFrame: new post files are picked up
incrementally, scored on the executors, and written by the file sink, whose
checkpoint makes the output exactly-once across restarts and lost executors.
No state is kept (no aggregation), so no watermark is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from textlab.functions.clean import clean_post, collapse_ws, tokenize
from textlab.functions.slang import expand_slang
from textlab.operators.lexicon import lexicon_compound, lexicon_polarity, score_to_class

POSTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def scored(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores of one post (batch or stream): cleaned model input, polarity
    after slang expansion, compound score, class."""
    pol = lexicon_polarity(tokenize(expand_slang(F.col(text), "substring")))
    return df.select(
        id_col,
        clean_post(text).alias("post"),
        pol.alias("polarity"),
        lexicon_compound(collapse_ws(text)).alias("compound"),
        score_to_class(pol).alias("sentiment_score"),
    )


def read_posts_stream(spark: SparkSession, path: str, schema: T.StructType = POSTS, fmt: str = "parquet",
                      max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def start_scoring(spark: SparkSession, source: str, sink: str, checkpoint: str,
                  schema: T.StructType = POSTS, fmt: str = "parquet", available_now: bool = True) -> StreamingQuery:
    """Score every new post file under ``source`` into parquet under ``sink``."""
    out = scored(read_posts_stream(spark, source, schema, fmt))
    w = out.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start(sink)
