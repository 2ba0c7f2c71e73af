"""Scans and sinks.

All readers take an explicit schema: nothing is inferred, ids stay strings,
csv rows bind to columns by position (the reference reads some files by
column index) and multi-line quoted posts survive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"

LABELED_POSTS = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("sentiment", T.IntegerType()),
    T.StructField("vape_user", T.StringType()),
])

RAW_POSTS = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("posts", T.StringType()),
])

SCORED_POSTS = T.StructType(RAW_POSTS.fields + [T.StructField("sentiment_score", T.IntegerType())])

CLASSIFIED_POSTS = T.StructType(SCORED_POSTS.fields + [T.StructField("vape_user", T.StringType())])

PROFILE_IMAGES = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("image_url", T.StringType()),
])

MEMBERS = T.StructType([T.StructField("account_id", T.StringType())])

_TEXT_ONLY = T.StructType([T.StructField("full_text", T.StringType())])

CRAWL_RECORD = T.StructType([
    T.StructField("id_str", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("user", T.StructType([
        T.StructField("id_str", T.StringType()),
        T.StructField("screen_name", T.StringType()),
    ])),
    T.StructField("extended_tweet", _TEXT_ONLY),
    T.StructField("retweeted_status", T.StructType([
        T.StructField("id_str", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("extended_tweet", _TEXT_ONLY),
    ])),
])

FACE_RESPONSE = T.StructType([
    T.StructField("face_num", T.IntegerType()),
    T.StructField("faces", T.ArrayType(T.StructType([
        T.StructField("attributes", T.StructType([
            T.StructField("age", T.StructType([T.StructField("value", T.IntegerType())])),
            T.StructField("gender", T.StructType([T.StructField("value", T.StringType())])),
        ])),
    ]))),
])


def read_posts_csv(spark: SparkSession, path: str, schema: T.StructType,
                   keep_corrupt: bool = False, multi_line: bool = True) -> DataFrame:
    """Headed csv, columns bound by position to ``schema``.  Short rows
    give nulls, long rows drop the extra values; with ``keep_corrupt`` both
    kinds are also flagged in ``_corrupt_record``.  Posts hold line breaks, so
    quoted values may by default, which makes each file one task; for files
    without such values ``multi_line=False`` lets Spark split them."""
    if keep_corrupt:
        schema = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    reader = (spark.read.schema(schema)
              .option("header", True).option("enforceSchema", True)
              .option("multiLine", multi_line).option("escape", '"')
              .option("mode", "PERMISSIVE"))
    if keep_corrupt:
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
    return reader.csv(path)


def read_crawl(spark: SparkSession, path: str, schema: T.StructType = CRAWL_RECORD):
    """JSON-lines crawl with a minimal read schema.  Returns
    ``(good, bad)``: bad records (unparseable lines) are a side output instead
    of an exception per line."""
    full = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    df = (spark.read.schema(full)
          .option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", CORRUPT)
          .json(path))
    # Spark refuses queries whose scan needs only the corrupt column; the bad
    # side's filter also reads one parsed field (same rows: a malformed line
    # always has the corrupt text set), which keeps the scan lazy (no cache).
    first = schema.fields[0].name
    good = df.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    is_bad = F.col(CORRUPT).isNotNull() & F.coalesce(F.col(CORRUPT), F.col(first).cast("string")).isNotNull()
    bad = df.where(is_bad).select(CORRUPT)
    return good, bad


def observe_counts(df: DataFrame, name: str, accepted=None):
    """Rows seen / rows accepted, collected as a side effect of the job
    that consumes ``df`` (no extra pass).  Returns ``(df, observation)``."""
    obs = Observation(name)
    aggs = [F.count(F.lit(1)).alias("rows_seen")]
    if accepted is not None:
        aggs.append(F.count_if(accepted).alias("rows_accepted"))
    return df.observe(obs, *aggs), obs


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Result table with header (one part file per task)."""
    (df.write.mode(mode).option("header", True).option("escape", '"')
       .option("quoteAll", False).csv(path))


def append_rows(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append to an existing result (a second run appends again; see :func:`append_new`)."""
    df.write.mode("append").format(fmt).save(path)


def append_new(df: DataFrame, path: str, batch: str, key: str) -> bool:
    """S5, resumable: add the rows of a batch whose key is not in the table yet.

    The batch is written beside the table, in a folder that readers skip, and renamed to
    ``batch=<name>``: the rename commits it (where the file system renames folders in one
    step, as HDFS and local disks do).  A run stopped before leaves nothing that counts and
    is simply run again; a batch that is there is not written again (False).  Of rows of one
    key in the batch the smallest by its other columns stays; rows without a key all stay.
    One writer at a time.  Read the table with ``spark.read.parquet(path)``; it has the
    column ``batch``."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    table = hadoop(path)
    fs = table.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done, staged = hadoop(table, f"batch={batch}"), hadoop(table, f"_staged-{batch}")
    if fs.exists(done):
        return False
    others = [c for c in df.columns if c != key]
    named = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(F.lit(0).alias("__0"), *others)).alias("__row"))
    rows = named.select(key, *[F.col("__row")[c].alias(c) for c in others])
    if fs.exists(table) and any(f.getPath().getName().startswith("batch=") for f in fs.listStatus(table)):
        rows = rows.join(spark.read.parquet(path).select(key), key, "left_anti")
    rows = rows.unionByName(df.where(F.col(key).isNull()))
    rows.select(*df.columns).write.mode("overwrite").parquet(staged.toString())
    if not fs.rename(staged, done):
        raise RuntimeError(f"{done.toString()} could not be committed")
    return True


def write_by_key(df: DataFrame, key: str, path: str, fmt: str = "csv") -> None:
    """One output folder per key value, written by the executors in one
    job (never a driver loop over keys).  The rebalance hint gathers a key's rows
    into few files and lets AQE split a hot key over several tasks."""
    w = df.hint("rebalance", key).write.mode("overwrite").partitionBy(key)
    if fmt == "csv":
        w = w.option("header", True)
    w.format(fmt).save(path)


#: Rows of a table of texts that are not worth a shuffle.
FEW_TEXTS = 5000


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name == "documents" else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to as many tasks as a shuffle has.  A row group of a file is read by one task, and
    what is made of a text (tokens, pairs) is much larger than the text, so a few large row groups
    would hold up all cores but those that read them.  Small tables, and those in more splits, stay as they are."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if df.rdd.getNumPartitions() >= parts or df.count() <= FEW_TEXTS:
        return df
    return df.repartition(parts)
