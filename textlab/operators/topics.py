"""Topic tables on fixed or fitted topic labels.

Topic words come from token counts per topic (class-based TF-IDF), never
from concatenated documents.  Everything keyed by topic is aggregated before
it is joined, so joins only ever see ``#topics`` or ``#topics x #words`` rows.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlab.session import cut_lineage

def term_counts(df: DataFrame, topic: str, tokens: str) -> DataFrame:
    """(topic, word, tf): token counts per topic, without null tokens.  A task adds its tokens up
    before the shuffle, so what moves is a row for each word and topic that it holds."""
    return (df.select(topic, F.explode(F.array_compact(tokens)).alias("word"))
              .groupBy(F.col(topic), "word").agg(F.count(F.lit(1)).alias("tf")))


def ctfidf(df: DataFrame, topic: str, tokens: str, truncate_mean: bool = True,
           materialize: bool = True) -> DataFrame:
    """Class-based TF-IDF, ``tf(t,c) / sum tf(., c) * ln(1 + A / f(t))`` with
    f(t) the frequency of t over all classes and A the mean number of tokens
    per class (truncated to an integer, as the topic library does; pass
    ``truncate_mean=False`` for the exact mean).  Returns (topic, word, tf, weight)."""
    tf = term_counts(df, topic, tokens)
    if materialize:
        # The counts feed three branches (rows, class totals, word totals);
        # writing the small (topic, word, tf) table once keeps the documents
        # from being scanned and tokenized three times.
        tf = cut_lineage(tf)
    return ctfidf_from_counts(tf, topic, truncate_mean)


def ctfidf_from_counts(tf: DataFrame, topic: str, truncate_mean: bool = True) -> DataFrame:
    """B5 from a (topic, word, tf) table (used again after topics merge)."""
    totals = tf.groupBy(topic).agg(F.sum("tf").alias("class_total"))
    mean = F.avg("class_total").over(Window.partitionBy())
    totals = totals.withColumn("avg_tokens", F.floor(mean) if truncate_mean else mean)
    freq = tf.groupBy("word").agg(F.sum("tf").alias("word_total"))
    # Both sides are aggregates; AQE broadcasts them at run time when their
    # real size is small and keeps a shuffle join otherwise.
    j = tf.join(totals, topic).join(freq, "word")
    w = (F.col("tf") / F.col("class_total")) * F.log(1.0 + F.col("avg_tokens") / F.col("word_total"))
    return j.select(topic, "word", "tf", w.alias("weight"))


def model_term_counts(df: DataFrame, models: dict, tokens: str) -> DataFrame:
    """(model, topic, word, tf) of several topic models on the same documents in one
    pass: ``models`` is model -> topic column.  A document's bag of words is made once."""
    from textlab.operators.phrases import bag_of_words
    each = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("topic")) for m, c in models.items()])
    return (df.select(each.alias("ms"), bag_of_words(tokens).alias("bag")).select(F.explode("ms").alias("m"), "bag")
              .select("m.model", "m.topic", F.explode("bag").alias("b")).groupBy("model", "topic", F.col("b.token").alias("word")).agg(F.sum("b.n").alias("tf")))


def model_ctfidf(tf: DataFrame) -> DataFrame:
    """B5 for every model of a (model, topic, word, tf) table: each model has its own
    class totals, mean number of tokens and word totals.  (model, topic, word, tf, weight)."""
    totals = tf.groupBy("model", "topic").agg(F.sum("tf").alias("class_total"))
    totals = totals.withColumn("avg_tokens", F.floor(F.avg("class_total").over(Window.partitionBy("model"))))
    freq = tf.groupBy("model", "word").agg(F.sum("tf").alias("word_total"))
    w = (F.col("tf") / F.col("class_total")) * F.log(1.0 + F.col("avg_tokens") / F.col("word_total"))
    return tf.join(totals, ["model", "topic"]).join(freq, ["model", "word"]).select("model", "topic", "word", "tf", w.alias("weight"))


def top_words(weights: DataFrame, topic: str, n: int = 10) -> DataFrame:
    """The ``n`` heaviest words per topic (ties: word ascending) as
    (topic, rank, word, weight).  ``row_number() <= n`` is planned with a
    partial group limit before the shuffle, so only n rows per topic and task move."""
    w = Window.partitionBy(topic).orderBy(F.col("weight").desc(), F.col("word").asc())
    return (weights.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
                   .select(topic, F.col("rank").cast("int").alias("rank"), "word", "weight"))


def first_docs(df: DataFrame, topic: str, order: str, n: int = 3) -> DataFrame:
    """The first ``n`` documents of each topic in ``order``."""
    w = Window.partitionBy(topic).orderBy(F.col(order).asc())
    return (df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
              .select(topic, F.col("rank").cast("int").alias("rank"), order))


def _ordered_list(col: str, order: str) -> Column:
    """Collect a bounded group (at most n rows) in a fixed order."""
    return F.transform(F.sort_array(F.collect_list(F.struct(F.col(order), F.col(col)))), lambda s: s[col])


def topic_info(docs: DataFrame, topic: str, doc_id: str, text: str, words: DataFrame, name_words: int = 5,
               n_docs: int = 3) -> DataFrame:
    """(Topic, Count, Name, Representation, Representative_Docs); the name
    is ``{topic}_{w1}_..._{w5}`` (F16), the documents are the texts of the first
    ``n_docs`` by id.  The ids are ranked first; only theirs are fetched."""
    counts = docs.groupBy(topic).agg(F.count(F.lit(1)).alias("Count"))
    rep = words.groupBy(topic).agg(_ordered_list("word", "rank").alias("Representation"))
    firsts = (docs.select(doc_id, text).join(first_docs(docs.select(topic, doc_id), topic, doc_id, n_docs), doc_id)
              .groupBy(topic).agg(_ordered_list(text, "rank").alias("Representative_Docs")))
    name = F.concat_ws("_", F.col(topic).cast("string"), F.array_join(F.slice("Representation", 1, name_words), "_"))
    return (counts.join(rep, topic, "left").join(firsts, topic, "left")
                  .select(F.col(topic).alias("Topic"), "Count", name.alias("Name"),
                          "Representation", "Representative_Docs"))


#: Modulus and base of the hash of a joined text; products stay below 2**63.
HASH_MOD, HASH_BASE = 2_147_483_647, 1_000_003
#: Code points that are hashed together.
_STEP = 1 << 16


def _text_hash(text: str) -> int:
    """``sum(c_i * BASE**(n - 1 - i)) % MOD`` over the code points, in pieces of bounded size."""
    powers, out = _powers(), 0
    for at in range(0, len(text), _STEP):
        c = np.frombuffer(text[at:at + _STEP].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        out = (out * int(powers[len(c)]) + int(((c * powers[len(c) - 1::-1][:len(c)]) % HASH_MOD).sum())) % HASH_MOD
    return out


@functools.lru_cache(maxsize=1)
def _powers() -> np.ndarray:
    """BASE**0 .. BASE**_STEP modulo MOD."""
    out = np.ones(1, np.int64)
    while len(out) <= _STEP:
        out = np.concatenate([out, out * pow(HASH_BASE, len(out), HASH_MOD) % HASH_MOD])
    return out[:_STEP + 1]


def _power_mod(n: np.ndarray) -> np.ndarray:
    """BASE**n modulo MOD by repeated squaring."""
    left, out, square = n.astype(np.int64), np.ones(len(n), np.int64), HASH_BASE
    while left.any():
        out = np.where(left & 1, out * square % HASH_MOD, out)
        left, square = left >> 1, square * square % HASH_MOD
    return out


def concat_stats(df: DataFrame, topic: str, text: str, order: str, sep: str = " ", buckets: int = 1024) -> DataFrame:
    """A5/U4: size and hash of each topic's texts joined by ``sep`` in ascending ``order``
    (a number; ties by length, then hash): (topic, n_docs, n_chars, text_hash), without joining them.

    The hash is polynomial, so a text adds its own hash times the base to the power of the
    code points behind it.  Those are found in two steps: a window over the sums of the
    ranges of ``order`` between its quantiles, and one inside each range.  The terms are then
    added with map-side combining: a topic is never one string, one group or one window.
    Null texts count as empty, null orders come first."""
    t = F.coalesce(F.col(text), F.lit(""))
    cuts = df.agg(F.percentile_approx(order, [i / buckets for i in range(1, buckets)], 10 * buckets)).first()[0] or []
    bounds = np.unique(np.array(cuts, float))

    @F.pandas_udf("b int, n long, h long")
    def hashed(texts: pd.Series, orders: pd.Series) -> pd.DataFrame:
        o = pd.to_numeric(orders).to_numpy(float, na_value=-np.inf)
        return pd.DataFrame({"b": np.searchsorted(bounds, o, side="right").astype(np.int32), "n": [len(x) for x in texts],
                             "h": [_text_hash(x) for x in texts]})

    rows = cut_lineage(df.select(F.col(topic).alias("t"), F.col(order).alias("o"), hashed(t, F.col(order)).alias("s"))
                       .select("t", "o", "s.*"))  # numbers only
    gap = len(sep)
    behind = Window.unboundedPreceding, -1
    ranges = rows.groupBy("t", "b").agg(F.sum(F.col("n") + gap).alias("size"))
    after = ranges.select(F.col("t").alias("t2"), F.col("b").alias("b2"), F.coalesce(F.sum("size").over(
        Window.partitionBy("t").orderBy(F.desc("b")).rowsBetween(*behind)), F.lit(0)).alias("after"))
    own = F.coalesce(F.sum(F.col("n") + gap).over(
        Window.partitionBy("t", "b").orderBy(F.desc_nulls_last("o"), F.desc("n"), F.desc("h")).rowsBetween(*behind)), F.lit(0))
    placed = rows.withColumn("own", own).join(after, F.col("t").eqNullSafe(F.col("t2")) & (F.col("b") == F.col("b2")))
    at = F.col("own") + F.col("after")
    power = F.pandas_udf(lambda n: pd.Series(_power_mod(n.to_numpy())), "long")
    # the separator in front of a text; the first text has none
    sep_term = F.lit(_text_hash(sep)) * power(at + F.col("n")) % HASH_MOD
    g = placed.select("t", "n", (F.col("h") * power(at) % HASH_MOD).alias("x"), sep_term.alias("y"), (at + F.col("n")).alias("front")) \
        .groupBy("t").agg(F.count(F.lit(1)).alias("n_docs"), (F.sum("n") + (F.count(F.lit(1)) - 1) * gap).cast("bigint").alias("n_chars"),
                          F.sum("x").alias("x"), F.sum("y").alias("y"), F.max_by("y", "front").alias("first"))
    return g.select(F.col("t").alias(topic), "n_docs", "n_chars",
                    F.pmod(F.col("x") + F.col("y") - F.col("first"), F.lit(HASH_MOD)).cast("bigint").alias("text_hash"))


# ------------------------------------------------------------ embeddings side

def centroids(df: DataFrame, label: str, vec: str) -> DataFrame:
    """Per-label mean vector as (label, dim, value); one aggregation with a
    map-side combine, so a label holding a third of the rows is no hot spot."""
    return (df.select(label, F.posexplode(vec).alias("dim", "x"))
              .groupBy(label, "dim").agg(F.avg(F.col("x").cast("double")).alias("value")))


def collect_centroids(cent: DataFrame, label: str):
    """Topic matrix on the driver: #topics x #dimensions numbers, as large as the
    model itself and not growing with the documents."""
    rows = cent.groupBy(label).agg(F.sort_array(F.collect_list(F.struct("dim", "value"))).alias("v")).collect()
    labels = [r[0] for r in rows]
    mat = np.array([[x["value"] for x in r[1]] for r in rows], dtype=float)
    order = np.argsort(labels)
    return [labels[i] for i in order], mat[order]


def assign_topics(df: DataFrame, vec: str, labels, mat) -> DataFrame:
    """Nearest centroid by cosine (ties: smaller topic id) and, B6/F18,
    ``probabilities``, the softmax over the centroid similarities in the order of
    ``labels``, with its maximum ``probability``.  A vector without direction (null,
    zero) gets no topic, probability 0 and 0 for every topic.

    One matrix product per Arrow batch; the model is broadcast."""
    norm = np.linalg.norm(mat, axis=1)
    shared = df.sparkSession.sparkContext.broadcast((np.asarray(labels), mat / np.where(norm == 0, 1.0, norm)[:, None]))

    @F.pandas_udf("topic int, similarity double, probability double, probabilities array<double>")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        names, unit = shared.value
        v = np.array([x if x is not None else np.zeros(unit.shape[1]) for x in vectors], dtype=float).reshape(len(vectors), -1)
        n = np.sqrt((v * v).sum(axis=1))
        sim = (v @ unit.T) / np.where(n == 0, 1.0, n)[:, None]
        best = sim.argmax(axis=1)
        top = sim[np.arange(len(sim)), best]
        each = np.exp(sim - top[:, None])
        p = 1.0 / each.sum(axis=1)
        each = np.where((n == 0)[:, None], 0.0, each * p[:, None])
        out = pd.DataFrame({"topic": pd.array(names[best], dtype="Int32"), "similarity": top, "probability": p, "probabilities": list(each)})
        out.loc[n == 0, ["topic", "similarity"]] = None
        out.loc[n == 0, "probability"] = 0.0
        return out

    d = df.withColumn("__near", nearest(F.col(vec)))
    return d.select(*df.columns, "__near.*")


# ------------------------------------------------------------ topic x topic

#: Numbers of the words x topics piece that a task multiplies at once.
_PIECE = 1 << 21


def _topic_products(per_word: DataFrame, kind: str) -> DataFrame:
    """(a, b, dot), a <= b: the products of the topics' weights, summed over the words.  ``per_word`` has one
    array ``ts`` of (t, w) a word; a task adds its words up in one topics x topics matrix."""
    def work(batches):
        place, names, total, met = {}, [], np.zeros((0, 0)), np.zeros((0, 0), bool)
        for batch in batches:
            ts = batch.column(0)
            entries, word = pc.list_flatten(ts), pc.list_parent_indices(ts).to_numpy(zero_copy_only=False)
            if not len(entries):
                continue
            coded = pc.struct_field(entries, "t").dictionary_encode()
            for t in coded.dictionary.to_pylist():
                if t not in place:
                    place[t] = len(names)
                    names.append(t)
            topic = np.array([place[t] for t in coded.dictionary.to_pylist()])[coded.indices.to_numpy(zero_copy_only=False)]
            w = pc.struct_field(entries, "w").to_numpy(zero_copy_only=False)
            k = len(names)
            if k > len(total):
                pad = ((0, k - len(total)),) * 2
                total, met = np.pad(total, pad), np.pad(met, pad)
            step = max(1, _PIECE // k)
            for at in range(0, len(ts), step):
                some = slice(*np.searchsorted(word, [at, at + step]))
                m, has = np.zeros((2, min(step, len(ts) - at), k))
                m[word[some] - at, topic[some]], has[word[some] - at, topic[some]] = w[some], 1.0
                total += m.T @ m
                met |= has.T @ has > 0
        rows = [(names[i], names[j], float(total[i, j])) for i, j in zip(*np.nonzero(met)) if names[i] <= names[j]]
        yield pa.RecordBatch.from_pylist([dict(zip("abp", r)) for r in rows], schema=pa.schema([("a", arrow), ("b", arrow), ("p", pa.float64())]))

    from pyspark.sql.pandas.types import to_arrow_type
    arrow = to_arrow_type(per_word.schema["ts"].dataType.elementType["t"].dataType)
    return per_word.select("ts").mapInArrow(work, f"a {kind}, b {kind}, p double").groupBy("a", "b").agg(F.sum("p").alias("dot"))


def topic_cosine(weights: DataFrame, topic: str) -> DataFrame:
    """Cosine between topic word-weight vectors as (topic_a, topic_b,
    cosine, distance), a < b.  The topics of a word meet in an array, whose
    products a task adds up before a row for each pair is shuffled."""
    t = F.col(topic)
    per_word = (weights.where(t.isNotNull()).groupBy("word")
                .agg(F.collect_list(F.struct(t.alias("t"), F.col("weight").alias("w"))).alias("ts")))
    g = _topic_products(per_word, weights.schema[topic].dataType.simpleString())
    norms = g.where("a = b").select(F.col("a").alias("t"), F.sqrt("dot").alias("n"))
    # every pair, also those without a common word: each topic is numbered (one row a topic) and
    # asks for the numbers behind its own, so the pairs come from joins by number on many tasks
    numbered = cut_lineage(norms.withColumn("i", F.row_number().over(Window.orderBy("t"))))
    k = numbered.count()
    left = numbered.where(F.col("i") < k).select(F.col("t").alias("a"), F.col("n").alias("na"), F.explode(F.sequence(F.col("i") + 1, F.lit(k))).alias("i"))
    every = left.join(numbered.select("i", F.col("t").alias("b"), F.col("n").alias("nb")), "i")
    out = every.select("a", "b", (F.col("na") * F.col("nb")).alias("nn")).join(g, ["a", "b"], "left")
    cos = F.try_divide(F.coalesce("dot", F.lit(0.0)), F.col("nn"))
    return out.select(F.col("a").alias("topic_a"), F.col("b").alias("topic_b"), cos.alias("cosine"), (1.0 - cos).alias("distance"))


def mds_coordinates(dist: np.ndarray, dims: int = 2) -> np.ndarray:
    """Classical multidimensional scaling of a small k x k distance matrix
    (driver side; k is the number of topics)."""
    d2 = np.asarray(dist, dtype=float) ** 2
    k = d2.shape[0]
    j = np.eye(k) - np.ones((k, k)) / k
    b = -0.5 * j @ d2 @ j
    vals, vecs = np.linalg.eigh(b)
    idx = np.argsort(vals)[::-1][:dims]
    return vecs[:, idx] * np.sqrt(np.maximum(vals[idx], 0.0))


def jensen_shannon(p: np.ndarray) -> np.ndarray:
    """Distance matrix between the rows (topic-word distributions)."""
    p = np.asarray(p, dtype=float)
    m = 0.5 * (p[:, None] + p[None])

    def kl(x):
        return np.where(x > 0, x * np.log(np.where(x > 0, x, 1.0) / np.where(m > 0, m, 1.0)), 0.0).sum(axis=2)
    return np.sqrt(np.maximum(0.5 * kl(np.broadcast_to(p[:, None], m.shape)) + 0.5 * kl(np.broadcast_to(p[None], m.shape)), 0.0))


def term_relevance(weights: DataFrame, topic: str, corpus: DataFrame, lam: float = 0.6) -> DataFrame:
    """T8 relevant terms: ``lam * log p(w|t) + (1 - lam) * log(p(w|t) / p(w))``.

    ``weights`` is (topic, word, weight) with weights normalised per topic
    into p(w|t); ``corpus`` is (word, cf) corpus frequencies giving p(w).
    Both normalisations are aggregations; the join with p(w) is on the word."""
    tot = weights.groupBy(topic).agg(F.sum("weight").alias("__tw"))
    p_wt = weights.join(tot, topic).select(topic, "word", (F.col("weight") / F.col("__tw")).alias("p_wt"))
    total = corpus.agg(F.sum("cf")).collect()[0][0] or 1
    p_w = corpus.select("word", (F.col("cf") / F.lit(float(total))).alias("p_w"))
    j = p_wt.join(p_w, "word")
    rel = lam * F.log(F.col("p_wt")) + (1.0 - lam) * F.log(F.col("p_wt") / F.col("p_w"))
    return j.select(topic, "word", "p_wt", "p_w", rel.alias("relevance"))
