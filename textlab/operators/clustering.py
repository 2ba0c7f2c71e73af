"""Embedding-based topics (B1-B3, B7, B10), re-aimed to Spark ML.

The reference embeds posts with a sentence network, reduces with UMAP and
clusters with HDBSCAN on one machine.  Here: a given embedding column or
TF-IDF vectors, PCA, and KMeans with cosine distance, with outliers (-1) by
minimum similarity or minimum topic size.  Topic merging works on the
topic x word count table and the k x k similarity matrix only; documents are
relabelled once with a literal map.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, PCA, HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.functions.clean import map_literal
from textlab.operators import topics as TP
from textlab.session import cut_lineage

NUM_FEATURES = 1 << 18
#: Tasks of a KMeans step for each core, at most.
FIT_TASKS = 4


def reduce_dimensions(df: DataFrame, vec: str, k: int = 5, out: str = "reduced") -> DataFrame:
    """B2: PCA of an array or vector column to ``k`` components (array<double>)."""
    d = df.withColumn("__v", array_to_vector(F.col(vec)) if dict(df.dtypes)[vec].startswith("array") else F.col(vec))
    model = PCA(k=k, inputCol="__v", outputCol="__p").fit(d)
    return model.transform(d).withColumn(out, vector_to_array("__p")).drop("__v", "__p")


def tfidf_embedding(df: DataFrame, tokens: str, out: str = "features", num_features: int = NUM_FEATURES) -> DataFrame:
    """B1 re-aimed: L2-normalised TF-IDF vectors of the token arrays."""
    tf = HashingTF(inputCol=tokens, outputCol="__tf", numFeatures=num_features).transform(df)
    idf = IDF(inputCol="__tf", outputCol="__idf").fit(tf).transform(tf)
    return Normalizer(inputCol="__idf", outputCol=out, p=2.0).transform(idf).drop("__tf", "__idf")


def cluster_topics(df: DataFrame, features: str, k: int, seed: int = 42, min_topic_size: int = 10,
                   min_similarity: float | None = None, out: str = "topic", tokens: str | None = None) -> DataFrame:
    """KMeans with cosine distance; a document is an outlier (-1) when its
    cluster has fewer than ``min_topic_size`` members or, if given, its cosine
    similarity to the centre is below ``min_similarity``.

    Cosine distance is undefined for zero vectors: they are outliers.  With
    ``tokens`` (the array that sparse ``features`` were made from) a document
    without tokens is one; otherwise ``features`` is an array and is looked at.
    The cluster sizes are k numbers and are read on the driver."""
    array = dict(df.dtypes)[features].startswith("array")
    if not (array or tokens):
        raise ValueError("sparse features need the tokens they were made from")
    if min_similarity is not None and not array:
        raise ValueError("min_similarity needs features as an array")
    some = F.size(tokens) > 0 if tokens else F.exists(features, lambda x: x != 0)
    d = df.withColumn("__v", array_to_vector(F.col(features)) if array else F.col(features))
    fit_on = d.where(F.coalesce(some, F.lit(False)))
    # a task sends k dense centres in every step, so the number of tasks follows the cores, not the rows
    few = fit_on.coalesce(FIT_TASKS * df.sparkSession.sparkContext.defaultParallelism)
    model = KMeans(k=k, seed=seed, distanceMeasure="cosine", featuresCol="__v", predictionCol="__c").fit(few)
    pred = model.transform(fit_on).unionByName(d.where(~F.coalesce(some, F.lit(False))).withColumn("__c", F.lit(-1)))
    if min_similarity is not None:
        centres = np.array([c / (np.linalg.norm(c) or 1.0) for c in model.clusterCenters()])
        shared = df.sparkSession.sparkContext.broadcast(centres)  # the model, k x dimensions

        @F.pandas_udf("double")
        def similarity(vectors: pd.Series, cluster: pd.Series) -> pd.Series:
            unit, c = shared.value, cluster.to_numpy()
            v = np.array([x if i >= 0 else np.zeros(unit.shape[1]) for x, i in zip(vectors, c)], float).reshape(len(c), -1)
            n = np.sqrt((v * v).sum(axis=1))
            sim = np.einsum("ij,ij->i", v, unit[np.maximum(c, 0)]) / np.where(n == 0, 1.0, n)
            return pd.Series(np.where((n == 0) | (c < 0), np.nan, sim))

        s = similarity(F.col(features), F.col("__c"))
        far = ~F.coalesce(~F.isnan(s) & (s >= min_similarity), F.lit(False))
    else:
        far = F.lit(False)
    pred = pred.withColumn("__far", far)
    sizes = {r[0]: r[1] for r in pred.groupBy("__c").count().collect()}
    big = sorted(c for c, n in sizes.items() if c >= 0 and n >= min_topic_size)
    keep = F.col("__c").isin(big) & ~F.col("__far")
    return pred.withColumn(out, F.when(keep, F.col("__c")).otherwise(F.lit(-1)).cast("int")).drop("__v", "__c", "__far")


def topic_similarity(tf: DataFrame, topic: str) -> tuple[list, np.ndarray]:
    """Topics and their k x k c-TF-IDF cosine matrix."""
    w = TP.ctfidf_from_counts(tf, topic).select(topic, "word", "weight")
    cos = TP.topic_cosine(w, topic).collect()
    topics = sorted(r[0] for r in tf.select(topic).distinct().collect())
    idx = {t: i for i, t in enumerate(topics)}
    m = np.zeros((len(topics), len(topics)))
    for r in cos:
        i, j = idx[r["topic_a"]], idx[r["topic_b"]]
        m[i, j] = m[j, i] = r["cosine"] or 0.0
    return topics, m


def merge_path(topics: list, sizes: dict, sim: np.ndarray, targets) -> dict:
    """B7 on the k x k similarity matrix: the smallest topic (fewest documents;
    ties: larger id) joins its most similar one (ties: smaller id), whose
    similarities become the means weighted by documents, until ``n`` remain, for
    every ``n`` in ``targets``.  Returns ``{n: {old_topic: new_topic}}``."""
    wrong = [n for n in targets if not 1 <= n <= len(topics)]
    if wrong:
        raise ValueError(f"{len(topics)} topics cannot be reduced to {wrong}")
    sim, size = sim.copy(), {t: sizes[t] for t in topics}
    mapping, live, out = {t: t for t in topics}, list(topics), {}
    idx = {t: i for i, t in enumerate(topics)}
    while True:
        if len(live) in targets:
            out[len(live)] = dict(mapping)
        if len(live) <= min(targets):
            return out
        small = min(live, key=lambda t: (size[t], -t))
        into = max((t for t in live if t != small), key=lambda t: (sim[idx[small], idx[t]], -t))
        i, j = idx[small], idx[into]
        merged = (sim[j] * size[into] + sim[i] * size[small]) / (size[into] + size[small])
        sim[j, :], sim[:, j] = merged, merged
        size[into] += size.pop(small)
        live.remove(small)
        mapping = {old: (into if new == small else new) for old, new in mapping.items()}


def reduce_topics(docs: DataFrame, topic: str, tokens: str, targets, outlier: int = -1, counts: DataFrame | None = None) -> dict:
    """One pass over the documents (term counts and sizes), one similarity
    table, then :func:`merge_path` on the driver; c-TF-IDF of a merged table is
    computed by the caller, once per target.  The outlier topic stays itself.
    ``counts`` are the term counts without the outliers, if they are there already."""
    known = docs.where(F.col(topic) != outlier)
    topics, sim = topic_similarity(cut_lineage(TP.term_counts(known, topic, tokens)) if counts is None else counts, topic)
    sizes = {r[0]: r[1] for r in known.groupBy(topic).count().collect()}
    missing = sorted(set(sizes) - set(topics))  # topics whose documents have no token
    n = len(topics)
    full = np.zeros((n + len(missing),) * 2)
    full[:n, :n] = sim
    out = merge_path(topics + missing, sizes, full, list(targets))
    return {k: {**m, outlier: outlier} for k, m in out.items()}


def relabel(df: DataFrame, topic: str, mapping: dict, out: str | None = None) -> DataFrame:
    """Apply a topic mapping (a small literal map, no join)."""
    return df.withColumn(out or topic, F.try_element_at(map_literal(mapping), F.col(topic)))
