import numpy as np
import pandas as pd

from textlab.llm import common as C


def test_bit_filter_counts_slots_over_batches_and_partitions(spark):
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    keys = np.r_[keys, keys[:500], keys[:20]]
    bits = 20

    def mark(batches):
        for pdf in batches:
            yield C.slot_rows(C.slots_of(pdf["k"].to_numpy().view(np.uint64), bits))

    df = spark.createDataFrame(pd.DataFrame({"k": keys.view(np.int64)})).repartition(5)
    slots = df.mapInPandas(mark, "chunk int, low binary")
    n = np.bincount(C.slots_of(keys, bits), minlength=1 << bits)
    for least in (1, 2):
        bitmap = C.bit_filter(slots, bits, least)
        assert (np.unpackbits(bitmap) == (n >= least)).all()
    assert C.with_bit(bitmap, C.slots_of(keys[:500], bits)).all()
    assert not C.bit_filter(slots.limit(0), bits, 1).any()


def test_filter_size_follows_the_keys_up_to_a_bound():
    assert C.bits_for(0) == 16 and C.bits_for(1 << 20) == 23 and C.bits_for(1e15) == C.MOST_BITS


def test_runs_split_at_key_changes():
    a, b = pd.DataFrame({"k": [1, 1, 2], "v": [1, 2, 3]}), pd.DataFrame({"k": [2, 3], "v": [4, 5]})
    got = [(k, p["v"].tolist()) for k, p in C.runs(iter([a, a.iloc[:0], b]), ["k"])]
    assert got == [((1,), [1, 2]), ((2,), [3]), ((2,), [4]), ((3,), [5])]
