from textlab.llm import bytecnn


def test_a_repeated_id_does_not_fill_the_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(bytecnn, "fit", lambda bags, y: seen.append((bags, list(y))))
    rows = [(1, "again and again")] * 500 + [(2, f"another text {i}") for i in range(500)] + [(i, f"text {i}") for i in range(3, 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 11)], "doc_id long, quality int")
    bytecnn.learn(docs, labels, rows=10)
    bags, y = seen[0]
    texts = [b"".join(b).decode() for b in bags]
    assert {f"text {i}" for i in range(3, 11)} < set(texts) and texts.count("again and again") == 1
    assert 1 <= sum(t.startswith("another") for t in texts) <= bytecnn.TRAIN_TEXTS and len(texts) == len(y) <= 20
