import random

from hirelake.llm import mixing


def test_labels_of_other_ids_and_repeated_ids_take_no_place(spark, monkeypatch):
    """A wide table of labels leaves the sample to documents; an id with many rows comes once."""
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(30)) + (" nastyword" if i % 2 else "")) for i in range(60)]
    rows += [(5, f"another text {k}") for k in range(300)]
    labels = [(i, 1, i % 2) for i in range(60)] + [(10_000 + i, 0, 0) for i in range(4000)]
    seen = []
    frame = type(spark.range(1))
    plain = frame.toPandas
    monkeypatch.setattr(frame, "toPandas", lambda self: seen.append(plain(self)) or seen[-1])
    mixing.fit_classifier(
        spark.createDataFrame(rows, "doc_id long, text string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), "doc_id", "text", 50,
    )
    assert len(seen[0]) == 50 and set(seen[0]["domain"]) == {2, 3}
