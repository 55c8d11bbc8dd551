from hirelake.llm import simhash

SCHEMA = "doc_id long, text string, source string"


def prose(mark, n=60):
    return " ".join(f"{mark}{i}" for i in range(n))


def test_one_row_of_each_component(spark):
    rows = [(7, prose(chr(97 + k)), "same id, other text") for k in range(12)]
    rows += [(3, prose("p"), "first"), (9, prose("p"), "copy"), (9, prose("q"), "own"), (2, prose("q"), "smaller")]
    rows += [(None, prose("p"), "copy without an id"), (None, prose("z"), "b"), (None, prose("z"), "a"), (None, prose("y"), "c")]
    rows += [(50, prose("x"), "equal rows")] * 3 + [(None, prose("w"), "equal rows")] * 2
    kept = [tuple(r) for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()]
    texts = [r[1] for r in kept]
    assert sorted(texts) == sorted({r[1] for r in rows})
    assert set(kept) <= set(rows)
    ids = {r[1]: r[0] for r in kept}
    assert ids[prose("p")] == 3 and ids[prose("q")] == 2 and ids[prose("z")] is None
