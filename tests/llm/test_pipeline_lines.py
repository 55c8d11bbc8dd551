import corpus_pipeline


def test_boilerplate_of_a_large_host_goes(spark):
    """A line of 11 documents is cut, and one of 10 stays, whatever the host's size."""
    def own(i):
        return " ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(40))

    def text(i):
        return own(i) + ("\nsubscribe to our newsletter" if i < 11 else "\nread more here" if i < 21 else "")

    docs = spark.createDataFrame([(i, text(i), "h", 0) for i in range(200)], "doc_id long, text string, source string, n_chars int")
    got = {r.doc_id: r.text for r in corpus_pipeline.quality_rules(spark, docs, None).collect()}
    assert got == {i: own(i) if i < 11 else text(i) for i in range(200)}
