"""Benchmark decontamination by a broadcast hash set of word n-grams.

DataFrame functions only.  A window of W words in a document always holds one
of the document's aligned blocks of (W + 1) // 2 words whole.  So a document is
scanned in blocks that don't overlap, each looked up in the set of all such
n-grams of the benchmark, and a hit is verified word by word along its diagonal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.llm.common import ascii_lower, carry, text_key
from hirelake.session import materialize

WINDOW = 13
#: Documents with at least one hit word in so many words are contaminated.
ONE_IN = 20
#: N-grams that are broadcast (8 bytes each); a larger set is joined by a shuffle.
BROADCAST_GRAMS = 2_000_000
_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_NO_LETTER = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def normal(text: Column) -> Column:
    """Words in lower case (A-Z), parted by one space; null has none."""
    return F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), _NO_WORD, " "))


def count_words(text: Column) -> Column:
    body = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), _NO_LETTER, " "))
    spaces = F.length(body) - F.length(F.replace(body, F.lit(" "), F.lit("")))
    return F.when(body == "", F.lit(0)).otherwise(spaces + 1).cast("long")


def benchmark_grams(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Items (item, id, words, window) and their grams (block, gram, item, offset)."""
    items = materialize(
        benchmark.select(F.col(key).cast("string").alias("id"), normal(F.col(text)).alias("body")).where("body <> ''").distinct()
        .select(F.xxhash64("id", "body").alias("item"), "id", F.split("body", " ").alias("words"))
        .withColumn("window", F.least(F.size("words"), F.lit(WINDOW))),
        "benchmark-items",
    )
    block = F.floor((F.col("window") + 1) / 2).cast("int")
    grams = items.select("item", "words", block.alias("block")).select(
        "item", "words", "block", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("block"))).alias("offset")
    ).select(
        "block", F.xxhash64(F.array_join(F.slice("words", F.col("offset") + 1, F.col("block")), " ")).alias("gram"), "item", "offset"
    )
    return items, materialize(grams, "benchmark-grams")


def find_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """(_key, n_hit, ids) of the distinct texts that hold a window of an item."""
    items, grams = benchmark_grams(benchmark)
    bodies = docs.select(text_key(text).alias("_key"), normal(F.col(text)).alias("_body"))
    found = None
    for (block,) in sorted(grams.select("block").distinct().collect()):  # at most (WINDOW + 1) // 2 values
        known = grams.where(F.col("block") == block).select("gram").distinct()
        if known.count() <= BROADCAST_GRAMS:
            known = F.broadcast(known)
        cut = F.regexp_extract_all(F.concat("_body", F.lit(" ")), F.lit(r"\G(?:[^ ]++ ){%d}" % block), F.lit(0))
        blocks = bodies.select("_key", "_body", F.posexplode(cut).alias("at", "words"))
        hit = F.struct(F.lit(block).alias("block"), (F.col("at") * block).alias("at"), "gram")
        hits = blocks.withColumn("gram", F.xxhash64(F.rtrim("words"))).join(known, "gram", "left_semi").select("_key", "_body", hit.alias("hit"))
        found = hits if found is None else found.union(hits)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "_key binary, _body string, hit struct<block:int,at:int,gram:long>")
    # Texts with a hit go on with it, so no other text is ever moved.
    texts = materialize(
        found.groupBy("_key").agg(F.first("_body").alias("_body"), F.collect_set("hit").alias("hits")), "benchmark-hits"
    )
    lines = texts.select("_key", F.explode("hits").alias("hit")).select("_key", "hit.*").join(grams, ["block", "gram"])
    candidates = lines.select("_key", "item", (F.col("at") - F.col("offset")).alias("shift")).distinct()
    pairs = (
        candidates.join(texts.select("_key", F.split("_body", " ").alias("_words")), "_key")
        .join(items, "item")
        .withColumn("low", F.greatest(F.lit(0), -F.col("shift")))
        .withColumn("high", F.least(F.size("words"), F.size("_words") - F.col("shift")))
        .where(F.col("high") - F.col("low") >= F.col("window"))
        .withColumn("same", F.transform(
            F.sequence(F.col("low"), F.col("high") - 1), lambda q: F.get("words", q) == F.get("_words", q + F.col("shift"))
        ))
    )
    first = F.filter(
        F.sequence(F.lit(0), F.size("same") - F.col("window")),
        lambda s: F.forall(F.sequence(F.lit(0), F.col("window") - 1), lambda k: F.get("same", s + k)),
    )
    hits = pairs.withColumn("starts", first).where(F.size("starts") > 0).select(
        "_key", "id", F.array_distinct(F.flatten(F.transform(
            "starts", lambda s: F.transform(
                F.sequence(F.lit(0), F.col("window") - 1), lambda k: s + k + F.col("low") + F.col("shift"))
        ))).alias("places"),
    )
    return hits.groupBy("_key").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("long").alias("n_hit"),
        F.sort_array(F.collect_set("id")).alias("ids"),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Words, hit words, items and verdict of every row.

    Equal texts are judged once.  A null text, or one without words, has no
    hits; items without words are no windows; an item that is repeated counts
    once, and one without an id hits words but isn't listed.  An empty
    benchmark hits nothing; no documents give no rows.  Other columns of either
    table aren't read.
    """
    rows = docs.select(F.col(key).alias("doc_id"), text_key(text).alias("_key"), count_words(F.col(text)).alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return rows.join(find_hits(docs, benchmark, text), "_key", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (ONE_IN * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """Rows that aren't contaminated, in all their columns."""
    texts = docs.select(text_key(text).alias("_key"), count_words(F.col(text)).alias("n_words"))
    bad = find_hits(docs, benchmark, text).join(texts, "_key").where(ONE_IN * F.col("n_hit") >= F.col("n_words"))
    rows = docs.select(carry(docs), text_key(text).alias("_key"))
    return rows.join(bad.select("_key").distinct(), "_key", "left_anti").select("_row.*")
