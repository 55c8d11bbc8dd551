"""The corpus pipeline: each stage takes what its predecessor kept."""

from __future__ import annotations

from hirelake.llm import decontaminate, mixing, quality, sharding, simhash
from hirelake.llm.common import read
from hirelake.llm.queries import SHARDS
from hirelake.session import fresh_path


def quality_rules(spark, docs, sf_dir):
    """Drop documents that a quality rule rejects, and frequent lines of a host from the rest."""
    return quality.drop_low_quality(docs)


def near_duplicates(spark, docs, sf_dir):
    """Keep one document of each group whose fingerprints lie within four bits."""
    return simhash.drop_near_duplicates(docs)


def decontamination(spark, docs, sf_dir):
    """Drop documents that are contaminated with benchmark items."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mixture(spark, docs, sf_dir):
    """Thin out domains that hold more than their share of tokens."""
    return mixing.apply_mix(docs, read(spark, sf_dir, "labels"))


def shards(spark, docs, sf_dir):
    """Put the kept documents into shards by their id."""
    return sharding.assign_shards(docs, SHARDS)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("shards", shards),
]
#: The classifier and the hashes have no SQL form.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
