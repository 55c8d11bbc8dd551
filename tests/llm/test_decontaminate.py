import hashlib
import re

import pytest

from hirelake.llm import decontaminate
from llm import made


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def by_hand(text, items):
    own, hit, ids = words(text), set(), set()
    for item, body in items:
        theirs = words(body)
        n = min(13, len(theirs))
        windows = {tuple(theirs[i : i + n]) for i in range(len(theirs) - n + 1)} if n else set()
        for i in range(len(own) - n + 1):
            if tuple(own[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                ids.add(str(item))
    listed = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
    return len(own), len(hit), len(ids), listed, bool(hit) and 20 * len(hit) >= len(own)


@pytest.mark.parametrize("broadcast", [decontaminate.BROADCAST_GRAMS, 0])
def test_documents_against_all_windows(spark, documents, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_GRAMS", broadcast)
    benchmark = spark.createDataFrame([(*x, 1) for x in made.ITEMS], "item_id long, text string, words int")
    expected = sorted((str(d[0]), *by_hand(d[1], made.ITEMS)) for d in made.documents())
    got = decontaminate.contamination(documents, benchmark).collect()
    assert sorted((str(r.doc_id), *r[1:]) for r in got) == expected
    assert sum(r.contaminated for r in got) >= 4
    kept = decontaminate.drop_contaminated(documents, benchmark)
    assert kept.columns == documents.columns and kept.count() == sum(not r.contaminated for r in got)


def test_no_rows(spark, documents, nothing):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(documents, none).where("contaminated OR n_hit > 0").count() == 0
    assert decontaminate.contamination(nothing, none).count() == 0
