import hashlib
import random
import re

from hirelake.llm import pii
from llm import made


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (2 * int(c) > 9) for i, c in enumerate(reversed(digits))) % 10 == 0


def by_hand(text):
    text, out = text or "", []
    digits = lambda s: re.sub(r"\D", "", s)
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text) if "@" in text else ():
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0])):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(digits(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def row(base):
    joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
    return (*(sum(k == kind for _, k, _ in base) for kind in range(4)), hashlib.sha256(joined.encode()).hexdigest())


def test_base_spans(spark, documents, nothing):
    rng = random.Random(1)
    letters = "0123456789" * 3 + "..@@+- ()ab_é\U0001f600x,"
    rows = [(5000 + i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 120)))) for i in range(400)]
    rows += [(d[0], d[1]) for d in made.documents()]
    more = spark.createDataFrame(rows[:400], "doc_id long, text string").union(documents.select("doc_id", "text"))
    got = pii.find_personal(more).collect()
    assert sorted((str(r.doc_id), *r[1:6]) for r in got) == sorted((str(i), *row(by_hand(t))) for i, t in rows)
    texts = {i: t for i, t in rows if i is not None and i >= 5000}
    for r in got:
        if r.doc_id in texts:
            spans = [s.split(":") for s in r.spans.split(",") if s]
            base = [s for s in spans if s[0] != "weak"]
            assert len(base) == len(by_hand(texts[r.doc_id]))
            for _, a, b in (s for s in spans if s[0] == "weak"):
                assert all(int(b) <= int(x) or int(y) <= int(a) for _, x, y in base)
    assert pii.find_personal(nothing).count() == 0


def test_labelers_agree_on_new_forms(spark):
    rows = [(i, f"please call 305-555-{i:04} today") for i in range(120)] + [(500 + i, f"order {i * 9999 + 10000000} is here") for i in range(120)]
    got = {r.doc_id: r.spans for r in pii.find_personal(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == "weak:12:24" for i in range(120))
    assert all(got[500 + i] == "" for i in range(120))


def test_reliabilities_are_recovered():
    rng = random.Random(3)
    good = (0.9, 0.8, 0.7, 0.85, 0.6)
    counts = {}
    for _ in range(20_000):
        truth = rng.random() < 0.4
        votes = tuple(int(truth if rng.random() < g else not truth) for g in good)
        counts[votes] = counts.get(votes, 0) + 1
    share, tables = pii.reliabilities(sorted(counts.items()))
    assert abs(share - 0.4) < 0.05
    assert all(abs(t[1][2] - g) < 0.05 and abs(t[0][1] - g) < 0.05 for t, g in zip(tables, good))
