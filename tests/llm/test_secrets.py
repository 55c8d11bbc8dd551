import hashlib
import re

from hirelake.llm import secrets
from llm import made


def by_hand(text):
    text, out = text or "", []
    assign = r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out += [(m.start(), 0, m.end()) for m in re.finditer(assign, text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def row(base):
    joined = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base)
    return (*(sum(k == kind for _, k, _ in base) for kind in range(3)), hashlib.sha256(joined.encode()).hexdigest(), joined)


def test_base_spans_stay(documents, nothing):
    got = secrets.find_secrets(documents).collect()
    expected = sorted((str(d[0]), *row(by_hand(d[1]))[:4]) for d in made.documents())
    assert sorted((str(r.doc_id), *r[1:5]) for r in got) == expected
    for d in made.documents():
        joined = row(by_hand(d[1]))[4]
        assert any(r.doc_id == d[0] and set(joined.split(",")) <= {"", *r.spans.split(",")} for r in got)
    assert secrets.find_secrets(nothing).count() == 0


def test_field_finds_what_the_patterns_miss(spark):
    rows = [(i, f"some words before token = \"{hashlib.sha1(b'%d' % i).hexdigest()}\" and call 305555{i:04} or page {i + 123456} then") for i in range(150)]
    rows += [(1000 + i, f"the order {i * 7919 + 1000000} came on 2024-01-{i % 28 + 1:02} at 10.20.30.{i} again") for i in range(150)]
    field = secrets.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    base, more = secrets.scan("é the password is hunter2x9Zq81 for now", field)
    assert base == [] and more == [(18, 3, 18 + len("hunter2x9Zq81"))]
    assert secrets.scan("the order 7919001 came on 2024-01-05 at 10.20.30.4 again", field) == ([], [])


def test_viterbi_is_the_best_path():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    pairs = rng.normal(size=(3, 3))
    pairs[secrets.OUT, secrets.INSIDE] = secrets.NEVER
    field = secrets.Field(rng.normal(size=(secrets.FEATURES, 3)), pairs)
    for n in range(1, 6):
        x = rng.normal(size=(n, secrets.FEATURES))

        def score(tags):
            full = (0, *tags, 0)
            return (x @ field.weights)[range(n), list(tags)].sum() + sum(pairs[a, b] for a, b in zip(full, full[1:]))

        assert tuple(field.viterbi(x)) == max(itertools.product(range(3), repeat=n), key=score)
