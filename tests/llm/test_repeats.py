import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from hirelake.llm import repeats
from llm import made


def by_hand(texts, length):
    raws = [(t or "").encode() for t in texts]
    count = Counter(r[s : s + length] for r in raws for s in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for s in range(len(r) - length + 1):
            if count[r[s : s + length]] > 1:
                gone[s : s + length] = True
        kept = bytes(np.frombuffer(r, np.uint8)[~gone[:-1]])
        spans = int((gone[:-1] & ~np.r_[False, gone[:-2]]).sum()) if r else 0
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("index_rows", [repeats.INDEX_ROWS, 5])
def test_documents_against_all_windows(documents, index_rows):
    rows = made.documents()
    expected = sorted((str(d[0]), *x) for d, x in zip(rows, by_hand([d[1] for d in rows], 400)))
    got = repeats.repeated_bytes(documents, index_rows=index_rows).collect()
    assert sorted((str(r.doc_id), *r[1:]) for r in got) == expected


def test_index_marks_what_occurs_elsewhere():
    rng = np.random.default_rng(3)
    strings = [bytes(rng.integers(97, 99, int(n), dtype=np.uint8)) for n in rng.integers(1, 60, 40)] + [b"a" * 50, b"a" * 9]
    count = Counter(s[i : i + 7] for s in strings for i in range(len(s) - 6))
    for s, starts in zip(strings, repeats.marked(strings, 7)):
        assert starts.tolist() == [i for i in range(len(s) - 6) if count[s[i : i + 7]] > 1]


def test_texts_after_removal(spark):
    passage = "é" * 10 + "".join(chr(97 + i % 23) for i in range(600))
    docs = spark.createDataFrame([(1, "A" + passage, 0), (2, passage + "B", 0), (3, "short", 0), (4, None, 0)], "doc_id long, text string, kept int")
    out = {r.doc_id: r.text for r in repeats.remove_repeats(docs).collect()}
    assert out == {1: "A", 2: "B", 3: "short", 4: None}


def test_no_rows(nothing):
    assert repeats.repeated_bytes(nothing).count() == 0


def test_texts_side_by_side_have_the_anchors_they_have_alone():
    """The scan took each text by itself, however short."""
    rng = np.random.default_rng(4)
    sizes = [400, 400, 527, 900, 401, 3000, 40_000, 400]
    texts = [bytes(rng.integers(97, 97 + (2 if n % 2 else 9), n, np.uint8)) for n in sizes] + [b"x" * 700, b"x" * 700]
    keys = pa.array([b"%d" % n for n in range(len(texts))], pa.binary())
    together = repeats._anchors_of(keys, b"".join(texts), np.array([len(t) for t in texts]), 400).to_pylist()
    alone = [
        row for n, t in enumerate(texts) for row in repeats._anchors_of(keys.slice(n, 1), t, np.array([len(t)]), 400).to_pylist()
    ]
    assert together == alone
    starts = [sum(r["high"] - r["low"] + 1 for r in together if r["key"] == k.as_py()) for k in keys]
    assert starts == [len(t) - 399 for t in texts]
    assert [list(g) for g in repeats._groups(np.array([3, 4, 9, 1, 1]), 7)] == [[0, 1], [2], [3, 4]]


@pytest.mark.parametrize("index_rows", [repeats.INDEX_ROWS, 5])
def test_passages_of_words_against_all_windows(documents, index_rows):
    """Passages of over 50 words may have fewer than 400 bytes and were not told."""
    rows = made.documents()
    split = [(d[1] or "").encode().split() for d in rows]
    count = Counter(tuple(w[s : s + 51]) for w in split for s in range(len(w) - 50))
    expected = []
    for d, w in zip(rows, split):
        hit = {s + i for s in range(len(w) - 50) if count[tuple(w[s : s + 51])] > 1 for i in range(51)}
        expected.append((str(d[0]), len(hit)))
    got = repeats.repeated_bytes(documents, index_rows=index_rows, words=51).collect()
    assert sorted((str(r.doc_id), r.n_passage_words) for r in got) == sorted(expected)
    plain = repeats.repeated_bytes(documents).collect()
    assert sorted(map(str, (tuple(r[:5]) for r in got))) == sorted(map(str, map(tuple, plain)))


def test_short_passage_is_told_and_not_removed(spark):
    """A repeat of 51 short words, in other white space, left no trace in the result."""
    passage = [f"w{i}" for i in range(51)]
    texts = ["one two " + " ".join(passage), "\n\t".join(passage) + "\rthree", " ".join(passage[1:]), " ".join(passage[::-1]), None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = sorted(repeats.repeated_bytes(docs, words=repeats.PASSAGE).collect())
    assert [(r.n_removed, r.n_passage_words) for r in got] == [(0, 51), (0, 51), (0, 0), (0, 0), (0, 0)]


def test_words_side_by_side_have_the_hashes_they_have_alone():
    texts = [b"", b" ", b"ab a b", b"ab", b"\x0bab\x0c\x1cab ", "é é".encode(), b"ba", b"  "]
    hashes, counts = repeats.word_hashes(b"".join(texts), np.array([len(t) for t in texts]))
    assert counts.tolist() == [0, 0, 3, 1, 2, 1, 1, 0]
    words = [b"ab", b"a", b"b", b"ab", b"ab", b"\x1cab", "é\u00a0é".encode(), b"ba"]
    assert [words.index(w) for w in words] == [hashes.tolist().index(h) for h in hashes.tolist()]
    one = [repeats.word_hashes(t, np.array([len(t)]))[0] for t in texts]
    assert hashes.tolist() == np.concatenate(one).tolist()
    assert not len(repeats.word_hashes(b"", np.array([0, 0]))[0])


def test_rows_of_an_anchor_that_is_everywhere_are_not_counted_in_one_place():
    """All rows of one anchor met in one task to be counted."""
    anchor = [5, 7, 5, 5, 9, 7]
    got = repeats._with_twins(pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64())], ["anchor"])).to_pylist()
    assert [r["twin"] for r in got] == [0, 0, 1, 2, 0, 1]
    assert [r["again"] for r in got] == [True, True, True, True, False, True]
