import base64
import random

import regex

from hirelake.llm import tokens
from llm import made


def greedy(word, vocabulary):
    longest, at, count = max(map(len, vocabulary)), 0, 0
    while at < len(word):
        size = next((k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in vocabulary), 0)
        if not size:
            return 1
        at, count = at + size, count + 1
    return count


def test_random_vocabularies():
    rng = random.Random(4)
    for _ in range(30):
        vocabulary = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 25))}
        matcher = tokens.LongestMatch(vocabulary)
        for _ in range(300):
            word = bytes(rng.choice(b"abcd") for _ in range(rng.randint(0, 12)))
            assert matcher.count(word) == greedy(word, vocabulary), (word, vocabulary)


def test_documents(documents, nothing, tmp_path):
    vocabulary = {bytes([b]) for b in range(256)} | {b"ab", b"abc", b" a", "é".encode(), b" th", b"bra"}
    file = tmp_path / "vocabulary"
    file.write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate(sorted(vocabulary))))
    expected = []
    for d in made.documents():
        words = regex.findall(tokens.WORDS, d[1] or "")
        expected.append((str(d[0]), len(words), sum(greedy(w.encode(), vocabulary) for w in words)))
    got = tokens.token_counts(documents, f"file://{file}").collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(expected)
    assert tokens.token_counts(nothing, f"file://{file}").count() == 0
