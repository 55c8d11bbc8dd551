"""Exact repeated passages by run-length indexes of their surroundings.

Every string of ``length`` bytes has an anchor: its GRAM-byte piece with the
smallest hash, leftmost of equals.  Equal strings have equal anchors at equal
places.  The strings of one anchor start side by side and make up its
surroundings, so each string lies in the surroundings of one anchor only, and
only those of anchors that occur more than once can hold a repeat.
Surroundings that occur whole more than once are repeats as they stand.  The
distinct ones of an anchor meet in one bounded bucket.  Its
Burrows-Wheeler transform is kept as runs with the suffix positions at the run
ends; from these samples alone the longest match of every position with any
other is streamed over the text, and matches of ``length`` bytes are marked.

Passages of words go the same way at the same time, with the 64-bit hashes of
the words in place of bytes; the lowest bit of an anchor tells the two apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirelake.llm.common import carry, small_batches, text_key
from hirelake.session import materialize

LENGTH = 400
GRAM = 128
#: Words of the shortest passage, and of the piece that anchors it.
PASSAGE = 51
WORD_GRAM = 8
#: Bytes of a word's hash.
WORD = 8
#: Distinct surroundings of one anchor in one index; an anchor with more is dealt over several.
INDEX_ROWS = 2048
#: Of strings that meet across indexes, every so many share the digest of the bytes all have in common.
GRID = 16
#: Bytes of surroundings one bucket is meant to hold.
BUCKET_BYTES = 1 << 20
#: Bytes of texts whose anchors are looked for at once.
SCAN_BYTES = 1 << 17
_ODD = np.uint64(0x9E3779B97F4A7C15)
_KINDS = {1: np.uint8, WORD: np.uint64}
_IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of the ``gram`` bytes (a power of two) at each place, by doubling."""
    hashes = _mix(data.astype(np.uint64) + np.uint64(1))
    step = 1
    while step < gram:
        hashes = _mix(hashes[:-step] * _ODD + hashes[step:])
        step *= 2
    return hashes


def anchor_places(
    hashes: np.ndarray, width: int, ends: np.ndarray | None = None, short: int = 0
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the leftmost smallest hash of every ``width`` neighbouring ones.

    With each place the first and the last start of the windows it belongs to.
    Where several texts lie side by side, ``ends`` has their ends, and the last
    ``short`` hashes of a text are not its own; windows with other than a text's
    own hashes don't count.
    """
    least, span = hashes, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    ends = np.array([len(hashes)]) if ends is None else ends
    heads, tails = np.r_[0, ends[:-1]], ends - short - width
    inside = np.zeros(len(least) + 1, np.int64)
    inside[heads] += 1
    np.subtract.at(inside, tails + 1, 1)
    inside = np.cumsum(inside)[:-1] > 0
    fresh = np.ones(len(least), bool)
    fresh[1:] = (least[1:] != least[:-1]) | (hashes[: len(least) - 1] == least[:-1])
    fresh[heads] = True
    found, windows = [], np.lib.stride_tricks.sliding_window_view(hashes, width)
    starts = np.flatnonzero(fresh & inside)
    for at in range(0, len(starts), 4096):
        part = starts[at : at + 4096]
        found.append(part + windows[part].argmin(axis=1))
    places = np.concatenate(found)
    own = np.r_[True, places[1:] != places[:-1]]
    lows = starts[own]
    # A place's windows end before those of the next place, and with its text.
    last = tails[np.searchsorted(ends, lows, side="right")]
    return places[own], lows, np.minimum(np.r_[lows[1:] - 1, len(least) - 1], last)


def _signed(values) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _groups(sizes: np.ndarray, most: int) -> Iterator[range]:
    """Neighbouring rows of ``most`` bytes together, or one row that is larger."""
    at, held = 0, 0
    for row, size in enumerate(sizes.tolist()):
        if row > at and held + size > most:
            yield range(at, row)
            at, held = row, 0
        held += size
    if at < len(sizes):
        yield range(at, len(sizes))


def word_hashes(raw: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts of ``sizes`` bytes that make up ``raw``, and each text's number of words."""
    data = np.frombuffer(raw, np.uint8)
    ends = np.cumsum(sizes)
    letter = ~_IS_SPACE[data]
    fresh = letter.copy()
    fresh[1:] &= ~letter[:-1]
    heads = (ends - sizes)[sizes > 0]
    fresh[heads] = letter[heads]
    starts = np.flatnonzero(fresh)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(sizes), np.int64)
    # A word's bytes count with their place in it; white space behind it counts nothing.
    place = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.r_[starts, len(data)]))
    seen = _mix(((place.astype(np.uint64) << np.uint64(8)) + data[starts[0] :] + np.uint64(1)) * _ODD)
    seen[~letter[starts[0] :]] = 0
    return _mix(np.add.reduceat(seen, starts - starts[0])), np.diff(np.r_[0, np.searchsorted(starts, ends)])


def _anchors_of(keys: pa.Array, raw: bytes, sizes: np.ndarray, length: int, unit: int = 1) -> pa.RecordBatch:
    """Anchors of the texts of ``sizes`` bytes (or words), ``length`` at least, that make up ``raw``."""
    gram = GRAM if unit == 1 else WORD_GRAM
    hashes = gram_hashes(np.frombuffer(raw, _KINDS[unit]), gram)
    ends = np.cumsum(sizes)
    # A text's last hashes would read the next text, but the whole's last ones are not there.
    places, lows, highs = anchor_places(hashes, length - gram + 1, ends, gram - 1)
    view = memoryview(raw)
    around = [xxhash.xxh3_64_intdigest(view[a * unit : (b + length) * unit]) for a, b in zip(lows.tolist(), highs.tolist())]
    text = np.searchsorted(ends, places, side="right")
    anchor = (hashes[places] >> np.uint64(1) << np.uint64(1)) + np.uint64(unit > 1)
    return pa.RecordBatch.from_arrays(
        [keys.take(pa.array(text)), pa.array((places - (ends - sizes)[text]).astype(np.int32)),
         pa.array((lows - places).astype(np.int32)), pa.array((highs - places).astype(np.int32)),
         pa.array(anchor.view(np.int64)), _signed(around)],
        ["key", "place", "low", "high", "anchor", "around"],
    )


def _with_twins(found: pa.RecordBatch) -> pa.RecordBatch:
    """Rows numbered among those of one anchor, and whether there are others.

    Rows known to have others needn't meet in one task to be counted.
    """
    anchor = found.column("anchor").to_numpy()
    order = np.argsort(anchor, kind="stable")
    ordered = anchor[order]
    heads = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    sizes = np.diff(np.r_[heads, len(anchor)])
    twin, again = np.empty(len(anchor), np.int32), np.empty(len(anchor), bool)
    twin[order] = np.arange(len(anchor)) - np.repeat(heads, sizes)
    again[order] = np.repeat(sizes > 1, sizes)
    return found.append_column("twin", pa.array(twin)).append_column("again", pa.array(again))


def _short_key(text: str) -> Column:
    """128 bits of a text's key: every anchor carries it."""
    return F.substring(text_key(text), 1, 16)


def _least(length: int, words: int | None) -> int:
    """Bytes of the shortest text that can hold a string of ``length`` bytes or a passage of ``words``."""
    return min(length, 2 * words - 1) if words else length


def anchors(docs: DataFrame, text: str, length: int, words: int | None = None) -> DataFrame:
    """Every anchor of every row's text and the first and last start of its strings.

    The starts are counted from the anchor's place; twin and again number the
    rows of one anchor among texts looked at together.  With ``words`` also the
    anchors of passages of so many words, counted in words.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            # Texts are looked at side by side, a bounded number of bytes at a time or one larger text.
            for rows in _groups(sizes, SCAN_BYTES):
                keys, bodies = (batch.column(i).slice(rows.start, len(rows)) for i in range(2))
                size, bodies = sizes[rows.start : rows.stop], bodies.to_pylist()
                if (fit := size >= length).any():
                    raw = b"".join(b for b, long in zip(bodies, fit) if long)
                    yield _with_twins(_anchors_of(keys.filter(pa.array(fit)), raw, size[fit], length))
                if words is None:
                    continue
                hashes, counts = word_hashes(b"".join(bodies), size)
                if (fit := counts >= words).any():
                    raw = hashes[np.repeat(fit, counts)].tobytes()
                    yield _with_twins(_anchors_of(keys.filter(pa.array(fit)), raw, counts[fit], words, WORD))

    rows = docs.select(_short_key(text).alias("key"), F.col(text).cast("binary").alias("body"))
    return rows.where(F.length("body") >= _least(length, words)).mapInArrow(
        scan, "key binary, place int, low int, high int, anchor long, around long, twin int, again boolean"
    )


class RunLengthIndex:
    """Burrows-Wheeler transform of several strings of bytes or words, as runs with samples.

    A separator smaller than every symbol follows each string; matches end there.
    """

    def __init__(self, strings: list[bytes], depth: int, unit: int = 1):
        sizes = np.array([len(s) // unit for s in strings])
        symbols = np.frombuffer(b"".join(strings), _KINDS[unit])
        if unit > 1:
            symbols = np.unique(symbols, return_inverse=True)[1]
        ends = np.cumsum(sizes + 1)
        self.text = np.zeros(ends[-1], np.uint16 if unit == 1 else np.int32)
        inside = np.ones(len(self.text), bool)
        inside[ends - 1] = False
        self.text[inside] = symbols.astype(self.text.dtype) + 1
        self.starts = ends - sizes - 1
        self.rest = np.repeat(self.starts + sizes, sizes + 1) - np.arange(len(self.text))
        order = self._sort(depth)
        symbol = self.text[order - 1]
        # Separators count as different symbols, as matches don't go on across them.
        heads = np.flatnonzero(np.r_[True, (symbol[1:] != symbol[:-1]) | (symbol[1:] == 0)])
        ends = np.r_[heads[1:] - 1, len(order) - 1]
        #: One row for each run: its symbol, its length, and the suffixes at its ends.
        self.symbols, self.lengths = symbol[heads], ends - heads + 1
        self.first, self.last = order[heads], order[ends]
        self.before, self.after = order[heads - 1], order[(ends + 1) % len(order)]

    def _sort(self, depth: int) -> np.ndarray:
        """Suffixes in order of their first ``depth`` symbols at least, by doubling."""
        n = len(self.text)
        rank, span = self.text.astype(np.int64), 1
        padded = np.r_[rank, np.zeros(64, np.int64)]
        bits = int(rank.max()).bit_length()
        while 2 * span * bits < 64 and span < 64:
            padded[:n] = (padded[:n] << (bits * span)) | padded[span : n + span]
            span *= 2
        rank = padded[:n]
        while True:
            order = np.argsort(rank)
            ordered = rank[order]
            fresh = np.r_[0, np.cumsum(ordered[1:] != ordered[:-1])]
            rank = np.empty(n, np.int64)
            rank[order] = fresh
            if span >= depth or fresh[-1] == n - 1:
                return np.argsort(rank, kind="stable")
            follow = np.zeros(n, np.int64)
            follow[: n - span] = rank[span:] + 1 if span < n else 0
            rank = rank * (n + 1) + follow
            span *= 2

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal symbols from ``a`` and ``b`` on, up to a separator."""
        most = np.minimum(self.rest[a], self.rest[b])
        most[a == b] = 0
        size = np.zeros(len(a), np.int64)
        live = np.flatnonzero(most > 0)
        offsets = np.arange(32)
        last = len(self.text) - 1
        while live.size:
            x, y = a[live] + size[live], b[live] + size[live]
            same = self.text[np.minimum(x[:, None] + offsets, last)] == self.text[np.minimum(y[:, None] + offsets, last)]
            run = np.where(same.all(axis=1), 32, same.argmin(axis=1))
            size[live] = np.minimum(size[live] + run, most[live])
            live = live[(run == 32) & (size[live] < most[live])]
        return size

    def matching_statistics(self) -> np.ndarray:
        """Longest match of each position with any other one.

        Inside a run the match with the neighbour in suffix order is one shorter
        than at the position before, so the samples at run ends give them all.
        """
        n = len(self.text)
        best = np.zeros(n, np.int64)
        for own, other in ((self.first, self.before), (self.last, self.after)):
            reach = np.zeros(n, np.int64)
            np.maximum.at(reach, own, own + self.common(own, other))
            best = np.maximum(best, np.maximum.accumulate(reach) - np.arange(n))
        return np.minimum(best, self.rest)


def marked(strings: list[bytes], length: int, unit: int = 1) -> list[np.ndarray]:
    """For each string the starts of those ``length`` bytes (or words) that occur elsewhere too."""
    index = RunLengthIndex(strings, max(map(len, strings)) // unit + 1, unit)
    far = index.matching_statistics() >= length
    return [np.flatnonzero(far[s : s + len(t) // unit]) for s, t in zip(index.starts, strings)]


def _runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of neighbouring numbers."""
    cut = np.flatnonzero(np.diff(starts) > 1)
    return starts[np.r_[0, cut + 1]], starts[np.r_[cut, len(starts) - 1]]


def repeat_spans(
    docs: DataFrame, text: str = "text", length: int = LENGTH, index_rows: int = INDEX_ROWS, words: int | None = None
) -> DataFrame:
    """(key, found, passages) of the distinct texts with repeats: their marks in bytes and in words, by anchor."""
    small_batches(docs.sparkSession)
    # An anchor that occurs once holds no repeat; most do, and are not kept.
    times = F.count("*").over(Window.partitionBy("anchor", "twin"))
    found = anchors(docs, text, length, words).withColumn("times", times).where("times > 1 OR again")
    found = materialize(found.drop("times", "twin", "again"), "anchors")
    kinds = found.groupBy("anchor", "around", "low", "high").agg(
        F.count("*").alias("n"), F.min(F.struct("key", "place")).alias("one")
    )
    kinds = materialize(kinds.withColumn("rows", F.count("*").over(Window.partitionBy("anchor"))), "anchor-kinds")
    whole = kinds.where("n > 1").select("anchor", "around", "low", "high")
    dealt = F.ceil(F.col("rows") / index_rows).cast("int")
    chosen = kinds.where("rows > 1").select(
        "anchor", "around", "low", "high", "one.key", "one.place", dealt.alias("parts"), F.pmod("around", dealt).cast("int").alias("part")
    )
    buckets = max(1, chosen.count() * 2 * length // BUCKET_BYTES)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, wanted = batch.column(0), batch.column(1).to_pylist()
            for raw, rows in zip(body, wanted):
                data = raw.as_py()
                hashes = b""
                if any(r["anchor"] & 1 for r in rows):
                    hashes = word_hashes(data, np.array([len(data)]))[0].tobytes()
                ends = [(r["place"] + r["low"], r["place"] + r["high"]) for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [_signed([r["anchor"] & (1 << 64) - 1 for r in rows]), _signed([r["around"] & (1 << 64) - 1 for r in rows]),
                     pa.array([r["parts"] for r in rows], pa.int32()), pa.array([r["part"] for r in rows], pa.int32()),
                     pa.array([r["low"] for r in rows], pa.int32()),
                     pa.array([hashes[a * WORD : (b + words) * WORD] if r["anchor"] & 1 else data[a : b + length]
                               for r, (a, b) in zip(rows, ends)], pa.binary())],
                    ["anchor", "around", "parts", "part", "low", "body"],
                )

    wanted = chosen.groupBy("key").agg(F.collect_list(F.struct("anchor", "around", "place", "low", "high", "parts", "part")).alias("wanted"))
    once = (
        docs.where(F.octet_length(F.col(text)) >= _least(length, words))
        .select(_short_key(text).alias("key"), F.col(text).cast("binary").alias("body"))
        .join(wanted, "key").select("key", "body", "wanted").dropDuplicates(["key"])
    )
    pieces = once.select("body", "wanted").mapInArrow(
        cut, "anchor long, around long, parts int, part int, low int, body binary"
    )

    def index(rows: pd.DataFrame) -> pd.DataFrame:
        kinds = ((rows["anchor"] & 1 == 0, length, 1), (rows["anchor"] & 1 == 1, words, WORD))
        out = [m for own, most, unit in kinds if own.any() for m in marks_of(rows[own], most, unit)]
        marks = pd.DataFrame(out, columns=["anchor", "around", "low", "high", "core", "strings"])
        return marks.astype({"low": "Int32", "high": "Int32"})

    def marks_of(rows: pd.DataFrame, length: int, unit: int) -> list[tuple]:
        """Marks of one bucket, and of divided anchors the strings that other indexes may know.

        Those are the strings that this index met once, and one of each kind
        that it met more often, in groups of GRID neighbouring starts with the
        digest of what the whole group has in common.
        """
        out = []
        seen: set[bytes] = set()
        for row, starts in enumerate(marked(rows["body"].tolist(), length, unit)):
            anchor, around, low = (rows[n].iat[row] for n in ("anchor", "around", "low"))
            if len(starts):
                for a, b in zip(*_runs(starts)):
                    out.append((anchor, around, low + a, low + b, None, None))
            if rows["parts"].iat[row] == 1:
                continue
            body, own, last = rows["body"].iat[row], set(starts.tolist()), len(rows["body"].iat[row]) // unit - length
            # Groups are counted from the anchor, so equal strings fall into equal groups.
            for group in range(low // GRID, (low + last) // GRID + 1):
                strings = []
                for at in range(max(group * GRID, low), min(group * GRID + GRID - 1, low + last) + 1):
                    digest = hashlib.blake2b(body[(at - low) * unit : (at - low + length) * unit], digest_size=16).digest()
                    if at - low not in own or digest not in seen:
                        seen.add(digest)
                        strings.append({"at": at if at - low not in own else None, "digest": digest})
                # All strings of a group hold the bytes from its last start to its first end.
                core = body[max(0, group * GRID + GRID - 1 - low) * unit : (group * GRID + length - low) * unit]
                if strings:
                    out.append((anchor, around, None, None, hashlib.blake2b(core, digest_size=16).digest(), strings))
        return out

    bucket = F.pmod(F.xxhash64("anchor", "part"), F.lit(buckets))
    marks = materialize(
        pieces.groupBy(bucket.alias("bucket")).applyInPandas(
            index, "anchor long, around long, low int, high int, core binary, strings array<struct<at:int,digest:binary>>"
        ),
        "repeat-marks",
    )
    inside = marks.where("core IS NULL").select("anchor", "around", "low", "high").distinct()
    # Strings of a divided anchor that no index saw twice, but several indexes saw.
    apart = marks.where("core IS NOT NULL").select("anchor", "around", "core", "strings")
    common = apart.groupBy("core").agg(F.count("*").alias("n")).where("n > 1")
    strings = apart.join(common, "core", "left_semi").select("anchor", "around", F.explode("strings").alias("s"))
    shared = strings.groupBy("s.digest").agg(F.count("*").alias("n")).where("n > 1")
    across = strings.select("anchor", "around", "s.*").where("at IS NOT NULL").join(shared, "digest", "left_semi").select(
        "anchor", "around", F.col("at").alias("low"), F.col("at").alias("high")
    )
    spans = materialize(
        whole.union(inside).union(across).groupBy("anchor", "around").agg(F.collect_set(F.struct("low", "high")).alias("marks")),
        "repeat-spans",
    )
    placed = found.join(spans, ["anchor", "around"]).select("key", F.struct("place", "marks").alias("at"), F.col("anchor") % 2 == 0)
    placed = placed.toDF("key", "at", "bytes")
    return placed.groupBy("key").agg(
        F.collect_set(F.when(F.col("bytes"), F.col("at"))).alias("found"),
        F.collect_set(F.when(~F.col("bytes"), F.col("at"))).alias("passages"),
    )


def covered(found: list[tuple[int, list]], length: int) -> list[tuple[int, int]]:
    """Maximal spans of the bytes (or words) that the marks of one text cover."""
    spans = [(place + low, place + high + length) for place, marks in found for low, high in marks]
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def words_covered(found: pa.ListArray, words: int) -> np.ndarray:
    """For each row the number of words that the marks of its text cover."""
    places, marks = (found.flatten().field(n) for n in ("place", "marks"))
    row = np.repeat(np.arange(len(found)), pc.list_value_length(found).to_numpy(zero_copy_only=False))
    many = pc.list_value_length(marks).to_numpy(zero_copy_only=False)
    row, place = np.repeat(row, many), np.repeat(places.to_numpy(zero_copy_only=False).astype(np.int64), many)
    low, high = (marks.flatten().field(n).to_numpy(zero_copy_only=False) for n in ("low", "high"))
    # One number line holds all rows, each in a part of its own.
    start, end = (row << 32) + place + low, (row << 32) + place + high + words
    order = np.argsort(start)
    row, start, end = row[order], start[order], np.maximum.accumulate(end[order])
    fresh = end - np.maximum(start, np.r_[0, end[:-1]])
    return np.bincount(row, fresh, len(found)).astype(np.int64)


def _sorted_out(docs: DataFrame, text: str, length: int, index_rows: int, words: int | None = None) -> DataFrame:
    """(key, n_removed, n_spans, kept, spans, n_passage_words) of the distinct texts with repeats."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, body, found in zip(*(batch.column(i) for i in range(3))):
                raw = body.as_py()
                spans = covered([(f["place"], [(m["low"], m["high"]) for m in f["marks"]]) for f in found.as_py()], length)
                edges = [0, *(x for span in spans for x in span), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((key.as_py(), sum(b - a for a, b in spans), len(spans), kept, [list(s) for s in spans]))
            columns = list(zip(*out)) or [[]] * 5
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.list_(pa.int64())))
            passages = words_covered(batch.column(3), words or 0)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(list(c), k) for c, k in zip(columns, kinds)), pa.array(passages)],
                ["key", "n_removed", "n_spans", "kept", "spans", "n_passage_words"],
            )

    found = repeat_spans(docs, text, length, index_rows, words)
    once = (
        docs.where(F.octet_length(F.col(text)) >= _least(length, words))
        .select(_short_key(text).alias("key"), F.col(text).cast("binary").alias("body"))
        .join(found, "key").dropDuplicates(["key"])
    )
    return once.select("key", "body", "found", "passages").mapInArrow(
        cut, "key binary, n_removed long, n_spans long, kept binary, spans array<array<bigint>>, n_passage_words long"
    )


def repeated_bytes(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, index_rows: int = INDEX_ROWS, words: int | None = None
) -> DataFrame:
    """What removing repeats does to every row: bytes before, removed, spans, digest of the rest.

    A byte goes if a string of ``length`` bytes that covers it also starts
    anywhere else, in the same text or another; copies of a text, and repeated
    rows, count as other places.  A null text is empty; shorter texts stay
    whole.  No rows give no rows.  Only ``key`` and ``text`` are read.

    With ``words`` also n_passage_words: words (ASCII white space between them)
    in passages of so many words, 16 at least, that start anywhere else too.  They
    may be shorter than ``length`` and are not removed.
    """
    out = _sorted_out(docs, text, length, index_rows, words).select(
        "key", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passage_words"
    )
    rows = docs.select(
        F.col(key).alias("doc_id"), _short_key(text).alias("key"), text_key(text).alias("sha256"),
        F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"),
    )
    passages = [F.coalesce("n_passage_words", F.lit(0)).cast("long").alias("n_passage_words")] if words else []
    return rows.join(out, "key", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", F.lower(F.hex("sha256"))).alias("kept_sha256"), *passages,
    )


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """All rows and columns, texts without their repeated bytes.

    A character of which a byte went is dropped whole.
    """
    out = _sorted_out(docs, text, length, INDEX_ROWS).select(F.col("key").alias("_key"), F.col("kept").alias("_kept"))
    joined = docs.select(carry(docs), _short_key(text).alias("_key")).join(out, "_key", "left")
    rest = F.regexp_replace(F.make_valid_utf8(F.col("_kept").cast("string")), "\ufffd", "")
    body = F.when(F.col("_kept").isNotNull(), rest).otherwise(F.col("_row")[text])
    return joined.select(*((body if n == text else F.col("_row")[n]).alias(n) for n in docs.columns))
