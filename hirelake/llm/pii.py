"""Personal data: fixed patterns, and spans that weak labelers agree on.

DataFrame functions only.  Loosely matched spans are candidates.  A pattern, a
checksum, gazetteers and the words around vote yes, no or not at all on each.
Votes are counted over all documents by their combination, and
expectation-maximisation on these counts gives every labeler's reliability
without any labels.  The posteriors then train a logistic span classifier on
the spans' features, again from counts of combinations; a few hundred rows at
most reach the driver, however many spans there are.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.llm.common import bind
from hirelake.session import materialize

KINDS = ("email", "ip", "card", "phone", "weak")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.|$)){4}$"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Candidates of the labelers: numbers of seven digits or more, and addresses written around filters.
NUMBER = r"(?<![A-Za-z0-9.])[+(]?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+(?![A-Za-z0-9])"
ADDRESS = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|[(\[]at[)\]])\x20?[A-Za-z0-9-]++"
    r"(?:\x20?(?:\.|[(\[]dot[)\]])\x20?[A-Za-z0-9-]++)++"
)
#: Fixed word lists of the gazetteer and context labelers.
DOMAINS = r"(?i)(?:com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu)$"
FORMATS = (
    r"^(?:\+?[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$|^[0-9]{3}-[0-9]{2}-[0-9]{4}$"
    r"|^[0-9]{4}(?:[ -]?[0-9]{4}){3}$|^\+[0-9][0-9 ().-]+$|@|(?i)[(\[]at[)\]]"
)
ISSUERS = r"^(?:4|5[1-5]|3[47]|6011|65)"
NAMED = r"(?i)(?:phone|tel|telephone|call|fax|mobile|cell|contact|mail|e-mail|card|visa|mastercard|ssn|social|iban|account)\W{0,4}(?:\w+\W{1,3}){0,2}$"
OTHERWISE = r"(?i)(?:version|isbn|issn|doi|order|invoice|page|item|chapter|seed|id|total|price|[#$%=_/\"'])\W{0,3}$"
BEFORE = 40
SURE = 0.9
ROUNDS, STEPS, RATE, DECAY = 50, 400, 0.5, 1e-4
VOTES = ("v_format", "v_check", "v_list", "v_named", "v_other")
TRAITS = ("t_digits", "t_plus", "t_bracket", "t_parted", "t_at")
_BLOCK = 256


def _running(values: Column, add) -> Column:
    """Running results of ``add`` from 0, in blocks so that long arrays aren't copied for each element."""

    def block(part: Column) -> Column:
        start = F.struct(F.lit(0).alias("now"), F.array().cast("array<int>").alias("all"))

        def step(state: Column, value: Column) -> Column:
            return bind(add(state["now"], value), lambda now: F.struct(
                now.alias("now"), F.concat(state["all"], F.array(now)).alias("all")))

        return F.aggregate(part, start, step, lambda state: state["all"])

    def joined(parts: Column) -> Column:
        done = F.transform(parts, block)
        return bind(done, lambda own: bind(
            block(F.transform(own, lambda p: F.element_at(p, -1))),
            lambda sums: F.flatten(F.transform(own, lambda p, i: F.transform(
                p, lambda v: F.when(i > 0, add(F.get(sums, i - 1), v)).otherwise(v)))),
        ))

    parts = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int")),
        lambda b: F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK)),
    )
    return F.when(F.size(values) > 0, bind(parts, joined)).otherwise(F.array().cast("array<int>"))


def located(text: Column, pattern: str) -> Column:
    """Matches of ``pattern`` as (start, end, hit, before), leftmost and apart, in code points.

    What lies between matches gives their places.
    """

    def place(found: Column) -> Column:
        gaps, hits = found["gaps"], found["hits"]
        steps = F.transform(
            hits, lambda h, i: F.length(F.get(gaps, i)) + F.coalesce(F.length(F.get(hits, i - 1)), F.lit(0))
        )
        return bind(_running(steps, lambda a, b: a + b), lambda starts: F.transform(hits, lambda h, i: F.struct(
            F.get(starts, i).alias("start"), (F.get(starts, i) + F.length(h)).alias("end"), h.alias("hit"),
            F.right(F.get(gaps, i), F.lit(BEFORE)).alias("before"),
        )))

    return bind(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits")), place)


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check; every second one from the right counts double."""
    backwards = F.reverse(digits)

    def value(i: Column) -> Column:
        one = F.substring(backwards, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, F.substring(F.lit("0246813579"), one + 1, F.lit(1)).cast("int")).otherwise(one)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + value(i)) % 10 == 0


def is_card(hit: Column) -> Column:
    return bind(digits_of(hit), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(F.lit(False)))


_SPAN = "array<struct<start:int,kind:int,end:int>>"
_CANDIDATE = ", ".join(f"{n}:int" for n in ("start", "end", *VOTES, *TRAITS))


def _base(text: Column) -> Column:
    """Spans (start, kind, end) of the fixed patterns, sorted."""
    digit = text.rlike("[0-9]")
    tests = (
        (text.contains("@"), EMAIL, lambda hit: F.lit(True)),
        (digit, IP, lambda hit: hit.rlike(OCTETS)),
        (digit, CARD, is_card),
        (text.contains("+"), PHONE, lambda hit: F.length(digits_of(hit)).between(9, 15)),
    )

    def spans(kind: int, pattern: str, good) -> Column:
        passing = F.filter(located(text, pattern), lambda m: good(m["hit"]))
        return F.transform(passing, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))

    found = [
        F.when(asked, spans(kind, pattern, good)).otherwise(F.array().cast(_SPAN))
        for kind, (asked, pattern, good) in enumerate(tests)
    ]
    return F.sort_array(F.concat(*found))


def _apart(candidates: Column, base: Column) -> Column:
    """Candidates of one pattern that touch no base span."""
    item = F.transform(candidates, lambda c: F.struct(c["start"].alias("start"), F.lit(1).alias("own"), c["end"].alias("end"), c.alias("c")))
    none = F.lit(None).cast("struct<start:int,end:int,hit:string,before:string>")
    other = F.transform(base, lambda b: F.struct(b["start"].alias("start"), F.lit(0).alias("own"), b["end"].alias("end"), none.alias("c")))

    def free(row: Column) -> Column:
        every, ends = row["every"], row["ends"]

        def alone(x: Column, i: Column) -> Column:
            after = F.get(every, i + 1)
            touches = (F.coalesce(F.get(ends, i - 1), F.lit(0)) > x["start"]) | (
                (after["own"] == 0) & (after["start"] < x["end"])
            )
            return (x["own"] == 1) & ~F.coalesce(touches, F.lit(False))

        return F.transform(F.filter(every, alone), lambda x: x["c"])

    return bind(F.sort_array(F.concat(item, other)), lambda every: bind(
        F.struct(every.alias("every"), _running(
            F.transform(every, lambda x: F.when(x["own"] == 0, x["end"]).otherwise(F.lit(0))), F.greatest).alias("ends")),
        free,
    ))


def _judged(m: Column) -> Column:
    """Places, votes (1 yes, 0 no, -1 none) and features of one candidate."""

    def of(d: Column) -> Column:
        hit, before, count = m["hit"], m["before"], F.length(d)
        address = hit.rlike(r"@|(?i)[(\[]at[)\]]")
        card = count.between(13, 19)
        votes = (
            F.when(hit.rlike(FORMATS), 1).otherwise(0),
            F.when(address, -1).when(card, F.when(luhn(F.left(d, F.lit(19))), 1).otherwise(0)).otherwise(-1),
            F.when(address, F.when(hit.rlike(DOMAINS), 1).otherwise(0)).when(card, F.when(d.rlike(ISSUERS), 1).otherwise(0)).otherwise(-1),
            F.when(before.rlike(NAMED), 1).otherwise(-1),
            F.when(before.rlike(OTHERWISE), 0).otherwise(-1),
        )
        traits = (
            F.when(count < 9, 0).when(count < 12, 1).when(count < 16, 2).when(count == 16, 3).otherwise(4),
            hit.startswith("+").cast("int"), hit.contains("(").cast("int"), hit.rlike(r"[0-9][ .-][0-9]").cast("int"), address.cast("int"),
        )
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), *(
            value.cast("int").alias(name) for name, value in zip((*VOTES, *TRAITS), (*votes, *traits))))

    return bind(digits_of(m["hit"]), of)


def _marks(base: Column, text: Column) -> Column:
    loose = (
        (text.rlike("[0-9]"), NUMBER),
        (text.contains("@") | text.rlike(r"(?i)[(\[]at[)\]]"), ADDRESS),
    )
    found = [
        F.when(asked, F.transform(_apart(located(text, pattern), base), _judged)).otherwise(F.array().cast(f"array<struct<{_CANDIDATE}>>"))
        for asked, pattern in loose
    ]
    return F.concat(*found)


def reliabilities(counts: list[tuple[tuple[int, ...], int]]) -> tuple[float, list[list[list[float]]]]:
    """Share of personal data, and P(vote | truth) of every labeler, by expectation-maximisation.

    Starts from the majority of each combination of votes; 1 is added to all counts.
    """
    share = 0.5
    guess = [(1 + sum(v == 1 for v in votes)) / (2 + sum(v >= 0 for v in votes)) for votes, _ in counts]
    tables: list[list[list[float]]] = []
    for _ in range(ROUNDS):
        total = sum(n for _, n in counts)
        yes = sum(p * n for p, (_, n) in zip(guess, counts))
        share = (1 + yes) / (2 + total)
        tables = []
        for k in range(len(VOTES)):
            table = [[1.0, 1.0, 1.0], [1.0, 1.0, 1.0]]
            for p, (votes, n) in zip(guess, counts):
                table[1][votes[k] + 1] += p * n
                table[0][votes[k] + 1] += (1 - p) * n
            tables.append([[c / sum(row) for c in row] for row in table])
        guess = [_posterior(votes, share, tables) for votes, _ in counts]
    return share, tables


def _posterior(votes: tuple[int, ...], share: float, tables: list) -> float:
    odds = math.log(share / (1 - share))
    # Saying nothing is no evidence.
    odds += sum(math.log(t[1][v + 1] / t[0][v + 1]) for t, v in zip(tables, votes) if v >= 0)
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, odds))))


def _levels() -> list[tuple[str, int]]:
    """One-hot features of the span classifier."""
    return [(n, v) for n in VOTES for v in (0, 1)] + [("t_digits", v) for v in range(5)] + [(n, 1) for n in TRAITS[1:]]


def classifier(rows: list[tuple[dict[str, int], int, float]]) -> tuple[float, dict[tuple[str, int], float]]:
    """Bias and weights of a logistic regression on (features, count, soft label)."""
    levels = _levels()
    weights, bias = dict.fromkeys(levels, 0.0), 0.0
    total = sum(n for _, n, _ in rows) or 1
    for _ in range(STEPS):
        slope, base = {k: -DECAY * w for k, w in weights.items()}, 0.0
        for features, n, label in rows:
            active = [k for k in levels if features[k[0]] == k[1]]
            score = bias + sum(weights[k] for k in active)
            gap = n / total * (label - 1 / (1 + math.exp(-max(-60.0, min(60.0, score)))))
            base += gap
            for k in active:
                slope[k] += gap
        bias += RATE * base
        for k in levels:
            weights[k] += RATE * slope[k]
    return bias, weights


def train(marks: DataFrame, column: str = "_marks") -> tuple[float, dict[tuple[str, int], float]]:
    """Classifier from the votes on all candidates of ``marks``; their combinations are few."""
    names = (*VOTES, *TRAITS)
    counted = marks.select(F.explode(column).alias("m")).groupBy(*(F.col(f"m.{n}").alias(n) for n in names)).count().collect()
    votes: dict[tuple[int, ...], int] = {}
    for row in counted:
        key = tuple(row[n] for n in VOTES)
        votes[key] = votes.get(key, 0) + row["count"]
    share, tables = reliabilities(sorted(votes.items()))
    return classifier([
        ({n: row[n] for n in names}, row["count"], _posterior(tuple(row[n] for n in VOTES), share, tables))
        for row in sorted(counted, key=lambda r: tuple(r[n] for n in names))
    ])


def find_personal(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Numbers of base spans, their digest, and all spans of every row's text.

    A null text is empty and has no span; repeated rows get equal rows; no rows
    give none.  Spans that the classifier adds touch no base span.  Without
    candidates, nothing is added.  Only ``key`` and ``text`` are read.
    """
    body = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    based = body.withColumn("_base", _base(F.col("_text")))
    rows = materialize(based.select("doc_id", "_base", _marks(F.col("_base"), F.col("_text")).alias("_marks")), "personal")
    bias, weights = train(rows)

    def sure(m: Column) -> Column:
        parts = [F.when(m[n] == v, F.lit(w)).otherwise(F.lit(0.0)) for (n, v), w in weights.items()]
        return reduce(lambda a, b: a + b, parts, F.lit(bias)) > math.log(SURE / (1 - SURE))

    weak = F.transform(
        F.filter("_marks", sure), lambda m: F.struct(m["start"].alias("start"), F.lit(len(KINDS) - 1).alias("kind"), m["end"].alias("end"))
    )
    names = F.array(*map(F.lit, KINDS))

    def number(kind: int) -> Column:
        return F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")

    return rows.select(
        "doc_id",
        *map(number, range(4)),
        F.sha2(joined(F.col("_base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.sort_array(F.concat("_base", weak))).alias("spans"),
    )
