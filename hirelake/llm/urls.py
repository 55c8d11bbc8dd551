"""URL filters held as a sorted array of 64-bit digests.

The rules' digests lie in one sorted file that every worker maps into memory,
so all workers of a machine share its pages.  A batch of URLs is probed by one
vectorised binary search, and each digest found is confirmed by the stored
rule, so two texts with one digest are told apart.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterable

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.llm.common import small_batches

#: Rules one digest file may hold: 8 bytes each in the file that is searched.
MAX_RULES = 50_000_000
#: What a url without a fitting rule gets.
UNLISTED = "allow"


def split_rule(rule: str) -> tuple[str, str]:
    """Host in lower case, and path, of a rule such as ``example.com/en/``."""
    host, slash, path = rule.partition("/")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?`` or ``#``; empty without one."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


class DigestRules:
    """Rules (text, verdict) written as sorted digests and sent to every executor.

    Spark's file service carries the files, so a new executor fetches them when
    it starts; their names hold their content, so a second build changes nothing.
    """

    def __init__(self, spark: SparkSession, rules: Iterable[tuple[str, str]]):
        table = {}
        for rule, verdict in rules:
            host, path = split_rule(rule)
            table[host + path] = f"{host}{path}\0{rule}\0{verdict}".encode()
            if len(table) > MAX_RULES:
                raise ValueError(f"more than {MAX_RULES} rules; split the list and apply each part")
        ordered = sorted((xxhash.xxh64_intdigest(k.encode()), k) for k in table)
        entries = [table[k] for _, k in ordered]
        self.rules = len(table)
        self.paths = tuple(sorted({len(split_rule(k)[1]) for k in table}))
        self.labels = max((split_rule(k)[0].count(".") + 1 for k in table), default=0)
        parts = {
            "digests": np.array([d for d, _ in ordered], np.uint64).tobytes(),
            "ends": np.cumsum([0, *(len(e) for e in entries)], dtype=np.int64).tobytes(),
            "entries": b"".join(entries),
        }
        content = hashlib.sha256(b"\n".join(entries)).hexdigest()[:24]
        self.names = tuple(f"{content}-{part}" for part in parts)
        folder = os.path.join(os.path.realpath(tempfile.gettempdir()), f"rules-{content}")
        os.makedirs(folder, exist_ok=True)
        for name, data in zip(self.names, parts.values() if table else ()):
            path = os.path.join(folder, name)
            if not os.path.exists(path):
                with tempfile.NamedTemporaryFile(dir=folder, delete=False) as file:
                    file.write(data)
                os.replace(file.name, path)
            spark.sparkContext.addFile(path)

    def candidates(self, host: str, path: str) -> list[str]:
        """Every text a fitting rule could have, longest first."""
        labels = host.split(".")
        hosts = [".".join(labels[i:]) for i in range(max(0, len(labels) - self.labels), len(labels))]
        texts = {h + path[:n] for h in hosts for n in self.paths if n <= len(path)}
        return sorted(texts, key=lambda t: (-len(t), t))

    def search(self, texts: list[str]) -> list[tuple[str, str] | None]:
        """Rule and verdict that each text stands for, if any."""
        found = [None] * len(texts)
        if not self.rules or not texts:
            return found
        digests, ends, entries = (
            np.memmap(SparkFiles.get(name), kind, "r")
            for name, kind in zip(self.names, (np.uint64, np.int64, np.uint8))
        )
        asked = np.array([xxhash.xxh64_intdigest(t.encode()) for t in texts], np.uint64)
        at = np.searchsorted(digests, asked)
        inside = np.flatnonzero(at < len(digests))
        for i in inside[digests[at[inside]] == asked[inside]]:
            place = at[i]
            while place < len(digests) and digests[place] == asked[i]:
                text, rule, verdict = entries[ends[place]:ends[place + 1]].tobytes().decode().split("\0")
                if text == texts[i]:
                    found[i] = (rule, verdict)
                    break
                place += 1
        return found

    def judge(self, hosts: Iterable[str], paths: Iterable[str]) -> list[tuple[str | None, str]]:
        """Rule and verdict of each url."""
        texts, rows, best = [], [], []
        for row, (host, path) in enumerate(zip(hosts, paths)):
            own = self.candidates(host, path)
            texts += own
            rows += [row] * len(own)
            best.append((None, UNLISTED))
        for row, found in reversed(list(zip(rows, self.search(texts)))):  # the first, so longest, is set last
            if found:
                best[row] = found
        return best


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str]], url: str = "url", keep: Iterable[str] = ("page_id",)) -> DataFrame:
    """Verdict of the longest rule that fits each url; ``allow`` where none does.

    A rule fits its host and every subdomain if the url's path begins with the
    rule's.  A null url, or one without ``://``, has an empty host and path.  A
    url on its own is judged alike in every row; an empty list allows all.
    Columns in ``keep`` come first; other columns aren't read.
    """
    small_batches(pages.sparkSession, 4096)
    table = DigestRules(pages.sparkSession, rules)

    @F.pandas_udf("rule string, verdict string")
    def judge(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(table.judge(host, path), columns=["rule", "verdict"]).astype(object)

    parts = pages.select(*keep, url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    judged = parts.withColumn("judged", judge("host", "path"))
    return judged.select(*parts.columns, "judged.rule", "judged.verdict")
