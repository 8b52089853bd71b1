"""URL filters: a trie over reversed host labels, then path segments, with the longest rule winning.

A rule is (host, path, verdict). It fits its host and all subdomains, and every path that
starts with its own, character by character; its last segment may be a part of one. Of the
rules that fit, the one with the longest text (host and path together) decides, then the one
with the longer host, then block before allow. URLs that no rule fits get ``default``.

Rules that take up to ``BROADCAST_BYTES`` are broadcast as one trie. Beyond that, or where
asked for, the same is found by joins: a URL's host suffixes and path prefixes against the
rules' own, so a table of rules of any size is searched exactly.

Null urls and those without ``://`` have an empty host and path and fit no rule. Repeated rows
stay repeated. An empty table gives an empty table, an empty list of rules gives ``default``
everywhere. Columns of the input named host, path, rule or verdict are replaced by the result's.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of rule text up to which the trie is broadcast.
BROADCAST_BYTES = 16 << 20
ADDED = ("host", "path", "rule", "verdict")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str | Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: str | Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class _Segment:
    """A place in a path: whole segments that may follow, and the beginnings of a last one."""

    __slots__ = ("below", "tails", "lengths")

    def __init__(self):
        self.below: dict[str, _Segment] = {}
        self.tails: dict[str, tuple[str, str]] = {}
        self.lengths: list[int] = []


class Trie:
    """Rules by reversed host labels, then by path segments."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        for host, path, verdict in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            at = node.setdefault(None, _Segment())  # labels are texts, so None is free for the paths
            *whole, tail = path.split("/")
            for segment in whole:
                at = at.below.setdefault(segment, _Segment())
            if at.tails.get(tail, ("", ""))[1] != "block":
                at.tails[tail] = (host + path, verdict)
            at.lengths = sorted({*at.lengths, len(tail)}, reverse=True)

    @staticmethod
    def _in_paths(at: _Segment, parts: list[str]) -> tuple[str, str] | None:
        found = None
        for depth, part in enumerate(parts):
            found = next((at.tails[part[:n]] for n in at.lengths if len(part) >= n and part[:n] in at.tails), found)
            at = at.below.get(part) if depth + 1 < len(parts) else None
            if at is None:
                break
        return found

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits, or None."""
        best, node, parts = None, self.root, path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if None in node:
                found = self._in_paths(node[None], parts)
                if found and (best is None or len(found[0]) >= len(best[0])):
                    best = found
        return best


def _with_parts(pages: DataFrame, url: str) -> DataFrame:
    return pages.withColumns({"host": host_of(url), "path": path_of(url)}).drop("rule", "verdict")


def _by_trie(pages: DataFrame, rules: list[tuple[str, str, str]], default: str) -> DataFrame:
    trie = pages.sparkSession.sparkContext.broadcast(Trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def judged(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        match = trie.value.match
        return pd.DataFrame([match(h, p) or (None, default) for h, p in zip(host, path)], columns=["rule", "verdict"])

    kept = [c for c in pages.columns if c not in ADDED[2:]]
    return pages.select(F.struct(*kept).alias("row"), judged("host", "path").alias("judged")).select("row.*", "judged.*")


def _by_join(pages: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """Each different (host, path) meets rules at its host suffixes and those prefixes of its
    path that are as long as some rule's."""
    lengths = [r[0] for r in rules.select(F.length("path").alias("n")).distinct().orderBy("n").collect()]  # as many as the longest path has characters
    urls = pages.select("host", "path").distinct()
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path")), lambda n: F.substring("path", F.lit(1), n)) if lengths else F.array().cast("array<string>")
    keys = urls.select("host", "path", F.explode(suffixes).alias("__h"), prefixes.alias("__p")).select("host", "path", "__h", F.explode("__p").alias("__p"))
    known = rules.groupBy(F.col("host").alias("__h"), F.col("path").alias("__p")).agg(F.max("verdict").alias("verdict"))  # block before allow
    fits = keys.join(known, ["__h", "__p"]).withColumn("rule", F.concat("__h", "__p"))
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), F.length("__h"))).alias("__best"))
    found = pages.join(best, ["host", "path"], "left")
    return found.select(*pages.columns, F.col("__best.rule").alias("rule"), F.coalesce("__best.verdict", F.lit(default)).alias("verdict"))


def judge(pages: DataFrame, rules: DataFrame | list[tuple[str, str, str]], default: str = "allow", url: str = "url", joined: bool = False) -> DataFrame:
    """``pages`` with host, path, rule and verdict. ``rules`` is a table or list of (host, path,
    verdict), verdict allow or block; rules with a null or another verdict are an error."""
    if not isinstance(rules, DataFrame):
        rules = pages.sparkSession.createDataFrame(rules, "host string, path string, verdict string")
    rules = rules.select(F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict")
    sound = F.col("host").isNotNull() & F.col("path").isNotNull() & F.coalesce(F.col("verdict").isin("allow", "block"), F.lit(False))
    wrong, size = rules.agg(F.count_if(~sound), F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path")), F.lit(0))).first()
    if wrong:
        raise ValueError(f"{wrong} rules lack a host, a path, or the verdict allow or block")
    pages = _with_parts(pages, url)
    if joined or size > BROADCAST_BYTES:
        return _by_join(pages, rules, default)
    return _by_trie(pages, [tuple(r) for r in rules.collect()], default)


def keep_allowed(pages: DataFrame, rules: DataFrame | list[tuple[str, str, str]], default: str = "allow", url: str = "url") -> DataFrame:
    """The pages whose verdict is allow, with their own columns only."""
    judged = judge(pages.select(F.struct("*").alias("__row"), F.col(url).alias("__url")), rules, default, "__url")
    return judged.where("verdict = 'allow'").select("__row.*")
