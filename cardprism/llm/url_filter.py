"""URL filter: a trie over reversed host labels, then path segments.

A rule is ``(verdict, host, path)``.  It fits a URL if the URL's host is the
rule's host or below it, and the URL's path starts with the rule's path
(plain string prefix, so ``/en/1`` fits ``/en/17``).  Of the fitting rules the
longest decides: the longest host first, then the longest path; if one place
carries both verdicts, block wins.  Without a fitting rule the verdict is
``default``.

The trie is broadcast.  Its size is bounded by the rule list, which the driver
holds anyway; ``max_rules`` refuses larger lists instead of broadcasting them.

Defined results: a null URL, an empty one and one without ``://`` have empty
host and path and get the default; repeated rows are judged one by one; an
empty table gives an empty table.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    if not url:
        return "", ""
    _, found, rest = url.partition("://")
    if not found:
        return "", ""
    for mark in "#?":
        rest = rest.partition(mark)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


class _Paths:
    """Path segments below one host.  ``stems`` are rule ends: the rest of a
    rule's last segment, which the URL's segment need only start with."""

    __slots__ = ("children", "stems")

    def __init__(self):
        self.children: dict[str, _Paths] = {}
        self.stems: dict[str, tuple[str, str]] = {}

    def longest(self, segments: list[str]):
        found, node = None, self
        for s in segments:
            for n in sorted({len(k) for k in node.stems}, reverse=True):
                if (hit := node.stems.get(s[:n])) and n <= len(s):
                    found = hit
                    break
            node = node.children.get(s)
            if node is None:
                break
        return found


class RuleTrie:
    def __init__(self, rules):
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")):
                node = node.setdefault(label, {})
            at = node.setdefault(None, _Paths())
            *inner, stem = path.split("/")
            for s in inner:
                at = at.children.setdefault(s, _Paths())
            if at.stems.get(stem, ("",))[0] != "block":
                at.stems[stem] = (verdict, host.translate(_LOWER) + path)

    def judge(self, host: str, path: str):
        """(verdict, rule) of the longest fitting rule, or None."""
        found, node, segments = None, self.root, path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if None in node and (hit := node[None].longest(segments)):
                found = hit
        return found


def filter_urls(df: DataFrame, rules, default: str = "allow", url: str = "url", max_rules: int = 1_000_000) -> DataFrame:
    """``df`` with a struct column ``url_filter`` (host, path, rule, verdict)."""
    rules = list(rules)
    if len(rules) > max_rules:
        raise ValueError(f"{len(rules)} rules; at most {max_rules} are broadcast")
    trie = df.sparkSession.sparkContext.broadcast(RuleTrie(rules))

    @F.pandas_udf("host string, path string, rule string, verdict string")
    def judge(urls: pd.Series) -> pd.DataFrame:
        rows = []
        for u in urls:
            host, path = split_url(u)
            verdict, rule = trie.value.judge(host, path) or (default, None)
            rows.append((host, path, rule, verdict))
        return pd.DataFrame(rows, columns=["host", "path", "rule", "verdict"])

    return df.withColumn("url_filter", judge(F.col(url)))
