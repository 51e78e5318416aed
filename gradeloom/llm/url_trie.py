"""Allow and block lists for urls, held in a trie over reversed host labels and path segments.

Defined results: a null url or one without ``://`` has an empty host and path and gets the default
verdict; repeated rows are judged alike; an empty table gives no rows; other columns are ignored.
A rule without a path separator (``net``) fits every path, one with (``net/``) only paths that start with it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

MOST_RULES = 1_000_000


def _node() -> dict:
    return {"labels": {}, "segments": {}, "ends": {}}


def build_trie(rules: Iterable[tuple[str, str]]) -> dict:
    """Trie of (verdict, host + path) rules: host labels from the right, then path segments.

    The last piece of a rule's path need not be a whole segment; it is kept in ``ends`` of its node.
    """
    root = _node()
    for verdict, rule in rules:
        host, slash, path = rule.partition("/")
        node = root
        for label in reversed(host.lower().split(".")) if host else ():
            node = node["labels"].setdefault(label, _node())
        if not slash:
            node.setdefault("any", (len(rule), rule, verdict))
            continue
        *segments, last = path.split("/")
        for segment in segments:
            node = node["segments"].setdefault(segment, _node())
        node["ends"].setdefault(last, (len(rule), rule, verdict))
    return root


def _on_path(node: dict, path: str) -> Iterator[tuple[int, str, str]]:
    if "any" in node:
        yield node["any"]
    if not path.startswith("/"):
        return
    for segment in path[1:].split("/"):
        if node["ends"]:
            for size in range(len(segment) + 1):
                if segment[:size] in node["ends"]:
                    yield node["ends"][segment[:size]]
        node = node["segments"].get(segment)
        if node is None:
            return


def longest_match(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits, or None."""
    best, node = (-1, "", ""), trie
    for label in [*reversed(host.split(".")), None]:
        best = max([best, *_on_path(node, path)], key=lambda found: found[0])
        node = node["labels"].get(label)
        if node is None:
            break
    return best[1:] if best[0] >= 0 else None


def host_of(url: Column) -> Column:
    ascii_lower = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(ascii_lower, F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(
    pages: DataFrame,
    rules: list[tuple[str, str]],
    default: str = "allow",
    id_column: str = "page_id",
    url_column: str = "url",
) -> DataFrame:
    """One row per page: id, host, path, rule (null if none fits) and verdict.

    The trie is broadcast once; it holds at most ``MOST_RULES`` rules.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; split them by top-level label, at most {MOST_RULES} at once")
    trie = pages.sparkSession.sparkContext.broadcast(build_trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def judged(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        found = [longest_match(trie.value, h, p) or (None, default) for h, p in zip(hosts, paths)]
        return pd.DataFrame(found, columns=["rule", "verdict"])

    cut = pages.select(
        F.col(id_column), host_of(F.col(url_column)).alias("host"), path_of(F.col(url_column)).alias("path")
    )
    return cut.withColumn("_judged", judged("host", "path")).select(id_column, "host", "path", "_judged.rule", "_judged.verdict")
