"""URL filter: a trie over reversed host labels and path segments.

Rules are (host, path, verdict). A rule fits its host and every subdomain when
the url's path starts with the rule's path. Among fitting rules the one with
the most host labels wins, then the longest path. The trie is broadcast; its
size is bounded by ``max_rules`` and checked when it is built.

Defined cases: a null url, or one without ``://``, has empty host and path; an
empty host fits no rule; a url without a path fits only rules with an empty
path; two equal rules with different verdicts are refused; no rule fitting
gives the default verdict. Repeated rows are judged one by one, extra columns
of the input are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from alertflow.llm.common import read_table

ALLOW, BLOCK = "allow", "block"

#: Rules of the registered query (fixed values): host, path, verdict.
QUERY_RULES = [
    ("net", "/", BLOCK),
    ("example.net", "/en/", ALLOW),
    ("example.com", "/de/", BLOCK),
    ("org", "/fr/", ALLOW),
]


def url_host(url: Column) -> Column:
    """Text after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; '' if there is none."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """Text after the host up to ``? #`` or the end; '' if there is none."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class RuleTrie:
    """Nested dicts: reversed host labels first, below each host node a trie of
    path segments. A rule path that ends inside a segment is kept at the node
    of its last whole segment as an open prefix."""

    def __init__(self, rules: Iterable[tuple[str, str, str]], max_rules: int = 200_000):
        self.root: dict = {"labels": {}, "paths": None}
        for n, (host, path, verdict) in enumerate(rules, 1):
            if n > max_rules:
                raise ValueError(f"more than {max_rules} rules: beyond the size that is broadcast")
            if verdict not in (ALLOW, BLOCK):
                raise ValueError(f"unknown verdict {verdict!r}")
            node = self.root
            for label in reversed(host.lower().split(".")):
                node = node["labels"].setdefault(label, {"labels": {}, "paths": None})
            if node["paths"] is None:
                node["paths"] = {"segments": {}, "open": {}}
            at = node["paths"]
            *whole, rest = path.split("/")
            for segment in whole:
                at = at["segments"].setdefault(segment, {"segments": {}, "open": {}})
            if at["open"].setdefault(rest, (host + path, verdict))[1] != verdict:
                raise ValueError(f"two verdicts for {host}{path}")

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest match, or None."""
        if not host:
            return None
        node, best = self.root, None
        for label in reversed(host.split(".")):
            node = node["labels"].get(label)
            if node is None:
                break
            if node["paths"] is not None:
                best = self._longest(node["paths"], path) or best
        return best

    @staticmethod
    def _longest(at: dict, path: str) -> tuple[str, str] | None:
        best, segments = None, path.split("/")
        for i, segment in enumerate(segments):
            fits = [p for p in at["open"] if segment.startswith(p)]
            if fits:
                best = at["open"][max(fits, key=len)]
            at = at["segments"].get(segment) if i < len(segments) - 1 else None
            if at is None:
                break
        return best


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = ALLOW,
                id_col: str = "page_id", url_col: str = "url", max_rules: int = 200_000) -> DataFrame:
    """One row per page: id, host, path, rule (null if none fits), verdict."""
    trie = pages.sparkSession.sparkContext.broadcast(RuleTrie(rules, max_rules))
    parts = pages.select(F.col(id_col).alias(id_col), url_host(F.col(url_col)).alias("host"),
                         url_path(F.col(url_col)).alias("path"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = trie.value.find
        for b in batches:
            found = [find(h, p) for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([f[0] if f else None for f in found], pa.string()),
                 pa.array([f[1] if f else default for f in found], pa.string())],
                names=[id_col, "host", "path", "rule", "verdict"])

    id_type = parts.schema[id_col].dataType.simpleString()
    return parts.mapInArrow(judge, f"`{id_col}` {id_type}, host string, path string, rule string, verdict string")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read_table(spark, sf_dir, "pages"), QUERY_RULES)


_PARTS = r"""
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages"""

ORACLE = f"""
WITH parts AS ({_PARTS}),
rules(rhost, rpath, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                                   ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
hits AS (
  SELECT page_id, rhost || rpath AS rule, v,
    row_number() OVER (PARTITION BY page_id ORDER BY len(string_split(rhost, '.')) DESC, length(rpath) DESC) AS k
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT p.page_id, p.host, p.path, h.rule, coalesce(h.v, 'allow') AS verdict
FROM parts p LEFT JOIN hits h ON p.page_id = h.page_id AND h.k = 1
"""
