"""URL filter: a trie over reversed host labels and path segments with longest-match precedence.

Hosts are what stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower
case; paths go on up to ``?``, ``#`` or the end.  A null url or one without ``://`` has an empty
host and path and gets the default verdict.  A rule fits its host and all subdomains if the path
starts with the rule's; the rule with most characters wins, then the one with the longer host,
then ``block``.  Repeated rules count once; extra columns stay, and columns of the input named
like a result are replaced.  Urls may be of any length, repeated rows are judged alike, an empty table gives no rows, and without rules
every url gets the default verdict.

The trie is broadcast only up to ``max_trie_rules`` rules, some 200 MB.  Above that, the rules are a table that
is joined on the host suffixes of each url, with the same results.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenledger.llm.common import lower_ascii, table

#: (verdict, host, path) of the production filter; fixed values of the contract.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
MAX_TRIE_RULES = 500_000


class UrlTrie:
    """Nested dictionaries: host labels from the right, then path segments, then segment prefixes."""

    def __init__(self, rules: Sequence[tuple[str, str, str]]):
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            *whole, last = path.split("/")
            node = node.setdefault("/paths", {})
            for segment in whole:
                node = node.setdefault(("segment", segment), {})
            ends = node.setdefault("/ends", {})
            new = (len(host) + len(path), len(host), verdict == "block", host + path, verdict)
            ends[last] = max(ends.get(last, new), new)
            node.setdefault("/sizes", set()).add(len(last))

    def _in_path(self, node: dict, segments: list[str], best):
        for segment in segments:
            for n in node.get("/sizes", ()):  # as many looks as there are lengths of prefixes, however many rules
                found = node["/ends"].get(segment[:n]) if n <= len(segment) else None
                if found:
                    best = max(best, found) if best else found
            node = node.get(("segment", segment))
            if node is None:
                break
        return best

    def match(self, host: str, path: str):
        """The (rule, verdict) of the longest fitting rule, else (None, None)."""
        node, best, segments = self.root, None, path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if "/paths" in node:
                best = self._in_path(node["/paths"], segments, best)
        return best[3:] if best else (None, None)


def with_host_and_path(df: DataFrame, url: str = "url") -> DataFrame:
    u = F.col(url)
    rest = F.when(F.instr(u, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return df.withColumns({
        "host": lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)),
        "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
    })


def filter_urls(df: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame = RULES, url: str = "url",
                default: str = "allow", max_trie_rules: int = MAX_TRIE_RULES) -> DataFrame:
    """df with host, path, rule and verdict.  rules: tuples, or a DataFrame (verdict, host, path)."""
    parsed = with_host_and_path(df, url)
    if isinstance(rules, DataFrame):
        # limit() bounds what reaches the driver whatever the table's size
        some = rules.select("verdict", "host", "path").limit(max_trie_rules + 1).collect()
        if len(some) > max_trie_rules:
            return _by_join(parsed, rules, default)
        rules = [tuple(r) for r in some]
    if len(rules) > max_trie_rules:
        return _by_join(parsed, df.sparkSession.createDataFrame(list(rules), "verdict string, host string, path string"), default)
    trie = df.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    @F.pandas_udf("struct<rule:string,verdict:string>")
    def match(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        found = [trie.value.match(h, p) for h, p in zip(hosts, paths, strict=True)]
        return pd.DataFrame(found, columns=["rule", "verdict"], dtype=object)

    hit = match("host", "path")
    out = parsed.withColumn("rule", hit)
    return out.withColumns({"verdict": F.coalesce(F.col("rule.verdict"), F.lit(default)), "rule": F.col("rule.rule")})


def _by_join(parsed: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """Hosts are few next to urls, so their suffixes meet the rules once per distinct host and path."""
    keys = parsed.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    r = rules.select(F.col("verdict").alias("r_verdict"), F.col("host").alias("r_host"), F.col("path").alias("r_path"))
    best = (
        keys.withColumn("suffix", F.explode(suffixes))
        .join(r, (F.col("suffix") == F.col("r_host")) & F.col("path").startswith(F.col("r_path")))
        .withColumn("rule", F.concat("r_host", "r_path"))
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("n"), F.length("r_host").alias("h"), (F.col("r_verdict") == "block").alias("b"), "rule", F.col("r_verdict").alias("verdict"))).alias("best"))
        .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    )
    return parsed.drop("rule", "verdict").join(best, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


SQL = """
WITH rules(verdict, rh, rp) AS (VALUES ('allow','org','/'), ('block','example.org','/es/'), ('block','example.org','/en/1'),
                                       ('allow','com','/fr/'), ('block','com','/de/')),
rest AS (SELECT page_id, CASE WHEN coalesce(strpos(url, '://'), 0) > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
p AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
m AS (SELECT p.*, rh || rp AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC NULLS LAST, length(rh) DESC, verdict DESC) AS k
      FROM p LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
