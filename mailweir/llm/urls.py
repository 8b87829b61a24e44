"""URL filter: pattern rules indexed by their rarest literal token.

Every rule becomes a regular expression over host and path. A rule is filed under that one of its
whole literal tokens (host labels, complete path segments) which the URLs of the table hold least
often. The tokens of a URL fetch the rules filed under them, and only those run their expression; a
rule without a whole token is always tried.

Defined results: a null URL, or one without "://", has empty host and path and, unless a rule fits
those, the default verdict. Of the fitting rules the longest wins (ties: block before allow). A
column named like an output is replaced. An empty rule list gives every URL the default.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailweir.llm.common import MAX_BROADCAST_BYTES, add_columns, lower_az, read_table


@dataclass(frozen=True)
class UrlRule:
    """A verdict for a host with all its subdomains, for paths that start with the rule's."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2] if "/" in self.text else ""

    def pattern(self) -> str:
        return rf"(?:[^/]*\.)?{re.escape(self.host)}{re.escape(self.path) if self.path else '(?:/.*)?$'}"

    def tokens(self) -> list[str]:
        """Literal tokens that every fitting URL holds whole: the last path segment may go on."""
        labels = [f"h:{x}" for x in self.host.split(".") if x]
        return labels + [f"p:{x}" for x in self.path.split("/")[1:-1] if x]


#: The rules of the query.
RULES = [
    UrlRule("allow", "org/"),
    UrlRule("block", "example.org/es/"),
    UrlRule("block", "example.org/en/1"),
    UrlRule("allow", "com/fr/"),
    UrlRule("block", "com/de/"),
]


def url_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Add host (A-Z lower-cased) and path; both empty for null and for URLs without "://"."""
    whole = F.col(f"`{url}`")
    rest = F.when(F.instr(whole, "://") > 0, F.expr(f"substr(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)
    return df.withColumns({"host": lower_az(host), "path": path})


def _token_counts(parts: DataFrame, rules: list[UrlRule]) -> dict[str, int]:
    """How many URLs hold each token of the rules; as many rows come back as the rules have tokens."""
    spark = parts.sparkSession
    wanted = sorted({t for r in rules for t in r.tokens()})
    if not wanted:
        return {}
    tokens = F.array_distinct(
        F.concat(
            F.transform(F.split("host", r"\."), lambda x: F.concat(F.lit("h:"), x)),
            F.transform(F.split("path", "/"), lambda x: F.concat(F.lit("p:"), x)),
        )
    )
    wanted_df = F.broadcast(spark.createDataFrame([(t,) for t in wanted], "token string"))
    rows = parts.select(F.explode(tokens).alias("token")).join(wanted_df, "token").groupBy("token").count().collect()
    return {r["token"]: r["count"] for r in rows}


def build_index(rules: list[UrlRule], counts: dict[str, int]) -> dict[str, list[int]]:
    """Rarest token -> numbers of the rules filed under it; "" holds the rules without a token."""
    index: dict[str, list[int]] = {}
    for i, rule in enumerate(rules):
        key = min(rule.tokens(), key=lambda t: (counts.get(t, 0), t), default="")
        index.setdefault(key, []).append(i)
    return index


def judge_urls(df: DataFrame, rules: list[UrlRule], url: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, rule (text of the winning rule, else null) and verdict to every row.

    Map-only but for the token count. The rules and their index go to the tasks with the function;
    their size is checked, as they are a parameter and not data.
    """
    if sum(len(r.text) for r in rules) > MAX_BROADCAST_BYTES:
        raise ValueError("too many rules for one pass: call judge_urls on parts of them and keep the longest rule")
    parts = url_parts(df, url)
    index = build_index(rules, _token_counts(parts, rules))
    order = [(-len(r.text), r.verdict != "block", i) for i, r in enumerate(rules)]

    def make():
        compiled = [re.compile(r.pattern(), re.DOTALL) for r in rules]
        always = index.get("", [])

        def best(host: str, path: str) -> int | None:
            found = list(always)
            for label in set(host.split(".")):
                found += index.get(f"h:{label}", ())
            for segment in set(path.split("/")):
                found += index.get(f"p:{segment}", ())
            target = host + path
            return min((order[i] for i in found if compiled[i].match(target)), default=(0, 0, None))[2]

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            hit = [best(h, p) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            return [
                pa.array([None if i is None else rules[i].text for i in hit], pa.string()),
                pa.array([default if i is None else rules[i].verdict for i in hit], pa.string()),
            ]

        return work

    return add_columns(parts, "path", [("rule", "string"), ("verdict", "string")], make)


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the verdict of every page's URL."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path
  FROM cut
), rules(verdict, rhost, rpath, rule) AS (
  VALUES ('allow', 'org', '/', 'org/'), ('block', 'example.org', '/es/', 'example.org/es/'),
         ('block', 'example.org', '/en/1', 'example.org/en/1'), ('allow', 'com', '/fr/', 'com/fr/'),
         ('block', 'com', '/de/', 'com/de/')
), hits AS (
  SELECT p.page_id, r.rule, r.verdict, row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule) DESC) AS n
  FROM parts p JOIN rules r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)
)
SELECT p.page_id, p.host, p.path, h.rule, coalesce(h.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN hits h ON p.page_id = h.page_id AND h.n = 1
"""
