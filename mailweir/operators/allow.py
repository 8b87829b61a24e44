"""The allow-list of hosts: exact names, IP literals, shell patterns, or a lone dot for all."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailweir.functions.ip import canonical_text
from mailweir.functions.text import glob_to_regex


@dataclass(frozen=True)
class AllowList:
    """Exact entries (lower case; IP literals canonical, in brackets) and shell patterns, in their order."""

    exact: frozenset[str]
    globs: tuple[str, ...]

    @staticmethod
    def of(entries: list[str]) -> AllowList:
        """An entry with a star is a pattern; one in brackets an IP literal, which is left out if it is none."""
        exact: set[str] = set()
        for entry in (e for e in entries if "*" not in e):
            if len(entry) > 5 and entry[0] == "[" and entry[-1] == "]":
                ip = canonical_text(entry[1:-1])
                exact |= {f"[{ip}]"} if ip else set()
            else:
                exact.add(entry.lower())
        return AllowList(frozenset(exact), tuple(e.lower() for e in entries if "*" in e))

    def allows(self, host: Column) -> Column:
        """Whether a name, or an address in brackets, is on the list. A dot that is the only exact entry allows all."""
        if self.exact == {"."}:
            return F.lit(True)
        low = F.lower(host)
        out = low.isin(sorted(self.exact)) if self.exact else F.lit(False)
        for pattern in filter(None, map(glob_to_regex, self.globs)):
            out = out | low.rlike(pattern)
        return F.coalesce(out, F.lit(False))


def allows_host(host: Column, allowed: list[str]) -> Column:
    """Whether a host is on the list; names compare without case, exact ones first."""
    return AllowList.of(allowed).allows(host)


def allows_recipient(host: Column, ip: Column, allowed: list[str]) -> Column:
    """The relay decision: a recipient at an address literal by its address, any other by its host."""
    table = AllowList.of(allowed)
    return F.when(ip.isNotNull(), table.allows(F.concat(F.lit("["), ip, F.lit("]")))).otherwise(table.allows(host))


def split_by_exact_list(df: DataFrame, host: str, allowed: DataFrame, name: str = "host", keep: bool = True) -> DataFrame:
    """Rows whose host is (or isn't) on a list that is a table; Spark broadcasts the list only if it is small."""
    listed = allowed.select(F.lower(name).alias("_listed")).distinct()
    return df.join(listed, F.lower(host) == F.col("_listed"), "left_semi" if keep else "left_anti")
