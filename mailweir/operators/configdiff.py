"""Difference of two configurations, as events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The events of a changed configuration, in the order in which they come.
APP_EVENTS = ["config_change:backend_config", "config_change:new_config", "config_change:allowed_hosts", "config_change:pid_file", "config_change:log_file", "config_change:log_level"]
SERVER_EVENTS = [
    "server_change:new_server", "server_change:remove_server", "server_change:update_config", "server_change:start_server", "server_change:stop_server",
    "server_change:new_log_file", "server_change:reopen_log_file", "server_change:timeout", "server_change:max_clients", "server_change:tls_config",
]


def diff(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, event (new, removed or changed) and field (null unless changed), a row for each changed field.

    One join on the key; the fields of a changed row are unpivoted after it.
    """
    side = lambda df, n: df.select(F.col(key).alias(key), F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias(n))
    both = side(old, "o").join(side(new, "n"), key, "full_outer")
    changed = F.filter(F.array(*[F.when(~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}")), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    found = both.select(
        key,
        F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "removed").otherwise("changed").alias("event"),
        F.when(F.col("o").isNull() | F.col("n").isNull(), F.array(F.lit(None).cast("string"))).otherwise(changed).alias("fields"),
    )
    return found.select(key, "event", F.explode("fields").alias("field"))


def _events(named: list[tuple[str, Column]]) -> Column:
    """The names whose condition holds, in order."""
    return F.array_compact(F.array(*(F.when(F.coalesce(when, F.lit(False)), F.lit(name)) for name, when in named)))


def server_events(old: DataFrame, new: DataFrame, key: str = "listen_interface", tls: str = "tls") -> DataFrame:
    """key, position and event of what changed between two tables of servers, in one join.

    A server that was switched on or off has no further events; one whose log file stays has it opened anew. Columns that both tables
    have are compared; those of TLS are the struct `tls`.
    """
    fields = [c for c in old.columns if c in new.columns and c != key]
    side = lambda df, n: df.select(F.col(key), F.struct(*(F.col(c) for c in fields)).alias(n))
    both = side(old, "o").join(side(new, "n"), key, "full_outer")
    differs = lambda c: ~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) if c in fields else F.lit(False)
    gone, fresh = F.col("n").isNull(), F.col("o").isNull()
    kept = ~gone & ~fresh
    switched, on = differs("is_enabled"), F.col("n.is_enabled") if "is_enabled" in fields else F.lit(True)
    going = kept & ~switched
    conditions = [
        fresh, gone, kept & ~F.col("o").eqNullSafe(F.col("n")), kept & switched & on, kept & switched & ~on, going & differs("log_file"), going & ~differs("log_file"),
        going & differs("timeout"), going & differs("max_clients"), going & differs(tls),
    ]
    return both.select(key, F.posexplode(_events(list(zip(SERVER_EVENTS, conditions, strict=True)))).alias("position", "event"))


def app_events(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, position and event of what changed between two versions of each application's configuration.

    A row has backend_config, allowed_hosts, pid_file, log_file and log_level, and whatever else counts as a change.
    """
    side = lambda df, n: df.select(F.col(key), F.struct(*(F.col(c) for c in df.columns if c != key)).alias(n))
    both = side(old, "o").join(side(new, "n"), key)
    differs = lambda c: ~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    conditions = [differs("backend_config"), ~F.col("o").eqNullSafe(F.col("n")), differs("allowed_hosts"), differs("pid_file"), differs("log_file"), differs("log_level")]
    return both.select(key, F.posexplode(_events(list(zip(APP_EVENTS, conditions, strict=True)))).alias("position", "event"))


def as_map(*names: str) -> Column:
    """Columns as a map from name to text."""
    return F.create_map(*(x for n in names for x in (F.lit(n), F.col(n).cast("string"))))
