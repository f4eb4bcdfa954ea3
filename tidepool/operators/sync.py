"""Comparing client and server file tables: J3, J4, P3, P4, F7, F8, F10, T3.

The reference compares with a nested loop per client; here it is one equi
join on ``(client_id, path)`` for all clients at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions.paths import conflict_name
from tidepool.functions.timeutil import utc_wall_clock
from tidepool.operators.files import latest_per_key


def has_conflict(local_hash, remote_hash, local_version, remote_version) -> Column:
    """Hashes differ and both sides have a version above 0."""
    return (local_hash != remote_hash) & (local_version > 0) & (remote_version > 0)


def first_local(local: DataFrame, order: str | list[str]) -> DataFrame:
    """One local row per path: the first in ``order`` (the position in the client's list)."""
    return latest_per_key(local, ["client_id", "path"], [order] if isinstance(order, str) else order, first=True)


def sync_changes(server: DataFrame, local: DataFrame, last_sync: DataFrame | int,
                 local_order: str | list[str] = ("modified_time", "hash")) -> DataFrame:
    """Changes the server reports to each client.

    Live server rows are compared with the client's list on path: a
    different hash is MODIFIED; a path the client lacks is CREATED when its
    ``modified_time`` is after the client's ``last_sync_time``.  Never
    DELETED/RENAMED; local-only rows are ignored.  ``last_sync`` is either a
    constant or a ``(client_id, last_sync_time)`` table (absent client = 0).
    Of a path that the client's list repeats, the first row in ``local_order``
    (its list position) is compared, so a path is reported once.
    """
    local = first_local(local, list(local_order) if not isinstance(local_order, str) else local_order)
    live = server.where(~F.col("deleted")).select("client_id", "path", "modified_time", F.col("hash").alias("server_hash"))
    loc = local.select("client_id", "path", F.col("hash").alias("local_hash"))
    joined = live.join(loc, ["client_id", "path"], "left")
    if isinstance(last_sync, DataFrame):
        joined = joined.join(last_sync.select("client_id", "last_sync_time"), "client_id", "left")
        since = F.coalesce("last_sync_time", F.lit(0))
    else:
        since = F.lit(int(last_sync))
    kind = (
        F.when(F.col("local_hash").isNotNull() & (F.col("local_hash") != F.col("server_hash")), F.lit("MODIFIED"))
        .when(F.col("local_hash").isNull() & (F.col("modified_time") > since), F.lit("CREATED"))
    )
    return joined.select("client_id", "path", kind.alias("type")).where(F.col("type").isNotNull())


def conflicts(local: DataFrame, server: DataFrame) -> DataFrame:
    """ConflictInfo rows of local vs server state on the same path; a path that the
    server has deleted still conflicts with a local edit."""
    loc = local.select(
        "client_id", "path",
        F.col("hash").alias("local_hash"),
        F.col("modified_time").alias("local_modified_time"),
        F.col("version").alias("local_version"),
    )
    srv = server.select(
        "client_id", "path",
        F.col("hash").alias("remote_hash"),
        F.col("modified_time").alias("remote_modified_time"),
        F.col("version").alias("remote_version"),
    )
    pairs = loc.join(srv, ["client_id", "path"], "inner")
    return pairs.where(has_conflict(F.col("local_hash"), F.col("remote_hash"), F.col("local_version"), F.col("remote_version")))


def auto_strategy(local_mtime="local_modified_time", remote_mtime="remote_modified_time") -> Column:
    """F8: newer side wins, equal times keep both; never MANUAL."""
    lm, rm = F.col(local_mtime), F.col(remote_mtime)
    return F.when(lm > rm, "KEEP_LOCAL").when(rm > lm, "KEEP_REMOTE").otherwise("KEEP_BOTH")


def resolve(path, strategy, at_ts, client_label: str = "local") -> Column:
    """KEEP_LOCAL/KEEP_REMOTE keep the path, KEEP_BOTH renames the local copy,
    MANUAL or anything else gives ``""``."""
    p = F.col(path) if isinstance(path, str) else path
    s = F.col(strategy) if isinstance(strategy, str) else strategy
    return (
        F.when(s.isin("KEEP_LOCAL", "KEEP_REMOTE"), p)
        .when(s == "KEEP_BOTH", conflict_name(p, F.lit(client_label), at_ts))
        .otherwise(F.lit(""))
    )


def resolve_conflicts(conflict_rows: DataFrame, resolved_at: int | None = None,
                      strategy: str | None = None) -> DataFrame:
    """F10 with the library's meaning: detect (J4), pick a strategy (F8 unless
    one is given), and compute the resolved path (F7) in one table job.
    ``resolved_at`` (unix seconds, printed as UTC) defaults to the query's
    start time in the session zone, as the reference prints local time."""
    at = F.current_timestamp() if resolved_at is None else utc_wall_clock(resolved_at)
    strat = auto_strategy() if strategy is None else F.lit(strategy)
    return conflict_rows.withColumn("strategy", strat).withColumn("resolved_path", resolve("path", "strategy", at))


def incremental_sync(files: DataFrame, sync_state: DataFrame) -> DataFrame:
    """Rows newer than each client's ``last_sync_time`` (absent = 0), tombstones included."""
    state = sync_state.select("client_id", "last_sync_time")
    return (
        files.join(state.withColumnRenamed("last_sync_time", "__since"), "client_id", "left")
        .where(F.col("modified_time") > F.coalesce("__since", F.lit(0)))
        .drop("__since")
    )


def sync_response(server: DataFrame, local: DataFrame, last_sync: DataFrame | int, server_time: int,
                  local_order: str | list[str] = ("modified_time", "hash")) -> DataFrame:
    """The answer to a sync request, one row per change or conflict: J3 and J4 with the server's time.

    Rows: ``client_id, kind (CHANGE | CONFLICT), path, type, local_hash, remote_hash, server_time``.
    """
    changed = sync_changes(server, local, last_sync, local_order).select(
        "client_id", F.lit("CHANGE").alias("kind"), "path", "type",
        F.lit(None).cast("string").alias("local_hash"), F.lit(None).cast("string").alias("remote_hash"),
    )
    order = list(local_order) if not isinstance(local_order, str) else local_order
    disputed = conflicts(first_local(local, order), server).select(
        "client_id", F.lit("CONFLICT").alias("kind"), "path", auto_strategy().alias("type"), "local_hash", "remote_hash"
    )
    return changed.unionByName(disputed).withColumn("server_time", F.lit(server_time).cast("long"))


def advance_sync_state(state: DataFrame, synced: DataFrame) -> DataFrame:
    """T3 write side: new ``last_sync_time`` per client = the latest of the
    stored value and the ``sync_time`` of this round (absent client = 0).

    A grouped max over the union, so it is idempotent under replays.
    """
    rows = state.select("client_id", "last_sync_time").unionByName(
        synced.select("client_id", F.col("sync_time").alias("last_sync_time"))
    )
    return rows.groupBy("client_id").agg(F.max("last_sync_time").alias("last_sync_time"))
