"""Reconciling uploads: deduplication, conflict resolution, merge, audit and failure policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.session import cut_lineage

# Columns that never make two versions of a row differ.
BOOKKEEPING = ["id", "updated_at", "created_at", "synced_at", "synced"]
# Messages and status codes that decide whether a failed upload is tried again.
FATAL_CODES = [400, 401, 403, 404, 422]
RETRY_CODES = [408, 429]
FATAL_MESSAGES = ["bad request", "unauthorized", "forbidden", "invalid input", "violates foreign key"]
RETRY_MESSAGES = [
    "network",
    "failed to fetch",
    "econnrefused",
    "etimedout",
    "enotfound",
    "econnreset",
    "socket hang up",
    "timeout",
    "offline",
    "aborterror",
    "service unavailable",
    "gateway timeout",
    "rate limit",
    "server error",
]
MAX_RETRIES = 5


def _conflicts(items: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """Earliest item per key, and earliest one per session that has not failed; map-side combined."""
    by_key = items.where("_key is not null").groupBy("_key").agg(F.min("_at").alias(f"{prefix}_key"))
    holding = items.where("_session is not null").where(~F.col("status").eqNullSafe("failed"))
    return by_key, holding.groupBy("_session").agg(F.min("_at").alias(f"{prefix}_session"))


def dedup_uploads(queue: DataFrame) -> DataFrame:
    """Flags duplicates as a queue does that takes items in order of (timestamp, id): an accepted earlier item has the same
    idempotency key, or the same session and has not failed.  An item that was itself a duplicate blocks nothing.

    A round accepts every open item that no earlier open item could block, and rejects the items that those block; the others
    wait for the next round, which holds only them.  The earliest open item is always accepted, so rounds end; their number
    is the longest chain of items that wait for each other.  Minima are combined map-side and joined back, so a session
    uploaded a million times is never ordered in one task.

    A missing or empty key is made of session, participant and timestamp.  Without a session (or a key) there is nothing to
    match on that side.  Rows of one timestamp and id are one item.  No rows give no rows.
    """
    session, key = (F.when(F.col(c) != "", F.col(c)) for c in ("session_id", "idempotency_key"))
    participant = F.col("participant_id") if "participant_id" in queue.columns else F.lit(None)
    made = F.when(session.isNotNull(), F.concat_ws("_", session, participant.cast("string"), F.col("timestamp").cast("string")))
    open_items = queue.withColumns({"_at": F.struct("timestamp", "id"), "_session": session.cast("string"), "_key": F.coalesce(key.cast("string"), made)})
    done = None
    while True:
        by_key, by_session = _conflicts(open_items, "_first")
        items = open_items.join(by_key, "_key", "left").join(by_session, "_session", "left")
        waits = F.coalesce(F.col("_first_key") < F.col("_at"), F.lit(False)) | F.coalesce(F.col("_first_session") < F.col("_at"), F.lit(False))
        items = cut_lineage(items.withColumn("_accepted", ~waits).drop("_first_key", "_first_session"))
        by_key, by_session = _conflicts(items.where("_accepted"), "_taken")
        items = items.join(by_key, "_key", "left").join(by_session, "_session", "left")
        blocked = F.coalesce(F.col("_taken_key") < F.col("_at"), F.lit(False)) | F.coalesce(F.col("_taken_session") < F.col("_at"), F.lit(False))
        items = cut_lineage(items.withColumn("is_duplicate", F.when(F.col("_accepted"), F.lit(False)).when(blocked, F.lit(True))))
        decided = items.where("is_duplicate is not null").select(*queue.columns, "is_duplicate")
        done = decided if done is None else done.unionByName(decided)
        open_items = items.where("is_duplicate is null").select(*open_items.columns)
        if open_items.isEmpty():
            return done


def compared_columns(local: DataFrame, server: DataFrame, key: str) -> list[str]:
    names = list(dict.fromkeys([*local.columns, *server.columns]))
    return [c for c in names if c not in BOOKKEEPING and c != key]


def _side(df: DataFrame, name: str, alias: str) -> Column:
    return F.col(f"{alias}.{name}") if name in df.columns else F.lit(None)


def divergent_array(local: DataFrame, server: DataFrame, key: str) -> Column:
    """Names of the columns whose values differ (nulls equal) between the aliases ``l`` and ``s``."""
    items = [
        F.when(~_side(local, c, "l").eqNullSafe(_side(server, c, "s")), F.lit(c)) for c in compared_columns(local, server, key)
    ]
    return F.array_compact(F.array(*items))


def divergent_fields(local: DataFrame, server: DataFrame, key: str = "session_id") -> DataFrame:
    return local.alias("l").join(server.alias("s"), F.col(f"l.{key}") == F.col(f"s.{key}")).select(
        F.col(f"l.{key}").alias(key), divergent_array(local, server, key).alias("divergent_fields")
    )


def reconcile(local: DataFrame, server: DataFrame, key: str = "session_id") -> DataFrame:
    """Server wins. One row per local row with the resolution, the differing columns and the resolved values."""
    joined = local.alias("l").join(server.alias("s"), F.col(f"l.{key}") == F.col(f"s.{key}"), "left")
    known = F.col(f"s.{key}").isNotNull()
    diff = F.when(known, divergent_array(local, server, key)).otherwise(F.array().cast("array<string>"))
    resolved = [
        F.when(known, _side(server, c, "s")).otherwise(_side(local, c, "l")).alias(c) for c in compared_columns(local, server, key)
    ]
    return joined.select(F.col(f"l.{key}").alias(key), *resolved, diff.alias("divergent_fields"), known.alias("_known")).withColumn(
        "resolution",
        F.when(~F.col("_known"), "local_inserted").when(F.size("divergent_fields") == 0, "idempotent_match").otherwise("server_wins"),
    ).drop("_known")


def merge_sessions(local: DataFrame, server: DataFrame, key: str = "session_id") -> DataFrame:
    """Insert-if-absent: the server table plus the local rows it does not have, one per key (the smallest row)."""
    fresh = local.join(server.select(key), key, "left_anti").groupBy(key).agg(
        F.min(F.struct(*[c for c in local.columns if c != key])).alias("_row")
    )
    return server.unionByName(fresh.select(key, "_row.*"), allowMissingColumns=True)


def sync_audit(reconciled: DataFrame, key: str = "session_id") -> DataFrame:
    """Audit row per item: outcome, whether it was a conflict, and what differed."""
    return reconciled.select(
        key,
        "participant_id",
        F.lit("synced").alias("status"),
        F.col("resolution").alias("resolution"),
        (F.col("resolution") == "server_wins").alias("conflict"),
        F.col("divergent_fields"),
    )


def queue_stats(queue: DataFrame) -> DataFrame:
    return queue.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "syncing", "synced", "failed")],
    )


def retryable(message: Column, code: Column) -> Column:
    text = F.lower(F.coalesce(message, F.lit("")))

    def any_of(words: list[str]) -> Column:
        return text.rlike("|".join(words))

    fatal = F.coalesce(code.isin(FATAL_CODES), F.lit(False)) | any_of(FATAL_MESSAGES)
    transient = F.coalesce(code.isin(RETRY_CODES) | code.between(500, 599), F.lit(False)) | any_of(RETRY_MESSAGES)
    return ~fatal & transient & (message.isNotNull() | code.isNotNull())


def classify_failures(log: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Retryable or not, the attempt count after this failure, and the resulting queue status."""
    attempts = F.col("retry_count") + 1
    return log.withColumns(
        {
            "retryable": retryable(F.col("last_error"), F.col("status_code")),
            "attempts": attempts,
            "next_status": F.when(attempts >= max_retries, "failed").otherwise("pending"),
        }
    )
