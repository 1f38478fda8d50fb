"""Consent, erasure, export, isolation and retention."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DATA_COLLECTION = "data_collection"
# Sensor consent a modality needs besides data collection.
MODALITY_CONSENT = {
    "typing": "keyboard_access",
    "voice": "microphone_access",
    "motor": "motion_access",
    "visual": "camera_access",
}


def consent_state(log: DataFrame, tie: str = "record_id") -> DataFrame:
    """Latest record per (participant, type): active iff granted and not revoked. Partially aggregated, no window."""
    latest = log.groupBy("participant_id", "consent_type").agg(
        F.max_by(F.struct("granted", "revoked_at", "consent_version"), F.struct("timestamp", tie)).alias("r")
    )
    return latest.select(
        "participant_id",
        "consent_type",
        "r.granted",
        "r.revoked_at",
        "r.consent_version",
        (F.coalesce(F.col("r.granted"), F.lit(False)) & F.col("r.revoked_at").isNull()).alias("active"),
    )


def consented_sessions(sessions: DataFrame, log: DataFrame) -> DataFrame:
    """Sessions whose participant has active data-collection consent and that of the modality's sensor, if it has one."""
    active = consent_state(log).where("active").select("participant_id", "consent_type")
    needed = reduce(lambda acc, kv: acc.when(F.col("modality") == kv[0], kv[1]), list(MODALITY_CONSENT.items())[1:], F.when(F.col("modality") == "typing", MODALITY_CONSENT["typing"]))
    with_type = sessions.withColumn("consent_type", F.coalesce(needed, F.lit(DATA_COLLECTION)))
    collecting = active.where(F.col("consent_type") == DATA_COLLECTION).select("participant_id")
    return with_type.join(collecting, "participant_id", "left_semi").join(active, ["participant_id", "consent_type"], "left_semi").drop("consent_type")


def apply_revocations(log: DataFrame, requests: DataFrame) -> DataFrame:
    """Closes the open records named by (participant, type or 'all'); the earliest request counts."""
    everything = requests.where("consent_type = 'all'").groupBy("participant_id").agg(F.min("requested_at").alias("_all"))
    single = requests.where("consent_type <> 'all'").groupBy("participant_id", "consent_type").agg(F.min("requested_at").alias("_one"))
    j = log.join(everything, "participant_id", "left").join(single, ["participant_id", "consent_type"], "left")
    when = F.least("_all", "_one")
    hit = F.col("revoked_at").isNull() & when.isNotNull()
    return j.withColumns(
        {
            "granted": F.when(hit, F.lit(False)).otherwise(F.col("granted")),
            "revoked_at": F.coalesce(F.col("revoked_at"), when),
            "affected": hit,
        }
    ).drop("_all", "_one")


def consent_snapshot(log: DataFrame, types: list[str]) -> DataFrame:
    state = consent_state(log)
    return state.groupBy("participant_id").agg(
        *[F.coalesce(F.max(F.when(F.col("consent_type") == t, F.col("active"))), F.lit(False)).alias(t) for t in types]
    )


#: Tables that an erasure leaves: consents stay for the audit trail, participants are marked as deleted.
RETAINED = ("consent_records", "participants")


def erase(tables: dict[str, DataFrame], requests: DataFrame, key: str = "participant_id") -> tuple[dict[str, DataFrame], DataFrame]:
    """All tables, those that are not retained without the rows of the requesting participants, and purge counts per (participant, table).

    Rows are counted per participant map-side before the requests are joined, so a participant of any size is one row.
    """
    ids = requests.select(key).distinct()
    kept = {name: df.join(ids, key, "left_anti") if name not in RETAINED else df for name, df in tables.items()}
    owned = [df.select(key, F.lit(name).alias("table_name")) for name, df in tables.items() if name not in RETAINED]
    counts = reduce(DataFrame.unionByName, owned).groupBy(key, "table_name").agg(F.count(F.lit(1)).alias("purged"))
    return kept, counts.join(ids, key, "left_semi").select(key, "table_name", "purged")


def erasure_audit(requests: DataFrame, version: str = "1.0.0", key: str = "participant_id") -> DataFrame:
    """The consent records that document erasures: one granted 'deletion' record per requesting participant."""
    first = requests.groupBy(key).agg(F.min("requested_at").alias("timestamp"))
    return first.select(key, F.lit("deletion").alias("consent_type"), F.lit(version).alias("consent_version"), F.lit(True).alias("granted"), "timestamp", F.lit(None).cast("timestamp").alias("revoked_at"))


def soft_delete(participants: DataFrame, requests: DataFrame, key: str = "participant_id") -> DataFrame:
    gone = requests.groupBy(key).agg(F.min("requested_at").alias("deleted_at"))
    return participants.join(gone, key, "left").withColumn("is_deleted", F.col("deleted_at").isNotNull())


def export_package(tables: dict[str, DataFrame], participants: DataFrame | None = None, key: str = "participant_id") -> DataFrame:
    """Every row a participant owns as one JSON line with its section.

    The package stays long - a participant may own billions of rows - and is meant to be written partitioned by
    participant; ``export_summary`` gives the counts.
    """
    lines = []
    for name, df in tables.items():
        own = df if participants is None else df.join(participants.select(key).distinct(), key, "left_semi")
        lines.append(own.select(F.col(key), F.lit(name).alias("section"), F.to_json(F.struct(*df.columns)).alias("record")))
    return reduce(DataFrame.unionByName, lines)


def export_summary(package: DataFrame, sections: list[str], key: str = "participant_id") -> DataFrame:
    return package.groupBy(key).agg(*[F.count_if(F.col("section") == s).alias(f"total_{s}") for s in sections])


def isolate(df: DataFrame, participant, key: str = "participant_id") -> DataFrame:
    """Rows of one participant; the predicate is pushed into the scan."""
    return df.where(F.col(key) == F.lit(participant))


def expire(df: DataFrame, keep_days: Column | int, as_of: str, date: str = "date") -> DataFrame:
    """Rows still inside the retention window. With a constant window the filter prunes date partitions."""
    days = F.lit(keep_days) if isinstance(keep_days, int) else keep_days
    return df.where(F.col(date) >= F.date_sub(F.lit(as_of).cast("date"), days.cast("int")))
