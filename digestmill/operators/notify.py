"""Notification feed and client activity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from digestmill import constants as K


def notification_feed(changes: DataFrame, enabled: Sequence[str], occurred_at: Column | None = None, error_chars: int | None = None) -> DataFrame:
    """``event, payload`` for the enabled events ``job.<status>``.

    Only listed fields enter the payload; empty ones are dropped and error text is whole,
    or held to ``error_chars`` where asked. Works on a stream too: one projection per row.
    """
    event = F.concat(F.lit("job."), F.coalesce("status", F.lit("unknown")))
    wanted = [name.strip() for name in enabled if name.strip()]
    moment = F.current_timestamp() if occurred_at is None else occurred_at
    stamp = F.concat(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))

    def field(name: str) -> Column:
        text = F.col(name).cast("string") if name in changes.columns else F.lit(None).cast("string")
        text = F.left(text, F.lit(error_chars)) if name == "error_message" and error_chars is not None else text
        return F.nullif(text, F.lit("")).alias(name)

    payload = F.to_json(F.struct(*[field(name) for name in K.NOTIFICATION_FIELDS], event.alias("event"), stamp.alias("occurred_at")))
    return changes.filter(event.isin(*wanted) if wanted else F.lit(False)).select("job_id", event.alias("event"), payload.alias("payload"))


def client_activity(requests: DataFrame, now: Column, window_seconds: int = 600) -> DataFrame:
    """Last request per client ``(client, path, ts)`` and whether it is recent enough to count as connected."""
    last = requests.groupBy("client").agg(F.max("ts").alias("last_seen_at"), F.max_by("path", "ts").alias("last_path"))
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_seen_at").cast("timestamp"))
    return last.withColumn("connected", age <= window_seconds * 1_000_000)
