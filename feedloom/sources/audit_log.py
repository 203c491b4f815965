"""Append-only run log in Parquet with a latest-state view. One writer at a time: Parquet has no unique index."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators.audit import STATUSES, latest_state, real_send

VERSION = 1
SCHEMA = (
    "run_id string, product string, iso_week string, started_at timestamp, ended_at timestamp, status string, window_start timestamp, window_end timestamp, corpus_stats_json string, "
    "cluster_count int, theme_count int, llm_model string, total_tokens int, total_cost_usd double, doc_id string, doc_section_anchor string, doc_revision_id string, gmail_message_id string, "
    "gmail_draft_id string, failed_phase int, error string, forced boolean, dry_run boolean, schema_version int, event_at timestamp"
)
TYPES = dict(c.split() for c in SCHEMA.split(", "))
COLUMNS = list(TYPES)
REQUIRED = ("run_id", "product", "iso_week", "started_at", "status")
# what a later event of a run may change
UPDATABLE = tuple(c for c in COLUMNS if c not in ("run_id", "product", "iso_week", "started_at", "forced", "dry_run", "schema_version", "event_at"))
ERROR_BYTES, CUT_MARK = 8192, "…[truncated]"


def cut_error(message: str | None) -> str | None:
    """An error text of at most ``ERROR_BYTES`` bytes, marked if it was longer; a character cut in two becomes a replacement character."""
    raw = (message or "").encode()
    return message if len(raw) <= ERROR_BYTES else raw[:ERROR_BYTES].decode(errors="replace") + CUT_MARK


class AuditLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def events(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], SCHEMA)
            raise

    def check_version(self) -> None:
        """An error if events of another schema version are in the log; events without a version count as the first."""
        other = self.events().where(F.coalesce("schema_version", F.lit(1)) != VERSION).select("schema_version").first()
        if other:
            raise RuntimeError(f"the run log has schema version {other[0]}, this engine {VERSION}: it must be rewritten")

    def state(self) -> DataFrame:
        return latest_state(self.events())

    def get(self, run_id: str) -> Row | None:
        """The latest state of a run, or None."""
        return latest_state(self.events().where(F.col("run_id") == run_id)).first()

    def append(self, events: DataFrame, new_runs: bool = False) -> None:
        """Append events after checking required values, statuses, repeated run ids and a second real send of a product and week.

        Columns that ``events`` lacks are null, ``forced`` and ``dry_run`` false.
        """
        default = {"forced": F.lit(False), "dry_run": F.lit(False), "schema_version": F.lit(VERSION), "event_at": F.current_timestamp()}
        given = lambda c: F.coalesce(F.col(c), default[c]) if c in events.columns and c in default else F.col(c) if c in events.columns else default.get(c, F.lit(None))
        events = events.select(*[given(c).cast(TYPES[c]).alias(c) for c in COLUMNS])
        lacking = F.lit(False)
        for c in REQUIRED:
            lacking = lacking | F.col(c).isNull()
        if events.where(lacking).limit(1).count():
            raise ValueError(f"an event lacks one of {', '.join(REQUIRED)}")
        if events.where(~F.col("status").isin(*STATUSES)).limit(1).count():
            raise ValueError("unknown status")
        known = self.state()
        if new_runs and events.join(known, "run_id", "left_semi").limit(1).count():
            raise ValueError("run_id exists")
        sends = events.where(real_send()).select("product", "iso_week", "run_id")
        old = known.where(real_send()).select("product", "iso_week", F.col("run_id").alias("other"))
        if sends.join(old, ["product", "iso_week"]).where("run_id <> other").limit(1).count():
            raise ValueError("a real send of that product and week exists")
        events.write.mode("append").parquet(self.path)

    def insert(self, **values) -> None:
        """A new run."""
        self._write(values, True)

    def update(self, run_id: str, **values) -> None:
        """A later event of a run: its latest state with these values; other columns than ``UPDATABLE`` are refused."""
        wrong = sorted(set(values) - set(UPDATABLE))
        if wrong:
            raise ValueError(f"columns that no event may change: {', '.join(wrong)}")
        now = self.get(run_id)
        if now is None:
            raise KeyError(run_id)
        self._write({**now.asDict(), **values}, False)

    def _write(self, values: dict, new: bool) -> None:
        values = {**values, "error": cut_error(values.get("error")), "event_at": dt.datetime.now(dt.UTC)}
        given = [c for c in COLUMNS if c in values]
        self.append(self.spark.createDataFrame([tuple(values[c] for c in given)], ", ".join(f"{c} {TYPES[c]}" for c in given)), new)
