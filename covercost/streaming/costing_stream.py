"""Incidents arriving as files: enrichment, costing and running totals.

Pricing is stateless per row and every join is fact-to-dimension, so the
batch operators apply unchanged to a streaming DataFrame (stream-static
joins against the persisted dimensions).  Running totals per session use the
streaming aggregation in complete mode; no watermark is needed because the
payroll month is a label, not an event time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from covercost.operators.enrich import enrich
from covercost.operators.masters import Masters
from covercost.operators.pricing import export_costed, summary_by_scope
from covercost.schemas import INCIDENCIAS
from covercost.session import ensure_checkpoint_dir


def incident_stream(spark: SparkSession, source_dir: str, max_files_per_trigger: int = 64) -> DataFrame:
    """Raw incidents from Parquet files dropped into ``source_dir``."""
    return (spark.readStream.schema(INCIDENCIAS).option("maxFilesPerTrigger", max_files_per_trigger)
            .parquet(source_dir))


def costed_stream(incidents: DataFrame, m: Masters) -> DataFrame:
    """Costed export rows of a stream (append mode)."""
    return export_costed(enrich(incidents, m), m)


def totals_stream(incidents: DataFrame, m: Masters) -> DataFrame:
    """Running five totals per session and month (complete or update mode)."""
    return summary_by_scope(enrich(incidents, m), m)


def start_totals(spark: SparkSession, incidents: DataFrame, m: Masters, query_name: str,
                 checkpoint: str | None = None) -> StreamingQuery:
    """Run the totals into an in-memory table ``query_name`` with a durable checkpoint."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    checkpoint = checkpoint or f"{base}/covercost-stream-{query_name}-{uuid.uuid4().hex}"
    return (totals_stream(incidents, m).writeStream.outputMode("complete").format("memory")
            .queryName(query_name).option("checkpointLocation", checkpoint).start())
