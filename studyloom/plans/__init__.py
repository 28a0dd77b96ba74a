"""Importing this package registers every query."""

from . import (  # noqa: F401
    sources_q,
    scalar_q,
    records_q,
    metadata_q,
    series_q,
    quality_q,
    schedule_q,
    audit_q,
    stats_q,
    assignment_q,
    models_q,
    streaming_q,
)
