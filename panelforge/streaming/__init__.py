"""Structured Streaming entry points.  The reference has no streaming; the
only late-data notion it has is the append of a late extract (U1), offered
here as an incremental file-source stream."""

from .late_data import LATE_SCHEMA, ingest_late, panel_with_late, stream_append

__all__ = ["LATE_SCHEMA", "ingest_late", "panel_with_late", "stream_append"]
