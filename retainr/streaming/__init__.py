"""Structured Streaming: incremental, exactly-once loading of new table drops (``ingest``).
The analyses themselves are batch, as in the reference."""
