"""Incremental ingest with Structured Streaming."""

from voxloom.streaming.incremental import ingest_logged, ingest_new_shards, read_ingested, read_log, retry_failed  # noqa: F401
