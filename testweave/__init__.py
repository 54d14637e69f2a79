"""Test-history analytics on Spark: ingest reports, fingerprint failures, keep a history, classify."""
