"""Sources and sinks: Parquet/JDBC scans, strict NDJSON ingest, JSON output, snapshots."""
