"""Sources and sinks: unit profiles over the test tables, multi-file scans,
Parquet sink, describe, file checks, catalog loading."""
