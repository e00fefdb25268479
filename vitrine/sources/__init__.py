"""Sources and sinks: logical relations over Parquet tables, JSON lines, URL lists and image files."""
