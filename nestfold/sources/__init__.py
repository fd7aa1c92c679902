"""From captured pages and payloads to canonical rows."""
