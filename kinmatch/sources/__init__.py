"""Tables, files and sinks: raw files, the index catalog, items and the work queue."""
