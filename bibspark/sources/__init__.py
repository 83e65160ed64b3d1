"""bibspark.sources."""
