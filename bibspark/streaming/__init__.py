"""bibspark.streaming."""
