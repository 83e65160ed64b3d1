"""bibspark.functions."""
