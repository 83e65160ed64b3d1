"""bibspark.operators."""
