"""bibspark.plans."""
