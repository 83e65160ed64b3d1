"""bibspark.llm."""
