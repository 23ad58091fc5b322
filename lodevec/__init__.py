"""lodevec: regex-filtered vector search and corpus preparation, expressed in Spark."""
