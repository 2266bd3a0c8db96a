"""Analytics for hierarchical, scored observations on Spark."""
