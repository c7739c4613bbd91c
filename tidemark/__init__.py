"""Order-aware analytics on Spark: sort, merge, verify, compare and plan keyed records."""
