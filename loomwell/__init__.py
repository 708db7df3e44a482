"""Analytics over many small named databases kept as one partitioned log, on Spark."""
