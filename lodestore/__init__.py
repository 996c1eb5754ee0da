"""Analytics over content-addressed object stores, on Spark."""
