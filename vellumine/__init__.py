"""Analytics over versioned document collections on Spark DataFrames."""
