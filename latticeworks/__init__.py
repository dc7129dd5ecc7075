"""Analytics over collections of periodic atomic structures, as Spark DataFrames."""
