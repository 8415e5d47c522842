"""Learning-analytics engine on Spark DataFrames."""
