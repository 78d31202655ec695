"""Detection and tracking of moving features in gridded time series, on Spark DataFrames."""
