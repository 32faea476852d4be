"""weftline: interval, alignment, k-mer and graph analytics on Spark DataFrames."""
