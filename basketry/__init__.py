"""Price statistics on Spark: panels of price quotes in, indices and their analysis out, all as DataFrames."""
