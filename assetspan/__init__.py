"""Analysis of leased assets and their contract intervals, as functions from DataFrames to DataFrames."""
