"""Read coverage and differential expression over sequencing reads, on Spark DataFrames."""
