"""strandweave: k-mer sketching and set comparison on Spark DataFrames."""
