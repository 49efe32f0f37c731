"""locuspark: copy-number estimation and star-allele typing on Spark DataFrames."""
