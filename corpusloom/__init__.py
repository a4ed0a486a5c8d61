"""corpusloom: corpus preparation, auditing and scoring on Spark DataFrames."""
