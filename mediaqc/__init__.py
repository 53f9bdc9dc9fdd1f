"""Media verification and de-duplication on Spark DataFrames."""
