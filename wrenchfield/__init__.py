"""Fleet-repair analytics and corpus preparation on Spark DataFrames."""
