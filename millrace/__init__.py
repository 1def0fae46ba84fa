"""millrace: profile, protect, compare, synthesise and prepare data with Spark DataFrames."""
