"""Feature engine for ordered, tokenised text collections on Spark DataFrames."""
