"""Business analytics on Spark DataFrames: relational verbs, tests, models and their evaluation."""
