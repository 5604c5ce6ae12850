"""skein: relational-schema clustering and training-data preparation on Spark."""
