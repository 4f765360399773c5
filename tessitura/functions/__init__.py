"""Column functions: token arrays, text, rewards and objectives, all built from Spark SQL functions."""
