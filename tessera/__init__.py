"""Spark-first numeric analytics: generators, reductions, matrix-vector products, timing records."""
