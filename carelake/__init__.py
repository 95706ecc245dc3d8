"""carelake: clinic risk and scheduling analytics as Spark DataFrame jobs.

Layout
------
sources/    table readers, fixture views over the driver tables, file IO
functions/  pure Column expressions (text cleaning, vital-sign bands, keyword rules)
operators/  DataFrame -> DataFrame operators (clean, features, scoring, records, ...)
plans/      registered queries and their DuckDB oracle SQL
streaming/  Structured Streaming twins of the incremental operators
"""

__all__ = ["session"]
