"""Coverage and call-outcome analytics on Spark.

Functions take DataFrames and return DataFrames. Most are lazy. Those that need an
intermediate result more than once write it (`session.settle`) and so run jobs when called:
value statistics and what is built on them, order within hot days, author scores, the event study,
stance flips, incremental outcomes and every `store_...` function. What reaches the driver
are single values, the months a write touches, and counts.
"""
