"""Analytics of hydrological series of many gauging posts, as Spark DataFrame jobs.

Every operator takes and returns DataFrames.  A series is the long table
``post STRING, t BIGINT, value DOUBLE`` with one row per (post, t); ``t`` counts time
steps (years, months, days, hours).
"""
