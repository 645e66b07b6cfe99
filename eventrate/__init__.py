"""Binary-event analytics on Spark: DataFrame operators for event rates.

Each operator takes and returns DataFrames and receives every column name as a
parameter.  ``operators`` holds them by family, ``sources`` reads and writes
records and reports, ``functions`` builds column expressions, and ``plans``
strings operators together and keeps the query catalogue.
"""
