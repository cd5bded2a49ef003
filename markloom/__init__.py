"""markloom: grading analytics as Spark DataFrame operators.

Every operator is ``f(df, ...) -> DataFrame``.  Nothing here collects rows to the driver.
"""
