"""Recipe and grocery analytics as Spark DataFrame operators.

Every operator is a plain function from DataFrames (or Columns) to DataFrames (or Columns).
Nothing in the package starts a Spark session, and time enters only through ``as_of``.
"""
