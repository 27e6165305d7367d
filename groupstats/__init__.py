"""Group-relative features, encodings, splits and reports as Spark DataFrame operators.

Rows are *entries*; entries that compete with each other share a *group* key.
Every operator takes DataFrames and column names and returns DataFrames.
"""
