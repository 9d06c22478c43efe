import __spark_entry__  # noqa: F401  functions go to workers by value
