"""Market and community signal analytics as plain Spark DataFrame operators.

Every operator takes and returns DataFrames that carry ``run_id``, so one job
covers all research runs at once. See README.md for the operator map.
"""

__version__ = "0.1.0"
