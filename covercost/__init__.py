"""covercost: workforce incident costing as Spark DataFrame jobs.

Incidents (a worker covering hours at another centre) are enriched from four
master tables, validated, priced with night rates and payroll accounts, and
summed per supervisor session and payroll month.  Every operator is a
``DataFrame -> DataFrame`` (or ``Column -> Column``) function built from
``pyspark.sql.functions``; no Python UDF runs in the hot path.
"""

__all__ = ["constants", "session"]
