"""tallyspark — auditable retail-transaction analytics on Apache Spark.

Raw, text-typed sales rows are parsed, cleaned and flagged; the cleaned table
feeds quality checks, SQL-style reports, a month x channel x category cube,
distributed rank statistics, a cluster bootstrap and a time-ordered Ridge
benchmark. Everything is expressed as DataFrame / Spark SQL / Spark ML plans.
"""

from tallyspark.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
