"""Column expressions as Spark SQL text: dimension buckets and labels, report text."""

from paddock.functions.buckets import bucket_sql, label_sql
from paddock.functions.text import percent_text_expr, percent_text_sql, ratio_sql, record_sql

__all__ = ["bucket_sql", "label_sql", "percent_text_expr",
           "percent_text_sql", "ratio_sql", "record_sql"]
