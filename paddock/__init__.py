"""paddock — course statistics for horse races on Spark.

Given race, runner-result and payout tables, paddock selects the races of
one course (racecourse, surface, distance, going, meeting days) or of a
named graded race, and breaks the runners down by eleven dimensions
(draw, horse number, popularity, sex, running style, body weight, age,
carried weight, last-3F time, last-3F rank in the race, jockey).  Every
step is a DataFrame plan built from ``pyspark.sql.functions``; there are
no Python UDFs.

Layout
------
``sources``    tables, explicit schemas, readers, the driver-table binding
``functions``  column expressions (buckets, labels, percent text)
``operators``  joins, aggregations, windows, report building, sinks
``plans``      criteria, the dimension catalog, course and all-course plans
"""

from paddock.plans.criteria import Criteria, DAY_PRESETS
from paddock.plans.dimensions import DIMENSIONS, dimension
from paddock.plans.course import CourseAnalysis

__all__ = ["Criteria", "DAY_PRESETS", "DIMENSIONS", "dimension", "CourseAnalysis"]
