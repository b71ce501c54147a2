"""Criteria used by the registered queries, the oracle SQL, tests and bench.

The driver tables' dates run 1995-01-01 .. 2001-08-01, so the default
2010/2012 cut-offs would select nothing; the checks pass their own.
"""

from paddock.plans.criteria import DAY_PRESETS, Criteria

CHECK_SINCE = "1996-01-01 09:50:00"

# Fukushima, turf, 1200 m, good going, all meeting days.
CHECK_COURSE = Criteria(3, True, 1200, "良", DAY_PRESETS[7], since=CHECK_SINCE)

# Same course fields, graded-race mode: race name contains "URGENT".
CHECK_GRADED = Criteria(3, True, 1200, "良", DAY_PRESETS[7], grade_race="URGENT", since=CHECK_SINCE)

# Course mode with the optional predicates switched on.
CHECK_COURSE_OPT = Criteria(3, True, 1200, "良", DAY_PRESETS[7], since=CHECK_SINCE,
                            months=(1, 2, 3, 4, 5, 6), race_rank="オープン")

# Course mode with name and terms.
CHECK_COURSE_TERMS = Criteria(3, True, 1200, "良", DAY_PRESETS[7], since=CHECK_SINCE,
                              name_contains="URGENT", terms="ハンデ")

# Graded-race mode with a name that no race has.
CHECK_NO_RACE = Criteria(3, True, 1200, "良", DAY_PRESETS[7], grade_race="NO SUCH RACE", since=CHECK_SINCE)
