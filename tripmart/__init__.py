"""tripmart: a Spark-native trip mart.

Monthly trip files of several services, whose schemas drift over time, are
harmonised into one canonical trips table; a One-Big-Table with duration,
calendar, tip and speed features is derived from it, cleaned by named rule
sets, enriched with zone and code dimensions and summarised by a fixed set of
reports.  Every step is a DataFrame transformation planned by Catalyst; no
Python UDF runs in a hot path.
"""

__version__ = "0.1.0"
