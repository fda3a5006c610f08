"""dayloom: wearable-health analytics as Spark DataFrame jobs.

Raw samples, sessions and daily tables of many subjects are woven into one row
per subject and day; profiles, quality scores, anomaly and prediction jobs run
on top.  Functions take and return lazy DataFrames.
"""

__version__ = "0.1.0"
