"""Relational and model operators; each takes and returns DataFrames.

``subject_cols`` names the columns that identify a person; ``()`` means one
person.  A "daily" frame has one row per subject and day, so a window over one
subject is as long as its calendar, never as long as its samples.
"""
