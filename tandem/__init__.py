"""tandem: Spark-native analytics for two-sided events.

A *two-sided event* is a dated contest or exchange between two entities
(home / away) with a measure per side and, optionally, a published line.
Every operator is a ``DataFrame -> DataFrame`` function built from the
DataFrame API so Catalyst can prune, push down and plan it.
"""

__version__ = "0.1.0"
