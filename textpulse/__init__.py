"""textpulse: forum-text enrichment and temporal analytics on Spark.

Sub-packages
------------
sources    readers and writers (exports, lexicons, stage tables)
functions  Column-level building blocks (text, numeric, dates)
operators  DataFrame -> DataFrame stages (clean, tokens, scores, topics, ...)
plans      the registered queries and their SQL oracles
streaming  the narrow stages on a streaming DataFrame
"""

__version__ = "0.1.0"
