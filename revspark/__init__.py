"""Review analytics on Spark.

Collect review pages, flatten them into a typed table, filter and page them,
drop rows already stored, normalise text, tag product titles and turn text into
features and models -- all as DataFrame, Structured Streaming and ``pyspark.ml``
operations.
"""

from revspark.session import checkpoint_dir, get_session

__all__ = ["checkpoint_dir", "get_session"]
