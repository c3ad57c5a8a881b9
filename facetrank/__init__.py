"""facetrank: aspect-based hybrid retrieval and ranking on Spark DataFrames.

Every operator takes DataFrames and returns a DataFrame; none of them runs an
action on the corpus.  Queries always arrive as a batch (one row per query).
"""

__all__ = ["session"]
