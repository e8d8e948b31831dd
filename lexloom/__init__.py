"""Document-retrieval analytics on Spark DataFrames.

Every public operator takes and returns DataFrames (``operators``, ``sources``,
``streaming``, ``plans``) or Columns (``functions``).
"""
