"""kgweave: knowledge-graph analytics on Spark DataFrames.

A graph is two DataFrames, ``nodes`` and ``edges``; every operator takes
DataFrames and returns DataFrames, so Catalyst plans the whole query.
"""

__version__ = "0.1.0"
