"""PySpark-native analytics over typed, weighted graphs with evidence.

Operators are functions from DataFrames to DataFrames; ``tidegraph.catalog`` holds the registered queries.
"""

__version__ = "0.1.0"
