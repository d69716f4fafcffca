"""runeframe: a PySpark workbench for symbol-stream analytics and chat-archive search.

Everything is declared on DataFrames so that Catalyst and AQE choose the physical plan;
Python (always Arrow batches, never row at a time) appears only where Spark has no
expression for the semantics.
"""

__version__ = "0.1.0"
