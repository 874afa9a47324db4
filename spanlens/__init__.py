"""spanlens: execution-timeline analytics as PySpark DataFrame operators.

Every operator takes and returns DataFrames keyed by ``capture_id`` (one traced process) and ``seq`` (the
arrival number of a row inside its capture).  See README.md for the map of modules.
"""

__version__ = "0.1.0"
