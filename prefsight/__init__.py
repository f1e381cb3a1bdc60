"""prefsight: preference-data and reward-model analytics as Spark DataFrame jobs.

Sub-packages:
    sources    -- readers, writers, validation and the derived input views
    functions  -- Column-level helpers (sigmoid, softplus, keyed hashes, ...)
    operators  -- DataFrame -> DataFrame operators (evaluation, margins, ...)
    plans      -- the registered queries and their DuckDB oracle SQL
    streaming  -- Structured Streaming monitors
"""

__version__ = "0.1.0"
