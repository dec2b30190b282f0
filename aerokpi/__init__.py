"""aerokpi — route and booking KPI analytics on Spark DataFrames.

Layers: ``sources`` (entity schemas, readers, test-data adapter, warehouse),
``functions`` (column expressions), ``operators`` (pure DataFrame -> DataFrame
datasets), ``plans`` (query registry, DuckDB oracle, jobs), ``streaming``
(row checks on a stream).
"""

__version__ = "0.1.0"
