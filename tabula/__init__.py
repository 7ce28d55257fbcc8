"""tabula: tabular profiling and supervised learning as Spark DataFrame operators.

Packages: ``sources`` (scans and sinks), ``functions`` (column expressions), ``operators`` (profile,
association, splits, preparation, neighbours, resampling, models, search, metrics, reports,
explanation), ``plans`` (fixtures, the training flow and the registered query catalog) and
``streaming`` (intentionally empty: the reference has no streams).
"""

__version__ = "0.1.0"
