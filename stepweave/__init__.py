"""stepweave: analytics over episodic, step-indexed experiment data on Spark.

Sub-packages: ``sources`` (readers, sinks, logical schemas), ``functions``
(Column-level building blocks), ``operators`` (DataFrame in, DataFrame out),
``plans`` (registered queries and their SQL oracles), ``streaming``.
"""

__version__ = "0.1.0"
