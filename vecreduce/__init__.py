"""vecreduce: distributed vector reductions and gradient training on Spark DataFrames.

    from vecreduce import operators as op, sources as src, functions as fn
"""

from . import functions, operators, sources

__version__ = "0.2.0"

__all__ = ["functions", "operators", "sources", "__version__"]
