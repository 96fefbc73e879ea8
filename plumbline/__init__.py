"""Plumbline: statistical profiles, exposure tests and session logs as Spark jobs.

Every public operator takes DataFrames and plain Python parameters and returns a DataFrame.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

__version__ = "0.1.0"

# Functions run by Python workers travel with their job, so executors need no copy of this package.
register_pickle_by_value(sys.modules[__name__])
