"""Run-evidence analytics on Spark: profiles, traces, series and workloads as DataFrames keyed by run."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run in Python workers travel by value, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
