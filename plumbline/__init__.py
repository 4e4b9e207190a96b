"""Plumbline: classifier evaluation and data-reliability diagnostics as Spark jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few Arrow functions travel to executors by value, so nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
