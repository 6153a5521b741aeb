"""Graph analytics, pattern mining and data preparation as plain Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions for Python workers travel by value, so that the package need not be installed on executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
