"""presslake: syndicated-content analytics as PySpark DataFrame jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Send the package's Arrow helpers to Python workers by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
