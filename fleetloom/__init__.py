"""Road-network movement analytics on Spark."""

import sys

from pyspark import cloudpickle

# Kernels travel to executors by value: these need neither the package nor a PYTHONPATH.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
