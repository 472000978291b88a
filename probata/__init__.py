"""Evidence analytics and corpus preparation as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions shipped to executors travel by value: a worker needs no copy of this package on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
