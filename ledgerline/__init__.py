"""Communications-record analytics and corpus preparation on PySpark."""

import sys

from pyspark import cloudpickle

# Functions shipped to executors travel by value, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
