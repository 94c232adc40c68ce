"""Analytics over tracked objects, motion signals and symbolic rules, written as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# functions of this package travel to the executors by value, so workers need no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
