"""Parley: conversation analytics over multi-meeting tables on PySpark."""

import sys

from pyspark import cloudpickle

# Python workers get our functions by value: no copy of the package is needed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
