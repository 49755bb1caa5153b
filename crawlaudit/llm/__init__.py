"""Operators for training-data pipelines. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Python workers get these functions by value: nothing to install on executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
