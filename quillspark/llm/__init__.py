"""Operators of a training-data pipeline. Nothing outside this package imports it."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel whole, so no executor needs this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
