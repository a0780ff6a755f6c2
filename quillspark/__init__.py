"""Retrieval and analytics over large question-and-answer corpora, as Spark plans."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel whole, so no executor needs this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
