"""PySpark library for news feeds and the articles they carry."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Executors need not have this package: the few functions that run in Python travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
