"""korvid: a Spark-first analytics engine (relational, spatial, text, vector)."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python workers get the package's functions inside the tasks, so they need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
