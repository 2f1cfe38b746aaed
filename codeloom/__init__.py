"""codeloom: assigning codes of a two-level codebook to free text, as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to the Python workers by value, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
