"""Turn a table of already-fetched web pages into clean tabular records with Spark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python tasks carry the functions they run, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
