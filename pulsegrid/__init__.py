"""pulsegrid: landmark analytics on irregular per-entity series, and data preparation, on Spark."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry this package's code with them: executors need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
