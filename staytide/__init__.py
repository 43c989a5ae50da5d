"""Episode-centred time-series analytics on Spark."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the workers by value: they run whether or
# not the folder is on the workers' path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
