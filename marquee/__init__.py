"""Set-oriented movie-catalogue analytics and recommendation jobs on Spark."""

import sys

from pyspark import cloudpickle

# The block kernels travel to the Python workers by value, so the package need
# not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
