"""gridflow: coupling of gridded, time-stepped fields as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so the package need
# not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
