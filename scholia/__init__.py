"""Knowledge retrieval and corpus analytics as PySpark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the job: executors need no copy of
# this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
