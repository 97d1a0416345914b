"""Risk scanning of source files and documents as lazy Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# The few Python functions that run in tasks travel with the job, so that
# executors do not need this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
