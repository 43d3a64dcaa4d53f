"""driftwell: machine-learning operations analytics as plain Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# The few Python functions that run on executors travel with the query, so the
# package needs no installation there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
