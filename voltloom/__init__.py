"""Building-energy time series on Spark: meters, occupancy, weather, models, anomalies."""

import sys

from pyspark import cloudpickle

# The few small functions that run in Python workers travel with the job, so executors
# need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
