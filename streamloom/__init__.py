"""A continuous-query engine on Spark: deployments of streams, windows and queries, compiled to DataFrames."""

import sys

from pyspark import cloudpickle

# What runs on executors travels with its tasks: the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
