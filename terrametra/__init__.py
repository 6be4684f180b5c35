"""Spark-native spatial market analytics: DataFrame in, DataFrame out."""

import sys

from pyspark import cloudpickle

# The few Python functions that run in tasks travel with the plan, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
