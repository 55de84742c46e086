"""cutgraph: a Spark-native engine for time-based media knowledge bases."""

import sys

from pyspark import cloudpickle

# Executors needn't have the package installed: its functions travel with the tasks that call them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
