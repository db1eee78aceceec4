"""Dataset sync, diff, delta and chunk-dedup operators as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Python workers get the package's helpers with the task, so a cluster needs
# no separate install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
