"""docsight: evidence-grounded document analytics on PySpark."""

import sys

from pyspark import cloudpickle

# Python workers get this package's functions with the task, so that a cluster needs no installation of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
