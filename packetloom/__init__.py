"""packetloom: network-threat analytics as PySpark DataFrame operators."""
import sys

from pyspark import cloudpickle

# Task-side helpers travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
