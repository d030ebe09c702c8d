"""plumbline: fairness, truth and trust auditing of tables and texts as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions shipped to Python workers travel with their code, so that executors do not
# need this package installed or on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
