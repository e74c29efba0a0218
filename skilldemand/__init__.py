"""Job-market skill demand analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Executors need not have the package installed: its UDFs travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
