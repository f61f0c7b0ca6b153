"""Spark-first retrieval analytics: ingestion, chunking, search, fusion, packing, evaluation."""

import sys

from pyspark import cloudpickle

# Executors need not have this package installed: functions travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
