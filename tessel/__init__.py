"""tessel: a PySpark-native engine for relational queries, contracts, ingestion and data quality."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions for Python workers travel with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
