"""Operators for large text corpora: scoring, scanning, deduplication, mixing and packing."""

import sys

from pyspark import cloudpickle

# Executors get these functions with the task; the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
