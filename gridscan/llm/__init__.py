"""Operators for large training-text pipelines; `queries` registers one query per operator."""

import sys

from pyspark import cloudpickle

# Tasks carry this subpackage's functions with them, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
