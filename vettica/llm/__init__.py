"""Operators for preparing training data: scoring, filtering, deduplication, packing.

Each module holds one operator with its own general interface; ``queries``
registers one query per operator.  Nothing outside this subpackage imports it.
"""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the workers by value, so executors need
# no copy of it on their path.  Broadcast values are plain arrays and tuples.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
