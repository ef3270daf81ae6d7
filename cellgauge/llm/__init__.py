"""Operators of a training-data pipeline: dedup, filters, counts, archives and mixing.

Task functions travel to the executors by value; the helpers they call don't, so
executors need the package as well.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
