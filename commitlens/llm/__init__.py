"""Training-data operators (one module each) on top of Spark.

Nothing outside this package imports it. Functions used inside tasks are
pickled by value, so executors need Spark's Python and the listed libraries,
not this repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
