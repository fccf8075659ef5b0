"""Training-data operators: scans, near-duplicates, search and encoding over document tables.

Nothing outside this subpackage imports it.  Functions that run on executors are
pickled by value, so executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
