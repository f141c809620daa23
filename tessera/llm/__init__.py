"""Operators for building training corpora from a `documents` table.

Nothing else in the library imports this subpackage; `registry` lists its queries.
"""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
