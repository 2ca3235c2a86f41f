"""Operators for training-data preparation at scale.

Thirteen operators over the ``documents``, ``pages``, ``benchmark``, ``labels`` and
``embeddings`` tables.  Each module holds one operator with its general
interface; ``catalog`` holds the thin registered queries.  Nothing else in the
library imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their task, so executors
# need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
