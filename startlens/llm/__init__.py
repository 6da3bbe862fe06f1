"""Operators for preparing training text and embeddings at large scale.

One module per operator, each with its own general interface; ``registry``
holds the thin ``opN_<name>`` queries and their DuckDB SQL. Nothing else in
the library imports this package.

Functions that run inside Spark tasks are shipped by value, so executors
need only PySpark, pyarrow and numpy, not this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
