"""codelake: Spark-native indexing and search over source-code and document corpora."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code along, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
