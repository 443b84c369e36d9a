"""Document similarity on Spark: ingest, embed, search and study a corpus."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with them, so executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
