"""tidepool: file-sync data work (chunking, dedup, delta, sync, metrics,
admission) as Spark DataFrame and Structured Streaming jobs."""

import sys

from pyspark import cloudpickle as _cp

# functions run in the workers travel by value: no installed copy of this package is needed there
_cp.register_pickle_by_value(sys.modules[__name__])
