"""Spark jobs for the data side of retrieval-augmented question answering.

functions   column expressions (text rules, urls, predicates, scores)
operators   joins, groupings and windows over tables (dedup, sections, search, history)
sources     readers and writers (JSON lines, page snapshots, chunk tables)
plans       whole jobs made of the above (page documents, corpus build, review)
streaming   incremental chunk load
catalog     the registered queries with their SQL counterparts
"""

import sys

from pyspark import cloudpickle

# functions that run inside tasks travel with the task, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
