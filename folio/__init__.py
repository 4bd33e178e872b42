"""folio: documents in, typed Spark tables out.

Reads files and tables of documents as DataFrames, classifies and parses them
into cells, nodes, blocks, links and listings, and renders them again, with the
work expressed as Spark joins, windows, aggregations and table functions.
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so it needs no installation there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
