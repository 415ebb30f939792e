"""Operators for large text corpora: language ID, fingerprints, licences, packing, near and
exact duplicates, byte-level BPE, URL rules, n-gram language model and web archives.

Nothing else in the library imports this package.  Its Python functions travel to the
executors by value, so the executors need not have the library installed."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
