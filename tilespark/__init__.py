"""tilespark: map-tile pyramids as DataFrames, from areas of interest to stitched chunks.

Functions that run in Python workers are pickled by value, so executors need
nothing installed but the interpreter and the usual numeric packages.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
