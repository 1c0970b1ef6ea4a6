"""Training-data operators: near-dedup, decontamination, scoring, packing and token counts.

Nothing else in the library imports this subpackage. Its functions are shipped to the Python
workers by value, so executors need no installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
