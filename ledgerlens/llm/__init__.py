"""Training-data operators for text, page and vector corpora.

Nothing else in the library imports this subpackage. Functions that run in
tasks are shipped by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
