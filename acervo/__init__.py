"""acervo: document-corpus analytics as plain PySpark jobs.

The package is serialised by value into Python tasks, so executors need no
installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
