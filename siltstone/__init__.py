"""siltstone: a PySpark-native analytics engine for knowledge corpora.

Worker-side kernels are shipped by value, so executors need nothing but Python, numpy,
pandas and pyarrow: the package itself does not have to be installed on them.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
