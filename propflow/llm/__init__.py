"""Operators for preparing language-model training corpora.

Each module holds one operator, its query (``opN_<name>``) and, where SQL can
express the result, its SQL.  Nothing outside this subpackage imports it.
"""

import sys

from pyspark import cloudpickle

# Executors need not have this package installed: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
