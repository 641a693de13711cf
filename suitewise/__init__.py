"""suitewise: test-history analytics on Spark.

Every operator is a function ``DataFrame(s) + parameters -> DataFrame`` (column
functions are ``Column -> Column``). Operators are lazy but for checkpoints:
model fits and the global-order helper write one to the shared folder.
"""

import sys

from pyspark import cloudpickle as _cloudpickle

# Functions run inside Python workers (mapInPandas, applyInPandasWithState) are
# shipped by value, so executors need no installed copy of this package and the
# driver may run from any working directory.
_cloudpickle.register_pickle_by_value(sys.modules[__name__])

from suitewise.session import build_session, ensure_checkpoint_dir  # noqa: E402

__all__ = ["build_session", "ensure_checkpoint_dir"]
