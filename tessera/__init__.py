"""tessera: a Spark-native engine for reproducible studies on labelled tables.

Every operator takes and returns a DataFrame and is built from Spark column
expressions, windows, joins and aggregations, so the same code runs on a
laptop sample and on a cluster.
"""

from tessera.session import get_spark, ensure_checkpoint_dir, materialize
from tessera.spec import TableSpec, IRRIGATION_SPEC

__all__ = [
    "get_spark",
    "ensure_checkpoint_dir",
    "materialize",
    "TableSpec",
    "IRRIGATION_SPEC",
]
