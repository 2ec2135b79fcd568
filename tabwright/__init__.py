"""tabwright — Spark-native data preparation, profiling, model evaluation and
candidate search over DataFrames.

Every operator takes and returns a ``pyspark.sql.DataFrame``. Fitted
transforms are plain ``Column`` expressions or joins against small fitted
tables, so Catalyst prunes, pushes down and codegens them like any other query.
"""

from tabwright.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
__version__ = "0.1.0"
