"""tablelens: table profiling and exploratory analysis as Spark jobs.

Every operator takes a ``DataFrame`` (plus plain parameters) and returns a
``DataFrame``. Heavy work stays inside Spark: one fused aggregate per table
for moments, one frequency table for distinct/top-k questions, windows for
series, ``pyspark.ml`` for models. Only k-by-k matrices and a handful of
p-values are finished on the driver.
"""

from tablelens.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
