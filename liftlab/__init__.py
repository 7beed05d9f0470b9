"""liftlab: randomized-experiment measurement and uplift evaluation on Spark.

Every operator takes a DataFrame and returns a DataFrame. Row work runs on
Spark executors; the driver only sees small aggregate tables.
"""

from liftlab.spec import ExperimentSpec, ValidationError

__version__ = "0.1.0"

__all__ = ["ExperimentSpec", "ValidationError", "__version__"]
