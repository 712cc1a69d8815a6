"""scrubsearch: privacy-preserving retrieval over tickets and documents on Spark.

Every operator is a DataFrame -> DataFrame (or Column -> Column) function built
from Spark's own expressions, so Catalyst plans, prunes and pushes it down.
Python runs only in the recursive chunker, the xlsx reader and the
embed/respond plug points.
"""

from scrubsearch.session import get_spark, scratch_dir

__all__ = ["get_spark", "scratch_dir"]
