"""cohortspark: cohort selection, text mention surveillance and incidence statistics on Spark.

Every operator takes DataFrames plus explicit parameters and returns a lazy DataFrame;
nothing is collected to the driver except scalars of fixed size (quantiles, thresholds).
"""

from cohortspark.params import StudyParams
from cohortspark.session import build_session, checkpoint_dir

__all__ = ["StudyParams", "build_session", "checkpoint_dir"]
