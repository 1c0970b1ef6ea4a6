"""Study parameters: one frozen object replaces the JSON configuration file."""

from __future__ import annotations

from dataclasses import dataclass, field

SECONDS_PER_DAY = 86_400
# mean Gregorian year in seconds; age is floor(elapsed seconds / this), not calendar age
SECONDS_PER_YEAR = 31_556_952


@dataclass(frozen=True)
class StudyParams:
    # study window on the stay month: date_from <= month < date_upper_limit
    date_from: str = "1995-01-01"
    date_upper_limit: str = "2001-08-01"
    # month splitting the pre / post periods
    cutoff: str = "1998-01-01"
    # stays of a patient closer than this chain into one episode (seconds)
    delta_min_visits: int = 15 * SECONDS_PER_DAY
    # a mention dated at least this long before the stay start is history (seconds)
    delta_history: int = 15 * SECONDS_PER_DAY
    # a stay is positive when it has at least this many positive mentions
    threshold_positive: int = 1
    # right-closed age bands (7,17] (17,25] (25,65] (65,120]
    age_breaks: tuple[int, ...] = (7, 17, 25, 65, 120)
    discharge_death: str = "death"
    unknown_sex: tuple[str, ...] = ("Unknown", "U")
    unknown_category: str = "src0"
    # survival: open stays end at this date; curve on days 0..km_days
    km_limit_date: str = "2001-09-01"
    km_days: int = 30
    # episode chaining splits a patient's history into time buckets of this width (seconds)
    # so that one very large patient does not land in one task
    episode_bucket_seconds: int = 30 * SECONDS_PER_DAY
    seed: int = 7919
    sexes: tuple[str, ...] = ("M", "W")
    extra: dict = field(default_factory=dict, compare=False, hash=False)

    def age_labels(self) -> list[tuple[int, int, str]]:
        b = self.age_breaks
        return [(b[i], b[i + 1], f"{b[i] + 1}-{b[i + 1]}") for i in range(len(b) - 1)]


DEFAULT = StudyParams()
