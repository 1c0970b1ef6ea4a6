"""Cohort and note selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.operators.joins import hot_join, hot_keys
from cohortspark.params import StudyParams


def _epoch():
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def _subset(df: DataFrame, subset, key: str) -> DataFrame:
    """A subset is a list (isin) or a DataFrame (semi join; never collected)."""
    if subset is None:
        return df
    if isinstance(subset, DataFrame):
        return df.join(subset.select(key).distinct(), key, "left_semi")
    return df.where(F.col(key).isin(*list(subset)))


def cohort_filter(
    visits: DataFrame,
    sites: DataFrame | None = None,
    admission_modes: list[str] | None = None,
    visit_types: list[str] | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
    site_labels: list[str] | None = None,
    encounter_subset=None,
    source_systems: list[str] | None = None,
    source_col: str = "sourcesystem_cd",
) -> DataFrame:
    """Chained filters, each skipped when None; start >= date_from and < date_to. ``source_systems``
    keeps the stays that one of these systems recorded.

    The site filter runs before the one-row-per-stay reduction, so a stay with any listed
    site is kept and carries its smallest listed site label."""
    v = visits if source_systems is None else visits.where(F.col(source_col).isin(*source_systems))
    if admission_modes is not None:
        v = v.where(F.col("admission_mode").isin(*admission_modes))
    if visit_types is not None:
        v = v.where(F.col("visit_type").isin(*visit_types))
    if date_from is not None:
        v = v.where(F.col("visit_start_date") >= F.lit(date_from).cast("timestamp_ntz"))
    if date_to is not None:
        v = v.where(F.col("visit_start_date") < F.lit(date_to).cast("timestamp_ntz"))
    v = _subset(v, encounter_subset, "encounter_num")
    if sites is not None:
        s = sites
        if site_labels is not None:
            s = s.where(F.col("site_label").isin(*site_labels))
        s = s.groupBy("encounter_num").agg(F.min("site_label").alias("site_label"))
        v = v.join(s, "encounter_num", "inner")
    return v


def note_filter(
    notes: DataFrame,
    patient_subset=None,
    categories: list[str] | None = None,
    encounter_subset=None,
    exclude_categories: list[str] | None = None,
) -> DataFrame:
    """Subsets (list or table), category include list, category exclude list.

    ``~isin`` drops null categories as SQL three-valued logic does."""
    n = _subset(notes, patient_subset, "patient_num")
    n = _subset(n, encounter_subset, "encounter_num")
    if categories is not None:
        n = n.where(F.col("note_category").isin(*categories))
    if exclude_categories is not None:
        n = n.where(~F.col("note_category").isin(*exclude_categories))
    return n


def combined_pattern(patterns: dict[str, str] | list[str]) -> str:
    """All patterns OR-ed into one, so the text is scanned once."""
    ps = list(patterns.values()) if isinstance(patterns, dict) else list(patterns)
    return "|".join(f"({p})" for p in ps)


def regex_filter(notes: DataFrame, patterns, text_col: str = "note_text") -> DataFrame:
    """Keep notes where any pattern is found (find semantics)."""
    return notes.where(F.col(text_col).rlike(combined_pattern(patterns)))


def patient_enrich(df: DataFrame, patients: DataFrame) -> DataFrame:
    """Left join of patient columns, birth timestamp to date."""
    p = patients.select("patient_num", F.to_date("birth_date").alias("birth_date"), "sex_cd")
    return df.join(p, "patient_num", "left")


def _order_key(method: str, params: StudyParams):
    known = F.when(
        F.col("note_category").isNull() | (F.col("note_category") == F.lit(params.unknown_category)), F.lit(0)
    ).otherwise(F.lit(1))
    micros = F.timestamp_diff("MICROSECOND", _epoch(), F.col("document_datetime"))
    if method == "keep_last":
        t = micros
    elif method == "keep_first":
        t = -micros
    else:
        raise ValueError(f"unknown note selection method {method!r}; use 'keep_last' or 'keep_first'")
    return F.struct(known.alias("k"), t.alias("t"), F.col("note_id").alias("i"))


def select_one_note(notes: DataFrame, method: str = "keep_last", params: StudyParams = StudyParams()) -> DataFrame:
    """W1 + W2: per stay, the note count and one note: known category first, then the latest
    (keep_last) or earliest (keep_first) time, ties to the larger note id.

    A ``max_by`` aggregate instead of ``row_number``: it combines map-side, so a stay with a
    huge number of notes is reduced before the shuffle rather than sorted in one task."""
    key = _order_key(method, params)
    cols = [c for c in notes.columns if c != "encounter_num"]
    picked = notes.groupBy("encounter_num").agg(
        F.count(F.lit(1)).alias("n_docs_per_visit"),
        F.max_by(F.struct(*[F.col(c) for c in cols]), key).alias("_n"),
    )
    return picked.select("encounter_num", "_n.*", "n_docs_per_visit")


def select_note_texts(notes: DataFrame, patterns, method: str = "keep_last", params: StudyParams = StudyParams(),
                      text_col: str = "note_text", by_stay: bool = False, picked: DataFrame | None = None) -> DataFrame:
    """W1 + W2 + P3 with a late read of the text: the note of each stay is chosen among all notes on the narrow
    columns, and the texts, filtered by the patterns where they are read, are joined to the chosen notes by note
    id (unique; a null id has no text). No aggregate holds a text, and only matching texts are shuffled. Same
    rows as ``regex_filter`` after ``select_one_note``.

    ``by_stay``: every note has a stay, and its id is of no other stay. Then the texts are joined by stay, and
    those that a join with the stays has dealt by stay are not shuffled again. ``picked``: the chosen notes
    (``select_one_note`` on all notes), if they are known; then ``notes`` needs to hold these only."""
    if picked is None:
        picked = select_one_note(notes.drop(text_col), method, params)
    if by_stay:
        texts = regex_filter(notes.select("encounter_num", F.col("note_id").alias("_id"), text_col), patterns, text_col)
        # no join key: a second one would have the texts dealt by both
        same_note = F.array_contains(F.array("note_id"), F.col("_id"))
        return picked.join(texts, "encounter_num").where(same_note).select(*notes.columns, "n_docs_per_visit")
    texts = regex_filter(notes.select("note_id", text_col), patterns, text_col)
    return picked.join(texts, "note_id").select(*notes.columns, "n_docs_per_visit")


def notes_per_stay(notes: DataFrame) -> DataFrame:
    """W1 on every note: the stay's note count. The counts are known before the join back, so the notes of a
    hot stay are dealt over many tasks (``hot_join``)."""
    counts = notes.groupBy("encounter_num").agg(F.count(F.lit(1)).alias("n_docs_per_visit"))
    return hot_join(notes, counts, ["encounter_num"], "note_id", hot=hot_keys(counts, ["encounter_num"], "n_docs_per_visit"))


def dedup_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key under a total order (ascending columns), as a min_by aggregate."""
    rest = [c for c in df.columns if c not in keys]
    key = F.struct(*[F.col(c) for c in order])
    return df.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in rest]), key).alias("_r")).select(
        *keys, "_r.*"
    )


def notes_of_stays(notes: DataFrame, stays: DataFrame) -> DataFrame:
    """Notes of the given stays, as a semi join (no id list on the driver)."""
    return notes.join(stays.select("encounter_num"), "encounter_num", "left_semi")


def attrition(stays: DataFrame, steps: list[tuple[str, object]]) -> DataFrame:
    """Stays and distinct patients left after each criterion (criteria nest: step k
    requires steps 1..k). One pass: per patient counts, then sums; no count-distinct expand."""
    flags = []
    cond = F.lit(True)
    for name, c in steps:
        cond = cond & F.coalesce(c, F.lit(False))
        flags.append((name, cond))
    per_patient = stays.groupBy("patient_num").agg(
        *[F.count_if(c).alias(f"s{i}") for i, (_, c) in enumerate(flags)]
    )
    wide = per_patient.agg(
        *[F.sum(f"s{i}").alias(f"s{i}") for i in range(len(flags))],
        *[F.count_if(F.col(f"s{i}") > 0).alias(f"p{i}") for i in range(len(flags))],
    )
    stack = ", ".join(f"{i + 1}, '{n}', s{i}, p{i}" for i, (n, _) in enumerate(flags))
    return wide.selectExpr(f"stack({len(flags)}, {stack}) as (step, criterion, n_stays, n_patients)")


def site_filter(df: DataFrame, sites: list[str], col: str = "site_label") -> DataFrame:
    """P10: rows of the listed (e.g. test) sites."""
    return df.where(F.col(col).isin(*sites))
