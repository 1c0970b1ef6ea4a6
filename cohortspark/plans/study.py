"""Study-level building blocks shared by the registered queries: enriched stays under the
outcome sources (every stay, claim codes, text mentions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.operators.codes import code_rule
from cohortspark.operators.episodes import tag_episodes, tag_positive
from cohortspark.operators.stays import enrich_stays
from cohortspark.params import StudyParams
from cohortspark.plans.registry import Registry, Staged
from cohortspark.sources import adapters
from cohortspark.sources.tables import read_table

P = StudyParams()

# fixed values of the demo study: site lists used by the cohort / weight queries
TRAIN_SITES = ["NATION_0", "NATION_1", "NATION_2", "NATION_3", "NATION_4", "NATION_5", "NATION_6", "NATION_7"]
TEST_SITES = ["NATION_8", "NATION_9", "NATION_10", "NATION_11", "NATION_12"]


def patients_with_site(spark: SparkSession, d: str) -> DataFrame:
    """Patients plus the site of their stays (customer nation and its region); one scan of
    customer. nation and region have a fixed size (25 / 5 rows): broadcast."""
    n = read_table(spark, d, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    r = read_table(spark, d, "region", ["r_regionkey", "r_name"])
    dim = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(
        "n_nationkey", F.col("n_name").alias("site_label"), F.col("r_name").alias("site_type"))
    return adapters.patients(spark, d, extra=["c_nationkey"]).join(
        F.broadcast(dim), F.col("c_nationkey") == F.col("n_nationkey"), "left").drop("c_nationkey", "n_nationkey")


def stays(spark: SparkSession, d: str, params: StudyParams = P) -> DataFrame:
    return enrich_stays(adapters.visits(spark, d), patients_with_site(spark, d), params)


def claim_positive(spark: SparkSession, d: str) -> DataFrame:
    return code_rule(adapters.claims(spark, d), "two_part")


def stays_by_source(spark: SparkSession, d: str, source: str = "all", params: StudyParams = P) -> DataFrame:
    """Stays with ``positive_visit`` and ``recurrent_visit`` for one outcome source. Episodes are
    tagged on the visits alone, before the patient columns are joined; of a source that marks some stays
    only these are windowed, and the tags are joined back."""
    v = adapters.visits(spark, d)
    if source == "all":
        tagged = tag_episodes(v.withColumn("positive_visit", F.lit(True)), params)
    elif source == "claims":
        tagged = tag_positive(v, claim_positive(spark, d).select("encounter_num"), params)
    elif source in ("text", "ml", "model"):
        tagged = tag_positive(v, text_stays(spark, d, "rule" if source == "text" else source).where("nlp_positive").select(
            "encounter_num", "has_history"), params)
    else:
        raise ValueError(f"unknown source {source!r}")
    return enrich_stays(tagged, patients_with_site(spark, d), params)


# ---------------------------------------------------------------- text path
#
# The steps that several analyses need are stage tables: the chosen notes without their texts, the visits of their
# stays, the selected notes (the only reads of the documents), their mentions, their dates, and the mentions
# linked to dates.

def _files(d: str, *names: str) -> list[str]:
    return [f"{d.rstrip('/')}/{n}.parquet" for n in names]


def chosen_stage(spark: SparkSession, d: str, method: str = "keep_last") -> Staged:
    """One note per stay (W1/W2), chosen on the narrow columns."""
    from cohortspark.operators import cohort

    return Registry(spark).stage("chosen", lambda: cohort.select_one_note(adapters.notes(spark, d, with_text=False), method, P),
                                 _files(d, "documents", "orders"), params=(method, P))


def visit_stage(spark: SparkSession, d: str, method: str = "keep_last") -> Staged:
    """The visits of the stays that have a chosen note, all rows of each: what the joins of notes, dates and
    mentions with the visits need, so that they do not shuffle the other stays."""
    chosen = chosen_stage(spark, d, method)
    return Registry(spark).stage("visits", lambda: adapters.visits(spark, d).select("encounter_num", "patient_num", "visit_start_date").join(
        chosen.df.select("encounter_num"), "encounter_num", "left_semi"), _files(d, "orders"), [chosen])


def note_stage(spark: SparkSession, d: str, method: str = "keep_last") -> Staged:
    """The chosen notes that match a lexicon of the study: only their texts are read, filtered and joined."""
    from cohortspark.operators import cohort, text

    words = [cohort.combined_pattern(x) for x in (text.LEXICON, RF_LEXICON)]
    chosen, v = chosen_stage(spark, d, method), visit_stage(spark, d, method)
    return Registry(spark).stage("notes", lambda: cohort.select_note_texts(
        adapters.notes(spark, d, chosen=chosen.df, stays=v.df), words, method, P, by_stay=True, picked=chosen.df),
        _files(d, "documents"), [chosen, v], (method, P, words))


def _note_visits(spark: SparkSession, d: str, notes: DataFrame | None) -> DataFrame:
    """The visits that the stays of the selected notes, or of ``notes``, are among."""
    return visit_stage(spark, d).df if notes is None else adapters.visits(spark, d)


def selected_notes(spark: SparkSession, d: str, method: str = "keep_last") -> DataFrame:
    """One note per stay, then the lexicon filter (P3): selection precedes the regex."""
    from cohortspark.operators import cohort, text

    return cohort.regex_filter(note_stage(spark, d, method).df, text.LEXICON)


def mention_stage(spark: SparkSession, d: str) -> Staged:
    from cohortspark.operators import text

    return Registry(spark).stage("mentions", lambda: text.mentions(selected_notes(spark, d), keep_cols=("encounter_num",)), [],
                                 [note_stage(spark, d)], (text.LEXICON, text.CUES))


def text_mentions(spark: SparkSession, d: str, notes: DataFrame | None = None) -> DataFrame:
    """Mentions of the selected notes, or of ``notes`` (a stage table of them)."""
    from cohortspark.operators import text

    return mention_stage(spark, d).df if notes is None else text.mentions(notes, keep_cols=("encounter_num",))


# fixed values: words of the demo risk factors
RF_WORDS = ["pain", "douleur", "home", "soins", "review"]
RF_LEXICON = {w: r"(?iu)(?<![\p{L}\p{N}_])" + w + r"(?![\p{L}\p{N}_])" for w in RF_WORDS}


def date_mentions(spark: SparkSession, d: str, notes: DataFrame | None = None) -> DataFrame:
    return date_stage(spark, d).df if notes is None else _dates_of(notes)


def _dates_of(notes: DataFrame) -> DataFrame:
    from cohortspark.operators import dates

    return dates.date_mentions(notes.select("note_id", "encounter_num", "note_text"), keep_cols=("encounter_num",))


def date_stage(spark: SparkSession, d: str) -> Staged:
    return Registry(spark).stage("dates", lambda: _dates_of(selected_notes(spark, d)), [], [note_stage(spark, d)])


def resolved_dates(spark: SparkSession, d: str, notes: DataFrame | None = None) -> DataFrame:
    from cohortspark.operators import dates

    v = _note_visits(spark, d, notes).select("encounter_num", "visit_start_date")
    return dates.resolve_relative(date_mentions(spark, d, notes).join(v, "encounter_num", "left"))


def clean_dates(spark: SparkSession, d: str, notes: DataFrame | None = None) -> DataFrame:
    from cohortspark.operators import dates

    p = adapters.patients(spark, d).select("patient_num", "birth_date")
    v = _note_visits(spark, d, notes).select("encounter_num", "patient_num")
    x = resolved_dates(spark, d, notes).join(v, "encounter_num", "left").join(p, "patient_num", "left")
    return dates.clean_dates(x).select("note_id", "encounter_num", "label", "start_char", "start", "sent_id", "date_dt", "is_birth_date")


def linked_mentions(spark: SparkSession, d: str, notes: DataFrame | None = None) -> DataFrame:
    """Mentions with the nearest date of their sentence by token distance (J7, X11); ``history`` is
    set where that date lies long enough before the stay."""
    from cohortspark.operators import dates

    dm = clean_dates(spark, d, notes).select("note_id", "sent_id", "start", F.col("start_char").alias("date_id"), "date_dt", "is_birth_date")
    linked = dates.asof_nearest(text_mentions(spark, d, notes), dm, ["note_id", "sent_id"], "start", "date_id", ("date_dt", "is_birth_date"))
    v = _note_visits(spark, d, notes).select("encounter_num", "visit_start_date")
    return dates.history_by_date(linked.join(v, "encounter_num", "left"), P)


#: columns of a linked mention that flags, scores and roll-ups take; words and snippets stay in the mentions' stage
LINKED = ["note_id", "encounter_num", "std_lexical_variant", "start_char", "end_char", "negation", "hypothesis", "family", "history", "rspeech"]


def link_stage(spark: SparkSession, d: str) -> Staged:
    """The linked mentions without words and snippets, so that the shuffles of the link do not carry them."""
    return Registry(spark).stage("linked", lambda: linked_mentions(spark, d).select(*LINKED), _files(d, "orders", "customer"),
                                 [mention_stage(spark, d), date_stage(spark, d), visit_stage(spark, d)], P)


def mention_model(spark: SparkSession, d: str) -> tuple[str, str]:
    """(version, folder) of the trained mention model: annotator A's labels of the mentions' notes. The
    version is the digest of mentions, labels and settings; a model that is there is not trained again."""
    from cohortspark.operators import scoring

    mentions = mention_stage(spark, d)
    gold = adapters.annotations(spark, d).where("annotator = 'A'").select("note_id", F.col("gold").alias("label"))
    train = mentions.df.select("note_id", "words").join(gold, "note_id")
    registry = Registry(spark)
    version = registry.address("model", lambda: train, _files(d, "labels"), [mentions], scoring.SETTINGS)
    return version, registry.made("model", version, lambda folder: scoring.train_mention_model(train).write().save(folder))


def model_scores(spark: SparkSession, d: str) -> Staged:
    """The score table: each mention scored once by the saved model, keyed by (note_id, start_char, end_char,
    model_version)."""
    from cohortspark.operators import scoring

    version, folder = mention_model(spark, d)
    mentions = mention_stage(spark, d)
    keys = ["note_id", "start_char", "end_char"]

    def scored():
        x = scoring.score_mentions(scoring.load_mention_model(folder), mentions.df.select(*keys, "words"))
        return x.select(*keys, F.lit(version).alias("model_version"), F.col("ml_prediction").alias("prediction"),
                        F.col("ml_probability").alias("probability"))

    return Registry(spark).stage("scores", scored, [], [mentions], version)


def mention_scores(mentions: DataFrame) -> DataFrame:
    """Stand-in model scores keyed like the mentions (arithmetic, so that SQL can follow)."""
    return mentions.select("note_id", "start_char", "end_char", ((F.col("note_id") + F.col("start_char")) % 4 == 0).alias("prediction"))


def flagged_mentions(spark: SparkSession, d: str, method: str = "rule") -> DataFrame:
    """Mentions with the date-based history, then P12/P13. Method 'ml' and 'model': the joined score is the
    instance flag (J12), arithmetic that SQL can follow or the saved model's."""
    from cohortspark.operators.stays import flag_mentions

    m = flag_mentions(link_stage(spark, d).df)
    if method == "rule":
        return m
    keys = ["note_id", "start_char", "end_char"]
    scores = mention_scores(text_mentions(spark, d)) if method == "ml" else model_scores(spark, d).df.select(*keys, "prediction")
    return m.join(scores, keys, "left").withColumn("instance_flag", F.coalesce("prediction", F.lit(False)))


def text_stays(spark: SparkSession, d: str, method: str = "rule") -> DataFrame:
    """Mention roll-up per stay (A1/A2/P15) by the rule or by the model score."""
    from cohortspark.operators.stays import stay_rollup

    return stay_rollup(flagged_mentions(spark, d, method), P)


def rf_flag_stays(spark: SparkSession, d: str) -> DataFrame:
    """Risk-factor flags of the text-positive stays, from the RF lexicon in those stays' notes."""
    from cohortspark.operators import cohort, text
    from cohortspark.operators.stays import rf_flags, rf_mention_filter

    positive = text_stays(spark, d).where("nlp_positive").select("encounter_num")
    notes = cohort.regex_filter(cohort.notes_of_stays(note_stage(spark, d).df, positive), RF_LEXICON)
    m = text.mentions(notes, RF_LEXICON, keep_cols=("encounter_num",))
    kept = rf_mention_filter(m, None, ["negation", "hypothesis"]).withColumnRenamed("std_lexical_variant", "rf_name")
    return rf_flags(positive, kept, list(RF_LEXICON))
