"""Registered queries: each is (spark, sf_dir) -> DataFrame over the driver tables, paired
with an independent DuckDB SQL oracle when the operator is expressible in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.functions.columns import safe_ratio
from cohortspark.operators import codes, cohort, incidence
from cohortspark.plans import oracle as O
from cohortspark.plans import study
from cohortspark.plans.study import P
from cohortspark.sources import adapters
from cohortspark.sources.adapters import SQL as A
from cohortspark.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _bigint_counts(sql: str) -> str:
    """DuckDB types count_if as HUGEINT; Spark's count_if is a bigint. Wrap each call."""
    out, i, key = [], 0, "count_if("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 0, j + len(key) - 1
        while True:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            if depth == 0:
                break
            k += 1
        end = k + 1
        tail = sql[end:end + 8].strip().upper()
        out.append(sql[i:j])
        inner = _bigint_counts(sql[j + len(key):k])
        out.append(f"count_if({inner})" if tail.startswith("OVER") else f"CAST(count_if({inner}) AS BIGINT)")
        i = end


def rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    """Result columns rounded for the comparison with SQL; the operators don't round."""
    return df.withColumns({c: F.round(c, digits) for c in cols})


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = _bigint_counts(sql)
        return fn

    return deco


# ---------------------------------------------------------------- step 0: minimum slice

@register("episodes", O.stays_source("all") + """
SELECT encounter_num, patient_num, visit_start_date, visit_end_date, recurrent_visit FROM ep""")
def q_episodes(spark, d):
    return study.stays_by_source(spark, d, "all").select(
        "encounter_num", "patient_num", "visit_start_date", "visit_end_date", "recurrent_visit"
    )


@register("age_band", "WITH " + O.STAYS + """
SELECT encounter_num, patient_num, birth_date, age, age_cat FROM stays""")
def q_age_band(spark, d):
    return study.stays(spark, d).select("encounter_num", "patient_num", "birth_date", "age", "age_cat")


def monthly_incidence(spark, d, source="all"):
    st = incidence.outcome_stays(study.stays_by_source(spark, d, source))
    return incidence.monthly_table(st, ["sex_cd", "age_cat"], P)


@register("monthly_incidence", O.stays_source("all") + """,
agg AS (SELECT sex_cd, age_cat, date, count(*) AS n_sa, count_if(death) AS death,
               avg(duration_seconds) / 86400.0 AS mean_duration
        FROM ep WHERE """ + O.OUTCOME + """ GROUP BY ALL),
months AS (SELECT DISTINCT date FROM ep WHERE """ + O.OUTCOME + """),
grid AS (SELECT date, sex_cd, age_cat FROM months,
         (VALUES ('M'), ('W')) s(sex_cd), (VALUES ('8-17'), ('18-25'), ('26-65'), ('66-120')) a(age_cat))
SELECT sex_cd, age_cat, date, coalesce(n_sa, 0) AS n_sa, coalesce(death, 0) AS death, mean_duration,
       CAST(month(date) AS INTEGER) AS month, CAST(year(date) AS INTEGER) AS year, monthname(date) AS month_name,
       CASE WHEN coalesce(n_sa, 0) = 0 THEN NULL ELSE coalesce(death, 0) / n_sa END AS death_ratio
FROM grid LEFT JOIN agg USING (date, sex_cd, age_cat)""")
def q_monthly_incidence(spark, d):
    return monthly_incidence(spark, d, "all")


# ---------------------------------------------------------------- step 1: cohort

COHORT_TYPES = ["1-URGENT", "2-HIGH"]


@register("cohort_filter", "WITH " + A["visits"] + ", " + A["stay_sites"] + """
SELECT v.*, s.site_label FROM visits v JOIN (
  SELECT encounter_num, min(site_label) AS site_label FROM stay_sites
  WHERE site_label IN ('NATION_0','NATION_1','NATION_2','NATION_3','NATION_4','NATION_5','NATION_6','NATION_7')
  GROUP BY encounter_num) s USING (encounter_num)
WHERE visit_type IN ('1-URGENT', '2-HIGH') AND admission_mode IN ('F', 'O')
  AND visit_start_date >= TIMESTAMP '1996-01-01' AND visit_start_date < TIMESTAMP '2000-01-01'""")
def q_cohort_filter(spark, d):
    return cohort.cohort_filter(
        adapters.visits(spark, d), adapters.stay_sites(spark, d),
        admission_modes=["F", "O"], visit_types=COHORT_TYPES, date_from="1996-01-01", date_to="2000-01-01",
        site_labels=study.TRAIN_SITES,
    )


def _with_source(df, key: str):
    """Demo source systems: one row in four comes from billing, the others from the wards."""
    return df.withColumn("sourcesystem_cd", F.when(F.col(key) % 4 == 0, "BILLING").otherwise("WARD"))


@register("cohort_filter_source", "WITH " + A["visits"] + """
SELECT *, 'WARD' AS sourcesystem_cd FROM visits
WHERE encounter_num % 4 <> 0 AND visit_type IN ('1-URGENT', '2-HIGH') AND visit_start_date >= TIMESTAMP '1996-01-01'""")
def q_cohort_filter_source(spark, d):
    """P1 with the source-system condition."""
    return cohort.cohort_filter(_with_source(adapters.visits(spark, d), "encounter_num"), visit_types=COHORT_TYPES, date_from="1996-01-01",
                                source_systems=["WARD"])


NOTE_CATS = [f"src{i}" for i in range(0, 12)]


@register("note_filter", "WITH " + A["visits"] + ", " + A["notes"] + """
SELECT note_id, encounter_num, patient_num, note_category, document_datetime FROM notes
WHERE note_category IN ('src0','src1','src2','src3','src4','src5','src6','src7','src8','src9','src10','src11')
  AND note_category NOT IN ('src3', 'src4')
  AND encounter_num IN (SELECT encounter_num FROM visits WHERE visit_type IN ('1-URGENT', '2-HIGH'))""")
def q_note_filter(spark, d):
    v = adapters.visits(spark, d).where(F.col("visit_type").isin(*COHORT_TYPES))
    n = adapters.notes(spark, d, with_text=False)
    return cohort.note_filter(n, categories=NOTE_CATS, encounter_subset=v, exclude_categories=["src3", "src4"])


# fixed values: demo outcome lexicon (label -> pattern); frequent words of the driver's texts
LEXICON = {"with": r"\bwith\b", "from": r"\bfrom\b", "pour": r"\bpour\b", "dans": r"\bdans\b", "avec": r"\bavec\b"}


@register("regex_filter", "WITH " + A["visits"] + ", " + A["notes"] + r"""
SELECT note_id, encounter_num FROM notes
WHERE regexp_matches(note_text, '(\bwith\b)|(\bfrom\b)|(\bpour\b)|(\bdans\b)|(\bavec\b)')""")
def q_regex_filter(spark, d):
    return cohort.regex_filter(adapters.notes(spark, d), LEXICON).select("note_id", "encounter_num")


@register("patient_enrich", "WITH " + A["visits"] + ", " + A["patients"] + """
SELECT v.encounter_num, v.patient_num, p.birth_date, p.sex_cd FROM visits v LEFT JOIN patients p USING (patient_num)""")
def q_patient_enrich(spark, d):
    v = adapters.visits(spark, d).select("encounter_num", "patient_num")
    return cohort.patient_enrich(v, adapters.patients(spark, d))


def _keep_sql(order: str) -> str:
    return "WITH " + A["visits"] + ", " + A["notes"] + f""",
r AS (SELECT note_id, encounter_num, patient_num, note_category, document_datetime,
             count(*) OVER (PARTITION BY encounter_num) AS n_docs_per_visit,
             row_number() OVER (PARTITION BY encounter_num ORDER BY
                 CASE WHEN note_category IS NULL OR note_category = 'src0' THEN 0 ELSE 1 END DESC,
                 document_datetime {order}, note_id DESC) AS rn
      FROM notes)
SELECT encounter_num, note_id, patient_num, note_category, document_datetime, n_docs_per_visit FROM r WHERE rn = 1"""


def _keep(spark, d, method):
    n = adapters.notes(spark, d, with_text=False)
    return cohort.select_one_note(n, method, P)


@register("keep_last", _keep_sql("DESC"))
def q_keep_last(spark, d):
    return _keep(spark, d, "keep_last")


@register("keep_first", _keep_sql("ASC"))
def q_keep_first(spark, d):
    return _keep(spark, d, "keep_first")


@register("keep_last_text", "WITH " + A["visits"] + ", " + A["notes"] + r""",
r AS (SELECT *, count(*) OVER (PARTITION BY encounter_num) AS n_docs_per_visit,
             row_number() OVER (PARTITION BY encounter_num ORDER BY
                 CASE WHEN note_category IS NULL OR note_category = 'src0' THEN 0 ELSE 1 END DESC,
                 document_datetime DESC, note_id DESC) AS rn
      FROM notes)
SELECT encounter_num, note_id, note_category, n_docs_per_visit, md5(note_text) AS text_md5 FROM r
WHERE rn = 1 AND regexp_matches(note_text, '(\bwith\b)|(\bfrom\b)|(\bpour\b)|(\bdans\b)|(\bavec\b)')""")
def q_keep_last_text(spark, d):
    n = cohort.select_note_texts(adapters.notes(spark, d), LEXICON, "keep_last", P)
    return n.select("encounter_num", "note_id", "note_category", "n_docs_per_visit", F.md5("note_text").alias("text_md5"))


@register("notes_per_stay", "WITH " + A["visits"] + ", " + A["notes"] + """
SELECT note_id, encounter_num, count(*) OVER (PARTITION BY encounter_num) AS n_docs_per_visit FROM notes""")
def q_notes_per_stay(spark, d):
    n = adapters.notes(spark, d, with_text=False).select("note_id", "encounter_num")
    return cohort.notes_per_stay(n)


@register("dedup_first", "WITH " + A["claims"] + """
SELECT encounter_num, instance_num, diag_type, concept_cd FROM (
  SELECT *, row_number() OVER (PARTITION BY encounter_num, diag_type ORDER BY concept_cd, instance_num) AS rn
  FROM claims) WHERE rn = 1""")
def q_dedup_first(spark, d):
    return cohort.dedup_first(adapters.claims(spark, d), ["encounter_num", "diag_type"], ["concept_cd", "instance_num"])


@register("notes_of_positive_stays", "WITH " + A["visits"] + ", " + A["notes"] + ", " + O.CLAIM_POS.strip() + """
SELECT note_id, encounter_num, note_category FROM notes WHERE encounter_num IN (SELECT encounter_num FROM claim_pos)""")
def q_notes_of_positive_stays(spark, d):
    n = adapters.notes(spark, d, with_text=False).select("note_id", "encounter_num", "note_category")
    return cohort.notes_of_stays(n, study.claim_positive(spark, d))


@register("demographic_exclusions", "WITH " + O.STAYS + """
SELECT count_if(age IS NULL OR age < 0) AS n_stays_missing_age,
       count(DISTINCT CASE WHEN age IS NULL OR age < 0 THEN patient_num END) AS n_patients_missing_age,
       count_if(sex_cd IN ('Unknown', 'U')) AS n_stays_missing_sex,
       count(DISTINCT CASE WHEN sex_cd IN ('Unknown', 'U') THEN patient_num END) AS n_patients_missing_sex,
       count_if(age >= 0 AND age_cat = 'Unknown') AS n_stays_out_of_range,
       count(DISTINCT CASE WHEN age >= 0 AND age_cat = 'Unknown' THEN patient_num END) AS n_patients_out_of_range
FROM stays""")
def q_demographic_exclusions(spark, d):
    return incidence.demographic_exclusions(study.stays(spark, d))


ATTRITION_SQL = O.stays_source("claims") + """,
f AS (SELECT patient_num,
  true AS c1,
  date >= DATE '1995-01-01' AND date < DATE '2001-08-01' AS c2,
  visit_type IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AS c3,
  positive_visit AS c4,
  sex_cd NOT IN ('Unknown', 'U') AND age_cat <> 'Unknown' AS c5,
  NOT recurrent_visit AS c6 FROM ep),
g AS (SELECT patient_num, count_if(c1) AS s0, count_if(c1 AND c2) AS s1, count_if(c1 AND c2 AND c3) AS s2,
             count_if(c1 AND c2 AND c3 AND c4) AS s3, count_if(c1 AND c2 AND c3 AND c4 AND c5) AS s4,
             count_if(c1 AND c2 AND c3 AND c4 AND c5 AND c6) AS s5 FROM f GROUP BY patient_num),
w AS (SELECT sum(s0) AS s0, sum(s1) AS s1, sum(s2) AS s2, sum(s3) AS s3, sum(s4) AS s4, sum(s5) AS s5,
             count_if(s0 > 0) AS p0, count_if(s1 > 0) AS p1, count_if(s2 > 0) AS p2, count_if(s3 > 0) AS p3,
             count_if(s4 > 0) AS p4, count_if(s5 > 0) AS p5 FROM g)
SELECT 1 AS step, 'all stays' AS criterion, CAST(s0 AS BIGINT) AS n_stays, p0 AS n_patients FROM w
UNION ALL SELECT 2, 'study window', CAST(s1 AS BIGINT), p1 FROM w
UNION ALL SELECT 3, 'visit type', CAST(s2 AS BIGINT), p2 FROM w
UNION ALL SELECT 4, 'positive', CAST(s3 AS BIGINT), p3 FROM w
UNION ALL SELECT 5, 'known sex and age', CAST(s4 AS BIGINT), p4 FROM w
UNION ALL SELECT 6, 'first of episode', CAST(s5 AS BIGINT), p5 FROM w"""


@register("attrition", ATTRITION_SQL)
def q_attrition(spark, d):
    st = study.stays_by_source(spark, d, "claims")
    steps = [
        ("all stays", F.lit(True)),
        ("study window", incidence.in_window(P)),
        ("visit type", F.col("visit_type").isin("1-URGENT", "2-HIGH", "3-MEDIUM")),
        ("positive", F.col("positive_visit")),
        ("known sex and age", incidence.known_demographics(P)),
        ("first of episode", ~F.col("recurrent_visit")),
    ]
    return cohort.attrition(st, steps)


# ---------------------------------------------------------------- step 2: codes

@register("code_range", "WITH " + A["claims"] + """
SELECT encounter_num, instance_num, diag_type, concept_cd, TRY_CAST(substr(concept_cd, 8, 2) AS INTEGER) AS code_number
FROM claims WHERE diag_type = 'DAS' AND substr(concept_cd, 7, 1) = 'X'
  AND TRY_CAST(substr(concept_cd, 8, 2) AS INTEGER) BETWEEN 60 AND 84""")
def q_code_range(spark, d):
    return codes.code_range(adapters.claims(spark, d), "X", 60, 84, "DAS")


@register("code_range_source", "WITH " + A["claims"] + """
SELECT encounter_num, instance_num, diag_type, concept_cd, 'BILLING' AS sourcesystem_cd, TRY_CAST(substr(concept_cd, 8, 2) AS INTEGER) AS code_number
FROM claims WHERE encounter_num % 4 = 0 AND substr(concept_cd, 7, 1) = 'S' AND TRY_CAST(substr(concept_cd, 8, 2) AS INTEGER) BETWEEN 0 AND 49""")
def q_code_range_source(spark, d):
    """P4 with the source-system condition."""
    return codes.code_range(_with_source(adapters.claims(spark, d), "encounter_num"), "S", 0, 49, source_system="BILLING")


@register("code_rule", "WITH " + O.CLAIM_POS.strip() + "\nSELECT encounter_num, number_codes FROM claim_pos")
def q_code_rule(spark, d):
    return study.claim_positive(spark, d)


@register("code_set", "WITH " + A["claims"] + """
SELECT encounter_num, list_sort(list_distinct(list(TRY_CAST(substr(concept_cd, 8, 2) AS INTEGER)))) AS number_codes
FROM claims WHERE substr(concept_cd, 7, 1) = 'T' AND TRY_CAST(substr(concept_cd, 8, 2) AS INTEGER) BETWEEN 0 AND 98
GROUP BY encounter_num""")
def q_code_set(spark, d):
    return codes.code_set(adapters.claims(spark, d), "T", 0, 98)


# ---------------------------------------------------------------- step 8: text

from cohortspark.operators import stays as stay_ops  # noqa: E402
from cohortspark.operators import text  # noqa: E402

MENTION_COLS = ["note_id", "encounter_num", "lexical_variant", "std_lexical_variant", "start_char", "end_char",
                "start", "end", "sent_id", "section", "words", "word_index",
                "snippet", "snippet_start", "snippet_end", "negation", "hypothesis", "family", "history", "rspeech"]


@register("mentions", "WITH " + O.MENTIONS + "\nSELECT " + ", ".join(
    f'"{c}"' for c in MENTION_COLS) + " FROM ments")
def q_mentions(spark, d):
    return study.text_mentions(spark, d).select(*MENTION_COLS)


@register("qualifiers", "WITH " + O.MENTIONS + """
SELECT note_id, start_char, negation, hypothesis, family, history, rspeech FROM ments""")
def q_qualifiers(spark, d):
    return study.text_mentions(spark, d).select("note_id", "start_char", *text.QUALIFIERS)


@register("token_window", "WITH " + O.MENTIONS + """
SELECT note_id, start_char, start, "end", words, word_index FROM ments""")
def q_token_window(spark, d):
    return study.text_mentions(spark, d).select("note_id", "start_char", "start", "end", "words", "word_index")


def _scopes_sql() -> str:
    """Scopes as intervals: every kind of cue is searched alone, phrases that overlap a longer one go."""
    rules, parts, flags = text.SCOPED_CUES, [], []
    kinds = {"masked": rules.masked, "stop": rules.stops}
    kinds |= {f"left_{c}": ws for c, ws in rules.left.items()} | {f"right_{c}": ws for c, ws in rules.right.items()}
    for kind, words in kinds.items():
        alts = "|".join(sorted((w.replace("'", "''") for w in words), key=len, reverse=True))
        parts.append(O.boundary_spans("note_text", alts, "q_" + kind, "sel", "note_id", O.WB, "(?i)"))
    every = " UNION ALL ".join(f"SELECT '{k}' AS kind, note_id, word, start_char FROM q_{k}" for k in kinds)
    for c in rules.classes():
        history = " OR coalesce(m.section IN ('was', 'history'), false)" if c == "history" else ""
        flags.append(f"""(EXISTS (SELECT 1 FROM qs c WHERE c.note_id = m.note_id AND c.kind = 'left_{c}' AND c.sent = m.sent_id AND c.start_char < m.start_char
            AND NOT EXISTS (SELECT 1 FROM qs s WHERE s.note_id = m.note_id AND s.kind = 'stop' AND s.start_char > c.start_char AND s.start_char < m.start_char))
          OR EXISTS (SELECT 1 FROM qs c WHERE c.note_id = m.note_id AND c.kind = 'right_{c}' AND c.sent = m.sent_id AND c.start_char >= m.end_char
            AND NOT EXISTS (SELECT 1 FROM qs s WHERE s.note_id = m.note_id AND s.kind = 'stop' AND s.start_char >= m.end_char AND s.start_char < c.start_char)){history}) AS {c}""")
    return "WITH " + O.MENTIONS + ",\n" + ",\n".join(parts) + f""",
qa AS ({every}),
qk AS (SELECT x.* FROM qa x WHERE NOT EXISTS (SELECT 1 FROM qa y WHERE y.note_id = x.note_id AND y.start_char < x.start_char + length(x.word)
         AND x.start_char < y.start_char + length(y.word) AND (y.start_char < x.start_char OR (y.start_char = x.start_char AND length(y.word) > length(x.word))))),
qs AS (SELECT k.*, len(list_filter(ss, lambda b: b <= k.start_char)) - 1 AS sent FROM qk k JOIN dst USING (note_id))
SELECT m.note_id, m.start_char, {', '.join(flags)} FROM ments m"""


@register("qualifier_scopes", _scopes_sql())
def q_qualifier_scopes(spark, d):
    """X6 with all kinds of cues: left and right, ends of scopes, phrases that are none."""
    m = text.mentions(study.selected_notes(spark, d), cues=text.SCOPED_CUES)
    return m.select("note_id", "start_char", *text.SCOPED_CUES.classes())


_NOISE_SQL = r"={3,}|-{3,}|_{3,}|\*{3,}|#{3,}|(?i:\bpage [0-9]+(?:/| of | sur )[0-9]+\b)"


@register("normalised_mentions", "WITH " + O.SELECTED_NOTES + f""",
nz AS (SELECT note_id, encounter_num, string_split_regex(note_text, '({_NOISE_SQL})|([ \\t\\n\\x0B\\f\\r]+)') AS g,
              regexp_extract_all(note_text, '({_NOISE_SQL})|([ \\t\\n\\x0B\\f\\r]+)') AS m FROM sel),
nw AS (SELECT *, list_transform(m, lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '') AS ws FROM nz),
nr AS (SELECT *, list_transform(range(1, len(m) + 1), lambda i: CASE WHEN ws[i] AND len(list_filter(range(greatest(1, i - 3), i),
         lambda j: ws[j] AND list_sum(list_transform(g[j + 1:i], lambda x: length(x))) = 0)) = 0 THEN ' ' ELSE '' END) AS r FROM nw),
nt AS (SELECT note_id, encounter_num, translate(translate(lower(list_reduce(list_transform(range(1, len(g) + 1), lambda i: g[i] || coalesce(r[i], '')), lambda a, b: a || b)),
         'àâäáãåçéèêëíìîïñóòôöõúùûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '’‘«»“”', repeat(chr(39), 2) || repeat(chr(34), 4)) AS note_text,
         list_transform(range(1, len(m) + 1), lambda i: {{'at': CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(r[1:i], lambda x: length(x))) AS BIGINT),
                        'more': length(m[i]) - length(r[i])}}) AS moves FROM nr),
""" + O.mention_ctes(O.LEX_WORDS, "nm", "nt").lstrip() + """
SELECT nm.note_id, nm.std_lexical_variant, nm.start_char, nm.end_char, nm.sent_id, nm.negation, nm.history,
       CAST(nm.start_char + coalesce(list_sum(list_transform(list_filter(moves, lambda v: v.at <= nm.start_char), lambda v: v.more)), 0) AS INTEGER) AS raw_start,
       CAST(nm.end_char + coalesce(list_sum(list_transform(list_filter(moves, lambda v: v.at <= nm.end_char - 1), lambda v: v.more)), 0) AS INTEGER) AS raw_end
FROM nm JOIN nt USING (note_id)""")
def q_normalised_mentions(spark, d):
    """X3, X2, X6 on normalised text: places in it and in the note."""
    n = text.normalised(study.selected_notes(spark, d))
    m = text.mentions(n, text_col="norm_text", align_col="alignment")
    return m.select("note_id", "std_lexical_variant", "start_char", "end_char", "sent_id", "negation", "history", "raw_start", "raw_end")


REGEX_SPAN_PATTERN = r"[A-Z][a-z]+"


@register("regex_spans", "WITH " + A["visits"] + ", " + A["notes"] + r""",
s0 AS (SELECT note_id, note_text, string_split_regex(note_text, '[A-Z][a-z]+') AS g,
              regexp_extract_all(note_text, '[A-Z][a-z]+') AS m FROM notes),
s1 AS (SELECT note_id, note_text, CAST(i - 1 AS INTEGER) AS match_index, m[i] AS match,
              CAST(list_sum(list_transform(g[1:i], lambda x: length(x)))
                   + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS INTEGER) AS start_char
       FROM s0, unnest(range(1, len(m) + 1)) r(i))
SELECT note_id, match_index, match, start_char, CAST(start_char + length(match) AS INTEGER) AS end_char,
       substr(note_text, greatest(start_char - 35, 0) + 1, start_char + length(match) + 35 - greatest(start_char - 35, 0)) AS snippet
FROM s1""")
def q_regex_spans(spark, d):
    return text.regex_spans(adapters.notes(spark, d), REGEX_SPAN_PATTERN)


@register("normalise_text", "WITH " + A["visits"] + ", " + A["notes"] + """
SELECT note_id, regexp_replace(translate(translate(lower(note_text), 'àâäáãåçéèêëíìîïñóòôöõúùûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'),
       '’‘«»“”', '''''""""'), '\\s+', ' ', 'g') AS norm_text FROM notes""")
def q_normalise_text(spark, d):
    return adapters.notes(spark, d).select("note_id", text.normalise_text(F.col("note_text")).alias("norm_text"))


@register("sentences", "WITH " + A["visits"] + ", " + A["notes"] + r""",
s0 AS (SELECT note_id, string_split_regex(note_text, '[^.!?\n]+[.!?]*') AS g,
              regexp_extract_all(note_text, '[^.!?\n]+[.!?]*') AS m FROM notes),
s1 AS (SELECT note_id, CAST(i - 1 AS INTEGER) AS sent_id, m[i] AS sentence,
              CAST(list_sum(list_transform(g[1:i], lambda x: length(x)))
                   + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS INTEGER) AS start_char
       FROM s0, unnest(range(1, len(m) + 1)) r(i))
SELECT note_id, sent_id, start_char, CAST(start_char + length(sentence) AS INTEGER) AS end_char, sentence FROM s1""")
def q_sentences(spark, d):
    return text.sentences(adapters.notes(spark, d))


@register("sections", "WITH " + A["visits"] + ", " + A["notes"] + r""",
s0 AS (SELECT note_id, note_text, string_split_regex(note_text, '(?m)^[\p{L}\p{N}][\p{L}\p{N} ''’/()-]*:') AS g,
              regexp_extract_all(note_text, '(?m)^[\p{L}\p{N}][\p{L}\p{N} ''’/()-]*:') AS m FROM notes),
s1 AS (SELECT note_id, note_text, CAST(i - 1 AS INTEGER) AS section_index, regexp_replace(m[i], ':$', '') AS section,
              CAST(list_sum(list_transform(g[1:i], lambda x: length(x)))
                   + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS INTEGER) AS start_char
       FROM s0, unnest(range(1, len(m) + 1)) r(i))
SELECT note_id, section_index, section, start_char,
       CAST(coalesce(lead(start_char) OVER (PARTITION BY note_id ORDER BY section_index), length(note_text)) AS INTEGER) AS end_char
FROM s1""")
def q_sections(spark, d):
    return text.sections(adapters.notes(spark, d))


def _overlap_spans(spark, d):
    """Two span families that overlap: capitalised words and the lexicon/cue words."""
    n = adapters.notes(spark, d)
    a = text.regex_spans(n, REGEX_SPAN_PATTERN).select("note_id", "start_char", "end_char", F.lit("cap").alias("label"))
    b = text.regex_spans(n, r"[a-z]+[.!?] [A-Z][a-z]+").select(
        "note_id", "start_char", "end_char", F.lit("pair").alias("label"))
    return a.unionByName(b)


def _pattern_spans(name: str, pattern: str) -> str:
    return f"""{name}0 AS (SELECT note_id, string_split_regex(note_text, '{pattern}') AS g, regexp_extract_all(note_text, '{pattern}') AS m FROM notes),
{name} AS (SELECT note_id, '{name}' AS label, m[i] AS match,
             CAST(list_sum(list_transform(g[1:i], lambda x: length(x)))
                  + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS INTEGER) AS start_char
           FROM {name}0, unnest(range(1, len(m) + 1)) r(i))"""


#: greedy choice by recursion over the spans of a cluster of overlapping spans, longest first
SPAN_SQL = "WITH RECURSIVE " + A["visits"] + ", " + A["notes"] + ", " + _pattern_spans("cap", "[A-Z][a-z]+") + ", " + _pattern_spans(
    "pair", "[a-z]+[.!?] [A-Z][a-z]+") + """,
sp AS (SELECT note_id, label, start_char, CAST(start_char + length(match) AS INTEGER) AS end_char
       FROM (SELECT * FROM cap UNION ALL SELECT * FROM pair)),
s1 AS (SELECT *, CASE WHEN start_char < max(end_char) OVER (PARTITION BY note_id ORDER BY start_char, end_char
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM sp),
s2 AS (SELECT *, sum(opens) OVER (PARTITION BY note_id ORDER BY start_char, end_char ROWS UNBOUNDED PRECEDING) AS cluster FROM s1),
sr AS (SELECT *, row_number() OVER (PARTITION BY note_id, cluster ORDER BY start_char - end_char, start_char, end_char, label) AS rn FROM s2),
gr(note_id, cluster, rn, kept) AS (
  SELECT note_id, cluster, rn, [{'s': start_char, 'e': end_char, 'l': label}] FROM sr WHERE rn = 1
  UNION ALL
  SELECT gr.note_id, gr.cluster, sr.rn, CASE WHEN len(list_filter(gr.kept, lambda k: k.s < sr.end_char AND sr.start_char < k.e)) > 0
         THEN gr.kept ELSE list_append(gr.kept, {'s': sr.start_char, 'e': sr.end_char, 'l': sr.label}) END
  FROM gr JOIN sr ON sr.note_id = gr.note_id AND sr.cluster = gr.cluster AND sr.rn = gr.rn + 1),
kp AS (SELECT note_id, k.s AS start_char, k.e AS end_char, k.l AS label
       FROM (SELECT note_id, cluster, arg_max(kept, rn) AS kept FROM gr GROUP BY note_id, cluster), unnest(kept) u(k))"""


@register("span_filter", SPAN_SQL + "\nSELECT * FROM kp")
def q_span_filter(spark, d):
    return text.span_filter(_overlap_spans(spark, d))


@register("mention_stats", "WITH " + O.MENTIONS + """
SELECT avg(n) AS mean_mentions_per_note, count(*) AS n_notes, count(DISTINCT encounter_num) AS n_stays,
       count(DISTINCT patient_num) AS n_patients
FROM (SELECT m.note_id, count(*) AS n, any_value(m.encounter_num) AS encounter_num, any_value(s.patient_num) AS patient_num
      FROM ments m JOIN sel s USING (note_id) GROUP BY m.note_id)""")
def q_mention_stats(spark, d):
    m = study.text_mentions(spark, d)
    pat = adapters.visits(spark, d).select("encounter_num", "patient_num")
    return text.mention_stats(m.join(pat, "encounter_num"))


@register("stays_per_term", "WITH " + O.MENTIONS + """
SELECT std_lexical_variant, count(DISTINCT encounter_num) AS n_stays FROM ments GROUP BY 1""")
def q_stays_per_term(spark, d):
    return text.stays_per_term(study.text_mentions(spark, d))


@register("cooccurrence", "WITH " + O.MENTIONS + """,
st AS (SELECT DISTINCT encounter_num, std_lexical_variant AS t FROM ments)
SELECT a.t AS term_1, b.t AS term_2, count(*) AS n_stays FROM st a JOIN st b USING (encounter_num)
WHERE a.t <= b.t GROUP BY 1, 2""")
def q_cooccurrence(spark, d):
    return text.cooccurrence(study.text_mentions(spark, d))


@register("exclusive_terms", "WITH " + O.MENTIONS + """
SELECT any_value(std_lexical_variant) AS std_lexical_variant, count(*) AS n_stays FROM (
  SELECT encounter_num, any_value(std_lexical_variant) AS std_lexical_variant FROM ments
  GROUP BY encounter_num HAVING count(DISTINCT std_lexical_variant) = 1) GROUP BY std_lexical_variant""")
def q_exclusive_terms(spark, d):
    return text.exclusive_terms(study.text_mentions(spark, d))


# ---------------------------------------------------------------- step 3: stays

@register("mention_flag", "WITH " + O.MENTIONS + """
SELECT note_id, start_char, instance_flag, history_flag FROM fm""")
def q_mention_flag(spark, d):
    return study.flagged_mentions(spark, d).select("note_id", "start_char", "instance_flag", "history_flag")


@register("stay_rollup", "WITH " + O.MENTIONS + "\nSELECT * FROM tstays")
def q_stay_rollup(spark, d):
    return study.text_stays(spark, d)


CARRIED = ["patient_num", "visit_start_date", "visit_end_date", "site_label", "admission_mode", "discharge_mode", "birth_date", "sex_cd", "visit_type"]


@register("stay_table", "WITH " + O.MENTIONS + ",\n" + O.STAYS.strip().replace(A["visits"] + ",", "", 1) + """,
nd AS (SELECT encounter_num, count(*) AS n_docs_per_visit FROM notes GROUP BY encounter_num),
nc AS (SELECT encounter_num, list_sort(list_distinct(list(note_category))) AS concept_cds FROM sel GROUP BY encounter_num)
SELECT t.*, nc.concept_cds, nd.n_docs_per_visit, """ + ", ".join("s." + c for c in CARRIED) + """
FROM tstays t JOIN nc USING (encounter_num) JOIN nd USING (encounter_num) JOIN stays s USING (encounter_num)""")
def q_stay_table(spark, d):
    """A1 with the carried stay columns and the note categories."""
    return stay_ops.stay_table(study.text_stays(spark, d), study.selected_notes(spark, d), study.stays(spark, d), CARRIED)


@register("positive_terms", "WITH " + O.MENTIONS + """
SELECT encounter_num, std_positive_lexical_variants FROM tstays""")
def q_positive_terms(spark, d):
    return study.text_stays(spark, d).select("encounter_num", "std_positive_lexical_variants")


@register("score_join", "WITH " + O.MENTIONS + """
SELECT note_id, start_char, end_char, std_lexical_variant, (note_id + start_char) % 4 = 0 AS prediction FROM ments""")
def q_score_join(spark, d):
    from cohortspark.operators.joins import checked_join

    m = study.text_mentions(spark, d).select("note_id", "start_char", "end_char", "std_lexical_variant")
    return checked_join(m, study.mention_scores(m), ["note_id", "start_char", "end_char"], "left", "1:1")


RF_NAMES = list(study.RF_LEXICON)


def rf_flag_stays(spark, d):
    """Per text-positive stay one flag per risk factor; RF mentions come from the RF lexicon in the
    notes of those stays, kept by P9 (a negated or hypothetical mention is dropped)."""
    return study.rf_flag_stays(spark, d)


RF_SQL = "WITH " + O.MENTIONS + ", " + O.mention_ctes("|".join(RF_NAMES), "rfm", "sel_pos", """
sel_pos AS (SELECT * FROM all_sel WHERE encounter_num IN (SELECT encounter_num FROM tstays WHERE nlp_positive))""") + """,
rfk AS (SELECT DISTINCT encounter_num, std_lexical_variant AS rf FROM rfm WHERE NOT (negation OR hypothesis)),
rff AS (SELECT t.encounter_num, """ + ", ".join(
    f"coalesce(bool_or(rf = '{r}'), false) AS \"{r}\"" for r in RF_NAMES) + """
        FROM tstays t LEFT JOIN rfk USING (encounter_num) WHERE t.nlp_positive GROUP BY t.encounter_num)"""


@register("rf_flags", RF_SQL + "\nSELECT * FROM rff")
def q_rf_flags(spark, d):
    return rf_flag_stays(spark, d)


@register("rf_stays_long", RF_SQL + "\n" + "\nUNION ALL ".join(
    f"SELECT encounter_num, '{r}' AS rf_name, \"{r}\" AS value, CAST(encounter_num AS VARCHAR) || '-{r}' AS stay_rf_id FROM rff"
    for r in RF_NAMES))
def q_rf_stays_long(spark, d):
    return stay_ops.rf_stays_long(rf_flag_stays(spark, d), RF_NAMES)


@register("rule_only_stays", "WITH " + O.MENTIONS + """
SELECT encounter_num, n_positive_mentions FROM tstays
WHERE nlp_positive AND encounter_num NOT IN (SELECT encounter_num FROM mlstays WHERE nlp_positive)""")
def q_rule_only_stays(spark, d):
    rule = study.text_stays(spark, d).where("nlp_positive").select("encounter_num", "n_positive_mentions")
    ml = study.text_stays(spark, d, "ml").select("encounter_num", F.col("nlp_positive").alias("ml_positive"))
    return stay_ops.rule_only(rule, ml)


@register("method_outer", "WITH " + O.MENTIONS + """
SELECT encounter_num, t.nlp_positive AS text_positive, m.nlp_positive AS ml_positive
FROM (SELECT encounter_num, nlp_positive FROM tstays WHERE nlp_positive) t
FULL JOIN (SELECT encounter_num, nlp_positive FROM mlstays WHERE nlp_positive) m USING (encounter_num)""")
def q_method_outer(spark, d):
    a = study.text_stays(spark, d).where("nlp_positive").select("encounter_num", F.col("nlp_positive").alias("text_positive"))
    b = study.text_stays(spark, d, "ml").where("nlp_positive").select("encounter_num", F.col("nlp_positive").alias("ml_positive"))
    return stay_ops.method_outer(a, b)


@register("stays_by_source_ml", O.stays_source("ml") + """
SELECT encounter_num, patient_num, date, positive_visit, recurrent_visit, has_history FROM ep""")
def q_stays_by_source_ml(spark, d):
    return study.stays_by_source(spark, d, "ml").select(
        "encounter_num", "patient_num", "date", "positive_visit", "recurrent_visit", "has_history")


@register("outcome_stays", O.stays_source("claims") + """
SELECT encounter_num, patient_num, sex_cd, age_cat, date, death FROM ep WHERE """ + O.OUTCOME)
def q_outcome_stays(spark, d):
    st = incidence.outcome_stays(study.stays_by_source(spark, d, "claims"))
    return st.select("encounter_num", "patient_num", "sex_cd", "age_cat", "date", "death")


# ---------------------------------------------------------------- step 4: incidence

from cohortspark.operators import its, risk, survival  # noqa: E402


def claim_outcomes(spark, d):
    return incidence.outcome_stays(study.stays_by_source(spark, d, "claims"))


MONTHLY_COLS_SQL = """, count(*) AS n_sa, count_if(death) AS death, avg(duration_seconds) / 86400.0 AS mean_duration,
  CAST(month(date) AS INTEGER) AS month, CAST(year(date) AS INTEGER) AS year, monthname(date) AS month_name,
  count_if(death) / count(*) AS death_ratio"""


@register("month_grid", "WITH " + A["visits"] + """,
b AS (SELECT CAST(date_trunc('month', min(visit_start_date)) AS DATE) AS lo,
             CAST(date_trunc('month', max(visit_start_date)) AS DATE) AS hi FROM visits)
SELECT CAST(m AS DATE) AS date, CAST(datediff('month', DATE '1995-01-01', CAST(m AS DATE)) AS INTEGER) AS t
FROM b, unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) u(m)""")
def q_month_grid(spark, d):
    b = adapters.visits(spark, d).agg(F.min("visit_start_date").alias("lo"), F.max("visit_start_date").alias("hi"))
    g = b.select(F.explode(F.sequence(F.trunc("lo", "MM"), F.trunc("hi", "MM"), F.expr("interval 1 month"))).alias("date"))
    return g.withColumn("t", incidence.months_since("date", P.date_from))


@register("incidence_grouping_sets", O.outcome_cte("claims") + """
SELECT sex_cd, age_cat, site_label, date, CAST(GROUPING(sex_cd, age_cat, site_label) AS INTEGER) AS grouping_level"""
          + MONTHLY_COLS_SQL + """
FROM oc GROUP BY GROUPING SETS ((date), (sex_cd, date), (sex_cd, age_cat, date), (site_label, date),
                                (sex_cd, age_cat, site_label, date))""")
def q_incidence_grouping_sets(spark, d):
    return incidence.incidence_grouping_sets(claim_outcomes(spark, d))


def sex_and_all_monthly(spark, d):
    st = claim_outcomes(spark, d)
    by_sex = incidence.monthly_table(st, ["sex_cd"], P)
    overall = incidence.monthly_table(st, [], P).withColumn("sex_cd", F.lit("all"))
    return by_sex.unionByName(overall)


@register("centered_mean", O.outcome_cte("claims") + """,
m AS (SELECT s.sex_cd, mo.date, coalesce(a.n_sa, 0) AS n_sa
      FROM (SELECT DISTINCT date FROM oc) mo CROSS JOIN (VALUES ('M'), ('W')) s(sex_cd)
      LEFT JOIN (SELECT sex_cd, date, count(*) AS n_sa FROM oc GROUP BY ALL) a USING (sex_cd, date)
      UNION ALL SELECT 'all', date, count(*) FROM oc GROUP BY date)
SELECT sex_cd, date, n_sa,
  CASE WHEN count(n_sa) OVER w = 3 THEN avg(n_sa) OVER w END AS n_sa_centered_mean
FROM m WINDOW w AS (PARTITION BY sex_cd ORDER BY date ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""")
def q_centered_mean(spark, d):
    return incidence.centered_mean(sex_and_all_monthly(spark, d), "n_sa", "sex_cd")


@register("period_shares", O.outcome_cte("claims") + """,
g AS (SELECT sex_cd, age_cat, count_if(date < DATE '1998-01-01') AS n_pre, count_if(date >= DATE '1998-01-01') AS n_post
      FROM oc GROUP BY ALL)
SELECT *, n_pre / sum(n_pre) OVER () AS share_pre, n_post / sum(n_post) OVER () AS share_post FROM g""")
def q_period_shares(spark, d):
    return incidence.period_shares(claim_outcomes(spark, d), ["sex_cd", "age_cat"], P)


@register("stays_per_site", O.outcome_cte("claims") + """
SELECT site_label, count(*) AS n_stays FROM oc GROUP BY site_label""")
def q_stays_per_site(spark, d):
    return incidence.stays_per_site(claim_outcomes(spark, d))


@register("age_summary", O.outcome_cte("claims") + """
SELECT round(avg(age), 9) AS mean_age, round(stddev_samp(age), 9) AS std_age, count(age) AS n FROM oc""")
def q_age_summary(spark, d):
    return rounded(incidence.age_summary(claim_outcomes(spark, d)), 9, "mean_age", "std_age")


def probe(spark, d):
    """Completeness: a stay 'has a note' when its order has a returned line (flag 'R')."""
    st = study.stays(spark, d).select("encounter_num", "date", "site_label")
    li = read_table(spark, d, "lineitem", ["l_orderkey", "l_returnflag"])
    has = li.groupBy(F.col("l_orderkey").alias("encounter_num")).agg(
        F.bool_or(F.col("l_returnflag") == "R").alias("has_note"))
    x = st.join(has, "encounter_num", "left").fillna(False, subset=["has_note"])
    return incidence.completeness_probe(x)


PROBE_SQL = "WITH " + O.STAYS + """,
has AS (SELECT l_orderkey AS encounter_num, bool_or(l_returnflag = 'R') AS has_note FROM lineitem GROUP BY 1),
pr AS (SELECT site_label, date, count(*) AS n_visit, count_if(coalesce(has_note, false)) AS n_note,
              count_if(coalesce(has_note, false)) / count(*) AS rho
       FROM stays LEFT JOIN has USING (encounter_num) GROUP BY site_label, date)"""


@register("completeness_probe", PROBE_SQL + "\nSELECT * FROM pr")
def q_completeness_probe(spark, d):
    return probe(spark, d)


PROBE_CATS = [f"src{i}" for i in range(1, 16)]


@register("completeness_probe_notes", "WITH " + O.STAYS + ", " + A["notes"] + """,
has AS (SELECT DISTINCT encounter_num FROM notes WHERE note_category IN (""" + ", ".join(f"'{c}'" for c in PROBE_CATS) + """)
        AND note_text IS NOT NULL)
SELECT site_label, date, count(*) AS n_visit, count(h.encounter_num) AS n_note, count(h.encounter_num) / count(*) AS rho
FROM stays LEFT JOIN has h USING (encounter_num) WHERE visit_type IN ('1-URGENT', '2-HIGH') GROUP BY site_label, date""")
def q_completeness_probe_notes(spark, d):
    return probe_notes(spark, d)


def probe_notes(spark, d):
    """A6 on the notes: stays of the chosen visit types with at least one note of the chosen categories
    that has a text."""
    st = study.stays(spark, d).where(F.col("visit_type").isin("1-URGENT", "2-HIGH")).select("encounter_num", "date", "site_label")
    n = adapters.notes(spark, d).where(F.col("note_category").isin(*PROBE_CATS) & F.col("note_text").isNotNull())
    has = n.select("encounter_num").distinct().withColumn("has_note", F.lit(True))
    return incidence.completeness_probe(st.join(has, "encounter_num", "left").fillna(False, subset=["has_note"]))


@register("stay_weight", PROBE_SQL + """,
w AS (SELECT site_label, date, CASE WHEN rho = 0 THEN NULL ELSE 1.0 / rho END AS stay_weight FROM pr
      WHERE date >= DATE '1995-01-01' AND date < DATE '2001-08-01')
SELECT encounter_num, date, site_label, stay_weight FROM stays LEFT JOIN w USING (date, site_label)""")
def q_stay_weight(spark, d):
    w = incidence.inverse_weights(probe(spark, d), P)
    st = study.stays(spark, d).select("encounter_num", "date", "site_label")
    return stay_ops.add_weights(st, w)


PROBE_NOTES_SQL = "WITH " + O.STAYS + ", " + A["notes"] + """,
has AS (SELECT DISTINCT encounter_num FROM notes WHERE note_category IN (""" + ", ".join(f"'{c}'" for c in PROBE_CATS) + """)
        AND note_text IS NOT NULL),
pr AS (SELECT site_label, date, count(h.encounter_num) / count(*) AS rho
       FROM stays LEFT JOIN has h USING (encounter_num) WHERE visit_type IN ('1-URGENT', '2-HIGH') GROUP BY site_label, date)"""


@register("stay_weight_notes", PROBE_NOTES_SQL + """,
w AS (SELECT site_label, date, CASE WHEN rho > 0 THEN 1.0 / rho END AS stay_weight FROM pr
      WHERE date >= DATE '1995-01-01' AND date < DATE '2001-08-01')
SELECT encounter_num, date, site_label, round(stay_weight, 9) AS stay_weight FROM stays LEFT JOIN w USING (date, site_label)""")
def q_stay_weight_notes(spark, d):
    """J10, A7 with weights from the notes' completeness."""
    st = study.stays(spark, d).select("encounter_num", "date", "site_label")
    return rounded(stay_ops.add_weights(st, incidence.inverse_weights(probe_notes(spark, d), P)), 9, "stay_weight")


GENERIC_TERMS = ["with"]


def text_outcome_stays(spark, d):
    ts = study.text_stays(spark, d)
    st = study.stays(spark, d).select("encounter_num", "date", "sex_cd")
    return ts.join(st, "encounter_num")


@register("modality_mix", "WITH " + O.MENTIONS + """,
ts AS (SELECT t.encounter_num, s.date, t.std_positive_lexical_variants AS l FROM tstays t
       JOIN (SELECT o_orderkey AS encounter_num, CAST(date_trunc('month', o_orderdate) AS DATE) AS date FROM orders) s
       USING (encounter_num)),
ex AS (SELECT encounter_num, date, unnest(l) AS term FROM ts WHERE l IS NOT NULL),
ps AS (SELECT encounter_num, date, term, count(*) AS n FROM ex WHERE term NOT IN ('with') GROUP BY ALL),
pw AS (SELECT encounter_num, date, term, n / sum(n) OVER (PARTITION BY encounter_num) AS w FROM ps),
unk AS (SELECT encounter_num, date, 'Unknown' AS term, 1.0 AS w FROM ts
        WHERE len(l) > 0 AND encounter_num NOT IN (SELECT encounter_num FROM ps)),
mo AS (SELECT date, term, sum(w) AS w FROM (SELECT * FROM pw UNION ALL SELECT * FROM unk) GROUP BY ALL)
SELECT date, term, round(w / sum(w) OVER (PARTITION BY date), 9) AS share FROM mo""")
def q_modality_mix(spark, d):
    out = incidence.modality_mix(text_outcome_stays(spark, d), GENERIC_TERMS)
    return out.withColumn("share", F.round("share", 9))


@register("unpivot_flags", RF_SQL + """,
j AS (SELECT r.*, CAST(date_trunc('month', o_orderdate) AS DATE) AS date FROM rff r JOIN orders ON r.encounter_num = o_orderkey),
m AS (SELECT date, count(*) AS n, """ + ", ".join(f"count_if(\"{r}\") AS \"{r}\"" for r in RF_NAMES) + """ FROM j GROUP BY date)
""" + "\nUNION ALL ".join(f"SELECT date, '{r}' AS rf_name, \"{r}\" / n AS prevalence FROM m" for r in RF_NAMES))
def q_unpivot_flags(spark, d):
    st = study.stays(spark, d).select("encounter_num", "date", "duration_seconds", "death")
    x = rf_flag_stays(spark, d).join(st, "encounter_num")
    monthly = incidence.monthly_table(x, [], P, rf_cols=RF_NAMES)
    ratios = [f"{r}_ratio" for r in RF_NAMES]
    long = monthly.select("date", *[F.col(c).alias(c[:-6]) for c in ratios]).unpivot(
        ["date"], RF_NAMES, "rf_name", "prevalence")
    return long


# ---------------------------------------------------------------- step 5: ITS

def its_design_df(spark, d, keys=()):
    st = claim_outcomes(spark, d)
    monthly = st.groupBy(*keys, "date").agg(F.count(F.lit(1)).alias("n_sa"))
    return its.design(monthly, list(keys), P)


def _its_sql(keys: list[str], y: str = "count(*)", source: str = "", rows: str = "oc") -> str:
    """Closed-form minimum-norm OLS in SQL (same algebra, independent code)."""
    k = ", ".join(keys)
    kc = (k + ", ") if keys else ""
    on = " AND ".join(f"x.{c} = g.{c}" for c in keys) if keys else "true"
    grp = f"GROUP BY {k}" if keys else ""
    return (source or O.outcome_cte("claims")) + f""",
mo AS (SELECT {kc}date, {y} AS n_sa FROM {rows} GROUP BY ALL),
gr AS (SELECT DISTINCT {k if keys else "'all' AS series"} FROM {"mo" if keys else "(SELECT 1)"}),
cal AS (SELECT CAST(m AS DATE) AS date FROM unnest(generate_series(DATE '1995-01-01', DATE '2001-07-01', INTERVAL 1 MONTH)) u(m)),
des AS (SELECT gr.*, cal.date, CAST(coalesce(mo.n_sa, 0) AS DOUBLE) AS y, mo.n_sa IS NOT NULL AS observed,
               CAST(datediff('month', DATE '1995-01-01', cal.date) AS INTEGER) AS t,
               CASE WHEN cal.date >= DATE '1998-01-01' THEN datediff('month', DATE '1998-01-01', cal.date) ELSE 0 END AS delta_t,
               month(cal.date) AS month_index
        FROM gr CROSS JOIN cal LEFT JOIN mo ON {" AND ".join(f"mo.{c} = gr.{c}" for c in keys) + " AND " if keys else ""}mo.date = cal.date),
pm AS (SELECT {kc}month_index, count(*) AS n_k, avg(t) AS mt, avg(delta_t) AS md, avg(y) AS my FROM des GROUP BY ALL),
x AS (SELECT d.*, p.n_k, p.mt, p.md, p.my FROM des d JOIN pm p USING ({kc}month_index)),
g0 AS (SELECT {kc}sum((t-mt)*(t-mt)) AS stt, sum((t-mt)*(delta_t-md)) AS std, sum((delta_t-md)*(delta_t-md)) AS sdd,
              sum((t-mt)*(y-my)) AS sty, sum((delta_t-md)*(y-my)) AS sdy, count(*) AS n FROM x {grp}),
g1 AS (SELECT *, (sdd*sty - std*sdy) / (stt*sdd - std*std) AS b_t, (stt*sdy - std*sty) / (stt*sdd - std*std) AS b_d,
              stt*sdd - std*std AS det FROM g0),
ak AS (SELECT p.*, g1.b_t, g1.b_d, p.my - g1.b_t*p.mt - g1.b_d*p.md AS a_k FROM pm p JOIN g1 {"USING (" + k + ")" if keys else "ON true"}),
sa AS (SELECT {kc}sum(a_k) AS sum_a, sum(1.0/n_k) AS sum_inv_n, sum(mt) AS w_t, sum(md) AS w_d FROM ak {grp}),
rs AS (SELECT {kc}sum(power(x.y - ak.a_k - ak.b_t*x.t - ak.b_d*x.delta_t, 2)) AS ssr
       FROM x JOIN ak USING ({kc}month_index) {grp}),
g AS (SELECT g1.*, sa.sum_a / 13.0 AS const, sa.sum_inv_n, sa.w_t, sa.w_d, rs.ssr, rs.ssr / (g1.n - 14) AS s2
      FROM g1 {"JOIN sa USING (" + k + ") JOIN rs USING (" + k + ")" if keys else "CROSS JOIN sa CROSS JOIN rs"}),
co AS (SELECT *, sqrt(s2*sdd/det) AS se_t, sqrt(s2*stt/det) AS se_d,
              sqrt(s2/169.0*(sum_inv_n + (w_t*w_t*sdd - 2*w_t*w_d*std + w_d*w_d*stt)/det)) AS se_const FROM g)"""


COEF_COLS = ("estimate", "std_error", "lower", "upper")
# published Student t quantile, 0.975 at 65 degrees of freedom (79 window months less 14 terms)
Q_ITS = 1.9971379084
_MN = "['January','February','March','April','May','June','July','August','September','October','November','December']"


def _coef_sql(keys, **outcome):
    kc = ", ".join(keys) + ", " if keys else "'all' AS series, "
    kk = ", ".join(keys) + ", " if keys else ""
    return _its_sql(keys, **outcome) + f""",
lo AS (SELECT {kc}'const' AS term, const AS estimate, se_const AS std_error FROM co
       UNION ALL SELECT {kc}'t', b_t, se_t FROM co
       UNION ALL SELECT {kc}'delta_t', b_d, se_d FROM co
       UNION ALL SELECT {kk.replace(", ", "") and ", ".join("ak." + c for c in keys) + ", " or "'all', "}{_MN}[ak.month_index], ak.a_k - co.const, NULL
         FROM ak JOIN co {"USING (" + ", ".join(keys) + ")" if keys else "ON true"})
SELECT {", ".join(keys) + ", " if keys else "series, "}term, round(estimate, 6) AS estimate, round(std_error, 6) AS std_error,
       round(estimate - {Q_ITS!r} * std_error, 6) AS lower, round(estimate + {Q_ITS!r} * std_error, 6) AS upper FROM lo"""


@register("its_design", _its_sql([]) + """
SELECT series, date, y, observed, t, CAST(date >= DATE '1998-01-01' AS INTEGER) AS after_cutoff,
       CAST(delta_t AS INTEGER) AS delta_t, CAST(month_index AS INTEGER) AS month_index FROM des""")
def q_its_design(spark, d):
    return its_design_df(spark, d)


@register("its_coefficients", _coef_sql([]))
def q_its_coefficients(spark, d):
    return rounded(its.coefficients(its_design_df(spark, d), [], P), 6, *COEF_COLS)


@register("its_fitted", _its_sql([]) + """
SELECT x.series, x.date, x.y, x.t, CAST(x.delta_t AS INTEGER) AS delta_t,
       round(ak.a_k + ak.b_t*x.t + ak.b_d*x.delta_t, 6) AS estimate,
       round(x.y - (ak.a_k + ak.b_t*x.t + ak.b_d*x.delta_t), 6) AS residual,
       round(ak.b_t*x.t + ak.b_d*x.delta_t + co.const, 6) AS linear_trend,
       round(ak.b_t*x.t + co.const, 6) AS no_change_trend
FROM x JOIN ak USING (month_index) CROSS JOIN co WHERE x.observed""")
def q_its_fitted(spark, d):
    return rounded(its.fitted(its_design_df(spark, d), []), 6, "estimate", "residual", "linear_trend", "no_change_trend")


@register("its_by_group", _coef_sql(["sex_cd"]))
def q_its_by_group(spark, d):
    return rounded(its.coefficients(its_design_df(spark, d, ["sex_cd"]), ["sex_cd"], P), 6, *COEF_COLS)


@register("trend_change", _coef_sql(["site_label"]).rsplit("SELECT site_label, term", 1)[0] + """
SELECT site_label, round(estimate, 6) AS delta_t, round(estimate - """ + repr(Q_ITS) + """ * std_error, 6) AS lower,
       round(estimate + """ + repr(Q_ITS) + """ * std_error, 6) AS upper,
       round(""" + repr(Q_ITS) + """ * std_error, 6) AS lower_half_width, round(""" + repr(Q_ITS) + """ * std_error, 6) AS upper_half_width,
       r_name AS site_type, n_stays
FROM lo JOIN nation ON site_label = n_name JOIN region ON n_regionkey = r_regionkey
JOIN (SELECT site_label, count(*) AS n_stays FROM oc GROUP BY 1) USING (site_label) WHERE term = 'delta_t'""")
def q_trend_change(spark, d):
    coefs = its.coefficients(its_design_df(spark, d, ["site_label"]), ["site_label"], P)
    tc = rounded(its.trend_change(coefs, ["site_label"]), 6, "delta_t", "lower", "upper", "lower_half_width", "upper_half_width")
    sites = adapters.site_dimension(spark, d)
    n = incidence.stays_per_site(claim_outcomes(spark, d))
    return tc.join(sites, "site_label", "left").join(n, "site_label", "left")


_CHANGE = f"""round(estimate, 6) AS delta_t, round(estimate - {Q_ITS!r} * std_error, 6) AS lower,
       round(estimate + {Q_ITS!r} * std_error, 6) AS upper"""


def _change(des, keys):
    return rounded(its.trend_change(its.coefficients(des, keys, P), keys or ["series"]), 6, "delta_t", "lower", "upper").select(
        *(keys or ["series"]), "delta_t", "lower", "upper")


@register("trend_change_overall", _coef_sql([]).rsplit("SELECT series, term", 1)[0] + f"""
SELECT series, {_CHANGE} FROM lo WHERE term = 'delta_t'""")
def q_trend_change_overall(spark, d):
    return _change(its_design_df(spark, d), [])


@register("trend_change_slice", _coef_sql(["sex_cd", "age_cat"]).rsplit("SELECT sex_cd, age_cat, term", 1)[0] + f"""
SELECT sex_cd, age_cat, {_CHANGE} FROM lo WHERE term = 'delta_t'""")
def q_trend_change_slice(spark, d):
    """T4 by slice: every sex and age band."""
    return _change(its_design_df(spark, d, ["sex_cd", "age_cat"]), ["sex_cd", "age_cat"])


WEIGHTED_SQL = O.outcome_cte("claims") + """,
has AS (SELECT l_orderkey AS encounter_num, bool_or(l_returnflag = 'R') AS has_note FROM lineitem GROUP BY 1),
pr AS (SELECT site_label, date, count_if(coalesce(has_note, false)) / count(*) AS rho
       FROM stays LEFT JOIN has USING (encounter_num) GROUP BY site_label, date),
ow AS (SELECT oc.*, CASE WHEN rho > 0 THEN 1.0 / rho END AS stay_weight FROM oc LEFT JOIN pr USING (date, site_label))"""


@register("trend_change_weighted", _coef_sql(["sex_cd"], y="sum(stay_weight)", source=WEIGHTED_SQL, rows="ow").rsplit(
    "SELECT sex_cd, term", 1)[0] + f"""
SELECT sex_cd, {_CHANGE} FROM lo WHERE term = 'delta_t'""")
def q_trend_change_weighted(spark, d):
    """T4 on counts weighted by inverse completeness."""
    st = stay_ops.add_weights(claim_outcomes(spark, d), incidence.inverse_weights(probe(spark, d), P))
    monthly = st.groupBy("sex_cd", "date").agg(F.sum("stay_weight").alias("n_sa"))
    return _change(its.design(monthly, ["sex_cd"], P), ["sex_cd"])


@register("table_by_age", O.outcome_cte("claims") + """
SELECT coalesce(age_cat, 'all') AS age_cat, count(*) AS n_stays, count(DISTINCT patient_num) AS n_patients,
       round(count_if(sex_cd = 'W') / count(*), 9) AS share_women, round(avg(age), 9) AS mean_age, round(stddev_samp(age), 9) AS std_age,
       count_if(death) AS n_deaths, round(avg(duration_seconds) / 86400.0, 9) AS mean_duration
FROM oc GROUP BY GROUPING SETS ((age_cat), ())""")
def q_table_by_age(spark, d):
    """T13 table 1 by age band, with the row of all bands."""
    return rounded(incidence.outcome_table(claim_outcomes(spark, d), ["age_cat"]), 9, "share_women", "mean_age", "std_age", "mean_duration")


@register("table_by_site_type", O.outcome_cte("claims") + """
SELECT coalesce(site_type, 'all') AS site_type, count(*) AS n_stays, count(DISTINCT patient_num) AS n_patients,
       round(count_if(sex_cd = 'W') / count(*), 9) AS share_women, round(avg(age), 9) AS mean_age, round(stddev_samp(age), 9) AS std_age,
       count_if(death) AS n_deaths, round(avg(duration_seconds) / 86400.0, 9) AS mean_duration
FROM oc GROUP BY GROUPING SETS ((site_type), ())""")
def q_table_by_site_type(spark, d):
    """T13 table 2: the same summary by site type."""
    return rounded(incidence.outcome_table(claim_outcomes(spark, d), ["site_type"]), 9, "share_women", "mean_age", "std_age", "mean_duration")


@register("table_trends", _coef_sql(["sex_cd"]).rsplit("SELECT sex_cd, term", 1)[0] + """
SELECT sex_cd, n_stays, share, mean_age, round(estimate, 6) AS delta_t,
       round(estimate - """ + repr(Q_ITS) + """ * std_error, 6) AS lower, round(estimate + """ + repr(Q_ITS) + """ * std_error, 6) AS upper
FROM lo JOIN (SELECT sex_cd, count(*) AS n_stays, count(*) / sum(count(*)) OVER () AS share, avg(age) AS mean_age
              FROM oc GROUP BY sex_cd) USING (sex_cd) WHERE term = 'delta_t'""")
def q_table_trends(spark, d):
    st = claim_outcomes(spark, d)
    tc = its.trend_change(its.coefficients(its_design_df(spark, d, ["sex_cd"]), ["sex_cd"], P), ["sex_cd"])
    g = st.groupBy("sex_cd").agg(F.count(F.lit(1)).alias("n_stays"), F.avg("age").alias("mean_age"))
    from pyspark.sql import Window
    g = g.withColumn("share", F.col("n_stays") / F.sum("n_stays").over(Window.partitionBy()))
    return g.join(rounded(tc, 6, "delta_t", "lower", "upper").select("sex_cd", "delta_t", "lower", "upper"), "sex_cd")


SETS = {"all": [], "sex": ["sex_cd"], "age": ["age_cat"], "sex_age": ["sex_cd", "age_cat"], "site": ["site_label"]}
TEXT_SETS = {k: SETS[k] for k in ("all", "sex", "age")}


def _sets_sql(sets: dict, source: str) -> str:
    cols = list(dict.fromkeys(c for cs in sets.values() for c in cs))
    rows = " UNION ALL ".join(f"SELECT '{name}' AS grouping_, " + ", ".join(c if c in cs else f"'all' AS {c}" for c in cols) + ", date, age FROM oc"
                              for name, cs in sets.items())
    keys = ["grouping_", *cols]
    k = ", ".join(keys)
    q = repr(Q_ITS)
    terms = ", ".join(f"round({e}, 6) AS {t}, round({e} - {q} * {s}, 6) AS {t}_lower, round({e} + {q} * {s}, 6) AS {t}_upper"
                      for t, e, s in (("const", "const", "se_const"), ("t", "b_t", "se_t"), ("delta_t", "b_d", "se_d")))
    return _its_sql(keys, source=O.outcome_cte(source) + f", ocs AS ({rows})", rows="ocs") + f""",
sz AS (SELECT {k}, count(*) AS n_stays, avg(age) AS mean_age FROM ocs GROUP BY ALL)
SELECT grouping_ AS "grouping", {", ".join(cols)}, n_stays, round(mean_age, 9) AS mean_age,
       round(n_stays / sum(n_stays) OVER (PARTITION BY grouping_), 9) AS share, {terms} FROM sz JOIN co USING ({k})"""


def _sets_df(spark, d, sets, source):
    out = its.fit_sets(incidence.outcome_stays(study.stays_by_source(spark, d, source)), sets, P)
    return rounded(rounded(out, 9, "mean_age", "share"), 6, *[f"{t}{e}" for t in ("const", "t", "delta_t") for e in ("", "_lower", "_upper")])


@register("table_trends_sets", _sets_sql(SETS, "claims"))
def q_table_trends_sets(spark, d):
    """T13 table 1: all, sex, age band, sex x age band and site in one fit."""
    return _sets_df(spark, d, SETS, "claims")


@register("table_trends_text", _sets_sql(TEXT_SETS, "text"))
def q_table_trends_text(spark, d):
    """The same trends of the stays that are positive by text."""
    return _sets_df(spark, d, TEXT_SETS, "text")


# ---------------------------------------------------------------- step 6: risk / survival

def rf_stays_dated(spark, d):
    """RF flags of the analysed stays: positive by text, first of their episode, in the window, known
    sex and age."""
    st = incidence.outcome_stays(study.stays_by_source(spark, d, "text")).select("encounter_num", "date", "sex_cd")
    return rf_flag_stays(spark, d).join(st, "encounter_num")


def contingency_df(spark, d):
    return risk.contingency(rf_stays_dated(spark, d), RF_NAMES, ["sex_cd"], P, all_label="all")


CONTINGENCY_SQL = RF_SQL.replace("WITH " + O.MENTIONS, O.stays_source("text", head=True) + ", " + O.MENTION_BODY, 1) + O.stays_tail("text") + """,
j0 AS (SELECT r.*, ep.date, ep.sex_cd FROM rff r JOIN ep USING (encounter_num) WHERE """ + O.OUTCOME + """),
j AS (SELECT * FROM j0 UNION ALL SELECT * REPLACE ('all' AS sex_cd) FROM j0),
lg AS (""" + "\nUNION ALL ".join(f"SELECT sex_cd, '{r}' AS rf_name, \"{r}\" AS rf, date >= DATE '1998-01-01' AS post FROM j"
                                 for r in RF_NAMES) + """),
ct AS (SELECT sex_cd, rf_name, count_if(rf AND post) AS a, count_if(rf AND NOT post) AS b,
              count_if(NOT rf AND post) AS c, count_if(NOT rf AND NOT post) AS d FROM lg GROUP BY ALL)"""


@register("contingency", CONTINGENCY_SQL + "\nSELECT * FROM ct")
def q_contingency(spark, d):
    return contingency_df(spark, d)


@register("risk_ratio", CONTINGENCY_SQL + """,
rr AS (SELECT *, CASE WHEN a > 0 AND b > 0 THEN (a / (a + c)) / (b / (b + d)) END AS rr0,
              CASE WHEN a > 0 AND b > 0 THEN sqrt(1.0/a - 1.0/(a + c) + 1.0/b - 1.0/(b + d)) END AS se FROM ct),
hx AS (SELECT sex_cd, rf_name, a, x,
              lgamma(a+b+1) - lgamma(x+1) - lgamma(a+b-x+1) + lgamma(c+d+1) - lgamma(a+c-x+1) - lgamma(c+d-a-c+x+1)
              - (lgamma(a+b+c+d+1) - lgamma(a+c+1) - lgamma(b+d+1)) AS lp
       FROM ct, unnest(generate_series(CAST(greatest(0, a+c-(c+d)) AS BIGINT), CAST(least(a+b, a+c) AS BIGINT))) g(x)),
fp AS (SELECT h.sex_cd, h.rf_name, least(1.0, sum(CASE WHEN h.lp <= o.lp + ln(1 + 1e-7) THEN exp(h.lp) ELSE 0 END)) AS p
       FROM hx h JOIN (SELECT sex_cd, rf_name, lp FROM hx WHERE x = a) o USING (sex_cd, rf_name) GROUP BY ALL)
SELECT sex_cd, rf_name, a, b, c, d, round(rr0, 6) AS risk_ratio,
       round(exp(ln(rr0) - 1.959963984540054 * se), 6) AS rr_lower, round(exp(ln(rr0) + 1.959963984540054 * se), 6) AS rr_upper,
       round(p, 6) AS fisher_p
FROM rr LEFT JOIN fp USING (sex_cd, rf_name)""")
def q_risk_ratio(spark, d):
    return rounded(risk.risk_ratio(contingency_df(spark, d), ["sex_cd", "rf_name"]), 6, "risk_ratio", "rr_lower", "rr_upper", "fisher_p")


@register("table_risk_factors", CONTINGENCY_SQL + """
SELECT rf_name, a AS n_post, b AS n_pre, round(a / nullif(a + c, 0), 9) AS share_post, round(b / nullif(b + d, 0), 9) AS share_pre
FROM ct WHERE sex_cd = 'all'""")
def q_table_risk_factors(spark, d):
    """T13 table 3: risk factors of the analysed stays before and after the cutoff."""
    ct = contingency_df(spark, d).where("sex_cd = 'all'")
    out = ct.select("rf_name", F.col("a").alias("n_post"), F.col("b").alias("n_pre"),
                    safe_ratio("a", F.col("a") + F.col("c")).alias("share_post"), safe_ratio("b", F.col("b") + F.col("d")).alias("share_pre"))
    return rounded(out, 9, "share_post", "share_pre")


def km_df(spark, d):
    return survival.km_input(claim_outcomes(spark, d), P)


KM_SQL = O.outcome_cte("claims") + """,
km AS (SELECT encounter_num, CASE WHEN date < DATE '1998-01-01' THEN 'pre' ELSE 'post' END AS cohort,
              (epoch(coalesce(visit_end_date, TIMESTAMP '2001-09-01')) - epoch(visit_start_date)) / 86400.0 AS duration,
              visit_end_date IS NOT NULL AS event FROM oc),
pt AS (SELECT cohort, duration, count_if(event) AS n_event, count_if(NOT event) AS n_censored FROM km GROUP BY ALL),
pt2 AS (SELECT *, sum(n_event + n_censored) OVER (PARTITION BY cohort ORDER BY duration DESC
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n_at_risk FROM pt)"""


@register("km_input", KM_SQL + "\nSELECT * FROM km")
def q_km_input(spark, d):
    return km_df(spark, d)


@register("km_curve", KM_SQL + """
SELECT cohort, duration, n_event, n_censored, CAST(n_at_risk AS BIGINT) AS n_at_risk,
  round(CASE WHEN max(CAST(n_event >= n_at_risk AS INTEGER)) OVER w = 1 THEN 0.0
        ELSE exp(sum(CASE WHEN n_event >= n_at_risk THEN 0.0 ELSE ln(1 - n_event / n_at_risk) END) OVER w) END, 6) AS survival
FROM pt2 WINDOW w AS (PARTITION BY cohort ORDER BY duration ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def q_km_curve(spark, d):
    return rounded(survival.km_curve(km_df(spark, d)), 6, "survival")


@register("km_at_risk", KM_SQL + """,
days AS (SELECT DISTINCT cohort, unnest(generate_series(0, 30)) AS day FROM km)
SELECT cohort, CAST(day AS INTEGER) AS day, CAST(count(k.encounter_num) AS BIGINT) AS n_at_risk
FROM days LEFT JOIN km k USING (cohort) WHERE k.duration >= day OR k.duration IS NULL GROUP BY ALL""")
def q_km_at_risk(spark, d):
    return survival.at_risk_days(km_df(spark, d), P.km_days)


@register("logrank", KM_SQL + """,
times AS (SELECT DISTINCT duration FROM pt),
nn AS (SELECT t.duration,
         coalesce((SELECT n_event FROM pt2 WHERE cohort = 'pre' AND duration = t.duration), 0) AS d1,
         coalesce((SELECT n_event FROM pt2 WHERE cohort = 'post' AND duration = t.duration), 0) AS d2,
         (SELECT count(*) FROM km WHERE cohort = 'pre' AND duration >= t.duration) AS n1,
         (SELECT count(*) FROM km WHERE cohort = 'post' AND duration >= t.duration) AS n2 FROM times t),
agg AS (SELECT sum(d1) AS observed_1, sum((d1 + d2) * n1 / (n1 + n2)) AS expected_1,
               sum(CASE WHEN n1 + n2 > 1 THEN (d1 + d2) * n1 * n2 * (n1 + n2 - d1 - d2) / ((n1 + n2) * (n1 + n2) * (n1 + n2 - 1.0)) ELSE 0 END) AS variance
        FROM nn WHERE d1 + d2 > 0)
SELECT CAST(observed_1 AS BIGINT) AS observed_1, round(expected_1, 6) AS expected_1,
       round(power(observed_1 - expected_1, 2) / variance, 6) AS chi2 FROM agg""")
def q_logrank(spark, d):
    return rounded(survival.logrank(km_df(spark, d)).drop("p_value"), 6, "expected_1", "chi2")


def _erfc_sql(x: str) -> str:
    """The power series of erf, 150 terms (exact to 1e-9 for arguments below 4)."""
    return (f"(1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 150), lambda n: CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END * "
            f"exp((2 * n + 1) * ln({x}) - lgamma(n + 1.0)) / (2 * n + 1))))")


LOGRANK_SQL = ORACLE["logrank"]


@register("logrank_p", LOGRANK_SQL.rsplit("SELECT CAST(observed_1", 1)[0] + """,
st AS (SELECT observed_1, expected_1, power(observed_1 - expected_1, 2) / variance AS x2 FROM agg)
SELECT CAST(observed_1 AS BIGINT) AS observed_1, round(expected_1, 6) AS expected_1, round(x2, 6) AS chi2,
       round(""" + _erfc_sql("sqrt(x2 / 2.0)") + """, 6) AS p_value FROM st""")
def q_logrank_p(spark, d):
    return rounded(survival.logrank(km_df(spark, d)), 6, "expected_1", "chi2", "p_value")


# ---------------------------------------------------------------- step 7: agreement / sampling

from cohortspark.operators import agreement, sampling  # noqa: E402

ANN = "WITH " + A["annotations"] + """,
w AS (SELECT note_id, any_value(gold) FILTER (WHERE annotator = 'A') AS "A",
             any_value(gold) FILTER (WHERE annotator = 'B') AS "B", any_value(rf_name) AS rf_name FROM annotations GROUP BY note_id)"""


def ann_wide(spark, d):
    a = adapters.annotations(spark, d)
    return agreement.pair_wide(a, ("A", "B"), ["note_id", "rf_name"])


@register("crosstab_margins", ANN + """
SELECT "A" AS label_a, "B" AS label_b, GROUPING("A") = 1 AS is_margin_a, GROUPING("B") = 1 AS is_margin_b, count(*) AS n
FROM w GROUP BY CUBE ("A", "B")""")
def q_crosstab_margins(spark, d):
    return agreement.crosstab_margins(ann_wide(spark, d))


@register("annotator_disagreement", "WITH " + A["annotations"] + """
SELECT note_id, count(DISTINCT annotator) AS n_annotators, count(DISTINCT gold) AS n_labels,
       count(DISTINCT gold) > 1 AS disagreement FROM annotations GROUP BY note_id""")
def q_annotator_disagreement(spark, d):
    return agreement.disagreement(adapters.annotations(spark, d))


@register("notes_per_annotator", "WITH " + A["annotations"] + """,
k AS (SELECT note_id, count(DISTINCT annotator) AS k FROM annotations GROUP BY 1)
SELECT annotator, count(*) AS n_notes, count_if(k > 1) AS n_shared, count_if(k = 1) AS n_unique
FROM (SELECT DISTINCT note_id, annotator FROM annotations) JOIN k USING (note_id) GROUP BY annotator""")
def q_notes_per_annotator(spark, d):
    return agreement.notes_per_annotator(adapters.annotations(spark, d))


def rounds(spark, d):
    a = adapters.annotations(spark, d)
    main = a.where(~F.col("supplementary")).select("note_id", "annotator", "gold", "predicted", F.lit("main").alias("round"))
    supp = a.where(F.col("supplementary")).select("note_id", "annotator", "gold", "remark", F.lit("supplementary").alias("round"))
    return [main, supp]


@register("annotation_union", "WITH " + A["annotations"] + """
SELECT note_id, annotator, gold, predicted, 'main' AS round, CAST(NULL AS VARCHAR) AS remark FROM annotations WHERE NOT supplementary
UNION ALL
SELECT note_id, annotator, gold, CAST(NULL AS BOOLEAN), 'supplementary', remark FROM annotations WHERE supplementary""")
def q_annotation_union(spark, d):
    return agreement.annotation_union(rounds(spark, d))


@register("resolve_conflicts", "WITH " + A["annotations"] + """,
conf AS (SELECT note_id, 'B' AS annotator FROM annotations GROUP BY note_id HAVING count(DISTINCT gold) > 1),
k AS (SELECT a.* FROM annotations a ANTI JOIN conf USING (note_id, annotator))
SELECT note_id, annotator, gold, predicted FROM (
  SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY CASE annotator WHEN 'A' THEN 1 WHEN 'B' THEN 2 END, annotator) AS rn
  FROM k) WHERE rn = 1""")
def q_resolve_conflicts(spark, d):
    a = adapters.annotations(spark, d)
    conf = agreement.disagreement(a).where("disagreement").select("note_id", F.lit("B").alias("annotator"))
    return agreement.resolve_conflicts(a.select("note_id", "annotator", "gold", "predicted"), conf, ["A", "B"])


@register("shared_pivot", ANN + """
SELECT note_id, rf_name, "A", "B" FROM w WHERE "A" <> "B" """)
def q_shared_pivot(spark, d):
    return ann_wide(spark, d).where(F.col("A") != F.col("B"))


@register("cohen_kappa", ANN + """,
g AS (SELECT rf_name, count(*) AS n, count_if("A" = "B") AS agree, count_if("A") AS ta, count_if("B") AS tb,
             len(list_distinct(flatten(list(["A", "B"])))) AS n_values FROM w GROUP BY rf_name)
SELECT rf_name, n, CAST(n_values AS INTEGER) AS n_values,
  round(CASE WHEN 1 - ((ta/n)*(tb/n) + (1-ta/n)*(1-tb/n)) = 0 THEN NULL
        ELSE (agree/n - ((ta/n)*(tb/n) + (1-ta/n)*(1-tb/n))) / (1 - ((ta/n)*(tb/n) + (1-ta/n)*(1-tb/n))) END, 6) AS kappa FROM g""")
def q_cohen_kappa(spark, d):
    return rounded(agreement.cohen_kappa(ann_wide(spark, d), by=["rf_name"]), 6, "kappa")


@register("class_agreement", ANN + """,
g AS (SELECT count_if("A" AND "B") AS both_pos, count_if("A" AND NOT "B") AS only_a, count_if(NOT "A" AND "B") AS only_b,
             count_if(NOT "A" AND NOT "B") AS both_neg FROM w)
SELECT *, round(2.0*both_pos / nullif(2*both_pos + only_a + only_b, 0), 6) AS positive_agreement,
          round(2.0*both_neg / nullif(2*both_neg + only_a + only_b, 0), 6) AS negative_agreement FROM g""")
def q_class_agreement(spark, d):
    return rounded(agreement.class_agreement(ann_wide(spark, d)), 6, "positive_agreement", "negative_agreement")


def annotator_a(spark, d):
    return adapters.annotations(spark, d).where(F.col("annotator") == "A")


@register("ppv_wilson", "WITH " + A["annotations"] + """,
g AS (SELECT after_cutoff, rf_name, count_if(predicted AND gold) AS tp, count_if(predicted AND NOT gold) AS fp,
             count_if(NOT predicted AND gold) AS fn, count_if(NOT predicted AND NOT gold) AS tn
      FROM annotations WHERE annotator = 'A' GROUP BY ALL),
h AS (SELECT *, tp + fp AS n_pred, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS p FROM g),
z AS (SELECT *, 1.959963984540054 AS z FROM h)
SELECT after_cutoff, rf_name, tp, fp, fn, tn, n_pred, round(p, 6) AS ppv,
  round((p + z*z/(2*n_pred)) / (1 + z*z/n_pred) - z*sqrt(p*(1-p)/n_pred + z*z/(4*n_pred*n_pred)) / (1 + z*z/n_pred), 6) AS ppv_lower,
  round((p + z*z/(2*n_pred)) / (1 + z*z/n_pred) + z*sqrt(p*(1-p)/n_pred + z*z/(4*n_pred*n_pred)) / (1 + z*z/n_pred), 6) AS ppv_upper
FROM z""")
def q_ppv_wilson(spark, d):
    return rounded(agreement.ppv_wilson(annotator_a(spark, d), ["after_cutoff", "rf_name"]), 6, "ppv", "ppv_lower", "ppv_upper")


@register("composite_ppv", "WITH " + A["annotations"] + """,
r AS (SELECT *, note_id % 4 <> 0 AS ml FROM annotations WHERE annotator = 'A' AND predicted),
g AS (SELECT count(*) AS n_rule, count_if(ml) AS n_both, count_if(ml AND gold) AS tp_both, count_if(NOT ml AND gold) AS tp_rule_only FROM r),
h AS (SELECT n_both / n_rule AS p, tp_both / n_both AS ppv_both, tp_rule_only / (n_rule - n_both) AS ppv_only FROM g)
SELECT round(p, 6) AS share_both, round(ppv_both, 6) AS ppv_both, round(ppv_only, 6) AS ppv_rule_only,
       round(p * ppv_both + (1 - p) * ppv_only, 6) AS composite_ppv FROM h""")
def q_composite_ppv(spark, d):
    a = annotator_a(spark, d).withColumn("ml", F.col("note_id") % 4 != 0)
    return rounded(agreement.composite_ppv(a, "predicted", "ml"), 6, "share_both", "ppv_both", "ppv_rule_only", "composite_ppv")


@register("binary_metrics", "WITH " + A["annotations"] + """,
g AS (SELECT count_if(predicted AND gold) AS tp, count_if(predicted AND NOT gold) AS fp, count_if(NOT predicted AND gold) AS fn,
             count_if(NOT predicted AND NOT gold) AS tn FROM annotations WHERE annotator = 'A')
SELECT tp, fp, fn, tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
       round(2.0*tp / (2*tp + fp + fn), 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, tp + fn AS support FROM g""")
def q_binary_metrics(spark, d):
    return rounded(agreement.binary_metrics(annotator_a(spark, d)), 6, "precision", "recall", "f1", "accuracy")


@register("flatten_labels", """
SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events""")
def q_flatten_labels(spark, d):
    e = read_table(spark, d, "events", ["event_id", "event_type", "props"])
    return agreement.flatten_labels(e, "props", "k int")


def sample_df(spark, d):
    a = annotator_a(spark, d).select("note_id", "after_cutoff", "rf_name", "gold")
    avoid = annotator_a(spark, d).where(F.col("remark") == "unclear").select("note_id")
    return sampling.stratified_sample(a, ["after_cutoff", "rf_name"], 20, avoid=avoid)


SAMPLE_SQL = "WITH " + A["annotations"] + """,
s AS (SELECT note_id, after_cutoff, rf_name, gold, CAST(row_number() OVER (PARTITION BY after_cutoff, rf_name
             ORDER BY md5('7919-' || note_id), note_id) AS INTEGER) AS sample_rank
      FROM annotations WHERE annotator = 'A' AND note_id NOT IN (
        SELECT note_id FROM annotations WHERE annotator = 'A' AND remark = 'unclear')),
smp AS (SELECT * FROM s WHERE sample_rank <= 20)"""


@register("stratified_sample", SAMPLE_SQL + "\nSELECT * FROM smp")
def q_stratified_sample(spark, d):
    return sample_df(spark, d)


@register("annotator_allocation", SAMPLE_SQL + """,
o AS (SELECT *, row_number() OVER (ORDER BY md5('7919-' || note_id), note_id) - 1 AS i,
             floor(count(*) OVER () * 0.2) AS n_shared FROM smp),
x AS (SELECT *, i < n_shared AS shared,
             CASE WHEN i < n_shared THEN ['A', 'B', 'C'] ELSE [['A', 'B', 'C'][CAST((i - n_shared) % 3 AS INTEGER) + 1]] END AS who FROM o)
SELECT note_id, after_cutoff, rf_name, gold, sample_rank, shared, unnest(who) AS annotator FROM x""")
def q_annotator_allocation(spark, d):
    return sampling.allocate(sample_df(spark, d), ["A", "B", "C"], 0.2)


@register("annotation_tasks", "WITH " + O.MENTIONS + """
SELECT note_id, start_char AS start, end_char AS "end", std_lexical_variant AS label_name,
       'note ' || CAST(note_id AS VARCHAR) AS title, CAST(note_id AS VARCHAR) AS note_id_dedup FROM ments""")
def q_annotation_tasks(spark, d):
    return sampling.annotation_tasks(study.text_mentions(spark, d))


# ---------------------------------------------------------------- step 9: dates

from cohortspark.operators import dates as date_ops  # noqa: E402


DATES_SQL = "WITH " + O.SELECTED_NOTES + ", " + O.DATE_CTES


@register("date_mentions", DATES_SQL + "\nSELECT * FROM dm")
def q_date_mentions(spark, d):
    return study.date_mentions(spark, d)


@register("relative_dates", DATES_SQL + "\nSELECT * FROM rel")
def q_relative_dates(spark, d):
    return study.resolved_dates(spark, d)


@register("clean_dates", DATES_SQL + "\nSELECT * FROM cd")
def q_clean_dates(spark, d):
    return study.clean_dates(spark, d)


def asof_df(spark, d):
    ents, dts = adapters.asof_sides(spark, d)
    day_us = 86_400 * 1_000_000
    return date_ops.asof_nearest(ents, dts, ["group_id"], "start", "date_id", ("date",), bucket_width=day_us)


@register("asof_nearest", """
WITH e AS (SELECT event_id, user_id, event_type, ts, CAST(epoch_us(ts) AS BIGINT) AS p FROM events),
en AS (SELECT user_id AS group_id, event_id AS ent_id, p AS start FROM e WHERE event_type = 'purchase'),
dt AS (SELECT user_id AS group_id, event_id AS date_id, p, ts FROM e WHERE event_type = 'view'),
bk AS (SELECT en.ent_id, arg_max(dt.date_id, (dt.p, dt.date_id)) AS bid, max(dt.p) AS bp
       FROM en JOIN dt ON en.group_id = dt.group_id AND dt.p <= en.start GROUP BY en.ent_id),
fw AS (SELECT en.ent_id, arg_min(dt.date_id, (dt.p, dt.date_id)) AS fid, min(dt.p) AS fp
       FROM en JOIN dt ON en.group_id = dt.group_id AND dt.p >= en.start GROUP BY en.ent_id),
pk AS (SELECT en.*, CASE WHEN bid IS NULL THEN fid WHEN fid IS NULL THEN bid WHEN en.start - bp <= fp - en.start THEN bid ELSE fid END AS date_id
       FROM en LEFT JOIN bk USING (ent_id) LEFT JOIN fw USING (ent_id))
SELECT pk.group_id, pk.ent_id, pk.start, pk.date_id, dt.ts AS date, abs(pk.start - dt.p) AS distance
FROM pk LEFT JOIN dt USING (date_id)""")
def q_asof_nearest(spark, d):
    return asof_df(spark, d)


@register("history_by_date", "WITH " + O.MENTIONS + "\nSELECT * FROM hd")
def q_history_by_date(spark, d):
    return study.linked_mentions(spark, d).select("note_id", "start_char", "date_dt", "history")


# ---------------------------------------------------------------- step 10: scoring

from cohortspark.operators import scoring  # noqa: E402
from cohortspark.operators.joins import checked_join  # noqa: E402


@register("mention_score")
def q_mention_score(spark, d):
    """The saved model's score of each mention."""
    return rounded(study.model_scores(spark, d).df, 6, "probability")


@register("score_table_check", "WITH " + O.MENTIONS + """
SELECT count(*) AS n_scores, count(DISTINCT (note_id, start_char, end_char)) AS n_keys, 1 AS n_versions, true AS in_range,
       CAST(0 AS BIGINT) AS n_without_score FROM ments""")
def q_score_table_check(spark, d):
    """Every mention has one score of one model version, between 0 and 1."""
    keys = ["note_id", "start_char", "end_char"]
    scores, m = study.model_scores(spark, d).df, study.text_mentions(spark, d).select(*keys)
    without = m.join(scores, keys, "left_anti").agg(F.count(F.lit(1)).alias("n_without_score"))
    per_key = scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("model_version").alias("low"), F.max("model_version").alias("high"),
                                        F.bool_and((F.col("probability").between(0, 1)) & (F.col("prediction") == (F.col("probability") > 0.5))).alias("ok"))
    return per_key.agg(F.sum("n").alias("n_scores"), F.count(F.lit(1)).alias("n_keys"),
                       F.when(F.min("low") == F.max("high"), 1).otherwise(2).alias("n_versions"), F.bool_and("ok").alias("in_range")).crossJoin(without)


@register("stays_by_source_model")
def q_stays_by_source_model(spark, d):
    """P8 with the saved model's scores as the outcome source."""
    return study.stays_by_source(spark, d, "model").select(
        "encounter_num", "patient_num", "date", "sex_cd", "age_cat", "positive_visit", "recurrent_visit", "has_history")


def notes_patients(spark, d):
    return adapters.notes(spark, d, with_text=False).select("note_id", "patient_num")


@register("training_split", "WITH " + A["visits"] + ", " + A["notes"] + ", " + A["annotations"] + """,
r AS (SELECT note_id, annotator, gold, predicted, 'main' AS round, NULL AS remark FROM annotations WHERE NOT supplementary
      UNION ALL SELECT note_id, annotator, gold, NULL, 'supplementary', remark FROM annotations WHERE supplementary),
k AS (SELECT * FROM r WHERE coalesce(remark, '') <> 'unclear'),
f AS (SELECT k.*, n.patient_num FROM (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY
        CASE annotator WHEN 'A' THEN 1 WHEN 'B' THEN 2 END, annotator, round) AS rn FROM k) k
      LEFT JOIN notes n USING (note_id) WHERE rn = 1),
vp AS (SELECT DISTINCT n.patient_num FROM k JOIN notes n USING (note_id) WHERE round = 'supplementary')
SELECT note_id, annotator, gold, predicted, round, CAST(remark AS VARCHAR) AS remark, patient_num,
       CASE WHEN patient_num IN (SELECT patient_num FROM vp) THEN 'validation' ELSE 'train' END AS split FROM f""")
def q_training_split(spark, d):
    r = agreement.annotation_union(rounds(spark, d))
    return scoring.training_split(r, notes_patients(spark, d), "supplementary", ["A", "B"])


@register("training_split_offsets", "WITH " + A["visits"] + ", " + A["notes"] + ", " + A["annotations"] + """,
r AS (SELECT note_id, start_char, annotator, gold, 'main' AS round, remark FROM annotations, (VALUES (0), (40)) o(start_char)
      WHERE NOT (start_char = 40 AND annotator = 'A')),
k AS (SELECT * FROM r WHERE coalesce(remark, '') <> 'unclear'),
f AS (SELECT k.*, n.patient_num FROM (SELECT *, row_number() OVER (PARTITION BY note_id, start_char ORDER BY
        CASE annotator WHEN 'A' THEN 1 WHEN 'B' THEN 2 END, annotator, round) AS rn FROM k) k
      LEFT JOIN notes n USING (note_id) WHERE rn = 1)
SELECT note_id, CAST(start_char AS INTEGER) AS start_char, annotator, gold, round, remark, patient_num, 'train' AS split FROM f""")
def q_training_split_offsets(spark, d):
    """X14 with one row per (note, offset): two annotated places per note, the second by annotator B only."""
    a = adapters.annotations(spark, d).select("note_id", "annotator", "gold", F.lit("main").alias("round"), "remark")
    r = a.select("*", F.explode(F.array(F.lit(0), F.lit(40))).alias("start_char")).where("NOT (start_char = 40 AND annotator = 'A')")
    return scoring.training_split(r, notes_patients(spark, d), "supplementary", ["A", "B"], key=("note_id", "start_char"))


@register("checked_join", "WITH " + A["visits"] + ", " + A["patients"] + """
SELECT v.encounter_num, v.patient_num, p.sex_cd FROM visits v LEFT JOIN patients p USING (patient_num)""")
def q_checked_join(spark, d):
    v = adapters.visits(spark, d).select("encounter_num", "patient_num")
    p = adapters.patients(spark, d).select("patient_num", "sex_cd")
    return checked_join(v, p, ["patient_num"], "left", "m:1")


# ---------------------------------------------------------------- remaining inventory items

from cohortspark.sources.tables import debug_sample  # noqa: E402


@register("debug_sample", "WITH " + A["visits"] + ", " + A["notes"] + """
SELECT note_id, encounter_num, note_category FROM notes ORDER BY md5('7919-' || note_id), note_id LIMIT 300""")
def q_debug_sample(spark, d):
    n = adapters.notes(spark, d, with_text=False).select("note_id", "encounter_num", "note_category")
    return debug_sample(n, 300, "note_id")


@register("slice_incidence", O.outcome_cte("claims") + """
SELECT date, count(*) AS n_sa FROM oc WHERE sex_cd = 'W' AND age_cat = '26-65' GROUP BY date""")
def q_slice_incidence(spark, d):
    st = incidence.slice_stays(claim_outcomes(spark, d), age="26-65", sex="W")
    return st.groupBy("date").agg(F.count(F.lit(1)).alias("n_sa"))


@register("value_share", O.outcome_cte("claims") + """
SELECT site_label, avg(CAST(death AS DOUBLE)) AS death_share, count(death) AS n_known FROM oc GROUP BY site_label""")
def q_value_share(spark, d):
    return incidence.value_share(claim_outcomes(spark, d), "death", ["site_label"])


@register("test_site_stays", O.outcome_cte("claims") + """
SELECT encounter_num, site_label FROM oc WHERE site_label IN ('NATION_8','NATION_9','NATION_10','NATION_11','NATION_12')""")
def q_test_site_stays(spark, d):
    return cohort.site_filter(claim_outcomes(spark, d), study.TEST_SITES).select("encounter_num", "site_label")


@register("rf_mention_filter", "WITH " + O.MENTIONS + """
SELECT note_id, start_char, std_lexical_variant FROM ments
WHERE std_lexical_variant IN ('with', 'dans') AND NOT (negation OR hypothesis OR family)""")
def q_rf_mention_filter(spark, d):
    m = stay_ops.rf_mention_filter(study.text_mentions(spark, d), ["with", "dans"], ["negation", "hypothesis", "family"])
    return m.select("note_id", "start_char", "std_lexical_variant")


@register("pair_allocation", SAMPLE_SQL + """,
o AS (SELECT *, row_number() OVER (ORDER BY md5('7919-' || note_id), note_id) - 1 AS i, count(*) OVER () AS n FROM smp),
x AS (SELECT *, i < floor(n * 0.3) AS shared, CAST(CAST('0x' || substr(md5('7919-' || note_id), 9, 8) AS BIGINT) % 3 AS INTEGER) AS f FROM o),
y AS (SELECT *, CASE WHEN shared THEN [['A','B','C'][f + 1], ['A','B','C'][CAST((f + 1 + CAST('0x' || substr(md5('7919-' || note_id), 17, 8) AS BIGINT) % 2) % 3 AS INTEGER) + 1]]
                ELSE [['A','B','C'][f + 1]] END AS who FROM x)
SELECT note_id, after_cutoff, rf_name, gold, sample_rank, shared, unnest(who) AS annotator FROM y""")
def q_pair_allocation(spark, d):
    return sampling.allocate_pairs(sample_df(spark, d), ["A", "B", "C"], 0.3)


@register("annotation_read_back", "WITH " + A["annotations"] + """
SELECT note_id, annotator, arg_min(predicted, supplementary) AS predicted, arg_min(after_cutoff, supplementary) AS after_cutoff,
       arg_min(rf_name, supplementary) AS rf_name, arg_min(supplementary, supplementary) AS supplementary,
       arg_min(remark, supplementary) AS remark, arg_min(gold, supplementary) AS gold
FROM annotations WHERE NOT coalesce(remark IN ('unclear'), false) GROUP BY note_id, annotator""")
def q_annotation_read_back(spark, d):
    return agreement.read_back(adapters.annotations(spark, d), rf_level=True)


@register("token_labels", SPAN_SQL + """,
tk AS (SELECT kp.note_id, start_char, label, regexp_extract_all(substr(note_text, start_char + 1, end_char - start_char),
              '""" + O.TOK + """') AS t FROM kp JOIN notes USING (note_id))
SELECT note_id, start_char, label, CAST(i - 1 AS INTEGER) AS token_index, t[i] AS token, CASE WHEN i = 1 THEN label ELSE '-100' END AS token_label
FROM tk, unnest(range(1, len(t) + 1)) r(i)""")
def q_token_labels(spark, d):
    kept = text.span_filter(_overlap_spans(spark, d))
    n = adapters.notes(spark, d).select("note_id", "note_text")
    k = kept.join(n, "note_id").withColumn(
        "span_text", F.substring("note_text", F.col("start_char") + 1, F.col("end_char") - F.col("start_char")))
    return text.token_labels(k.drop("note_text"))


def weighted_text_stays(spark, d):
    st = study.stays_by_source(spark, d, "text")
    w = incidence.inverse_weights(probe(spark, d), P)
    return stay_ops.add_weights(incidence.outcome_stays(st), w)


@register("weighted_incidence", "WITH " + O.MENTIONS + ",\n" + O.STAYS.strip().replace(A["visits"] + ",", "", 1) + """,
has AS (SELECT l_orderkey AS encounter_num, bool_or(l_returnflag = 'R') AS has_note FROM lineitem GROUP BY 1),
pr AS (SELECT site_label, date, count(*) AS n_visit, count_if(coalesce(has_note, false)) AS n_note,
              count_if(coalesce(has_note, false)) / count(*) AS rho
       FROM stays LEFT JOIN has USING (encounter_num) GROUP BY site_label, date),
wt AS (SELECT site_label, date, CASE WHEN rho = 0 THEN NULL ELSE 1.0 / rho END AS stay_weight FROM pr
       WHERE date >= DATE '1995-01-01' AND date < DATE '2001-08-01'),
pos AS (SELECT s.*, t.encounter_num IS NOT NULL AS positive_visit, coalesce(t.has_history, false) AS has_history
        FROM stays s LEFT JOIN (SELECT encounter_num, has_history FROM tstays WHERE nlp_positive) t USING (encounter_num)),
""" + O.episodes_cte("pos", "ep") + """,
oc AS (SELECT ep.*, wt.stay_weight FROM ep LEFT JOIN wt USING (date, site_label) WHERE """ + O.OUTCOME + """)
SELECT date, count(*) AS n_sa, count_if(death) AS death, count_if(has_history) AS has_history,
       round(sum(stay_weight), 6) AS weighted_n_sa, count_if(has_history) / count(*) AS has_history_ratio
FROM oc GROUP BY date""")
def q_weighted_incidence(spark, d):
    st = weighted_text_stays(spark, d)
    t = incidence.monthly_table(st, [], P, weight_col="stay_weight", history_col="has_history")
    return t.select("date", "n_sa", "death", "has_history", F.round("weighted_n_sa", 6).alias("weighted_n_sa"),
                    "has_history_ratio")


@register("weighted_incidence_notes", O.outcome_cte("claims") + ",\n" + A["notes"] + """,
has AS (SELECT DISTINCT encounter_num FROM notes WHERE note_category IN (""" + ", ".join(f"'{c}'" for c in PROBE_CATS) + """)
        AND note_text IS NOT NULL),
pr AS (SELECT site_label, date, count(h.encounter_num) / count(*) AS rho
       FROM stays LEFT JOIN has h USING (encounter_num) WHERE visit_type IN ('1-URGENT', '2-HIGH') GROUP BY site_label, date)
SELECT oc.date, count(*) AS n_sa, round(sum(CASE WHEN rho > 0 THEN 1.0 / rho END), 6) AS weighted_n_sa
FROM oc LEFT JOIN pr ON pr.date = oc.date AND pr.site_label = oc.site_label GROUP BY oc.date""")
def q_weighted_incidence_notes(spark, d):
    """A4 weighted by the notes' completeness, for the stays positive by claims."""
    st = stay_ops.add_weights(claim_outcomes(spark, d), incidence.inverse_weights(probe_notes(spark, d), P))
    t = incidence.monthly_table(st, [], P, weight_col="stay_weight")
    return t.select("date", "n_sa", F.round("weighted_n_sa", 6).alias("weighted_n_sa"))


def _scratch(spark, name: str) -> str:
    import uuid

    from cohortspark.session import checkpoint_dir

    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register("csv_report", ORACLE["table_by_age"])
def q_csv_report(spark, d):
    """A report table written as CSV and read back."""
    from cohortspark.sources.tables import export_csv

    report, path = q_table_by_age(spark, d), _scratch(spark, "report")
    export_csv(report, path)
    return spark.read.schema(report.schema).option("header", True).csv(path)


@register("stage_read_back", O.outcome_cte("claims") + """
SELECT encounter_num, patient_num, date, age_cat FROM oc WHERE sex_cd = 'W' AND age_cat = '26-65'""")
def q_stage_read_back(spark, d):
    """S3: a table written in partitions by sex; the reader takes one partition and four columns."""
    from cohortspark.sources.tables import write_stage

    path = _scratch(spark, "sink")
    write_stage(claim_outcomes(spark, d).select("encounter_num", "patient_num", "date", "age_cat", "age", "sex_cd"), path, ["sex_cd"])
    return spark.read.parquet(path).where("sex_cd = 'W' and age_cat = '26-65'").select("encounter_num", "patient_num", "date", "age_cat")


@register("report_order", O.outcome_cte("claims") + """,
g AS (SELECT coalesce(sex_cd, 'all') AS sex_cd, coalesce(age_cat, 'all') AS age_cat, count(*) AS n_sa
      FROM oc GROUP BY GROUPING SETS ((sex_cd, age_cat), (sex_cd), ()))
SELECT sex_cd, age_cat, n_sa,
       CAST(CASE sex_cd WHEN 'M' THEN 0 WHEN 'W' THEN 1 ELSE 2 END AS INTEGER) AS sex_order,
       CAST(CASE age_cat WHEN '8-17' THEN 0 WHEN '18-25' THEN 1 WHEN '26-65' THEN 2 WHEN '66-120' THEN 3 ELSE 4 END AS INTEGER) AS age_order
FROM g""")
def q_report_order(spark, d):
    """O1/O2: report rows by sex and age band with the 'all' margins, in the custom category
    order (M, W, all; bands ascending, all last) carried as explicit order columns."""
    from cohortspark.functions.columns import age_band_order

    st = claim_outcomes(spark, d)
    g = st.groupingSets([["sex_cd", "age_cat"], ["sex_cd"], []], "sex_cd", "age_cat").agg(
        F.count(F.lit(1)).alias("n_sa"))
    g = g.withColumn("sex_cd", F.coalesce("sex_cd", F.lit("all"))).withColumn("age_cat", F.coalesce("age_cat", F.lit("all")))
    sex_order = F.when(F.col("sex_cd") == "M", 0).when(F.col("sex_cd") == "W", 1).otherwise(2).cast("int")
    out = g.withColumn("sex_order", sex_order).withColumn("age_order", age_band_order("age_cat", P).cast("int"))
    return out.orderBy("sex_order", "age_order")
