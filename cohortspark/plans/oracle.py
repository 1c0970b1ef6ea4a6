"""DuckDB oracle SQL for the registered queries: the same study written independently as
plain SQL over the driver's tables (views named after the Parquet files)."""

from __future__ import annotations

from cohortspark.sources.adapters import SQL as A

DELTA = 15 * 86400
AGE_BAND = """CASE WHEN age > 7 AND age <= 17 THEN '8-17' WHEN age > 17 AND age <= 25 THEN '18-25'
                   WHEN age > 25 AND age <= 65 THEN '26-65' WHEN age > 65 AND age <= 120 THEN '66-120'
                   ELSE 'Unknown' END"""

STAYS = f"""
{A['visits']},
{A['patients']},
patients_site AS (
  SELECT p.*, n_name AS site_label, r_name AS site_type
  FROM patients p LEFT JOIN (customer JOIN nation ON c_nationkey = n_nationkey
                             JOIN region ON n_regionkey = r_regionkey) ON p.patient_num = c_custkey),
stays0 AS (
  SELECT v.*, ps.birth_date, coalesce(ps.sex_cd, 'Unknown') AS sex_cd, ps.site_label, ps.site_type,
         CAST(floor((epoch(v.visit_start_date) - epoch(CAST(ps.birth_date AS TIMESTAMP))) / 31556952) AS INTEGER) AS age,
         CAST(date_trunc('month', v.visit_start_date) AS DATE) AS date,
         CAST(epoch(v.visit_end_date) - epoch(v.visit_start_date) AS DOUBLE) AS duration_seconds,
         coalesce(v.discharge_mode = 'death', false) AS death
  FROM visits v LEFT JOIN patients_site ps USING (patient_num)),
stays AS (SELECT *, {AGE_BAND} AS age_cat, CAST(year(date) AS INTEGER) AS year FROM stays0)"""


def episodes_cte(src: str, name: str) -> str:
    return f"""{name} AS (
  SELECT s.*, coalesce(e.recurrent_visit, false) AS recurrent_visit
  FROM {src} s LEFT JOIN (
    SELECT encounter_num,
           NOT (prev_end IS NULL OR epoch(visit_start_date) - epoch(prev_end) > {DELTA}) AS recurrent_visit
    FROM (SELECT encounter_num, visit_start_date,
                 max(visit_end_date) OVER (PARTITION BY patient_num
                     ORDER BY visit_start_date ASC, visit_end_date DESC NULLS LAST, encounter_num ASC
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_end
          FROM {src}
          WHERE positive_visit AND visit_start_date IS NOT NULL AND patient_num IS NOT NULL)
  ) e USING (encounter_num))"""


CLAIM_POS = f"""
{A['claims']},
claim_pos AS (
  SELECT encounter_num,
         list_sort(list_distinct(list(CASE WHEN diag_type = 'DAS' AND substr(concept_cd, 7, 1) = 'X'
                AND TRY_CAST(substr(concept_cd, 8, 2) AS INTEGER) BETWEEN 60 AND 84
                THEN TRY_CAST(substr(concept_cd, 8, 2) AS INTEGER) END))) AS number_codes
  FROM claims GROUP BY encounter_num
  HAVING bool_or(diag_type = 'DP' AND ((substr(concept_cd, 7, 1) = 'S' AND TRY_CAST(substr(concept_cd, 8, 2) AS INTEGER) BETWEEN 0 AND 99)
                                      OR (substr(concept_cd, 7, 1) = 'T' AND TRY_CAST(substr(concept_cd, 8, 2) AS INTEGER) BETWEEN 0 AND 98)))
     AND bool_or(diag_type = 'DAS' AND substr(concept_cd, 7, 1) = 'X' AND TRY_CAST(substr(concept_cd, 8, 2) AS INTEGER) BETWEEN 60 AND 84))"""


def stays_tail(source: str) -> str:
    """CTEs from the text roll-up ``source`` (text: rule, ml: model) to ``ep``."""
    t = {"text": "tstays", "ml": "mlstays"}[source]
    return f""",
pos AS (SELECT s.*, coalesce(t.nlp_positive, false) AS positive_visit, coalesce(t.has_history AND t.nlp_positive, false) AS has_history
        FROM stays s LEFT JOIN {t} t USING (encounter_num)),
{episodes_cte('pos', 'ep')}"""


def stays_source(source: str, head: bool = False) -> str:
    """CTE chain ending in ``ep`` (stays + positive_visit + recurrent_visit); with ``head`` only the
    stays, for a chain that goes on by itself."""
    if head:
        return f"WITH {STAYS}"
    if source == "all":
        pos = "pos AS (SELECT *, true AS positive_visit FROM stays)"
        return f"WITH {STAYS},\n{pos},\n{episodes_cte('pos', 'ep')}"
    if source == "claims":
        pos = ("pos AS (SELECT s.*, c.encounter_num IS NOT NULL AS positive_visit "
               "FROM stays s LEFT JOIN claim_pos c USING (encounter_num))")
        return f"WITH {STAYS},\n{CLAIM_POS},\n{pos},\n{episodes_cte('pos', 'ep')}"
    return f"WITH {STAYS}, {MENTION_BODY}{stays_tail(source)}"


OUTCOME = """ep.positive_visit AND sex_cd NOT IN ('Unknown', 'U') AND age_cat <> 'Unknown'
  AND date >= DATE '1995-01-01' AND date < DATE '2001-08-01' AND NOT recurrent_visit"""

MONTHLY_TAIL = """, n_sa, death, mean_duration, CAST(month(date) AS INTEGER) AS month, CAST(year(date) AS INTEGER) AS year,
  monthname(date) AS month_name, CASE WHEN n_sa = 0 THEN NULL ELSE death / n_sa END AS death_ratio"""


# ---------------------------------------------------------------- text path
# RE2 has no look-behind: whole words are found by consuming the left boundary character
# (group 1) and checking the right one afterwards; offsets add the left boundary back.
WB = r"[^\p{L}\p{N}_]"
TOK = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
LEX_WORDS = "with|from|pour|dans|avec"
CUE_WORDS = {"negation": "pas|not|no|sans", "hypothesis": "for|if|si|may", "family": "family|mother|father|famille",
             "history": "was|history", "rspeech": "that|says|dit"}
ALL_CUES = "|".join(CUE_WORDS.values())
SENT = r"[^.!?\n]+[.!?]*"
HEAD = r"(?m)^[\p{L}\p{N}][\p{L}\p{N} ''’/()-]*:"


def _word_spans(text: str, words: str, name: str, src: str, keep: str) -> str:
    pat = f"(?i)(^|{WB})({words})"
    return f"""{name}0 AS (
  SELECT {keep}, {text} AS _t, string_split_regex({text}, '{pat}') AS g,
         regexp_extract_all({text}, '{pat}', 0) AS mf, regexp_extract_all({text}, '{pat}', 2) AS mw FROM {src}),
{name}1 AS (
  SELECT {keep}, _t, i, mw[i] AS word,
         CAST(list_sum(list_transform(g[1:i], lambda x: length(x)))
           + coalesce(list_sum(list_transform(mf[1:i-1], lambda x: length(x))), 0)
           + length(mf[i]) - length(mw[i]) AS BIGINT) AS start_char,
         CAST(0 AS BIGINT) AS tok
  FROM {name}0, unnest(range(1, len(mw) + 1)) r(i)),
{name} AS (SELECT * EXCLUDE (tok), CAST(len(regexp_extract_all(substr(_t, 1, start_char), '{TOK}')) AS BIGINT) AS tok
  FROM {name}1 WHERE NOT regexp_matches(substr(_t, start_char + length(word) + 1, 1), '[\\p{{L}}\\p{{N}}_]'))"""


def _plain_starts(text: str, pat: str) -> str:
    """list of 0-based starts of the matches of ``pat`` in ``text``."""
    return f"""list_transform(range(1, len(regexp_extract_all({text}, '{pat}')) + 1), lambda j:
      CAST(list_sum(list_transform(string_split_regex({text}, '{pat}')[1:j], lambda x: length(x)))
      + coalesce(list_sum(list_transform(regexp_extract_all({text}, '{pat}')[1:j-1], lambda x: length(x))), 0) AS BIGINT))"""


def boundary_spans(text: str, alts: str, name: str, src: str, keep: str, wb: str, flags: str = "") -> str:
    """Spans of ``alts`` with a consumed left boundary ``wb`` and a checked right one."""
    pat = f"{flags}(^|{wb})({alts})"
    right = wb[:1] + wb[2:] if wb.startswith("[^") else wb
    return f"""{name}0 AS (
  SELECT {keep}, {text} AS _t, string_split_regex({text}, '{pat}') AS g,
         regexp_extract_all({text}, '{pat}', 0) AS mf, regexp_extract_all({text}, '{pat}', 2) AS mw FROM {src}),
{name}1 AS (
  SELECT {keep}, _t, mw[i] AS word,
         CAST(list_sum(list_transform(g[1:i], lambda x: length(x)))
           + coalesce(list_sum(list_transform(mf[1:i-1], lambda x: length(x))), 0)
           + length(mf[i]) - length(mw[i]) AS BIGINT) AS start_char
  FROM {name}0, unnest(range(1, len(mw) + 1)) r(i)),
{name} AS (SELECT * FROM {name}1 WHERE NOT regexp_matches(substr(_t, start_char + length(word) + 1, 1), '{right}'))"""


SELECTED_BODY = f"""
{A['notes']},
sel0 AS (SELECT note_id, encounter_num, patient_num, note_category, document_datetime, note_text,
   row_number() OVER (PARTITION BY encounter_num ORDER BY
     CASE WHEN note_category IS NULL OR note_category = 'src0' THEN 0 ELSE 1 END DESC,
     document_datetime DESC, note_id DESC) AS rn FROM notes),
all_sel AS (SELECT * EXCLUDE (rn) FROM sel0 WHERE rn = 1),
sel AS (SELECT * FROM all_sel WHERE regexp_matches(note_text, '(?i)(^|{WB})({LEX_WORDS})({WB}|$)'))"""

SELECTED_NOTES = A["visits"] + ", " + SELECTED_BODY

_UNITS = r"days?|jours?|weeks?|semaines?|months?|mois|years?|ans?"
_NAMES = ("january|february|march|april|may|june|july|august|september|october|november|december|"
          "janvier|février|mars|avril|mai|juin|juillet|août|septembre|octobre|novembre|décembre")
_WB = r"[^\p{L}\p{N}_]"
_DAY = "[0-9]{1,2}(?:er|st|nd|rd|th)?"
_DATE_FORMS = [
    ("relative", "past", f"il y a [0-9]+ (?:{_UNITS})|[0-9]+ (?:{_UNITS}) ago"),
    ("relative", "future", f"(?:dans|in) [0-9]+ (?:{_UNITS})"),
    ("relative", "near", "avant-hier|hier|yesterday|aujourd[''’]hui|today|demain|tomorrow|après-demain"),
    ("duration", "duration", f"(?:pendant|during) [0-9]+ (?:{_UNITS})"),
    ("amount", "amount", f"[0-9]+ (?:{_UNITS})"),
    ("absolute", "ymd", "[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}"),
    ("absolute", "dmy", "[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}[.][0-9]{1,2}[.][0-9]{4}|[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}"),
    ("absolute", "short", "[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}|[0-9]{1,2}[.][0-9]{1,2}[.][0-9]{2}"),
    ("absolute", "named", f"{_DAY} (?:{_NAMES}) [0-9]{{4}}|(?:{_NAMES}) {_DAY},? [0-9]{{4}}"),
    ("absolute", "name_y", f"(?:{_NAMES}) [0-9]{{4}}"),
    ("absolute", "day_name", f"{_DAY} (?:{_NAMES})|(?:{_NAMES}) {_DAY}"),
    ("absolute", "year", "(?:19|20)[0-9]{2}"),
]
#: every form is searched alone; of dates that overlap, the one that begins first stays, there the longest
DATE_CTES = ",\n".join(boundary_spans("note_text", p, f"d_{form}", "sel", "note_id, encounter_num", _WB, "(?i)") for _, form, p in _DATE_FORMS) + r""",
dst AS (SELECT note_id, """ + _plain_starts("note_text", SENT) + r""" AS ss FROM sel),
dall AS (""" + " UNION ALL ".join(f"SELECT '{label}' AS label, '{form}' AS form, * FROM d_{form}" for label, form, _ in _DATE_FORMS) + r"""),
dm0 AS (SELECT x.* FROM dall x WHERE x.label <> 'amount' AND NOT EXISTS (SELECT 1 FROM dall y WHERE y.note_id = x.note_id
          AND y.start_char < x.start_char + length(x.word) AND x.start_char < y.start_char + length(y.word)
          AND (y.start_char < x.start_char OR (y.start_char = x.start_char AND length(y.word) > length(x.word))))),
mn AS (SELECT * FROM (VALUES """ + ", ".join(
    f"('{n}', {i % 12 + 1})" for i, n in enumerate(_NAMES.split("|"))) + r""") t(month_name, month_no)),
nw AS (SELECT * FROM (VALUES ('avant-hier', -2), ('hier', -1), ('yesterday', -1), ('aujourd''hui', 0), ('today', 0), ('demain', 1), ('tomorrow', 1),
       ('après-demain', 2)) t(near_word, away)),
dm1 AS (SELECT note_id, encounter_num, label, form, word AS match, CAST(start_char AS INTEGER) AS start_char,
               CAST(start_char + length(word) AS INTEGER) AS end_char,
               CAST(len(regexp_extract_all(substr(_t, 1, start_char), '""" + TOK + r"""')) AS INTEGER) AS start,
               CAST(len(list_filter(ss, lambda b: b <= start_char)) - 1 AS INTEGER) AS sent_id,
               list_transform(regexp_extract_all(word, '[0-9]+'), lambda z: TRY_CAST(z AS INTEGER)) AS n, replace(lower(word), '’', '''') AS w
        FROM dm0 JOIN dst USING (note_id)),
dm2 AS (SELECT dm1.*, month_no, away FROM dm1 LEFT JOIN mn ON label = 'absolute' AND regexp_extract(w, '[^0-9 ,]{3,}') = month_name
        LEFT JOIN nw ON form = 'near' AND w = near_word),
dm3 AS (SELECT note_id, encounter_num, label, match, start_char, end_char, start, sent_id,
               CAST(CASE form WHEN 'ymd' THEN n[1] WHEN 'name_y' THEN n[1] WHEN 'year' THEN n[1] WHEN 'dmy' THEN n[3] WHEN 'named' THEN n[2]
                    WHEN 'short' THEN n[3] + CASE WHEN n[3] <= 68 THEN 2000 ELSE 1900 END END AS INTEGER) AS year,
               CAST(CASE WHEN form IN ('ymd', 'dmy', 'short') THEN n[2] ELSE month_no END AS INTEGER) AS month,
               CAST(CASE WHEN form = 'ymd' THEN n[3] WHEN form IN ('dmy', 'short', 'named', 'day_name') THEN n[1] END AS INTEGER) AS day,
               CAST(CASE WHEN form = 'near' THEN abs(away) WHEN label <> 'absolute' THEN n[1] END AS INTEGER) AS value,
               CASE WHEN form = 'near' THEN 'day' WHEN label <> 'absolute' THEN regexp_extract(w, '[0-9]+ ([a-z]+)', 1) END AS unit,
               CASE WHEN label = 'relative' THEN CASE WHEN form = 'future' OR away > 0 THEN 'future' ELSE 'past' END END AS direction FROM dm2),
dm AS (SELECT *, CASE WHEN label = 'absolute' THEN TRY_CAST(printf('%04d-%02d-%02d', year, coalesce(month, 1), coalesce(day, 1)) AS DATE) END
         AS date_dt FROM dm3),
un AS (SELECT * FROM (VALUES ('day', 1, 0), ('days', 1, 0), ('jour', 1, 0), ('jours', 1, 0), ('week', 7, 0), ('weeks', 7, 0),
       ('semaine', 7, 0), ('semaines', 7, 0), ('month', 0, 1), ('months', 0, 1), ('mois', 0, 1), ('year', 0, 12), ('years', 0, 12),
       ('an', 0, 12), ('ans', 0, 12)) t(unit, unit_days, unit_months)),
rel0 AS (SELECT dm.*, v.visit_start_date, CAST(value AS BIGINT) * unit_days AS far_days, CAST(value AS BIGINT) * unit_months AS far_months,
               CASE direction WHEN 'future' THEN 1 ELSE -1 END AS sign
        FROM dm LEFT JOIN un USING (unit) LEFT JOIN visits v USING (encounter_num)),
rel AS (SELECT * EXCLUDE (far_days, far_months, sign) REPLACE (CASE
            WHEN label = 'absolute' THEN coalesce(date_dt, CASE WHEN year IS NULL THEN
                 TRY_CAST(printf('%04d-%02d-%02d', year(visit_start_date), coalesce(month, 1), coalesce(day, 1)) AS DATE) END)
            WHEN label <> 'relative' THEN date_dt
            WHEN far_days <= 500000 AND far_months <= 12000 THEN
                 CAST(CAST(visit_start_date AS DATE) + to_days(CAST(sign * far_days AS INTEGER)) + to_months(CAST(sign * far_months AS INTEGER)) AS DATE)
          END AS date_dt) FROM rel0),
cd AS (SELECT note_id, encounter_num, label, start_char, start, sent_id, date_dt, coalesce(date_dt = birth, false) AS is_birth_date
       FROM rel JOIN visits v USING (encounter_num)
       LEFT JOIN (SELECT c_custkey, DATE '1993-01-01' - CAST(c_custkey * 37 % 30000 AS INTEGER) AS birth FROM customer) p
         ON v.patient_num = c_custkey
       WHERE label <> 'duration' AND date_dt IS NOT NULL)"""



_CLS = " ".join(f"WHEN regexp_matches(lower(word), '^({w})$') THEN '{k}'" for k, w in CUE_WORDS.items())

def mention_ctes(words: str, name: str, src: str, before: str = "") -> str:
    """CTEs ending in ``name``: mentions of ``words`` in the notes of ``src``."""
    n = name
    return (before + "," if before else "") + f"""
{_word_spans('note_text', words, n + 'lx', src, 'note_id, encounter_num')},
{_word_spans('note_text', ALL_CUES, n + 'cu', src, 'note_id')},
{n}sst AS (SELECT note_id, {_plain_starts('note_text', SENT)} AS ss,
               {_plain_starts('note_text', HEAD)} AS hs, regexp_extract_all(note_text, '{HEAD}') AS ht,
               regexp_extract_all(note_text, '{TOK}') AS w FROM {src}),
{n}cues AS (SELECT c.note_id, list({{'start': c.start_char, 'cls': CASE {_CLS} END,
                 'sent': len(list_filter(s.ss, lambda b: b <= c.start_char)) - 1}}) AS cl
         FROM {n}cu c JOIN {n}sst s USING (note_id) GROUP BY c.note_id),
{n}0m AS (
  SELECT m.note_id, m.encounter_num, m.word AS lexical_variant, lower(m.word) AS std_lexical_variant,
         CAST(m.start_char AS INTEGER) AS start_char, CAST(m.start_char + length(m.word) AS INTEGER) AS end_char,
         CAST(m.tok AS INTEGER) AS start, CAST(m.tok + 1 AS INTEGER) AS "end",
         CAST(len(list_filter(s.ss, lambda b: b <= m.start_char)) - 1 AS INTEGER) AS sent_id,
         lower(regexp_replace(list_filter(list_zip(s.hs, s.ht), lambda h: h[1] <= m.start_char)[-1][2], ':$', ''))
           AS section,
         list_slice(s.w, greatest(m.tok - 35, 0) + 1, m.tok + 1 + 10) AS words,
         CAST(m.tok - greatest(m.tok - 35, 0) AS INTEGER) AS word_index,
         substr(m._t, greatest(m.start_char - 35, 0) + 1, m.start_char + length(m.word) + 35 - greatest(m.start_char - 35, 0)) AS snippet,
         CAST(m.start_char - greatest(m.start_char - 35, 0) AS INTEGER) AS snippet_start,
         CAST(m.start_char + length(m.word) - greatest(m.start_char - 35, 0) AS INTEGER) AS snippet_end,
         coalesce(c.cl, []) AS cl
  FROM {n}lx m JOIN {n}sst s USING (note_id) LEFT JOIN {n}cues c USING (note_id)),
{n} AS (
  SELECT * EXCLUDE (cl, sent0, start0),
  FROM (SELECT *, sent_id AS sent0, start_char AS start0,
    len(list_filter(cl, lambda c: c.cls = 'negation' AND c.sent = sent_id AND c.start < start_char)) > 0 AS negation,
    len(list_filter(cl, lambda c: c.cls = 'hypothesis' AND c.sent = sent_id AND c.start < start_char)) > 0 AS hypothesis,
    len(list_filter(cl, lambda c: c.cls = 'family' AND c.sent = sent_id AND c.start < start_char)) > 0 AS family,
    len(list_filter(cl, lambda c: c.cls = 'history' AND c.sent = sent_id AND c.start < start_char)) > 0
      OR coalesce(section IN ('was', 'history'), false) AS history,
    len(list_filter(cl, lambda c: c.cls = 'rspeech' AND c.sent = sent_id AND c.start < start_char)) > 0 AS rspeech
  FROM {n}0m))"""


#: mentions, their nearest date of the sentence by an explicit ranking, flags and both roll-ups
MENTION_TAIL = """,
lk0 AS (SELECT m.note_id, m.start_char, c.date_dt, c.is_birth_date, row_number() OVER (PARTITION BY m.note_id, m.start_char
          ORDER BY abs(m.start - c.start), c.start, CASE WHEN c.start <= m.start THEN -c.start_char ELSE c.start_char END) AS rn
        FROM ments m JOIN cd c USING (note_id, sent_id)),
hd AS (SELECT m.note_id, m.start_char, l.date_dt, m.history OR coalesce(
         epoch(v.visit_start_date) - epoch(CAST(l.date_dt AS TIMESTAMP)) >= 1296000 AND NOT l.is_birth_date, false) AS history
       FROM ments m LEFT JOIN (SELECT * FROM lk0 WHERE rn = 1) l USING (note_id, start_char)
       LEFT JOIN visits v ON v.encounter_num = m.encounter_num),
lm AS (SELECT m.* REPLACE (hd.history AS history), (m.note_id + m.start_char) % 4 = 0 AS prediction
       FROM ments m JOIN hd USING (note_id, start_char)),
fm AS (SELECT *, NOT (negation OR family OR history OR hypothesis OR rspeech) AS instance_flag,
              history AND NOT (negation OR family OR hypothesis) AS history_flag FROM lm),
tstays AS (
  SELECT encounter_num, list_sort(list_distinct(list(note_id))) AS note_ids,
         list_sort(list_distinct(list(std_lexical_variant))) AS std_lexical_variants,
         count(*) AS n_mentions, bool_or(instance_flag) AS has_instance, bool_or(history_flag) AS has_history,
         count_if(instance_flag) AS n_positive_mentions,
         CASE WHEN count_if(instance_flag) > 0 THEN list_sort(list(std_lexical_variant) FILTER (WHERE instance_flag)) END
           AS std_positive_lexical_variants,
         count_if(instance_flag) >= 1 AS nlp_positive
  FROM fm GROUP BY encounter_num),
mlstays AS (
  SELECT encounter_num, list_sort(list_distinct(list(note_id))) AS note_ids,
         list_sort(list_distinct(list(std_lexical_variant))) AS std_lexical_variants,
         count(*) AS n_mentions, bool_or(prediction) AS has_instance, bool_or(history_flag) AS has_history,
         count_if(prediction) AS n_positive_mentions,
         CASE WHEN count_if(prediction) > 0 THEN list_sort(list(std_lexical_variant) FILTER (WHERE prediction)) END
           AS std_positive_lexical_variants,
         count_if(prediction) >= 1 AS nlp_positive
  FROM fm GROUP BY encounter_num)"""

MENTION_BODY = SELECTED_BODY + ", " + DATE_CTES + ", " + mention_ctes(LEX_WORDS, "ments", "sel") + MENTION_TAIL
MENTIONS = A["visits"] + ", " + MENTION_BODY


def outcome_cte(source: str = "claims") -> str:
    """CTE chain ending in ``oc``: the stays an analysis counts."""
    return stays_source(source) + f",\noc AS (SELECT * FROM ep WHERE {OUTCOME})"
