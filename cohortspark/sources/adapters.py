"""Driver tables presented as study tables.

The study works on stays, patients, notes, claims and annotations. The driver ships a
TPC-H-like star schema plus text tables, so each study table is a projection of a driver
table with plain arithmetic; the same expressions are written once more in SQL (``SQL``)
so that DuckDB can serve as an independent oracle on the same Parquet files.

Fixed values of the mapping (kept together here):
  stays      = orders; stay end = start + (key % 20 + 1) days, open (null) when status 'P';
               discharge 'death' when status 'F' and key % 50 = 0, else 'home'
  patients   = customer; sex null when key % 10 = 0, else even 'M' / odd 'W';
               birth = 1993-01-01 minus (key * 37 % 30000) days
  sites      = customer nation (label) and its region (site type)
  claims     = lineitem x part; line 1 is the main diagnosis 'DP', others 'DAS';
               code 'ICD10:' + letter (part size % 3 -> S, T, X) + two digits (part key % 100)
  notes      = documents; stay = doc_id div 3; time = stay start + doc_id % 5 days;
               category = source, 'src0' is the unknown category; the text is preceded by
               dated lines in one of four forms (doc_id % 4), their date = stay start - doc_id % 60 days
  annotators = labels; annotator A says quality = 1, B says toxic = 0; prediction doc_id % 3 > 0;
               post-cutoff period when doc_id is even; supplementary round when doc_id % 5 = 0
  as-of      = events; 'purchase' rows are mentions, 'view' rows are dates, user = group
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.sources.tables import read_table


# fixed values: English and French month names
EN_MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
FR_MONTHS = ["janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"]


def _days(n):
    return F.make_dt_interval(days=n.cast("int"))


def visits(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders")
    key = F.col("o_orderkey")
    return o.select(
        key.alias("encounter_num"),
        F.col("o_custkey").alias("patient_num"),
        F.col("o_orderdate").alias("visit_start_date"),
        F.when(F.col("o_orderstatus") == "P", F.lit(None).cast("timestamp_ntz"))
        .otherwise(F.col("o_orderdate") + _days(key % 20 + 1))
        .alias("visit_end_date"),
        F.col("o_orderpriority").alias("visit_type"),
        F.col("o_orderstatus").alias("admission_mode"),
        F.when((F.col("o_orderstatus") == "F") & (key % 50 == 0), F.lit("death"))
        .otherwise(F.lit("home"))
        .alias("discharge_mode"),
    )


def patients(spark: SparkSession, d: str, extra: list[str] = ()) -> DataFrame:
    c = read_table(spark, d, "customer")
    key = F.col("c_custkey")
    return c.select(
        *extra,
        key.alias("patient_num"),
        F.date_sub(F.lit("1993-01-01").cast("date"), (key * 37 % 30000).cast("int")).alias("birth_date"),
        F.when(key % 10 == 0, F.lit(None).cast("string"))
        .when(key % 2 == 0, F.lit("M"))
        .otherwise(F.lit("W"))
        .alias("sex_cd"),
    )


def stay_sites(spark: SparkSession, d: str) -> DataFrame:
    """Site (label, type) of each stay. nation/region have a fixed size (25/5 rows): broadcast."""
    o = read_table(spark, d, "orders", ["o_orderkey", "o_custkey"])
    c = read_table(spark, d, "customer", ["c_custkey", "c_nationkey"])
    n = read_table(spark, d, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    r = read_table(spark, d, "region", ["r_regionkey", "r_name"])
    dim = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(
        F.col("n_nationkey").alias("site_code"), F.col("n_name").alias("site_label"), F.col("r_name").alias("site_type")
    )
    return (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(F.broadcast(dim), F.col("c_nationkey") == F.col("site_code"))
        .select(F.col("o_orderkey").alias("encounter_num"), "site_code", "site_label", "site_type")
    )


def site_dimension(spark: SparkSession, d: str) -> DataFrame:
    n = read_table(spark, d, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    r = read_table(spark, d, "region", ["r_regionkey", "r_name"])
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(
        F.col("n_name").alias("site_label"), F.col("r_name").alias("site_type")
    )


def claims(spark: SparkSession, d: str) -> DataFrame:
    li = read_table(spark, d, "lineitem", ["l_orderkey", "l_partkey", "l_linenumber"])
    p = read_table(spark, d, "part", ["p_partkey", "p_size"])
    letter = F.when(F.col("p_size") % 3 == 0, "S").when(F.col("p_size") % 3 == 1, "T").otherwise("X")
    number = F.lpad((F.col("l_partkey") % 100).cast("string"), 2, "0")
    return li.join(p, li.l_partkey == p.p_partkey).select(
        F.col("l_orderkey").alias("encounter_num"),
        F.col("l_linenumber").alias("instance_num"),
        F.when(F.col("l_linenumber") == 1, "DP").otherwise("DAS").alias("diag_type"),
        F.concat(F.lit("ICD10:"), letter, number).alias("concept_cd"),
    )


def _dated_line():
    """The dated first line of a note, in four forms."""
    i, day = F.col("doc_id"), F.date_sub(F.to_date("visit_start_date"), (F.col("doc_id") % 60).cast("int"))
    named = lambda names: F.element_at(F.array(*[F.lit(m) for m in names]), F.month(day))
    month = named(FR_MONTHS)
    text = lambda n: n.cast("string")
    return (
        F.when(i % 4 == 0, F.concat(F.lit("===== Page 1/2 =====\nSeen  with   pain on "), F.date_format(day, "dd/MM/yyyy"), F.lit(", review in "),
                                    text(i % 6 + 2), F.lit(" days.\n")))
        .when(i % 4 == 1, F.concat(F.lit("History:\nCame from home on "), F.date_format(day, "yyyy-MM-dd"),
                                    F.lit(".\nPlan/follow-up:\nBilan du "), F.date_format(day, "dd.MM.yyyy"), F.lit(", lettre du "),
                                    F.date_format(day, "d/M/yy"), F.lit(", noted "), named(EN_MONTHS), F.lit(" "), text(F.dayofmonth(day)),
                                    F.lit(", "), F.date_format(day, "yyyy"), F.lit(", vu hier; il y a 2010 jours, il y a 999999999 ans.\n")))
        .when(i % 4 == 2, F.concat(F.lit("Venu avec douleur il y a "), text(i % 5 + 1), F.lit(" mois pendant 3 jours, vu en "),
                                   month, F.lit(" "), F.date_format(day, "yyyy"),
                                    F.lit(".\nDouleur avec fièvre exclue, not with care but with food. Not only with it.\n")))
        .otherwise(F.concat(F.lit("Parti pour soins le "), text(F.dayofmonth(day)), F.lit(" "), month, F.lit(" "),
                            F.date_format(day, "yyyy"), F.lit(", revu dans "), text(i % 7 + 2), F.lit(" semaines, suivi depuis "),
                            text(F.year(day) - 2), F.lit(", rappel le "), text(F.dayofmonth(day)), F.lit(" "), month, F.lit(".\n")))
    )


def notes(spark: SparkSession, d: str, with_text: bool = True, chosen: DataFrame | None = None,
          stays: DataFrame | None = None) -> DataFrame:
    """``chosen`` (encounter_num, note_id; one row per stay): these notes only. ``stays``: the visits of the notes,
    if they are known. All joins are by stay, so that a text is shuffled once at most."""
    doc = read_table(spark, d, "documents")
    v = (visits(spark, d) if stays is None else stays).select("encounter_num", "patient_num", "visit_start_date")
    cols = [
        F.col("doc_id").alias("note_id"),
        F.col("encounter_num"),
        F.col("patient_num"),
        F.col("source").alias("note_category"),
        (F.col("visit_start_date") + _days(F.col("doc_id") % 5)).alias("document_datetime"),
    ]
    if with_text:
        cols += [F.concat(_dated_line(), F.col("text")).alias("note_text")]
    if chosen is not None:
        doc = doc.join(chosen.select(F.col("encounter_num").alias("_stay"), F.col("note_id").alias("_id")), F.expr("doc_id div 3") == F.col("_stay"))
        # no join key: a second one would have the texts dealt by both
        doc = doc.where(F.array_contains(F.array("doc_id"), F.col("_id"))).drop("_stay", "_id")
    return doc.join(v, F.expr("doc_id div 3") == v.encounter_num).select(*cols)


def annotations(spark: SparkSession, d: str) -> DataFrame:
    lab = read_table(spark, d, "labels")
    base = [
        F.col("doc_id").alias("note_id"),
        (F.col("doc_id") % 3 > 0).alias("predicted"),
        (F.col("doc_id") % 2 == 0).alias("after_cutoff"),
        F.concat(F.lit("rf"), (F.col("doc_id") % 3).cast("string")).alias("rf_name"),
        (F.col("doc_id") % 5 == 0).alias("supplementary"),
        F.when(F.col("doc_id") % 11 == 0, F.lit("unclear")).alias("remark"),
    ]
    a = lab.select(*base, F.lit("A").alias("annotator"), (F.col("quality") == 1).alias("gold"))
    b = lab.select(*base, F.lit("B").alias("annotator"), (F.col("toxic") == 0).alias("gold"))
    return a.unionByName(b)


def asof_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Mentions and dates for the nearest as-of join: group = user, position = µs since epoch."""
    e = read_table(spark, d, "events", ["event_id", "ts", "user_id", "event_type"])
    # microseconds since the epoch without any session time zone (ts is timestamp_ntz)
    pos = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    ents = e.where(F.col("event_type") == "purchase").select(
        F.col("user_id").alias("group_id"), F.col("event_id").alias("ent_id"), pos.alias("start")
    )
    dates = e.where(F.col("event_type") == "view").select(
        F.col("user_id").alias("group_id"), F.col("event_id").alias("date_id"), pos.alias("start"),
        F.col("ts").alias("date"),
    )
    return ents, dates


# ---------------------------------------------------------------------------------------
# The same adapters in DuckDB SQL, for the oracle queries.
SQL = {
    "visits": """visits AS (
  SELECT o_orderkey AS encounter_num, o_custkey AS patient_num, o_orderdate AS visit_start_date,
         CASE WHEN o_orderstatus = 'P' THEN NULL
              ELSE o_orderdate + to_days(CAST(o_orderkey % 20 + 1 AS INTEGER)) END AS visit_end_date,
         o_orderpriority AS visit_type, o_orderstatus AS admission_mode,
         CASE WHEN o_orderstatus = 'F' AND o_orderkey % 50 = 0 THEN 'death' ELSE 'home' END AS discharge_mode
  FROM orders)""",
    "patients": """patients AS (
  SELECT c_custkey AS patient_num,
         DATE '1993-01-01' - CAST(c_custkey * 37 % 30000 AS INTEGER) AS birth_date,
         CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'W' END AS sex_cd
  FROM customer)""",
    "stay_sites": """stay_sites AS (
  SELECT o_orderkey AS encounter_num, n_nationkey AS site_code, n_name AS site_label, r_name AS site_type
  FROM orders JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "claims": """claims AS (
  SELECT l_orderkey AS encounter_num, l_linenumber AS instance_num,
         CASE WHEN l_linenumber = 1 THEN 'DP' ELSE 'DAS' END AS diag_type,
         'ICD10:' || CASE WHEN p_size % 3 = 0 THEN 'S' WHEN p_size % 3 = 1 THEN 'T' ELSE 'X' END
                  || lpad(CAST(l_partkey % 100 AS VARCHAR), 2, '0') AS concept_cd
  FROM lineitem JOIN part ON l_partkey = p_partkey)""",
    "notes": """notes AS (
  SELECT doc_id AS note_id, o_orderkey AS encounter_num, o_custkey AS patient_num, source AS note_category,
         o_orderdate + to_days(CAST(doc_id % 5 AS INTEGER)) AS document_datetime,
         CASE doc_id % 4
           WHEN 0 THEN '===== Page 1/2 =====' || chr(10) || 'Seen  with   pain on ' || strftime(line_day, '%d/%m/%Y') || ', review in ' || (doc_id % 6 + 2) || ' days.' || chr(10)
           WHEN 1 THEN 'History:' || chr(10) || 'Came from home on ' || strftime(line_day, '%Y-%m-%d') || '.' || chr(10) || 'Plan/follow-up:' || chr(10)
             || 'Bilan du ' || strftime(line_day, '%d.%m.%Y') || ', lettre du ' || day(line_day) || '/' || month(line_day) || '/' || strftime(line_day, '%y')
             || ', noted ' || monthname(line_day) || ' ' || day(line_day) || ', ' || year(line_day) || ', vu hier; il y a 2010 jours, il y a 999999999 ans.' || chr(10)
           WHEN 2 THEN 'Venu avec douleur il y a ' || (doc_id % 5 + 1) || ' mois pendant 3 jours, vu en ' || line_month || ' ' || year(line_day) || '.' || chr(10)
             || 'Douleur avec fièvre exclue, not with care but with food. Not only with it.' || chr(10)
           ELSE 'Parti pour soins le ' || day(line_day) || ' ' || line_month || ' ' || year(line_day) || ', revu dans ' || (doc_id % 7 + 2)
                || ' semaines, suivi depuis ' || (year(line_day) - 2) || ', rappel le ' || day(line_day) || ' ' || line_month || '.' || chr(10) END || text AS note_text, lang
  FROM (SELECT *, ['janvier', 'février', 'mars', 'avril', 'mai', 'juin', 'juillet', 'août', 'septembre', 'octobre', 'novembre',
                   'décembre'][month(line_day)] AS line_month
        FROM (SELECT *, CAST(o_orderdate AS DATE) - CAST(doc_id % 60 AS INTEGER) AS line_day
              FROM documents JOIN orders ON doc_id // 3 = o_orderkey)))""",
    "annotations": """annotations AS (
  SELECT doc_id AS note_id, doc_id % 3 > 0 AS predicted, doc_id % 2 = 0 AS after_cutoff,
         'rf' || CAST(doc_id % 3 AS VARCHAR) AS rf_name, doc_id % 5 = 0 AS supplementary,
         CASE WHEN doc_id % 11 = 0 THEN 'unclear' END AS remark, 'A' AS annotator, quality = 1 AS gold
  FROM labels
  UNION ALL
  SELECT doc_id, doc_id % 3 > 0, doc_id % 2 = 0, 'rf' || CAST(doc_id % 3 AS VARCHAR), doc_id % 5 = 0,
         CASE WHEN doc_id % 11 = 0 THEN 'unclear' END, 'B', toxic = 0
  FROM labels)""",
}

