"""Date mentions (X7, X8, X10), the nearest as-of join (J7) and history by date (X11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions.columns import seconds_between
from cohortspark.operators.text import WORD_L, WORD_R, begins, spans
from cohortspark.params import StudyParams

# ---- fixed values: date forms ------------------------------------------------------
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9,
    "october": 10, "november": 11, "december": 12,
    "janvier": 1, "février": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6, "juillet": 7, "août": 8, "septembre": 9,
    "octobre": 10, "novembre": 11, "décembre": 12,
}
# unit words, every spelling, and their length in days or months
UNIT_DAYS = {"day": 1, "days": 1, "jour": 1, "jours": 1, "week": 7, "weeks": 7, "semaine": 7, "semaines": 7}
UNIT_MONTHS = {"month": 1, "months": 1, "mois": 1, "year": 12, "years": 12, "an": 12, "ans": 12}
UNITS = r"days?|jours?|weeks?|semaines?|months?|mois|years?|ans?"
NAMES = "|".join(MONTHS)
# words for a day near the stay: days from it
DAY_WORDS = {"avant-hier": -2, "hier": -1, "yesterday": -1, "aujourd'hui": 0, "today": 0, "demain": 1, "tomorrow": 1, "après-demain": 2}

NAME_BEGINS = begins(MONTHS, 3)
AMOUNT = r"[0-9]+ (?:" + UNITS + ")"
DAY = r"[0-9]{1,2}(?:er|st|nd|rd|th)?"
# forms that begin alike stand with the longer one first, so that the first form that fits is the longest
FORMS = {
    "past": "il y a " + AMOUNT + "|" + AMOUNT + " ago",
    "future": "(?:dans|in) " + AMOUNT,
    "day_word": begins(DAY_WORDS, 3) + "(?:" + "|".join(sorted((w.replace("'", "['’]") for w in DAY_WORDS), key=len, reverse=True)) + ")",
    "duration": "(?:pendant|during) " + AMOUNT,
    "amount": AMOUNT,
    "ymd": r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}",
    "dmy": r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}[.][0-9]{1,2}[.][0-9]{4}|[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}",
    "dmy_short": r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}|[0-9]{1,2}[.][0-9]{1,2}[.][0-9]{2}",
    "d_name_y": DAY + " (?:" + NAMES + ") [0-9]{4}",
    "d_name": DAY + " (?:" + NAMES + ")",
    "name_d_y": NAME_BEGINS + "(?:" + NAMES + ") " + DAY + ",? [0-9]{4}",
    "name_y": NAME_BEGINS + "(?:" + NAMES + ") [0-9]{4}",
    "name_d": NAME_BEGINS + "(?:" + NAMES + ") " + DAY,
    "year": "(?:19|20)[0-9]{2}",
}
# what every form begins with
FORM_BEGINS = "(?=[0-9]|" + begins(["il", "dans", "in", "pendant", "during", *DAY_WORDS, *MONTHS])[3:]
RELATIVE_FORMS = ["past", "future", "day_word"]
# two-digit years up to this one are of the 2000s
SHORT_YEAR_PIVOT = 68
# a relative date farther than this from the stay is none
MAX_DAYS, MAX_MONTHS = 3_660_000, 120_000
# ------------------------------------------------------------------------------------


def _whole(pattern: str) -> str:
    return "(?iu)" + FORM_BEGINS + WORD_L + "(?:" + pattern + ")" + WORD_R


def _lookup(key, table: dict):
    """``table[key]`` as a column; null for another key."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def _calendar_date(year, month, day):
    """The date of the parts, the first day or month for a missing one; null if there is none."""
    m, d = F.coalesce(month, F.lit(1)), F.coalesce(day, F.lit(1))
    ymd = F.format_string("%04d-%02d-%02d", year, m, d)
    return F.when(year.between(1, 9999) & m.between(1, 12) & d.between(1, 31), F.try_to_date(ymd, "yyyy-MM-dd"))


def date_mentions(notes: DataFrame, text_col: str = "note_text", keep_cols: tuple[str, ...] = ()) -> DataFrame:
    """Date spans with parsed parts, token position and sentence.

    One matcher reads all ``FORMS``, so that a place belongs to one date only: the leftmost, and there the
    longest. Labels: absolute, relative, duration; a bare amount ("2010 jours") is none, but its number is
    no year. ``date_dt`` of an absolute date takes the first day or month where the text has none; it is null
    where the parts are not a calendar date or the year is missing (``resolve_relative`` takes the stay's).
    Relative and duration: ``value`` and ``unit``, relative ones a direction, past or future; a value
    beyond the integers is null."""
    patterns = {k: _whole(p) for k, p in FORMS.items()}
    found = spans(F.col(text_col), patterns, with_tokens=True, with_sentences=True)
    x = notes.select("note_id", *keep_cols, F.explode(found).alias("x")).select(
        "note_id", *keep_cols, F.element_at(F.array(*[F.lit(f) for f in FORMS]), F.col("x.label") + 1).alias("form"),
        F.col("x.match").alias("match"), F.col("x.start").alias("start_char"), F.col("x.end").alias("end_char"),
        F.col("x.tok").alias("start"), F.col("x.sent").alias("sent_id"),
    ).where("form <> 'amount'")
    m, form = F.replace(F.lower("match"), F.lit("’"), F.lit("'")), F.col("form")
    relative = form.isin(*RELATIVE_FORMS)
    label = F.when(relative, "relative").when(form == "duration", "duration").otherwise("absolute")
    absolute = label == "absolute"
    numbers = F.transform(F.regexp_extract_all(m, F.lit("[0-9]+"), 0), lambda n: n.try_cast("int"))
    number = lambda i: F.get(F.col("_n"), F.lit(i))
    day_word = _lookup(m, DAY_WORDS)
    x = x.withColumn("_n", numbers)
    short = number(2) + F.when(number(2) <= SHORT_YEAR_PIVOT, 2000).otherwise(1900)
    year = (F.when(form.isin("ymd", "name_y", "year"), number(0)).when(form == "dmy", number(2)).when(form == "dmy_short", short)
            .when(form.isin("d_name_y", "name_d_y"), number(1)))
    month = F.when(form.isin("ymd", "dmy", "dmy_short"), number(1)).when(absolute, _lookup(F.regexp_extract(m, "(" + NAMES + ")", 1), MONTHS))
    day = F.when(form == "ymd", number(2)).when(form.isin("dmy", "dmy_short", "d_name_y", "d_name", "name_d_y", "name_d"), number(0))
    value = F.when(form == "day_word", F.abs(day_word)).when(~absolute, number(0))
    unit = F.when(form == "day_word", F.lit("day")).when(~absolute, F.regexp_extract(m, r"[0-9]+ ([a-z]+)", 1))
    direction = F.when(form == "future", "future").when(form == "day_word", F.when(day_word > 0, "future").otherwise("past")).when(
        form == "past", "past")
    x = x.select("note_id", *keep_cols, label.alias("label"), "match", "start_char", "end_char", "start", "sent_id",
                 year.alias("year"), month.alias("month"), day.alias("day"), value.alias("value"), unit.alias("unit"),
                 direction.alias("direction"))
    return x.withColumn("date_dt", F.when(F.col("label") == "absolute", _calendar_date(F.col("year"), F.col("month"), F.col("day"))))


def resolve_relative(dates: DataFrame, ref: str = "visit_start_date") -> DataFrame:
    """A relative date is the reference date minus (past) or plus (future) value units; an absolute
    date without a year takes the reference's. An unknown unit, a missing reference, or a date outside the
    years 1 to 9999 gives null."""
    sign = F.when(F.col("direction") == "future", F.lit(1)).otherwise(-1)
    amount = F.col("value").cast("long") * sign
    days, months = _lookup(F.col("unit"), UNIT_DAYS) * amount, _lookup(F.col("unit"), UNIT_MONTHS) * amount
    ref_d = F.to_date(F.col(ref))
    near = lambda n, most: F.when(F.abs(n) <= most, n).cast("int")
    moved = F.coalesce(F.date_add(ref_d, near(days, MAX_DAYS)), F.add_months(ref_d, near(months, MAX_MONTHS)))
    moved = F.when(moved.between(F.lit("0001-01-01").cast("date"), F.lit("9999-12-31").cast("date")), moved)
    completed = F.coalesce("date_dt", F.when(F.col("year").isNull(), _calendar_date(F.year(ref_d), F.col("month"), F.col("day"))))
    return dates.withColumn("date_dt", F.when(F.col("label") == "relative", moved).when(F.col("label") == "absolute", completed)
                            .otherwise(F.col("date_dt")))


def clean_dates(dates: DataFrame, birth: str = "birth_date") -> DataFrame:
    """Drop unparsed dates, durations, and relative dates without a reference; tag the
    dates equal to the patient's birth date."""
    d = dates.where(F.col("label") != "duration").where(F.col("date_dt").isNotNull())
    return d.withColumn("is_birth_date", F.coalesce(F.col("date_dt") == F.col(birth), F.lit(False)))


def asof_nearest(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    pos: str = "start",
    right_id: str = "date_id",
    right_cols: tuple[str, ...] = ("date",),
    bucket_width: int | None = None,
) -> DataFrame:
    """For each left row, the right row of the same ``by`` group nearest in ``pos``.

    Ties of distance go to the earlier right row; several right rows at one position: the
    backward candidate is the last of them (largest id), the forward one the first. Left rows
    without a candidate keep nulls; the left row count is preserved.

    Skew: with ``bucket_width`` the position axis is cut into buckets; the windows run per
    (group, bucket) and the nearest right row of the earlier / later buckets is carried in
    from a per-bucket summary (one row per bucket). Exact, and a group holding a large share
    of all rows is spread over many tasks."""
    cand = F.struct(F.col(pos).alias("p"), F.col(right_id).alias("i"), *[F.col(c).alias(c) for c in right_cols])
    l0 = left.select("*", F.lit(1).alias("_side"))
    lcols = left.columns
    r0 = right.select(*by, F.col(pos), cand.alias("_c"), F.lit(0).alias("_side"))
    bw = bucket_width
    keys = list(by) + (["_b"] if bw else [])
    u = l0.withColumn("_c", F.lit(None).cast(r0.schema["_c"].dataType)).unionByName(r0, allowMissingColumns=True)
    if bw:
        u = u.withColumn("_b", F.floor(F.col(pos) / F.lit(bw)))
    order_back = [F.col(pos), F.col("_side"), F.col("_c.i")]
    w_back = Window.partitionBy(*keys).orderBy(*order_back).rowsBetween(Window.unboundedPreceding, 0)
    order_fwd = [F.col(pos), F.col("_side").desc(), F.col("_c.i")]
    w_fwd = Window.partitionBy(*keys).orderBy(*order_fwd).rowsBetween(0, Window.unboundedFollowing)
    u = u.withColumn("_bk", F.last("_c", ignorenulls=True).over(w_back)).withColumn(
        "_fw", F.first("_c", ignorenulls=True).over(w_fwd))
    if bw:
        summ = r0.withColumn("_b", F.floor(F.col(pos) / F.lit(bw))).groupBy(*by, "_b").agg(
            F.max_by("_c", F.struct(F.col("_c.p"), F.col("_c.i"))).alias("_last"),
            F.min_by("_c", F.struct(F.col("_c.p"), F.col("_c.i"))).alias("_first"),
        )
        wb = Window.partitionBy(*by).orderBy("_b")
        # buckets that hold only left rows need carries too: take them from the bucket list of both sides
        lb = l0.select(*by, F.floor(F.col(pos) / F.lit(bw)).alias("_b")).distinct()
        allb = lb.join(summ.select(*by, "_b", "_last", "_first"), by + ["_b"], "full")
        allb = allb.withColumn("_cb", F.last("_last", ignorenulls=True).over(wb.rowsBetween(Window.unboundedPreceding, -1)))
        allb = allb.withColumn("_cf", F.first("_first", ignorenulls=True).over(wb.rowsBetween(1, Window.unboundedFollowing)))
        u = u.where(F.col("_side") == 1).join(allb.select(*by, "_b", "_cb", "_cf"), by + ["_b"], "left")
        u = u.withColumn("_bk", F.coalesce("_bk", "_cb")).withColumn("_fw", F.coalesce("_fw", "_cf"))
    else:
        u = u.where(F.col("_side") == 1)
    db = F.col(pos) - F.col("_bk.p")
    df_ = F.col("_fw.p") - F.col(pos)
    pick = F.when(F.col("_bk").isNull(), F.col("_fw")).when(F.col("_fw").isNull(), F.col("_bk")).when(
        db <= df_, F.col("_bk")).otherwise(F.col("_fw"))
    out = u.withColumn("_m", pick)
    return out.select(*lcols, F.col("_m.i").alias(right_id), *[F.col(f"_m.{c}").alias(c) for c in right_cols],
                      F.abs(F.col(pos) - F.col("_m.p")).alias("distance"))


def history_by_date(linked: DataFrame, params: StudyParams = StudyParams(), exclude_birth: bool = True) -> DataFrame:
    """X11: delta = visit start - linked date; history when delta >= delta_history and the
    date is not the birth date."""
    delta = seconds_between(F.col("date_dt"), F.col("visit_start_date"))
    cond = delta >= F.lit(params.delta_history)
    if exclude_birth:
        cond = cond & ~F.coalesce(F.col("is_birth_date"), F.lit(False))
    return linked.withColumn("delta_to_start_visit", delta).withColumn(
        "history", F.coalesce(F.col("history"), F.lit(False)) | F.coalesce(cond, F.lit(False)))
