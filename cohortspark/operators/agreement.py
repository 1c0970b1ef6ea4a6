"""Annotation data and agreement statistics.

Annotations are long rows (note, annotator, round, labels). Per-note pivots use the known
annotator list, so each note becomes one row without collecting groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.stats import Z975


def annotation_union(rounds: list[DataFrame]) -> DataFrame:
    """Union of annotator x round tables; columns missing in a round become null."""
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out


def flatten_labels(df: DataFrame, json_col: str, schema: str) -> DataFrame:
    """a JSON label dictionary to columns."""
    return df.withColumn("_l", F.from_json(F.col(json_col), schema)).select("*", "_l.*").drop("_l", json_col)


def pair_wide(ann: DataFrame, annotators: tuple[str, str] = ("A", "B"), key: list[str] = ("note_id",),
              value: str = "gold") -> DataFrame:
    """K7: note x annotator pivot of one label (known annotator list: no distinct pass)."""
    return ann.groupBy(*key).pivot("annotator", list(annotators)).agg(F.min(value))


def crosstab_margins(wide: DataFrame, a: str = "A", b: str = "B") -> DataFrame:
    """Counts of annotator a x annotator b with margins (cube; margin rows have null keys
    and ``is_margin_*`` set)."""
    g = wide.select(F.col(a).alias("label_a"), F.col(b).alias("label_b")).cube("label_a", "label_b").agg(
        F.grouping("label_a").cast("boolean").alias("is_margin_a"),
        F.grouping("label_b").cast("boolean").alias("is_margin_b"),
        F.count(F.lit(1)).alias("n"),
    )
    return g


def disagreement(ann: DataFrame, value: str = "gold") -> DataFrame:
    """Per note, annotators and distinct labels; disagreement when > 1 distinct label."""
    return ann.groupBy("note_id").agg(
        F.count_distinct("annotator").alias("n_annotators"),
        F.count_distinct(value).alias("n_labels"),
    ).withColumn("disagreement", F.col("n_labels") > 1)


def notes_per_annotator(ann: DataFrame) -> DataFrame:
    """Distinct notes per annotator, and how many of them are shared with another one."""
    per_note = ann.groupBy("note_id").agg(F.count_distinct("annotator").alias("k"))
    x = ann.select("note_id", "annotator").distinct().join(per_note, "note_id")
    return x.groupBy("annotator").agg(
        F.count(F.lit(1)).alias("n_notes"), F.count_if(F.col("k") > 1).alias("n_shared"),
        F.count_if(F.col("k") == 1).alias("n_unique"))


def resolve_conflicts(ann: DataFrame, conflicts: DataFrame, order: list[str]) -> DataFrame:
    """K6: drop the listed (note, annotator) pairs, then keep the first row per note in the
    annotator preference order (min_by over the rank; combines map-side)."""
    kept = ann.join(conflicts.select("note_id", "annotator"), ["note_id", "annotator"], "left_anti")
    rank = F.array_position(F.array(*[F.lit(a) for a in order]), F.col("annotator"))
    cols = [c for c in kept.columns if c != "note_id"]
    return kept.groupBy("note_id").agg(F.min_by(F.struct(*cols), F.struct(rank, F.col("annotator"))).alias("r")).select(
        "note_id", "r.*")


def cohen_kappa(wide: DataFrame, a: str = "A", b: str = "B", by: list[str] = ()) -> DataFrame:
    """Cohen's kappa of two boolean raters (null when chance agreement is 1), with n and
    the number of distinct values used."""
    by = list(by)
    x = wide.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    g = x.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(a) == F.col(b)).alias("n_agree"),
        F.count_if(F.col(a)).alias("n_a_true"), F.count_if(F.col(b)).alias("n_b_true"),
        F.size(F.array_distinct(F.flatten(F.collect_set(F.array(F.col(a), F.col(b)))))).alias("n_values"),
    )
    n = F.col("n").cast("double")
    po = F.col("n_agree") / n
    pe = (F.col("n_a_true") / n) * (F.col("n_b_true") / n) + (1 - F.col("n_a_true") / n) * (1 - F.col("n_b_true") / n)
    return g.withColumn("kappa", F.try_divide(po - pe, 1 - pe)).drop("n_agree", "n_a_true", "n_b_true")


def class_agreement(wide: DataFrame, a: str = "A", b: str = "B") -> DataFrame:
    """Positive agreement 2a/(2a+b+c) and negative agreement 2d/(2d+b+c)."""
    x = wide.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    g = x.agg(
        F.count_if(F.col(a) & F.col(b)).alias("both_pos"),
        F.count_if(F.col(a) & ~F.col(b)).alias("only_a"),
        F.count_if(~F.col(a) & F.col(b)).alias("only_b"),
        F.count_if(~F.col(a) & ~F.col(b)).alias("both_neg"),
    )
    pa = F.try_divide(2 * F.col("both_pos").cast("double"), 2 * F.col("both_pos") + F.col("only_a") + F.col("only_b"))
    na = F.try_divide(2 * F.col("both_neg").cast("double"), 2 * F.col("both_neg") + F.col("only_a") + F.col("only_b"))
    return g.withColumn("positive_agreement", pa).withColumn("negative_agreement", na)


def wilson(k, n, z: float = Z975):
    """Wilson score interval of k successes in n (null for n = 0)."""
    k, n = F.col(k).cast("double"), F.col(n).cast("double")
    n = F.when(n > 0, n)
    p = k / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return p, centre - half, centre + half


def ppv_wilson(ann: DataFrame, by: list[str], gold: str = "gold", pred: str = "predicted") -> DataFrame:
    """PPV (gold among predicted positives) with the Wilson 95% interval and the
    confusion counts, per group."""
    g = ann.groupBy(*by).agg(
        F.count_if(F.col(pred) & F.col(gold)).alias("tp"), F.count_if(F.col(pred) & ~F.col(gold)).alias("fp"),
        F.count_if(~F.col(pred) & F.col(gold)).alias("fn"), F.count_if(~F.col(pred) & ~F.col(gold)).alias("tn"),
    ).withColumn("n_pred", F.col("tp") + F.col("fp"))
    p, lo, hi = wilson("tp", "n_pred")
    return g.withColumn("ppv", p).withColumn("ppv_lower", lo).withColumn("ppv_upper", hi)


def composite_ppv(ann: DataFrame, rule: str, other: str, gold: str = "gold") -> DataFrame:
    """P * PPV(rule and other) + (1 - p) * PPV(rule only), p = share of other-positive
    among rule-positive."""
    r = ann.where(F.col(rule))
    g = r.agg(
        F.count(F.lit(1)).alias("n_rule"), F.count_if(F.col(other)).alias("n_both"),
        F.count_if(F.col(other) & F.col(gold)).alias("tp_both"), F.count_if(~F.col(other) & F.col(gold)).alias("tp_rule_only"),
    )
    p = F.try_divide(F.col("n_both").cast("double"), F.col("n_rule"))
    ppv_both = F.try_divide(F.col("tp_both").cast("double"), F.col("n_both"))
    ppv_only = F.try_divide(F.col("tp_rule_only").cast("double"), F.col("n_rule") - F.col("n_both"))
    return g.select(
        p.alias("share_both"), ppv_both.alias("ppv_both"), ppv_only.alias("ppv_rule_only"),
        (p * ppv_both + (1 - p) * ppv_only).alias("composite_ppv"),
    )


def binary_metrics(df: DataFrame, gold: str = "gold", pred: str = "predicted") -> DataFrame:
    """Precision, recall, F1, accuracy and support of a boolean prediction."""
    g = df.agg(
        F.count_if(F.col(pred) & F.col(gold)).alias("tp"), F.count_if(F.col(pred) & ~F.col(gold)).alias("fp"),
        F.count_if(~F.col(pred) & F.col(gold)).alias("fn"), F.count_if(~F.col(pred) & ~F.col(gold)).alias("tn"),
    )
    prec = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp"))
    rec = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))
    f1 = F.try_divide(2 * F.col("tp").cast("double"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    acc = F.try_divide((F.col("tp") + F.col("tn")).cast("double"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    return g.select(
        "tp", "fp", "fn", "tn",
        prec.alias("precision"), rec.alias("recall"), f1.alias("f1"),
        acc.alias("accuracy"), (F.col("tp") + F.col("fn")).alias("support"),
    )


def read_back(ann: DataFrame, rf_level: bool = False, remark_codes: list[str] = ("unclear",)) -> DataFrame:
    """K5: reviewed rows only, remark codes dropped at RF level, one row per (note, annotator): the
    main round before the supplementary one, then the smallest row by its other columns."""
    a = ann.where(F.coalesce(F.col("reviewed"), F.lit(False))) if "reviewed" in ann.columns else ann
    if rf_level:
        a = a.where(~F.coalesce(F.col("remark").isin(*remark_codes), F.lit(False)))
    cols = [c for c in a.columns if c not in ("note_id", "annotator")]
    rest = [c for c in cols if c != "supplementary"]
    return a.groupBy("note_id", "annotator").agg(F.min(F.struct("supplementary", *rest)).alias("r")).select(
        "note_id", "annotator", *[f"r.{c}" for c in cols])
