"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortspark.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


@register("op6_simhash_near_dedup")
def op6(spark, sf_dir):
    from cohortspark.llm.simhash import simhash_classes

    return simhash_classes(table(spark, sf_dir, "documents"), k=3, max_bits=3)


#: all pairs of a label by SQL, then the smallest vec_id reachable
OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
          WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT m.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links,
       CAST(least(m.vec_id, coalesce(r.c, m.vec_id)) AS BIGINT) AS component_id,
       m.vec_id <= coalesce(r.c, m.vec_id) AS kept
FROM embeddings m
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = m.vec_id
LEFT JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = m.vec_id"""


@register("op1_cap_near_dedup", OP1_SQL)
def op1(spark, sf_dir):
    from cohortspark.llm.caps import cap_links

    return cap_links(table(spark, sf_dir, "embeddings"), threshold=0.93)


@register("op9_token_counts")
def op9(spark, sf_dir):
    import public_tokenizers

    from cohortspark.llm.tokens import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


@register("op8_best_fit_packing")
def op8(spark, sf_dir):
    import public_tokenizers

    from cohortspark.llm.packing import best_fit_packing

    return best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                            capacity=2048, end_id=0)


_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

OP4_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[p:p + least(len(w), 13) - 1], ' ') AS g
        FROM i, unnest(range(1, greatest(len(w) - 13, 0) + 2)) t(p) WHERE len(w) > 0),
grams AS (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS g
          FROM d, (SELECT DISTINCT n FROM win) s, unnest(range(1, len(w) - n + 2)) t(p) WHERE len(w) >= n),
hits AS (SELECT DISTINCT doc_id, p, n, item_id FROM grams JOIN win USING (n, g)),
hit_words AS (SELECT doc_id, count(DISTINCT p + k) AS n_hit FROM hits, unnest(range(0, n)) t(k) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
              FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)"""


@register("op4_benchmark_decontamination", OP4_SQL)
def op4(spark, sf_dir):
    from cohortspark.llm.decontaminate import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op7_license_scan")
def op7(spark, sf_dir):
    from cohortspark.llm.licenses import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


@register("op10_language_id")
def op10(spark, sf_dir):
    from cohortspark.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


@register("op3_quality_rules")
def op3(spark, sf_dir):
    from cohortspark.llm.quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op5_line_dedup")
def op5(spark, sf_dir):
    """One row per document: lines, lines compared, lines dropped, and the sum of the dropped numbers."""
    from pyspark.sql import functions as F

    from cohortspark.llm.lines import dropped_lines

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    gone = dropped_lines(docs)
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"),
                       F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0))
                       .cast("long").alias("n_lines"))
    return rows.join(gone, ["doc_id", "row"], "left").select(
        "doc_id", "n_lines", F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("drop").isNotNull(), F.array_join(F.col("drop").cast("array<string>"), ",")).otherwise("").alias("dropped_lines"))


@register("op2_context_mixing")
def op2(spark, sf_dir):
    from cohortspark.llm.mixing import mixing_scores

    return mixing_scores(table(spark, sf_dir, "documents"))


def _op12_sql() -> str:
    """Per rule: matches and the pieces between them give the spans; the automaton is not used."""
    from cohortspark.llm.secret_scan import BASE, MORE

    def quoted(x):
        return x.replace("'", "''")

    kinds = []
    for k, r in enumerate(BASE + MORE):
        kinds.append(f"""SELECT doc_id, row_n, {k} AS k, '{r.kind}' AS kind,
  CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s, m[i] AS hit
  FROM (SELECT doc_id, row_n, string_split_regex(t, '{quoted(r.pattern)}') AS g, regexp_extract_all(t, '{quoted(r.pattern)}') AS m FROM d), unnest(range(1, len(m) + 1)) u(i)
  WHERE length(m[i]) >= {r.least} AND length(regexp_extract(m[i], '^({quoted(r.whole_head)})({quoted(r.tail)})', 2)) >= {r.least_tail}""")
    base = ", ".join(f"'{r.kind}'" for r in BASE)
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row_n, coalesce(text, '') AS t FROM documents),
hits AS ({' UNION ALL '.join(kinds)}),
spans AS (SELECT *, kind || ':' || s || ':' || (s + length(hit)) AS x FROM hits),
per AS (SELECT row_n, {', '.join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)},
        string_agg(x, ',' ORDER BY s, k) FILTER (kind IN ({base})) AS b, string_agg(x, ',' ORDER BY s, k) AS spans
        FROM spans GROUP BY row_n)
SELECT doc_id, {', '.join(f"CAST(coalesce(n_{r.kind}, 0) AS BIGINT) AS n_{r.kind}" for r in BASE)},
       sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (row_n)"""


@register("op12_secret_scan", _op12_sql())
def op12(spark, sf_dir):
    from cohortspark.llm.secret_scan import secret_report

    return secret_report(table(spark, sf_dir, "documents"))


#: CRC-32 of a word with its doc_id from the polynomial, byte by byte; words meet that agree when one place is masked (replaced)
#: or left out (inserted)
OP13_SQL = """
WITH RECURSIVE tab AS (
  SELECT list(list_reduce(list_prepend(i, range(0, 8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(0, 256) r(i)),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents),
keyed AS (SELECT w, string_split(CAST(doc_id AS VARCHAR) || ':' || w, '') AS cs, count(*) AS n FROM runs WHERE length(w) >= 7 GROUP BY ALL),
bytes AS (SELECT w, n, list_concat([4294967295], flatten(list_transform(cs, lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)]
          ELSE [CAST(192 + (unicode(c) >> 6) AS BIGINT), CAST(128 + unicode(c) % 64 AS BIGINT)] END))) AS b FROM keyed),
hashed AS (SELECT w, n, 4294967295 - list_reduce(b, lambda c, x: xor(c >> 8, t[CAST(xor(c % 256, x) AS INTEGER) + 1])) AS h FROM bytes, tab),
damaged AS (SELECT CASE WHEN h % 31 = 0 THEN left(w, CAST(h % length(w) AS INTEGER)) || substr(w, CAST(h % length(w) AS INTEGER) + 2) ELSE w END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM damaged WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
masks AS (SELECT word, n, left(word, CAST(i - 1 AS INTEGER)) || '*' || substr(word, i + 1) AS k FROM words, unnest(range(1, length(word) + 1)) u(i)),
outs AS (SELECT DISTINCT word, n, left(word, CAST(i - 1 AS INTEGER)) || substr(word, i + 1) AS k FROM words, unnest(range(1, length(word) + 1)) u(i)),
near AS (SELECT a.word, a.n, b.word AS w2, b.n AS n2 FROM masks a JOIN masks b USING (k) WHERE a.word <> b.word
  UNION ALL SELECT o.word, o.n, w.word, w.n FROM outs o JOIN words w ON w.word = o.k
  UNION ALL SELECT w.word, w.n, o.word, o.n FROM outs o JOIN words w ON w.word = o.k),
best AS (SELECT word, count(*) AS n_near, min(struct_pack(m := -n2, w := w2)) AS b FROM near GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= 10 * w.n THEN b.w END AS form, CASE WHEN -b.m >= 10 * w.n THEN -b.m END AS form_n
          FROM words w LEFT JOIN best USING (word)),
way(word, goal) AS (SELECT word, word FROM words UNION ALL SELECT y.word, f.form FROM way y JOIN forms f ON f.word = y.goal WHERE f.form IS NOT NULL)
SELECT f.word, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form, CAST(f.form_n AS BIGINT) AS form_n, y.goal AS root
FROM forms f JOIN way y USING (word) JOIN forms e ON e.word = y.goal AND e.form IS NULL"""


@register("op13_spelling_variants", OP13_SQL)
def op13(spark, sf_dir):
    from cohortspark.llm.spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


#: damage by CRC-32 from the polynomial; then the cheapest audit per state, row after row, with whole strings
OP11_SQL = """
WITH RECURSIVE tab AS (
  SELECT list(list_reduce(list_prepend(i, range(0, 8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(0, 256) r(i)),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        list_concat([4294967295], list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
                    lambda c: CAST(unicode(c) AS BIGINT))) AS b FROM conversations),
hashed AS (SELECT *, (4294967295 - list_reduce(b, lambda c, x: xor(c >> 8, t[CAST(xor(c % 256, x) AS INTEGER) + 1]))) % 20 AS h FROM src, tab),
rows_ AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
          CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
          FROM hashed, unnest(range(0, CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) u(i)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p FROM rows_),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) AS nth FROM ordered),
faults AS (SELECT conv_id, p, turn, role, text, left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY p) AS prior,
           CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b' WHEN nth > 1 THEN 'd'
                WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 't' ELSE '' END AS fault FROM placed),
sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
         count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (prior IS NOT NULL AND prior || ini NOT IN ('su', 'ua', 'au')) AS illegal, max(p) AS n FROM faults GROUP BY conv_id),
ins(f, g, c, a, o) AS (VALUES ('0', '0', 0, '', ''), ('s', 's', 0, '', ''), ('u', 'u', 0, '', ''), ('a', 'a', 0, '', ''),
  ('0', 'u', 2, 'I', chr(10) || 'user:'), ('s', 'u', 2, 'I', chr(10) || 'user:'), ('a', 'u', 2, 'I', chr(10) || 'user:'), ('u', 'a', 2, 'I', chr(10) || 'assistant:'),
  ('0', 'a', 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), ('s', 'a', 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
nexts(g, i, t) AS (VALUES ('0', 's', 's'), ('0', 'u', 'u'), ('s', 'u', 'u'), ('a', 'u', 'u'), ('u', 'a', 'a')),
acts AS (SELECT f.conv_id, f.p, ins.f AS f, ins.g AS t, ins.c + 3 AS c, ins.a || 'D' AS a, ins.o AS o FROM faults f, ins
  UNION ALL SELECT f.conv_id, f.p, ins.f, x.t, ins.c + (f.fault = 't')::INT, ins.a || 'K', ins.o || chr(10) || f.role || ':' || f.text
  FROM faults f, ins JOIN nexts x USING (g) WHERE f.fault NOT IN ('b', 'd') AND f.ini = x.i
  UNION ALL SELECT f.conv_id, f.p, ins.f, x.t, ins.c + 2 + (f.fault = 't')::INT, ins.a || 'R', ins.o || chr(10) || CASE x.i WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || f.text
  FROM faults f, ins JOIN nexts x USING (g) WHERE f.fault NOT IN ('b', 'd') AND x.i <> 's'),
dp(conv_id, p, st, b) AS (SELECT conv_id, CAST(0 AS BIGINT), '0', struct_pack(c := 0, a := '', o := '') FROM sums
  UNION ALL SELECT d.conv_id, d.p + 1, y.t, min(struct_pack(c := d.b.c + y.c, a := d.b.a || y.a, o := d.b.o || y.o))
  FROM dp d JOIN acts y ON y.conv_id = d.conv_id AND y.p = d.p + 1 AND y.f = d.st GROUP BY d.conv_id, d.p, y.t),
ends AS (SELECT d.conv_id, min(struct_pack(c := d.b.c + ins.c, a := d.b.a || ins.a, o := d.b.o || ins.o)) AS b
         FROM dp d JOIN sums s ON s.conv_id = d.conv_id AND s.n = d.p JOIN ins ON ins.f = d.st AND ins.g IN ('0', 'a') GROUP BY d.conv_id)
SELECT v.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(e.b.c, 0) AS BIGINT) AS cost, coalesce(e.b.a, '') AS audit, sha256(coalesce(substr(e.b.o, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) v LEFT JOIN sums s ON s.conv_id = v.conv_id LEFT JOIN ends e ON e.conv_id = v.conv_id"""


@register("op11_conversation_repair", OP11_SQL)
def op11(spark, sf_dir):
    from cohortspark.llm.conversations import damage, repair_report

    conversations = table(spark, sf_dir, "conversations")
    return repair_report(conversations, damage(conversations))
