import random

import regex
from pyspark.sql import functions as F

from cohortspark.operators import text


def py_spans(t, p):
    return [(m.group(0), m.start(), m.end()) for m in regex.finditer(p, t)] if t is not None else []


def test_regex_spans_edges(spark):
    texts = ["With x with", "aaWITHbb with", "Élan with Élan", "nothing", None, "with with,with", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "note_id long, note_text string")
    p = text.LEXICON["with"]
    got = {}
    for r in text.regex_spans(df, p).collect():
        got.setdefault(r.note_id, []).append((r.match, r.start_char, r.end_char))
    py = r"(?i)(?<![\p{L}\p{N}_])with(?![\p{L}\p{N}_])"
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == py_spans(t, py)


def test_regex_spans_random_against_python(spark):
    rng = random.Random(1)
    alphabet = ["with", "With", "é", "a", " ", ".", "\n", "dans", "x"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "note_id long, note_text string")
    pat = text.combined(text.LEXICON)
    got = {}
    for r in text.regex_spans(df, pat).collect():
        got.setdefault(r.note_id, []).append((r.match, r.start_char, r.end_char))
    py = r"(?i)(?<![\p{L}\p{N}_])(?:with|from|pour|dans|avec)(?![\p{L}\p{N}_])"
    for i, t in enumerate(texts):
        assert sorted(got.get(i, []), key=lambda x: x[1]) == py_spans(t, py)


def test_empty_matches_are_no_spans_and_java_patterns_work(spark):
    df = spark.createDataFrame([(1, "baab ÀB+x aab \ufdd0b")], "note_id long, note_text string")
    rows = lambda p: [(r.match, r.start_char, r.end_char) for r in text.regex_spans(df, p).orderBy("start_char").collect()]
    assert rows("a*") == [("aa", 1, 3), ("aa", 10, 12)]
    assert rows(r"\p{Lu}+[+]x") == [("ÀB+x", 5, 9)]
    assert rows("(?<=a{1,3})b") == [("b", 3, 4), ("b", 12, 13)]
    assert rows("b$") == [("b", 15, 16)]
    assert [text.group_count(p) for p in ("(a)(?:b)(?<n>c)(?<=d)(?<!e)", r"\(x[(]\Q(a)\E(y)", "[a-z&&[(]]()")] == [2, 1, 1]


def test_mentions_qualifiers_and_window(spark):
    t = "Patient was seen. He came with pain. Not for that: with care! The mother says that it was with them."
    df = spark.createDataFrame([(1, 10, t)], "note_id long, encounter_num long, note_text string")
    m = text.mentions(df).orderBy("start_char").collect()
    assert [x.start_char for x in m] == [t.find("with"), t.find("with care"), t.find("with them")]
    first, second, third = m
    assert first.sent_id == 1 and not any([first.negation, first.hypothesis, first.family, first.history, first.rspeech])
    assert second.sent_id == 2 and second.negation  # cues match case-insensitively: "Not"
    assert second.hypothesis and second.rspeech
    assert third.family and third.rspeech and third.history
    toks = regex.findall(text.TOKEN, t)
    assert first.start == len(regex.findall(text.TOKEN, t[: first.start_char]))
    assert first.words == toks[max(first.start - 35, 0): first.start + 1 + 10]
    assert first.words[first.word_index] == "with"


def test_span_filter_greedy(spark):
    rng = random.Random(2)
    rows = []
    for note in range(30):
        for _ in range(rng.randint(0, 12)):
            s = rng.randint(0, 50)
            rows.append((note, s, s + rng.randint(1, 10), rng.choice(["a", "b"])))
    df = spark.createDataFrame(rows, "note_id long, start_char int, end_char int, label string")
    got = {(r.note_id, r.start_char, r.end_char) for r in text.span_filter(df).collect()}
    want = set()
    for note in range(30):
        spans = sorted({(s - e, s, e, lab) for n, s, e, lab in rows if n == note})
        kept = []
        for neg, s, e, lab in spans:
            if not any(a < e and s < b for a, b in kept):
                kept.append((s, e))
        want |= {(note, s, e) for s, e in kept}
    assert got == want


def test_cooccurrence_and_exclusive(spark):
    rows = [(1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, "a"), (3, "b"), (3, "c")]
    m = spark.createDataFrame(rows, "encounter_num long, std_lexical_variant string")
    co = {(r.term_1, r.term_2): r.n_stays for r in text.cooccurrence(m).collect()}
    assert co == {("a", "a"): 3, ("a", "b"): 2, ("a", "c"): 1, ("b", "b"): 2, ("b", "c"): 1, ("c", "c"): 1}
    ex = {r.std_lexical_variant: r.n_stays for r in text.exclusive_terms(m).collect()}
    assert ex == {"a": 1}


def test_normalise(spark):
    df = spark.createDataFrame([("Élan  “ça”\n va",)], "t string")
    assert df.select(text.normalise_text(F.col("t")).alias("n")).first().n == 'elan "ca" va'


def test_sections_and_history_section(spark):
    t = "Motif:\nwith pain today.\nHistory:\nseen with care.\nPlan:\nnothing with it."
    df = spark.createDataFrame([(1, 5, t)], "note_id long, encounter_num long, note_text string")
    secs = [(r.section, r.start_char, r.end_char) for r in text.sections(df).orderBy("section_index").collect()]
    assert secs == [("Motif", 0, t.find("History:")), ("History", t.find("History:"), t.find("Plan:")),
                    ("Plan", t.find("Plan:"), len(t))]
    m = {r.start_char: (r.section, r.history) for r in text.mentions(df).collect()}
    assert m[t.find("with pain")] == ("motif", False)
    assert m[t.find("with care")] == ("history", True)       # inside a history section
    assert m[t.find("with it")] == ("plan", False)


def test_labels_with_mixed_flags_accents_and_look_around(spark):
    lexicon = {"a": "(?i)foo", "b": "BAR", "c": "(?i)récidive", "d": "(?<=pre )x(?= post)", "e": "(q)(r)"}
    rows = [(1, "FOO bar BAR Récidive RÉCIDIVE récidive pre x post x qr", 7)]
    df = spark.createDataFrame(rows, "note_id long, note_text string, encounter_num long")
    got = [(r.lexical_variant, r.std_lexical_variant) for r in text.mentions(df, lexicon).orderBy("start_char").collect()]
    assert got == [("FOO", "a"), ("BAR", "b"), ("Récidive", "c"), ("RÉCIDIVE", "c"), ("récidive", "c"), ("x", "d"), ("qr", "e")]


def test_snippets_and_long_headings(spark):
    title = "Antécédents médicaux et chirurgicaux n° 2 d'hier/aujourd'hui".replace("°", "")
    rows = [(1, f"{title}:\nCame with pain.\nHistory-2: none", 7)]
    df = spark.createDataFrame(rows, "note_id long, note_text string, encounter_num long")
    secs = [r.section for r in text.sections(df).collect()]
    assert secs == [title, "History-2"]
    m = text.mentions(df, snippet=5).first()
    assert m.snippet == "Came with pain"[0:14] and m.snippet[m.snippet_start:m.snippet_end] == "with" and m.section == title.lower()


def test_scopes_right_cues_stops_and_masked_phrases(spark):
    cases = {
        "pain with fever excluded today": {"negation"},                     # right-hand cue
        "no change with the dose": set(),                                   # a phrase that holds a cue and is none
        "no change but not so with it": {"negation"},
        "not here but with it": set(),                                      # the scope ends at "but"
        "it came with fever. excluded": set(),                              # another sentence
        "seen with fever but that is excluded": set(),                      # a stop before the right cue
        "with fever, ruled out, and no pain": {"negation"},
        "she was there with him": {"history"},
        "no pain, mother says it came with fever": {"negation", "family", "rspeech"},
    }
    rows = [(i, 1, t) for i, t in enumerate(cases)]
    df = spark.createDataFrame(rows, "note_id long, encounter_num long, note_text string")
    got = {r.note_id: {q for q in text.QUALIFIERS if r[q]} for r in text.mentions(df, cues=text.SCOPED_CUES).collect()}
    assert got == {i: want for i, want in enumerate(cases.values())}


def test_normalised_text_keeps_the_places(spark):
    raw = "===== Page 1/2 =====\nÉlan  “avec”\t\tDOULEUR --- et\n\nWITHà with ___ avec."
    rows = [(1, 1, raw), (2, 1, None), (3, 1, ""), (4, 1, "with" + " x" * 5000 + "   avec")]
    df = spark.createDataFrame(rows, "note_id long, encounter_num long, note_text string")
    n = text.normalised(df)
    texts = {r.note_id: r.norm_text for r in n.collect()}
    assert texts[1] == ' elan "avec" douleur et witha with avec.' and texts[2] is None and texts[3] == ""
    m = text.mentions(n, text_col="norm_text", align_col="alignment").collect()
    full = {i: t for i, _, t in rows}
    assert sorted((r.note_id, full[r.note_id][r.raw_start:r.raw_end].lower()) for r in m) == [
        (1, "avec"), (1, "avec"), (1, "with"), (4, "avec"), (4, "with")]
    assert all(texts[r.note_id][r.start_char:r.end_char] == r.lexical_variant for r in m)


def test_time_grows_with_the_length_of_a_note(spark):
    import time

    def seconds(n):
        df = spark.createDataFrame([(1, 1, "He came with pain. not so with it for me " * (n // 2))],
                                   "note_id long, encounter_num long, note_text string")
        start = time.perf_counter()
        rows = text.mentions(df).selectExpr("count(*)", "max(sent_id)", "sum(size(words))").first()
        assert rows[0] == n and rows[1] == n // 2
        return time.perf_counter() - start

    seconds(200)
    small, large = seconds(2000), seconds(8000)
    assert large < 4.5 * small + 1


def test_span_filter_on_one_long_chain(spark):
    import time

    n = 50_000
    spans = [(1, 3 * i, 3 * i + 4 + i % 3, "a") for i in range(n)]
    df = spark.createDataFrame(spans, "note_id long, start_char int, end_char int, label string")
    start = time.perf_counter()
    got = sorted((r.start_char, r.end_char) for r in text.span_filter(df).collect())
    assert time.perf_counter() - start < 60
    taken, want = set(), []
    for _, s, e, _ in sorted(spans, key=lambda x: (x[1] - x[2], x[1])):
        if not taken & set(range(s, e)):
            taken |= set(range(s, e))
            want.append((s, e))
    assert got == sorted(want)
    assert text.span_filter(df.limit(0)).collect() == []


def test_word_boundary_is_looked_at_once(spark):
    """Patterns with a common word boundary share it and a look at the first letters, and find the same spans
    as one by one (F3-F15, F17)."""
    from cohortspark.operators import dates

    cues, _ = text.SCOPED_CUES.groups()
    forms = {k: dates._whole(p) for k, p in dates.FORMS.items()}
    rows = [("With WITHout from,avec pour_x dans ſans PAS à vérifier; À VÉRIFIER xéavec avec",), ("il y a 3 mois 12 février 2001, Février 2001 AOÛT 2 12 ſept 1999",),
            ("ſi ſept September 5, 1999 hier aujourd’hui APRÈS-DEMAIN 2010 jours 1/2/99 in 2 weeks",), ("a﷐with﷑from 3-4-2001",), ("",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    optional = {"a": r"(?iu)" + text.WORD_L + "(?:wi?|d?ans)" + text.WORD_R, "b": r"(?iu)" + text.WORD_L + "av?ec" + text.WORD_R}
    either = {"a": r"(?iu)" + text.WORD_L + "with|ec", "b": r"(?iu)" + text.WORD_L + "from"}
    for patterns in (text.LEXICON, cues, forms, optional, either):
        alone = patterns | {"none": "(?iu)\\x00{3}"}  # begins otherwise, so that nothing is shared
        got = df.select(text.spans(F.col("t"), patterns, True, True).alias("a"), text.spans(F.col("t"), alone, True, True).alias("b")).collect()
        assert all(r.a == r.b for r in got) and any(r.a for r in got)
        assert text.combined(alone).count(text.WORD_L) == len(patterns)
    assert [text.combined(p).count(text.WORD_L) for p in (text.LEXICON, cues, forms, either)] == [1, 1, 1, 2]
    assert text.combined(text.LEXICON).startswith("(?iu:(?=[adfpw][aiorv])")
    assert text.combined(optional).startswith("(?iu:" + text.WORD_L)


def test_pieces_are_made_once(spark):
    """The filter of notes without a mention does not cut the texts a first time."""
    n = spark.createDataFrame([(1, 1, "Not with care. from")], "note_id long, encounter_num long, note_text string")
    m = text.mentions(n)
    filters = [line for line in m._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter " in line]
    assert filters and not any("regexp_replace" in line for line in filters)
    assert [(r.start_char, r.negation, r.sent_id) for r in m.orderBy("start_char").collect()] == [(4, True, 0), (15, False, 1)]


def test_cues_are_searched_in_the_sentences_of_mentions_only(spark, monkeypatch):
    far = "No care if that was so! "
    df = spark.createDataFrame([(1, "Not with it. " + far * 50 + "He says with me, excluded. " + far + "from\nno")], "note_id long, note_text string")
    cut = df.select(text.near_hits(text.pieces(F.col("note_text"), text.LEXICON)).alias("p")).first().p
    assert "".join(p.match for p in cut) == "Not with it\n He says with me, excluded\n from\nno"
    # the same rows as a search of the whole texts, also where a mention holds the end of a sentence
    rng = random.Random(5)
    words = ["with", "From", "not", "no change", "excluded", "but", "not only", "says", "in the past", "History:", "a", "é", ".", "!", "\n", "?x", "if any"]
    texts = ["".join(rng.choice(words) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    notes = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "note_id long, encounter_num long, note_text string")

    def rows(lexicon, cues):
        return sorted(map(str, text.mentions(notes, lexicon, cues).collect()))

    cases = [(text.LEXICON, text.SCOPED_CUES), ({"end": r"[.!?] ?with|with[.!]|x?"}, text.CUES)]
    found = [rows(*c) for c in cases]
    assert all(len(r) > 50 for r in found)
    monkeypatch.setattr(text, "near_hits", lambda cut: cut)
    assert [rows(*c) for c in cases] == found
