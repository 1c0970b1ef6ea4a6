import random

from cohortspark.llm.licenses import NOTICES, PHRASES, license_scan
from cohortspark.llm.words import words_of

from helpers import docs_frame


def test_exact_places_match_brute_force(spark):
    rng = random.Random(2)
    parts = ["GNU General Public License", "Apache License", "CC BY", "CC-BY", "MIT License", "cc", "by", "license", "été"]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))) for i in range(40)] + [(90, None), (91, ""), (None, "CC BY cc by")]
    got = {r["doc_id"]: r for r in license_scan(docs_frame(spark, rows)).collect()}
    for i, t in rows:
        w = [x.decode() for x in words_of((t or "").encode())]
        places = [(s, label) for p, label in PHRASES.items() for s in range(len(w)) if w[s:s + len(p.split())] == p.split()]
        starts = sorted(s for s, _ in places)
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(w), len(places))
        assert (r["first_word"], r["last_word"]) == ((starts[0], starts[-1]) if starts else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1


def test_fuzzy_notices_report_label_span_and_edits(spark):
    rows = [(1, "Some words. Relesed under the MIT Licence today"), (2, "all rigths reserved"), (3, "all right now reserved"),
            (4, "x " * 60_000 + "Mozila Public License"), (5, "this work is licensed under cc by nc 4.0")]
    got = {r["doc_id"]: r for r in license_scan(docs_frame(spark, rows)).collect()}
    assert got[1]["labels"] == "mit" and got[1]["base_labels"] == ""
    assert [(s["first_word"], s["words"], s["edits"]) for s in got[1]["spans"]] == [(2, 5, 2)]
    assert got[2]["labels"] in ("", "all-rights-reserved") and got[3]["labels"] == ""
    assert got[4]["labels"] == "mpl" and got[4]["spans"][0]["first_word"] == 60_000
    assert got[5]["labels"] == "cc-by,cc-by-nc"
    assert license_scan(docs_frame(spark, [])).collect() == []


def test_any_edits_within_the_bound_are_found():
    """Every candidate comes from an unchanged seed: compare with a search of the whole text."""
    from cohortspark.llm.licenses import Scanner

    rng, scan = random.Random(4), Scanner(PHRASES, NOTICES)
    for _ in range(300):
        k = rng.randrange(len(NOTICES))
        label, words, edits = NOTICES[k]
        w = list(words)
        for _ in range(rng.randint(0, edits)):
            i = rng.randrange(1, len(w) - 1)
            w[i] = rng.choice("abcxyz") if w[i] != " " else w[i]
        text = " aa bb " + "".join(w) + " cc dd "
        whole = scan.patterns[k].search(text)
        assert whole and any(x[2] == label for x in scan.fuzzy(text))


def test_time_grows_with_the_places():
    import time

    import pyarrow as pa

    from cohortspark.llm import licenses

    kept = []
    real, licenses.arrow_map = licenses.arrow_map, lambda df, run, schema: kept.append(run)
    try:
        class Rows:
            def select(self, *_):
                return self
        col, licenses.F = licenses.F, type("F", (), {"col": staticmethod(lambda _: type("C", (), {"cast": lambda s, t: s, "alias": lambda s, t: s})())})
        license_scan(Rows())
    finally:
        licenses.arrow_map, licenses.F = real, col
    text = "été cc by " * 200_000
    start = time.time()
    out = kept[0](pa.RecordBatch.from_pydict({"doc_id": [1], "text": [text]}))
    assert out["n_base"] == [200_000] and (out["first_word"], out["last_word"]) == ([1], [599_998]) and time.time() - start < 20
