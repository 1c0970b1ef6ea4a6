"""License scans: exact phrases by word, and fuzzy short notices.

A notice may differ from its wording in up to ``edits`` characters. It is cut into edits + 1
pieces; any occurrence keeps one piece unchanged, so exact piece hits (one Aho-Corasick pass over
the text's joined words) give all candidate places, and the regex library's bounded-error
matching verifies each place and reports span and edits.

Defined results: null or empty text has no words and no labels (score 0); a null doc_id keeps its
row; repeated rows each get a row; very long texts are read whole, in time that grows with their length and
their matches; a notice found from two places counts once with its fewest edits; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import arrow_map, binary_texts
from cohortspark.llm.words import words_of

# fixed values: exact phrases and their labels
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# fixed values: notices (label, words, edits allowed)
NOTICES = [
    ("gpl", "licensed under the gnu general public license", 4),
    ("gpl", "gnu general public license", 2),
    ("lgpl", "gnu lesser general public license", 2),
    ("agpl", "gnu affero general public license", 2),
    ("apache", "licensed under the apache license", 3),
    ("apache", "apache license version 2 0", 2),
    ("mit", "released under the mit license", 2),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 6),
    ("bsd", "redistribution and use in source and binary forms", 4),
    ("mpl", "mozilla public license", 2),
    ("cc-by", "creative commons attribution", 2),
    ("cc-by-nc", "licensed under cc by nc", 1),
    ("cc-by-sa", "licensed under cc by sa", 1),
    ("all-rights-reserved", "all rights reserved", 1),
]


class Scanner:
    def __init__(self, phrases: dict[str, str], notices: list[tuple[str, str, int]]):
        import ahocorasick
        import regex

        self.phrases = [(b" " + p.encode() + b" ", label) for p, label in phrases.items()]
        self.notices = notices
        self.patterns = [regex.compile(rf"(?be)(?<!\S)(?:{regex.escape(w)}){{e<={k}}}(?!\S)") for _, w, k in notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, (_, w, k) in enumerate(notices):
            cut = [len(w) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cut, cut[1:]):
                seeds.setdefault(w[a:b], []).append((i, a))
        self.seeds = ahocorasick.Automaton()
        for s, where in seeds.items():
            self.seeds.add_word(s, (len(s), where))
        self.seeds.make_automaton()

    def exact(self, joined: bytes) -> list[tuple[int, str]]:
        """(start byte in the joined words, label) of every place of a phrase."""
        found = []
        for phrase, label in self.phrases:
            at = joined.find(phrase)
            while at >= 0:
                found.append((at, label))
                at = joined.find(phrase, at + 1)
        return found

    def fuzzy(self, text: str) -> list[tuple[int, int, str, int]]:
        """(start, end, label, edits) of the notices found in the joined words."""
        starts = {(i, end + 1 - size - off) for end, (size, where) in self.seeds.iter(text) for i, off in where}
        found = {}
        for i, at in sorted(starts):
            label, words, k = self.notices[i]
            low = max(0, at - k)
            m = self.patterns[i].search(text, low, at + len(words) + k + 1)
            if m:
                key = (m.start(), m.end(), label)
                found[key] = min(sum(m.fuzzy_counts), found.get(key, k))
        return [(*key, e) for key, e in sorted(found.items())]


def license_scan(docs: DataFrame, phrases: dict[str, str] | None = None, notices: list | None = None,
                 text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, and ``spans``: (first word, words, label, edits) of the fuzzy notices."""
    wanted = (PHRASES if phrases is None else phrases, NOTICES if notices is None else notices)
    made: list[Scanner] = []

    def run(batch: pa.RecordBatch) -> dict:
        if not made:
            made.append(Scanner(*wanted))
        scan = made[0]
        lengths = {(label, at): len(w) for at, (label, w, _) in enumerate(scan.notices)}
        longest = {label: max(n for (x, _), n in lengths.items() if x == label) for label, _ in lengths}
        out: dict = {c: [] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
        for t in binary_texts(batch.column("text")):
            words = words_of(t)
            joined = b" " + b" ".join(words) + b" "
            base = scan.exact(joined)
            # the number of a word is that of the spaces before it
            spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
            places = np.searchsorted(spaces, sorted(at for at, _ in base)).tolist()
            plain = joined.decode("utf-8", "replace")
            near = scan.fuzzy(plain) if words else []
            if near and len(plain) != len(joined):  # the fuzzy spans are in characters
                spaces = np.flatnonzero(np.frombuffer(plain.encode("utf-32-le"), np.uint32) == 32)
            number = np.searchsorted(spaces, [a for a, _, _, _ in near]).tolist()
            out["n_words"].append(len(words))
            out["n_base"].append(len(base))
            out["first_word"].append(places[0] if places else None)
            out["last_word"].append(places[-1] if places else None)
            out["base_labels"].append(",".join(sorted({x for _, x in base})))
            out["labels"].append(",".join(sorted({x for _, x in base} | {x[2] for x in near})))
            out["score"].append(1.0 if base else max((1 - e / longest[x] for _, _, x, e in near), default=0.0))
            out["spans"].append([{"first_word": k - 1, "words": len(plain[a:b].split()), "label": x, "edits": e}
                                 for k, (a, b, x, e) in zip(number, near)])
        return {"doc_id": batch.column("doc_id")} | out

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(src, run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
                               "labels string, score double, spans array<struct<first_word:long,words:long,label:string,edits:int>>")
