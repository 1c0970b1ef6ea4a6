"""Secret scans: all rules in one byte pass of a combined deterministic automaton.

The rules' expressions are compiled once on the driver into one minimal transition array
(``automaton``), which the tasks receive by value. A task walks each text's UTF-8 bytes once; a rule's
matches are its leftmost, non-overlapping ones, and a match that is too short is dropped after it was
found, so that it still uses up its characters. Spans are counted in code points.

Defined results: null or empty text has no span; a null doc_id keeps its row; repeated rows each get a
row; very long texts are walked whole in one pass; matches of two kinds may overlap, and matches of
equal start are ordered as the rules are listed; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.automaton import Scanner, Table, compile_rules, fold_case
from cohortspark.llm.common import arrow_map, binary_texts


class Rule(NamedTuple):
    """Matches of ``head`` followed by ``tail``. Kept where the whole has ``least`` characters and what
    follows the longest head has ``least_tail``. ``fold``: letters of the head in either case."""

    kind: str
    head: str
    tail: str
    least: int = 0
    least_tail: int = 0
    fold: bool = False

    @property
    def whole_head(self) -> str:
        return fold_case(self.head) if self.fold else self.head

    @property
    def pattern(self) -> str:
        return self.whole_head + self.tail


# fixed values: the base kinds (hex: only runs of 4 or more leave the automaton, so that single letters do not)
BASE = [
    Rule("assign", r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=-]+",
         least_tail=6, fold=True),
    Rule("access", "AKIA", "[A-Z0-9]+", least=20),
    Rule("hex", "", "[0-9a-f]{4,}", least=24),
]
# fixed values: further kinds, by the public forms of common credentials
MORE = [
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", ""),
    Rule("github", "gh[pousr]_", "[A-Za-z0-9]+", least=40),
    Rule("slack", "xox[abprs]-", "[A-Za-z0-9-]+", least=20),
    Rule("google", "AIza", "[0-9A-Za-z_-]+", least=39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.", "[A-Za-z0-9_-]+", least=40),
]


class SecretScanner:
    def __init__(self, rules: list[Rule], table: Table):
        import re

        self.rules = rules
        self.scan = Scanner([r.pattern for r in rules], table)
        self.heads = [re.compile(r.whole_head.encode()) for r in rules]

    def spans(self, data: bytes) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points, by start and then as the rules are listed."""
        found = []
        for r, start, end in self.scan.matches(data):
            rule = self.rules[r]
            if end - start < rule.least:
                continue
            if rule.least_tail and end - self.heads[r].match(data, start).end() < rule.least_tail:
                continue
            found.append((start, r, end))
        found.sort()
        if found and not data.isascii():
            lead = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
            point = lambda at: int(lead[at - 1]) if at else 0
            return [(self.rules[r].kind, point(s), point(e)) for s, r, e in found]
        return [(self.rules[r].kind, s, e) for s, r, e in found]


def find_secrets(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id and ``found``, its spans (kind, start, end)."""
    rules = BASE + MORE if rules is None else rules
    table = compile_rules([r.pattern for r in rules])
    made: list[SecretScanner] = []

    def run(batch: pa.RecordBatch) -> dict:
        if not made:
            made.append(SecretScanner(rules, table))
        return {"doc_id": batch.column("doc_id"),
                "found": [[{"kind": k, "start": s, "end": e} for k, s, e in made[0].spans(t or b"")]
                          for t in binary_texts(batch.column("text"))]}

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(src, run, "doc_id long, found array<struct<kind:string,start:long,end:long>>", rows=64)


def span_digest(spans):
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of(kinds: list[str]):
    return lambda s: s["kind"].isin(kinds)


def secret_report(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Counts and digests of ``find_secrets``: doc_id, n_<kind> of the base kinds, base_sha256, spans."""
    kinds = [r.kind for r in BASE]
    found = find_secrets(docs, rules)
    return found.select(
        "doc_id",
        *[F.size(F.filter("found", _of([k]))).cast("long").alias(f"n_{k}") for k in kinds],
        F.sha2(span_digest(F.filter("found", _of(kinds))), 256).alias("base_sha256"),
        span_digest(F.col("found")).alias("spans"))


def brute_spans(text: str, rules: list[Rule]) -> list[tuple[str, int, int]]:
    """The same spans by one regex search per rule: the tests' reference."""
    import re

    out = []
    for k, r in enumerate(rules):
        for m in re.finditer(f"({r.whole_head})({r.tail})", text):
            if len(m[0]) >= r.least and len(m[2]) >= r.least_tail:
                out.append((m.start(), k, r.kind, m.end()))
    return [(kind, s, e) for s, _, kind, e in sorted(out)]
