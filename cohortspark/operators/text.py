"""Text operators on note tables.

Every note is handled inside its own row with native functions. One regular-expression pass per family
(lexicon, cues, headings) puts markers around the matches and their groups; a split at the markers gives
the pieces, and a linear scan over the pieces' lengths gives offsets, token numbers and sentence numbers.
A second scan, over the found spans in text order, merges mentions with cues, headings and the places
of a normalised text. No text is copied per mention, nothing is shuffled to find mentions, and the time
grows with the length of a note.

Patterns are Java's. A match of no characters is no span. The two markers are code points that are never
characters (U+FDD0, U+FDD1); where a text has one, U+FFFD stands for it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.arrays import let, nth, scan, wide, wide_slice

# ---- fixed values ------------------------------------------------------------------
# tokens: a run of letters/digits/underscore, or one other non-space character
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
# sentences: a run without terminators, then its terminators
SENTENCE = r"[^.!?\n]+[.!?]*"
# section headings: a line start of letters, digits, spaces and ' ’ / ( ) - up to a colon
HEADING = r"(?m)^[\p{L}\p{N}][\p{L}\p{N} '’/()-]*:"
# whole-word boundary that is Unicode-aware (Java's \b and RE2's \b disagree on accents)
WORD_L, WORD_R = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
# demo outcome lexicon (label -> case-insensitive whole-word pattern)
LEXICON = {
    "with": r"(?iu)" + WORD_L + "with" + WORD_R,
    "from": r"(?iu)" + WORD_L + "from" + WORD_R,
    "pour": r"(?iu)" + WORD_L + "pour" + WORD_R,
    "dans": r"(?iu)" + WORD_L + "dans" + WORD_R,
    "avec": r"(?iu)" + WORD_L + "avec" + WORD_R,
}
# qualifier cues: a cue earlier in the same sentence qualifies the mention
CUES = {
    "negation": ["pas", "not", "no", "sans"],
    "hypothesis": ["for", "if", "si", "may"],
    "family": ["family", "mother", "father", "famille"],
    "history": ["was", "history"],
    "rspeech": ["that", "says", "dit"],
}
# cues of the other kinds, for ``CueRules``: right-hand cues, words that end a scope, phrases that hold a
# cue's word and are none
RIGHT_CUES = {
    "negation": ["exclu", "exclue", "excluded", "absent", "absente", "ruled out"],
    "hypothesis": ["possible", "probable", "suspected", "à vérifier"],
    "family": ["chez la mère", "chez le père", "in the family"],
    "history": ["in the past", "dans le passé"],
    "rspeech": ["he says", "she says", "dit-il", "dit-elle"],
}
SCOPE_ENDS = ["but", "however", "mais", "cependant", "sauf", "except"]
PSEUDO_CUES = ["no change", "not only", "pas seulement", "sans changement", "if any", "no increase"]
# what a normalised text leaves out: ruled lines and page marks
NOISE = [r"={3,}", r"-{3,}", r"_{3,}", r"\*{3,}", r"#{3,}", r"(?i)\bpage [0-9]+(?:/| of | sur )[0-9]+\b"]
SNIPPET_CHARS = 35
WINDOW_BEFORE = 35
WINDOW_AFTER = 10
# ------------------------------------------------------------------------------------

QUALIFIERS = list(CUES)
MARK, SEP = "\ufdd0", "\ufdd1"
SENT_RUN = r"[^.!?\n]+"


@dataclass(frozen=True)
class CueRules:
    """Cues per class. A left cue qualifies what follows it in its sentence, a right cue what precedes it;
    a scope ends at the sentence or at one of ``stops``. A phrase of ``masked`` hides the cues in it."""

    left: dict[str, list[str]]
    right: dict[str, list[str]] = field(default_factory=dict)
    stops: list[str] = field(default_factory=list)
    masked: list[str] = field(default_factory=list)

    def classes(self) -> list[str]:
        return list(dict.fromkeys([*self.left, *self.right]))

    def phrases(self) -> list[str]:
        return [w for words in (*self.left.values(), *self.right.values(), self.stops, self.masked) for w in words]

    def groups(self) -> tuple[dict[str, str], list[list[str]]]:
        """(label -> pattern, per label its roles): phrases of the same roles share a pattern."""
        roles: dict[str, list[str]] = {w: [] for w in self.masked}
        for w in self.stops:
            roles.setdefault(w, []).append("stop")
        for side, table in (("left", self.left), ("right", self.right)):
            for cls, words in table.items():
                for w in words:
                    if w not in self.masked:
                        roles.setdefault(w, []).append(f"{side} {cls}")
        sets: dict[tuple, list[str]] = {}
        for w in sorted(roles, key=lambda w: -len(w)):  # the longest phrase first
            sets.setdefault((len(w.split()), *roles[w]), []).append(w)
        ordered = sorted(sets.items(), key=lambda kv: -kv[0][0])
        return {f"cue{i}": whole_words(ws) for i, (_, ws) in enumerate(ordered)}, [list(k[1:]) for k, _ in ordered]


#: all kinds of cues
SCOPED_CUES = CueRules(CUES, RIGHT_CUES, SCOPE_ENDS, PSEUDO_CUES)


def whole_words(words: list[str]) -> str:
    return r"(?iu)" + WORD_L + "(?:" + "|".join(words) + ")" + WORD_R


# ------------------------------------------------------------------ patterns

def inline_flags(p: str) -> tuple[str, str]:
    """(leading inline flags, the rest)."""
    if p.startswith("(?") and ")" in p:
        flags = p[2:p.index(")")]
        if flags.isalpha():
            return flags, p[p.index(")") + 1:]
    return "", p


def scoped(p: str) -> str:
    """The pattern with its leading inline flags limited to itself, case folding by Unicode."""
    flags, rest = inline_flags(p)
    flags = "".join(sorted(set(flags) | ({"u"} if "i" in flags else set())))
    return f"(?{flags}:{rest})"


def group_count(p: str) -> int:
    """Capture groups of a Java pattern: opening parentheses that are not escaped, quoted or in a class,
    and not followed by ``?`` unless by a group name."""
    n, i, depth = 0, 0, 0
    while i < len(p):
        two = p[i:i + 2]
        if two == "\\Q":
            end = p.find("\\E", i)
            i = len(p) if end < 0 else end + 2
            continue
        if p[i] == "\\":
            i += 2
            continue
        if p[i] == "[":
            depth += 1
        elif p[i] == "]" and depth:
            depth -= 1
        elif p[i] == "(" and not depth:
            named = p[i + 1:i + 3] == "?<" and p[i + 3:i + 4] not in ("=", "!")
            n += p[i + 1:i + 2] != "?" or named
        i += 1
    return n


def has_alternatives(p: str) -> bool:
    """Whether a Java pattern has a ``|`` outside all groups, classes and quotes."""
    i, groups, classes = 0, 0, 0
    while i < len(p):
        if p[i:i + 2] == "\\Q":
            end = p.find("\\E", i)
            i = len(p) if end < 0 else end + 2
            continue
        if p[i] == "\\":
            i += 2
            continue
        if p[i] == "[":
            classes += 1
        elif p[i] == "]" and classes:
            classes -= 1
        elif not classes:
            if p[i] == "|" and not groups:
                return True
            groups += (p[i] == "(") - (p[i] == ")")
        i += 1
    return False


#: a pattern's whole-word boundary, perhaps after a look at the letters that follow
WORD_BEGIN = r"(?:\(\?=[^()]*\))?" + re.escape(WORD_L)


def begins(words: list[str], n: int = 2) -> str:
    """A look at the first ``n`` letters of ``words``, which spares most places the many words that can follow."""
    return "(?=" + "".join("[" + "".join(sorted({w[i] for w in words})) + "]" for i in range(n)) + ")"


def first_words(p: str, n: int) -> list[str] | None:
    """The pattern, or the words of its leading ``(?:...|...)``, if each begins with ``n`` letters that are not optional."""
    group = re.match(r"\(\?:([^()\[\]\\]*)\)(?![?*+{])", p)
    words = group[1].split("|") if group else [p]
    return words if all(re.match(r"[^\W\d_]{%d}(?![?*+{])" % n, w) for w in words) else None


def combined(patterns: dict[str, str]) -> str:
    """One alternation; each label's pattern is one capture group and keeps its own flags. Of patterns with the
    same flags that all begin with the same word boundary it is looked at once for each place, not once for
    each label, and only where the letters that follow are some word's first ones."""
    parts = [inline_flags(p) for p in patterns.values()]
    heads = {(m := re.match(WORD_BEGIN, p)) and m[0] for _, p in parts}
    if len({flags for flags, _ in parts}) == 1 and len(heads) == 1 and heads != {None} and not any(has_alternatives(p) for _, p in parts):
        flags, head = parts[0][0], heads.pop()
        rests = [p[len(head):] for _, p in parts]
        for n in (2, 1) if head == WORD_L else ():
            words = [first_words(p, n) for p in rests]
            if None not in words:
                head = begins([w for ws in words for w in ws], n) + head
                break
        return scoped((f"(?{flags})" if flags else "") + f"{head}(?:{'|'.join(f'({p})' for p in rests)})")
    return "|".join(f"({scoped(p)})" for p in patterns.values())


def label_groups(patterns: dict[str, str]) -> dict[str, int]:
    """The capture group of each label in ``combined``."""
    at, out = 1, {}
    for label, p in patterns.items():
        out[label] = at
        at += 1 + group_count(p)
    return out


# ------------------------------------------------------------------ pieces and spans



def unmarked(text: Column) -> Column:
    """The text without markers of its own."""
    clean = F.replace(F.replace(text, F.lit(MARK), F.lit("\ufffd")), F.lit(SEP), F.lit("\ufffd"))
    return F.when(text.rlike(f"[{MARK}{SEP}]"), clean).otherwise(text)


def pieces(text: Column, patterns: str | dict[str, str], plain: bool = False) -> Column:
    """The text cut at its matches, in order: array of (hit, label, match), label the number of the
    pattern whose group took part. One pass over the text, however many labels there are. ``plain``: the
    text is ``unmarked``."""
    text = text if plain else unmarked(text)
    if isinstance(patterns, str):
        pattern, found = patterns, "$0"
    else:
        pattern, found = combined(patterns), SEP.join(f"${g}" for g in label_groups(patterns).values())
    cut = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(MARK + found + MARK)), MARK, -1)
    # only the matches hold marks; the text between them, most of it, is not searched again
    return F.transform(cut, lambda p, i: F.struct(
        (i % 2 == 1).alias("hit"),
        F.when(i % 2 == 1, F.length(p) - F.length(F.ltrim(p, F.lit(SEP)))).otherwise(0).alias("label"),
        F.when(i % 2 == 1, F.replace(p, F.lit(SEP), F.lit(""))).otherwise(p).alias("match")))


def piece_tokens(cut: Column) -> Column:
    """The tokens of each of the ``pieces``."""
    return F.transform(cut, lambda p: F.regexp_extract_all(p["match"], F.lit(TOKEN), 0))


def located(cut: Column, with_tokens: bool = False, with_sentences: bool = False, tokens: Column | None = None) -> Column:
    """The spans among ``pieces``, array<struct<match, start, end, tok, ntok, sent, label>>: start and end
    characters, number of tokens before and in it, sentence and label. Pieces and matches are tokenised apart: exact when matches start and end on token
    boundaries, as whole-word patterns do. ``tokens``: their ``piece_tokens``, if they are known."""
    zero = F.lit(0)

    def measured(p, i):
        t = p["match"]
        parts = [p["hit"].alias("hit"), p["label"].alias("label"), t.alias("match"), F.length(t).alias("n")]
        if with_tokens:
            parts.append(F.size(F.regexp_extract_all(t, F.lit(TOKEN), 0) if tokens is None else F.get(tokens, i)).alias("ntok"))
        if with_sentences:  # starts of sentences, and whether the first and the last character are inside one
            inside = lambda at: F.length(F.translate(F.substring(t, at, 1), ".!?\n", "")) == 1
            parts += [F.size(F.regexp_extract_all(t, F.lit(SENT_RUN), 0)).alias("starts"), inside(1).alias("first"), inside(-1).alias("last")]
        return F.struct(*parts)

    def hit(x):
        return x["hit"] & (x["n"] > 0)

    def step(at, x):
        state, numbers = [(at["pos"] + x["n"]).alias("pos")], [at["pos"]]
        if with_tokens:
            state.append((at["tok"] + x["ntok"]).alias("tok"))
            numbers.append(at["tok"])
        if with_sentences:
            joins = F.when(at["open"] & x["first"], 1).otherwise(0)
            state += [(at["sents"] + x["starts"] - joins).alias("sents"), F.when(x["n"] == 0, at["open"]).otherwise(x["last"]).alias("open")]
            numbers.append(at["sents"] + F.when(x["first"] & ~at["open"], 1).otherwise(0) - 1)
        return F.struct(*state), hit(x), numbers

    start = [zero.alias("pos")] + ([zero.alias("tok")] if with_tokens else []) + (
        [zero.alias("sents"), F.lit(False).alias("open")] if with_sentences else [])
    width = 1 + with_tokens + with_sentences

    def found(xs):
        return let(scan(xs, F.struct(*start), step), lambda at: F.transform(F.filter(xs, hit), lambda x, i: F.struct(
            x["match"].alias("match"), nth(at, i, width, 0).alias("start"), (nth(at, i, width, 0) + x["n"]).alias("end"),
            (nth(at, i, width, 1) if with_tokens else zero).alias("tok"), (x["ntok"] if with_tokens else zero).alias("ntok"),
            (nth(at, i, width, width - 1) if with_sentences else zero).alias("sent"), x["label"].alias("label"))))

    return let(F.transform(cut, measured), found)


def spans(text: Column, patterns: str | dict[str, str], with_tokens: bool = False, with_sentences: bool = False,
          plain: bool = False) -> Column:
    """array of spans (``located``) of all matches of ``patterns`` in ``text`` (``start``/``end``: 0-based characters)."""
    return located(pieces(text, patterns, plain), with_tokens, with_sentences)


#: a cue that cannot reach over the end of a sentence, nor look there for more than a word's boundary
PLAIN_CUE = re.compile(r"[\w '’-]+")


def near_hits(cut: Column) -> Column:
    """The ``pieces`` without the sentences that lie between two hits and hold none: of a piece with several
    sentences its first and its last stay. What stays keeps its order, and two places are in one sentence
    as before. A text with a hit that has the end of a sentence in it stays whole."""
    over = F.exists(cut, lambda p: p["hit"] & (F.length(F.translate(p["match"], ".!?\n", "")) < F.length(p["match"])))
    short = F.transform(cut, lambda p: F.struct(
        p["hit"].alias("hit"), p["label"].alias("label"),
        F.when(p["hit"], p["match"]).otherwise(F.regexp_replace(p["match"], r"(?s)[.!?\n].*[.!?\n]", "\n")).alias("match")))
    return F.when(over, cut).otherwise(short)


def regex_spans(notes: DataFrame, pattern: str, text_col: str = "note_text", id_col: str = "note_id",
                window: int = SNIPPET_CHARS) -> DataFrame:
    """One row per match: note id, match text, start/end char, snippet of +-window chars
    (clipped at the text start)."""
    def rows(r):
        def row(s):
            low = F.greatest(s["start"] - window, F.lit(0))
            return F.struct(s["match"].alias("match"), s["start"].alias("start_char"), s["end"].alias("end_char"),
                            wide_slice(r["w"], low, s["end"] + window - low).alias("snippet"))

        return F.transform(r["a"], row)

    found = let(F.struct(spans(F.col(text_col), pattern).alias("a"), wide(F.col(text_col)).alias("w")), rows)
    return notes.select(id_col, F.posexplode(found).alias("match_index", "m")).select(id_col, "match_index", "m.*")


# fixed values: accented letters and their plain forms, typographic quotes
ACCENTS, PLAIN = "àâäáãåçéèêëíìîïñóòôöõúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
QUOTES, PLAIN_QUOTES = "’‘«»“”", "\'\'\"\"\"\""


def fold_letters(text: Column) -> Column:
    """Lower case without accents, typographic quotes to ASCII; each character stays one character."""
    t = F.lower(F.translate(text, "İ", "I"))
    return F.translate(t, ACCENTS + QUOTES, PLAIN + PLAIN_QUOTES)


def normalise_text(text: Column) -> Column:
    """Lower case, accents removed, typographic quotes to ASCII, whitespace collapsed."""
    return F.regexp_replace(fold_letters(text), r"\s+", " ")


def normalised(notes: DataFrame, text_col: str = "note_text", noise: list[str] = NOISE, out: str = "norm_text",
               align: str = "alignment") -> DataFrame:
    """X3 with offsets: ``out`` is the text with folded letters, without ``noise`` and then with each run of
    white space as one space; ``align`` lists where its segments begin, (norm, raw) characters: place p of
    a segment that begins at norm comes from raw + p - norm."""
    drop = {"noise": "|".join(f"(?:{scoped(p)})" for p in noise), "space": r"\s+"}
    x = notes.withColumn("_cut", pieces(F.col(text_col), drop))
    text = F.transform("_cut", lambda p: F.when(~p["hit"], fold_letters(p["match"])).when(p["label"] == 1, F.lit(" ")).otherwise(F.lit("")))

    def step(at, p):
        n, space = F.length(p["match"]), p["hit"] & (p["label"] == 1)
        made = F.when(~p["hit"], n).when(space & ~at["space"], 1).otherwise(0)
        state = F.struct((at["norm"] + made).alias("norm"), (at["raw"] + n).alias("raw"),
                         F.when(space, True).when(made > 0, False).otherwise(at["space"]).alias("space"))
        return state, made > 0, [at["norm"], at["raw"]]

    zero = F.struct(F.lit(0).alias("norm"), F.lit(0).alias("raw"), F.lit(False).alias("space"))
    places = let(scan(F.col("_cut"), zero, step), lambda flat: F.transform(
        F.filter(flat, lambda _, i: i % 2 == 0), lambda norm, i: F.struct(norm.alias("norm"), nth(flat, i, 2, 1).alias("raw"))))
    return x.withColumn(out, F.regexp_replace(F.array_join(text, ""), " +", " ")).withColumn(align, places).drop("_cut")


def raw_places(starts: Column, align: Column) -> Column:
    """The raw place of each of the sorted ``starts`` in a normalised text."""
    kinds = F.concat(F.transform(align, lambda a: F.struct(a["norm"].alias("p"), F.lit(0).alias("k"), a["raw"].alias("raw"))),
                     F.transform(starts, lambda s: F.struct(s.alias("p"), F.lit(1).alias("k"), F.lit(0).alias("raw"))))

    def step(at, e):
        state = F.struct(F.when(e["k"] == 0, e["raw"] - e["p"]).otherwise(at["shift"]).alias("shift"))
        return state, e["k"] == 1, [e["p"] + at["shift"]]

    return scan(F.sort_array(kinds), F.struct(F.lit(0).alias("shift")), step)


def sentences(notes: DataFrame, text_col: str = "note_text", id_col: str = "note_id") -> DataFrame:
    """One row per sentence: sent_id (0-based index), start/end char, text."""
    notes = notes.select(id_col, spans(F.col(text_col), SENTENCE).alias("_a"))
    return notes.select(id_col, F.posexplode("_a").alias("sent_id", "s")).select(
        id_col, "sent_id", F.col("s.start").alias("start_char"), F.col("s.end").alias("end_char"),
        F.col("s.match").alias("sentence"),
    )


def sections(notes: DataFrame, text_col: str = "note_text", id_col: str = "note_id", heading: str = HEADING) -> DataFrame:
    """One row per heading: title (without colon), start char, end char (= next heading
    start or the text end)."""
    x = notes.select(id_col, F.length(text_col).alias("_n"), spans(F.col(text_col), heading).alias("_h"))
    ends = F.concat(F.slice(F.transform("_h", lambda s: s["start"]), F.lit(2), F.greatest(F.size("_h") - 1, F.lit(0))), F.array("_n"))
    rows = F.zip_with("_h", F.when(F.size("_h") > 0, ends).otherwise(F.array().cast("array<int>")), lambda s, end: F.struct(
        F.regexp_replace(s["match"], ":$", "").alias("section"), s["start"].alias("start_char"), end.alias("end_char")))
    return x.select(id_col, F.posexplode(rows).alias("section_index", "s")).select(id_col, "section_index", "s.*")


def mentions(
    notes: DataFrame,
    lexicon: dict[str, str] = LEXICON,
    cues: dict[str, list[str]] | CueRules = CUES,
    text_col: str = "note_text",
    keep_cols: tuple[str, ...] = ("encounter_num",),
    k_before: int = WINDOW_BEFORE,
    k_after: int = WINDOW_AFTER,
    heading: str = HEADING,
    snippet: int = SNIPPET_CHARS,
    align_col: str | None = None,
) -> DataFrame:
    """X2 + X5 + X6 + X9 + X4: lexicon mentions with sentence, qualifiers, section, token window.

    A qualifier is true in the scope of a cue of its class (``CueRules``; a plain dict holds left cues);
    history is also true inside a section whose title is a history cue. With ``align_col`` the text is a
    normalised one and the mentions carry ``raw_start`` and ``raw_end`` as well."""
    rules = cues if isinstance(cues, CueRules) else CueRules(cues)
    classes = rules.classes()
    text = F.col(text_col)
    keep = ["note_id", *keep_cols]
    # a note without a mention needs no further pass; a filter on the pieces would make them twice
    x = notes.where(unmarked(text).rlike(combined(lexicon)))
    x = x.select(*keep, *([F.col(align_col).alias("_al")] if align_col else []), text.alias("_t"), unmarked(text).alias("_u"))
    x = x.withColumn("_p", pieces(F.col("_u"), lexicon, plain=True)).withColumn("_k", piece_tokens(F.col("_p")))
    # cues count in the sentences of mentions only, so the others are not searched for them
    one_sentence = all(PLAIN_CUE.fullmatch(w) for w in rules.phrases())
    x = x.withColumn("_n", near_hits(F.col("_p")) if one_sentence else F.col("_p"))
    patterns, roles = rules.groups()
    # what a role does, as a number: 0 ends all scopes, then the classes from the left and from the right
    number = {"stop": 0} | {f"{side} {c}": 1 + i for i, (side, c) in enumerate((s, c) for s in ("left", "right") for c in classes)}
    role_lists = F.array(*[F.array(*[F.lit(number[r]) for r in rs]).cast("array<int>") for rs in roles])

    def event(pos, kind, code, sent):
        return F.struct(pos.alias("pos"), F.lit(kind).alias("kind"), code.alias("code"), sent.alias("sent"))

    def cue_events(cues_found):
        return F.flatten(F.transform(cues_found, lambda c: F.transform(
            F.element_at(role_lists, c["label"] + 1), lambda r: event(c["start"], 2, r, c["sent"]))))

    note = F.struct(
        located(F.col("_p"), True, True, F.col("_k")).alias("m"), F.flatten("_k").alias("w"),
        wide(F.col("_t")).alias("b"), located(F.col("_n"), with_sentences=True).alias("n"),
        cue_events(spans(F.array_join(F.transform("_n", lambda p: p["match"]), ""), patterns, with_sentences=True, plain=True)).alias("c"),
        F.transform(spans(F.col("_u"), heading, plain=True), lambda h: F.struct(
            h["start"].alias("start"), F.lower(F.regexp_replace(h["match"], ":$", "")).alias("title"))).alias("h"),
        *([F.col("_al").alias("al")] if align_col else []))
    titles = [w.lower() for w in rules.left.get("history", [])]
    zero = {c: F.lit(-1) for c in classes}

    def scope(at, e, side, cls):
        """The sentence of the last cue of the class; a stop ends its scope."""
        return F.when(e["kind"] != 2, at[cls]).when(e["code"] == number[f"{side} {cls}"], e["sent"]).when(
            e["code"] == 0, F.lit(-1)).otherwise(at[cls])

    def headed(r):
        """Per mention: its section. A mention is read after a heading at the same place."""
        events = F.sort_array(F.concat(F.transform(r["h"], lambda h, i: event(h["start"], 0, i, F.lit(-1))),
                                       F.transform(r["m"], lambda m: event(m["start"], 1, F.lit(0), F.lit(-1)))))

        def step(at, e):
            return F.struct(F.when(e["kind"] == 0, e["code"]).otherwise(at["section"]).alias("section")), e["kind"] == 1, [at["section"]]

        return scan(events, F.struct(F.lit(-1).alias("section")), step)

    def before(r):
        """Per mention: the classes that a cue before it gives. A mention is read before a cue at the same place."""
        events = F.sort_array(F.concat(F.transform(r["n"], lambda m: event(m["start"], 1, F.lit(0), m["sent"])), r["c"]))

        def step(at, e):
            return F.struct(*[scope(at, e, "left", c).alias(c) for c in classes]), e["kind"] == 1, [at[c] == e["sent"] for c in classes]

        return scan(events, F.struct(*[v.alias(c) for c, v in zero.items()]), step)

    def behind(r):
        """The same from the other end: a cue at or after the mention's end reaches back."""
        events = F.reverse(F.sort_array(F.concat(F.transform(r["n"], lambda m: event(m["end"], 0, F.lit(0), m["sent"])), r["c"])))

        def step(at, e):
            return F.struct(*[scope(at, e, "right", c).alias(c) for c in classes]), e["kind"] == 0, [at[c] == e["sent"] for c in classes]

        return scan(events, F.struct(*[v.alias(c) for c, v in zero.items()]), step)

    def raw(r):
        return raw_places(F.flatten(F.transform(r["m"], lambda m: F.array(m["start"], m["end"] - 1))), r["al"])

    def rows(r):
        tables = [headed(r).alias("s"), before(r).alias("l")] + ([behind(r).alias("r")] if rules.right else []) + ([raw(r).alias("q")] if align_col else [])
        return let(F.struct(*tables), lambda t: F.transform(r["m"], lambda m, i: row(r, t, m, i)))

    def row(r, t, m, i):
        low = F.greatest(m["tok"] - k_before, F.lit(0))
        snip = F.greatest(m["start"] - snippet, F.lit(0))
        at = F.get(t["s"], i)
        section = F.when(at >= 0, F.get(r["h"], at)["title"])
        flags = {c: nth(t["l"], i, len(classes), k) == 1 for k, c in enumerate(classes)}
        if rules.right:  # listed from the last mention to the first
            other = F.size(r["m"]) - 1 - i
            flags = {c: f | (nth(t["r"], other, len(classes), k) == 1) for k, (c, f) in enumerate(flags.items())}
        if titles and "history" in flags:
            flags["history"] = flags["history"] | F.coalesce(section.isin(*titles), F.lit(False))
        return F.struct(
            m["match"].alias("lexical_variant"), F.element_at(F.array(*[F.lit(x) for x in lexicon]), m["label"] + 1).alias("std_lexical_variant"),
            m["start"].alias("start_char"), m["end"].alias("end_char"), m["tok"].alias("start"), (m["tok"] + m["ntok"]).alias("end"),
            m["sent"].alias("sent_id"), section.alias("section"),
            F.slice(r["w"], low + 1, m["tok"] + m["ntok"] + k_after - low).alias("words"), (m["tok"] - low).alias("word_index"),
            wide_slice(r["b"], snip, m["end"] + snippet - snip).alias("snippet"),
            (m["start"] - snip).alias("snippet_start"), (m["end"] - snip).alias("snippet_end"),
            *([nth(t["q"], i, 2, 0).alias("raw_start"), (nth(t["q"], i, 2, 1) + 1).alias("raw_end")] if align_col else []),
            *[f.alias(c) for c, f in flags.items()])

    return x.select(*keep, F.explode(let(note, rows)).alias("x")).select(*keep, "x.*")


def span_filter(spans_df: DataFrame, key: str = "note_id") -> DataFrame:
    """Per note, keep a set of non-overlapping spans, longest first (ties: earlier start, then label).

    Spans pass sorted by note and start; those that touch one another form a cluster, which ends where a
    span begins at or after the largest end so far. A cluster is decided on a map of its taken
    characters: a span that meets a kept one, which is at least as long, has its first or its last character
    taken, so that two looks decide it, and a cluster costs its sort and its length. Spans without
    characters, and those without a start or an end, are dropped."""
    out_cols = [key, "start_char", "end_char", "label"]
    x = spans_df.select(*out_cols).where("start_char < end_char")
    schema = x.schema.simpleString()[7:-1]

    def run(batches):
        import pyarrow as pa

        names = None
        note, low, reach, held = None, 0, 0, []

        def kept():
            taken, out = bytearray(reach - low), []
            for neg, start, end, label in sorted((s - e, s, e, lab) for s, e, lab in held):
                if not (taken[start - low] or taken[end - 1 - low]):
                    taken[start - low:end - low] = bytes([1]) * -neg
                    out.append((note, start, end, label))
            return out

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        done = []
        for b in batches:
            names, types = b.schema.names, b.schema.types
            for n, s, e, lab in zip(*(c.to_pylist() for c in b.columns)):
                if held and (n != note or s >= reach):
                    done += kept()
                    held = []
                if not held:
                    note, low, reach = n, s, e
                held.append((s, e, lab))
                reach = max(reach, e)
            if len(done) > 4096:
                yield batch(done)
                done = []
        if held:
            done += kept()
        if done:
            yield batch(done)

    parts = int(spans_df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return x.repartition(parts, key).sortWithinPartitions(key, "start_char", "end_char", "label").mapInArrow(run, schema)


def mention_stats(m: DataFrame) -> DataFrame:
    """Mean mentions per note; distinct notes, stays, patients."""
    per_note = m.groupBy("note_id").agg(F.count(F.lit(1)).alias("n"), F.first("encounter_num").alias("encounter_num"),
                                        F.first("patient_num").alias("patient_num"))
    return per_note.agg(
        F.avg("n").alias("mean_mentions_per_note"),
        F.count(F.lit(1)).alias("n_notes"),
        F.count_distinct("encounter_num").alias("n_stays"),
        F.count_distinct("patient_num").alias("n_patients"),
    )


def stays_per_term(m: DataFrame, term: str = "std_lexical_variant") -> DataFrame:
    """Distinct stays per term, most frequent first."""
    return (
        m.select(term, "encounter_num").distinct().groupBy(term).agg(F.count(F.lit(1)).alias("n_stays"))
        .orderBy(F.desc("n_stays"), F.asc(term))
    )


def cooccurrence(m: DataFrame, term: str = "std_lexical_variant") -> DataFrame:
    """A10: for term pairs t1 <= t2 (diagonal included), the number of stays having both.

    Stays are first counted per distinct sorted term set; pairs are expanded once per
    distinct set (weighted by its stay count), never per stay and never by a self join."""
    sets = m.groupBy("encounter_num").agg(F.sort_array(F.collect_set(term)).alias("ts"))
    combos = sets.groupBy("ts").agg(F.count(F.lit(1)).alias("n"))
    pairs = combos.select("n", F.explode(F.flatten(F.transform(
        "ts", lambda a: F.transform(F.filter("ts", lambda b: b >= a), lambda b: F.struct(a.alias("term_1"), b.alias("term_2")))
    ))).alias("p"))
    return pairs.groupBy("p.term_1", "p.term_2").agg(F.sum("n").alias("n_stays"))


def exclusive_terms(m: DataFrame, term: str = "std_lexical_variant") -> DataFrame:
    """A10 'O': stays whose only term is this one."""
    sets = m.groupBy("encounter_num").agg(F.collect_set(term).alias("ts"))
    return sets.where(F.size("ts") == 1).groupBy(F.col("ts")[0].alias(term)).agg(F.count(F.lit(1)).alias("n_stays"))


def token_labels(kept_spans: DataFrame, text_col: str = "span_text", ignore: int = -100) -> DataFrame:
    """Tokens of each kept span; the first carries the span label, the others ``ignore``."""
    toks = F.regexp_extract_all(F.col(text_col), F.lit(TOKEN), 0)
    return kept_spans.select("note_id", "start_char", "label", F.posexplode(toks).alias("token_index", "token")).withColumn(
        "token_label", F.when(F.col("token_index") == 0, F.col("label")).otherwise(F.lit(str(ignore))))
