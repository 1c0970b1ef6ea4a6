"""Token ids and token counts of whole texts, with a digest cache of counts.

Encoding: a byte-level BPE without normaliser can only merge inside pre-tokens, and a pre-token
never runs from a non-space into a space or line feed. So a text may be cut in front of such
white space, each distinct piece is encoded once by the library, and the pieces' ids are joined.
The cut is used only for tokenizers that declare that form; others encode the whole text.

Counts: normalised content (null becomes the empty text; the tokenizer's own normaliser, if it
has one, works inside the encoder) and the tokenizer file are digested; counts stored under both
digests are joined, only distinct misses are encoded, and their counts are appended.

Defined results: null text is empty; a null doc_id keeps its row; repeated rows each keep a
row; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
import types
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import arrow_map, scratch, stage

#: pieces start at a space or line feed that follows a non-space
PIECE = re.compile(r"\s*\S+(?:[^\S \n]\s*\S+)*(?:[^\S \n]\s*$)?|\s+")
#: white space in front of a space or line feed: such texts take the pattern, others a plain split
DOUBLE = re.compile(r"\s[ \n]")
#: a line feed or none, one Latin word, and a run of ASCII punctuation but the apostrophe
WORD = re.compile(r"(\n?)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-&(-/:-@\[-`{-~]*)")
#: distinct pieces kept in a worker before its memo starts anew
MEMO_PIECES = 250_000


def cuttable(model: bytes) -> bool:
    """True if the tokenizer file declares byte-level BPE on the usual pattern, no normaliser, and
    special tokens that neither hold nor absorb white space."""
    d = json.loads(model)
    pre = d.get("pre_tokenizer") or {}
    plain = (not d.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
             and pre.get("use_regex", True) and d["model"]["type"] == "BPE" and not d.get("truncation") and not d.get("padding"))
    return bool(plain and all(
        not (t.get("lstrip") or t.get("rstrip") or t.get("single_word")) and not re.search(r"\s", t["content"])
        for t in d.get("added_tokens", [])))


class Memo(dict):
    """Ids of pieces, encoded by the library when first asked for. Keys: a piece that starts with
    a line feed as it stands, else the piece without its leading space."""

    def __init__(self, lib):
        super().__init__()
        self.lib, self.tails = lib, {}
        # the byte-level alphabet: printable bytes stand for themselves, the rest follow at 256
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.alphabet = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def __missing__(self, piece: str) -> bytes:
        if len(self) > MEMO_PIECES:
            self.clear()
            self.tails.clear()
        m = WORD.fullmatch(piece)
        if m is None:
            got = self.encode(piece if piece[:1] == "\n" else " " + piece)
        elif m[3]:  # a word and the punctuation after it are pre-tokens of their own
            got = self[piece[:-len(m[3])]] + (self.tails.get(m[3]) or self.tail(m[3]))
        elif m[1]:
            got = (self.tails.get("\n") or self.tail("\n")) + self.one(m[2])
        else:
            got = self.one(" " + m[2])
        self[piece] = got
        return got

    def tail(self, text: str) -> bytes:
        got = self.tails[text] = self.encode(text)
        return got

    def encode(self, text: str) -> bytes:
        return array("I", self.lib.encode(text, add_special_tokens=False).ids).tobytes()

    def one(self, token: str) -> bytes:
        """Ids of one pre-token."""
        shown = token.encode().decode("latin-1").translate(self.alphabet)
        return array("I", [t.id for t in self.lib.model.tokenize(shown)]).tobytes()


def _worker_state() -> dict:
    """A dict that outlives tasks in a reused Python worker (functions shipped by value are new
    in each task)."""
    return sys.modules.setdefault("_cohortspark_llm_state", types.ModuleType("_cohortspark_llm_state")).__dict__


class Encoder:
    """Encodes whole texts."""

    def __init__(self, model: bytes, kind: str):
        if kind == "json":
            from tokenizers import Tokenizer

            self.lib = Tokenizer.from_str(model.decode())
            self.memo = Memo(self.lib) if cuttable(model) else None
        else:
            import sentencepiece

            self.lib, self.memo = sentencepiece.SentencePieceProcessor(model_proto=model), None
        self.kind = kind

    def library(self, texts: list[str]) -> list[bytes]:
        if self.kind == "json":
            got = (e.ids for e in self.lib.encode_batch(texts, add_special_tokens=False))
        else:
            got = self.lib.encode(texts, num_threads=1)
        return [np.array(x, "<u4").tobytes() for x in got]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if self.memo is None:
            return [x for i in range(0, len(texts), 16) for x in self.library(texts[i:i + 16])]
        out, of = [], self.memo.__getitem__
        for t in texts:
            if DOUBLE.search(t):
                head, *rest = PIECE.findall(t)
                got = [self.library([p])[0] if p[:2] == " \n" else of(p if p[0] == "\n" else p[1:]) for p in rest]
            else:
                head, *rest = t.replace("\n", " \n").split(" ")
                got = map(of, rest)
            out.append((self.library([head])[0] if head else b"") + b"".join(got))
        return out


def encoder(model: bytes, kind: str) -> Encoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    made, key = _worker_state(), "encoder " + hashlib.sha256(model).hexdigest()
    if key not in made:
        made[key] = Encoder(model, kind)
    return made[key]


def read_model(path: str) -> tuple[bytes, str]:
    with open(path, "rb") as f:
        return f.read(), "json" if path.endswith(".json") else "model"


def token_counts(docs: DataFrame, tokenizer_path: str, cache: str | None = None, limit: int = 1024,
                 text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    ``cache``: folder of the Parquet cache (tokenizer, digest, n_tokens), read if it exists and
    appended to; by default a new one in the shared folder. Texts travel once, to the rows that
    are encoded; everything else carries digests."""
    spark = docs.sparkSession
    model, kind = read_model(tokenizer_path)
    version = hashlib.sha256(model).hexdigest()
    shipped = spark.sparkContext.broadcast((model, kind))
    cache = cache or scratch(spark, "token-cache")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = stage(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"),
        F.unhex(F.sha2(text, 256)).alias("digest")), "digests")

    schema = "tokenizer string, digest binary, n_tokens long"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        stored = spark.read.schema(schema).parquet(cache).where(F.col("tokenizer") == version)
    else:
        stored = spark.createDataFrame([], schema)
    first = keys.groupBy("digest").agg(F.min(F.coalesce("doc_id", F.lit(-2**63))).alias("doc_id"))
    misses = first.join(stored.select("digest"), "digest", "left_anti")

    def encode(batch: pa.RecordBatch) -> dict:
        got = encoder(*shipped.value).ids(batch.column("text").to_pylist())
        return {"digest": batch.column("digest"), "n_tokens": [len(x) // 4 for x in got]}

    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-2**63)).alias("doc_id"), text.alias("text"))
    # the digest again tells apart rows that share a doc_id; equal rows are encoded once
    todo = texts.join(misses.hint("shuffle_hash"), "doc_id").where(F.unhex(F.sha2("text", 256)) == F.col("digest"))
    new = arrow_map(todo.select("digest", "text"), encode, "digest binary, n_tokens long").dropDuplicates(["digest"])
    new.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    counts = spark.read.schema(schema).parquet(cache).where(F.col("tokenizer") == version)
    # staged, so that Spark can split the join at a digest that many documents share
    counts = stage(counts.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "digest-counts")
    return keys.join(counts, "digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
