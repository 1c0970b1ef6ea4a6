"""Language identification with error-correcting output codes.

Each language has a codeword; one binary classifier per bit tells the languages whose bit is set
from the others by hashed byte n-grams of the lower-cased letters (log ratio of the two sides'
mean n-gram shares, counted over all training documents by Spark). A text's margins are scaled
by what each side expects, each bit's logistic loss is weighted by how well that bit separates,
and the codeword with the least total loss is the language. A small gap to the second codeword
flags the text as ambiguous.

Defined results: text that is null or has no letter is ``und`` with score 0 and not ambiguous;
so is every text when nothing was learned. A null doc_id is never held out, its row stays;
repeated rows each get a row; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import Shared, arrow_map, binary_texts, crc_fold, row_key

BUCKETS = 1 << 16
SIZES = (1, 2, 3, 4)

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def ngrams(text: bytes) -> np.ndarray:
    """Buckets of all byte n-grams of the lower-cased words, each word with its borders."""
    b = b" " + b" ".join(text.translate(_LOWER).split()) + b" "
    x = np.frombuffer(b, np.uint8).astype(np.uint64)
    out, code = [], np.zeros(len(x), np.uint64)
    for n in SIZES:
        if len(x) < n:
            break
        code = code[:len(x) - n + 1] * np.uint64(256) + x[n - 1:]
        out.append(((code * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48))
    return np.concatenate(out).astype(np.int64)


def codewords(n: int) -> np.ndarray:
    """n codewords of +1/-1: all ways to split up to six languages in two, for more the random
    code of 10 * log2(n) bits, at least 31, with the largest least distance of 50 tries."""
    if n <= 6:
        rows = [p for p in itertools.product((1, -1), repeat=n) if p[0] == 1 and -1 in p]
        return np.array(rows or [(1,)] * n).T.reshape(n, -1)
    bits, rng, best, most = max(31, int(10 * np.log2(n))), np.random.default_rng(5), None, -1
    for _ in range(50):
        c = rng.choice([-1, 1], (n, bits))
        c = c[:, np.abs(c.sum(axis=0)) < n]
        far = min(int((a != b).sum()) for a, b in itertools.combinations(c, 2))
        best, most = (c, far) if far > most else (best, most)
    return best


class CodeModel:
    """Margins and losses of the bits, from the n-gram counts of each language."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs, self.code = langs, codewords(len(langs))
        p = (counts + 0.1) / (counts + 0.1).sum(axis=1, keepdims=True)
        weights, plus, minus = [], [], []
        for bit in self.code.T:
            a, b = (p[bit == s].mean(axis=0) if (bit == s).any() else np.full(p.shape[1], 1 / p.shape[1]) for s in (1, -1))
            w = np.log(a) - np.log(b)
            weights.append(w)
            plus.append((a * w).sum())
            minus.append(-(b * w).sum())
        self.weights = np.array(weights, np.float32).T.copy()
        plus, minus = np.array(plus), np.array(minus)
        self.mid, self.half = (plus - minus) / 2, (plus + minus) / 2
        self.trust = np.minimum(plus, minus) / max(np.minimum(plus, minus).max(), 1e-12)

    def losses(self, text: bytes) -> np.ndarray:
        h = ngrams(text)
        total = sum(self.weights[h[i:i + 65536]].sum(axis=0, dtype=np.float64) for i in range(0, len(h), 65536))
        margin = (total / len(h) - self.mid) / np.maximum(self.half, 1e-12)
        return np.logaddexp(0, -3 * margin[None, :] * self.code) @ self.trust / max(self.trust.sum(), 1e-12)


def train(docs: DataFrame, learn, buckets: int = BUCKETS) -> CodeModel | None:
    """Counts of every n-gram bucket by language over all rows where ``learn`` holds."""

    def count(batch: pa.RecordBatch) -> dict:
        total: dict[str, np.ndarray] = {}
        pairs = ((lang, t) for i in range(0, batch.num_rows, 512) for lang, t in zip(
            batch.column("lang").slice(i, 512).to_pylist(), binary_texts(batch.column("text").slice(i, 512))))
        for lang, t in pairs:
            if lang not in total:
                total[lang] = np.zeros(buckets, np.int64)
            h = ngrams(t)
            for i in range(0, len(h), 1 << 20):
                total[lang] += np.bincount(h[i:i + (1 << 20)], minlength=buckets)
        hit = {lang: np.flatnonzero(v) for lang, v in total.items()}
        return {"lang": [lang for lang, h in hit.items() for _ in range(len(h))], "bucket": np.concatenate(list(hit.values())),
                "n": np.concatenate([total[lang][h] for lang, h in hit.items()])}

    rows = arrow_map(docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text"),
                     count, "lang string, bucket long, n long", rows=0)
    got = rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # languages x buckets at most
    langs = sorted(got["lang"].unique())
    if not langs:
        return None
    counts = np.zeros((len(langs), buckets))
    counts[np.searchsorted(langs, got["lang"]), got["bucket"]] = got["n"]
    return CodeModel(langs, counts)


def identify(docs: DataFrame, learn=None, gap: float = 0.02, text_col: str = "text", id_col: str = "doc_id",
             lang_col: str = "lang", with_row: bool = False) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, ambiguous, on demand row (its ``row_key``). ``learn``: condition on
    doc_id for the rows to learn from; by default crc32(doc_id) mod 3 is not 1."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    held = F.coalesce(crc_fold(F.col("doc_id"), 3) == 1, F.lit(False))
    model = train(src, ~held if learn is None else learn)
    shipped = Shared(docs.sparkSession, model)

    def run(batch: pa.RecordBatch) -> dict:
        m, langs, scores, flags = shipped.value, [], [], []
        for ok, t in zip(batch.column("letters").to_pylist(), binary_texts(batch.column("text"))):
            if not ok or m is None:
                langs.append("und"), scores.append(0.0), flags.append(False)
                continue
            loss = m.losses(t)
            order = np.argsort(loss, kind="stable")
            like = np.exp(-10 * (loss - loss[order[0]]))
            langs.append(m.langs[order[0]])
            scores.append(float(like[order[0]] / like.sum()))
            flags.append(bool(len(loss) > 1 and loss[order[1]] - loss[order[0]] < gap))
        return {"doc_id": batch.column("doc_id"), "row": batch.column("row"), "held_out": batch.column("held_out"), "lang_pred": langs, "score": scores,
                "ambiguous": flags}

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    out = arrow_map(src.select("doc_id", row_key().alias("row"), held.alias("held_out"), letters.alias("letters"), "text"), run,
                     "doc_id long, row long, held_out boolean, lang_pred string, score double, ambiguous boolean")
    return out if with_row else out.drop("row")
