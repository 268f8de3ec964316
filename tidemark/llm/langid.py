"""Language identification with a string kernel.

Kernel: the blended-spectrum presence kernel over byte n-grams of 1 to 4 of
the lower-cased text (non-letters count as a space): the number of hashed
n-grams that two texts share, divided by the root of the product of their
numbers of n-grams.  Nystroem: the kernel is taken against landmark texts
only, K_mm ** -1/2 maps it to features, and a ridge regression is fitted for
each language against the rest.

Scoring is two batched matrix products: presence rows of a batch times the
landmarks' presence rows give the kernel, kernel times the dual weights the
scores.  As the kernel is linear in the presence rows, both products are
folded into one (n-grams x languages) matrix once, after fitting.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tidemark.llm.frames import Shared, fresh, hash_sample

NGRAMS = 4
BITS = 16
LANDMARKS = 128
TRAIN_ROWS = 2400
RIDGE = 1e-3
SHARPNESS = 8.0
UNKNOWN = "und"
MIN_SCORE = 0.4
_BATCH = 64
_MULT = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)]

_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def _presence(text: str | None, row: np.ndarray) -> int:
    """Set the buckets of the text's n-grams in ``row``; returns how many are set."""
    b = np.frombuffer((text or "").lower().encode(), np.uint8)
    if not len(b):
        return 0
    b = _LETTERS[b].astype(np.uint32)
    g = b
    for n in range(NGRAMS):
        if n:
            if len(b) <= n:
                break
            g = (g[:-1] << np.uint32(8)) | b[n:]
        row[(g * _MULT[n]) >> np.uint32(32 - BITS)] = 1
    return int(np.count_nonzero(row))


def presence_rows(texts: list, out: np.ndarray | None = None) -> np.ndarray:
    """Rows of presence values, each divided by the root of its sum: products of rows are kernel values."""
    p = np.zeros((len(texts), 1 << BITS), np.float32) if out is None else out[:len(texts)]
    p.fill(0)
    for i, t in enumerate(texts):
        n = _presence(t, p[i])
        if n:
            p[i] *= np.float32(1 / np.sqrt(n))
    return p


class LanguageModel:
    """Landmark rows, dual weights and the names of the languages."""

    def __init__(self, langs: list[str], landmarks: np.ndarray, dual: np.ndarray, base: np.ndarray):
        self.langs, self.base = langs, base
        self.folded = (landmarks.T @ dual).astype(np.float32)

    def outputs(self, rows: np.ndarray) -> np.ndarray:
        return rows @ self.folded + self.base


def train(texts: list[str], langs: list[str], n_landmarks: int = LANDMARKS, ridge: float = RIDGE) -> LanguageModel:
    """Landmarks are taken from the languages in turn, in the order of the rows."""
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs])
    queues = [list(np.flatnonzero(y == k)) for k in range(len(names))]
    picks: list[int] = []
    while len(picks) < min(n_landmarks, len(texts)) and any(queues):
        picks += [q.pop(0) for q in queues if q]
    picks = picks[:n_landmarks]
    lm = presence_rows([texts[i] for i in picks])
    values, vectors = np.linalg.eigh((lm @ lm.T).astype(np.float64))
    ok = values > 1e-6 * max(values.max(), 1e-12)
    root = vectors[:, ok] / np.sqrt(values[ok])
    k = np.concatenate([presence_rows(texts[i:i + _BATCH]) @ lm.T for i in range(0, len(texts), _BATCH)]).astype(np.float64)
    phi = k @ root
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    weight = 1.0 / np.bincount(y, minlength=len(names))[y]  # every language counts the same
    weight *= len(y) / weight.sum()
    base = (weight[:, None] * target).sum(0) / weight.sum()
    a = phi.T @ (phi * weight[:, None]) + ridge * len(y) * np.eye(phi.shape[1])
    w = np.linalg.solve(a, phi.T @ ((target - base) * weight[:, None]))
    return LanguageModel(names, lm, root @ w, base)


def fit_language(docs: DataFrame, learn: Column | None = None, text_col: str = "text", lang_col: str = "lang",
                 id_col: str = "doc_id", train_rows: int = TRAIN_ROWS) -> LanguageModel | None:
    """Fit on at most ``train_rows`` rows with a language and a text, chosen by the hash of id and text.

    None if there is no such row, as in an empty table.  Rows equal in id and text, and ties of the hash, count as one
    row.  Very long texts are learned from whole.  Other columns may have any names.  Only the sampled rows (bounded)
    reach the driver.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    if learn is not None:
        rows = rows.where(learn)
    got = hash_sample(rows.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")),
                      train_rows, "i", "t").toPandas()
    got = got.sort_values(["i", "t"], kind="stable")
    return train(list(got["t"]), list(got["l"])) if len(got) else None


_RESULT = "struct<lang:string,score:double>"
_TYPE = pa.struct([("lang", pa.string()), ("score", pa.float64())])


def predict_language(model: LanguageModel | None, text: Column) -> Column:
    """struct(lang, score) of a text column.

    ``und`` with score 0 if the text is null or holds no letter, or if nothing was learned.  The score is the
    softmax of the one-versus-rest outputs; equal outputs give the first language by name.  Very long texts are read
    whole; repeated texts get equal results.
    """
    shared = Shared(SparkSession.active(), model)

    @arrow_udf(_RESULT)
    def predict(texts: pa.Array) -> pa.Array:
        m = shared.get()
        langs, scores = [], []
        rows = np.zeros((_BATCH, 1 << BITS), np.float32)
        for i in range(0, len(texts), _BATCH):
            batch = [t.as_py() for t in texts[i:i + _BATCH]]
            if m is not None:
                presence_rows(batch, rows)  # always the whole block: a text's score must not hang on how many stand beside it
                z = SHARPNESS * m.outputs(rows)[:len(batch)].astype(np.float64)
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
            for k, t in enumerate(batch):
                if m is None or not t or not any(map(str.isalpha, t)):
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                else:
                    langs.append(m.langs[int(p[k].argmax())])
                    scores.append(float(p[k].max()))
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], fields=list(_TYPE))

    return predict(text)


def reject_language(docs: DataFrame, model: LanguageModel | None, text_col: str = "text",
                    min_score: float = MIN_SCORE, languages: list[str] | None = None) -> DataFrame:
    """``docs`` whose text is in one of ``languages`` (default: any learned) with at least ``min_score``.

    Null texts and texts without letters go.  All columns are kept, whatever their names.  Empty table: no rows.
    """
    r, = fresh(docs, "language")
    marked = docs.withColumn(r, predict_language(model, F.col(text_col)))
    ok = (F.col(f"{r}.lang") != UNKNOWN) & (F.col(f"{r}.score") >= min_score)
    if languages is not None:
        ok = ok & F.col(f"{r}.lang").isin(languages)
    return marked.where(ok).select(*docs.columns)
