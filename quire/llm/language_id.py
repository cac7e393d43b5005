"""Operator 4: language identification with string kernels.

Kernel: the blended spectrum of order 1 to ORDERS over lower-cased characters; two
texts share as many n-grams as are present in both, divided by the geometric mean
of their numbers of n-grams. N-grams are hashed to FEATURES places. Landmarks of
each language span a Nyström space, in which one-versus-rest kernel ridge regression
is solved. Scoring is two matrix products a batch: presence by landmarks, then kernel
rows by coefficients. ``score`` is the softmax over the classes' outputs.

Training uses whole texts of a bounded sample: about PER_LANGUAGE labelled rows of
each of the MOST_LANGUAGES most frequent languages, fewer if TRAIN_ROWS don't do,
chosen by a hash of their ids and texts; landmarks are the first of those, LANDMARKS
of a language and MOST_LANDMARKS in all. Features are made on the executors; the
driver gets bit vectors, FEATURES / 8 bytes a row.

Cases: null texts and texts without a letter are ``und`` with score 0, as is every
text if nothing could be learned (empty tables). Numerals and fractions aren't
letters. Rows with null lang, null text or without a letter don't train; a null id
does. Very long texts are processed in whole. Repeated rows give repeated results and
train as often as they stand; if more of them are chosen than 2 * TRAIN_ROWS, the
first by hash count. Extra columns are kept whatever their names; those named as a
result, in any case, are replaced by it.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import col, crc_mod, map_texts, share_of_rows, table

ORDERS = 3
FEATURES = 1 << 13
PER_LANGUAGE = 400
LANDMARKS = 48  # of each language
MOST_LANGUAGES = 200
TRAIN_ROWS = 8000
MOST_LANDMARKS = 2000
RIDGE = 1e-3
SHARPNESS = 8.0
NEAREST = 5
_LETTER = re.compile(r"[^\W\d_]")
_PRIME = (2654435761, 2246822519, 3266489917, 668265263)


def has_letter(text: str | None) -> bool:
    """A letter, not only a numeral such as a fraction or a superscript."""
    return any(m.group().isalpha() for m in _LETTER.finditer(text or ""))


def presence(texts: Sequence[str], orders: int = ORDERS, features: int = FEATURES) -> np.ndarray:
    """For each text, which hashed n-grams are present (uint8, texts x features)."""
    out = np.zeros((len(texts), features), np.uint8)
    flat = out.reshape(-1)
    shift = np.uint32(32 - features.bit_length() + 1)
    codes = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    sizes = [len(c) for c in codes]
    if not sum(sizes):
        return out
    chars = np.concatenate(codes)
    row = np.repeat(np.arange(len(texts), dtype=np.int64) * features, sizes)
    last = np.repeat(np.cumsum(sizes), sizes)  # the end of each character's text
    gram = np.zeros(len(chars), np.uint32)
    for n in range(orders):
        m = len(chars) - n
        if m <= 0:
            break
        gram = gram[:m] * np.uint32(_PRIME[1]) + chars[n:] * np.uint32(_PRIME[0]) + np.uint32(_PRIME[2])
        mixed = (gram ^ (gram >> np.uint32(15))) * np.uint32(_PRIME[3] + 2 * n)
        inside = np.arange(m) + n < last[:m]
        flat[row[:m][inside] + (mixed[inside] >> shift)] = 1
    return out


class Kernel:
    """The fitted classifier: landmarks (features x landmarks) and coefficients (landmarks x languages)."""

    def __init__(self, languages: list[str], landmarks: np.ndarray, norms: np.ndarray, weights: np.ndarray, orders: int, features: int) -> None:
        self.languages, self.landmarks, self.norms, self.weights, self.orders, self.features = languages, landmarks, norms, weights, orders, features

    def rows(self, found: np.ndarray) -> np.ndarray:
        own = np.sqrt(np.maximum(found.sum(1, dtype=np.float32), 1))[:, None]
        return (found.astype(np.float32) @ self.landmarks) / own / self.norms

    def near(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Kernel rows, and their mean over the NEAREST landmarks beyond what texts of that many n-grams share by chance."""
        found = presence(texts, self.orders, self.features)
        rows = self.rows(found)
        chance = np.sqrt(found.sum(1, dtype=np.float32))[:, None] * self.norms / self.features
        k = min(NEAREST, rows.shape[1])
        return rows, np.maximum(np.partition(rows - chance, -k, axis=1)[:, -k:].mean(1), 0).astype(np.float64)


def fit_kernel(bits: np.ndarray, langs: list[str], orders: int = ORDERS, features: int = FEATURES, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Kernel | None:
    """Kernel ridge regression in the landmarks' Nyström space; None without a row."""
    languages = sorted(set(langs))
    if not languages:
        return None
    which = np.array([languages.index(x) for x in langs])
    chosen = np.concatenate([np.flatnonzero(which == k)[:landmarks] for k in range(len(languages))])
    marks = bits[chosen].T.astype(np.float32)
    norms = np.sqrt(np.maximum(marks.sum(0), 1))
    made = Kernel(languages, marks, norms, np.zeros((len(chosen), len(languages)), np.float32), orders, features)
    k_all = made.rows(bits).astype(np.float64)
    values, vectors = np.linalg.eigh(k_all[chosen])
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = k_all @ root
    want = np.where(which[:, None] == np.arange(len(languages)), 1.0, -1.0)
    weight = 1.0 / np.bincount(which)[which][:, None]  # each language counts alike
    solved = np.linalg.solve(phi.T @ (phi * weight) + ridge * np.eye(phi.shape[1]), phi.T @ (want * weight))
    made.weights = (root @ solved).astype(np.float32)
    return made


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = PER_LANGUAGE, orders: int = ORDERS, features: int = FEATURES, rows: int = TRAIN_ROWS) -> Kernel | None:
    """Fit on about ``per_language`` rows of each language, ``rows`` in all, by a hash of their ids and texts."""
    labelled = df.select(col(id_col).cast("string").alias("id"), col(lang_col).cast("string").alias("lang"), col(text_col).cast("string").alias("text")).filter("lang is not null and text is not null")
    groups = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()
    if not groups:
        return None
    per_language = max(1, min(per_language, rows // len(groups)))
    known = df.sparkSession.createDataFrame(groups, "lang string, n long")
    sample = share_of_rows(labelled, ["id", "text"], ["lang"], per_language, known)
    sample = sample.withColumn("place", F.xxhash64("id", "text"))

    def factory():
        def work(texts):
            bits = np.packbits(presence(texts, orders, features), axis=1)
            return [pa.array([b.tobytes() for b in bits]), [has_letter(t) for t in texts]]

        return work

    fields = T.StructType([T.StructField("bits", T.BinaryType()), T.StructField("letter", T.BooleanType())])
    got = map_texts(sample, "text", fields, factory, keep=["place", "lang"]).filter("letter").orderBy("place", "lang").select("lang", "bits").limit(2 * rows).collect()
    if not got:
        return None
    bits = np.unpackbits(np.frombuffer(b"".join(r["bits"] for r in got), np.uint8).reshape(len(got), -1), axis=1)
    return fit_kernel(bits, [r["lang"] for r in got], orders, features, max(1, min(LANDMARKS, MOST_LANDMARKS // len(groups))))


def classify(df: DataFrame, kernel: Kernel | None, text_col: str = "text", keep: Sequence[str] | None = None, prefix: str = "") -> DataFrame:
    """Adds lang_pred, score (0 to 1) and likeness, the kernel with the nearest landmarks beyond chance (0: like no language learned)."""
    fields = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("likeness", T.DoubleType())])
    sent = df.sparkSession.sparkContext.broadcast(kernel)

    def factory():
        model = sent.value

        def work(texts):
            lang, score, like = ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
            known = [i for i, t in enumerate(texts) if model is not None and has_letter(t)]
            if known:
                near, likeness = model.near([texts[i] for i in known])
                out = (near @ model.weights).astype(np.float64)
                p = np.exp(SHARPNESS * (out - out.max(1, keepdims=True)))
                p /= p.sum(1, keepdims=True)
                for i, best, s, f in zip(known, p.argmax(1).tolist(), p.max(1).tolist(), likeness.tolist(), strict=True):
                    lang[i], score[i], like[i] = model.languages[best], min(1.0, s), f
            return lang, score, like

        return work

    return map_texts(df, text_col, fields, factory, keep, prefix)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    kernel = train(documents.filter(crc_mod("doc_id", 4) != 2))
    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    return classify(documents, kernel, keep=["doc_id"]).select("doc_id", held.alias("held_out"), "lang_pred", "score")


QUERIES = {"op4_language_id": op4_language_id}
ORACLES: dict[str, str] = {}
