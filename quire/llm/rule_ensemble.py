"""Operator 8: quality classifier by a sparse rule ensemble.

Statistics of the whole text feed boosted trees of depth DEPTH; every node of a
tree is a rule, the conjunction of the comparisons on its path. Logistic regression
with a lasso penalty (proximal gradient) keeps few of the rules, and those are
compiled into one Spark column expression over the statistics' columns, which
scores all rows within code generation.

Training uses a bounded sample: about TRAIN_ROWS labelled ids, by a hash of them. Of
several documents of one id one trains, by a hash of its text. Statistics come from
the executors; the driver gets one row of numbers a document. Labelled ids are
broadcast (2 * TRAIN_ROWS at most), so no text is shuffled unless ids repeat.

Cases: null texts are empty; the empty text is scored by its statistics like any
other, and very long texts in whole. Labels other than 0 and 1 or with null ids don't
train; of several labels of one id the smallest counts. Without labels of both kinds
(empty tables) every score is the share of label 1 (0.5 without labels). Repeated rows
give repeated results. Extra columns are kept whatever their names; those named as a
result, in any case, are replaced by it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import col, crc_mod, map_texts, materialize, share_of_rows, table

TRAIN_ROWS = 8000
TREES = 40
DEPTH = 3
SHRINK = 0.3
LASSO = 2e-3
THRESHOLD = 0.3

STATS = (
    "n_chars", "n_words", "word_len", "long_words", "upper", "digits", "symbols", "shouts", "punct", "other_punct", "distinct_words", "top_word", "same_next",
    "distinct_pairs", "dup_lines", "line_words", "capital_words", "bare_words",
)

_UPPER, _DIGITS, _SYMBOLS, _SHOUTS, _PUNCT = (bytes(x) for x in (range(65, 91), range(48, 58), b"#*$%&|<>", b"!?", b".,;:"))
_OTHER = b"\"'()+-/=@[\\]^_`{}~"
_BARE = bytes(range(128)).translate(None, bytes([*range(48, 58), *range(65, 91), *range(97, 123)]))


def statistics(text: str | None) -> tuple[float, ...]:
    """STATS of a whole text, by passes of built-in byte operations."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n, chars, size = len(words), len(text), max(1, len(data))
    if not n:
        return (float(chars), *[0.0] * (len(STATS) - 1))
    share = lambda some: (len(data) - len(data.translate(None, some))) / size
    lengths = list(map(len, words))
    lines = [x for x in text.split("\n") if x.strip()]
    counts = Counter(words)
    return (
        float(chars), float(n), sum(lengths) / n, sum(x > 15 for x in lengths) / n, share(_UPPER), share(_DIGITS), share(_SYMBOLS), share(_SHOUTS), share(_PUNCT), share(_OTHER),
        len(counts) / n, max(counts.values()) / n, sum(map(eq, words, words[1:])) / n, len(set(zip(words, words[1:], strict=False))) / max(1, n - 1),
        (len(lines) - len(set(lines))) / max(1, len(lines)), n / max(1, len(lines)), sum(map(bytes.istitle, words)) / n, sum(not w.strip(_BARE) for w in words) / n,
    )


def with_statistics(df: DataFrame, text_col: str = "text", keep: Sequence[str] | None = None, prefix: str = "") -> DataFrame:
    fields = T.StructType([T.StructField(name, T.DoubleType()) for name in STATS])
    return map_texts(df, text_col, fields, lambda: lambda texts: list(zip(*map(statistics, texts), strict=True)), keep, prefix)


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, greater, threshold) all of which hold


def grow(x: np.ndarray, gradient: np.ndarray, edges: list[np.ndarray], depth: int, least: int) -> tuple[list[Rule], np.ndarray]:
    """Rules of one regression tree on the gradient, and its prediction."""
    rules: list[Rule] = []
    out = np.zeros(len(x))
    open_: list[tuple[Rule, np.ndarray]] = [((), np.arange(len(x)))]
    while open_:
        path, rows = open_.pop()
        g = gradient[rows]
        out[rows] = g.mean()
        if len(path) >= depth or len(rows) < 2 * least:
            continue
        base, best = g.sum() ** 2 / len(g), (1e-9, -1, 0.0)
        for k, cut in enumerate(edges):
            if not len(cut):
                continue
            at = np.searchsorted(cut, x[rows, k], "left")  # cut[i - 1] < x <= cut[i]
            n = np.cumsum(np.bincount(at, minlength=len(cut) + 1))[:-1]
            s = np.cumsum(np.bincount(at, g, len(cut) + 1))[:-1]
            ok = (n >= least) & (len(g) - n >= least)
            if ok.any():
                gain = np.where(ok, s**2 / np.maximum(n, 1) + (g.sum() - s) ** 2 / np.maximum(len(g) - n, 1) - base, -1)
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (gain[i], k, cut[i])
        _, k, t = best
        if k < 0:
            continue
        right = x[rows, k] > t
        for greater, some in ((True, rows[right]), (False, rows[~right])):
            rule = (*path, (k, greater, float(t)))
            rules.append(rule)
            open_.append((rule, some))
    return rules, out


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, greater, t in rule:
        out &= (x[:, k] > t) if greater else (x[:, k] <= t)
    return out


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 600) -> tuple[float, np.ndarray]:
    """Intercept and weights of lasso logistic regression by accelerated proximal gradient."""
    mean = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
    b, w = math.log(mean / (1 - mean)), np.zeros(z.shape[1])
    step = 4 * len(z) / (np.linalg.norm(z, 2) ** 2 + len(z)) if z.size else 1.0
    vb, vw, t = b, w, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(vb + z @ vw, -30, 30)))
        nb = vb - step * (p - y).mean()
        nw = vw - step * (z.T @ (p - y)) / len(z)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        vb, vw = nb + (t - 1) / nt * (nb - b), nw + (t - 1) / nt * (nw - w)
        b, w, t = nb, nw, nt
    return b, w


class Ensemble:
    """Intercept and weighted rules."""

    def __init__(self, intercept: float, rules: list[tuple[Rule, float]]) -> None:
        self.intercept, self.rules = intercept, rules

    def column(self, prefix: str = "") -> Column:
        """The score as an expression over the statistics' columns."""
        total = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            test = F.lit(True)
            for k, greater, t in rule:
                c = col(prefix + STATS[k])
                test = test & ((c > t) if greater else (c <= t))
            total = total + F.when(test, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, shrink: float = SHRINK, penalty: float = LASSO) -> Ensemble:
    if len(y) == 0 or y.min() == y.max():
        mean = float(y.mean()) if len(y) else 0.5
        return Ensemble(math.log(max(mean, 1e-6) / max(1 - mean, 1e-6)), [])
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0.02, 0.98, 33))) for k in range(x.shape[1])]
    rng, score, found = np.random.default_rng(11), np.full(len(y), float(y.mean())), {}
    least = max(5, len(y) // 200)
    for _ in range(trees):
        some = rng.random(len(y)) < 0.6
        if not some.any():
            continue
        rules, _ = grow(x[some], (y - score)[some], edges, depth, least)
        leaf = np.zeros(len(y))
        for rule in rules:  # later rules are deeper or siblings: the deepest that holds decides
            hit = holds(rule, x)
            if (hit & some).any():
                leaf[hit] = (y - score)[hit & some].mean()
            found.setdefault(tuple(sorted(rule)), None)
        score = score + shrink * leaf
    rules = list(found)
    z = np.stack([holds(r, x) for r in rules], 1).astype(np.float64) if rules else np.zeros((len(y), 0))
    intercept, weights = lasso(z, y.astype(np.float64), penalty)
    return Ensemble(intercept, [(r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-9])


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> DataFrame:
    """Rows (id, text, y), one an id, of a bounded sample of the labels, whose ids are few and broadcast."""
    known = labels.filter(col(label).isin(0, 1) & col(id_col).isNotNull()).groupBy(col(id_col).alias("id")).agg(F.min(col(label)).cast("int").alias("y"))
    known = known.withColumn("all", F.lit(1))
    some = materialize(share_of_rows(known, ["id"], ["all"], rows).drop("all").orderBy(F.xxhash64("id"), "id").limit(2 * rows), "labelled")
    texts = documents.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    sample = texts.join(F.broadcast(some), "id")
    if sample.select("id").count() <= some.count():
        return sample
    return sample.groupBy("id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Ensemble:
    sample = labelled_sample(documents, labels, label, id_col, text_col, rows)
    got = with_statistics(sample, "text", keep=["id", "y"], prefix="stat_").collect()  # numbers of 2 * `rows` documents at most
    got.sort(key=lambda r: (r["id"], r["y"], *r[2:]))
    x = np.array([r[2:] for r in got], np.float64).reshape(len(got), len(STATS))
    return fit(x, np.array([r["y"] for r in got], np.float64))


def score(df: DataFrame, model: Ensemble, text_col: str = "text", keep: Sequence[str] | None = None, prefix: str = "", threshold: float = THRESHOLD) -> DataFrame:
    """Adds score (0 to 1) and predicted (score >= threshold)."""
    made = {(prefix + c).lower() for c in ("score", "predicted")}
    names = [c for c in (df.columns if keep is None else keep) if c.lower() not in made]
    inner = "stat_"
    while any(c.lower().startswith(inner) for c in df.columns):
        inner += "_"
    out = with_statistics(df, text_col, names, inner).select(*[col(c) for c in names], model.column(inner).alias(prefix + "score"))
    return out.withColumn(prefix + "predicted", (col(prefix + "score") >= threshold).cast("int"))


def op8_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(documents, labels.filter(crc_mod("doc_id", 5) != 0))
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    return score(documents, model, keep=["doc_id"]).select("doc_id", held.alias("held_out"), "score", "predicted")


QUERIES = {"op8_rule_ensemble": op8_rule_ensemble}
ORACLES: dict[str, str] = {}
