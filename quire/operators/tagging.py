"""Section tags: TF-IDF with a linear classifier, scored in column expressions.

The model is the exact optimum of L2-regularised squared hinge loss (C = 1,
one-versus-rest, the intercept as a regularised constant feature) over TF-IDF rows of
unit length, found by Newton's method when first asked for. Its vocabulary is a few
dozen words, which go into the plan as a literal; texts need no shuffle or join.
"""

from __future__ import annotations

import functools
import json
import math
import re
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import keep_once

UNTAGGED = "UNTAGGED"

# The training texts of each label.
TRAINING = (
    ("RESPONSIBILITY", "The manager shall ensure compliance with this policy"),
    ("RESPONSIBILITY", "Department heads are responsible for implementation"),
    ("RESPONSIBILITY", "The supervisor must monitor employee performance"),
    ("PROCEDURE", "Step 1: Open the application. Step 2: Click submit."),
    ("PROCEDURE", "This procedure must be followed during onboarding"),
    ("PROCEDURE", "Follow these steps to complete the process"),
    ("POLICY", "Employees may request leave up to 15 days annually"),
    ("POLICY", "All staff are entitled to medical benefits"),
    ("POLICY", "This policy applies to all full-time employees"),
    ("WORKING INSTRUCTION", "How to Download Our Manuals in PDF format"),
    ("WORKING INSTRUCTION", "Instructions for operating the scanning machine"),
    ("WORKING INSTRUCTION", "Refer to this guide when using the document portal"),
)


class TagModel:
    """Vocabulary with idf, and weights and intercepts by label."""

    def __init__(self, labels: list[str], idf: dict[str, float], weights: dict[str, list[float]], intercepts: list[float]) -> None:
        self.labels, self.idf, self.weights, self.intercepts = labels, idf, weights, intercepts

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(self.__dict__))

    @classmethod
    def load(cls, path: str) -> TagModel:
        return cls(**json.loads(Path(path).read_text()))

    @classmethod
    def load_or_train(cls, path: str, spark: SparkSession | None = None) -> TagModel:
        """The model kept at ``path``, or a new one, which is then kept.

        With ``spark`` the path may be in any storage that Spark writes. The model is
        written beside it and then given its name, which happens once: of sessions that
        train together the first to finish decides, and the others take its model.
        """
        if spark is not None:
            return cls(**json.loads(keep_once(spark, path, lambda: json.dumps(train().__dict__))))
        if Path(path).exists():
            return cls.load(path)
        model = train()
        model.save(path)
        return model


def squared_hinge(x: np.ndarray, y: np.ndarray, rounds: int = 200) -> np.ndarray:
    """argmin |w|^2 / 2 + sum(max(0, 1 - y w.x)^2) by Newton steps on the active rows, halved while they don't descend."""
    w = np.zeros(x.shape[1])
    loss = lambda v: v @ v / 2 + (np.maximum(0, 1 - y * (x @ v)) ** 2).sum()
    for _ in range(rounds):
        gap = np.maximum(0, 1 - y * (x @ w))
        gradient = w - 2 * x.T @ (y * gap)
        if np.linalg.norm(gradient) < 1e-13:
            break
        active = x[gap > 0]
        step = np.linalg.solve(np.eye(len(w)) + 2 * active.T @ active, gradient)
        size = 1.0
        while loss(w - size * step) > loss(w) and size > 1e-8:
            size /= 2
        w = w - size * step
    return w


@functools.lru_cache(maxsize=4)
def train(rows: tuple[tuple[str, str], ...] = TRAINING) -> TagModel:
    tokens = [re.findall(r"(?u)\b\w\w+\b", text.lower()) for _, text in rows]
    words = sorted({w for some in tokens for w in some})
    tf = np.array([[some.count(w) for w in words] for some in tokens], float)
    idf = np.log((1 + len(rows)) / (1 + (tf > 0).sum(0))) + 1
    x = tf * idf
    x = np.hstack([x / np.linalg.norm(x, axis=1, keepdims=True), np.ones((len(rows), 1))])
    labels = sorted({label for label, _ in rows})
    w = np.stack([squared_hinge(x, np.where([r[0] == label for r in rows], 1.0, -1.0)) for label in labels], 1)
    return TagModel(labels, dict(zip(words, idf.tolist(), strict=True)), dict(zip(words, w[:-1].tolist(), strict=True)), w[-1].tolist())


def scores(text: Column, model: TagModel | None = None) -> Column:
    """array<double>: the decision value of each label, in label order."""
    model = model or train()
    words = list(model.idf)
    # For each word idf, then idf times the label's weight.
    values = F.create_map(*[x for w in words for x in (F.lit(w), F.array(*[F.lit(model.idf[w] * v) for v in (1.0, *model.weights[w])]))])
    # A token is a run of letters, numbers and _; one set operation finds the few known ones, and only those are counted.
    tokens = F.split(F.lower(text), r"[^\p{L}\p{N}_]+")
    known = F.array(*[F.lit(w) for w in words])

    def scored(all_: Column) -> Column:
        terms = F.transform(F.array_intersect(all_, known), lambda w: F.struct(F.size(F.filter(all_, lambda t: t == w)).cast("double").alias("n"), F.element_at(values, w).alias("v")))

        def of(terms: Column) -> Column:
            total = lambda k: F.aggregate(terms, F.lit(0.0), lambda s, t: s + t["n"] * t["v"][k])
            length = F.sqrt(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t["n"] * t["n"] * t["v"][0] * t["v"][0]))
            return F.array(*[F.when(F.size(terms) == 0, F.lit(b)).otherwise(total(k + 1) / length + F.lit(b)) for k, b in enumerate(model.intercepts)])

        return F.get(F.transform(F.array(terms), of), F.lit(0))

    return F.get(F.transform(F.array(tokens), scored), F.lit(0))


def best(values: Column, model: TagModel | None = None) -> Column:
    """The label of the largest score, the first of equals."""
    model = model or train()
    return F.element_at(F.array(*[F.lit(x) for x in model.labels]), F.array_position(values, F.array_max(values)).cast("int"))


def tag(df: DataFrame, text_col: str = "content", out: str = "tag", untag_blank: bool = True, model: TagModel | None = None) -> DataFrame:
    """Adds the tag of a text.

    ``untag_blank``: blank text is UNTAGGED, as when sections are made. An edit asks
    the model about any text, and one without a known word gets the label of the
    largest intercept. A null text is UNTAGGED in either case.
    """
    from quire.functions.text import strip

    c = F.col(text_col)
    label = F.get(F.transform(F.array(scores(c, model)), lambda s: best(s, model)), F.lit(0))
    blank = (strip(c) == "") if untag_blank else F.lit(False)
    return df.withColumn(out, F.when(c.isNull() | blank, UNTAGGED).otherwise(label))


def oracle_scores(content: str, table: str, keys: str, model: TagModel | None = None) -> str:
    """DuckDB SQL for the label of each row of ``table``: (keys, tag), before the rule for blank text."""
    model = model or train()
    rows = ", ".join(f"('{w}', {', '.join(f'{v!r}::DOUBLE' for v in (model.idf[w], *model.weights[w]))})" for w in model.idf)
    names = ", ".join(f"w{k}" for k in range(len(model.labels)))
    picks = " UNION ALL ".join(
        f"SELECT {keys}, '{label}' AS tag, coalesce(sum(n * idf * w{k}) / sqrt(sum(n * idf * n * idf)), 0) + {model.intercepts[k]!r}::DOUBLE AS score FROM hits GROUP BY {keys}" for k, label in enumerate(model.labels)
    )
    return f"""
    model(w, idf, {names}) AS (VALUES {rows}),
    tokens AS (SELECT {keys}, unnest(regexp_extract_all(lower({content}), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS w FROM {table}),
    counts AS (SELECT {keys}, w, count(*) AS n FROM tokens GROUP BY ALL),
    hits AS (SELECT t.*, c.n, m.* EXCLUDE (w) FROM (SELECT {keys} FROM {table}) t LEFT JOIN (counts c JOIN model m USING (w)) USING ({keys})),
    scored AS ({picks}),
    tags AS (SELECT {keys}, tag FROM scored QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, tag) = 1)"""


def accuracy(model: TagModel) -> float:
    """Share of the training texts that get their own label (by plain Python)."""
    right = 0
    for label, text in TRAINING:
        found = [w for w in re.findall(r"\b\w\w+\b", text.lower()) if w in model.idf]
        length = math.sqrt(sum((found.count(w) * model.idf[w]) ** 2 for w in set(found))) or 1.0
        values = [sum(model.idf[w] * model.weights[w][k] for w in found) / length + b for k, b in enumerate(model.intercepts)]
        right += model.labels[values.index(max(values))] == label
    return right / len(TRAINING)
