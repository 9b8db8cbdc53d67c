"""Toxicity classifier with counterfactual regularisation.

A logistic model over the words of a text. Each labelled text that names a group also yields copies in which the
identity terms are swapped for others; the loss adds the squared difference between the scores of a text and of its
copies, so naming a group moves no score by itself.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import over_cores, slices
from tessera.llm.quality import labelled_sample

#: Terms that name groups; any of them may stand for any other in a counterfactual copy.
IDENTITY_TERMS = (
    "women", "men", "woman", "man", "muslim", "muslims", "christian", "christians", "jewish", "jews", "hindu", "hindus",
    "buddhist", "atheist", "black", "white", "asian", "african", "latino", "arab", "immigrant", "immigrants", "refugees",
    "gay", "lesbian", "straight", "bisexual", "trans", "transgender", "queer", "deaf", "blind", "disabled", "autistic",
    "old", "young", "french", "german", "spanish", "american", "chinese", "mexican", "indian", "russian",
)
FIT_DOCS = 4000
FIT_LONGEST = 20_000
#: Words in fewer documents of the sample are no features; so many with the clearest difference are.
MIN_DOCS = 5
MAX_FEATURES = 300
#: Weight of the squared score change under a swap, of the squared weights, and copies made of each text.
SWAP_PENALTY = 5.0
RIDGE = 1e-5
SWAPS = 3

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass(frozen=True)
class ToxicityModel:
    features: tuple[str, ...]
    weights: tuple[float, ...]
    bias: float


def swapped(present: frozenset[str], terms: Sequence[str], copies: int) -> list[frozenset[str]]:
    """Copies of a text's words with each identity term moved on in the list, a different step for each copy."""
    place = {t: i for i, t in enumerate(terms)}
    own = present & place.keys()
    if not own:
        return []
    steps = [1 + round(k * (len(terms) - 1) / copies) for k in range(copies)]
    return [frozenset(present - own) | {terms[(place[t] + s) % len(terms)] for t in own} for s in steps]


def train(
    texts: list[tuple[str, int]], share: float, terms: Sequence[str] = IDENTITY_TERMS, penalty: float = SWAP_PENALTY,
    min_docs: int = MIN_DOCS, max_features: int = MAX_FEATURES, ridge: float = RIDGE, rounds: int = 60,
) -> ToxicityModel:
    """Fit by Newton steps on the mean log loss at the true class shares, ridge and swap penalty added."""
    bags = [frozenset(words(t)) for t, _ in texts]
    y = np.array([float(label == 1) for _, label in texts])
    prior = float(np.clip(share, 1e-3, 1 - 1e-3))
    if not len(y) or y.min() == y.max():
        return ToxicityModel((), (), float(np.log(prior / (1 - prior))))
    hits = [Counter(), Counter()]
    for bag, label in zip(bags, y, strict=True):
        hits[int(label)].update(bag)
    n = [int((y == 0).sum()), int((y == 1).sum())]

    def clear(word: str) -> float:
        rate = [(hits[k][word] + 0.5) / (n[k] + 1) for k in (0, 1)]
        both = [(rate[k], 1 - rate[k]) for k in (0, 1)]
        return sum((p - q) * np.log(p / q) for p, q in zip(both[1], both[0], strict=True))

    common = [w for w in {*hits[0], *hits[1]} if hits[0][w] + hits[1][w] >= min_docs]
    chosen = sorted(sorted(common, key=lambda w: (-clear(w), w))[:max_features] + [t for t in terms if hits[0][t] + hits[1][t]])
    features = {w: i + 1 for i, w in enumerate(dict.fromkeys(chosen))}

    def matrix(rows: Sequence[frozenset[str]]) -> np.ndarray:
        x = np.zeros((len(rows), len(features) + 1))
        x[:, 0] = 1
        for i, bag in enumerate(rows):
            x[i, [features[w] for w in bag & features.keys()]] = 1
        return x

    x, weight = matrix(bags), np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean())) / len(y)
    pairs = [(i, copy) for i, bag in enumerate(bags) for copy in swapped(bag, terms, SWAPS)]
    change = x[[i for i, _ in pairs]] - matrix([copy for _, copy in pairs]) if pairs else np.zeros((0, x.shape[1]))
    held = change.T @ change * (penalty / max(1, len(pairs))) + ridge * np.diag([0.0, *np.ones(len(features))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + held + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(curve, x.T @ (weight * (y - p)) - held @ w)
        w += step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return ToxicityModel(tuple(features), tuple(map(float, w[1:])), float(w[0]))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", fit_docs: int = FIT_DOCS) -> ToxicityModel:
    """Train on a bounded sample of the labelled rows where ``learn`` holds."""
    sample, share = labelled_sample(docs, labels, label, learn, fit_docs, longest=FIT_LONGEST)
    return train([(t.decode(), y) for t, y in sample], share)


def score(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``<key>, score`` of each row of ``docs``.

    Null and empty texts get the score of a text without known words. Rows that repeat each get their row, other
    columns are not read. A task holds the words of one text at a time.
    """
    rows = over_cores(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "key")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = dict(zip(model.features, model.weights, strict=True))
        known = weights.keys()
        for batch in slices(batches, "text"):
            z = np.array([
                model.bias + sum(weights[w] for w in sorted(known & set(_WORD.findall((t or "").lower()))))
                for t in (x.as_py() for x in batch.column(1))
            ])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["key", "score"])

    out = rows.mapInArrow(scored, f"key {docs.schema[key].dataType.simpleString()}, score double")
    return out.select(F.col("key").alias(key), "score")
