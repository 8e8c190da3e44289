"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or abstain on every document.  Expectation
maximisation estimates each labeller's accuracies in both classes and the share of good documents
(no true label is used).  Labellers look for different faults, so the bad class is a mixture of kinds, one
begun from each labeller's bad votes; errors are taken as independent within a kind.  Documents with
equal votes are alike to it, so it runs on the counts of vote patterns over all documents, at most
3 ** labellers rows.  The posterior labels then train a linear scorer on hashed features: trigrams
of character classes, common words and words in repeated runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchpanel.llm import quality_rules as q
from watchpanel.llm.wordspans import slices, utf8
from watchpanel.sources.storage import materialize

LABELLERS = ("symbols", "repeats", "capitals", "exclamations", "common words", "sentences", "length")
BUCKETS = 1 << 10
#: documents that the scorer is fitted on, at most: those with the smallest hashes
FIT_DOCUMENTS = 10_000
BAD, GOOD, NONE = 0, 1, 2


def votes(m: dict[str, np.ndarray]) -> np.ndarray:
    """A row for each text: BAD, GOOD or NONE of each labeller."""
    words = np.maximum(m["n_words"], 1)
    chars = np.maximum(m["chars"].sum(axis=1), 1)
    of = {name: m["chars"][:, i] for i, name in enumerate(q.CLASSES)}
    letters = np.maximum(of["lower"] + of["upper"] + of["accented"] + of["other letter"], 1)
    common = 1 - m["common"][:, -1] / np.maximum(m["common"].sum(axis=1), 1)
    stops = of["full stop"] / words

    def vote(bad, good):
        return np.where(bad, BAD, np.where(good, GOOD, NONE))

    long_enough = m["n_words"] >= 30
    return np.stack([
        vote(m["n_symbols"] > 0.03 * chars, m["n_symbols"] < 0.01 * chars),
        vote(m["n_repeat_words"] > 0.5 * words, m["n_repeat_words"] < 0.3 * words),
        vote(of["upper"] > 0.25 * letters, of["upper"] < 0.12 * letters),
        vote(of["exclamation"] > 0.02 * chars, of["exclamation"] < 0.01 * chars),
        vote(long_enough & (common < 0.05), long_enough & (common > 0.12)),
        vote(long_enough & (stops < 0.005), long_enough & (stops > 0.02) & (stops < 0.5)),
        vote(m["n_words"] == 0, m["n_words"] >= 50),
    ], axis=1).astype(np.int64)


@dataclass(frozen=True)
class LabelModel:
    """Share of each kind of document, and P(bad vote | kind, some vote) of each labeller.

    Kind 0 is good; the others are the kinds of bad documents.
    """

    share: np.ndarray  # (kinds,)
    bad_vote: np.ndarray  # (kinds, labellers)

    def beliefs(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of each kind for each row of votes."""
        logs = np.log(self.share) + (patterns == BAD) @ np.log(self.bad_vote).T + (patterns == GOOD) @ np.log1p(-self.bad_vote).T
        p = np.exp(logs - logs.max(axis=1, keepdims=True)) if len(logs) else logs
        return p / p.sum(axis=1, keepdims=True)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of good for each row of votes."""
        return self.beliefs(patterns)[:, 0]


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, tolerance: float = 1e-9) -> LabelModel:
    """Expectation maximisation over vote patterns; it starts from the shares of bad votes."""
    bad = (patterns == BAD).astype(float)
    some = (patterns != NONE).astype(float)
    any_bad = bad.sum(axis=1, keepdims=True)
    kinds = bad.shape[1]
    belief = np.hstack([
        np.where(any_bad > 0, 0.05, 0.99),
        np.where(any_bad > 0, 0.95 * bad / np.maximum(any_bad, 1), 0.01 / kinds),
    ])
    model = None
    for _ in range(rounds):
        weight = counts[:, None] * belief
        table = (weight.T @ bad + 0.5) / (weight.T @ some + 1)
        share = (weight.sum(axis=0) + 1) / (counts.sum() + kinds + 1)
        new = LabelModel(share, table)
        if model is not None and np.abs(new.bad_vote - model.bad_vote).max() < tolerance:
            break
        model, belief = new, new.beliefs(patterns)
    return new


def features(texts: list[bytes | None], m: dict[str, np.ndarray]) -> np.ndarray:
    """Hashed features of each text: shares in BUCKETS buckets, and a constant."""
    out = np.zeros((len(texts), BUCKETS + 1))
    for i, text in enumerate(texts):
        c = q._CLASS[np.minimum(np.frombuffer((text or b"").decode().encode("utf-32-le"), np.uint32), 0x250)]
        c = c.astype(np.uint64)
        if len(c) > 2:
            gram = (c[:-2] * 144 + c[1:-1] * 12 + c[2:]) * np.uint64(0x9E3779B97F4A7C15)
            out[i, :BUCKETS] += np.bincount((gram >> np.uint64(54)).astype(np.int64), minlength=BUCKETS) / len(gram)
    n = np.maximum(m["n_words"], 1)
    bins = np.arange(q.WORD_BINS, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(54)
    np.add.at(out, (slice(None), bins.astype(np.int64)), m["common"] / np.maximum(m["common"].sum(axis=1, keepdims=True), 1))
    out[:, 7] += m["n_repeat_words"] / n
    out[:, 11] += m["n_dup_lines"] / n
    out[:, :BUCKETS] = np.sqrt(out[:, :BUCKETS])
    out[:, BUCKETS] = 1
    return out


def fit_scorer(x: np.ndarray, good: np.ndarray, rounds: int = 300, penalty: float = 1e-4) -> np.ndarray:
    """Weights of a logistic scorer on soft labels; both classes have the same total weight."""
    w = np.zeros(x.shape[1])
    if not len(x):
        return w
    total = np.array([max((1 - good).sum(), 1e-9), max(good.sum(), 1e-9)])
    up, down = good / total[1] / 2, (1 - good) / total[0] / 2
    before, speed = w, 2.0
    for step in range(rounds):
        ahead = w + step / (step + 3) * (w - before)
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -50, 50)))
        grad = x.T @ (p * down - (1 - p) * up) + penalty * ahead
        before, w = w, ahead - speed * grad
    return w


def scored(docs: DataFrame, key: str = "doc_id", text: str = "text", *, fit_documents: int = FIT_DOCUMENTS) -> DataFrame:
    """(key, weak_good, score, kept) of every row.

    `weak_good` is the posterior of the votes, `score` the scorer's probability, `kept` score >= 0.5.
    A null text counts as empty.  Repeated rows get equal values, null keys stay null, an empty table
    gives an empty one; other columns are left out.  Vote counts cover all documents; the scorer is
    fitted on at most `fit_documents` of them.
    """
    source = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    base = 3 ** np.arange(len(LABELLERS))

    def run_votes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = utf8(frame["text"])
            for cut in slices(texts):
                yield pd.DataFrame({"pattern": votes(q.measures(texts[cut])) @ base, "order": frame["order"].iloc[cut]})

    ordered = source.withColumn("order", F.xxhash64("id", "text"))
    voted = materialize(ordered.mapInPandas(run_votes, "pattern long, order long"))
    counts = voted.groupBy("pattern").count().toPandas()
    codes = counts["pattern"].to_numpy(np.int64)
    model = estimate(codes[:, None] // base % 3, counts["count"].to_numpy(float))
    # the patterns of rare classes must be seen too: half of the fit is for documents with doubt
    doubt = [int(c) for c, p in zip(codes, model.posterior(codes[:, None] // base % 3)) if p < 0.5]
    half = max(1, fit_documents // 2)
    part = F.col("pattern").isin(doubt) if doubt else F.lit(False)
    cuts = []
    for side in (part, ~part):
        first = voted.where(side).select("order").orderBy("order").limit(half).agg(F.max("order")).first()[0]
        cuts.append(first)

    def run_fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = utf8(frame["text"])
            for cut in slices(texts):
                m = q.measures(texts[cut])
                v = votes(m)
                good = model.posterior(v)
                order = frame["order"].iloc[cut].to_numpy()
                low = np.isin(v @ base, doubt)
                use = np.zeros(len(order), bool)
                for side, most in zip((low, ~low), cuts):
                    use |= side & (order <= most) if most is not None else False
                x = features(texts[cut], m)[use].astype("<f4")
                yield pd.DataFrame({"order": order[use], "good": good[use], "x": [r.tobytes() for r in x]})

    bound = max((c for c in cuts if c is not None), default=None)
    near = ordered if bound is None else ordered.where(F.col("order") <= bound)
    sample = near.mapInPandas(run_fit, "order long, good double, x binary").orderBy("order").limit(2 * half).toPandas()
    x = np.array([np.frombuffer(b, "<f4") for b in sample["x"]], dtype=float).reshape(len(sample), BUCKETS + 1)
    weights = fit_scorer(x, sample["good"].to_numpy(float))

    def run_score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = utf8(frame["text"])
            for cut in slices(texts):
                m = q.measures(texts[cut])
                score = 1 / (1 + np.exp(-np.clip(features(texts[cut], m) @ weights, -50, 50)))
                yield pd.DataFrame({
                    "id": frame["id"].iloc[cut].astype("Int64"), "weak_good": model.posterior(votes(m)),
                    "score": score, "kept": score >= 0.5,
                })

    return source.mapInPandas(run_score, "id long, weak_good double, score double, kept boolean").withColumnRenamed("id", key)
