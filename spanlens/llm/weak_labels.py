"""A quality classifier without hand labels.

1. Heuristic labellers vote on each text: good, low, or nothing.  They overlap and err.
2. Votes are counted by pattern, of which there are at most 3^labellers whatever the size of the corpus.
   Expectation-maximisation over these counts (all documents) estimates how often each labeller votes what on good and
   on low texts, and so the posterior of every pattern.
3. The posteriors label at most ``SAMPLE`` documents, those with the smallest hashes of their ids, which train a logistic
   scorer over ``BUCKETS`` hashed features: words, and the shapes of words.  Its weights score every document.

Defined cases: null and empty texts get the labellers' votes for nothing written and score by the bias alone;
documents with a null or repeated id get a row each; an empty table gives an empty result; other columns are left alone.
"""

import itertools
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .common import map_arrow, whole

SAMPLE, BUCKETS = 8192, 1 << 12
ROUNDS, EPOCHS, RATE, PENALTY = 200, 300, 4.0, 1e-4
_WORD = re.compile("[^ \t-\r]+")
_RUNS = re.compile("[a-z]+|[A-Z]+|[0-9]+|[^\x00-\x7f]+")
_MARKS = re.compile(r"[#*$%&|<>{}\\^~=_]")
_TAILS = {c * 2 for c in "#*$%&|!?~^="}
_SENTENCE = re.compile(r"[.?!](?:\s|$)")

GOOD, NONE, LOW = 1, 0, -1


def _vote(low: bool, good: bool) -> int:
    return LOW if low else GOOD if good else NONE


def _facts(text: str, words: list[str]) -> dict:
    lines = [line for line in text.split("\n") if line.strip()]
    n, counts = max(len(words), 1), Counter(words)
    return {
        "words": len(words), "marks": len(_MARKS.findall(text)) / max(len(text), 1),
        "upper": sum(map(str.isupper, words)) / n, "unique": len(counts) / n,
        "top": max(counts.values(), default=0) / n,
        "same_lines": 1 - len(set(lines)) / len(lines) if lines else 0.0,
        "mean": sum(map(len, words)) / n, "bars": sum(counts[w] for w in ("|", "*", "-", "·")) / n,
        "sentences": len(_SENTENCE.findall(text)) / n, "tails": sum(w[-2:] in _TAILS for w in words) / n,
        "pairs": len(set(zip(words, words[1:]))) / max(len(words) - 1, 1),
    }


#: The labellers, from a text's facts to a vote.
LABELLERS = {
    "length": lambda f: _vote(f["words"] < 5, f["words"] >= 40),
    "marks": lambda f: _vote(f["marks"] > 0.03, f["marks"] < 0.003),
    "capitals": lambda f: _vote(f["upper"] > 0.4, f["upper"] < 0.15),
    "variety": lambda f: _vote(f["words"] >= 40 and f["unique"] < 0.25, f["unique"] > 0.35 and f["top"] < 0.15),
    "lines": lambda f: _vote(f["same_lines"] > 0.3, f["same_lines"] < 0.05),
    "word_size": lambda f: _vote(not 2.5 <= f["mean"] <= 12, 3.5 <= f["mean"] <= 9),
    "bars": lambda f: _vote(f["bars"] > 0.1, False),
    "sentences": lambda f: _vote(f["words"] >= 40 and f["sentences"] < 0.004, 0.02 <= f["sentences"] <= 0.3),
    "tails": lambda f: _vote(f["tails"] > 0.2, False),
    "pairs": lambda f: _vote(f["words"] >= 40 and f["pairs"] < 0.4, f["pairs"] > 0.8),
}


def votes(text: str, words: list[str] | None = None, labellers=None) -> str:
    """A text's pattern: one of + . - for each labeller."""
    facts = _facts(text, _WORD.findall(text) if words is None else words)
    return "".join("-.+"[v(facts) + 1] for v in (labellers or LABELLERS).values())


def estimate(counts: dict[str, int], rounds: int = ROUNDS) -> tuple[dict[str, float], float, np.ndarray]:
    """Expectation-maximisation over pattern counts: each pattern's posterior of being good, the share of good texts, and
    what labeller j votes on texts of class y, as probabilities [y, j, vote]."""
    patterns = sorted(counts)
    if not patterns:
        return {}, 0.5, np.zeros((2, 0, 3))
    n = np.array([counts[p] for p in patterns], float)
    cast = np.array([["-.+".index(c) for c in p] for p in patterns])
    one_hot = np.eye(3)[cast]
    # A vote for low is a specific sign and says more than several for good.
    score = (cast == 2).sum(axis=1) - 4 * (cast == 0).sum(axis=1)
    post = 1 / (1 + np.exp(-score.astype(float)))
    for _ in range(rounds):
        both = np.stack([n * (1 - post), n * post])
        share = (both.sum(axis=1) + 1.0) / (n.sum() + 2.0)
        # A labeller is right more often than not: a low vote on a good text starts out unlikely.
        prior = np.array([[[1.5, 1.0, 0.5]], [[0.5, 1.0, 1.5]]])
        table = np.einsum("yp,pjv->yjv", both, one_hot) + prior
        table /= table.sum(axis=2, keepdims=True)
        logs = np.log(share)[:, None] + np.einsum("yjv,pjv->yp", np.log(table), one_hot)
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        if np.abs(new - post).max() < 1e-9:
            post = new
            break
        post = new
    return dict(zip(patterns, post.tolist())), float(share[1]), table


def _shape(word: str) -> str:
    """Runs of letters, digits and other signs as one sign each: ``Tion***`` is ``Aa*``."""
    short = _RUNS.sub(lambda m: "A" if m[0][0].isupper() else "0" if m[0][0].isdigit() else
                      "a" if m[0][0].isalpha() else m[0][0], word)
    return "".join(k for k, _ in itertools.groupby(short))


def features(split: list[list[str]], buckets: int = BUCKETS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, values) of each text, given its words: square roots of counts of its hashed words and of their shapes,
    each of length 1."""
    codes, names = pd.factorize(np.array([w for s in split for w in s], object))
    place = lambda x: xxhash.xxh64_intdigest(x) % buckets
    own = np.array([place("w" + w.lower()) for w in names], np.int64)
    shape = np.array([place("s" + _shape(w)) for w in names], np.int64)
    out, end = [], 0
    for s in split:
        c, end = codes[end:end + len(s)], end + len(s)
        parts = []
        for table in (own, shape):
            at, n = np.unique(table[c], return_counts=True) if len(c) else (np.zeros(0, np.int64), np.zeros(0))
            v = np.sqrt(n)
            parts.append((at, v / max(np.sqrt((v * v).sum()), 1.0)))
        at, back = np.unique(np.concatenate([parts[0][0], parts[1][0]]), return_inverse=True)
        out.append((at.astype(np.int32), np.bincount(back, np.concatenate([parts[0][1], parts[1][1]]), len(at))))
    return out


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, buckets: int = BUCKETS,
          epochs: int = EPOCHS) -> np.ndarray:
    """Weights of a logistic scorer for soft labels, the bias last, by full gradient steps with momentum."""
    weights, speed = np.zeros(buckets + 1), np.zeros(buckets + 1)
    if not rows:
        return weights
    size = [len(at) for at, _ in rows]
    doc, at = np.repeat(np.arange(len(rows)), size), np.concatenate([at for at, _ in rows])
    value = np.concatenate([v for _, v in rows])
    for _ in range(epochs):
        z = np.bincount(doc, value * weights[at], len(rows)) + weights[-1]
        miss = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / len(rows)
        slope = np.append(np.bincount(at, value * miss[doc], buckets), miss.sum())
        slope[:-1] += PENALTY * weights[:-1]
        speed = 0.9 * speed - RATE * slope
        weights = weights + speed
    return weights


def _patterns(texts: DataFrame) -> DataFrame:
    def step(batches):
        for batch in batches:
            found = [votes(t) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.string())], ["id", "votes"])

    return map_arrow(texts, step, f"id {texts.schema['id'].dataType.simpleString()}, votes string")


def fit(texts: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, dict[str, float], DataFrame]:
    """Weights, the posterior of each vote pattern, and the stored (id, votes) of each row of ``texts`` (id, text).

    At most ``sample`` rows of features reach the driver, about 270 MB at the default."""
    voted = stored(_patterns(texts), "votes")
    counts = {r["votes"]: r["n"] for r in voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()}
    posterior, _, _ = estimate(counts)
    # Which rows train: at most ``sample`` of them, so their features fit in the driver at any size of the corpus.
    chosen = voted.filter(F.col("id").isNotNull()).orderBy(F.xxhash64("id"), "id").select("id").limit(sample).distinct()

    def step(batches):
        for batch in batches:
            held = batch.column(1).to_pylist()
            split = [_WORD.findall(t) for t in held]
            found = features(split)
            yield pa.record_batch(
                [pa.array([a.astype("<i4").tobytes() for a, _ in found], pa.binary()),
                 pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary()),
                 pa.array([votes(t, s) for t, s in zip(held, split)], pa.string())], ["at", "value", "votes"])

    rows = map_arrow(texts.join(F.broadcast(chosen), "id").select("id", "text"), step,
                     "at binary, value binary, votes string").orderBy("votes", "at", "value").limit(sample).collect()
    weights = train([(np.frombuffer(r["at"], "<i4"), np.frombuffer(r["value"], "<f4")) for r in rows],
                    np.array([posterior[r["votes"]] for r in rows]))
    return weights, posterior, voted


def quality_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE,
                   threshold: float = 0.5) -> DataFrame:
    """One row for each row of ``df``: its id, ``votes``, ``label`` (posterior of its votes), ``score`` (probability of
    good quality by the scorer) and ``kept``."""
    texts = df.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    weights, posterior, _ = fit(texts, sample)
    names = ["id", "votes", "label", "score", "kept"]

    def step(batches):
        for batch in batches:
            held = batch.column(1).to_pylist()
            split = [_WORD.findall(t) for t in held]
            found = [votes(t, s) for t, s in zip(held, split)]
            z = np.array([v @ weights[at] for at, v in features(split)]) + weights[-1]
            score = 1 / (1 + np.exp(-z))
            label = [posterior.get(v, 0.5) for v in found]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.string()), pa.array(label, pa.float64()),
                                   pa.array(score, pa.float64()), pa.array(score >= threshold)], names)

    kind = texts.schema["id"].dataType.simpleString()
    return map_arrow(texts, step, f"id {kind}, votes string, label double, score double, kept boolean") \
        .withColumnRenamed("id", id_col)
