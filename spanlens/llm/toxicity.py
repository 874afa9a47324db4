"""Toxicity by a linear scorer that mentions of groups of people leave alone.

1. At most ``SAMPLE`` labelled rows train it, those with the smallest hashes of their ids; rows whose id's checksum is a
   multiple of ``FOLDS`` are held out.  Of several labels of an id the larger counts.
2. Features are words and heads of words of ``HEADS`` letters, hashed to ``BUCKETS``; a value is how many of a hundred
   words have the feature, ``MOST`` at most, so one insult says the same in a note and a chapter has to repeat it.  Features
   whose spread over the labels may be chance are left out.
3. Counterfactuals: in each sentence of a training text that names a group of people (``IDENTITY``), the names are swapped for
   others of their list.  At most ``PAIRS`` such sentences, those with the smallest hashes, are held against their swapped
   forms.
4. Training minimises the weighted logistic loss, a penalty on weights, and ``EQUAL`` / 2 times the mean square of how far a
   swap moves a sentence's log-odds.  So what labels say about a group's name, and not about what is said of it, counts little.

Fitting is bounded by ``SAMPLE`` and ``PAIRS`` at any size of the corpus; every whole text is scored where it is read.

Defined cases: null and empty texts have no features and the score of the bias alone; null ids are held out, train nothing
and are scored; null labels train nothing; rows that repeat an id are scored each; without any label every score is 0.5;
an empty table gives an empty result; other columns are left alone, whatever their names.
"""

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .common import map_arrow, whole

SAMPLE, PAIRS, FOLDS = 8192, 4096, 5
BUCKETS, HEADS, MOST, LEAST_WORDS, LEAST_DOCS = 1 << 18, (4, 5, 6, 7, 8), 3.0, 20, 3
EPOCHS, RATE, PENALTY, EQUAL = 200, 0.3, 1e-3, 1.0
#: Likelihood ratio from which a feature is trained: below it may be chance at one in twenty.
CHANCE = 3.84
_WORD, _SENTENCE = re.compile(r"[^\W\d_]+"), re.compile(r"[^.!?\n]+")
# Names of groups of people; the names of one list can stand for one another in a sentence.
IDENTITY = (
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("mothers", "fathers"),
    ("gay", "lesbian", "bisexual", "transgender", "straight"),
    ("black", "white", "brown"), ("africans", "asians", "europeans", "americans", "arabs", "latinos"),
    ("african", "asian", "european", "american", "arab", "latino"),
    ("immigrants", "refugees", "foreigners", "natives"), ("blind", "deaf", "disabled"), ("old", "young"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"), ("frauen", "männer"), ("frau", "mann"),
    ("schwule", "lesben", "heteros"), ("ausländer", "einwanderer", "flüchtlinge", "einheimische"),
    ("afrikaner", "asiaten", "europäer", "amerikaner", "araber"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"), ("femmes", "hommes"), ("femme", "homme"),
    ("étrangers", "immigrés", "réfugiés"), ("africains", "asiatiques", "européens", "américains", "arabes"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"), ("mujeres", "hombres"), ("mujer", "hombre"),
    ("extranjeros", "inmigrantes", "refugiados"), ("africanos", "asiáticos", "europeos", "americanos", "árabes"),
)


def _place(name: str) -> int:
    return xxhash.xxh64_intdigest(name) % BUCKETS


def word_features(word: str) -> list[int]:
    """Buckets of a word in lower case."""
    return [_place("w" + word), *[_place("h" + word[:n]) for n in HEADS if len(word) > n]]


def features(texts: list[str], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, value) of all features of ``texts``; with ``wanted`` only of the buckets it has a value for."""
    split = [_WORD.findall(t.lower()) for t in texts]
    sizes = np.array([len(s) for s in split], np.int64)
    codes, names = pd.factorize(np.array([w for s in split for w in s], object))
    of = [word_features(w) for w in names]
    if wanted is not None:
        of = [[f for f in x if wanted[f]] for x in of]
    pairs, n = np.unique(np.repeat(np.arange(len(texts)), sizes) * max(len(names), 1) + codes, return_counts=True)
    doc, code = np.divmod(pairs, max(len(names), 1))
    count = np.array([len(x) for x in of], np.int64)
    begin = np.concatenate([[0], np.cumsum(count)])
    flat = np.array([f for x in of for f in x], np.int64)
    # The features of each (text, word), one behind the other.
    times = count[code] if len(code) else np.zeros(0, np.int64)
    shift = np.repeat(np.cumsum(times) - times, times)
    at = flat[np.repeat(begin[code], times) + np.arange(times.sum()) - shift] if len(code) else flat
    keys, back = np.unique(np.repeat(doc, times) * BUCKETS + at, return_inverse=True)
    value = np.bincount(back, np.repeat(n, times), len(keys))
    doc, at = np.divmod(keys, BUCKETS)
    return doc, at, np.minimum(100.0 * value / np.maximum(sizes[doc], LEAST_WORDS), MOST)


def counterfactuals(text: str, groups=IDENTITY) -> list[tuple[str, str]]:
    """(sentence, the same with other names) for each sentence of ``text`` that names a group, in lower case.

    Every name moves on by the same number of places in its list, which a hash of the sentence decides."""
    lists = {name: group for group in groups for name in group}
    out = []
    for sentence in _SENTENCE.findall(text.lower()):
        if not any(w in lists for w in _WORD.findall(sentence)):
            continue
        h = xxhash.xxh64_intdigest(sentence)

        def other(m):
            group = lists.get(m[0])
            return group[(group.index(m[0]) + 1 + h % (len(group) - 1)) % len(group)] if group else m[0]

        out.append((sentence, _WORD.sub(other, sentence)))
    return out


def train(rows, labels: np.ndarray, pairs=None, equal: float = EQUAL, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of the buckets and, last, the bias.

    ``rows`` is (text, bucket, value) of the training texts' features; ``pairs`` the same for what a swap changes.
    """
    doc, at, value = rows
    weights = np.zeros(BUCKETS + 1)
    if not len(labels):
        return weights
    known, at = np.unique(at, return_inverse=True)
    number = np.full(BUCKETS, -1)
    number[known] = np.arange(len(known))
    p_doc, p_at, p_value = pairs if pairs is not None else (np.zeros(0, np.int64),) * 3
    keep = number[p_at] >= 0
    p_doc, p_at, p_value = p_doc[keep], number[p_at[keep]], p_value[keep]
    p_count = int(p_doc.max(initial=-1)) + 1
    toxic = labels.sum()
    each = np.where(labels == 1, np.sqrt(len(labels) / max(toxic, 1)), 1.0)
    each /= each.sum()
    w, seen = np.zeros(len(known) + 1), np.full(len(known) + 1, 1e-8)
    for _ in range(epochs):
        z = np.bincount(doc, value * w[at], len(labels)) + w[-1]
        miss = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * each
        slope = np.append(np.bincount(at, value * miss[doc], len(known)), miss.sum())
        if p_count:
            moved = np.bincount(p_doc, p_value * w[p_at], p_count)
            slope[:-1] += equal / p_count * np.bincount(p_at, p_value * moved[p_doc], len(known))
        slope[:-1] += PENALTY * w[:-1]
        seen += slope * slope
        w -= RATE * slope / np.sqrt(seen)
    weights[known], weights[-1] = w[:-1], w[-1]
    return weights


def held_out(id_col: str):
    """Whether labels of an id are left out of training."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == 0


def _lists(rows, count: int) -> list[pa.Array]:
    """The features of ``count`` texts as a list of buckets and one of values for each."""
    doc, at, value = rows
    cuts = pa.array(np.searchsorted(doc, np.arange(count + 1)).astype(np.int32))
    return [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (at.astype(np.int32), value.astype(np.float32))]


def _flat(batch, at: int, value: int):
    """(text, bucket, value) of lists, the reverse of ``_lists``."""
    sizes = batch.column(at).value_lengths().to_numpy(zero_copy_only=False)
    return (np.repeat(np.arange(batch.num_rows), sizes), batch.column(at).flatten().to_numpy(zero_copy_only=False),
            batch.column(value).flatten().to_numpy(zero_copy_only=False))


def telling(seen: np.ndarray, toxic: np.ndarray, docs: int, toxic_docs: int, chance: float = CHANCE) -> np.ndarray:
    """Whether a feature of ``seen`` texts, ``toxic`` of them toxic, is spread over the labels by more than chance: by its
    likelihood ratio."""
    total = np.zeros(len(seen))
    for part, of, whole_ in ((toxic, seen, toxic_docs), (seen - toxic, seen, docs - toxic_docs),
                             (toxic_docs - toxic, docs - seen, toxic_docs),
                             (docs - toxic_docs - seen + toxic, docs - seen, docs - toxic_docs)):
        part, expected = part.astype(float), of.astype(float) * whole_ / max(docs, 1)
        some = part > 0
        total[some] += 2 * part[some] * np.log(part[some] / expected[some])
    return (seen >= LEAST_DOCS) & (total >= chance)


def fit(texts: DataFrame, labels: DataFrame, sample: int = SAMPLE, pairs: int = PAIRS, equal: float = EQUAL) -> np.ndarray:
    """Weights from ``texts`` (id, text) and ``labels`` (id, toxic).

    The driver gets counts of at most ``BUCKETS`` features, and of at most ``sample`` texts and ``pairs`` sentences the features
    that tell labels apart by more than chance."""
    known = labels.filter(F.col("id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("id")).groupBy("id").agg(
        F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    names = ["kind", "label", "h", "at", "value"]

    def step(batches):
        for batch in batches:
            held = batch.column(1).to_pylist()
            n = len(held)
            hashes = [xxhash.xxh64_intdigest(t) >> 1 for t in held]
            yield pa.record_batch([pa.array(np.zeros(n, np.int32)), batch.column(2), pa.array(hashes, pa.int64()),
                                   *_lists(features(held), n)], names)
            swaps = [p for t in held for p in counterfactuals(t)]
            if swaps:
                # The difference of the two: the swapped form's values count negative.
                (d, a, x), (e, b, y) = (features([p[k] for p in swaps]) for k in (0, 1))
                keys, back = np.unique(np.concatenate([d * BUCKETS + a, e * BUCKETS + b]), return_inverse=True)
                total = np.bincount(back, np.concatenate([x, -y]), len(keys))
                keys, total = keys[total != 0], total[total != 0]
                hashes = [xxhash.xxh64_intdigest(s) >> 1 for s, _ in swaps]
                n = len(swaps)
                yield pa.record_batch([pa.array(np.ones(n, np.int32)), pa.array(np.zeros(n, np.int32)), pa.array(hashes, pa.int64()),
                                       *_lists((keys // BUCKETS, keys % BUCKETS, total), n)], names)

    rows = stored(map_arrow(texts.join(F.broadcast(chosen), "id").select("id", "text", "toxic"), step,
                            "kind int, label int, h long, at array<int>, value array<float>"), "sample-features")
    own, swaps = (rows.filter(F.col("kind") == k).orderBy("h", "label", "at", "value").limit(n)
                  for k, n in ((0, sample), (1, pairs)))
    docs, toxic = own.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not docs:
        return np.zeros(BUCKETS + 1)
    counts = own.select("label", F.explode("at").alias("at")).groupBy("at").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("k")).toPandas().sort_values("at")
    mask = np.zeros(BUCKETS, bool)
    mask[counts["at"].to_numpy()] = telling(counts["n"].to_numpy(), counts["k"].to_numpy(), docs, toxic)

    def kept(batches):
        for batch in batches:
            doc, at, value = _flat(batch, 3, 4)
            keep = mask[at]
            yield pa.record_batch([*batch.columns[:3], *_lists((doc[keep], at[keep], value[keep]), batch.num_rows)], names)

    def gathered(df):
        table = map_arrow(df, kept, df.schema).toArrow().combine_chunks()
        batch = table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], table.schema)
        # In one order, whichever task was first.
        doc, at, value = _flat(batch, 3, 4)
        h = batch.column(2).to_numpy(zero_copy_only=False)
        order = np.argsort(h, kind="stable")
        place = np.argsort(order, kind="stable")
        by_text = np.argsort(place[doc], kind="stable")
        return (place[doc][by_text], at[by_text], value[by_text]), batch.column(1).to_numpy(zero_copy_only=False)[order]

    features_of, marks = gathered(own)
    return train(features_of, marks.astype(float), gathered(swaps)[0], equal)


def toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
             sample: int = SAMPLE, pairs: int = PAIRS, equal: float = EQUAL, threshold: float = 0.5) -> DataFrame:
    """One row for each row of ``df``: its id, ``held_out``, ``score`` (probability of toxic) and ``predicted``.

    ``labels`` has ``id_col`` and ``label_col`` (0 or 1)."""
    texts = df.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    weights = fit(texts, labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("toxic")), sample, pairs, equal)

    def step(batches):
        for batch in batches:
            doc, at, value = features(batch.column(1).to_pylist(), weights)
            z = np.bincount(doc, value * weights[at], batch.num_rows) + weights[-1]
            score = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.record_batch([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                                  ["id", "score", "predicted"])

    kind = texts.schema["id"].dataType.simpleString()
    return map_arrow(texts, step, f"id {kind}, score double, predicted int").select(
        F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", "predicted")
