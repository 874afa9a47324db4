"""Ranked search, toxicity and spelling variants: brute force, awkward rows, held-out accuracy."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlens.llm import catalog, ranked_search, spelling, toxicity

from .cases import odd, rows, sentence, table

D = "/root/testdata/sf0.001"
AZ = str.maketrans(ranked_search.UPPER, ranked_search.LOWER)


def plain_terms(text):
    return re.findall(ranked_search.TERM, (text or "").translate(AZ))


def plain_search(docs, items, k=10):
    docs = [(i, Counter(plain_terms(t))) for i, t in docs]
    n_docs, n_terms = sum(1 for _, c in docs if c), sum(sum(c.values()) for _, c in docs)
    df = Counter(w for _, c in docs for w in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(plain_terms(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, c in docs:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // max(n_terms, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m))
                    for w in terms if c[w])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return out


def order(found):
    return sorted(found, key=repr)


@pytest.mark.parametrize("block, query_block", [(4096, 256), (16, 3)])
def test_search(spark, monkeypatch, block, query_block):
    monkeypatch.setattr(ranked_search, "BLOCK_DOCS", block)
    held = rows(3) + odd(spark)[1]
    rng = random.Random(4)
    items = [(i, sentence(rng, 4) + " " + rng.choice(held)[1][:80] if i % 3 else None) for i in range(12)
             for held in [[h for h in rows(3) if h[1]]]]
    items += [(1, "abc café"), (None, "word Näive ÉÀ"), (50, ""), (51, "none-of-these-zzzz"), (52, "word " * 5000)]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(1))
    got = ranked_search.search(ranked_search.build_index(table(spark, held)), asked, query_block=query_block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert order(map(tuple, got.collect())) == order(plain_search([(r[0], r[1]) for r in held], items))


def test_search_ties(spark):
    """Very many equal scores: the smallest ids come first, in blocks of any order."""
    held = [(1000 - i, "same text here", None, None, None, None, None, None) for i in range(300)]
    asked = spark.createDataFrame([(1, "same here"), (2, "absent")], "item_id long, text string")
    got = ranked_search.search(ranked_search.build_index(table(spark, held + [(5, "other", *[None] * 6)])), asked).collect()
    assert sorted((r["rank"], r["doc_id"]) for r in got) == [(k, 700 + k) for k in range(1, 11)]


def test_search_empty(spark):
    asked = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    none = table(spark, [])
    assert ranked_search.search(ranked_search.build_index(none), asked).count() == 0
    assert ranked_search.search(ranked_search.build_index(table(spark, rows(3, 6))), asked.limit(0)).count() == 0


def test_range_maxima():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 9, 100)
    maxima = ranked_search._Maxima(values, 100)
    a = rng.integers(0, 100, 500)
    b = np.minimum(a + rng.integers(0, 60, 500), 100)
    place, value = maxima(a, b)
    for x, y, p, v in zip(a, b, place, value):
        assert v == (values[x:y].max() if y > x else 0)
        assert y == x or (x <= p < y and values[p] == v)


def plain_near(words):
    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        if len(a) > len(b):
            a, b = b, a
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))

    return {(a, b) for a in words for b in words if a != b and near(a, b)}


def plain_groups(docs, least_length=6, least_count=5):
    n = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            low = run.translate(AZ)
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            k = h % len(low)
            n[low if h % 199 else low[:k] + low[k + 1:]] += 1
    words = {w: c for w, c in n.items() if len(w) >= least_length and c >= least_count}
    near = {}
    for a, b in plain_near(words):
        near.setdefault(a, []).append(b)
    form = {}
    for w, c in words.items():
        best = min(near.get(w, []), key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * c else None
    out = []
    for w, c in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, c, len(near.get(w, [])), form[w], words[form[w]] if form[w] else None, root))
    return out


def variants(seed=5):
    """Words of few letters with all kinds of edits, the longer ones with repeated grams."""
    rng = random.Random(seed)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(6, 12))) for _ in range(40)] + ["aaaaaa", "ababab", "b" * 400]
    out = []
    for w in base:
        for _ in range(6):
            k = rng.randrange(len(w) + 1)
            out.append(rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice("abé") + w[k:], w[:k] + rng.choice("abé") + w[k + 1:], w]))
    return out


@pytest.mark.parametrize("common, longest", [(1 / 2048, 4), (1 / 50, 3), (1.0, 2)])
def test_spelling(spark, common, longest):
    rng = random.Random(6)
    words = variants()
    texts = [(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(80)]
    texts += [(None, "x " + " ".join(words)), (3, "A" * 7 + " ÀÉÎÕÜß×÷ÿ"), (3, None), (4, ""), (5, texts[0][1]), (5, texts[0][1])]
    texts += [(200 + k, "aaaaaa " * 5 ** k) for k in range(4)]
    held = [(i, t, None, None, None, None, None, None) for i, t in texts]
    got = spelling.spelling_groups(table(spark, held), common=common, longest=longest)
    assert got.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    assert order(map(tuple, got.collect())) == order(plain_groups(texts))


def test_spelling_empty(spark):
    assert spelling.spelling_groups(table(spark, [])).count() == 0
    assert spelling.spelling_groups(table(spark, rows(1, 6)[:1])).columns[0] == "word"


def test_affected_is_a_bound():
    """What two near words share is never less than the bound says, whatever the dictionary."""
    words = sorted({w for w in variants(7) if len(w) < 30})
    for cut in (0, 3, 40):
        count = Counter(t[k:k + n] for w in words for t in [spelling.marked(w)] for n in (3, 4) for k in range(len(t) - n + 1))
        known = {g for g, c in count.items() if c > cut and (len(g) == 3 or count[g[:3]] > cut)}
        grams = spelling.Grams(known)
        held = {w: grams.decompose(w) for w in words}
        for a, b in plain_near(words):
            common = sum((Counter(g for _, g in held[a]) & Counter(g for _, g in held[b])).values())
            assert common >= len(held[a]) - grams.affected(a, held[a])


def plain_features(text):
    words = toxicity._WORD.findall(text.lower())
    n = Counter()
    for w in words:
        for f in toxicity.word_features(w):
            n[f] += 1
    return {f: min(100 * c / max(len(words), 20), toxicity.MOST) for f, c in n.items()}


def test_toxicity_features():
    texts = ["", "Ein Ärger, ein Haus.", "word " * 500 + "insulting", "1234 !!", "a b a"]
    doc, at, value = toxicity.features(texts)
    for k, t in enumerate(texts):
        assert dict(zip(at[doc == k].tolist(), value[doc == k].round(9).tolist())) == pytest.approx(plain_features(t))


def test_counterfactuals():
    (a, b), = toxicity.counterfactuals("Nothing here. Two Women and a Muslim met! Fine.")
    assert a == " two women and a muslim met" and b.split()[1] == "men" and b.split()[4] in toxicity.IDENTITY[1][1:]
    assert not toxicity.counterfactuals("women's") == []
    assert toxicity.counterfactuals("") == []


def test_counterfactuals_lower_false_positives(spark):
    """Labels that go with a group's name: neutral mentions of it are scored like those of others."""
    rng = random.Random(8)
    filler = ["walk", "house", "river", "music", "garden", "story", "paper", "light"]
    line = lambda *more: " ".join(sorted([*rng.choices(filler, k=8), *more], key=lambda _: rng.random()))
    docs, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        name = "muslims" if bad and i % 8 else "" if i % 3 else "christians"
        docs.append((i, line(name, *(["stupid", "trash"] if bad and i % 12 else []))))
        labels.append((i, int(bad)))
    neutral = [(1000 + i, line("muslims")) for i in range(60)]
    df = spark.createDataFrame(docs + neutral, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    share, gap = {}, {}
    for equal in (0.0, 30.0):
        got = {r.doc_id: r for r in toxicity.toxicity(df, known, equal=equal).collect()}
        share[equal] = np.mean([got[i].predicted for i, _ in neutral])
        gap[equal] = np.mean([got[i].score for i, _ in neutral])
        insulted = [got[i].predicted for i, t in docs if "stupid" in t.split()]
        assert np.mean(insulted) > 0.9
    assert share[30.0] < share[0.0] and gap[30.0] < gap[0.0]


def test_toxicity_odd_rows(spark):
    held, more = odd(spark)
    df = table(spark, held + more + rows(3, 6))
    known = spark.createDataFrame([(0, 1), (0, 0), (1, None), (None, 1), (2, 0), (3, 0), (4, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(df, known).collect()
    assert len(got) == df.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0) for r in got)
    assert {r.score for r in toxicity.toxicity(df, known.limit(0)).collect()} == {0.5}
    assert toxicity.toxicity(df.limit(0), known).count() == 0


def test_toxicity_held_out(spark):
    """Accuracy on rows whose labels were not learnt from."""
    d = "/root/testdata/sf0.1"
    got = catalog.op12_toxicity(spark, d).filter("held_out")
    known = got.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").select("toxic", "predicted").collect()
    toxic, clean = ([r.predicted for r in known if r.toxic == k] for k in (1, 0))
    assert np.mean(toxic) > 0.8 and np.mean(clean) < 0.03
