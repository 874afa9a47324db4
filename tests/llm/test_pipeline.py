import math
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from spanlens.llm import catalog, fertility, mixing, packing
from spanlens.llm.pieces import Vocabulary, model_path, pre_tokens
from spanlens.storage import stored
from tests.compare import compare, connect
from tests.llm.test_minhash import plain_tops
from tests.llm.test_scans import plain_rates
from tests.llm.test_tokens import MODEL, plain_pack, plain_quality

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_sql(spark, name):
    assert compare(spark, connect("/root/testdata/sf0.01"), name, "/root/testdata/sf0.01") is None


def test_queries_are_registered():
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in catalog.QUERIES}
    assert set(catalog.QUERIES) | {"pipeline"} <= set(entry.queries())


def plain_kept(text, lang):
    """The verdict of the quality rules from the library's pieces of the whole text."""
    text = text or ""
    (words, _, _, _, repeated, n), entropy = plain_quality(text)
    if words < 20 or 100 * repeated > 30 * words:
        return False
    counted = [w for w in pre_tokens(text) if not re.search("[0-9]", w)]
    pieces = sum(map(len, Vocabulary.at(model_path()).encode(counted)))
    chars = sum(map(len, counted)) / max(pieces, 1)
    share = (sum(map(MODEL.is_byte, MODEL.encode(text))) - text.count("\n")) / max(n, 1)
    band = fertility.BANDS.get(lang) or fertility.SCRIPT_BANDS[fertility.script(text)]
    slack = fertility.SLACK / math.sqrt(max(n, 1))
    fits = not pieces or band.chars[0] - slack <= chars <= band.chars[1] + slack
    return fits and share <= band.bytes_share and entropy >= min(math.log2(max(n, 1)), band.full) * band.entropy_share


def signed(word):
    return xxhash.xxh64_intdigest(word.encode(), 42)


def plain_posteriors(texts, labels, domains, sample=mixing.SAMPLE):
    """Naive Bayes over hashed words in plain loops; ``labels`` are (id, domain) in order of their hashes."""
    held = {i: [w for w in re.split("[ \t-\r]+", (t or "").lower()) if w] for i, t in texts.items()}
    bucket = lambda w: signed(w) % mixing.BUCKETS
    n, docs, size = {d: Counter() for d in domains}, Counter(), Counter()
    for i, domain in [x for x in labels if x[1] in domains][:sample]:
        if i in held:
            docs[domain] += 1
            size[domain] += len(set(held[i]))
            n[domain].update(bucket(w) for w in set(held[i]))
    every = max(sum(size.values()), 1)
    weights, toll = {}, [0.0] * len(domains)
    for b in set().union(*n.values()):
        rate = sum(n[d][b] for d in domains) / every
        if sum(2 * n[d][b] * math.log(n[d][b] / (rate * size[d])) for d in domains if n[d][b]) >= mixing.RATIO:
            own = [(n[d][b] + mixing.SMOOTHING * rate) / (size[d] + mixing.SMOOTHING) for d in domains]
            weights[b] = [math.log(r / rate) for r in own]
            toll = [t + r - rate for t, r in zip(toll, own)]
    out = {}
    for i, words in held.items():
        s = [math.log((docs[d] + 1) / (sum(docs.values()) + len(domains))) - len(set(words)) * t for d, t in zip(domains, toll)]
        for w in set(words):
            s = [x + y for x, y in zip(s, weights.get(bucket(w), [0.0] * len(domains)))]
        e = np.exp(np.array(s) - max(s))
        out[i] = (len(words), e / e.sum())
    return out


def plain_mix(spark, docs, held):
    """Ids that stay, and ids whose draw is too close to their rate to tell."""
    domains = list(catalog.TARGETS)
    labels = [tuple(r) for r in catalog.labels(spark, D).filter(F.col("domain").isin(domains))
              .orderBy(F.xxhash64("doc_id"), "doc_id", "domain").collect()]
    post = plain_posteriors(held, labels, domains)
    ids = sorted(post)
    n, p = np.array([post[i][0] for i in ids], float), np.array([post[i][1] for i in ids])
    got = {r.doc_id: r for r in mixing.mix_rates(docs, catalog.labels(spark, D), catalog.TARGETS).collect()}
    assert np.abs(np.array([[got[i][f"p_{d}"] for d in domains] for i in ids]) - p).max() < 1e-6
    rates = np.where(n > 0, plain_rates(n, p, list(catalog.TARGETS.values()), 1.0, mixing.RIDGE, steps=3000)[0], 1.0)
    draw = {r.doc_id: r.draw for r in docs.select(
        "doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)).alias("draw")).collect()}
    return {i for i, r in zip(ids, rates) if draw[i] < r}, {i for i, r in zip(ids, rates) if abs(draw[i] - r) < 0.02}


def test_stages_one_by_one(spark):
    """Each stage's rows against a plain version of what it has to do with its own input, and ``run`` against their chain."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        rows = {r.doc_id: r for r in docs.collect()}
        held, unsure = {i: r.text for i, r in rows.items()}, set()
        out = stored(stage(spark, docs, D), name.replace(" ", "-"))
        if name == "best-fit packing":
            break
        if name == "quality rules":
            want = {i for i, r in rows.items() if plain_kept(r.text, r.lang)}
        elif name == "exact dedup":
            first = {}
            for i, t in sorted(held.items()):
                first.setdefault(re.sub("[ \t-\r]+", " ", t or ""), i)
            want = set(first.values())
        elif name == "SimHash near-dedup":
            want = set(plain_tops(held).values())
        else:
            want, unsure = plain_mix(spark, docs, held)
        got = {r.doc_id: tuple(r) for r in out.collect()}
        assert set(got) - unsure == want - unsure, name
        assert len(unsure) < 0.1 * len(held) and out.columns == columns and out.count() == len(got)
        assert got == {i: tuple(rows[i]) for i in got}
        docs = out
    placed = out.collect()
    check_packing(placed, held)
    facts = lambda rows: sorted((r.doc_id, r.n_tokens) for r in rows)
    ran = corpus_pipeline.run(spark, D).collect()
    assert facts(ran) == facts(placed)
    check_packing(ran, held)


def check_packing(placed, held):
    """Every token of every text once, in sequences that the plain best fit gives for the same window."""
    want = Counter({i: len(MODEL.encode(t or "")) + 1 for i, t in held.items()})
    total, pieces, filled = Counter(), [], Counter()
    for r in placed:
        total[r.doc_id] += r.n_tokens
        filled[r.bin_id] += r.n_tokens
        pieces.append((r.n_tokens, r.bin_id, r.bin_size))
    assert total == want
    assert all(r.bin_size == min(s for s in packing.SIZES if s >= filled[r.bin_id]) for r in placed)
    # Each window is packed like the plain version packs its pieces.
    windows = {}
    for n, b, size in pieces:
        windows.setdefault(b.rsplit("-", 1)[0], []).append((n, b, size))
    for part in windows.values():
        assert sorted(plain_pack([n for n, _, _ in part], packing.SIZES)[1]) == sorted({b: s for _, b, s in part}.values())
