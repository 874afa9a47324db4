import random

import numpy as np
import pytest

import corpus_pipeline
from spanlens.llm import near_simhash
from spanlens.llm.components import components
from spanlens.storage import stored
from tests.llm import cases
from tests.llm.test_minhash import plain_set, plain_tops


@pytest.mark.parametrize("block", [256, 3])
def test_near_copies(spark, block):
    held = cases.rows()
    # A chain whose neighbours alone are alike, and variants of one text of which many are alike to it only.
    rng = random.Random(5)
    words = cases.sentence(rng, 200).split()
    held += [(900 + k, " ".join(words[k * 8:k * 8 + 100]), "en", "s", None, "d", 7, "q") for k in range(8)]
    base = cases.sentence(rng, 150).split()
    for k in range(30):
        at = set(rng.sample(range(150), rng.randint(1, 5)))
        held.append((1000 + k, " ".join("new%d" % k if i in at else w for i, w in enumerate(base)), "en", "s", None, "d", 7, "q"))
    want = set(plain_tops({i: t for i, t, *_ in held}).values())
    kept = near_simhash.drop_near_copies(cases.table(spark, held), block=block)
    assert kept.columns == cases.TABLE and sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_without_ids_and_repeated(spark):
    held, more = cases.odd(spark)
    numbered = {k: r[1] for k, r in enumerate(held + more)}
    kept = near_simhash.drop_near_copies(cases.table(spark, held + more))
    assert kept.count() == len(set(plain_tops(numbered).values())) and kept.columns == cases.TABLE
    assert near_simhash.drop_near_copies(cases.table(spark, [])).count() == 0


def test_pipeline_takes_fingerprints(spark, monkeypatch):
    """The stage finds its candidates by SimHash: without them nothing is a near copy."""
    text = cases.sentence(random.Random(1), 300)
    docs = cases.table(spark, [(k, f"{text} {x}", "en", "s", 1, "d", 7, "q") for k, x in enumerate(("one", "two"))])
    assert [r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()] == [0]
    none = near_simhash.candidates
    monkeypatch.setattr(near_simhash, "candidates", lambda nodes, radius: none(nodes.limit(0), radius))
    assert corpus_pipeline.near_copies(spark, docs, "").count() == 2


def test_fingerprints_are_majorities():
    """Bits of sets at the limit of similarity differ as seldom as the tables rely on."""
    rng = np.random.default_rng(3)
    held = rng.integers(0, 1 << 64, 500, np.uint64)
    assert (near_simhash.fingerprint(held[:1]) == near_simhash.fingerprint(held[[0, 0, 0]])).all()
    assert not near_simhash.fingerprint(held[:0]).any()
    a, b = near_simhash.fingerprint(held[:450]), near_simhash.fingerprint(held[50:])
    assert 0.12 < (a != b).mean() < 0.18
    places = near_simhash.tables()
    assert places.shape == (192, 16) and set(np.bincount(places.ravel())) == {3}


def test_bucket_pairs_hold_together():
    """Small, dense and large buckets give the components of all pairs within the radius."""
    rng = np.random.default_rng(4)
    key, fp = [], []
    for k, size in enumerate((1, 2, 5, 40, 150)):
        middle = rng.integers(-(1 << 62), 1 << 62, (3, 2))
        for i in range(size):
            flip = rng.integers(0, 128, 14)
            x = middle[i % 3].copy()
            for f in flip:
                x[f // 64] ^= np.int64(np.uint64(1 << int(f % 64)).view(np.int64))
            key.append(k)
            fp.append(x)
    key, fp = np.array(key), np.array(fp)

    def tops(pairs):
        top = {}

        def find(x):
            while top.setdefault(x, x) != x:
                x = top[x]
            return x

        for x, y in pairs:
            x, y = find(x), find(y)
            top[max(x, y)] = min(x, y)
        return {x: find(x) for x in list(top)}

    row = lambda x: tuple(x.tolist())
    got = [(row(x), row(y)) for a, b in near_simhash._bucket_pairs(key, fp, 20) for x, y in zip(a, b)]
    want = [(row(fp[i]), row(fp[j])) for i in range(len(key)) for j in range(i) if key[i] == key[j]
            and 0 < sum((int(x) ^ int(y)).bit_count() if (int(x) ^ int(y)) >= 0 else 64 - (~(int(x) ^ int(y))).bit_count()
                        for x, y in zip(fp[i], fp[j])) <= 20]
    assert tops(got) == tops(want) and len(got) <= 2 * len(key)


def test_sets_are_compared_whole():
    sets = [np.sort(np.array([hash(x) & 0xFFFFFFFF for x in plain_set(t, 1)], np.uint64)) for t in (
        "a b c d e", "a b c d", "a b c", "p q r s t", "p q r s")]
    found = near_simhash._set_forest([0, 1, 2, 3, 4], sets, 0.8)
    assert {frozenset(x) for x in found} == {frozenset((0, 1)), frozenset((3, 4))}
    # What is tied already isn't held against itself.
    assert len(near_simhash._set_forest([0, 0, 0, 3, 3], sets, 0.8)) == 0


def test_a_crowd_makes_few_links(spark):
    """Candidates of many variants of one text are tied as by all tables at once, by few links a node."""
    rng = random.Random(9)
    base = cases.sentence(rng, 200).split()
    texts = [cases.sentence(rng, 200) for _ in range(20)]
    for k in range(300):
        at = set(rng.sample(range(200), rng.randint(1, 6)))
        texts.append(" ".join("new%d" % k if i in at else w for i, w in enumerate(base)))
    source = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    nodes = stored(near_simhash._sketches(source, near_simhash.SHINGLE), "sketches")
    got = stored(near_simhash.candidates(nodes), "got")
    every = stored(near_simhash.candidates(nodes, first=0), "every")
    tops = [sorted((bytes(r.node), bytes(r.component)) for r in components(x).collect()) for x in (got, every)]
    assert tops[0] == tops[1] and len(tops[0]) >= 300
    assert got.distinct().count() <= 4 * len(texts) < every.distinct().count()


def test_what_is_tied_makes_no_links():
    """With what has the same top tied already, a bucket's links hold together what they would without."""
    rng = np.random.default_rng(6)
    middle = rng.integers(-(1 << 62), 1 << 62, (4, 2))
    fp = np.concatenate([np.stack([m ^ (1 << rng.integers(0, 62, 2)) for _ in range(40)]) for m in middle])
    fp, top = np.unique(fp, axis=0), None
    which = np.array([int(near_simhash._apart(middle, x).argmin()) for x in fp])
    top = np.where(which < 3, which + 1, 0)
    order = np.argsort(top, kind="stable")
    fp, top, which = fp[order], top[order], which[order]
    for key in (np.zeros(len(fp), np.int64), np.arange(len(fp)) % 5):
        by = np.lexsort((top, key))
        pairs = near_simhash._bucket_pairs(key[by], fp[by], 8, top[by])
        ends = [(x.tobytes(), y.tobytes()) for a, b in pairs for x, y in zip(a, b)]
        alone = {x.tobytes() for x in fp[which == 3]}
        assert ends and all(x in alone and y in alone for x, y in ends) and len(ends) <= 5 * len(alone)
    # Two tied groups that are near each other get one link.
    near = near_simhash._bucket_pairs(np.zeros(len(fp), np.int64), fp, 128, top)
    assert sum(len(a) for a, _ in near) == 2 + (which == 3).sum()
