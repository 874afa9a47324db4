import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from spanlens.llm import components, exact_dedup, simhash
from tests.llm import cases


def groups(held):
    found = defaultdict(list)
    for i, t, *_ in held:
        found[re.sub("[ \t-\r]+", " ", t or "")].append(i)
    return found


@pytest.mark.parametrize("support", [0.001, 0.1, 0.5])
def test_exact_copies(spark, support):
    held = cases.rows()
    got = {r.doc_id: tuple(r)[1:] for r in exact_dedup.duplicates(cases.table(spark, held), support=support).collect()}
    want = {}
    for text, ids in groups(held).items():
        for i in ids:
            want[i] = (min(ids), len(ids), i == min(ids), hashlib.sha256(text.encode()).hexdigest())
    assert got == want
    kept = exact_dedup.drop_duplicates(cases.table(spark, held), support=support)
    assert kept.columns == cases.TABLE
    assert sorted(r.doc_id for r in kept.collect()) == sorted(min(ids) for ids in groups(held).values())


def test_exact_copies_without_ids_and_repeated(spark):
    held, more = cases.odd(spark)
    df = cases.table(spark, held + more)
    texts = groups(held + more)
    got = exact_dedup.duplicates(df).collect()
    assert len(got) == len(held + more) and sum(r.kept for r in got) == len(texts)
    assert all(r.keep_id is not None or r.doc_id is None for r in got)
    kept = exact_dedup.drop_duplicates(df, support=0.3).collect()
    assert len(kept) == len(texts)
    assert exact_dedup.duplicates(cases.table(spark, [])).count() == 0
    assert exact_dedup.drop_duplicates(cases.table(spark, [])).count() == 0


def test_one_text_holds_a_third(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'same', 'text ' || id) AS text")
    got = exact_dedup.duplicates(df, support=0.01)
    assert got.filter("kept").count() == 2001 and got.filter("group_size = 1000").count() == 1000
    assert exact_dedup.drop_duplicates(df, support=0.01).count() == 2001


def plain_fingerprint(text, size=4):
    words = re.findall("[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius):
    top = {i: i for i in prints}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 1])
def test_near_copies(spark, bucket):
    held = cases.rows()
    prints = {i: plain_fingerprint(t) for i, t, *_ in held}
    top = plain_components(prints, simhash.RADIUS)
    df = cases.table(spark, held)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df, bucket=bucket).collect()}
    assert got == {i: (f"{prints[i]:016x}", top[i]) for i in prints}
    kept = simhash.drop_near_duplicates(df, bucket=bucket)
    assert kept.columns == cases.TABLE and sorted(r.doc_id for r in kept.collect()) == sorted(set(top.values()))


def test_near_copies_without_ids_and_repeated(spark):
    held, more = cases.odd(spark)
    numbered = {k: plain_fingerprint(r[1]) for k, r in enumerate(held + more)}
    kept = simhash.drop_near_duplicates(cases.table(spark, held + more))
    assert kept.count() == len(set(plain_components(numbered, simhash.RADIUS).values()))
    assert simhash.near_duplicates(cases.table(spark, [])).count() == 0
    assert simhash.drop_near_duplicates(cases.table(spark, [])).count() == 0


@pytest.mark.parametrize("radius", [1, 2, 3, 4, 6])
def test_masks_cover_every_difference(radius):
    found = [m & (1 << 64) - 1 for m in simhash.masks(radius)]
    assert len(found) == (1 << (radius + 1)) - 1 and all(16 <= m.bit_count() <= 48 for m in found)
    rng = np.random.default_rng(3)
    for _ in range(500):
        at = rng.choice(64, radius, replace=False)
        assert any(not any(m >> int(i) & 1 for i in at) for m in found)


@pytest.mark.parametrize("radius,bucket", [(3, 2000), (3, 1), (4, 3)])
def test_links_of_a_dense_cloud(spark, radius, bucket):
    """Fingerprints around one centre, as a large group of near copies makes them."""
    rng = np.random.default_rng(radius)
    centre = int(rng.integers(1 << 62))
    prints = {centre}
    for _ in range(80):
        flips = rng.choice(64, int(rng.integers(1, 8)), replace=False)
        prints.add(centre ^ sum(1 << int(i) for i in flips))
    signed = {p - (1 << 64) if p >> 63 else p: p for p in prints}
    links = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), radius, bucket)
    pairs = links.collect()
    assert all((signed[a] ^ signed[b]).bit_count() <= radius for a, b in pairs)
    got = {r.node: r.component for r in components.components(links).collect()}
    by_place = {i: p for i, p in enumerate(sorted(prints))}
    want = plain_components(by_place, radius)
    number = {p: i for i, p in by_place.items()}
    same = defaultdict(set)
    for s, p in signed.items():
        same[got.get(s, s)].add(want[number[p]])
    assert all(len(v) == 1 for v in same.values()) and len(same) == len(set(want.values()))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 200), (5, 5),
             (None, 3), (300, 301), (302, 301)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200} | {
        i: 300 for i in (300, 301, 302)}
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
