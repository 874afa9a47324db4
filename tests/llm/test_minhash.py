import re

import pytest

import corpus_pipeline
from spanlens.llm import exact_dedup, minhash
from tests.llm import cases


def plain_set(text, size=5):
    words = re.findall("[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def plain_tops(texts):
    """The smallest key of each key's component under a similarity of 0.8, by brute force."""
    sets, top = {i: plain_set(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            common = len(sets[a] & sets[b])
            if sets[a] == sets[b] or 5 * common >= 4 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("stars, direct", [(0, 0), (2, 4), (2, 8)])
def test_near_copies(spark, stars, direct):
    held = cases.rows()
    # A chain whose neighbours alone are alike, and pairs on either side of the limit.
    words = cases.sentence(cases.random.Random(5), 200).split()
    chain = [" ".join(words[k * 8:k * 8 + 100]) for k in range(8)]
    held += [(900 + i, t, "en", "s", None, "d", 7, "q") for i, t in enumerate(chain)]
    want = set(plain_tops({i: t for i, t, *_ in held}).values())
    kept = minhash.drop_near_copies(cases.table(spark, held), stars=stars, direct=direct)
    assert kept.columns == cases.TABLE and sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_near_copies_without_ids_and_repeated(spark):
    held, more = cases.odd(spark)
    numbered = {k: r[1] for k, r in enumerate(held + more)}
    kept = minhash.drop_near_copies(cases.table(spark, held + more))
    assert kept.count() == len(set(plain_tops(numbered).values())) and kept.columns == cases.TABLE
    assert minhash.drop_near_copies(cases.table(spark, [])).count() == 0


def test_stage_drops_what_is_alike(spark):
    """64-bit fingerprints within 4 bits leave four of these five pairs in the corpus."""
    d = "/root/testdata/sf0.01"
    docs = exact_dedup.drop_duplicates(spark.read.parquet(f"{d}/documents.parquet"))
    kept = {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, d).collect()}
    ids = {r.doc_id for r in docs.collect()}
    assert ids - kept == {56, 255, 770, 875, 944}
