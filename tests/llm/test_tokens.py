import random
import re
import zlib
from collections import Counter
from math import log2

import numpy as np
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from spanlens.llm import fertility, packing, pieces, token_counts, token_files
from tests.llm import cases

MODEL = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())


def test_pre_tokens_have_the_pieces_of_the_text():
    vocabulary = pieces.Vocabulary.at(pieces.model_path())
    rng = random.Random(4)
    odd = ["".join(rng.choice(" \n\t▁abé中😀\x00<>s/0x0A") for _ in range(rng.randint(0, 40))) for _ in range(800)]
    for text in odd + [r[1] for r in cases.rows() if r[1]]:
        cut = pieces.pre_tokens(text)
        assert [i for ids in vocabulary.encode(cut) for i in ids] == MODEL.encode(text)


@pytest.mark.parametrize("head", [1 << 16, 3])
def test_token_counts(spark, head):
    held = cases.rows()
    got = {r.doc_id: tuple(r)[1:] for r in token_counts.token_counts(cases.table(spark, held), head=head).collect()}
    for i, t, *_ in held:
        n = len(MODEL.encode(t or ""))
        assert got[i] == (len((t or "").encode()), n, n > token_counts.LIMIT)


def test_token_counts_without_ids_and_repeated(spark):
    held, more = cases.odd(spark)
    got = token_counts.token_counts(cases.table(spark, held + more)).collect()
    want = Counter((r[0], len(MODEL.encode(r[1] or ""))) for r in held + more)
    assert Counter((r.doc_id, r.n_tokens) for r in got) == want
    assert token_counts.token_counts(cases.table(spark, [])).count() == 0


def test_token_files(spark):
    held = cases.rows()
    random.Random(5).shuffle(held)
    got = [tuple(r) for r in token_files.token_file_report(cases.table(spark, held)).orderBy("doc_id")
           .select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    tokenizer, start, want = Tokenizer.from_file(token_files.model_path()), 0, []
    for i, t, *_ in sorted(held):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_token_files_are_laid_out_as_asked(spark, tmp_path):
    path = str(tmp_path / "ids")
    token_files.write_tokens(cases.table(spark, cases.rows()), path)
    for name in (tmp_path / "ids").glob("*.parquet"):
        group = pq.ParquetFile(name).metadata.row_group(0)
        columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
        ids = next(c for k, c in columns.items() if k.startswith("ids"))
        assert "RLE_DICTIONARY" in ids.encodings and ids.has_offset_index
        assert "DELTA_BINARY_PACKED" in columns["n_tokens"].encodings and columns["doc_id"].has_column_index
    rows = token_files.read_tokens(spark, path, with_ids=False)
    assert "ids" not in rows._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1].split(">")[0]
    back = token_files.read_tokens(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in back] == sorted(r.doc_id for r in back)
    assert all(len(r.ids) == r.n_tokens and r.ids[-1] == 1 for r in back)


def test_token_files_without_ids_and_repeated(spark):
    held, more = cases.odd(spark)
    got = token_files.token_file_report(cases.table(spark, held + more)).orderBy("start").collect()
    assert len(got) == len(held + more) and got[0].doc_id is None
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    assert token_files.token_file_report(cases.table(spark, [])).count() == 0


def plain_quality(text):
    import re

    text = text or ""
    words = re.findall("[^ \t-\r]+", text)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    lines = text.split("\n")
    again = sum(bool(re.search("[^ \t-\r]", x)) and x in lines[:k] for k, x in enumerate(lines))
    ids = Counter(MODEL.encode(text))
    n = sum(ids.values())
    entropy = log2(n) - sum(c * log2(c) for c in ids.values()) / n if n else 0.0
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(hit), n), entropy


def test_quality(spark):
    held = [r for r in cases.rows() if len(r[1] or "") < 60_000]
    held += [(1000 + i, t, "en", "", None, "", 1, "") for i, t in enumerate(
        ["a b c d e f g h " * 5, "a b\nc d\na b\n\n\n \n \na b", "| x " * 30, "a b c d e f g h i j k a b c d e f g h z"])]
    for r in fertility.quality(cases.table(spark, held)).collect():
        (words, *rest, n), entropy = plain_quality(next(x[1] for x in held if x[0] == r.doc_id))
        assert tuple(r)[1:7] == (words, *rest, n) and abs(r.entropy - entropy) < 1e-6
        assert r.base_failed == (words < 20 or 100 * rest[-1] > 30 * words)
        assert not (r.base_failed and r.kept)


def test_quality_keeps_clean_texts_and_rejects_others(spark):
    d = "/root/testdata/sf0.01"
    marked = spark.read.parquet(f"{d}/labels.parquet")
    got = fertility.quality(spark.read.parquet(f"{d}/documents.parquet")).join(marked, "doc_id").filter("NOT base_failed")
    clean, junk = got.filter("quality = 1"), got.filter("quality = 0")
    assert clean.filter("kept").count() >= 0.99 * clean.count()
    assert junk.filter("NOT kept").count() >= 0.85 * junk.count()


def test_quality_of_odd_rows(spark):
    held, more = cases.odd(spark)
    df = cases.table(spark, held + more)
    assert fertility.quality(df).count() == len(held + more)
    assert fertility.keep_good(df).columns == cases.TABLE
    assert fertility.quality(df, lang_col=None).count() == len(held + more)
    assert fertility.quality(cases.table(spark, [])).count() == 0
    kept = {r.doc_id for r in fertility.quality(df).filter("kept").collect()}
    assert {r.doc_id for r in fertility.keep_good(df).collect()} == kept
    assert fertility.script("привет мир") == "cyrillic" and fertility.script("中文") == "other"


def plain_pack(lengths, sizes):
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    left, space, content, where = sum(lengths), [], [], [0] * len(lengths)
    for i in order:
        fits = [(s, b) for b, s in enumerate(space) if s >= lengths[i]]
        if fits:
            b = min(fits)[1]
        else:
            b = len(space)
            space.append(min((s for s in sizes if s >= lengths[i]), key=lambda s: (packing.cost(s) / min(s, left), s)))
            content.append(0)
        space[b] -= lengths[i]
        content[b] += lengths[i]
        left -= lengths[i]
        where[i] = b
    return where, [min(s for s in sizes if s >= c) for c in content]


def test_packing_is_best_fit():
    rng = random.Random(6)
    for _ in range(60):
        sizes = tuple(sorted(rng.sample(range(5, 60), 3)))
        lengths = [rng.randint(1, sizes[-1]) for _ in range(rng.randint(1, 80))]
        bins, offsets, final = packing.pack(lengths, sizes)
        assert (bins, final) == plain_pack(lengths, sizes)
        for b in set(bins):
            inside = sorted((offsets[i], lengths[i]) for i in range(len(lengths)) if bins[i] == b)
            assert [o for o, _ in inside] == np.cumsum([0, *[n for _, n in inside]])[:-1].tolist()


@pytest.mark.parametrize("sizes,window", [(packing.SIZES, packing.WINDOW), ((64, 256), 50)])
def test_packed_documents(spark, sizes, window):
    held, more = cases.odd(spark)
    held = cases.rows() + more
    got = packing.pack_documents(cases.table(spark, held), sizes=sizes, window=window).collect()
    want = Counter()
    for i, t, *_ in held:
        want[i] += len(MODEL.encode(t or "")) + 1
    total, filled = Counter(), Counter()
    for r in got:
        total[r.doc_id] += r.n_tokens
        filled[r.bin_id] += r.n_tokens
    assert total == want
    for r in got:
        assert r.bin_size == min(s for s in sizes if s >= filled[r.bin_id])
        assert r.n_tokens == max(sizes) or r.start % max(sizes) == 0
    assert packing.pack_documents(cases.table(spark, [])).count() == 0


def test_pre_tokens_are_packed():
    """Pre-tokens encoded a few together have the ids that each has alone, and the model gets few texts."""
    rng = random.Random(8)
    odd = "▁\x00\x1c\x85\r\v aeé9<中\U0001f600\u0301x0A>"
    words = ["\n", "▁", "▁▁▁", "<0x0A>", "▁<unk>", "a" * 5000, "a\nb", *["▁" + "".join(rng.choice(odd) for _ in range(rng.randint(0, 9)))
                                                                     for _ in range(800)]]
    vocabulary = pieces.Vocabulary(pieces.model_path())
    want = [np.array(ids, np.int32).tobytes() for ids in vocabulary.encode(words)]
    model, given = vocabulary.model, []
    vocabulary.model = type("Counting", (), {"encode": lambda _, x, **k: given.extend([x] if isinstance(x, str) else x) or model.encode(x, **k)})()
    assert vocabulary.packed(words) == want and len(given) <= len(words) // pieces.TOGETHER + 4
    # A line break that comes out as something else is no mark: each word goes alone.
    vocabulary.line_break = next(i for i, x in enumerate(vocabulary.byte) if x)
    assert vocabulary.packed(words) == want
    assert vocabulary.packed([]) == [] and vocabulary.packed(["\n"]) == want[:1]


def test_the_quality_rules_give_the_model_few_texts(monkeypatch):
    rng, sizes = random.Random(10), []
    real = pieces.Vocabulary.at(pieces.model_path())
    counting = type("Counting", (), {"encode": lambda _, x, **k: sizes.append(len(x)) or real.model.encode(x, **k)})()
    fake = pieces.Vocabulary(pieces.model_path())
    fake.model = counting
    monkeypatch.setitem(pieces._open, pieces.model_path(), fake)
    names = list({"▁" + cases.sentence(rng, 1) for _ in range(3000)})
    fertility._ids.clear()
    got = fertility._encoded(pieces.model_path(), names)
    assert [np.frombuffer(x, np.int32).tolist() for x in got] == real.encode(names)
    assert sum(sizes) <= len(names) // 8 and fertility._encoded(pieces.model_path(), names) == got


def test_plain_counts_of_odd_texts():
    rng = random.Random(12)
    odd = " \t\n\v\f\r\x1c\x85\xa0\u2028a9é#*$%&|<>中\U0001f600"
    texts = ["".join(rng.choice(odd) for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["", "\n", "9"]
    base = fertility._base(texts)
    words = [re.findall("[^ \\t-\\r]+", t) for t in texts]
    assert base["n_words"].tolist() == [len(w) for w in words]
    assert base["word_chars"].tolist() == [sum(map(len, w)) for w in words]
    assert base["n_symbols"].tolist() == [len(re.findall(r"[#*$%&|<>]", t)) for t in texts]
    names = [t for t in texts if t]
    length = np.array([len(t) for t in names])
    assert fertility._with_digits(names, length).tolist() == [bool(re.search("[0-9]", t)) for t in names]
