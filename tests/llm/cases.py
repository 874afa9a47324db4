"""Small tables with the awkward rows that every operator must answer for."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, key long, spans string"
TABLE = ["doc_id", "text", "lang", "source", "n_chars", "digest", "key", "spans"]


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(n))


def rows(seed=1, n=60):
    """Plain texts, copies, near copies, and texts that are null, empty, blank, very long or odd."""
    rng = random.Random(seed)
    texts = [sentence(rng, rng.randint(5, 300)) for _ in range(n)]
    texts += [texts[0]] * 20 + [texts[1].replace(" ", "  \t"), texts[1] + "\n", texts[2] + " zz", texts[3][:-1]]
    long = [sentence(rng, 400) for _ in range(3)]
    for t in long:
        words = t.split()
        texts += [t] + [" ".join(words[:k] + ["changed"] + words[k + 1:]) for k in range(0, 400, 40)]
    texts += [None, None, "", " ", "\n\t \r", "x", "▁a ▁", "café \U0001f600 中文\n\n\x00\x1c\x85 z",
              "Näive <|endoftext|>it's <s>THE</s>", "word " * 20_000, "a" * 50_000, "=" * 3000, "́abc é"]
    return [(i, t, rng.choice(["en", "de", None, "xx"]), "s", None, "d", 7, "q") for i, t in enumerate(texts)]


def table(spark, held):
    return spark.createDataFrame(held, SCHEMA)


def odd(spark):
    """Rows without an id, rows that repeat an id, and rows that are repeated whole."""
    held = rows(2, 8)
    return held, [(None, "x y", None, None, None, None, None, None), (None, None, None, None, None, None, None, None),
                  held[0], held[0], (0, "another text", "en", "s", 1, "d", 7, "q")]
