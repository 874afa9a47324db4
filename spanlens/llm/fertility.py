"""Quality rules from tokeniser fertility: how a public vocabulary cuts a text.

For each text: characters per token (of the pre-tokens without digits: numbers and keys are cut character by character
in any text), the share of tokens that are byte fallbacks, and the Shannon entropy of its token ids in bits.  Each has
a band for the document's language, or for its script where the language has none; a text outside a band is rejected.
Entropy is held against the most that a text of so many tokens can have.  Two plain rules come first: too few words, and
too many words in repeated passages.

Defined cases: null and empty texts have no words, no tokens and fail the first rule; documents with a null or repeated
id get a row each; an unknown or null language falls back to the script; an empty table gives an empty result.
"""

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, names_apart, parts, remembered, whole
from .pieces import Vocabulary, model_path, pre_tokens

MIN_WORDS, REPEATED_PERCENT, WINDOW = 20, 30, 8
#: Texts whose words and tokens a worker holds at once; all of them count against the executor's memory.
PART_ROWS = 200
#: Distinct pre-tokens that a Python worker keeps the ids of, and how long they may be.
CACHE, CACHE_CHARS = 100_000, 64
_WORD = re.compile("[^ \t-\r]+")
_SPACES, _SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"


@dataclass(frozen=True)
class Band:
    """What a clean text keeps to: characters per token, most byte fallbacks, and bits of entropy as a share of
    what a text of so many tokens can have at most (``log2`` of its tokens, or ``full`` bits)."""

    chars: tuple[float, float]
    bytes_share: float
    entropy_share: float
    full: float = 9.0


#: The lower ends and the entropy shares lie below clean texts of the given tables, whose invented words are cut finer than
#: natural ones (about 2.6 characters a token in English; the natural sentences of the tests have 3.3 to 5.2).  The upper ends leave room for
#: natural text: a vocabulary that fits a language well is no sign of junk.
BANDS = {
    "en": Band((2.45, 6.0), 0.05, 0.705), "de": Band((2.45, 6.0), 0.05, 0.698),
    "fr": Band((2.22, 6.0), 0.05, 0.687), "es": Band((2.18, 6.0), 0.05, 0.687),
}
SCRIPT_BANDS = {
    "latin": Band((1.4, 6.0), 0.15, 0.60), "cyrillic": Band((1.2, 6.0), 0.15, 0.60),
    "other": Band((0.3, 6.0), 0.80, 0.50),
}
#: Characters per token of a short text vary by chance: its band is wider by SLACK / sqrt(tokens) at either end.
SLACK = 0.7


def script(text: str) -> str:
    """The script of most of a text's letters."""
    latin = cyrillic = other = 0
    for c, n in zip(*np.unique(np.frombuffer(text.encode("utf-32-le", "replace"), "<u4"), return_counts=True)):
        if chr(c).isalpha():
            if c < 0x250:
                latin += n
            elif 0x400 <= c < 0x530:
                cyrillic += n
            else:
                other += n
    return max((latin, 2, "latin"), (cyrillic, 1, "cyrillic"), (other, 0, "other"))[2]


def repeated_words(codes: np.ndarray, window: int = WINDOW) -> int:
    """Words in windows of ``window`` words that occur twice or more, given a number for each word."""
    n = len(codes) - window + 1
    if n < 2:
        return 0
    mixed = np.zeros(n, np.uint64)
    spread = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    spread ^= spread >> np.uint64(29)
    for i in range(window):
        mixed = mixed * np.uint64(0xBF58476D1CE4E5B9) + spread[i:i + n]
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    if not same.any():
        return 0
    # Equal hashes are only candidates: what repeats is decided by the words themselves.
    maybe = np.zeros(n, bool)
    maybe[order[1:][same]] = maybe[order[:-1][same]] = True
    at = np.flatnonzero(maybe)
    rows = np.lib.stride_tricks.sliding_window_view(codes, window)[at]
    _, back, count = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    starts = at[count[back.reshape(-1)] > 1]
    edge = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that are equal to an earlier line."""
    seen, found = set(), 0
    for line in text.split("\n"):
        if line in seen:
            found += _WORD.search(line) is not None
        else:
            seen.add(line)
    return found


def _base(texts: list[str]) -> dict[str, np.ndarray]:
    """The plain counts of each text."""
    # Of bytes ``split`` parts at ASCII white space alone.
    split = [t.encode().split() for t in texts]
    codes, _ = pd.factorize(np.array([w for s in split for w in s], object))
    ends = np.cumsum([len(s) for s in split])
    out = {
        "n_words": [len(s) for s in split],
        "word_chars": [len(t) - sum(map(t.count, _SPACES)) for t in texts],
        "n_symbols": [sum(map(t.count, _SYMBOLS)) for t in texts],
        "n_dup_lines": [duplicate_lines(t) for t in texts],
        "n_repeat_words": [repeated_words(codes[e - len(s):e]) for s, e in zip(split, ends)],
    }
    return {k: np.array(v, np.int64) for k, v in out.items()}


_ids: dict[str, dict[str, bytes]] = remembered()


def _encoded(path: str, names: list[str]) -> list[bytes]:
    """The ids of distinct pre-tokens, four bytes each; short ones are remembered from batch to batch."""
    known = _ids.setdefault(path, {})
    if len(known) > CACHE:
        known.clear()
    new = [w for w in names if w not in known]
    known.update(zip(new, Vocabulary.at(path).packed(new)))
    out = list(map(known.__getitem__, names))
    for w in new if len(new) > CACHE else [w for w in new if len(w) > CACHE_CHARS]:
        del known[w]
    return out


def _with_digits(names: list[str], length: np.ndarray) -> np.ndarray:
    """Which of the names (not empty, of the given lengths) have an ASCII digit."""
    code = np.frombuffer("".join(names).encode("utf-32-le"), "<u4")
    out = np.zeros(len(names), bool)
    out[np.searchsorted(np.cumsum(length), np.flatnonzero((code >= 48) & (code <= 57)), side="right")] = True
    return out


def _fertility(texts: list[str], path: str) -> dict[str, np.ndarray]:
    """Tokens, byte fallbacks and entropy of each text, from the pieces of its distinct pre-tokens."""
    split = [pre_tokens(t) for t in texts]
    n = len(texts)
    doc = np.repeat(np.arange(n), [len(s) for s in split])
    codes, names = pd.factorize(np.array([w for s in split for w in s], object))
    ids = _encoded(path, list(names))
    size = np.array([len(x) for x in ids], np.int64) // 4
    flat = np.frombuffer(b"".join(ids), np.int32).astype(np.int64)
    start = np.cumsum(size) - size
    pair, times = np.unique(doc * max(len(names), 1) + codes, return_counts=True)
    of_pair, code = pair // max(len(names), 1), pair % max(len(names), 1)
    reps = size[code]
    inner = np.arange(int(reps.sum())) - np.repeat(np.cumsum(reps) - reps, reps)
    token = flat[np.repeat(start[code], reps) + inner]
    width = len(Vocabulary.at(path).byte)
    key = np.repeat(of_pair, reps) * width + token
    weight = np.repeat(times, reps)
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    count = np.add.reduceat(weight, first) if len(first) else np.zeros(0, np.int64)
    of, token = key[first] // width, key[first] % width
    tokens = np.bincount(of, count, n)
    with np.errstate(divide="ignore", invalid="ignore"):
        plogp = np.bincount(of, count * np.log2(np.maximum(count, 1)), n)
        entropy = np.where(tokens > 0, np.log2(np.maximum(tokens, 1)) - plogp / np.maximum(tokens, 1), 0.0)
    is_byte = np.array(Vocabulary.at(path).byte)
    # Numbers and keys say nothing of the language.
    length = np.fromiter(map(len, names), np.int64, len(names))
    plain = ~_with_digits(names, length)
    plain_chars = np.bincount(of_pair, times * (length * plain)[code], n)
    plain_tokens = np.bincount(of_pair, times * (size * plain)[code], n)
    # A line break is a byte in this vocabulary without being foreign to it.
    foreign = np.bincount(of, count * is_byte[token], n) - np.array([t.count("\n") for t in texts])
    return {"n_tokens": tokens.astype(np.int64), "foreign": foreign, "entropy": np.maximum(entropy, 0.0),
            "chars_per_token": plain_chars / np.maximum(plain_tokens, 1), "no_plain": plain_tokens == 0}


_MEASURES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, "
             "chars_per_token double, byte_share double, entropy double, base_failed boolean, kept boolean")


def _measured(texts: list[str], langs: list, path: str, bands: dict, scripts: dict) -> list[pa.Array]:
    base, cut = _base(texts), _fertility(texts, path)
    tokens = np.maximum(cut["n_tokens"], 1)
    chars = cut["chars_per_token"]
    share = cut["foreign"] / tokens
    failed = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > REPEATED_PERCENT * base["n_words"])
    band = [bands.get(lang) or scripts[script(t)] for lang, t in zip(langs, texts)]
    low, high = (np.array([b.chars[i] for b in band]) for i in (0, 1))
    slack = SLACK / np.sqrt(tokens)
    room = np.minimum(np.log2(tokens), [b.full for b in band])
    inside = (
        ((chars >= low - slack) & (chars <= high + slack) | cut["no_plain"]) & (share <= [b.bytes_share for b in band])
        & (cut["entropy"] >= room * [b.entropy_share for b in band])
    )
    columns = [*base.values(), cut["n_tokens"], chars, share, cut["entropy"], failed, inside & ~failed]
    return [pa.array(c) for c in columns]


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang",
            model: str | None = None, bands: dict | None = None, scripts: dict | None = None) -> DataFrame:
    """One row for each row of ``df``: its id, the counts, the measures, ``base_failed`` and ``kept``."""
    path, bands, scripts = model or model_path(), bands or BANDS, scripts or SCRIPT_BANDS
    lang = F.lit(None).cast("string") if lang_col is None else F.col(lang_col).cast("string")
    source = df.select(F.col(id_col).alias("id"), whole(text_col).alias("text"), lang.alias("lang"))
    names = ["id", *[x.split()[0] for x in _MEASURES.split(", ")]]

    def step(batches):
        for part in parts(batches, PART_ROWS):
            columns = _measured(part.column(1).to_pylist(), part.column(2).to_pylist(), path, bands, scripts)
            yield pa.record_batch([part.column(0), *columns], names)

    kind = source.schema["id"].dataType.simpleString()
    return map_arrow(source, step, f"id {kind}, {_MEASURES}").withColumnRenamed("id", id_col)


def keep_good(df: DataFrame, text_col: str = "text", lang_col: str | None = "lang", model: str | None = None,
              bands: dict | None = None, scripts: dict | None = None) -> DataFrame:
    """The rows of ``df`` that pass, with all their columns, in one pass without a shuffle."""
    path, bands, scripts = model or model_path(), bands or BANDS, scripts or SCRIPT_BANDS
    text, lang = names_apart(df, "whole_text", "band_lang")
    given = F.lit(None).cast("string") if lang_col is None else F.col(lang_col).cast("string")
    source = df.withColumns({text: whole(text_col), lang: given})

    def step(batches):
        for part in parts(batches, PART_ROWS):
            texts, langs = part.column(part.num_columns - 2), part.column(part.num_columns - 1)
            kept = _measured(texts.to_pylist(), langs.to_pylist(), path, bands, scripts)[-1]
            yield part.select(range(part.num_columns - 2)).filter(kept)

    return map_arrow(source, step, df.schema)
