"""Token ids as Parquet files that can be read in part.

A file has one row for each document, ordered by id: the id, the number of tokens and the ids as a list.  List values are
dictionary-encoded (a vocabulary is small) and fall back to delta encoding, the plain columns are delta-encoded, row
groups and pages have fixed sizes, and page indexes are written, so a reader of some columns or of a range of documents
reads little else.

Encoding: texts are cut where the tokenizer itself never joins anything, and each distinct piece of a batch is given to
the tokenizers library once.  ``Cutter`` holds a tokenizer's rules against what the cuts need: with the pattern below,
texts of Latin-1 characters are cut into its own units; other texts are cut at ASCII white space; and a tokenizer whose
rules are others gets whole texts.

Defined cases: null and empty texts have the end id only; null ids come first; rows with equal ids keep the order in
which they were read; an empty table writes no rows.
"""

import json
import os
import re
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import scratch
from .common import map_arrow, whole

MODEL, END_ID = "word_bpe_49k.json", 1
#: Bytes of a row group and rows of a page: what a selective read takes at least.
ROW_GROUP_BYTES, PAGE_ROWS, PAGE_BYTES = 32 << 20, 1000, 256 << 10
#: Words that a Python worker keeps the ids of, and how long they may be.
CACHE, CACHE_CHARS = 500_000, 64
_WORD = re.compile("[^ \t-\r]+")
# Fixed value: the pattern of the public tokenizer, whose matches are encoded apart.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# The same over lower-case Latin-1: its letters, its numbers, and characters that need more than that.
_LETTERS, _NUMBERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_UNIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^ \t-\r{_LETTERS}{_NUMBERS}]+")
_PLAIN = re.compile(f"[{_LETTERS}]+")
_OTHER = re.compile("[^\x00-\x1b -\x84\x86-\x9f\xa1-\xff]")
_BLOCK = 5000
_open = {}


def model_path(name: str = MODEL) -> str:
    """Where the public tokenizer is; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Cutter:
    """One tokenizer, and how texts may be cut for it; opened once in each Python worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.known: dict[str, bytes] = {}
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.apart = self._apart(spec)
        ends = {i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")}
        self.ends = np.array([i in ends for i in range(self.tokenizer.get_vocab_size())])

    @staticmethod
    def _apart(spec: dict) -> bool:
        """White space is dropped before the merges, and nothing is put before or after a text's words."""
        norms = spec.get("normalizer") or {"type": "Sequence", "normalizers": []}
        cut = spec.get("pre_tokenizer") or {}
        steps = cut.get("pretokenizers", [cut])
        first = steps[0] if steps else {}
        return (
            first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
            and first.get("pattern") == {"Regex": PATTERN}
            and [n["type"] for n in norms.get("normalizers", [norms])] == ["NFC", "Replace", "Lowercase"]
            and not any(s.get("add_prefix_space") for s in steps)
            and spec["model"].get("end_of_word_suffix") == "</w>"
            and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])
            and spec.get("truncation") is None and spec.get("padding") is None
        )

    @staticmethod
    def at(path: str) -> "Cutter":
        if path not in _open:
            _open[path] = Cutter(path)
        return _open[path]

    def cut(self, text: str) -> list[str]:
        if not self.apart:
            return [text]
        if _OTHER.search(text) or any(t in text for t in self.added):
            return _WORD.findall(text)
        return _UNIT.findall(text.lower())

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4") for e in found]

    def _fresh(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of pieces as bytes.  Runs of letters are one unit each, whose last id alone ends a word, so many of
        them go through the library as one text."""
        out: dict[str, bytes] = {}
        plain = [p for p in pieces if self.apart and _PLAIN.fullmatch(p)]
        for at in range(0, len(plain), _BLOCK):
            block = plain[at:at + _BLOCK]
            ids = self._library([" ".join(block)])[0]
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(block):
                data, cuts = ids.tobytes(), (4 * ends).tolist()
                out.update(zip(block, (data[a:b] for a, b in zip([0, *cuts], cuts))))
        rest = [p for p in pieces if p not in out]
        for at in range(0, len(rest), _BLOCK):
            block = rest[at:at + _BLOCK]
            out.update(zip(block, (x.tobytes() for x in self._library(block))))
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as the library gives them for the whole text without added special tokens."""
        split = [self.cut(t) for t in texts]
        known = self.known
        new = list(set().union(*split).difference(known))
        room = max(CACHE - len(known), 0)
        known.update(self._fresh(new))
        out = [np.frombuffer(b"".join(map(known.__getitem__, s)), "<u4") for s in split]
        new.sort(key=len)
        for p in new[min(room, bisect_right(new, CACHE_CHARS, key=len)):]:
            del known[p]
        return out


def write_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
                 end_id: int | None = END_ID) -> None:
    """Write the files of ``df`` below ``path``, in ascending order of the id.

    The rows are dealt in ranges of (id, place), so one id with very many rows is more than one task.  Spark's
    writer commits each task's file once, whatever is repeated.
    """
    model = tokenizer or model_path()
    source = df.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text"),
                       F.monotonically_increasing_id().alias("place"))
    dealt = source.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place")
    last = [] if end_id is None else [end_id]

    def step(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = [np.concatenate([x, np.array(last, "<u4")]) for x in Cutter.at(model).encode(batch.column(1).to_pylist())]
            sizes = np.array([len(x) for x in ids], np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32)))
            yield pa.record_batch([batch.column(0), pa.array(sizes), lists], ["doc_id", "n_tokens", "ids"])

    kind = source.schema["doc_id"].dataType.simpleString()
    rows = map_arrow(dealt.select("doc_id", "text"), step, f"doc_id {kind}, n_tokens long, ids array<int>")
    (
        rows.write.option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.size", PAGE_BYTES)
        .option("parquet.page.row.count.limit", PAGE_ROWS).option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#ids.list.element", "true")
        .option("compression", "zstd").parquet(path)
    )


_PLACE = ("file", "row")


def _rows(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    return spark.read.parquet(path).select(
        *columns, F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")
    )


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Rows of the files with ``start``, the tokens of all rows before: from the two plain columns alone unless the
    ids are asked for."""
    columns = ["doc_id", "n_tokens", *(["ids"] if with_ids else [])]
    return _started(_rows(spark, path, *columns), path)


def _started(rows: DataFrame, path: str) -> DataFrame:
    """Files are numbered in the order of the ids.  Sums inside a file and one row for each file give the start, so no
    window spans the whole corpus."""
    files = _rows(rows.sparkSession, path, "n_tokens").groupBy("file").agg(F.sum("n_tokens").alias("n"))
    number = F.regexp_extract("file", "part-([0-9]+)", 1).cast("long")
    earlier = Window.orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("start", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(offsets, "file")
        .withColumn("start", F.col("start") + F.col("offset")).drop(*_PLACE, "offset")
    )


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each row: CRC-32 of its ids as little-endian 32-bit numbers."""
    rows = _rows(spark, path, "doc_id", "n_tokens", "ids")
    names = ["doc_id", "n_tokens", "ids_crc32", *_PLACE]

    def step(batches):
        for batch in batches:
            ids = batch.column(2)
            flat = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            ends = np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip([0, *ends], ends)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(crc, pa.int64()), batch.column(3),
                                   batch.column(4)], names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    counted = map_arrow(rows, step, f"doc_id {kind}, n_tokens long, ids_crc32 long, file string, row long")
    return _started(counted, path)


def token_file_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      tokenizer: str | None = None) -> DataFrame:
    """Encode ``df``, write its files to the shared folder, read them back and report each row."""
    path = scratch(df.sparkSession, "token-files")
    write_tokens(df, path, id_col, text_col, tokenizer)
    return token_digests(df.sparkSession, path).withColumnRenamed("doc_id", id_col)
