"""Groups of spelling variants: words at an edit distance of one, found by an index of grams of variable length.

1. ``word_counts``: runs of letters, A-Z in lower case.  One run in ``DROP`` loses a code point, which a checksum of the
   document's id and the run decides.  Words are counted in the task that reads them before anything is shuffled.
2. ``gram_dictionary``: grams of ``SHORTEST`` code points need no entry.  A longer one is in the dictionary where the gram
   without its last code point starts in more than a ``COMMON`` part of all places in words; rarer grams are selective
   enough and are not extended.  So at most 1/COMMON grams of each length are extended, and the dictionary is bounded
   by that number times the alphabet.
3. ``decompose``: at each place of a word (with ``LONGEST`` - 1 marks around it) the longest gram of the dictionary, or the
   shortest length; a gram that lies within an earlier one goes.
4. ``affected``: how many of a word's grams one edit can change at most.  A gram that starts before the edited place changes
   if it reaches that place or if the dictionary could extend it there; one behind it changes only if a longer gram from
   before could cover it.  Two words at distance one therefore share all but that many grams, those on the left of the edit at
   the same place and those on its right moved by the difference in length.
5. Lists of the index are merged for each word's ``affected`` + 1 rarest grams: by the bound two near words share one of
   them.  The grams' places and the words' lengths are part of a list's key.  What meets is verified by edit distance.

Defined cases: null and empty texts have no words; a null id counts as an empty one in the checksum; repeated rows count as
often as they are there; an empty table gives an empty result; other columns are left alone; runs of any length are words.
"""

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .common import map_arrow, whole

# What a word is, how often it has to occur, and how many times more its form must.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
DROP, LEAST_LENGTH, LEAST_COUNT, FORM_FACTOR = 199, 6, 5, 5
SHORTEST, LONGEST, COMMON = 2, 4, 1 / 2048
#: Marks around a word; no word holds them.
_BEFORE, _AFTER = "\x01", "\x02"
#: Distinct words that a task counts before it hands them on.
_HELD = 1 << 18


def varied(run: str, doc_id) -> str:
    """``run`` in a document, where one in ``DROP`` loses a code point."""
    low = run.encode().lower()
    h = zlib.crc32(b"%s:%s" % (doc_id, low))
    word = low.decode()
    if h % DROP:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1:]


def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH,
                least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    source = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), whole(text_col).alias("text"))

    def step(batches):
        held: Counter = Counter()

        def flush():
            words = [w for w in held if len(w) >= least_length]
            yield pa.record_batch([pa.array(words, pa.string()), pa.array([held[w] for w in words], pa.int64())],
                                  ["word", "n"])
            held.clear()

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                doc = doc_id.encode()
                for run, n in Counter(RUN.findall(text.encode().lower().decode())).items():
                    # A run that is too short stays so.
                    if len(run) >= least_length:
                        held[varied(run, doc)] += n
            if len(held) >= _HELD:
                yield from flush()
        yield from flush()

    return map_arrow(source, step, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(
        F.col("n") >= least_count)


def marked(word: str, longest: int = LONGEST) -> str:
    return _BEFORE * (longest - 1) + word + _AFTER * (longest - 1)


def _marked(word: str, longest: int) -> Column:
    return F.concat(F.lit(_BEFORE * (longest - 1)), word, F.lit(_AFTER * (longest - 1)))


def gram_dictionary(words: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST, common: float = COMMON) -> set[str]:
    """The grams of more than ``shortest`` code points that words are cut into."""
    held = words.select(_marked("word", longest).alias("word"))
    limit = common * (held.agg(F.sum(F.length("word"))).first()[0] or 0)
    grown, extended = set(), None
    for size in range(shortest, longest):
        # Places of grams of this size, and of the same with one code point more.
        at = F.explode(F.sequence(F.lit(1), F.length("word") - size))
        rows = held.filter(F.length("word") > size).select("word", at.alias("at")).select(
            F.substr("word", F.col("at"), F.lit(size)).alias("gram"), F.substr("word", F.col("at"), F.lit(size + 1)).alias("more"))
        counts = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.collect_set("more").alias("more"))
        found = counts.filter(F.col("n") > limit).collect()
        extended = {m for r in found if extended is None or r["gram"] in extended for m in r["more"]}
        grown |= extended
    return grown


class Grams:
    """A dictionary that cuts words, and bounds what an edit changes."""

    def __init__(self, known: set[str], shortest: int = SHORTEST, longest: int = LONGEST):
        self.known, self.shortest, self.longest = known, shortest, longest
        #: What the dictionary can extend.
        self.heads = {g[:size] for g in known for size in range(1, len(g))}

    def decompose(self, word: str) -> list[tuple[int, str]]:
        """(place, gram) of a word with its marks."""
        text, out, end = marked(word, self.longest), [], 0
        for at in range(len(text) - self.shortest + 1):
            size = self.shortest
            # Every head of a dictionary gram that is longer than the shortest is in the dictionary, too.
            while size < self.longest and at + size < len(text) and text[at:at + size + 1] in self.known:
                size += 1
            if at + size > end:
                out.append((at, text[at:at + size]))
                end = at + size
        return out

    def affected(self, word: str, grams: list[tuple[int, str]]) -> int:
        """The most grams that one inserted, deleted or replaced code point can change."""
        text, pad, most = marked(word, self.longest), self.longest - 1, 0
        for i in range(pad, pad + len(word) + 1):
            n = 0
            for at, gram in grams:
                if at <= i - self.longest:
                    continue
                if at <= i:
                    n += at + len(gram) > i or text[at:i] in self.heads or i - at < self.shortest
                else:
                    n += at + len(gram) <= i + self.longest
            most = max(most, n)
        return most


def _gram_rows(words: DataFrame, grams: Grams) -> DataFrame:
    """(word, size, grams, wanted): the grams of each word with their places, and how many of the rarest must be held."""

    def step(batches):
        for batch in batches:
            places, texts, sizes, wanted = [], [], [], []
            for word in batch.column(0).to_pylist():
                cut = grams.decompose(word)
                places.append([at for at, _ in cut])
                texts.append([g for _, g in cut])
                sizes.append(len(word))
                wanted.append(grams.affected(word, cut) + 1)
            yield pa.record_batch(
                [batch.column(0), pa.array(sizes, pa.int32()), pa.array(places, pa.list_(pa.int32())),
                 pa.array(texts, pa.list_(pa.string())), pa.array(wanted, pa.int32())],
                ["word", "size", "places", "grams", "wanted"])

    return map_arrow(words.select("word"), step, "word string, size int, places array<int>, grams array<string>, wanted int")


def near_words(words: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST, common: float = COMMON) -> DataFrame:
    """(a, b) for every two of the distinct ``words`` at an edit distance of one, once: ``a`` is shorter or, of equal
    length, first."""
    grams = Grams(gram_dictionary(words, shortest, longest, common), shortest, longest)
    rows = stored(_gram_rows(words, grams), "word-grams")
    each = rows.select("word", "size", "wanted", F.explode(F.arrays_zip("grams", "places")).alias("g")).select(
        "word", "size", "wanted", F.col("g.grams").alias("gram"), F.col("g.places").alias("at"))
    counts = each.groupBy("gram").agg(F.count(F.lit(1)).alias("rows"))
    # Every word sorts its grams alike: the rarest first, equal ones by place.
    sort = F.array_sort(F.collect_list(F.struct("rows", "gram", "at")))
    lists = each.join(counts, "gram").groupBy("word").agg(
        F.first("size").alias("size"), F.first("wanted").alias("wanted"), sort.alias("sorted"))
    kept = stored(lists.select("word", "size", F.explode(F.slice("sorted", F.lit(1), F.col("wanted"))).alias("g")).select(
        "word", "size", F.col("g.gram").alias("gram"), F.col("g.at").alias("at")), "rare-grams")
    # Equal lengths: a gram keeps its place.  One code point more: it keeps it on the left of the edit only.
    same, longer = F.struct("size", "at"), [F.struct((F.col("size") + 1).alias("size"), (F.col("at") + d).alias("at")) for d in (0, 1)]
    left = kept.select(F.col("word").alias("a"), "gram", F.col("size").alias("size_a"),
                       F.explode(F.array(same, *longer)).alias("key"))
    right = kept.select(F.col("word").alias("b"), "gram", F.struct("size", "at").alias("key"), F.col("size").alias("size_b"))
    met = left.join(right, ["gram", "key"]).filter((F.col("size_a") < F.col("size_b")) | (F.col("a") < F.col("b")))
    pairs = met.select("a", "b").distinct()
    return pairs.filter(F.levenshtein("a", "b", 1) == 1)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of a table (word, form): forms are followed to the last.  The part already followed doubles with each
    round; as a form is ``FORM_FACTOR`` times as frequent, five rounds reach the end of any chain."""
    now = stored(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "forms")
    for _ in range(5):
        next_ = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        more = stored(now.join(next_, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        now = more.select("word", "root")
        if more.filter("moved").isEmpty():
            break
    return now


def spelling_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of each word: how many words are near, the most frequent of them if it is
    frequent enough, and the last word that forms lead to."""
    words = stored(word_counts(df, id_col, text_col), "words")
    pairs = stored(near_words(words, **settings), "near-words")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Strings compare by their bytes in UTF-8, hence in code-point order.
    best = F.min(F.struct((-F.col("m")).alias("m"), F.col("b").alias("b")))
    near = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("m")), "b").groupBy(F.col("a").alias("word")).agg(
        F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    found = words.join(near, "word", "left")
    often = -F.col("best.m") >= FORM_FACTOR * F.col("n")
    formed = stored(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                                 F.when(often, F.col("best.b")).alias("form"), F.when(often, -F.col("best.m")).alias("form_n")),
                    "formed-words")
    return formed.join(roots(formed), "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
