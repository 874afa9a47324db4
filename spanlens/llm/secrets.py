"""Secrets in texts: fixed forms, and strings whose characters look random.

Fixed forms are assignments to a secret's name, access keys and long hexadecimal runs.  Beyond them every long run of
letters, digits and key characters is a candidate.  A window of fixed width slides over it for each character class
(``CLASSES``); the number of times each character is in the window is kept as the window moves, one character in and one
out, and so is the sum of c * log2(c) over these counts, from which the entropy follows: log2(width) - sum / width.
Windows at or above the class's threshold make spans, overlapping ones one span.  Spans go whose own text, or whose whole
string, one pattern of the allow list makes up, and spans of which less than ``REST`` characters remain without the parts
that hold a word of ``PLACEHOLDER``; fixed forms stay.

Everything is a column expression of whole texts: no row leaves its task.  Positions are code points, the end
exclusive.  Defined cases: null and empty texts have no spans; null ids and repeated rows get a row each; an empty table gives
an empty result; texts and strings of any length are scanned whole, in time linear in them; other columns are left alone.
"""

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import names_apart, whole

# The forms looked for, and how long a match must be.  A hexadecimal run is matched as a whole, so asking for
# its length in the pattern drops the short ones.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
ASSIGN_VALUE, ACCESS_LENGTH = 6, 20
KINDS = ("assign", "access", "hex")


@dataclass(frozen=True)
class CharacterClass:
    """Runs of ``characters`` (inside a regular expression's brackets), and from how many bits a window of ``width`` of
    them counts as random.  ``most``: the longest run of the class; ``needs``: what each run has to hold."""

    kind: str
    characters: str
    width: int
    bits: float
    most: int | None = None
    needs: tuple[str, ...] = ()

    @property
    def pattern(self) -> str:
        one = f"[{self.characters}]"
        return f"{one}{{{self.width},}}" if self.most is None else f"(?<!{one}){one}{{{self.width},{self.most}}}(?!{one})"


CLASSES = (
    CharacterClass("entropy_hex", "0-9A-Fa-f", 24, 3.0),
    CharacterClass("entropy_base64", "A-Za-z0-9+/_=-", 28, 4.1),
    # Keys shorter than that window, as 16 bytes in base64: they mix capitals, small letters and digits.
    CharacterClass("entropy_short", "A-Za-z0-9+/_=-", 20, 3.6, 27, ("[A-Z]", "[a-z]", "[0-9].*[0-9]")),
)
#: Allow list of harmless texts.  Repetitions are possessive: Java walks those in a loop, others by recursion.
ALLOW = (
    r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",  # UUID
    r"[0-9]++",  # plain numbers
    r"[A-Za-z]++",  # one long word
    r"(?i)[a-z]++([-_/=][a-z]++)++",  # words joined by marks, as in paths
)
#: Words of stand-ins for secrets; parts of a span lie between marks.
PLACEHOLDER, MARK, REST = "(?i)(example|sample|placeholder|xxxx)", "[-_/=+]", 20
_BLOCK = 256


def _long_sizes(parts: Column) -> Column:
    return F.transform(parts, lambda x: F.length(x).cast("long"))


def _with(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: inside higher-order functions each mention counts."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _sums_before(sizes: Column) -> Column:
    """For each element the sum of those before it.  Growing one array costs the square of its length, so blocks of
    ``_BLOCK`` are summed apart and then shifted."""
    start = F.struct(F.lit(0).cast("long").alias("next"), F.array().cast("array<bigint>").alias("out"))
    step = lambda s, x: F.struct(
        (s["next"] + x).alias("next"), F.concat(s["out"], F.array(s["next"])).alias("out")
    )

    def blocks(whole):
        last = F.floor((F.size(whole) - 1) / _BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
                           lambda b: F.slice(whole, b * _BLOCK + 1, F.lit(_BLOCK)))

    def shifted(inner):
        shifts = F.aggregate(F.transform(inner, lambda b: b["next"]), start, step)["out"]
        return F.flatten(F.zip_with(inner, shifts, lambda b, shift: F.transform(b["out"], lambda x: x + shift)))

    inner = _with(sizes, lambda whole: F.transform(blocks(whole), lambda b: F.aggregate(b, start, step)))
    return _with(inner, shifted)


def _starts(text: Column, pattern: str, found: Column) -> Column:
    """Start positions of the matches ``found``.  ``split`` walks through the same matches, so the lengths of what lies
    between them give the positions; texts without a match are not split."""
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    placed = _with(_long_sizes(gaps), lambda between: F.zip_with(
        _sums_before(F.zip_with(between, _long_sizes(found), lambda a, b: a + b)), between, lambda a, b: a + b
    ))
    return F.when(F.size(found) > 0, placed).otherwise(F.array().cast("array<bigint>"))


def _span(start: Column, kind: int, end: Column) -> Column:
    return F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))


def _fixed_spans(kind: int, found: Column, starts: Column, enough) -> Column:
    """Spans of the matches that ``enough`` holds for."""
    both = F.filter(F.arrays_zip(found.alias("text"), starts.alias("start")), lambda m: enough(m["text"]))
    return F.transform(both, lambda m: _span(m["start"], kind, m["start"] + F.length(m["text"])))


def _secret(span: Column, allowed: str) -> Column:
    rest = F.filter(F.split(span, MARK), lambda part: ~part.rlike(PLACEHOLDER))
    return ~span.rlike(allowed) & (~span.rlike(PLACEHOLDER) | (F.length(F.array_join(rest, "")) >= REST))


def _random_spans(run: Column, place: Column, kind: int, cls: CharacterClass, allowed: str) -> Column:
    """Spans in one candidate that starts at ``place``, without those that ``allowed`` makes up and stand-ins.

    ``counts`` holds, for each of 128 characters, how often the window has it, as one character of a string: the state
    is as small for a candidate of a million characters as for one of thirty.
    """
    width = cls.width
    part = [c * math.log2(c) if c else 0.0 for c in range(width + 2)]
    # What the sum of c * log2(c) gains when a count of c grows by one.
    gain = F.array(*[F.lit(part[c + 1] - part[c]) for c in range(width + 1)])
    most = (math.log2(width) - cls.bits) * width + 1e-9
    count = lambda counts, c: F.ascii(F.substring(counts, F.ascii(c), F.lit(1))) - 48
    put = lambda counts, c, n: F.overlay(counts, F.char(n + 48), F.ascii(c), F.lit(1))
    window = lambda counts, total: F.struct(counts.alias("counts"), total.alias("total"))

    def enter(w, c):
        return _with(count(w["counts"], c), lambda n: window(
            put(w["counts"], c, n + 1), w["total"] + F.element_at(gain, n + 1)))

    def leave(w, c):
        return _with(count(w["counts"], c), lambda n: window(
            put(w["counts"], c, n - 1), w["total"] - F.element_at(gain, n)))

    def settle(state, now):
        """The open span from ``first`` to ``last`` grows, closes or begins."""
        begin, random = state["at"] - (width - 1), (state["at"] >= width - 1) & (now["total"] <= most)
        joins = random & (state["last"] >= begin)
        closed = F.array(F.struct(state["first"].alias("first"), state["last"].alias("last")))
        return F.struct(
            now.alias("window"), (state["at"] + 1).alias("at"),
            F.when(random & ~joins, begin).otherwise(state["first"]).alias("first"),
            F.when(random, state["at"] + 1).otherwise(state["last"]).alias("last"),
            F.when(random & ~joins & (state["first"] >= 0), F.concat(state["spans"], closed))
            .otherwise(state["spans"]).alias("spans"),
        )

    def step(chars):
        return lambda state, c: _with(
            F.when(state["at"] >= width, leave(state["window"], F.get(chars, state["at"] - width)))
            .otherwise(state["window"]),
            lambda w: _with(enter(w, c), lambda now: settle(state, now)),
        )

    start = F.struct(
        window(F.lit("0" * 128), F.lit(0.0)).alias("window"), F.lit(0).alias("at"), F.lit(-1).alias("first"),
        F.lit(-1).alias("last"), F.array().cast("array<struct<first:int,last:int>>").alias("spans"),
    )
    ended = _with(F.split(run, ""), lambda chars: F.aggregate(chars, start, step(chars)))
    return _with(ended, lambda e: F.transform(
        F.filter(F.concat(e["spans"], F.array(F.struct(e["first"].alias("first"), e["last"].alias("last")))),
                 lambda s: (s["first"] >= 0) & _secret(F.substring(run, s["first"] + 1, s["last"] - s["first"]), allowed)),
        lambda s: _span(place + s["first"], kind, place + s["last"]),
    ))


def _scan(kind: int, cls: CharacterClass, allowed: str):
    return lambda m: _random_spans(m["text"], m["start"], kind, cls, allowed)


def _odd(harmless: str, needs):
    return lambda m: reduce(lambda a, b: a & b, [~m["text"].rlike(harmless), *[m["text"].rlike(n) for n in needs]])


def _one_of(patterns) -> str:
    return "^(?:" + "|".join(patterns) + ")$" if patterns else "(?!)"


def secret_spans(df: DataFrame, text_col: str = "text", classes=CLASSES, allow=ALLOW, out: str = "spans") -> DataFrame:
    """``df`` with an array ``out`` of (start, kind, end), ordered by start and then kind; ``kind`` counts through
    ``KINDS`` and then ``classes``."""
    text, *helpers = names_apart(df, "whole_text", *[f"{x}_{i}" for i in range(3 + len(classes)) for x in ("found", "at")])
    found, at = helpers[::2], helpers[1::2]
    patterns = [ASSIGN, ACCESS, HEX, *[c.pattern for c in classes]]
    df_all = df.withColumn(text, whole(text_col))
    df_all = df_all.withColumns({
        f: F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)) for f, p in zip(found, patterns)
    })
    df_all = df_all.withColumns({
        a: _starts(F.col(text), p, F.col(f)) for a, f, p in zip(at, found, patterns)
    })
    enough = (
        lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_VALUE,
        lambda m: F.length(m) >= ACCESS_LENGTH,
        lambda m: F.lit(True),
    )
    parts = [_fixed_spans(k, F.col(found[k]), F.col(at[k]), enough[k]) for k in range(3)]
    harmless = _one_of(allow)
    for k, cls in enumerate(classes, 3):
        odd = F.filter(F.arrays_zip(F.col(found[k]).alias("text"), F.col(at[k]).alias("start")), _odd(harmless, cls.needs))
        parts.append(F.flatten(F.transform(odd, _scan(k, cls, harmless))))
    spans = F.array_sort(F.concat(*parts))
    return df_all.select(*[F.col(c) for c in df.columns], spans.alias(out))


def span_text(spans: Column, classes=CLASSES) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in (*KINDS, *[c.kind for c in classes])])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
