"""Call stacks: text and array forms, frame parsing and trimming."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import STACK_SEPARATOR
from .arith import col

# Path parts that mark a library frame, and the file name of evaluated source.
LIBRARY_PARTS = ("/gevent/", "/greenlet")
EVALUATED = "<string>"


def split_stack(text) -> Column:
    """Leaf-first frames of a joined stack; an empty text has none."""
    c = col(text)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, STACK_SEPARATOR))


def join_stack(frames) -> Column:
    return F.array_join(col(frames), STACK_SEPARATOR)


def cap_frames(frames, limit: int) -> Column:
    """The first ``limit`` frames."""
    return F.slice(col(frames), 1, limit)


def frame_path(frame) -> Column:
    return F.split_part(col(frame), F.lit(":"), F.lit(1))


def is_library(path) -> Column:
    return F.contains(path, F.lit(LIBRARY_PARTS[0])) | F.contains(path, F.lit(LIBRARY_PARTS[1]))


def parse_frame(frame) -> Column:
    """``path:qualname:line`` as STRUCT<path, file, qual, line, lib>; the qualname may itself hold colons."""
    parts = F.split(col(frame), ":")
    n = F.size(parts)
    path = F.get(parts, F.lit(0))
    base = F.substring_index(path, "/", -1)
    middle = F.array_join(F.slice(parts, F.lit(2), F.greatest(n - 2, F.lit(0))), ":")
    return F.struct(
        path.alias("path"),
        F.when(base == "", path).otherwise(base).alias("file"),
        F.when(n >= 3, middle).otherwise(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("qual"),
        F.when(n >= 3, F.get(parts, n - 1)).otherwise("").alias("line"),
        is_library(path).alias("lib"),
    )


def parse_frames(frames) -> Column:
    return F.transform(col(frames), parse_frame)


def _is_tracer(path, tracer_file):
    own = path == EVALUATED
    return own | F.contains(path, F.lit(tracer_file)) if tracer_file else own


def leaf_function(frames, tracer_file: str | None = None) -> Column:
    """``file:qualname:line`` of the first application frame, else an empty string.

    ``tracer_file`` names the tracing hook's own source file, whose frames are skipped.
    """
    app = F.filter(
        col(frames),
        lambda f: ~_is_tracer(frame_path(f), tracer_file) & ~is_library(frame_path(f)),
    )
    first = F.get(app, F.lit(0))
    path = frame_path(first)
    rest = F.substring(first, F.length(path) + 1, F.length(first))
    return F.coalesce(F.concat(F.substring_index(path, "/", -1), rest), F.lit(""))


def clean_stack(frames, tracer_file: str | None = None) -> Column:
    """The frames that are neither evaluated source nor the tracing hook's own."""
    return F.filter(col(frames), lambda f: ~_is_tracer(frame_path(f), tracer_file))


def shown_frames(stack, func) -> Column:
    """Frames to show: those of the stack, else the function label alone, else none."""
    none = F.array().cast("array<string>")
    leaf = F.when(col(func) == "", none).otherwise(F.array(col(func)))
    return F.when(col(stack) == "", leaf).otherwise(F.split(col(stack), STACK_SEPARATOR))


def short_stack(stack, func, limit: int) -> Column:
    """STRUCT<frames, hidden>: up to ``limit`` application frames (all frames if there are none)."""
    every = shown_frames(stack, func)
    app = F.filter(every, lambda f: ~is_library(frame_path(f)))
    pick = F.when(F.size(app) > 0, app).otherwise(every)
    return F.struct(
        F.slice(pick, 1, limit).alias("frames"),
        F.greatest(F.size(pick) - limit, F.lit(0)).alias("hidden"),
    )
