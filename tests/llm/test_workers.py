"""What Python workers keep when a task is over."""

from spanlens.llm import common, fertility, packing
from spanlens.llm.common import frugal
from spanlens.llm.pieces import Vocabulary, model_path


def _run(module, step=iter):
    return list(frugal(step, module)([1, 2, 3]))


def test_a_step_of_another_module_finds_nothing_remembered():
    path, words = model_path(), ["▁some", "▁unlikelywords", "▁some"]
    assert _run("spanlens.llm.fertility") == [1, 2, 3]
    first = fertility._encoded(path, words)
    packing.token_lengths(["a few words"], path)
    assert fertility._ids[path] and packing._known[path] and Vocabulary.at(path) is Vocabulary.at(path)
    _run("spanlens.llm.fertility")
    assert fertility._ids[path]
    _run("spanlens.llm.near_simhash")
    assert not any(common._remembered) and len(common._remembered) >= 3
    assert fertility._encoded(path, words) == first
    assert [list(memoryview(x).cast("i")) for x in first] == Vocabulary.at(path).encode(words)


def test_free_memory_is_handed_back_when_a_task_ends(monkeypatch):
    seen = []
    monkeypatch.setattr(common, "hand_back", lambda: seen.append("back"))

    def step(batches):
        for b in batches:
            seen.append(b)
            yield b

    assert _run("any", step) == [1, 2, 3] and seen == [1, 2, 3, "back"]


def test_workers_forget_between_operators(spark):
    """In Spark's workers, too: a step after the quality rules finds none of their pre-tokens."""
    import pyarrow as pa

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").coalesce(1)
    assert fertility.keep_good(docs).count()

    def step(batches):
        for b in batches:
            held = sum(map(len, fertility._ids.values())) + sum(map(len, packing._known.values()))
            yield pa.record_batch([pa.array([held] * b.num_rows, pa.int64())], ["held"])

    found = common.map_arrow(docs.select("doc_id"), step, "held long").repartition(1)
    assert {r.held for r in found.distinct().collect()} == {0}
