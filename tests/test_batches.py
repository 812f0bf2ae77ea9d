"""Long texts are taken a bounded number of bytes at a time."""

import pyarrow as pa
from pyspark.sql import functions as F

from veristry.functions import patterns, urls
from veristry.functions.batches import slices
from veristry.operators import documents


def test_slices_are_bounded_and_whole():
    texts = ["a" * 10, None, "", "é" * 30, "b" * 5, "c" * 5, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], names=["i", "t"])
    got = [b.column(1).to_pylist() for b in slices(batch, 1, 12)]
    assert [t for b in got for t in b] == texts and all(len(b) == 1 or sum(len((t or "").encode()) for t in b) <= 12 for b in got) and len(got) == 3
    assert not list(slices(batch.slice(0, 0), 1))


def test_chunks_leave_in_several_batches():
    """A batch of 4 MB gave one batch of all its chunks."""
    text = "One two three four. " * 5000
    batch = pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64()), pa.array([text] * 40)], names=["doc_id", "text"])
    for cut in (documents.pack_sentences, documents.split_recursive):
        out = list(documents._chunker(cut)([batch]))
        assert len(out) > 3 and pa.Table.from_batches(out).to_pydict()["chunk"] == cut(text) * 40


def test_literals_of_a_batch_are_not_all_held_at_once(spark, monkeypatch):
    rows = spark.createDataFrame([(0, "an abc and abd"), (1, None), (2, "")], "i int, t string")
    found = patterns.found_literals(F.col("t"), ["abc", "abd", "zzz"])
    assert [r.f for r in rows.select("i", found.alias("f")).orderBy("i").collect()] == [[0, 1], [], []]
    assert "ArrowEvalPython" in rows.select(found)._jdf.queryExecution().executedPlan().toString()


def test_a_name_is_cut_up_once_for_all_candidates(spark):
    """The plan held the name's fifteen replacements once for each form."""
    df = spark.createDataFrame([("Lake Unified 5", "TX")], "name string, state string")
    out = df.select(urls.candidate_urls(F.col("name"), F.col("state")).alias("u"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("consolidated") <= 1 and "https://www.lake5isd.org" in out.first()["u"]
