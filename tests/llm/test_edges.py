"""Empty tables and repeated rows through the operators that judge row by row."""

from veristry.llm import decontamination, language_id, quality, segmentation, toxicity

SCHEMA = "doc_id long, text string, score double"
ROWS = [(1, "the same words of one text", 0.1), (1, "the same words of one text", 0.2), (2, None, 0.3), (3, "", 0.4)]


def test_empty_tables(frame):
    docs = frame([], SCHEMA)
    items = frame([(1, "the same words")], "item_id long, text string")
    assert language_id.identify(docs, None).count() == 0
    assert toxicity.score_toxicity(docs, None).count() == 0
    assert quality.score_quality(docs, None).count() == 0
    assert decontamination.find_contamination(docs, items).count() == 0
    assert segmentation.encode(docs, segmentation.load(segmentation.model_path())).count() == 0


def test_repeated_rows_get_the_same(spark, frame):
    at = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    rows = frame(ROWS, SCHEMA)
    language = language_id.train(docs)
    for out in (language_id.identify(rows, language), toxicity.score_toxicity(rows, toxicity.train(docs, labels, language=language)), quality.score_quality(rows, quality.train(docs, labels))):
        found = [r for r in out.collect() if r.doc_id == 1]
        assert len(found) == 2 and found[0].score == found[1].score and 0 <= found[0].score <= 1
    out = decontamination.find_contamination(rows, frame([(1, "same words"), (1, "same words"), (2, "one")], "item_id long, text string")).collect()
    assert [(r.n_hit, r.item_ids) for r in out if r.doc_id == 1] == [(3, ["1", "2"])] * 2
