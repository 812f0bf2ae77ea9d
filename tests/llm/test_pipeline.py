"""The pipeline's stages against brute force, each on its own input."""

from test_joins import brute_components, brute_hits, brute_windows, shingles

import corpus_pipeline
from veristry.llm import segmentation

AT = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{AT}/documents.parquet").unionByName(spark.createDataFrame([(900001, "!!", None, "s", 2), (900002, None, None, "s", 0)], "doc_id long, text string, lang string, source string, n_chars long"))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{AT}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "ngram_join", "substring_dedup", "decontamination", "sentencepiece"]
    step = lambda name, df: stages[name](spark, df, AT)

    known = step("language_id", docs)
    assert known.columns == docs.columns and known.where("doc_id >= 900001").count() == 0 and known.count() == docs.count() - 2

    texts = {r.doc_id: r.text for r in known.collect()}
    sets = {i: shingles(t) for i, t in texts.items()}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = brute_components(links, ids)
    single = step("ngram_join", known)
    assert {r.doc_id for r in single.collect()} == {i for i in ids if root[i] == i} and single.columns == docs.columns

    want = brute_windows([(r.doc_id, r.text) for r in single.collect()])
    cut = step("substring_dedup", single)
    got = {r.doc_id: r for r in cut.collect()}
    assert set(got) == {i for i, (n, gone, _) in want.items() if not gone or gone < n} and cut.columns == docs.columns
    assert all(r.text == (want[i][2] if want[i][1] else texts[i]) and r.n_chars == len(r.text) for i, r in got.items())

    clean = step("decontamination", cut)
    dirty = {i for i, r in got.items() for n, h, _ in [brute_hits(r.text, items)] if h and 20 * h >= n}
    assert dirty and {r.doc_id for r in clean.collect()} == set(got) - dirty and clean.columns == docs.columns

    v = segmentation.load(segmentation.model_path())
    out = segmentation.decode(step("sentencepiece", clean), v).collect()
    assert all(r.decoded == got[r.doc_id].text for r in out) and {r.doc_id for r in out} == set(got) - dirty


def test_run_gives_the_same_as_its_stages(spark):
    docs = spark.read.parquet(f"{AT}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, AT)
    a, b = ({(r.doc_id, r["sample"], tuple(r.ids)) for r in df.collect()} for df in (docs, corpus_pipeline.run(spark, AT)))
    assert a == b
