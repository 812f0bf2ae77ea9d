"""Segmentation, chats and archives: round trips, distributions, SQL, edge cases."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veristry.llm import chat_format, segmentation, warc
from veristry.llm.words import mix, raw


@pytest.fixture(scope="module")
def vocabulary():
    return segmentation.load(segmentation.model_path())


def sample(v, texts, keys, k):
    data, offsets = raw(pa.array(texts, pa.string()))
    return segmentation.sample_slice(v, data, offsets, np.array(keys, np.uint64), k)


def test_round_trip_and_distinct(vocabulary):
    @settings(max_examples=60, deadline=None)
    @given(st.lists(st.text(st.characters(codec="utf-8"), max_size=30), min_size=1, max_size=4))
    def check(texts):
        for text, found in zip(texts, sample(vocabulary, texts, range(len(texts)), 3), strict=True):
            assert all(segmentation.decode_ids(vocabulary.pieces, ids.tolist()) == text for ids, _, _ in found)
            assert len({tuple(ids) for ids, _, _ in found}) == len(found) >= 1
            assert all(0 <= inc <= 1 and lp <= 1e-9 for _, lp, inc in found)

    check()


def test_samples_follow_the_lattice(vocabulary):
    v, text = vocabulary, b" the"

    def every(rest):
        if not rest:
            yield ()
        for i in v.ids:
            if rest.startswith(v.pieces[i]):
                for more in every(rest[len(v.pieces[i]) :]):
                    yield (int(i), *more)

    paths = list(every(text))
    weight = np.exp([v.log_weight[list(p)].sum() for p in paths])
    p = dict(zip(paths, weight / weight.sum(), strict=True))
    n = 6000
    got = sample(v, ["the"] * n, mix(np.arange(n, dtype=np.uint64)), 2)
    first = collections.Counter(tuple(r[0][0].tolist()) for r in got)
    second = collections.Counter(tuple(r[1][0].tolist()) for r in got)
    for path in sorted(p, key=p.get)[-4:]:
        assert first[path] / n == pytest.approx(p[path], abs=0.03)
        after = sum(p[a] * p[path] / (1 - p[a]) for a in p if a != path)
        assert second[path] / n == pytest.approx(after, abs=0.03)


def test_inclusion_scores_make_samples_unbiased(vocabulary):
    """Over many keys, the drawn segmentations' probabilities over their inclusion scores add up to 1, as do each one's own."""
    n, text = 8000, "abc d"
    got = sample(vocabulary, [text] * n, mix(np.arange(n, dtype=np.uint64)), 2)
    total, own = 0.0, collections.Counter()
    for found in got:
        for ids, log_p, inclusion in found:
            total += np.exp(log_p) / inclusion
            own[tuple(ids.tolist())] += 1 / inclusion
    assert total / n == pytest.approx(1, abs=0.03)
    p = {tuple(ids.tolist()): np.exp(lp) for found in got for ids, lp, _ in found}
    for path in sorted(p, key=p.get)[-3:]:
        assert own[path] / n == pytest.approx(1, abs=4 / (n * p[path]) ** 0.5)  # four standard errors


def unspaced(n, seed=3):
    rng = random.Random(seed)
    return "".join(rng.choice(["the", "of", "an", "ing", "é", "x", "q1", "ation"]) for _ in range(n))


def cjk(n, seed=4):
    rng = random.Random(seed)
    return "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(n))


@pytest.mark.parametrize("text", [unspaced(900), cjk(900), "a" * 1500, "ab" * 3000, "é" * 700 + unspaced(300), "x" * 513, cjk(171) + "y", unspaced(400) + " " + unspaced(700)])
@pytest.mark.parametrize("ahead", [8, 128])
def test_long_units_have_the_lattice_of_short_ones(vocabulary, monkeypatch, text, ahead):
    """Sums in blocks give every edge the probability that one pass from the unit's end gives it, however far they have to look."""
    data, offsets = raw(pa.array([text]))
    put, begin, end, _ = segmentation.cut_units(data, offsets)
    monkeypatch.setattr(segmentation, "AHEAD", ahead)
    lat = segmentation.Lattice(vocabulary, put, begin, end)
    monkeypatch.setattr(segmentation, "LONG", 1 << 30)
    plain = segmentation.Lattice(vocabulary, put, begin, end)
    assert lat.long.any() and not plain.long.any()
    a, b = (np.lexsort((x.piece, x.step, x.start)) for x in (lat, plain))
    assert (lat.start[a] == plain.start[b]).all() and (lat.piece[a] == plain.piece[b]).all()
    assert lat.p[a] == pytest.approx(plain.p[b], abs=1e-9)


def test_long_units_are_sampled_as_short_ones(vocabulary, monkeypatch):
    """Each cut of a short unit occurs as often when its draws go by place."""
    v, n, text = vocabulary, 4000, "another"
    keys = mix(np.arange(n, dtype=np.uint64))
    plain = collections.Counter(tuple(r[0][0].tolist()) for r in sample(v, [text] * n, keys, 2))
    monkeypatch.setattr(segmentation, "LONG", 2)
    found = sample(v, [text] * n, keys, 2)
    own = collections.Counter(tuple(r[0][0].tolist()) for r in found)
    assert all(own[p] / n == pytest.approx(plain[p] / n, abs=0.035) for p in set(own) | set(plain))
    assert all(len({tuple(i.tolist()) for i, _, _ in r}) == len(r) for r in found)


@pytest.mark.parametrize("text", [unspaced(3000), cjk(4000), unspaced(800) + "\n" + cjk(500) + " plain words"])
def test_texts_without_spaces_round_trip(vocabulary, text):
    alone = sample(vocabulary, [text], [5], 3)[0]
    assert len({tuple(i.tolist()) for i, _, _ in alone}) == len(alone) == (1 if text == cjk(4000) else 3)  # most of these characters are no pieces
    assert all(segmentation.decode_ids(vocabulary.pieces, i.tolist()) == text for i, _, _ in alone)
    beside = sample(vocabulary, ["before", text, cjk(900, 8)], [1, 5, 6], 3)[1]
    assert [i.tolist() for i, _, _ in alone] == [i.tolist() for i, _, _ in beside]


def test_draws_do_not_depend_on_neighbours(vocabulary):
    alone = sample(vocabulary, ["some words here"], [9], 2)[0]
    among = sample(vocabulary, ["x y", "some words here", ""], [1, 9, 2], 2)[1]
    assert [a[0].tolist() for a in alone] == [b[0].tolist() for b in among]


def test_encode_and_decode_tables(spark, frame, vocabulary):
    rows = [(1, None), (2, ""), (3, " a  b\n"), (None, "ﬁ▁日本"), (4, "word " * 200000), (3, " a  b\n")]
    named = frame([(*r, 1, "x") for r in rows], "doc_id long, text string, sample int, decoded string")  # other columns, named like results
    out = segmentation.decode(segmentation.encode(named, vocabulary, k=3), vocabulary).collect()
    by = collections.defaultdict(set)
    for r in out:
        by[r.doc_id].add((r.ids is None, r.decoded))
    assert by[1] == {(True, None)} and by[2] == {(False, "")} and by[3] == {(False, " a  b\n")} and by[4] == {(False, rows[4][1])}
    assert sum(r.doc_id == 3 for r in out) == 6 and {r.sample for r in out if r.doc_id == 4} == {1, 2, 3}
    assert segmentation.encode(frame([], "doc_id long, text string"), vocabulary).count() == 0


CHATS = [
    (1, 0, "user", "Hello there.\n\nSecond paragraph here\nwith two lines."), (1, 1, "assistant", "> Hello there.\nHi!"), (1, 2, "user", "On Monday X wrote:\n> > Hello there.\n> Hi!\n\nok then"),
    (1, 3, "bob", "> second  Paragraph here\n> with two lines.\nI agree"), (1, 4, None, "> ok then\n\nfine"), (1, 5, "x", None), (1, 6, "x", "> never said\n>\nme"), (2, 0, "u", "> Hello there.\nnew"), (None, 1, "u", "> Hello there."), (1, 4, None, "> ok then\n\nfine"),
    *[(3, i, "u", f"> m{i - 1}\nm{i}" if i else "m0") for i in range(12)],
    (4, 0, "a", "a long first message that says a great deal"), (4, 1, "b", "> a long first message that says a great deal\nshort"), (4, 2, "a", "> > a long first message that says a great deal\n> short\nthird"),
    (4, 3, "c", "> > > a long first message that says a great deal\n> > unheard of\n> never said either\nfourth"), (4, 4, "d", "> third\n> short\nfifth"), (4, 5, "e", ">> third\n> fourth\nsixth"),
]


def test_quotes_are_linked_and_left_out(spark, tmp_path):
    import duckdb

    spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = chat_format.op9(spark, str(tmp_path)).collect()
    by = {(r.conv_id, r.turn): r for r in got}
    assert len(got) == len(CHATS) and by[1, 2].content == "ok then" and by[1, 3].parent_turn == 0 and by[1, 6].n_linked == 0
    place = lambda *at: (by[at].parent_turn, by[at].thread_turn, by[at].depth, by[at].n_linked)
    assert place(1, 4) == (2, 0, 3, 1) and place(3, 11) == (10, 0, 11, 1)
    # nested quotes: the lowest level that is found anywhere has the parent, however short it is
    assert [place(4, k) for k in range(6)] == [(None, 0, 0, 0), (0, 0, 1, 1), (1, 0, 2, 2), (0, 0, 1, 1), (2, 0, 3, 2), (3, 0, 2, 2)]
    assert by[3, 11].depth == 11 and by[1, 5].formatted == "<|x|>\n<|end|>\n" and by[1, 4].role == "unknown"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(chat_format.OP9_SQL).fetchall()
    names = [d[0] for d in con.description]
    assert sorted((tuple(str(r[n]) for n in names) for r in got)) == sorted(tuple(str(x) for x in w) for w in want)


def test_chats_run_without_python(spark):
    plan = chat_format.op9(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert chat_format.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_deep_threads_hot_conversations_and_other_columns(spark):
    """A thread of 300 replies; a message that 300 others answer; very long texts; columns named like results."""
    rows = [(1, i, "u", f"> n{i - 1}\nn{i}" if i else "n0") for i in range(300)] + [(2, i, "u", f"> start\nr{i}" if i else "start") for i in range(300)]
    rows += [(3, 0, "u", "long line\n" * 30000 + "end"), (3, 1, "u", "> end\n" + "> long line\n" * 30000 + "yes")]
    frame = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, depth int, body string, passages string")
    by = {(r.conv_id, r.turn): r for r in chat_format.format_chats(frame).collect()}
    assert len(by) == len(rows) and all(by[1, i].depth == i and by[1, i].thread_turn == 0 for i in range(300))
    assert all(by[2, i].parent_turn == 0 and by[2, i].depth == 1 for i in range(1, 300)) and by[3, 1].content == "yes" and by[3, 1].parent_turn == 0


def test_archives_and_their_index(spark):
    big = "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 20
    rows = [(5, "http://www.B.org/x", big), (2, "https://b.org/x", big), (9, "http://a.org/", big + "!"), (7, None, None), (8, "bad url\n", "short"), (6, "http://[x", "short"), (None, "http://b.org/x", big), (2, "https://b.org/x", big)]
    out = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("merged_part", "merged_pos").collect()
    keys = [warc._order(r.asDict()) for r in out]
    assert keys == sorted(keys) and len(out) == len(rows)
    by = {r.page_id: r for r in out}
    assert by[5].record_type == "revisit" and by[5].refers_to == 2 and by[None].refers_to == 2 and by[2].record_type == "response" and by[9].record_type == "response" and by[6].record_type == by[8].record_type == "response"
    for i, _, html in rows:
        assert by[i].payload_bytes == len((html or "").encode()) and by[i].payload_digest == hashlib.sha256((html or "").encode()).hexdigest()
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_records_are_found_by_their_offsets(spark):
    from pathlib import Path

    rows = [(i, f"http://h{i % 7}.org/p", "é payload " * (i % 40) + str(i // 3), "x", -1) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, original string, merged_pos int")
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/plain-warc"
    warc.write_archives(pages, folder, compression="none")
    files = {p.name: p.read_bytes() for p in Path(folder.removeprefix("file:")).iterdir()}
    html, out = {r[0]: r[2].encode() for r in rows}, warc.capture_index(spark, folder).collect()
    assert len(out) == 300
    for r in out:
        record = files[r.run][r.record_offset : r.record_offset + r.record_length]
        assert record.startswith(b"WARC/1.1\r\n") and f"X-Page: {r.page_id}\r\n".encode() in record
        assert record.endswith(html[r.page_id]) if r.record_type == "response" else record.endswith(b"\r\n\r\n")


def test_hot_payloads_and_small_merges(spark, monkeypatch):
    """A third of all pages are copies; archives and merges are cut small."""
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    monkeypatch.setattr(warc, "MERGE_ROWS", 40)
    rows = [(i, f"http://h.org/{i % 5}", "copy " * 50 if i % 3 == 0 else f"own {i} " * (30 if i != 7 else 300_000)) for i in range(600)]
    out = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("merged_part", "merged_pos").collect()
    keys = [warc._order(r.asDict()) for r in out]
    assert keys == sorted(keys) and len(out) == 600 and len({r.merged_part for r in out}) > 4 and len({r.run for r in out}) > 4
    assert {r.page_id for r in out if r.record_type == "revisit"} == set(range(3, 600, 3)) and {r.refers_to for r in out} == {None, 0}
    assert {r.payload_bytes for r in out if r.page_id == 7} == {len("own 7 ") * 300_000}


def test_loser_tree_merges():
    rng = random.Random(1)
    for k in range(20):
        runs = [sorted(rng.randrange(30) for _ in range(rng.randrange(20))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)


def test_url_keys():
    assert warc.url_key("https://www.A.b.org/X?q=1#z") == "org,b,a)/x?q=1" and warc.url_key(None) == ""


def test_same_as_sql_at_the_smallest_size(same_as_sql):
    same_as_sql(chat_format.op9, chat_format.OP9_SQL)
    same_as_sql(warc.op10, warc.OP10_SQL)


def test_registered_segmentation_decodes_every_sample(spark):
    text = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    out = segmentation.op8(spark, "/root/testdata/sf0.001").select("doc_id", "decoded").collect()
    assert {r.doc_id for r in out} == set(text) and all(r.decoded == text[r.doc_id] for r in out)


def test_encode_with_texts_is_decode(frame, vocabulary):
    rows = [(1, "  two  spaces"), (2, ""), (3, None), (4, " x"), (5, "\u00e9\U0001f600\x00 end "), (6, "\u2581a")]
    out = segmentation.encode(frame(rows, "doc_id long, text string"), vocabulary, decoded=True)
    again = segmentation.decode(out.drop("decoded"), vocabulary)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, again.collect()), key=str)
