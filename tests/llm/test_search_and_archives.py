import base64
import hashlib
import io
import zlib

import numpy as np
import pytest

from litforge.llm import ann, warc


def test_hilbert():
    g = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = ann.hilbert_keys(g, 3)
    assert sorted(key.tolist()) == list(range(512)) and (np.abs(np.diff(g[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_nearest(spark, folder):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 16)).astype(np.float32)
    x[100:140] = x[100]  # ties
    bad = [(9000, None), (9020, []), (9040, [0.0] * 16), (9060, [float("nan")] + [1.0] * 15), (9080, [None] + [1.0] * 15), (9100, [1.0] * 3), (None, [1.0] * 16)]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + bad
    got = ann.op5_nearest(spark, folder(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6), "embeddings")).toPandas()
    y, hits = x.astype(float), 0
    queries = range(0, 3000, 20)
    assert set(got["query_id"]) == set(queries)
    for q in queries:
        score = (y * y[q]).sum(axis=1)
        score[q] = -np.inf
        best = np.lexsort((np.arange(3000), -score))[:20]
        mine = got[got["query_id"] == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and (mine["vec_id"] != q).all()
        assert np.array_equal(score[mine["vec_id"]], mine["score"]) and (np.diff(mine["score"]) <= 0).all()
        hits += len(set(best) & set(mine["vec_id"]))
    assert hits >= 0.9 * 20 * len(queries)
    ties = got[got["query_id"] == 100].sort_values("rank")["vec_id"].tolist()
    assert ties == list(range(101, 121))


def test_hot_block_and_repeated_ids(spark, monkeypatch):
    """Half of all vectors are one, so one block holds them and is split; ids repeat; names clash."""
    monkeypatch.setattr(ann, "TASK_ROWS", 100)
    rng = np.random.default_rng(6)
    x = rng.standard_normal((1200, 8)).astype(np.float32)
    x[::2] = x[0]
    rows = [(i, v.tolist(), 0.5, 1) for i, v in enumerate(x)] + [(7, x[900].tolist(), 0.5, 1), (40, x[41].tolist(), 0.5, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double, rank int").repartition(5)
    got = ann.nearest(frame, curves=4, blocks=1).toPandas()
    ids, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    for q in range(0, 1200, 20):
        best = {}
        for a in np.flatnonzero(ids == q):
            for i, s in zip(ids.tolist(), (y * y[a]).sum(axis=1).tolist(), strict=True):
                if i != q:
                    best[i] = max(s, best.get(i, s))
        want = sorted(best, key=lambda i: (-best[i], i))[:20]
        mine = got[got["query_id"] == q].sort_values("rank")
        assert mine["vec_id"].tolist() == want and mine["score"].tolist() == [best[i] for i in want]


def test_few_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r)[:3] for r in ann.nearest(few).orderBy("rank").collect()] == [(0, 1, 2), (0, 2, 1)]
    assert ann.nearest(few.limit(0)).count() == 0


def test_archives(spark, folder):
    rows = [(5, "http://a/x", "same"), (3, "http://b", "same"), (7, None, None), (6, "http://c", ""), (9, "http://d", "é" * 100_000), (3, "http://b", "same"), (None, "http://e", "same"), (None, "u", "alone")]
    d = folder(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), "pages")
    got = warc.op10_warc(spark, d).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id in (3, 5):
            assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == 3 else ("revisit", 3))
        if r.page_id in (6, 7):
            assert (r.record_type, r.refers_to, r.payload_bytes) == (("response", None, 0) if r.page_id == 6 else ("revisit", 6, 0))
        if r.page_id == 9:
            assert r.payload_bytes == 200_000 and r.payload_digest == base64.b32encode(hashlib.sha1(("é" * 100_000).encode()).digest()).decode()
    assert sorted((r.record_type, r.refers_to or 0) for r in got if r.page_id is None) == [("response", 0), ("revisit", 3)]
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(empty)).count() == 0
    back = warc.read_archives(warc.write_archives(spark.createDataFrame(rows[:1], "page_id long, url string, html string")), payload=True).first()
    assert bytes(back.payload) == b"same" and back.url == "http://a/x"


def test_archives_with_shuffled_firsts(spark, folder, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", 0)
    rows = [(i, "u", f"text {i % 90 if i % 3 else 0}", "x") for i in range(600)]
    d = folder(spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3), "pages")
    first = {}
    for i, _, html, _ in rows:
        first.setdefault(html, i)
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.op10_warc(spark, d).collect()}
    assert got == {i: ("response", None) if first[h] == i else ("revisit", first[h]) for i, _, h, _ in rows}


def test_damaged_archives():
    good = warc.record(1, "http://a", b"payload") + warc.record(2, "http://b", b"payload", 1)
    records = [warc.read_record(m) for m in warc.members(io.BytesIO(good))]
    assert [(r["key"], r["record_type"], r["refers_to"]) for r in records] == [(1, "response", None), (2, "revisit", 1)]
    with pytest.raises(warc.WarcError):
        list(warc.members(io.BytesIO(good[:-5])))
    plain = zlib.decompress(warc.record(1, "http://a", b"payload"), 31)
    with pytest.raises(warc.WarcError):
        warc.read_record(plain.replace(b"payload\r\n\r\n", b"poyload\r\n\r\n"))
    with pytest.raises(warc.WarcError):
        warc.parse(plain[:-1])
