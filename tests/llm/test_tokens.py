import array
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from litforge.llm import bpe, packing

TEXTS = [
    "Hello  WORLD's 123 été <|endoftext|>x", None, "", " ", "İstanbul ΑΣ ΣΑΣ é ½ ²3 ​ 　x ﬁ", "don't I'Ll 's'T", "a" * 3000, "word " * 5000, "Ab\ncd\n\nef  gh\t ij", "<|startoftext|>", "thingthe of the\nanother line here",
    "dup", "dup", "日本語 テキスト 🎉🎉", "x́y 'S",
]


@pytest.fixture(scope="module")
def libraries():
    return {n: Tokenizer.from_file(public_tokenizers.path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json")}


def test_bpe_like_the_library(spark, documents, folder, libraries):
    d = folder(documents(list(enumerate(TEXTS))), "documents")
    got = {r.doc_id: r for r in bpe.op2_bpe(spark, d).collect()}
    t = libraries["word_bpe_49k.json"]
    for i, text in enumerate(TEXTS):
        ids = t.encode(text or "", add_special_tokens=False).ids
        decoded = t.decode(ids, skip_special_tokens=False)
        assert got[i].n_tokens == len(ids), text
        assert got[i].ids_sha256 == hashlib.sha256(array.array("I", ids).tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    rows = bpe.encode_table(documents([(1, "the thing")])).collect()
    assert rows[0].ids == t.encode("the thing", add_special_tokens=False).ids


def test_every_code_point_like_the_library(libraries):
    t, mine = libraries["word_bpe_49k.json"], bpe.WordBpe(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(2)
    points = [*range(0x3100), *(rng.randrange(0x3100, 0x110000) for _ in range(6000)), 0x088F, 0x1C89, 0xA7CB, 0x1F130]
    for c in points:
        if not 0xD800 <= c < 0xE000:
            text = f"a{chr(c)}b {chr(c)}"
            assert mine.encode(text) == t.encode(text, add_special_tokens=False).ids, hex(c)


def test_bpe_empty_table(spark, documents):
    assert bpe.encode_table(documents([])).count() == 0


def check_packing(rows, texts, library, capacity=2048):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    total = 0
    for i, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        mine, at = sorted(pieces[i], key=lambda r: r.piece), 0
        assert [r.piece for r in mine] == list(range(len(mine)))
        assert all(r.length == capacity for r in mine[1:]) and (len(mine) == 1 or len(ids) > capacity)
        for r in mine:
            assert r.start == at and r.ids_crc32 == zlib.crc32(array.array("I", ids[at : at + r.length]).tobytes())
            at += r.length
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(sequences), -(-total // capacity)


def test_packing(spark, documents, folder, libraries):
    rng = random.Random(1)
    texts = [*enumerate(TEXTS), *((100 + i, " ".join(rng.choices(["alpha", "beta", "gamma", "of"], k=rng.randint(1, 900)))) for i in range(60))]
    d = folder(documents(texts).repartition(4), "documents")
    n, least = check_packing(packing.op6_packing(spark, d).collect(), texts, libraries["byte_bpe_50k.json"])
    assert n <= least + 1


def test_packing_without_ids(spark, documents):
    rows = [(None, "some words"), (None, "some words"), (4, None), (4, None), (5, "word " * 30_000)]
    docs = documents(rows).selectExpr("*", "0 AS piece", "'x' AS sequence_id", "1 AS length")
    got = packing.pack(docs).collect()
    assert Counter(r.doc_id for r in got if r.piece == 0) == {None: 2, 4: 2, 5: 1}
    assert sum(r.length for r in got if r.doc_id == 5) > 30_000 and {r.length for r in got if r.doc_id == 4} == {1}


def test_packing_empty_and_levels(spark, documents, monkeypatch):
    assert packing.pack(documents([])).count() == 0
    monkeypatch.setattr(packing, "ITEMS", 10)
    rows = packing.pack(documents([(i, "word " * (5 + i % 40)) for i in range(200)]).repartition(8), 64).collect()
    assert len({(r.doc_id, r.piece) for r in rows}) == len(rows) and {r.doc_id for r in rows} == set(range(200))


def test_best_fit_is_tight():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 100, 2000)
    bins = packing.best_fit(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(2000))
    assert all(sizes[b].sum() <= 100 for b in bins) and len(bins) <= 1.02 * sizes.sum() / 100 + 1
    assert packing.best_fit(np.array([], int), 10) == []
    assert packing.cut(5000, 2048) == [(0, 904), (904, 2048), (2952, 2048)] and packing.cut(4096, 2048) == [(0, 2048), (2048, 2048)]
