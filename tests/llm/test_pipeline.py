"""The pipeline against plain versions of its stages, each on its own input."""

import array
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from test_dedup import brute_groups
from test_filters import brute_quality, brute_score
from test_tokens import check_packing
from tokenizers import Tokenizer

import corpus_pipeline
from litforge.llm import quality, toxicity

rng = random.Random(11)
VOCAB = [a + b + c for a in "bcdfglmnprst" for b in ("al", "er", "in", "ot", "us", "em") for c in ("", "a", "io", "ent")]


def text(n):
    return " ".join(rng.choices(VOCAB, k=n))


def corpus():
    rows, labels = [], []
    for i in range(420):
        w = text(rng.randint(60, 140)).split(" ")
        if toxic := i % 6 == 0:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["zugga", "ZUGGOT", "zuggi!", "krokka", "zugg0"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    passage = text(70)
    for i in range(12):  # near and exact copies
        w = rows[5 * i + 1][1].split(" ")
        if i % 3:
            w[i] = "changed"
        rows.append((500 + i, " ".join(w)))
    rows += [(600 + i, f"{text(60)} {passage} {text(50)}") for i in range(6)]
    rows += [(700, None), (701, ""), (702, "too short"), (703, "## %% ** " * 40 + text(60)), (704, "one line here\n" * 12 + text(60)), (705, text(4000)), (706, rows[3][1]), (706, rows[3][1])]
    return rows, labels


def sound(t):
    words, chars, symbols, dup, _, base = brute_quality(t)
    lines = sum(1 for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r"))
    return not base and 100 * symbols <= 5 * chars and not (lines >= 4 and 100 * dup > 35 * lines) and 2 * words <= chars <= 15 * words


def cut(rows, length=200):
    """Texts without the bytes of strings of this length that start twice."""
    data = [(t or "").encode() for _, t in rows]
    count = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for (doc, _), b in zip(rows, data, strict=True):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append((doc, bytes(np.frombuffer(b, np.uint8)[~gone]).decode("utf-8", "ignore")))
    return out


def test_every_stage_like_brute_force(spark, documents, folder):
    rows, labels = corpus()
    d = folder(documents(rows).repartition(5), "documents")
    folder(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), "labels")
    docs = corpus_pipeline.table(spark, d, "documents")
    columns = docs.columns
    lexicon, curve = toxicity.learn(docs, corpus_pipeline.table(spark, d, "labels"))
    clean = lambda t: 1 / (1 + math.exp(-sum(a * b for a, b in zip(brute_score(t, lexicon, toxicity.EXCEPTIONS), curve, strict=True)))) < toxicity.THRESHOLD
    want = [r for r in rows if clean(r[1])]
    assert 330 < len(want) < len(rows) - 40
    stages = dict(corpus_pipeline.STAGES)
    key = lambda r: (r[0], r[1] or "")

    def step(name, docs, want):
        out = corpus_pipeline.materialize(stages[name](spark, docs, d), "test")
        assert out.columns == columns
        got = sorted(((r.doc_id, r.text) for r in out.collect()), key=key)
        assert got == sorted(want, key=key), name
        return out

    docs = step("toxicity", docs, want)
    want = [r for r in want if sound(r[1])]
    assert quality.host_verdicts(quality.measure(docs.selectExpr("source AS host", "text"))).filter("NOT host_ok").count() == 0
    docs = step("quality rules", docs, want)
    least = brute_groups(sorted(set(want)))
    want = sorted({r for r in want if least[r[0]][1] == r[0]})
    docs = step("n-gram Jaccard join", docs, want)
    want = cut(want)
    step("suffix-array dedup", docs, want)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = corpus_pipeline.run(spark, d).collect()
    n, least_n = check_packing(packed, want, library)
    assert n <= least_n + 1 and {r.doc_id for r in packed} == {i for i, _ in want}
    ids = library.encode(want[0][1], add_special_tokens=False).ids + [0]
    assert next(r.ids_crc32 for r in packed if r.doc_id == want[0][0] and r.piece == 0) == zlib.crc32(array.array("I", ids).tobytes())


def test_nothing_in(spark, documents, folder):
    d = folder(documents([]), "documents")
    folder(spark.createDataFrame([], "doc_id long, quality int, toxic int"), "labels")
    assert corpus_pipeline.run(spark, d).count() == 0
