"""Toxicity by a weighted lexicon.

Texts are folded (compatibility forms, case, look-alike letters, digits and
signs that stand for letters) and searched with an Aho-Corasick automaton for
the stems of a lexicon, which match where a word begins.  A hit inside an
exception phrase doesn't count.  The weights of the distinct words so found, as a
sum, at their largest and in proportion to the text's length, give a probability
by a logistic curve.

The lexicon is learned from labelled rows: stems and whole words that are far
more frequent in toxic rows, each weighted by its log odds, near copies counted
once.  It is learned from a sample of TRAIN_ROWS labelled rows at most (a
documented bound); seven tenths give the lexicon and the rest the curve.

Cases: null or empty text scores what a text without hits does; without labels
of both kinds every score is the smoothed share of label 1; texts are searched
whole, however long; repeated rows score alike; rows without a doc_id are never
learned from and have a null held_out; ``keep_clean`` keeps all columns, of any
names; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litforge.session import materialize, table

#: Production parameters.
TRAIN_ROWS = 30_000
THRESHOLD = 0.7
MIN_TOXIC = 4
MIN_WEIGHT = 2.0
STEM_LENGTHS = range(3, 11)
#: Measures of a text that the curve weighs.
MEASURES = 4
#: Benign phrases that contain words of a usual lexicon.
EXCEPTIONS = ("trash can", "trash cans", "trash bag", "trash bin", "clown fish", "clownfish", "idiot proof", "idiot-proof", "scum line")

#: Letters that look like Latin ones, and digits and signs that stand for letters.
LOOKALIKES = dict(zip("асеорхуіјѕһԁԛԝкмтвнгαβεηικμνορτυχωϲỿıłøđ", "aceopxyijshdqwkmtbhraβenikuvoptuxwcylłod", strict=False)) | {"β": "b", "ł": "l", "ı": "i", "ø": "o", "đ": "d", "ỿ": "y"}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i"}

_TABLE = {ord(k): v for k, v in LOOKALIKES.items()}
_SUBSTITUTES = {ord(k): v for k, v in SUBSTITUTES.items()}
_ODD = re.compile("[" + "".join(LOOKALIKES) + "]")
_HIDDEN = re.compile("[­​-‏⁠﻿]")
_DIGIT = re.compile(r"(?<=[^\W\d_])[01345789]+|[01345789]+(?=[^\W\d_])")
_SIGN = re.compile(r"(?<=[^\W_])[@$!](?=[^\W_])")
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    """Lower case, with disguises of letters undone."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        text = _HIDDEN.sub("", text)
    text = text.lower()
    if not text.isascii() and _ODD.search(text):
        text = text.translate(_TABLE)
    text = _DIGIT.sub(lambda m: m[0].translate(_SUBSTITUTES), text)
    return _SIGN.sub(lambda m: SUBSTITUTES[m[0]], text)


def features_of(word: str) -> Iterator[str]:
    """The stems of a word, and the word itself, which ends in a blank."""
    for n in STEM_LENGTHS:
        if n > len(word):
            break
        yield word[:n]
    yield word + " "


class Matcher:
    """Weighted stems (and whole words, which end in a blank) in one automaton with the exception phrases."""

    def __init__(self, lexicon: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
        self.automaton = ahocorasick.Automaton()
        self.size = len(lexicon)
        whole = {w.rstrip(): v for w, v in lexicon.items() if w.endswith(" ")}
        stems = {w: v for w, v in lexicon.items() if not w.endswith(" ")}
        for w in {*whole, *stems, *(fold(e) for e in exceptions)}:
            self.automaton.add_word(w, (w, stems.get(w), whole.get(w), w in {fold(e) for e in exceptions}))
        if len(self.automaton):
            self.automaton.make_automaton()

    def hits(self, text: str | None) -> tuple[dict[str, float], int]:
        """Weight of each distinct word of a text that begins with a hit, and the number of the text's words."""
        if not text:
            return {}, 0
        text = fold(text)
        best: dict[int, tuple[float, int]] = {}
        benign: list[tuple[int, int]] = []
        for last, (w, stem, whole, phrase) in self.automaton.iter(text) if self.size else ():
            first = last - len(w) + 1
            if first and text[first - 1].isalnum():
                continue
            ends = last + 1 >= len(text) or not text[last + 1].isalnum()
            if phrase and ends:
                benign.append((first, last))
            for value in (stem, whole if ends else None):
                if value is not None and (first not in best or len(w) >= best[first][1]):
                    best[first] = (value, len(w))
        found: dict[str, float] = {}
        for first, (value, n) in best.items():
            if not any(a <= first and first + n - 1 <= b for a, b in benign):
                word = _WORD.match(text, first)[0]
                found[word] = max(value, found.get(word, value))
        return found, text.count(" ") + 1

    def measures(self, text: str | None) -> tuple[float, ...]:
        """Constant; sum, largest and density of the distinct hits' weights."""
        found, words = self.hits(text)
        total = sum(found.values())
        return 1.0, math.log1p(max(total, 0.0)), max(found.values(), default=0.0), total / math.sqrt(10 + words)


def choose(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Weighted lexicon from the (toxic, clean) counts of features.

    Shorter stems come first; a longer one enters only if it is clearly surer
    than the stem that it begins with.  A stem is then drawn out as far as it
    keeps nearly all its toxic rows, so that it names its word and no more.
    """
    longer: dict[str, list[str]] = {}
    for w in counts:
        if not w.endswith(" "):
            longer.setdefault(w[:-1], []).append(w)
    lexicon: dict[str, float] = {}
    for w in sorted(counts, key=lambda w: (len(w), w)):
        pos, neg = counts[w]
        if pos < MIN_TOXIC:
            continue
        weight = math.log((pos + 0.5) / (toxic + 1)) - math.log((neg + 0.5) / (clean + 1))
        # A chance excess in few rows is no evidence: require it beyond three standard deviations.
        expected = (pos + neg) * toxic / (toxic + clean)
        if weight < MIN_WEIGHT or pos - expected < 3 * math.sqrt(expected + 1) or pos < 0.5 * (pos + neg):
            continue
        shorter = [lexicon[w[:n]] for n in STEM_LENGTHS if n < len(w) and w[:n] in lexicon]
        if not shorter or weight > max(shorter) + 1.0:
            lexicon[w] = weight
    drawn: dict[str, float] = {}
    for w, weight in lexicon.items():
        pos = counts[w][0]
        while more := [x for x in longer.get(w, ()) if counts[x][0] >= 0.95 * pos]:
            w = max(more, key=lambda x: (counts[x][0], x))
        drawn[w] = max(weight, drawn.get(w, weight))
    return drawn


def fit_curve(x: np.ndarray, y: np.ndarray, penalty: float = 0.1) -> np.ndarray:
    """Logistic regression by Newton's method with a small ridge."""
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (y - p) - penalty * b)
        b += step
        if np.abs(step).max() < 1e-6:
            break
    return b


def fold_of(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = TRAIN_ROWS) -> DataFrame:
    """``(doc_id, text, label)`` of a sample of labelled rows outside the held-out fold, at most ``limit``."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold_of(F.col("doc_id")) != 1))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return materialize(docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(known), "doc_id"), "toxicity-sample")


def _mark(text: str) -> int:
    """Smallest hash of the text's five-word runs: near copies mostly share it."""
    words = text.split()
    return min(hash_ for hash_ in (zlib.crc32(" ".join(words[i : i + 5]).encode()) for i in range(max(1, len(words) - 4))))


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = TRAIN_ROWS) -> tuple[dict[str, float], list[float]]:
    """Lexicon and curve.  What reaches the driver is bounded by the sample."""
    sample = training_rows(docs, labels, label, limit)

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "label": b["label"], "mark": [_mark(t) for t in b["text"]]})

    marked = sample.mapInPandas(mark, "doc_id long, label int, mark long")
    one = marked.groupBy("mark", "label").agg(F.min("doc_id").alias("doc_id")).toPandas()
    part = one["doc_id"].map(lambda i: zlib.crc32(b"curve%d" % i) % 10)
    lexicon_ids = dict(zip(one["doc_id"][part < 7], one["label"][part < 7], strict=True))
    curve_ids = dict(zip(one["doc_id"][part >= 7], one["label"][part >= 7], strict=True))
    toxic = sum(lexicon_ids.values())
    clean = len(lexicon_ids) - toxic
    share = (sum(one["label"]) + 1) / (len(one) + 2) if len(one) else 0.5
    if not toxic or not clean:
        return {}, [math.log(share / (1 - share))] + [0.0] * (MEASURES - 1)

    def count(wanted: set[str] | None, kind: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen: Counter = Counter()
            for b in batches:
                for doc, text in zip(b["doc_id"], b["text"], strict=True):
                    if lexicon_ids.get(doc) == kind:
                        found = {f for w in set(_WORD.findall(fold(text))) for f in features_of(w)}
                        seen.update(found if wanted is None else found & wanted)
            yield pd.DataFrame(list(seen.items()), columns=["feature", "n"])

        counted = sample.mapInPandas(run, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))
        return {r.feature: r.n for r in counted.filter(F.col("n") >= (MIN_TOXIC if wanted is None else 1)).toLocalIterator()}

    pos = count(None, 1)
    neg = count(set(pos), 0)
    lexicon = choose({f: (n, neg.get(f, 0)) for f, n in pos.items()}, toxic, clean)

    names = [f"x{i}" for i in range(MEASURES)]

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(lexicon)
        for b in batches:
            kept = [(d, *matcher.measures(t)) for d, t in zip(b["doc_id"], b["text"], strict=True) if d in curve_ids]
            yield pd.DataFrame(kept, columns=["doc_id", *names])

    x = sample.mapInPandas(measure, "doc_id long, " + ", ".join(f"{n} double" for n in names)).orderBy("doc_id").toPandas()
    y = x["doc_id"].map(curve_ids).to_numpy(float)
    if len(set(y)) < 2:
        return lexicon, [math.log(share / (1 - share)), 0.0, 1.0] + [0.0] * (MEASURES - 3)
    return lexicon, fit_curve(x[names].to_numpy(float), y).tolist()


def score(docs: DataFrame, lexicon: dict[str, float], curve: list[float], threshold: float = THRESHOLD, exceptions: tuple[str, ...] = EXCEPTIONS) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``; columns of these names are replaced."""
    rows = docs.drop("score", "predicted")
    schema = rows.select("*", F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher, weights = Matcher(lexicon, exceptions), np.array(curve)
        for b in batches:
            x = np.array([matcher.measures(t) for t in b["text"]]).reshape(-1, MEASURES)
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            yield b.assign(score=p, predicted=(p >= threshold).astype(np.int32))

    return rows.mapInPandas(run, schema)


def keep_clean(docs: DataFrame, lexicon: dict[str, float], curve: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that aren't toxic, with their columns.  Other columns than the text don't leave the JVM's row."""
    columns = docs.columns

    def run(batches):
        import pyarrow as pa

        matcher, weights = Matcher(lexicon), np.array(curve)
        at = columns.index("text")
        for b in batches:
            x = np.array([matcher.measures(t.as_py()) for t in b.column(at)]).reshape(-1, MEASURES)
            good = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30))) < threshold
            yield b.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon, curve = learn(docs, table(spark, sf_dir, "labels"))
    keyed = docs.select("doc_id", (fold_of(F.col("doc_id")) == 1).alias("held_out"), "text")
    return _scores(keyed, lexicon, curve)


def _scores(keyed: DataFrame, lexicon: dict[str, float], curve: list[float]) -> DataFrame:
    """Scores without the text."""
    import pyarrow as pa

    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, weights = Matcher(lexicon), np.array(curve)
        for b in batches:
            x = np.array([matcher.measures(t.as_py()) for t in b.column(2)]).reshape(-1, MEASURES)
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], schema=schema)

    return keyed.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


QUERIES = {"op7_toxicity": op7_toxicity}
ORACLE_SQL: dict[str, str] = {}
