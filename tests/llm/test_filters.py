import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from litforge.llm import html_extract, quality, sharding, toxicity

rng = random.Random(3)


def test_sharding(spark, documents):
    table = sharding.lookup_table(8, 1009)
    n = Counter(table)
    assert set(n) == set(range(8)) and max(n.values()) - min(n.values()) <= 1
    fewer = sharding.lookup_table(7, 1009)
    assert sum(a == b for a, b in zip(table, fewer, strict=True)) > 0.6 * 1009
    with pytest.raises(ValueError):
        sharding.lookup_table(8, 1000)
    rows = [(i, "x") for i in range(500)] + [(None, "n"), (3, "again")]
    got = sharding.place(documents(rows).withColumn("slot", F.lit("clash")), "doc_id").collect()
    assert len(got) == len(rows)
    shard = {}
    for r in got:
        assert shard.setdefault(r.doc_id, (r.slot, r.shard)) == (r.slot, r.shard) and 0 <= r.slot < sharding.SIZE
    assert sharding.place(documents([]), "doc_id").count() == 0


def brute_quality(text):
    t = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    grams = Counter(zip(w, w[1:], w[2:]))
    hit = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


QUALITY = [
    None, "", "  \n\t", "one", "one two three", "a b c a b c", "a a a a a", "x\ny\nx\n\nx", "#*$%&|<> été ﬁ\x0bz\x0cq\rw", "word " * 200, " ".join(f"w{i}" for i in range(120)), "w x y", "line one\nline two\n" * 40 + "q",
    " ".join(f"w{i}" for i in range(60)) + " a b c d a b c", "a b c " * 20000,
]


def test_quality_like_brute_force(spark, documents, folder):
    rows = [(i, t, "h1") for i, t in enumerate(QUALITY)] + [(3, "one", None)]
    got = quality.op8_quality_rules(spark, folder(documents(rows), "documents")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:7] == brute_quality(QUALITY[r.doc_id]), QUALITY[r.doc_id]


def test_hosts(spark, documents):
    good = lambda i: " ".join(f"w{i}x{j}" for j in range(80))
    noisy, lines = "## %% " * 60 + good(0), "one two three\n" * 30 + " ".join(f"q{j}" for j in range(60)) + "\n" + "a b\n" * 9
    rows = [(1000 * h + i, good(i), f"good{h}") for h in range(12) for i in range(60)]
    rows += [(20_000 + i, ["short", noisy, lines][h] if i % 10 else good(i), f"bad{h}") for h in range(3) for i in range(h * 200, h * 200 + 90)]
    rows += [(30_000, good(1), None), (30_001, noisy, "good1"), (30_002, "short", "good2"), (30_003, good(2), "new"), (30_004, None, "good3"), (30_005, lines, None)]
    docs = documents(rows).withColumn("host", F.lit("clash")).withColumn("failed", F.lit("clash")).withColumn("m", F.lit(1))
    kept = quality.keep_good(docs)
    assert {r.doc_id for r in kept.collect()} == {i for i, _, h in rows if h and h.startswith("good") and i < 20_000} | {30_000, 30_003}
    assert kept.columns == docs.columns
    verdicts = {r.host: r for r in quality.host_verdicts(quality.measure(docs.select(F.col("source").alias("host"), "text"))).collect()}
    assert {h for h, r in verdicts.items() if not r.host_ok} == {"bad0", "bad1", "bad2"} and 0 < verdicts["good5"].rate_symbols < 0.1
    assert quality.keep_good(documents([])).count() == 0
    # Hosts that fail alike all stay.
    alike = documents([(100 * h + i, "short" if i < 30 else good(i), f"h{h}") for h in range(8) for i in range(60)])
    assert quality.keep_good(alike).count() == 8 * 30


def test_fold():
    assert toxicity.fold("Іdіоt 1d10t L0SER tr@sh clоwn​") == "idiot idiot loser trash clown"
    assert toxicity.fold("in 2023 for $5") == "in 2023 for $5"


def test_matcher():
    m = toxicity.Matcher({"idio": 3.0, "idiot": 4.0, "ass ": 2.0, "trash": 3.0})
    assert m.hits("An IDIOTIC one, idiots!") == ({"idiotic": 4.0, "idiots": 4.0}, 4)
    assert m.hits("videodiot assess ass.")[0] == {"ass": 2.0}
    assert m.hits("the trash can, trash!")[0] == {"trash": 3.0} and m.hits("a trash can")[0] == {}
    assert m.hits(None) == ({}, 0) and toxicity.Matcher({}).hits("idiot") == ({}, 1)


def test_toxicity_held_out(spark, documents, folder):
    words = [a + b for a in "bcdfglmn" for b in ("al", "er", "in", "ot", "us", "em")]
    rows, labels = [], []
    for i in range(900):
        w = rng.choices(words, k=rng.randint(20, 80))
        if toxic := i % 6 == 0:
            for _ in range(2):
                w[rng.randrange(len(w))] = rng.choice(["zugga", "ZUGGOT", "zuggi!", "krâk", "zugg0"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    rows += [(9001, None), (9002, "")]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    folder(marks, "labels")
    got = {r.doc_id: r for r in toxicity.op7_toxicity(spark, folder(documents(rows), "documents")).collect()}
    assert len(got) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for i, r in got.items())
    held = [(got[i].predicted, t) for i, _, t in labels if got[i].held_out]
    assert sum(p == t for p, t in held) >= 0.97 * len(held) and got[9001].predicted == got[9002].predicted == 0
    docs = documents(rows)
    lexicon, curve = toxicity.learn(docs, marks)
    kept = toxicity.keep_clean(docs, lexicon, curve)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}


def brute_score(text, lexicon, exceptions):
    """Words of the folded text by regular expressions, without an automaton."""
    text = toxicity.fold(text or "")
    spans = [m.span() for e in exceptions for m in re.finditer(rf"(?<!\w){re.escape(toxicity.fold(e))}(?!\w)", text)]
    found = {}
    for m in re.finditer(r"[^\W\d_]+", text):
        if m.start() and text[m.start() - 1].isalnum():
            continue
        ends = m.end() >= len(text) or not text[m.end()].isalnum()
        fits = [(len(w.rstrip()), w.endswith(" "), w) for w in lexicon if (m[0] == w.rstrip() and ends if w.endswith(" ") else m[0].startswith(w))]
        if fits:
            n, _, w = max(fits)
            if not any(a <= m.start() and m.start() + n <= b for a, b in spans):
                found[m[0]] = max(lexicon[w], found.get(m[0], lexicon[w]))
    total = sum(found.values())
    return [1.0, math.log1p(total), max(found.values(), default=0.0), total / math.sqrt(10 + (text.count(" ") + 1 if text else 0))]


def test_scores_like_brute_force(spark, documents):
    lexicon, curve = {"idio": 3.0, "idiot": 4.0, "ass ": 2.0, "trash": 3.5, "zug": 2.5, "zugga ": 5.0}, [-4.0, 0.3, 0.5, 3.0]
    words = ["idiot", "Idi0tic", "ass", "assess", "tr@sh", "trash can", "the", "zugga", "zuggo", "videodiot", "x1diot", "clown fish", "of", "été", "IDIO"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 40)))) for i in range(200)] + [(200, None), (201, ""), (202, "idiot " * 60_000), (203, "the " * 60_000 + "trash"), (203, "trash")]
    docs = documents(rows).withColumn("score", F.lit("clash")).withColumn("predicted", F.lit("clash"))
    got = toxicity.score(docs, lexicon, curve).collect()
    assert len(got) == len(rows)
    for r in got:
        p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(brute_score(r.text, lexicon, toxicity.EXCEPTIONS), curve, strict=True))))
        assert abs(r.score - p) < 1e-9 and r.predicted == (p >= 0.7), r.text
    kept = toxicity.keep_clean(docs, lexicon, curve)
    assert kept.columns == docs.columns and kept.count() == sum(not r.predicted for r in got)
    assert toxicity.keep_clean(documents([]), lexicon, curve).count() == 0


def test_toxicity_without_labels(spark, documents):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    lexicon, curve = toxicity.learn(documents([(1, "x")]), none)
    assert lexicon == {} and {r.predicted for r in toxicity.score(documents([(1, "x"), (2, None)]), lexicon, curve).collect()} == {0}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href=x>Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div><header>Site</header><article><header><h1>Title &amp; more</h1></header><p>One&nbsp;<b>two
 three<br>four<p>Five<!-- no --><div class="related">See also</div><form>q</form><ul><li>i<li>j</ul></article><div id="comments"><article class="comment"><p>Reader</p></article></div>
<aside>Side</aside><footer>&copy;</footer></body></html>"""


def extracted(spark, *htmls):
    pages = spark.createDataFrame([(i, f"http://h{i}.example/", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")
    return [r.text for r in html_extract.extract_pages(pages).orderBy("page_id").collect()]


def test_extract(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 10
    steps = "".join(f"<div>s{i} " for i in range(2000))
    first, *rest = extracted(spark, PAGE, None, "plain  text", "<p>a <3 b</p><p>c<p", deep, steps, "<nav>only</nav>", "<div class=comments><article>said</article></div><p>text <span hidden>no</span></p>")
    assert first.split("\n") == ["Title & more", "One two three four", "Five", "i", "j"]
    assert rest[:2] == ["", "plain text"] and rest[2].startswith("a <3 b") and rest[3] == "deep"
    assert rest[4] == "\n".join(f"s{i}" for i in range(2000)) and rest[5:] == ["", "text"]
    assert html_extract.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def site(n, host="http://h.example/x"):
    words = lambda k: " ".join(rng.choices("abcdefgh", k=k))
    page = lambda i: f"<html><body><div class=top>Our great site</div><div class=box><p>{words(9)} {i}</p><div class=strip>Send this to a friend</div><p>{words(30)}</p>{'<ul><li>x<li>y</ul>' if i % 3 else ''}</div>tail {i % 2}</body></html>"
    return [(i, host, page(i)) for i in range(n)]


def test_style_tree_removes_boilerplate(spark, folder):
    rows = [*site(40), (100, None, None), (101, "http://other.example", "<p>one</p>"), (102, "http://other.example", "")]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, low string, host string")
    got = {r.page_id: r for r in html_extract.op9_html_extraction(spark, folder(frame.unionByName(frame.filter("page_id = 7")), "pages")).collect()}
    assert len(got) == len(rows)
    assert all("great" not in got[i].text and "friend" not in got[i].text and got[i].text for i in range(40))
    assert got[100].text == "" and got[101].text == "one" and got[102].n_chars == 0
    kept = {r.page_id: r.text for r in html_extract.extract_pages(frame, low=0.0).collect()}  # without the tree's verdict all of it stays
    assert all("Our great site" in kept[i] and "friend" in kept[i] for i in range(40))


def test_style_tree_removes_boilerplate_in_articles(spark, folder):
    words = lambda i: f"{' '.join(rng.choices('abcdefgh', k=9))} {i}"
    page = lambda i: f"<html><body><article><div class=strip>Send this to a friend</div><p>{words(i)}</p><div class=strip>All views are their authors' own</div></article><div>more {words(i)}</div></body></html>"
    rows = [(i, "http://h.example/x", page(i)) for i in range(40)] + [(50 + i, "http://same.example", f"<body><main><p>Always this</p></main><!-- {i} --></body>") for i in range(20)]
    got = {r.page_id: r.text for r in html_extract.op9_html_extraction(spark, folder(spark.createDataFrame(rows, "page_id long, url string, html string"), "pages")).collect()}
    assert len(got) == len(rows)
    assert all(got[i].endswith(f" {i}") and not any(w in got[i] for w in ("friend", "views", "more")) for i in range(40))
    assert all(got[50 + i] == "Always this" for i in range(20))


def brute_tree(rows):
    """Importance of every path of every host, from dictionaries of all occurrences."""
    seen = {}
    for host, html in {(h, t) for _, h, t in rows}:
        p = html_extract.parse(html)
        for code, layout, content, size, flags in zip(p.code, p.layout, p.content, p.size, p.flags, strict=True):
            seen.setdefault((host, code), []).append((layout, content, size, flags))
    spread = lambda x: 1.0 if len(x) < 2 else -sum(c / len(x) * math.log(c / len(x)) for c in Counter(x).values()) / math.log(len(x))
    out = {}
    for (host, code), found in seen.items():
        n = len(found)
        share = lambda bit: sum(f[3] & bit > 0 for f in found) > n / 2  # noqa: B023, E731
        entropy = spread([f[1] for f in found]) if share(4) else 0.9 * spread([f[1] for f in found]) + 0.1 * spread([f[0] for f in found])
        evidence = (0.3 if share(1) else 1) * (0.4 if share(2) else 1)
        mass = sum(f[2] for f in found) / max(1, sum(f[2] for f in seen[host, 0])) * n / (n + 8)
        out[host, code] = (n, max(0.01, (n * entropy + 8) / (n + 8) * evidence) ** (1 - mass))
    return out


def test_style_tree_like_brute_force(spark):
    rows = [*site(12, "http://a.example/1"), *site(25, "http://b.example/2"), *((200 + i, "http://a.example/9", PAGE + f"<p>{i % 3}") for i in range(9))]
    parsed = html_extract.parse_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).persist()
    got = {(r.host, r.code): (r.n, r.importance) for r in html_extract.style_tree(parsed).collect()}
    want = brute_tree([(i, u.split("/")[2], h) for i, u, h in rows])
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_quality_sql(spark, documents, folder):
    rows = [(i, t, f"h{i % 3}") for i, t in enumerate(QUALITY[:-1])]
    d = folder(documents(rows), "documents")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet/*.parquet'")
    found = con.execute(quality.ORACLE_SQL["op8_quality_rules"])
    names = [x[0] for x in found.description]
    want = sorted(tuple(dict(zip(names, r, strict=True))[c] for c in sorted(names)) for r in found.fetchall())
    assert sorted(tuple(r[c] for c in sorted(names)) for r in quality.op8_quality_rules(spark, d).collect()) == want
