import hashlib

from pyspark.sql import functions as F

from litforge.functions import text as T
from litforge.sources import payloads


def one(spark, column, value=None, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(column.alias("y")).first()[0]


def test_tokens_by_bytes(spark):
    assert one(spark, T.tokens(F.col("x")), "Ab été The a1b-xyz é ñé") == ["été", "the", "a1b", "xyz", "ñé"]
    assert one(spark, T.content_tokens(F.col("x")), "the paper shows graphs") == ["shows", "graphs"]
    assert one(spark, T.tokens(F.col("x"))) == []


def test_ids(spark):
    x = F.col("x")
    assert one(spark, T.strip_version(x), "2301.00001v12") == "2301.00001"
    assert one(spark, T.strip_version(x), "hep-th/9901001") == "hep-th/9901001"
    for value, good in (("2301.00001", True), ("2301.00001v2", True), ("230.1", False), ("hep-th/9901001", True), ("solv-int/9901001", False), ("2301.00001vx", False)):
        assert one(spark, T.is_paper_id(x), value) is good, value
    assert one(spark, T.mined_ids(x), "see 2301.00001v2 and hep-th/9901001, 9999.12345") == ["2301.00001v2", "hep-th/9901001"]
    assert one(spark, T.mined_doi(x), "doi:10.1000/ab.c). x") == "10.1000/ab.c"
    assert one(spark, T.id_from_url(x), "https://arxiv.org/abs/hep-th/9901001?x=1") == "hep-th/9901001"
    assert one(spark, T.id_from_doi(x), "10.48550/arXiv.2301.00001") == "2301.00001"


def test_sections(spark):
    x = F.col("x")
    for title, kind in (("1. Introduction", "introduction"), ("II. The Model", "methods"), ("A. Results and Discussion", "results"), ("V Summary", "conclusion"), ("Appendix of methods", None), ("Odds", None)):
        assert one(spark, T.classify_section(T.normalize_title(x)), title) == kind, title


def test_references_and_abstracts(spark):
    text = spark.createDataFrame([("A. Author, B. Other, A fine title", None), ("A. Author, Fine, J. 3", "Fine")], "x string, i string")
    got = [r[0] for r in text.select(T.author_and_title(F.col("x"), F.col("i"))).collect()]
    assert (got[0].author, got[0].title) == ("A. Author, B. Other", "A fine title")
    assert (got[1].author, got[1].title) == ("A. Author", "Fine")
    index = spark.createDataFrame([({"b": [1, 3], "a": [0], "c": [2]},)], "m map<string,array<int>>")
    assert index.select(T.abstract_from_index(F.col("m"))).first()[0] == "a b c b"


def test_strength_and_phrases(spark):
    x = F.col("x")
    assert one(spark, T.strength(x), "Unconfirmed") == "strong"
    assert one(spark, T.strength(x), "Preliminary hint") == "weak"
    assert one(spark, T.strength(x), "so so") is None
    hit = one(spark, T.first_phrase(x, ["analogous to", "reminiscent of"]), "It is  Reminiscent of, and analogous to, that")
    assert hit.phrase == "reminiscent of" and hit.at == 7
    assert one(spark, T.first_phrase(x, ["q"]), "none") is None
    assert one(spark, T.looks_english(x), "the cat and the dog of a house is in that garden for us") is True
    assert one(spark, T.looks_english(x), "") is False
    assert one(spark, T.labels_match(x, F.lit("physics of high energy")), "High Energy Physics") is True


def test_fingerprint(spark):
    ids = spark.createDataFrame([("b",), ("a",)], "x string")
    assert ids.agg(T.fingerprint(F.col("x"))).first()[0] == hashlib.sha256(b"a,b").hexdigest()


def test_search_query():
    assert T.search_query({"au": "Doe", "ti": "graphs", "nope": "x"}) == 'ti:"graphs"+AND+au:"Doe"'


def test_reference_html(spark):
    html = '<ol><li><span class="ltx_bibblock">A. Doe, <em>Nice work</em>, <a href="https://arxiv.org/abs/2301.00001v2">x</a></span></li><li><span class="ltx_bibblock">B. Roe, Old, 1999, hep-th/9901001</span></li></ol>'
    rows = payloads.references(spark.createDataFrame([("p", html), ("q", None)], "id string, html string")).orderBy("place").collect()
    assert [(r.author, r.title, r.ref_id) for r in rows] == [("A. Doe", "Nice work", "2301.00001"), ("B. Roe, Old, 1999", "hep-th/9901001", "hep-th/9901001")]


def test_section_html(spark):
    html = '<div class="ltx_abstract"><p class="ltx_para">Abs.</p></div><section class="ltx_section"><h2 class="ltx_title ltx_title_section">1. Introduction</h2><p class="ltx_para">In.</p></section><section class="ltx_section"><h2 class="ltx_title_section">Methods</h2><p class="ltx_para">M1.</p><p class="ltx_para">M2.</p></section><section class="ltx_section"><h2 class="ltx_title_section">References</h2><p class="ltx_para">R.</p></section>'
    r = {x.id: x for x in payloads.sections(spark.createDataFrame([("p", html), ("q", "")], "id string, html string")).collect()}
    assert (r["p"].abstract, r["p"].introduction, r["p"].methods, r["p"].results, r["p"].is_partial, r["p"].n_sections) == ("Abs.", "In.", "M1.\nM2.", None, False, 3)
    assert r["q"].is_partial and r["q"].n_sections == 0


def test_payloads(spark):
    inspire = '{"hits":{"hits":[{"id":12,"metadata":{"titles":[{"title":"T"}],"authors":[{"full_name":"A"}],"abstracts":[{"value":"S"}],"arxiv_eprints":[{"value":"2301.1v2"}],"citation_count":3,"references":[{"reference":{"arxiv_eprint":"2302.1v1","title":{"title":"R"}},"record":{"$ref":"https://x/99"}}]}},{"id":"13","metadata":{}}]}}'
    rows = payloads.inspire_papers(spark.createDataFrame([(inspire,)], "payload string")).orderBy("inspire_id").collect()
    assert (rows[0].arxiv_id, rows[0].inspire_id, rows[0].references[0].arxiv_eprint, rows[0].references[0].inspire_record_id) == ("2301.1", "12", "2302.1", "99")
    assert rows[1].arxiv_id is None and rows[1].references == []
    page = '{"data":[{"citedPaper":{"title":"T","authors":[{"name":"A"}],"year":2020,"externalIds":{"ArXiv":"2301.1v3"}}},{"citedPaper":null}],"next":500}'
    got = payloads.scholar_page(spark.createDataFrame([(page,)], "payload string"), "citedPaper").collect()
    assert [(r.arxiv_id, r.published, r.next) for r in got] == [("2301.1", "2020", 500)]
    works = spark.createDataFrame([("W1", "https://doi.org/10.48550/arXiv.2301.1", "T", None, "2023", ["W2", "W9"], [], [], {"hi": [0], "you": [1]}), ("W2", None, "U", None, "2022", [], [], [("http://arxiv.org/abs/2302.2v1",)], None)], payloads.OPENALEX)
    found = payloads.openalex_works(spark, rows=works)
    papers, edges = payloads.ingest_openalex(found)
    assert {(r.arxiv_id, r.summary) for r in papers.collect()} == {("2301.1", "hi you"), ("2302.2", "")}
    assert [tuple(r) for r in edges.collect()] == [("2301.1", "2302.2")]


def test_first_success(spark):
    a = spark.createDataFrame([("1", ["x"]), ("2", [])], "id string, references array<string>")
    b = spark.createDataFrame([("1", ["y"]), ("2", ["z"])], "id string, references array<string>")
    assert {r.id: r.references for r in payloads.first_success([a, b]).collect()} == {"1": ["x"], "2": ["z"]}
