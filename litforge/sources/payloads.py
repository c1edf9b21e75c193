"""Converters of scholarly payloads (JSON, HTML) to papers and references."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litforge.functions import text as T

INSPIRE = "struct<hits:struct<hits:array<struct<id:string,metadata:struct<titles:array<struct<title:string>>,authors:array<struct<full_name:string>>,abstracts:array<struct<value:string>>,arxiv_eprints:array<struct<value:string>>,dois:array<struct<value:string>>,citation_count:bigint,earliest_date:string,references:array<struct<record:struct<`$ref`:string>,reference:struct<arxiv_eprint:string,dois:array<string>,label:string,title:struct<title:string>,authors:array<struct<full_name:string>>>>>>>>>>"
SCHOLAR = "struct<title:string,authors:array<struct<name:string>>,year:int,abstract:string,externalIds:struct<ArXiv:string,DOI:string>,citationCount:bigint,publicationDate:string>"
OPENALEX = "id string, doi string, title string, display_name string, publication_date string, referenced_works array<string>, authorships array<struct<author:struct<display_name:string>>>, locations array<struct<landing_page_url:string>>, abstract_inverted_index map<string,array<int>>"


def inspire_papers(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """A row per hit, with its references.  Ids may be numbers or strings."""
    hit = payloads.select(F.explode(F.from_json(column, INSPIRE)["hits"]["hits"]).alias("h")).select("h.id", "h.metadata.*")
    refs = F.transform("references", lambda r: F.struct(T.strip_version(r["reference"]["arxiv_eprint"]).alias("arxiv_eprint"), F.get(r["reference"]["dois"], F.lit(0)).alias("doi"), r["reference"]["title"]["title"].alias("title"), F.array_join(r["reference"]["authors"]["full_name"], ", ").alias("author"), F.regexp_extract(r["record"]["$ref"], r"(\d+)$", 1).alias("inspire_record_id"), r["reference"]["label"].alias("label")))
    first = lambda c, f: F.get(F.col(c), F.lit(0))[f]
    return hit.select(
        T.strip_version(first("arxiv_eprints", "value")).alias("arxiv_id"), first("titles", "title").alias("title"), F.col("authors.full_name").alias("authors"), first("abstracts", "value").alias("summary"),
        first("dois", "value").alias("doi"), F.col("id").alias("inspire_id"), F.col("citation_count"), F.col("earliest_date").alias("published"), F.lit("InspireHEP").alias("source"), F.coalesce(refs, F.array()).alias("references"),
    )


def scholar_paper(payload: Column) -> Column:
    """Struct of a paper from one record, as text or parsed."""
    p = payload
    return F.struct(
        F.coalesce(T.strip_version(p["externalIds"]["ArXiv"]), F.lit("")).alias("arxiv_id"), p["title"].alias("title"), p["authors"]["name"].alias("authors"), F.coalesce(p["abstract"], F.lit("")).alias("summary"),
        p["externalIds"]["DOI"].alias("doi"), p["citationCount"].alias("citation_count"), F.coalesce(p["publicationDate"], p["year"].cast("string"), F.lit("")).alias("published"), F.lit("SemanticScholar").alias("source"),
    )


def scholar_page(payloads: DataFrame, side: str, column: str = "payload") -> DataFrame:
    """Papers of a page of references (``citedPaper``) or citations (``citingPaper``); rows without a paper go."""
    page = F.from_json(column, f"struct<data:array<struct<{side}:{SCHOLAR}>>,next:int>")
    return payloads.select(page["next"].alias("next"), F.explode(page["data"][side]).alias("p")).filter("p IS NOT NULL").select("next", scholar_paper(F.col("p")).alias("paper")).select("next", "paper.*")


def openalex_works(spark: SparkSession, path: str | None = None, rows: DataFrame | None = None) -> DataFrame:
    """Works from JSON (``path``) or from parsed ``rows``: id, arXiv id, abstract and references."""
    works = rows if rows is not None else spark.read.schema(OPENALEX).option("multiLine", True).json(path)
    urls = F.filter(F.transform("locations", lambda x: T.id_from_url(x["landing_page_url"])), lambda x: x.isNotNull())
    return works.select(
        F.col("id").alias("work"), T.strip_version(F.coalesce(T.id_from_doi(F.col("doi")), F.get(urls, F.lit(0)))).alias("arxiv_id"), F.coalesce("title", "display_name").alias("title"),
        F.col("authorships.author.display_name").alias("authors"), F.coalesce(T.abstract_from_index(F.col("abstract_inverted_index")), F.lit("")).alias("summary"), F.col("publication_date").alias("published"), F.coalesce("referenced_works", F.array().cast("array<string>")).alias("references"),
    )


def ingest_openalex(works: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Papers with an id, and citation edges between them: ids of all works first, then references."""
    from litforge.operators.relational import translate_ids

    names = works.filter("arxiv_id IS NOT NULL").select("work", F.col("arxiv_id").alias("id"))
    return works.filter("arxiv_id IS NOT NULL"), translate_ids(works.select("work", "references"), names)


def corpus_papers(spark: SparkSession, path: str, field: str = "papers") -> DataFrame:
    return spark.read.option("multiLine", True).json(path).select(F.explode(field).alias("p")).select("p.*")


def first_success(sources: list[DataFrame], key: str = "id") -> DataFrame:
    """Each key's row from the first source that has it, with non-empty ``references`` if that is a column."""
    tagged = []
    for i, s in enumerate(sources):
        good = s.filter(F.size("references") > 0) if "references" in s.columns else s
        tagged.append(good.withColumn("__source", F.lit(i)))
    rows = tagged[0]
    for t in tagged[1:]:
        rows = rows.unionByName(t)
    best = rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in (key, "__source")]), "__source").alias("r"))
    return best.select(key, "r.*")


def stored_papers(papers: DataFrame, cites: DataFrame) -> DataFrame:
    """The local database as a source: ``papers(id, ...)`` with their stored ``references``, sorted."""
    known = papers.select("id").distinct()
    refs = cites.join(known.withColumnRenamed("id", "src"), "src", "left_semi").groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("references"))
    kind = dict(refs.dtypes)["references"]
    return papers.join(refs, "id", "left").withColumn("references", F.coalesce("references", F.array().cast(kind)))


class _Tree(HTMLParser):
    """Texts of the elements that a test picks, with the italics and links inside."""

    def __init__(self, pick):
        super().__init__()
        self.pick, self.depth, self.found, self.stack = pick, 0, [], []

    def handle_starttag(self, tag, attrs):
        if tag in ("br", "img", "hr", "meta", "link", "input"):
            return
        a = dict(attrs)
        classes = (a.get("class") or "").split()
        kind = self.pick(tag, classes)
        item = {"kind": kind, "text": [], "em": [], "links": []} if kind else None
        self.stack.append((tag, item))
        for _, open_item in self.stack:
            if open_item is not None and tag == "a" and a.get("href"):
                open_item["links"].append(a["href"])

    def handle_endtag(self, tag):
        while self.stack:
            name, item = self.stack.pop()
            if item is not None:
                self.found.append((item["kind"], " ".join("".join(item["text"]).split()), " ".join("".join(item["em"]).split()), item["links"]))
            if name == tag:
                break

    def handle_data(self, data):
        italic = any(t in ("em", "i") for t, _ in self.stack)
        for _, item in self.stack:
            if item is not None:
                item["text"].append(data)
                if italic:
                    item["em"].append(data)


def reference_blocks(html: str | None) -> list[tuple[str, str, list[str]]]:
    """(text, italic text, links) of each bibliography block."""
    tree = _Tree(lambda tag, classes: "ref" if "ltx_bibblock" in classes else None)
    tree.feed(html or "")
    tree.close()
    return [(text, em, links) for _, text, em, links in tree.found]


def references(pages: DataFrame) -> DataFrame:
    """A row per bibliography block of ``pages(id, html)``: author, title, links, doi and mined id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, n, t, e or None, x) for i, html in zip(b["id"], b["html"], strict=True) for n, (t, e, x) in enumerate(reference_blocks(html))]
            yield pd.DataFrame(rows, columns=["id", "place", "text", "italic", "links"])

    rows = pages.select(F.col("id").cast("string"), "html").mapInPandas(run, "id string, place int, text string, italic string, links array<string>")
    linked = F.filter(F.transform("links", lambda u: T.id_from_url(u)), lambda x: x.isNotNull())
    eprint = F.get(F.array_except(T.mined_ids(F.col("text")), linked), F.lit(0))
    return rows.select("id", "place", T.author_and_title(F.col("text"), F.col("italic")).alias("r"), "links", T.mined_doi(F.col("text")).alias("doi"), eprint.alias("arxiv_eprint"), "text").select("id", "place", "r.*", "links", "doi", "arxiv_eprint", T.reference_id(F.col("links"), F.col("arxiv_eprint")).alias("ref_id"))


def section_texts(html: str | None) -> tuple[str, list[tuple[str, str]]]:
    """The abstract, and (title, text) of each section."""
    tree = _Tree(lambda tag, c: "abstract" if "ltx_abstract" in c else "section" if tag == "section" and "ltx_section" in c else "title" if any(x.startswith("ltx_title_section") for x in c) else "para" if "ltx_para" in c else None)
    tree.feed(html or "")
    tree.close()
    abstract, sections, title, parts, paras = "", [], "", [], []
    for kind, text, _, _ in tree.found:
        if kind == "para":
            paras.append(text)
        elif kind == "title":
            title = text
        elif kind == "abstract":
            abstract, paras = "\n".join(paras) or text, []
        elif kind == "section":
            sections.append((title, "\n".join(paras)))
            title, paras, parts = "", [], []
    return abstract, sections


def sections(pages: DataFrame) -> DataFrame:
    """Section map of ``pages(id, html)``: texts of a category joined; unknown titles are dropped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, html in zip(b["id"], b["html"], strict=True):
                abstract, found = section_texts(html)
                rows.append((i, -1, "abstract", abstract))
                rows += [(i, n, title, text) for n, (title, text) in enumerate(found)]
            yield pd.DataFrame(rows, columns=["id", "place", "title", "text"])

    rows = pages.select(F.col("id").cast("string"), "html").mapInPandas(run, "id string, place int, title string, text string")
    kind = F.when(F.col("place") < 0, "abstract").otherwise(T.classify_section(T.normalize_title(F.col("title"))))
    rows = rows.withColumn("kind", kind).filter("text <> ''")
    texts = [F.nullif(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("place", "text")))), lambda x: x["text"]), "\n"), F.lit("")).alias(k) for k in T.SECTION_WEIGHTS]
    out = rows.groupBy("id").agg(*texts)
    others = [F.col(k) for k in T.SECTION_WEIGHTS if k != "abstract"]
    return pages.select(F.col("id").cast("string")).join(out, "id", "left").withColumn("is_partial", F.coalesce(*others).isNull()).withColumn("n_sections", sum((F.col(k).isNotNull().cast("int") for k in T.SECTION_WEIGHTS), F.lit(0)))


ANNOTATION = "paper_type string, methods array<struct<name:string,category:string,source_section:string,source_snippet:string>>, findings array<struct<text:string,strength:string,source_section:string,source_snippet:string>>, open_problems array<string>"


def annotations(answers: DataFrame, ask=None) -> DataFrame:
    """Parsed model answers ``(id, prompt, answer)``; an answer without the four fields is asked for once more.

    ``ask``: a pandas UDF from prompt to answer.  Rows that still don't parse go.
    """
    sound = lambda c: F.from_json(c, ANNOTATION)
    whole = lambda a: a["paper_type"].isNotNull() & a["methods"].isNotNull() & a["findings"].isNotNull() & a["open_problems"].isNotNull()
    rows = answers.withColumn("a", sound("answer"))
    good = rows.filter(whole(F.col("a")))
    if ask is not None:
        bad = rows.filter(~F.coalesce(whole(F.col("a")), F.lit(False)))
        again = bad.withColumn("answer", ask(F.concat(F.col("prompt"), F.lit("\nReturn only valid JSON."))))
        good = good.unionByName(again.withColumn("a", sound("answer")).filter(whole(F.col("a"))))
    return good.select("id", "a.*")
