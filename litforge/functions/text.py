"""Text and identifier expressions: plain Columns, so they stay inside code generation."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The academic words that are dropped beside common English ones.
ACADEMIC_STOP = ["paper", "study", "result", "show", "figure", "also", "using"]
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can could did do does doing down during "
    "each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not "
    "now of off on once only or other our ours ourselves out over own same she should so some such than that the their theirs them themselves then there these they "
    "this those through to too under until up very was we were what when where which while who whom why will with would you your yours yourself yourselves"
).split() + ACADEMIC_STOP

# Section weights.
SECTION_WEIGHTS = {"abstract": 2.0, "methods": 1.5, "results": 1.0, "introduction": 0.5, "conclusion": 0.5}

# Section titles.
SECTION_EXCLUDED = ["reference", "bibliography", "acknowledgement", "acknowledgment", "appendix"]
SECTION_WORDS = {
    "introduction": ["introduction", "motivation"],
    "methods": ["method", "approach", "model", "framework", "formalism", "setup"],
    "results": ["result", "discussion", "experiment", "analysis", "observation", "finding"],
    "conclusion": ["conclusion", "summary", "outlook"],
}

# Words of strong and weak findings.
STRONG = ["strong", "strong_evidence", "established", "confirmed"]
WEAK = ["weak", "weak_evidence", "preliminary", "speculative", "inconclusive"]

NEW_ID = r"\b((?:0[0-9]|1[0-9]|2[0-9])\d{2}\.\d{4,5}(?:v\d+)?)\b"
OLD_ID = r"\b([a-zA-Z][a-zA-Z0-9\-]+/\d{7}(?:v\d+)?)\b"
DOI = r"\b(10\.\d{4,}/[^\s,;)\]]+)"


def strip_version(paper_id: Column) -> Column:
    return F.regexp_replace(paper_id, "v[0-9]+$", "")


def is_paper_id(paper_id: Column) -> Column:
    """New ids by pattern; any other id needs a slash in its base, before the first ``v``."""
    base, version = F.substring_index(paper_id, "v", 1), F.regexp_extract(paper_id, "^[^v]*v(.*)$", 1)
    sound = ~paper_id.contains("v") | version.rlike("^[0-9]+$")
    return F.coalesce(sound & (base.rlike(r"^[0-9]{4}\.[0-9]{4,5}$") | base.contains("/")), F.lit(False))


def is_web_url(url: Column) -> Column:
    return F.coalesce(url.startswith("http://") | url.startswith("https://"), F.lit(False))


def tokens(text: Column) -> Column:
    """Runs of letters and digits over two bytes long, lowered."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(parts, lambda t: F.octet_length(t) > 2), F.lower)


def content_tokens(text: Column) -> Column:
    return F.filter(tokens(text), lambda t: ~t.isin(STOP_WORDS))  # becomes a lookup in a hash set


def _marked_letters() -> tuple[str, str]:
    """Letters with marks and the ASCII letters that they are without, by canonical decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xC0, 0x250)]
    pairs = [(c, d[0]) for c, d in pairs if len(d) > 1 and d[0].isascii() and all(unicodedata.combining(m) for m in d[1:])]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


MARKED, BARE = _marked_letters()


def folded(text: Column) -> Column:
    """Lower case without marks on Latin letters."""
    return F.translate(F.lower(text), MARKED, BARE)


def folded_text(text: str) -> str:
    """The same for a string."""
    return text.lower().translate(str.maketrans(MARKED, BARE))


def normalize_title(title: Column) -> Column:
    """Drops leading section numbers: digits or capitals with delimiters, then a Roman numeral."""
    t = F.regexp_replace(F.trim(title), r"^(?:[0-9]+(?:\.[0-9]+)*|[A-Z])[.):\s]+", "")
    return F.lower(F.trim(F.regexp_replace(t, r"^[IVXLC]+[.):\s]+", "")))


def classify_section(title: Column) -> Column:
    """Category of a normalized title, null if none."""
    has = lambda words: F.lit(False) if not words else F.exists(F.array(*map(F.lit, words)), lambda w: title.contains(w))
    out = F.when(has(SECTION_EXCLUDED), F.lit(None).cast("string"))
    for name, words in SECTION_WORDS.items():
        out = out.when(has(words), F.lit(name))
    return out


def mined_ids(text: Column) -> Column:
    """Distinct paper ids in a reference's text, new form first."""
    return F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(NEW_ID), F.lit(1)), F.regexp_extract_all(text, F.lit(OLD_ID), F.lit(1))))


def mined_doi(text: Column) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_extract(text, DOI, 1), r"[^\p{L}\p{N}]+$", ""), F.lit(""))


def id_from_doi(doi: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(doi), r"10\.48550/arxiv\.([^\s?#]+)", 1), F.lit(""))


def id_from_url(url: Column) -> Column:
    """The id after ``/abs/``; an old-style id keeps its category."""
    return F.nullif(F.regexp_extract(url, r"arxiv\.org/abs/([^?#\s]+)", 1), F.lit(""))


def reference_id(links: Column, eprint: Column) -> Column:
    """First link to the archive, else the mined id."""
    found = F.get(F.filter(links, lambda u: u.contains("arxiv")), F.lit(0))
    return F.coalesce(strip_version(F.nullif(F.regexp_extract(found, r"(?:abs|pdf|html)/([^?#]+?)(?:\.pdf)?$", 1), F.lit(""))), strip_version(eprint))


def author_and_title(text: Column, italic: Column) -> Column:
    """Struct of author and title of a reference: split at its italic title, else at the last comma."""
    pieces = F.split(text, ",")
    cut = F.instr(text, F.coalesce(italic, F.lit("\0")))
    author = F.when(cut > 0, F.substring(text, F.lit(1), cut - 1)).when(F.size(pieces) > 1, F.array_join(F.slice(pieces, F.lit(1), F.size(pieces) - 1), ","))
    title = F.when(cut > 0, italic).otherwise(F.element_at(pieces, -1))
    trim = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^[\s,]+|[\s,]+$", "")
    return F.struct(trim(author).alias("author"), trim(title).alias("title"))


def abstract_from_index(index: Column) -> Column:
    """Words of an inverted index (word -> positions) in order of position."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


def year_of(published: Column) -> Column:
    return F.coalesce(F.substring(published, 1, 4), F.lit(""))


def strength(text: Column) -> Column:
    t = F.lower(text)
    return F.when(t.rlike("|".join(STRONG)), "strong").when(t.rlike("|".join(WEAK)), "weak")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_phrase(text: Column, phrases: list[str]) -> Column:
    """Earliest of the phrases (ties: first listed) with the sentence around it, null if none."""

    def sentence(t: Column, best: Column) -> Column:
        before = F.reverse(F.regexp_extract(F.reverse(F.substring(t, F.lit(1), best["at"] - 1)), "^[^.!?]*", 0))  # anchored, so read once
        after = F.regexp_extract(F.substring(t, best["at"], F.length(t)), "^[^.!?]*[.!?]?", 0)
        return F.when(best.isNotNull(), F.struct(best["phrase"].alias("phrase"), best["at"].alias("at"), F.trim(F.concat(before, after)).alias("snippet")))

    def find(t: Column) -> Column:
        places = F.array(*[F.struct(F.instr(t, p).alias("at"), F.lit(i).alias("rank"), F.lit(p).alias("phrase")) for i, p in enumerate(phrases)])
        return let(F.array_min(F.filter(places, lambda h: h["at"] > 0)), lambda best: sentence(t, best))

    return let(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), find)


# Function words that tell English.
ENGLISH_WORDS = "the of and to in a is for we that with are this as by".split()


def looks_english(text: Column, share: float = 0.9, words: int = 5) -> Column:
    """Mostly a-z, and enough different function words."""
    t = F.lower(F.coalesce(text, F.lit("")))
    solid = F.regexp_replace(t, r"\s", "")
    letters = F.length(solid) - F.length(F.regexp_replace(solid, "[a-z]", ""))
    found = F.size(F.array_intersect(F.split(t, "[^a-z]+"), F.array(*map(F.lit, ENGLISH_WORDS))))
    return (F.length(solid) > 0) & (letters >= share * F.length(solid)) & (found >= words)


def labels_match(a: Column, b: Column, least: float = 0.67) -> Column:
    """Equal after normalizing, or enough of the shorter label's words in the other."""
    words = lambda c: F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: (w != "") & ~F.array_contains(F.array(*map(F.lit, STOP_WORDS)), w))
    x, y = F.array_distinct(words(a)), F.array_distinct(words(b))
    low = F.least(F.size(x), F.size(y))
    return (F.array_join(words(a), " ") == F.array_join(words(b), " ")) | ((low > 0) & (F.size(F.array_intersect(x, y)) >= least * low))


def field_key(community: Column, domain: Column, category: Column, paper_id: Column) -> Column:
    """Where a paper belongs: the first of these that is known, else the head of its id, with its kind."""
    known = [F.concat(F.lit(f"{name}:"), F.nullif(c.cast("string"), F.lit(""))) for name, c in (("community_id", community), ("domain", domain), ("primary_category", category))]
    i = F.coalesce(paper_id, F.lit(""))
    return F.coalesce(*known, F.concat(F.lit("cat:"), F.when(i.contains("/"), F.substring_index(i, "/", 1)).otherwise(F.substring_index(i, ".", 1))))


def prompt_sections(sections: dict[str, Column], most: int = 3000) -> Column:
    """Sections under headers, cut at ``most`` characters with a mark."""
    parts = []
    for name, text in sections.items():
        body = F.when(F.coalesce(text, F.lit("")) == "", "[EMPTY]").when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("[truncated]"))).otherwise(text)
        parts.append(F.concat(F.lit(f"## {name}\n"), body))
    return F.concat_ws("\n\n", *parts)


def fingerprint(ids: Column) -> Column:
    """Aggregate: SHA-256 of the sorted ids joined by commas."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(ids)), ","), 256)


def search_query(fields: dict[str, str]) -> str:
    """The archive's search string; fields: ti, au, abs, co, jr, cat, rn, id, all."""
    known = ("ti", "au", "abs", "co", "jr", "cat", "rn", "id", "all")
    return "+AND+".join(f'{k}:"{fields[k]}"' for k in known if fields.get(k))


def rounded(x: Column, digits: int = 6) -> Column:
    """Half up, alike in Spark and in SQL engines."""
    return F.floor(x * F.lit(10.0**digits) + 0.5) / F.lit(10.0**digits)
