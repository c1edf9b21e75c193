"""Table operators: upserts, edge inserts, aggregations and the reports made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litforge.functions.text import rounded
from litforge.operators.ordered import running


def upsert(old: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` replacing those of equal keys; of repeated new keys, the last by all columns."""
    keys = [key] if isinstance(key, str) else key
    order = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in new.columns if c not in keys] or keys)
    fresh = new.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")
    return old.join(fresh.select(*keys), keys, "left_anti").select(*new.columns).unionByName(fresh)


def delete_stale(rows: DataFrame, fingerprint: str) -> tuple[DataFrame, int]:
    """Rows of the current fingerprint, and how many others there were."""
    current = F.coalesce(F.col("corpus_fingerprint") == fingerprint, F.lit(False))
    return rows.filter(current), rows.filter(~current).count()


def insert_edges(cites: DataFrame, references: DataFrame, papers: DataFrame | None = None, inverse: bool = False) -> DataFrame:
    """``cites`` and the new edges; with ``papers``, only those whose listed paper (``dst``) is known are kept.

    ``inverse``: the list names the papers that cite ``src``, so edges point the other way.
    """
    new = references.filter("src IS NOT NULL AND dst IS NOT NULL")
    if papers is not None:
        new = new.join(papers.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi")
    if inverse:
        new = new.withColumns({"src": F.col("dst"), "dst": F.col("src")})
    return cites.unionByName(new.select(*cites.columns), allowMissingColumns=True)


def replace_keys(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with all rows of each key that ``new`` has replaced by the rows of ``new``, which may repeat a key."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*new.columns).unionByName(new)


def built_edges(papers: DataFrame) -> DataFrame:
    """Edges ``(src, dst)`` of ``papers(id, references)`` between papers of the table; repeated references stay."""
    refs = papers.select(F.col("id").alias("src"), F.explode("references").alias("dst"))
    ids = papers.select(F.col("id").alias("dst")).distinct()
    return refs.join(ids, "dst", "left_semi").select("src", "dst")


def zipped(names: Column, values: Column, n: int = 5) -> Column:
    """The first n pairs of two parallel arrays; the shorter ends the list."""
    both = F.arrays_zip(names.alias("name"), values.alias("value"))
    return F.slice(both, F.lit(1), F.least(F.lit(n), F.size(names), F.size(values)))


def dedup_first(rows: DataFrame, key: Column, *order: Column | str) -> DataFrame:
    """The first row of each key."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("__n", n).filter("__n = 1").drop("__n")


def cited_by(papers: DataFrame, edges: DataFrame, paper_id) -> DataFrame:
    return papers.join(edges.filter(F.col("src") == paper_id).select(F.col("dst").alias("id")), "id", "left_semi")


def citing(papers: DataFrame, edges: DataFrame, paper_id) -> DataFrame:
    return papers.join(edges.filter(F.col("dst") == paper_id).select(F.col("src").alias("id")), "id", "left_semi")


def translate_ids(works: DataFrame, names: DataFrame) -> DataFrame:
    """``(src, dst)`` edges of works, their references translated by ``names(work, id)``; unknown ones go."""
    refs = works.select(F.col("work"), F.explode("references").alias("ref"))
    out = refs.join(names.withColumnsRenamed({"work": "ref", "id": "dst"}), "ref")
    return out.join(names.withColumnsRenamed({"id": "src"}), "work").select("src", "dst")


def in_period(rows: DataFrame, after: str | None, before: str | None, column: str = "published") -> DataFrame:
    """Lexicographic bounds on the string: a time of day on the last day is after that day."""
    for bound, sign in ((after, 1), (before, -1)):
        if bound is not None:
            rows = rows.filter(F.col(column) >= bound if sign > 0 else F.col(column) <= bound)
    return rows


def edge_overlay(citations: DataFrame, gaps: DataFrame, similar: DataFrame, least: float = 0.15, symmetric: bool = False) -> DataFrame:
    """Typed union of edges.  A similarity edge comes from the smaller end's own list unless ``symmetric``."""
    near = similar.filter((F.col("score") >= least) & (F.col("a") != F.col("b") if symmetric else F.col("a") < F.col("b")))
    ends = (F.least("a", "b"), F.greatest("a", "b"))
    parts = [
        citations.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit("citation").alias("kind"), F.lit(1.0).alias("weight")),
        gaps.select("a", "b", F.col("gap_type").alias("kind"), F.col("confidence").alias("weight")),
        near.select(ends[0].alias("a"), ends[1].alias("b"), F.lit("similarity").alias("kind"), F.col("score").alias("weight")).distinct(),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def gap_filter(gaps: DataFrame, kinds: list[str], least_percent: int) -> DataFrame:
    return gaps.filter(F.col("gap_type").isin(kinds) & (F.floor(F.col("confidence") * 100 + 0.5) >= least_percent))


def method_matrix(items: DataFrame, key: str, position: str, category: str) -> DataFrame:
    """``(a, b, n)``: pairs of positions i <= j of each list, by sorted categories.

    With c of a category and d of another in a list there are c * d pairs of
    both, and c * (c + 1) / 2 within one, so lists are counted and never paired
    row by row.
    """
    counts = items.groupBy(key, category).agg(F.count("*").alias("__n"))
    a, b = counts.select(key, F.col(category).alias("a"), F.col("__n").alias("ca")), counts.select(key, F.col(category).alias("b"), F.col("__n").alias("cb"))
    both = a.join(b, key).filter("a <= b")
    n = F.when(F.col("a") == F.col("b"), F.col("ca") * (F.col("ca") + 1) / 2).otherwise(F.col("ca") * F.col("cb"))
    return both.groupBy("a", "b").agg(F.sum(n.cast("bigint")).alias("n"))


def heat(count: Column) -> Column:
    """Bucket of a count: 0, 1-3, 4-9, 10 and more."""
    return F.when(count <= 0, 0).when(count <= 3, 1).when(count <= 9, 2).otherwise(3)


def problem_ranking(problems: DataFrame, column: str = "problem") -> DataFrame:
    return problems.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def dashboard(papers: DataFrame, gaps: DataFrame, problems: DataFrame, with_methods: DataFrame) -> DataFrame:
    """One row of counts; the share of papers with a method is 0 without papers."""
    p = papers.agg(F.count("*").alias("papers"))
    g = gaps.agg(F.count_if(F.col("gap_type") == "contradiction").alias("contradictions"), F.count_if(F.col("gap_type") == "abc_bridge").alias("bridges"))
    o = problems.agg(F.countDistinct("problem").alias("open_problems"))
    m = with_methods.agg(F.countDistinct("id").alias("m"))
    share = F.when(F.col("papers") == 0, 0.0).otherwise(100.0 * F.col("m") / F.col("papers"))
    return p.join(g).join(o).join(m).withColumn("method_percent", share).drop("m")


def keyword_variance(top: DataFrame, n: int = 8) -> DataFrame:
    """Terms whose scores in the documents' top lists vary most; two or more values are needed."""
    v = top.groupBy("term").agg(F.count("*").alias("n"), F.var_pop("weight").alias("variance")).filter("n >= 2")
    order = [F.desc(rounded(F.col("variance"), 9)), F.col("term")]
    best = v.orderBy(*order).limit(n)  # a heap in each task; the window sees these rows only
    return best.select((F.row_number().over(Window.orderBy(*order)) - 1).alias("slot_index"), "term", "variance")


def gap_summary(gaps: DataFrame) -> DataFrame:
    counts = gaps.agg(F.count_if(F.col("gap_type") == "contradiction").alias("contradictions"), F.count_if(F.col("gap_type") == "abc_bridge").alias("bridges"))
    ids = gaps.select(F.explode("paper_ids").alias("id")).agg(F.countDistinct("id").alias("papers"))
    return counts.join(ids)


def shortened(text: Column, most: int = 60) -> Column:
    """Cut to most - 3 characters and three dots where longer."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def gap_report(gaps: DataFrame) -> DataFrame:
    """Lines ``(section, line, text)`` of the gap table: a section for each kind, surest first.

    ``gaps(gap_type, paper_ids, confidence, shared_terms, justification)``.  A line has the papers, the
    confidence, the shared terms and the justification, cut to its column.
    """
    ids = F.array_join(F.transform("paper_ids", lambda x: x.cast("string")), ", ")
    text = F.format_string("%-30s  %5.1f%%  %-30s  %s", ids, F.col("confidence") * 100, F.array_join("shared_terms", ", "), shortened(F.col("justification")))
    section = F.when(F.col("gap_type") == "contradiction", "Contradictions").otherwise("Bridges")
    rows = gaps.select(section.alias("section"), "confidence", ids.alias("ids"), text.alias("text"))
    placed = running(rows, [F.col("section"), F.desc("confidence"), F.col("ids"), F.col("text")])
    first = placed.groupBy("section").agg(F.min("nth").alias("first"))  # a row a kind
    return placed.join(F.broadcast(first), "section").select("section", (F.col("nth") - F.col("first") + 1).alias("line"), "text")


# Presentation expressions.


def node_radius(citations: Column) -> Column:
    return F.least(F.lit(18.0), F.greatest(F.lit(4.0), 2.5 * F.sqrt(F.coalesce(citations, F.lit(0)) + 1)))


def metric_radius(score: Column) -> Column:
    return F.least(F.lit(18.0), F.greatest(F.lit(4.0), 50 * F.sqrt(score) + 4))


def radius_by_mode(mode: str, citations: Column, pagerank: Column, betweenness: Column) -> Column:
    return {"uniform": F.lit(8.0), "citations": node_radius(citations), "pagerank": metric_radius(pagerank), "betweenness": metric_radius(betweenness)}[mode]


def keyword_opacity(score: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.35), 0.35 + 0.65 * score))


def strength_radius(strengths: Column) -> Column:
    """Largest multiplier among the findings' strengths."""
    one = lambda s: F.when(s == "strong", 2.0).when(s == "strong_evidence", 3.0).when(s.contains("moderate"), 1.5).otherwise(1.0)
    return F.coalesce(F.array_max(F.transform(strengths, one)), F.lit(1.0))


def is_visible(zoom: float, depth: Column, is_seed: Column) -> Column:
    """Seeds always; deeper nodes as the view comes nearer."""
    most = 1 if zoom < 0.3 else 2 if zoom < 0.6 else 3 if zoom < 1.0 else None
    return F.lit(True) if most is None else is_seed | (F.coalesce(depth, F.lit(2**31 - 1)) <= most)


def in_years(year: Column, low: int, high: int) -> Column:
    """Unknown years stay visible."""
    y = year.try_cast("int")
    return y.isNull() | y.between(low, high)


def year_bounds(rows: DataFrame, column: str = "year") -> DataFrame:
    y = F.col(column).try_cast("int")
    good = rows.select(y.alias("y")).filter("y > 1900 AND y < 2100")
    return good.agg(F.coalesce(F.min("y"), F.lit(2000)).alias("low"), F.coalesce(F.max("y"), F.lit(2026)).alias("high"))


def arc_angles(rows: DataFrame, key: str, order: str, weight: str) -> DataFrame:
    """Start and end angle of each arc of a ring, in proportion to its weight."""
    w = Window.partitionBy(key)
    turn = 2 * 3.141592653589793
    before = F.coalesce(F.sum(weight).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    total = F.sum(weight).over(w)
    return rows.withColumn("start", turn * before / total).withColumn("end", turn * (before + F.col(weight)) / total)


def node_color(mode: str, palette: list[str], index: Column, orphan: str = "#888888") -> Column:
    """Palette entry by community modulo its size, or by depth up to four."""
    colours = F.array(*map(F.lit, palette))
    place = F.pmod(index, F.lit(len(palette))) if mode == "community" else F.least(index, F.lit(min(4, len(palette) - 1)))
    return F.coalesce(F.element_at(colours, (place + 1).cast("int")), F.lit(orphan))


def paper_type_color(kind: Column) -> Column:
    return F.when(kind == "theoretical", "#4e79a7").when(kind == "experimental", "#f28e2b").when(kind == "computational", "#59a14f").when(kind == "review", "#b07aa1").otherwise("#9c9c9c")


def dimmed(keywords: Column, active: Column) -> Column:
    return (F.size(active) > 0) & ~F.arrays_overlap(keywords, active)


def bounding_box(points: DataFrame, margin: float = 0.0) -> DataFrame:
    return points.agg((F.min("x") - margin).alias("left"), (F.min("y") - margin).alias("top"), (F.max("x") + margin).alias("right"), (F.max("y") + margin).alias("bottom"))


def order_parameter(phases: DataFrame) -> DataFrame:
    """Modulus of the mean phase vector."""
    return phases.agg(F.sqrt(F.pow(F.avg(F.cos("theta")), 2) + F.pow(F.avg(F.sin("theta")), 2)).alias("order_parameter"))


def set_jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)
