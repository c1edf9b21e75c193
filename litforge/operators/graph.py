"""Citation-graph operators over ``edges(src, dst)``.

Iterative ones write each round to the shared folder, which cuts lineage and
survives lost executors.  Edges are distinct unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litforge.functions.text import rounded
from litforge.operators import paths
from litforge.session import materialize, release

OTHER = 2**32 - 2
#: Edges of a component that each worker may hold for exact betweenness.
MOST_EDGES = 10_000_000
#: Edges of a task of ``communities``, about.
TASK_EDGES = 50_000
#: Components of fewer edges share tasks of about so many.
FEW_EDGES = 10_000
#: Nodes times edges of a block of sources, about; blocks of a component, and tasks of all, at most.
BLOCK_WORK, MOST_BLOCKS, MOST_TASKS = 400_000_000, 256, 4000


def resolved(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are nodes, multiplicity kept."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def undirected(edges: DataFrame) -> DataFrame:
    """Each unordered pair once; a self-loop stays."""
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, directed: bool = True) -> DataFrame:
    """``(id, depth)`` of all that ``seeds(id)`` reach."""
    hops = materialize((edges.select("src", "dst").distinct() if directed else both_ways(edges)), "bfs-edges")
    seen = materialize(seeds.select("id").distinct().withColumn("depth", F.lit(0)), "bfs-0")
    frontier, depth = seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        found = frontier.select(F.col("id").alias("src")).join(hops, "src").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        frontier = materialize(found.withColumn("depth", F.lit(depth)), f"bfs-{depth}")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def bfs_edges(edges: DataFrame, reached: DataFrame, max_depth: int) -> DataFrame:
    """Edges that leave the nodes above the depth bound, those to known nodes too."""
    inside = reached.filter(F.col("depth") < max_depth).select(F.col("id").alias("src"))
    return edges.join(inside, "src", "left_semi")


def connected_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(id, component)``: the smallest id of each component; isolated nodes are their own."""
    pairs = materialize(edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a <> b").distinct(), "components")
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = materialize(both.filter("b > a").join(low, "a").select(F.col("low").alias("a"), "b").filter("a <> b").distinct(), "components")
        low = large.groupBy("b").agg(F.min("a").alias("low"))
        before_pairs = pairs
        pairs = materialize(large.join(low, "b").select(F.explode(F.array("a", "b")).alias("b"), F.col("low").alias("a")).filter("a <> b").distinct(), "components")
        release(before_pairs, large)
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
    roots = pairs.select(F.col("b").alias("id"), F.col("a").alias("component"))
    return nodes.select("id").distinct().join(roots, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def component_report(components: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts of components, their largest, isolated nodes, mean degree, and whether few components hold all."""
    sizes = components.groupBy("component").agg(F.count("*").alias("size"))
    facts = sizes.agg(F.count("*").alias("n_cc"), F.max("size").alias("largest"), F.count_if(F.col("size") == 1).alias("isolated"), F.sum("size").alias("n"))
    degree = undirected(edges).filter("src <> dst").agg(F.count("*").alias("m"))
    return facts.join(degree).select("n_cc", "largest", "isolated", (2.0 * F.col("m") / F.col("n")).alias("mean_degree"), (F.col("n_cc") / F.col("n") <= 0.05).alias("passes"))


def giant_component(components: DataFrame) -> DataFrame:
    sizes = components.groupBy("component").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "component").limit(1)
    return components.join(F.broadcast(sizes.select("component")), "component", "left_semi").select("id")


def pagerank(edges: DataFrame, nodes: DataFrame, rounds: int = 50, damping: float = 0.85, write_every: int = 5) -> DataFrame:
    """``(id, pagerank)``, summing to 1; the rank of nodes without out-edges is shared by all."""
    ids = nodes.select("id").distinct()
    links = resolved(edges.select("src", "dst").distinct(), nodes)
    links = materialize(links.join(links.groupBy("src").agg(F.count("*").alias("out")), "src"), "pagerank-links")
    sinks = materialize(ids.join(links.select(F.col("src").alias("id")).distinct().withColumn("out", F.lit(1)), "id", "left").select("id", F.col("out").isNull().alias("sink")), "pagerank-nodes")
    n = sinks.count()
    if not n:
        return ids.withColumn("pagerank", F.lit(0.0))
    ranks, last = sinks.select("id", "sink", F.lit(1.0 / n).alias("r")), None
    for i in range(rounds):
        lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("sink"), F.col("r"))), F.lit(0.0)).alias("lost"))
        given = links.join(ranks.select(F.col("id").alias("src"), "r"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("r") / F.col("out")).alias("given"))
        r = F.lit((1 - damping) / n) + damping * (F.coalesce("given", F.lit(0.0)) + F.col("lost") / n)
        ranks = sinks.join(given, "id", "left").join(F.broadcast(lost)).select("id", "sink", r.alias("r"))
        if i % write_every == write_every - 1 or i == rounds - 1:
            older, last = last, materialize(ranks, f"pagerank-{i}")
            ranks = last
            if older is not None:
                release(older)
    return ranks.select("id", F.col("r").alias("pagerank"))


def betweenness(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Brandes' measure, directed and unweighted, over (n-1)(n-2).

    No path leaves its component, so each is taken by itself: those of few edges
    many to a task, any other in blocks of sources, whose tasks hold its edges.
    So a component must fit in a worker, as for any exact method: MOST_EDGES is checked.
    """
    ids = nodes.select("id").distinct()
    return _betweenness(placed_links(edges, nodes).filter("src <> dst"), ids)


def placed_links(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges between nodes, self-loops too, with their component: ``(src, dst, component)``."""
    found = materialize(resolved(edges.select("src", "dst").distinct(), nodes), "links")
    where = connected_components(found, nodes)
    return materialize(found.join(where.withColumnRenamed("id", "src"), "src"), "placed-links")


def _numbered(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, pd.Index]:
    codes, names = pd.factorize(np.concatenate([part["src"].to_numpy(), part["dst"].to_numpy()]))
    return codes[: len(part)], codes[len(part) :], names


def _packed(part: pd.DataFrame) -> tuple[list, bytes, bytes]:
    """Nodes, and of each the count of its edges and where they end."""
    src, dst, names = _numbered(part)
    return list(names), np.bincount(src, minlength=len(names)).astype("<i4").tobytes(), dst[np.lexsort((dst, src))].astype("<i4").tobytes()


def _betweenness(placed: DataFrame, ids: DataFrame) -> DataFrame:
    sizes = materialize(placed.groupBy("component").agg(F.count("*").alias("m")), "betweenness-sizes")
    facts = sizes.agg(F.max("m"), F.sum(F.when(F.col("m") < FEW_EDGES, F.col("m")))).first()
    if (facts[0] or 0) > MOST_EDGES:
        raise ValueError(f"a component of more than {MOST_EDGES} edges doesn't fit in a worker")
    n = ids.count()
    scale = (n - 1) * (n - 2) if n > 2 else 1
    kind = dict(ids.dtypes)["id"]
    bins = 1 + (facts[1] or 0) // FEW_EDGES
    sized = placed.join(sizes, "component")
    small = sized.filter(F.col("m") < FEW_EDGES).withColumn("bin", F.pmod(F.xxhash64("component"), F.lit(bins))).repartition(min(bins, MOST_TASKS), "bin")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        done = []
        for _, own in part.groupby("component", sort=False):
            src, dst, names = _numbered(own)
            done.append(pd.DataFrame({"id": names, "b": paths.dependencies(src, dst, len(names), np.arange(len(names)))}))
        return pd.concat(done)

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        names, counts, ends = _packed(part)
        blocks = min(max(1, len(names) * len(part) // BLOCK_WORK), MOST_BLOCKS)
        return pd.DataFrame([(names, counts, ends, blocks)], columns=["ids", "counts", "ends", "blocks"])

    def run_block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for x in batch.itertuples():
                size = len(x.ids)
                src = np.repeat(np.arange(size), np.frombuffer(x.counts, "<i4"))
                dst = np.frombuffer(x.ends, "<i4").astype(np.int64)
                yield pd.DataFrame({"id": x.ids, "b": paths.dependencies(src, dst, size, np.arange(x.block, size, x.blocks))})

    packed = sized.filter(F.col("m") >= FEW_EDGES).groupBy("component").applyInPandas(pack, f"ids array<{kind}>, counts binary, ends binary, blocks int")
    packed = materialize(packed, "betweenness-packed")
    tasks = min(packed.agg(F.sum("blocks")).first()[0] or 1, MOST_TASKS)
    dealt = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).repartition(tasks)
    parts = small.groupBy("bin").applyInPandas(run, f"id {kind}, b double").unionByName(dealt.mapInPandas(run_block, f"id {kind}, b double"))
    sums = parts.groupBy("id").agg(F.sum("b").alias("b"))
    return ids.join(sums, "id", "left").select("id", (F.coalesce("b", F.lit(0.0)) / scale).alias("betweenness"))


def pagerank_apart(placed: DataFrame, ids: DataFrame, rounds: int = 50, damping: float = 0.85) -> DataFrame:
    """``pagerank`` over ``placed_links``, whose components each fit in a worker: no round deals anything out.

    A round is linear, and components share only what each node is given evenly.
    So ranks are sums of what one unit at every node has become after so many
    rounds, times what was given that many rounds ago.  A first pass finds what
    is at sinks by round, of which the gifts of all rounds follow; a second sums.
    """
    n = ids.count()
    kind = dict(ids.dtypes)["id"]
    sizes = placed.groupBy("component").agg(F.count("*").alias("m"))
    few = sizes.agg(F.sum(F.when(F.col("m") < FEW_EDGES, F.col("m")))).first()[0] or 0
    small = F.col("m") < FEW_EDGES
    keys = [F.when(small, F.pmod(F.xxhash64("component"), F.lit(1 + few // FEW_EDGES))).alias("bin"), F.when(~small, F.col("component")).alias("own")]

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([_packed(part)], columns=["ids", "counts", "ends"])

    packed = placed.join(sizes, "component").select("src", "dst", *keys).groupBy("bin", "own").applyInPandas(pack, f"ids array<{kind}>, counts binary, ends binary")
    packed = materialize(packed, "pagerank-packed")

    def units(counts: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
        """What one unit at every node has become, round by round."""
        at = np.ones(len(counts))
        yield at
        for _ in range(rounds):
            at = damping * np.bincount(ends, np.repeat(at / np.maximum(counts, 1), counts), len(counts))
            yield at

    def arrays(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for batch in batches:
            for x in batch.itertuples():
                yield x.ids, np.frombuffer(x.counts, "<i4"), np.frombuffer(x.ends, "<i4")

    def at_sinks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for names, counts, ends in arrays(batches):
            yield pd.DataFrame([(len(names), [float(x[counts == 0].sum()) for x in units(counts, ends)])], columns=["nodes", "sinks"])

    sinks = packed.mapInPandas(at_sinks, "nodes long, sinks array<double>")
    sums = sinks.agg(F.coalesce(F.sum("nodes"), F.lit(0)), *[F.coalesce(F.sum(F.col("sinks")[i]), F.lit(0.0)) for i in range(rounds + 1)]).first()
    lost = [sums[1] + n - sums[0], *sums[2:]]  # nodes without edges are sinks that get no more than is given
    gifts = [1.0 / n if n else 0.0]
    for i in range(rounds):
        gifts.append((1 - damping + damping * sum(g * x for g, x in zip(gifts, reversed(lost[: i + 1]), strict=True))) / n if n else 0.0)

    def ranked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for names, counts, ends in arrays(batches):
            yield pd.DataFrame({"id": names, "pagerank": sum(g * x for g, x in zip(reversed(gifts), units(counts, ends), strict=True))})

    ranks = packed.mapInPandas(ranked, f"id {kind}, pagerank double")
    return ids.join(ranks, "id", "left").select("id", F.coalesce("pagerank", F.lit(gifts[-1])).alias("pagerank"))


def metrics(edges: DataFrame, nodes: DataFrame, rounds: int = 50) -> DataFrame:
    """``(id, pagerank, betweenness)``; components are found once for both, and must fit in a worker as for ``betweenness``."""
    ids = materialize(nodes.select("id").distinct(), "metrics-nodes")
    placed = placed_links(edges, ids)
    b = _betweenness(placed.filter("src <> dst"), ids)
    p = pagerank_apart(placed, ids, rounds)
    return ids.join(p, "id", "left").join(b, "id", "left").fillna(0.0, ["pagerank", "betweenness"])


def louvain_partition(pairs: list[tuple], resolution: float = 1.0) -> dict:
    """Greedy modularity in passes of local moves and merging; nodes in order of id, ties to the smaller community."""
    names = sorted({v for a, b, _ in pairs for v in (a, b)})
    number = {v: i for i, v in enumerate(names)}
    a, b = (np.fromiter((number[x[i]] for x in pairs), np.int64, len(pairs)) for i in (0, 1))
    found = louvain_arrays(a, b, np.fromiter((x[2] for x in pairs), float, len(pairs)), len(names), resolution)
    return {v: names[c] for v, c in zip(names, found.tolist(), strict=True)}


def louvain_arrays(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int, resolution: float = 1.0) -> np.ndarray:
    """For each node of ``0 .. n - 1`` the number of the node that its community is named by; links are held in arrays."""
    row, col, w = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w])  # a self-loop counts twice, as in the degree
    label = name = np.arange(n)
    while True:
        keys, at = np.unique(row * len(name) + col, return_inverse=True)
        w = np.bincount(at, w, len(keys))
        row, col = keys // len(name), keys % len(name)
        del keys, at
        at = _moves(row, col, w, len(name), resolution)
        if at is None:
            return name[label]
        kept, at = np.unique(at, return_inverse=True)
        label, name, row, col = at[label], name[kept], at[row], at[col]


def _moves(row: np.ndarray, col: np.ndarray, w: np.ndarray, n: int, resolution: float) -> np.ndarray | None:
    """Communities after local moves until none gains, or None if there was no move."""
    total = float(w.sum())
    if not total:
        return None
    degree = np.bincount(row, w, n).tolist()
    other = row != col
    ends, w = col[other].astype(np.int32), w[other]
    start = np.searchsorted(row[other], np.arange(n + 1)).tolist()
    whole = bool((w == np.floor(w)).all())  # then sums are exact in any order, and kept
    w = w.astype(np.int64) if whole else w

    def links(v: int) -> Iterator[tuple]:
        low, high = start[v], start[v + 1]
        return zip(ends[low:high].tolist(), w[low:high].tolist(), strict=True)

    at, mass = list(range(n)), list(degree)
    near: list = [None] * n
    inside = [{v} for v in at]
    # A node that stayed is asked again only after a change that it can see: clocks of the last visit, of a node's own and of all nodes' changes.
    clock, seen, changed, all_changed = 1, [0] * n, [1] * n, 0
    any_move, moved = False, True
    while moved:
        moved = False
        for v in range(n):
            if seen[v] > changed[v] and seen[v] > all_changed:
                continue
            clock += 1
            seen[v] = clock
            around = near[v]
            if around is None:
                around = near[v] = {}
                for u, x in links(v):
                    c = at[u]
                    around[c] = around[c] + x if c in around else x
            own, factor = at[v], resolution * degree[v]
            mass[own] -= degree[v]
            most = around.get(own, 0.0) - factor * mass[own] / total
            close = [(most, own)]
            for c, x in around.items():
                gain = x - factor * mass[c] / total
                if gain > most - 1e-11 and c != own:  # equal when rounded, perhaps
                    most = max(most, gain)
                    close.append((gain, c))
            best = own if len(close) == 1 else min(close, key=lambda x: (-round(x[0], 12), x[1] != own, x[1]))[1]  # noqa: B023
            mass[best] += degree[v]
            if best == own:
                continue
            at[v], moved, any_move = best, True, True
            inside[own].discard(v)
            inside[best].add(v)
            clock += 1
            if len(inside[own]) + len(inside[best]) > 20:
                all_changed = clock
            else:
                for x in inside[own] | inside[best]:
                    changed[x] = clock
                    for u in ends[start[x] : start[x + 1]].tolist():
                        changed[u] = clock
            for u, x in links(v):
                changed[u] = clock
                around = near[u]
                if not whole:
                    near[u] = None
                elif around is not None:
                    around[best] = around.get(best, 0) + x
                    around[own] -= x
                    if not around[own]:
                        del around[own]
    return np.array(at) if any_move else None


def communities(edges: DataFrame, nodes: DataFrame, least_nodes: int = 10, least_size: int = 3) -> DataFrame:
    """``(id, community_id)`` numbered by size; small ones are merged into OTHER.

    Components never share a community, so each is partitioned in a task of its
    own; a graph of fewer than ``least_nodes`` nodes has no communities.
    """
    if nodes.select("id").distinct().count() < least_nodes:
        return nodes.select("id", F.lit(OTHER).cast("bigint").alias("community_id")).limit(0)
    pairs = undirected(resolved(edges, nodes))
    where = connected_components(pairs, nodes)
    kind = dict(nodes.dtypes)["id"]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        names, codes = np.unique(np.concatenate([part["src"].to_numpy(), part["dst"].to_numpy()]), return_inverse=True)
        found = louvain_arrays(codes[: len(part)], codes[len(part) :], np.ones(len(part)), len(names))
        _, first, c = np.unique(found, return_index=True, return_inverse=True)
        return pd.DataFrame({"id": names, "c": names[first[c]]})

    pairs = materialize(pairs.join(where.withColumnRenamed("id", "src"), "src"), "community-pairs")
    # Dealt to a given number of tasks: what moves take is far more than their bytes tell.
    tasks = min(1 + pairs.count() // TASK_EDGES, MOST_TASKS)
    placed = pairs.repartition(tasks, "component").groupBy("component").applyInPandas(run, f"id {kind}, c {kind}")
    placed = nodes.select("id").distinct().join(placed, "id", "left").select("id", F.coalesce("c", "id").alias("c"))
    placed = materialize(placed, "communities")
    sizes = placed.groupBy("c").agg(F.count("*").alias("size")).filter(F.col("size") >= least_size)
    ranked = sizes.withColumn("community_id", (F.row_number().over(Window.orderBy(F.desc("size"), "c")) - 1).cast("bigint"))
    return placed.join(ranked, "c", "left").select("id", F.coalesce("community_id", F.lit(OTHER)).alias("community_id"))


def communities_of(members: DataFrame, fingerprint: str, paper_id=None, community_id=None) -> DataFrame:
    """Current rows of ``members(id, community_id, corpus_fingerprint)``: all, a paper's or a community's."""
    out = members.filter(F.col("corpus_fingerprint") == fingerprint)
    if paper_id is not None:
        out = out.filter(F.col("id") == paper_id)
    return out if community_id is None else out.filter(F.col("community_id") == community_id)


def community_status(members: DataFrame, fingerprint: str) -> DataFrame:
    """One row: whether any assignment is current, and how many communities these make, OTHER aside."""
    own = F.col("corpus_fingerprint") == fingerprint
    return members.agg(F.coalesce(F.bool_or(own), F.lit(False)).alias("ready"), F.countDistinct(F.when(own & (F.col("community_id") != OTHER), F.col("community_id"))).alias("communities"))


def inner_degree(edges: DataFrame, members: DataFrame) -> DataFrame:
    """``(id, intra)``: one for both ends of each edge inside a community, repeated edges counted."""
    m = members.select("id", "community_id")
    same = edges.join(m.withColumnsRenamed({"id": "src", "community_id": "cs"}), "src").join(m.withColumnsRenamed({"id": "dst", "community_id": "cd"}), "dst").filter("cs = cd")
    ends = same.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("intra"))
    return members.select("id").distinct().join(ends, "id", "left").fillna(0, ["intra"])


def shared_in_community(weights: DataFrame, members: DataFrame, least: float = 0.05, n: int = 8) -> DataFrame:
    """Terms that pairs of members share; m members with a term make m (m - 1) / 2 pairs."""
    held = weights.filter(F.col("weight") >= least).join(members.withColumnRenamed("id", "doc_id"), "doc_id")
    counts = held.groupBy("community_id", "term").agg(F.count("*").alias("m")).filter("m >= 2").withColumn("pairs", (F.col("m") * (F.col("m") - 1) / 2).cast("bigint"))
    order = Window.partitionBy("community_id").orderBy(F.desc("pairs"), "term")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).select("community_id", "rank", "term", "pairs")


def community_summary(members: DataFrame, ranks: DataFrame, edges: DataFrame, tf: DataFrame, top: int = 5, only=None) -> DataFrame:
    """Size, colour index, label, keywords and top papers of each community; OTHER last.

    ``only``: that community alone.  Papers are then ranked for it alone; keywords
    and the colour index still need the others' terms and sizes.
    """
    from litforge.operators import corpus

    everyone, wanted = members, F.lit(True) if only is None else F.col("community_id") == only
    members = members.filter(wanted)
    intra = inner_degree(edges, members)
    hybrid = members.join(ranks, "id", "left").join(intra, "id").withColumn("score", F.coalesce("pagerank", F.lit(0.0)) * (F.col("intra") + 1))
    order = Window.partitionBy("community_id").orderBy(F.desc(rounded(F.col("score"), 12)), "id")  # equal but for the order of summing is equal
    best = hybrid.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    papers = best.groupBy("community_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("top_papers"))
    terms = corpus.class_tfidf(tf, everyone.withColumnRenamed("id", "doc_id"), other=OTHER).filter(wanted)
    words = terms.groupBy("community_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("keywords"))
    other = F.col("community_id") == OTHER
    sizes = everyone.groupBy("community_id").agg(F.count("*").alias("size"))
    sizes = sizes.withColumn("color_index", F.row_number().over(Window.orderBy(other, F.desc("size"), "community_id")) - 1)
    out = sizes.join(papers, "community_id").join(words, "community_id", "left")
    label = F.when(other, "Other").when(F.coalesce(F.size("keywords"), F.lit(0)) <= 0, "Unlabeled").otherwise(F.array_join(F.slice("keywords", 1, 2), " "))
    return out.select("community_id", "color_index", "size", label.alias("label"), "keywords", "top_papers")


def export_graph(members: DataFrame, vectors: DataFrame, edges: DataFrame, fingerprint: str) -> DataFrame:
    """A row per node, community and edge of the graph document, as JSON lines with their kind.

    Nodes without a vector have an empty one; edges stay inside the node set.
    """
    kept = members.filter(F.col("community_id") != OTHER)
    vecs = vectors.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "weight")))).alias("tfidf_vec"))
    nodes = kept.join(vecs.withColumnRenamed("doc_id", "id"), "id", "left")
    empty = F.create_map().cast("map<string,double>")
    inner = resolved(edges, kept)
    rows = nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct("id", "community_id", F.coalesce("tfidf_vec", empty).alias("tfidf_vec"))).alias("json"))
    rows = rows.unionByName(inner.select(F.lit("edge").alias("kind"), F.to_json(F.struct("src", "dst", F.lit(1.0).alias("weight"))).alias("json")))
    sizes = kept.groupBy("community_id").agg(F.count("*").alias("size"))
    return rows.unionByName(sizes.select(F.lit("community").alias("kind"), F.to_json(F.struct("community_id", "size", F.lit(fingerprint).alias("corpus_fingerprint"))).alias("json")))
