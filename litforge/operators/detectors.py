"""Bridge detectors over small graphs: coupled oscillators, sheaf spectra, catalytic sets, structure mapping.

These are dense or sequential by nature; each graph, source or pair is one
group of ``applyInPandas`` or one row of a pandas UDF, and groups run in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litforge.session import materialize


def laplacian(n: int, pairs: list[tuple[int, int]], weights: np.ndarray | None = None) -> np.ndarray:
    m = np.zeros((n, n))
    for k, (i, j) in enumerate(pairs):
        w = 1.0 if weights is None else weights[k]
        m[i, j] -= w
        m[j, i] -= w
        m[i, i] += w
        m[j, j] += w
    return m


def integrate(adjacency: np.ndarray, omega: np.ndarray, theta: np.ndarray, coupling: float, steps: int = 2000, dt: float = 0.02) -> np.ndarray:
    """Phases after fixed Runge-Kutta steps of fourth order."""
    n = len(theta)

    def slope(x: np.ndarray) -> np.ndarray:
        return omega + coupling / n * (adjacency * np.sin(x[None, :] - x[:, None])).sum(axis=1)

    for _ in range(steps):
        a = slope(theta)
        b = slope(theta + dt / 2 * a)
        c = slope(theta + dt / 2 * b)
        theta = theta + dt / 6 * (a + 2 * b + 2 * c + slope(theta + dt * c))
    return theta


def order_of(theta: np.ndarray) -> float:
    return float(abs(np.exp(1j * theta).mean()))


def sync_coupling(adjacency: np.ndarray, omega: np.ndarray, theta: np.ndarray, target: float = 0.9, low: float = 0.0, high: float = 64.0, rounds: int = 12) -> float:
    """Smallest coupling, by bisection, whose phases reach the target order."""
    for _ in range(rounds):
        middle = (low + high) / 2
        if order_of(integrate(adjacency, omega, theta, middle)) >= target:
            high = middle
        else:
            low = middle
    return high


def fiedler_cut(adjacency: np.ndarray, theta: np.ndarray | None = None) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
    """Sides by the sign of the second eigenvector, and the edges across, widest first.

    With phases, edges are weighted by the cosine of their difference.
    """
    n = len(adjacency)
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n) if adjacency[i, j]]
    w = None if theta is None else np.maximum(np.array([np.cos(theta[i] - theta[j]) for i, j in pairs]), 1e-9)
    _, vectors = np.linalg.eigh(laplacian(n, pairs, w))
    v = vectors[:, 1] if n > 1 else np.zeros(n)
    v = v * (1 if v[np.argmax(np.abs(v))] >= 0 else -1)
    cut = [(i, j, float(abs(v[i] - v[j]))) for i, j in pairs if (v[i] >= 0) != (v[j] >= 0)]
    return v >= 0, sorted(cut, key=lambda x: (-round(x[2], 9), x[0], x[1]))


def kuramoto_bridges(edges: DataFrame, coupling: float | None = None, seed: int = 42) -> DataFrame:
    """Ranked bridge edges of each graph of ``edges(graph, src, dst)`` with its order parameter and coupling."""
    kinds = dict(edges.dtypes)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*g["src"], *g["dst"]})
        at = {v: i for i, v in enumerate(names)}
        a = np.zeros((len(names), len(names)))
        for s, d in zip(g["src"], g["dst"], strict=True):
            if s != d:
                a[at[s], at[d]] = a[at[d], at[s]] = 1.0
        rng = np.random.default_rng(seed)
        omega, theta = rng.normal(0, 0.1, len(names)), rng.uniform(-np.pi, np.pi, len(names))
        k = sync_coupling(a, omega, theta) if coupling is None else coupling
        final = integrate(a, omega, theta, k)
        _, cut = fiedler_cut(a, final)
        rows = [(g["graph"].iloc[0], names[i], names[j], n + 1, gap, order_of(final), float(k)) for n, (i, j, gap) in enumerate(cut)]
        return pd.DataFrame(rows, columns=["graph", "src", "dst", "rank", "gap", "order_parameter", "coupling"])

    return edges.groupBy("graph").applyInPandas(run, f"graph {kinds['graph']}, src {kinds['src']}, dst {kinds['dst']}, rank long, gap double, order_parameter double, coupling double")


def null_graph(n: int, pairs: list[tuple[int, int]], kind: str, seed: int) -> list[tuple[int, int]]:
    """A random graph of as many edges (``erdos``), or of the same degrees (``configuration``, double edge swaps)."""
    rng = np.random.default_rng(seed)
    if kind == "erdos":
        every = [(i, j) for i in range(n) for j in range(i + 1, n)]
        return sorted(every[k] for k in rng.choice(len(every), len(pairs), replace=False))
    edges, held = [tuple(p) for p in pairs], {frozenset(p) for p in pairs}
    for _ in range(10 * len(edges)):
        i, j = rng.integers(len(edges), size=2)
        (a, b), (c, d) = edges[i], edges[j]
        if len({a, b, c, d}) == 4 and frozenset((a, d)) not in held and frozenset((c, b)) not in held:
            held -= {frozenset((a, b)), frozenset((c, d))}
            held |= {frozenset((a, d)), frozenset((c, b))}
            edges[i], edges[j] = (a, d), (c, b)
    return sorted(tuple(sorted(e)) for e in edges)


def sheaf_scores(stalks: dict, pairs: list[tuple]) -> list[tuple]:
    """Score of each edge: sum over positive modes of its energy over the mode's eigenvalue.

    A node's stalk is its list of terms; an edge's restriction maps keep shared terms.
    """
    place, size = {}, 0
    for v in sorted(stalks):
        for t in stalks[v]:
            place[v, t] = size
            size += 1
    rows = [(place[a, t], place[b, t], k) for k, (a, b) in enumerate(pairs) for t in stalks[a] if (b, t) in place]
    m = laplacian(size, [r[:2] for r in rows])
    values, vectors = np.linalg.eigh(m) if size else (np.empty(0), np.empty((0, 0)))
    score = np.zeros(len(pairs))
    for value, v in zip(values, vectors.T, strict=True):
        if value > 1e-9:
            for i, j, k in rows:
                score[k] += (v[i] - v[j]) ** 2 / value
    return sorted(((a, b, float(s)) for (a, b), s in zip(pairs, score, strict=True)), key=lambda x: (-round(x[2], 9), x[0], x[1]))


def sheaf_bridges(terms: DataFrame, edges: DataFrame) -> DataFrame:
    """Ranked edges between communities of each graph; ``terms(graph, id, term)``, ``edges(graph, src, dst)``."""
    kinds = dict(edges.dtypes)

    def run(t: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        stalks = {k: sorted(set(x)) for k, x in t.groupby("id")["term"]}
        pairs = sorted({(min(a, b), max(a, b)) for a, b in zip(e["src"], e["dst"], strict=True) if a != b and a in stalks and b in stalks})
        rows = [(t["graph"].iloc[0], a, b, n + 1, s) for n, (a, b, s) in enumerate(sheaf_scores(stalks, pairs))] if len(t) else []
        return pd.DataFrame(rows, columns=["graph", "src", "dst", "rank", "score"])

    return terms.groupBy("graph").cogroup(edges.groupBy("graph")).applyInPandas(run, f"graph {kinds['graph']}, src {kinds['src']}, dst {kinds['dst']}, rank long, score double")


def precision_at(ranked: list, truth: set, k: int = 10) -> float:
    """Share of the first k that is true; the list is cut before it is scored."""
    return sum(x in truth for x in ranked[:k]) / k


def raf_closure(reactions: dict, food: set) -> set:
    """The largest catalysed set: all reactants and some catalyst are food or a product of the set itself."""
    kept = set(reactions)
    while True:
        there = food.union(*(reactions[k]["products"] for k in kept))
        left = {k for k in kept if reactions[k]["reactants"] <= there and reactions[k]["catalysts"] & there}
        if left == kept:
            return kept
        kept = left


def closed_reactions(reactions: DataFrame, food: list[str]) -> DataFrame:
    """The rows of ``raf_closure`` over all sources of ``reactions(id, reactants, catalysts, products, ...)``.

    Each round drops the reactions that miss a reactant or have no catalyst; every
    round is written.  Ids are taken to be unique.
    """
    given = reactions.sparkSession.createDataFrame([(f,) for f in food], "m string")
    kept, n = materialize(reactions, "raf-0"), reactions.count()
    while True:
        there = kept.select(F.explode("products").alias("m")).unionByName(given).distinct()
        missing = kept.select("id", F.explode("reactants").alias("m")).join(there, "m", "left_anti").select("id").distinct()
        helped = kept.select("id", F.explode("catalysts").alias("m")).join(there, "m", "left_semi").select("id").distinct()
        kept = materialize(kept.join(missing, "id", "left_anti").join(helped, "id", "left_semi").select(*reactions.columns), "raf")
        left = kept.count()
        if left == n:
            return kept
        n = left


def _sides(reactions: dict, food: set) -> list[set]:
    """Sets that grow each from one reaction that needs food only, by reactions that use what the set made."""
    sides = []
    for seed in (k for k in reactions if reactions[k]["reactants"] <= food):
        side, made = {seed}, set(reactions[seed]["products"])
        grown = True
        while grown:
            grown = False
            for k, r in reactions.items():
                needs = r["reactants"] - food
                if k not in side and needs and needs <= made and r["catalysts"] & (food | made):
                    side.add(k)
                    made |= r["products"]
                    grown = True
        sides.append((side, made))
    alone = set(reactions).difference(*(side for side, _ in sides))
    there = food.union(*(made for _, made in sides))
    out = [set(side) for side, _ in sides]
    for k in alone:
        r = reactions[k]
        if r["reactants"] <= there and r["catalysts"] & there:
            for mine, (_, made) in zip(out, sides, strict=True):
                if (r["reactants"] - food) & made:
                    mine.add(k)
    return out


def _sharing(reactions: dict) -> list[set]:
    """Reactions that are joined by what they use or make."""
    groups: list[tuple[set, set]] = []
    for k, r in reactions.items():
        ids, things = {k}, r["reactants"] | r["catalysts"] | r["products"]
        rest = []
        for other, held in groups:
            if held & things:
                ids, things = ids | other, things | held
            else:
                rest.append((other, held))
        groups = [*rest, (ids, things)]
    return [ids for ids, _ in groups]


def minimal_rafs(reactions: dict, food: set) -> list[set]:
    """The sets that a closure of one source is made of.

    With two or more reactions that need food only, one set grows from each, and a
    reaction that none of them reaches but all together do belongs to each set
    that makes one of its reactants.  Otherwise reactions that share anything are
    one set.
    """
    table = dict(sorted(reactions.items()))
    found = _sides(table, food) if sum(r["reactants"] <= food for r in table.values()) >= 2 else _sharing(table)
    return sorted(found, key=lambda s: (min(s), len(s), sorted(s)))


def _table(g: pd.DataFrame) -> dict:
    return {r.id: {"reactants": set(r.reactants), "catalysts": set(r.catalysts), "products": set(r.products)} for r in g.itertuples()}


def raf_sets(reactions: DataFrame, food: list[str]) -> DataFrame:
    """``(source, raf, id)``: the sets of each source of ``reactions(id, reactants, catalysts, products, source)`` within the closure of all."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        rows = [(g["source"].iloc[0], n, k) for n, s in enumerate(minimal_rafs(_table(g), set(food))) for k in sorted(s)]
        return pd.DataFrame(rows, columns=["source", "raf", "id"])

    return closed_reactions(reactions, food).groupBy("source").applyInPandas(run, "source string, raf long, id string")


def raf_bridges(rafs: DataFrame) -> DataFrame:
    """``(source, id, rafs)``: reactions that belong to two sets or more."""
    return rafs.groupBy("source", "id").agg(F.array_sort(F.collect_set("raf")).alias("rafs")).filter(F.size("rafs") >= 2)


def raf_contractions(reactions: DataFrame, food: list[str]) -> DataFrame:
    """``(source, id, raf, lost)``: how much smaller each set of a source is without one of its bridges.

    The set is compared with the new one that shares most with it; sources are
    taken by themselves.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        table, base = _table(g), set(food)
        sets = minimal_rafs({k: table[k] for k in raf_closure(table, base)}, base)
        rows = []
        for bridge in sorted(k for k in table if sum(k in s for s in sets) >= 2):
            rest = {k: r for k, r in table.items() if k != bridge}
            new = minimal_rafs({k: rest[k] for k in raf_closure(rest, base)}, base)
            for n, s in enumerate(sets):
                rows.append((g["source"].iloc[0], bridge, n, len(s) - (len(max(new, key=lambda x: len(x & s))) if new else 0)))  # noqa: B023
        return pd.DataFrame(rows, columns=["source", "id", "raf", "lost"])

    return reactions.groupBy("source").applyInPandas(run, "source string, id string, raf long, lost long")


def best_mapping(relations_a: list[tuple[str, str, str]], relations_b: list[tuple[str, str, str]], roles_a: dict | None = None, roles_b: dict | None = None) -> int:
    """Relations kept by the best connected part of a one-to-one mapping of entities.

    Entities of like roles may be mapped on each other, and two such pairs go
    together if all relations between them, in both directions, are of the same
    types.  Among the largest sets of pairs that all go together, found by
    branching around pivots, the one counts whose relations make the largest
    connected part.  Without roles all entities are alike; an entity that stands
    in a relation to itself only counts as one without relations.
    """
    sides = []
    for relations, roles in ((relations_a, roles_a), (relations_b, roles_b)):
        between: dict = {}
        for x, y, kind in relations:
            if x != y:
                between.setdefault((x, y), set()).add(kind)
        names = sorted(roles) if roles is not None else sorted({e for x, y, _ in relations for e in (x, y)})
        sides.append((names, between, roles or dict.fromkeys(names)))
    (names_a, of_a, role_a), (names_b, of_b, role_b) = sides
    nodes = [(x, y) for x in names_a for y in names_b if role_a[x] == role_b[y]]
    fits = lambda x, y, u, v: of_a.get((x, u)) == of_b.get((y, v)) and of_a.get((u, x)) == of_b.get((v, y))
    near = [{j for j, (u, v) in enumerate(nodes) if u != x and v != y and fits(x, y, u, v)} for x, y in nodes]
    best = 0
    stack = [(set(), set(range(len(nodes))), set())]
    while stack:
        r, p, seen = stack.pop()
        if not p and not seen:
            best = max(best, _largest_part([nodes[i] for i in r], of_a))
            continue
        if not p:
            continue
        pivot = max(p | seen, key=lambda i: len(near[i] & p))
        for v in sorted(p - near[pivot]):
            stack.append((r | {v}, p & near[v], seen & near[v]))
            p, seen = p - {v}, seen | {v}
    return best


def _largest_part(mapped: list[tuple], between: dict) -> int:
    """Relations in the part of the mapped entities, joined by relations, that has most."""
    inside = {x for x, _ in mapped}
    kept = {pair: len(kinds) for pair, kinds in between.items() if set(pair) <= inside}
    best = 0
    while kept:
        part, grown = set(next(iter(kept))), True
        while grown:
            more = {e for pair in kept if part & set(pair) for e in pair} - part
            part |= more
            grown = bool(more)
        best = max(best, sum(n for pair, n in kept.items() if pair[0] in part))
        kept = {pair: n for pair, n in kept.items() if pair[0] not in part}
    return best


def structure_scores(pairs: DataFrame) -> DataFrame:
    """``pairs(query_id, cand_id, a, b)`` with relation arrays of (src, dst, type) -> ``score``; maps ``roles_a``, ``roles_b`` are used where given."""
    roles = [c for c in ("roles_a", "roles_b") if c in pairs.columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plain = lambda rs: [(r["src"], r["dst"], r["type"]) for r in rs]
        for g in batches:
            known = zip(*(g[c] for c in roles), strict=True) if len(roles) == 2 else [(None, None)] * len(g)
            scores = [float(best_mapping(plain(a), plain(b), x and dict(x), y and dict(y))) for a, b, (x, y) in zip(g["a"], g["b"], known, strict=True)]
            yield pd.DataFrame({"query_id": g["query_id"], "cand_id": g["cand_id"], "score": scores})

    kinds = dict(pairs.dtypes)
    return pairs.mapInPandas(run, f"query_id {kinds['query_id']}, cand_id {kinds['cand_id']}, score double")


def detected_pairs(bridges: DataFrame, members: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """``pairs(ca, cb)`` of communities with the first rank of a bridge that spans them and whether it is within k."""
    m = members.select("id", "community_id")
    spans = bridges.join(m.withColumnsRenamed({"id": "src", "community_id": "x"}), "src").join(m.withColumnsRenamed({"id": "dst", "community_id": "y"}), "dst")
    first = spans.groupBy(F.least("x", "y").alias("ca"), F.greatest("x", "y").alias("cb")).agg(F.min("rank").alias("first_rank"))
    return pairs.join(first, ["ca", "cb"], "left").withColumn("detected", F.coalesce(F.col("first_rank") <= k, F.lit(False)))
