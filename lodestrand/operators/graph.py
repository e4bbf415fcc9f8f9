"""Graph measures over edge tables (src, dst[, type, weight]) and vertex tables (id).

Iterations cut their lineage by writing to the checkpoint folder. Per-component algorithms (articulation points,
communities) run in one task for each component up to ``COMPONENT_EDGES`` edges; larger ones are refused by name rather
than cut short.
"""

from __future__ import annotations

import tempfile
from collections import defaultdict, deque
from collections.abc import Iterator, Sequence
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions.numbers import half_up
from lodestrand.operators.aggregates import running_sums

#: Bounds: edges of one component in one task; vertices and edges of a graph whose paths are counted from each source.
COMPONENT_EDGES, PATH_VERTICES, PATH_EDGES = 2_000_000, 20_000, 500_000
#: Graphs of no more edges have their components found by one task.
FEW_EDGES = 200_000
#: Vertices of a frontier that are sent to all tasks; more are joined.
FRONT = 1_000_000


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder; a new local one where none is set and all of Spark is on this machine."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        at = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not at and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="lodestrand-"))
    return df.checkpoint()


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) in both directions, without loops."""
    e = edges.select("src", "dst").where("src <> dst")
    return e.select(F.inline(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))).distinct()


def induced(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges with both ends among ``vertices``."""
    ids = vertices.select("id")
    return edges.join(ids, F.col("src") == F.col("id"), "left_semi").join(ids, F.col("dst") == F.col("id"), "left_semi")


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges from each vertex to the least of its component, by union and find."""
    up: dict = {}

    def top(v):
        while up[v] != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    kinds = None
    for batch in batches:
        kinds = batch.dtypes
        for a, b in zip(batch["src"], batch["dst"], strict=True):
            up.setdefault(a, a)
            up.setdefault(b, b)
            a, b = top(a), top(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    if kinds is not None:
        rows = [(v, top(v)) for v in up if top(v) != v]
        yield pd.DataFrame({"src": pd.Series([v for v, _ in rows], dtype=kinds["src"]), "dst": pd.Series([r for _, r in rows], dtype=kinds["dst"])})


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id that is reached along edges, whatever their direction.

    Edges are rewritten to stars around least neighbours, alternately from above and below; rounds grow with the
    logarithm of a component's size, not its diameter. Up to ``FEW_EDGES`` edges one task does it at once, to the same end.
    """
    own = cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    if own.count() <= FEW_EDGES:
        own = cut(own.coalesce(1).mapInPandas(_stars, own.schema))
    before = None
    while True:
        now = own.agg(F.count("*"), F.expr("bit_xor(xxhash64(src, dst))")).first()
        if not now[0] or now == before:
            break
        before = now
        both = own.unionByName(own.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("u"), F.least("src", "m").alias("m"))
        large = both.where("dst > src").join(least, F.col("src") == F.col("u")).select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()
        low = large.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("u"), "m")
        small = large.join(low, F.col("src") == F.col("u")).select(F.explode(F.array(F.struct("src", F.col("m").alias("dst")), F.struct(F.col("dst").alias("src"), F.col("m").alias("dst")))).alias("e"))
        own = cut(small.select("e.src", "e.dst").where("src <> dst").distinct())
    return vertices.select("id").join(own, F.col("id") == F.col("src"), "left").select("id", F.coalesce("dst", "id").alias("component"))


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree, in_degree, out_degree, weighted, by_type) of each vertex; parallel edges count, loops do not."""
    e = edges.where("src <> dst")
    ends = e.select(F.col("src").alias("id"), "type", "weight", F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("dst").alias("id"), "type", "weight", F.lit(0).alias("o"), F.lit(1).alias("i")))
    by_type = ends.groupBy("id", "type").agg(F.count("*").alias("n"), F.sum("o").alias("o"), F.sum("i").alias("i"), F.sum("weight").alias("w"))
    total = by_type.groupBy("id").agg(F.sum("n").alias("degree"), F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.sum("w").alias("weighted"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("by_type"))
    zero = {"degree": 0, "in_degree": 0, "out_degree": 0, "weighted": 0}
    return vertices.select("id").join(total, "id", "left").fillna(zero)


def degree_centrality(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, centrality): degree over the number of other vertices; 0 for a single one."""
    n = vertices.agg(F.count("*").alias("n"))
    d = degrees(vertices, edges).crossJoin(F.broadcast(n))  # one row
    return d.select("id", half_up(F.when(F.col("n") > 1, F.col("degree") / (F.col("n") - 1)).otherwise(F.lit(0.0)), 6).alias("centrality"))


def hops(edges: DataFrame, sources: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    """(source, id, hops, previous): breadth-first distances from each of ``sources`` (id), ignoring direction.

    ``previous`` is the least neighbour that is one hop nearer. Only the frontier is joined in each round, to
    the edges where they lie unless it is large.
    """
    e = edges.where(F.col("type").isin(list(types))) if types else edges
    e = cut(e.select("src", "dst").where("src <> dst"))
    front = known = cut(sources.select(F.col("id").alias("source"), "id", F.lit(0).alias("hops"), F.lit(None).cast(sources.schema["id"].dataType).alias("previous")))
    size = front.count()
    for k in count(1):
        ends = front.select("source", F.col("id").alias("at"))
        ends = F.broadcast(ends) if size <= FRONT else ends  # edges need no exchange
        met = [e.join(ends, F.col(a) == F.col("at")).select("source", F.col(b).alias("id"), "at") for a, b in (("src", "dst"), ("dst", "src"))]
        new = met[0].unionByName(met[1]).groupBy("source", "id").agg(F.min("at").alias("previous")).join(known.select("source", "id"), ["source", "id"], "left_anti")
        front = cut(new.select("source", "id", F.lit(k).alias("hops"), "previous"))
        size = front.count()
        if not size:
            break
        known = known.unionByName(front)
    return known


def shortest_path(edges: DataFrame, start, goal, types: Sequence[str] | None = None) -> list | None:
    """Ids on a shortest path, of equal ones the one through the least predecessors; None if there is no path."""
    spark, kind = edges.sparkSession, edges.schema["src"].dataType
    found = hops(edges, spark.createDataFrame([(start,)], f"id {kind.simpleString()}"), types)
    row = found.where(F.col("id") == F.lit(goal)).first()
    path = []
    while row is not None:
        path.append(row["id"])
        row = found.where(F.col("id") == F.lit(row["previous"])).first() if row["previous"] is not None else None
    return path[::-1] or None


def find_path(vertices: DataFrame, edges: DataFrame, start, goal, types: Sequence[str] | None = None) -> dict:
    """``shortest_path`` among ``vertices`` as {found, path, hops}, or {found: False, reason}."""
    known = {r["id"] for r in vertices.where(F.col("id").isin([start, goal])).select("id").collect()}
    if start not in known:
        return {"found": False, "reason": "the start is not in the graph"}
    if goal not in known:
        return {"found": False, "reason": "the goal is not in the graph"}
    if start == goal:
        return {"found": False, "reason": "start and goal are the same"}
    path = shortest_path(induced(edges, vertices), start, goal, types)
    if path is None:
        only = f" by edges of the types {', '.join(types)}" if types else ""
        return {"found": False, "reason": f"no path leads from one to the other{only}"}
    return {"found": True, "path": path, "hops": len(path) - 1}


def neighbourhood(edges: DataFrame, focus) -> DataFrame:
    """Edges among ``focus`` and the vertices next to it."""
    e = undirected(edges)
    near = e.where(F.col("src") == F.lit(focus)).select(F.col("dst").alias("id")).unionByName(edges.sparkSession.createDataFrame([(focus,)], f"id {edges.schema['src'].dataType.simpleString()}"))
    return induced(edges, near.distinct())


def betweenness(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, betweenness): share of shortest directed paths through each vertex, normalised by (n-1)(n-2).

    Paths are counted source by source, sources dealt over all tasks; the graph itself goes to every task, so its size is
    checked first.
    """
    spark, kind = vertices.sparkSession, vertices.schema["id"].dataType.simpleString()
    pairs = induced(edges.select("src", "dst").where("src <> dst").distinct(), vertices)
    n, m = vertices.count(), pairs.count()
    if n > PATH_VERTICES or m > PATH_EDGES:
        raise ValueError(f"betweenness holds a graph of at most {PATH_VERTICES} vertices and {PATH_EDGES} edges in a task; this one has {n} and {m}")
    out: dict = defaultdict(list)
    for r in pairs.collect():
        out[r["src"]].append(r["dst"])
    shared = spark.sparkContext.broadcast({k: sorted(v) for k, v in out.items()})

    def through(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        adjacent, score = shared.value, defaultdict(float)
        for batch in batches:
            for s in batch["id"]:
                paths, depth, order, before = defaultdict(float, {s: 1.0}), {s: 0}, [], defaultdict(list)
                queue = deque([s])
                while queue:
                    v = queue.popleft()
                    order.append(v)
                    for w in adjacent.get(v, ()):
                        if w not in depth:
                            depth[w] = depth[v] + 1
                            queue.append(w)
                        if depth[w] == depth[v] + 1:
                            paths[w] += paths[v]
                            before[w].append(v)
                share = defaultdict(float)
                for w in reversed(order):
                    for v in before[w]:
                        share[v] += paths[v] / paths[w] * (1 + share[w])
                    if w != s:
                        score[w] += share[w]
        yield pd.DataFrame({"id": pd.Series(list(score), dtype=object), "s": list(score.values())})

    parts = vertices.select("id").repartition(max(1, min(n, spark.sparkContext.defaultParallelism * 4))).mapInPandas(through, f"id {kind}, s double")
    scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    return vertices.select("id").join(parts.groupBy("id").agg(F.sum("s").alias("s")), "id", "left").select("id", half_up(F.coalesce("s", F.lit(0.0)) * scale, 6).alias("betweenness"))


def _per_component(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Undirected edges (src < dst, w) with their component; refuses components beyond the bound of one task."""
    c = connected_components(vertices, edges)
    weighted = edges.where("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("weight").alias("w"))
    own = cut(weighted.join(c.select(F.col("id").alias("src"), "component"), "src"))
    largest = own.groupBy("component").count().agg(F.max("count")).first()[0] or 0
    if largest > COMPONENT_EDGES:
        raise ValueError(f"a component has {largest} edges; one task takes at most {COMPONENT_EDGES}")
    return own


def articulation_points(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component, pieces, sizes): vertices whose removal splits their component, into how many and how large pieces."""
    kind = vertices.schema["id"].dataType.simpleString()

    def find(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        adjacent = defaultdict(list)
        for a, b in zip(pdf["src"], pdf["dst"], strict=True):
            adjacent[a].append(b)
            adjacent[b].append(a)
        root = min(adjacent)
        order, low, size, cuts = {root: 0}, {root: 0}, {root: 1}, defaultdict(list)
        stack = [(root, None, iter(sorted(adjacent[root])))]
        while stack:
            v, parent, rest = stack[-1]
            for w in rest:
                if w == parent:
                    continue
                if w in order:
                    low[v] = min(low[v], order[w])
                else:
                    order[w] = low[w] = len(order)
                    size[w] = 1
                    stack.append((w, v, iter(sorted(adjacent[w]))))
                    break
            else:
                stack.pop()
                if stack:
                    up = stack[-1][0]
                    low[up], size[up] = min(low[up], low[v]), size[up] + size[v]
                    if low[v] >= order[up]:
                        cuts[up].append(size[v])
        rows = []
        for v, below in cuts.items():
            rest = len(order) - 1 - sum(below)
            pieces = sorted([*below, *([rest] if v != root else [])], reverse=True)
            if len(pieces) > 1:
                rows.append((v, key[0], len(pieces), pieces))
        return pd.DataFrame(rows, columns=["id", "component", "pieces", "sizes"], dtype=object)

    return _per_component(vertices, edges).groupBy("component").applyInPandas(find, f"id {kind}, component {kind}, pieces int, sizes array<int>")


def communities(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, community): by moving vertices, in order of id, to the neighbouring group of most modularity gain, then groups
    as vertices, until nothing gains. A community is named by its least id. Deterministic; ties go to the least group."""
    kind = vertices.schema["id"].dataType.simpleString()

    def detect(pdf: pd.DataFrame) -> pd.DataFrame:
        links: dict = defaultdict(lambda: defaultdict(float))
        for a, b, w in zip(pdf["src"], pdf["dst"], pdf["w"], strict=True):
            links[a][b] += w
            links[b][a] += w
        member, total = {v: v for v in links}, sum(sum(x.values()) for x in links.values())
        while True:
            group = {v: v for v in links}
            weight = {v: sum(x.values()) for v, x in links.items()}
            mass, moved, again = dict(weight), False, True
            while again:
                again = False
                for v in sorted(links):
                    own, near = group[v], defaultdict(float)
                    for w, x in links[v].items():
                        if w != v:
                            near[group[w]] += x
                    mass[own] -= weight[v]
                    best = max(sorted({own, *near}), key=lambda g: (round(near[g] - weight[v] * mass[g] / total, 12), g == own))
                    mass[best] += weight[v]
                    if best != own:
                        group[v], again, moved = best, True, True
            if not moved:
                break
            member = {v: group[g] for v, g in member.items()}
            fresh: dict = defaultdict(lambda: defaultdict(float))
            for v, near in links.items():
                for w, x in near.items():
                    fresh[group[v]][group[w]] += x
            links = fresh
        least: dict = {}
        for v, g in member.items():
            least[g] = min(least.get(g, v), v)
        return pd.DataFrame({"id": list(member), "community": [least[g] for g in member.values()]}, dtype=object)

    found = _per_component(vertices, edges).groupBy("component").applyInPandas(detect, f"id {kind}, community {kind}")
    return vertices.select("id").join(found, "id", "left").select("id", F.coalesce("community", "id").alias("community"))


def modularity(edges: DataFrame, groups: DataFrame) -> float:
    """Of (id, community) over the weights of undirected edges."""
    e = edges.where("src <> dst").select("src", "dst", "weight")
    g = groups.select(F.col("id").alias("src"), F.col("community").alias("a")), groups.select(F.col("id").alias("dst"), F.col("community").alias("b"))
    joined = e.join(g[0], "src").join(g[1], "dst")
    m = joined.agg(F.sum("weight")).first()[0]
    if not m:
        return 0.0
    inside = joined.where("a = b").agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    ends = joined.select(F.col("a").alias("c"), "weight").unionByName(joined.select(F.col("b").alias("c"), "weight")).groupBy("c").agg(F.sum("weight").alias("k"))
    return float(inside / m - ends.agg(F.sum(F.pow(F.col("k") / (2.0 * m), 2))).first()[0])


def ranking(scores: DataFrame) -> DataFrame:
    """(id, score, rank) from (id, betweenness, centrality, pieces): weights .35, .35 and .30 of pieces over the most; ties by id."""
    most = scores.agg(F.greatest(F.max("pieces"), F.lit(1)).alias("most"))
    scored = scores.crossJoin(F.broadcast(most)).select("id", half_up(0.35 * F.col("betweenness") + 0.35 * F.col("centrality") + 0.30 * F.col("pieces") / F.col("most"), 6).alias("score"))
    return running_sums(scored, [F.desc("score"), F.col("id")], {"rank": F.lit(1)}).withColumn("rank", F.col("rank").cast("int"))


def community_profiles(groups: DataFrame, vertices: DataFrame, edges: DataFrame, scores: DataFrame) -> DataFrame:
    """(community, size, kinds, edge_types, internal_edges, representatives) of (id, community).

    kinds and edge_types are maps of counts, edges count if both ends are members; representatives: the three members of
    highest betweenness in ``scores`` (id, betweenness), of equal ones the least id.
    """
    member = groups.join(vertices.select("id", "kind"), "id").join(scores.select("id", "betweenness"), "id", "left")
    by_kind = member.groupBy("community", "kind").agg(F.count("*").alias("n")).groupBy("community").agg(F.sum("n").alias("size"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("kinds"))
    a, b = (groups.select(F.col("id").alias(e), F.col("community").alias(f"c_{e}")) for e in ("src", "dst"))
    inside = edges.where("src <> dst").join(a, "src").join(b, "dst").where("c_src = c_dst").groupBy(F.col("c_src").alias("community"), "type").agg(F.count("*").alias("n"))
    by_type = inside.groupBy("community").agg(F.sum("n").alias("internal_edges"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("edge_types"))
    top = Window.partitionBy("community").orderBy(F.desc(F.coalesce("betweenness", F.lit(0.0))), "id")
    first = member.withColumn("k", F.row_number().over(top)).where("k <= 3").groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "id"))), lambda x: x["id"]).alias("representatives"))
    return by_kind.join(by_type, "community", "left").join(first, "community").select("community", "size", "kinds", "edge_types", F.coalesce("internal_edges", F.lit(0)).cast("long").alias("internal_edges"), "representatives")
