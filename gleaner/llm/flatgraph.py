"""Embedding near-duplicates with a robust-pruned flat graph.

Vectors of a label are dealt to overlapping cluster shards, each to its two nearest centroids.
Each shard gets a graph: a vector's nearest neighbours in the shard, a few random ones, and
those that it serves, pruned so that a neighbour is dropped if a kept one is nearer to it. A
vector's lists from its shards are united. Each vector then searches the shards that may
hold a partner: greedily from the shard's medoid, and from itself where it is a member, with a
beam that grows as long as nodes within range turn up. Every reported link is a cosine
computed in double precision. An audit compares some vectors' links with brute force over
all vectors; if too few were found, the search is repeated with a wider beam and more shards.
"""
from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.boosting import bounded
from gleaner.llm.common import by_value, components, map_columns, map_groups, share
from gleaner.session import snapshot

by_value(__name__)

SHARD = 1_000                # vectors of a label for each centroid
BLOCK = 2_000                # members, or queries, that one task holds of a shard
DEGREE, CANDIDATES, RANDOM, ALPHA = 24, 64, 8, 1.2
MARGIN = 0.12                # how much farther than the nearest centroid a shard is still searched
REACH = 0.05                 # nodes this far below the wanted cosine are still expanded
STEP = 4                     # nodes a query expands at a time


def unit_of(vector) -> np.ndarray | None:
    """The vector at length 1; None for null, empty or zero ones and for null or non-finite parts."""
    if not vector or any(x is None for x in vector):
        return None
    v = np.array(vector, dtype=np.float64)
    top = np.abs(v).max()
    if not np.isfinite(top) or top == 0:
        return None
    v /= top                                        # so that no square overflows
    return v / np.sqrt(v @ v)


def _rows(vectors: DataFrame) -> DataFrame:
    """vec_id, label, dim, unit and mark; equal marks are equal labels and directions."""
    def clean(batch):
        out = {"vec_id": batch["vec_id"], "label": batch["label"], "dim": [], "unit": [], "mark": []}
        for label, vector in zip(batch["label"], batch["embedding"]):
            unit = None if label is None else unit_of(vector)
            raw = None if unit is None else unit.tobytes()
            out["dim"].append(None if unit is None else len(unit))
            out["unit"].append(raw)
            out["mark"].append(None if unit is None else hashlib.blake2b(
                label.encode() + b"\0" + raw, digest_size=16).digest())
        return out

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return map_columns(vectors.select("vec_id", F.col("label").cast("string").alias("label"), "embedding"),
                       f"vec_id {kind}, label string, dim int, unit binary, mark binary", clean)


def _centroids(classes: DataFrame, sample_bytes: int) -> dict[tuple[str, int], np.ndarray]:
    """Centroids of the labels with more than SHARD vectors, from a sample of that many bytes."""
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).filter(F.col("n") > SHARD)
    widest = sizes.agg(F.max("dim")).first()[0]
    if not widest:
        return {}
    most = max(1, sample_bytes // (8 * widest))
    some = bounded(classes.join(sizes, ["label", "dim"]).select("rep", "label", "dim", "n", "unit"),
                   most, "rep", "label").orderBy("rep").collect()
    by: dict[tuple[str, int], list] = {}
    for r in some:
        by.setdefault((r["label"], r["dim"]), []).append(r)
    out = {}
    for key, rows in by.items():
        x = np.stack([np.frombuffer(r["unit"]) for r in rows])
        c = x[:min(-(-rows[0]["n"] // SHARD), max(1, len(x) // 8))].copy()
        for _ in range(6):
            near = (x @ c.T).argmax(axis=1)
            for i in range(len(c)):
                mean = x[near == i].sum(axis=0)
                length = np.sqrt(mean @ mean)
                if length > 0:
                    c[i] = mean / length
        out[key] = c
    return out


def _dealt(classes: DataFrame, centroids, margin: float) -> DataFrame:
    """Adds `members`, the two shards that hold a vector, and `probes`, those it searches.

    Two vectors of cosine 0.93 differ by 0.37, and their cosines with a centroid by 0.05 or so
    in 64 dimensions, so a partner's shard is rarely beyond the margin; the audit tells.
    """
    sent = share(classes.sparkSession, centroids)

    def deal(batch):
        known = sent()
        members, probes = [None] * len(batch["rep"]), [None] * len(batch["rep"])
        groups: dict[tuple[str, int], list[int]] = {}
        for i, key in enumerate(zip(batch["label"], batch["dim"])):
            groups.setdefault(key, []).append(i)
        for key, at in groups.items():
            name = f"{key[0]}|{key[1]}|"
            c = known.get(key)
            if c is None:
                for i in at:
                    members[i] = probes[i] = [name]
                continue
            near = np.stack([np.frombuffer(batch["unit"][i]) for i in at]) @ c.T
            order = np.argsort(-near, axis=1, kind="stable")
            for row, i in enumerate(at):
                own = order[row, :2]
                wide = np.flatnonzero(near[row] >= near[row].max() - margin)
                members[i] = [f"{name}{n}" for n in own]
                probes[i] = [f"{name}{n}" for n in sorted({*own.tolist(), *wide.tolist()})]
        return {**batch, "members": members, "probes": probes}

    kind = classes.schema["rep"].dataType.simpleString()
    return map_columns(classes.select("rep", "size", "label", "dim", "unit"),
                       f"rep {kind}, size bigint, label string, dim int, unit binary,"
                       " members array<string>, probes array<string>", deal)


def _graph(group) -> dict[str, list]:
    """Robust-pruned adjacency lists of one shard block."""
    ids = group["rep"]
    x = np.stack([np.frombuffer(u) for u in group["unit"]])
    n = len(ids)
    if n == 1:
        return {"node": ids, "near": [[]]}
    close = x @ x.T
    np.fill_diagonal(close, -2)
    c = min(CANDIDATES, n - 1)
    cand = np.argpartition(-close, c - 1, axis=1)[:, :c]
    rng = np.random.default_rng(n)
    cand = np.concatenate([cand, rng.integers(0, n, (n, RANDOM))], axis=1)
    rows = np.arange(n)[:, None]
    cand = np.take_along_axis(cand, np.argsort(-close[rows, cand], axis=1, kind="stable"), axis=1)
    far = lambda cos: np.sqrt(np.maximum(2 - 2 * cos, 0))
    away = far(close[rows, cand])
    alive = cand != rows
    kept: list[list[int]] = [[] for _ in range(n)]
    for _ in range(DEGREE):
        left = np.flatnonzero(alive.any(axis=1))
        if not len(left):
            break
        pick = cand[left, alive[left].argmax(axis=1)]
        for i, p in zip(left.tolist(), pick.tolist()):
            kept[i].append(p)
        alive[left] &= (ALPHA * far(close[pick[:, None], cand[left]]) > away[left]) & (cand[left] != pick[:, None])
    # lists also hold the nodes they serve: every node is put into the lists of the three of its
    # neighbours that serve fewest, so that it can be reached, then the nearest fill the rest
    served: list[list[int]] = [[] for _ in range(n)]
    for i, ps in enumerate(kept):
        for p in sorted(ps, key=lambda p: len(served[p]))[:3]:
            served[p].append(i)
    for _, i, p in sorted((-close[i, p], i, p) for i, ps in enumerate(kept) for p in ps):
        if len(served[p]) < DEGREE and i not in served[p]:
            served[p].append(i)
    return {"node": ids, "near": [[ids[p] for p in {*a, *b}] for a, b in zip(kept, served)]}


def range_search(x: np.ndarray, lists: list[list[int]], y: np.ndarray, own: np.ndarray,
                 least: float, beam: int) -> np.ndarray:
    """Cosines of the queries `y` with the nodes `x` that their searches reached, else -2.

    A query expands its best nodes while they are among its `beam` best or within range,
    or nearly so; all of the latter are expanded, however many there are. `own` is a query's own node
    or -1.
    """
    n, q = len(x), len(y)
    width = max(map(len, lists), default=0)
    adj = np.full((n, max(width, 1)), -1)
    for i, near in enumerate(lists):
        adj[i, :len(near)] = near
    sim = np.full((q, n), -2.0)
    open_ = np.zeros((q, n), dtype=bool)             # reached, not yet expanded

    def reach(qi, ni):
        sim[qi, ni] = np.einsum("ij,ij->i", y[qi], x[ni])
        open_[qi, ni] = True

    def start(qi, ni):
        fresh = sim[qi, ni] == -2
        reach(qi[fresh], ni[fresh])

    every = np.arange(q)
    start(every, np.full(q, int((x @ x.sum(axis=0)).argmax())))
    start(every[own >= 0], own[own >= 0])
    active = every
    links = None
    while len(active):
        s = sim[active]
        within = open_[active] & (s >= least - REACH)
        if within.sum() > 8 * STEP * len(active):    # many in range: expand them all at once
            if links is None:
                links = np.zeros((n, n), dtype=np.float32)
                real = adj >= 0
                links[np.nonzero(real)[0], adj[real]] = 1
            got = (within.astype(np.float32) @ links > 0) & (s == -2)
            open_[active] &= ~within
            qi, ni = np.nonzero(got)
            for at in range(0, len(qi), 200_000):
                reach(active[qi[at:at + 200_000]], ni[at:at + 200_000])
            continue
        at_least = np.partition(s, n - beam, axis=1)[:, n - beam] if n > beam else np.full(len(active), -2.0)
        score = np.where(open_[active], s, -9.0)
        k = min(STEP, n)
        best = np.argpartition(-score, k - 1, axis=1)[:, :k]
        value = np.take_along_axis(score, best, axis=1)
        good = (value > -2) & ((value >= at_least[:, None]) | (value >= least - REACH))
        alive = good.any(axis=1)
        qi, place = np.nonzero(good)
        node = best[qi, place]
        open_[active[qi], node] = False
        pairs_q = np.repeat(active[qi], adj.shape[1])
        pairs_n = adj[node].ravel()
        keep = pairs_n >= 0
        flat = np.unique(pairs_q[keep] * n + pairs_n[keep])
        flat = flat[sim.ravel()[flat] == -2]
        for at in range(0, len(flat), 200_000):
            reach(flat[at:at + 200_000] // n, flat[at:at + 200_000] % n)
        active = active[alive]
    return sim


def _search(group, least: float, beam: int) -> dict[str, list]:
    """Link counts of the queries of one block, and each node's smallest one in its component."""
    ask = np.array(group["ask"], dtype=bool)
    m, q = np.flatnonzero(~ask), np.flatnonzero(ask)
    if not len(m) or not len(q):
        return None
    ids = np.array(group["rep"])
    units = [np.frombuffer(u) for u in group["unit"]]
    x, y = np.stack([units[i] for i in m]), np.stack([units[i] for i in q])
    place = {v: i for i, v in enumerate(ids[m].tolist())}
    lists = [[place[v] for v in group["near"][i] or () if v in place] for i in m]
    own = np.array([place.get(v, -1) for v in ids[q].tolist()])
    found = range_search(x, lists, y, own, least, beam) >= least
    # a link that one end has found is also the other's
    both = own >= 0
    square = np.zeros((len(m), len(m)), dtype=bool)
    square[own[both]] = found[both]
    found[both] |= square.T[own[both]]
    found[np.flatnonzero(own >= 0), own[own >= 0]] = False
    # components of this block, over queries and members; a vector may be both
    names, code = np.unique(ids, return_inverse=True)
    qi, mi = np.nonzero(found)
    a, b = code[q][qi], code[m][mi]
    low = np.arange(len(names))
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            break
        low = new
    # a pair that meets in two shards is counted in the smaller one
    shard = group["shard"][0]
    before = [next((s for s in group["members"][i] if s < shard), None) for i in m]
    count = found
    for s in {s for s in before if s}:
        asked = np.array([s in group["probes"][i] for i in q])
        count = count & ~(asked[:, None] & np.array([t == s for t in before])[None])
    size = np.array([group["size"][i] for i in m], dtype=np.int64)
    moved = np.flatnonzero(low != np.arange(len(names)))
    return {"rep": ids[q].tolist() + names[moved].tolist(),
            "links": (count @ size).tolist() + [0] * len(moved),
            "low": names[low[code[q]]].tolist() + names[low[moved]].tolist()}


def _found(placed: DataFrame, graph: DataFrame, least: float, beam: int) -> DataFrame:
    kind = placed.schema["rep"].dataType.simpleString()
    members = placed.select(F.explode("members").alias("shard"), "rep", "size", "unit", "members")
    queries = placed.select(F.explode("probes").alias("shard"), "rep", "unit", "probes")
    n = (members.groupBy("shard").agg(F.count("*").alias("_n")).join(
        queries.groupBy("shard").agg(F.count("*").alias("_q")), "shard")
        .select("shard", F.ceil(F.col("_n") / BLOCK).cast("int").alias("_blocks"),
                F.ceil(F.col("_q") / BLOCK).cast("int").alias("_chunks")))
    n = snapshot(n, "graph-shards")
    own = F.pmod(F.xxhash64("rep"), F.col("_blocks")).cast("int")
    if graph is None:
        return snapshot(map_groups(
            members.join(n, "shard").select("shard", own.alias("block"), "rep", "unit"),
            ["shard", "block"], f"node {kind}, near array<{kind}>", _graph)
            .groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")
    nodes = (members.join(n, "shard").join(graph, F.col("rep") == F.col("node"))
             .select("shard", own.alias("block"), F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("chunk"),
                     "rep", "unit", "size", "near", "members", F.lit(None).cast("array<string>").alias("probes"),
                     F.lit(False).alias("ask")))
    asked = (queries.join(n, "shard")
             .select("shard", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("block"),
                     F.pmod(F.xxhash64(F.lit(1), "rep"), F.col("_chunks")).cast("int").alias("chunk"),
                     "rep", "unit", F.lit(None).cast("bigint").alias("size"),
                     F.lit(None).cast(f"array<{kind}>").alias("near"),
                     F.lit(None).cast("array<string>").alias("members"), "probes", F.lit(True).alias("ask")))
    return snapshot(map_groups(nodes.unionByName(asked), ["shard", "block", "chunk"],
                               f"rep {kind}, links bigint, low {kind}",
                               partial(_search, least=least, beam=beam)), "graph-found")


def audited(placed: DataFrame, counts: DataFrame, least: float, queries: int) -> float:
    """Share of the links of `queries` vectors, drawn by hash, that the search has counted."""
    some = bounded(placed.select("rep", "label", "dim", "unit"), queries, "rep", "label").collect()
    by: dict[tuple[str, int], list] = {}
    for r in some:
        by.setdefault((r["label"], r["dim"]), []).append((r["rep"], bytes(r["unit"])))
    sent = share(placed.sparkSession, by)
    kind = placed.schema["rep"].dataType.simpleString()

    def compare(batch):
        out = {"rep": [], "true": []}
        groups: dict[tuple[str, int], list[int]] = {}
        for i, key in enumerate(zip(batch["label"], batch["dim"])):
            groups.setdefault(key, []).append(i)
        for key, at in groups.items():
            if key not in sent():
                continue
            x = np.stack([np.frombuffer(batch["unit"][i]) for i in at])
            size = np.array([batch["size"][i] for i in at])
            names = np.array([batch["rep"][i] for i in at])
            for rep, unit in sent()[key]:
                out["rep"].append(rep)
                out["true"].append(int(size[(x @ np.frombuffer(unit) >= least) & (names != rep)].sum()))
        return out

    exact = map_columns(placed.select("rep", "size", "label", "dim", "unit"),
                        f"rep {kind}, true bigint", compare).groupBy("rep").agg(F.sum("true").alias("true"))
    both = exact.join(counts, "rep", "left").agg(
        F.sum("true").alias("true"), F.sum(F.least("true", F.coalesce("links", F.lit(0)))).alias("found")).first()
    return both["found"] / both["true"] if both["true"] else 1.0


def near_vectors(vectors: DataFrame, least: float = 0.93, recall: float = 0.98, beam: int = 32,
                 audit_queries: int = 256, sample_bytes: int = 16 << 20) -> DataFrame:
    """vec_id, n_links, component_id, kept and class size of every row of `vectors`.

    Vectors are linked if their labels are equal and not null and their cosine, in double
    precision, is at least `least`. `n_links` counts the other vectors linked directly,
    `component_id` is the smallest vec_id reachable, `kept` marks that one. Null, empty and zero
    vectors, those with null or non-finite parts, and rows without label or vec_id link with
    nothing: 0 links, their own component, kept. Vectors of different length do not link.
    Repeated rows of one vec_id are one vector and are answered each. An empty table gives no
    row. vec_id is an integer; other columns are not read.

    Vectors of equal direction are one class from the start and enter with their number, so
    copies cost one vector. Centroids come from a sample of at most `sample_bytes`; every
    vector is in the graph and every one is a query. A task holds at most about BLOCK members
    and BLOCK queries of a shard; larger shards are cut into blocks that are all searched.
    `audit_queries` vectors are compared with brute force over all vectors, and the beam and
    the margin for shards are widened until their recall is at least `recall`.
    """
    rows = snapshot(_rows(vectors), "vectors")
    real = rows.filter("mark IS NOT NULL AND vec_id IS NOT NULL")
    classes = snapshot(real.select("vec_id", "label", "dim", "unit", "mark").dropDuplicates(["vec_id", "mark"])
                       .groupBy("mark").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("size"), F.first("label").alias("label"),
        F.first("dim").alias("dim"), F.first("unit").alias("unit")), "vector-classes")
    centroids, margin, graph = _centroids(classes, sample_bytes), MARGIN, None
    while True:
        placed = snapshot(_dealt(classes, centroids, margin), "vectors-dealt")
        graph = graph or _found(placed, None, least, beam)
        found = _found(placed, graph, least, beam)
        counts = snapshot(found.groupBy("rep").agg(F.sum("links").alias("links")), "vector-links")
        if audited(placed, counts, least, audit_queries) >= recall:
            break
        if beam > BLOCK:
            raise RuntimeError("the graph search stays below the wanted recall")
        beam, margin = beam * 8, margin * 2
    comp = components(found.select(F.col("rep").alias("a"), F.col("low").alias("b")), "vector-classes")
    joined = (real.select("vec_id", "mark").distinct().join(classes.select("mark", "rep", "size"), "mark")
              .join(counts, "rep").join(comp, F.col("rep") == F.col("node"), "left")
              .groupBy("vec_id").agg(F.sum(F.col("links") + F.col("size") - 1).alias("n"),
                                     F.min(F.coalesce("root", "rep")).alias("c"), F.max("size").alias("size")))
    return (rows.select("vec_id").join(joined.withColumnRenamed("vec_id", "_v"), F.col("vec_id") == F.col("_v"), "left")
            .select("vec_id", F.coalesce("n", F.lit(0)).alias("n_links"),
                    F.coalesce("c", "vec_id").alias("component_id"), F.coalesce("size", F.lit(1)).alias("class_size"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))
