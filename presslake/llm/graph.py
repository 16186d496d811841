"""Embedding near-duplicates by a robust-pruned flat graph.

1. Equal vectors become one node with a count.
2. Clusters: centroids from a bounded sample, no two of them close to each other. A node is a member of the nearest few
   clusters and at home in the nearest one. A cluster with many members is dealt into shards of bounded size.
3. Every shard builds a graph over its members: candidates are the nearest members and some random ones, robust-pruned
   to few neighbours in different directions. The adjacency lists of a node from all of its shards are united.
4. Every node is searched in its home cluster, greedily from the medoid, from itself and from its own adjacency list,
   until the beam settles; then the search expands along the graph as long as it finds nodes within range. Pairs are
   verified by cosine in double precision. A home cluster of several shards is compared with itself block by block
   instead: there a node has no list in most shards, and no walk is sure to come near it.
5. The search is audited against brute force, node by node, for bounded samples of nodes with no, few and many links
   found. If one of them lacks a link, the search is repeated with more clusters for each node and more neighbours; when
   the tries are used up, all nodes are compared block by block.

A task gives one row for each node it searched, with the number of linked rows, and the links of a spanning forest of
what it found, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presslake.llm.common import written
from presslake.llm.components import components
from presslake.llm.vectors import by_length, matrix, sample, usable

THRESHOLD = 0.95
SAMPLE_ROWS, CLUSTER_ROWS, SHARD_ROWS, OVERLAP, DEGREE = 20000, 1500, 24000, 4, 20
AUDIT_ROWS, MANY_LINKS, TRIES, ROUNDING = 200, 100, 3, 1e-12
ALPHA, WALK, QUERIES, STARTS = 1.2, 48, 128, 12


def centroids(points, count: int, apart: float, seed: int = 1):
    """At most count unit vectors: sampled points that are apart from one another, moved to the means they attract."""
    import numpy as np

    rng = np.random.default_rng(seed)
    chosen: list[int] = []
    for i in rng.permutation(len(points)):
        if len(chosen) >= count:
            break
        if not chosen or (points[chosen] @ points[i]).max() < apart:
            chosen.append(i)
    centers = points[chosen]
    for _ in range(3):
        near = (points @ centers.T).argmax(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, points)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), centers)
    return centers


def robust_prune(points, candidates, degree: int, alpha: float = ALPHA):
    """For each row of candidates (numbers of points; its own row's number or -1 for none), up to degree of them.

    The nearest candidate stays; those much nearer to it than to the point go; and so on. -1 fills up the rest.
    """
    import numpy as np

    n, width = candidates.shape
    out = np.full((n, degree), -1, np.int64)
    for at in range(0, n, 512):
        cand = candidates[at : at + 512]
        own = np.arange(at, at + len(cand))
        there = points[cand]
        to_own = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ijk,ik->ij", there, points[own])))
        among = np.sqrt(np.maximum(0, 2 - 2 * there @ there.transpose(0, 2, 1)))
        far = np.where((cand < 0) | (cand == own[:, None]), np.inf, to_own)
        row = np.arange(len(cand))
        for k in range(degree):
            best = far.argmin(1)
            live = np.isfinite(far[row, best])
            if not live.any():
                break
            out[at + row[live], k] = cand[row[live], best[live]]
            gone = alpha * among[row, best] <= to_own
            far = np.where((gone | (np.arange(width) == best[:, None])) & live[:, None], np.inf, far)
    return out


def build(points, degree: int, seed: int):
    """Adjacency (numbers, -1 for none) over the unit vectors of a shard."""
    import numpy as np

    n = len(points)
    rng = np.random.default_rng(seed)
    near = min(n, 2 * degree)
    lists = np.zeros((n, near), np.int64)
    for at in range(0, n, 256):
        close = points[at : at + 256] @ points.T
        lists[at : at + 256] = np.argpartition(-close, near - 1, axis=1)[:, :near]
    return robust_prune(points, np.concatenate([lists, rng.integers(0, n, (n, degree))], axis=1), degree)


def greedy(points, edges, queries, starts, beam: int):
    """For each query, the beam of nearest nodes that a greedy walk from its starts settles on."""
    import numpy as np

    q = np.arange(len(queries))
    width = starts.shape[1]
    pool = np.full((len(queries), beam), -1, np.int64)
    pool[:, :width] = starts
    score = np.where(pool >= 0, np.einsum("ijk,ik->ij", points[pool], queries), -np.inf)
    open_ = pool >= 0
    live = q
    while len(live):
        ranked = np.where(open_[live], score[live], -np.inf)
        step = ranked.argmax(1)
        go = np.isfinite(ranked[np.arange(len(live)), step])
        live, step = live[go], step[go]
        if not len(live):
            break
        node = pool[live, step]
        open_[live, step] = False
        new = edges[node]
        known = (new[:, :, None] == pool[live][:, None, :]).any(2) | (new < 0)
        gain = np.where(known, -np.inf, np.einsum("ijk,ik->ij", points[new], queries[live]))
        both = np.concatenate([pool[live], np.where(known, -1, new)], axis=1)
        marks = np.concatenate([score[live], gain], axis=1)
        flags = np.concatenate([open_[live], ~known], axis=1)
        # A list may name a node twice; the later one is dropped.
        order = np.argsort(-marks, axis=1, kind="stable")[:, :beam]
        row = np.arange(len(live))[:, None]
        pool[live], score[live], open_[live] = both[row, order], marks[row, order], flags[row, order]
    return pool


def expand(ends, near, nodes):
    """(position in nodes, neighbour) for the neighbours of all nodes; node k's are near[ends[k]:ends[k + 1]]."""
    import numpy as np

    counts = ends[nodes + 1] - ends[nodes]
    position = np.repeat(np.arange(len(nodes)), counts)
    within = np.arange(len(position)) - np.repeat(np.cumsum(counts) - counts, counts)
    return position, near[ends[nodes][position] + within]


def walkable(points, ends, near, width: int):
    """Per node, its width nearest neighbours by number, -1 for none: what a greedy walk looks at."""
    import numpy as np

    owner, other = expand(ends, near, np.arange(len(points)))
    close = np.einsum("ij,ij->i", points[owner], points[other])
    order = np.lexsort((-close, owner))
    owner, other = owner[order], other[order]
    place = np.arange(len(owner)) - ends[owner]
    edges = np.full((len(points), width), -1, np.int64)
    keep = place < width
    edges[owner[keep], place[keep]] = other[keep]
    return edges


def in_range(points, ends, near, edges, queries, starts, threshold: float, beam: int = 16):
    """(query number, node) of all pairs found with cosine >= threshold; each query's range is expanded until it is closed."""
    import numpy as np

    pool = greedy(points, edges, queries, starts, beam)
    seen = np.zeros((len(queries), len(points)), bool)
    owner = np.repeat(np.arange(len(queries)), pool.shape[1])[(pool >= 0).ravel()]
    node = pool[pool >= 0]
    found_q, found_n = [], []
    while len(owner):
        fresh = ~seen[owner, node]
        code = np.unique(owner[fresh] * len(points) + node[fresh])
        owner, node = code // len(points), code % len(points)
        seen[owner, node] = True
        keep = np.zeros(len(owner), bool)
        for at in range(0, len(owner), 1 << 16):
            part = slice(at, at + (1 << 16))
            keep[part] = np.einsum("ij,ij->i", queries[owner[part]], points[node[part]]) >= threshold
        owner, node = owner[keep], node[keep]
        found_q.append(owner)
        found_n.append(node)
        position, node = expand(ends, near, node)
        owner = owner[position]
    return np.concatenate(found_q or [np.zeros(0, np.int64)]), np.concatenate(found_n or [np.zeros(0, np.int64)])


def forest_of(a, b):
    """The least label of each node that pairs (a, b) connect: (nodes, labels)."""
    import numpy as np

    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return nodes, nodes[label]


def _members(nodes: DataFrame, centers, overlap: int) -> DataFrame:
    """(cluster, home, node, v, copies): each node in its nearest clusters."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            points = matrix(batch.column(1))
            close = points @ centers.T
            width = min(overlap, close.shape[1])
            best = np.argsort(-close, axis=1, kind="stable")[:, :width]
            for k in range(width):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(best[:, k].astype(np.int32)), pa.array(np.full(len(points), k == 0)), *batch.columns],
                    ["cluster", "home", "node", "v", "copies"],
                )

    return nodes.select("node", "v", "copies").mapInArrow(run, "cluster int, home boolean, node long, v array<double>, copies long")


def _lists(shards: DataFrame, degree: int) -> DataFrame:
    """(node, near): the adjacency list of every member of every shard, with the reverse edges."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by("node")
        ids, points = table.column("node").to_numpy(), matrix(table.column("v"))
        edges = build(points, degree, int(table.column("cluster")[0].as_py()))
        a, k = np.nonzero(edges >= 0)
        b = edges[a, k]
        a, b = np.concatenate([a, b]), np.concatenate([b, a])
        order = np.argsort(a, kind="stable")
        cuts = np.searchsorted(a[order], np.arange(len(ids) + 1))
        lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids[b[order]]))
        return pa.table({"node": pa.array(ids), "near": lists})

    return shards.groupBy("cluster", "shard").applyInArrow(run, "node long, near array<long>")


def _searched(members: DataFrame, asking: DataFrame, threshold: float) -> DataFrame:
    """(node, linked, a, b): for each node that a shard searched, the rows linked with it there; links (a, b) of a forest."""

    def run(left, right):
        import numpy as np
        import pyarrow as pa

        if not left.num_rows or not right.num_rows:
            return _answer(*[np.zeros(0, np.int64)] * 4)
        left, right = left.sort_by("node"), right.sort_by("node")
        ids, points, copies = left.column("node").to_numpy(), matrix(left.column("v")), left.column("copies").to_numpy()
        owner, near = _flat(left.column("near"))
        at = np.minimum(np.searchsorted(ids, near), len(ids) - 1)
        inside = ids[at] == near
        owner, at = owner[inside], at[inside]
        ends = np.searchsorted(owner, np.arange(len(ids) + 1))
        edges = walkable(points, ends, at, WALK)
        medoid = int((points @ points.mean(0)).argmax())
        asked, queries = right.column("node").to_numpy(), matrix(right.column("v"))
        self_at = np.minimum(np.searchsorted(ids, asked), len(ids) - 1)
        starts = np.full((len(asked), STARTS), -1, np.int64)
        starts[:, 0], starts[:, 1] = medoid, np.where(ids[self_at] == asked, self_at, -1)
        owner, near = _flat(right.column("near"))
        near_at = np.minimum(np.searchsorted(ids, near), len(ids) - 1)
        inside = ids[near_at] == near
        owner, near_at = owner[inside], near_at[inside]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner) + 2
        starts[owner[place < STARTS], place[place < STARTS]] = near_at[place < STARTS]
        starts.sort(axis=1)
        starts[:, 1:][starts[:, 1:] == starts[:, :-1]] = -1
        linked, pairs_a, pairs_b = np.zeros(len(asked), np.int64), [], []
        for k in range(0, len(asked), QUERIES):
            part = slice(k, k + QUERIES)
            q, n = in_range(points, ends, at, edges, queries[part], starts[part], threshold)
            other = ids[n] != asked[part][q]
            q, n = q[other], n[other]
            np.add.at(linked, q + k, copies[n])
            nodes, roots = forest_of(asked[part][q], ids[n])
            pairs_a.append(nodes[nodes != roots])
            pairs_b.append(roots[nodes != roots])
        return _answer(asked, linked, np.concatenate(pairs_a), np.concatenate(pairs_b))

    return members.groupBy("cluster", "shard").cogroup(asking.groupBy("cluster", "shard")).applyInArrow(
        run, "node long, linked long, a long, b long"
    )


def _answer(asked, linked, a, b):
    """The rows of _searched: the nodes asked about with what is linked, and a forest of the pairs (a, b)."""
    import numpy as np
    import pyarrow as pa

    a, b = forest_of(a, b)
    a, b = a[a != b], b[a != b]
    is_node = np.arange(len(asked) + len(a)) < len(asked)
    return pa.table({
        "node": pa.array(np.concatenate([asked, np.zeros(len(a), np.int64)])),
        "linked": pa.array(np.concatenate([linked, np.zeros(len(a), np.int64)])),
        "a": pa.array(np.concatenate([np.zeros(len(asked), np.int64), a]), mask=is_node),
        "b": pa.array(np.concatenate([np.zeros(len(asked), np.int64), b]), mask=is_node),
    })


def all_in_range(ids, points, copies, asked, queries, threshold: float):
    """(linked, a, b): for each query the copies of all other points within range; pairs that connect what is linked."""
    import numpy as np

    linked, pairs_a, pairs_b = np.zeros(len(asked), np.int64), [], []
    root = np.arange(len(ids))  # of each point, a point that earlier queries connect it with
    weight = copies.astype(float)
    for k in range(0, len(asked), QUERIES):
        close = queries[k : k + QUERIES] @ points.T >= threshold
        close &= asked[k : k + QUERIES, None] != ids
        linked[k : k + QUERIES] = (close @ weight).round()
        for row in np.flatnonzero(close.any(1)):
            roots = root[close[row]]
            if (roots != roots[0]).any():
                roots = np.unique(roots)
                root[np.isin(root, roots)] = roots[0]
            pairs_a.append(np.full(1 if roots[0] == roots[-1] else len(roots), asked[k + row]))
            pairs_b.append(ids[roots[: len(pairs_a[-1])]])
    none = [np.zeros(0, np.int64)]
    return linked, np.concatenate(pairs_a or none), np.concatenate(pairs_b or none)


def _compared(members: DataFrame, asking: DataFrame, threshold: float) -> DataFrame:
    """What _searched returns, by comparing the nodes asking (cluster, shards, node, v) with all members of their
    clusters (cluster, shards, shard, node, v, copies). A task has one shard of members and one as large of nodes."""

    def run(left, right):
        import numpy as np

        if not left.num_rows or not right.num_rows:
            return _answer(*[np.zeros(0, np.int64)] * 4)
        asked = right.column("node").to_numpy()
        ids, copies = left.column("node").to_numpy(), left.column("copies").to_numpy()
        return _answer(asked, *all_in_range(ids, matrix(left.column("v")), copies, asked, matrix(right.column("v")), threshold))

    each = F.explode(F.sequence(F.lit(0), F.col("shards") - 1))
    left = members.select("cluster", "shard", each.alias("part"), "node", "v", "copies")
    part = F.pmod(F.xxhash64("node", F.lit("part")), F.col("shards")).cast("int")
    right = asking.select("cluster", each, part, "node", "v").toDF("cluster", "shard", "part", "node", "v")
    return left.groupBy("cluster", "shard", "part").cogroup(right.groupBy("cluster", "shard", "part")).applyInArrow(
        run, "node long, linked long, a long, b long"
    )


def _flat(column):
    """(row, value) of a list column."""
    import numpy as np
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    return np.repeat(np.arange(len(sizes)), sizes), column.flatten().to_numpy(zero_copy_only=False)


def _links(nodes: DataFrame, centers, overlap: int, degree: int, shard_rows: int, threshold: float) -> DataFrame:
    members = _members(nodes, centers, overlap)
    sizes = members.groupBy("cluster").count().select("cluster", F.ceil(F.col("count") / F.lit(shard_rows)).cast("int").alias("shards"))
    members = members.join(sizes, "cluster")
    shards = written(members.withColumn("shard", F.pmod(F.xxhash64("node", "cluster"), F.col("shards")).cast("int")), "shards")
    lists = _lists(shards.select("cluster", "shard", "node", "v"), degree)
    # Every node has lists from a few shards; united they hold what each shard knows of both ends.
    united = lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    united = written(united, "adjacency")
    graph = shards.where("shards = 1").select("cluster", "shard", "node", "v", "copies").join(united, "node")
    at_home = shards.where("home and shards = 1").join(united, "node")
    asking = at_home.select("cluster", "shard", "node", "v", "near").toDF("cluster", "shard", "node", "v", "near")
    large = shards.where("shards > 1")
    return written(_searched(graph, asking, threshold).union(_compared(large, large.where("home"), threshold)), "links")


def _settled(nodes: DataFrame, shard_rows: int, total: int, threshold: float) -> DataFrame:
    """What _links returns, by comparing all nodes with all nodes."""
    shards = nodes.select(F.lit(0).alias("cluster"), F.lit(-(-total // shard_rows)).alias("shards"), "node", "v", "copies")
    shards = shards.withColumn("shard", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int"))
    return written(_compared(shards, shards, threshold), "links")


def _complete(nodes: DataFrame, counts: DataFrame, threshold: float, rows: int) -> bool:
    """Whether every audited node has all of its links, by brute force for up to rows nodes of each kind.

    The kinds are those with no link found, with at most MANY_LINKS and with more; together they are all nodes.
    """
    import numpy as np

    got = F.col("n_links") - F.col("copies") + 1
    drawn = {}
    for kind in (got == 0, (got > 0) & (got <= MANY_LINKS), got > MANY_LINKS):
        drawn.update(zip(*sample(counts.where(kind).select("vec_id", "v"), rows, "audit")))
    ids, points = np.array(list(drawn), np.int64), np.array(list(drawn.values()))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            block, copies = matrix(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False)
            close = points @ block.T
            other = ids[:, None] != batch.column(0).to_numpy(zero_copy_only=False)
            # A pair at the threshold may come out either way.
            least, most = (((close >= threshold + x) & other) @ copies for x in (ROUNDING, -ROUNDING))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(least), pa.array(most)], ["vec_id", "least", "most"])

    real = nodes.select("node", "v", "copies").mapInArrow(run, "vec_id long, least long, most long")
    real = real.groupBy("vec_id").agg(F.sum("least").alias("least"), F.sum("most").alias("most"))
    return real.join(counts, "vec_id").where(~got.between(F.col("least"), F.col("most"))).isEmpty()


def near_duplicates(table: DataFrame, threshold: float = THRESHOLD, overlap: int = OVERLAP, degree: int = DEGREE,
                    cluster_rows: int = CLUSTER_ROWS, shard_rows: int = SHARD_ROWS, sample_rows: int = SAMPLE_ROWS,
                    id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of table, no row for an empty one.

    Two rows are linked if the cosine of their vectors, of one length, is threshold or more; a pair at the threshold but
    for rounding may come out either way. Rows that take no part (vectors.usable) have no links and are components of
    their own. Rows that repeat an id are linked with one another like other rows. A null id has a null component and is
    not kept. Other columns of table, whatever their names, are not read.
    """
    rows = usable(table, id_col, vector_col)
    nodes = rows.groupBy("v").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    nodes = written(nodes.withColumn("raw", F.col("v")).withColumn("v", F.transform("v", lambda x: x / norm)), "nodes")
    parts = [_linked(part, total, threshold, overlap, degree, cluster_rows, shard_rows, sample_rows) for part, total in by_length(nodes)]
    every = table.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("raw"))
    if parts:
        counts, links = (reduce(DataFrame.union, part) for part in zip(*parts))
        found = counts.select("raw", "n_links", F.col("vec_id").alias("node")).join(components(links), "node", "left")
        found = found.withColumn("node", F.coalesce("root", "node")).drop("root")
    else:
        found = nodes.select("raw", F.lit(0).alias("n_links"), "node")
    joined = every.join(found, "raw", "left")
    component = F.coalesce("node", F.col("vec_id"))
    return joined.select(
        "vec_id",
        F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), component).cast("long").alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def _linked(nodes: DataFrame, total: int, threshold: float, overlap: int, degree: int, cluster_rows: int, shard_rows: int,
            sample_rows: int) -> tuple[DataFrame, DataFrame]:
    """(vec_id, v, raw, copies, n_links) of the nodes, whose vectors have one length, and links (a, b) that connect them."""
    _, points = sample(nodes.select(F.col("node").alias("vec_id"), "v"), sample_rows, "clusters")
    many = max(1, min(total // cluster_rows, len(points) // 8))
    centers = centroids(points, many, 0.8)
    for attempt in range(TRIES + 1):
        if attempt < TRIES:
            found = _links(nodes, centers, overlap << attempt, degree << attempt, shard_rows, threshold)
        else:
            found = _settled(nodes, shard_rows, total, threshold)
        linked = found.where("a is null").groupBy("node").agg(F.sum("linked").alias("linked"))
        counts = written(
            nodes.join(linked, "node", "left").select(
                F.col("node").alias("vec_id"), "v", "raw", "copies", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links")
            ), "counts",
        )
        links = found.where("a is not null").select("a", "b")
        if attempt == TRIES or _complete(nodes, counts, threshold, AUDIT_ROWS):
            break
    return counts, links
