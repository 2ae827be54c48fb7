"""Near-duplicate vectors by a robust-pruned flat graph.

Equal vectors of one label are one node. The nodes of a label are one cell at first; a cell with too many members is split around
centres that are fitted on a sample of it, again and again until all fit. A split deals a node to its two nearest parts, so
the shards overlap. Each shard builds a flat graph in which an edge is pruned when a kept neighbour is much closer to
its target; the adjacency lists of a node from all its shards are united. Every node then searches its shards: greedy search
from the medoids and from itself until its best candidates are expanded, then the range of hits is expanded until no new
hit appears. Each hit sends the search on to its other shards, where the rest of its united list is, with the hit as the
entry, until no search leads to a shard that it has not seen. Each node has one home among its shards. Hits are verified by their
cosine in double precision and counted at home, so each link counts once and no list of links is ever made: a shard
returns a count for each node and a spanning forest of its links. ``audit_recall`` measures what was found against brute force.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Store, connected_components, give_back, grouped, small

#: Nodes of a shard at most (a split aims at half), out-degree, pruning factor, search beam.
SHARD, DEGREE, ALPHA, BEAM = 800, 20, 1.2, 16
#: Members of a cell that its centres are fitted on at most, drawn by a hash; parts of one split. Every vector is indexed.
SAMPLE, PARTS = 4_000, 64
#: Rows of a cell that one task deals to its parts, or that search it from outside.
DEALT = 20_000
#: Cells to split (some 50 bytes each) whose sizes are broadcast; more are joined by a shuffle.
BROADCAST_CELLS = 100_000
#: What the range expansion walks through below the threshold.
SLACK = 0.03


def _valid(vec: Column) -> Column:
    """Not null or empty, no null or non-finite component, not zero."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vec, lambda x: x != 0)


def _unit(x):
    import numpy as np

    x = x / np.abs(x).max(1, keepdims=True)  # so that no square over- or underflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column):
    """The vectors of an Arrow column as a matrix."""
    if hasattr(column, "combine_chunks"):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _fit(shard: int, parts: int):
    """The centres of a cell from rows (cell, node, size, vec) of a sample: sample members, moved to their means."""

    def run(key, rows: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        t = pa.Table.from_batches(list(rows)).sort_by("node")
        x, size = _unit(_matrix(t["vec"])), t["size"][0].as_py()
        k = min(max(2, -(-4 * size // shard)), parts, max(2, len(x) // 4))  # each part gets its node and a neighbour's
        centre = x[np.random.default_rng(size).permutation(len(x))[:k]]
        for _ in range(5):
            nearest = (x @ centre.T).argmax(1)
            sums = np.zeros_like(centre)
            np.add.at(sums, nearest, x)
            norm = np.linalg.norm(sums, axis=1, keepdims=True)
            centre = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centre)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([centre.ravel()], pa.list_(pa.float64()))], ["cell", "centres"])

    return grouped(run)


def _deal(left, right):
    """Members of a cell in its parts: one at home in the two nearest, the others in the nearest. Parts that are equally near, as
    vectors of one direction find them, are dealt by the node's number."""
    import numpy as np
    import pyarrow as pa

    kinds = [("cell", pa.string()), ("node", pa.int64()), ("home", pa.bool_()), ("copies", pa.int64()), ("vec", pa.list_(pa.float64()))]
    if not left.num_rows or not right.num_rows:
        return pa.schema(kinds).empty_table()
    x = _unit(_matrix(left["vec"]))
    near = x @ np.array(right["centres"][0].as_py()).reshape(-1, x.shape[1]).T
    node = left["node"].to_numpy()
    k = near.shape[1]
    turn = (np.arange(k) + (node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)[:, None]) % k
    order = np.lexsort((turn, -np.round(near, 12)), axis=1)[:, :2]
    home = left["home"].to_numpy(zero_copy_only=False)
    own = np.flatnonzero(home)
    row, part = np.concatenate([np.arange(len(x)), own]), np.concatenate([order[:, 0], order[own, 1]])
    cell = left["cell"][0].as_py()
    names = pa.array([f"{p}.{cell}" for p in range(k)]).take(pa.array(part))
    stays = np.concatenate([home, np.zeros(len(own), bool)])
    t = left.take(pa.array(row))
    return pa.table([names, t["node"], pa.array(stays), t["copies"], t["vec"]], schema=pa.schema(kinds))


def _salts(size: str) -> Column:
    return F.ceil(F.col(size) / DEALT)


def _shards(store: Store, nodes: DataFrame, shard: int, sample: int) -> DataFrame:
    """(cell, node, home, copies, vec): the nodes (node, label, copies, vec) in cells of ``shard`` members at most.

    The name of a cell is the path of its splits, the length of the vectors and the label.
    """
    cells = nodes.select(F.concat(F.size("vec").cast("string"), F.lit("/"), "label").alias("cell"), "node", F.lit(True).alias("home"), "copies", "vec")
    done = []
    while True:
        sizes = store.put(cells.groupBy("cell").agg(F.count("*").alias("size")).where(F.col("size") > shard))
        n = sizes.count()
        if not n:
            done.append(cells)
            break
        done.append(cells.join(small(sizes, n, BROADCAST_CELLS), "cell", "left_anti"))
        large = cells.join(small(sizes, n, BROADCAST_CELLS), "cell")
        drawn = large.where(F.pmod(F.xxhash64("node"), F.lit(1_000_000)) * F.col("size") < 1_000_000 * sample)
        centres = store.put(drawn.select("cell", "node", "size", "vec").groupBy("cell").applyInArrow(_fit(shard, PARTS), "cell string, centres array<double>"))
        left = large.withColumn("salt", F.pmod(F.xxhash64(F.lit(3), "node"), _salts("size")))
        right = centres.join(sizes, "cell").select("cell", "centres", F.explode(F.sequence(F.lit(0).cast("long"), _salts("size") - 1)).alias("salt"))
        cells = store.put(left.select("cell", "salt", "node", "home", "copies", "vec").groupBy("cell", "salt").cogroup(right.groupBy("cell", "salt")).applyInArrow(_deal, "cell string, node long, home boolean, copies long, vec array<double>"))
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def robust_graph(x, degree: int = DEGREE, alpha: float = ALPHA, seed: int = 5):
    """The neighbours (n, degree; -1 for none) of unit vectors: from the candidates, the nearest first, each kept neighbour prunes
    those that it is ``alpha`` times closer to than the node is. Candidates are the members of the buckets around the
    node's three nearest pivots, and some drawn at random; no node is compared with all others.
    """
    import numpy as np

    n = len(x)
    out = np.full((n, degree), -1, np.int64)
    if n < 2:
        return out
    rng = np.random.default_rng(seed)
    pivots = rng.permutation(n)[: max(1, n // 48)]
    by = min(3, len(pivots))
    pool, far = min(n - 1, degree), min(n - 1, degree // 2)
    nearest = np.argsort(-(x @ x[pivots].T), axis=1)[:, :by]
    cand = rng.integers(0, n, (n, by * pool + far))
    sim = np.full(cand.shape, -2.0)
    sim[:, by * pool :] = np.einsum("ik,ijk->ij", x, x[cand[:, by * pool :]])
    for p in range(len(pivots)):
        member, slot = np.nonzero(nearest == p)
        m = min(pool, len(member) - 1)
        for a in range(0, len(member) if m > 0 else 0, 512):
            rows, at = member[a : a + 512], slot[a : a + 512]
            s = x[rows] @ x[member].T
            s[np.arange(len(rows)), a + np.arange(len(rows))] = -2
            best = np.argpartition(-s, m - 1, axis=1)[:, :m]
            cols = at[:, None] * pool + np.arange(m)
            cand[rows[:, None], cols], sim[rows[:, None], cols] = member[best], np.take_along_axis(s, best, 1)
    for a in range(0, n, 256):
        own = np.arange(a, min(n, a + 256))
        order = np.argsort(-sim[own], axis=1, kind="stable")
        c, s = np.take_along_axis(cand[own], order, 1), np.take_along_axis(sim[own], order, 1)
        alive = (c != own[:, None]) & (s > -2)
        y = x[c]
        for d in range(degree):
            any_left = alive.any(1)
            best = alive.argmax(1)
            chosen = np.take_along_axis(c, best[:, None], 1)[:, 0]
            out[own, d] = np.where(any_left, chosen, -1)
            to = np.einsum("ijk,ik->ij", y, x[chosen])
            alive &= ~(alpha * alpha * (2 - 2 * to) <= 2 - 2 * s)
            alive[np.arange(len(own)), best] = False
            alive &= c != chosen[:, None]
    return out


def _build(degree: int, alpha: float):
    def run(key, rows: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        t = pa.Table.from_batches(list(rows)).sort_by("node")
        node = t["node"].to_numpy()
        graph = robust_graph(_unit(_matrix(t["vec"])), degree, alpha)
        # an edge leads both ways
        a, k = np.nonzero(graph >= 0)
        b = graph[a, k]
        edges = np.unique(np.concatenate([a * len(node) + b, b * len(node) + a]))
        cut = np.searchsorted(edges // len(node), np.arange(len(node) + 1))
        lists = [node[edges[cut[i] : cut[i + 1]] % len(node)] for i in range(len(node))]
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()] * len(node)), t["node"].combine_chunks(), pa.array(lists, pa.list_(pa.int64()))], ["cell", "node", "near"])
        give_back()

    return grouped(run)


def search(x, first, near, queries, entry, threshold: float, beam: int = BEAM, slack: float = SLACK, width: int = 4):
    """Yields (query, place) of what the graph leads each query to within ``slack`` of the threshold.

    ``x`` are the unit vectors of a shard, ``near[first[i] : first[i + 1]]`` the neighbours of i, ``queries`` unit vectors, ``entry`` a place
    for each to start from besides the medoid and the medoids of slices, or -1.
    """
    import numpy as np

    n = len(x)
    starts = [int((x @ x.mean(0)).argmax())]
    for k in range(8):
        part = np.arange(k, n, 8)
        if len(part):
            starts.append(int(part[(x[part] @ x[part].mean(0)).argmax()]))
    starts = np.unique(starts)
    beam = min(beam, n)
    step = max(1, min(512, (16 << 20) // (10 * n)))
    for a in range(0, len(queries), step):
        y, own_entry = queries[a : a + step], entry[a : a + step]
        sim = np.full((len(y), n), -2.0)  # of what the search has visited
        done = np.zeros((len(y), n), bool)
        sim[:, starts] = y @ x[starts].T
        some = np.flatnonzero(own_entry >= 0)
        sim[some, own_entry[some]] = np.einsum("ij,ij->i", y[some], x[own_entry[some]])

        new_at = np.zeros(len(y) * n, bool)

        def expand(rows, nodes, sim=sim, done=done, y=y, new_at=new_at):
            done[rows, nodes] = True
            degree = first[nodes + 1] - first[nodes]
            upto = np.cumsum(degree)
            cut = np.unique(np.append(np.searchsorted(upto, np.arange(0, upto[-1], 300_000)), len(rows))) if len(rows) else []
            for k, z in zip(cut, cut[1:], strict=False):  # a group of near vectors has many hits, and neighbours of each
                own, d = nodes[k:z], degree[k:z]
                r, to = np.repeat(rows[k:z], d), near[np.arange(d.sum()) + np.repeat(first[own] - (np.cumsum(d) - d), d)]
                known = sim[r, to] != -2
                new_at[r[~known] * n + to[~known]] = True
                code = np.flatnonzero(new_at)
                new_at[code] = False
                r, to = code // n, code % n
                for p in range(0, len(r), 50_000):
                    i, j = r[p : p + 50_000], to[p : p + 50_000]
                    sim[i, j] = np.einsum("ij,ij->i", y[i], x[j])

        active = np.arange(len(y))
        while len(active):
            best = np.argpartition(-sim[active], beam - 1, axis=1)[:, :beam]
            s = np.take_along_axis(sim[active], best, 1)
            s[np.take_along_axis(done[active], best, 1)] = -2
            top = np.argsort(-s, axis=1)[:, :width]
            i, j = np.nonzero(np.take_along_axis(s, top, 1) > -2)
            expand(active[i], best[i, top[i, j]])
            active = active[np.unique(i)]
        while True:
            r, v = np.nonzero((sim >= threshold - slack) & ~done)
            if not len(r):
                break
            expand(r, v)
        r, v = np.nonzero(sim >= threshold - slack)
        yield a + r, v


def _roots(n: int, a, b):
    """For each of n places the smallest that it reaches by the links (a, b)."""
    import numpy as np

    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


_FOUND = "kind int, node long, other long, cell string"
#: Kinds of rows that a search returns: links of a node that are at home in the shard; a link of the forest; a shard to search.
COUNT, LINK, ASK = 0, 1, 2


def _look(members, asking, threshold: float, beam: int):
    """Searches a shard (rows cell, node, home, copies, vec, near, cells) for ``asking`` (node, vec, cells, entry), or for its own members."""
    import numpy as np
    import pyarrow as pa

    members = members.sort_by("node")
    cell, node = members["cell"][0].as_py(), members["node"].to_numpy()
    raw = _matrix(members["vec"])
    raw = raw / np.abs(raw).max(1, keepdims=True)
    x, home, copies = _unit(raw), members["home"].to_numpy(zero_copy_only=False), members["copies"].to_numpy()
    shards = members["cells"].to_pylist()
    shard_names, shard_of = np.unique(np.array([c for x in shards for c in x], object), return_inverse=True)
    n_shards = np.fromiter(map(len, shards), np.int64, len(shards))
    first_shard = np.cumsum(n_shards) - n_shards
    lists = members["near"].to_pylist()
    degree = np.fromiter(map(len, lists), np.int64, len(lists))
    ids, of_node = np.fromiter((i for x in lists for i in x), np.int64, degree.sum()), np.repeat(np.arange(len(node)), degree)
    to = np.minimum(np.searchsorted(node, ids), len(node) - 1)
    here = node[to] == ids  # neighbours that this shard has too
    near, first = to[here], np.searchsorted(of_node[here], np.arange(len(node) + 1))
    if asking is None:
        names, y_raw, y, entry, of = node, raw, x, np.arange(len(node)), members["cells"].to_pylist()
    else:
        names = asking["node"].to_numpy()
        y_raw = _matrix(asking["vec"])
        y_raw = y_raw / np.abs(y_raw).max(1, keepdims=True)
        y, of = _unit(y_raw), asking["cells"].to_pylist()
        entry = np.searchsorted(node, asking["entry"].to_numpy())
    length = np.einsum("ij,ij->i", raw, raw)
    links = np.zeros(len(names), np.int64)
    both = np.concatenate([node, names])
    known, code = np.unique(both, return_inverse=True)
    root = np.arange(len(known))
    kind, who, other, where = [], [], [], []
    for r, v in search(x, first, near, y, entry, threshold, beam):
        for k in range(0, len(r), 50_000):
            i, j = r[k : k + 50_000], v[k : k + 50_000]
            new = names[i] != node[j]
            i, j = i[new], j[new]
            b, c = y_raw[i], raw[j]
            sure = np.einsum("ij,ij->i", b, c) / np.sqrt(np.einsum("ij,ij->i", b, b) * length[j]) >= threshold
            counted = sure & home[j]
            links += np.bincount(i[counted], copies[j[counted]], len(names)).astype(np.int64)
            root = _roots(len(known), np.concatenate([np.arange(len(known)), code[len(node) + i[sure]]]), np.concatenate([root, code[j[sure]]]))
            # the other shards of each hit, where the rest of its united list is
            n = n_shards[j]
            to = shard_of[np.arange(n.sum()) + np.repeat(first_shard[j] - (np.cumsum(n) - n), n)]
            _, once = np.unique(np.repeat(i, n) * len(shard_names) + to, return_index=True)
            for q, c, p in zip(np.repeat(i, n)[once].tolist(), shard_names[to[once]], np.repeat(j, n)[once].tolist(), strict=True):
                if c != cell and c not in of[q]:
                    kind.append(ASK)
                    who.append(int(names[q]))
                    other.append(int(node[p]))
                    where.append(c)
    some, tied = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(known)))
    kinds = np.concatenate([np.full(len(some), COUNT), np.full(len(tied), LINK), np.array(kind, np.int64)]).astype(np.int32)
    return pa.table(
        [pa.array(kinds), pa.array(np.concatenate([names[some], known[tied], np.array(who, np.int64)])), pa.array(np.concatenate([links[some], known[root[tied]], np.array(other, np.int64)])), pa.array([None] * (len(some) + len(tied)) + where, pa.string())],
        names=["kind", "node", "other", "cell"],
    )


def _nodes(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows (id, key of the node or null) and the nodes (key, node, least id, copies, label, vec). A node's number is its own
    in the table that is written, whatever ids its rows have."""
    vec, label = F.col("__vec"), F.col("__label")
    # 128 bits stand for the vector in joins
    key = F.md5(F.concat_ws("|", label.cast("string"), F.transform(vec, lambda x: x.cast("string"))).cast("binary"))
    base = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("__label"), F.col(vec_col).cast("array<double>").alias("__vec"))
    base = base.select("id", F.when(label.isNotNull() & F.col("id").isNotNull() & _valid(vec), key).alias("key"), label.cast("string").alias("label"), vec.alias("vec"))
    nodes = base.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vec").alias("vec"))
    return base.select("id", "key"), nodes.withColumn("node", F.monotonically_increasing_id())


def _links(store: Store, nodes: DataFrame, threshold: float, shard: int, degree: int, beam: int, sample: int) -> tuple[DataFrame, DataFrame]:
    """(node, others): the linked vectors of other nodes; (u, v): a spanning forest of the links between nodes."""
    cells = _shards(store, nodes, shard, sample)
    lists = cells.select("cell", "node", "vec").groupBy("cell").applyInArrow(_build(degree, ALPHA), "cell string, node long, near array<long>")
    # lists of a node: one more than there are levels of splits
    union = lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"), F.collect_list("cell").alias("cells"))
    members = store.put(cells.join(union, "node").select("cell", "node", "home", "copies", "vec", "near", "cells"))

    def inside(key, rows: Iterator) -> Iterator:
        import pyarrow as pa

        yield from _look(pa.Table.from_batches(list(rows)), None, threshold, beam).to_batches(max_chunksize=10_000)
        give_back()

    def outside(left, right):
        import pyarrow as pa

        if left.num_rows and right.num_rows:
            out = _look(left, right, threshold, beam)
            give_back()
            return out
        return pa.table([pa.array([], pa.int32()), pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.string())], names=["kind", "node", "other", "cell"])

    found = store.put(members.groupBy("cell").applyInArrow(grouped(inside), _FOUND))
    out, seen = found, None
    while True:
        asks = found.where(F.col("kind") == ASK).groupBy("node", "cell").agg(F.min("other").alias("entry"))
        if seen is not None:
            asks = asks.join(seen, ["node", "cell"], "left_anti")
        asks = store.put(asks)
        if not asks.take(1):
            break
        seen = asks.select("node", "cell") if seen is None else seen.union(asks.select("node", "cell"))
        sizes = store.put(asks.groupBy("cell").agg(F.count("*").alias("size")))
        n = sizes.count()
        salted = asks.join(small(sizes, n, BROADCAST_CELLS), "cell").withColumn("salt", F.pmod(F.xxhash64(F.lit(5), "node"), _salts("size"))).drop("size")
        asking = store.put(salted.join(members.where("home").select("node", "vec", "cells"), "node").select("cell", "salt", "node", "entry", "vec", "cells"))
        asked = members.join(small(sizes, n, BROADCAST_CELLS), "cell").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), _salts("size") - 1))).drop("size")
        found = store.put(asked.groupBy("cell", "salt").cogroup(asking.groupBy("cell", "salt")).applyInArrow(outside, _FOUND))
        out = out.union(found)
    degrees = out.where(F.col("kind") == COUNT).groupBy("node").agg(F.sum("other").alias("others"))
    return degrees, out.where(F.col("kind") == LINK).select(F.col("node").alias("u"), F.col("other").alias("v"))


def link_vectors(
    df: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.98,
    shard: int = SHARD,
    degree: int = DEGREE,
    beam: int = BEAM,
    sample: int = SAMPLE,
) -> DataFrame:
    """(id, n_links, component_id, kept) for each row.

    Two rows link when their labels are equal and not null and the cosine is at least ``threshold``. Vectors that
    are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of different
    lengths: n_links 0, component_id the own id, kept. A row with a null id links with nothing; its component_id is null and it
    is kept. Repeated rows count as vectors of their own, in one component. Rows that share an id with different vectors or
    labels are different vectors; each has the links and the component of its own vector. Other columns are not read; an
    empty table gives an empty result. Equal vectors are one node with a number of copies, so they make no pairs.
    """
    store = Store(df.sparkSession)
    rows, nodes = _nodes(df, id_col, vec_col, label_col)
    nodes = store.put(nodes)
    degrees, forest = _links(store, nodes, threshold, shard, degree, beam, sample)
    parts = store.put(connected_components(store, forest))
    named = nodes.select("key", "node", "least", "copies").join(degrees, "node", "left").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = store.put(named.select("key", "least", "component", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("key", "n_links", "component_id")
    # rows without a node are spread, as nulls would all meet in one task
    key = F.coalesce("key", F.concat(F.lit("none"), F.xxhash64("id").cast("string")))
    component = F.coalesce("component_id", "id")
    return rows.withColumn("key", key).join(named, "key", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")
    )


def audit_recall(df: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, block: int = 256, **options) -> tuple[int, int]:
    """(links found, links by brute force) of the rows of ``queries``, a stated set, against all rows, in blocks."""
    store = Store(df.sparkSession)
    wanted = queries.select(F.col(id_col).cast("long").alias("id")).distinct()
    found = link_vectors(df, id_col, vec_col, label_col, threshold, **options).join(wanted, F.col(id_col) == F.col("id"), "left_semi").agg(F.sum("n_links")).first()[0]
    rows, nodes = _nodes(df, id_col, vec_col, label_col)
    nodes = store.put(nodes.withColumn("kind", F.concat_ws("/", F.size("vec"), "label")))
    asked = store.put(rows.join(wanted, "id", "left_semi").groupBy("key").agg(F.count("*").alias("times")).join(nodes.select("key", "kind", "vec"), "key"))
    # the nodes of a label, dealt by a salt, each part against the blocks of the label's queries
    salts = 16
    blocks = asked.withColumn("b", F.pmod(F.xxhash64("key"), F.greatest(F.lit(1), (F.lit(asked.count()) / block).cast("int")))).groupBy("kind", "b").agg(F.collect_list(F.struct("times", "vec")).alias("q"))
    blocks = blocks.select("kind", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"), "q")
    dealt = nodes.select("kind", F.pmod(F.xxhash64(F.lit(3), "node"), F.lit(salts)).cast("long").alias("salt"), "copies", "vec")

    def compare(left, right):
        import numpy as np
        import pyarrow as pa

        total = 0
        if left.num_rows and right.num_rows:
            x, copies = _unit(_matrix(right["vec"])), right["copies"].to_numpy()
            for q in left["q"].to_pylist():
                y = _unit(np.array([r["vec"] for r in q], float))
                total += int(((y @ x.T >= threshold) * copies).sum(1) @ np.array([r["times"] for r in q]))
        return pa.table({"n": pa.array([total], pa.int64())})

    true = blocks.groupBy("kind", "salt").cogroup(dealt.groupBy("kind", "salt")).applyInArrow(compare, "n long").agg(F.sum("n")).first()[0]
    return found or 0, (true or 0) - (asked.agg(F.sum("times")).first()[0] or 0)  # none links with itself
