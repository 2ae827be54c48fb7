"""Exact Jaccard join of documents on word shingles, filtered under several global token orders.

1. Each document becomes a set of 64-bit shingle hashes; equal sets are one class from here on.
2. Batches of documents send their shingles, sorted and packed, to hash-range buckets. A bucket finds the
   shingles that two or more classes have and sends only those back, with the number of classes. Shingles
   of one class can never be in an intersection, so what comes back is all that a verification needs.
3. Under any global order of shingles, two sets with Jaccard >= t share a shingle among the first
   n - ceil(t n) + 1 of each. Classes whose own shingles fill that prefix can link with nothing and go. The others
   give prefixes under three orders (rarest first with three tie-breaks of different strength). A pair is a
   candidate only if its prefixes meet under all three.
   It also needs an intersection that fits in the shared shingles of either.
4. Large groups of near copies would make a quadratic number of pairs. So classes first meet only the leader of
   their group (the classes with the same smallest hash, for several hash functions): the class with the least
   share of shingles of its own, as an original has among its edited copies. What does not link with the
   leader meets the group by what it differs in, and only links leave that join. Links merge classes into
   components, and the join of step 3 then makes pairs between different components and groups only.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import Store, connected_components, deal, give_back, grouped, plan_bytes, small, text_or_empty

#: Shingles and documents in a batch that is sent at once, and bytes of input for each bucket; all grow with very large inputs, see ``deal``.
BATCH, BATCH_DOCS, BUCKET_BYTES = 400_000, 60_000, 6 << 20
ORDERS = 3
#: Smallest-hash keys by which a class meets a leader.
LEADERS = 4
#: Parts of a group in which its leader is found.
SALTS = 64
#: Members of a group of near copies that one task compares, for groups of up to 64 times as many.
PART = 256
#: Ids to remove that are broadcast (8 bytes each); more are joined by a shuffle of the documents.
BROADCAST_IDS = 1_000_000


def _prefix(n, percent: int):
    """The prefix length for a set of n at a similarity of percent / 100: n - ceil(n * percent / 100) + 1."""
    return n - -(-n * percent // 100) + 1


def _refs(docs: int):
    """The numbers that name a batch's documents."""
    import numpy as np

    return np.uint16 if docs <= 1 << 16 else np.uint32


def _send(size: int, docs: int, buckets: int, shingle: int):
    """Rows for the buckets from rows (doc_id, text): packed shingles, and the documents themselves."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        from .hashing import pack, shingle_set

        names = ["bucket", "toks", "refs", "sigs", "sizes", "doc_ids", "doc_sigs", "doc_ns"]
        shift = np.uint64(64 - (buckets.bit_length() - 1))

        def flush(ids: list, sigs: list, ns: list, sets: list) -> Iterator:
            own: dict[int, int] = {}
            kept = []
            for i, s in enumerate(sigs):
                if ns[i] and s not in own:
                    own[s] = len(own)
                    kept.append(sets[i])
            toks = np.concatenate(kept) if kept else np.zeros(0, np.uint64)
            refs = np.repeat(np.arange(len(kept), dtype=_refs(docs)), [len(x) for x in kept])
            order = np.argsort(toks, kind="stable")
            toks, refs = toks[order], refs[order]
            table = np.fromiter(own, np.uint64, len(own))
            sizes = np.array([len(x) for x in kept], np.uint32)
            cut = np.searchsorted(toks >> shift if buckets > 1 else np.zeros(len(toks), np.uint64), np.arange(buckets + 1, dtype=np.uint64))
            rows = []
            for b in range(buckets):
                part = slice(cut[b], cut[b + 1])
                if cut[b] < cut[b + 1]:
                    used, local = np.unique(refs[part], return_inverse=True)
                    rows.append((b, pack(toks[part]), local.astype(_refs(docs)).tobytes(), table[used].tobytes(), sizes[used].tobytes(), None, None, None))
            at = int(sigs[0] % buckets) if sigs else 0
            rows.append((at, None, None, None, None, np.array(ids, np.int64).tobytes(), np.array(sigs, np.uint64).tobytes(), np.array(ns, np.int64).tobytes()))
            for k in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if j == 0 else pa.binary()) for j, c in enumerate(zip(*rows[k : k + 64], strict=True))], names)

        ids, sigs, ns, sets, n = [], [], [], [], 0
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    s = shingle_set(text, shingle)
                    ids.append(i)
                    sets.append(s)
                    ns.append(len(s))
                    sigs.append(xxhash.xxh3_64_intdigest(s.tobytes(), len(s)))
                    n += len(s)
                    if n >= size or len(ids) >= docs:
                        yield from flush(ids, sigs, ns, sets)
                        ids, sigs, ns, sets, n = [], [], [], [], 0
        if ids:
            yield from flush(ids, sigs, ns, sets)
        del ids, sigs, ns, sets
        give_back()

    return run


def _return(owners: int, docs: int):
    """From a bucket's rows: the documents as rows, and for each owner the shingles that two or more classes have."""

    def run(key, rows: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .hashing import unpack

        names = ["owner", "doc_id", "sig", "n", "sigs", "sizes", "refs", "toks", "dfs"]
        # entries point into one table of (class, size), so that what is sorted stays narrow
        toks, refs, sigs, sizes, seen = [], [], [], [], 0
        for b in rows:
            for r in b.to_pylist():
                if r["doc_ids"] is not None:
                    ids, s, n = (np.frombuffer(r[k], np.int64) for k in ("doc_ids", "doc_sigs", "doc_ns"))
                    none = pa.nulls(len(ids), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), -1, np.int32)), pa.array(ids), pa.array(s), pa.array(n), *[none] * 5], names)
                    continue
                own = np.frombuffer(r["refs"], _refs(docs))
                toks.append(unpack(r["toks"]))
                refs.append(own.astype(np.uint32) + np.uint32(seen))
                sigs.append(np.frombuffer(r["sigs"], np.uint64))
                sizes.append(np.frombuffer(r["sizes"], np.uint32))
                seen += len(sigs[-1])
        if not toks:
            return
        tok = np.concatenate(toks)
        del toks
        order = np.argsort(tok, kind="stable")
        tok = tok[order]
        same = tok[1:] == tok[:-1]
        keep = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        tok, ref = tok[keep], np.concatenate(refs)[order[keep]]
        del order, same, refs
        sig, size = np.concatenate(sigs)[ref], np.concatenate(sizes)[ref]
        del ref, sigs, sizes
        order = np.lexsort((sig, tok))
        tok, sig, size = tok[order], sig[order], size[order]
        first = np.ones(len(tok), bool)
        first[1:] = (tok[1:] != tok[:-1]) | (sig[1:] != sig[:-1])  # batches that both have a class send it twice
        tok, sig, size = tok[first], sig[first], size[first]
        if not len(tok):
            return
        at = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
        df = np.repeat(np.diff(np.append(at, len(tok))), np.diff(np.append(at, len(tok))))
        keep = df >= 2
        tok, sig, size, df = tok[keep], sig[keep], size[keep], df[keep]
        owner = (sig % np.uint64(owners)).astype(np.int32)
        order = np.lexsort((sig, owner))
        tok, sig, size, df, owner = tok[order], sig[order], size[order], df[order], owner[order]
        cut = np.searchsorted(owner, np.arange(owners + 1))
        for o in range(owners):
            p = slice(cut[o], cut[o + 1])
            if cut[o] < cut[o + 1]:
                table, where, refs = np.unique(sig[p], return_index=True, return_inverse=True)
                made = [table, size[p][where].astype(np.uint32), refs.astype(np.uint32), tok[p], np.minimum(df[p], 1 << 31).astype(np.uint32)]
                yield pa.RecordBatch.from_arrays([pa.array([o], pa.int32()), *(pa.nulls(1, pa.int64()) for _ in range(3)), *(pa.array([x.tobytes()], pa.binary()) for x in made)], names)
        del tok, sig, size, df, owner, order, keep, first, at
        give_back()

    return grouped(run)


def _assemble(percent: int, orders: int, leaders: int):
    """From an owner's rows: the classes that can link at all, with shared shingles, prefixes and leader keys."""

    def run(key, rows: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .hashing import mix64

        parts: list[list] = [[], [], [], []]
        for b in rows:
            for r in b.to_pylist():
                refs = np.frombuffer(r["refs"], np.uint32)
                for to, x in zip(parts, (np.frombuffer(r["sigs"], np.uint64)[refs], np.frombuffer(r["sizes"], np.uint32)[refs], np.frombuffer(r["toks"], np.uint64), np.frombuffer(r["dfs"], np.uint32)), strict=True):
                    to.append(x)
        sig, size, tok, df = map(np.concatenate, parts)
        order = np.lexsort((tok, sig))
        sig, size, tok, df = sig[order], size[order], tok[order], df[order]
        cut = np.append(np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])), len(sig))
        out = []
        for a, z in zip(cut, cut[1:], strict=False):
            n, m = int(size[a]), int(z - a)
            free = _prefix(n, percent) - (n - m)  # the class's own shingles are the rarest and come first under each order
            if free <= 0:
                continue
            t, d = tok[a:z], df[a:z]
            ranks = (d, np.floor(np.log2(d)).astype(np.uint32), d > 16)
            prefixes = [t[np.lexsort((mix64(t, k + 1), ranks[k]))[:free]].view(np.int64) for k in range(orders)]
            keys = np.array([mix64(t, 50 + k).min() for k in range(leaders)], np.uint64).view(np.int64)
            out.append((sig[a : a + 1].view(np.int64)[0], n, m, int(d.sum()) // n, t.view(np.int64), keys, *prefixes))
            if len(out) == 500:
                yield batch(out, pa)
                out = []
        if out:
            yield batch(out, pa)
        del parts, sig, size, tok, df, order, out
        give_back()

    def batch(out, pa):
        cols = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.list_(pa.int64())) for c in cols[4:])], ["sig", "n", "m", "common", "toks", "leaders", *(f"p{k}" for k in range(orders))])

    return grouped(run)


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (u, v) of classes with the sizes (n), shared sizes (m) and shared shingles (t) of both, and the size of their intersection.

    A class can be v of very many pairs, so its set goes to each salted part of them.
    """
    left = sets.select(F.col("sig").alias("u"), F.col("n").alias("nu"), F.col("m").alias("mu"), F.col("toks").alias("tu"))
    right = sets.select(F.col("sig").alias("v"), F.col("n").alias("nv"), F.col("m").alias("mv"), F.col("toks").alias("tv"))
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64(F.lit(13), "u"), F.lit(SALTS)))
    right = pairs.select("v", "salt").distinct().join(right, "v")
    return pairs.join(left, "u").join(right, ["v", "salt"]).drop("salt").withColumn("both", F.size(F.array_intersect("tu", "tv")))


def _similar(both: Column, n: Column, percent: int) -> Column:
    return 100 * both >= percent * (n - both)


def _leader_links(store: Store, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The links within groups of near copies, and the members (u, v) of each group v in which all links are found.

    Every class meets the leader of each of its groups. Of a group in which the leader links with a third or more, members that
    are half like the leader meet the members that do not link with it. Both sets are the leader's but for a few
    shingles, and from these differences alone the size of an intersection follows.
    """
    # one number a class: the share of shared shingles, how common they are, and a hash against ties
    left = lambda x, bits: F.call_function("shiftleft", x, F.lit(bits))
    rank = left((1_000_000 * F.col("m") / F.col("n")).cast("long"), 42) + left(F.least("common", F.lit((1 << 22) - 1)), 20) + F.pmod(F.xxhash64("sig"), F.lit(1 << 20))
    keyed = sets.select("sig", rank.alias("rank"), F.pmod(F.xxhash64(F.lit(9), "sig"), F.lit(SALTS)).alias("salt"), F.posexplode("leaders").alias("k", "key"))
    # the best of each salted part, then of the group, which goes back to each part: no task sees a whole group
    best = lambda v: [F.max_by(v, "rank").alias("v"), F.max("rank").alias("rank")]
    part = keyed.groupBy("k", "key", "salt").agg(*best("sig"), F.count("*").alias("size"))
    leader = part.groupBy("k", "key").agg(*best("v"), F.sum("size").alias("size")).where("size > 1").select("k", "key", "v")
    leader = part.select("k", "key", "salt").join(leader, ["k", "key"])
    pairs = keyed.join(leader, ["k", "key", "salt"]).where(F.col("sig") != F.col("v")).select(F.col("sig").alias("u"), "v").distinct()
    sizes = F.col("nu") + F.col("nv")
    differ = F.concat(F.array_except("tu", "tv"), F.array_except("tv", "tu"))
    near = _with_sets(pairs, sets).where(_similar(F.col("both"), sizes, 50))
    near = store.put(near.select("u", "v", F.col("nu").alias("n"), F.col("mu").alias("m"), _similar(F.col("both"), sizes, percent).alias("linked"), differ.alias("differ")))
    links = near.where("linked").select("u", "v")
    # counted in salted parts, which the result goes back to, so that a large group is never in one task
    salt = F.pmod(F.xxhash64(F.lit(17), "u"), F.lit(SALTS))
    near = near.withColumn("salt", salt)
    counts = near.groupBy("v", "salt").agg(F.count("*").alias("all"), F.count_if("linked").alias("some"))
    groups = counts.groupBy("v").agg(F.sum("all").alias("all"), F.sum("some").alias("some")).where("3 * some >= all")
    # a large group is dealt to several tasks: each of its parts meets all that do not link with the leader
    parts = F.least(F.lit(64), F.ceil(F.col("all") / PART)).cast("int")
    groups = counts.select("v", "salt").join(groups.select("v", parts.alias("parts")), "v")
    members = near.join(groups, ["v", "salt"])
    one = members.where(~F.col("linked")).select("v", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *(F.col(c).alias(f"{c}1") for c in ("u", "n", "m", "differ")))
    two = members.select("v", F.pmod(F.xxhash64("u"), F.col("parts")).cast("int").alias("part"), *(F.col(c).alias(f"{c}2") for c in ("u", "n", "m", "linked", "differ")))
    shared = F.size(F.array_intersect("differ1", "differ2"))
    both = (F.col("m1") + F.col("m2") - F.size("differ1") - F.size("differ2") + 2 * shared) / 2
    bound = (100 + percent) * F.least("m1", "m2") >= percent * (F.col("n1") + F.col("n2"))
    once = F.when(F.col("linked2"), F.lit(True)).otherwise(F.col("u1") < F.col("u2"))
    more = one.join(two, ["v", "part"]).where(once & bound & _similar(both, F.col("n1") + F.col("n2"), percent))
    return links.union(more.select("u1", "u2")).distinct(), members.select("u", "v").union(members.select("v", F.col("v").alias("w")).distinct())


def _meet(at: DataFrame, percent: int) -> DataFrame:
    """(u, v, orders): the pairs of classes (sig, n, m, part, done, prefixes) whose prefixes meet, and the bits of the orders under which
    they do. Pairs of one part, of one group in ``done``, or whose shared shingles are too few for a link are left out."""

    def under(k: int):
        return F.transform(f"p{k}", lambda t: F.struct(F.lit(k).alias("k"), t.alias("tok")))

    posts = at.select("sig", "n", "m", "part", "done", F.explode(F.concat(*map(under, range(ORDERS)))).alias("p")).select("sig", "n", "m", "part", "done", "p.k", "p.tok")
    mixed = posts.groupBy("k", "tok").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a < b").select("k", "tok")
    posts = Store(at.sparkSession).put(posts.join(mixed, ["k", "tok"], "left_semi"))
    a = posts.select("k", "tok", F.col("sig").alias("u"), F.col("n").alias("nu"), F.col("m").alias("mu"), F.col("part").alias("pu"), F.col("done").alias("du"))
    b = posts.select("k", "tok", F.col("sig").alias("v"), F.col("n").alias("nv"), F.col("m").alias("mv"), F.col("part").alias("pv"), F.col("done").alias("dv"))
    bound = (100 + percent) * F.least("mu", "mv") >= percent * (F.col("nu") + F.col("nv"))
    meet = a.join(b, ["k", "tok"]).where((F.col("u") < F.col("v")) & (F.col("pu") != F.col("pv")) & bound & ~F.arrays_overlap("du", "dv"))
    return meet.groupBy("u", "v").agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("k"))).alias("orders"))


def _classes(store: Store, docs: DataFrame, id_col: str, text_col: str, percent: int, shingle: int, batch: int, bucket_bytes: int) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, sig, n), and the classes that can link at all, see ``_assemble``."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    buckets, factor = deal(plan_bytes(rows, "text"), bucket_bytes)
    most = int(BATCH_DOCS * factor)
    sent = rows.mapInArrow(_send(int(batch * factor), most, buckets, shingle), "bucket int, toks binary, refs binary, sigs binary, sizes binary, doc_ids binary, doc_sigs binary, doc_ns binary")
    # a partition for each bucket, as a bucket is what a task is to hold
    back = sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_return(buckets, most), "owner int, doc_id long, sig long, n long, sigs binary, sizes binary, refs binary, toks binary, dfs binary")
    back = store.put(back)
    classes = back.where(F.col("owner") < 0).select("doc_id", "sig", "n")
    shared = back.where(F.col("owner") >= 0).select("owner", "sigs", "sizes", "refs", "toks", "dfs")
    sets = shared.repartition(buckets, "owner").groupBy("owner").applyInArrow(_assemble(percent, ORDERS, LEADERS), "sig long, n long, m long, common long, toks array<long>, leaders array<long>, " + ", ".join(f"p{k} array<long>" for k in range(ORDERS)))
    sets = store.put(sets)
    classes = store.put(classes)
    store.drop(back)
    return classes, sets


def candidate_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, shingle: int = 5, batch: int = BATCH, bucket_bytes: int = BUCKET_BYTES) -> list[int]:
    """How many pairs of classes are candidates under the first order, under the first two, and so on: what each order removes.

    All pairs that meet are counted, also within groups of near copies, so this is an audit for a corpus of moderate size.
    """
    store = Store(docs.sparkSession)
    _, sets = _classes(store, docs, id_col, text_col, percent, shingle, batch, bucket_bytes)
    pairs = _meet(sets.select("*", F.col("sig").alias("part"), F.array().cast("array<bigint>").alias("done")), percent)
    masks = [(2 << k) - 1 for k in range(ORDERS)]
    return list(pairs.agg(*(F.count_if(F.col("orders").bitwiseAND(m) == m) for m in masks)).first())


def _count_shingles(shingle: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from .hashing import shingle_set

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(shingle_set(t, shingle)) for t in b.column(0).to_pylist()], pa.int64())], ["n_shingles"])

    return run


def _sig(texts, shingle: int):
    import numpy as np
    import xxhash

    from .hashing import shingle_set

    sets = (shingle_set(t, shingle) for t in texts)
    return np.array([xxhash.xxh3_64_intdigest(s.tobytes(), len(s)) for s in sets], np.uint64).view(np.int64)


def join_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, shingle: int = 5, batch: int = BATCH, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(id, n_shingles, component_id, class_id, sig, stays) for each row of ``docs``.

    ``component_id`` is the smallest id that a document reaches by links of Jaccard >= percent / 100, ``class_id`` the
    smallest id with the same shingle set, ``sig`` names that set, and ``stays`` marks the one class of each component that a
    deduplication keeps: that of its smallest id. A text with fewer words than a shingle is one shingle of
    all its words; one without words, or null, has an empty set, links with nothing and stays. Equal rows are in one
    class; of rows that share an id with different texts each has its own class. Rows with a null id cannot be
    named by a component: they have their n_shingles, nulls and stay. Other columns are not read; an empty table gives an empty result.

    Shingles and classes are 64-bit hashes: two different sets are taken for one with a chance of 1 in 2^64 a pair.
    """
    store = Store(docs.sparkSession)
    classes, sets = _classes(store, docs, id_col, text_col, percent, shingle, batch, bucket_bytes)
    links, members = _leader_links(store, sets, percent)
    links, members = store.put(links), store.put(members)
    parts = store.put(connected_components(store, links))

    # pairs of different components, of no group that is done, whose prefixes meet under all orders
    done = members.groupBy(F.col("u").alias("sig")).agg(F.collect_set("v").alias("done"))  # LEADERS + 1 at most
    at = sets.join(parts, F.col("sig") == F.col("node"), "left").join(done, "sig", "left")
    at = at.withColumn("part", F.coalesce("component", "sig")).withColumn("done", F.coalesce("done", F.array().cast("array<bigint>")))
    pairs = _meet(at, percent).where(F.col("orders") == (1 << ORDERS) - 1).select("u", "v")
    more = store.put(_with_sets(pairs, sets).where(_similar(F.col("both"), F.col("nu") + F.col("nv"), percent)).select("u", "v"))
    parts = connected_components(store, links.union(more))

    # the smallest id of each class and component; of classes with one smallest id the one that the hash puts first stays
    least = classes.groupBy("sig").agg(F.min("doc_id").alias("class_id"), F.max("n").alias("size"))
    named = store.put(least.join(parts, F.col("sig") == F.col("node"), "left").select("sig", "class_id", F.coalesce("component", "sig").alias("part"), "size"))
    whole = named.groupBy("part").agg(F.min("class_id").alias("component_id"), F.min_by("sig", F.struct("class_id", "sig")).alias("first"))
    of = named.join(whole, "part").select("sig", "class_id", "component_id", (F.col("sig") == F.col("first")).alias("stays"))
    empty = F.col("n") == 0
    own = lambda c: F.when(empty, F.col("doc_id")).otherwise(F.col(c))
    out = classes.join(of, "sig").select(
        F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), own("component_id").alias("component_id"), own("class_id").alias("class_id"), "sig", (empty | (F.col("stays") & (F.col("doc_id") == F.col("class_id")))).alias("stays")
    )
    none = F.lit(None).cast("long")
    nameless = docs.where(F.col(id_col).isNull()).select(text_or_empty(text_col).alias("text")).mapInArrow(_count_shingles(shingle), "n_shingles long")
    return out.unionByName(nameless.select(none.alias(id_col), "n_shingles", none.alias("component_id"), none.alias("class_id"), none.alias("sig"), F.lit(True).alias("stays")))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, shingle: int = 5) -> DataFrame:
    """The rows of ``docs``, with all their columns, less all but the smallest id of each component.

    Of equal rows one stays. Where rows share an id with different texts, each is judged by its own text. Rows with a null
    id or without words stay, as no result names them or they are no copies; of such rows with one id and text one stays.
    """
    store = Store(docs.sparkSession)
    out = join_near_duplicates(docs, id_col, text_col, percent, shingle).where(F.col(id_col).isNotNull())
    of = out.groupBy(id_col).agg(F.max("stays").alias("stays"), F.count("*").alias("rows"))
    of = store.put(of.where(~F.col("stays") | (F.col("rows") > 1)).select(F.col(id_col).alias("__own_id"), F.col("stays").alias("__own_stays")))
    n, repeated = of.agg(F.count("*"), F.count_if("__own_stays")).first()
    # the documents as one column, so that no name of theirs can clash
    rows = docs.select(F.struct(*docs.columns).alias("__own_doc"))
    same = F.col("__own_doc").getField(id_col).cast("long") == F.col("__own_id")
    back = [F.col("__own_doc").getField(c).alias(c) for c in docs.columns]
    kept = rows.join(small(of, n, BROADCAST_IDS), same, "left_anti").select(*back)
    if not repeated:
        return kept
    # rows that share an id: the classes that stay, one row of each

    def signed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_sig(b.column(1).to_pylist(), shingle))], [*b.schema.names, "__own_sig"])

    again = rows.join(small(of.where("__own_stays"), repeated, BROADCAST_IDS), same, "left_semi")
    again = again.select("__own_doc", F.coalesce(F.col("__own_doc").getField(text_col), F.lit("")).alias("__own_text"))
    again = again.mapInArrow(signed, StructType([*again.schema.fields, StructField("__own_sig", LongType())]))
    staying = out.where("stays").select(F.col(id_col).alias("__own_id"), F.col("sig").alias("__own_class")).distinct()
    again = again.join(staying, same & (F.col("__own_sig") == F.col("__own_class")), "left_semi")
    again = again.select("*", F.col("__own_doc").getField(id_col).alias("__own_id")).dropDuplicates(["__own_id", "__own_sig"])
    return kept.unionByName(again.select(*back))


COLUMNS = ["doc_id", "n_shingles", "component_id"]


def sql(documents: str = "documents") -> str:
    """DuckDB SQL for the same result by comparing all pairs that share a shingle."""
    return f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\x0B\\f\\r]+') AS ws FROM {documents}
),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN ws ELSE list_slice(ws, i, i + 4) END AS v
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)
),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.v = b.v AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * shared >= 80 * (nx.n + ny.n - shared)),
r AS (SELECT x AS a, x AS b FROM e UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.m, w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) c ON c.a = w.doc_id
"""
