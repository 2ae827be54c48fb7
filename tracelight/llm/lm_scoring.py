"""Language-model scores by deleted interpolation of bigram, unigram and uniform estimates.

p(w | v) = l2 c(v w) / c(v) + l1 c(w) / N + l0 / (V + 1), where the weights l depend on the bucket of c(v)
(its binary order of magnitude). The weights are learned by expectation-maximisation on the bigrams of a deleted fold of the
training documents, with their exact counts in the other folds; the scores then use the counts of all training folds.

Counts never meet in one place. Documents are packed into batches (about a million tokens) that are written
once. A batch sends its distinct words, later its distinct bigrams, as sorted hashes to hash-range buckets; a bucket adds up the
counts of all batches and answers each batch in the order of its request. What is exchanged grows with the
corpus; a task holds one batch, or one bucket of a bounded share of it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store, deal, fold, give_back, grouped, plan_bytes, text_or_empty

#: Tokens and documents of a batch; bytes of input for each bucket (all grow with very large inputs, see ``deal``); the fold that is
#: never learned from, and the deleted one.
BATCH, BATCH_DOCS, BUCKET_BYTES, HELD_FOLD, DELETED_FOLD = 1_000_000, 50_000, 6 << 20, 1, 2
#: Rounds of EM at most, the change of a weight at which it ends, and what keeps each weight above 0.
EM_ROUNDS, EM_STOP, EM_LEAST = 40, 1e-5, 0.01
#: Rows of counts (32 bytes each) with which the driver does EM itself; more stay a table, and only sums for each bucket come back.
EM_ROWS = 500_000
#: Buckets of contexts; bits of a word's and of a bigram's hash.
CONTEXTS, WORD_BITS, PAIR_BITS = 64, 64, 64
END, BEGIN = 0x5EED0F0E4D, 0x5EED0BE617  # hashes of the end token and of the context before the first word


def _zip(x) -> bytes:
    import pyarrow as pa

    raw = x.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True) if raw else b""


def _unzip(b: bytes, kind):
    import numpy as np
    import pyarrow as pa

    return np.frombuffer(pa.decompress(b[8:], int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True), kind) if b else np.zeros(0, kind)


def _batches(size: int, most: int):
    """Rows of packed documents from rows (doc_id, fold, text)."""

    def run(rows: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from .hashing import pack, word_hashes

        part, seq = TaskContext.get().partitionId(), 0
        end = np.array([END], np.uint64)

        def flush(ids, folds, docs):
            vocab, where, counts = np.unique(np.concatenate([x for d in docs for x in (d, end)]), return_inverse=True, return_counts=True)
            # frequent words get small numbers, whose byte planes compress best; the counts give the order again
            rank = np.empty(len(vocab), np.uint32)
            rank[np.argsort(-counts, kind="stable")] = np.arange(len(vocab), dtype=np.uint32)
            planes = np.ascontiguousarray(rank[where].view(np.uint8).reshape(-1, 4).T)
            cols = [
                pa.array([part << 32 | seq], pa.int64()),
                pa.array([ids], pa.list_(pa.int64())),
                pa.array([np.array(folds, np.uint8).tobytes()], pa.binary()),
                pa.array([np.array([len(d) + 1 for d in docs], np.uint32).tobytes()], pa.binary()),
                pa.array([pack(vocab)], pa.binary()),
                pa.array([_zip(counts.astype(np.uint32))], pa.binary()),
                pa.array([_zip(planes)], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(cols, ["batch", "doc_ids", "folds", "lens", "vocab", "counts", "tokens"])

        ids, folds, docs, n = [], [], [], 0
        for whole in rows:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                for i, f, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    ids.append(i)
                    folds.append(f)
                    docs.append(word_hashes(t))
                    n += len(docs[-1]) + 1
                    if n >= size or len(ids) >= most:
                        yield flush(ids, folds, docs)
                        seq += 1
                        ids, folds, docs, n = [], [], [], 0
        if ids:
            yield flush(ids, folds, docs)
        del ids, folds, docs
        give_back()

    return run


class _Batch:
    """A packed batch: tokens as places in its vocabulary, and the document, fold and context of each."""

    def __init__(self, row: dict):
        import numpy as np

        from .hashing import unpack

        self.doc_ids = row["doc_ids"]
        self.folds = np.frombuffer(row["folds"], np.uint8)
        self.lens = np.frombuffer(row["lens"], np.uint32).astype(np.int64)
        self.vocab = unpack(row["vocab"])
        order = np.argsort(-_unzip(row["counts"], np.uint32).astype(np.int64), kind="stable")
        planes = _unzip(row["tokens"], np.uint8).reshape(4, -1)
        self.tokens = order[np.ascontiguousarray(planes.T).view(np.uint32)[:, 0]]
        self.doc = np.repeat(np.arange(len(self.lens)), self.lens)
        fold_of = self.folds[self.doc]
        self.deleted = fold_of == DELETED_FOLD
        self.kept = ~self.deleted & (fold_of != HELD_FOLD)

    def pairs(self):
        """Distinct (context, word) pairs in the order of their hashes: hash, context and word places; and the place of each token's pair."""
        import numpy as np

        from .hashing import mix64

        v = len(self.vocab)
        context = np.empty(len(self.tokens), np.int64)
        context[1:] = self.tokens[:-1]
        context[np.cumsum(self.lens) - self.lens] = v
        code, place = np.unique(context * (v + 1) + self.tokens, return_inverse=True)
        hashes = np.append(self.vocab, np.uint64(BEGIN))
        h = mix64(mix64(hashes[code // (v + 1)], 1) + hashes[code % (v + 1)], 2) >> np.uint64(64 - PAIR_BITS)
        order = np.argsort(h, kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return h[order], code[order] // (v + 1), code[order] % (v + 1), back[place]

    def counts(self, place, n):
        import numpy as np

        return np.bincount(place[self.kept], minlength=n), np.bincount(place[self.deleted], minlength=n)


_REQUEST = "bucket int, batch long, hashes binary, kept binary, deleted binary, context binary, word binary"
_REPLY = "batch long, bucket int, kept binary, total binary, context long, pair long, word long, weight long, kept_sum long, total_sum long, distinct long"


def _request(batch: int, buckets: int, bits: int, hashes, kept, deleted, context, word):
    import numpy as np
    import pyarrow as pa

    from .hashing import pack

    shift = np.uint64(bits - (buckets.bit_length() - 1))
    cut = np.searchsorted(hashes >> shift, np.arange(buckets + 1, dtype=np.uint64))
    rows = []
    for b in range(buckets):
        p = slice(cut[b], cut[b + 1])
        if cut[b] < cut[b + 1]:
            rows.append((b, batch, pack(hashes[p]), *(_zip(x[p].astype(np.uint32)) for x in (kept, deleted, context, word))))
    cols = zip(*rows, strict=True)
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["bucket", "batch", "hashes", "kept", "deleted", "context", "word"])


def _send_words(buckets: int):
    def run(rows: Iterator) -> Iterator:
        import numpy as np

        for b in rows:
            for r in b.to_pylist():
                x = _Batch(r)
                kept, deleted = x.counts(x.tokens, len(x.vocab))
                none = np.zeros(len(x.vocab), np.uint32)
                yield _request(r["batch"], buckets, WORD_BITS, x.vocab, kept, deleted, none, none)

    return run


def _replies(table, size: int, of: str):
    """The answers to a batch, in the order of its request."""
    import numpy as np

    rows = sorted(table.to_pylist(), key=lambda r: r["bucket"])
    out = np.concatenate([np.zeros(0, np.uint32), *(_unzip(r[of], np.uint32) for r in rows)]).astype(np.float64)
    if len(out) != size:
        raise ValueError(f"a batch asked for {size} counts and got {len(out)}")
    return out


def _send_pairs(buckets: int, kept_docs: int):
    def run(left, right):
        import numpy as np
        import pyarrow as pa

        out = []
        for r in left.to_pylist():
            x = _Batch(r)
            c = np.append(_replies(right, len(x.vocab), "kept"), float(kept_docs))
            h, context, word, place = x.pairs()
            kept, deleted = x.counts(place, len(h))
            # EM needs what stands around deleted counts only
            out.append(_request(r["batch"], buckets, PAIR_BITS, h, kept, deleted, *(np.where(deleted > 0, c[at], 0) for at in (context, word))))
        return pa.Table.from_batches(out)

    return run


def _count(with_history: bool):
    """Adds up a bucket and answers each batch; also sums, and the statistics of the deleted counts for EM."""

    def run(key, rows: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .hashing import unpack

        names = [x.split()[0] for x in _REPLY.split(", ")]
        asked = [r for b in rows for r in b.to_pylist()]
        if not asked:
            return
        hashes = [unpack(r["hashes"]) for r in asked]
        where = np.concatenate(hashes)
        _, first, place = np.unique(where, return_index=True, return_inverse=True)
        kept, deleted = (np.bincount(place, np.concatenate([_unzip(r[k], np.uint32) for r in asked]), len(first)).astype(np.int64) for k in ("kept", "deleted"))
        total = kept + deleted
        at = 0
        for r, h in zip(asked, hashes, strict=True):
            p = place[at : at + len(h)]
            at += len(h)
            cols = [[r["batch"]], [r["bucket"]], [_zip(kept[p].astype(np.uint32)) if not with_history else None], [_zip(total[p].astype(np.uint32))]]
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), *(pa.nulls(1, pa.int64()) for _ in range(7))], names)
        seen = np.flatnonzero(deleted) if with_history else np.zeros(0, np.int64)
        around = []
        for k in ("context", "word"):
            of = np.concatenate([_unzip(r[k], np.uint32) for r in asked])
            to = np.zeros(len(first), np.uint32)
            to[place[of > 0]] = of[of > 0]  # a pair has the same in every batch with deleted counts of it
            around.append(to[seen].astype(np.int64))
        code, back = np.unique(np.stack([around[0], kept[seen], around[1]]), axis=1, return_inverse=True)
        weight = np.bincount(back.ravel(), deleted[seen], code.shape[1]).astype(np.int64)
        for k in range(0, code.shape[1], 50_000):
            h = [pa.array(x[k : k + 50_000]) for x in (*code, weight)]
            n = len(h[0])
            yield pa.RecordBatch.from_arrays([pa.array([-1] * n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), *h, *(pa.nulls(n, pa.int64()) for _ in range(3))], names)
        sums = [pa.array([int(s)], pa.int64()) for s in (kept.sum(), total.sum(), (total > 0).sum())]
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), *(pa.nulls(1, pa.int64()) for _ in range(4)), *sums], names)
        del asked, hashes, where, first, place, kept, deleted, total, around, code, back
        give_back()

    return grouped(run)


def bucket_of(count):
    """The bucket of a context: 0 for one that was never seen, else 1 + the binary order of magnitude of its count."""
    import numpy as np

    return np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))) + 1, 0).astype(int)


def learn_weights(history: DataFrame, n_kept: float, distinct: int, rounds: int = EM_ROUNDS, driver_rows: int = EM_ROWS):
    """The weights (l2, l1, l0) of each context bucket by EM on rows (context, pair, word, weight): how often bigrams with these
    counts occur in the deleted fold. A bucket without such rows takes the weights of the nearest below that has some, else above."""
    import numpy as np

    out = np.tile([0.0, 0.0, 1.0], (CONTEXTS, 1))
    if not n_kept:
        return out
    some = np.zeros(CONTEXTS, bool)
    weights = np.full((CONTEXTS, 3), 1 / 3)
    rare = 1 / (distinct + 1)
    local = history.limit(driver_rows + 1).count() <= driver_rows
    if local:
        t = history.select("context", "pair", "word", "weight").toArrow()
        context, pair, word, weight = (t[c].to_numpy().astype(float) for c in t.column_names)
        of = bucket_of(context)
        p = np.stack([np.divide(pair, context, out=np.zeros(len(context)), where=context > 0), word / n_kept, np.full(len(context), rare)])
    else:
        chance = F.when(F.col("context") > 0, F.col("pair") / F.col("context")).otherwise(0.0)
        magnitude = F.when(F.col("context") > 0, F.length(F.bin("context"))).otherwise(0)
        table = history.select(magnitude.alias("of"), chance.alias("p2"), (F.col("word") / F.lit(float(n_kept))).alias("p1"), F.col("weight").cast("double").alias("weight"))
    for _ in range(rounds):
        if local:
            mixed = weights[of].T * p
            mixed *= weight / mixed.sum(0)
            sums = np.stack([np.bincount(of, m, CONTEXTS) for m in mixed], axis=1)
        else:
            at = [F.get(F.array(*map(F.lit, weights[:, k].tolist())), F.col("of")) for k in range(3)]
            parts = [at[0] * F.col("p2"), at[1] * F.col("p1"), at[2] * F.lit(rare)]
            scale = F.col("weight") / (parts[0] + parts[1] + parts[2])
            sums = np.zeros((CONTEXTS, 3))
            for r in table.groupBy("of").agg(*(F.sum(x * scale).alias(f"s{k}") for k, x in enumerate(parts))).collect():  # a row a bucket
                sums[r["of"]] = r["s0"], r["s1"], r["s2"]
        some = sums.sum(1) > 0
        if not some.any():
            return out
        new = (sums + EM_LEAST) / (sums + EM_LEAST).sum(1, keepdims=True)
        moved = np.abs(new - weights)[some].max()
        weights = new
        if moved < EM_STOP:
            break
    known = np.flatnonzero(some)
    out = weights[[known[known <= b][-1] if (known <= b).any() else known[0] for b in range(CONTEXTS)]]
    out[0, 0] = 0  # an unseen context says nothing
    return out / out.sum(1, keepdims=True)


def _score(weights, n_total: float, distinct: int, n_docs: float):
    def run(left, right):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        out = []
        pairs_of, words_of = right.filter(pc.equal(right["kind"], 2)), right.filter(pc.equal(right["kind"], 1))
        for r in left.to_pylist():
            x = _Batch(r)
            h, context, word, place = x.pairs()
            c1 = _replies(words_of, len(x.vocab), "total")
            c2 = _replies(pairs_of, len(h), "total")
            cc = np.append(c1, n_docs)[context]
            w = weights[bucket_of(cc)]
            p = w[:, 0] * np.divide(c2, cc, out=np.zeros(len(h)), where=cc > 0) + w[:, 1] * c1[word] / max(n_total, 1) + w[:, 2] / (distinct + 1)
            n = len(x.lens)
            score = np.bincount(x.doc, np.log10(p)[place], n)
            base = np.bincount(x.doc, np.log10((c1 + 0.5) / (n_total + 0.5 * (distinct + 1)))[x.tokens], n)
            known = np.bincount(x.doc, (c1 > 0)[x.tokens], n).astype(np.int64)
            cols = [pa.array(x.doc_ids, pa.int64()), pa.array(x.folds == HELD_FOLD), pa.array(x.lens), pa.array(known), pa.array(base), pa.array(score)]
            out.append(pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]))
        return pa.Table.from_batches(out)

    return run


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: int = BATCH, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_token) for each row.

    A null or empty text is one end token. Null ids and repeated rows stay (a null id is in the fold of the
    empty text). Without training documents N = V = 0 and every token has probability 1 / (V + 1). Other columns are not read; an
    empty table gives an empty result. Words and bigrams are 64-bit hashes.
    """
    spark = docs.sparkSession
    store = Store(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), fold(F.col(id_col)).cast("int").alias("fold"), text_or_empty(text_col).alias("text"))
    buckets, factor = deal(plan_bytes(rows, "text"), bucket_bytes)
    packed = store.put(rows.mapInArrow(_batches(int(batch * factor), int(BATCH_DOCS * factor)), "batch long, doc_ids array<long>, folds binary, lens binary, vocab binary, counts binary, tokens binary"))
    words = store.put(packed.mapInArrow(_send_words(buckets), _REQUEST).groupBy("bucket").applyInArrow(_count(False), _REPLY))
    n = words.agg(F.sum("kept_sum"), F.sum("total_sum"), F.sum("distinct")).first()
    n_kept, n_total, distinct = (x or 0 for x in n)
    learned = rows.where(F.col("fold") != HELD_FOLD).agg(F.count("*"), F.count(F.when(F.col("fold") != DELETED_FOLD, 1))).first()
    answers = words.where("batch >= 0")
    asked = packed.groupBy("batch").cogroup(answers.select("batch", "bucket", "kept").groupBy("batch")).applyInArrow(_send_pairs(buckets, learned[1]), _REQUEST)
    pairs = store.put(asked.groupBy("bucket").applyInArrow(_count(True), _REPLY))
    history = store.put(pairs.where("batch < 0 AND weight IS NOT NULL").groupBy("context", "pair", "word").agg(F.sum("weight").alias("weight")))
    weights = learn_weights(history, n_kept, distinct)
    replies = answers.select("batch", "bucket", "total", F.lit(1).alias("kind")).union(pairs.where("batch >= 0").select("batch", "bucket", "total", F.lit(2).alias("kind")))
    out = packed.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(_score(weights, float(n_total), distinct, float(learned[0])), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(
        F.col("doc_id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n_total).cast("long").alias("train_tokens"), "base_score", "score", (-F.col("score") / F.col("n_tokens") / F.lit(0.30102999566398114)).alias("bits_per_token")
    )


COLUMNS = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
