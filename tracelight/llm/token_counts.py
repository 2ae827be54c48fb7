"""Token counts of whole texts, huge ones by overlapping chunks that are spliced where both sides provably agree.

The pre-tokenizer reads a text from left to right and looks ahead, never back. So when a chunk's scan and the
true scan share one pre-token boundary, they agree from there on, up to ``GUARD`` characters before the chunk's end. Each chunk is
encoded once, with offsets, and starts inside the one before it. The first boundary in the overlap that both have is
true in both: the ids of the one end there and those of the other begin. If there is none, the overlap is doubled, and
when it has reached the last splice, so is the chunk.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_or_empty

CHUNK, OVERLAP = 32_768, 1_024
#: Longest added token of the vocabulary plus three: what a chunk's end can hide from its last pre-tokens.
GUARD = 16
LIMIT = 1024
_LOADED: dict[str, tuple] = {}


def load(path: str):
    """The tokenizer of a file, and the bytes of each id, kept for the life of a Python worker."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        special = {i: a.content for i, a in t.get_added_tokens_decoder().items()}
        vocab = t.get_vocab(with_added_tokens=True)
        sizes = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():  # a byte-level token has one character a byte
            sizes[i] = len(special[i].encode()) if i in special else len(token)
        if max([0, *map(len, special.values())]) + 3 > GUARD:
            raise ValueError("an added token is longer than GUARD allows")
        _LOADED[path] = t, sizes
    return _LOADED[path]


def _scan(path: str, text: str):
    """Ids of a chunk, and for each the byte where it starts if it starts a pre-token, else -1."""
    import numpy as np

    t, sizes = load(path)
    e = t.encode(text, add_special_tokens=False)
    ids = np.array(e.ids, np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes[ids])])[:-1] if len(ids) else ids
    word = np.array([-1 if w is None else w for w in e.word_ids], np.int64)
    first = np.ones(len(ids), bool)
    first[1:] = word[1:] != word[:-1]
    return ids, np.where(first, starts, -1)


def encode_long(text: str, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[list[int], int]:
    """The ids of a whole text, from chunks of ``chunk`` characters that overlap by ``overlap`` at first, and the number of splices."""
    import numpy as np

    chunk, overlap = max(chunk, 4 * GUARD), max(overlap, 2 * GUARD)
    out: list[np.ndarray] = []
    # a chunk is text[begin:][:len(part)]; its ids are true from its byte ``since`` on, which starts a pre-token
    begin, part, since, back = 0, text[:chunk], 0, overlap
    ids, starts = _scan(path, part)
    while begin + len(part) < len(text):
        spliced = len(part.encode()[:since].decode())
        at = max(spliced, len(part) - back)
        shift = len(part[:at].encode())
        # as long as the overlap twice at least, so it always leads on
        after = text[begin + at :][: max(chunk, 2 * (len(part) - at))]
        new_ids, new_starts = _scan(path, after)
        sure = len(part[: len(part) - GUARD].encode())
        if at == spliced:  # all that is true is in the overlap, and the new chunk begins where a pre-token does
            common = [since]
        else:
            common = np.intersect1d(starts[(starts >= since) & (starts <= sure)], new_starts[new_starts > 0] + shift)
        if not len(common):
            back *= 2
            continue
        cut = int(common[0])
        out.append(ids[np.flatnonzero(starts == since)[0] : np.flatnonzero(starts == cut)[0]])
        begin, part, since, back = begin + at, after, cut - shift, overlap
        ids, starts = new_ids, new_starts
    out.append(ids[np.flatnonzero(starts == since)[0] :])
    return np.concatenate(out).tolist(), len(out) - 1


def count_tokens(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit, n_splices) for each row; other columns are not read.

    A null text counts as an empty one: 0 bytes, 0 tokens. Null ids and repeated rows stay; an empty table gives
    an empty result. No shuffle: texts go from the scan to the tokenizer in batches, and a task holds one batch
    and the ids of one chunk sequence at a time.
    """

    def counted(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            texts = b.column(1).to_pylist()
            n = [0] * len(texts)
            splices = [0] * len(texts)
            short = [i for i, t in enumerate(texts) if len(t) <= chunk]
            t = load(path)[0]
            for k in range(0, len(short), 256):
                for i, e in zip(short[k : k + 256], t.encode_batch_fast([texts[i] for i in short[k : k + 256]], add_special_tokens=False), strict=True):
                    n[i] = len(e.ids)
            for i, x in enumerate(texts):
                if len(x) > chunk:
                    ids, splices[i] = encode_long(x, path, chunk, overlap)
                    n[i] = len(ids)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(splices, pa.int64())], ["id", "n_bytes", "n_tokens", "n_splices"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"), F.octet_length(text_or_empty(text_col)).cast("long").alias("n_bytes"))
    kind = dict(rows.dtypes)["id"]
    out = rows.mapInArrow(counted, f"id {kind}, n_bytes long, n_tokens long, n_splices long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_splices")
