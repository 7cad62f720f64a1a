"""Nearest neighbours by additive quantisation.

A vector is coded as a sum of one word from each of ``M`` full-dimensional
codebooks. Codebooks are started on residuals, and then all fitted together by least
squares on a bounded, documented sample. Encoding is a beam search over the residual
codebooks. Every row is encoded; its norm and that of its decoded sum are stored and
correct the length that quantisation loses. Queries, in blocks of bounded size, meet
packs of encoded vectors: table look-ups give approximate inner products, and the best
``rerank`` vectors of each pack are reranked by exact double-precision products on the
original vectors. Their worst score that still counts is the cut: what quantisation
left of each vector bounds the error of its look-up, and every vector that may reach
the cut within that bound is reranked too, ties and near copies with them. Copies in a
pack are one vector with a list of ids. The packs' lists are merged.

Vectors that are null, empty or zero, of another dimension than most sampled ones,
or hold null or non-finite components take no part. A null id takes no part. Ties go
to the smaller id. Of rows of one id each counts for itself; a query never gets rows
of its own id. With fewer candidates than ``top`` all are returned; without vectors
the result is empty.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, map_batches, schema_of

M = 8
WORDS = 256
BEAM = 4
SAMPLE = 8192
PACK = 4096
QUERIES = 2048
RERANK = 320


def residual_codebooks(x: np.ndarray, m: int, words: int, steps: int = 8, seed: int = 7) -> np.ndarray:
    """k-means on what the codebooks before left over."""
    rng, rest, books = np.random.default_rng(seed), x.copy(), []
    for _ in range(m):
        book = rest[rng.choice(len(rest), words, replace=len(rest) < words)].copy()
        for _ in range(steps):
            near = (-2 * rest @ book.T + (book**2).sum(1)).argmin(1)
            n = np.bincount(near, minlength=words)
            sums = np.zeros_like(book)
            np.add.at(sums, near, rest)
            book = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], book)
        near = (-2 * rest @ book.T + (book**2).sum(1)).argmin(1)
        rest = rest - book[near]
        books.append(book)
    return np.stack(books)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (rows, codebooks) by beam search: ``beam`` partial sums of least error are kept after each codebook."""
    m, words, dim = books.shape
    out = np.zeros((len(x), m), np.uint8)
    norms = (books**2).sum(2)
    for at in range(0, len(x), 1024):
        r = x[at : at + 1024][:, None, :]  # rows, beam, dim: what is left
        codes = np.zeros((len(r), 1, 0), np.uint8)
        for k in range(m):
            error = (r**2).sum(2)[:, :, None] - 2 * r @ books[k].T + norms[k]
            flat = error.reshape(len(r), -1)
            width = min(beam if k < m - 1 else 1, flat.shape[1])
            best = np.argpartition(flat, width - 1, axis=1)[:, :width]
            parent, word = best // words, best % words
            rows = np.arange(len(r))[:, None]
            r = r[rows, parent] - books[k][word]
            codes = np.concatenate((codes[rows, parent], word[:, :, None].astype(np.uint8)), axis=2)
        out[at : at + 1024] = codes[:, 0]
    return out


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(books[k][codes[:, k]] for k in range(len(books)))


def train(x: np.ndarray, m: int = M, words: int = WORDS, rounds: int = 2) -> np.ndarray:
    """Codebooks fitted to ``x``: residual ones, then all words together by least squares on the beam's codes."""
    books = residual_codebooks(x, m, words)
    for _ in range(rounds):
        codes = encode(x, books)
        n = m * words
        column = codes.astype(np.int64) + np.arange(m) * words
        gram, right = np.zeros((n, n)), np.zeros((n, x.shape[1]))
        for a in range(m):
            np.add.at(right, column[:, a], x)
            for b in range(m):
                gram += np.bincount(column[:, a] * n + column[:, b], minlength=n * n).reshape(n, n)
        ridge = 1e-3 * len(x) / words
        books = np.linalg.solve(gram + ridge * np.eye(n), right + ridge * books.reshape(n, -1)).reshape(books.shape)
    return books


def look_up(queries: np.ndarray, codes: np.ndarray, books: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Approximate inner products (queries, rows) from one table of products a query."""
    total = np.zeros((len(queries), len(codes)), np.float32)
    for k in range(len(books)):
        table = (queries @ books[k].T).astype(np.float32)
        total += table[:, codes[:, k]]
    return total * scale.astype(np.float32)


def best_of(qid: np.ndarray, q: np.ndarray, ids: np.ndarray, sizes: np.ndarray, x: np.ndarray, codes: np.ndarray, books: np.ndarray, scale: np.ndarray, error: np.ndarray, top: int, rerank: int):
    """Of one block of queries in one pack: query number, id and exact score of the ``top`` best.

    ``x``: distinct vectors, whose ``sizes`` say how many of the sorted ``ids`` each has.
    ``error``: length of what the codes leave of each vector.
    """
    out = []
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)
    # a query's own rows are at most so many of one vector's
    new = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (owner[1:] != owner[:-1])))
    most = np.minimum(sizes, top + np.diff(np.append(new, len(ids))).max())
    ends = ids[starts], ids[starts + sizes - 1]
    width = min(len(x), max(rerank, top + 1))
    # the look-ups add single-precision products
    slip = 1e-5 * scale.max() * np.sqrt((books**2).sum(2).max(1)).sum()
    for at in range(0, len(q), 256):
        part, own_id = q[at : at + 256], qid[at : at + 256]
        rough = look_up(part, codes, books, scale)
        near = np.argpartition(-rough, width - 1, axis=1)[:, :width]
        exact = np.einsum("qd,qwd->qw", part, x[near])
        # vectors that only the query's own id has do not count for the cut
        exact[(ends[0][near] == own_id[:, None]) & (ends[1][near] == own_id[:, None])] = -np.inf
        length = np.linalg.norm(part, axis=1)
        low = np.partition(exact, width - top, axis=1)[:, width - top] if width >= top else np.full(len(part), -np.inf)
        low -= 1e-9 * (length * np.linalg.norm(x, axis=1).max() + np.abs(low, where=np.isfinite(low), out=np.zeros(len(low))))
        may = ~(rough + length[:, None] * (error + slip) < low[:, None])
        if may.mean() > 1 / 16:
            may &= ~(part @ x.T < low[:, None])
        for lo in range(0, len(part), 16):
            i, r = np.nonzero(may[lo : lo + 16])
            i += lo
            # equal vectors of different packs get equal scores, whatever is scored with them
            score = np.concatenate([np.einsum("nd,nd->n", part[i[k : k + 32768]], x[r[k : k + 32768]]) for k in range(0, max(1, len(i)), 32768)])
            n = most[r]
            row = np.repeat(starts[r] - np.cumsum(n) + n, n) + np.arange(n.sum())
            i, score, found = np.repeat(i, n), np.repeat(score, n), ids[row]
            ok = found != own_id[i]
            i, score, found = i[ok], score[ok], found[ok]
            by = np.lexsort((found, -score, i))
            i, score, found = i[by], score[by], found[by]
            first = np.arange(len(i)) - np.searchsorted(i, i) < top
            out.append((i[first] + at, found[first], score[first]))
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    good = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    return rows.where(good)


def index(df: DataFrame, books: np.ndarray, pack: int = PACK) -> DataFrame:
    """Packs of at most ``pack`` rows: ids by vector, and distinct vectors, their sizes, codes, scales and errors, as binaries. Other dimensions are left out."""
    schema = schema_of("pack string, ids binary, sizes binary, vectors binary, codes binary, scales binary, errors binary")
    dim = books.shape[2]

    def make():
        def step(x):
            rows = [(i, v) for i, v in zip(x["id"], x["v"]) if len(v) == dim]
            if not rows:
                return None
            ids, v = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)
            v, of, sizes = np.unique(v, axis=0, return_inverse=True, return_counts=True)
            ids = ids[np.lexsort((ids, of.reshape(-1)))]
            codes = encode(v, books)
            sums = decode(codes, books)
            scales = np.clip(np.linalg.norm(v, axis=1) / np.maximum(np.linalg.norm(sums, axis=1), 1e-12), 0.5, 2.0)
            errors = np.linalg.norm(v - sums * scales[:, None], axis=1)
            parts = {"ids": ids, "sizes": sizes.astype(np.int64), "vectors": v, "codes": codes, "scales": scales, "errors": errors}
            return {"pack": [None]} | {n: [p.tobytes()] for n, p in parts.items()}

        return step

    return map_batches(df, make, schema, rows=pack)


def blocks(queries: DataFrame, dim: int, n_blocks: int) -> DataFrame:
    """Queries dealt by a hash of their ids to blocks: block, qids and qs as binaries."""
    schema = schema_of("block int, qids binary, qs binary")
    dealt = queries.where(F.size("v") == dim).select(F.pmod(F.xxhash64("id", "v"), F.lit(n_blocks)).cast("int").alias("block"), "id", "v")

    def make():
        def step(x):
            return {
                "block": x["block"], "qids": [np.array([q["id"] for q in qs], np.int64).tobytes() for qs in x["qs"]],
                "qs": [np.array([q["v"] for q in qs], np.float64).tobytes() for qs in x["qs"]],
            }

        return step

    return map_batches(dealt.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("qs")), make, schema, rows=1)


def fit(vectors: DataFrame, sample: int = SAMPLE) -> np.ndarray | None:
    """Codebooks from at most ``sample`` vectors: those with the smallest hashes of their ids."""
    got = vectors.orderBy(F.xxhash64("id"), "id", "v").limit(sample).select("v").collect()
    if not got:
        return None
    sizes = np.bincount([len(r.v) for r in got])
    return train(np.array([r.v for r in got if len(r.v) == sizes.argmax()], np.float64))


def search(df: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", top: int = 20, rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id and score of the nearest rows of each query by inner product."""
    vectors = usable(df, id_col, vec_col)
    queries = usable(df.where(is_query), id_col, vec_col)
    books = fit(vectors)
    empty = df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if books is None:
        return empty
    dim = books.shape[2]
    n_blocks = max(1, -(-queries.count() // QUERIES))
    packs = cut(index(vectors, books)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    met = packs.join(blocks(queries, dim, n_blocks), "block")

    def make():
        def step(x):
            parts = []
            for ids, sizes, v, codes, scales, errors, qids, qs in zip(*(x[n] for n in ("ids", "sizes", "vectors", "codes", "scales", "errors", "qids", "qs"))):
                ids, v, codes = np.frombuffer(ids, np.int64), np.frombuffer(v).reshape(-1, dim), np.frombuffer(codes, np.uint8).reshape(-1, len(books))
                qid = np.frombuffer(qids, np.int64)
                n, i, s = best_of(qid, np.frombuffer(qs).reshape(-1, dim), ids, np.frombuffer(sizes, np.int64), v, codes, books, np.frombuffer(scales), np.frombuffer(errors), top, rerank)
                parts.append((qid[n], n, i, s))
            return {"query_id": np.concatenate([p[0] for p in parts]).tolist(), "n": np.concatenate([p[1] for p in parts]).tolist(), "vec_id": np.concatenate([p[2] for p in parts]).tolist(), "score": np.concatenate([p[3] for p in parts]).tolist(), "block": [b for b, p in zip(x["block"], parts) for _ in p[0]]}

        return step

    from pyspark.sql import Window

    near = map_batches(met, make, schema_of("query_id bigint, n bigint, vec_id bigint, score double, block int"), rows=1)
    w = Window.partitionBy("query_id", "block", "n").orderBy(F.col("score").desc(), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
