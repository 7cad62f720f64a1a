"""Near-duplicates by DartMinHash signatures, banded joining and exact checks.

A text is the weighted set of its five-word shingles, weighted by their counts. Each
element owns a region of width equal to its weight and height equal to a threshold;
a hashed Poisson process of unit rate throws darts into it (regions are cut into
dyadic weight bands so that equal elements of unequal weight share their darts).
Every dart is hashed to one of ``K`` coordinates, and the earliest dart of each
coordinate is kept: coordinates of two texts agree with the probability of their
weighted Jaccard similarity. Where a coordinate got no dart, the threshold is
doubled. Signatures are cut into bands; texts that agree in a band share a bucket.

Every two texts that share a bucket are checked exactly, and once. Pairs of small
buckets are listed. Members of a larger bucket go, once each, to a fixed number of tasks at most, which
hold it in blocks, compare their share of the pairs of blocks, and give a row for each linked
member; rows grow with a bucket, not with its square, and only comparisons with that. Links are joined
to classes by alternating star contractions.

Exact copies are collapsed before anything else. Words are lower-cased runs of
letters, digits, underscores and non-ASCII characters; a text of one to four words is
one shingle; a text without words (or null) is only a copy of equal texts. Rows
alike in id and text share one row of the result. Other columns are ignored.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ._common import cut, map_batches, schema_of
from ._hashing import Prefixes, U, mix

WORDS = 5
SIMILARITY = 0.8
K = 128
ROWS = 4
BANDS = K // ROWS
#: Members of a bucket whose pairs are listed; larger buckets are checked in blocks.
LISTED = 8
#: Members and bytes of text of a block, about.
BLOCK = 256
BLOCK_BYTES = 8 << 20
#: Tasks that the pairs of a bucket are dealt over, at most; its members go to each.
STRIPES = 4
#: Bytes of blocks that a task holds in memory; the others wait in a temporary file.
HELD_BYTES = 64 << 20
#: Texts that share a shingle and are counted pair by pair; more common shingles are counted by matrix products.
RARE = 16
#: Parts that the rows of one text or class are dealt over where they are joined.
SALTS = 8
#: Bytes of text hashed at once.
CHUNK = 1 << 20

WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*b"abcdefghijklmnopqrstuvwxyz0123456789_", *range(128, 256)]] = True


def shingles(texts: list[str], n: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and count of each distinct shingle, sorted by both."""
    blobs = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(blobs) + b"\n", np.uint8)
    ends_of_text = np.cumsum([len(b) + 1 for b in blobs])
    inside = WORD_BYTE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside)).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        z = np.zeros(0, np.int64)
        return z, z.astype(U), z
    text = np.searchsorted(ends_of_text, start, "right")
    with np.errstate(over="ignore"):
        word = mix(Prefixes(data).raw(start, end) + (end - start).astype(U))
        count = np.bincount(text, minlength=len(texts))
        # fewer words than n: all of them are the one shingle
        at = np.arange(len(word))
        first = (np.cumsum(count) - count)[text]
        whole = np.flatnonzero((count[text] >= n) & (at - first <= count[text] - n) | (count[text] < n) & (at == first))
        size = np.minimum(count[text[whole]], n)
        h = np.zeros(len(whole), U)
        padded = np.concatenate((word, np.zeros(n, U)))
        for k in range(n):
            h = np.where(size > k, mix(h * U(0x9E3779B97F4A7C15) + padded[whole + k]), h)
    text = text[whole]
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return text[at], h[at], np.diff(np.append(at, len(h)))


def uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int = K) -> np.ndarray:
    """``k`` coordinates (uint64) of each of ``n`` weighted sets; sets without elements have zeros."""
    sig = np.zeros((n, k), U)
    total = np.bincount(owner, weight, n)
    with np.errstate(divide="ignore"):
        height = k * (np.log(k) + 2) / total
    todo = total > 0
    while todo.any():
        own = todo[owner]
        o, e, w = owner[own], element[own], weight[own].astype(np.float64)
        best = np.full(n * k, np.inf)
        got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        low, width = 0.0, 1.0
        with np.errstate(over="ignore"):
            band = 0
            while len(o):
                # darts in [low, low + width) of the weight axis come at rate ``width``, one after the other
                i, seed, t, step = np.arange(len(o)), mix(e + U(band * 0x632BE59BD9B4E019 & (1 << 64) - 1)), np.zeros(len(o)), 0
                while len(i):
                    step += 1
                    dart = mix(seed[i] + U(step * 0xD1342543DE82EF95 & (1 << 64) - 1))
                    t = t - np.log(uniform(dart)) / width
                    alive = t <= height[o[i]]
                    i, t, dart = i[alive], t[alive], dart[alive]
                    inside = slice(None)
                    if (w[i] < low + width).any():
                        inside = low + width * uniform(mix(dart ^ U(0xA0761D6478BD642F))) <= w[i]
                    d, at = dart[inside], t[inside]
                    key = o[i[inside]] * k + (mix(d ^ U(0xE7037ED1A0B428DB)) % U(k)).astype(np.int64)
                    np.minimum.at(best, key, at)
                    got.append((key, at, d))
                low, width, band = low + width, low + width, band + 1
                more = w > low
                o, e, w = o[more], e[more], w[more]
        flat = sig.reshape(-1)
        for key, at, d in got:
            kept = best[key] == at
            flat[key[kept]] = d[kept]
        full = np.isfinite(best.reshape(n, k)).all(1)
        todo &= ~full
        height = height * 2
    return sig


def bands_of(texts: list[str | None]) -> list[list[int] | None]:
    """Band hashes of each text; None without words."""
    texts = [t or "" for t in texts]
    sig = signatures(*shingles(texts), len(texts))
    with np.errstate(over="ignore"):
        h = np.zeros((len(texts), BANDS), U)
        for r in range(ROWS):
            h = mix(h * U(0x9E3779B97F4A7C15) + sig[:, r::ROWS] + U(r))
        h = mix(h + np.arange(1, BANDS + 1, dtype=U))
    some = sig.any(1)
    return [b if s else None for b, s in zip(h.view(np.int64).tolist(), some)]


def chunks(texts: list[str | None], size: int = CHUNK) -> list[tuple[int, int]]:
    out, start, held = [], 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= size:
            out.append((start, i + 1))
            start, held = i + 1, 0
    return out + ([(start, len(texts))] if start < len(texts) else [])


def copy_key(text_col: str) -> Column:
    """What stands for a whole text: its MD5 in full; null and empty texts differ."""
    return F.md5(F.coalesce(F.col(text_col), F.lit("\0null")))


def sketch(df: DataFrame) -> DataFrame:
    """id, key (of the text), bytes and bands of each row of (id, key, text)."""

    def make():
        def step(x):
            bands = [b for lo, hi in chunks(x["text"]) for b in bands_of(x["text"][lo:hi])]
            return {"id": x["id"], "key": x["key"], "size": x["size"], "bands": bands}

        return step

    with_size = df.select("id", "key", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"), "text")
    return map_batches(with_size, make, schema_of("id bigint, key string, size bigint, bands array<bigint>"), rows=1024)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two sorted (hash, count) sets."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = np.minimum(a[1][i], b[1][j]).sum()
    most = a[1].sum() + b[1].sum() - least
    return float(least) / float(most) if most else 0.0


def checked(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of copies whose texts are at least ``threshold`` alike. ``reps``: copy, text."""
    left = pairs.join(reps.select(F.col("copy").alias("b"), F.col("text").alias("text_b")), "b")
    both = left.join(reps.select(F.col("copy").alias("a"), F.col("text").alias("text_a")), "a")

    def make():
        last: list = [None, None]

        def sets(texts):
            texts = [t or "" for t in texts]
            o, h, c = shingles(texts)
            at = np.searchsorted(o, np.arange(len(texts) + 1))
            return [(h[x:y], c[x:y]) for x, y in zip(at[:-1], at[1:])]

        def step(x):
            pivots = list(dict.fromkeys(x["a"]))
            first = dict(zip(reversed(x["a"]), reversed(x["text_a"])))
            fresh = [p for p in pivots if p != last[0]]
            known = dict(zip(fresh, sets([first[p] for p in fresh])))
            if last[0] in first:
                known[last[0]] = last[1]
            last[:] = [x["a"][-1], known[x["a"][-1]]]
            ok = [similarity(known[a], b) >= threshold for a, b in zip(x["a"], sets(x["text_b"]))]
            return {"a": [a for a, k in zip(x["a"], ok) if k], "b": [b for b, k in zip(x["b"], ok) if k]}

        return step

    return map_batches(both.select("a", "b", "text_a", "text_b"), make, schema_of("a bigint, b bigint"))


def elements(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number and hash of each occurrence of a shingle, and weight of each text."""
    owner, h, count = shingles(texts)
    total = np.bincount(owner, count, len(texts))
    # the nth occurrence of a shingle is an element of its own: common weights are common elements
    owner, h = np.repeat(owner, count), np.repeat(h, count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    with np.errstate(over="ignore"):
        return owner, mix(h + nth.astype(U) * U(0x9E3779B97F4A7C15)), total


def overlaps(owner: np.ndarray, h: np.ndarray, total: np.ndarray, left: int) -> np.ndarray:
    """Common weight of each of the first ``left`` texts with each of the others (all with all if ``left`` is their number), from :func:`elements`."""
    n = len(total)
    by = np.lexsort((owner, h))
    owner, h = owner[by], h[by]
    column = np.cumsum(np.append(True, h[1:] != h[:-1])[: len(h)]) - 1
    held = np.bincount(column)[column] if len(column) else column
    common = np.zeros(n * n)
    some = (held > 1) & (held <= RARE)
    o, c = owner[some], column[some]
    for lag in range(1, RARE):
        x = np.flatnonzero(c[lag:] == c[:-lag])
        if not len(x):
            break
        common += np.bincount(o[x] * n + o[x + lag], minlength=n * n)
    common = common.reshape(n, n)
    common += common.T
    rows, cols = slice(0, left), slice(left % n, n)
    common = common[rows, cols]
    o, c = owner[held > RARE], column[held > RARE]
    kind = np.float32 if len(total) and total.max() < 1 << 24 else np.float64
    if len(c):
        c = np.cumsum(np.append(True, c[1:] != c[:-1])) - 1
        for at in range(0, c[-1] + 1, 2048):
            lo, hi = np.searchsorted(c, (at, at + 2048))
            x = np.zeros((n, 2048), kind)
            x[o[lo:hi], c[lo:hi] - at] = 1
            common += x[rows] @ x[cols].T
    return common


def apart(bucket: int, bands: np.ndarray, wide: np.ndarray, left: int) -> np.ndarray:
    """Pairs that a bucket checks: its first ``left`` members by the others (all by all if ``left`` is their number).

    Pairs that share a listed bucket (not ``wide``) or a larger one of an earlier band
    are left to that bucket.
    """
    n = len(bands)
    here = int(np.flatnonzero(bands[0] == bucket)[0])
    rows, cols = slice(0, left), slice(left % n, n)
    own = np.ones((left, n - left % n), bool)
    if left == n:
        np.fill_diagonal(own, False)
    for k in range(bands.shape[1]):
        same = bands[rows, k][:, None] == bands[cols, k][None, :]
        if k >= here:
            same &= ~wide[rows, k][:, None]
        own &= ~same
    return own


def needed(bucket: int, bands: np.ndarray, wide: np.ndarray, left: int) -> np.ndarray:
    """Which members of a bucket have a pair to check there."""
    own = apart(bucket, bands, wide, left)
    used = np.zeros(len(bands), bool)
    used[:left] |= own.any(1)
    used[left % len(bands) :] |= own.any(0)
    return used


def linked(bucket: int, bands: np.ndarray, wide: np.ndarray, found: tuple[np.ndarray, np.ndarray, np.ndarray], left: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of one bucket among the pairs of :func:`apart`: number of links of each member, and one member of its connected set (-1 without links). ``found``: of :func:`elements`."""
    n = len(bands)
    own = apart(bucket, bands, wide, left)
    owner, h, total = found
    common = overlaps(owner, h, total, left)
    cols = slice(left % n, n)
    most = total[:left, None] + total[None, cols] - common
    ok = own & (common / np.maximum(most, 1) >= threshold)
    degree = np.zeros(n, np.int64)
    degree[:left] += ok.sum(1)
    if left < n:
        degree[left:] += ok.sum(0)
    root = np.full(n, -1)
    for r in np.flatnonzero(degree):
        if root[r] >= 0:
            continue
        new = np.zeros(n, bool)
        new[r] = True
        while new.any():
            root[new] = r
            near = np.zeros(n, bool)
            near[cols] |= ok[new[:left]].any(0)
            if left < n:
                near[:left] |= ok[:, new[left:]].any(1)
            new = near & (root < 0)
    return degree, root


def buckets(reps: DataFrame) -> DataFrame:
    """copy, bucket, and members (n) and bytes (size) of the bucket, of each bucket of several copies. ``reps``: copy, size, bands."""
    each = reps.where(F.col("bands").isNotNull()).select("copy", "size", F.explode("bands").alias("bucket"))
    full = each.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).where("n > 1")
    return each.drop("size").join(full, "bucket")  # most buckets hold one text and end here


def listed_pairs(each: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of copies that share a bucket of at most ``LISTED``. ``each``: :func:`buckets`."""
    few = each.where(F.col("n") <= LISTED).groupBy("bucket").agg(F.sort_array(F.collect_list("copy")).alias("m"))
    firsts = few.select("m", F.posexplode("m").alias("i", "a"))
    return firsts.select("a", F.explode(F.expr("slice(m, i + 2, size(m))")).alias("b")).distinct()


def texts_of(copies: DataFrame, wanted: DataFrame, rows: DataFrame) -> DataFrame:
    """copy and text of the copies in ``wanted``: each is read from its row of least id, so a text that many rows hold is one row of the join."""
    keys = wanted.join(copies.select("copy", "key", "least"), "copy").alias("w")
    met = rows.alias("r").join(keys, (F.col("r.key") == F.col("w.key")) & F.col("r.id").eqNullSafe(F.col("w.least")))
    return met.select("w.copy", "r.text").groupBy("copy").agg(F.first("text").alias("text"))


MEMBER = "bucket bigint, stripe int, block int, blocks int, copy bigint, bands array<bigint>, wide array<boolean>"


class Shelf:
    """Blocks of one group: what goes beyond ``HELD_BYTES`` waits in a temporary file."""

    def __init__(self) -> None:
        self.blocks: list = []
        self.bytes = 0
        self.file = None

    def add(self, block, size: int) -> None:
        self.bytes += size
        if self.bytes <= HELD_BYTES:
            self.blocks.append(block)
            return
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        self.blocks.append(self.file.tell())
        pickle.dump(block, self.file, pickle.HIGHEST_PROTOCOL)

    def __getitem__(self, i: int):
        if not isinstance(self.blocks[i], int):
            return self.blocks[i]
        self.file.seek(self.blocks[i])
        return pickle.load(self.file)

    def __len__(self) -> int:
        return len(self.blocks)


class Block:
    """Members of a bucket that are of one block: their copies, bands, which of these are large buckets, and :func:`elements` of their texts, if they came with them."""

    def __init__(self, members: list[tuple]) -> None:
        self.number, self.blocks = members[0][2:4]
        self.copies = np.array([m[4] for m in members], np.int64)
        self.bands = np.array([m[5] for m in members], np.int64)
        self.wide = np.array([m[6] for m in members], bool)
        self.found = elements([m[7] or "" for m in members]) if len(members[0]) > 7 else None

    def bytes(self) -> int:
        return sum(a.nbytes for a in (self.copies, self.bands, self.wide, *(self.found or ())))

    def met(self, other: Block) -> tuple[np.ndarray, np.ndarray, tuple | None]:
        """bands, wide and found of the members of both."""
        if other is self:
            return self.bands, self.wide, self.found
        found = None
        if self.found is not None:
            found = tuple(np.concatenate(p) for p in zip(self.found, (other.found[0] + len(self.copies), *other.found[1:])))
        return np.concatenate((self.bands, other.bands)), np.concatenate((self.wide, other.wide)), found


def in_stripe(shelf: Shelf, stripe: int, act: Callable[[Block, Block, int, int], None]) -> None:
    """``act(x, y, i, j)`` on every two blocks (i <= j) that the stripe compares."""
    numbers = [shelf[i].number for i in range(len(shelf))]
    for i in range(len(shelf)):
        x = shelf[i]
        for j in range(i, len(shelf)):
            if (numbers[i] + numbers[j]) % min(STRIPES, x.blocks) == stripe:
                act(x, x if j == i else shelf[j], i, j)


def chosen_of(bucket: int, stripe: int, shelf: Shelf):
    """Members that have a pair to check in the stripe."""
    used = [np.zeros(0, bool)] * len(shelf)

    def act(x, y, i, j):
        for k, b in ((i, x), (j, y)):
            if not len(used[k]):
                used[k] = np.zeros(len(b.copies), bool)
        bands, wide, _ = x.met(y)
        if len(bands) < 2:
            return
        u = needed(bucket, bands, wide, len(x.copies))
        used[i] |= u[: len(x.copies)]
        if j > i:
            used[j] |= u[len(x.copies) :]

    in_stripe(shelf, stripe, act)
    for i, u in enumerate(used):
        if u.any():
            b = shelf[i]
            for m in np.flatnonzero(u):
                yield bucket, stripe, b.number, b.blocks, int(b.copies[m]), b.bands[m].tolist(), b.wide[m].tolist()


def links_of(bucket: int, stripe: int, shelf: Shelf, threshold: float):
    """Linked members, one member of each one's connected set, and numbers of links."""
    copies = [shelf[i].copies for i in range(len(shelf))]
    starts = np.cumsum([0, *map(len, copies)])
    degree, parent = np.zeros(starts[-1], np.int64), list(range(starts[-1]))

    def top(v):
        while parent[v] != v:
            parent[v] = v = parent[parent[v]]
        return v

    def act(x, y, i, j):
        bands, wide, found = x.met(y)
        if len(bands) < 2:
            return
        links, root = linked(bucket, bands, wide, found, len(x.copies), threshold)
        at = starts[i] + np.arange(len(x.copies))
        if j > i:
            at = np.concatenate((at, starts[j] + np.arange(len(y.copies))))
        degree[at] += links
        for m in np.flatnonzero(links):
            a, b = top(int(at[m])), top(int(at[root[m]]))
            parent[max(a, b)] = min(a, b)

    in_stripe(shelf, stripe, act)
    every = np.concatenate(copies)
    for m in np.flatnonzero(degree).tolist():
        yield int(every[m]), int(every[top(m)]), int(degree[m])


def by_stripe(members: DataFrame, names: list[str], schema: str, act) -> DataFrame:
    """``act(bucket, stripe, shelf)`` on the blocks of each stripe of a bucket; it gives rows of ``schema``."""
    out_schema = schema_of(schema)

    def make():
        held: list[tuple] = []
        shelf = Shelf()

        def close():
            block = Block(held)
            shelf.add(block, block.bytes())
            held.clear()

        def flush(out):
            nonlocal shelf
            bucket, stripe = held[0][:2]
            close()
            for r in act(bucket, stripe, shelf):
                for name, v in zip(out_schema.names, r):
                    out[name].append(v)
            shelf = Shelf()

        def step(x):
            out: dict = {n: [] for n in out_schema.names}
            for r in zip(*(x[n] for n in names)) if x is not None else ():
                if held and r[:2] != held[0][:2]:
                    flush(out)
                elif held and r[2] != held[0][2]:
                    close()
                held.append(r)
            if x is None and held:
                flush(out)
            return out

        return step

    dealt = members.select(*names).repartition("bucket", "stripe").sortWithinPartitions("bucket", "stripe", "block", "copy")
    return map_batches(dealt, make, out_schema, finish=True)


def links_in_blocks(each: DataFrame, copies: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """Links in buckets of more than ``LISTED`` that no listed pair gives: a (copy), b (another of its connected set), n (links of a).

    Which members have a pair to check is told from their bands alone; only their texts are fetched.
    """
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    wide = cut(each.where(F.col("n") > LISTED).groupBy("copy").agg(F.collect_list(F.struct("bucket", blocks.alias("blocks"))).alias("wide")))
    met = wide.join(copies.select("copy", "bands"), "copy")
    met = met.select("copy", "bands", F.transform("bands", lambda b: F.array_contains("wide.bucket", b)).alias("wide"), F.explode("wide").alias("w"))
    met = met.select("copy", "bands", "wide", "w.bucket", "w.blocks", F.pmod(F.xxhash64("copy", "w.bucket"), "w.blocks").cast("int").alias("block"))
    met = met.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.least(F.lit(STRIPES), "blocks") - 1)))
    names = schema_of(MEMBER).names
    chosen = cut(by_stripe(met, names, MEMBER, chosen_of))
    texts = texts_of(copies, chosen.select("copy").distinct(), rows)
    return by_stripe(chosen.join(texts, "copy"), [*names, "text"], "a bigint, b bigint, n bigint", lambda bucket, stripe, shelf: links_of(bucket, stripe, shelf, threshold))


def classed(rows: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``rows`` (id, key, text), and of each distinct text: key, least (id that holds it), class_id, n_links, and whether its row of least id is the first of its class."""
    sketched = sketch(rows).groupBy("key").agg(F.min("id").alias("least"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    # texts are numbered, and the numbers written, so that whole keys tell them apart and short ones are moved
    copies = cut(sketched.withColumn("copy", F.monotonically_increasing_id()))
    members = cut(buckets(copies))
    pairs = cut(listed_pairs(members))
    ends = lambda e: e.groupBy(F.col("a").alias("copy")).agg(F.count("*").alias("n")).unionByName(e.groupBy(F.col("b").alias("copy")).agg(F.count("*").alias("n")))
    links = cut(checked(pairs, texts_of(copies, ends(pairs).select("copy").distinct(), rows), threshold))
    in_blocks = cut(links_in_blocks(members, copies, rows, threshold))
    named = components(links.unionByName(in_blocks.select("a", "b")))
    degree = ends(links).unionByName(in_blocks.select(F.col("a").alias("copy"), "n")).groupBy("copy").agg(F.sum("n").alias("n_links"))
    order = F.struct(F.col("least").isNull().alias("no"), F.col("least").alias("i"), F.col("key").alias("k"))
    linked_ = copies.select("copy", "key", "least").join(named.withColumnRenamed("node", "copy"), "copy").withColumn("salt", F.pmod(F.xxhash64("copy"), F.lit(SALTS)))
    heads = linked_.groupBy("label").agg(F.min(order).alias("head")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    in_class = linked_.join(heads, ["label", "salt"]).select("copy", F.col("head.i").alias("class_id"), (F.col("head.k") == F.col("key")).alias("first"))
    each = copies.select("copy", "key", "least").join(in_class, "copy", "left").join(degree, "copy", "left")
    return rows, each.select(
        "key", "least", F.when(F.col("first").isNull(), F.col("least")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("first", F.lit(True)).alias("first"),
    )


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), copy_key(text_col).alias("key"), F.col(text_col).alias("text"))


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """One row per distinct (id, text): id, class_id (the least id of its class), copy (key of the text) and n_links.

    n_links: other texts (copies as one) at least ``threshold`` alike that share a bucket. Rows of a
    null id are classed too; a class of null ids only has a null class_id. An empty table gives no rows.
    """
    rows, each = classed(keyed(df, id_col, text_col), threshold)
    # a text that many rows hold is dealt over several tasks
    held = rows.select("id", "key").distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    each = each.select("key", "class_id", "n_links", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return held.join(each, ["key", "salt"]).select(F.col("id").alias(id_col), "class_id", F.col("key").alias("copy"), "n_links")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """``df`` with one row of each class: that of its least id (the least text key among rows of one id).

    Texts without words are kept apart by their exact text only. Rows alike in id and text are one document.
    """
    _, each = classed(keyed(df, id_col, text_col), threshold)
    first = each.where("first").select("least", "key").alias("f")
    kept = df.withColumn("_key", copy_key(text_col)).alias("d").join(first, F.col(id_col).cast("long").eqNullSafe(F.col("f.least")) & (F.col("_key") == F.col("f.key")), "left_semi")
    return kept.dropDuplicates([id_col, "_key"]).drop("_key")


def oracle(threshold: float = SIMILARITY, n: int = WORDS) -> str:
    """DuckDB SQL that compares every two texts that share a shingle."""
    return f"""
WITH RECURSIVE d AS (SELECT DISTINCT doc_id, text FROM documents),
t AS (SELECT text, min(doc_id) AS least, row_number() OVER () AS c FROM d GROUP BY text),
w AS (SELECT c, regexp_extract_all(lower(text), '[a-z0-9_\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM t WHERE text IS NOT NULL),
s AS (SELECT c, sh, count(*) AS n FROM (SELECT c, unnest(CASE WHEN len(w) >= {n} THEN list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(list_slice(w, i, i + {n - 1}), ' ')) ELSE [array_to_string(w, ' ')] END) AS sh FROM w WHERE len(w) > 0) GROUP BY ALL),
size AS (SELECT c, sum(n) AS size FROM s GROUP BY c),
links AS (SELECT a, b FROM (SELECT x.c AS a, y.c AS b, sum(least(x.n, y.n)) AS common FROM s x JOIN s y ON x.sh = y.sh AND x.c <> y.c GROUP BY ALL) JOIN size p ON p.c = a JOIN size q ON q.c = b WHERE common >= {threshold} * (p.size + q.size - common)),
reach AS (SELECT c AS node, c AS root FROM t UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node AND r.root < l.b),
label AS (SELECT node AS c, min(root) AS label FROM reach GROUP BY node),
class AS (SELECT label, min(least) AS class_id FROM t JOIN label USING (c) GROUP BY label)
SELECT d.doc_id, class.class_id, (SELECT count(*) FROM links WHERE a = t.c) AS n_links
FROM d JOIN t ON d.text IS NOT DISTINCT FROM t.text JOIN label USING (c) JOIN class USING (label)
"""
