"""Exact removal of repeated byte strings by suffix arrays over shards.

Every byte covered by a string of ``length`` bytes that also starts earlier (in a
document of smaller id, or earlier in the same one) is removed.

1. *Pruning.* Anchors are the windows of ``k`` bytes whose hash is least among the
   windows of some ``length``-byte string; equal strings have equal anchors at equal
   places, so any repeat shares an anchor and its surroundings (*context*: all
   ``length``-byte strings that hold the anchor and chose it). Occurrences with the
   same anchor and the same context are told by hashes and collapse to the earliest.
   Anchors with one context are settled by that; no repeat can be lost.
2. *Shards.* The contexts of an anchor with several of them meet in one shard (those
   of a hot anchor are dealt over several). A shard's contexts are joined to one byte
   string whose suffix array is built by prefix doubling as Larsson and Sadakane
   refine it: groups of equal prefixes are sorted by the rank ``h`` bytes on, and only
   groups that are not yet settled take part. Kasai's order gives the common prefixes
   of neighbours; runs of neighbours with ``length`` bytes in common are one string,
   and all but its earliest place are repeats.
3. *Merging.* Shards of one hot anchor are merged: their sorted distinct strings, as
   bytes, are dealt to ranges, and in each range the runs are merged two by
   two, every string being looked up in the other run by binary search for an earlier place.

Rows come to the second and third step sorted, and are gone through as they come: what is
held is one anchor's shard, or one range of a hot anchor, never a partition.

Texts are UTF-8 bytes; null counts as empty. Matches never cross documents. Null ids
come after all others. Rows alike in id and text are one document and give equal
rows; rows of one id and unlike texts are ordered by a key of their text. Documents
of any length are treated whole. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, map_batches, row_key, schema_of
from ._hashing import Prefixes, U, mix

LENGTH = 100
K = 40
CHUNK = 1 << 20
#: Contexts of one anchor in one shard; hotter anchors are dealt over several shards.
HOT = 512
#: Bytes of contexts in one suffix array.
SHARD = 1 << 20
NULL_ID = (1 << 63) - 1


# --- anchors ---------------------------------------------------------------


def sliding(x: np.ndarray, w: int, best) -> np.ndarray:
    """``best`` over each window of ``w`` values, by doubling."""
    size, out = 1, x
    while size * 2 <= w:
        out = best(out[: len(out) - size], out[size:])
        size *= 2
    if size < w:
        out = best(out[: len(out) - (w - size)], out[w - size :])
    return out


def anchors(blobs: list[bytes], length: int = LENGTH, k: int = K) -> tuple[np.ndarray, ...]:
    """Document number, place, hash, hash of context, and bytes of context to the left and right of each anchor."""
    data = np.frombuffer(b"".join(blobs), np.uint8)
    sizes = np.array([len(b) for b in blobs], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    n, w = len(data), length - k + 1
    empty = np.zeros(0, np.int64)
    if n < length:
        return empty, empty, empty.astype(U), empty.astype(U), empty, empty
    pre = Prefixes(data)
    h = pre.windows(k)
    least = sliding(h, w, np.minimum)  # of each string of ``length`` bytes
    # strings that cross documents choose nothing
    bad = np.zeros(n + 1, np.int32)
    for_end = ends[:-1][(ends[:-1] > 0) & (ends[:-1] < n)]
    np.add.at(bad, np.maximum(for_end - length + 1, 0), 1)
    np.add.at(bad, for_end, -1)
    least = np.where(np.cumsum(bad)[: len(least)] > 0, U(0), least)
    wide = np.concatenate((np.zeros(w - 1, U), least, np.zeros(w - 1, U)))
    chosen = np.flatnonzero(sliding(wide, w, np.maximum) == h)
    doc = np.searchsorted(ends, chosen, "right")
    left = np.minimum(chosen - starts[doc], w - 1)
    right = np.minimum(ends[doc] - chosen - k, w - 1)
    with np.errstate(over="ignore"):
        c = mix(pre.raw(chosen - left, chosen + k + right) + mix((left * 1024 + right).astype(U)))
    return doc, chosen - starts[doc], h[chosen], c, left, right


# --- suffix arrays ----------------------------------------------------------


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number; zeros after the end."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    key = np.zeros(len(data), U)
    for i in range(8):
        key = (key << U(8)) | padded[i : i + len(data)].astype(U)
    return key


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array up to ``depth`` bytes (then in no order), and rank of each suffix's group.

    Starts from groups of 8 equal bytes; group numbers are the place of a group's
    last member, as Larsson and Sadakane number them.
    """
    n = len(data)
    key = eight_bytes(data)
    order = np.argsort(key)
    sorted_key = key[order]
    new = np.ones(n, bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    group = np.empty(n, np.int64)  # by suffix
    last = np.append(np.flatnonzero(new)[1:], n) - 1
    group[order] = last[np.cumsum(new) - 1]
    h = 8
    while h < depth:
        g = group[order]
        size = np.diff(np.append(-1, np.flatnonzero(np.append(g[1:] != g[:-1], True))))
        open_ = np.flatnonzero(np.repeat(size, size) > 1)
        if not len(open_):
            break
        suffix = order[open_]
        after = suffix + h
        second = np.where(after < n, group[np.minimum(after, n - 1)], -1)
        first = group[suffix]
        both = first * (n + 1) + second  # within 63 bits, as a shard is bounded
        by = np.argsort(both)
        suffix, both = suffix[by], both[by]
        order[open_] = suffix
        edge = np.ones(len(by), bool)
        edge[1:] = both[1:] != both[:-1]
        tail = np.append(np.flatnonzero(edge)[1:], len(by)) - 1
        group[suffix] = open_[tail[np.cumsum(edge) - 1]]
        h *= 2
    return order, group


def common_prefixes(data: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """Common prefix of each suffix in ``order`` with the one before it, up to ``limit``.

    Kasai's walk goes by place: the suffix one on from ``i`` shares at least one byte
    less with its own neighbour. Where that neighbour is the next place of the last
    one's, the two lie on one diagonal and their prefixes end at the same mismatch, so
    a diagonal is measured as a whole, from its mismatches; only its last suffixes,
    whose mismatch lies beyond, are compared byte by byte.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    apart = (before < 0) | (data != data[np.maximum(before, 0)])
    breaks = np.ones(n, bool)
    breaks[1:] = before[1:] != before[:-1] + 1
    # the next mismatch on the diagonal, or its end
    stop = np.where(apart, at, n)
    nxt = np.minimum.accumulate(stop[::-1])[::-1]
    ends = np.where(np.append(breaks[1:], True), at + 1, n + 1)
    end = np.minimum.accumulate(ends[::-1])[::-1]
    size = np.minimum(np.minimum(nxt, end) - at, limit)
    todo = np.flatnonzero((nxt >= end) & (size < limit) & (before >= 0))
    word = eight_bytes(data)
    while len(todo):
        i, j = todo + size[todo], before[todo] + size[todo]
        inside = (i < n) & (j < n)
        todo, i, j = todo[inside], i[inside], j[inside]
        differ = word[i] ^ word[j]
        equal = (differ == 0).astype(np.int64)  # leading bytes in common
        for byte in range(1, 8):
            equal += differ < U(1 << 8 * byte)
        room = n - np.maximum(i, j)
        size[todo] += np.minimum(equal, room)
        todo = todo[(equal == 8) & (room > 8)]
        todo = todo[size[todo] < limit]
    size = np.minimum(size, limit)
    return size[order]


def shard_repeats(contexts: list[bytes], docs: np.ndarray, places: np.ndarray, length: int = LENGTH):
    """Strings of a shard.

    Gives (document, place) of every string that starts earlier in the shard, and of
    the distinct strings in their order the digest prefix, document and place of the
    earliest occurrence. ``docs`` are ranks in the order of documents; ``places`` are
    those of the contexts' first bytes.
    """
    sizes = np.array([len(c) for c in contexts], np.int64)
    data = np.frombuffer(b"".join(contexts), np.uint8)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.cumsum(sizes) - sizes
    offset = np.arange(len(data)) - starts[owner]
    whole = offset + length <= sizes[owner]
    order, _ = suffix_array(data, length)
    lcp = common_prefixes(data, order, length)
    # what runs over the end of its context is no string
    run = np.cumsum(lcp < length)
    keep = whole[order]
    at, run = order[keep], run[keep]
    size = np.bincount(run)[run]
    alone = at[size == 1]
    at, run = at[size > 1], run[size > 1]
    doc, place = docs[owner[at]], places[owner[at]] + offset[at]
    by = np.lexsort(((doc << 32) | place, run))
    at, run, doc, place = at[by], run[by], doc[by], place[by]
    first = np.ones(len(run), bool)
    first[1:] = run[1:] != run[:-1]
    head = np.maximum.accumulate(np.where(first, np.arange(len(run)), 0))
    again = (doc != doc[head]) | (place != place[head])
    distinct = np.concatenate((at[first], alone))
    return (doc[again], place[again]), (distinct, docs[owner[distinct]], places[owner[distinct]] + offset[distinct]), data


def covers(doc: np.ndarray, place: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal spans of overlapping or touching strings: document, start, end."""
    if not len(doc):
        z = np.zeros(0, np.int64)
        return z, z, z
    by = np.lexsort((place, doc))
    doc, place = doc[by], place[by]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (place[1:] > place[:-1] + length)
    at = np.flatnonzero(new)
    return doc[at], place[at], place[np.append(at[1:], len(doc)) - 1] + length


# --- the plan ------------------------------------------------------------------

#: Kinds of rows between the stages.
MARK, DONE, ASK = 0, 1, 2


def pack_place(place, left, right):
    return (place << 12) | (left << 6) | right


def unpack_place(p):
    return p >> 12, (p >> 6) & 63, p & 63


def union_spans(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal unions of spans of documents numbered from 0: document, start, end."""
    if not len(doc):
        z = np.zeros(0, np.int64)
        return z, z, z
    by = np.lexsort((b, a, doc))
    doc, a, b = doc[by], a[by] + (doc[by] << 32), b[by] + (doc[by] << 32)
    top = np.maximum.accumulate(b)
    new = np.ones(len(doc), bool)
    new[1:] = a[1:] > top[:-1]
    at = np.flatnonzero(new)
    base = doc[at] << 32
    return doc[at], a[at] - base, top[np.append(at[1:], len(doc)) - 1] - base


def _columns(names: str, *parts) -> dict:
    """Arrow columns (int64) of the concatenated parts, each a tuple of arrays in the order of ``names``."""
    return {n: pa.array(np.concatenate([np.zeros(0, np.int64), *[p[i] for p in parts]]), pa.int64()) for i, n in enumerate(names.split())}


MARKS = "kind bigint, h bigint, c bigint, doc bigint, row bigint, p bigint"


def _first_pass(rows: DataFrame, length: int, k: int) -> DataFrame:
    """Marks: the first of each (anchor, context) in a piece of the scan. Done: spans that repeat inside the piece (c: start and end)."""

    def make():
        def step(x):
            one_each = {(d, r): i for i, (d, r) in reversed(list(enumerate(zip(x["doc"], x["row"]))))}
            order = [one_each[key] for key in sorted(one_each)]
            parts, lo = [], 0
            while lo < len(order):
                hi, blobs, held = lo, [], 0
                while hi < len(order) and held < CHUNK:
                    blobs.append((x["text"][order[hi]] or "").encode("utf-8", "surrogatepass"))
                    held += len(blobs[-1])
                    hi += 1
                ids = np.array([x["doc"][i] for i in order[lo:hi]], np.int64)
                keys = np.array([x["row"][i] for i in order[lo:hi]], np.int64)
                doc, place, h, c, left, right = anchors(blobs, length, k)
                by_class = np.lexsort((place, doc, c, h))
                doc, place, h, c, left, right = (v[by_class] for v in (doc, place, h, c, left, right))
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
                d = doc[new]
                parts.append((np.full(len(d), MARK), h[new].view(np.int64), c[new].view(np.int64), ids[d], keys[d], pack_place(place[new], left[new], right[new])))
                d, a, b = union_spans(doc[~new], (place - left)[~new], (place + k + right)[~new])
                # any key will do to deal these rows: they only pass through
                parts.append((np.full(len(d), DONE), mix(ids[d].view(U)).view(np.int64), (a << 32) | b, ids[d], keys[d], a * 0))
                lo = hi
            return _columns("kind h c doc row p", *parts)

        return step

    return map_batches(rows, make, schema_of(MARKS), rows=2048)


SETTLED = "kind bigint, h bigint, salt bigint, doc bigint, row bigint, a bigint, b bigint"


def _settle(marks: DataFrame, k: int) -> DataFrame:
    """Spans of what repeats an earlier context whole, and requests for contexts of anchors with several (salt: -1, or the shard of a hot anchor).

    ``marks`` come sorted by anchor, context and place. They are gone through as they come: of an
    anchor only the heads of its contexts are held, and no more than HOT of those.
    """

    def make():
        # the last mark gone by, and the heads of its anchor that wait to be asked for or dropped
        last: list = [None]
        heads: list[tuple[int, ...]] = []
        seen = 0

        def asked(rows, salts):
            cols = [np.array(c, np.int64) for c in zip(*rows)] if rows else [np.zeros(0, np.int64)] * 5
            return (np.full(len(rows), ASK), cols[0], np.array(salts, np.int64), cols[1], cols[2], cols[3], cols[4])

        def leave(out):
            """The anchor is done: its heads are asked for if there are several."""
            nonlocal seen
            if len(heads) > 1 or seen > len(heads):
                out.append(asked(heads, [-1 if seen <= HOT else (seen - len(heads) + i) // HOT for i in range(len(heads))]))
            heads.clear()
            seen = 0

        def step(x):
            nonlocal seen
            out: list = []
            if x is None:
                leave(out)
                return _columns("kind h salt doc row a b", *out) if out else None
            kind, h, c, doc, row, p = (np.array(x[n], np.int64) for n in ("kind", "h", "c", "doc", "row", "p"))
            done = kind == DONE
            out.append((kind[done], h[done], doc[done] * 0, doc[done], row[done], c[done] >> 32, c[done] & 0xFFFFFFFF))
            h, c, doc, row, p = h[~done], c[~done], doc[~done], row[~done], p[~done]
            if not len(h):
                return _columns("kind h salt doc row a b", *out)
            place, left, right = unpack_place(p)
            before = last[0] if last[0] is not None else (h[0] ^ 1, 0, 0, 0, 0)
            prior = [np.concatenate(([b], v[:-1])) for b, v in zip(before, (h, c, doc, row, p))]
            last[0] = (h[-1], c[-1], doc[-1], row[-1], p[-1])
            new_h = h != prior[0]
            new = new_h | (c != prior[1])
            # a row that lies in several pieces of the scan gives its marks in each
            other = new | (doc != prior[2]) | (row != prior[3]) | (p != prior[4])
            a, b = place - left, place + k + right
            again = other & ~new
            out.append((np.full(again.sum(), DONE), h[again], h[again] * 0, doc[again], row[again], a[again], b[again]))
            # heads: those of anchors that begin and end here with one context are dropped at once
            at = np.flatnonzero(new)
            anchor = np.cumsum(new_h[at])
            many = np.bincount(anchor, minlength=int(anchor[-1]) + 1 if len(anchor) else 1)
            first, final = 0, int(anchor[-1]) if len(anchor) else 0  # anchor 0 goes on from what came before, the final one may go on
            rows = list(zip(h[at].tolist(), doc[at].tolist(), row[at].tolist(), a[at].tolist(), b[at].tolist()))
            inner = (anchor > first) & (anchor < final) & (many[anchor] > 1) & (many[anchor] <= HOT) if len(anchor) else np.zeros(0, bool)
            if inner.any():
                w = at[inner]
                out.append((np.full(len(w), ASK), h[w], np.full(len(w), -1), doc[w], row[w], a[w], b[w]))
            for i in np.flatnonzero(~inner & ((anchor == first) | (anchor == final) | (many[anchor] > HOT))) if len(anchor) else ():
                if new_h[at[i]]:
                    leave(out)
                if len(heads) == HOT:
                    out.append(asked(heads, [(seen - HOT + j) // HOT for j in range(HOT)]))
                    heads.clear()
                heads.append(rows[i])
                seen += 1
            return _columns("kind h salt doc row a b", *out)

        return step

    return map_batches(marks, make, schema_of(SETTLED), rows=100_000, finish=True)


def _contexts(asked: DataFrame) -> DataFrame:
    """The bytes of the requested contexts; ``asked``: doc, row, text, asks."""
    schema = schema_of("h bigint, salt bigint, doc bigint, row bigint, a bigint, bytes binary")

    def make():
        def step(x):
            out: dict = {n: [] for n in schema.names}
            for doc, row, text, asks in zip(x["doc"], x["row"], x["text"], x["asks"]):
                blob = (text or "").encode("utf-8", "surrogatepass")
                for q in asks:
                    for n, v in zip(schema.names, (q["h"], q["salt"], doc, row, q["a"], blob[q["a"] : q["b"]])):
                        out[n].append(v)
            return out

        return step

    return map_batches(asked, make, schema)


#: Spans, and runs: the strings of one range of a hot anchor's shard in suffix order, packed (strings, then document, row and place of each).
FOUND = "h bigint, part bigint, doc bigint, row bigint, a bigint, b bigint, run binary"


def _shards(contexts: DataFrame, length: int) -> DataFrame:
    """Suffix arrays of contexts dealt by (h, salt) and sorted by it: spans, and the distinct strings of shards of hot anchors."""

    def make():
        held: list[tuple] = []
        size = 0
        spans_: list[tuple] = []
        runs: list[tuple[int, int, bytes]] = []

        def flush(rows):
            doc, row = (np.array([r[i] for r in rows], np.int64) for i in (2, 3))
            by = np.lexsort((row, doc))
            new = np.ones(len(by), bool)
            new[1:] = (doc[by][1:] != doc[by][:-1]) | (row[by][1:] != row[by][:-1])
            rank = np.empty(len(by), np.int64)
            rank[by] = np.cumsum(new) - 1
            ids, keys = doc[by][new], row[by][new]
            (d, p), (at, fd, fp), data = shard_repeats([r[5] for r in rows], rank, np.array([r[4] for r in rows], np.int64), length)
            d, a, b = covers(d, p, length)
            # any key will do to deal these on
            spans_.append((mix(ids[d].view(U)).view(np.int64), d * 0, ids[d], keys[d], a, b))
            if rows[0][1] >= 0:
                text = np.lib.stride_tricks.sliding_window_view(data, length)[at] if len(at) else np.zeros((0, length), np.uint8)
                with np.errstate(over="ignore"):
                    part = mix(Prefixes(data).raw(at, at + length)) >> U(64 - RANGE_BITS)  # equal strings meet in one range
                for n in np.unique(part).tolist():
                    own = np.flatnonzero(part == U(n))
                    runs.append((rows[0][0], n, text[own].tobytes() + np.stack((ids[fd[own]], keys[fd[own]], fp[own])).tobytes()))

        def step(x):
            nonlocal size
            spans_.clear()
            runs.clear()
            rows = list(zip(*(x[n] for n in ("h", "salt", "doc", "row", "a", "bytes")))) if x is not None else [None]
            for r in rows:
                if held and (r is None or r[:2] != held[-1][:2] and (size >= SHARD or r[1] >= 0 or held[-1][1] >= 0)):
                    flush(held)
                    held.clear()
                    size = 0
                if r is not None:
                    held.append(r)
                    size += len(r[5])
            z = np.zeros(len(runs), np.int64)
            heads = tuple(np.array([r[i] for r in runs], np.int64) for i in (0, 1))
            out = _columns("h part doc row a b", *spans_, (*heads, z, z, z, z))
            out["run"] = pa.array([None] * sum(len(t[0]) for t in spans_) + [r[2] for r in runs], pa.binary())
            return out

        return step

    return map_batches(contexts, make, schema_of(FOUND), rows=4096, finish=True)


#: Ranges of strings that shards of a hot anchor are merged in: 2 to this power.
RANGE_BITS = 6


def merged(runs: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, row and place of every string that another of the runs, or the same, holds earlier.

    Runs are sorted; they are merged two by two, each string being looked up in the other run by binary search,
    and keep the earliest place of a string.
    """
    kind = np.dtype((np.void, length))
    parts, late = [], []
    for r in runs:
        n = len(r) // (length + 24)
        text = np.frombuffer(r, np.uint8, n * length).reshape(n, length)
        doc, row, place = np.frombuffer(r, np.int64, 3 * n, n * length).reshape(3, n)
        keys = np.ascontiguousarray(text).view(kind).reshape(n)
        by = np.argsort(keys, kind="stable")
        parts.append((keys[by], doc[by], row[by], place[by]))
    while len(parts) > 1:
        (ka, *a), (kb, *b) = parts.pop(0), parts.pop(0)
        at = np.searchsorted(ka, kb)
        found = at < len(ka)
        found[found] = ka[at[found]] == kb[found]
        i, j = at[found], np.flatnonzero(found)
        # of a string in both the earlier place stays
        first = np.lexsort((np.concatenate((a[2][i], b[2][j])), np.concatenate((a[1][i], b[1][j])), np.concatenate((a[0][i], b[0][j])))) if len(i) else np.zeros(0, np.int64)
        rank = np.empty(len(first), np.int64)
        rank[first] = np.arange(len(first))
        b_first = rank[len(i) :] < rank[: len(i)]
        same = (a[0][i] == b[0][j]) & (a[1][i] == b[1][j]) & (a[2][i] == b[2][j])
        for lost, run, at_ in ((b_first & ~same, a, i), (~b_first & ~same, b, j)):
            late.append(tuple(v[at_[lost]] for v in run))
        a = [v.copy() for v in a]
        for v, w in zip(a, b):
            v[i[b_first]] = w[j[b_first]]
        rest = ~found
        to = at[rest] + np.arange(rest.sum())  # where the others go in
        size = len(ka) + len(to)
        own = np.ones(size, bool)
        own[to] = False
        out = []
        for x, y in zip((ka, *a), (kb, *b)):
            z = np.empty(size, x.dtype)
            z[own], z[to] = x, y[rest]
            out.append(z)
        parts.append(tuple(out))
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate([empty, *[r[k] for r in late]]) for k in range(3))


def _merge_shards(found: DataFrame, length: int) -> DataFrame:
    """Runs of all shards of a hot anchor, a range at a time: all but the earliest place of a string are spans. Spans pass through. ``found`` comes sorted by anchor and range."""

    def make():
        held: list[bytes] = []
        last: list = [None]

        def step(x):
            out = []
            if x is not None:
                span = np.array([r is None for r in x["run"]], bool)
                out.append(tuple(np.array(x[n], np.int64)[span] for n in ("doc", "row", "a", "b")))
            for key, run in zip(zip(x["h"], x["part"]), x["run"]) if x is not None else [(None, b"")]:
                if run is None:
                    continue
                if key != last[0] and held:
                    doc, row, place = merged(held, length)
                    out.append((doc, row, place, place + length))
                    held.clear()
                last[0] = key
                if key is not None:
                    held.append(run)
            return _columns("doc row a b", *out) if out else None

        return step

    return map_batches(found, make, schema_of("doc bigint, row bigint, a bigint, b bigint"), rows=4096, finish=True)


def documents_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc"), row_key(text_col).alias("row"), F.col(text_col).alias("text"))


def spans(rows: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """Repeats (doc, row, a, b), which may overlap. ``rows``: doc, row, text of :func:`documents_of`."""
    if not 0 < length - k < 64:
        raise ValueError("a context may reach at most 63 bytes beyond its anchor")
    settled = cut(_settle(_first_pass(rows, length, k).repartition("h").sortWithinPartitions("h", "c", "doc", "row", "p"), k))
    asks = settled.where(F.col("kind") == ASK).groupBy("doc", "row").agg(F.collect_list(F.struct("h", "salt", "a", "b")).alias("asks"))
    contexts = _contexts(rows.join(asks, ["doc", "row"]).select("doc", "row", "text", "asks").dropDuplicates(["doc", "row"]))
    found = _shards(contexts.repartition("h", "salt").sortWithinPartitions("h", "salt"), length)
    across = _merge_shards(found.repartition("h", "part").sortWithinPartitions("h", "part"), length)
    return settled.where(F.col("kind") == DONE).select("doc", "row", "a", "b").unionByName(across)


def removals(df: DataFrame, id_col: str, text_col: str, length: int, k: int) -> DataFrame:
    """Every row of ``df`` (doc, row, text) with its spans."""
    rows = documents_of(df, id_col, text_col)
    of_doc = spans(rows, length, k).groupBy("doc", "row").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    return rows.join(of_doc, ["doc", "row"], "left")


def unions(found) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in (() if found is None else found)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def rest(blob: bytes, cuts: list[tuple[int, int]]) -> bytes:
    ends = [0, *(b for _, b in cuts)]
    return b"".join(blob[x:y] for x, y in zip(ends, [*(a for a, _ in cuts), len(blob)]))


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = K) -> DataFrame:
    """Of each row: id, n_bytes, n_removed, n_spans and kept_sha256."""
    schema = schema_of(f"{id_col} bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")

    def make():
        def step(x):
            out = {n: [] for n in schema.names}
            for doc, text, found in zip(x["doc"], x["text"], x["spans"]):
                blob, cuts = (text or "").encode("utf-8", "surrogatepass"), unions(found)
                kept = rest(blob, cuts)
                for n, v in zip(schema.names, (None if doc == NULL_ID else doc, len(blob), len(blob) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest())):
                    out[n].append(v)
            return out

        return step

    return map_batches(removals(df, id_col, text_col, length, k).select("doc", "text", "spans"), make, schema)


def remove(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = K) -> DataFrame:
    """``df`` without the repeats of its texts; characters of which only some bytes are left go too. n_chars, if there, follows."""
    rows = documents_of(df, id_col, text_col)
    of_doc = spans(rows, length, k).groupBy("doc", "row").agg(F.collect_list(F.struct("a", "b")).alias("_spans"))

    @F.pandas_udf("string")
    def cut_out(texts, found):
        def one(t, s):
            return t if t is None or s is None else rest(t.encode("utf-8", "surrogatepass"), unions(s)).decode("utf-8", "ignore")

        return texts.combine(found, one)

    keyed = df.withColumns({"_doc": F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)), "_row": row_key(text_col)})
    both = keyed.join(of_doc.withColumnsRenamed({"doc": "_doc", "row": "_row"}), ["_doc", "_row"], "left")
    out = both.withColumn(text_col, F.when(F.col("_spans").isNull(), F.col(text_col)).otherwise(cut_out(text_col, "_spans"))).select(*df.columns)
    return out.withColumn("n_chars", F.length(text_col).cast("long")) if "n_chars" in df.columns else out
