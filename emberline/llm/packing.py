"""Variable-capacity best-fit packing of documents into sequences of several permitted lengths.

Documents are cut into pieces of the largest length and a rest. A whole piece fills a
bin of its own; the rests are packed, longest first. A rest goes to the open bin that
it leaves fullest. If none has room, a bin is opened, and its length is chosen from
all that hold the rest: each length is filled, longest first, from the histogram of
the rests that are still to be placed, downsized to what that gives, and priced (a
fixed part, its tokens, and a part that grows with the square of its length) by the
token it would hold. The least price opens the bin, so a long bin is opened where what
is left fills it better than a short one. At the end each bin is downsized to the
shortest permitted length that holds its contents. What a bin was opened for is kept out
of the histogram of later bins.

Tokens are those of the given tokenizer (a rank file of a byte-level vocabulary, whose ids
give back the text, or the file of the trie encoder), or a column of numbers. Rows are dealt to shards
of about ``window`` pieces by a hash of id, text and number of the copy, never by where they
lie, so the bins of a table do not hang on its files or partitions; only numbers
are held. Null and empty texts have no tokens; they get one row without a bin. Every
token is placed in exactly one piece. Rows alike in id and text are packed each for
itself; rows of a null id or of one id are told apart by their texts; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bpe_trie
from ._common import cut, map_batches, schema_of

LENGTHS = (512, 1024, 2048, 4096)
WINDOW = 100_000
# Fixed value: how byte-level vocabularies cut a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@lru_cache(maxsize=2)
def encoder(path: str):
    """Text to token ids, once a worker process."""
    if not path.endswith(".tiktoken"):
        return bpe_trie.encoder(path).encode
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def cost(length: int, largest: int, fixed: float = 32.0, square: float = 0.25) -> float:
    """What a sequence costs to process."""
    return fixed + length + square * length * length / largest


def smallest(lengths: tuple[int, ...], n: int) -> int:
    return next(c for c in lengths if c >= n)


class Left:
    """Sizes still to be placed: how many of each that no open bin expects, how many that one does, and a bit for each size of the first kind."""

    def __init__(self, sizes: list[int], top: int):
        self.free, self.expected, self.bits = [0] * (top + 1), [0] * (top + 1), 0
        for n in sizes:
            self.free[n] += 1
            self.bits |= 1 << n

    def take(self, n: int, k: int = 1) -> None:
        self.free[n] -= k
        if not self.free[n]:
            self.bits ^= 1 << n

    def place(self, n: int, in_open_bin: bool) -> None:
        """A piece of ``n`` gets its place: of those that a bin expects, or for a new bin rather of the others."""
        if self.free[n] and not (in_open_bin and self.expected[n]):
            self.take(n)
        else:
            self.expected[n] -= 1

    def filling(self, length: int, n: int) -> list[tuple[int, int]]:
        """What fills a bin that holds ``n``, longest first: sizes and how many."""
        room, bits, out = length - n, self.bits, []
        while room and (bits := bits & ((1 << room + 1) - 1)):
            size = bits.bit_length() - 1
            k = min(self.free[size], room // size)
            out.append((size, k))
            room -= size * k
            bits ^= 1 << size
        return out


def pack(sizes: list[int], lengths: tuple[int, ...] = LENGTHS) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """Of each piece (1 to the largest length) its bin and offset; of each bin the length it was opened with and the one it ends with."""
    lengths = tuple(sorted(lengths))
    top = lengths[-1]
    left = Left(sizes, top)
    rooms: list[list[int]] = [[] for _ in range(top + 1)]  # open bins by room
    with_room = 0
    used: list[int] = []
    opened: list[int] = []
    place: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        n = sizes[i]
        enough = with_room >> n
        left.place(n, bool(enough))
        if enough:
            room = n + (enough & -enough).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                with_room ^= 1 << room
        else:
            best = None
            for c in lengths:
                if c >= n:
                    filling = left.filling(c, n)
                    held = n + sum([s * k for s, k in filling])
                    price = cost(smallest(lengths, held), top) / held
                    if best is None or price < best[0]:
                        best = price, c, filling
            _, room, filling = best
            for s, k in filling:
                left.take(s, k)
                left.expected[s] += k
            b = len(used)
            used.append(0)
            opened.append(room)
        place[i] = (b, used[b])
        used[b] += n
        if room > n:
            rooms[room - n].append(b)
            with_room |= 1 << room - n
    return place, opened, [smallest(lengths, u) for u in used]


def counted(df: DataFrame, id_col: str, text_col: str, tokens: Column | None, tokenizer: str | None) -> DataFrame:
    """id, key (that of the text) and n (tokens) of each row."""
    if tokens is not None:
        key = F.md5(text_col) if text_col in df.columns else F.lit(None).cast("string")
        return df.select(F.col(id_col).cast("long").alias("id"), key.alias("key"), F.greatest(F.coalesce(tokens, F.lit(0)), F.lit(0)).cast("long").alias("n"))
    if tokenizer is None:
        raise ValueError("packing needs a column of numbers of tokens or a tokenizer")

    def make():
        encode = encoder(tokenizer)

        def step(x):
            return {"id": x["id"], "key": x["key"], "n": [len(encode(t)) if t else 0 for t in x["text"]]}

        return step

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.md5(text_col).alias("key"), F.col(text_col).alias("text"))
    return map_batches(rows, make, schema_of("id bigint, key string, n bigint"))


PIECES = "id bigint, key string, piece int, n_tokens bigint, doc_offset bigint, bin_id bigint, bin_offset bigint, capacity int, bin_tokens bigint"


def _placed(dealt: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """Pieces of rows (shard, id, key, n) that come sorted by shard; one shard is held at a time."""
    schema = schema_of(PIECES)
    lengths = tuple(sorted(lengths))
    top = lengths[-1]

    def make():
        held: list[tuple] = []

        def flush(out):
            first = held[0][0] << 36
            held.sort(key=lambda r: (-r[3], r[1] is None, r[1] or 0, r[2] or ""))
            rests = [r for r in held if r[3] % top]
            place, _, caps = pack([r[3] % top for r in rests], lengths)
            filled = [0] * len(caps)
            for r, (b, _) in zip(rests, place):
                filled[b] += r[3] % top
            rows, number = [], len(caps)
            for _, i, key, n in held:
                for k in range(n // top):
                    rows.append((i, key, k, top, k * top, first + number, 0, top, top))
                    number += 1
            for (_, i, key, n), (b, at) in zip(rests, place):
                rows.append((i, key, n // top, n % top, n - n % top, first + b, at, caps[b], filled[b]))
            for name, column in zip(schema.names, zip(*rows)):
                out[name] += column
            held.clear()

        def step(x):
            out: dict = {n: [] for n in schema.names}
            for r in zip(x["shard"], x["id"], x["key"], x["n"]) if x is not None else ():
                if held and r[0] != held[0][0]:
                    flush(out)
                held.append(r)
            if x is None and held:
                flush(out)
            return out

        return step

    return map_batches(dealt, make, schema, rows=10_000, finish=True)


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None, tokenizer: str | None = None, lengths: tuple[int, ...] = LENGTHS, window: int = WINDOW) -> DataFrame:
    """One row per piece (PIECES): key is that of the text, doc_offset the piece's first token in its document."""
    top = max(lengths)
    # rows alike are counted before they are dealt, so a text that a third of all rows hold is one row here
    groups = cut(counted(df, id_col, text_col, tokens, tokenizer).groupBy("id", "key", "n").agg(F.count("*").alias("m")))
    total = groups.agg(F.sum(F.col("m") * F.ceil(F.col("n") / top))).first()[0] or 0
    shards = max(1, -(-int(total) // window))
    # copies in two steps, so that no array is long
    many = groups.withColumn("k1", F.explode(F.sequence(F.lit(0), F.expr("(m - 1) div 10000"))))
    each = many.withColumn("k2", F.explode(F.sequence(F.lit(0), F.least(F.lit(9999), F.expr("m - 1 - k1 * 10000")))))
    empty = each.where("n = 0").select("id", "key", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("doc_offset"), *[F.lit(None).cast(t).alias(c) for c, t in (("bin_id", "long"), ("bin_offset", "long"), ("capacity", "int"), ("bin_tokens", "long"))])
    shard = F.pmod(F.xxhash64("id", "key", "n", "k1", "k2"), F.lit(shards))
    dealt = each.where("n > 0").select(shard.alias("shard"), "id", "key", "n").repartition("shard").sortWithinPartitions("shard")
    return _placed(dealt, lengths).unionByName(empty)


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per piece: id, piece, n_tokens, doc_offset, bin_id, bin_offset, capacity, bin_tokens. Options: those of :func:`pieces`."""
    return pieces(df, id_col, text_col, **options).drop("key").withColumnRenamed("id", id_col)


def sequences(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """As :func:`pack_documents`, with the token ids of each piece, and on a document's first piece its text."""
    placed = pieces(df, id_col, text_col, tokenizer=tokenizer, **options)
    by_text = ["id", "key"]
    at = [c for c in placed.columns if c not in by_text]
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.md5(text_col).alias("key"), F.col(text_col).alias("text")).dropDuplicates(by_text)
    same = placed["id"].eqNullSafe(texts["id"]) & placed["key"].eqNullSafe(texts["key"])
    met = placed.join(texts, same).select(placed["id"], *at, "text")
    schema = schema_of(f"{id_col} bigint, " + PIECES.split(", ", 2)[2] + ", ids array<int>, text string")

    def make():
        encode = encoder(tokenizer)

        def step(x):
            ids = [encode(t or "") for t in x["text"]]
            cuts = [i[a : a + n] for i, a, n in zip(ids, x["doc_offset"], x["n_tokens"])]
            return {id_col: x["id"], **{c: x[c] for c in at}, "ids": cuts, "text": [t if not p else None for t, p in zip(x["text"], x["piece"])]}

        return step

    return map_batches(met, make, schema)
