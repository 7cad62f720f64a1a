"""BPE encoding by a depth-first walk of a trie of distinct words.

A text is normalised and cut into words as the tokenizer file says. The distinct
words not met before are put into a trie; one depth-first walk gives every node the
*last token* of the encoding of its prefix, so what words share is encoded once. A
token ``t`` ends the encoding of a prefix exactly if it is a suffix of it and merging
would keep it apart from the last token of what stands before it. Ids are read back
along the last tokens. Encodings of words and of runs between white space are kept
in dictionaries of bounded size, which change nothing but speed.

Null texts count as empty: no tokens, empty decoded text. Texts of any length are
encoded whole. Strings of special tokens in a text become those tokens, as in the
tokenizers library. Repeated rows and ids give one row each; other columns of the
input are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import json
import struct
import unicodedata
from functools import lru_cache

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_batches, schema_of

END = "</w>"
#: Symbols by which suffix tokens are looked up.
TAIL = 4


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, spare = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in table:
            table[b], spare = chr(spare), spare + 1
    return [table[b] for b in range(256)]


class WordBpe:
    """Encoder and decoder of a byte-level BPE whose words end in ``</w>``."""

    CACHE = 500_000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in self.vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names.update({i: t for t, i in self.added.items()})
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        # Rank of each token: single bytes first, then merges in their order.
        self.halves: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for n, (a, b) in enumerate(pairs):
            t = self.vocab[a + b]
            left, right = self.vocab[a], self.vocab[b]
            self.merged[(left, right)] = n + 1
            self.halves.setdefault(t, (left, right))
            self.rank.setdefault(t, n + 1)
        # Lengths of tokens of over TAIL symbols by their last TAIL symbols (inner ones, and those that end a word).
        self.longer: tuple[dict, dict] = ({}, {})
        for t, i in self.vocab.items():
            ends = t.endswith(END) and len(t) > len(END)
            body = t[: -len(END)] if ends else t
            if len(body) > TAIL and i in self.halves:
                self.longer[ends].setdefault(body[-TAIL:], set()).add(len(body))
        for lengths in self.longer:
            lengths.update({k: tuple(sorted(v, reverse=True)) for k, v in lengths.items()})
        self.tails: tuple[dict, dict] = ({}, {})
        self.pairs: dict[tuple[int, int], bool] = {}
        self.alphabet = byte_alphabet()
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.cut = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.blank = regex.compile(r"\p{White_Space}+")
        self.marks = [s[:2] for s in self.added]
        self.words: dict[str, tuple[bytes, int, str]] = {}
        self.runs: dict[str, tuple[bytes, int, str]] = {}
        self.silent = False  # whether a run without tokens has been met

    def apart(self, a: int, b: int) -> bool:
        """Whether merging leaves ``b`` a token of its own after ``a``: undo merges on both sides, latest first, and look for a merge across the cut that would have come earlier."""
        rank, halves, merged = self.rank.get, self.halves, self.merged
        limit = 1 << 60
        while True:
            across = merged.get((a, b))
            if across is not None and across < limit:
                return False
            ra, rb = rank(a, 0), rank(b, 0)
            if ra > rb:
                limit, a = ra, halves[a][1]
            elif rb:
                limit, b = rb + 1, halves[b][0]
            else:
                return True

    def tokens_ending(self, tail: str, ends: int) -> tuple:
        """Lengths of tokens longer than ``tail`` that may end so, and (length, token) of the others, longest first."""
        shorter = (self.tails[ends].get(tail[1:]) or self.tokens_ending(tail[1:], ends))[1] if len(tail) > 1 else ()
        token = self.vocab.get(tail + (END if ends else ""))
        if token is not None and (len(tail) == 1 or token in self.halves):
            shorter = ((len(tail), token), *shorter)
        out = (self.longer[ends].get(tail, ()), shorter)
        if len(self.tails[ends]) > self.CACHE:
            self.tails[ends].clear()
        self.tails[ends][tail] = out
        return out

    def last_token(self, path: str, state: list, ends: int) -> tuple[int, int]:
        """The last token of the encoding of ``path`` and where it begins; ``state`` has those of its prefixes."""
        tail, size = path[-TAIL:], len(path)
        longer, others = self.tails[ends].get(tail) or self.tokens_ending(tail, ends)
        pairs = self.pairs
        if longer:
            others = [(n, t) for n in longer if n <= size and (t := self.vocab.get(path[size - n :] + (END if ends else ""))) is not None] + list(others)
        for n, t in others:
            if n == size:
                return t, 0
            pair = (state[size - n][0], t)
            ok = pairs.get(pair)
            if ok is None:
                if len(pairs) > self.CACHE:
                    pairs.clear()
                ok = pairs[pair] = self.apart(*pair)
            if ok:
                return t, size - n
        raise ValueError(path)

    def walk(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """Encodings of distinct non-empty words (as byte-alphabet strings) by one depth-first walk.

        The trie is held as its sorted words: a word's path leaves that of the word before it where
        their common prefix ends, so going through them in order visits every node once, and only
        the states along one path are held.
        """
        out: dict[str, tuple[int, ...]] = {}
        path, last_token = "", self.last_token
        state: list[tuple[int, int]] = [(-1, 0)]
        for w in sorted(words):
            stem = w[:-1]
            depth = 0
            if stem != path:
                for a, b in zip(stem, path):
                    if a != b:
                        break
                    depth += 1
                del state[depth + 1 :]
                for n in range(depth + 1, len(stem) + 1):
                    state.append(last_token(stem[:n], state, 0))
                path = stem
            t, at = last_token(w, state, 1)
            if not at:
                out[w] = (t,)
                continue
            ids = [t]
            while at:
                t, at = state[at]
                ids.append(t)
            ids.reverse()
            out[w] = tuple(ids)
        return out

    def split(self, text: str) -> list[str]:
        """Words of a text without special tokens."""
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")
        return self.cut.findall(text.lower())

    def learn(self, runs: set[str]) -> None:
        """Encode runs of a text that have not been met: their new words go into one trie."""
        if len(self.runs) + len(runs) > self.CACHE:
            self.runs.clear()
        if len(self.words) > self.CACHE:
            self.words.clear()
        words, alphabet, names = self.words, self.alphabet, self.names
        cut = {r: (r.lower(),) if r.isascii() and r.isalpha() else self.split(r) for r in runs}
        fresh = list({w for ws in cut.values() for w in ws if w not in words})
        for at in range(0, len(fresh), 100_000):
            shown = {w if w.isascii() and w.isalnum() else "".join([alphabet[b] for b in w.encode()]): w for w in fresh[at : at + 100_000]}
            for s, ids in self.walk(list(shown)).items():
                words[shown[s]] = (struct.pack(f"<{len(ids)}I", *ids), len(ids), " ".join([names[i] for i in ids]))
        for r, ws in cut.items():
            if len(ws) == 1:
                self.runs[r] = words[ws[0]]
            elif ws:
                got = [words[w] for w in ws]
                self.runs[r] = (b"".join([g[0] for g in got]), sum([g[1] for g in got]), " ".join([g[2] for g in got]))
            else:
                self.runs[r], self.silent = (b"", 0, ""), True

    def parts(self, text: str) -> list[str]:
        """Runs between white space; special tokens stand alone behind an empty string."""
        if self.special is None or not any(m in text for m in self.marks):
            return self.spaced(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [*self.spaced(text[at : m.start()]), "", m[0]]
            at = m.end()
        return out + self.spaced(text[at:])

    def spaced(self, text: str) -> list[str]:
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # blank for str.split only
            return [r for r in self.blank.split(text) if r]
        return text.split()

    def pieces(self, texts: list[str]) -> list[list[tuple[bytes, int, str]]]:
        """Of each text: packed ids, number and shown tokens of each run, in order."""
        cut = [self.parts(t) for t in texts]
        fresh = set().union(*cut).difference(self.runs, ("",))
        if len(self.runs) + len(fresh) > self.CACHE:
            fresh = {r for runs in cut for r in runs if r}
        gc.disable()  # what is built here has no cycles, and looking for them costs more than the walk
        try:
            self.learn(fresh)
        finally:
            gc.enable()
        known, out = self.runs, []
        for runs in cut:
            if "" in runs:
                got, special = [], False
                for r in runs:
                    if not r:
                        special = True
                    else:
                        got.append((struct.pack("<I", self.added[r]), 1, r) if special else known[r])
                        special = False
            else:
                got = list(map(known.__getitem__, runs))
            out.append([p for p in got if p[1]] if self.silent else got)
        return out

    def encode(self, text: str) -> list[int]:
        return [i for ids, n, _ in self.pieces([text])[0] for i in struct.unpack(f"<{n}I", ids)]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.names[i] for i in ids)


@lru_cache(maxsize=2)
def encoder(path: str) -> WordBpe:
    """One encoder a worker process: tasks that follow one another there share what it has learnt."""
    return WordBpe(path)


def encode_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: ``id_col``, ids array<int>, decoded string."""
    schema = schema_of(f"{id_col} bigint, ids array<int>, decoded string")

    def make():
        bpe = encoder(path)

        def step(x):
            pieces = bpe.pieces([t or "" for t in x["text"]])
            return {
                id_col: x["id"],
                "ids": [[i for ids, n, _ in p for i in struct.unpack(f"<{n}I", ids)] for p in pieces],
                "decoded": [" ".join([s for _, _, s in p]) for p in pieces],
            }

        return step

    return map_batches(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), make, schema)


def digest_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As :func:`encode_documents`, with number and digests in place of ids and text, so that neither leaves its task."""
    schema = schema_of(f"{id_col} bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")

    def make():
        bpe, sha = encoder(path), hashlib.sha256

        def step(x):
            n, a, b = [], [], []
            for p in bpe.pieces([t or "" for t in x["text"]]):
                n.append(sum([q[1] for q in p]))
                a.append(sha(b"".join([q[0] for q in p])).hexdigest())
                b.append(sha(" ".join([q[2] for q in p]).encode()).hexdigest())
            return {id_col: x["id"], "n_tokens": n, "ids_sha256": a, "decoded_sha256": b}

        return step

    return map_batches(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), make, schema)
