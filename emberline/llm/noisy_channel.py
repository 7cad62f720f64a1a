"""Toxicity of texts whose words may be disguised.

*Restoring.* A word, or a run of letters spelled out one by one, becomes a lattice: at each
place the channel allows the sign itself, the letters it may stand for, or, for a
repeat, fewer of it; a separator (blank, dot, dash, star, underscore) and a sign that is
also punctuation may stand for nothing or for the end of a word. How likely a
separator joins hangs on what stands around it: single letters are mostly spelled out, a
wider gap among narrow ones mostly ends a word. The lattice of a whole run is decoded by
Viterbi under a trigram language model of characters, counted over all documents, so that
``y o u  i d i o t`` gives two words. Only lattices of one path are not decoded.

*Scoring.* From a bounded sample of labelled documents (held-out ones never), words
and their beginnings are weighed by how much oftener toxic documents hold them. A
text's strongest distinct words, their number and density are the features of a
logistic regression. Only the text is an input.

Null texts count as empty; empty texts get the score of a text without any evidence.
Whole texts are scored, of any length. Repeated rows give equal rows; an empty table
gives none; other columns are ignored. Without labels of both kinds every score is the least there is (under 1e-12).
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import map_batches, schema_of

#: Labelled documents that are sampled of each kind; the bound of what comes to the driver.
SAMPLE = {1: 1500, 0: 3000}
# Letters that digits and signs may stand for.
LOOKALIKE = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
DISGUISE = re.compile(r"[0134567@$!|+(€89]")
LETTER = re.compile(r"[^\W\d_]")
WORD = re.compile(r"[^\W_]+")
STRETCHED = re.compile(r"([^\W\d_])\1\1")
SEPARATORS = " .-_*"
SPACED = re.compile(r"(?<!\S)(?:[^\s\w]?[^\W_]|[@$!|+(€])(?:[ .\-_*]{1,3}(?:[^\W_]|[@$!|+(€])){3,}(?![^\s.,;:!?])")
#: A separator beside a single letter.
SPELLED = re.compile(r"(?<![^\W_])[^\W_][.\-_*]+[^\W_]|[^\W_][.\-_*]+[^\W_](?![^\W_])")
JUNK = re.compile(r"([^\w\s])\1\1*$|^([^\w\s])\2\2*")
#: Log probabilities of the channel: as written, as a look-alike, a repeat dropped, a sign that ends a word.
AS_IS, LOOKS, DROPPED, STOPS = math.log(0.02), math.log(0.3), math.log(0.5), math.log(0.2)
#: That a separator joins: between single letters, in a gap wider than others there, beside one single letter, elsewhere.
JOINS = (0.95, 0.2, 0.5, 0.0)

ALPHABET = 64
CLASS = np.full(256, 63, np.uint8)
CLASS[[*b" \t\r\n.,;:!?\"'()"]] = 0
CLASS[[*b"abcdefghijklmnopqrstuvwxyz"]] = np.arange(1, 27)
CLASS[[*range(0xDF, 0xF7), *range(0xF8, 0x100)]] = 27 + np.arange(32) % 36


def classes(text: str) -> np.ndarray:
    return CLASS[np.frombuffer(text.lower().encode("latin-1", "replace"), np.uint8)]


def count_trigrams(df: DataFrame, text_col: str = "text") -> DataFrame:
    """key (three character classes) and n over all texts; each word is bounded by blanks."""

    def make():
        held = np.zeros(ALPHABET**3, np.int64)

        def step(x):
            nonlocal held
            if x is None:
                at = np.flatnonzero(held)
                return {"key": at.tolist(), "n": held[at].tolist()}
            c = classes(" ".join([t for t in x["text"] if t]) + "  ").astype(np.int64)
            if len(c) > 2:
                held += np.bincount((c[:-2] << 12) | (c[1:-1] << 6) | c[2:], minlength=ALPHABET**3)
            return None

        return step

    parts = map_batches(df.select(F.col(text_col).alias("text")), make, schema_of("key int, n bigint"), finish=True)
    return parts.groupBy("key").agg(F.sum("n").alias("n"))


def language_model(counts: list[tuple[int, int]], weight: float = 0.05) -> np.ndarray:
    """Log probabilities [two classes before, class], smoothed by the distribution of single characters. At most ALPHABET**3 counts."""
    n = np.zeros(ALPHABET**3)
    for k, v in counts:
        n[k] = v
    n = n.reshape(-1, ALPHABET)
    single = n.sum(0) + 1
    single = single / single.sum()
    total = n.sum(1, keepdims=True)
    seen = np.divide(n, total, out=np.tile(single, (len(n), 1)), where=total > 0)
    return np.log((1 - weight) * seen + weight * single)


class Restorer:
    """Viterbi decoding of disguised words and of runs of spelled-out letters."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()

    def lattice(self, run: str) -> list[list[tuple[str, float]]]:
        """Choices at each place: text and log probability."""
        chunks = [len(c) for c in re.split(r"[ .\-_*]+", run)]
        widths = [len(w) for w in re.findall(r"[ .\-_*]+", run.strip(SEPARATORS))]
        out, i, nth = [], 0, 0
        while i < len(run):
            j, c = i, run[i]
            if c in SEPARATORS:
                while j < len(run) and run[j] in SEPARATORS:
                    j += 1
                around, nth = chunks[nth : nth + 2], nth + 1
                if min(around) > 0:  # not at either end
                    kind = 3 if min(around) > 1 else 2 if max(around) > 1 else 1 if j - i > min(widths) else 0
                    out.append([(t, math.log(p)) for t, p in (("", JOINS[kind]), (" ", 1 - JOINS[kind])) if p])
                i = j
                continue
            while j < len(run) and run[j] == c:
                j += 1
            n, letters = j - i, LOOKALIKE.get(c, "")
            single = [(x, LOOKS) for x in letters] + ([(c, AS_IS if letters else 0.0)] if c.isalnum() or not letters else [])
            if n == 1:
                out.append(single)
            else:  # a run of one sign is one letter, two, or as written
                out.append([(t * k, p + (DROPPED if k < n else 0.0)) for t, p in single for k in sorted({1, 2, n})])
            if letters and not c.isalnum():
                out[-1].append((" ", STOPS))
            i = j
        return out

    def viterbi(self, run: str) -> str:
        """The likeliest reading; words are parted by blanks. Ties go to the smaller text."""
        states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        model = self.model
        for choices in self.lattice(run):
            new: dict[tuple[int, int], tuple[float, str]] = {}
            coded = [(t, p, [int(CLASS[ord(ch)]) if ord(ch) < 256 else 63 for ch in t]) for t, p in choices]
            for (a, b), (score, sofar) in states.items():
                for t, p, ks in coded:
                    s, x, y = score + p, a, b
                    for k in ks:
                        s += model[(x << 6) | y][k]
                        x, y = y, k
                    old = new.get((x, y))
                    if old is None or s > old[0] or s == old[0] and sofar + t < old[1]:
                        new[(x, y)] = (s, sofar + t)
            states = new
        return min(((-s - model[(a << 6) | b][0], t) for (a, b), (s, t) in states.items()))[1]

    def words(self, token: str) -> list[str]:
        """Words of a token (lower case, no white space), restored where there is a choice."""
        if token.isalpha() and not STRETCHED.search(token):
            return [token]
        inner = JUNK.sub("", token).strip(".,;:?\"'()[]{}-_*")
        if not LETTER.search(inner) or not (DISGUISE.search(inner) or STRETCHED.search(inner) or SPELLED.search(inner)):
            return WORD.findall(inner)
        return WORD.findall(self.viterbi(inner))

    def spaced(self, text: str) -> list[str]:
        """Words spelled out letter by letter with separators between."""
        return [w for m in SPACED.finditer(text) if LETTER.search(m[0]) for w in WORD.findall(self.viterbi(m[0].strip(",;:?\"'")))]

    def text(self, text: str) -> str:
        """The whole text in lower case, restored; words are parted by single blanks."""
        low = SPACED.sub(lambda m: self.viterbi(m[0].strip(",;:?\"'")) if LETTER.search(m[0]) else m[0], text.lower())
        return " ".join(w for token in low.split() for w in self.words(token))


def pieces(word: str) -> list[str]:
    """The word and its beginnings of 4 to 6 letters."""
    return [word, *[f"{word[:n]}~" for n in (4, 5, 6) if len(word) > n]]


def doc_pieces(text: str, restore: Restorer) -> set[str]:
    low = text.lower()
    words = {w for token in set(low.split()) for w in restore.words(token)}
    words.update(restore.spaced(low))
    return {p for w in words for p in pieces(w)}


class Scorer:
    CACHE = 400_000

    def __init__(self, model: np.ndarray, weights: dict[str, float], logit: list[float]):
        self.restore, self.weights, self.logit = Restorer(model), weights, logit
        self.known: dict[str, float] = {}

    def word(self, word: str) -> float:
        get = self.weights.get
        return max(0.0, get(word, 0.0), get(f"{word[:4]}~", 0.0), get(f"{word[:5]}~", 0.0), get(f"{word[:6]}~", 0.0))

    def token(self, token: str) -> float:
        got = max([self.word(w) for w in self.restore.words(token)], default=0.0)
        if len(self.known) >= self.CACHE:
            self.known.clear()
        self.known[token] = got
        return got

    def features(self, text: str) -> list[float]:
        low = text.lower()
        known = self.known
        tokens = set(low.split())
        hits = [s for t in tokens if (s := known[t] if t in known else self.token(t))]
        hits += [s for w in self.restore.spaced(low) if (s := self.word(w))]
        top = sorted(hits, reverse=True)[:3] + [0.0] * 3
        return [top[0], top[1], top[2], math.log1p(sum(hits)), sum(hits) / (len(tokens) + 20)]

    def score(self, text: str) -> float:
        z = self.logit[-1] + sum(a * b for a, b in zip(self.logit, self.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sizes: dict[int, int] | None = None) -> list[tuple[int, str]]:
    """(label, text) of at most ``sizes`` documents of each label, those with the smallest hashes of their ids; never held-out ones."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where(~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    chosen = None
    for y, n in (sizes or SAMPLE).items():
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(n)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    got = rows.join(F.broadcast(chosen), "id").select("id", "y", "text").toLocalIterator()
    return [(r[1], r[2]) for r in sorted((tuple(r) for r in got), key=lambda r: (r[0], r[1], r[2]))]


def counted(docs) -> tuple[Counter, dict[int, Counter]]:
    """Of (label, pieces): documents of each label, and those that hold each piece. One document is held at a time."""
    n, have = Counter(), {0: Counter(), 1: Counter()}
    for y, ps in docs:
        n[y] += 1
        have[y].update(ps)
    return n, have


def weigh(n: Counter, have: dict[int, Counter], least: int = 4, strength: float = 2.0) -> dict[str, float]:
    """Log ratio of the shares of toxic and other documents that hold a piece, shrunk; only clear evidence is kept."""
    out = {}
    for p, a in have[1].items():
        if a >= least:
            w = math.log((a + 0.1) / (n[1] + 1)) - math.log((have[0].get(p, 0) + 0.5) / (n[0] + 1))
            if w > strength:
                out[p] = w
    return out


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 60, l2: float = 1e-2) -> list[float]:
    """Weights and intercept by Newton's method."""
    a = np.hstack((x, np.ones((len(x), 1))))
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + l2 * w
        h = (a * (p * (1 - p))[:, None]).T @ a + l2 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if abs(step).max() < 1e-6:
            break
    return w.tolist()


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sizes: dict[int, int] | None = None) -> tuple:
    """Language model of all documents, weights of pieces, and regression; what :class:`Scorer` takes.

    Weights come from one half of the sample and the regression from the other, so that
    it sees evidence of the strength that new documents show.
    """
    counts = [(r.key, r.n) for r in count_trigrams(docs, text_col).collect()]  # at most ALPHABET**3
    model = language_model(counts).astype(np.float32)
    texts = sample(docs, labels, id_col, text_col, label_col, sizes)
    if len({y for y, _ in texts}) < 2:
        return model, {}, [0.0] * 5 + [-30.0]
    restore = Restorer(model)
    n, have = counted((y, doc_pieces(t, restore)) for y, t in texts[::2])
    half, rest = Scorer(model, weigh(n, have), [0.0] * 6), texts[1::2]
    for y, t in rest:
        n[y] += 1
        have[y].update(doc_pieces(t, restore))
    weights = weigh(n, have)
    del have
    if len({y for y, _ in rest}) < 2:
        half, rest = Scorer(model, weights, [0.0] * 6), texts
    x = np.array([half.features(t) for _, t in rest] + [half.features("")])
    y = np.array([float(y) for y, _ in rest] + [0.0])
    return model, weights, logistic(x, y)


def score(df: DataFrame, fitted: tuple, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each row: id, held_out, score and predicted."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(fitted)  # a bounded sample's weights and at most ALPHABET**3 floats

    def make():
        scorer = Scorer(*shared.value)

        def step(x):
            s = [scorer.score(t or "") for t in x["text"]]
            return {"id": x["id"], "held_out": x["held_out"], "score": s, "predicted": [int(v >= 0.5) for v in s]}

        return step

    rows = df.select(F.col(id_col).cast("long").alias("id"), held_out(F.col(id_col).cast("long")).alias("held_out"), F.col(text_col).alias("text"))
    return map_batches(rows, make, schema_of("id bigint, held_out boolean, score double, predicted int")).withColumnRenamed("id", id_col)


def restore(df: DataFrame, fitted: tuple, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each row: id and its whole text in lower case, restored (null stays null)."""
    shared = df.sparkSession.sparkContext.broadcast(fitted[0])  # at most ALPHABET**3 floats

    def make():
        restorer = Restorer(shared.value)

        def step(x):
            return {"id": x["id"], "text": [None if t is None else restorer.text(t) for t in x["text"]]}

        return step

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_batches(rows, make, schema_of("id bigint, text string")).withColumnsRenamed({"id": id_col, "text": text_col})
