"""Quality rules: a linear-chain conditional random field labels lines as content or boilerplate.

Each line with words is described by a few binned features (share of symbols and of
digits, length, repetition, punctuation, case, notice words). A two-state CRF with
weights for features and transitions is fitted to a bounded sample of labelled documents,
whole. Their lines' labels are not known: of a good document at least SHARE of the words
lie in content lines, of a bad one at least that share in boilerplate, and which lines
those are is latent. Each step finds, by forward-backward, the distribution over paths
that is nearest to the model's and meets the document's share (its chain tilted by one
number), and moves the weights from the model's expected features towards that one's
(posterior regularisation). So good documents may hold boilerplate and bad ones content.
Viterbi decoding labels the lines of a text; the share of its words in content lines decides
whether it is kept.

Null texts count as empty: no words, base_failed. Texts without lines of words are
not kept. Words are ``[^\\x20\\x09-\\x0D]+``. Texts of any length are read whole, in
training too; rows of null ids or texts are not trained on; no
row is dropped; repeated rows give equal rows; other columns are ignored; an empty table gives none.
Without labels nothing is known and every line is content.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_batches, schema_of

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
NOTICE = re.compile(r"licen[sc]ed|copyright|all rights reserved|cookie|subscribe|privacy policy|terms of (?:use|service)|click here", re.I)
#: Bins of each feature, in order: words, symbols, digits, distinct words, long words, flags.
SIZES = (5, 4, 3, 3, 2, 2, 2, 2, 2, 2)
OFFSETS = np.cumsum((0, *SIZES))[:-1]
N_FEATURES = sum(SIZES)
#: Labelled documents that the model is fitted to, whole.
SAMPLE_DOCS = 3000
#: Words of a document that its label speaks for.
SHARE = 0.8
#: Lines of a segment of a chain.
SEGMENT = 32


def words_of(text: str) -> list[bytes]:
    """``bytes.split`` knows exactly the six blanks."""
    return text.encode("utf-8", "surrogatepass").split()


def features(line: str, words: list[bytes], seen: bool) -> tuple[int, ...]:
    n, size = len(words), len(line)
    symbols = sum(map(line.count, SYMBOLS)) / size
    digits = sum(map(line.count, "0123456789")) / size
    distinct = len(set(words)) / n
    shouts = line.count("!")
    return (
        0 if n < 3 else 1 if n < 6 else 2 if n < 15 else 3 if n < 60 else 4,
        0 if not symbols else 1 if symbols < 0.02 else 2 if symbols < 0.08 else 3,
        0 if not digits else 1 if digits < 0.15 else 2,
        0 if distinct < 0.4 else 1 if distinct < 0.7 or n < 4 else 2,
        int(sum(map(len, words)) > 12 * n),
        int(seen),
        int(line.rstrip(BLANKS)[-1] in ".!?:;\"'"),
        int(shouts * 3 > n),
        int(line.isupper()),
        int(bool(NOTICE.search(line))),
    )


def read(text: str) -> tuple[list[tuple[int, ...]], list[int], int, list[bytes]]:
    """Features and word counts of the lines that have words, number of duplicate lines, all words."""
    feats, sizes, dup, seen, every = [], [], 0, set(), []
    for line in text.split("\n"):
        words = words_of(line)
        if words:
            again = line in seen
            dup += again
            seen.add(line)
            feats.append(features(line, words, again))
            sizes.append(len(words))
            every += words
    return feats, sizes, dup, every


def repeated(words: list, n: int = 5) -> int:
    """Words in windows of ``n`` that are found twice or more in the text, the first included."""
    windows = list(zip(*(words[i:] for i in range(n))))
    if len(set(windows)) == len(windows):
        return 0
    count: dict = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    total, end = 0, 0
    for i, w in enumerate(windows):
        if count[w] > 1:
            total += i + n - max(i, end)
            end = i + n
    return total


class Chains:
    """Forward and backward sums over many chains at once, cut into segments so that a long chain takes few steps.

    Each segment's 2 x 2 transfer is summed for all segments together, chains are
    passed segment by segment, and then each segment is gone through from what
    comes in: the same sums as line by line.
    """

    def __init__(self, chains: list[tuple[np.ndarray, np.ndarray]]):
        """``chains``: features (lines, kinds) and words of the lines, at least one line each."""
        sizes = np.array([len(f) for f, _ in chains])
        parts = -(-sizes // SEGMENT)
        self.n, self.chain = len(chains), np.repeat(np.arange(len(chains)), parts)
        self.nth = np.arange(len(self.chain)) - np.repeat(np.cumsum(parts) - parts, parts)
        self.start, self.parts = np.cumsum(parts) - parts, parts
        self.feats = np.zeros((len(self.chain), SEGMENT, len(SIZES)), np.int64)
        self.mask = np.zeros((len(self.chain), SEGMENT), bool)
        self.weight = np.zeros((len(self.chain), SEGMENT))
        for s, (i, k) in enumerate(zip(self.chain, self.nth)):
            f, words = chains[i]
            part = slice(k * SEGMENT, (k + 1) * SEGMENT)
            n = len(f[part])
            self.feats[s, :n], self.mask[s, :n] = f[part], True
            self.weight[s, :n] = words[part] * (len(f) / words.sum())
        self.lines = sizes
        self.steps = [np.flatnonzero(self.nth == k) for k in range(parts.max())]

    def run(self, e: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals (segments, lines, states) and expected transitions (segments, lines, from, to)."""
        many, gone = len(self.chain), np.log(np.zeros(1) + 1e-300)[0]
        into = np.broadcast_to(move, (many, 2, 2)).copy()  # into a segment's first line; a chain's first has nothing before it
        into[self.nth == 0] = 0
        step = lambda t: into if t == 0 else move[None]
        total = lambda x, axis: np.logaddexp(np.take(x, 0, axis), np.take(x, 1, axis))
        pass_ = np.broadcast_to(np.array([[0.0, gone], [gone, 0.0]]), (many, 2, 2))
        for t in range(SEGMENT):
            new = total(pass_[:, :, :, None] + step(t)[:, None], 2) + e[:, t, None, :]
            pass_ = np.where(self.mask[:, t, None, None], new, pass_)
        come = np.empty((many, 2))
        come[self.steps[0]] = [0.0, gone]
        for now in self.steps[1:]:
            come[now] = total(come[now - 1][:, :, None] + pass_[now - 1], 1)
        last = self.start + self.parts - 1
        z = total(total(come[last][:, :, None] + pass_[last], 1), 1)[self.chain]
        follow = np.zeros((many, 2))
        for now in reversed(self.steps[1:]):
            follow[now - 1] = total(pass_[now] + follow[now][:, None, :], 2)
        before, fwd, bwd = np.empty((many, SEGMENT, 2)), np.empty((many, SEGMENT, 2)), np.empty((many, SEGMENT, 2))
        v, w = come, follow
        for t in range(SEGMENT):
            before[:, t] = v
            v = np.where(self.mask[:, t, None], total(v[:, :, None] + step(t), 1) + e[:, t], v)
            fwd[:, t] = v
        for t in reversed(range(SEGMENT)):
            bwd[:, t] = w
            w = np.where(self.mask[:, t, None], total(step(t) + (e[:, t] + w)[:, None, :], 2), w)
        p = np.exp(fwd + bwd - z[:, None, None]) * self.mask[:, :, None]
        joint = np.exp(before[:, :, :, None] + move + (e + bwd)[:, :, None, :] - z[:, None, None, None]) * self.mask[:, :, None, None]
        joint[self.nth == 0, 0] = 0
        return p, joint

    def share(self, p: np.ndarray) -> np.ndarray:
        """Expected share of each chain's words in content lines."""
        return np.bincount(self.chain, (p[:, :, 1] * self.weight).sum(1), self.n) / self.lines


class LineCrf:
    """Two states: 0 boilerplate, 1 content. ``emit`` and ``move`` are log potentials."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move
        self.known: dict[tuple, tuple[float, float]] = {}

    @classmethod
    def train(cls, docs: list[tuple[np.ndarray, np.ndarray, int]], steps: int = 80, rate: float = 4.0, l2: float = 1e-3) -> LineCrf:
        """``docs``: features (lines, kinds) and words of the lines of whole documents, and their labels."""
        emit, move = np.zeros((N_FEATURES, 2)), np.zeros((2, 2))
        docs = [d for d in docs if len(d[0])]
        if not docs:
            return cls(emit, move)
        chains = Chains([(np.asarray(f) + OFFSETS, np.asarray(w)) for f, w, _ in docs])
        sign = np.array([1.0 if y else -1.0 for _, _, y in docs])
        tilt = np.zeros(len(docs))
        # every document counts alike, whatever its length
        by = (1.0 / (chains.lines * len(docs)))[chains.chain]
        for _ in range(steps):
            e = emit[chains.feats].sum(2)
            p, joint = chains.run(e, move)
            for _ in range(3):
                tilted = e.copy()
                tilted[:, :, 1] += (sign * tilt)[chains.chain][:, None] * chains.weight
                q, joint_q = chains.run(tilted, move)
                short = SHARE - np.where(sign > 0, chains.share(q), 1 - chains.share(q))
                tilt = np.clip(tilt + 4.0 * short, 0.0, 30.0)
            diff = (q - p) * by[:, None, None]
            flat = chains.feats.ravel()
            for s in (0, 1):
                emit[:, s] += rate * np.bincount(flat, np.repeat(diff[:, :, s].ravel(), chains.feats.shape[2]), N_FEATURES)
            move += 0.25 * rate * ((joint_q - joint) * by[:, None, None, None]).sum((0, 1))
            emit -= rate * l2 * emit
            move -= rate * l2 * move
        return cls(emit, move)

    def potentials(self, f: tuple[int, ...]) -> tuple[float, float]:
        got = self.known.get(f)
        if got is None:
            row = self.emit[np.array(f) + OFFSETS].sum(0)
            got = self.known[f] = (float(row[0]), float(row[1]))
        return got

    def viterbi(self, feats: list[tuple[int, ...]]) -> list[int]:
        """The likeliest labels; ties go to content."""
        if not feats:
            return []
        (m00, m01), (m10, m11) = self.move.tolist()
        back = []
        a, b = self.potentials(feats[0])
        for f in feats[1:]:
            x, y = self.potentials(f)
            fa, fb = m10 + b >= m00 + a, m11 + b >= m01 + a
            a, b = x + (m10 + b if fa else m00 + a), y + (m11 + b if fb else m01 + a)
            back.append((fa, fb))
        out = [int(b >= a)]
        for fa, fb in reversed(back):
            out.append(int(fb if out[-1] else fa))
        return out[::-1]

    def share(self, feats: list, sizes: list[int]) -> float:
        """Share of words in content lines; 0 if there are none."""
        total = sum(sizes)
        return sum(n for n, y in zip(sizes, self.viterbi(feats)) if y) / total if total else 0.0


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", limit: int = SAMPLE_DOCS) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Line features, words of the lines, and label of at most ``limit`` labelled documents, those with the smallest hashes of their ids; all their lines.

    Features are made on the executors and come as one byte each.
    """
    chosen = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
    chosen = chosen.groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(limit)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(chosen), "id")

    def make():
        def step(x):
            read_ = [read(t) for t in x["text"]]
            return {
                "id": x["id"], "y": x["y"], "feats": [np.array(r[0], np.uint8).tobytes() for r in read_],
                "sizes": [np.array(r[1], np.int32).tobytes() for r in read_],
            }

        return step

    # a text that has several rows is learnt once; of unlike texts of one id that of the least features is taken
    once = map_batches(rows, make, schema_of("id bigint, y int, feats binary, sizes binary")).groupBy("id").agg(F.min(F.struct("feats", "sizes", "y")).alias("r"))
    got = sorted((tuple(r) for r in once.select("id", "r.feats", "r.sizes", "r.y").collect()), key=lambda r: r[0])
    return [(np.frombuffer(f, np.uint8).reshape(-1, len(SIZES)), np.frombuffer(n, np.int32), y) for _, f, n, y in got]


def fit(docs: DataFrame, labels: DataFrame, **options) -> LineCrf:
    return LineCrf.train(sample(docs, labels, **options))


def judge(df: DataFrame, model: LineCrf, id_col: str = "doc_id", text_col: str = "text", min_share: float = 0.5) -> DataFrame:
    """Of each row: the base counts, base_failed, content_share and kept."""
    schema = schema_of(f"{id_col} bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, content_share double, kept boolean")
    emit, move = model.emit, model.move

    def make():
        crf = LineCrf(emit, move)

        def step(x):
            out = {k: [] for k in schema.names}
            for i, t in zip(x["id"], x["text"]):
                t = t or ""
                feats, sizes, dup, words = read(t)
                n, again = len(words), repeated(words)
                failed = n < 10 or 100 * again > 20 * n
                share = crf.share(feats, sizes)
                row = (i, n, len(t) - sum(map(t.count, BLANKS)), sum(map(t.count, SYMBOLS)), dup, again, failed, share, not failed and share >= min_share)
                for k, v in zip(schema.names, row):
                    out[k].append(v)
            return out

        return step

    return map_batches(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), make, schema)


def keep(df: DataFrame, model: LineCrf, min_share: float = 0.5) -> DataFrame:
    """The rows of ``df`` that :func:`judge` keeps, with their columns; judged in place, without a join."""
    emit, move = model.emit, model.move
    crf = LineCrf(emit, move)

    @F.pandas_udf("boolean")
    def good(texts):
        def one(t):
            feats, sizes, _, words = read(t or "")
            n = len(words)
            return not (n < 10 or 100 * repeated(words) > 20 * n) and crf.share(feats, sizes) >= min_share

        return texts.map(one)

    return df.where(good("text"))
