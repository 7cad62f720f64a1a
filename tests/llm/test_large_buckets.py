"""Buckets of many blocks: their rows grow with their members, and no link is lost."""

import random

import numpy as np
import pytest

from emberline.llm import dart_minhash as DM


def near_copies(n, seed=7):
    rng = random.Random(seed)
    base = [f"u{rng.randrange(10**9)}" for _ in range(150)]
    rows = []
    for i in range(n):  # one to five edits each: some are alike, some are not
        other = list(base)
        for _ in range(1 + i % 5):
            other[rng.randrange(150)] = f"edit{i}x{rng.randrange(99)}"
        rows.append((i, " ".join(other)))
    o, h, c = DM.shingles([t for _, t in rows])
    at = np.searchsorted(o, np.arange(n + 1))
    sets = [(h[a:b], c[a:b]) for a, b in zip(at[:-1], at[1:])]
    return rows, np.array([[i != j and DM.similarity(x, y) >= 0.8 for j, y in enumerate(sets)] for i, x in enumerate(sets)])


@pytest.mark.parametrize("held", [0, 1 << 30])
def test_stripes_of_a_bucket_find_every_link_once(monkeypatch, held):
    monkeypatch.setattr(DM, "HELD_BYTES", held)
    rows, alike = near_copies(60)
    degree, edges = np.zeros(60, int), []
    for stripe in range(DM.STRIPES):
        shelf = DM.Shelf()
        for number in range(7):
            block = DM.Block([(77, stripe, number, 7, i, [77], [True], t) for i, t in rows if i % 7 == number])
            shelf.add(block, block.bytes())
        assert (shelf.file is None) == (held > 0)
        chosen = {r[4] for r in DM.chosen_of(77, stripe, shelf)}
        for a, b, n in DM.links_of(77, stripe, shelf, 0.8):
            assert a in chosen
            degree[a] += n
            edges.append((a, b))
    assert degree.tolist() == alike.sum(1).tolist() and 0 < alike.sum() < 60 * 59
    label = list(range(60))
    for a, b in edges:
        label = [min(label[a], label[b]) if x in (label[a], label[b]) else x for x in label]
    want = list(range(60))
    for a, b in zip(*np.nonzero(alike)):
        want = [min(want[a], want[b]) if x in (want[a], want[b]) else x for x in want]
    assert label == want


def test_rows_of_a_bucket_grow_with_its_members(spark, monkeypatch):
    monkeypatch.setattr(DM, "BLOCK", 4)
    dealt, by_stripe = [], DM.by_stripe

    def counted(members, *rest):
        dealt.append(members.count())
        return by_stripe(members, *rest)

    monkeypatch.setattr(DM, "by_stripe", counted)
    rows, alike = near_copies(200)
    got = {r.doc_id: r.n_links for r in DM.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(alike.sum(1).tolist()))
    assert len(dealt) == 2 and max(dealt) <= 200 * DM.BANDS * DM.STRIPES  # a member met each of some 30 blocks in each band before
