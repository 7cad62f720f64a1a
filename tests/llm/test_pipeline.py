"""Every stage of the corpus pipeline against a plain version of it, on all that the stage before kept."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from emberline.llm import dart_minhash as DM, line_crf, packing, secret_ownership as SO

RNG = random.Random(21)
WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "ter", "un", "sol") for b in ("da", "ren", "tik", "or", "usch", "é")]
KEYS = [hashlib.md5(str(i).encode()).hexdigest() for i in range(6)]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def corpus():
    """(doc_id, text, source): prose, junk, near copies, copies, shared passages, secrets, and odd rows."""
    passage, rows = prose(40), []
    for i in range(40):
        text = "\n".join(f"{prose(RNG.randrange(6, 20))}." for _ in range(RNG.randrange(2, 6)))
        if i % 4 == 0:
            text += "\n" + passage
        if i % 5 == 0:
            text += f"\ntoken = {KEYS[i // 5 % 6]} and so on"
        if i % 8 == 7:
            text = "\n".join("*** $$$ ### click here" for _ in range(6))
        rows.append((i, text, "ab"[i % 2]))
    rows += [(100 + i, t + " end", s) for i, t, s in rows[:6]] + [(200 + i, t, s) for i, t, s in rows[8:12]]
    rows += [(300, None, "a"), (301, "", "a"), (302, " \n\t", None), (None, rows[1][1] + "\n" + prose(30), "a"), (303, "x" * 4000, "b"), rows[2], rows[2], (2, prose(60), "b")]
    return rows


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, "xx", s, len(t or "")) for i, t, s in corpus()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"key": F.lit("clash"), "row": F.lit(1), "bucket": F.lit("c")})
    docs.repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, int(i % 8 != 7), 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    return sf


def texts(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def good(model, text):
    feats, sizes, _, words = line_crf.read(text or "")
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    again = len({k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)})
    return len(words) >= 10 and 100 * again <= 20 * len(words) and model.share(feats, sizes) >= 0.5


def firsts(rows):
    """One row of each class of texts that are alike, or equal."""
    rows = sorted({r[:2] for r in rows}, key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()))
    o, h, c = DM.shingles([t for _, t in rows])
    at = np.searchsorted(o, np.arange(len(rows) + 1))
    sets = [dict(zip(h[a:b].tolist(), c[a:b].tolist())) for a, b in zip(at[:-1], at[1:])]
    label = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            least = sum(min(x[k], y[k]) for k in x.keys() & y.keys())
            most = sum(x.values()) + sum(y.values()) - least
            if rows[i][1] == rows[j][1] or most and least / most >= 0.8:
                a, b = label[i], label[j]
                label = [min(a, b) if v in (a, b) else v for v in label]
    return [rows[i] for i in range(len(rows)) if label[i] == i]


def without_repeats(rows, n=100):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = t.encode()
        mark = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if b[p : p + n] in seen:
                mark[p : p + n] = b"\1" * n
            seen.add(b[p : p + n])
        out.append((i, bytes(x for x, m in zip(b, mark) if not m).decode("utf-8", "ignore")))
    return out


def masked(rows):
    """``rows``: id, text, source."""
    owners = {}
    for _, t, s in rows:
        for _, _, _, a, b in SO.find(t):
            owners.setdefault(t[a:b], set()).add(s)
    out = []
    for i, t, _ in rows:
        spans, at, made = sorted({(a, b) for _, _, _, a, b in SO.find(t) if len(owners[t[a:b]]) == 1}), 0, ""
        for a, b in spans:
            if b <= at:
                continue
            if a >= at:
                made += t[at:a] + "[SECRET]"
            at = b
        out.append((i, made + t[at:]))
    return out


def test_stages_against_plain_versions(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    order = lambda rows: sorted((-1 if i is None else i, t) for i, t in rows)
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]

    model = line_crf.fit(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    one = stages["quality_rules"](spark, docs, tables)
    want = [r for r in rows if good(model, r[1])]
    assert one.columns == columns and texts(one) == order((i, t) for i, t, _ in want) and 0 < len(want) < len(rows)

    two = stages["near_duplicates"](spark, one, tables)
    kept = firsts(want)
    assert two.columns == columns and texts(two) == order(kept) and len(kept) < len(want)

    three = stages["repeated_passages"](spark, two, tables)
    cut = without_repeats(kept)
    assert three.columns == columns and texts(three) == order(cut) and sum(len(t) for _, t in cut) < sum(len(t) for _, t in kept)
    assert three.where("n_chars <> length(text)").count() == 0

    four = stages["secrets"](spark, three, tables)
    hidden = masked([(r.doc_id, r.text, r.source) for r in three.collect()])
    assert four.columns == columns and texts(four) == order(hidden) and any("[SECRET]" in t for _, t in hidden)

    import public_tokenizers

    encode = packing.encoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    five = stages["packing"](spark, four, tables).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in five if r.piece == 0) == order(hidden)
    assert all(encode(r.text)[: r.n_tokens] == r.ids for r in five if r.piece == 0)
    bins = {}
    for r in five:
        if r.bin_id is not None:
            bins.setdefault(r.bin_id, []).append(r)
    for rs in bins.values():
        assert {(r.bin_tokens, r.capacity) for r in rs} == {(sum(r.n_tokens for r in rs), packing.smallest(packing.LENGTHS, sum(r.n_tokens for r in rs)))}

    whole = corpus_pipeline.run(spark, tables)
    assert sorted(repr(tuple(r)) for r in whole.drop("bin_id").collect()) == sorted(repr(tuple(v for n, v in zip(r.__fields__, r) if n != "bin_id")) for r in five)


def test_an_empty_table_goes_through(spark, tables, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{tables}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
