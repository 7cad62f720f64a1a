"""Secret scan with corpus-wide ownership frequency.

Candidates are found in every whole text. Three base kinds follow fixed patterns
(assignments, access keys, hexadecimal runs); a fourth finds other long mixed
tokens. The value of each candidate is hashed, and over the whole corpus the
distinct repositories and owners that hold it are counted. A value that few owners
hold is taken as a live-looking credential of theirs, a value that many hold as a
copied example. Base spans are kept either way; a live value adds a span of kind
``live`` over the value itself. How many owners decides; a bound on repositories is an option,
as one owner may well use a credential of its own in many.

Null texts count as empty. Offsets are code points, ends exclusive. A repository or
owner that is null counts as one more. Rows alike in id and text give equal rows; an empty
table gives none; other columns are ignored.
Counting is by partial aggregates over (value, owner, repository), so a value that
a third of all rows hold takes no more than its distinct pairs.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, map_batches, row_key, schema_of

#: Kinds in the order that breaks ties of position.
KINDS = ("assign", "access", "hex", "live")
# The patterns of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Other candidates: long runs over the base64url alphabet that hold a digit, an upper- and a lower-case letter.
MIXED = re.compile(r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{24,}(?![A-Za-z0-9_-])")
LONG_RUN = re.compile(r"[A-Za-z0-9_-]{24,}")


def find(text: str) -> list[tuple[str, int, int, int, int]]:
    """Base and other candidates: kind, start, end, and start and end of the value."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", m.start(), m.end(), m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m.start(), m.end()) for m in ACCESS.finditer(text)]
    if LONG_RUN.search(text):
        out += [("hex", m.start(), m.end(), m.start(), m.end()) for m in HEX.finditer(text)]
        for m in MIXED.finditer(text):
            run = m[0]
            if run.lower() != run and run.upper() != run:
                out.append(("mixed", m.start(), m.end(), m.start(), m.end()))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    """``kind:start:end`` by start, then kind as listed, then end; comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def hashed(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def candidates(df: DataFrame, id_col: str, text_col: str, repo_col: str, owner_col: str) -> DataFrame:
    """Of each row: id, key, repo, owner, base (kind, start, end) and values (hash, start, end)."""
    schema = schema_of("id bigint, row bigint, repo string, owner string, base array<struct<kind:string,a:int,b:int>>, found array<struct<value:bigint,a:int,b:int>>")

    def make():
        def step(x):
            base, found = [], []
            for t in x["text"]:
                got = find(t or "")
                base.append([{"kind": k, "a": a, "b": b} for k, a, b, _, _ in got if k != "mixed"])
                found.append([{"value": hashed(t[c:d]), "a": c, "b": d} for c, d in sorted({(c, d) for _, _, _, c, d in got})])
            return {"id": x["id"], "row": x["row"], "repo": x["repo"], "owner": x["owner"], "base": base, "found": found}

        return step

    rows = df.select(
        F.col(id_col).cast("long").alias("id"), row_key(text_col).alias("row"), F.col(repo_col).cast("string").alias("repo"),
        F.col(owner_col).cast("string").alias("owner"), F.col(text_col).alias("text"),
    )
    return map_batches(rows, make, schema)


def ownership(found: DataFrame) -> DataFrame:
    """Of each value: n_repos and n_owners over the whole corpus. ``found``: the rows of :func:`candidates`."""
    held = found.select(F.explode("found.value").alias("value"), F.coalesce("owner", F.lit("\0")).alias("owner"), F.coalesce("repo", F.lit("\0")).alias("repo")).distinct()
    by_owner = held.groupBy("value", "owner").agg(F.count("*").alias("n"))
    repos = held.select("value", "repo").distinct().groupBy("value").agg(F.count("*").alias("n_repos"))
    return by_owner.groupBy("value").agg(F.count("*").alias("n_owners")).join(repos, "value")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", max_owners: int = 1, max_repos: int | None = None) -> DataFrame:
    """Of each row: id, row (key of its text), base (kind, a, b) and live (a, b) spans.

    A value is live if at most ``max_owners`` owners and, if given, ``max_repos`` repositories
    hold it. The scan runs once: its rows, which hold no text, are checkpointed.
    """
    found = cut(candidates(df, id_col, text_col, repo_col, owner_col))
    few = F.col("n_owners") <= max_owners
    live = ownership(found).where(few if max_repos is None else few & (F.col("n_repos") <= max_repos)).select("value")
    each = found.select("id", "row", F.explode("found").alias("f")).select("id", "row", "f.value", "f.a", "f.b")
    spans = each.join(live, "value", "left_semi").groupBy("id", "row").agg(F.collect_set(F.struct("a", "b")).alias("live"))
    out = found.select("id", "row", "base").alias("d").join(spans.alias("s"), F.col("d.id").eqNullSafe(F.col("s.id")) & (F.col("d.row") == F.col("s.row")), "left")
    return out.select("d.id", "d.row", "d.base", F.coalesce("s.live", F.array().cast("array<struct<a:int,b:int>>")).alias("live"))


def digests(df: DataFrame, **options) -> DataFrame:
    """The spans of :func:`scan` as one row of counts and strings per document."""
    schema = schema_of("doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_live bigint")

    def make():
        def step(x):
            out = {k: [] for k in schema.names}
            for i, base, live in zip(x["id"], x["base"], x["live"]):
                own = [(s["kind"], s["a"], s["b"]) for s in base]
                out["doc_id"].append(i)
                for k in KINDS[:3]:
                    out[f"n_{k}"].append(sum(s[0] == k for s in own))
                out["base_sha256"].append(hashlib.sha256(joined(own).encode()).hexdigest())
                out["spans"].append(joined(own + [("live", s["a"], s["b"]) for s in live]))
                out["n_live"].append(len(live))
            return out

        return step

    return map_batches(scan(df, **options), make, schema, rows=4096)


def redact(df: DataFrame, mask: str = "[SECRET]", **options) -> DataFrame:
    """``df`` with every live value masked in its text (n_chars, if there, follows); copied examples stay."""
    spans = scan(df, **options).where(F.size("live") > 0).select(F.col("id").alias("_id"), F.col("row").alias("_row"), F.col("live").alias("_live")).distinct()

    @F.pandas_udf("string")
    def masked(texts, live):
        def one(t, spans):
            if t is None or spans is None:
                return t
            at, out = 0, []
            for a, b in sorted((s["a"], s["b"]) for s in spans):
                if b <= at:
                    continue
                if a >= at:
                    out += [t[at:a], mask]
                at = b
            return "".join([*out, t[at:]])

        return texts.combine(live, one)

    text = masked(F.col("text"), F.col("_live"))
    joined_rows = df.join(spans, F.col("doc_id").eqNullSafe(F.col("_id")) & (row_key("text") == F.col("_row")), "left")
    out = joined_rows.withColumn("text", F.when(F.col("_live").isNull(), F.col("text")).otherwise(text)).select(*df.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in df.columns else out
