"""Secret scans with corpus-wide ownership frequency.

Patterns propose candidates in every text. The value of each candidate is hashed, and for
each hash the distinct repositories and distinct owners that hold it are counted over the
whole corpus. A value that many owners and many repositories share, or a great many
repositories alone, is a copied example; any other value that looks random is live.
"""
from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import by_value, map_columns
from gleaner.llm.spans import digest, joined
from gleaner.session import snapshot

by_value(__name__)

KINDS = ("assign", "access", "hex", "key")      # the first three are the base
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# a run of 24 or more; shorter runs would be dropped anyway
_HEX = re.compile(r"[0-9a-f]{24,}")
# issued keys of fixed form, which only their owner should have
_KEY = re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}|sk_live_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{16,}"
                  r"|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}")


def candidates(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value), leftmost and without overlaps within each kind."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [("assign", *m.span(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", *m.span(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [("hex", *m.span(), m[0]) for m in _HEX.finditer(text)]
    held = [(s, e) for _, s, e, _ in out]
    out += [("key", *m.span(), m[0]) for m in _KEY.finditer(text)
            if not any(s <= m.start() and m.end() <= e for s, e in held)]
    return sorted(out, key=lambda c: (c[1], KINDS.index(c[0])))


def entropy(value: str) -> float:
    """Bits a character."""
    n = len(value)
    return sum(-c / n * math.log2(c / n) for c in Counter(value).values())


def secret_spans(docs: DataFrame, owner: str = "source", repository: str = "doc_id",
                 many_owners: int = 3, many_repositories: int = 3, any_repositories: int = 100,
                 least_entropy: float = 2.5) -> DataFrame:
    """doc_id, `found` and `aside`, arrays of (kind, start, stop, base, owners, repositories, live).

    `owners` and `repositories` count the distinct values of the two columns over all
    documents with the same secret value; null counts as one value. A value is shared, a
    copied example, if at least `many_owners` owners and `many_repositories` repositories hold
    it, or if `any_repositories` repositories do, whoever owns them: a key that leaked once
    stays live when its document is copied to a second owner, or often within one owner, and a
    placeholder all over one owner is shared. A span is live if its value is not shared and has
    `least_entropy` bits a character.
    Spans of issued-key forms (kind key) are found besides the base ones; they are part of
    `found` where live and of `aside` otherwise, so none is lost. Base spans are always in
    `found`.

    Null and empty texts have no spans. Repeated rows are answered each; they add nothing to
    the distinct counts. An empty table gives no row. Only the named columns are read.

    Counts are taken over distinct (value, owner) and (value, repository) pairs, which
    combine before the shuffle, so a value in a third of all documents is no hot group.
    """
    spans_type = "array<struct<kind:string,start:int,stop:int,hash:binary,random:double>>"

    def scan(batch):
        found = [[(k, s, e, hashlib.blake2b(v.encode(), digest_size=16).digest(), entropy(v))
                  for k, s, e, v in candidates(t or "")] for t in batch["text"]]
        return {"doc_id": batch["doc_id"], "owner": batch["owner"], "repository": batch["repository"],
                "spans": [[dict(zip(("kind", "start", "stop", "hash", "random"), x)) for x in f]
                          for f in found]}

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = snapshot(map_columns(
        docs.select("doc_id", F.col(owner).cast("string").alias("owner"),
                    F.col(repository).cast("string").alias("repository"), "text"),
        f"doc_id {kind}, owner string, repository string, spans {spans_type}", scan)
        .withColumn("_row", F.monotonically_increasing_id()), "secret-spans")
    each = rows.filter(F.size("spans") > 0).select(
        "_row", "owner", "repository", F.explode("spans").alias("s")).select(
        "_row", "owner", "repository", "s.*")
    holders = (each.select("hash", "owner").distinct().groupBy("hash").agg(F.count("*").alias("owners"))
               .join(each.select("hash", "repository").distinct().groupBy("hash")
                     .agg(F.count("*").alias("repositories")), "hash"))
    shared = (((F.col("owners") >= many_owners) & (F.col("repositories") >= many_repositories))
              | (F.col("repositories") >= any_repositories))
    live = ~shared & (F.col("random") >= least_entropy)
    span = F.struct("kind", "start", "stop", "base", "owners", "repositories", "live")
    judged = (each.join(snapshot(holders, "secret-holders"), "hash")
              .withColumn("live", live).withColumn("base", F.col("kind") != "key")
              .groupBy("_row").agg(*[F.collect_list(F.when(F.expr(part), span)).alias(name) for name, part in
                                     (("found", "base OR live"), ("aside", "NOT (base OR live)"))]))
    return rows.select("_row", "doc_id").join(judged, "_row", "left").select(
        "doc_id", *[F.coalesce(c, F.array().cast(judged.schema[c].dataType)).alias(c)
                    for c in ("found", "aside")])


def secret_digest(found: DataFrame) -> DataFrame:
    """Counts, digests and joined spans of `secret_spans`, by start and then kind as listed.

    `spans`, `n_live` and `n_shared` (not live) are of `found`; `aside` are the issued keys that
    are not live.
    """
    place = lambda s: (s["start"], KINDS.index(s["kind"]))

    def write(batch):
        out = {c: [] for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_shared",
                               "aside")}
        for spans, aside in zip(batch["found"], batch["aside"]):
            spans = sorted(spans, key=place)
            every = [(s["kind"], s["start"], s["stop"]) for s in spans]
            base = [x for x, s in zip(every, spans) if s["base"]]
            for k in KINDS[:3]:
                out[f"n_{k}"].append(sum(x[0] == k for x in base))
            out["base_sha256"].append(digest(base))
            out["spans"].append(joined(every))
            out["n_live"].append(sum(s["live"] for s in spans))
            out["n_shared"].append(sum(not s["live"] for s in spans))
            out["aside"].append(joined((s["kind"], s["start"], s["stop"]) for s in sorted(aside, key=place)))
        return {"doc_id": batch["doc_id"], **out}

    kind = found.schema["doc_id"].dataType.simpleString()
    return map_columns(found, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint,"
                       " base_sha256 string, spans string, n_live bigint, n_shared bigint, aside string", write)
