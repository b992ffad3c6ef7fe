"""Near-duplicates by DartMinHash: weighted minwise signatures and banded joining.

Every element of a document, a shingle with its number of uses as weight, owns a strip of the
plane: its weight wide, ranks upward. Hashed darts fall on the strip as a Poisson process of
rate one, the same ones in every document that holds the element. Each dart belongs to one of
k coordinates by its hash, and a coordinate's value is the dart of lowest rank over all
elements. A document needs about k ln k darts however many elements it has. Two documents
agree in a coordinate with the probability of their weighted Jaccard similarity.
"""
from __future__ import annotations

import hashlib
import re
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import by_value, components, map_columns, map_groups
from gleaner.session import snapshot

by_value(__name__)

K, ROWS = 128, 4                 # coordinates, and how many make a band
BANDS = K // ROWS
SHINGLE = 5
UNITS = 400_000                  # element units signed together
BLOCK = 2_048                    # documents of one bucket compared in one task
BLOCK_CHARS = 16 << 20           # and characters of their texts
_WORD = re.compile(r"\w+")
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB,
                               0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x + _ODD[0]).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * _ODD[1]
    x = (x ^ (x >> np.uint64(27))) * _ODD[2]
    return x ^ (x >> np.uint64(31))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def elements(words: list[str], known: dict[str, int], size: int = SHINGLE):
    """Sorted shingle hashes and their number of uses; shorter texts are one shingle."""
    for w in words:
        if w not in known:
            known[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"),
                                                      digest_size=8).digest(), "little")
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = min(size, len(h))
    parts = sum(h[i:len(h) - n + 1 + i] * _ODD[i] for i in range(n))
    return np.unique(mixed(parts + np.uint64(n)), return_counts=True)


def signatures(docs: list[tuple[np.ndarray, np.ndarray]], k: int = K) -> np.ndarray:
    """One row of k dart numbers for each (elements, weights > 0) of at least one element."""
    n = len(docs)
    elem = np.concatenate([e for e, _ in docs]).astype(np.uint64)
    weight = np.concatenate([w for _, w in docs]).astype(np.float64)
    owner = np.repeat(np.arange(n), [len(e) for e, _ in docs])
    total = np.bincount(owner, weight, n)
    # strips are cut into units of weight; the last unit of a strip may be narrower
    units = np.ceil(weight).astype(np.int64)
    strip = np.repeat(np.arange(len(elem)), units)
    unit = np.arange(len(strip)) - np.repeat(np.cumsum(units) - units, units)
    width = np.minimum(weight[strip] - unit, 1.0)
    key = mixed(elem[strip] + unit.astype(np.uint64) * _ODD[3])
    doc = owner[strip]
    throw = np.zeros(len(key), dtype=np.uint64)
    rank = -np.log(_uniform(mixed(key)))
    top = k * (np.log(k) + 4.0) / total              # ranks looked at so far, by document
    best = np.full(n * k, np.inf)
    value = np.zeros(n * k, dtype=np.uint64)
    active = np.flatnonzero(rank <= top[doc])
    while True:
        while len(active):
            dart = mixed(key[active] ^ ((throw[active] + np.uint64(1)) * _ODD[4]))
            slot = doc[active] * k + (dart % np.uint64(k)).astype(np.int64)
            on = _uniform(mixed(dart + _ODD[5])) < width[active]
            np.minimum.at(best, slot[on], rank[active][on])
            won = on & (rank[active] == best[slot])
            value[slot[won]] = dart[won]
            throw[active] += np.uint64(1)
            rank[active] -= np.log(_uniform(mixed(dart ^ _ODD[3])))
            active = active[rank[active] <= top[doc[active]]]
        open_ = np.isinf(best).reshape(n, k).any(axis=1)
        if not open_.any():
            return value.reshape(n, k)
        top[open_] *= 2                                # a coordinate has no dart yet
        active = np.flatnonzero(open_[doc] & (rank <= top[doc]))


def similarity(a, b) -> float:
    """Weighted Jaccard similarity of two (elements, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = np.minimum(a[1][i], b[1][j]).sum()
    return common / (a[1].sum() + b[1].sum() - common)


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, print (of the word sequence, null without words), bands, signature, n_chars."""
    known: dict[str, int] = {}

    def sign(batch):
        prints, todo = [], {}
        for text in batch["text"]:
            words = words_of(text)
            mark = hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"),
                                   digest_size=16).digest() if words else None
            prints.append(mark)
            if words and mark not in todo:
                if len(known) > 200_000:
                    known.clear()
                todo[mark] = elements(words, known)
        made, share, size = {}, [], 0
        for n, (mark, pair) in enumerate(todo.items(), 1):
            share.append(mark)
            size += int(pair[1].sum())
            if size >= UNITS or n == len(todo):
                sigs = signatures([todo[m] for m in share])
                bands = (sigs.reshape(-1, BANDS, ROWS) * np.array(_ODD[:ROWS])).sum(axis=2, dtype=np.uint64)
                bands = mixed(bands + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
                low = (sigs >> np.uint64(32)).astype(np.uint32)
                made |= {m: (b.tolist(), s.tobytes()) for m, b, s in zip(share, bands, low)}
                share, size = [], 0
        return {"doc_id": batch["doc_id"], "print": prints,
                "bands": [made[m][0] if m else None for m in prints],
                "signature": [made[m][1] if m else None for m in prints],
                "n_chars": [len(t or "") for t in batch["text"]]}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_columns(docs.select("doc_id", "text"),
                       f"doc_id {kind}, print binary, bands array<bigint>, signature binary,"
                       " n_chars bigint", sign)


def _verified(pairs: DataFrame, texts: DataFrame, least: float, label: str) -> DataFrame:
    """Pairs (a, b) whose texts are similar. Pairs of one b come together and share its set."""
    known: dict[str, int] = {}
    last: list = [None, None]

    def judge(batch):
        out = {"a": [], "b": []}
        if len(known) > 200_000:
            known.clear()
        for a, b, ta, tb in zip(*(batch[c] for c in ("a", "b", "ta", "tb"))):
            if last[0] != (b, tb):
                last[:] = (b, tb), elements(words_of(tb), known)
            if similarity(elements(words_of(ta), known), last[1]) >= least:
                out["a"].append(a)
                out["b"].append(b)
        return out

    kind = pairs.schema["a"].dataType.simpleString()
    both = (pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
            .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
            .select("a", "b", "ta", "tb"))
    return snapshot(map_columns(both, f"a {kind}, b {kind}", judge), label)


def _between(batch, least: float, slack: float) -> dict[str, list]:
    """Links between different components in one block of a bucket.

    Pairs whose signatures agree in `least - slack` of the coordinates are compared exactly,
    the most alike first, each in the first band that it shares, unless links found before
    have joined their components.
    """
    sig = np.frombuffer(b"".join(batch["signature"]), dtype=np.uint32).reshape(-1, K)
    ids, comp, side = np.array(batch["rep"]), batch["comp"], np.array(batch["side"])
    known: dict[str, int] = {}
    sets: dict[int, tuple] = {}
    above = {c: c for c in comp}

    def root(c):
        while above[c] != c:
            above[c] = above[above[c]]
            c = above[c]
        return c

    def held(n):
        if n not in sets:
            sets[n] = elements(words_of(batch["text"][n]), known)
        return sets[n]

    home = np.unique(comp, return_inverse=True)[1]
    pairs = []
    for n in range(len(ids)):
        fit = home != home[n]
        fit &= ids > ids[n] if batch["i"][0] == batch["j"][0] else side > side[n]
        at = np.flatnonzero(fit)
        if len(at):
            same = sig[at] == sig[n]
            share = same.mean(axis=1)
            keep = np.flatnonzero(share >= least - slack)
            first = same[keep].reshape(len(keep), BANDS, ROWS).all(axis=2).argmax(axis=1)
            keep = keep[first == batch["band"][0]]
            pairs += zip((-share[keep]).tolist(), [n] * len(keep), at[keep].tolist())
    out: dict[str, list] = {"a": [], "b": []}
    for _, n, m in sorted(pairs):
        x, y = root(comp[n]), root(comp[m])
        if x != y and similarity(held(n), held(m)) >= least:
            above[max(x, y)] = min(x, y)
            out["a"].append(int(max(ids[n], ids[m])))
            out["b"].append(int(min(ids[n], ids[m])))
    return out


def near_duplicates(docs: DataFrame, least: float = 0.8, slack: float = 0.18) -> DataFrame:
    """doc_id, class_id and kept of every document.

    Documents are linked if their weighted Jaccard similarity over five-word shingles (lower
    case, weights are numbers of uses) is at least `least`; a class is a connected component of
    links, `class_id` its smallest doc_id, and that document is `kept`. Texts of fewer than five
    words are one shingle. Null and empty texts, texts without words, and rows without doc_id
    are never linked and always kept. Rows that share a doc_id are one document. An empty
    table gives no row. Only doc_id and text are read; doc_id is an integer.

    1. Equal word sequences become one representative, combined before the shuffle.
    2. Representatives that share one of 32 bands meet in a bucket. Each is compared with the
       bucket's smallest member by exact similarity, so a bucket of n gives n - 1 pairs.
    3. Buckets that hold several components are cut into blocks of bounded number and text.
       In them, pairs between different components whose signatures agree in `least - slack`
       of the coordinates (5 standard deviations at the threshold) are compared exactly. A pair
       inside one component is never formed, and only links leave the task.

    A pair at the threshold shares no band with probability (1 - 0.8^4)^32 < 1e-7, and falls short
    of the signature test with about 2e-7.
    """
    marks = snapshot(signed(docs.filter("doc_id IS NOT NULL")), "minhash-signed")
    reps = snapshot(marks.filter("print IS NOT NULL").groupBy("print").agg(
        F.min("doc_id").alias("rep"), F.first("bands").alias("bands"),
        F.first("signature").alias("signature"), F.max("n_chars").alias("n_chars")), "minhash-reps")
    bands = reps.select("rep", "n_chars", F.posexplode("bands").alias("band", "bucket"))
    heads = (bands.groupBy("bucket").agg(F.min("rep").alias("head"), F.count("*").alias("size"),
                                         F.sum("n_chars").alias("chars")).filter("size > 1"))
    shared = snapshot(bands.drop("n_chars").join(heads, "bucket"), "minhash-buckets")
    asked = shared.select(F.col("rep").alias("doc_id")).distinct()
    texts = snapshot(docs.select("doc_id", "text").join(asked, "doc_id", "left_semi"), "minhash-texts")
    links = _verified(shared.filter("rep <> head").select(F.col("rep").alias("a"), F.col("head").alias("b"))
                      .distinct(), texts, least, "minhash-links")
    comp = components(links, "minhash-classes").select(F.col("node").alias("rep"), F.col("root").alias("comp"))
    placed = (shared.join(comp, "rep", "left").withColumn("comp", F.coalesce("comp", "rep")))
    several = (placed.groupBy("bucket").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"))
               .filter("_lo < _hi").select("bucket"))
    parts = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("chars") / BLOCK_CHARS)).cast("int")
    blocks = (placed.join(several, "bucket").join(reps.select("rep", "signature"), "rep")
              .join(texts.withColumnRenamed("doc_id", "rep"), "rep")
              .withColumn("side", F.pmod(F.xxhash64("rep"), parts).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
              .select("bucket", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"),
                      "rep", "comp", "band", "side", "signature", "text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    more = snapshot(map_groups(blocks, ["bucket", "i", "j"], f"a {kind}, b {kind}",
                               partial(_between, least=least, slack=slack)), "minhash-links")
    # copies of one doc_id in different texts are one document
    twice = (marks.filter("print IS NOT NULL").join(reps.select("print", "rep"), "print")
             .filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    comp = components(links.unionByName(more).unionByName(twice), "minhash-classes")
    return (docs.select("doc_id").join(comp, F.col("doc_id") == F.col("node"), "left")
            .select("doc_id", F.coalesce("root", "doc_id").alias("class_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True))))
