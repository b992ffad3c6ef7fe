"""Benchmark decontamination with a positional inverted index of the training text.

The index is distributed by documents: each row holds the posting lists of one document,
term by term with ascending positions, for the terms of the test set. A phrase is sought
from its rarest term over the whole corpus: that term's list, less its offset in the phrase,
is intersected with the offset-adjusted lists of the next rarest terms until it is empty or
all terms agree. For proximity a phrase is entered under as many of its rarest terms as can be
missing, and one more, so every window that is near enough holds one of them.
"""
from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass
from functools import cached_property
from math import ceil

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import by_value, map_columns, share
from gleaner.session import snapshot

by_value(__name__)

# A-Z become a-z, other ASCII characters that are no letter or digit become a space; bytes
# of other characters stay, as all of those are word characters
_ASCII = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32
               for c in range(256))
TERMS_A_BLOCK = 400_000       # bound of what is sent to every task: test terms in one block
STEP = 100_000                # places of phrases in a document that are compared at a time


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_ASCII).split()


def phrases(items: DataFrame, size: int = 10) -> DataFrame:
    """Distinct windows of `size` consecutive item words, with the items that hold them.

    An item of fewer words, but not none, is one window. Null and empty items give none.
    """
    def cut(batch):
        out = {"item_id": [], "phrase": []}
        for item, text in zip(batch["item_id"], batch["text"]):
            words = words_of(text)
            for at in range(max(len(words) - size + 1, 1 if words else 0)):
                out["item_id"].append(str(item))
                out["phrase"].append(b" ".join(words[at:at + size]))
        return out

    return (map_columns(items.filter("item_id is not null").select("item_id", "text"),
                        "item_id string, phrase binary", cut)
            .groupBy("phrase").agg(F.sort_array(F.collect_set("item_id")).alias("items")))


def term_counts(docs: DataFrame, terms: dict[bytes, int]) -> list[int]:
    """Occurrences of each term in all documents."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batch):
        known, found = sent.value, Counter()
        for text in batch["text"]:
            found.update([known[w] for w in words_of(text) if w in known])
        return {"term": list(found), "n": list(found.values())}

    counts = [0] * len(terms)
    for row in (map_columns(docs.select("text"), "term int, n bigint", count)
                .groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator()):
        counts[row["term"]] = row["n"]
    return counts


def index(docs: DataFrame, terms: dict[bytes, int], anchors: set[int], reach: int) -> DataFrame:
    """doc_id, digest of the text, n_words, and the document's posting lists: its terms, the length
    of each one's list, and the lists one after the other, as 32-bit integers.

    Positions further than `reach` from every anchor term cannot belong to a match and are
    not stored.
    """
    sent = docs.sparkSession.sparkContext.broadcast((terms, np.array(sorted(anchors), dtype=np.int64)))

    def post(batch):
        known, rare = sent.value
        is_rare = np.zeros(len(known) + 1, dtype=bool)
        is_rare[rare] = True
        out = {"doc_id": batch["doc_id"], "digest": batch["digest"], "n_words": [], "terms": [], "counts": [],
               "positions": []}
        for text in batch["text"]:
            words = words_of(text)
            n = len(words)
            number = np.fromiter((known.get(w, -1) for w in words), np.int32, n)
            hot = np.flatnonzero(is_rare[number])
            open_ = np.bincount(np.maximum(hot - reach, 0), minlength=n + 1)
            shut = np.bincount(np.minimum(hot + reach + 1, n), minlength=n + 1)
            at = np.flatnonzero((np.cumsum(open_ - shut)[:n] > 0) & (number >= 0))
            at = at[np.argsort(number[at], kind="stable")]
            held, counts = np.unique(number[at], return_counts=True)
            out["n_words"].append(n)
            for name, values in (("terms", held), ("counts", counts), ("positions", at)):
                out[name].append(values.astype("<i4").tobytes())
        return out

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_columns(docs.select("doc_id", "text", F.xxhash64("text").alias("digest")),
                       f"doc_id {kind}, digest bigint, n_words bigint, terms binary, counts binary, positions binary",
                       post)


class Phrase:
    """Terms with their offsets, rarest first, and the items it stands for.

    `spare` of the terms may be missing in a near match, so it holds one of the `leads`, the
    spare + 1 rarest, at its place.
    """

    def __init__(self, terms: list[int], counts: list[int], items: list[str], near_share: float):
        self.order = sorted(((t, at) for at, t in enumerate(terms)), key=lambda x: (counts[x[0]], *x))
        self.size, self.items = len(terms), items
        self.spare = self.size - max(1, ceil(near_share * self.size))
        self.leads = self.order[:self.spare + 1]

    def near(self, lists: dict[int, list[int]], slack: int) -> bool:
        """Whether from some start all but `spare` terms lie within `slack` words of their place."""
        spare = self.spare
        held = [(lists[term], off) for term, off in self.order if term in lists]

        def fits(start: int, slack: int) -> bool:
            missing = self.size - len(held)
            for own, off in held:
                i = bisect_left(own, start + off - slack)
                if i == len(own) or own[i] > start + off + slack:
                    missing += 1
                    if missing > spare:
                        return False
            return missing <= spare

        # at most `spare` terms miss their place, so one of the first spare + 1 held ones does not;
        # starts that it allows differ by `slack` from its own, which are tried with twice the slack
        seen = set()
        for own, off in held[:spare + 1]:
            for p in own:
                if fits(p - off, 2 * slack):
                    for start in range(p - off - slack, p - off + slack + 1):
                        if start not in seen:
                            seen.add(start)
                            if fits(start, slack):
                                return True
        return False


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its length says, one run after the other."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


@dataclass
class Matcher:
    """The phrases of a block, entered under each of their leads."""

    phrases: list[Phrase]
    n_terms: int
    size: int
    slack: int

    @cached_property
    def _tables(self):
        """Terms of each phrase by place (n_terms where it has ended), how many a near match
        needs, and for each term the phrases that it leads with its places in them."""
        laid = np.full((len(self.phrases), self.size), self.n_terms, dtype=np.int32)
        need = np.zeros(len(self.phrases), dtype=np.int64)
        leads = []
        for n, p in enumerate(self.phrases):
            for term, at in p.order:
                laid[n, at] = term
            need[n] = p.size - p.spare
            leads.extend((term, n, at) for term, at in p.leads)
        term, phrase, place = np.array(sorted(leads), dtype=np.int64).reshape(-1, 3).T
        return laid, need, np.searchsorted(term, np.arange(self.n_terms + 1)), phrase, place

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_tables"}

    def find(self, n_words: int, terms: np.ndarray, counts: np.ndarray,
             positions: np.ndarray) -> tuple[set[tuple[int, int]], set[str], set[str]]:
        """Spans, items and near items of one document.

        Phrases of which the document lacks too many terms go first. The lists of the others'
        leads, less their offsets, give the starts to look at; there the document's terms are
        compared with the phrase, place by place for exact matches, and with twice the slack
        for near ones, of which few are left to be tried in full.
        """
        laid, need, first, by_lead, place = self._tables
        spans, exact, near = set(), set(), set()
        begin = first[terms]
        entry = _ragged(begin, first[terms + 1] - begin)
        if not len(entry):
            return spans, exact, near
        own = np.repeat(np.arange(len(terms)), first[terms + 1] - begin)      # the document's term of an entry
        has = np.zeros(self.n_terms + 1, dtype=bool)
        has[terms] = True
        asked = np.zeros(len(laid), dtype=bool)
        asked[by_lead[entry]] = True
        asked = np.flatnonzero(asked)
        able = np.zeros(len(laid), dtype=bool)
        able[asked[has[laid[asked]].sum(axis=1) >= need[asked]]] = True
        alive = able[by_lead[entry]]
        entry, own = entry[alive], own[alive]
        if not len(entry):
            return spans, exact, near
        margin = self.size + 2 * self.slack
        text = np.full(n_words + 2 * margin, -1, dtype=np.int32)
        text[positions + margin] = np.repeat(terms, counts)
        list_start = np.cumsum(counts) - counts
        before = np.cumsum(counts[own]) - counts[own]
        places, maybe, hits = np.arange(self.size), set(), set()
        for part in np.split(np.arange(len(entry)), np.flatnonzero(np.diff(before // STEP)) + 1):
            length = counts[own[part]]
            phrase = np.repeat(by_lead[entry[part]], length)
            start = positions[_ragged(list_start[own[part]], length)] - np.repeat(place[entry[part]], length)
            wanted = laid[phrase]
            ended = wanted == self.n_terms
            at = (start + margin)[:, None] + places
            here = text[at] == wanted
            whole = (here | ended).all(axis=1)
            for p, s in zip(phrase[whole].tolist(), start[whole].tolist()):
                hits.add(p)
                spans.add((s, s + self.phrases[p].size))
            if self.slack or (need < (laid != self.n_terms).sum(axis=1)).any():
                rest = ~whole
                phrase, at, wanted, here = phrase[rest], at[rest], wanted[rest], here[rest]
                for d in range(1, 2 * self.slack + 1):
                    here |= (text[np.maximum(at - d, 0)] == wanted) | (text[np.minimum(at + d, len(text) - 1)] == wanted)
                maybe.update(phrase[here.sum(axis=1) >= need[phrase]].tolist())
        for p in hits:
            exact.update(self.phrases[p].items)
        if maybe - hits:
            lists = dict(zip(terms.tolist(), (x.tolist() for x in np.split(positions, np.cumsum(counts)[:-1]))))
            for p in maybe - hits:
                if not exact.issuperset(self.phrases[p].items) and self.phrases[p].near(lists, self.slack):
                    near.update(self.phrases[p].items)
        return spans, exact, near


def contamination(docs: DataFrame, items: DataFrame, size: int = 10, slack: int = 3,
                  near_share: float = 0.8, terms_a_block: int = TERMS_A_BLOCK) -> DataFrame:
    """doc_id, digest, n_words, spans, items, near_items of every document.

    Exact: `items` are those with a window (see `phrases`) that occurs in the document, `spans`
    the merged [start, end) word intervals of all occurrences. `digest` is xxhash64 of the text.
    Proximity: `near_items` are further items with a window of which, from some start in the
    document, `near_share` of the words occur within `slack` words of their place. Any words
    may be the missing ones.

    Null and empty texts have no words and no hits. Repeated rows appear as often as they
    are given. Without items, or without documents, nothing is hit. Other columns are not read.
    The test set goes to the tasks in blocks of `terms_a_block` words or so; each block costs
    two passes over the texts. Only terms, counts and phrases of one block are in the driver.
    """
    tests = snapshot(phrases(items, size), "test-phrases")
    total = tests.agg(F.sum(F.length("phrase") - F.length(F.regexp_replace(
        F.col("phrase").cast("string"), " ", "")) + 1)).first()[0] or 0
    blocks = max(1, -(-total // terms_a_block))
    found = None
    for block in range(blocks):
        part = tests.filter(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == block)
        held = [(bytes(r["phrase"]).split(b" "), list(r["items"]))
                for r in part.orderBy("phrase").toLocalIterator()]
        terms = {w: n for n, w in enumerate(dict.fromkeys(w for ws, _ in held for w in ws))}
        counts = term_counts(docs, terms) if terms else []
        held = [Phrase([terms[w] for w in words], counts, names, near_share) for words, names in held]
        anchors = {term for p in held for term, _ in p.leads}
        stored = snapshot(index(docs, terms, anchors, size - 1 + 2 * slack), "test-index")
        sent = share(docs.sparkSession, Matcher(held, len(terms), size, slack))

        def match(batch):
            matcher = sent()
            out = {**{c: batch[c] for c in ("doc_id", "digest", "n_words")},
                   "spans": [], "items": [], "near_items": []}
            for n, *lists in zip(batch["n_words"], batch["terms"], batch["counts"], batch["positions"]):
                spans, exact, near = matcher.find(n, *(np.frombuffer(x, "<i4").astype(np.int64) for x in lists))
                out["spans"].append(merged(spans))
                out["items"].append(sorted(exact))
                out["near_items"].append(sorted(near - exact))
            return out

        kind = docs.schema["doc_id"].dataType.simpleString()
        here = map_columns(stored, f"doc_id {kind}, digest bigint, n_words bigint,"
                           " spans array<array<int>>, items array<string>, near_items array<string>",
                           match).withColumn("block", F.lit(block))
        found = here if found is None else found.unionByName(here)
    return found if blocks == 1 else _combined(found)


def _combined(found: DataFrame) -> DataFrame:
    """One row for each document from the rows of all blocks; repeated documents stay repeated."""
    flat = lambda c: F.flatten(F.collect_list(c))
    one = found.groupBy("doc_id", "digest", "n_words").agg(
        F.count_if(F.col("block") == 0).alias("copies"), flat("spans").alias("spans"),
        F.array_distinct(flat("items")).alias("items"),
        F.array_distinct(flat("near_items")).alias("near"))

    def unite(batch):
        return {**batch, "spans": [merged({tuple(s) for s in spans}) for spans in batch["spans"]]}

    kind = found.schema["doc_id"].dataType.simpleString()
    return (map_columns(one, f"doc_id {kind}, digest bigint, n_words bigint, copies bigint,"
                        " spans array<array<int>>, items array<string>, near array<string>", unite)
            .select("doc_id", "digest", "n_words", "spans", F.sort_array("items").alias("items"),
                    F.sort_array(F.array_except("near", "items")).alias("near_items"),
                    F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("block")))


def merged(spans: set[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def hit_words() -> Column:
    return F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s[1] - s[0])
