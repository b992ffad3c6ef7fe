"""Token counts by rank-synchronous merging over ragged arrays.

A text is cut into pre-tokens that no vocabulary piece crosses. All pre-tokens of a batch
that have not been counted before lie in one flat array of symbol numbers, with a sequence
number beside each symbol. In every round each sequence finds its pair of lowest rank, all
sequences apply theirs at the same time, and the symbols that survive are counted.
"""
from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import by_value, map_columns, share

by_value(__name__)

SPACE = "▁"
NONE = np.iinfo(np.int64).max
CACHE = 200_000           # counted pre-tokens a task remembers; it starts anew beyond
SHARE = 8_192             # pre-tokens in one flat array
LONGEST_KEY = 64          # longer pre-tokens are counted but not remembered


@dataclass
class MergeTable:
    """Pairs of symbols that merge. Size: about ten numbers for each vocabulary piece."""

    number: dict[str, int]       # single characters that occur in pieces
    keys: np.ndarray             # left * width + right, sorted
    merged: np.ndarray           # symbol the pair becomes
    rank: np.ndarray             # smaller goes first
    cost: np.ndarray             # tokens of a symbol that survives
    width: int
    alone: str                   # white space that no longer piece contains

    @classmethod
    def of_pieces(cls, path: str) -> MergeTable:
        """From a piece model with byte fallback whose text is only prefixed by a space."""
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        order = {}
        for i in range(model.get_piece_size()):
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)
                    or model.is_unused(i)):
                order[model.id_to_piece(i)] = -model.get_score(i)
        if any(SPACE in piece.lstrip(SPACE) for piece in order):
            raise ValueError("a piece crosses the start of a word")
        # equal scores are taken from the left, so they share a rank
        ranks = {s: n for n, s in enumerate(sorted(set(order.values())))}
        symbols = {piece: n for n, piece in enumerate(order)}
        for piece in order:
            for char in piece:
                symbols.setdefault(char, len(symbols))
        width = len(symbols) + 1                         # the last one: any other character
        pairs = [(symbols[p[:k]] * width + symbols[p[k:]], symbols[p], ranks[s])
                 for p, s in order.items() for k in range(1, len(p))
                 if p[:k] in symbols and p[k:] in symbols]
        keys, merged, rank = (np.array(x, dtype=np.int64) for x in zip(*sorted(pairs)))
        cost = np.ones(width, dtype=np.int64)
        for text, n in symbols.items():
            if text not in order:
                cost[n] = len(text.encode())
        joined = {c for p in order if len(p) > 1 for c in p}
        return cls({s: n for s, n in symbols.items() if len(s) == 1}, keys, merged, rank, cost,
                   width, "".join(c for c in "\t\n\r" if c not in joined))

    def pretokens(self, text: str) -> list[str]:
        cut = f" *[^ {self.alone}]+| +" + (f"|[{self.alone}]" if self.alone else "")
        return re.findall(cut, " " + text.replace(SPACE, " ")) if text else []

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair in `keys`, or -1."""
        wanted = left * self.width + right
        place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[place] == wanted, place, -1)

    def count(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token. A few thousand at a time stay in the processor's cache."""
        return np.concatenate([np.zeros(0, dtype=np.int64)] + [
            self._count(words[i:i + SHARE]) for i in range(0, len(words), SHARE)])

    def _count(self, words: list[str]) -> np.ndarray:
        totals = np.zeros(len(words), dtype=np.int64)
        other = self.width - 1
        chars = "".join(words).replace(" ", SPACE)
        sym = np.fromiter((self.number.get(c, other) for c in chars), np.int64, len(chars))
        seq = np.repeat(np.arange(len(words)), [len(w) for w in words])
        for at in np.flatnonzero(sym == other):          # spelled out in bytes
            totals[seq[at]] += len(chars[at].encode()) - 1
        place, rank = self._pairs(np.arange(len(sym)), sym, seq)
        while len(sym):
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            lowest = np.minimum.reduceat(rank, starts)
            low = np.repeat(lowest, np.diff(np.r_[starts, len(sym)]))
            if (lowest == NONE).any():                   # these sequences have ended
                done = low == NONE
                np.add.at(totals, seq[done], self.cost[sym[done]])
                sym, seq, place, rank, low = (x[~done] for x in (sym, seq, place, rank, low))
                if not len(sym):
                    break
            first = self._chosen(np.flatnonzero(rank == low), sym, seq, place, low)
            sym[first] = self.merged[place[first]]
            keep = np.ones(len(sym), dtype=bool)
            keep[first + 1] = False
            changed = (np.cumsum(keep) - 1)[first]       # where the merged symbols are now
            sym, seq, place, rank = sym[keep], seq[keep], place[keep], rank[keep]
            near = np.r_[changed, changed[changed > 0] - 1]
            place[near], rank[near] = self._pairs(near, sym, seq)
        return totals

    def _pairs(self, at, sym, seq) -> tuple[np.ndarray, np.ndarray]:
        """Place and rank of the pairs that begin at the given positions."""
        place = np.full(len(at), -1, dtype=np.int64)
        after = np.minimum(at + 1, len(sym) - 1)
        inner = np.flatnonzero((after > at) & (seq[at] == seq[after]))
        place[inner] = self._look_up(sym[at[inner]], sym[after[inner]])
        return place, np.where(place >= 0, self.rank[place], NONE)

    def _chosen(self, at, sym, seq, place, low) -> np.ndarray:
        """Pairs to merge now: from the left, without overlaps, in each sequence up to the
        first merge that makes a pair of lower rank than its own, as that one goes next."""
        run = np.r_[True, np.diff(at) != 1]              # overlapping pairs: every other one
        begun = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - begun) % 2 == 0]
        new = self.merged[place[at]]
        end = len(sym) - 1
        before, after = np.maximum(at - 1, 0), np.minimum(at + 2, end)
        left = sym[before].copy()
        beside = np.r_[False, (np.diff(at) == 2) & (seq[at[1:]] == seq[at[:-1]])]
        left[beside] = new[:-1][beside[1:]]
        urgent = np.zeros(len(at), dtype=bool)
        for found, real in ((self._look_up(left, new), (at > 0) & (seq[before] == seq[at])),
                            (self._look_up(new, sym[after]), (at + 2 <= end) & (seq[after] == seq[at]))):
            urgent |= real & (found >= 0) & (self.rank[found] < low[at])
        if not urgent.any():
            return at
        own = seq[at]
        group = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        earlier = np.cumsum(urgent) - urgent             # urgent ones before this one ...
        return at[earlier == np.repeat(earlier[group], np.diff(np.r_[group, len(at)]))]


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > `limit`) of every document.

    Whole texts, no begin or end tokens; a null or empty text has no token. Repeated rows are
    counted each. Other columns are not read. Work is one pass without a shuffle; a task
    holds one batch, the merge table and at most CACHE counted pre-tokens.
    """
    merges = share(docs.sparkSession, MergeTable.of_pieces(model_path))
    known: dict[str, int] = {}

    def count(batch):
        merge = merges()
        texts = [t or "" for t in batch["text"]]
        words = [merge.pretokens(t) for t in texts]
        if len(known) > CACHE:
            known.clear()
        new = list({w for ws in words for w in ws if w not in known})
        fresh = dict(zip(new, merge.count(new).tolist()))
        totals = [sum(known[w] if w in known else fresh[w] for w in ws) for ws in words]
        known.update((w, n) for w, n in fresh.items() if len(w) <= LONGEST_KEY)
        return {"doc_id": batch["doc_id"], "n_bytes": [len(t.encode()) for t in texts],
                "n_tokens": totals, "over_limit": [n > limit for n in totals]}

    return map_columns(docs.select(F.col("doc_id"), F.col("text")),
                       f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes bigint,"
                       " n_tokens bigint, over_limit boolean", count)
