"""Byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

A pre-token's symbols lie in a row. Leaf i of the tree holds the rank of the pair that begins
at symbol i, and i itself; every inner node holds the smaller of its children, so the root
is the leftmost pair of lowest rank. Merging it changes the leaves of at most three pairs, each
along one path to the root. A pre-token of n symbols costs n log n steps, however long it is.
"""
from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property
from struct import pack

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gleaner.llm.common import by_value, map_columns, share
from gleaner.llm.pretokens import byte_signs, cutter

by_value(__name__)

NONE = 1 << 62                # a pair that is not in the vocabulary
SHIFT = 24                    # room for a symbol in a pair's number
CACHE = 200_000               # encoded pre-tokens a task remembers; it starts anew beyond
LONGEST_KEY = 64              # longer pre-tokens are encoded but not remembered
LONGEST_TREE = 65             # bytes of a pre-token up to which trees lie side by side
TREES = 4_096                 # trees in one array
STEP_CHARS = 1 << 20          # characters cut at a time; a longer text is cut alone


@dataclass
class WordBPE:
    """A tokenizer file of byte-level BPE with word ends, as plain tables."""

    content: str                             # the file, for its normalizer and character classes
    first: list[int]                         # symbol of each byte inside a pre-token
    last: list[int]                          # and at its end
    pairs: dict[int, int]                    # rank of the merge of two symbols, left << SHIFT | right
    merged: list[int]                        # symbol that the merge of a rank makes
    tokens: dict[int, str]                   # by id, added tokens included
    added: dict[str, int]                    # strings that are taken from the raw text
    pattern: str

    @classmethod
    def of_file(cls, path: str) -> WordBPE:
        with open(path, encoding="utf-8") as f:
            return cls.of_content(f.read())

    @classmethod
    def of_content(cls, content: str) -> WordBPE:
        """ValueError if the file asks for anything that is not done here."""
        spec = json.loads(content)
        model, pre = spec["model"], spec["pre_tokenizer"]
        steps = pre.get("pretokenizers", [pre])
        known = (
            model["type"] == "BPE" and not model.get("dropout") and not model.get("unk_token")
            and not model.get("continuing_subword_prefix") and not model.get("byte_fallback")
            and not model.get("ignore_merges") and spec.get("post_processor") is None
            and spec.get("decoder") is None
            and [s["type"] for s in steps] == ["Split", "ByteLevel"]
            and steps[0]["behavior"] == "Removed" and steps[0]["invert"]
            and "Regex" in steps[0]["pattern"]
            and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
            and not any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]
                        for t in spec["added_tokens"]))
        if not known:
            raise ValueError("not a byte-level BPE file with word ends and a splitting pattern")
        vocab, end, signs = model["vocab"], model.get("end_of_word_suffix") or "", byte_signs()
        pairs, merged = {}, []
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pairs[vocab[left] << SHIFT | vocab[right]] = rank
            merged.append(vocab[left + right])
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        return cls(content, [vocab[s] for s in signs], [vocab[s + end] for s in signs], pairs, merged,
                   {i: t for t, i in vocab.items()} | {i: t for t, i in added.items()}, added,
                   steps[0]["pattern"]["Regex"])

    @cached_property
    def _parts(self) -> tuple[Callable, Callable, re.Pattern | None]:
        """Normalizer, cutter, and the pattern of added tokens. Not sent to the executors."""
        library = Tokenizer.from_str(self.content)

        def by_library(text: str) -> list[str]:
            return [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]

        longest = sorted(self.added, key=len, reverse=True)
        return (lambda text: text.lower() if text.isascii() else library.normalizer.normalize_str(text),
                cutter(self.pattern, by_library),
                re.compile(f"({'|'.join(map(re.escape, longest))})") if longest else None)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_parts", "_arrays")}

    def pretokens(self, text: str) -> list[str | int]:
        """The text's pre-tokens in order, and the ids of added tokens between them.

        White space only separates pre-tokens, so its normal form does not matter.
        """
        normal, cut, added = self._parts
        if added is None or not any(t in text for t in self.added):
            return cut(normal(text))
        out: list[str | int] = []
        for n, part in enumerate(added.split(text)):
            if n % 2:
                out.append(self.added[part])
            else:
                out.extend(cut(normal(part)))
        return out

    def merge(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        raw = word.encode()
        first, n = self.first, len(raw)
        sym = [first[b] for b in raw]
        sym[-1] = self.last[raw[-1]]
        if n == 1:
            return sym
        rank_of, merged, m = self.pairs.get, self.merged, n - 1
        tree = [NONE] * (2 * m)
        for i in range(m):
            rank = rank_of(sym[i] << SHIFT | sym[i + 1])
            if rank is not None:
                tree[m + i] = rank * n + i
        for i in range(m - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while tree[1] < NONE:
            rank, i = divmod(tree[1], n)
            gone = after[i]
            sym[i], sym[gone] = merged[rank], -1
            right = after[i] = after[gone]
            left = before[i]
            if right < n:
                before[right] = i
                rank = rank_of(sym[i] << SHIFT | sym[right])
                changed = [(gone, NONE), (i, NONE if rank is None else rank * n + i)]
            else:
                changed = [(gone, NONE), (i, NONE)] if gone < m else [(i, NONE)]
            if left >= 0:
                rank = rank_of(sym[left] << SHIFT | sym[i])
                changed.append((left, NONE if rank is None else rank * n + left))
            for leaf, low in changed:                    # up to the first node that stays as it is
                at = leaf + m
                while tree[at] != low:
                    tree[at] = low
                    if at == 1:
                        break
                    beside = tree[at ^ 1]
                    at >>= 1
                    if beside < low:
                        low = beside
        return [s for s in sym if s >= 0]

    @cached_property
    def _arrays(self):
        """The pairs in order with their ranks, the merged symbols, and the bytes' symbols."""
        keys = np.array(sorted(self.pairs), dtype=np.int64)
        return (keys, np.array([self.pairs[k] for k in keys.tolist()], dtype=np.int64),
                *(np.array(x, dtype=np.int64) for x in (self.merged, self.first, self.last)))

    def merge_many(self, words: list[str]) -> list[bytes]:
        """Ids of many pre-tokens as little-endian 32-bit integers.

        Short ones have their trees side by side in one array: in each round every tree's root
        is merged and its leaves' paths are renewed, level by level for all trees at once.
        """
        out: list[bytes] = [b""] * len(words)
        raw = [w.encode() for w in words]
        classes: dict[int, list[int]] = {}
        for n, word in enumerate(raw):
            if len(word) > LONGEST_TREE:
                out[n] = np.array(self.merge(words[n]), dtype="<u4").tobytes()
            else:
                classes.setdefault(max(1, (len(word) - 2).bit_length()), []).append(n)
        for depth, members in classes.items():
            for at in range(0, len(members), TREES):
                part = members[at:at + TREES]
                for n, ids in zip(part, self._merged_together([raw[n] for n in part], 1 << depth)):
                    out[n] = ids
        return out

    def _merged_together(self, raw: list[bytes], m: int) -> list[bytes]:
        """`raw` have at most m + 1 bytes; m, a power of two, is the number of leaves of a tree."""
        keys, ranks, merged, first, last = self._arrays
        size, width = np.array([len(r) for r in raw]), m + 2            # the last place is beyond the end
        row = np.repeat(np.arange(len(raw)), size)
        col = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        sym = np.full((len(raw), width), -1, dtype=np.int64)
        sym[row, col] = first[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        sym[np.arange(len(raw)), size - 1] = last[[r[-1] for r in raw]]
        after = np.tile(np.arange(1, width + 1), (len(raw), 1))
        before = np.tile(np.arange(-1, width - 1), (len(raw), 1))

        def leaf(left, right, place):
            wanted = np.where((left < 0) | (right < 0), -1, left << SHIFT | right)
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            return np.where(keys[at] == wanted, ranks[at] * width + place, NONE)

        tree = np.full((len(raw), 2 * m), NONE, dtype=np.int64)
        tree[:, m:] = leaf(sym[:, :m], sym[:, 1:m + 1], np.arange(m))
        level = m
        while level > 1:
            level >>= 1
            tree[:, level:2 * level] = np.minimum(tree[:, 2 * level:4 * level:2], tree[:, 2 * level + 1:4 * level:2])
        alive = np.flatnonzero(tree[:, 1] < NONE)
        while len(alive):
            rank, i = np.divmod(tree[alive, 1], width)
            gone = after[alive, i]
            right = np.minimum(after[alive, gone], width - 1)
            left = before[alive, i]
            sym[alive, i], sym[alive, gone] = merged[rank], -1
            after[alive, i], before[alive, right] = right, i
            own = leaf(sym[alive, i], sym[alive, right], i)
            none = gone >= m                                            # that place has no leaf
            tree[alive, m + np.where(none, i, gone)] = NONE
            tree[alive, m + i] = own
            outer = np.where(left < 0, i, left)
            tree[alive, m + outer] = np.where(left < 0, own, leaf(sym[alive, left], sym[alive, i], left))
            for changed in (np.where(none, i, gone), i, outer):
                at = m + changed
                for _ in range(m.bit_length() - 1):
                    at >>= 1
                    tree[alive, at] = np.minimum(tree[alive, 2 * at], tree[alive, 2 * at + 1])
            alive = alive[tree[alive, 1] < NONE]
        kept = sym >= 0
        ids, ends = sym[kept].astype("<u4").tobytes(), 4 * np.cumsum(kept.sum(axis=1))
        return [ids[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]

    def decode(self, ids: Sequence[int]) -> str:
        """Tokens joined by spaces, as the file names no decoder; unknown ids are left out."""
        try:
            return " ".join(map(self.tokens.__getitem__, ids))
        except KeyError:
            return " ".join(self.tokens[i] for i in ids if i in self.tokens)


def encoded(docs: DataFrame, tokenizer_path: str, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, n_tokens and `ids`, little-endian unsigned 32-bit integers, of every text.

    Whole texts, no begin or end tokens; strings of added tokens inside a text become those
    tokens, as in the library. Null and empty texts have no token. Repeated rows are encoded
    each; an empty table gives no row. Other columns are not read. One pass without a shuffle; a
    task holds one batch, the merge table and at most CACHE encoded pre-tokens.
    """
    bpe = share(docs.sparkSession, WordBPE.of_file(tokenizer_path))
    known: dict[str | int, bytes] = {}

    def encode(batch):
        model = bpe()
        rows: list[bytes] = []
        while len(rows) < len(batch["_text"]):
            texts, chars = [], 0
            for text in batch["_text"][len(rows):]:
                if texts and chars + len(text or "") > STEP_CHARS:
                    break
                texts.append(model.pretokens(text or ""))
                chars += len(text or "")
            new = list({w for words in texts for w in words if w not in known})
            fresh = [w for w in new if isinstance(w, str)]
            known.update(zip(fresh, model.merge_many(fresh)))
            known.update((i, pack("<I", i)) for i in new if isinstance(i, int))
            rows += [b"".join(map(known.__getitem__, words)) for words in texts]
            for word in fresh:
                if len(word) > LONGEST_KEY:
                    del known[word]
            if len(known) > CACHE:
                known.clear()
        return {**{c: batch[c] for c in keep}, "n_tokens": [len(r) // 4 for r in rows], "ids": rows}

    return map_columns(docs.select(*keep, docs["text"].alias("_text")),
                       "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
                       + "n_tokens bigint, ids binary", encode)


def decoded(rows: DataFrame, tokenizer_path: str) -> DataFrame:
    """Adds `decoded`, the library's decoding of `ids` with added tokens shown; null for null."""
    bpe = share(rows.sparkSession, WordBPE.of_file(tokenizer_path))
    columns = [c for c in rows.columns if c != "decoded"]

    def decode(batch):
        model = bpe()
        return {**batch, "decoded": [None if raw is None else model.decode(
            np.frombuffer(raw, dtype="<u4").tolist()) for raw in batch["ids"]]}

    return map_columns(rows.select(*columns), "".join(
        f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in columns) + "decoded string", decode)


def encoding_digest(rows: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text."""
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
