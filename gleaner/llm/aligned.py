"""Alignment of two tokenizations of the same bytes, and how often token pairs go together.

Both tokenizers spell the same bytes. For each batch of documents `pandas.merge_asof`, keyed by
document, finds the other side's token that covers a token's start, once in each direction;
the union holds every overlap. An overlap whose tokens end at the same byte closes a group.

Counts over the corpus need each document twice: first to tell which pairs of ids it links, then
to add up their counts. So documents are aligned once, into chunks of bounded size: a chunk has
a dictionary of its pairs and, by document, places in it. Dictionaries meet in one shuffle by
pair; their counts go back to the chunks and not to documents, which are many more rows.
"""
from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from tokenizers import Tokenizer

from gleaner.llm.common import by_value, share
from gleaner.llm.pretokens import BYTE_LEVEL, UNSETTLED, byte_signs
from gleaner.session import snapshot

by_value(__name__)

STEP_CHARS = 1 << 18         # characters aligned at a time; a longer text is aligned alone
CHUNK = 1_000_000            # (document, pair) entries of a chunk, about
LONG = 200_000               # characters from which the library's n log n encoder is used
_ROW_BITS = 33


@dataclass
class ByteLevel:
    """A byte-level tokenizer file. Strings of added tokens are ordinary text.

    If merges rank as their ids do, and each token's bytes merge to that token, then any two
    neighbours whose bytes form a token merge under the file's own rules too, and an encoder by
    ranks gives the same ids. Both are checked. It is many times faster than the file's library, which
    still encodes texts with signs on whose class versions of Unicode differ, and long ones.
    """

    content: str
    spell: list[bytes]           # bytes of each id

    @classmethod
    def of_file(cls, path: str) -> ByteLevel:
        with open(path, encoding="utf-8") as f:
            content = f.read()
        spec = json.loads(content)
        pre, vocab = spec["pre_tokenizer"], spec["model"]["vocab"]
        if (spec["normalizer"] or spec["post_processor"] or pre["type"] != "ByteLevel"
                or pre["add_prefix_space"] or not pre["use_regex"]):
            raise ValueError("not a plain byte-level file")
        byte = {sign: b for b, sign in enumerate(byte_signs())}
        spell = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            spell[i] = bytes(byte[c] for c in token)
        ranks = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        model = Tokenizer.from_str(content).model
        if ranks != sorted(set(ranks)) or any([t.id for t in model.tokenize(token)] != [i] for token, i in vocab.items()):
            raise ValueError("merges do not rank as their tokens do")
        return cls(content, spell)

    @cached_property
    def _parts(self):
        library = Tokenizer.from_str(self.content)
        library.encode_special_tokens = True
        return library, tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL, special_tokens={},
                                          mergeable_ranks={s: i for i, s in enumerate(self.spell) if s})

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_parts"}

    def encode(self, texts: list[str]) -> list[list[int] | None]:
        """Ids of each text, None where they spell other bytes."""
        library, by_rank = self._parts
        out = []
        for text in texts:
            if len(text) > LONG or UNSETTLED.search(text):
                ids = library.encode(text, add_special_tokens=False).ids
            else:
                ids = by_rank.encode_ordinary(text)
            out.append(ids if b"".join(map(self.spell.__getitem__, ids)) == text.encode() else None)
        return out


@dataclass
class Pieces:
    """A piece model with byte fallback that adds a space to the text."""

    proto: bytes
    spell: list[bytes]

    @classmethod
    def of_file(cls, path: str) -> Pieces:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        return cls(model.serialized_model_proto(), [
            bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(names)])

    @cached_property
    def _parts(self):
        return sentencepiece.SentencePieceProcessor(model_proto=self.proto)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_parts"}

    def encode(self, texts: list[str]) -> list[list[int] | None]:
        """Ids of each text, None where they spell other bytes than a space and the text."""
        return [ids if b"".join(map(self.spell.__getitem__, ids)) == b" " + text.encode() else None
                for ids, text in zip(self._parts.encode(texts, num_threads=1), texts)]


@dataclass
class Pair:
    """Both sides; what their tokens spell and how ids are written."""

    a: ByteLevel
    b: Pieces

    @cached_property
    def _parts(self):
        lengths = [np.array([len(s) for s in side.spell], dtype=np.int64) for side in (self.a, self.b)]
        written = [f"{i}{end}" for side, ends in ((self.a, ",|"), (self.b, ",;"))
                   for end in ends for i in range(len(side.spell))]
        return (*lengths, written)

    def __getstate__(self):
        return {"a": self.a, "b": self.b}

    def align(self, texts: list[str | None]) -> Aligned:
        """Documents whose tokens on either side spell other bytes than space + text have none."""
        own = [t for t in texts if t]
        both = zip((i for i, t in enumerate(texts) if t), self.a.encode([" " + t for t in own]), self.b.encode(own))
        kept = [x for x in both if x[1] is not None and x[2] is not None]
        return Aligned(self, [i for i, _, _ in kept], *([np.array(x[n], dtype=np.int32) for x in kept] for n in (1, 2)))


class Aligned:
    """Tokens of some documents, laid out one after the other, and their groups."""

    def __init__(self, pair: Pair, docs: list[int], a: list[np.ndarray], b: list[np.ndarray]):
        size_a, size_b, self._written = pair._parts
        self.width = len(size_b)
        self.docs = np.array(docs, dtype=np.int64)
        self.n_a, self.n_b = (np.array([len(x) for x in side], dtype=np.int64) for side in (a, b))
        self.a, self.b = (np.concatenate([np.zeros(0, np.int32), *side]).astype(np.int64) for side in (a, b))
        ends_a, ends_b = np.cumsum(size_a[self.a]), np.cumsum(size_b[self.b])
        left, right = (pd.DataFrame({"doc": np.repeat(np.arange(len(docs)), n), "start": ends - size,
                                     name: np.arange(len(ends))})
                       for name, n, ends, size in (("a", self.n_a, ends_a, size_a[self.a]),
                                                   ("b", self.n_b, ends_b, size_b[self.b])))
        covered = pd.merge_asof(left, right, on="start", by="doc")      # each start of A, its token of B
        covering = pd.merge_asof(right, left, on="start", by="doc")
        over_a = np.r_[covered["a"].to_numpy(), covering["a"].to_numpy()]
        over_b = np.r_[covered["b"].to_numpy(), covering["b"].to_numpy()]
        closing = ends_a[over_a] == ends_b[over_b]
        cut_a, cut_b = np.zeros(len(self.a), dtype=np.int64), np.zeros(len(self.b), dtype=np.int64)
        cut_a[over_a[closing]] = 1
        cut_b[over_b[closing]] = 1
        self.cut_a, self.cut_b = cut_a, cut_b
        self.group_a, self.group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        groups = int(cut_a.sum())
        self.in_a, self.in_b = (np.bincount(g, minlength=groups) for g in (self.group_a, self.group_b))
        self.doc_of = left["doc"].to_numpy()[cut_a > 0]                  # of each group
        count = np.bincount(self.doc_of, minlength=len(docs))
        self.n_groups = count
        before = np.r_[0, np.cumsum(self.in_a * self.in_b)]
        self.n_links = np.diff(before[np.r_[0, np.cumsum(count)]])

    def written(self) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` of each document."""
        half = len(self._written) // 2 - self.width                      # ids of A
        codes = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        codes[np.arange(len(self.a)) + np.r_[0, np.cumsum(self.in_b)][self.group_a]] = self.a + half * self.cut_a
        codes[np.arange(len(self.b)) + np.cumsum(self.in_a)[self.group_b]] = (
            2 * half + self.b + self.width * self.cut_b)
        at = np.r_[0, np.cumsum(self.n_a + self.n_b)]
        text = self._written.__getitem__
        return ["".join(map(text, codes[lo:hi].tolist()))[:-1] for lo, hi in zip(at, at[1:])]

    def entries(self, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(document, pair, times) without repeats: pair is A id * width + B id, times the number
        of its links. Ids are multiplied within a group once each, with their counts, and
        about `most` products at a time; all those of a document and A id are in one part.
        """
        keys_a, times_a = np.unique(self.group_a * (1 << 32) + self.a, return_counts=True)
        keys_b, times_b = np.unique(self.group_b * (1 << 32) + self.b, return_counts=True)
        group, id_a, id_b = keys_a >> 32, keys_a & 0xffffffff, keys_b & 0xffffffff
        per_group = np.bincount(keys_b >> 32, minlength=len(self.in_b))
        first = np.cumsum(per_group) - per_group
        doc = self.doc_of[group]
        order = np.lexsort((id_a, doc))
        group, id_a, times_a, doc = group[order], id_a[order], times_a[order], doc[order]
        size = per_group[group]
        starts = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (id_a[1:] != id_a[:-1])][:len(doc)])
        before = (np.cumsum(size) - size)[starts]
        at = 0
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(before, before[at] + most)))
            part = slice(starts[at], starts[to] if to < len(starts) else len(doc))
            n = size[part]
            row = np.repeat(np.arange(part.start, part.stop), n)
            other = first[group[row]] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            key = (doc[row] * len(self._written) + id_a[row]) * self.width + id_b[other]
            key, back = np.unique(key, return_inverse=True)
            times = np.zeros(len(key), dtype=np.int64)
            np.add.at(times, back, times_a[row] * times_b[other])
            head, right = np.divmod(key, self.width)
            d, left = np.divmod(head, len(self._written))
            yield d, left * self.width + right, times
            at = to


def _numbers(values, kind) -> bytes:
    return np.ascontiguousarray(values, dtype=kind).tobytes()


def _chunk(number: int, entries: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> dict:
    row, pair, times = (np.concatenate(x) for x in zip(*entries))
    pairs, place = np.unique(pair, return_inverse=True)
    return {"chunk": number, "pairs": pairs, "held": np.bincount(place, minlength=len(pairs)),
            "rows": _numbers(row, "<i8"), "places": _numbers(place, "<i4"), "times": _numbers(times, "<i8")}


def _aligned(docs: DataFrame, pair, with_groups: bool) -> DataFrame:
    """Two kinds of rows: documents (row is set) and chunks (chunk is set)."""
    schema = T.StructType.fromDDL(
        f"row bigint, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_a bigint, n_b bigint,"
        " n_groups bigint, n_links bigint, groups string, groups_sha256 string, chunk bigint,"
        " pairs array<bigint>, held array<bigint>, rows binary, places binary, times binary")
    arrow = to_arrow_schema(schema)

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r.get(n) for r in rows], type=arrow.field(n).type) for n in schema.names], schema=arrow)

    def steps(batches):
        """Rows of (doc_id, text), few enough to align at once."""
        ids, texts, chars = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if chars and chars + len(text or "") > STEP_CHARS:
                    yield ids, texts
                    ids, texts, chars = [], [], 0
                ids.append(doc_id)
                texts.append(text)
                chars += len(text or "")
        if ids:
            yield ids, texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = pair()
        base = TaskContext.get().partitionId() << _ROW_BITS
        seen, chunks, waiting, n = 0, 0, [], 0
        for ids, texts in steps(batches):
            made = sides.align(texts)
            rows = [{"row": base + seen + i, "doc_id": d, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0,
                     "groups_sha256": "", "groups": "" if with_groups else None} for i, d in enumerate(ids)]
            for i, a, b, g, links, text in zip(made.docs.tolist(), made.n_a.tolist(), made.n_b.tolist(),
                                               made.n_groups.tolist(), made.n_links.tolist(), made.written()):
                rows[i] |= {"n_a": a, "n_b": b, "n_groups": g, "n_links": links,
                            "groups_sha256": hashlib.sha256(text.encode()).hexdigest()}
                if with_groups:
                    rows[i]["groups"] = text
            yield batch_of(rows)
            for doc, key, times in made.entries(CHUNK):
                waiting.append((base + seen + made.docs[doc], key, times))
                n += len(key)
                if n >= CHUNK:
                    yield batch_of([_chunk(base + chunks, waiting)])
                    chunks, waiting, n = chunks + 1, [], 0
            seen += len(ids)
        if n:
            yield batch_of([_chunk(base + chunks, waiting)])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def alignments(docs: DataFrame, a_path: str, b_path: str, with_groups: bool = False) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A, a byte-level tokenizer file, encodes space + text; B, a piece model, encodes the text, to
    which it adds a space itself. Byte offsets where tokens of both end cut them into groups;
    links are all pairs of token occurrences of a group. A pair's count is the number of
    documents of the whole table that hold it linked. `count_sum` adds the counts over a
    document's links; `n_best` counts the links whose count is the highest of their A id, ties
    included. Groups are written `a1,a2|b1;a3|b2,b3`; `with_groups` adds that text as `groups`.

    Null and empty texts, and texts that either side spells otherwise, have no tokens: zeros,
    and '' for the digest. Repeated rows, also without doc_id, are documents of their own. An
    empty table gives no row. Other columns are not read.

    Links are counted, not written out: a group's ids are multiplied once each. A task holds
    about STEP_CHARS characters, or one longer text, and a chunk of CHUNK entries.
    """
    spark = docs.sparkSession
    sides = Pair(ByteLevel.of_file(a_path), Pieces.of_file(b_path))
    width = len(sides.b.spell)
    laid = snapshot(_aligned(docs, share(spark, sides), with_groups), "alignment")
    chunks = laid.filter("chunk IS NOT NULL")
    entries = chunks.select("chunk", F.posexplode(F.arrays_zip("pairs", "held")).alias("place", "e")).select(
        "chunk", "place", F.col("e.pairs").alias("pair"), F.col("e.held").alias("held"))
    counts = snapshot(entries.groupBy("pair").agg(F.sum("held").alias("docs")), "alignment-pairs")
    left = F.floor(F.col("pair") / width)
    highest = counts.groupBy(left.alias("_a")).agg(F.max("docs").alias("_most"))     # a row per A id
    known = counts.join(highest, left == F.col("_a")).select(
        "pair", "docs", (F.col("docs") == F.col("_most")).alias("best"))
    answered = entries.select("chunk", "place", "pair").join(known, "pair").select(
        F.col("chunk").alias("of"), "place", "docs", "best")
    sums = pa.schema([("row", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64())])

    def add(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        place = answers["place"].to_numpy()
        docs_of, best_of = np.zeros(len(place), dtype=np.int64), np.zeros(len(place), dtype=np.int64)
        docs_of[place] = answers["docs"].to_numpy()
        best_of[place] = answers["best"].to_numpy(zero_copy_only=False)
        row, at, times = (np.frombuffer(chunk[c][0].as_py(), dtype=kind) for c, kind in
                          (("rows", "<i8"), ("places", "<i4"), ("times", "<i8")))
        edge = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        return pa.table([pa.array(row[edge]), pa.array(np.add.reduceat(times * best_of[at], edge)),
                         pa.array(np.add.reduceat(times * docs_of[at], edge))], schema=sums)

    added = (chunks.select("chunk", "rows", "places", "times").groupBy("chunk")
             .cogroup(answered.groupBy("of"))
             .applyInArrow(add, "row bigint, n_best bigint, count_sum bigint")
             .groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")))
    zero = F.lit(0).cast("bigint")
    return (laid.filter("row IS NOT NULL").join(added, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256", *(["groups"] if with_groups else [])))
