"""Alternating least squares for implicit feedback, in blocks whose memory does not grow with the data.

A side's ids are dealt to blocks of about BLOCK_ROWS ratings. A block holds its ratings packed as numbers, and
the list of the other side's blocks that need each of its vectors. One half of an iteration sends the packed
vectors to the blocks that need them, solves every block's normal equations there, and writes the new
vectors down; the shuffle and the vectors before are removed then. A task holds one block's ratings and the
vectors they name, at most one for each rating.
"""
from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gleaner.session import discard, passing, snapshot

# functions sent to the workers travel with the plan; the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_ROWS = 1 << 20         # ratings of a block
LEAST_ROWS, TASKS = 1 << 14, 32   # small tables are cut into up to TASKS blocks of LEAST_ROWS
GATHERED = 1 << 13           # vectors multiplied at once
_SENT = 16 << 20             # bytes of a batch of messages

# one shape for a block's ratings (kind 0) and the vectors it is sent (kind 1)
_SHAPE = ("block int, kind int, source int, ids binary, counts binary, named binary, places binary, weights binary, "
          "targets binary, route binary, matrix binary, gram binary")
_STATE = "block int, ids binary, targets binary, route binary, matrix binary, gram binary"
_SENDING = "block int, kind int, source int, ids binary, matrix binary, gram binary"


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(ddl))


def _rows(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows, one at a time; a row is a whole block or message."""
    for batch in batches:
        for n in range(batch.num_rows):
            yield {name: batch.column(i)[n].as_py() for i, name in enumerate(batch.schema.names)}


def block_count(n: int) -> int:
    return max(-(-n // BLOCK_ROWS), min(TASKS, -(-n // LEAST_ROWS)), 1)


def _block(name: str, blocks: int):
    return F.pmod(F.xxhash64(F.col(name).cast("int")), F.lit(blocks)).cast("int")


def packed(ratings: DataFrame, own: str, other: str, blocks: int) -> DataFrame:
    """A row per block of `own`: its ids with their numbers of ratings, the ids of `other` they name, and by
    block of `other` the places of the ids that it needs. `ratings` has one row per pair, with `r` above 0."""
    arrow = _arrow(_SHAPE)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)] for batch in batches if batch.num_rows]
        if not parts:
            return
        block, ids, names, to, weights = (np.concatenate(c) for c in zip(*parts))
        del parts
        own_ids, own_at, counts = np.unique(ids, return_inverse=True, return_counts=True)
        named, places = np.unique(names, return_inverse=True)
        pairs = np.unique(to.astype(np.int64) * len(own_ids) + own_at)      # by target, then place
        yield _rows(arrow, [{
            "block": int(block[0]), "kind": 0, "source": -1, "ids": own_ids.astype(np.int32).tobytes(),
            "counts": counts.astype(np.int32).tobytes(), "named": named.astype(np.int32).tobytes(),
            "places": places.astype(np.int32).tobytes(),
            "weights": b"" if (weights == 1).all() else weights.astype(np.float32).tobytes(),
            "targets": np.bincount(pairs // len(own_ids), minlength=blocks).astype(np.int32).tobytes(),
            "route": (pairs % len(own_ids)).astype(np.int32).tobytes()}])

    dealt = ratings.select(_block(own, blocks).alias("block"), F.col(own).cast("int").alias("own"),
                           F.col(other).cast("int").alias("other"), _block(other, blocks).alias("to"),
                           F.col("r").cast("float").alias("r"))
    return snapshot(dealt.repartitionById(blocks, F.col("block")).sortWithinPartitions("own", "other")
                    .mapInArrow(pack, _SHAPE), "als-blocks")


def _vectors(vectors: DataFrame, blocks: int, factors: int) -> DataFrame:
    """Rows of id and features as messages to the blocks that own the ids."""
    arrow = _arrow(_SENDING)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, batch in enumerate(batches):
            block, ids = (batch.column(i).to_numpy() for i in range(2))
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, factors).astype(np.float32)
            yield _rows(arrow, [{"block": int(b), "kind": 1, "source": n, "ids": ids[block == b].astype(np.int32).tobytes(),
                                 "matrix": x[block == b].tobytes()} for b in np.unique(block)])

    return vectors.select(_block("id", blocks).alias("block"), "id", "features").mapInArrow(pack, _SENDING)


def _messages(state: DataFrame, factors: int) -> DataFrame:
    """What a side's blocks send: to each block of the other side the vectors it names, and the sum of all
    vectors' squares, block by block."""
    arrow = _arrow(_SENDING)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _records(batches):
            ids = np.frombuffer(row["ids"], np.int32)
            x = np.frombuffer(row["matrix"], np.float32).reshape(-1, factors)
            route, ends = np.frombuffer(row["route"], np.int32), np.cumsum(np.frombuffer(row["targets"], np.int32))
            out, size = [], 0
            for to, (start, end) in enumerate(zip(np.r_[0, ends[:-1]], ends)):
                at = route[start:end]
                out.append({"block": to, "kind": 1, "source": row["block"], "ids": ids[at].tobytes(),
                            "matrix": x[at].tobytes(), "gram": row["gram"]})
                size += len(at) * 4 * (factors + 1) + len(row["gram"])
                if size > _SENT:
                    yield _rows(arrow, out)
                    out, size = [], 0
            if out:
                yield _rows(arrow, out)

    return state.mapInArrow(send, _SENDING)


def _met(held: DataFrame, sent: DataFrame, blocks: int, step, label: str) -> DataFrame:
    """`step` over every block's ratings, followed by what it is sent, in order of the sender."""
    arrow = _arrow(_STATE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _records(batches)
        own = next(rows, None)
        if own is None or own["kind"]:          # a block without ratings, which owns nothing
            for _ in rows:
                pass
            return
        x = step(own, rows)
        square = x.astype(np.float64).T @ x.astype(np.float64)
        yield _rows(arrow, [{**{n: own[n] for n in ("block", "ids", "targets", "route")},
                             "matrix": x.astype(np.float32).tobytes(), "gram": square.tobytes()}])

    together = held.unionByName(sent, allowMissingColumns=True)
    with passing(held.sparkSession):
        return snapshot(together.repartitionById(blocks, F.col("block")).sortWithinPartitions("kind", "source")
                        .mapInArrow(run, _STATE), label)


def _filled(own: dict, ids: str, rows: Iterator[dict], factors: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of the ids that are listed, as they come in, and the sum of the squares sent."""
    listed = np.frombuffer(own[ids], np.int32)
    x, gram = np.zeros((len(listed), factors), np.float32), np.zeros((factors, factors))
    for row in rows:
        x[np.searchsorted(listed, np.frombuffer(row["ids"], np.int32))] = \
            np.frombuffer(row["matrix"], np.float32).reshape(-1, factors)
        if row["gram"]:
            gram += np.frombuffer(row["gram"]).reshape(factors, factors)
    return x, gram


def solved(counts: np.ndarray, places: np.ndarray, weights: np.ndarray, y: np.ndarray, gram: np.ndarray,
           confidence: float, reg: float) -> np.ndarray:
    """The vector of each id: (Y'Y + sum c yy' + reg n I) x = sum (1 + c) y, with c the confidence times a
    rating's weight, over its `counts` ratings. `places` are their rows in `y`, id by id.

    Ids with equally many ratings are multiplied together. Sums are in double precision.
    """
    factors = len(gram)
    out, starts, eye = np.empty((len(counts), factors), np.float32), np.cumsum(counts) - counts, np.eye(factors)
    by_count = np.argsort(counts, kind="stable")
    edges = np.flatnonzero(np.diff(counts[by_count], prepend=-1))
    for lo, hi in zip(edges, np.r_[edges[1:], len(counts)]):
        n = int(counts[by_count[lo]])
        rows = max(1, GATHERED // n)
        for at in range(lo, hi, rows):
            ids = by_count[at:min(at + rows, hi)]
            left, right = gram + np.zeros((len(ids), 1, 1)) + reg * n * eye, np.zeros((len(ids), factors))
            for first in range(0, n, GATHERED):         # one piece, but for an id of very many ratings
                which = starts[ids][:, None] + np.arange(first, min(first + GATHERED, n))
                part = y[places[which]].astype(np.float64)
                if len(weights):
                    c = confidence * weights[which].astype(np.float64)
                    left += (part * c[:, :, None]).transpose(0, 2, 1) @ part
                    right += ((1 + c)[:, None, :] @ part)[:, 0]
                else:
                    left += confidence * (part.transpose(0, 2, 1) @ part)
                    right += (1 + confidence) * part.sum(axis=1)
            out[ids] = np.linalg.solve(left, right[:, :, None])[:, :, 0]
    return out


def alternate(ratings: DataFrame, start: DataFrame, factors: int, iterations: int, reg: float,
              confidence: float) -> tuple[DataFrame, DataFrame]:
    """(user factors, item factors), each id and features, as MLlib gives them. `ratings` has user_idx, item_idx and r, one row per
    pair; `start` the users' first vectors, as id and features."""
    if iterations < 1:
        raise ValueError("iterations must be at least 1")
    blocks = block_count(ratings.count())
    users, items = packed(ratings, "user_idx", "item_idx", blocks), packed(ratings, "item_idx", "user_idx", blocks)

    def begin(own: dict, rows: Iterator[dict]) -> np.ndarray:
        return _filled(own, "ids", rows, factors)[0]

    def solve(own: dict, rows: Iterator[dict]) -> np.ndarray:
        y, gram = _filled(own, "named", rows, factors)
        numbers = lambda name, kind: np.frombuffer(own[name], kind)
        return solved(numbers("counts", np.int32).astype(np.int64), numbers("places", np.int32), numbers("weights", np.float32),
                      y, gram, confidence, reg)

    x = _met(users, _vectors(start, blocks, factors), blocks, begin, "als-state")
    y = None
    for _ in range(iterations):
        before, y = y, _met(items, _messages(x, factors), blocks, solve, "als-state")
        if before is not None:
            discard(before)
        before, x = x, _met(users, _messages(y, factors), blocks, solve, "als-state")
        discard(before)
    for table in (users, items):
        discard(table)
    return _unpacked(x, factors), _unpacked(y, factors)


def _unpacked(state: DataFrame, factors: int) -> DataFrame:
    arrow = _arrow("id int, features array<float>")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _records(batches):
            ids, x = np.frombuffer(row["ids"], np.int32), np.frombuffer(row["matrix"], np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(
                pa.array(np.arange(len(ids) + 1, dtype=np.int32) * factors), pa.array(x)).cast(arrow.field(1).type)], schema=arrow)

    return state.select("ids", "matrix").mapInArrow(unpack, "id int, features array<float>")
