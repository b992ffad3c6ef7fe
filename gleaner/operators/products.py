"""Exact best-k inner products of two tables of vectors, without forming all of them.

Items lie on shelves in order of their length, the longest first. A product is at most the
product of both lengths, so a user whose k-th best score so far is out of a shelf's reach is not
sent there, and inside a shelf it stops at the first step out of its reach. The first shelf is
searched for everyone; what it gives are the thresholds for all others.

Each shelf is shuffled to a number of lanes that depends on the number of shelves alone; the
users come to the shelves, not the shelves to the users. The shelves behind the first are taken
in rounds, each WIDEN times as far as the last, and the thresholds rise from round to round: what a
round writes down is a few times what is wanted, however many shelves there are.
"""
from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gleaner.functions.expressions import int_array
from gleaner.functions.grouping import global_positions
from gleaner.session import snapshot

# functions sent to the workers travel with the plan; the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DIGITS = 5                   # scores are rounded, so that a list does not depend on the blocking
TASKS = 64                   # tasks of a round, at least
WIDEN = 4                    # shelves after a round to those before it
_REACH = 2e-5                # room for that rounding and for single precision
_FLOAT = 1e-6


def length(vector: str):
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def shelved(items: DataFrame, per_shelf: int) -> DataFrame:
    """(shelf, top, ids, matrix): items in order of length, `per_shelf` to a row; `top` is the
    longest one's length. `items` has id and features."""
    placed = global_positions(items.select("id", "features", (-length("features")).alias("shorter")),
                              ["shorter", "id"], "position", "products-order")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position")
        return pd.DataFrame({
            "shelf": [int(pdf["shelf"].iloc[0])], "top": [-float(pdf["shorter"].iloc[0])],
            "ids": [pdf["id"].to_numpy(np.int32).tobytes()],
            "matrix": [np.stack(pdf["features"].to_numpy()).astype(np.float32).tobytes()]})

    shelf = F.floor(F.col("position") / per_shelf).cast("int")
    return snapshot(placed.withColumn("shelf", shelf).groupBy("shelf").applyInPandas(
        pack, "shelf int, top double, ids binary, matrix binary"), "products-shelves")


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row its k largest scores in falling order, equal ones by id.

    One cut for the whole matrix: what is below a row's k-th score becomes -inf, the columns
    left are as many as the fullest row needs, and only those are sorted.
    """
    if scores.shape[1] > k:
        keep = scores >= -np.partition(-scores, k - 1, axis=1)[:, k - 1:k]
        columns = np.argsort(~keep, axis=1, kind="stable")[:, :keep.sum(axis=1).max()]
        ids, scores, keep = (np.take_along_axis(m, columns, axis=1) for m in (ids, scores, keep))
        scores = np.where(keep, scores, -np.inf)
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(scores, order, axis=1)


def search(ids: np.ndarray, y: np.ndarray, x: np.ndarray, wanted: np.ndarray, least: np.ndarray,
           step: int, score_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(row of x, id, score) of each row's best `wanted` items that score `least` or more, and the
    number of products formed. `y` is in order of length, the longest first.

    Rows are taken together whose `wanted` is alike, so one that wants many does not widen the
    others' lists. A product costs one comparison with the row's bound, in single precision; only
    those that reach it are rounded, kept and, when they have become as many as half the lists, sorted.
    """
    tops = np.sqrt((y[::step].astype(np.float64) ** 2).sum(axis=1))
    lengths = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
    kind = np.ceil(np.log2(np.maximum(wanted, 1))).astype(int)
    out, formed = [], 0
    for group in np.unique(kind):
        alike = np.flatnonzero(kind == group)
        most = int(wanted[alike].max())
        rows = min(max(1, score_bytes // (24 * (most + step))), 1 << 16)
        for at in range(0, len(alike), rows):
            part = alike[at:at + rows]
            lists = _Lists(wanted[part], least[part], most)
            for n, top in enumerate(tops):
                bound = lengths[part] * top
                open_ = np.flatnonzero(bound >= lists.low - _REACH - _FLOAT * bound)
                if not len(open_):
                    break
                items = slice(n * step, (n + 1) * step)
                scores = x[part[open_]] @ y[items].T
                formed += scores.size
                lists.add(open_, ids[items], scores)
            row, found, score = lists.best()
            out.append((part[row], found, score))
    row, found, score = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, np.int32),
                                                                            np.zeros(0))
    return row, found, score, formed


class _Lists:
    """The best `wanted` items so far of at most 65,536 rows, and the bound `low` a further one must reach."""

    def __init__(self, wanted: np.ndarray, least: np.ndarray, most: int) -> None:
        self.wanted, self.low, self.most = wanted, least.copy(), most
        none = np.zeros(0, np.uint16), np.zeros(0, np.int32), np.zeros(0)
        self.held, self.fresh, self.n_fresh = none, [], 0

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """`scores` has a line for each of `rows` and a column for each of `ids`."""
        low = self.low[rows]
        if scores.shape[1] >= self.most:        # the first items give a bound by themselves
            unbound = np.flatnonzero(np.isneginf(low))
            if len(unbound):
                kth = np.partition(scores[unbound], scores.shape[1] - self.most, axis=1)[:, scores.shape[1] - self.most]
                low[unbound] = self.low[rows[unbound]] = np.round(kth.astype(np.float64), DIGITS)
        # half a unit of the last digit, and what single precision may be short of
        about = low - 0.6 * 10.0 ** -DIGITS
        near = np.flatnonzero(scores >= np.nextafter(about.astype(np.float32), np.float32(-np.inf))[:, None])
        line, column = np.divmod(near, scores.shape[1])
        score = np.round(scores.ravel()[near].astype(np.float64), DIGITS)
        real = score >= low[line]
        self.fresh.append((rows[line[real]].astype(np.uint16), ids[column[real]], score[real]))
        self.n_fresh += int(real.sum())
        if self.n_fresh > len(self.low) * self.most // 2:
            self._sort()

    def _sort(self) -> None:
        row, found, score = (np.concatenate(c) for c in zip(self.held, *self.fresh))
        order = np.argsort(row, kind="stable")          # by radix, as it has two bytes
        row, found, score = row[order], found[order], score[order]
        n = np.bincount(row, minlength=len(self.low))
        width, place = max(int(n.max(initial=0)), self.most), np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        ids = np.full((len(n), width), np.iinfo(np.int32).max, np.int32)
        scores = np.full((len(n), width), -np.inf)
        ids[row, place], scores[row, place] = found, score
        ids, scores = best_of(ids, scores, self.most)
        self.low = np.maximum(self.low, scores[np.arange(len(n)), self.wanted - 1])
        real = np.isfinite(scores) & (np.arange(self.most) < self.wanted[:, None])
        self.held = np.repeat(np.arange(len(n)), real.sum(axis=1)).astype(np.uint16), ids[real], scores[real]
        self.fresh, self.n_fresh = [], 0

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, id, score), in order of row, falling score and id."""
        if self.fresh:
            self._sort()
        return self.held


def _round(shelves: DataFrame, tops: list[float], first: int, users: DataFrame, factors: int, step: int,
           score_bytes: int, label: str) -> DataFrame:
    """(user_idx, item_idx, score) over the shelves from `first` on, whose lengths are `tops`."""
    lanes = -(-TASKS // len(tops))
    bound = F.col("_length")
    out_of_reach = F.col("least") - F.lit(_REACH)
    within = F.size(F.filter(int_array(tops, "double"),
                             lambda top: top * bound * (1 + _FLOAT) >= out_of_reach))
    asked = (users.withColumn("_length", length("features")).withColumn("_shelves", within).filter("_shelves > 0")
             .withColumn("shelf", F.explode(F.sequence(F.lit(first), F.lit(first - 1) + F.col("_shelves"))))
             .withColumn("lane", F.pmod(F.xxhash64("user_idx"), F.lit(lanes)).cast("int"))
             .select("shelf", "lane", F.lit(1).alias("kind"), "user_idx", "features", "wanted", "least"))
    held = (shelves.filter(F.col("shelf").between(first, first + len(tops) - 1)).drop("top")
            .withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).withColumn("kind", F.lit(0)))
    arrow = to_arrow_schema(T.StructType.fromDDL("user_idx int, item_idx int, score double"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = y = None
        for batch in batches:
            col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            kind = col["kind"].to_numpy()
            edges = np.flatnonzero(np.r_[True, (kind[1:] == 0) | (kind[1:] != kind[:-1])][:len(kind)])
            for at, to in zip(edges, np.r_[edges[1:], len(kind)]):
                if kind[at] == 0:
                    ids = np.frombuffer(col["ids"][int(at)].as_py(), np.int32)
                    y = np.frombuffer(col["matrix"][int(at)].as_py(), np.float32).reshape(-1, factors)
                    continue
                part = {n: col[n].slice(int(at), int(to - at)) for n in ("user_idx", "features", "wanted", "least")}
                x = part["features"].flatten().to_numpy(zero_copy_only=False).reshape(-1, factors)
                row, found, score, _ = search(ids, y, x, part["wanted"].to_numpy(), part["least"].to_numpy(),
                                              step, score_bytes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part["user_idx"].to_numpy()[row]), pa.array(found), pa.array(score)], schema=arrow)

    together = held.unionByName(asked, allowMissingColumns=True)
    return snapshot(together.repartition(lanes * len(tops), "shelf", "lane")
                    .sortWithinPartitions("shelf", "lane", "kind")
                    .mapInArrow(run, "user_idx int, item_idx int, score double"), label)


def best_products(items: DataFrame, users: DataFrame, factors: int, per_shelf: int, step: int,
                  score_bytes: int) -> DataFrame:
    """(user_idx, item_idx, score): at least the best `wanted` items of every user, ties by item.

    `items` has id and features, `users` user_idx, features and wanted. One length per shelf
    reaches the driver. Scores are rounded to DIGITS digits.
    """
    shelves = shelved(items, per_shelf)
    tops = [r["top"] for r in shelves.orderBy("shelf").select("top").collect()]
    start = users.withColumn("least", F.lit(float("-inf")))
    if not tops:
        return start.select("user_idx", F.lit(0).alias("item_idx"), F.lit(0.0).alias("score")).limit(0)
    best = _round(shelves, tops[:1], 0, start, factors, step, score_bytes, "products-lead")
    done = 1
    while done < len(tops):
        have = best.groupBy("user_idx").agg(F.count("*").alias("n"), F.min("score").alias("low"))
        raised = snapshot(users.join(have, "user_idx", "left").select(
            *users.columns, F.when(F.col("n") >= F.col("wanted"), F.col("low"))
            .otherwise(F.lit(float("-inf"))).alias("least")), "products-users")
        to = WIDEN * done
        more = _round(shelves, tops[done:to], done, raised, factors, step, score_bytes, "products-more")
        best = snapshot(_wanted_of(best.unionByName(more), users), "products-best")
        done = to
    return best


def _wanted_of(scored: DataFrame, users: DataFrame) -> DataFrame:
    """The best `wanted` rows of every user, ties by item."""
    place = F.row_number().over(Window.partitionBy("user_idx").orderBy(F.desc("score"), "item_idx"))
    return (scored.withColumn("_place", place).join(users.select("user_idx", "wanted"), "user_idx")
            .filter("_place <= wanted").select("user_idx", "item_idx", "score"))


def above(items: DataFrame, users: DataFrame, factors: int, per_block: int = 262_144,
          score_bytes: int = 64 << 20) -> DataFrame:
    """(user_idx, item_idx, score): every pair whose product is more than the user's `least`.

    All users against all items, with no order and no bound that skips any. `items` has item_idx and
    features, `users` user_idx, features and least. Items are dealt out in blocks, users stream past
    them, and only the pairs found leave a task; scores are sums in double precision.
    """
    blocks = -(-max(items.count(), 1) // per_block)
    lanes = -(-TASKS // blocks)
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = (items.select(F.lit(0).alias("kind"), F.col("item_idx").alias("id"), "features", F.lit(0.0).alias("least"))
            .withColumn("block", dealt("id", blocks)).withColumn("lane", every(lanes)))
    asked = (users.select(F.lit(1).alias("kind"), F.col("user_idx").alias("id"), "features",
                          F.col("least").cast("double").alias("least"))
             .withColumn("lane", dealt("id", lanes)).withColumn("block", every(blocks)))
    arrow = to_arrow_schema(T.StructType.fromDDL("user_idx int, item_idx int, score double"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, ids, y, longest = None, [], [], 0.0
        for batch in batches:
            col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            key = np.stack([col[n].to_numpy() for n in ("block", "lane", "kind")])
            edges = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)][:key.shape[1]])
            for at, to in zip(edges, np.r_[edges[1:], key.shape[1]]):
                part = {n: col[n].slice(int(at), int(to - at)) for n in ("id", "features", "least")}
                x = part["features"].flatten().to_numpy(zero_copy_only=False).reshape(-1, factors).astype(np.float32)
                if cell != tuple(key[:2, at]):
                    cell, ids, y = tuple(key[:2, at]), [], []
                if key[2, at] == 0:
                    ids.append(part["id"].to_numpy())
                    y.append(x)
                    continue
                if not y:
                    continue
                if len(y) > 1 or len(ids) > 1:
                    ids, y = [np.concatenate(ids)], [np.concatenate(y)]
                longest = float(np.sqrt((y[0].astype(np.float64) ** 2).sum(axis=1).max()))
                yield from over(part["id"].to_numpy(), x, part["least"].to_numpy(), ids[0], y[0], longest)

    def over(user, x, least, ids, y, longest):
        # what single precision may be short of
        low = (least - _FLOAT * factors * longest * np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))).astype(np.float64)
        step = 8_192
        rows = max(1, score_bytes // (4 * step))
        for a in range(0, len(x), rows):
            for b in range(0, len(y), step):
                near = x[a:a + rows] @ y[b:b + step].T
                near = near > np.nextafter(low[a:a + rows].astype(np.float32), np.float32(-np.inf))[:, None]
                u, i = np.divmod(np.flatnonzero(near), near.shape[1])   # over one flat array, which skips what is far
                score = (x[a + u].astype(np.float64) * y[b + i]).sum(axis=1)
                real = score > least[a + u]
                if real.any():
                    yield pa.RecordBatch.from_arrays([pa.array(user[a + u[real]]), pa.array(ids[b + i[real]]),
                                                      pa.array(score[real])], schema=arrow)

    return (held.unionByName(asked).repartition(lanes * blocks, "block", "lane")
            .sortWithinPartitions("block", "lane", "kind").mapInArrow(run, "user_idx int, item_idx int, score double"))
