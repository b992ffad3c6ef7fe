"""Hard negatives: exact inner-product search with coordinate pruning over length buckets.

Vectors are ordered by length and cut into buckets. A bucket keeps, for each coordinate, its
vectors in the order of that coordinate of their directions. An anchor that needs a score above
some threshold needs directions within an angle of its own: the shorter the bucket's longest
vector, the smaller the angle. In each of the anchor's focus coordinates, its largest, the angle
leaves a range of values; a bucket's candidates are the vectors inside all of these ranges.
Their scores are then computed exactly. The longest vectors go first, and what they
give raises the thresholds for all others; buckets that cannot reach them are not opened.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gleaner.functions import top_k
from gleaner.functions.grouping import global_positions
from gleaner.llm.common import by_value, map_columns, map_groups
from gleaner.session import snapshot

by_value(__name__)

BUCKET = 2_048               # vectors of a bucket
SHELF = 8                    # buckets that a task holds
LANE = 16_384                # anchors that a task compares with its shelf
FOCUS = 4                    # coordinates by which candidates are pruned
SPREAD = 64
SLACK = 1e-9                 # room for rounding in angles
EXACT = 2.0 ** 53            # integers below are exact in double precision
LONGEST = 2 ** 63 - 1


def _whole(vectors: DataFrame, scale: float) -> DataFrame:
    """vec_id, label, dim, shorter (the length, negated) and `q`, the integer components as doubles."""
    def clean(batch):
        out = {n: [] for n in ("vec_id", "label", "dim", "shorter", "q")}
        for vec_id, label, vector in zip(batch["vec_id"], batch["label"], batch["embedding"]):
            if vec_id is None or label is None or vector is None or any(x is None for x in vector):
                continue
            x = np.array(vector, dtype=np.float64)
            if not np.isfinite(x).all():
                continue
            q = np.floor(scale * x) + 0.0                          # + 0.0: no negative zero
            top = np.abs(q).max(initial=1.0)
            for name, value in (("vec_id", vec_id), ("label", label), ("dim", len(q)), ("q", q.tobytes()),
                                ("shorter", -float(top * np.sqrt(((q / top) ** 2).sum())))):
                out[name].append(value)
        return out

    kind = vectors.schema["vec_id"].dataType.simpleString()
    cleaned = map_columns(vectors.select("vec_id", F.col("label").cast("string").alias("label"), "embedding"),
                          f"vec_id {kind}, label string, dim int, shorter double, q binary", clean)
    one = F.min(F.struct("label", "q", "dim", "shorter")).alias("row")
    return cleaned.groupBy("vec_id").agg(one).select("vec_id", "row.*")


def _bucket(group: dict[str, list]) -> dict[str, list]:
    """One row for a bucket: its vectors in order of length, and each coordinate's order."""
    at = sorted(range(len(group["vec_id"])), key=group["position"].__getitem__)
    norm = -np.array([group["shorter"][i] for i in at])
    x = np.stack([np.frombuffer(group["q"][i]) for i in at])
    orders = np.argsort(_directions(x, norm), axis=0, kind="stable").T
    return {"dim": group["dim"][:1], "shelf": [group["bucket"][0] // SHELF], "bucket": group["bucket"][:1],
            "top": [float(norm.max())], "ids": [np.array([group["vec_id"][i] for i in at], np.int64).tobytes()],
            "labels": [[group["label"][i] for i in at]], "lengths": [norm.tobytes()],
            "vectors": [x.tobytes()], "orders": [np.ascontiguousarray(orders, np.int32).tobytes()]}


def _directions(x: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return x / np.where(norm > 0, norm, 1.0)[:, None]


@dataclass
class Bucket:
    top: float
    ids: np.ndarray
    codes: dict[str, int]        # of the labels
    label: np.ndarray
    x: np.ndarray
    unit: np.ndarray
    orders: np.ndarray           # coordinate x place: row
    values: np.ndarray           # coordinate x place: that row's value, rising

    @classmethod
    def of(cls, row: dict) -> Bucket:
        ids = np.frombuffer(row["ids"], np.int64)
        x = np.frombuffer(row["vectors"]).reshape(len(ids), row["dim"])
        unit = _directions(x, np.frombuffer(row["lengths"]))
        orders = np.frombuffer(row["orders"], np.int32).reshape(row["dim"], len(ids))
        names, label = np.unique(np.array(row["labels"]), return_inverse=True)
        return cls(row["top"], ids, {n: i for i, n in enumerate(names.tolist())}, label, x, unit, orders,
                   np.take_along_axis(unit.T, orders, axis=1))

    def feasible(self, direction: np.ndarray, cosine: float) -> np.ndarray:
        """Rows that may have at least this cosine (above 0) with `direction`."""
        focus = np.argsort(-np.abs(direction), kind="stable")[:FOCUS]
        angle = np.arccos(min(cosine, 1.0)) + SLACK
        own = np.arccos(np.clip(direction[focus], -1.0, 1.0))
        low = np.cos(np.minimum(own + angle, np.pi)) - SLACK
        high = np.cos(np.maximum(own - angle, 0.0)) + SLACK
        ranges = sorted((int(np.searchsorted(self.values[f], b, "right") - np.searchsorted(self.values[f], a)), f, a, b)
                        for f, a, b in zip(focus.tolist(), low, high))
        n, f, a, _ = ranges[0]
        first = int(np.searchsorted(self.values[f], a))
        rows = self.orders[f, first:first + n]
        for n, f, a, b in ranges[1:]:
            if n < len(self.ids):
                value = self.unit[rows, f]
                rows = rows[(value >= a) & (value <= b)]
        return rows


def _scores(x: np.ndarray, q: np.ndarray, largest: float) -> np.ndarray:
    """Exact inner products; in whole numbers of any size where doubles would round, cut to a long."""
    if largest < EXACT:
        return x @ q
    whole = [int(v) for v in q]
    return np.array([max(min(sum(int(a) * b for a, b in zip(row, whole)), LONGEST), -LONGEST) for row in x],
                    dtype=object)


def nearest(shelf: list[Bucket], anchor: int, label: str, q: np.ndarray, norm: float, same: bool, k: int,
            goals: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int, int]], int]:
    """(goal, id, score) of the best k rows for each goal, and the number of scores computed.

    A goal (name, low, high) takes scores from low to high, of rows of the anchor's label
    (`same`) or of the others. Higher scores come first, then smaller ids. `shelf` goes from
    the longest bucket to the shortest.
    """
    low = [g[1] for g in goals]
    best = [(np.zeros(0, object if norm * shelf[0].top >= EXACT else np.float64), np.zeros(0, np.int64))
            for _ in goals]
    direction, tried = q / norm if norm > 0 else q, 0
    for bucket in shelf:
        need, reach = min(low), norm * bucket.top
        if need > 0 and reach < need * (1 - SLACK):
            break                                                  # and so are the shorter ones
        rows = bucket.feasible(direction, need / reach * (1 - SLACK)) if need > 0 else np.arange(len(bucket.ids))
        rows = rows[((bucket.label[rows] == bucket.codes.get(label, -1)) == same) & (bucket.ids[rows] != anchor)]
        if not len(rows):
            continue
        tried += len(rows)
        score, ids = _scores(bucket.x[rows], q, reach), bucket.ids[rows]
        for n, (_, _, high) in enumerate(goals):
            good = (score >= low[n]) & (score <= high)
            if not good.any():
                continue
            s, i = np.concatenate([best[n][0], score[good]]), np.concatenate([best[n][1], ids[good]])
            first = np.lexsort((i, -s))[:k]
            best[n] = s[first], i[first]
            if len(first) == k:
                low[n] = int(s[first[-1]])
    return [(goal[0], int(i), int(s)) for goal, (ss, ii) in zip(goals, best) for s, i in zip(ss, ii)], tried


_GOALS = "array<struct<goal:bigint,low:bigint,high:bigint>>"


def _meet(index: DataFrame, shelves: DataFrame, asked: DataFrame, lanes: int, same: bool, k: int,
          label: str) -> DataFrame:
    """(anchor, goal, other, score) over the given shelves, at most k for a goal and task."""
    need = F.array_min(F.transform("goals", lambda g: g["low"]))
    salt = F.pmod(F.xxhash64("anchor"), F.lit(SPREAD)).cast("int")
    listed = (shelves.groupBy("dim").agg(F.collect_list(F.struct("shelf", "top")).alias("_at"))
              .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))))
    reached = F.filter("_at", lambda s: (F.col("_need") <= 0) | (
        s["top"] * F.col("norm") >= F.col("_need") * (1 - SLACK)))
    queries = (asked.withColumn("_salt", salt).withColumn("_need", need).join(listed, ["dim", "_salt"])
               .withColumn("shelf", F.explode(F.transform(reached, lambda s: s["shelf"])))
               .withColumn("lane", F.pmod(F.xxhash64(F.lit(1), "anchor"), F.lit(lanes)).cast("int"))
               .select("dim", "shelf", "lane", F.lit(1).alias("kind"), "anchor", "label", "norm", "q", "goals"))
    held = (index.join(shelves.select("dim", "shelf"), ["dim", "shelf"], "left_semi")
            .withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
            .withColumn("kind", F.lit(0)))
    arrow = to_arrow_schema(T.StructType.fromDDL("anchor bigint, goal bigint, other bigint, score bigint"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, shelf = None, []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                at = row["dim"], row["shelf"], row["lane"]
                if at != key:
                    key, shelf = at, []
                if not row["kind"]:
                    shelf.append(Bucket.of(row))
                else:
                    found, _ = nearest(shelf, row["anchor"], row["label"], np.frombuffer(row["q"]), row["norm"],
                                       same, k, [(g["goal"], g["low"], g["high"]) for g in row["goals"]])
                    out.extend((row["anchor"], *f) for f in found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(zip(*out) if out else [[]] * 4, arrow)], schema=arrow)

    together = held.unionByName(queries, allowMissingColumns=True)
    return snapshot(together.repartition("dim", "shelf", "lane")
                    .sortWithinPartitions("dim", "shelf", "lane", "kind", "bucket")
                    .mapInArrow(run, "anchor bigint, goal bigint, other bigint, score bigint"), label)


def _best(index: DataFrame, shelves: DataFrame, asked: DataFrame, lanes: int, same: bool, k: int,
          label: str) -> DataFrame:
    """(anchor, goal, rank, other, score), the best k for each goal over all shelves.

    The shelf of the longest vectors goes first; its k-th scores are the others' thresholds.
    """
    lead = shelves.groupBy("dim").agg(F.min("shelf").alias("shelf"))
    found = _meet(index, shelves.join(lead, ["dim", "shelf"]), asked, lanes, same, k, label)
    rest = shelves.join(lead, ["dim", "shelf"], "left_anti")
    if not rest.isEmpty():
        full = (found.groupBy("anchor", "goal").agg(F.count("*").alias("n"), F.min("score").alias("low"))
                .filter(F.col("n") >= k).groupBy("anchor")
                .agg(F.map_from_entries(F.collect_list(F.struct("goal", "low"))).alias("_low")))
        raised = F.transform("goals", lambda g: F.struct(
            g["goal"].alias("goal"), F.greatest(g["low"], F.coalesce(F.col("_low")[g["goal"]], g["low"])).alias("low"),
            g["high"].alias("high")))
        asked = asked.join(full, "anchor", "left").withColumn("goals", raised).drop("_low")
        found = found.unionByName(_meet(index, rest, asked, lanes, same, k, label))
    return top_k(found, ["anchor", "goal"], [F.desc("score"), F.asc("other")], k)


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10,
                   least: int = 30, most: int = 90, scale: float = 256.0) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x); scores are their integer inner products. An anchor, a
    row where `anchors` holds, has its best `positives` other rows of equal label; for each, its best
    `negatives` rows of other labels whose score is from `least` to `most` percent of the
    positive's are returned. Higher scores come first, then smaller vec_id.

    Rows without vec_id, label or vector and vectors with null or non-finite parts take no part.
    Vectors of different length are not compared. Of several rows of one vec_id one is used, that of
    the smallest label, then vector. Empty vectors score 0 with each other. Scores beyond a
    long are cut to its range. An empty table, or none without anchors, gives no row. vec_id is an integer;
    other columns are not read.

    Every bucket is searched that can hold a result, so the result is exact. A task holds SHELF
    buckets and one anchor at a time; a label or length that most rows share is cut like any other.
    """
    rows = snapshot(_whole(vectors, scale), "negatives-rows")
    placed = global_positions(rows, ["dim", "shorter", "vec_id"], "position", "negatives-order")
    kind = ("dim int, shelf bigint, bucket bigint, top double, ids binary, labels array<string>, lengths binary,"
            " vectors binary, orders binary")
    index = snapshot(map_groups(
        placed.withColumn("bucket", F.floor(F.col("position") / BUCKET)).select(
            "dim", "bucket", "position", "vec_id", "label", "shorter", "q"), ["dim", "bucket"], kind, _bucket),
        "negatives-index")
    shelves = snapshot(index.groupBy("dim", "shelf").agg(F.max("top").alias("top")), "negatives-shelves")
    base = rows.filter(anchors).select(F.col("vec_id").cast("bigint").alias("anchor"), "label", "dim",
                                       (-F.col("shorter")).alias("norm"), "q")
    lanes = max(1, -(-base.count() // LANE))

    def goals(*values: Column) -> Column:
        return F.struct(*(v.alias(n) for v, n in zip(values, ("goal", "low", "high"))))

    anything = goals(*(F.lit(n).cast("bigint") for n in (0, -LONGEST, LONGEST)))
    own = snapshot(_best(index, shelves, base.withColumn("goals", F.array(anything).cast(_GOALS)), lanes, True,
                         positives, "negatives-positives")
                   .select("anchor", F.col("other").alias("positive_id"), F.col("score").alias("positive_score")),
                   "negatives-goals")
    score = F.col("positive_score").cast("decimal(20,0)")
    low, high = (F.ceil(score * least / 100).cast("bigint"), F.floor(score * most / 100).cast("bigint"))
    wanted = (own.filter("positive_score >= 0").groupBy("anchor")
              .agg(F.collect_list(goals(F.col("positive_id"), low, high)).cast(_GOALS).alias("goals")))
    found = _best(index, shelves, base.join(wanted, "anchor"), lanes, False, negatives, "negatives-found")
    return (found.withColumnRenamed("goal", "positive_id").join(own, ["anchor", "positive_id"])
            .select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("other").alias("negative_id"),
                    "positive_score", F.col("score").alias("negative_score")))
