"""Quality by co-training: a view of the text and a view of the metadata teach each other.

Each view has its own classifier. In every round each labels the pool documents that it is
sure of, and the other one trains on those besides the true labels. At the end both are
calibrated on labelled documents kept aside, and a small model over the two combines them.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.boosting import bounded, calibration_fold
from gleaner.llm.common import by_value
from gleaner.session import snapshot

by_value(__name__)

# frequent function words of four languages
COMMON = frozenset("""the of and to in is that it was for on are as with his they be at one have this from or had by
der die das und in zu den mit von ist des sich auf für nicht ein eine als auch es an dem im
de la le les et des un une du que est pour dans qui par sur au avec ne se el los las y en por con su para como""".split())
_WORD = re.compile(r"[^\W\d_]+")
_SIGNS = re.compile(r"[#$%&*@^~<>{}\[\]\\|=+_]")
BUCKETS = 32


def text_features(text: str) -> list[float]:
    """Shares and logarithms, so that long and short texts are alike."""
    words = _WORD.findall(text)
    low = [w.lower() for w in words]
    n, chars = max(len(words), 1), max(len(text), 1)
    letters = max(sum(map(len, words)), 1)
    counts = Counter(low)
    lines = [x for x in text.split("\n") if x.strip()]
    repeats = sum(a == b for a, b in zip(low, low[1:]))
    upper = 0 if text.islower() else sum(c.isupper() for c in text)
    signs = len(_SIGNS.findall(text))
    out = [len(counts) / math.sqrt(n), repeats / n, max(counts.values(), default=0) / n,
           upper / letters, text.count("!") / n, signs / n, text.count("|") / n,
           sum(c.isdigit() for c in text) / chars if not text.isalpha() else 0.0,
           sum(counts[w] for w in COMMON if w in counts) / n,
           1 - len(set(lines)) / max(len(lines), 1), letters / n, letters / chars]
    # the same against what is usual, as the decision is about being far off
    out += [float(repeats / n > 0.05), float(upper / letters > 0.3), float(text.count("!") / n > 0.1),
            float(signs / n > 0.05), float(text.count("|") / n > 0.05), float(not words)]
    return out + [math.log1p(len(words)), math.log1p(len(lines))]


def text_view(docs: DataFrame) -> Column:
    @F.pandas_udf("array<double>")
    def make(texts: pd.Series) -> pd.Series:
        return pd.Series([text_features(t or "") for t in texts])

    return make(docs["text"])


def metadata_view(docs: DataFrame) -> Column:
    """Language and source, hashed, and the stated length. Missing columns count as null."""
    def hot(name: str, buckets: int) -> Column:
        value = docs[name].cast("string") if name in docs.columns else F.lit(None).cast("string")
        own = F.pmod(F.xxhash64(F.lit(name), value), F.lit(buckets))
        return F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda i: (own == i).cast("double"))

    size = docs["n_chars"].cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    size = F.log1p(F.greatest(F.coalesce(size, F.lit(0.0)), F.lit(0.0)))
    return F.concat(hot("lang", BUCKETS // 4), hot("source", BUCKETS), F.array(
        size, (size < 5).cast("double"), (size > 9).cast("double")))


@dataclass
class View:
    """One classifier, and its calibration on documents it did not see."""

    name: str
    model: object
    scale: object

    @classmethod
    def fit(cls, name: str, train: DataFrame, aside: DataFrame) -> View:
        learner = LogisticRegression(featuresCol="_v", labelCol="label", maxIter=40, regParam=1e-3)
        learner.setRawPredictionCol("_r").setProbabilityCol("_q").setPredictionCol("_y")
        model = learner.fit(train.select(array_to_vector(name).alias("_v"), "label"))
        rule = IsotonicRegression(featuresCol="_m", labelCol="label", predictionCol="_c")
        return cls(name, model, rule.fit(cls._margin(name, model, aside)))

    @staticmethod
    def _margin(name: str, model, rows: DataFrame) -> DataFrame:
        out = model.transform(rows.withColumn("_v", array_to_vector(name)))
        return out.select(*rows.columns, vector_to_array("_r")[1].alias("_m"))

    def score(self, rows: DataFrame) -> DataFrame:
        """`rows` with p_<name>, kept off 0 and 1 so that its logarithm exists."""
        out = self.scale.transform(self._margin(self.name, self.model, rows))
        return out.select(*rows.columns, F.least(F.greatest("_c", F.lit(1e-3)), F.lit(1 - 1e-3))
                          .alias(f"p_{self.name}"))


def _logits() -> Column:
    return array_to_vector(F.array(*[F.log(F.col(p) / (1 - F.col(p))) for p in ("p_text", "p_meta")]))


@dataclass
class Quality:
    text: View | None
    meta: View | None
    both: object

    def score(self, docs: DataFrame) -> DataFrame:
        """All columns of `docs`, with `q_score`, `q_text` and `q_meta`; one pass, no shuffle."""
        keep = [c for c in docs.columns if c not in ("q_score", "q_text", "q_meta")]
        if self.text is None:
            return docs.select(*keep, *[F.lit(1.0).alias(c) for c in ("q_score", "q_text", "q_meta")])
        rows = docs.select(F.struct(*[docs[c] for c in keep]).alias("_doc"),
                           text_view(docs).alias("text"), metadata_view(docs).alias("meta"))
        rows = self.meta.score(self.text.score(rows)).withColumn("_l", _logits())
        rows = self.both.transform(rows)
        return rows.select("_doc.*", vector_to_array("_q")[1].alias("q_score"),
                           F.col("p_text").alias("q_text"), F.col("p_meta").alias("q_meta"))


def fit_quality(docs: DataFrame, labels: DataFrame, most_labelled: int = 20_000,
                most_pool: int = 20_000, rounds: int = 3, sure: float = 0.97) -> Quality:
    """Co-training from `labels` (doc_id, label 0/1, 1 being good) over the texts of `docs`.

    `most_labelled` labelled rows and `most_pool` further documents are used for fitting, those
    with the smallest hash of doc_id. A fifth of the labelled rows is kept for calibration. In
    each round a view hands the other one the pool documents whose calibrated probability is
    at least `sure` for either class; the pool grows from round to round. Labels with nulls
    are left out. If the fitting rows or the rows kept aside hold one class only, there is no
    model and every document scores 1.

    Null and empty texts are scored like any other. Repeated rows are scored each; an empty
    table gives no row.
    """
    given = bounded(labels.select("doc_id", F.col("label").cast("int").alias("label"))
                    .filter("doc_id IS NOT NULL AND label IN (0, 1)"), most_labelled, "doc_id")
    pool = bounded(docs.select("doc_id").filter("doc_id IS NOT NULL")
                   .join(labels.select("doc_id"), "doc_id", "left_anti"), most_pool, "doc_id")
    # bounded by most_labelled + most_pool rows of two numbers
    chosen = F.broadcast(given.select("doc_id", "label").unionByName(
        pool.select("doc_id", F.lit(None).cast("int").alias("label"))))
    some = docs.join(chosen.withColumnRenamed("label", "_label").withColumnRenamed("doc_id", "_id"),
                     F.col("doc_id") == F.col("_id"))
    rows = snapshot(some.select("doc_id", F.col("_label").cast("double").alias("label"),
                                text_view(some).alias("text"), metadata_view(some).alias("meta")),
                    "quality-sample").coalesce(4)        # bounded rows; fitting runs many short jobs
    true = rows.filter("label IS NOT NULL")
    fold = calibration_fold("doc_id")
    train, aside = true.filter(~fold), true.filter(fold)
    if any(part.select("label").distinct().count() < 2 for part in (train, aside)):
        return Quality(None, None, None)
    pseudo = {"text": None, "meta": None}                 # what each view was taught by the other
    views: dict[str, View] = {}
    for turn in range(rounds + 1):
        for name in ("text", "meta"):
            more = pseudo[name]
            views[name] = View.fit(name, train if more is None else train.unionByName(more), aside)
        if turn == rounds:
            break
        part = rows.filter("label IS NULL").filter(
            F.pmod(F.xxhash64(F.lit(41), "doc_id"), F.lit(rounds)) <= turn)
        for name, other in (("text", "meta"), ("meta", "text")):
            p = F.col(f"p_{name}")
            pseudo[other] = (views[name].score(part).filter((p >= sure) | (p <= 1 - sure))
                             .select("doc_id", (p >= sure).cast("double").alias("label"), "text", "meta"))
    joint = LogisticRegression(featuresCol="_l", labelCol="label", maxIter=40, regParam=1e-3)
    joint.setRawPredictionCol("_r").setProbabilityCol("_q").setPredictionCol("_y")
    held = views["meta"].score(views["text"].score(aside)).withColumn("_l", _logits())
    return Quality(views["text"], views["meta"], joint.fit(held))
