"""Toxicity: boosted trees over dense features of whole texts, with isotonic calibration.

The lexicon is half given and half learned: words that training documents labelled toxic
hold far more often than the others. It is learned on one half of the training documents and
the trees on the other half, so the trees see how far a learned word can be trusted.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.boosting import Boosted, bounded, fit_boosted
from gleaner.llm.common import by_value, map_columns, share

by_value(__name__)

# plain insults of four languages
INSULTS = frozenset("""idiot idiots moron morons stupid dumb loser losers trash garbage scum pathetic worthless
disgusting clown fool fools jerk creep freak ugly hate dumm blöd dummkopf arschloch idioten abschaum
widerlich trottel hässlich hasse nutzlos estúpido estúpida idiota tonto tonta imbécil basura asqueroso
inútil payaso odio imbécile crétin stupide abruti ordure minable dégoûtant bouffon nul haine""".split())
YOU = frozenset("""you your yours yourself u ur du dich dir dein deine ihr euch euer sie tu te toi ton ta tes
vous votre vos tú ti tus usted ustedes vosotros""".split())
STEMS = (4, 5, 6, 7)                      # letters of a word beginning
NEAR = 5                                   # words between an insult and a second person
_WORD = re.compile(r"[^\W\d_]+")
# letters with signs or digits between them; possessive, so long runs stay linear
_MASKED = re.compile(r"(?<![a-z])[a-z]++[@$0-9!*._-]++[a-z@$0-9!*._-]*[a-z]")
_PLAIN = str.maketrans({"@": "a", "$": "s", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t",
                        "!": "i", "*": None, ".": None, "_": None, "-": None})
_RUN = re.compile(r"(\w)\1{3,}")


class Lexicon:
    """Weights of whole words and of word beginnings."""

    def __init__(self, weights: dict[str, float]):
        self.words = {w: x for w, x in weights.items() if not w.endswith("*")}
        self.stems = {w[:-1]: x for w, x in weights.items() if w.endswith("*")}
        self.lengths = sorted({len(w) for w in self.stems})

    def weight(self, word: str) -> float:
        """Of the word or else of its heaviest learned beginning; 0 if there is none."""
        own = self.words.get(word, 0.0)
        if own or not self.stems:
            return own
        return max((self.stems.get(word[:k], 0.0) for k in self.lengths if len(word) >= k), default=0.0)


def features(text: str, learned: Lexicon) -> list[float]:
    low = text.lower()
    words = _WORD.findall(low)
    n, chars = max(len(words), 1), max(len(text), 1)
    weights = [learned.weight(w) for w in words]
    hit = [i for i, x in enumerate(weights) if x]
    given = [i for i, w in enumerate(words) if w in INSULTS]
    person = [i for i, w in enumerate(words) if w in YOU]
    bad = sorted({*given, *hit})
    different = len({words[i] for i in hit})
    bare = [m.translate(_PLAIN) for m in _MASKED.findall(low)]
    letters = sum(map(len, words))
    upper = sum(c.isupper() for c in text) if not text.islower() else 0
    return [len(hit) / n, math.log1p(len(hit)), sum(weights) / n, max(weights, default=0.0),
            different / n, math.log1p(different),
            len(given) / n, math.log1p(len(given)), _near(bad, person) / n, len(person) / n,
            upper / max(letters, 1), (text.count("!") + text.count("?")) / chars,
            (chars - letters - text.count(" ")) / chars, len(bare) / n,
            float(sum(b in INSULTS or learned.weight(b) > 0 for b in bare)),
            len(_RUN.findall(low)) / n, math.log1p(len(words))]


def _near(first: list[int], second: list[int]) -> int:
    """Elements of `first` with one of `second` at most NEAR away; both ascend."""
    count = j = 0
    for i in first:
        while j < len(second) and second[j] < i - NEAR:
            j += 1
        count += j < len(second) and second[j] <= i + NEAR
    return count


def learn_lexicon(texts: DataFrame, most_words: int = 500, least_share: float = 0.01,
                  least_ratio: float = 8.0) -> dict[str, float]:
    """Weights of words, and of word beginnings (written with a star) of STEMS letters.

    A text counts each of its different words once. Taken are words and beginnings that are
    `least_ratio` times as frequent in texts with label 1, and stand in `least_share` of those
    texts and in three. The weight is the root of the likelihood ratio, so words seen often
    weigh more. `most_words` bounds the dictionary, not the texts.
    """
    def count(batch):
        uses = {0: Counter(), 1: Counter()}
        held, total = Counter(), Counter()
        for text, label in zip(batch["text"], batch["label"]):
            words = set(_WORD.findall((text or "").lower()))
            own = Counter(words)
            own.update(w[:k] + "*" for w in words for k in STEMS if len(w) > k)
            uses[label].update(own)
            total[label] += len(words)
            if label:
                held.update(own.keys())
        held["\0"] = sum(batch["label"])                # the totals go under a name no word has
        uses[0]["\0"], uses[1]["\0"] = total[0], total[1]
        names = list({*uses[0], *uses[1]})
        return {"word": names, "clean": [uses[0][w] for w in names],
                "toxic": [uses[1][w] for w in names], "held": [held[w] for w in names]}

    counts = map_columns(texts.select("text", "label"),
                         "word string, clean bigint, toxic bigint, held bigint", count)
    counts = counts.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("clean", "toxic", "held")])
    whole = counts.filter(F.col("word") == "\0").first()
    if whole is None or not whole["toxic"]:
        return {}
    ratio = ((F.col("toxic") + 0.5) / (whole["toxic"] + 1.0)) / ((F.col("clean") + 0.5) / (whole["clean"] + 1.0))
    weight = F.sqrt(2 * F.col("toxic") * F.log(ratio))
    best = (counts.filter((F.col("word") != "\0") & (ratio >= least_ratio)
                          & (F.col("held") >= max(3, least_share * whole["held"])))
            .select("word", weight.alias("weight")).orderBy(F.desc("weight"), "word").limit(most_words))
    return {r["word"]: r["weight"] for r in best.collect()}


@dataclass
class Toxicity:
    lexicon: dict[str, float]
    model: Boosted | None

    def score(self, docs: DataFrame, *columns: str) -> DataFrame:
        """The named columns of `docs` and `score`, 0 to 1. One pass without a shuffle."""
        rows = docs.select(*columns, featured(docs, self.lexicon).alias("features"))
        if self.model is None:
            return rows.withColumn("score", F.lit(0.0)).drop("features")
        return self.model.score(rows).drop("features")


def featured(docs: DataFrame, lexicon: dict[str, float]) -> Column:
    sent = share(docs.sparkSession, Lexicon(lexicon))

    @F.pandas_udf("array<double>")
    def make(texts: pd.Series) -> pd.Series:
        known = sent()
        return pd.Series([features(t or "", known) for t in texts])

    return make(docs["text"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, most_training: int = 20_000) -> Toxicity:
    """Learn from `labels` (doc_id, label 0/1) and the texts of `docs`.

    At most `most_training` labelled rows are used, those with the smallest hash of doc_id;
    rows with a null in either column are left out. Nothing but the text is an input. With
    labels of one class only, every score is 0. A null or empty text is scored like any other.
    Repeated rows are scored each; an empty table gives no row.
    """
    sample = bounded(labels.select("doc_id", F.col("label").cast("int").alias("label"))
                     .filter("doc_id IS NOT NULL AND label IN (0, 1)"), most_training, "doc_id")
    # bounded by most_training rows of two numbers
    texts = docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id", "label")), "doc_id")
    half = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(2))
    lexicon = learn_lexicon(texts.filter(half == 0))
    rows = texts.filter(half == 1).select("doc_id", "label", featured(texts, lexicon).alias("features"))
    return Toxicity(lexicon, fit_boosted(bounded(rows, most_training, "doc_id", "label"), ("doc_id",)))
