"""Personal data: spans proposed with high recall, scored by boosted trees, then redacted.

Strict patterns give the base spans, which always stay. Looser generators propose further,
partly overlapping spans: matches of the base patterns that fail their check, spelled-out
addresses, national phone numbers, short card numbers and bank accounts. Trees over format
and context features score those, and the ones above a calibrated threshold are added.

No table labels personal data, so the trees learn from the base spans as positives, from
copies of them broken in place (a wrong check digit, an octet above 255, too few digits) as
negatives, and from the loose proposals by their checksums and context words.
"""
from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.boosting import bounded, fit_boosted
from gleaner.llm.common import by_value, map_columns
from gleaner.llm.spans import digest, joined
from gleaner.session import snapshot

by_value(__name__)

KINDS = ("email", "ip", "card", "phone", "iban")      # the first four are the base
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# the looks behind keep long digit runs linear; a match cannot begin inside a run of digits
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SPELLED = re.compile(r"[(\[] ?at ?[)\]]", re.I)
_SPELLED_DOMAIN = re.compile(r" ?[A-Za-z0-9-]{1,63}( ?([(\[] ?dot ?[)\]]|\.) ?[A-Za-z0-9-]{1,63}){1,4}", re.I)
_NATIONAL = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_IBAN = re.compile(r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}( ?[A-Z0-9]{4}){2,7}( ?[A-Z0-9]{1,3})?(?![A-Z0-9])")
_CONTEXT = {
    "email": re.compile(r"mail|contact|kontakt|correo|courriel|write to", re.I),
    "ip": re.compile(r"\bip\b|address|host|server|adresse|direcci", re.I),
    "card": re.compile(r"card|karte|tarjeta|carte|visa|credit|kredit", re.I),
    "phone": re.compile(r"phone|\btel|call|fax|mobil|anruf|rufen|llam|appel", re.I),
    "iban": re.compile(r"iban|account|konto|cuenta|compte|bank|banque|banco", re.I),
}
SIDE = 40             # characters of context on either side


def luhn(digits: str) -> bool:
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = int(c) * (1 + n % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(value: str) -> str:
    return "".join(c for c in value if "0" <= c <= "9")


def valid(kind: str, value: str) -> bool:
    """Whether a match of a kind's base pattern is kept; for other forms, their own check."""
    if kind == "email":
        return "@" in value or "dot" in value.lower()
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in value.split("."))
    digits = _digits(value)
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return value[:1] == "+" and 8 <= len(digits) <= 15
    packed = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1


def _emails(text: str):
    """Leftmost matches, found from each @ so that long runs of letters stay linear."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(done, at + 1))


def proposals(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, by kind as listed and start, and further proposals."""
    base, loose = [("email", *x) for x in _emails(text)], []
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        for m in pattern.finditer(text):
            if valid(kind, m[0]):
                base.append((kind, *m.span()))
            elif kind != "card" or len(_digits(m[0])) >= 13:
                loose.append((kind, *m.span()))
    done = 0
    for m in _SPELLED.finditer(text):
        end, start = _SPELLED_DOMAIN.match(text, m.end()), m.start()
        start -= start > done and text[start - 1] == " "
        tail = start
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if end and start < tail:
            loose.append(("email", start, end.end()))
            done = end.end()
    loose += [("phone", *m.span()) for m in _NATIONAL.finditer(text)]
    loose += [("iban", *m.span()) for m in _IBAN.finditer(text)]
    return base, loose


def broken(kind: str, value: str) -> str:
    """A span like `value` that is not personal data."""
    if kind == "email":
        return value.replace("@", " ")
    if kind == "ip":
        return value.rpartition(".")[0] + ".999"
    if kind == "card":
        return value[:-1] + str((int(value[-1]) + 1) % 10)
    return value[:6]


def features(kind: str, value: str, before: str, after: str) -> list[float]:
    """Format of the span and what stands around it."""
    digits = _digits(value)
    near = before[-SIDE:] + " " + after[:SIDE]
    out = [float(kind == k) for k in KINDS]
    out += [float(bool(p.search(near))) for p in _CONTEXT.values()]
    out += [len(value), len(digits), len(set(digits)), sum(c in " ().-" for c in value),
            float(value[:1] == "+"), float("@" in value), float(valid(kind, value)),
            float(13 <= len(digits) <= 19 and luhn(digits)), float(before[-1:].isalnum()),
            float(after[:1].isalnum()), sum(c.isdigit() for c in near) / max(len(near), 1)]
    return [float(x) for x in out]


def _likely(kind: str, value: str, before: str, after: str) -> int:
    """Weak label of a loose proposal: its own check holds and the context names the kind."""
    sound = (kind in ("email", "iban") and valid(kind, value)
             or kind == "card" and luhn(_digits(value)) or kind == "phone" and value[:1] != "+")
    return int(sound and bool(_CONTEXT[kind].search(before[-SIDE:] + " " + after[:SIDE])))


def personal_data(docs: DataFrame, threshold: float = 0.9, most_training: int = 20_000) -> DataFrame:
    """doc_id, digest (xxhash64 of the text) and `found`: (kind, start, stop, base, score).

    Base spans have score 1. Loose proposals with a calibrated probability of `threshold` or
    more are added, unless they overlap a base span or a higher-scored addition. The trees
    are fitted on at most `most_training` examples; every document is searched and every
    proposal scored. Without examples of both classes nothing is added.

    Null and empty texts have no spans. Repeated rows are answered each; an empty table gives
    no row. Only doc_id and text are read.
    """
    span = "struct<kind:string,start:int,stop:int>"

    def scan(batch):
        out = {"doc_id": batch["doc_id"], "digest": batch["digest"], "base": [], "loose": [], "train": []}
        for text in batch["text"]:
            text = text or ""
            base, loose = proposals(text)
            train, more = [], []
            for kind, s, e in base:
                sides = text[max(0, s - SIDE):s], text[e:e + SIDE]
                train.append({"features": features(kind, text[s:e], *sides), "label": 1})
                train.append({"features": features(kind, broken(kind, text[s:e]), *sides), "label": 0})
            for kind, s, e in loose:
                sides = text[max(0, s - SIDE):s], text[e:e + SIDE]
                vector = features(kind, text[s:e], *sides)
                train.append({"features": vector, "label": _likely(kind, text[s:e], *sides)})
                more.append({"kind": kind, "start": s, "stop": e, "features": vector})
            out["base"].append([{"kind": k, "start": s, "stop": e} for k, s, e in base])
            out["loose"].append(more)
            out["train"].append(train)
        return out

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = snapshot(map_columns(
        docs.select("doc_id", "text", F.xxhash64("text").alias("digest")),
        f"doc_id {kind}, digest bigint, base array<{span}>,"
        " loose array<struct<kind:string,start:int,stop:int,features:array<double>>>,"
        " train array<struct<features:array<double>,label:int>>", scan)
        .withColumn("_row", F.monotonically_increasing_id()), "pii-proposals")
    sample = bounded(rows.select("doc_id", "digest", F.explode("train").alias("t"))
                     .select("doc_id", "digest", "t.*"), most_training, "doc_id", "digest", "features")
    model = fit_boosted(sample, ("doc_id", "digest"))
    kept = F.transform("base", lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"),
        F.lit(True).alias("base"), F.lit(1.0).alias("score")))
    if model is None:
        return rows.select("doc_id", "digest", kept.alias("found"))
    added = (model.score(rows.select("_row", F.explode("loose").alias("s")).select("_row", "s.*"))
             .filter(F.col("score") >= threshold)
             .groupBy("_row").agg(F.collect_list(F.struct(
                 "kind", "start", "stop", F.lit(False).alias("base"), "score")).alias("added")))
    both = rows.join(added, "_row", "left").select(
        "doc_id", "digest", kept.alias("base"), F.coalesce("added", F.array().cast(
            added.schema["added"].dataType)).alias("added"))

    def settle(batch):
        out = []
        for base, more in zip(batch["base"], batch["added"]):
            taken = list(base)
            for s in sorted(more, key=lambda s: (-s["score"], s["start"], s["stop"], s["kind"])):
                if all(s["stop"] <= t["start"] or t["stop"] <= s["start"] for t in taken):
                    taken.append(s)
            out.append(taken)
        return {"doc_id": batch["doc_id"], "digest": batch["digest"], "found": out}

    return map_columns(both, f"doc_id {kind}, digest bigint, found array<struct<kind:string,"
                       "start:int,stop:int,base:boolean,score:double>>", settle)


def personal_digest(found: DataFrame) -> DataFrame:
    """Counts, digest and joined spans of `personal_data`, by kind as listed and start."""
    def write(batch):
        out = {c: [] for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")}
        for spans in batch["found"]:
            spans = sorted(spans, key=lambda s: (KINDS.index(s["kind"]), s["start"]))
            every = [(s["kind"], s["start"], s["stop"]) for s in spans]
            base = [x for x, s in zip(every, spans) if s["base"]]
            for k in KINDS[:4]:
                out[f"n_{k}"].append(sum(x[0] == k for x in base))
            out["base_sha256"].append(digest(base))
            out["spans"].append(joined(every))
        return {"doc_id": batch["doc_id"], **out}

    kind = found.schema["doc_id"].dataType.simpleString()
    return map_columns(found, f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint,"
                       " n_phone bigint, base_sha256 string, spans string", write)


def redact(docs: DataFrame, found: DataFrame) -> DataFrame:
    """`docs` with every found span replaced by its kind in brackets; n_chars follows the text.

    Columns and rows stay as they are otherwise.
    """
    marks = (found.filter(F.size("found") > 0).dropDuplicates(["doc_id", "digest"])
             .select(F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest"), F.transform(
                 F.array_sort(F.transform("found", lambda s: F.struct(
                     s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind")))),
                 lambda s: F.concat_ws(":", s["start"], s["stop"], s["kind"])).alias("_marks")))

    def cover(batch):
        out = []
        for text, spans in zip(batch["text"], batch["marks"]):
            parts, done = [], 0
            for start, stop, kind in (m.split(":") for m in spans or ()):
                start, stop = int(start), int(stop)
                if start >= done:
                    parts += [text[done:start], f"[{kind.upper()}]"]
                done = max(done, stop)
            out.append("".join(parts) + text[done:] if spans else text)
        return out

    @F.pandas_udf("string")
    def covered(text: pd.Series, marks: pd.Series) -> pd.Series:
        return pd.Series(cover({"text": text, "marks": [None if m is None else list(m) for m in marks]}))

    # whole rows travel as one column, so that no input column meets a name used here
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), "text",
                       F.xxhash64("text").alias("print"))
    marked = rows.join(marks, F.col("id").eqNullSafe(F.col("_doc")) & (F.col("print") == F.col("_digest")), "left")
    hit = F.col("_marks").isNotNull()
    plain = marked.withColumn("covered", F.when(hit, covered("text", "_marks")).otherwise(F.col("text")))

    def kept(name: str) -> Column:
        if name == "text":
            return F.col("covered").alias(name)
        if name == "n_chars":
            return F.when(hit, F.length("covered").cast(docs.schema[name].dataType)).otherwise(F.col("row")[name]).alias(name)
        return F.col("row")[name].alias(name)

    return plain.select(*map(kept, docs.columns))
