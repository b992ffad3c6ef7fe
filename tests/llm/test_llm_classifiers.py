import random

from odd import documents, odd_rows, words

from gleaner.llm.quality import fit_quality
from gleaner.llm.toxicity import Lexicon, features, fit_toxicity


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, label int")


def test_toxicity_on_documents_held_out(spark):
    rng = random.Random(4)
    rows, truth = [], {}
    for n in range(1000, 1500):
        text, toxic = words(n, rng.randint(20, 80)), n % 4 == 0
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["zorgo", "blixt", "blixter", "idiot"]))
        rows.append((n, " ".join(text), "a"))
        truth[n] = int(toxic)
    known = [(n, t) for n, t in truth.items() if n % 5] + [(None, 1), (1000, None)]
    docs = documents(spark, odd_rows(rows))
    model = fit_toxicity(docs, labels(spark, known))
    got = model.score(docs, "doc_id").collect()
    assert len(got) == len(rows) + len(odd_rows()) and all(0 <= r["score"] <= 1 for r in got)
    held = [(r["doc_id"], r["score"]) for r in got if r["doc_id"] in truth and r["doc_id"] % 5 == 0]
    right = sum((s >= 0.5) == bool(truth[d]) for d, s in held)
    assert right >= 0.95 * len(held)
    assert fit_toxicity(docs, labels(spark, [])).score(docs, "doc_id").filter("score > 0").count() == 0
    assert model.score(documents(spark, []), "doc_id").count() == 0


def test_features_of_odd_texts():
    lexicon = Lexicon({"zorgo": 3.0, "blix*": 2.0})
    for text in ("", " ", "!!!", "a" * 100_000, "a1" * 50_000, "you z0rg0 YOU", "blixtering"):
        assert len(features(text, lexicon)) == 17
    assert lexicon.weight("blixtering") == 2.0 and lexicon.weight("bli") == 0.0
    assert features("you are z0rgo", lexicon)[14] == 1.0


def test_quality_keeps_clean_documents(spark):
    rng = random.Random(6)
    rows, truth = [], {}
    for n in range(2000, 2500):
        text, good = words(n, rng.randint(30, 90)), n % 5 > 0
        if not good:
            text = [w.upper() + "!!" for w in text] if n % 2 else [text[0]] * 60
        rows.append((n, " ".join(text), f"s{n % 3}"))
        truth[n] = int(good)
    docs = documents(spark, odd_rows(rows))
    model = fit_quality(docs, labels(spark, [(n, t) for n, t in truth.items() if n % 3] + [(7, None)]), rounds=2)
    got = {r["doc_id"]: r["q_score"] for r in model.score(docs).collect()}
    held = [n for n in truth if n % 3 == 0]
    assert sum((got[n] >= 0.5) == bool(truth[n]) for n in held) >= 0.97 * len(held)
    assert model.score(docs).count() == docs.count() and "n_tokens" in model.score(docs).columns
    none = fit_quality(docs, labels(spark, [(2001, 1)]))
    assert none.score(docs).filter("q_score < 1").count() == 0
    assert model.score(documents(spark, [])).count() == 0
