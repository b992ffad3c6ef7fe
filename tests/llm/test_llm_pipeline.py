import corpus_pipeline
from odd import documents, odd_rows, words

from gleaner.llm import minhash as M
from gleaner.session import snapshot

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_run_against_plain_rules(spark, tmp_path):
    """Planted cases: junk goes, one copy stays, benchmark text goes, personal data are covered."""
    good = [(n, " ".join(words(n, 60)), f"s{n % 2}") for n in range(1, 200)]
    item = " ".join(words(999, 14))
    junk = [(n, " ".join(w.upper() + "!!" for w in words(n, 60)), "s0") for n in range(300, 340)]
    near = [(400 + n, good[5][1] + f" x{n}", "s0") for n in range(3)]
    rows = good + junk + near + [(500, good[6][1], "s1"), (501, good[7][1] + " " + item, "s1"),
                                 (502, " ".join(words(77, 40)) + " me@mail.example.com", "s0"),
                                 (503, None, "s0"), (504, "", None)]
    documents(spark, odd_rows()[:0] + rows).select(*COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, int(d < 300)) for d, *_ in rows if d % 3 or d >= 300 and d % 2],
                          "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r["doc_id"] for r in got}
    text = {r["doc_id"]: r["text"] for r in got}
    assert not ids & {d for d, *_ in junk} and not ids & {400, 401, 402, 500, 501}
    assert 502 not in text or text[502].endswith("[EMAIL]")
    assert all(r["copy"] <= r["copies"] <= 2 and r["taken"] == r["copies"] * r["size"] for r in got)
    # what is there is whole, and each use is a row
    assert all(text[d] == t for d, t, _ in good if d in text)
    assert len(got) == sum({r["doc_id"]: r["copies"] for r in got}.values())
    assert len(ids) >= 0.8 * len(good)


def test_stages_keep_columns_and_take_odd_rows(spark, tmp_path):
    docs = documents(spark, odd_rows()).select(*COLUMNS)
    spark.createDataFrame([], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for start in (docs, docs.filter("false")):
        rows = start
        for name, stage in corpus_pipeline.STAGES:
            rows = snapshot(stage(spark, rows, str(tmp_path)), f"test-{name}")
            if name != "mixing":
                assert rows.columns == COLUMNS
            if name == "near_duplicates" and start is docs:
                assert rows.count() == len(odd_rows()) - 1       # the repeated row
    assert M.SHINGLE == 5 and len(corpus_pipeline.STAGES) == 5


CLASHES = ["row", "digest", "_text", "_doc", "_digest", "_marks", "hit_id", "print", "id", "covered", "kept", "class_id",
           "q_score", "p_text", "meta", "label", "copy", "copies", "_key", "_of", "_want", "items", "features"]


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    rows = [(n, " ".join(words(n, 30)) + (" me@mail.example.com" if n == 3 else ""), "en", f"s{n % 2}", 100, *["x"] * len(CLASHES))
            for n in range(1, 12)]
    docs = spark.createDataFrame([*rows, rows[0]], ", ".join(
        ["doc_id bigint, text string, lang string, source string, n_chars bigint", *(f"`{c}` string" for c in CLASHES)]))
    spark.createDataFrame([(n, n % 2) for n in range(1, 12)], "doc_id bigint, quality int").write.parquet(
        f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(words(5, 30)))], "item_id bigint, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = snapshot(stage(spark, docs, str(tmp_path)), f"test-{name}")
        assert set(docs.columns) <= set(out.columns)
        for r in out.collect():
            assert all(r[c] == "x" for c in CLASHES if name != "mixing" or c not in ("copy", "copies"))
        if name != "mixing":
            assert out.columns == docs.columns
        if name == "near_duplicates":
            assert out.count() == 11
        if name == "decontamination":
            assert 5 not in {r["doc_id"] for r in out.collect()} and out.count() == 11
        if name == "personal_data":
            covered = {r["doc_id"]: r for r in out.collect()}[3]
            assert covered["text"].endswith("[EMAIL]") and covered["n_chars"] == len(covered["text"])
