import gzip
import json

import pytest

from gleaner.operators import ingest
from gleaner.operators.sampling import sample_stats, sample_users
from gleaner.plans.runs import quality_run
from gleaner.sources import (
    category_paths,
    inventory_digest,
    read_interactions,
    read_metadata,
    read_reviews,
    read_table,
    source_inventory,
    write_by_year,
    write_table,
)


def _gz(path, lines):
    with gzip.open(path, "wt", encoding="utf-8") as out:
        out.write("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))


def _review(user, item, rating, ms, votes=0, verified=True, **more):
    return {"user_id": user, "parent_asin": item, "rating": rating, "timestamp": ms,
            "helpful_vote": votes, "verified_purchase": verified, "title": "t", **more}


@pytest.fixture
def raw(spark, tmp_path):
    _gz(tmp_path / "Toy.jsonl.gz", [
        _review("u1", "p1", 4, 1672531200000), _review("u1", "p1", 2, 1672617600000, 5),
        _review("u2", "p2", 5, 1672617600000, 1, False), _review("u3", "p3", 9, 1672617600000),
        "{broken", _review(None, "p1", 3, 1672617600000),
        _review("u4", "p4", 3, 1)])
    return read_reviews(spark, category_paths(spark, str(tmp_path), ["Toy"]))


def _maps(reviews):
    return [ingest.dense_ids(reviews, key, idx) for key, idx in (
        ("user_id", "user_idx"), ("parent_asin", "item_idx"), ("category", "category_idx"))]


def test_json_to_interactions(spark, raw, tmp_path):
    reviews = ingest.clean_reviews(raw)
    assert {r["category"] for r in reviews.collect()} == {"Toy"}
    table = ingest.encode_dedupe(reviews, *_maps(reviews))
    write_by_year(table, str(tmp_path / "interactions"))
    stored = read_interactions(spark, str(tmp_path / "interactions"))
    rows = sorted(tuple(r) for r in stored.select("user_idx", "item_idx", "rating", "ts",
                                                   "helpful_vote", "verified_purchase", "year").collect())
    assert rows == [(0, 0, 4, 1672531200, 0, True, 2023), (1, 1, 5, 1672617600, 1, False, 2023)]
    assert sorted(p.name for p in (tmp_path / "interactions").glob("year=*")) == ["year=2023"]
    stats = ingest.ingest_stats(reviews, stored).first()
    assert (stats["raw_rows"], stats["kept_rows"], stats["n_users"], stats["n_items"]) == (3, 2, 2, 2)
    assert (stats["first_date"], stats["last_date"]) == ("2023-01-01", "2023-01-02")
    listed = source_inventory(spark, [str(tmp_path / "interactions")])
    files = listed.collect()
    assert files and all(f["file_size"] > 0 and len(f["entry_sha256"]) == 64 for f in files)
    whole = inventory_digest(listed).first()
    assert whole["files"] == len(files) and whole == inventory_digest(listed.repartition(3)).first()


def test_rounding_caps_and_missing_votes(spark):
    rows = [("u", "a", 4.5, 1672531200999, 50_000, None, "c"),
            ("u", "b", 3.5, 1672531200500, None, True, "c"),
            ("u", "c", 0.5, 1672531200000, 1, True, "c"),
            ("u", "d", 5.0, 1704067200000, 2, True, "c"),
            ("u", "e", 5.0, 1704067200001, 2, True, "c")]
    raw = spark.createDataFrame(rows, "user_id string, parent_asin string, rating double, "
                                "timestamp bigint, helpful_vote bigint, verified_purchase boolean, "
                                "category string")
    got = {r["parent_asin"]: r for r in ingest.clean_reviews(raw).collect()}
    assert sorted(got) == ["a", "b", "d"]
    assert (got["a"]["rating"], got["a"]["ts"], got["a"]["helpful_vote"]) == (4, 1672531201, 32767)
    assert (got["b"]["rating"], got["b"]["ts"], got["b"]["helpful_vote"]) == (4, 1672531200, 32767)
    kept = {r["parent_asin"]: r for r in ingest.clean_reviews(raw, null_vote=None).collect()}
    assert kept["b"]["helpful_vote"] is None and kept["a"]["helpful_vote"] == 32767


def test_missing_attribute_comes_from_a_later_row(spark):
    rows = [("u", "p", 3.0, 1000000000000, 1, None, "c"), ("u", "p", 4.0, 1000000001000, 2, True, "c")]
    raw = spark.createDataFrame(rows, "user_id string, parent_asin string, rating double, "
                                "timestamp bigint, helpful_vote bigint, verified_purchase boolean, "
                                "category string")
    reviews = ingest.clean_reviews(raw)
    row = ingest.encode_dedupe(reviews, *_maps(reviews)).first()
    assert (row["rating"], row["helpful_vote"], row["verified_purchase"]) == (3, 1, True)


def test_dense_ids_are_complete_and_sorted(spark):
    names = spark.range(20_000).selectExpr("concat('n', lpad(cast(id * 7 % 15000 as string), 6, '0')) AS k")
    rows = ingest.dense_ids(names, "k", "i").orderBy("k").collect()
    assert [r["i"] for r in rows] == list(range(15_000))
    assert rows[0]["k"] == "n000000"
    again = ingest.dense_ids(names.repartition(7), "k", "i")
    assert again.exceptAll(ingest.dense_ids(names, "k", "i")).isEmpty()


def test_missing_files_are_named(spark, tmp_path):
    names = [f"Nothing{n}" for n in range(7)]
    with pytest.raises(FileNotFoundError, match=r"7 source files.*Nothing0.jsonl.gz.*Nothing6.jsonl.gz"):
        category_paths(spark, str(tmp_path), names)


def test_items(spark, tmp_path):
    _gz(tmp_path / "meta_Toy.jsonl.gz", [
        {"parent_asin": "p1", "main_category": "Toys", "store": "Acme", "price": "$1,299.50"},
        {"parent_asin": "p2", "main_category": None, "store": "Zeta", "price": 12.5},
        {"parent_asin": "p3", "main_category": "Toys", "price": "None"},
        {"parent_asin": "p9", "main_category": "Games", "store": "Acme", "price": ""},
        {"main_category": "Toys"}])
    raw = read_metadata(spark, category_paths(spark, str(tmp_path), ["Toy"], prefix="meta_"))
    metadata = ingest.clean_metadata(raw)
    item_map = spark.createDataFrame([("p1", 0), ("p2", 1), ("p3", 2)], "parent_asin string, item_idx int")
    items = ingest.build_items(metadata, item_map, ingest.metadata_maps(metadata))
    write_table(items, str(tmp_path / "items"))
    stored = read_table(spark, str(tmp_path / "items"))
    assert sorted(tuple(r) for r in stored.collect()) == [
        (0, 1, 0, 1299.5), (1, None, 1, 12.5), (2, 1, None, None)]
    stats = ingest.item_stats(metadata, stored).first()
    assert (stats["raw_rows"], stats["matched_rows"], stats["unmatched_rows"]) == (4, 3, 1)
    assert (stats["with_price"], stats["with_store"], stats["n_categories"], stats["n_stores"]) == (2, 2, 1, 2)
    with pytest.raises(ValueError):
        ingest.build_items(metadata, None, {})


@pytest.fixture
def thousand(spark):
    return spark.range(10_000).selectExpr(
        "cast(id div 10 as int) AS user_idx", "cast((id div 10 * 7 + id % 10) % 500 as int) AS item_idx",
        "1577836800 + id % 2 * 31622400 AS ts", "cast(2020 + id % 2 as int) AS year",
        "cast(1 AS smallint) AS category_idx", "cast(5 AS tinyint) AS rating", "true AS verified_purchase")


def test_sample_keeps_whole_users(thousand):
    sample = sample_users(thousand, 0.2)
    assert {r["count"] for r in sample.groupBy("user_idx").count().collect()} == {10}
    stats = sample_stats(thousand, sample).first()
    assert stats["source_users"] == 1000 and stats["source_interactions"] == 10_000
    assert 0.15 < stats["actual_user_fraction"] < 0.25
    assert sample.exceptAll(thousand).isEmpty() and sample.select("year").distinct().count() == 2


def test_sample_depends_on_the_seed_only(thousand):
    def users(seed, table=thousand):
        return {r[0] for r in sample_users(table, 0.2, seed).select("user_idx").distinct().collect()}

    assert users(1) == users(1, thousand.repartition(5)) and users(1) != users(2)
    for bad in (0, 1, -0.1, 1.5):
        with pytest.raises(ValueError):
            sample_users(thousand, bad)


def test_quality_run_sections(thousand):
    report = quality_run(thousand)
    assert report["scale"].first()["users"] == 1000
    assert report["anomalies"].first()["year_mismatch"] == 0
    assert report["user_activity"].first()["users_10_49"] == 1000
    assert report["yearly_volume"].count() == 2


def test_lines_are_counted_by_the_scan_that_cleans_them(spark, tmp_path):
    good = {"user_id": "u", "parent_asin": "p", "rating": 4.0, "timestamp": 1_500_000_000_000, "helpful_vote": 1,
            "verified_purchase": True}
    lines = [json.dumps({**good, "user_id": f"u{n}"}) for n in range(7)]
    lines += ['{"rating": ', "no json", json.dumps({**good, "rating": 9.0}), "", json.dumps({**good, "user_id": None})]
    with gzip.open(tmp_path / "Toy.jsonl.gz", "wt") as f:
        f.write("\n".join(lines))
    reviews, counts = ingest.counted_reviews(spark, category_paths(spark, str(tmp_path), ["Toy"]))
    assert reviews.count() == 7
    row = counts.first()
    assert (row["lines"], row["broken_lines"], row["kept_rows"]) == (11, 2, 7)
    assert row["removed_pct"] == pytest.approx(100 * 4 / 11)
    with gzip.open(tmp_path / "None.jsonl.gz", "wt") as f:
        f.write("")
    empty = ingest.counted_reviews(spark, category_paths(spark, str(tmp_path), ["None"]))[1].first()
    assert tuple(empty) == (0, 0, 0, None)


def test_lines_are_sorted_behind_their_shuffle(spark):
    """De-duplication sorts its structs once, in the partitions of the pairs."""
    reviews = ingest.clean_reviews(spark.createDataFrame(
        [("u", "p", 4.0, 1_500_000_000_000 - n, None, True, "A") for n in range(3)],
        "user_id string, parent_asin string, rating double, timestamp bigint, helpful_vote bigint, "
        "verified_purchase boolean, category string"))
    table = ingest.encode_dedupe(reviews, *_maps(reviews))
    text = table._jdf.queryExecution().executedPlan().toString()
    assert text.rindex("SortAggregate") < text.index("REPARTITION_BY_COL")
    assert table.count() == 1


def test_category_is_taken_from_the_names_without_a_pattern(spark, raw):
    """A pattern over the path of every row took most of the scan's time."""
    from pyspark.sql import functions as F

    from gleaner.sources.readers import _category

    names = {"a/Toy.jsonl.gz": "Toy", "a/Toy.jsonl.gz/part-0.txt.gz": "Toy", "a/x.jsonl.gz/y.jsonl.gz": "x",
             "a/To%20ys+b.jsonl.gz/p": "To ys b", ".jsonl.gz/q.jsonl.gz": "q", "x.jsonl.gz/a/b": "", "a/.jsonl.gz": "",
             "Toy.jsonl.gz.jsonl.gz/p": "Toy.jsonl.gz"}
    paths = spark.createDataFrame([(n,) for n in names], "path string")
    got = {r["path"]: r["category"] for r in paths.withColumn("category", _category(F.col("path"))).collect()}
    assert got == names
    assert "regexp" not in raw._jdf.queryExecution().executedPlan().toString()


def test_rows_in_even_partitions_are_not_moved_again(spark, tmp_path):
    from gleaner.plans.catalog import Workbench

    rows = spark.createDataFrame([(n % 7, n % 11, 946684800 + n * 86400 * 30, 2000 + n % 3) for n in range(77)],
                                 "user_idx int, item_idx int, ts bigint, year int").repartition(3, "user_idx", "item_idx")
    w = Workbench(spark, "unused")
    stored = {on: w._stored(rows, "even", rebalance=on) for on in (False, True)}
    same = [sorted(map(tuple, t.select("user_idx", "item_idx", "ts", "year").collect())) for t in stored.values()]
    assert same[0] == same[1] and len(same[0]) == 77
    # a file for each of the three partitions and three years; with the hint a year is gathered
    assert len(stored[False].inputFiles()) == 9 and len(stored[True].inputFiles()) < 9
