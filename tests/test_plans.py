"""Physical plans and results when one key dominates."""
import random

from conftest import ranked
from pyspark.sql import functions as F

from gleaner.functions import top_k
from gleaner.operators.als import ImplicitALS
from gleaner.operators.category import CategoryPopularity
from gleaner.operators.covisitation import CoVisitation
from gleaner.operators.popularity import Popularity
from gleaner.operators.splits import before, unix
from gleaner.session import snapshot

CUT = unix("2023-06-01")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_group_limit_reaches_below_the_shuffle(interactions):
    rows = interactions([(1, n, "2023-05-01") for n in range(20)])
    text = plan(top_k(rows, ["user_idx"], [F.desc("ts"), F.asc("item_idx")], 2_000))
    assert text.count("WindowGroupLimit") == 2
    text = plan(CoVisitation().baskets(rows, CUT))
    assert text.count("WindowGroupLimit") == 2 and text.count("Exchange") == 1


def test_no_single_partition_exchange(interactions, histories, spark):
    table = snapshot(interactions([(u, i, "2023-05-01") for u in range(9) for i in range(6)]), "t")
    h = histories({u: [1, 2] for u in range(9)})
    for model in (Popularity(), CoVisitation()):
        assert "SinglePartition" not in plan(model.fit(table, CUT).recommend(h, 4))


def test_popularity_is_a_top_k_not_a_sort(interactions):
    text = plan(Popularity().ranked(interactions([(1, 1, "2023-05-01")]), CUT))
    assert "TakeOrderedAndProject" in text


def test_filters_and_columns_reach_the_scan(interactions):
    table = snapshot(interactions([(1, 1, "2023-05-01", 3)], category=True), "t")
    text = plan(before(table, CUT, 90).groupBy("item_idx").count())
    assert "PushedFilters: [IsNotNull(ts), LessThan(ts," in text and "GreaterThanOrEqual(ts," in text
    assert "ReadSchema: struct<item_idx:int,ts:bigint>" in text


def test_fusion_moves_the_candidates_once(lists):
    from gleaner.operators import fusion

    channels = {"a": lists({0: [1, 2]}), "b": lists({0: [2, 3]})}
    for fused in (fusion.round_robin(channels, 2), fusion.weighted_rrf(channels, 2)):
        assert plan(fused).count("Exchange hashpartitioning") == 1


def test_top_k_of_a_hot_group_in_parts(spark):
    """90% of the rows share a group; the spread ranking equals the plain one."""
    rows = spark.range(6000).select(
        F.when(F.col("id") % 10 > 0, 0).otherwise(F.col("id") % 7).alias("g"),
        F.pmod(F.xxhash64("id"), F.lit(50)).alias("v"), F.col("id").alias("i"))
    order = [F.desc("v"), F.asc("i")]
    plain, spread = (top_k(rows, ["g"], order, 40, spread_by=s) for s in (None, ["i"]))
    assert plain.exceptAll(spread).isEmpty() and spread.exceptAll(plain).isEmpty()
    assert plain.filter("g = 0").count() == 40


def test_channels_with_a_hot_user_and_a_hot_item(interactions, histories):
    """One user and one item hold about a third of the rows each."""
    rng = random.Random(4)
    rows = [(0, i, "2023-05-01") for i in range(300)]
    rows += [(u, 7, "2023-05-02") for u in range(1, 300)]
    rows += [(rng.randrange(1, 60), rng.randrange(8, 300), "2023-05-03") for _ in range(300)]
    rows = list(dict.fromkeys(rows))
    table = interactions(rows)
    owned = {}
    for u, i, _ in rows:
        owned.setdefault(u, []).append(i)
    model = CoVisitation(max_items_per_user=20, min_cooccurrence=1).fit(table, CUT)
    latest = {u: sorted(set(items), key=lambda i, u=u: (
        -max(unix(d) for a, b, d in rows if (a, b) == (u, i)), i))[:20]
        for u, items in list(owned.items())}
    baskets = {r["user_idx"]: r["items"] for r in model.baskets(table, CUT).collect()}
    assert {u: sorted(b) for u, b in baskets.items()} == {u: sorted(b) for u, b in latest.items()}
    got = ranked(Popularity().fit(table, CUT).recommend(histories(owned), 5))
    counts = {}
    for _, i, _ in rows:
        counts[i] = counts.get(i, 0) + 1
    order = sorted(counts, key=lambda i: (-counts[i], i))
    for user, items in owned.items():
        assert got.get(user, []) == [i for i in order if i not in items][:5]
    kept = {tuple(r) for r in ImplicitALS(min_user_interactions=3, min_item_interactions=4)
            .training_rows(table, CUT).collect()}
    good = {i for i, n in counts.items() if n >= 4}
    of_user = {}
    for u, i, _ in rows:
        if i in good:
            of_user[u] = of_user.get(u, 0) + 1
    assert kept == {(u, i) for u, i, _ in rows if i in good and of_user[u] >= 3}


def test_covisitation_joins_whole_neighbour_lists(interactions, histories):
    """The join moves a row per source; neighbours are opened behind it and combined before
    their shuffle."""
    rows = [(u, i, "2023-05-01") for u in range(40) for i in range(u % 7, 30, 1 + u % 3)]
    model = CoVisitation(min_cooccurrence=1).fit(interactions(rows), CUT)
    assert model.lists.count() == model.graph.select("src").distinct().count()
    opened = {(r["src"], e["item_idx"]): e["score"] for r in model.lists.collect() for e in r["near"]}
    assert opened == {(r["src"], r["dst"]): r["score"] for r in model.graph.collect()}
    for r in model.lists.collect():
        assert r["near"] == sorted(r["near"], key=lambda e: (-e["score"], e["item_idx"]))
    text = plan(model.recommend(histories({0: [1, 2], 1: [5]}), 4))
    lines = text.splitlines()
    generate = next(n for n, line in enumerate(lines) if "Generate inline" in line)
    assert any("partial_sum" in line for line in lines[:generate])


def test_first_purchases_are_sorted_once(spark, tmp_path):
    """Lines are combined behind their shuffle; no task sorts all lines of a file before it."""
    from datetime import datetime

    from gleaner.sources import warehouse

    tables = {"lineitem": ([(n, 1, n, float(n), "N") for n in (1, 2, 3)],
                           "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double, l_returnflag string"),
              "orders": ([(n, 5, datetime(2000, 1, 4 - n), "1-URGENT") for n in (1, 2, 3)],
                         "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp, o_orderpriority string"),
              "part": ([(1, "LARGE")], "p_partkey bigint, p_type string")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    table = warehouse.interactions(spark, str(tmp_path))
    text = plan(table)
    assert text.rindex("SortAggregate") < text.index("REPARTITION_BY_COL")
    assert [(r["user_idx"], r["item_idx"], r["rating"]) for r in table.collect()] == [(5, 1, 3)]


def test_entries_of_category_lists_are_not_moved(interactions, histories):
    """A list is made where its entries are; users are dealt to all partitions before the fan-out."""
    rows = [(u, i, "2023-05-01", i % 3) for u in range(30) for i in range(u % 5, 40, 1 + u % 3)]
    model = CategoryPopularity().fit(interactions(rows, category=True), CUT)
    recs = model.recommend(histories({0: [1, 2], 1: [5], 2: [7, 8, 9]}), 4)
    lines = plan(recs).splitlines()
    generate = next(n for n, line in enumerate(lines) if "Generate inline" in line)
    depth = len(lines[generate]) - len(lines[generate].lstrip(" :+-"))
    above = [line for line in lines[:generate]
             if "Exchange hashpartitioning" in line and len(line) - len(line.lstrip(" :+-")) < depth]
    assert not above
    assert any("REPARTITION_BY_NUM" in line for line in lines[generate:])
    assert recs.groupBy("user_idx").count().count() == 3


def test_baskets_are_dealt_out_before_their_pairs(interactions):
    model = CoVisitation(min_cooccurrence=1)
    rows = [(u, i, "2023-05-01") for u in range(6) for i in range(4)]
    text = plan(model.pairs(snapshot(model.baskets(interactions(rows), CUT), "baskets")))
    assert "REPARTITION_BY_NUM" in text[text.index("Generate"):]
    assert {(r["lo"], r["hi"], r["cnt"]) for r in model.pairs(model.baskets(interactions(rows), CUT)).collect()} == {
        (a, b, 6) for a in range(4) for b in range(a + 1, 4)}


def test_partitions_hold_few_packed_bytes(spark):
    """Lists pack to some bytes a row; partitions are kept small enough for their sorts."""
    from gleaner.session import prepare

    session = prepare(spark.newSession())
    assert session.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "8m"
    assert session.conf.get("spark.sql.files.maxPartitionBytes") == "16m"


def test_a_channel_is_made_without_the_others(spark):
    """One channel's list, and the hits of two lists, make only what they consist of."""
    from gleaner.plans.catalog import Workbench

    w = Workbench(spark, "/root/testdata/sf0.001")
    w.list_of("category_popularity")
    assert not {"popularity", "covisitation"} & set(vars(w))
    w.found_in("popularity")
    assert "covisitation" not in vars(w)
    w.found_in("popularity", "weighted_rrf")
    assert set(w._made) == {("recs", name) for name in (*w.lists, "weighted_rrf")} | {
        ("found", name) for name in ("popularity", "weighted_rrf")}
