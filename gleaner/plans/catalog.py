"""Every operator as a named query over the warehouse tables."""
from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property, reduce, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import bootstrap, diagnostics, fusion, ingest, metrics, quality
from gleaner.operators import splits as S
from gleaner.operators.als import ImplicitALS
from gleaner.operators.candidates import item_weights
from gleaner.operators.category import CategoryPopularity
from gleaner.operators.content import Content
from gleaner.operators.covisitation import CoVisitation
from gleaner.operators.daily import DailyCounts
from gleaner.operators.popularity import Popularity
from gleaner.operators.products import above
from gleaner.operators.sampling import sample_stats, sample_users
from gleaner.plans import runs
from gleaner.session import prepare, shared_folder, snapshot
from gleaner.sources import (
    category_paths,
    inventory_digest,
    read_interactions,
    read_metadata,
    read_reviews,
    read_table,
    source_inventory,
    warehouse,
    write_by_year,
    write_table,
)

K = 50
KS = (10, 50)
SPLIT = warehouse.WAREHOUSE_SPLIT
# items held back from the past, so that there are cold ones at the cutoff
HELD_BACK = 10
WINDOWS = {
    "2000-q1": S.TimeSplit.of("2000-01-01", "2000-04-01", "2000-07-01"),
    "2000-q3": S.TimeSplit.of("2000-07-01", "2000-10-01", "2001-01-01"),
}
# the data end on 2001-08-01, so the last period is empty
GAP = S.TimeSplit.of("2001-01-01", "2001-08-02", "2001-10-01")
CHANNELS = ("popularity", "covisitation", "category_popularity")
FUSIONS = ("round_robin", "weighted_rrf")
RRF_WEIGHTS = (1.0, 1.0, 0.25)
SAMPLE_FRACTION = 0.3
SAMPLED_USERS = 50


class Workbench:
    """Stored tables and fitted channels over one set of warehouse files, made on first use."""

    _open: dict[tuple[str, str], Workbench] = {}

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    @classmethod
    def of(cls, spark: SparkSession, folder: str) -> Workbench:
        key = (spark.sparkContext.applicationId, folder)
        if key not in cls._open:
            cls._open[key] = cls(prepare(spark), folder)
        return cls._open[key]

    def _stored(self, table: DataFrame, name: str, rebalance: bool = True) -> DataFrame:
        path = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        write_by_year(table, path, rebalance=rebalance)
        return read_interactions(self.spark, path)

    @cached_property
    def interactions(self) -> DataFrame:
        return self._stored(warehouse.interactions(self.spark, self.folder), "interactions", rebalance=False)

    @cached_property
    def daily(self) -> DailyCounts:
        return DailyCounts.of(self.interactions)

    @cached_property
    def multi_category(self) -> DataFrame:
        """The same interactions filed under order priority: items in several categories."""
        return self._stored(warehouse.interactions(self.spark, self.folder, "o_orderpriority"),
                            "interactions-priority", rebalance=False)

    @cached_property
    def items(self) -> DataFrame:
        return warehouse.items(self.spark, self.folder)

    # raw side -----------------------------------------------------------------------------
    @cached_property
    def reviews(self) -> DataFrame:
        return snapshot(ingest.clean_reviews(warehouse.raw_reviews(self.spark, self.folder),
                                             extra=["l_orderkey", "l_linenumber"],
                                             time_range=(0, ingest.TIMESTAMP_MS_MAX)), "reviews")

    @cached_property
    def user_map(self) -> DataFrame:
        return snapshot(ingest.dense_ids(self.reviews, "user_id", "user_idx"), "user-map")

    @cached_property
    def item_map(self) -> DataFrame:
        return snapshot(ingest.dense_ids(self.reviews, "parent_asin", "item_idx"), "item-map")

    @cached_property
    def category_map(self) -> DataFrame:
        return snapshot(ingest.dense_ids(self.reviews, "category", "category_idx"), "category-map")

    @cached_property
    def encoded(self) -> DataFrame:
        return self._stored(ingest.encode_dedupe(
            self.reviews, self.user_map, self.item_map, self.category_map,
            tie_break=["l_orderkey", "l_linenumber"]), "encoded", rebalance=False)

    @cached_property
    def metadata(self) -> DataFrame:
        return snapshot(ingest.clean_metadata(
            warehouse.raw_metadata(self.spark, self.folder)), "metadata")

    @cached_property
    def metadata_maps(self) -> dict[str, DataFrame]:
        return {name: snapshot(table, f"map-{name}")
                for name, table in ingest.metadata_maps(self.metadata).items()}

    @cached_property
    def built_items(self) -> DataFrame:
        return snapshot(ingest.build_items(self.metadata, self.item_map, self.metadata_maps),
                        "built-items")

    # evaluation -----------------------------------------------------------------------------
    @cached_property
    def evaluation(self) -> S.EvalSet:
        return S.build_eval_set(self.interactions, SPLIT, "test")

    @cached_property
    def sparse(self) -> DataFrame:
        """The interactions without the past of every tenth item."""
        cold = (F.col("item_idx") % HELD_BACK == 0) & (F.col("ts") < SPLIT.feature_cutoff("test"))
        return self._stored(self.interactions.filter(~cold), "interactions-sparse")

    @cached_property
    def sparse_evaluation(self) -> S.EvalSet:
        return S.build_eval_set(self.sparse, SPLIT, "test")

    @cached_property
    def popularity(self) -> Popularity:
        return Popularity().fit(self.interactions, self.evaluation.cutoff)

    @cached_property
    def covisitation(self) -> CoVisitation:
        return CoVisitation().fit(self.interactions, self.evaluation.cutoff)

    @cached_property
    def baskets(self) -> DataFrame:
        return snapshot(CoVisitation().baskets(self.interactions, self.evaluation.cutoff), "baskets")

    @cached_property
    def category_popularity(self) -> CategoryPopularity:
        return CategoryPopularity().fit(self.interactions, self.evaluation.cutoff)

    @cached_property
    def content(self) -> Content:
        return Content(self.items).fit(self.sparse, self.sparse_evaluation.cutoff)

    @cached_property
    def repeated_items(self) -> DataFrame:
        """Item attributes in which most items have a second row, with another price; in
        every fifth store all of them have."""
        again = self.items.filter((F.col("item_idx") % 3 > 0) | (F.col("store_idx") % 5 == 0))
        return self.items.unionByName(again.withColumn("price", F.round(F.col("price") * 1.25, 2)))

    @cached_property
    def content_repeated(self) -> Content:
        return Content(self.repeated_items).fit(self.sparse, self.sparse_evaluation.cutoff)

    @cached_property
    def raw_json(self) -> str:
        """The raw relations as gzip JSON lines, a folder for each category, with broken lines."""
        path = f"{shared_folder(self.spark)}/raw-{uuid.uuid4().hex}"
        broken = F.when(F.col("n") % 40 == 0, F.array(F.lit("{\"rating\": "), F.col("value")))
        for name, rows, label in (("", warehouse.raw_reviews(self.spark, self.folder), "category"),
                                  ("meta_", warehouse.raw_metadata(self.spark, self.folder), None)):
            fields = [c for c in rows.columns if c not in ("category", "l_orderkey", "l_linenumber")]
            number = F.col("l_orderkey") * 7 + F.col("l_linenumber") if label else F.xxhash64(*fields)
            lines = rows.select(F.col(label).alias("file") if label else F.lit("Parts").alias("file"),
                                F.to_json(F.struct(*fields)).alias("value"),
                                F.pmod(number, F.lit(1_000)).alias("n"))
            lines = snapshot(lines.select("file", F.explode(F.coalesce(broken, F.array("value")))
                                          .alias("value")), "json-lines")
            for file in warehouse.CATEGORY_NAMES["p_type"] if label else ("Parts",):
                (lines.filter(F.col("file") == file).select("value").write
                 .option("compression", "gzip").text(f"{path}/{name}{file}.jsonl.gz"))
        return path

    @cached_property
    def als(self) -> ImplicitALS:
        return ImplicitALS(factors=32, iterations=10, min_user_interactions=10).fit(
            self.interactions, self.evaluation.cutoff)

    @cached_property
    def als_vectors(self) -> DataFrame:
        return snapshot(self.als.fold_in(self.evaluation.histories), "als-fold-in")

    @cached_property
    def _made(self) -> dict[tuple[str, str], DataFrame]:
        return {}

    def _once(self, kind: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if (kind, name) not in self._made:
            self._made[kind, name] = snapshot(make(), f"{kind}-{name}")
        return self._made[kind, name]

    def list_of(self, name: str) -> DataFrame:
        """The list of one channel or fusion; only the lists it is made of are made with it."""
        make = {"round_robin": lambda: fusion.round_robin(self.lists, K),
                "weighted_rrf": lambda: fusion.weighted_rrf(self.lists, K, RRF_WEIGHTS)}
        return self._once("recs", name, make.get(
            name, lambda: getattr(self, name).recommend(self.evaluation.histories, K)))

    def found_in(self, *names: str) -> DataFrame:
        """The hits of some lists. Every list is joined to the truths once."""
        return reduce(DataFrame.unionByName, (self._once("found", name, lambda name=name: metrics.found_by(
            {name: self.list_of(name)}, self.evaluation.truths)) for name in names))

    @property
    def lists(self) -> dict[str, DataFrame]:
        return {name: self.list_of(name) for name in CHANNELS}

    @property
    def all_lists(self) -> dict[str, DataFrame]:
        return {name: self.list_of(name) for name in (*CHANNELS, *FUSIONS)}


def _uniform(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint and fractions rounded to 6 digits, for comparison by value."""
    columns = []
    for field in df.schema.fields:
        kind, col = field.dataType.typeName(), F.col(f"`{field.name}`")
        if kind in ("byte", "short", "integer", "long"):
            col = col.cast("bigint")
        elif kind in ("float", "double"):
            col = F.round(col.cast("double"), 6)
        columns.append(col.alias(field.name))
    return df.select(*columns)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[Workbench], DataFrame]) -> Callable[[Workbench], DataFrame]:
    @wraps(build)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return _uniform(build(Workbench.of(spark, folder)))

    QUERIES[build.__name__] = run
    return build


# ingest ------------------------------------------------------------------------------------
@query
def clean_reviews(w):
    return w.reviews


@query
def price_clean(w):
    return w.metadata


@query
def id_map_user(w):
    return w.user_map


@query
def id_map_item(w):
    return w.item_map


@query
def id_map_category(w):
    return w.category_map


@query
def id_map_store(w):
    return w.metadata_maps["store"]


@query
def id_map_main_category(w):
    return w.metadata_maps["main_category"]


@query
def interactions_dedup(w):
    return w.encoded


@query
def interactions_year(w):
    return w.interactions.groupBy("year").agg(
        F.count(F.lit(1)).alias("interactions"), F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"))


@query
def ingest_stats(w):
    return ingest.ingest_stats(w.reviews, w.encoded)


@query
def items(w):
    return w.built_items


@query
def item_stats(w):
    return ingest.item_stats(w.metadata, w.built_items)


@query
def users_sampled(w):
    return sample_users(w.interactions, SAMPLE_FRACTION).select("user_idx", "item_idx", "ts", "year")


@query
def users_sampled_stats(w):
    return sample_stats(w.interactions, sample_users(w.interactions, SAMPLE_FRACTION))


@query
def event_interactions(w):
    events = warehouse.event_interactions(w.spark, w.folder)
    return (events.groupBy("user_idx", "item_idx")
            .agg(F.min("ts").alias("ts"), F.count(F.lit(1)).alias("n"),
                 F.min_by("category", F.struct("ts", "category")).alias("category")))


# splits ------------------------------------------------------------------------------------
@query
def split_summary(w):
    return S.split_summary(w.interactions, SPLIT)


@query
def qualified_users(w):
    return w.evaluation.users


@query
def qualified_users_min_history(w):
    return S.build_eval_set(w.interactions, SPLIT, "valid", min_history=30).users


@query
def hash_top_n(w):
    return S.hash_top_n(w.evaluation.users, SAMPLED_USERS)


@query
def histories(w):
    return w.evaluation.ordered_histories()


@query
def truths(w):
    return w.evaluation.truths


@query
def leakage_max_ts(w):
    return S.latest_time(S.guard_leakage(w.evaluation.histories, w.evaluation.cutoff))


@query
def eval_profile(w):
    return S.eval_profile(w.evaluation)


@query
def sample_fingerprint(w):
    return S.sample_fingerprint(w.evaluation.users)


# popularity --------------------------------------------------------------------------------
@query
def pop_ranked(w):
    return Popularity().ranked(w.interactions, w.evaluation.cutoff)


@query
def pop_recs(w):
    return w.list_of("popularity")


# co-visitation -----------------------------------------------------------------------------
@query
def covis_input(w):
    return CoVisitation.recent(w.baskets)


@query
def covis_pop(w):
    return CoVisitation.popularity(w.baskets)


@query
def covis_pairs(w):
    return CoVisitation().pairs(w.baskets)


@query
def covis_neighbours(w):
    return w.covisitation.graph


@query
def covis_recs(w):
    return w.list_of("covisitation")


@query
def covis_stats(w):
    return w.covisitation.stats()


# category popularity -----------------------------------------------------------------------
@query
def catpop_item_cat(w):
    return w.category_popularity.item_categories


@query
def catpop_pool(w):
    return w.category_popularity.pool


@query
def catpop_recs(w):
    return w.list_of("category_popularity")


@query
def catpop_recs_multi(w):
    model = CategoryPopularity(window_days=730).fit(w.multi_category, w.evaluation.cutoff)
    return model.recommend(w.evaluation.histories, K)


@query
def catpop_stats(w):
    return w.category_popularity.stats()


# content -----------------------------------------------------------------------------------
@query
def content_items(w):
    return w.content.catalogue


@query
def content_store_pool(w):
    return w.content.stores


@query
def content_cat_pool(w):
    return w.content.categories


@query
def content_profile(w):
    return w.content.profile(item_weights(w.sparse_evaluation.histories)).drop("items")


@query
def content_user_price(w):
    return Content.median_prices(w.content.profile(item_weights(w.sparse_evaluation.histories)))


@query
def content_recs(w):
    return w.content.recommend(w.sparse_evaluation.histories, K)


@query
def content_recs_repeated(w):
    return w.content_repeated.recommend(w.sparse_evaluation.histories, K)


@query
def content_stats(w):
    return w.content.stats()


# matrix factorisation ----------------------------------------------------------------------
@query
def als_input(w):
    return ImplicitALS(min_user_interactions=30, min_item_interactions=28).training_rows(
        w.interactions, w.evaluation.cutoff)


@query
def als_fold_in(w):
    """Per user: how far the folded-in vector is from solving its own normal equations.

    With A = Y'Y + (alpha-1) Ys'Ys + reg n I and b = alpha sum(Ys), the largest |Ax - b| over the
    largest |b|, here as the fact whether it is below 0.001. All of it by joins and sums.
    """
    als, vectors, items = w.als, w.als_vectors, w.als.item_factors
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                                   F.lit(0.0), lambda acc, v: acc + v)
    cells = (items.select(F.posexplode("features").alias("i", "yi"), "features")
             .select("i", F.posexplode("features").alias("j", "yj"), "yi")
             .groupBy("i", "j").agg(F.sum(F.col("yi").cast("double") * F.col("yj")).alias("c")))
    gram = (cells.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "c"))).alias("row"))
            .agg(F.sort_array(F.collect_list(F.struct("i", F.col("row.c").alias("row")))).alias("g"))
            .select(F.col("g.row").alias("gram")))
    # a user's rows meet once; its sums stay in that partition and become one row of arrays
    seen = (w.evaluation.histories.select("user_idx", "item_idx").distinct().join(items, "item_idx")
            .select("user_idx", "features").repartition("user_idx")
            .join(vectors.select("user_idx", F.col("features").alias("x")), "user_idx")
            .withColumn("p", dot(F.col("features"), F.col("x")))
            .select("user_idx", F.posexplode("features").alias("i", "y"), "p")
            .groupBy("user_idx", "i").agg(
                F.sum((als.alpha - 1) * F.col("p") * F.col("y") - als.alpha * F.col("y")).alias("own"),
                F.sum(als.alpha * F.col("y")).alias("b"))
            .groupBy("user_idx").agg(F.sort_array(F.collect_list(F.struct("i", "own", "b"))).alias("sums")))
    whole = (vectors.crossJoin(gram).select(      # the second side is one row of factors^2 numbers
        "user_idx", "n_seen", "features", F.transform("gram", lambda row: dot(row, F.col("features"))).alias("gx")))
    off = F.transform("sums", lambda s: F.abs(
        F.get("gx", s["i"]) + s["own"] + als.regularization * F.col("n_seen") * F.get("features", s["i"])))
    return whole.join(seen, "user_idx").select("user_idx", (
        F.array_max(off) < 1e-3 * F.array_max(F.transform("sums", lambda s: F.abs(s["b"])))).alias("solved"))


@query
def als_recs(w):
    """Per user with a vector: places filled, and whether no unseen item outside the list beats
    its last place. All users against all items, multiplied in blocks."""
    recs = snapshot(w.als.recommend(w.evaluation.histories, K), "recs-als")
    last = recs.groupBy("user_idx").agg(F.count("*").alias("places"), F.min("score").alias("last"))
    # every pair is multiplied; those that cannot beat the last place stay in the tasks
    users = w.als_vectors.join(last, "user_idx").select("user_idx", "features", F.col("last").alias("least"))
    taken = recs.select("user_idx", "item_idx").unionByName(
        w.evaluation.histories.select("user_idx", "item_idx"))
    rest = (above(w.als.item_factors, users, w.als.factors)
            .join(taken, ["user_idx", "item_idx"], "left_anti")
            .groupBy("user_idx").agg(F.max(F.round("score", 5)).alias("best")))
    return (last.join(rest, "user_idx", "left")
            .select("user_idx", "places", (F.coalesce("best", F.lit(-1e9)) <= F.col("last") + 2e-5)
                    .alias("exact")))


@query
def als_stats(w):
    return w.als.stats()


# fusion ------------------------------------------------------------------------------------
@query
def fuse_round_robin(w):
    return w.list_of("round_robin")


@query
def fuse_rrf(w):
    return w.list_of("weighted_rrf")


@query
def union_ceiling(w):
    return fusion.union_recall_ceiling(w.lists, w.evaluation.truths, w.found_in(*CHANNELS))


# metrics -----------------------------------------------------------------------------------
@query
def metric_hits(w):
    flagged = metrics.hits(fusion.stack(w.all_lists), w.evaluation.truths)
    return flagged.select("channel", "user_idx", "rank", "item_idx", "hit")


@query
def metric_values(w):
    return metrics.evaluate(w.all_lists, w.evaluation.truths, KS, k_max=K, found=w.found_in(*CHANNELS, *FUSIONS))


@query
def coverage(w):
    return metrics.coverage(w.all_lists,
                            diagnostics.catalogue_size(w.interactions, w.evaluation.cutoff))


@query
def history_segments(w):
    return metrics.evaluate(w.lists, w.evaluation.truths, KS, found=w.found_in(*CHANNELS),
                            segments=metrics.history_segments(w.evaluation.histories))


@query
def recall_differences(w):
    return bootstrap.differences_of(w.found_in("popularity", "weighted_rrf"), w.evaluation.truths,
                                    "popularity", "weighted_rrf", K)


@query
def paired_bootstrap(w):
    return bootstrap.paired_bootstrap(w.list_of("popularity"), w.list_of("weighted_rrf"),
                                      w.evaluation.truths, K)


@query
def paired_bootstrap_hashed(w):
    return bootstrap.paired_bootstrap(w.list_of("popularity"), w.list_of("weighted_rrf"),
                                      w.evaluation.truths, K, method="hashed")


@query
def paired_bootstrap_exact(w):
    return bootstrap.interval_of(bootstrap.differences_of(
        w.found_in("popularity", "weighted_rrf"), w.evaluation.truths, "popularity", "weighted_rrf", K), method="exact")


@query
def bootstrap_moments(w):
    """Both kinds of resampling against the mean and standard error they must have."""
    differences = snapshot(bootstrap.differences_of(
        w.found_in("popularity", "weighted_rrf"), w.evaluation.truths, "popularity", "weighted_rrf", K), "differences")
    return reduce(DataFrame.unionByName, (
        bootstrap.moments_of(differences, 2_000, method=method) for method in ("poisson", "exact")))


@query
def examples(w):
    return metrics.examples(w.evaluation, w.lists, 3)


# diagnostics -------------------------------------------------------------------------------
@query
def catalogue_diag(w):
    return diagnostics.catalogue_diagnostics(w.sparse, w.sparse_evaluation.cutoff,
                                             w.sparse_evaluation.truths)


@query
def reachability(w):
    return diagnostics.channel_reachability(w.interactions, w.evaluation.truths,
                                            w.evaluation.histories, w.covisitation.graph)


@query
def reachability_multi(w):
    return diagnostics.channel_reachability(w.multi_category, w.evaluation.truths,
                                            w.evaluation.histories)


# quality -----------------------------------------------------------------------------------
@query
def quality_scale(w):
    return quality.overall_scale(w.interactions)


@query
def quality_user_hist(w):
    return quality.user_activity(w.interactions)


@query
def quality_long_tail(w):
    return quality.item_long_tail(w.interactions)


@query
def quality_yearly(w):
    return quality.yearly_volume(w.interactions)


@query
def quality_eligibility(w):
    return quality.eligibility(w.interactions, SPLIT)


@query
def quality_anomalies(w):
    return quality.anomalies(w.interactions)


@query
def window_volume(w):
    return quality.window_volume(
        w.interactions, {name: s.bounds("valid") for name, s in WINDOWS.items()}, "2000-q1")


@query
def split_summary_gap(w):
    """A split that ends after the data: its last segment is empty."""
    return S.split_summary(w.interactions, GAP)


@query
def window_volume_gap(w):
    return quality.window_volume(w.interactions, {name: GAP.bounds(name)
                                                  for name in ("valid", "test")}, "valid")


@query
def source_files(w):
    return source_inventory(w.spark, [f"{w.folder}/{name}.parquet"
                                      for name in ("lineitem", "orders", "part")])


@query
def source_digest(w):
    return inventory_digest(source_files(w))


@query
def reviews_from_json(w):
    paths = category_paths(w.spark, w.raw_json, warehouse.CATEGORY_NAMES["p_type"])
    return ingest.clean_reviews(read_reviews(w.spark, paths), time_range=(0, ingest.TIMESTAMP_MS_MAX))


@query
def review_lines(w):
    """Lines, broken lines and kept rows of the raw reviews, all from the scan that cleans them."""
    paths = category_paths(w.spark, w.raw_json, warehouse.CATEGORY_NAMES["p_type"])
    return ingest.counted_reviews(w.spark, paths, time_range=(0, ingest.TIMESTAMP_MS_MAX))[1]


@query
def metadata_from_json(w):
    paths = category_paths(w.spark, w.raw_json, ["Parts"], prefix="meta_")
    return ingest.clean_metadata(read_metadata(w.spark, paths))


# whole runs --------------------------------------------------------------------------------
@query
def baseline_run(w):
    return runs.baseline_run(w.interactions, SPLIT, "test", KS)["metrics"]


@query
def rolling_windows(w):
    parts = None
    for name, split in WINDOWS.items():
        scores = runs.baseline_run(w.interactions, split, "valid", KS)["metrics"]
        scores = scores.withColumn("window", F.lit(name))
        parts = scores if parts is None else parts.unionByName(scores)
    return parts


@query
def rolling_pools(w):
    """Pools of three channels in all windows, read off one table of daily counts."""
    return runs.rolling_pools(w.daily, WINDOWS, w.items)


@query
def rolling_category(w):
    """Category popularity in all windows, fitted on the same counts."""
    parts = []
    for name, split in WINDOWS.items():
        evaluation = S.build_eval_set(w.interactions, split, "valid")
        recs = snapshot(CategoryPopularity().fit(w.daily, evaluation.cutoff)
                        .recommend(evaluation.histories, K), "rolling-category")
        scores = metrics.evaluate({"category_popularity": recs}, evaluation.truths, KS, k_max=K)
        parts.append(scores.withColumn("window", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


@query
def run_record(w):
    """Metrics and last status of a recorded run, read back from its record."""
    path = f"{shared_folder(w.spark)}/record-{uuid.uuid4().hex}"
    runs.recorded_run(w.interactions, path, "first", segment="test", split=SPLIT, k=K, eval_ks=KS,
                      channels=("popularity", "category_popularity"), bootstrap_samples=0)
    status = w.spark.read.parquet(f"{path}/status").agg(F.max_by("status", "at").alias("status"))
    return (w.spark.read.parquet(f"{path}/results").filter("section = 'results' AND metric <> 'coverage'")
            .filter(F.col("name").isin("popularity", "category_popularity"))
            .select("run_id", F.col("name").alias("channel"), "metric", "value", status.scalar().alias("status")))


@query
def stored_tables(w):
    """Id maps and item attributes written by the sink for tables and read back."""
    parts = []
    for name, rows, key, idx in (("user", w.user_map, "user_id", "user_idx"), ("item", w.item_map, "parent_asin", "item_idx"),
                                 ("store", w.items.select(F.col("store_idx").cast("string").alias("store"), "item_idx"),
                                  "store", "item_idx")):
        path = f"{shared_folder(w.spark)}/stored-{uuid.uuid4().hex}"
        write_table(rows, path)
        parts.append(read_table(w.spark, path).select(
            F.lit(name).alias("kind"), F.col(key).alias("name"), F.col(idx).cast("bigint").alias("idx")))
    return reduce(DataFrame.unionByName, parts)


@query
def evaluation_run(w):
    run = runs.evaluation_run(
        w.interactions, "test", SPLIT, k=K, eval_ks=KS, items=w.items,
        channels=("popularity", "covisitation", "category_popularity", "als", "content"),
        weights=(1.0, 1.0, 0.25, 0.5, 0.25))
    return run.results


@query
def rolling_evaluation(w):
    return runs.rolling_runs(
        w.interactions, WINDOWS, segment="valid", k=K, eval_ks=KS, items=w.items,
        channels=("popularity", "covisitation", "category_popularity", "als", "content"),
        weights=(1.0, 1.0, 0.25, 0.5, 0.25))


@query
def quality_report(w):
    return runs.quality_report(w.interactions, SPLIT)
