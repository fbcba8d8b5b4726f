"""The registered queries over the driver's tables, by inventory identifier, each with SQL of its own in oracles.py."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import findable
from ..functions import columns as C
from ..functions import pixels as P
from ..functions import text as T
from ..operators import audit, metrics, models, near_duplicates, networks, pairs, ranking, regression, resample, training
from ..sources import charts, features, files, readers, sinks, staged
from ..sources import images as images_io
from . import workflows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
STATES = ["F", "O", "P"]
TEMPLATES = ("A: {name}", "B: {name}")
#: Tables and columns whose rows a run's lineage names.
LINEAGE = {"region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"], "customer": ["c_custkey", "c_mktsegment", "c_nationkey"]}
LIMITS = (("very_strict", 16, 24), ("strict", 20, 28), ("screen", 24, 32))


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return findable(spark).read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def checksums(values: Column) -> list[Column]:
    """Sums that any moved or changed value alters: of the values, and of the values times their places from 1."""
    add = lambda a, b: a + b
    zero = F.lit(0).cast("double")
    placed = F.transform(values, lambda v, k: v.cast("double") * (k + 1))
    return [F.aggregate(F.transform(values, lambda v: v.cast("double")), zero, add).alias("total"), F.aggregate(placed, zero, add).alias("weighted")]


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as samples of customers: the status is the truth, a rule over line statuses the prediction (no lines: O)."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_linestatus").alias("a"), F.max("l_linestatus").alias("b"))
    orders, customers = table(spark, sf, "orders"), table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    met = orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left").join(customers, orders.o_custkey == customers.c_custkey)
    rule = F.when(F.col("a").isNull(), "O").when(F.col("a") == F.col("b"), F.col("a")).otherwise("P")
    out = met.select(F.col("o_orderkey").alias("sample_id"), F.col("o_custkey").alias("group_id"), F.col("c_mktsegment").alias("category"), F.col("o_orderstatus").alias("label"), rule.alias("prediction"))
    return out.withColumn("correct", F.col("label") == F.col("prediction"))


def families(spark: SparkSession, sf: str) -> DataFrame:
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("category"), F.col("r_name").alias("family"))


def images(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as images: nation is the category, region the family."""
    c, n, r = table(spark, sf, "customer"), table(spark, sf, "nation"), table(spark, sf, "region")
    met = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return met.select(F.col("c_custkey").alias("image_id"), F.col("n_name").alias("category"), F.col("r_name").alias("family"), F.sha2(F.col("c_custkey").cast("string"), 256).alias("sha256"), F.col("c_mktsegment").alias("segment"))


def split_images(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.stratified_split(images(spark, sf), "category", "image_id")


def relations(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.relations(images(spark, sf), TEMPLATES)


def partners(spark: SparkSession, sf: str) -> DataFrame:
    """Each nation's next nation in its region, and the nation of the same place in the next region."""
    p = pairs.plan(pairs.quotas(images(spark, sf))).select("category", "family", F.col("partner").alias("partial_partner"))
    w = Window.orderBy("family", "category")  # one row per category
    p = p.withColumn("k", F.row_number().over(w) - 1).withColumn("z", F.count("*").over(Window.partitionBy(F.lit(1)))).withColumn("m", F.count("*").over(Window.partitionBy("family")))
    aim = p.select(F.col("k").alias("ak"), F.col("category").alias("mismatch_partner"))
    return p.join(aim, (F.col("k") + F.col("m")) % F.col("z") == F.col("ak")).select("category", "family", "partial_partner", "mismatch_partner")


def hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as images: 32 rows of 32 values, each row three values further on, and 8 rows of 9 values."""
    square = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.slice("twice", 3 * i + 1, 32))
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("twice", 8 * i + 1, 9))
    twice = table(spark, sf, "embeddings").select("vec_id", "label", F.concat("embedding", "embedding").alias("twice"))
    e = twice.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("category"), C.perceptual_hash(square).alias("phash"), C.difference_hash(rows).alias("dhash"))
    e = sinks.written(e, "hashes")  # read several times
    return ranking.stratified_split(e, "category", "id").drop("rank")


def near(spark: SparkSession, sf: str, known: DataFrame | None = None) -> DataFrame:
    """Near duplicates among hashes(), which are made unless they are known."""
    return near_duplicates.pairs(hashes(spark, sf) if known is None else known, LIMITS)


def majority_rows(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    p = predictions(spark, sf)
    best = models.majority(p)
    return p, p.withColumn("correct", F.col("label") == F.lit(best))


def split_documents(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.stratified_split(table(spark, sf, "documents").select("doc_id", "text", "lang"), "lang", "doc_id").drop("rank")


def history(spark: SparkSession, sf: str) -> DataFrame:
    """Daily mean value of each event type, as a model's history."""
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01")).cast("long")
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("model"), day.alias("epoch")).agg(F.round(F.avg("value"), 6).alias("macro_f1"), F.count("*").alias("n"))


# Sources and sinks


@query
def S1_image_manifest(spark, sf):
    """A manifest written as CSV and read with its schema and required columns."""
    path, columns = sinks.shared_dir(spark, "manifest"), ("image_id", "category", "family", "sha256")
    images(spark, sf).select(*columns).write.option("header", True).csv(path)
    return readers.csv(spark, path, columns, "image_id bigint, category string, family string, sha256 string")


@query
def S2_split_relations(spark, sf):
    """Relations written by split, of which the guarded reader reads one."""
    path = sinks.shared_dir(spark, "relations")
    split = split_images(spark, sf).select("image_id", "split")
    sinks.write_partitioned(relations(spark, sf).join(split, "image_id").select("sample_id", "label", "split"), path)
    return readers.relations(spark, path, "validation").select("sample_id", "label", "split")


@query
def S3_category_index(spark, sf):
    return readers.category_index(families(spark, sf), "category", "family", 25).select("category", "family", F.col("index").cast("long").alias("index"))


@query
def S4_json_document(spark, sf):
    """Properties of events written as JSON documents and read again."""
    path = sinks.shared_dir(spark, "json")
    table(spark, sf, "events").select(F.to_json(F.struct("event_type", F.from_json("props", "k bigint").alias("props"))).alias("value")).write.text(path)
    k = F.col("props.k")
    read = readers.json_documents(spark, path, "event_type string, props struct<k: bigint>", lines=True)
    return read.groupBy("event_type").agg(F.count("*").alias("events"), F.sum(k).alias("k_sum"), F.max(k).alias("k_max"))


@query
def S8_lazy_dataset(spark, sf):
    e = table(spark, sf, "embeddings")
    n = e.count()
    r = relations(spark, sf).withColumn("vec", F.col("image_id") % n)
    features = e.select(F.col("vec_id").alias("vec"), F.col("embedding").alias("features"))
    ids = r.select("image_id", "vec").distinct().join(features, "vec").select("image_id", "features")
    d = readers.lazy_dataset(r, ids, list(C.LABELS), readers.category_index(families(spark, sf), "category", "family"))
    return d.select("sample_id", F.col("label_code").cast("long").alias("label_code"), F.col("image_code").cast("long").alias("image_code"), F.col("text_code").cast("long").alias("text_code"), *[F.round(c, 6).alias(n) for c, n in zip(checksums(F.col("features")), ("total", "weighted"))])


def archives(spark: SparkSession, sf: str) -> DataFrame:
    """A zip archive (path, content) for each document, which holds its text."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, contents = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w") as z:
                    z.writestr(f"data/{doc_id}.jpg", text or "")
                names.append(str(doc_id))
                contents.append(out.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])

    return table(spark, sf, "documents").select("doc_id", "text").mapInArrow(packed, "path string, content binary")


@query
def S5_archive_members(spark, sf):
    return readers.inspect_archive(archives(spark, sf), "data/").select("archive", "path", "safe", "crc_ok", "bytes", "sha256")


@query
def S6_S7_collected_files(spark, sf):
    d = table(spark, sf, "documents").select(F.col("lang").alias("category"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    return readers.collect_manifest(d, 250, table(spark, sf, "benchmark").select(F.sha2("text", 256).alias("sha256")))


@query
def S10_cached_features(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", *checksums(F.col("embedding")))
    path = sinks.shared_dir(spark, "features")
    readers.cached_features(spark, path, e, "vec_id", lambda: e)
    return rounded(readers.cached_features(spark, path, e, "vec_id", lambda: e.where("false")))  # kept, not built again


@query
def S11_single_record(spark, sf):
    """Parts as records to predict: pictures of several kinds, some without a description."""
    p = table(spark, sf, "part")
    suffix = F.element_at(F.array(*[F.lit(x) for x in ("JPG", "png", "webp", "gif", "jpeg.txt")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    words = F.when(F.col("p_partkey") % 7 == 0, "  ").otherwise(F.concat(F.lit(" "), "p_name", F.lit("  ")))
    return readers.uploads(p.select(F.concat(F.lit("files/"), "p_partkey", F.lit("."), suffix).alias("path"), words.alias("description")))


@query
def K1_csv_report(spark, sf):
    path = sinks.shared_dir(spark, "csv")
    sinks.write_csv(images(spark, sf).select("image_id", "category", "family"), path, ["category", "image_id"])
    return readers.csv(spark, path, ["image_id", "category", "family"], "image_id bigint, category string, family string")


@query
def K2_K3_documents(spark, sf):
    """Documents written once, then only when they change; 1 where the sink wrote."""
    path = sinks.shared_dir(spark, "document") + ".json"
    counts = {r.n_name: r.n_regionkey for r in table(spark, sf, "nation").collect()}  # 25 rows
    sinks.write_json(counts, path)
    wrote = [sinks.write_if_changed(d, path) for d in (counts, counts | {"more": 1})]
    return spark.createDataFrame([(int(wrote[0]), int(wrote[1]), sinks.digest(path))], "same int, changed int, sha256 string")


@query
def K4_K5_partitioned(spark, sf):
    path = sinks.shared_dir(spark, "partitioned")
    s = split_images(spark, sf).select("image_id", "category", "split")
    sinks.write_partitioned(s.where("image_id < 0"), path)
    sinks.write_partitioned(s, path, mode="overwrite")
    return spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("images"))


@query
def K6_saved_model(spark, sf):
    """Layers of a model that was saved and loaded again, and the size of its vocabulary."""
    d = split_documents(spark, sf).where("split = 'train'")
    vocabulary = T.fit(d, "doc_id", "text", 64)
    path = sinks.shared_dir(spark, "model")
    models.save(models.HeadNetwork("multimodal", 64, 64, 3, categories=25), vocabulary, path, list(C.LABELS))
    network, terms, _ = models.load(spark, path)
    rows = [(k, w.size) for k, w in network.weights.items()]
    return spark.createDataFrame(rows, "layer string, size long").unionByName(terms.agg(F.lit("terms").alias("layer"), F.count("*").alias("size")))


@query
def K8_F3_model_summary(spark, sf):
    """Arrays of a network as wide as the tables say, from its summary; whether its digest stays, and changes with a weight."""
    width = table(spark, sf, "embeddings").agg(F.max(F.size("embedding"))).first()[0]
    categories = families(spark, sf).count()
    network = models.HeadNetwork("multimodal", width, table(spark, sf, "region").count(), 3, categories=categories, hidden=8)
    again = {k: w.copy() for k, w in network.weights.items()}
    same = sinks.state_digest(network.weights) == sinks.state_digest(again)
    again["o"][0, 0] += 1
    changed = sinks.state_digest(network.weights) == sinks.state_digest(again)
    rows = [(line.split(" ")[0], int(line.split(" ")[-1]), same, changed) for line in sinks.model_summary(network.weights).split("\n")]
    return spark.createDataFrame(rows, "name string, parameters long, same boolean, changed_same boolean")


@query
def K9_lineage(spark, sf):
    """Digests of the rows that a run read, from its lineage document."""
    inputs = {name: staged.rows_digest(table(spark, sf, name).select(*columns)) for name, columns in LINEAGE.items()}
    path = sinks.shared_dir(spark, "lineage") + ".json"
    sinks.write_json(sinks.lineage(spark, 44, inputs), path)
    found = json.loads(sinks.read_bytes(path))
    return spark.createDataFrame([(k, v, found["seed"], found["spark"] == spark.version) for k, v in found["inputs"].items()], "input string, digest string, seed int, same_version boolean")


@query
def P17_lock(spark, sf):
    """What differs from a lock: before, and after a file and a flag change."""
    folder = sinks.shared_dir(spark, "lock")
    files = [f"{folder}/{name}.json" for name in ("a", "b")]
    for f in files:
        sinks.write_json({"n": table(spark, sf, "region").count()}, f)
    sinks.write_lock(files, f"{folder}/lock.json", official=True)
    before = sinks.verify_lock(f"{folder}/lock.json", folder, official=True)
    sinks.write_json({"n": 0}, files[1], overwrite=True)
    after = sinks.verify_lock(f"{folder}/lock.json", folder, official=False)
    return spark.createDataFrame([("before", x) for x in before] + [("after", x) for x in after], "moment string, difference string")


@query
def P19_forbidden_text(spark, sf):
    return audit.forbidden_text(table(spark, sf, "documents"), "doc_id", "text", ["@", "http", "password"])


@query
def A24_recomputed(spark, sf):
    """Stored metrics that the predictions don't give."""
    r = metrics.blocks(predictions(spark, sf), "group_id").first()
    wrong = audit.recomputed({"accuracy": r.accuracy, "rows": r.rows}, {"accuracy": r.accuracy, "rows": r.rows + 1, "lost": 1.0})
    return spark.createDataFrame([(w,) for w in wrong], "metric string")


@query
def W3_selection(spark, sf):
    """Candidates by category and candidate id in an order by digest, the first of each category selected."""
    c = images(spark, sf).select("category", F.concat_ws("|", "category", "image_id").alias("candidate"))
    ranked = ranking.hash_rank(c, ["category"], F.sha2("candidate", 256), ["candidate"])
    return ranked.where("rank <= 10").select("category", "candidate", F.col("rank").cast("long").alias("selection_order"))


@query
def S9_hash_manifest(spark, sf):
    d = table(spark, sf, "documents")
    lines = d.select(F.concat(F.sha2("text", 256), F.lit("  "), F.col("doc_id").cast("string")).alias("value"))
    return readers.hash_manifest(lines).select("sha256", "path")


@query
def K7_content_path(spark, sf):
    s = split_images(spark, sf)
    name = C.content_id("v4", F.col("category"), F.col("split"), F.col("rank"), F.col("sha256"))
    return s.select("image_id", name.alias("content_id"), F.concat_ws("/", "split", "category", name).alias("path"))


@query
def K7_verified_copies(spark, sf):
    s = split_images(spark, sf).select("image_id", C.content_id("v4", F.col("category"), F.col("split"), F.col("rank"), F.col("sha256")).alias("target"), F.col("image_id").cast("string").cast("binary").alias("content"), "sha256")
    return sinks.copy_verified(s, sinks.shared_dir(spark, "copies"))


# Projections, predicates, checks


@query
def P1_P2_prediction_rows(spark, sf):
    return predictions(spark, sf).select("sample_id", F.col("label").alias("true_label"), F.col("prediction").alias("predicted_label"), F.col("correct").alias("is_correct"))


@query
def P3_membership(spark, sf):
    c = table(spark, sf, "customer")
    return c.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & ~F.col("c_nationkey").isin(0, 1, 2) & (F.col("c_acctbal") > 0)).select("c_custkey", "c_mktsegment")


@query
def P5_label_rule(spark, sf):
    r = relations(spark, sf)
    rule = C.relation_label(F.col("part_category"), F.col("text_category"), F.col("part_family"), F.col("text_family"))
    return r.groupBy("label", rule.alias("rule_label")).agg(F.count("*").alias("rows"))


@query
def P6_encode(spark, sf):
    o = table(spark, sf, "orders")
    code = C.encode(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])
    return o.groupBy("o_orderpriority", code.cast("long").alias("code")).agg(F.count("*").alias("rows"))


@query
def P7_strict_boolean(spark, sf):
    text = F.concat(F.lit("  "), F.when(F.col("correct"), F.lit("TRUE")).otherwise("False"), F.lit(" "))
    return predictions(spark, sf).groupBy(C.strict_bool(text).alias("correct")).agg(F.count("*").alias("rows"))


@query
def P10_uniqueness(spark, sf):
    return audit.union([
        audit.uniqueness(table(spark, sf, "customer"), [["c_custkey"], ["c_name"]]), audit.uniqueness(table(spark, sf, "documents"), [["doc_id"], ["text"]]),
        audit.uniqueness(table(spark, sf, "lineitem"), [["l_orderkey", "l_linenumber"]]),
    ])


@query
def P11_domain(spark, sf):
    return audit.domain(table(spark, sf, "customer"), "c_nationkey", table(spark, sf, "nation").where("n_nationkey < 20"), "n_nationkey")


@query
def P12_counts(spark, sf):
    declared = spark.createDataFrame([("BUILDING", 300), ("MACHINERY", 299), ("NOWHERE", 1)], "segment string, declared long")
    return audit.counts(images(spark, sf), "segment", declared)


@query
def P13_rule_violations(spark, sf):
    return audit.rule_violations(relations(spark, sf), families(spark, sf))


@query
def P14_content_hashes(spark, sf):
    d = table(spark, sf, "documents")
    manifest = d.select(F.col("doc_id").alias("path"), F.sha2(F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"))
    return audit.content_hashes(d.select(F.col("doc_id").alias("path"), F.col("text").alias("content")), manifest)


@query
def P15_path_policy(spark, sf):
    s = split_images(spark, sf)
    path = F.concat(F.when((F.col("split") == "test") & (F.col("image_id") % 11 != 0), "data\\locked_test\\").otherwise("data/images/"), F.col("image_id").cast("string"))
    return audit.path_policy(s.withColumn("image_path", path), "image_path", "split", "test", "data/locked_test/")


@query
def P16_plan_check(spark, sf):
    return audit.plan_check(partners(spark, sf), per_family=5)


@query
def P18_provenance(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "props", (F.col("value") > 1).alias("reviewed"))
    return audit.provenance(e, ["reviewed"], "purchase")


@query
def P21_any_contains(spark, sf):
    p = table(spark, sf, "part")
    return p.where(C.any_contains(p, "ECON")).select("p_partkey")


# Joins


@query
def J2_feature_lookup(spark, sf):
    n = table(spark, sf, "embeddings").count()
    e = table(spark, sf, "embeddings").select(F.col("vec_id"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("feature_sum"))
    r = images(spark, sf).withColumn("vec_id", F.col("image_id") % n)
    return workflows.looked_up(r, e, "vec_id", "feature_sum").select("image_id", "vec_id", "feature_sum")


@query
def J3_text_lookup(spark, sf):
    d = table(spark, sf, "documents")
    once = d.select("text").distinct().select("text", F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"))
    known = d.where("text is not null")
    found = workflows.looked_up(known, once, "text", "n_tokens").select("doc_id", "n_tokens")
    return found.unionByName(d.where("text is null").select("doc_id", F.lit(0).cast("long").alias("n_tokens")))


@query
def J4_J6_relation_pairs(spark, sf):
    return relations(spark, sf)


@query
def J7_expand_modes(spark, sf):
    return pairs.expand_modes(images(spark, sf).select("image_id", "category"), partners(spark, sf).drop("family"))


@query
def J8_near_duplicate_pairs(spark, sf):
    return near(spark, sf).select("severity", "category", "left_split", "right_split", "left_id", "right_id", F.col("phash_distance").cast("long").alias("phash_distance"), F.col("dhash_distance").cast("long").alias("dhash_distance"))


@query
def J8_banded_near_duplicates(spark, sf):
    """Hashes of the train split, and copies of them with up to six bits changed as the test split."""
    h = hashes(spark, sf).where("split = 'train'")
    changed = F.expr("shiftleft(1L, cast(id % 64 as int)) | shiftleft(id % 32, 7)")
    copies = h.select((F.col("id") + 1_000_000).alias("id"), "category", F.lit("test").alias("split"), F.col("phash").bitwiseXOR(changed).alias("phash"), "dhash")
    found = near_duplicates.pairs(h.select("id", "category", "split", "phash", "dhash").unionByName(copies), (("very_strict", 4, 6), ("strict", 6, 8), ("screen", 8, 10)))
    return found.select("severity", "left_id", "right_id", F.col("phash_distance").cast("long").alias("phash_distance"), F.col("dhash_distance").cast("long").alias("dhash_distance"))


@query
def J9_split_overlap(spark, sf):
    return audit.overlap(split_images(spark, sf), "split", list(readers.SPLITS), ["image_id", "segment", "sha256"])


@query
def J10_description_overlap(spark, sf):
    return audit.overlap(split_documents(spark, sf), "split", list(readers.SPLITS), ["text"])


@query
def J12_A17_paired_difference(spark, sf):
    a, b = majority_rows(spark, sf)
    return rounded(resample.summary(resample.differences(resample.paired(a, b, "sample_id", "group_id"), "group_id")))


@query
def J13_frames_equal(spark, sf):
    p = sinks.written(predictions(spark, sf).select("sample_id", "label", "prediction"), "frame")  # read for both frames
    return audit.same(p, p.withColumn("prediction", F.when(F.col("sample_id") % 100 == 0, "P").otherwise(F.col("prediction"))), ["sample_id", "label", "prediction"])


@query
def J14_sampled_relations(spark, sf):
    ids = ranking.sample(split_images(spark, sf).drop("rank"), "split", "image_id", 20).select("image_id")
    return relations(spark, sf).join(ids, "image_id", "left_semi").select("sample_id", "label")


# Aggregations


@query
def A1_value_counts(spark, sf):
    return split_images(spark, sf).groupBy("split", "category").agg(F.count("*").alias("images"))


@query
def A2_distinct_counts(spark, sf):
    return table(spark, sf, "documents").agg(F.countDistinct("doc_id").alias("ids"), F.countDistinct("text").alias("texts"), F.countDistinct("source").alias("sources"))


@query
def A3_A4_balance_image(spark, sf):
    return audit.balance(relations(spark, sf), "image_id", "label", list(C.LABELS))


@query
def A4_balance_category(spark, sf):
    return audit.balance(relations(spark, sf), "text_category", "label", list(C.LABELS))


@query
def A4_balance_description(spark, sf):
    return audit.balance(relations(spark, sf), "description", "label", list(C.LABELS))


@query
def A5_crosstab(spark, sf):
    return audit.crosstab(split_images(spark, sf), "segment", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"], "split", ["test", "train", "validation"])


@query
def A6_quotas(spark, sf):
    return pairs.quotas(images(spark, sf))


@query
def A7_margins(spark, sf):
    actual = relations(spark, sf).groupBy("text_category", "label").agg(F.count("*").alias("n"))
    expected = pairs.quotas(images(spark, sf)).select(F.col("category").alias("text_category"), F.explode(F.array(*[F.lit(x) for x in C.LABELS])).alias("label"), F.col("quota").cast("long").alias("n"))
    return audit.finding(audit.margins_differ(actual, expected), "margins", F.count("*"), 0).withColumn("compared", F.lit(actual.count()).cast("long"))


@query
def A8_metric_by_segment(spark, sf):
    return rounded(metrics.blocks(predictions(spark, sf), "group_id", ["category"]))


@query
def A8_fixed_and_union(spark, sf):
    p = predictions(spark, sf).where("label <> 'P' and prediction <> 'P'")
    parts = [metrics.blocks(p, "group_id", labels=v).withColumn("labels", F.lit(k)) for k, v in (("fixed", STATES), ("union", None))]
    empty = metrics.blocks(p.where("sample_id < 0"), "group_id", labels=STATES).withColumn("labels", F.lit("empty"))
    return rounded(parts[0].unionByName(parts[1]).unionByName(empty))


@query
def A9_confusion_matrix(spark, sf):
    return metrics.confusion_matrix(predictions(spark, sf), STATES)


@query
def A10_per_class(spark, sf):
    return rounded(metrics.per_class(metrics.confusion(predictions(spark, sf)), labels=STATES))


@query
def A11_per_category(spark, sf):
    p = predictions(spark, sf).join(images(spark, sf).select(F.col("image_id").alias("group_id"), F.col("category").alias("nation")), "group_id")
    return rounded(metrics.blocks(p, "group_id", ["nation"]))


@query
def A12_group_accuracy(spark, sf):
    return rounded(metrics.group_accuracy(predictions(spark, sf), "group_id", F.col("correct")))


@query
def A13_error_directions(spark, sf):
    return predictions(spark, sf).where("not correct").groupBy("category", "label", "prediction").agg(F.count("*").alias("errors"))


@query
def A13_O4_errors_top10(spark, sf):
    e = predictions(spark, sf).where("not correct").groupBy("group_id", "category").agg(F.count("*").alias("errors"))
    return e.orderBy(F.desc("errors"), "group_id", "category").limit(10)


@query
def A14_J11_duplicate_sensitivity(spark, sf):
    p = predictions(spark, sf)
    h = sinks.written(hashes(spark, sf), "split-hashes")
    rows = h.where("split = 'test'").select("id").join(p, F.col("id") == F.col("sample_id")).select("id", "label", "prediction")
    return rounded(near_duplicates.sensitivity(rows, near(spark, sf, h), "id", STATES, LIMITS))


@query
def A15_severity_counts(spark, sf):
    return near_duplicates.severity_counts(near(spark, sf), LIMITS)


@query
def A16_accuracy_groups(spark, sf):
    return rounded(metrics.accuracy_by(predictions(spark, sf), [[], ["category"], ["label"], ["category", "label"]], F.col("correct")))


@query
def A18_sign_flip_exact(spark, sf):
    a, b = majority_rows(spark, sf)
    region = images(spark, sf).select(F.col("image_id").alias("group_id"), "family")
    pairs_ = resample.paired(a, b, "sample_id", "group_id").join(region, "group_id").drop("group_id")
    return rounded(resample.sign_flip_exact(resample.differences(pairs_, "family")))


@query
def A19_sign_flip_monte_carlo(spark, sf):
    a, b = majority_rows(spark, sf)
    return rounded(resample.sign_flip_monte_carlo(resample.differences(resample.paired(a, b, "sample_id", "group_id"), "group_id"), "group_id"))


@query
def A20_cluster_bootstrap(spark, sf):
    return rounded(resample.bootstrap(predictions(spark, sf), "group_id", STATES))


@query
def A21_ablation(spark, sf):
    runs = predictions(spark, sf).groupBy("category", (F.col("sample_id") % 3).alias("seed")).agg(F.avg(F.col("correct").cast("int")).alias("accuracy"), F.min("prediction").alias("prediction"))
    return rounded(metrics.ablation(runs, "category", "prediction", "accuracy", 0.4))


@query
def A22_rule_diagnostic(spark, sf):
    next_one = pairs.small(partners(spark, sf).select("category", F.col("partial_partner").alias("p")))
    r = relations(spark, sf)
    r = r.join(next_one.select(F.col("category").alias("part_category"), F.col("p").alias("pp")), "part_category").join(next_one.select(F.col("category").alias("text_category"), F.col("p").alias("tp")), "text_category")
    r = r.withColumn("predicted_part_category", F.when(F.col("image_id") % 5 == 0, F.col("pp")).otherwise(F.col("part_category"))).withColumn("predicted_text_category", F.when(F.col("image_id") % 7 == 0, F.col("tp")).otherwise(F.col("text_category")))
    return rounded(metrics.rule_diagnostic(r.withColumn("prediction", F.when(F.col("image_id") % 3 == 0, "MATCH").otherwise(F.col("label"))), families(spark, sf)))


@query
def A23_running_mean(spark, sf):
    h = history(spark, sf)
    return rounded(ranking.running_mean(h, "model", "epoch", "macro_f1", "n").select("model", "epoch", "running_mean"))


# Ordered operators


@query
def W1_W2_stratified_split(spark, sf):
    return split_images(spark, sf).select("image_id", "category", F.col("rank").cast("long").alias("rank"), "split")


@query
def W4_W5_templates(spark, sf):
    r = relations(spark, sf)
    return r.groupBy("label", "text_category", "description").agg(F.count("*").alias("rows"), F.min("sample_id").alias("first_sample"), F.max("sample_id").alias("last_sample"))


@query
def W7_best_epoch(spark, sf):
    return models.best_epoch(history(spark, sf))


@query
def W8_early_stop(spark, sf):
    return ranking.early_stop(history(spark, sf).withColumnRenamed("macro_f1", "loss"), "model", "epoch", "loss", patience=3)


@query
def O1_multi_key_sort(spark, sf):
    c = table(spark, sf, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.round(F.sum("c_acctbal"), 2).alias("balance"), F.count("*").alias("n"))
    return metrics.ranked(c, [F.desc("n"), F.desc("balance"), F.asc("c_mktsegment"), F.asc("c_nationkey")]).select(F.col("position").cast("long").alias("position"), "c_mktsegment", "c_nationkey", "n")


@query
def O2_custom_order(spark, sf):
    counted = split_images(spark, sf).groupBy("split", "category").agg(F.count("*").alias("n"))
    order = F.array_position(F.array(*[F.lit(s) for s in readers.SPLITS]), F.col("split"))
    return metrics.ranked(counted, [order, F.asc("category")]).select(F.col("position").cast("long").alias("position"), "split", "category", "n")


@query
def O3_model_select(spark, sf):
    a, b = majority_rows(spark, sf)
    b = b.withColumn("prediction", F.lit(models.majority(a)))
    both = metrics.blocks(a, "group_id").withColumn("model", F.lit("rule")).unionByName(metrics.blocks(b, "group_id").withColumn("model", F.lit("majority")))
    return rounded(models.select_model(both)).select("model", "accuracy", "macro_f1")


@query
def O5_head(spark, sf):
    return table(spark, sf, "orders").orderBy("o_orderkey").limit(25).select("o_orderkey", "o_custkey")


@query
def O6_seeded_sample(spark, sf):
    return ranking.sample(images(spark, sf), "segment", "image_id", 15).select("segment", "image_id", F.col("rank").cast("long").alias("rank"))


@query
def O8_sorted_distinct(spark, sf):
    d = table(spark, sf, "part").select("p_type", "p_brand").distinct()
    return metrics.ranked(d, [F.asc("p_type"), F.asc("p_brand")]).select(F.col("position").cast("long").alias("position"), "p_type", "p_brand")


# Set operations


@query
def U1_U2_unions(spark, sf):
    s = split_images(spark, sf)
    train, validation = s.where("split = 'train'").select("segment"), s.where("split = 'validation'").select("segment")
    every = train.unionByName(validation)
    return every.agg(F.count("*").alias("all_rows")).crossJoin(every.distinct().agg(F.count("*").alias("distinct_rows")))  # one row each


@query
def U3_U6_sets(spark, sf):
    a, b = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    parts = {"intersection": a.intersect(b), "left_only": a.subtract(b), "right_only": b.subtract(a), "symmetric_difference": a.subtract(b).union(b.subtract(a))}
    return audit.union([p.agg(F.count("*").alias("n")).select(F.lit(k).alias("set"), "n") for k, p in parts.items()])


# Scalar functions


@query
def F1_F2_digests(spark, sf):
    return families(spark, sf).select("category", F.sha2("category", 256).alias("sha256"), C.stable_seed(F.col("category")).alias("seed"))


@query
def F4_F6_strings(spark, sf):
    p = table(spark, sf, "part")
    path = F.concat(F.lit("src\\"), F.lower("p_brand"), F.lit("\\"), F.replace("p_name", F.lit(" "), F.lit("_")), F.when(F.col("p_partkey") % 50 == 0, "/../x.JPG").otherwise(".jpg"))
    clean = F.replace(path, F.lit("\\"), F.lit("/"))
    return p.select("p_partkey", C.display_name(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("display"), F.lpad(F.col("p_size").cast("string"), 4, "0").alias("padded"), F.element_at(C.parts_of_path(path), -1).alias("file"), F.endswith(F.lower(clean), F.lit(".jpg")).alias("is_jpg"), C.safe_archive_path(path).alias("safe"))


@query
def F7_tokens(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"), F.size(F.array_distinct(T.terms(F.col("text")))).cast("long").alias("n_terms"))


@query
def F8_tfidf_fit(spark, sf):
    train = split_documents(spark, sf).where("split = 'train'")
    return rounded(T.fit(train, "doc_id", "text", 512).select("term", "df", F.col("total").cast("long").alias("total"), "idf", F.col("index").cast("long").alias("index")))


@query
def F9_tfidf_transform(spark, sf):
    d = split_documents(spark, sf)
    return rounded(T.transform(d.where("split = 'test'"), T.fit(d.where("split = 'train'"), "doc_id", "text", 512), "doc_id", "text"))


@query
def F10_recognised(spark, sf):
    d = split_documents(spark, sf)
    return T.recognised(d.where("split = 'test'"), T.fit(d.where("split = 'train'"), "doc_id", "text", 512), "doc_id", "text")


@query
def F11_F12_hashes(spark, sf):
    return hashes(spark, sf).select("id", "split", "phash", "dhash")


@query
def F13_hamming(spark, sf):
    return hashes(spark, sf).select("id", C.hamming(F.col("phash"), F.col("dhash")).cast("long").alias("distance"))


@query
def F14_math(spark, sf):
    n = images(spark, sf).groupBy("category").agg(F.count("*").alias("n"), F.avg("image_id").alias("mean_id"), F.median("image_id").alias("median_id"), F.percentile("image_id", F.lit(0.975)).alias("high"))
    return rounded(n.select("category", C.half_even(F.col("n") * 0.15).alias("part"), F.abs(F.col("n") - 60).alias("gap"), "mean_id", "median_id", "high"))


@query
def F15_softmax(spark, sf):
    logits = F.transform("embedding", lambda x: x.cast("double") * 10)
    e = table(spark, sf, "embeddings").select("vec_id", C.softmax(logits).alias("p"))
    return rounded(e.select("vec_id", C.argmax(F.col("p")).cast("long").alias("best"), F.array_max("p").alias("score"), checksums(F.col("p"))[1]))


@query
def F16_F21_arrays(spark, sf):
    """Whole embeddings as 64 pixels of three channels, and as 8 rows of 8 values."""
    e = table(spark, sf, "embeddings")
    places = F.sequence(F.lit(0), F.lit(63))
    colours = F.transform(places, lambda i: F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda k: F.get("embedding", (i + k) % 64).cast("double") * 255))
    n = F.flatten(C.normalize(colours, C.CHANNEL_MEANS, C.CHANNEL_DEVIATIONS))
    pixels = C.pixel_vector(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.transform(F.slice("embedding", 8 * i + 1, 8), lambda x: x.cast("double") * 255)))
    joined = e.select("vec_id", F.concat(n, pixels).alias("v"))
    return rounded(joined.select("vec_id", F.size("v").cast("long").alias("size"), *checksums(F.col("v"))))


@query
def F18_augmentation(spark, sf):
    e = table(spark, sf, "embeddings")
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.transform(F.slice("embedding", 8 * i + 1, 8), lambda x: F.abs(x.cast("double"))))
    return rounded(e.select("vec_id", *checksums(F.flatten(C.augment(rows, F.col("vec_id"))))))


@query
def F19_json(spark, sf):
    p = predictions(spark, sf).groupBy("category").agg(F.count("*").alias("n"))
    return p.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n"))))).alias("document"))


# Models


@query
def M1_majority(spark, sf):
    p = predictions(spark, sf)
    best = models.majority(p)
    return rounded(p.groupBy("category").agg(F.lit(best).alias("prediction"), F.avg((F.col("label") == best).cast("int")).alias("accuracy")))


#: Iterations that each baseline may take: text, pixels, both.  Fixed values.
ITERATIONS = {"text": 3000, "pixels": 3000, "both": 4000}


def labelled_features(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """doc_id, split, quality label and sparse features: TF-IDF of the text (fitted on the train split), an embedding as the pixels, or both, pixels first."""
    d = split_documents(spark, sf).join(table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id")
    if kind != "pixels":
        d = d.join(T.sparse(d, T.fit(d.where("split = 'train'"), "doc_id", "text", 512), "doc_id", "text", "t"), "doc_id")
    if kind != "text":
        e = table(spark, sf, "embeddings")
        d = d.withColumn("vec_id", F.col("doc_id") % e.count()).join(e.select("vec_id", regression.from_dense(F.col("embedding"), 64).alias("p")), "vec_id")
    features = F.col("t") if kind == "text" else F.col("p") if kind == "pixels" else regression.beside(F.col("p"), F.col("t"))
    return sinks.written(d.select("doc_id", "split", "label", features.alias("features")), "regression")


def regressed(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """Predictions of the test split and the probability of label 1."""
    from pyspark.ml.functions import vector_to_array

    rows = regression.vectors(labelled_features(spark, sf, kind), "features")
    model = regression.fit(rows.where("split = 'train'"), "features", "label", max_iter=ITERATIONS[kind])
    return rounded(model.transform(rows.where("split = 'test'")).select("doc_id", F.col("prediction").cast("int").alias("prediction"), F.element_at(vector_to_array("probability"), 2).alias("probability")))


def optimum(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """Each feature's sum over the train rows of a class, and the objective's derivative there, which is 0 if the solver has converged."""
    train = labelled_features(spark, sf, kind).where("split = 'train'")
    model = regression.fit(regression.vectors(train, "features"), "features", "label", max_iter=ITERATIONS[kind])
    found = regression.stationarity(model, train, "features", "label")
    return found.select("class", "index", F.round("observed", 6).alias("observed"), (F.round("gradient", 4) + 0.0).alias("gradient"))


@query
def M3_M5_parameters(spark, sf):
    """Parameters of each network for the vocabulary of the train texts and the nations as categories."""
    d = split_documents(spark, sf).where("split = 'train'")
    words, categories = T.fit(d, "doc_id", "text", 342).count(), families(spark, sf).count()
    return networks.parameter_counts(spark, words, categories=categories).groupBy("network").agg(F.sum("parameters").alias("parameters"), F.count("*").alias("arrays"))


def pictured(spark: SparkSession, sf: str, image: tuple[int, ...]) -> DataFrame:
    """vec_id, image (whole embeddings again and again, in as many numbers as the network reads), text (the embedding)."""
    value = lambda i: F.get("embedding", (i % 64).cast("int")).cast("double")
    size = int(np.prod(image))
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), value).alias("image"), F.transform("embedding", lambda v: v.cast("double")).alias("text"))


@query
def M3_small_network_scores(spark, sf):
    """All embeddings as pictures of 8 x 8 pixels and as texts, scored by the small network of both encoders."""
    network = networks.RelationNetwork("small_multimodal", (3, 8, 8), 64)
    return rounded(models.score(pictured(spark, sf, (3, 8, 8)), network, "vec_id", list(C.LABELS)))


@query
def M5_large_network_scores(spark, sf):
    """All embeddings as backbone features and as texts, scored by the large network."""
    network = networks.RelationNetwork("large_multimodal", (512,), 64)
    return rounded(models.score(pictured(spark, sf, (512,)), network, "vec_id", list(C.LABELS)))


@query
def M2_logistic_regression(spark, sf):
    return regressed(spark, sf, "text")


@query
def M2_pixels_regression(spark, sf):
    return regressed(spark, sf, "pixels")


@query
def M2_F17_combined_regression(spark, sf):
    return regressed(spark, sf, "both")


@query
def M2_text_optimum(spark, sf):
    return optimum(spark, sf, "text")


@query
def M2_pixels_optimum(spark, sf):
    return optimum(spark, sf, "pixels")


@query
def M2_F17_combined_optimum(spark, sf):
    return optimum(spark, sf, "both")


@query
def M4_M9_head_scores(spark, sf):
    """A small multimodal head network fitted on embeddings of the train split and scored on the test split."""
    e = ranking.stratified_split(table(spark, sf, "embeddings").withColumn("category", F.col("label").cast("string")), "category", "vec_id")
    wide = lambda a, n: F.transform(F.slice("embedding", a, n), lambda v: v.cast("double"))
    rows = e.select("vec_id", "split", wide(1, 48).alias("image"), wide(49, 16).alias("text"), F.pmod("label", F.lit(3)).cast("int").alias("label"), F.pmod("label", F.lit(3)).cast("int").alias("image_category"), F.pmod("label", F.lit(3)).cast("int").alias("text_category"))
    network = models.HeadNetwork("multimodal", 48, 16, 3, categories=3, hidden=16)
    training.fit(spark, network, training.pack(rows.where("split = 'train'"), ("label", "image_category", "text_category")), epochs=3, rate=0.01)
    return models.score(rows.where("split = 'test'").select("vec_id", "image", "text"), network, "vec_id", list(C.LABELS))


def embedded(spark: SparkSession, sf: str) -> DataFrame:
    """vec_id, split, image (the embedding), text (its last 16 values), label (0 to 2): whole embeddings as rows to train on."""
    numbers = lambda c: F.transform(c, lambda v: v.cast("double"))
    e = table(spark, sf, "embeddings").select("vec_id", F.pmod("label", F.lit(3)).cast("int").alias("label"), numbers(F.col("embedding")).alias("image"), numbers(F.slice("embedding", 49, 16)).alias("text"))
    return ranking.stratified_split(e, "label", "vec_id").drop("rank")


def trained(spark: SparkSession, rows: DataFrame, epochs: int, validation: training.Packed | None = None) -> tuple[models.HeadNetwork, training.History]:
    """A small network of the embeddings, fitted by steps over all rows at once."""
    packed, network = training.pack(rows), models.HeadNetwork("image_only", 64, 16, 3, hidden=8)
    return network, training.fit(spark, network, packed, epochs, validation, rate=0.05, dropout=False, chunks=len(packed.chunks))


@query
def M7_training_history(spark, sf):
    """Loss and validation metrics of each epoch of a network trained by whole-table steps, and which epoch is kept."""
    rows = sinks.written(embedded(spark, sf), "embedded")
    _, history = trained(spark, rows.where("split = 'train'"), 4, training.pack(rows.where("split = 'validation'")))
    return rounded(history.frame(spark))


@query
def M8_refit_and_test(spark, sf):
    """The same network fitted anew on train and validation for as many epochs as were best, and what it makes of the test split."""
    rows = sinks.written(embedded(spark, sf), "embedded")
    _, history = trained(spark, rows.where("split = 'train'"), 4, training.pack(rows.where("split = 'validation'")))
    network, _ = trained(spark, rows.where("split <> 'test'"), history.best_epoch)
    accuracy, macro_f1, matrix = training.evaluate(spark, network, training.pack(rows.where("split = 'test'")))
    cells = [(history.best_epoch, accuracy, macro_f1, t, g, int(n)) for t, line in enumerate(matrix) for g, n in enumerate(line) if n]
    return rounded(spark.createDataFrame(cells, "epochs int, accuracy double, macro_f1 double, label int, prediction int, n long"))


@query
def M9_scores_of_saved_weights(spark, sf):
    """Scores of all rows by a network with both encoders, its first weights saved and loaded again."""
    path = sinks.shared_dir(spark, "model")
    nothing = spark.createDataFrame([], "term string, idf double, index int")
    models.save(models.HeadNetwork("multimodal", 64, 16, 3, hidden=8), nothing, path, list(C.LABELS))
    network, _, _ = models.load(spark, path)
    return rounded(models.score(embedded(spark, sf).select("vec_id", "image", "text"), network, "vec_id", list(C.LABELS)))


def textures(spark: SparkSession, sf: str) -> DataFrame:
    """vec_id, and a picture of 20 to 26 rows of 30 to 34 pixels, all of whose values come from the whole embedding."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding", (20 + F.col("vec_id") % 7).cast("int").alias("h"), (30 + F.col("vec_id") % 5).cast("int").alias("w"))
    value = lambda k, y, x: F.floor(F.abs(F.get("embedding", ((13 * y + 7 * x + 5 * k) % 64).cast("int")).cast("double")) * 1e6) % 256
    across = lambda k, y: F.transform(F.sequence(F.lit(0), F.col("w") - 1), lambda x: value(k, y, x))
    channel = lambda k: F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda y: across(k, y))
    return e.select("vec_id", F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), channel).alias("channels"))


@query
def S6_F21_loaded_images(spark, sf):
    """Pictures written as PNG files, decoded, brought to 16 x 16 pixels, and flattened to shares of 0..1."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = [images_io.encode_png(np.moveaxis(np.array(c), 0, 2)) for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([f"files/{k}.png" for k in batch.column(0).to_pylist()], pa.string()), pa.array(files, pa.binary())], names=["path", "content"])

    path = sinks.shared_dir(spark, "pictures")
    textures(spark, sf).mapInArrow(packed, "path string, content binary").write.parquet(path)
    asked = table(spark, sf, "embeddings").select("vec_id", F.concat(F.lit("files\\"), "vec_id", F.lit(".png")).alias("path"))
    found = images_io.loaded(asked, spark.read.parquet(path), 16, 16).select("vec_id", C.pixel_vector(F.array(P.interleaved(F.col("channels")))).alias("v"))
    return rounded(found.select("vec_id", F.size("v").cast("long").alias("size"), *checksums(F.col("v"))))


@query
def F11_F12_resized_hashes(spark, sf):
    """Grey pictures of 32 x 32 and of 9 x 8 pixels and their hashes."""
    greys = textures(spark, sf).select("vec_id", P.grey(F.col("channels")).alias("g"))
    small = greys.select("vec_id", P.resized(F.col("g"), 32, 32, "lanczos").alias("a"), P.resized(F.col("g"), 9, 8, "lanczos").alias("b"))
    total, weighted = checksums(F.flatten(F.array(F.flatten("a"), F.flatten("b"))))
    return small.select("vec_id", C.perceptual_hash(F.col("a")).alias("phash"), C.difference_hash(F.col("b")).alias("dhash"), total, weighted)


@query
def F18_full_augmentation(spark, sf):
    """Whole embeddings as 8 x 8 pixels in three channels: mirrored, turned, and brightness, contrast and saturation changed."""
    value = lambda k, y, x: F.least(F.abs(F.get("embedding", ((8 * y + x + 21 * k) % 64).cast("int")).cast("double")), F.lit(1.0))
    eight = F.sequence(F.lit(0), F.lit(7))
    channels = F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda k: F.transform(eight, lambda y: F.transform(eight, lambda x: value(k, y, x))))
    changed = table(spark, sf, "embeddings").select("vec_id", P.changed(channels, F.col("vec_id")).alias("p"))
    return rounded(changed.select("vec_id", *checksums(P.interleaved(F.col("p")))))


# Files, archives, features, charts


def files_of_suppliers(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    """A folder with a file for each supplier, but for every 13th, and a manifest (sha256, path) of what they should hold; every 11th holds something else."""
    root = sinks.shared_dir(spark, "tree")
    s = table(spark, sf, "supplier")
    k, kind = F.col("s_suppkey"), F.element_at(F.array(F.lit("json"), F.lit("pt"), F.lit("txt"), F.lit("TMP")), (F.col("s_suppkey") % 4 + 1).cast("int"))
    folder = F.when(k % 9 == 0, F.lit(".hidden/old_Set")).when(k % 10 == 0, F.lit("__pycache__")).otherwise(F.concat(F.lit("nation/"), "s_nationkey"))
    rows = s.select(k.alias("k"), F.concat_ws("/", folder, F.concat_ws(".", k.cast("string"), kind)).alias("path"), F.col("s_name").alias("content"))
    files.written(rows.where("k % 13 <> 0").select("path", F.when(F.col("k") % 11 == 0, F.lit("changed")).otherwise(F.col("content")).cast("binary").alias("content")), root).count()
    return root, rows.select(F.sha2(F.col("content").cast("binary"), 256).alias("sha256"), "path")


@query
def P20_forbidden_paths(spark, sf):
    root, _ = files_of_suppliers(spark, sf)
    return files.forbidden_paths(spark, root, ["*.pt", "*.TMP"], ["OLD_set"], excluded=("__pycache__",))


@query
def P14_P20_tree(spark, sf):
    """Folders with the number and bytes of their files."""
    root, _ = files_of_suppliers(spark, sf)
    found = files.tree(spark, root).where("not folder")
    return found.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query
def S9_P14_verified_files(spark, sf):
    root, manifest = files_of_suppliers(spark, sf)
    return files.verified(spark, manifest, root)


@query
def S5_archive_source(spark, sf):
    """Archives of many documents each, read member by member by several tasks."""
    root = sinks.shared_dir(spark, "archives")
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
                for doc_id, text in zip(ids, batch.column(1).to_pylist(), strict=True):
                    z.writestr(f"data\\{doc_id}.JPG", text)
            yield pa.RecordBatch.from_arrays([pa.array([f"{ids[0]}.zip"], pa.string()), pa.array([out.getvalue()], pa.binary())], names=["path", "content"])

    files.written(docs.mapInArrow(packed, "path string, content binary"), root).count()
    return files.archive_members(spark, root, "data/", task_bytes=1 << 20).select("path", "safe", "crc_ok", "bytes", "sha256")


@query
def M6_S10_feature_store(spark, sf):
    """Features of all pictures, half of which an earlier request had left in the store."""
    small = textures(spark, sf).select("vec_id", F.transform("channels", lambda c: P.resized(c, 16, 16)).alias("channels"))
    small, path = sinks.written(small, "pictures"), sinks.shared_dir(spark, "features")
    extractor = features.Convolution(4)
    features.kept(small.where("vec_id % 2 = 0"), "vec_id", path, extractor)
    return rounded(features.kept(small, "vec_id", path, extractor).select("vec_id", F.posexplode("features").alias("filter", "feature")))


@query
def K4_published_tables(spark, sf):
    """Tables published together, the rows of each as read from where they were published, and whether all still fit their digests."""
    out = sinks.shared_dir(spark, "published")
    s = staged.Staged(spark, out, {"tables": "images and relations"})
    s.table("images", split_images(spark, sf), "split")
    s.table("relations", relations(spark, sf), "label")
    s.publish()
    intact = not staged.checked(spark, out)
    return audit.union([spark.read.parquet(f"{out}/{name}").agg(F.lit(name).alias("table"), F.count("*").alias("rows"), F.lit(intact).alias("intact")) for name in ("images", "relations")])


@query
def M12_bar_chart(spark, sf):
    path = sinks.shared_dir(spark, "chart") + ".json"
    points = metrics.blocks(predictions(spark, sf), "group_id", ["category"], STATES)
    charts.write(charts.bar(rounded(points), "category", ["accuracy", "macro_f1"], "Segments"), path)
    return charts.read(spark, path, "category string, series string, value double")


@query
def M12_line_chart(spark, sf):
    path = sinks.shared_dir(spark, "chart") + ".json"
    charts.write(charts.line(history(spark, sf), "epoch", "macro_f1", "model", "By day", None), path)
    return charts.read(spark, path, "model string, epoch long, macro_f1 double")


@query
def M12_heat_map(spark, sf):
    path = sinks.shared_dir(spark, "chart") + ".json"
    charts.write(charts.heat_map(metrics.confusion(predictions(spark, sf)), "label", "prediction", "n", STATES, "Confusion"), path)
    return charts.read(spark, path, "label string, prediction string, n double")


@query
def M12_histogram(spark, sf):
    path = sinks.shared_dir(spark, "chart") + ".json"
    charts.write(charts.histogram(table(spark, sf, "orders"), "o_totalprice", 20, "Prices"), path)
    return charts.read(spark, path, "bin int, rows long")


@query
def M10_predicted_records(spark, sf):
    """Parts as records, predicted by a saved model: every label's score and place, known terms, and the warning where there are none."""
    p = table(spark, sf, "part").select(F.concat(F.lit("p/"), "p_partkey", F.lit(".png")).alias("path"), F.when(F.col("p_partkey") % 5 == 0, "0000 zzzz").otherwise(F.col("p_name")).alias("description"), "p_partkey")
    n = table(spark, sf, "embeddings").count()
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("features"))
    pictures = p.withColumn("vec_id", F.col("p_partkey") % n).join(e, "vec_id").select("path", "features")
    vocabulary, path = T.fit(p.where("p_partkey % 5 <> 0"), "path", "description", 16), sinks.shared_dir(spark, "model")
    models.save(models.HeadNetwork("image_only", 64, 16, 3, hidden=8), vocabulary, path, list(C.LABELS))
    network, vocabulary, about = models.load(spark, path, list(C.LABELS), same_versions=True)
    found = workflows.predict(readers.uploads(p).where("problem is null"), pictures, vocabulary, network, about["labels"])
    return rounded(found.withColumn("recognised", F.col("recognised").cast("long")))
