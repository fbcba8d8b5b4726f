"""Whole runs: build and lock a dataset, check it, choose a model on validation, test it once, audit saved predictions, predict one record.

Tables go to Parquet folders, documents to one-line JSON text, both below one path that Spark can write; nothing that exists is overwritten.
A build is validated before anything is published."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import text as T
from ..operators import audit, metrics, models, near_duplicates, pairs, ranking, training
from ..sources import readers, sinks, staged

# Names and kinds of the candidate networks.
CANDIDATES = (("text_only", "text_only", False), ("image_only", "image_only", False), ("multimodal_no_auxiliary", "multimodal", False), ("multimodal_auxiliary", "multimodal", True))
LABELS = list(C.LABELS)
#: Columns of the test split that its lock covers.
LOCKED = ["sample_id", "image_id", "text_category", "description", "label"]


def write_document(spark: SparkSession, document: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(document, sort_keys=True),)], "value string").coalesce(1).write.text(path)


def read_document(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


_digest = staged.rows_digest


def build(spark: SparkSession, images: DataFrame, out: str, templates: dict[str, tuple[str, str]], relations_only: bool = False) -> dict:
    """Split images (image_id, category, family, sha256) unless they have a split already, make relations for each split, validate, write images,
    relations (by split), categories and a lock: all at once, see sources.staged.  A build that was stopped goes on where it was."""
    audit.require_columns(images, ("image_id", "category", "family", "sha256"))
    if not relations_only:
        images = ranking.stratified_split(images.drop("split", "rank"), "category", "image_id")
    parts = [pairs.relations(images.where(F.col("split") == s), templates[s], "final_test" if s == "test" else "development").withColumn("split", F.lit(s)) for s in readers.SPLITS]
    relations = sinks.written(audit.union(parts), "relations")  # checked and published as they are
    categories = images.select("category", "family").distinct()
    violations = [c for c in audit.rule_violations(relations, categories).columns if c != "total"]
    checks = [
        audit.uniqueness(images, [["image_id"], ["sha256"]]), audit.uniqueness(relations, [["sample_id"]]),
        audit.rule_violations(relations, categories).select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("value"), (F.col(c) == 0).alias("ok")) for c in violations])).alias("x")).select("x.*"),
        audit.overlap(images, "split", list(readers.SPLITS), ["image_id", "sha256"]).select(F.concat_ws("_", "left", "right", "column").alias("check"), F.col("shared").alias("value"), (F.col("shared") == 0).alias("ok")),
        *[audit.finding(audit.balance(relations, by, "label", LABELS).where("not balanced"), f"unbalanced({by})", F.count("*"), 0) for by in ("image_id", "description")],
    ]
    audit.enforce(audit.union(checks))
    stage = staged.Staged(spark, out, {"images": _digest(images, ["image_id", "category", "family", "sha256", "split"]), "templates": {k: list(v) for k, v in templates.items()}})
    stage.table("images", images, "split")
    test = stage.table("relations", relations, "split").where("split = 'test'")
    stage.table("categories", readers.category_index(categories, "category", "family"))
    lock = {"test_rows": test.count(), "test_digest": _digest(test, LOCKED), "official": True}
    stage.document("lock", lock)
    stage.publish()
    return lock


def check(spark: SparkSession, out: str, include_locked_test: bool = False) -> DataFrame:
    """Findings over a built dataset; the test split's digest only on request."""
    relations = spark.read.parquet(f"{out}/relations").where(F.lit(True) if include_locked_test else F.col("split") != "test")
    categories = spark.read.parquet(f"{out}/categories")
    found = [audit.uniqueness(relations, [["sample_id"]]), audit.domain(relations.select(F.col("part_category").alias("category")), "category", categories, "category")]
    if include_locked_test:
        lock = read_document(spark, f"{out}/lock")
        test = relations.where("split = 'test'")
        same = _digest(test, LOCKED) == lock["test_digest"]
        found.append(spark.createDataFrame([("lock", 0 if same else 1, same)], "check string, value long, ok boolean"))
    return audit.union(found)


def looked_up(rows: DataFrame, dimension: DataFrame, key: str, value: str) -> DataFrame:
    """rows with a dimension's columns by key; a key that the dimension lacks (a null one too) or whose value is null is an error, never a lost row."""
    met = rows.join(dimension, key, "left")
    error = F.raise_error(F.concat(F.lit(f"no {value} for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return met.withColumn(value, F.when(F.col(value).isNull(), error.cast(met.schema[value].dataType)).otherwise(F.col(value)))


def _inputs(spark: SparkSession, out: str, features: DataFrame, vocabulary: DataFrame, relations: DataFrame) -> DataFrame:
    """sample_id, image, text, and codes of label and categories; text features are made once per distinct description."""
    categories = spark.read.parquet(f"{out}/categories")
    audit.require_values(relations, "label", LABELS)
    once = relations.select("description").distinct()
    texts = T.dense(once, vocabulary, "description", "description")
    rows = looked_up(relations, texts, "description", "text")
    rows = looked_up(rows, features.select("image_id", F.col("features").alias("image")), "image_id", "image")
    for side, name in (("part_category", "image_category"), ("text_category", "text_category_code")):
        rows = looked_up(rows, pairs.small(categories.select(F.col("category").alias(side), F.col("index").alias(name))), side, name)
    return rows.select("sample_id", "image_id", "part_category", "text_category", "label", "image", "text", C.encode(F.col("label"), LABELS).cast("int").alias("code"), "image_category", F.col("text_category_code"))


_CODES = ("code", "image_category", "text_category_code")


def _network(kind: str, auxiliary: bool, sizes: tuple[int, int, int], seed: int, hidden: int = 128) -> models.HeadNetwork:
    return models.HeadNetwork(kind, sizes[0], sizes[1], len(LABELS), sizes[2] if auxiliary else 0, seed=seed, hidden=hidden)


def _scored(rows: DataFrame, network: models.HeadNetwork) -> DataFrame:
    guess = models.score(rows.select("sample_id", "image", "text"), network, "sample_id", LABELS).select("sample_id", "prediction", "model_score")
    return rows.select("sample_id", "image_id", "part_category", "text_category", "label").join(guess, "sample_id").withColumn("correct", F.col("label") == F.col("prediction"))


def validate(spark: SparkSession, out: str, features: DataFrame, epochs: int = 8, max_text_features: int = 512, seed: int = 44, hidden: int = 128, batch: int = models.BATCH_ROWS, **options) -> dict:
    """Fit each candidate on train, measure it on validation after each epoch, keep its best epoch's state, and write the selection: most macro F1, then accuracy.

    options go to training.fit()."""
    train, validation = (readers.relations(spark, f"{out}/relations", s) for s in ("train", "validation"))
    vocabulary = sinks.written(T.fit(train, "sample_id", "description", max_text_features), "vocabulary")
    sizes = (len(features.first()["features"]), vocabulary.count(), spark.read.parquet(f"{out}/categories").count())
    b = sinks.written(_inputs(spark, out, features, vocabulary, validation), "validation")
    packed = [training.pack(r, _CODES, batch, seed) for r in (_inputs(spark, out, features, vocabulary, train), b)]
    table = []
    for k, (name, kind, auxiliary) in enumerate(CANDIDATES):
        network = _network(kind, auxiliary, sizes, seed + k, hidden)
        history = training.fit(spark, network, packed[0], epochs, packed[1], seed=seed + k, **options)
        r = metrics.blocks(_scored(b, network), "image_id").first()
        table.append({"model": name, "accuracy": r.accuracy, "macro_f1": r.macro_f1, "epochs": history.best_epoch, "seed": seed + k, "history": history.epochs})
    best = max(table, key=lambda r: (r["macro_f1"], r["accuracy"]))
    settings = {"hidden": hidden, "batch": batch, **options}
    summary = {"versions": sinks.versions(), "models": table, "selected": best, "text_features": sizes[1], "max_text_features": max_text_features, "settings": settings}
    write_document(spark, summary, f"{out}/validation")
    return summary


def final_test(spark: SparkSession, out: str, features: DataFrame, confirm: bool) -> dict:
    """Fit the selected model on train and validation, for as many epochs as its best one took and as it was fitted before, and score the test split, once: needs
    confirmation, an intact lock, the versions that chose the model, and no earlier result."""
    if not confirm:
        raise PermissionError("the final test needs confirmation")
    audit.enforce(check(spark, out, include_locked_test=True))
    chosen = read_document(spark, f"{out}/validation")
    sinks.require_versions(chosen["versions"])
    name, kind, auxiliary = next(c for c in CANDIDATES if c[0] == chosen["selected"]["model"])
    development = readers.relations(spark, f"{out}/relations", "train").unionByName(readers.relations(spark, f"{out}/relations", "validation"))
    test = readers.relations(spark, f"{out}/relations", "test", allow_locked_test=True)
    vocabulary = sinks.written(T.fit(development, "sample_id", "description", chosen["max_text_features"]), "vocabulary")
    sizes = (len(features.first()["features"]), vocabulary.count(), spark.read.parquet(f"{out}/categories").count())
    settings, seed = dict(chosen["settings"]), chosen["selected"]["seed"]
    network = _network(kind, auxiliary, sizes, seed, settings.pop("hidden"))
    rows = training.pack(_inputs(spark, out, features, vocabulary, development), _CODES, settings.pop("batch"), seed)
    training.fit(spark, network, rows, chosen["selected"]["epochs"], seed=seed, **settings)
    scored = sinks.written(_scored(_inputs(spark, out, features, vocabulary, test), network), "predictions")
    if scored.count() != test.count():
        raise ValueError("not every test row has a prediction")
    scored.write.parquet(f"{out}/predictions")
    models.save(network, vocabulary, f"{out}/model", LABELS)
    saved = spark.read.parquet(f"{out}/predictions")
    r = metrics.blocks(saved, "image_id").first()
    matrix = [list(x)[2:] for x in metrics.confusion_matrix(saved, LABELS).orderBy("position").collect()]
    summary = {"model": name, "rows": r.rows, "images": r.independent_groups, "accuracy": r.accuracy, "macro_f1": r.macro_f1, "confusion": matrix, "predictions": _digest(saved, ["sample_id", "prediction"])}
    write_document(spark, summary, f"{out}/final_test")
    return summary


def audit_result(spark: SparkSession, out: str, hashes: DataFrame, limits=C.SEVERITIES) -> dict[str, DataFrame]:
    """Saved predictions against the summary, equal-weight image accuracy, metrics by category, and sensitivity to near duplicates.

    hashes: id (of the image), category, split, phash, dhash."""
    saved, summary = spark.read.parquet(f"{out}/predictions"), read_document(spark, f"{out}/final_test")
    r = metrics.blocks(saved, "image_id", labels=LABELS).first()
    if audit.recomputed({"accuracy": r.accuracy, "rows": r.rows}, {k: summary[k] for k in ("accuracy", "rows")}) or _digest(saved, ["sample_id", "prediction"]) != summary["predictions"]:
        raise ValueError("the saved predictions differ from their summary")
    found = near_duplicates.pairs(hashes, limits)
    return {
        "images": metrics.group_accuracy(saved, "image_id", F.col("correct")), "categories": metrics.blocks(saved, "image_id", ["part_category"], LABELS), "near_duplicates": found,
        "severities": near_duplicates.severity_counts(found, limits), "sensitivity": near_duplicates.sensitivity(saved, found, "image_id", LABELS, limits),
    }


def predict_saved(spark: SparkSession, model: str, path: str, description: str, features: DataFrame, same_versions: bool = False) -> DataFrame:
    """predict() of one record by a saved model whose bundle is in order; features: path, features (a path without any is an error)."""
    network, vocabulary, about = models.load(spark, model, LABELS, same_versions)
    return predict(readers.single_record(spark, path, description), features, vocabulary, network, about["labels"])


def predict(records: DataFrame, features: DataFrame, vocabulary: DataFrame, network: models.HeadNetwork, labels: list[str] = LABELS) -> DataFrame:
    """path, place, label, score, recognised, warning of each record (path, description; paths distinct), the best label first.

    recognised: how many distinct terms of the description the model knows; where it knows none, a warning says that the picture alone decides."""
    row = records.select("path", T.require_text(F.col("description")).alias("description"))
    texts, known = T.dense(row, vocabulary, "path", "description"), T.recognised(row, vocabulary, "path", "description")
    inputs = looked_up(row.select("path"), features.select("path", F.col("features").alias("image")), "path", "image").join(texts, "path")
    scores = models.score(inputs.select("path", "image", "text"), network, "path", labels)
    each = [F.struct((-F.col(f"score_{x.lower()}")).alias("s"), F.lit(x).alias("label")) for x in labels]
    placed = scores.join(known, "path").select("path", F.posexplode(F.sort_array(F.array(*each))).alias("place", "x"), "recognised")
    warning = F.when(F.col("recognised") == 0, "no term of the description is known; the picture alone decides")
    return placed.select("path", "place", "x.label", (-F.col("x.s")).alias("score"), "recognised", warning.alias("warning")).orderBy("path", "place")
