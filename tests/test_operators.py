import itertools
import hashlib
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sparrel.functions import text as T
from sparrel.operators import audit, metrics, models, near_duplicates, pairs, ranking, resample, training


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# Metrics


def test_metric_block(spark):
    df = spark.createDataFrame([("a", "MATCH", "MATCH"), ("a", "MISMATCH", "MATCH"), ("b", "PARTIAL_MATCH", "PARTIAL_MATCH")], "g string, label string, prediction string")
    r = metrics.blocks(df, "g").first()
    assert (r.rows, r.independent_groups) == (3, 2) and abs(r.accuracy - 2 / 3) < 1e-12 and abs(r.macro_f1 - (2 / 3 + 0 + 1) / 3) < 1e-12


def test_macro_f1_label_rules(spark):
    df = spark.createDataFrame([("a", "F", "F"), ("b", "O", "O")], "g string, label string, prediction string")
    assert metrics.blocks(df, "g").first().macro_f1 == 1 and abs(metrics.blocks(df, "g", labels=["F", "O", "P"]).first().macro_f1 - 2 / 3) < 1e-12


def test_empty_slice_has_null_metrics(spark):
    df = spark.createDataFrame([], "g string, label string, prediction string")
    for labels in (None, ["F", "O"]):
        assert tuple(metrics.blocks(df, "g", labels=labels).first()) == (0, 0, None, None)


def test_collapsed_predictions(spark):
    df = spark.createDataFrame([(x, x, "MATCH") for x in ("MATCH", "MISMATCH", "PARTIAL_MATCH")], "g string, label string, prediction string")
    r = metrics.blocks(df, "g").first()
    assert abs(r.accuracy - 1 / 3) < 1e-12 and abs(r.macro_f1 - 1 / 6) < 1e-12


@pytest.mark.parametrize(("matrix", "accuracy", "macro"), [([[119, 30, 11], [13, 125, 22], [17, 33, 110]], 354 / 480, 0.738230), ([[2934, 27, 49], [100, 2831, 79], [121, 39, 2850]], 0.9540420819, 0.9540841368)])
def test_published_confusions(spark, matrix, accuracy, macro):
    labels = ["M", "P", "X"]
    cells = [(a, b, n) for a, line in zip(labels, matrix, strict=True) for b, n in zip(labels, line, strict=True)]
    counts = spark.createDataFrame(cells, "label string, prediction string, n long")
    f1 = metrics.per_class(counts).agg(F.avg("f1")).first()[0]
    assert abs(f1 - macro) < 1e-6
    assert abs(sum(n for a, b, n in cells if a == b) / sum(n for *_, n in cells) - accuracy) < 1e-9


def test_confusion_matrix_has_zero_rows_and_columns(spark):
    df = spark.createDataFrame([("F", "O")], "label string, prediction string")
    assert rows_of(metrics.confusion_matrix(df, ["F", "O", "P"]), "position", "label", "F", "O", "P") == [(0, "F", 0, 1, 0), (1, "O", 0, 0, 0), (2, "P", 0, 0, 0)]


# Splits and ranks


@pytest.mark.parametrize(("n", "sizes"), [(190, (28, 28, 134)), (210, (32, 32, 146))])
def test_split_sizes_round_half_to_even(spark, n, sizes):
    df = spark.range(n).select(F.lit("c").alias("category"), F.col("id"))
    got = {r.split: r["count"] for r in ranking.stratified_split(df, "category", "id").groupBy("split").count().collect()}
    assert (got["test"], got["validation"], got["train"]) == sizes


def test_hash_rank_is_a_dense_rank_with_ties(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), "id", F.sha2((F.col("id") % 50).cast("string"), 256).alias("h"))
    got = ranking.hash_rank(df, ["g"], F.col("h"), ["id"]).collect()
    for g in range(3):
        mine = sorted((r for r in got if r.g == g), key=lambda r: (r.h, r.id))
        assert [r["rank"] for r in mine] == list(range(1, 1001)) and {r.rank_of for r in mine} == {1000}


def test_early_stop(spark):
    losses = [5.0, 4.0, 4.00005, 3.99995, 4.5, 3.0]
    df = spark.createDataFrame([("m", k, v) for k, v in enumerate(losses)], "model string, epoch long, loss double")
    assert tuple(ranking.early_stop(df, "model", "epoch", "loss", patience=3).first()) == ("m", 1, 4.0, 4)
    assert tuple(ranking.early_stop(df, "model", "epoch", "loss", patience=9).first()) == ("m", 5, 3.0, None)


def test_best_epoch_takes_the_first_of_ties(spark):
    df = spark.createDataFrame([("m", 1, 0.5), ("m", 2, 0.7), ("m", 3, 0.7)], "model string, epoch long, macro_f1 double")
    assert tuple(models.best_epoch(df).first()) == ("m", 2, 0.7)


# Pairs

COUNTS = {"a1": 7, "a2": 3, "b1": 5, "b2": 5, "b3": 2, "c1": 4, "c2": 6, "d1": 3, "d2": 3}


def category_images(spark, counts=None):
    rows = [(f"{c}_{k}", c, c[0], f"{(k * 37) % 101:03d}") for c, n in (counts or COUNTS).items() for k in range(n)]
    return spark.createDataFrame(rows, "image_id string, category string, family string, sha256 string")


def brute_relations(counts):
    """The construction written out: units in turn, families by size, cyclic partners, rotation, counters."""
    images = {c: [f"{c}_{k}" for k in sorted(range(n), key=lambda k: (f"{(k * 37) % 101:03d}", f"{c}_{k}"))] for c, n in counts.items()}
    family = {}
    for c in sorted(counts):
        family.setdefault(c[0], []).append(c)
    quota = {c: 2 * max(counts[x] for x in family[c[0]]) for c in counts}
    order = [c for f in sorted(family, key=lambda f: (-sum(quota[c] for c in family[f]), f)) for c in family[f]]
    line = [(c, images[c][k % len(images[c])]) for c in order for k in range(quota[c])]
    shift = max(sum(quota[c] for c in v) for v in family.values())
    near = {c: v[(k + 1) % len(v)] for v in family.values() for k, c in enumerate(v)}
    out, templates, seen = [], {}, {}
    for label in ("MATCH", "PARTIAL_MATCH", "MISMATCH"):
        for pos, (c, image) in enumerate(line):
            text = c if label == "MATCH" else near[c] if label == "PARTIAL_MATCH" else line[(pos + shift) % len(line)][0]
            t = templates[label, text] = templates.get((label, text), -1) + 1
            k = seen[image, label] = seen.get((image, label), 0) + 1
            out.append((f"{image}_{label.lower()}_{k:02d}", image, c, text, f"{'one' if t % 2 == 0 else 'two'} {text}", label))
    return sorted(out)


def test_relations_against_the_written_out_construction(spark):
    got = pairs.relations(category_images(spark), ("one {name}", "two {name}"))
    assert rows_of(got, "sample_id", "image_id", "part_category", "text_category", "description", "label") == brute_relations(COUNTS)
    assert audit.balance(got, "image_id", "label", ["MATCH", "MISMATCH", "PARTIAL_MATCH"]).where("not balanced").count() == 0
    assert audit.balance(got, "description", "label", ["MATCH", "MISMATCH", "PARTIAL_MATCH"]).where("not balanced").count() == 0
    families = category_images(spark).select("category", "family").distinct()
    r = audit.rule_violations(got, families).first()
    assert r.total == len(brute_relations(COUNTS)) and sum(r[c] for c in r.asDict() if c != "total") == 0


@pytest.mark.parametrize(("counts", "message"), [({"a1": 2, "b1": 2, "b2": 2}, "single category"), ({"a1": 9, "a2": 9, "b1": 1, "b2": 1}, "more than half")])
def test_impossible_hierarchies_are_an_error(spark, counts, message):
    with pytest.raises(PySparkException, match=message):
        pairs.relations(category_images(spark, counts), ("one {name}", "two {name}")).collect()


# Resampling


def test_exact_sign_flip_against_enumeration(spark):
    for seed in range(3):
        rng = random.Random(seed)
        values = [rng.randrange(-4, 5) for _ in range(9)]
        df = spark.createDataFrame(list(enumerate(values)), "g long, difference long")
        hits = sum(abs(sum(s * v for s, v in zip(signs, values, strict=True))) >= abs(sum(values)) for signs in itertools.product((-1, 1), repeat=9))
        r = resample.sign_flip_exact(df).first()
        assert (r.assignments, r.extreme) == (512, hits) and r.p_value == hits / 512
        assert resample.sign_flip(df, "g").first().method == "exact"


def test_exact_sign_flip_needs_two_to_twenty_groups(spark):
    for n in (1, 21):
        with pytest.raises(ValueError, match="groups"):
            resample.sign_flip_exact(spark.range(n).select(F.col("id").alias("g"), F.lit(1).cast("long").alias("difference")))


def test_monte_carlo_is_near_the_exact_value(spark):
    values = [3, -1, 2, 2, -2, 1, 4, 1, 1, 2, -1, 2]
    df = spark.createDataFrame(list(enumerate(values)), "g long, difference long")
    exact = resample.sign_flip_exact(df).first().p_value
    assert abs(resample.sign_flip_monte_carlo(df, "g", repeats=4000).first().p_value - exact) < 0.03
    none = df.withColumn("difference", F.lit(0).cast("long"))
    assert resample.sign_flip_monte_carlo(none, "g", repeats=50).first().p_value == 1
    many = spark.range(30).select(F.col("id").alias("g"), F.lit(1).cast("long").alias("difference"))
    assert resample.sign_flip(many, "g", repeats=100).first().method == "monte_carlo"


def test_paired_rows_must_agree(spark):
    a = spark.createDataFrame([(1, "g", True), (2, "g", False)], "k long, g string, correct boolean")
    assert tuple(resample.summary(resample.differences(resample.paired(a, a, "k", "g"), "g")).first())[:5] == (1, 2, 1, 1, 0)
    for b in (a.where("k = 1"), a.withColumn("g", F.lit("h"))):
        with pytest.raises(PySparkException, match="differ"):
            resample.paired(a, b, "k", "g").collect()


def test_bootstrap_of_one_group_is_a_point(spark):
    df = spark.createDataFrame([("a", "F", "F"), ("a", "O", "F"), ("a", "O", "O")], "g string, label string, prediction string")
    r = resample.bootstrap(df, "g", ["F", "O"], repeats=20).first()
    assert abs(r.accuracy_low - 2 / 3) < 1e-12 and r.accuracy_low == r.accuracy_high and r.macro_f1_low == r.macro_f1_high


def test_bootstrap_is_near_the_normal_interval(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(g, "F", "F" if rng.random() < 0.7 else "O") for g in range(300)], "g long, label string, prediction string")
    r = resample.bootstrap(df, "g", ["F", "O"], repeats=400).first()
    p = df.where("label = prediction").count() / 300
    half = 1.96 * (p * (1 - p) / 300) ** 0.5
    assert abs(r.accuracy_low - (p - half)) < 0.02 and abs(r.accuracy_high - (p + half)) < 0.02


def test_both_ways_to_draw_a_bootstrap_agree(spark, monkeypatch):
    rng = random.Random(2)
    df = spark.createDataFrame([(k % 37, rng.choice("FO"), rng.choice("FO")) for k in range(200)], "g long, label string, prediction string")
    found = [{r.replicate: (r.accuracy, r.macro_f1) for r in resample.bootstrap_replicates(df, "g", ["F", "O"], repeats=30).collect()}]
    monkeypatch.setattr(resample, "LOCAL_GROUPS", 0)
    found.append({r.replicate: (r.accuracy, r.macro_f1) for r in resample.bootstrap_replicates(df, "g", ["F", "O"], repeats=30).collect()})
    assert found[0] == found[1] and len(found[0]) == 30
    groups = sorted(range(37), key=lambda g: (hashlib.sha256(str(g).encode()).hexdigest(), g))
    rows = df.collect()
    for b in range(30):
        drawn = [groups[int(hashlib.sha256(f"42|{b}|{s // 5}".encode()).hexdigest()[12 * (s % 5) :][:12], 16) % 37] for s in range(37)]
        taken = [r for g in drawn for r in rows if r.g == g]
        assert abs(found[0][b][0] - sum(r.label == r.prediction for r in taken) / len(taken)) < 1e-12


def test_sign_flips_against_brute_force(spark):
    values = {f"g{k}": k % 5 - 2 for k in range(23)}
    df = spark.createDataFrame(list(values.items()), "g string, difference long")
    sums = []
    for r in range(700):
        bit = lambda g, r=r: int(hashlib.sha256(f"42|{r // 256}|{g}".encode()).hexdigest(), 16) >> (255 - r % 256) & 1
        sums.append(abs(sum(v if bit(g) else -v for g, v in values.items())))
    found = resample.sign_flip_monte_carlo(df, "g", repeats=700).first()
    assert found.extreme == sum(s >= abs(sum(values.values())) for s in sums) and found.repeats == 700


# Near duplicates


def test_banded_pairs_are_all_pairs(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(4)]
    rows = []
    for k in range(150):
        p, d = rng.choice(base), rng.choice(base)
        for _ in range(rng.randrange(7)):
            p ^= 1 << rng.randrange(64)
            d ^= 1 << rng.randrange(64)
        signed = [x - (1 << 64) if x >= 1 << 63 else x for x in (p, d)]
        rows.append((k, rng.choice("ab"), rng.choice(("train", "validation", "test")), *signed))
    df = spark.createDataFrame(rows, "id long, category string, split string, phash long, dhash long")
    order = {"train": 0, "validation": 1, "test": 2}
    limits = near_duplicates.SEVERITIES
    want = []
    for x in rows:
        for y in rows:
            if x[1] == y[1] and order[x[2]] < order[y[2]]:
                pd, dd = ((a ^ b).bit_count() if a ^ b >= 0 else ((a ^ b) + (1 << 64)).bit_count() for a, b in ((x[3], y[3]), (x[4], y[4])))
                s = next((n for n, a, b in limits if pd <= a and dd <= b), None)
                if s:
                    want.append((s, x[0], y[0], pd, dd))
    for banded in (True, False):
        assert rows_of(near_duplicates.pairs(df, banded=banded), "severity", "left_id", "right_id", "phash_distance", "dhash_distance") == sorted(want, key=repr)
    assert len(want) > 20


def test_no_pairs_keep_the_schema(spark):
    none = spark.createDataFrame([], "id long, category string, split string, phash long, dhash long")
    found = near_duplicates.pairs(none)
    assert len(found.columns) == 8 and rows_of(near_duplicates.severity_counts(found), "severity", "pairs", "flagged") == [("screen", 0, 0), ("strict", 0, 0), ("very_strict", 0, 0)]


# Audits


def test_enforce(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    assert audit.enforce(audit.uniqueness(df, [["v"]])).count() == 1
    with pytest.raises(ValueError, match=r"unique\(k\): 1"):
        audit.enforce(audit.uniqueness(df, [["k"]]))
    with pytest.raises(ValueError, match="missing columns: w, x"):
        audit.require_columns(df, ["k", "x", "w"])


def test_overlap_counts_distinct_values(spark):
    df = spark.createDataFrame([("train", "a"), ("train", "a"), ("test", "a"), ("test", "b"), ("validation", "b"), ("test", None)], "split string, v string")
    assert rows_of(audit.overlap(df, "split", ["train", "validation", "test"], ["v"]), "left", "right", "shared") == [("train", "test", 1), ("train", "validation", 0), ("validation", "test", 1)]


def test_other_checks(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, n long")
    assert audit.same(a, a, ["k", "n"]).first().ok and not audit.same(a, a.where("n = 1"), ["k", "n"]).first().ok
    assert audit.margins_differ(a, a.where("n = 1")).collect()[0].side == "actual"
    assert audit.recomputed({"a": 1.0, "b": None}, {"a": 1.0 + 1e-13, "b": 2.0, "c": 3.0}) == ["b", "c"]
    texts = spark.createDataFrame([("f.py", "import torch")], "path string, value string")
    assert rows_of(audit.forbidden_text(texts, "path", "value", ["torch", "numpy"]), "path", "word") == [("f.py", "torch")]
    plan = spark.createDataFrame([("a", "f", "b", "c"), ("b", "f", "a", "d"), ("c", "g", "d", "a"), ("d", "g", "c", "b")], "category string, family string, partial_partner string, mismatch_partner string")
    assert audit.plan_check(plan).where("not ok").count() == 0
    broken = plan.withColumn("partial_partner", F.lit("a"))
    assert {r.check for r in audit.plan_check(broken).where("not ok").collect()} == {"partial_partner_repeated", "partial_partner_itself", "partial_partner_family"}


# Models


def test_majority_breaks_ties_by_label(spark):
    assert models.majority(spark.createDataFrame([("b",), ("a",)], "label string")) == "a"
    assert models.majority(spark.createDataFrame([], "label string")) is None


@pytest.mark.parametrize("kind", ["text_only", "image_only", "multimodal"])
def test_gradients_are_those_of_finite_differences(kind):
    rng = np.random.default_rng(0)
    net = models.HeadNetwork(kind, 5, 4, 3, categories=2 if kind == "multimodal" else 0, hidden=6)
    args = [rng.normal(size=(7, 5)), rng.normal(size=(7, 4)), rng.integers(0, 3, 7), rng.integers(0, 2, 7), rng.integers(0, 2, 7)]
    _, g = net.loss_and_gradients(*args)
    assert g.keys() == net.weights.keys()
    for k, w in net.weights.items():
        at = tuple(rng.integers(0, s) for s in w.shape)
        w[at] += 1e-6
        up = net.loss_and_gradients(*args)[0]
        w[at] -= 2e-6
        down = net.loss_and_gradients(*args)[0]
        w[at] += 1e-6
        assert abs((up - down) / 2e-6 - g[k][at]) < 1e-5


def test_network_learns_in_spark_and_scores_without_labels(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4))
    rows = [(k, [float(v) for v in x[k, :2]], [float(v) for v in x[k, 2:]], int(x[k, 0] > 0), 0, 1) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, image array<double>, text array<double>, label int, image_category int, text_category int").repartition(3)
    net = models.HeadNetwork("multimodal", 2, 2, 2, categories=2, hidden=8)
    history = training.fit(spark, net, training.pack(df, ("label", "image_category", "text_category")), epochs=12, rate=0.05, chunks=1)
    assert history.epochs[-1]["train_loss"] < 0.6 * history.epochs[0]["train_loss"] and history.best_epoch is None
    scored = models.score(df.select("id", "image", "text"), net, "id", ["NO", "YES"])
    assert scored.columns == ["id", "prediction", "model_score", "score_no", "score_yes"]
    right = scored.join(df, "id").where((F.col("prediction") == "YES") == (F.col("label") == 1)).count()
    assert right > 270
    with pytest.raises(ValueError, match="label"):
        models.score(df.select("id", "image", "text", "label"), net, "id", ["NO", "YES"])


def test_parameter_counts_of_the_networks(spark):
    from sparrel.operators import networks

    # Published counts of trainable parameters.
    published = {"small_text": 24131, "small_image": 21459, "small_multimodal": 58579, "small_multimodal_no_auxiliary": 57923}
    found = {r.network: r.n for r in networks.parameter_counts(spark, 342).groupBy("network").agg(F.sum("parameters").alias("n")).collect()}
    assert {k: found[k] for k in published} == published and set(found) == set(networks.NETWORKS)
    with pytest.raises(ValueError, match="unknown"):
        networks.layers("x", 3)


def test_unknown_values_are_named_in_order(spark):
    from sparrel.operators import audit

    df = spark.createDataFrame([("A",), ("z",), (None,), ("b",), ("z",)], "v string")
    assert audit.require_values(df.where("v = 'A' or v is null"), "v", ["A"]).count() == 2
    with pytest.raises(ValueError, match="unknown values of v: b, z$"):
        audit.require_values(df, "v", ["A", "B"])
    many = spark.range(70).selectExpr("lpad(id, 2, '0') v")
    with pytest.raises(ValueError, match="00, 01 and 68 more"):
        audit.require_values(many, "v", ["A"], shown=2)


def test_a_bootstrap_of_many_groups_makes_no_row_for_a_draw(spark, monkeypatch):
    rng = random.Random(3)
    df = spark.createDataFrame([(k % 61, rng.choice("FO"), rng.choice("FO")) for k in range(300)], "g long, label string, prediction string")
    some = resample.bootstrap_replicates(df, "g", ["F", "O"], repeats=12)
    found = [sorted(map(tuple, some.collect()))]
    monkeypatch.setattr(resample, "LOCAL_GROUPS", 0)
    for slots, size in ((10, 12 * 7), (5, 12 * 7), (1000, 12)):  # several pieces of a replicate, several ranges
        monkeypatch.setattr(resample, "SLOTS", slots)
        monkeypatch.setattr(resample, "RANGE_BYTES", size)
        by_range = resample.bootstrap_replicates(df, "g", ["F", "O"], repeats=12)
        assert "Generate" not in by_range._jdf.queryExecution().executedPlan().toString()
        found.append(sorted(map(tuple, by_range.collect())))
    assert len(found[0]) == 12 and all(f == found[0] for f in found)


def test_frames_are_compared_once(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x"), (3, "y")], "k long, v string")
    b = spark.createDataFrame([(1, None), (2, "z"), (3, "y"), (3, "y")], "k long, v string")
    found = audit.same(a, b, ["k", "v"])
    assert tuple(found.first()) == ("frames_equal", 4, False)
    assert tuple(audit.same(a.limit(0), a.limit(0), ["k", "v"]).first()) == ("frames_equal", 0, True)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 2 and "Generate" not in plan  # each frame is read once, and no surplus row is repeated


def test_a_limited_vocabulary_is_made_once_and_exact(spark, monkeypatch):
    rng = random.Random(4)
    texts = [None, "", "x", *(" ".join(rng.choice(["aa", "bb", "cc", "dd é1", "É1", f"w{rng.randrange(40)}"]) for _ in range(rng.randrange(1, 60))) for _ in range(40))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(T, "COUNTED_TOKENS", 50)
    whole = {r.term: (r.df, r.total) for r in docs.select("doc_id", F.explode(T.terms(F.col("text"))).alias("term")).groupBy("term").agg(F.countDistinct("doc_id").alias("df"), F.count("*").alias("total")).collect()}
    assert {r.term: (r.df, r.total) for r in T.term_statistics(docs, "text").collect()} == whole
    for n in (3, 9, 25, 10_000):
        v = T.fit(docs, "doc_id", "text", n)
        assert [(r.term, (r.df, r.total)) for r in v.orderBy("index").collect()] == sorted(sorted(whole.items(), key=lambda t: (-t[1][1], t[0]))[:n])
        assert "Aggregate" not in v._jdf.queryExecution().optimizedPlan().toString()  # reading it counts nothing again
    known = T.fit(docs, "doc_id", "text", 9)
    want = {(r.doc_id, r.term, r.n) for r in docs.select("doc_id", F.explode(T.terms(F.col("text"))).alias("term")).join(known, "term").groupBy("doc_id", "term").agg(F.count("*").alias("n")).collect()}
    assert {tuple(r) for r in T.known_counts(docs, known, "doc_id", "text").collect()} == want
    monkeypatch.setattr(T, "MAX_BROADCAST_TERMS", 2)
    assert {(r.doc_id, r.term, r.n) for r in T.known_counts(docs, known, "doc_id", "text").collect()} == want
