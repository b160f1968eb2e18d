"""The engine against golden values, worked examples, and independent computations in plain Python."""

import hashlib
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldspar import config, schema, storage
from veldspar.functions import distance, quantize, vectorize
from veldspar.operators import evaluate, index, kmeans, knn, score
from veldspar.sources import generate, readers, sinks

# The worked payloads and the vectors that the rules give them.
NO_HISTORY = {
    "id": "a", "transaction": {"amount": 41.12, "installments": 2, "requested_at": "2026-03-11T18:45:53Z"},
    "customer": {"avg_amount": 82.24, "tx_count_24h": 3, "known_merchants": ["MERC-003", "MERC-016"]}, "merchant": {"id": "MERC-016", "mcc": "5411", "avg_amount": 60.25},
    "terminal": {"is_online": False, "card_present": True, "km_from_home": 29.23}, "last_transaction": None,
}
FRAUD = {
    "id": "b", "transaction": {"amount": 9505.97, "installments": 10, "requested_at": "2026-03-14T05:15:12Z"},
    "customer": {"avg_amount": 81.28, "tx_count_24h": 20, "known_merchants": ["MERC-008", "MERC-007", "MERC-005"]}, "merchant": {"id": "MERC-068", "mcc": "7802", "avg_amount": 54.86},
    "terminal": {"is_online": False, "card_present": True, "km_from_home": 952.27}, "last_transaction": None,
}
HISTORY = {
    "id": "c", "transaction": {"amount": 384.88, "installments": 3, "requested_at": "2026-03-11T20:23:35Z"},
    "customer": {"avg_amount": 769.76, "tx_count_24h": 3, "known_merchants": ["MERC-009", "MERC-001"]}, "merchant": {"id": "MERC-001", "mcc": "5912", "avg_amount": 298.95},
    "terminal": {"is_online": False, "card_present": True, "km_from_home": 13.709}, "last_transaction": {"timestamp": "2026-03-11T14:58:35Z", "km_from_current": 18.8626},
}
GOLDEN = {
    "a": [0.0041, 0.1667, 0.05, 0.7826, 0.3333, -1, -1, 0.0292, 0.15, 0, 1, 0, 0.15, 0.006],
    "b": [0.9506, 0.8333, 1, 0.2174, 0.8333, -1, -1, 0.9523, 1, 0, 1, 1, 0.75, 0.0055],
    "c": [0.0385, 0.25, 0.05, 0.8696, 0.3333, 0.2257, 0.0189, 0.0137, 0.15, 0, 1, 0, 0.2, 0.0299],
}


def vectors(spark, *bodies, **settings):
    texts = [b if isinstance(b, str) or b is None else json.dumps(b) for b in bodies]
    df = vectorize.parse(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, body string"))
    return {r.n: r for r in vectorize.vectorize(df, ("n", "id", "reject", "incomplete"), **settings).collect()}


def test_golden_vectors(spark):
    for r in vectors(spark, NO_HISTORY, FRAUD, HISTORY).values():
        assert r.reject is None and not r.incomplete
        assert [round(x, 4) for x in r.vector] == pytest.approx(GOLDEN[r.id], abs=1e-4)


def change(base, **paths):
    out = json.loads(json.dumps(base))
    for path, value in paths.items():
        part, key = path.split("__") if "__" in path else (None, path)
        (out[part] if part else out)[key] = value
    return out


def test_corner_cases_of_payloads(spark):
    r = vectors(
        spark, change(FRAUD, customer__avg_amount=0), change(HISTORY, last_transaction={"timestamp": "2026-03-12T00:00:00Z", "km_from_current": 1.0}), change(HISTORY, last_transaction={"km_from_current": 5.0}),
        change(FRAUD, merchant__mcc="0001"), change(FRAUD, customer__known_merchants=[]), json.dumps(FRAUD).replace("9505.97", "1e3"), "not json", change(FRAUD, transaction__amount=25000.0),
        change(FRAUD, customer__known_merchants=[f"MERC-{i}" for i in range(40)] + ["MERC-068"]), "{}", None, change(FRAUD, transaction__requested_at="yesterday"), change(FRAUD, transaction__requested_at="2026-03-14T07:15:12+02:00"),
        change(FRAUD, merchant__id="", customer__known_merchants=[""]), change(FRAUD, merchant__id="MERC-0687", customer__known_merchants=["MERC-0688"]), "[1]")
    assert r[0].vector[2] == 0 and r[1].vector[5] == 0
    assert r[2].vector[5] == -1 and r[2].vector[6] == -1
    assert r[3].vector[12] == 0.5 and r[4].vector[11] == 1 and r[5].vector[0] == pytest.approx(0.1)
    assert r[6].reject == "malformed" and r[10].reject == "malformed" and r[15].reject == "malformed" and r[11].reject == "time"
    assert r[7].vector[0] == 1 and r[8].vector[11] == 0
    assert r[9].reject == "amount" and r[9].incomplete
    assert r[12].vector == r[14].vector[:0] + r[12].vector and r[12].vector[3] == pytest.approx(5 / 23)
    assert r[13].vector[11] == 0 and r[14].vector[11] == 1


def test_missing_fields_have_defaults(spark):
    v = vectors(spark, {"transaction": {"amount": 100}})[0]
    assert v.reject is None and v.incomplete
    assert list(v.vector) == pytest.approx([0.01, 0, 0, 0, 0, -1, -1, 0, 0, 0, 0, 1, 0.5, 0], abs=1e-6)


def test_fractional_minutes(spark):
    body = change(HISTORY, last_transaction={"timestamp": "2026-03-11T20:22:05Z", "km_from_current": 1.0})
    assert vectors(spark, body)[0].vector[5] == pytest.approx(1 / 1440)
    assert vectors(spark, body, fractional_minutes=True)[0].vector[5] == pytest.approx(1.5 / 1440)


@pytest.mark.parametrize("space,values", [("i8", [(-1, -128), (0, 0), (1, 127), (0.5, 64), (-0.004, -1), (-0.0039, 0), (2, 127)]), ("i16", [(-1, -32768), (1, 10000), (0.00005, 1), (5, 32767), (-0.00005, 0)])])
def test_quantize(spark, space, values):
    df = spark.createDataFrame([(float(v),) for v, _ in values], "v float").select("v", quantize.quantize(F.col("v"), space).alias("q"))
    assert [r.q for r in df.collect()] == [q for _, q in values]
    with pytest.raises(ValueError):
        quantize.quantize(F.col("v"), "i32")


@pytest.mark.parametrize("a,b,space,want", [([0, 25, 51], [0, 25, 51], "i8", 0), ([0, 0], [127, 0], "i8", 16129), ([127, -127], [-127, 127], "i8", 129032), ([0], [10000], "i16", 10**8), ([10000, -10000], [-10000, 10000], "i16", 8 * 10**8), ([-1, -1], [1, 1], "f32", 8), ([0, 0], [3, 4], "f32", 25), ([-32768] * 14, [32767] * 14, "i16", 14 * 65535**2)])
def test_distances(spark, a, b, space, want):
    df = spark.createDataFrame([([float(x) for x in a], [float(x) for x in b])], "a array<double>, b array<double>")
    kind = f"array<{quantize.space_of(space).type}>"
    got = df.select(distance.squared_l2(F.col("a").cast(kind), F.col("b").cast(kind), len(a), space).alias("d")).first().d
    assert got == want


def table(spark, rows, dims=14):
    """(dim 0, label) to references with the other dimensions 0."""
    return spark.createDataFrame([(i, [float(x)] + [0.0] * (dims - 1), label == "fraud") for i, (x, label) in enumerate(rows)], schema.REFERENCE)


# The labelled points of the quality guard.
GUARD = [(i / 100, "legit") for i in range(20)] + [(0.4 + i / 100, "legit") for i in range(10)] + [(0.5 + i / 100, "fraud") for i in range(10)] + [(0.8 + i / 100, "fraud") for i in range(20)]


def exact(rows, q, k):
    return [i for _, i in sorted(((x - y) ** 2 if not isinstance(x, list) else sum((a - b) ** 2 for a, b in zip(x, y)), i) for i, (x, y) in enumerate((r, q) for r in rows))][:k]


def test_probes_reach_the_recall(spark):
    r = random.Random(6)
    refs = spark.createDataFrame([(i, [r.uniform(-1, 1) for _ in range(6)], False) for i in range(600)], "ref_id long, vector array<float>, is_fraud boolean")
    full = refs.select("ref_id", quantize.quantized(F.col("vector"), 6, "i8").alias("vector"), "is_fraud").persist()
    q = full.where("ref_id % 10 = 0").select(F.col("ref_id").alias("query_id"), "vector")
    true = {(x.query_id, x.ref_id) for x in knn.brute(full, q, 6, "i8").collect()}
    found = index.build(refs, 6, "i8", clusters=20)
    recall = lambda n: sum((x.query_id, x.ref_id) in true for x in knn.ivf(found, q, 5, n).collect()) / len(true)
    nprobe, said = knn.probes_for(found, q, 5, 0.9)
    assert 1 < nprobe < 20 and said >= 0.9
    assert recall(nprobe) == pytest.approx(said) and recall(nprobe - 1) < 0.9
    assert knn.probes_for(found, q.limit(0)) == (1, 1.0)


@pytest.mark.parametrize("space", ["i8", "i16"])
def test_pruned_equals_brute(spark, space):
    refs = table(spark, GUARD)
    q = spark.createDataFrame([(i, [x] + [0.0] * 13) for i, x in enumerate((0.05, 0.1, 0.15, 0.3, 0.35, 0.42, 0.5, 0.57, 0.85, 0.9, 0.95))], "query_id long, vector array<float>")
    q = q.select("query_id", quantize.quantized(F.col("vector"), 14, space).alias("vector"))
    full = refs.select("ref_id", quantize.quantized(F.col("vector"), 14, space).alias("vector"), "is_fraud")
    want = sorted(map(tuple, knn.brute(full, q, 14, space).collect()))
    assert len(want) == 55 and want == sorted(map(tuple, knn.brute(full, q, 14, space, kernel="arrow", block_bytes=300).collect()))
    found = index.build(refs, 14, space, clusters=6, iterations=10)
    for nprobe in (1, 2, 6):
        assert want == sorted(map(tuple, knn.pruned(found, q, nprobe=nprobe).collect()))
    lows = {r.cluster_id: r for r in found.clusters.collect()}
    for r in found.records.collect():
        box = lows[r.cluster_id]
        assert all(lo <= x <= hi for lo, x, hi in zip(box.low, r.vector, box.high, strict=True))
    assert sum(c.n for c in lows.values()) == 60


def test_ties_order_and_few_references(spark):
    refs = spark.createDataFrame([(i, [1, 0], i % 2 == 0) for i in (5, 3, 9, 1)], "ref_id long, vector array<short>, is_fraud boolean")
    q = spark.createDataFrame([(7, [0, 0])], "query_id long, vector array<short>")
    for kernel in ("codegen", "arrow"):
        got = knn.brute(refs, q, 2, "i16", 3, kernel=kernel).orderBy("rank").collect()
        assert [r.ref_id for r in got] == [1, 3, 5]
        few = knn.brute(refs, q, 2, "i16", 10, kernel=kernel)
        assert few.count() == 4
        none = knn.brute(refs.limit(0), q, 2, "i16", 3, kernel=kernel)
        s = score.decide(score.vote(none, q, 5)).first()
        assert (s.fraud_count, s.fraud_score, s.approved) == (0, 0.0, True)
    assert score.vote(few, q, 5).first().fraud_score == 0.0


def test_worked_example(spark):
    rows = [([1.0, 0.96, 0.96], True), ([0.8, 0.9, 0.5], True), ([0.0, 0.0, 0.0], False), ([0.1, 0.2, 0.1], False), ([0.95, 0.92, 0.99], True), ([0.2, 0.1, 0.3], False)]
    refs = spark.createDataFrame([(i, v, f) for i, (v, f) in enumerate(rows)], schema.REFERENCE)
    q = spark.createDataFrame([(0, [1.0, 0.96, 0.96])], "query_id long, vector array<float>")
    got = score.decide(score.vote(knn.search(refs, q, "brute", dims=3, space="f32", k=3), q, 3)).first()
    assert got.fraud_score == 1.0 and not got.approved
    for metric in ("l1", "cosine"):
        assert knn.brute(refs, q, 3, "f32", 1, metric=metric).first().ref_id == 0
    with pytest.raises(ValueError):
        knn.search(refs, q, "tree")


@pytest.mark.parametrize("k,threshold", [(5, 0.6), (10, 0.5), (1, 0.3), (1024, 0.7)])
def test_response_table(spark, k, threshold):
    rows = score.response_table(spark, k, threshold).orderBy("fraud_count").collect()
    assert len(rows) == k + 1
    for r in rows:
        assert json.loads(r.body) == {"approved": r.fraud_count / k < threshold, "fraud_score": r.fraud_count / k}


def test_kmeans_keeps_incumbents_and_empty_clusters(spark):
    points = spark.createDataFrame([(0, [0], 1), (1, [10], 1), (2, [5], 1), (3, [5], None)], "ref_id long, vector array<byte>, current int")
    start = [[0], [10], [100]]
    want = {0: 0, 1: 1, 2: 1, 3: 0}
    assert {r.ref_id: r.cluster_id for r in kmeans.assign(points, kmeans.frame(spark, start)).collect()} == want
    assert {r.ref_id: r.cluster_id for r in kmeans.assign_fast(points, start).collect()} == want
    new = {r.cluster_id: (r.centroid, r.n) for r in kmeans.update(kmeans.assign_fast(points, start), kmeans.frame(spark, start), 1).collect()}
    assert new == {0: ([3], 2), 1: ([8], 2), 2: ([100], 0)}
    assert kmeans.fit(points, 2, 1, 5) == kmeans.fit(points.repartition(3), 2, 1, 5)


def test_search_reads_the_folders_it_needs(spark, tmp_path):
    refs = generate.references(spark, 2000)
    built = index.build(refs, 14, "i16", clusters=40, iterations=3)
    index.write(built.arranged(), str(tmp_path / "index"), shards=10)
    back = index.read(spark, str(tmp_path / "index"))
    assert back.size() == 40 and back.per_shard == 4
    some = back.of_clusters([1, 2, 17])
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*shard#\d+ IN \(0,4\)", plan) and re.search(r"PushedFilters: \[[^]]*In\(cluster_id", plan), plan
    assert len(some.select(F.input_file_name().alias("f")).distinct().collect()) < len(back.records.select(F.input_file_name()).distinct().collect())
    assert {r.cluster_id for r in some.collect()} <= {1, 2, 17}
    full = refs.select("ref_id", quantize.quantized(F.col("vector"), 14, "i16").alias("vector"), "is_fraud")
    q = full.where("ref_id % 50 = 0").select(F.col("ref_id").alias("query_id"), "vector")
    want = sorted(map(tuple, knn.brute(full, q, 14, "i16").collect()))
    assert want == sorted(map(tuple, knn.pruned(back, q, nprobe=3).collect()))
    assert want == sorted(map(tuple, knn.pruned(back, q, nprobe=3, block_bytes=2000).collect()))  # in several blocks
    assert sorted(map(tuple, knn.ivf(back, q, nprobe=5).collect())) == sorted(map(tuple, knn.ivf(built, q, nprobe=5, block_bytes=2000).collect()))


def test_one_cluster_holds_most(spark):
    refs = spark.createDataFrame([(i, [0.5] * 14 if i % 3 else [i / 3000] * 14, i % 2 == 0) for i in range(3000)], schema.REFERENCE)
    full = refs.select("ref_id", quantize.quantized(F.col("vector"), 14, "i16").alias("vector"), "is_fraud")
    q = full.where("ref_id % 100 = 0").select(F.col("ref_id").alias("query_id"), "vector")
    found = index.build(refs, 14, "i16", clusters=7, iterations=2).arranged()
    want = sorted(map(tuple, knn.brute(full, q, 14, "i16", 4, kernel="codegen").collect()))
    assert want == sorted(map(tuple, knn.pruned(found, q, 4, nprobe=1).collect())) == sorted(map(tuple, knn.brute(full, q, 14, "i16", 4).collect()))
    assert knn.pruned(found, q.limit(0)).count() == 0 and knn.ivf(found, q.limit(0)).count() == 0


def test_shared_folder(spark):
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="checkpoint"):
        storage.shared_dir(Session())
    assert storage.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_index_round_trip(spark, tmp_path):
    built = index.build(table(spark, GUARD), 14, "i16", clusters=4, iterations=3)
    index.write(built, str(tmp_path / "index"), shards=2)
    back = index.read(spark, str(tmp_path / "index"))
    assert back.ready() and back.warm() == 60 and (back.space, back.dims) == ("i16", 14)
    assert sorted(map(str, back.records.drop("shard").collect())) == sorted(map(str, built.records.select(*back.records.drop("shard").columns).collect()))
    firsts = back.clusters.orderBy("cluster_id").collect()
    assert [c.first for c in firsts] == [sum(x.n for x in firsts[:i]) for i in range(len(firsts))]
    (tmp_path / "index/meta").joinpath("x").write_text("")
    with pytest.raises(ValueError):
        index.build(table(spark, GUARD), 14, "f32")


SCORES = [(0, 0, 0, 1, 3000.0, 3000.0, 6000.0), (5, 5, 0, 3, 2522.88, 2001.27, 4524.15), (0, 0, 0, 100, 1000.0, 3000.0, 4000.0), (30, 20, 0, 10, 2000.0, 1157.02, 3157.02), (100, 50, 0, 300, 522.88, 581.13, 1104.01), (500, 250, 0, 200, 698.97, -327.12, 371.85), (500, 300, 0, 10, 2000.0, -3000.0, -1000.0), (0, 0, 5000, 60000, -3000.0, -3000.0, -6000.0)]


def test_scores(spark):
    rows = [(i, 0, 5000 - fp - fn - e, fp, fn, e, float(p)) for i, (fp, fn, e, p, *_) in enumerate(SCORES)]
    df = spark.createDataFrame(rows, "i int, tp long, tn long, fp long, fn long, err long, p99 double")
    got = evaluate.scored(evaluate.weighted(df)).orderBy("i").collect()
    for r, want in zip(got, SCORES, strict=True):
        assert (r.p99_score, r.detection_score, r.final_score) == pytest.approx(want[4:], abs=0.01)
    doc = json.loads(evaluate.result_document(evaluate.scored(evaluate.weighted(df))).orderBy("i").first().json)
    assert doc["scoring"]["final_score"] == 6000.0 and doc["scoring"]["raw"]["p99_ms"] == 1.0


def test_confusion_and_rates(spark):
    rows = [(False, False)] * 3 + [(True, True)] * 4 + [(False, True)] * 2 + [(True, False)] + [(None, True)]
    c = evaluate.confusion(spark.createDataFrame(rows, "approved boolean, expected_approved boolean"))
    assert tuple(c.first()) == (3, 4, 2, 1, 1)
    r = evaluate.rates(c).first()
    assert (r.precision, r.recall, r.fpr) == pytest.approx((0.6, 0.75, 2 / 6))
    empty = evaluate.rates(evaluate.confusion(spark.createDataFrame([], "approved boolean, expected_approved boolean"))).first()
    assert (empty.precision, empty.recall, empty.f1, empty.fpr) == (0, 0, 0, 0)


def test_load_profile_and_plateau(spark):
    one = evaluate.load_profile(spark.createDataFrame([(1, 120, 900)], "stage int, duration_s int, target int")).first()
    assert one.requests == 54060
    w = spark.createDataFrame([(i, x) for i, x in enumerate((100.0, 50.0, 50.5, 50.0, 80.0, 80.0))], "step int, latency double")
    assert [r.stable for r in evaluate.plateau(w).orderBy("step").collect()] == [0, 0, 1, 2, 0, 1]


def test_generator_follows_its_ratios(spark):
    rows = generate.payloads(spark, 4000, 0.4, 7)
    share = {r.profile: r["count"] / 4000 for r in rows.groupBy("profile").count().collect()}
    assert share[0] == pytest.approx(0.6, abs=0.03) and share[1] == pytest.approx(0.36, abs=0.03) and share[2] == pytest.approx(0.04, abs=0.02)
    assert rows.where("last_transaction is null").count() / 4000 == pytest.approx(0.2, abs=0.03)
    assert rows.where("terminal.is_online and terminal.card_present").count() == 0
    assert rows.where("profile = 1 and (transaction.amount < 2000 or transaction.installments not between 6 and 12)").count() == 0
    assert sorted(map(str, rows.collect())) == sorted(map(str, generate.payloads(spark, 4000, 0.4, 7, parts=3).collect()))
    refs = generate.references(spark, 300)
    assert refs.where("exists(vector, x -> x < 0 and x <> -1) or exists(vector, x -> x > 1)").count() == 0
    got = generate.labelled(refs, generate.payloads(spark, 60, 0.47, 4141))
    stats = evaluate.dataset_stats(got).first()
    assert stats.total == 60 and stats.fraud_count + stats.legit_count == 60


def test_reference_files(spark, tmp_path):
    import gzip

    rows = [{"vector": [i / 10] * 14, "label": "fraud" if i % 2 else "legit", "more": 1} for i in range(5)]
    with gzip.open(tmp_path / "r.json.gz", "wt") as f:
        json.dump([*rows, {"vector": [0.5] * 14}], f)
    got = readers.references(spark, str(tmp_path / "r.json.gz")).orderBy("ref_id").collect()
    assert [r.is_fraud for r in got] == [False, True, False, True, False, False]
    with pytest.raises(Exception, match="components"):
        with gzip.open(tmp_path / "bad.json.gz", "wt") as f:
            json.dump([{"vector": [1.0] * 13, "label": "fraud"}], f)
        readers.references(spark, str(tmp_path / "bad.json.gz")).collect()
    with pytest.raises(Exception):
        readers.references(spark, str(tmp_path / "r.json.gz"), strict=True).collect()
    sinks.write_references(readers.references(spark, str(tmp_path / "r.json.gz")), str(tmp_path / "out"))
    back = readers.references(spark, str(tmp_path / "out"), strict=True)
    assert back.where("is_fraud").count() == 2 and back.count() == 6
    assert readers.checksum(spark, str(tmp_path / "r.json.gz")) == hashlib.sha256((tmp_path / "r.json.gz").read_bytes()).hexdigest()


def test_files_written_are_read_back(spark, tmp_path):
    refs = generate.references(spark, 3000, parts=3)
    sinks.write_references(refs.unionByName(refs.limit(0).coalesce(1)), str(tmp_path / "refs"))
    back = readers.references(spark, str(tmp_path / "refs"), strict=True)
    want, got = ([(tuple(round(x, 4) for x in r.vector), r.is_fraud) for r in df.collect()] for df in (refs, back))
    assert sorted(want) == sorted(got) and len(got) == 3000
    rows = generate.payloads(spark, 40, random_dates=True)
    entries = rows.select(F.col("row").alias("position"), F.struct("id", "transaction", "customer", "merchant", "terminal", "last_transaction").alias("request"), F.col("coin").alias("expected_approved"), F.lit(0.6).alias("expected_fraud_score"))
    sinks.write_test_set(entries.repartition(4), evaluate.dataset_stats(entries), "ab", str(tmp_path / "set"))
    back, stats = readers.test_set(spark, str(tmp_path / "set"))
    assert [(r.position, r.request, r.expected_approved) for r in back.orderBy("position").collect()] == [(r.position, r.request, r.expected_approved) for r in entries.orderBy("position").collect()]
    assert stats.first().total == 40 and stats.first().edge_case_count == 40 and stats.first().references_checksum_sha256 == "ab"
    sinks.write_test_set(entries.limit(0), evaluate.dataset_stats(entries.limit(0)), "ab", str(tmp_path / "none"))
    assert readers.test_set(spark, str(tmp_path / "none"))[0].count() == 0


def test_random_dates(spark):
    rows = generate.payloads(spark, 2000, random_dates=True)
    days = rows.agg(F.min("transaction.requested_at"), F.max("transaction.requested_at"), F.countDistinct("id")).first()
    assert "2026-03" <= days[0][:7] < "2026-06" and "2030-09" < days[1][:7] <= "2030-12" and days[2] == 2000
    gap = F.unix_seconds(F.to_timestamp("transaction.requested_at")) - F.unix_seconds(F.to_timestamp("last_transaction.timestamp"))
    gaps = rows.where("last_transaction is not null").select(gap.alias("s")).agg(F.min("s"), F.max("s"), F.count_if(F.col("s") % 60 != 0)).first()
    assert 0 < gaps[0] and 3500 * 86_400 < gaps[1] <= 3650 * 86_400 and gaps[2] > 1000


def test_result_files(spark, tmp_path):
    def put(folder, name, p99, final, breakdown=True):
        (tmp_path / folder).mkdir(exist_ok=True)
        doc = {"p99": f"{p99}ms", "scoring": {"final_score": final, "raw": {"p99_ms": p99}} | ({"breakdown": {"true_positive_detections": 9}} if breakdown else {})}
        (tmp_path / folder / name).write_text(json.dumps(doc, indent=1))

    put("i16_K2048_nprobe2", "aggregate.json", 1.5, 10.0, breakdown=False)
    put("i16_K2048_nprobe2", "results_run1.json", 1.25, 11.0)
    put("i8_K256_nprobe4", "results.json", 2.5, 12.0)
    put("i8_K512_nprobe4", "aggregate.json", 3.5, 13.0)
    put("i8_K512_nprobe4", "results_run1.json", 4.5, 14.0)
    got = {(r.dtype, r.clusters, r.nprobe): (r.p99, r.final_score, r.tp) for r in readers.run_results(spark, str(tmp_path)).collect()}
    assert got == {("i16", 2048, 2): (1.25, 11.0, 9), ("i8", 256, 4): (2.5, 12.0, 9), ("i8", 512, 4): (3.5, 13.0, 9)}


def test_documents_of_runs_are_read_back(spark, tmp_path):
    runs = spark.createDataFrame([("i16", 2048, 2, 10, 20, 1, 0, 0, 1.5), ("i16", 2048, 2, 12, 20, 1, 0, 0, 2500.0), ("i8", 64, 4, 5, 5, 0, 1, 0, 3.0)], "dtype string, clusters int, nprobe int, tp long, tn long, fp long, fn long, err long, p99 double")
    scored = evaluate.scored(evaluate.weighted(runs))
    sinks.write_aggregates(evaluate.aggregate_documents(scored), str(tmp_path / "all"))
    got = {(r.dtype, r.clusters, r.nprobe): r for r in readers.run_results(spark, str(tmp_path / "all")).collect()}
    r = got["i16", 2048, 2]
    assert (r.p99, r.tp, r.tn, r.fp, r.p99_cut, r.detection_cut) == (1250.75, 11, 20, 1, True, False) and set(got) == {("i16", 2048, 2), ("i8", 64, 4)}
    first = evaluate.result_document(scored.where("dtype = 'i8'")).first()
    (tmp_path / "one/i8_K64_nprobe4").mkdir(parents=True)
    (tmp_path / "one/i8_K64_nprobe4/results_run1.json").write_text(first.json)
    back = readers.run_results(spark, str(tmp_path / "one")).first()
    assert (back.dtype, back.p99, back.fn) == ("i8", 3.0, 1) and back.final_score == pytest.approx(round(first.final_score, 2)) and back.p99_score == pytest.approx(round(first.p99_score, 2))


def test_percentiles_approximate(spark):
    rows = spark.range(100_000).select((F.col("id") % 7).alias("k"), F.xxhash64("id").cast("double").alias("x"))
    exact_, near = ({r.k: r for r in evaluate.percentiles(rows, "x", ("k",), exact=e).collect()} for e in (True, False))
    for k, r in exact_.items():
        below = rows.where(f"k = {k}").agg(*[F.avg((F.col("x") <= near[k][p]).cast("double")) for p in ("p50", "p95", "p99")]).first()
        assert all(abs(b - want) < 0.001 for b, want in zip(below, (0.5, 0.95, 0.99), strict=True)) and r.p50 == pytest.approx(near[k].p50, rel=0.2, abs=2e17)


def test_grid_is_bounded(spark):
    with pytest.raises(ValueError, match="combinations"):
        evaluate.parameter_grid(spark.range(1), spark.range(20).toDF("b"), most=10)


def test_json_array_split(spark):
    df = spark.createDataFrame([('[{"a": "x}\\"{"}, {"b": [1, 2]}]',)], "body string")
    assert [json.loads(r.object) for r in readers.split_array(df).orderBy("position").collect()] == [{"a": 'x}"{'}, {"b": [1, 2]}]


def test_config():
    assert config.EngineConfig.from_env({"VELDSPAR_K": "7", "VELDSPAR_THRESHOLD": "0.5", "OTHER": "1"}) == config.EngineConfig(k=7, threshold=0.5)
    with pytest.raises(ValueError):
        config.EngineConfig(space="i32")
    assert config.read_numbers('{"a": 1, "a": 2.5}') == {"a": 2.5}
    with pytest.raises(ValueError):
        config.read_numbers('{"a": "x"}')
    assert len(config.LIMITS) == 7 and len(config.MCC_RISK) == 10


def test_stream_equals_batch(spark, tmp_path):
    from veldspar.streaming import scorer

    refs = generate.references(spark, 200).persist()
    built = index.build(refs, 14, "i16", clusters=8, iterations=3)
    bodies = [json.dumps(b) for b in (NO_HISTORY, FRAUD, HISTORY)] + ["broken"]
    (tmp_path / "in").mkdir()
    for i in range(2):
        (tmp_path / "in" / f"{i}.txt").write_text("\n".join(bodies[2 * i : 2 * i + 2]) + "\n")
    scorer.start(scorer.text_source(spark, str(tmp_path / "in")), built, str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination()
    got = {r.id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {r.id: r for r in scorer.score_bodies(spark.createDataFrame(list(enumerate(bodies)), "request long, body string"), built).collect()}
    assert got.keys() == batch.keys() and got[None].reject == "malformed" and got[None].approved is None
    for i in ("a", "b", "c"):
        assert (got[i].fraud_count, got[i].approved, got[i].body) == (batch[i].fraud_count, batch[i].approved, batch[i].body)
    assert not got["b"].approved and got["a"].approved


def test_random_top_k(spark):
    r = random.Random(3)
    rows = [[r.randrange(-3, 4) for _ in range(3)] for _ in range(500)]
    refs = spark.createDataFrame([(i, v, False) for i, v in enumerate(rows)], "ref_id long, vector array<byte>, is_fraud boolean").repartition(5)
    qs = [[r.randrange(-3, 4) for _ in range(3)] for _ in range(20)]
    q = spark.createDataFrame(list(enumerate(qs)), "query_id long, vector array<byte>")
    for kernel in ("codegen", "arrow"):
        got = {}
        for x in knn.brute(refs, q, 3, "i8", 7, kernel=kernel).orderBy("query_id", "rank").collect():
            got.setdefault(x.query_id, []).append(x.ref_id)
        assert got == {i: exact(rows, v, 7) for i, v in enumerate(qs)}


@pytest.mark.parametrize("space", ["i8", "i16", "f32", "f64"])
def test_cells_equal_brute(spark, space, monkeypatch):
    from veldspar.operators import knn_cells

    monkeypatch.setattr(knn_cells, "CELL", 100)  # 15 cells
    refs = generate.references(spark, 1500)
    full = refs.select("ref_id", quantize.quantized(F.col("vector"), 14, space).alias("vector"), "is_fraud").repartition(3).persist()
    q = generate.references(spark, 200, 0.47, 9).select(F.col("ref_id").alias("query_id"), quantize.quantized(F.col("vector"), 14, space).alias("vector")).persist()
    want = sorted(map(tuple, knn.brute(full, q, 14, space).collect()))
    assert len(want) == 1000 and want == sorted(map(tuple, knn.cells(full, q, 14, space).collect()))
    few = full.where("ref_id < 3")
    assert sorted(map(tuple, knn.brute(few, q, 14, space).collect())) == sorted(map(tuple, knn.search(few, q, "cells", dims=14, space=space).collect()))
    assert knn.cells(full, q.limit(0), 14, space).count() == 0 and knn.cells(full.limit(0), q, 14, space).count() == 0


def test_cells_meet_few_references(monkeypatch):
    from veldspar.operators import knn_cells

    r = np.random.default_rng(5)
    x = np.concatenate([r.integers(0, 10_000, (20_000, 4)), 10_000 * r.integers(0, 2, (20_000, 10))], axis=1).astype(np.int16)
    cell, pairs, distances = knn_cells.Cell(x, np.arange(len(x)), np.zeros(len(x), bool), True), [], knn_cells.Cell._distances
    monkeypatch.setattr(knn_cells.Cell, "_distances", lambda self, q, leaf: pairs.append(out := distances(self, q, leaf)) or out)
    query, dist, ref, _ = cell.search(x[:500], 5).settle()
    assert sum(p.size for p in pairs) < 0.1 * 500 * len(x) and len(query) == 2500
    true = np.sort(((x[:500, None].astype(np.int64) - x[None]) ** 2).sum(axis=2), axis=1)[:, :5]
    assert (dist.reshape(500, 5) == true).all() and (ref.reshape(500, 5)[:, 0] == np.arange(500)).all()


def test_cells_keep_the_lowest_ids_of_ties(spark, monkeypatch):
    from veldspar.operators import knn_cells

    monkeypatch.setattr(knn_cells, "CELL", 50)
    r = random.Random(8)
    rows = [[r.randrange(-2, 3) for _ in range(2)] for _ in range(900)] + [[0, 0]] * 600  # 25 vectors, one of them most often
    refs = spark.createDataFrame([(i, v, i % 3 == 0) for i, v in enumerate(rows)], "ref_id long, vector array<byte>, is_fraud boolean").repartition(5)
    q = spark.createDataFrame([(i, [r.randrange(-3, 4) for _ in range(2)]) for i in range(60)], "query_id long, vector array<byte>")
    for k in (1, 5, 40):
        assert sorted(map(tuple, knn.cells(refs, q, 2, "i8", k).collect())) == sorted(map(tuple, knn.brute(refs, q, 2, "i8", k).collect()))
    x, ref, _ = knn_cells._lowest(np.array(rows, np.int8), np.arange(1500)[::-1], np.zeros(1500, bool), 5)
    assert len(x) == 125 and sorted(ref[(x == 0).all(axis=1)].tolist()) == [0, 1, 2, 3, 4]


def test_cells_are_built_once_and_no_task_is_without_one(spark, monkeypatch, tmp_path):
    from veldspar.operators import knn_cells

    monkeypatch.setattr(knn_cells, "CELL", 100)
    first = []
    monkeypatch.setattr(knn_cells, "written", lambda df, label: first.append(df) or storage.written(df, label))
    generate.references(spark, 1500).select("ref_id", quantize.quantized(F.col("vector"), 14, "i8").alias("vector"), F.when(F.col("ref_id") % 7 > 0, F.col("is_fraud")).alias("is_fraud")).write.parquet(str(tmp_path / "refs"))
    refs = spark.read.parquet(str(tmp_path / "refs"))
    q = refs.where("ref_id % 10 = 0").select(F.col("ref_id").alias("query_id"), "vector")
    found = knn_cells.search(refs, q, 14, "i8")
    assert not [f for f in found.inputFiles() if f"{tmp_path}/refs" in f]  # the second round reads what the first has built
    rows = first[0].groupBy(F.spark_partition_id().alias("part")).agg(F.countDistinct("cell").alias("cells")).collect()
    assert len(rows) == first[0].rdd.getNumPartitions() > 10 and {x.cells for x in rows} == {1}
    columns = ["query_id", "rank", "ref_id", "dist"]
    assert sorted(map(tuple, knn.top_k(found, 5).select(columns).collect())) == sorted(map(tuple, knn.brute(refs.fillna(False), q, 14, "i8").select(columns).collect()))


def test_bounds_do_not_depend_on_how_many_are_computed_at_once(monkeypatch):
    from veldspar.operators import knn_cells

    r = np.random.default_rng(4)
    low, q = r.normal(size=(30, 5)), r.normal(size=(200, 5))
    high = low + r.random((30, 5))
    want = sum(np.maximum(np.maximum(low[None, :, d] - q[:, d, None], q[:, d, None] - high[None, :, d]), 0) ** 2 for d in range(5))
    for near in (1, 70, 1 << 15):
        monkeypatch.setattr(knn_cells, "NEAR", near)
        assert (knn_cells.lower_bounds(q, low, high) == want).all()
    assert knn_cells.lower_bounds(q[:0], low, high).shape == (0, 30) and knn_cells.lower_bounds(q, low[:0], high[:0]).shape == (200, 0)


@pytest.mark.parametrize("space", ["i8", "i16"])
def test_batches_quantise_as_the_projection(spark, space):
    r, top = random.Random(3), quantize.space_of(space).scale
    halves = [(i + 0.5) / top for i in range(-top, top, max(1, top // 500))]
    values = [None, -1.0, 0.0, -0.0, 1.0, 2.0, -2.0, 1e9, 3e38, -3e38, float("nan"), float("inf"), float("-inf"), *halves, *[r.uniform(-1.1, 1.1) for _ in range(2000)]]
    rows = spark.createDataFrame([(i, values[i : i + 3], None if i % 3 == 0 else i % 3 == 1) for i in range(0, len(values) - 2, 3)], "ref_id long, vector array<float>, is_fraud boolean")
    got = quantize.in_batches(rows, 3, space)
    want = rows.select("ref_id", quantize.quantized(F.col("vector"), 3, space).alias("vector"), "is_fraud")
    assert got.dtypes == want.dtypes and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert quantize.in_batches(rows.limit(0), 3, space).count() == 0
    with pytest.raises(Exception, match="4 components"):
        quantize.in_batches(rows, 4, space).count()


@pytest.mark.parametrize("name", ["knn_ties_i8", "knn_arrow_i16"])
def test_searched_transactions_are_derived_in_compiled_methods(spark, name, monkeypatch):
    from veldspar.plans import catalog

    derived = []
    monkeypatch.setattr(catalog, "written", lambda df, label: derived.append(df) or storage.written(df, label))
    catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        stages = derived[0].select("*")._jdf.queryExecution().debug().codegenToSeq()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
    assert len(sizes) > 5 and max(sizes) < 8000  # beyond that the JVM interprets a method


def test_decisions_over_transactions_need_no_brute_force(spark, monkeypatch):
    from veldspar.plans import catalog

    monkeypatch.setattr(knn, "brute", lambda *a, **b: pytest.fail("every query against every reference"))
    assert catalog.fraud_score(spark, "/root/testdata/sf0.001").count() == 74


def test_labels_need_no_brute_force(spark, monkeypatch):
    refs, rows = generate.references(spark, 300), generate.payloads(spark, 60, 0.47, 4141)
    r = refs.select("ref_id", quantize.quantized(F.col("vector"), 14, "f64").alias("vector"), "is_fraud")
    q = vectorize.vectorize(rows, ("row",)).select(F.col("row").alias("query_id"), quantize.quantized(F.col("vector"), 14, "f64").alias("vector"))
    want = {x.query_id: (x.fraud_score, x.approved) for x in score.decide(score.vote(knn.brute(r, q, 14, "f64"), q)).collect()}
    monkeypatch.setattr(knn, "brute", lambda *a, **b: pytest.fail("every query against every reference"))
    assert want == {x.row: (x.expected_fraud_score, x.expected_approved) for x in generate.labelled(refs, rows).collect()}


def test_probes_of_a_sample_reach_the_recall_of_all(spark):
    r = random.Random(6)
    refs = spark.createDataFrame([(i, [r.uniform(-1, 1) for _ in range(6)], False) for i in range(2000)], "ref_id long, vector array<float>, is_fraud boolean")
    found = index.build(refs, 6, "i8", clusters=40)
    found.records = found.records.persist()
    q = found.records.select(F.col("ref_id").alias("query_id"), "vector")
    true = {(x.query_id, x.ref_id) for x in knn.brute(found.records, q, 6, "i8").collect()}
    for sample in (10, 60):
        nprobe, said = knn.probes_for(found, q, 5, 0.9, sample)
        assert said >= 0.9 and sum((x.query_id, x.ref_id) in true for x in knn.ivf(found, q, 5, nprobe).collect()) >= 0.9 * len(true)


def test_test_sets_are_written_and_read_in_parallel(spark, tmp_path):
    rows = generate.payloads(spark, 3000, parts=5, random_dates=True)
    entries = rows.select((2999 - F.col("row")).alias("position"), F.struct("id", "transaction", "customer", "merchant", "terminal", "last_transaction").alias("request"), F.col("coin").alias("expected_approved"), F.when(F.col("row") % 7 > 0, 0.6).alias("expected_fraud_score"))
    path, before = str(tmp_path / "set"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    sinks.write_test_set(entries, evaluate.dataset_stats(entries), 'a"b', path)
    (file,) = (tmp_path / "set").glob("[!._]*")
    doc = json.loads(file.read_text())
    assert len(doc["entries"]) == 3000 == doc["stats"]["total"] and [e["request"]["id"] for e in doc["entries"]] == [f"tx-42-{2999 - i}" for i in range(3000)]
    want = [tuple(r) for r in entries.orderBy("position").collect()]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        back, stats = readers.test_set(spark, path)
        assert back.drop("position").rdd.getNumPartitions() > 1 and [tuple(r) for r in back.orderBy("position").collect()] == want
        assert stats.first().references_checksum_sha256 == 'a"b'
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name, text in (("plain", json.dumps(doc)), ("wide", json.dumps(doc, indent=1)), ("pairs", file.read_text().replace("\n,", ",", 1))):  # laid out otherwise
        (tmp_path / name).write_text(text)
        back, stats = readers.test_set(spark, str(tmp_path / name))
        assert [tuple(r) for r in back.orderBy("position").collect()] == want and stats.first().total == 3000
    with pytest.raises(FileExistsError):
        sinks.write_test_set(entries, evaluate.dataset_stats(entries), "", path)


def test_large_batches_are_scored_by_cells(spark, monkeypatch):
    from veldspar.streaming import scorer

    built = index.build(generate.references(spark, 400), 14, "i16", clusters=8, iterations=3)
    rows = generate.payloads(spark, 60, 0.47, 4141).select(F.col("row").alias("request"), F.to_json(F.struct("id", "transaction", "customer", "merchant", "terminal", "last_transaction")).alias("body"))
    rows = rows.unionByName(spark.createDataFrame([(99, "broken")], "request long, body string"))
    want = sorted(map(str, scorer.score_bodies(rows, built).collect()))
    monkeypatch.setattr(knn, "pruned", lambda *a, **b: pytest.fail("passes over all references for each block"))
    assert len(want) == 61 and want == sorted(map(str, scorer.score_bodies(rows, built, block_bytes=1000).collect()))


def test_rows_of_an_index_are_assigned_once(spark, monkeypatch):
    calls, fast = spark.sparkContext.accumulator(0), kmeans.assign_fast
    counted = F.udf(lambda c: (calls.add(1), c)[1], "int")
    monkeypatch.setattr(kmeans, "assign_fast", lambda points, centroids: fast(points, centroids).withColumn("cluster_id", counted.asNondeterministic()("cluster_id")))
    built = index.build(table(spark, GUARD), 14, "i16", centroids=[[0] * 14, [100] + [0] * 13])
    assert built.ready() and built.size() == 2 and built.records.count() == 60 and calls.value == 60
