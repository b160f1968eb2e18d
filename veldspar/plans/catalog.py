"""Every registered query of the engine, and the SQL that gives the same rows.

Queries run over whole tables. Searches take the rows whose id is divisible by 20 as queries, against all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DIMS, MCC_RISK
from ..functions.vectorize import NAMES, vectorize
from ..operators import evaluate, index, kmeans, knn, score
from ..sources import generate, readers, sinks
from ..storage import shared_folder, written
from . import mappings as m

K, THRESHOLD, CLUSTERS, NPROBE = 5, 0.6, 16, 4
#: Least recall of the approximate search against brute force.
RECALL = 0.9
E = m.EMBEDDING_DIMS

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


# ---- pieces of SQL -------------------------------------------------------------------------------

TX = f"tx AS ({m.transactions_sql('duckdb')})"


def _clamp(x: str) -> str:
    return f"CAST(greatest(0, least(1, CAST({x} AS FLOAT))) AS FLOAT)"


_RISK = " ".join(f"WHEN '{k}' THEN {v}" for k, v in MCC_RISK.items())
FEATURES = [
    _clamp("amount / CAST(10000 AS DOUBLE)"), _clamp("installments / CAST(12 AS DOUBLE)"),
    _clamp("(CASE WHEN avg_amount > 0 THEN amount / avg_amount ELSE CAST(0 AS DOUBLE) END) / CAST(10 AS DOUBLE)"),
    "CAST((epoch_s % 86400) // 3600 / CAST(23 AS DOUBLE) AS FLOAT)", "CAST((epoch_s // 86400 + 3) % 7 / CAST(6 AS DOUBLE) AS FLOAT)",
    f"CASE WHEN last_at IS NULL THEN CAST(-1 AS FLOAT) ELSE {_clamp('greatest(0, epoch_s - last_at) // 60 / CAST(1440 AS DOUBLE)')} END",
    f"CASE WHEN last_at IS NULL THEN CAST(-1 AS FLOAT) ELSE {_clamp('coalesce(last_km, 0) / CAST(1000 AS DOUBLE)')} END",
    _clamp("km_home / CAST(1000 AS DOUBLE)"), _clamp("tx_count / CAST(20 AS DOUBLE)"),
    "CAST(CASE WHEN is_online THEN 1 ELSE 0 END AS FLOAT)", "CAST(CASE WHEN card_present THEN 1 ELSE 0 END AS FLOAT)",
    "CAST(CASE WHEN list_contains(known, merchant) THEN 0 ELSE 1 END AS FLOAT)",
    f"CAST(CASE mcc {_RISK} ELSE 0.5 END AS FLOAT)", _clamp("merchant_avg / CAST(10000 AS DOUBLE)"),
]


def _quantized(v: str, space: str) -> str:
    if space in ("i8", "i16"):
        scale, low, kind = {"i8": (127, -128, "TINYINT"), "i16": (10000, -32768, "SMALLINT")}[space]
        top = {"i8": 127, "i16": 32767}[space]
        return f"CAST(CASE WHEN {v} = -1 THEN {low} ELSE greatest(-{top}, least({top}, floor(CAST({v} * CAST({scale} AS FLOAT) AS DOUBLE) + 0.5))) END AS {kind})"
    return f"round(CAST({v} AS DOUBLE), 4) + 0" if space == "f64" else f"CAST({v} AS FLOAT)"


def _list(items) -> str:
    return "[" + ", ".join(items) + "]"


def _vectors(source: str, space: str) -> str:
    """CTEs that end in r(ref_id, v, is_fraud)."""
    if source == "tx":
        return f"{TX}, f AS (SELECT tx AS ref_id, {_list(FEATURES)} AS e, is_fraud FROM tx), r AS (SELECT ref_id, {_list(_quantized(f'e[{i + 1}]', space) for i in range(DIMS))} AS v, is_fraud FROM f)"
    labels = ", ".join(map(str, m.FRAUD_LABELS))
    return f"f AS (SELECT vec_id AS ref_id, embedding AS e, label IN ({labels}) AS is_fraud FROM embeddings), r AS (SELECT ref_id, {_list(_quantized(f'e[{i + 1}]', space) for i in range(E))} AS v, is_fraud FROM f)"


def _squared(a: str, b: str, dims: int, kind: str = "BIGINT") -> str:
    return " + ".join(f"(CAST({a}[{i}] AS {kind}) - CAST({b}[{i}] AS {kind})) * (CAST({a}[{i}] AS {kind}) - CAST({b}[{i}] AS {kind}))" for i in range(1, dims + 1))


def _knn(source: str, space: str) -> str:
    dims = DIMS if source == "tx" else E
    kind = "BIGINT" if space in ("i8", "i16") else "DOUBLE"
    return f"""{_vectors(source, space)}, q AS (SELECT ref_id AS query_id, v AS w FROM r WHERE ref_id % 20 = 0),
p AS (SELECT query_id, ref_id, is_fraud, {_squared('r.v', 'q.w', dims, kind)} AS dist FROM r, q),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dist, ref_id) AS INT) AS rank FROM p QUALIFY rank <= {K})"""


def _scores(source: str, space: str) -> str:
    return f"""{_knn(source, space)}, s AS (SELECT query_id, CAST(count(*) FILTER (is_fraud) AS INT) AS fraud_count FROM n GROUP BY query_id),
d AS (SELECT query_id, fraud_count, fraud_count / CAST({K} AS DOUBLE) AS fraud_score, fraud_count / CAST({K} AS DOUBLE) < CAST({THRESHOLD} AS DOUBLE) AS approved FROM s)"""


def _searched(spark: SparkSession, sf_dir: str, source: str, space: str, **settings) -> DataFrame:
    if source == "tx":  # derived by joins and windows: once for the queries and the references
        refs = written(m.transactions_in_space(spark, sf_dir, space), "vectors")
        return knn.cells(refs, m.queries_of(refs), DIMS, space, K)
    refs = m.in_space(m.embedding_vectors(spark, sf_dir), E, space)
    return knn.brute(refs, m.queries_of(refs), E, space, K, **settings)


# ---- features ------------------------------------------------------------------------------------

def _feature(i: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        vectors = vectorize(m.payloads(m.transactions(spark, sf_dir)), ("tx",))
        return vectors.select("tx", F.col("vector")[i].alias(NAMES[i]))

    register(f"WITH {TX} SELECT tx, {FEATURES[i]} AS {NAMES[i]} FROM tx", f"vec_{NAMES[i]}")(run)


for _i in range(DIMS):
    _feature(_i)


@register(f"WITH {TX} SELECT tx, {', '.join(f'{f} AS f{i}' for i, f in enumerate(FEATURES))} FROM tx")
def vectorize_all(spark, sf_dir):
    return vectorize(m.payloads(m.transactions(spark, sf_dir)), ("tx",)).select("tx", *[F.col("vector")[i].alias(f"f{i}") for i in range(DIMS)])


@register(f"WITH {TX} SELECT tx, {', '.join(f'{f} AS f{i}' for i, f in enumerate(FEATURES))}, CAST(NULL AS VARCHAR) AS reject, CAST(false AS BOOLEAN) AS incomplete FROM tx")
def vectorize_json(spark, sf_dir):
    """Through JSON bodies and back, with rejects."""
    from ..functions.vectorize import parse

    p = m.payloads(m.transactions(spark, sf_dir))
    bodies = p.select("tx", F.to_json(F.struct("id", "transaction", "customer", "merchant", "terminal", "last_transaction")).alias("body"))
    return vectorize(parse(bodies), ("tx", "reject", "incomplete")).select("tx", *[F.col("vector")[i].alias(f"f{i}") for i in range(DIMS)], "reject", "incomplete")


@register(f"WITH {TX} SELECT tx, mcc, CAST(CASE mcc {_RISK} ELSE 0.5 END AS DOUBLE) AS risk FROM tx")
def mcc_lookup(spark, sf_dir):
    """The category's risk as a left join with a default; the table is ten rows."""
    risks = spark.createDataFrame(list(MCC_RISK.items()), "mcc string, risk double")
    return m.transactions(spark, sf_dir).select("tx", "mcc").join(F.broadcast(risks), "mcc", "left").select("tx", "mcc", F.coalesce("risk", F.lit(0.5)).alias("risk"))


@register(f"WITH {TX} SELECT tx, merchant FROM tx WHERE list_contains(known, merchant)")
def known_merchant_semi(spark, sf_dir):
    """Transactions at a merchant that the customer knows, as a semi join on the exploded list."""
    tx = m.transactions(spark, sf_dir).select("tx", "merchant", "known")
    known = tx.select("tx", F.explode("known").alias("merchant")).where("merchant is not null")
    return tx.select("tx", "merchant").join(known, ["tx", "merchant"], "left_semi")


@register("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def json_extract(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@register(f"WITH {TX} SELECT tx, amount, installments, epoch_s, avg_amount, tx_count, coalesce(last_at, -1) AS last_at, last_km FROM tx")
def tx_window_features(spark, sf_dir):
    return m.transactions(spark, sf_dir).select("tx", "amount", "installments", "epoch_s", "avg_amount", "tx_count", F.coalesce("last_at", F.lit(-1)).alias("last_at"), "last_km")


# ---- spaces and search ---------------------------------------------------------------------------

for _space in ("i8", "i16", "f64"):

    def _quantize(spark, sf_dir, space=_space):
        return m.in_space(m.embedding_vectors(spark, sf_dir), E, space).select("ref_id", F.posexplode("vector").alias("i", "x"))

    register(f"WITH {_vectors('emb', _space)} SELECT ref_id, CAST(i - 1 AS INT) AS i, v[i] AS x FROM (SELECT ref_id, v, unnest(generate_series(1, {E})) AS i FROM r)", f"quantize_{_space}")(_quantize)

for _space in ("i8", "i16"):

    def _knn_int(spark, sf_dir, space=_space):
        return _searched(spark, sf_dir, "emb", space)

    register(f"WITH {_knn('emb', _space)} SELECT query_id, rank, ref_id, dist, is_fraud FROM n", f"knn_{_space}")(_knn_int)

for _space in ("f32", "f64"):

    def _knn_float(spark, sf_dir, space=_space):
        return _searched(spark, sf_dir, "emb", space).select("query_id", "rank", "ref_id")

    register(f"WITH {_knn('emb', _space)} SELECT query_id, rank, ref_id FROM n", f"knn_{_space}_ids")(_knn_float)

for _metric, _sql in (("l1", " + ".join(f"abs(CAST(r.v[{i}] AS BIGINT) - q.w[{i}])" for i in range(1, E + 1))),):

    def _knn_metric(spark, sf_dir, metric=_metric):
        return _searched(spark, sf_dir, "emb", "i16", metric=metric).select("query_id", "rank", "ref_id", "dist")

    register(f"WITH {_vectors('emb', 'i16')}, q AS (SELECT ref_id AS query_id, v AS w FROM r WHERE ref_id % 20 = 0), p AS (SELECT query_id, ref_id, {_sql} AS dist FROM r, q) SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dist, ref_id) AS INT) AS rank, ref_id, dist FROM p QUALIFY rank <= {K}", f"knn_{_metric}")(_knn_metric)


def _dot(a: str, b: str) -> str:
    return " + ".join(f"CAST({a}[{i}] AS DOUBLE) * {b}[{i}]" for i in range(1, E + 1))


@register(f"WITH {_vectors('emb', 'f64')}, q AS (SELECT ref_id AS query_id, v AS w FROM r WHERE ref_id % 20 = 0), p AS (SELECT query_id, ref_id, CASE WHEN ({_dot('v', 'v')}) * ({_dot('w', 'w')}) > 0 THEN 1 - ({_dot('v', 'w')}) / sqrt(({_dot('v', 'v')}) * ({_dot('w', 'w')})) ELSE 1 END AS dist FROM r, q) SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dist, ref_id) AS INT) AS rank, ref_id FROM p QUALIFY rank <= {K}")
def knn_cosine(spark, sf_dir):
    return _searched(spark, sf_dir, "emb", "f64", metric="cosine").select("query_id", "rank", "ref_id")


@register(f"WITH {_knn('tx', 'i16')} SELECT query_id, rank, ref_id, dist, is_fraud FROM n")
def knn_arrow_i16(spark, sf_dir):
    """Transactions, with the NumPy kernel."""
    return _searched(spark, sf_dir, "tx", "i16")


@register(f"WITH {_knn('tx', 'i8')} SELECT query_id, rank, ref_id, dist, is_fraud FROM n")
def knn_ties_i8(spark, sf_dir):
    """A coarse space, where many distances are equal."""
    return _searched(spark, sf_dir, "tx", "i8")


def _tx_index(spark, sf_dir) -> tuple[index.Index, DataFrame]:
    rows = written(m.transaction_vectors(spark, sf_dir), "vectors")
    found = index.build(rows, DIMS, "i16", iterations=4)
    path = shared_folder(spark, "index")
    index.write(found, path)
    return index.read(spark, path), m.queries_of(m.in_space(rows, DIMS, "i16"))


@register(f"WITH {_knn('tx', 'i16')} SELECT query_id, rank, ref_id, dist, is_fraud FROM n")
def knn_pruned_i16(spark, sf_dir):
    """Exact search through boxes; the SQL is brute force."""
    found, queries = _tx_index(spark, sf_dir)
    return knn.pruned(found, queries, K, NPROBE)


@register(f"WITH {_scores('tx', 'i16')} SELECT query_id, fraud_count, fraud_score, approved FROM d")
def fraud_score(spark, sf_dir):
    """The flagship: transactions to vectors to neighbours to a decision."""
    rows = written(m.in_space(m.transaction_vectors(spark, sf_dir), DIMS, "i16"), "vectors")
    queries = m.queries_of(rows)
    return score.decide(score.vote(knn.cells(rows, queries, DIMS, "i16", K), queries, K), THRESHOLD)


@register(f"WITH {_scores('emb', 'i16')} SELECT query_id, fraud_count, fraud_score, approved FROM d")
def decisions_i16(spark, sf_dir):
    return _decided(spark, sf_dir, "i16")


def _decided(spark, sf_dir, space) -> DataFrame:
    refs = m.in_space(m.embedding_vectors(spark, sf_dir), E, space)
    queries = m.queries_of(refs)
    return score.decide(score.vote(knn.brute(refs, queries, E, space, K), queries, K), THRESHOLD)


@register(f"SELECT CAST(i AS INT) AS fraud_count, i / CAST({K} AS DOUBLE) AS fraud_score, i / CAST({K} AS DOUBLE) < CAST({THRESHOLD} AS DOUBLE) AS approved, '{{\"approved\":' || CASE WHEN i / CAST({K} AS DOUBLE) < CAST({THRESHOLD} AS DOUBLE) THEN 'true' ELSE 'false' END || ',\"fraud_score\":' || CAST(i / CAST({K} AS DOUBLE) AS VARCHAR) || '}}' AS body FROM generate_series(0, {K}) t(i)")
def decision_table(spark, sf_dir):
    return score.response_table(spark, K, THRESHOLD)


# ---- clusters ------------------------------------------------------------------------------------
# The SQL starts from the first CLUSTERS embeddings by id; the operator's own start is by hash.

def _points(spark, sf_dir) -> DataFrame:
    return m.in_space(m.embedding_vectors(spark, sf_dir), E, "i8")


def _start(spark, sf_dir) -> list[list[int]]:
    return [list(r[0]) for r in _points(spark, sf_dir).orderBy("ref_id").limit(CLUSTERS).select("vector").collect()]


_C0 = f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY ref_id) - 1 AS INT) AS cluster_id, [{', '.join(f'CAST(v[{i}] AS INT)' for i in range(1, E + 1))}] AS c FROM (SELECT * FROM r ORDER BY ref_id LIMIT {CLUSTERS}))"


def _assign(n: int) -> str:
    return f"a{n} AS (SELECT r.ref_id, r.v, min((({_squared('r.v', 'c.c', E)}), c.cluster_id)) AS b FROM r, c{n} c GROUP BY ALL)"


def _update(n: int) -> str:
    means = _list(f"CAST(greatest(-127, least(127, floor(CAST(sum(CAST(v[{i}] AS BIGINT)) AS DOUBLE) / count(*) + 0.5))) AS INT)" for i in range(1, E + 1))
    return f"u{n} AS (SELECT b[2] AS cluster_id, {means} AS c, count(*) AS n FROM a{n} GROUP BY 1), c{n + 1} AS (SELECT c.cluster_id, coalesce(u.c, c.c) AS c, CAST(coalesce(u.n, 0) AS BIGINT) AS n FROM c{n} c LEFT JOIN u{n} u USING (cluster_id))"


_R8 = _vectors("emb", "i8")


@register(f"WITH {_R8}, {_C0}, {_assign(0)} SELECT ref_id, CAST(b[2] AS INT) AS cluster_id FROM a0")
def kmeans_assign(spark, sf_dir):
    return kmeans.assign(_points(spark, sf_dir).select("ref_id", "vector"), kmeans.frame(spark, _start(spark, sf_dir))).select("ref_id", "cluster_id")


@register(f"WITH {_R8}, {_C0}, {_assign(0)}, {_update(0)} SELECT cluster_id, n, CAST(i - 1 AS INT) AS i, c[i] AS x FROM (SELECT cluster_id, n, c, unnest(generate_series(1, {E})) AS i FROM c1)")
def kmeans_update(spark, sf_dir):
    start = kmeans.frame(spark, _start(spark, sf_dir))
    new = kmeans.update(kmeans.assign(_points(spark, sf_dir).select("ref_id", "vector"), start), start, E)
    return new.select("cluster_id", "n", F.posexplode("centroid").alias("i", "x"))


@register(f"WITH {_R8}, {_C0}, {_assign(0)}, {_update(0)}, {_assign(1)}, {_update(1)}, {_assign(2)}, {_update(2)} SELECT cluster_id, CAST(i - 1 AS INT) AS i, c[i] AS x FROM (SELECT cluster_id, c, unnest(generate_series(1, {E})) AS i FROM c3)")
def kmeans_fit_3(spark, sf_dir):
    now = kmeans.fit(_points(spark, sf_dir), CLUSTERS, E, 3, start=_start(spark, sf_dir))
    return kmeans.frame(spark, now).select("cluster_id", F.posexplode("centroid").alias("i", "x"))


@register(f"WITH {_R8}, {_C0}, {_assign(0)}, {_update(0)}, a1 AS (SELECT a0.ref_id, min((({_squared('a0.v', 'c.c', E)}), c.cluster_id <> a0.b[2], c.cluster_id)) AS b FROM a0, c1 c GROUP BY ALL) SELECT CAST(count(*) FILTER (a0.b[2] <> a1.b[3]) AS BIGINT) AS moved FROM a0 JOIN a1 USING (ref_id)")
def kmeans_moved(spark, sf_dir):
    points = _points(spark, sf_dir).select("ref_id", "vector")
    start = kmeans.frame(spark, _start(spark, sf_dir))
    first = kmeans.assign(points, start)
    second = kmeans.assign(first.withColumnRenamed("cluster_id", "current"), kmeans.update(first, start, E).select("cluster_id", "centroid"))
    return kmeans.moved(first, second)


def _emb_index(spark, sf_dir) -> index.Index:
    return index.build(m.embedding_vectors(spark, sf_dir), E, "i8", centroids=_start(spark, sf_dir))


_BOX = f"""{_R8}, {_C0}, {_assign(0)},
g AS (SELECT b[2] AS cluster_id, count(*) AS n, {_list(f'min(v[{i}])' for i in range(1, E + 1))} AS lo, {_list(f'max(v[{i}])' for i in range(1, E + 1))} AS hi FROM a0 GROUP BY 1),
k AS (SELECT c.cluster_id, c.c, coalesce(g.n, 0) AS n, coalesce(lo, {_list(['0'] * E)}) AS lo, coalesce(hi, {_list(['0'] * E)}) AS hi FROM c0 c LEFT JOIN g USING (cluster_id)),
q AS (SELECT ref_id AS query_id, v AS w FROM r WHERE ref_id % 20 = 0),
z AS (SELECT query_id, w, cluster_id, n, {_squared('q.w', 'k.c', E)} AS centroid_dist, {" + ".join(f"power(greatest(CAST(lo[{i}] AS BIGINT) - w[{i}], 0, CAST(w[{i}] AS BIGINT) - hi[{i}]), 2)" for i in range(1, E + 1))} AS lb FROM q, k),
y AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY centroid_dist, cluster_id) AS INT) AS rn FROM z)"""


@register(f"WITH {_BOX} SELECT cluster_id, CAST(n AS BIGINT) AS n, CAST(sum(n) OVER (ORDER BY cluster_id) - n AS BIGINT) AS first, CAST(list_sum(lo) AS BIGINT) AS low_sum, CAST(list_sum(hi) AS BIGINT) AS high_sum FROM k")
def cluster_directory(spark, sf_dir):
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return _emb_index(spark, sf_dir).clusters.select("cluster_id", "n", "first", total("low").alias("low_sum"), total("high").alias("high_sum"))


def _embedding_queries(spark, sf_dir) -> DataFrame:
    return m.queries_of(_points(spark, sf_dir))


@register(f"WITH {_BOX} SELECT query_id, cluster_id, centroid_dist, rn FROM y")
def cluster_rank(spark, sf_dir):
    return knn.rank_clusters(_emb_index(spark, sf_dir), _embedding_queries(spark, sf_dir)).select("query_id", "cluster_id", "centroid_dist", "rn")


@register(f"WITH {_BOX} SELECT query_id, cluster_id, CAST(lb AS BIGINT) AS lb FROM y")
def bbox_lower_bound(spark, sf_dir):
    return knn.rank_clusters(_emb_index(spark, sf_dir), _embedding_queries(spark, sf_dir)).select("query_id", "cluster_id", "lb")


@register(f"WITH {_BOX} SELECT query_id, ref_id, {_squared('a0.v', 'y.w', E)} AS dist, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {_squared('a0.v', 'y.w', E)}, ref_id) AS INT) AS rank FROM y JOIN a0 ON a0.b[2] = y.cluster_id WHERE rn <= {NPROBE} QUALIFY rank <= {K}")
def knn_ivf_i8(spark, sf_dir):
    return knn.ivf(_emb_index(spark, sf_dir), _embedding_queries(spark, sf_dir), K, NPROBE).select("query_id", "ref_id", "dist", "rank")


@register()
def knn_ivf_fitted_i8(spark, sf_dir):
    """Over clusters that k-means has found, as many as the measured recall of RECALL needs. knn_ivf_i8 has no such aim: its SQL fixes clusters and probes."""
    found, queries = index.build(m.embedding_vectors(spark, sf_dir), E, "i8"), _embedding_queries(spark, sf_dir)
    nprobe, _ = knn.probes_for(found, queries, K, RECALL)
    return knn.ivf(found, queries, K, nprobe).select("query_id", "ref_id", "dist", "rank")


@register("SELECT count(*) AS queries, CAST(true AS BOOLEAN) AS reached FROM embeddings WHERE vec_id % 20 = 0")
def ivf_recall(spark, sf_dir):
    """Whether the fitted search finds RECALL of what brute force over the same space finds."""
    refs = m.in_space(m.embedding_vectors(spark, sf_dir), E, "i8")
    true = knn.brute(refs, m.queries_of(refs), E, "i8", K).select("query_id", "ref_id", F.lit(True).alias("true"))
    both = true.join(knn_ivf_fitted_i8(spark, sf_dir).select("query_id", "ref_id", F.lit(True).alias("found")), ["query_id", "ref_id"], "left")
    return both.agg(F.countDistinct("query_id").alias("queries"), (F.count("found") >= RECALL * F.count("true")).alias("reached"))


# ---- evaluation ----------------------------------------------------------------------------------

def _decisions(spark, sf_dir) -> DataFrame:
    """What is said in the coarse space against what the oracle's space expects."""
    said = _decided(spark, sf_dir, "i8").select("query_id", "approved")
    want = _decided(spark, sf_dir, "f64").select("query_id", F.col("approved").alias("expected_approved"), F.col("fraud_score").alias("expected_fraud_score"))
    return said.join(want, "query_id")


_EXPECT = f"want AS (WITH {_scores('emb', 'f64')} SELECT query_id, approved AS expected_approved, fraud_score AS expected_fraud_score FROM d), said AS (WITH {_scores('emb', 'i8')} SELECT query_id, approved FROM d)"
_COUNTS = f"{_EXPECT}, t AS (SELECT count(*) FILTER (NOT approved AND NOT expected_approved) AS tp, count(*) FILTER (approved AND expected_approved) AS tn, count(*) FILTER (NOT approved AND expected_approved) AS fp, count(*) FILTER (approved AND NOT expected_approved) AS fn, count(*) FILTER (approved IS NULL) AS err FROM said JOIN want USING (query_id))"


@register(f"WITH {_COUNTS} SELECT tp, tn, fp, fn, err FROM t")
def confusion_matrix(spark, sf_dir):
    return evaluate.confusion(_decisions(spark, sf_dir))


_RATES = "CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END AS recall, CASE WHEN fp + tn > 0 THEN CAST(fp AS DOUBLE) / (fp + tn) ELSE 0 END AS fpr"


@register(f"WITH {_COUNTS} SELECT round(precision, 9) AS precision, round(recall, 9) AS recall, round(fpr, 9) AS fpr, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 9) AS f1 FROM (SELECT {_RATES} FROM t)")
def classification_metrics(spark, sf_dir):
    return evaluate.rates(evaluate.confusion(_decisions(spark, sf_dir))).select(*[F.round(c, 9).alias(c) for c in ("precision", "recall", "fpr", "f1")])


@register(f"WITH {_EXPECT} SELECT count(*) AS total, count(*) FILTER (NOT expected_approved) AS fraud_count, count(*) FILTER (expected_approved) AS legit_count, round(count(*) FILTER (NOT expected_approved) / CAST(count(*) AS DOUBLE), 4) AS fraud_rate, round(count(*) FILTER (expected_approved) / CAST(count(*) AS DOUBLE), 4) AS legit_rate, count(*) FILTER (expected_fraud_score = CAST(0.6 AS DOUBLE)) AS edge_case_count, round(count(*) FILTER (expected_fraud_score = CAST(0.6 AS DOUBLE)) / CAST(count(*) AS DOUBLE), 4) AS edge_case_rate FROM want")
def dataset_stats(spark, sf_dir):
    return evaluate.dataset_stats(_decisions(spark, sf_dir))


# Events stand for requests: their value is the latency, their type the configuration, bursts of a minute the runs.

def _runs(spark, sf_dir) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.from_json("props", "k int")["k"]
    return e.select("event_type", "user_id", "value", k.alias("k"), "event_id")


_E = "e AS (SELECT event_type, user_id, value, CAST(json_extract(props, '$.k') AS INT) AS k, event_id FROM events)"


@register(f"WITH {_E} SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM e GROUP BY 1")
def latency_percentiles(spark, sf_dir):
    got = evaluate.percentiles(_runs(spark, sf_dir), "value", ("event_type",))
    return got.select("event_type", *[F.round(p, 6).alias(p) for p in ("p50", "p95", "p99")])


def _scored_runs(spark, sf_dir) -> DataFrame:
    n = lambda c, name: F.count_if(c).alias(name)
    v, k = F.col("value"), F.col("k")
    runs = _runs(spark, sf_dir).groupBy("event_type", "user_id").agg(n(k < 40, "tp"), n((k >= 40) & (k < 94), "tn"), n((k >= 94) & (k < 97), "fp"), n((k >= 97) & (k < 99), "fn"), n(k >= 99, "err"), (F.max(v) * 10).alias("p99"))
    return evaluate.scored(evaluate.weighted(runs))


_RUNS = f"""{_E}, w AS (SELECT event_type, user_id, count(*) FILTER (k < 40) AS tp, count(*) FILTER (k >= 40 AND k < 94) AS tn, count(*) FILTER (k >= 94 AND k < 97) AS fp, count(*) FILTER (k >= 97 AND k < 99) AS fn, count(*) FILTER (k >= 99) AS err, max(value) * 10 AS p99 FROM e GROUP BY 1, 2),
x AS (SELECT *, tp + tn + fp + fn + err AS n, fp + 3 * fn + 5 * err AS weighted_errors, (fp + 3 * fn + 5 * err) / CAST(tp + tn + fp + fn + err AS DOUBLE) AS epsilon, (fp + fn + err) / CAST(tp + tn + fp + fn + err AS DOUBLE) AS failure_rate FROM w),
s AS (SELECT *, CASE WHEN p99 <= 0 THEN 0 WHEN p99 > 2000 THEN -3000 ELSE 1000 * log10(1000 / greatest(p99, 1)) END AS p99_score, p99 > 2000 AS p99_cut,
      CASE WHEN failure_rate > 0.15 THEN -3000 ELSE 1000 * log10(1 / greatest(epsilon, CAST(0.001 AS DOUBLE))) - 300 * log10(1 + weighted_errors) END AS detection_score, failure_rate > 0.15 AS detection_cut FROM x),
t AS (SELECT *, p99_score + detection_score AS final_score FROM s)"""


@register(f"WITH {_RUNS} SELECT event_type, user_id, n, weighted_errors, round(epsilon, 6) AS epsilon, round(failure_rate, 6) AS failure_rate, round(p99_score, 6) AS p99_score, round(detection_score, 6) AS detection_score, round(final_score, 6) AS final_score, p99_cut, detection_cut FROM t")
def weighted_error_score(spark, sf_dir):
    r = lambda c: F.round(c, 6).alias(c)
    return _scored_runs(spark, sf_dir).select("event_type", "user_id", "n", "weighted_errors", *map(r, ("epsilon", "failure_rate", "p99_score", "detection_score", "final_score")), "p99_cut", "detection_cut")


_SUMMARY = f"{_RUNS}, y AS (SELECT event_type, count(*) AS runs, median(p99) AS p99_median, min(p99) AS p99_min, max(p99) AS p99_max, round(max(p99) - min(p99), 2) AS p99_spread, median(final_score) AS final_score_median, bool_or(p99_cut) AS p99_cut_any, bool_or(detection_cut) AS detection_cut_any, len(list(p99)) AS samples FROM t GROUP BY 1)"


def _summary(spark, sf_dir) -> DataFrame:
    return evaluate.run_summary(_scored_runs(spark, sf_dir), ("event_type",))


@register(f"WITH {_SUMMARY} SELECT event_type, runs, round(p99_median, 6) AS p99_median, p99_min, p99_max, p99_spread, round(final_score_median, 6) AS final_score_median, p99_cut_any, detection_cut_any, CAST(samples AS INT) AS samples FROM y")
def run_median_spread(spark, sf_dir):
    s = _summary(spark, sf_dir)
    return s.select("event_type", "runs", F.round("p99_median", 6).alias("p99_median"), "p99_min", "p99_max", "p99_spread", F.round("final_score_median", 6).alias("final_score_median"), "p99_cut_any", "detection_cut_any", F.size("p99_samples").alias("samples"))


@register(f"WITH {_SUMMARY} SELECT event_type, row_number() OVER (ORDER BY final_score_median DESC, event_type) AS place FROM y")
def best_config_rank(spark, sf_dir):
    return evaluate.best_first(_summary(spark, sf_dir), keys=("event_type",)).select("event_type", "place")


_STAGES = "s AS (SELECT n_nationkey AS stage, 60 + 30 * n_regionkey AS duration_s, (n_nationkey * 37) % 900 + 1 AS target FROM nation)"


@register(f"WITH {_STAGES}, t AS (SELECT *, ((coalesce(lag(target) OVER (ORDER BY stage), 1) + target) * duration_s) // 2 AS requests FROM s) SELECT stage, CAST(requests AS BIGINT) AS requests, CAST(sum(requests) OVER (ORDER BY stage) AS BIGINT) AS total_requests, CAST(sum(duration_s) OVER (ORDER BY stage) AS BIGINT) AS total_s FROM t")
def load_profile_cumulative(spark, sf_dir):
    stages = spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("n_nationkey AS stage", "60 + 30 * n_regionkey AS duration_s", "(n_nationkey * 37) % 900 + 1 AS target")
    return evaluate.load_profile(stages).select("stage", "requests", "total_requests", "total_s")


@register(f"WITH {_E}, b AS (SELECT *, lag(value) OVER (PARTITION BY event_type ORDER BY event_id) AS p FROM e), c AS (SELECT *, coalesce(abs((p - value) / p) <= 0.5, false) AS calm FROM b), i AS (SELECT *, sum(CASE WHEN calm THEN 0 ELSE 1 END) OVER (PARTITION BY event_type ORDER BY event_id) AS part FROM c) SELECT event_id, CAST(sum(CASE WHEN calm THEN 1 ELSE 0 END) OVER (PARTITION BY event_type, part ORDER BY event_id) AS BIGINT) AS stable FROM i")
def warmup_plateau(spark, sf_dir):
    w = _runs(spark, sf_dir).select("event_type", "event_id", F.col("event_id").alias("step"), F.col("value").alias("latency"))
    return evaluate.plateau(w, 0.5, ("event_type",)).select("event_id", "stable")


@register("SELECT r_name, event_type, n_name FROM region, (SELECT DISTINCT event_type FROM events), nation")
def parameter_grid(spark, sf_dir):
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    return evaluate.parameter_grid(read("region").select("r_name"), read("events").select("event_type").distinct(), read("nation").select("n_name"))


@register("WITH a AS (SELECT user_id, '[' || string_agg(props, ',' ORDER BY event_id) || ']' AS body FROM events GROUP BY 1) SELECT user_id, CAST(i - 1 AS INT) AS position, CAST(body AS JSON) ->> ('$[' || (i - 1) || '].k') AS k FROM (SELECT user_id, body, unnest(generate_series(1, CAST(json_array_length(CAST(body AS JSON)) AS BIGINT))) AS i FROM a)")
def json_array_split(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    lists = events.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "props"))).alias("l")).select("user_id", F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["props"]), ","), F.lit("]")).alias("body"))
    return readers.split_array(lists, keep=("user_id",)).select("user_id", "position", F.get_json_object("object", "$.k").alias("k"))


# ---- files ---------------------------------------------------------------------------------------

_BODY = "'{\"approved\":' || CASE WHEN approved THEN 'true' ELSE 'false' END || ',\"fraud_score\":' || CAST(fraud_score AS VARCHAR) || '}'"


@register(f"WITH {_vectors('tx', 'f64')} SELECT is_fraud, count(*) AS n, CAST(sum({' + '.join(f'CAST(round(v[{i}] * 10000) AS BIGINT) * {i}' for i in range(1, DIMS + 1))}) AS BIGINT) AS total FROM r GROUP BY is_fraud")
def references_roundtrip(spark, sf_dir):
    """Labelled vectors as JSON arrays and back: how many, and a sum over all their features."""
    path = shared_folder(spark, "references")
    sinks.write_references(m.in_space(m.transaction_vectors(spark, sf_dir), DIMS, "f64"), path)
    total = sum((F.round(F.col("vector")[i].cast("double") * 10000).cast("long") * (i + 1) for i in range(DIMS)), F.lit(0))
    return readers.references(spark, path).groupBy("is_fraud").agg(F.count(F.lit(1)).alias("n"), F.sum(total).alias("total"))


@register(f"WITH {TX} SELECT CAST(tx % 20 AS INT) AS part, count(*) AS n, count(*) FILTER (is_fraud) AS denied, CAST(sum(installments) AS BIGINT) AS installments, (SELECT count(*) FROM tx) AS total FROM tx GROUP BY 1")
def test_set_roundtrip(spark, sf_dir):
    """All transactions as one labelled document and back; the label stands for the expected decision."""
    path, p = shared_folder(spark, "test-set"), m.payloads(written(m.transactions(spark, sf_dir), "transactions"))
    score_ = F.when(F.col("is_fraud"), 1.0).otherwise(0.0)
    entries = p.select(F.col("tx").alias("position"), F.struct("id", "transaction", "customer", "merchant", "terminal", "last_transaction").alias("request"), (~F.col("is_fraud")).alias("expected_approved"), score_.alias("expected_fraud_score"))
    sinks.write_test_set(entries, evaluate.dataset_stats(entries), "0" * 64, path)
    back, stats = readers.test_set(spark, path)
    part = F.substring_index("request.id", "-", -1).cast("long") % 20
    found = back.groupBy(part.cast("int").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("expected_approved")).alias("denied"), F.sum("request.transaction.installments").alias("installments"))
    return found.crossJoin(F.broadcast(stats.select("total")))  # one row


@register(f"WITH {_RUNS} SELECT event_type AS dtype, 2048 AS clusters, 2 AS nprobe, round(median(p99), 6) AS p99, CAST(round(median(tp)) AS BIGINT) AS tp, CAST(round(median(fn)) AS BIGINT) AS fn, round(median(final_score), 6) AS final_score, bool_or(p99_cut) AS p99_cut, bool_or(detection_cut) AS detection_cut FROM t GROUP BY 1")
def aggregate_roundtrip(spark, sf_dir):
    """A document for each configuration written and read back."""
    path = shared_folder(spark, "aggregates")
    runs = _scored_runs(spark, sf_dir).select("*", F.col("event_type").alias("dtype"), F.lit(2048).alias("clusters"), F.lit(2).alias("nprobe"))
    sinks.write_aggregates(evaluate.aggregate_documents(runs), path)
    r = lambda c: F.round(c, 6).alias(c)
    return readers.run_results(spark, path).select("dtype", "clusters", "nprobe", r("p99"), "tp", "fn", r("final_score"), "p99_cut", "detection_cut")


# ---- rows only -----------------------------------------------------------------------------------

@register()
def generate_references(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    return generate.references(spark, n)


@register("SELECT count(*) AS n, CAST(true AS BOOLEAN) AS in_range, CAST(true AS BOOLEAN) AS labelled, CAST(true AS BOOLEAN) AS sentinels FROM orders")
def generated_profiles(spark, sf_dir):
    """Stated ranges and shares of the generated references: features, labels (0.9 r + 0.05 r), vectors without history."""
    refs = generate_references(spark, sf_dir)
    inside = F.forall(F.transform("vector", lambda v, i: v.between(0, 1) | (v == -1) & i.isin(5, 6)), lambda x: x)
    none = F.col("vector")[5] == -1
    near = lambda c, share: F.abs(F.avg(c.cast("double")) - share) < 0.05
    return refs.agg(F.count(F.lit(1)).alias("n"), F.bool_and(inside).alias("in_range"), near(F.col("is_fraud"), 0.285).alias("labelled"), (F.bool_and(none == (F.col("vector")[6] == -1)) & near(none, 0.2)).alias("sentinels"))


@register()
def generate_labelled(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    return generate.labelled(generate.references(spark, n), generate.payloads(spark, n, 0.47, 4141))


@register(f"WITH {_vectors('tx', 'i16')} SELECT ref_id, is_fraud FROM r")
def index_roundtrip(spark, sf_dir):
    """Build, write, read: every record comes back."""
    path = shared_folder(spark, "index")
    built = index.build(written(m.transaction_vectors(spark, sf_dir), "vectors"), DIMS, "i16", iterations=3)
    index.write(built, path)
    return index.read(spark, path).records.select("ref_id", "is_fraud")


@register(f"WITH {_scores('tx', 'i16')} SELECT 'tx-' || query_id AS id, CAST(NULL AS VARCHAR) AS reject, fraud_count, fraud_score, approved, {_BODY} AS body FROM d")
def stream_score(spark, sf_dir):
    """Transactions as JSON files through the streaming scorer."""
    from ..streaming import scorer

    path, every = shared_folder(spark, "stream"), m.payloads(written(m.transactions(spark, sf_dir), "transactions"))
    every.where("tx % 20 = 0").select(F.to_json(F.struct("id", "transaction", "customer", "merchant", "terminal", "last_transaction")).alias("value")).repartition(2).write.text(f"{path}/in")
    vectors = vectorize(every, ("tx", "is_fraud")).withColumnRenamed("tx", "ref_id")
    built = index.build(written(vectors, "vectors"), DIMS, "i16", iterations=3)
    scorer.start(scorer.text_source(spark, f"{path}/in", 8), built, f"{path}/out", f"{path}/state", once=True).awaitTermination()
    return spark.read.parquet(f"{path}/out").select("id", "reject", "fraud_count", "fraud_score", "approved", "body")
