"""The queries opN_<name> over the whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, fingerprint, html_extract, langid, line_dedup, near_dedup, pii, substring_dedup, token_rollup
from .common import load, shared_folder


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return decontaminate.flagged(found).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(load(spark, sf_dir, "documents"), digest=True)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(load(spark, sf_dir, "documents"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(load(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def remainder():
    """crc32 of the id as text, modulo 4; 2 marks the held-out documents."""
    return F.crc32(F.col("doc_id").cast("string")) % 4


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = langid.train(docs.where(remainder() != 2))
    held_out = F.coalesce(remainder() == 2, F.lit(False))
    return langid.identify(docs.select("doc_id", "text", held_out.alias("held_out")), model, keep=("held_out",)).select("doc_id", "held_out", "lang_pred", "score")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert all documents under one tokenizer version, revise them to the next, delete later copies; then replay every batch."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    rollup = token_rollup.Rollup(spark, shared_folder(spark, "rollup"))
    old, new = token_rollup.TOKENIZERS
    batches = {
        "insert": token_rollup.deltas(docs, old, 1),
        "revise": token_rollup.revisions(docs, docs, old, new),
        "delete": token_rollup.copy_deltas(docs, new),
    }
    for batch, rows in [*batches.items(), *batches.items()]:
        rollup.commit(batch, rows)
    rollup.compact()
    return rollup.totals()


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(load(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(load(spark, sf_dir, "documents"))
    joined = lambda e: F.concat_ws(",", F.transform(e, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))
    base = F.filter("entities", lambda e: e["base"])
    count = lambda kind: F.size(F.filter("entities", lambda e: e["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("entities")).alias("spans"))


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_next(load(spark, sf_dir, "documents"))


#: DuckDB: the words of a text, and the consecutive words of an item that make a window.
_WORDS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS.format('text')}, []) AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format('text')} AS w FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT DISTINCT item, least(13, len(w)) AS m, array_to_string(w[k:k + least(13, len(w)) - 1], ' ') AS s
      FROM (SELECT item, w, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS k FROM i WHERE len(w) > 0)),
m AS (SELECT DISTINCT m FROM p),
v AS (SELECT r, k, m, array_to_string(w[k:k + m - 1], ' ') AS s
      FROM (SELECT r, w, m, unnest(generate_series(1, len(w) - m + 1)) AS k FROM d, m WHERE len(w) >= m)),
h AS (SELECT v.r, v.k, v.m, p.item FROM v JOIN p USING (m, s)),
c AS (SELECT r, count(DISTINCT x) AS n FROM (SELECT r, unnest(generate_series(k, k + m - 1)) AS x FROM (SELECT DISTINCT r, k, m FROM h)) GROUP BY r),
t AS (SELECT r, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM h GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t.s, '')) AS items_sha256, coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""

OP6_SQL = r"""
WITH f AS (SELECT text, min(doc_id) AS m FROM documents WHERE text IS NOT NULL GROUP BY text)
SELECT source, lang, 'words-2' AS tokenizer_version, count(*) AS n_docs,
       CAST(sum(len(regexp_extract_all(coalesce(d.text, ''), '[\p{L}\p{N}]+|[^\x20\x09-\x0D\p{L}\p{N}]'))) AS BIGINT) AS n_tokens
FROM documents d LEFT JOIN f ON d.text = f.text WHERE NOT coalesce(d.doc_id > f.m, false)
GROUP BY source, lang
"""

#: Nearness as it is defined: one edit of a code point, or of a word, at some place k. One edit leaves one half of the shorter line whole, so these choose what is looked at.
OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS r, doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
o AS (SELECT r, k, ls[k] AS raw, trim(ls[k], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS s FROM (SELECT r, ls, unnest(generate_series(1, len(ls))) AS k FROM d WHERE text IS NOT NULL)),
l AS (SELECT s, min((r, k)) AS f, length(s) AS n, regexp_extract_all(s, '[^\x20\x09-\x0D]+') AS w FROM o WHERE length(s) >= 1 GROUP BY s),
x AS (SELECT f, n, s, w, len(w) AS m FROM l WHERE n >= 20),
h AS (SELECT DISTINCT f, n, s, h, e, CASE WHEN e THEN substr(s, 1, h) ELSE substr(s, n - h + 1) END AS c FROM (SELECT f, n, s, unnest([n // 2, (n - 1) // 2]) AS h FROM x), (VALUES (true), (false)) t(e)),
q AS (SELECT DISTINCT f, m, w, h, e, CASE WHEN e THEN w[1:h] ELSE w[m - h + 1:] END AS c FROM (SELECT f, m, w, unnest([m // 2, (m - 1) // 2]) AS h FROM x WHERE m >= 12), (VALUES (true), (false)) t(e)),
p AS (SELECT f, s, t, unnest(generate_series(0, least(length(s), length(t)))) AS k FROM (SELECT DISTINCT b.f AS f, a.s AS s, b.s AS t FROM h a JOIN h b USING (e, h, c) WHERE a.f < b.f AND abs(a.n - b.n) <= 1)),
v AS (SELECT f, s, t, unnest(generate_series(0, least(len(s), len(t)))) AS k FROM (SELECT DISTINCT b.f AS f, a.w AS s, b.w AS t FROM q a JOIN q b USING (e, h, c) WHERE a.f < b.f AND abs(a.m - b.m) <= 1)),
near AS (SELECT f FROM p WHERE substr(s, 1, k) = substr(t, 1, k) AND (substr(s, k + 2) = substr(t, k + 2) OR substr(s, k + 2) = substr(t, k + 1) OR substr(s, k + 1) = substr(t, k + 2))
         UNION SELECT f FROM v WHERE s[1:k] = t[1:k] AND (s[k + 2:] = t[k + 2:] OR s[k + 2:] = t[k + 1:] OR s[k + 1:] = t[k + 2:])),
g AS (SELECT o.r, o.k FROM o JOIN l USING (s) WHERE (o.r, o.k) <> l.f OR l.f IN (SELECT f FROM near))
SELECT d.doc_id, CAST(coalesce(len(d.ls), 0) AS BIGINT) AS n_lines, CAST(count(g.k) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(o.raw, chr(10) ORDER BY o.k) FILTER (g.k IS NULL), '')) AS kept_sha256
FROM d LEFT JOIN o USING (r) LEFT JOIN g USING (r, k) GROUP BY d.r, d.doc_id, d.ls
"""

OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
v AS (SELECT r, k, md5_number(array_to_string(w[k:k + 34], ' ')) AS h FROM (SELECT r, w, unnest(generate_series(1, len(w) - 34)) AS k FROM d WHERE len(w) >= 35)),
m AS (SELECT r, k FROM v WHERE h IN (SELECT h FROM v GROUP BY h HAVING count(*) > 1)),
c AS (SELECT DISTINCT r, unnest(generate_series(k, k + 34)) AS x FROM m),
x AS (SELECT r, x, w[x] AS t FROM (SELECT r, w, unnest(generate_series(1, len(w))) AS x FROM d)),
y AS (SELECT x.r, count(c.x) AS n, string_agg(x.t, ' ' ORDER BY x.x) FILTER (c.x IS NULL) AS s FROM x LEFT JOIN c USING (r, x) GROUP BY x.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN y USING (r)
"""


#: Links by counting common shingles, and whom each document reaches over links.
OP7_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
x AS (SELECT DISTINCT r, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM (SELECT r, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 3) UNION ALL SELECT r, array_to_string(w, ' ') FROM d WHERE len(w) IN (1, 2)),
n AS (SELECT r, count(*) AS n FROM x GROUP BY r),
h AS (SELECT r, md5_number(t) AS h FROM x),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS i FROM h a JOIN h b USING (h) WHERE a.r <> b.r GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n u ON u.r = a JOIN n v ON v.r = b WHERE 100 * i >= 85 * (u.n + v.n - i)),
c AS (SELECT r, r AS m FROM d UNION SELECT c.r, e.b FROM c JOIN e ON e.a = c.m),
k AS (SELECT c.r, min(d.doc_id) AS least FROM c JOIN d ON d.r = c.m GROUP BY c.r)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least AS component_id, doc_id = least AS kept FROM d JOIN k USING (r) LEFT JOIN n USING (r)
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_decontaminate, op2_substring_dedup, op3_bpe, op4_html, op5_langid, op6_token_counts, op7_near_dedup, op8_line_dedup, op9_pii, op10_fingerprint)}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1_SQL, "op2_substring_dedup": OP2_SQL, "op6_token_counts": OP6_SQL, "op7_near_dedup": OP7_SQL, "op8_line_dedup": OP8_SQL}
