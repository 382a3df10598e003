"""One registered query per operator, over whole tables, and its SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from quizspark.llm import (centroids, exact_dedup, line_rules, mixing, ngram, packing, periodic, quality, records, sharding, simhash,
                           toxicity, url_filter)
from quizspark.llm.common import WORD, text_or_empty

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(build):
        QUERIES[name] = build
        if sql:
            SQL[name] = sql
        return build
    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op6_exact_dedup", r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)""")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("text_sha256", exact_dedup.digest(text_or_empty()))
    return exact_dedup.mark_duplicates(docs, carry=["doc_id", "text_sha256"])


@query("op9_mix_sources", r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  ('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, text, '')), 1, 12))::BIGINT / 281474976710656.0 AS u
           FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM s),
w AS (SELECT *, (rk - 1) % 3 + 1 AS w, source_size * 3 AS cap FROM r),
f AS (SELECT *, cap::DOUBLE / w AS ratio,
             sum(source_size) OVER () - coalesce(sum(cap) OVER p, 0) AS room, sum(w) OVER () - coalesce(sum(w) OVER p, 0) AS ws
      FROM w WINDOW p AS (ORDER BY cap::DOUBLE / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT room::DOUBLE / ws AS level FROM f WHERE room::DOUBLE / ws <= ratio ORDER BY ratio, rk LIMIT 1),
t AS (SELECT source, source_size, least(cap::DOUBLE, level * w) AS target FROM w, l),
j AS (SELECT d.doc_id, d.size, t.source_size, t.target, d.u,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM j""")
def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.plan_mix(docs).select("doc_id", "size", "source_size", "target",
                                        (F.col("size") * F.col("copies")).alias("taken"))


@query("op10_token_records")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return records.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


@query("op5_simhash_near_dedup")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    linked = simhash.link_documents(docs, carry=["doc_id"], words=4)
    return linked.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query("op8_shard_shuffle")
def op8(spark, sf_dir):
    text = F.col("text")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(text_or_empty().cast("binary")).alias("text_crc32"))
    return sharding.shuffle_to_shards(docs, 24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op1_line_rules", r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS p
      FROM (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d)),
g AS (SELECT rid, p, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS g
      FROM w WINDOW o AS (PARTITION BY rid ORDER BY p)),
c AS (SELECT rid, p FROM g WHERE g IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
r AS (SELECT rid, count(DISTINCT q) AS n_repeat_words FROM (SELECT rid, unnest(range(p, p + 5)) AS q FROM c) GROUP BY 1),
m AS (SELECT rid, doc_id, source, t, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS n_words,
             length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
l AS (SELECT rid, source, t, trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g')) AS line
      FROM (SELECT rid, source, t, unnest(string_split(lower(t), chr(10))) AS x FROM m)),
n AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l WHERE line <> ''),
h AS (SELECT source, count(DISTINCT t) AS docs FROM d GROUP BY 1),
f AS (SELECT n.source, n.line FROM n JOIN h ON n.source IS NOT DISTINCT FROM h.source
      GROUP BY 1, 2, h.docs HAVING count(DISTINCT n.t) > 1000 OR count(DISTINCT n.t) > 5 AND count(DISTINCT n.t) > h.docs * 0.05),
x AS (SELECT n.rid, count(*) AS removed_lines, sum(n.n)::BIGINT AS removed_words
      FROM n JOIN f ON n.line = f.line AND n.source IS NOT DISTINCT FROM f.source GROUP BY 1),
b AS (SELECT m.doc_id, m.n_words, m.word_chars, m.n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
             coalesce(r.n_repeat_words, 0) AS n_repeat_words, coalesce(x.removed_lines, 0) AS removed_lines, coalesce(x.removed_words, 0) AS removed_words
      FROM m LEFT JOIN r USING (rid) LEFT JOIN x USING (rid))
SELECT *, n_words < 10 OR n_repeat_words * 100 > n_words * 20 AS base_failed,
       NOT (n_words < 10 OR n_repeat_words * 100 > n_words * 20) AND n_words - removed_words >= 10 AND n_words - removed_words >= n_words * 0.5 AS kept
FROM b""")
def op1(spark, sf_dir):
    return line_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), carry=["doc_id"])


@query("op7_quality_classifier")
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score_documents(docs, table(spark, sf_dir, "labels"), carry=["doc_id"])


def _day(key: F.Column, days: int) -> F.Column:
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long"), F.lit(days)).cast("int")


def fetches(pages: DataFrame) -> DataFrame:
    """Pages with a fetch time in 2024, drawn from a digest of the page's id."""
    day = _day(F.concat(F.lit("fetch|"), F.col("page_id").cast("string")), 366)
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), day).cast("timestamp").alias("fetched_at"))


def list_log(pages: DataFrame) -> DataFrame:
    """A dated list over the pages' own hosts, their parents and first path segments: four entries for every third pattern."""
    patterns = pages.select(F.explode(F.slice(url_filter.patterns_of(F.col("url")), 1, 4)).alias("pattern")).distinct()
    listed = patterns.where((_day(F.concat(F.lit("listed|"), "pattern"), 3) == 0) & F.col("pattern").contains("."))
    key = F.concat_ws("|", F.lit("entry"), "pattern", F.col("k").cast("string"))
    at = F.date_add(F.lit("2023-10-01").cast("date"), _day(key, 420)).cast("timestamp")
    return (listed.withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(4)])))
            .select("pattern", at.alias("listed_at"),
                    F.when(_day(F.concat(F.lit("action|"), key), 2) == 0, url_filter.BLOCK).otherwise(url_filter.ALLOW).alias("action")))


@query("op3_url_list_join", r"""
WITH p AS (SELECT page_id, url, DATE '2024-01-01' + (('0x' || substr(md5('fetch|' || page_id::VARCHAR), 1, 8))::BIGINT % 366)::INTEGER AS fetched,
                  regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '\.+$', '') AS host,
                  list_filter(string_split(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda s: s <> '') AS seg
           FROM pages),
q AS (SELECT *, string_split(host, '.') AS lab FROM p),
k AS (SELECT page_id, url, fetched, CASE WHEN host = '' THEN []::VARCHAR[] ELSE
             list_transform(range(1, len(lab) + 1), lambda i: array_to_string(lab[i:], '.')) ||
             list_transform(range(1, len(seg) + 1), lambda i: host || '/' || array_to_string(seg[1:i], '/')) END AS keys FROM q),
pat AS (SELECT DISTINCT unnest(keys[1:4]) AS pattern FROM k),
lis AS (SELECT pattern FROM pat WHERE ('0x' || substr(md5('listed|' || pattern), 1, 8))::BIGINT % 3 = 0 AND contains(pattern, '.')),
e AS (SELECT lower(pattern) AS pattern, DATE '2023-10-01' + (('0x' || substr(md5('entry|' || pattern || '|' || i), 1, 8))::BIGINT % 420)::INTEGER AS since,
             CASE WHEN ('0x' || substr(md5('action|entry|' || pattern || '|' || i), 1, 8))::BIGINT % 2 = 0 THEN 'block' ELSE 'allow' END AS action
      FROM lis, (SELECT unnest(range(4)) AS i)),
o AS (SELECT pattern, since, max(action) AS action FROM e GROUP BY 1, 2),
v AS (SELECT *, lead(since) OVER (PARTITION BY pattern ORDER BY since) AS until FROM o),
x AS (SELECT page_id, url, fetched, unnest(keys) AS key FROM k),
j AS (SELECT x.page_id, v.pattern, v.action, v.since FROM x JOIN v ON x.key = v.pattern AND x.fetched >= v.since AND (v.until IS NULL OR x.fetched < v.until)
      QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY contains(v.pattern, '/') DESC, length(v.pattern) DESC, v.pattern DESC) = 1)
SELECT p.page_id, strftime(p.fetched, '%Y-%m-%d') AS fetched_on, j.pattern, j.action, strftime(j.since, '%Y-%m-%d') AS listed_on,
       coalesce(j.action, 'allow') <> 'block' AS kept
FROM p LEFT JOIN j ON p.page_id = j.page_id""")
def op3(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.apply_list(fetches(pages), list_log(pages))
    day = "yyyy-MM-dd"
    return judged.select("page_id", F.date_format("fetched_at", day).alias("fetched_on"), "pattern", "action",
                         F.date_format("listed_from", day).alias("listed_on"), "kept")


@query("op2_retrieval_packing")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


@query("op4_ngram_score")
def op4(spark, sf_dir):
    return ngram.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """Documents of which a tenth, by a checksum of the id, repeat a stretch of their words from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def tail(w: F.Column) -> F.Column:
        a = (g % F.size(w)).cast("int")
        p = (1 + F.floor((F.size(w) - a) / (3 + g % 8))).cast("int")
        again = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((F.size(w) - a) / p).cast("int")))
        return F.array_join(F.slice(F.concat(F.slice(w, F.lit(1), a), again), F.lit(1), F.size(w)), " ")

    words = F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0))
    made = line_rules.let(words, lambda w: F.when(F.size(w) > 0, tail(w)).otherwise(F.lit("")))
    return docs.withColumn("text", F.when(F.col("text").isNotNull() & (h % 10 == 0), made).otherwise(F.col("text")))


@query("op12_periodic_runs")
def op12(spark, sf_dir):
    docs = with_periodic_tails(table(spark, sf_dir, "documents").select("doc_id", "text"))
    runs = periodic.mark_runs(docs)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"),
                                                                            r["period"].cast("string")), F.lit("\n"))), "")
    out = runs.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
                      F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
                      F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def _centroid_sql(rounds: int = 10) -> str:
    """The rounds one after the other; ``x`` has a row per component, ``c0`` to ``cN`` the centroids, ``a0`` to ``aN`` the nearest ones."""
    def assigned(k: int) -> str:
        return f"""a{k} AS MATERIALIZED (SELECT rid, c, d FROM (SELECT x.rid, c.c, sum((x.x - c.x) * (x.x - c.x)) AS d FROM x JOIN c{k} AS c USING (i) GROUP BY 1, 2)
          QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1)"""
    steps = [assigned(0)]
    for k in range(rounds):
        steps.append(f"""c{k + 1} AS MATERIALIZED (SELECT o.c, o.i, coalesce(m.x, o.x) AS x FROM c{k} AS o LEFT JOIN (
          SELECT c, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS x FROM (SELECT a.c, x.i, sum(x.x) AS s, count(*) AS n FROM a{k} AS a JOIN x USING (rid) GROUP BY 1, 2)) AS m
          ON o.c = m.c AND o.i = m.i)""")
        steps.append(assigned(k + 1))
    parts = ",\n".join(steps)
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
x AS MATERIALIZED (SELECT rid, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM v),
f AS (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR) NULLS LAST, v) - 1 AS c, v FROM v),
c0 AS MATERIALIZED (SELECT c, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM f WHERE c < 8),
{parts}
SELECT v.vec_id, a.c::INTEGER AS cluster, a.d::BIGINT AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
       (sum(a.d) OVER ())::BIGINT AS inertia, t.centroid_sha256
FROM v JOIN a{rounds} AS a USING (rid) JOIN (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY 1) AS t ON a.c = t.c"""


@query("op13_centroid_clusters", _centroid_sql())
def op13(spark, sf_dir):
    found = centroids.cluster_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.select("vec_id", *centroids.ADDED)


@query("op11_toxicity_cnn")
def op11(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return toxicity.score_documents(docs, table(spark, sf_dir, "labels"), carry=["doc_id"])
