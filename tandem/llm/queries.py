"""Registered queries of the numbered operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.llm.op01_url_filter import judge_urls
from tandem.llm.op02_substring import remove_repeats
from tandem.llm.op03_sharding import shard
from tandem.llm.op04_jaccard import jaccard_components
from tandem.llm.op05_quality import judge as judge_quality
from tandem.llm.op06_mixing import mix
from tandem.llm.op07_packing import pack
from tandem.llm.op08_lines import line_report
from tandem.llm.op09_simhash import edited, with_near_counts
from tandem.llm.op10_toxicity import score as score_toxicity
from tandem.llm.op11_fim import digest as fim_digest
from tandem.llm.op11_fim import fill_in_middle
from tandem.llm.op12_whitening import whiten
from tandem.llm.op13_pii import personal_data
from tandem.llm.op13_pii import report as pii_report

Query = Callable[[SparkSession, str], DataFrame]

#: name -> (query, DuckDB SQL or None)
QUERIES: dict[str, tuple[Query, str | None]] = {}

#: Words of a text in DuckDB: the same class as the operators use.
WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = (fn, sql)
        return fn
    return add


@register("op2_substring_dedup", sql=f"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS g
        FROM d, unnest(range(1, len(w) - 48)) AS t(i)),
bad AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS lo FROM win) WHERE doc_id > lo),
covered AS (SELECT DISTINCT doc_id, i + k AS pos FROM bad, unnest(range(0, 50)) AS t(k)),
word AS (SELECT doc_id, pos, w[pos] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(pos)),
kept AS (SELECT word.doc_id, count(c.pos) AS n_removed,
                string_agg(CASE WHEN c.pos IS NULL THEN word END, ' ' ORDER BY word.pos) AS txt
         FROM word LEFT JOIN covered c ON word.doc_id = c.doc_id AND word.pos = c.pos GROUP BY word.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(txt, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"), keep_text=False)


@register("op1_url_filter", sql=r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
           FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r(rule, rhost, rpath, action) AS (VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
    ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'),
    ('net/fr/', 'net', '/fr/', 'block')),
best AS (SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action
         FROM (SELECT DISTINCT host, path FROM p), r
         WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY host, path)
SELECT page_id, p.host, p.path, rule, coalesce(action, 'allow') AS verdict
FROM p LEFT JOIN best ON p.host = best.host AND p.path = best.path""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"))


@register("op3_sharding")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(_table(spark, sf_dir, "documents"))


@register("op5_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(_table(spark, sf_dir, "documents"))


@register("op7_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


@register("op10_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@register("op6_mixing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"), keep=["doc_id", "source"])


@register("op9_fingerprints")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_near_counts(edited(_table(spark, sf_dir, "documents"))).drop("fp")


@register("op4_jaccard_join", sql=f"""
WITH RECURSIVE low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
d AS (SELECT doc_id, {WORDS_SQL} AS w FROM low),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1),
             lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g
      FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY x, y),
l AS (SELECT x, y FROM p JOIN n na ON na.doc_id = x JOIN n nb ON nb.doc_id = y WHERE 100 * o >= 90 * (na.n + nb.n - o)),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.y, r.m FROM r JOIN l ON r.doc_id = l.x)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(m) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id) GROUP BY d.doc_id""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents")).drop("rk")


@register("op8_line_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(_table(spark, sf_dir, "documents"))


@register("op11_fim", sql=r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS unit, ('0x' || h[1:8])::BIGINT AS h1,
             ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, len(unit) AS n, least(h1 % (len(unit) + 1), h2 % (len(unit) + 1)) AS a,
             greatest(h1 % (len(unit) + 1), h2 % (len(unit) + 1)) AS b,
             t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') AS plain FROM u),
x AS (SELECT *, array_to_string(unit[1:a], '') AS p, array_to_string(unit[a + 1:b], '') AS m,
             array_to_string(unit[b + 1:], '') AS s FROM c)
SELECT doc_id, n::BIGINT AS n, CASE WHEN plain THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
       CASE WHEN NOT plain THEN length(p) END::BIGINT AS prefix_chars,
       CASE WHEN NOT plain THEN length(m) END::BIGINT AS middle_chars,
       sha256(CASE WHEN plain THEN t WHEN h4 % 100 < 50 THEN '<S>' || s || '<P>' || p || '<M>' || m
                   ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM x""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim_digest(fill_in_middle(_table(spark, sf_dir, "documents")))


@register("op12_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten(_table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


@register("op13_pii")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(personal_data(_table(spark, sf_dir, "documents")))
