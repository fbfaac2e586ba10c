"""One query for each operator, over its whole table, with production parameters; and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm import bpe, conversations, exact_dedup, fill_in_middle, hmm, ngram_join, packing, pii, quality, token_counts, toxicity, url_rules, warc

URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
TOKEN_LIMIT = 512


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), keep_ids=False)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_groups(_table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"), digest_all=True)


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    out = bpe.round_trip(_table(spark, sf_dir, "documents"), path)
    return out.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op6_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as archive records, and a second replica of them in which every 41st record is damaged and every 59th
    lost: one row a page with what the audit found."""
    from keelson.sources.durable import durable

    records = durable(warc.archived(_table(spark, sf_dir, "pages")), "records")
    replica = records.where("coalesce(page_id % 59 <> 0, true)").withColumn("record_sha256", F.when((F.col("page_id") % 41 == 0) & F.col("damaged_sha256").isNotNull(), F.col("damaged_sha256")).otherwise(F.col("record_sha256")))
    found = warc.audit(records, replica).select("archive", "offset", "status", "right_sha256")
    out = records.join(found, ["archive", "offset"], "left")
    return out.select("page_id", "archive", "offset", "length", "record_sha256", F.coalesce("status", F.lit("intact")).alias("status"), "right_sha256")


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(_table(spark, sf_dir, "documents")).drop("_row")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    out = toxicity.score_texts(docs, model)
    return out.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hmm.score_corpus(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", hmm.held_out("doc_id").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digested(_table(spark, sf_dir, "documents"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digested(_table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_after_damage(_table(spark, sf_dir, "conversations"))


def queries() -> dict:
    found = [op1_harmonic_packing, op2_token_counts, op3_ngram_jaccard_join, op4_exact_dedup, op5_bpe_round_trip, op6_merkle_fixity, op7_url_rules, op8_quality_rules, op9_toxicity, op10_hmm_scoring, op11_fill_in_middle, op12_personal_data, op13_conversation_repair]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_ngram_jaccard_join": NEAR_SQL, "op4_exact_dedup": EXACT_SQL, "op6_merkle_fixity": FIXITY_SQL, "op8_quality_rules": QUALITY_SQL, "op11_fill_in_middle": MIDDLE_SQL, "op13_conversation_repair": REPAIR_SQL}


EXACT_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM t
"""

NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS a FROM documents),
g AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(a) = 0 THEN [] WHEN len(a) < 5 THEN [array_to_string(a, ' ')]
        ELSE list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i:i + 4], ' ')) END)) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b, k = na.n AND k = nb.n AS same FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 5 * k >= 4 * (na.n + nb.n - k)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS class_id FROM r GROUP BY a),
d AS (SELECT a AS doc_id, count(*) AS n_links, count(*) FILTER (WHERE same) AS same_set FROM l GROUP BY a)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, coalesce(same_set, 0) AS same_set FROM c LEFT JOIN d USING (doc_id)
"""

_S = r"[\x20\x09-\x0D]"
QUALITY_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '{_S}+'), lambda x: x <> '') AS a, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
tri AS (SELECT doc_id, i, array_to_string(a[i:i + 2], ' ') AS s FROM (SELECT doc_id, a, unnest(range(1, len(a) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS n FROM tri) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM twice, (VALUES (0), (1), (2)) v(d) GROUP BY doc_id),
lines AS (SELECT doc_id, host, text, trim(regexp_replace(lower(x), '{_S}+', ' ', 'g'), ' ') AS line FROM (SELECT doc_id, host, text, unnest(l) AS x FROM w)),
often AS (SELECT host, line, count(DISTINCT doc_id) AS n, min(doc_id) AS first FROM lines GROUP BY ALL),
sizes AS (SELECT host, count(DISTINCT doc_id) AS n FROM t GROUP BY host),
above AS (SELECT host, line, first FROM often JOIN sizes USING (host) WHERE often.n > 5 AND (often.n > 50 OR often.n > sizes.n * 0.05)),
lost AS (SELECT doc_id, sum(len(string_split(line, ' '))) AS n FROM lines JOIN above USING (host, line) WHERE doc_id > first GROUP BY doc_id),
b AS (SELECT w.doc_id, len(a) AS n_words, len(regexp_replace(text, '{_S}', '', 'g')) AS word_chars, len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS removed_words
      FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (removed_words > 0 AND n_words - removed_words < n_words * 0.5) AS kept
FROM b
"""

FIXITY_SQL = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, coalesce(html, '') <> '' AS has FROM pages),
r AS (SELECT page_id, page_id // 500 AS archive, has, concat('WARC/1.0', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10), 'WARC-Record-ID: <urn:page:', page_id, '>', chr(13), chr(10), 'WARC-Target-URI: ', url, chr(13), chr(10), 'Content-Type: text/html', chr(13), chr(10), 'Content-Length: ') AS head,
  html, '#' || html[2:] AS bad, concat(chr(13), chr(10), chr(13), chr(10)) AS gap FROM p),
t AS (SELECT page_id, archive, has, concat(head, strlen(html), gap, html, gap) AS good, concat(head, strlen(bad), gap, bad, gap) AS bad FROM r),
h AS (SELECT page_id, archive, has, strlen(good) AS length, sha256(good) AS record_sha256, sha256(bad) AS bad_sha256 FROM t),
o AS (SELECT *, CAST(coalesce(sum(length) OVER (PARTITION BY archive ORDER BY page_id, record_sha256 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM h)
SELECT page_id, archive, "offset", length, record_sha256, CASE WHEN page_id % 59 = 0 THEN 'missing' WHEN page_id % 41 = 0 AND has AND bad_sha256 <> record_sha256 THEN 'corrupt' ELSE 'intact' END AS status,
  CASE WHEN page_id % 59 <> 0 AND page_id % 41 = 0 AND has AND bad_sha256 <> record_sha256 THEN bad_sha256 END AS right_sha256
FROM o
"""

MIDDLE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256(concat('7:', doc_id)) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS a, list_transform([0, 1, 2, 3], lambda k: CAST('0x' || substr(h, 1 + 8 * k, 8) AS BIGINT)) AS r FROM t),
c AS (SELECT *, len(a) AS n, least(r[1] % (len(a) + 1), r[2] % (len(a) + 1)) AS lo, greatest(r[1] % (len(a) + 1), r[2] % (len(a) + 1)) AS hi FROM u),
p AS (SELECT *, array_to_string(a[1:lo], '') AS prefix, array_to_string(a[lo + 1:hi], '') AS middle, array_to_string(a[hi + 1:], '') AS suffix,
        CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR r[3] % 100 >= 100 THEN 'plain' WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN len(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN len(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""

REPAIR_SQL = rf"""
WITH RECURSIVE ids AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS g FROM (SELECT DISTINCT conv_id FROM conversations)),
raw AS (SELECT g, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split(concat(coalesce(CAST(c.conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS bytes
        FROM conversations c JOIN ids ON c.conv_id IS NOT DISTINCT FROM ids.conv_id),
hit AS (SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda c, b: list_reduce(list_prepend(xor(c, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda d, e: xor(d >> 1, CASE WHEN d % 2 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 20 AS hit FROM raw),
kept AS (SELECT g, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN hit = 3 THEN [0, 1] ELSE [0] END) AS copy FROM hit WHERE hit <> 0),
pos AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, md5(concat_ws(':', length(role), role, text)), copy) AS pos FROM kept),
fault AS (SELECT *, substr(role, 1, 1) AS i, NOT regexp_matches(text, '[^ 	-
]') AS blank, row_number() OVER (PARTITION BY g, role, text ORDER BY pos) > 1 AS again, NOT regexp_matches(text, '[.!?]{_S}*$') AS cut FROM pos),
r AS (SELECT *, CASE WHEN blank THEN 'blank' WHEN again THEN 'duplicate' WHEN cut THEN 'truncated' ELSE '' END AS f, lag(i) OVER (PARTITION BY g ORDER BY pos) || i AS pair FROM fault),
k AS (SELECT g, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE f = 'blank') AS blank, count(*) FILTER (WHERE f = 'duplicate') AS duplicate,
        count(*) FILTER (WHERE f = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY g),
e AS (SELECT g, pos, i, role, text, CASE f WHEN 'blank' THEN 1000000 WHEN 'duplicate' THEN 1000000 WHEN 'truncated' THEN 1 ELSE 0 END AS p FROM r),
v AS (SELECT g, n + 1 AS pos, CAST([0, 4, 2, 0] AS BIGINT[]) AS c FROM k
      UNION ALL
      SELECT g, pos, [least(b[1], 2 + b[3], 4 + b[4]), least(b[2], 2 + b[3], 4 + b[4]), least(b[3], 2 + b[4]), least(b[4], 2 + b[3])]
      FROM (SELECT g, pos, [least(3 + c[1], us, CASE WHEN i = 's' THEN p + c[2] ELSE us END), least(3 + c[2], us), least(3 + c[3], asst), least(3 + c[4], us)] AS b
            FROM (SELECT e.g, e.pos, i, p, c, p + CASE WHEN i = 'u' THEN 0 ELSE 2 END + c[3] AS us, p + CASE WHEN i = 'a' THEN 0 ELSE 2 END + c[4] AS asst FROM v JOIN e ON e.g = v.g AND e.pos = v.pos - 1))),
f AS (SELECT g, CAST(1 AS BIGINT) AS pos, 0 AS st, '' AS audit, CAST([] AS VARCHAR[]) AS rep FROM k
      UNION ALL
      SELECT g, pos + CASE WHEN letter = 'I' THEN 0 ELSE 1 END, CASE letter WHEN 'D' THEN st WHEN 'K' THEN kto ELSE nx END, audit || letter,
             CASE letter WHEN 'D' THEN rep WHEN 'K' THEN list_append(rep, role || ':' || text) ELSE list_append(rep, CASE nx WHEN 2 THEN 'user:' ELSE 'assistant:' END || CASE letter WHEN 'R' THEN text ELSE '' END) END
      FROM (SELECT x.*, CASE WHEN there AND 3 + c2[st + 1] = c[st + 1] THEN 'D' WHEN 2 + c[nx + 1] = c[st + 1] THEN 'I' WHEN kto IS NOT NULL AND p + c2[kto + 1] = c[st + 1] THEN 'K' ELSE 'R' END AS letter
            FROM (SELECT f.*, e.pos IS NOT NULL AS there, e.role, e.text, e.p, v.c, w.c AS c2, [2, 2, 3, 2][st + 1] AS nx, CASE WHEN e.i = 's' AND st = 0 THEN 1 WHEN e.i = 'u' AND st <> 2 THEN 2 WHEN e.i = 'a' AND st = 2 THEN 3 END AS kto
                  FROM f JOIN v ON v.g = f.g AND v.pos = f.pos LEFT JOIN e ON e.g = f.g AND e.pos = f.pos LEFT JOIN v w ON w.g = f.g AND w.pos = f.pos + 1
                  WHERE e.pos IS NOT NULL OR st IN (1, 2)) x)),
done AS (SELECT f.g, audit, sha256(array_to_string(rep, chr(10))) AS sha FROM f JOIN k ON k.g = f.g AND f.pos = k.n + 1 AND st IN (0, 3)),
cost AS (SELECT g, c[1] AS cost FROM v WHERE pos = 1)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
       coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM ids LEFT JOIN k USING (g) LEFT JOIN done USING (g) LEFT JOIN cost USING (g)
"""
