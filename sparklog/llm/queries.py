"""The queries of this subpackage, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, html, language, media, neardup, pack, quality, records, substring

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.op1(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.op2(_table(spark, sf_dir, "pages"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.op3(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.op4(_table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.op5(_table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.op6(_table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op7(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op8(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.op9(_table(spark, sf_dir, "conversations"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.op10(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py, one after the other, over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_token_records, op2_main_text, op3_packing, op4_minhash_dedup, op5_language, op6_substring_dedup, op7_decontaminate, op8_quality, op9_chat, op10_media, pipeline)}


OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
pos AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0),
sh AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 3], ' ')) AS s FROM pos),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM w UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r),
low AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w JOIN low USING (doc_id) LEFT JOIN size USING (doc_id)
"""

OP6_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(ws) - 48)) AS i, ws FROM w WHERE len(ws) >= 50),
wins AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i + 49], ' ')) AS h FROM starts),
owner AS (SELECT h, min(doc_id) AS low FROM wins GROUP BY h),
dup AS (SELECT wins.doc_id, wins.i FROM wins JOIN owner USING (h) WHERE wins.doc_id > owner.low),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM dup),
lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
words AS (SELECT w.doc_id, w.ws, unnest(range(1, len(w.ws) + 1)) AS p FROM w JOIN lists USING (doc_id)),
kept AS (SELECT a.doc_id, string_agg(a.ws[a.p], ' ' ORDER BY a.p) AS t, count(*) AS n
         FROM words a ANTI JOIN gone g ON a.doc_id = g.doc_id AND a.p = g.p GROUP BY a.doc_id)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(coalesce(len(lists.ps), 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN lists.doc_id IS NULL THEN coalesce(array_to_string(w.ws, ' '), '') ELSE coalesce(kept.t, '') END) AS kept_sha256
FROM w LEFT JOIN lists USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\x00', ' ', 'g'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT item_id, least(13, len(ws)) AS n, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i, ws FROM b WHERE len(ws) > 0),
bg AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS g FROM bw),
ns AS (SELECT DISTINCT n FROM bg),
dw AS (SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS i, ws FROM d, ns WHERE len(ws) >= n),
hits AS (SELECT dw.doc_id, dw.i, dw.n, bg.item_id FROM dw JOIN bg ON bg.n = dw.n AND bg.g = array_to_string(dw.ws[dw.i:dw.i + dw.n - 1], ' ')),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names
          FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.ws) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_minhash_dedup": OP4_SQL, "op6_substring_dedup": OP6_SQL, "op7_decontaminate": OP7_SQL}
