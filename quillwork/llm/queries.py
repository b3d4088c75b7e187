"""The registered queries of this package: production parameters over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.llm import cutting_stock, exact_dedup, exact_knn, fill_in_middle, language_id, packing, quality, segmentation_sampling, simhash_dedup, source_divergence, token_counts, token_file, toxicity
from quillwork.llm._common import fold, read_table, scratch_root
from quillwork.llm.bpe import public_vocabulary
from quillwork.llm.unigram import public_pieces

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{scratch_root(spark)}/token-file-{uuid.uuid4().hex}"
    token_file.write_token_file(read_table(spark, sf_dir, "documents"), out, public_vocabulary(), end_id=2)
    return token_file.read_token_file(spark, out)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op3_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, read_table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model).select("doc_id", fold("doc_id", 5, 0).alias("held_out"), "score", "predicted")


def op4_toxicity_nb(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model).select("doc_id", fold("doc_id", 3, 1).alias("held_out"), "score", "predicted")


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return exact_knn.exact_top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"), keep="max")


def op7_sentencepiece_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentation_sampling.sample_segmentations(read_table(spark, sf_dir, "documents"), public_pieces(), k=3)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = language_id.identify_languages(docs)
    return found.select("doc_id", fold("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), public_vocabulary())


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), public_pieces())


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.source_divergence(read_table(spark, sf_dir, "documents"))


def op12_cutting_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutting_stock.pack_by_patterns(read_table(spark, sf_dir, "documents"), public_vocabulary())


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_in_middle.fill_in_middle(read_table(spark, sf_dir, "documents"))
    before = fill_in_middle.restored(F.col("output"), F.col("form"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(before, 256).alias("restored_sha256"))


def queries() -> dict[str, Query]:
    found = (op1_token_file, op2_simhash_near_dedup, op3_quality_pu, op4_toxicity_nb, op5_exact_top_k, op6_exact_dedup, op7_sentencepiece_samples, op8_language_id, op9_best_fit_packing, op10_token_counts, op11_source_divergence, op12_cutting_stock_packing, op13_fill_in_middle)
    return {f.__name__: f for f in found}


OP6_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, coalesce(n.doc_id = g.keep_id, false) AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g USING (t)
"""


OP5_SQL = """
WITH v AS (SELECT vec_id, embedding, list_transform(embedding, lambda x: floor(256 * x::double)) AS e, len(embedding) AS dim FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT vec_id, list_transform(min(embedding), lambda x: floor(256 * x::double)) AS e, len(min(embedding)) AS dim FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint AS score FROM a q JOIN v c ON q.dim = c.dim AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::int AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
o AS (SELECT lang, source, r, unnest(ts) AS term FROM d),
e AS (SELECT lang, source, term, r, count(*) AS n FROM o GROUP BY ALL),
c AS (SELECT lang, source, term, sum(n)::bigint AS n, count(*) AS docs FROM e GROUP BY ALL),
k AS (SELECT lang, term, sum(n)::bigint AS n FROM c GROUP BY ALL HAVING sum(docs) >= 3),
v AS (SELECT lang, count(*) AS v, sum(n)::bigint AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT g.lang, g.source, k.term, k.n AS ln, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
m AS (SELECT lang, source, sum(n)::bigint AS n FROM w GROUP BY ALL),
p AS (SELECT w.lang, w.source, w.term, w.n, (1 + (1000000000::hugeint * (w.n + 1)) // (m.n + v.v))::bigint AS p, (1 + (1000000000::hugeint * (w.ln + 1)) // (v.n + v.v))::bigint AS q
      FROM w JOIN m ON m.lang = w.lang AND m.source = w.source JOIN v ON v.lang = w.lang),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::bigint AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::bigint AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::int AS rank FROM x)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200
"""

OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::varchar, '')) AS h FROM documents),
s AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS ts,
      ('0x' || h[1:8])::bigint AS h1, ('0x' || h[9:16])::bigint AS h2, ('0x' || h[17:24])::bigint AS h3, ('0x' || h[25:32])::bigint AS h4 FROM d),
f AS (SELECT *, len(ts) AS n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
      least(h1 % (len(ts) + 1), h2 % (len(ts) + 1)) AS a, greatest(h1 % (len(ts) + 1), h2 % (len(ts) + 1)) AS b FROM s),
p AS (SELECT *, array_to_string(ts[:a], '') AS pre, array_to_string(ts[a + 1:b], '') AS mid, array_to_string(ts[b + 1:], '') AS suf FROM f)
SELECT doc_id, n::bigint AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::bigint AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END::bigint AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_top_k": OP5_SQL, "op6_exact_dedup": OP6_SQL, "op11_source_divergence": OP11_SQL, "op13_fill_in_middle": OP13_SQL}
