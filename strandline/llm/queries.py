"""The registered queries of the corpus operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import collocations, embed_dedup, html_extract, langid, lexical, line_dedup, mixing, packing, quality, sentencepiece_codec, simhash, token_file, toxicity

WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(folds: int) -> Column:
    """crc32 of doc_id as text, modulo ``folds``."""
    return F.crc32(F.col("doc_id").cast("string")) % folds


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.documents(token_file.write(table(spark, sf_dir, "documents"), WORD_VOCABULARY))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), WORD_VOCABULARY).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    forests = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judged(docs.select("doc_id", "text"), forests).drop("text")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, fold(4) != 2)
    return langid.identified(docs.select("doc_id", "text"), model).select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.checked(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = line_dedup.deduplicated(docs, line_dedup.build(docs))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


#: White space at a line's ends, and its key, as DuckDB writes them.
OP7_SQL = r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents),
keyed AS (
    SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines),
common AS (
    SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (
    SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id < c.last, false) AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extracted(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold(5) != 0)
    return toxicity.scored(docs.select("doc_id", "text"), model).select("doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH words AS (
    SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'q', item_id, text FROM benchmark),
terms AS (
    SELECT kind, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM words),
counts AS (SELECT kind, id, term, count(*)::BIGINT AS tf FROM terms GROUP BY ALL),
lengths AS (SELECT id AS doc_id, sum(tf)::BIGINT AS n FROM counts WHERE kind = 'd' GROUP BY id),
corpus AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM lengths),
norms AS (SELECT doc_id, 75 + (25 * n * docs) // total AS m FROM lengths, corpus),
asked AS (SELECT id AS item_id, term, tf AS reps FROM counts WHERE kind = 'q'),
weights AS (
    SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
    FROM counts, corpus WHERE kind = 'd' AND term IN (SELECT term FROM asked) GROUP BY term, docs),
scored AS (
    SELECT item_id, c.id AS doc_id, sum(reps * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
    FROM asked JOIN weights USING (term) JOIN counts c ON c.term = asked.term AND c.kind = 'd' JOIN norms ON norms.doc_id = c.id
    GROUP BY item_id, c.id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 20
"""


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
    SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
    FROM worded, (SELECT unnest(range(1, 6)) AS size) sizes WHERE len(w) >= size),
counts AS (SELECT lang, size, phrase, count(*)::BIGINT AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE size = 1 GROUP BY lang),
candidates AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE size >= 2 AND f >= 100),
cuts AS (
    SELECT c.*, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
    FROM candidates c, (SELECT unnest(range(1, 5)) AS k) ks WHERE k < size),
scored AS (
    SELECT u.lang, u.size, u.phrase, u.a, k, h.f AS l, t.f AS r, n, ((1000::HUGEINT * u.a * n) // (h.f::HUGEINT * t.f))::BIGINT AS score
    FROM cuts u JOIN counts h ON h.lang = u.lang AND h.phrase = u.head JOIN counts t ON t.lang = u.lang AND t.phrase = u.tail
    JOIN totals ON totals.lang = u.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
    SELECT lang, array_to_string(w[i:i + n - 1], ' ') AS phrase, max(a) AS most
    FROM candidates, (SELECT unnest(range(1, 5)) AS i), (SELECT unnest(range(2, 5)) AS n)
    WHERE n < size AND i + n - 1 <= size GROUP BY ALL)
SELECT l.lang, row_number() OVER (PARTITION BY l.lang ORDER BY score DESC, a DESC, l.phrase) AS rank, l.phrase, a, l, r, n, score
FROM lowest l LEFT JOIN inside i ON i.lang = l.lang AND i.phrase = l.phrase WHERE most IS NULL OR 100 * most < 100 * a
QUALIFY rank <= 2000
"""


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixing.measured(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text")
    return mixing.mixed(docs).select("doc_id", "size", "source_size", "target", "taken")


OP13_SQL = r"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
sources AS (
    SELECT source, sum(size)::HUGEINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sized GROUP BY source),
weighed AS (
    SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * source_size AS limit_ FROM sources),
poured AS (
    SELECT *, coalesce(sum(limit_) OVER earlier, 0) AS limits, coalesce(sum(w) OVER earlier, 0) AS ws FROM weighed
    WINDOW earlier AS (ORDER BY source_size * (10 // w), rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
filled AS (
    SELECT *, limit_ * ((SELECT sum(w) FROM weighed) - ws) <= w * ((SELECT sum(source_size) FROM weighed) - limits) AS is_full FROM poured),
rest AS (
    SELECT sum(source_size) - coalesce(sum(limit_) FILTER (WHERE is_full), 0) AS words, sum(w) FILTER (WHERE NOT is_full) AS w FROM filled),
shares AS (
    SELECT f.source, f.source_size::BIGINT AS source_size,
           CASE WHEN is_full THEN limit_::DOUBLE ELSE rest.words::DOUBLE * f.w / rest.w END AS target,
           CASE WHEN is_full THEN 3 ELSE rest.words * f.w END::HUGEINT AS num,
           CASE WHEN is_full THEN 1 ELSE rest.w * source_size END::HUGEINT AS den,
           ('0x' || md5('0|' || coalesce('s' || source, 'n'))[1:8])::BIGINT::HUGEINT AS drawn
    FROM filled f, rest),
numbered AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id NULLS FIRST) - 1 AS k FROM sized)
SELECT n.doc_id, n.size, s.source_size, s.target,
       CASE WHEN s.source_size > 0
            THEN n.size * ((num * (k + 1) + drawn * den // 4294967296) // den - (num * k + drawn * den // 4294967296) // den)
            ELSE 0 END::BIGINT AS taken
FROM numbered n JOIN shares s ON n.source IS NOT DISTINCT FROM s.source
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_simhash, op2_token_file, op3_best_fit_packing, op4_quality_rules, op5_language_id,
        op6_sentencepiece, op7_line_dedup, op8_html_extraction, op9_toxicity, op10_embedding_dedup,
        op11_lexical_search, op12_collocations, op13_source_mixing,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op7_line_dedup": OP7_SQL, "op11_lexical_search": OP11_SQL, "op12_collocations": OP12_SQL, "op13_source_mixing": OP13_SQL}
