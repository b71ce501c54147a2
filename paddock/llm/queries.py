"""The registered queries of this subpackage: each applies one operator, with
production parameters, to a whole table; SQL where DuckDB can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.llm.common import table
from paddock.llm.decontaminate import contaminations
from paddock.llm.html_text import main_texts
from paddock.llm.jaccard_join import jaccard_components
from paddock.llm.language_id import languages, learn_languages
from paddock.llm.language_model import model_scores
from paddock.llm.mixing import mixed
from paddock.llm.neighbours import nearest_vectors
from paddock.llm.piece_codec import decoded, encoded
from paddock.llm.pseudonyms import key_of, pseudonymised
from paddock.llm.quality import fit_quality, quality_scores
from paddock.llm.resampling import importance_sample
from paddock.llm.token_counts import token_counts
from paddock.llm.vector_codes import vector_codes

WORDS_SQL = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each benchmark passage found: documents without a row are clean."""
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal shares for all sources, as many rows out as in (expected)."""
    return mixed(table(spark, sf_dir, "documents"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_vectors(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return languages(docs, learn_languages(docs))


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_scores(table(spark, sf_dir, "documents"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the rewritten text, how many values were replaced and where, and the key's name."""
    return pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), key_of(spark))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 parts, 16 entries, 6 rounds."""
    return vector_codes(table(spark, sf_dir, "embeddings"))


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and the text that they stand for, as digests."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    both = decoded(encoded(table(spark, sf_dir, "documents"), model), model)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents with at least 20 words, drawn towards the benchmark's words."""
    return importance_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def codes_sql() -> str:
    """The rounds written out, since each one is a join with the codebooks of the one before."""
    text = """WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
p AS MATERIALIZED (SELECT r, position, x[position * len(x) // 8 + 1:(position + 1) * len(x) // 8] AS part FROM v, range(8) AS t(position)),
q AS MATERIALIZED (SELECT position, part, count(*) AS n FROM p GROUP BY ALL),
i AS (SELECT r, row_number() OVER (ORDER BY vec_id, x) - 1 AS entry FROM v),
b0 AS MATERIALIZED (SELECT position, entry, part AS e FROM i JOIN p USING (r) WHERE entry < 16)"""
    for k in range(7):
        text += f""",
a{k} AS MATERIALIZED (SELECT q.position, part, n, min({{'d': CAST(list_sum(list_transform(range(1, len(part) + 1), lambda i: (part[i] - e[i]) * (part[i] - e[i]))) AS BIGINT), 'k': entry}}) AS m
  FROM q JOIN b{k} b ON q.position = b.position GROUP BY ALL)"""
        if k < 6:
            text += f""",
s{k} AS (SELECT position, m.k AS entry, i, CAST(sum(part[i] * n) AS BIGINT) AS s, CAST(sum(n) AS BIGINT) AS c FROM a{k}, range(1, len(part) + 1) AS t(i) GROUP BY ALL),
b{k + 1} AS MATERIALIZED (SELECT position, entry, coalesce(f.e, b.e) AS e FROM b{k} b LEFT JOIN
  (SELECT position, entry, list((s - ((s % c) + c) % c) // c ORDER BY i) AS e FROM s{k} GROUP BY ALL) f USING (position, entry))"""
    return text + """,
h AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY position, entry)) AS codebooks_sha256 FROM b6),
c AS (SELECT r, string_agg(printf('%02x', m.k), '' ORDER BY position) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM p JOIN a6 USING (position, part) GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN c USING (r), h"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_mix": op2_mix,
    "op3_nearest": op3_nearest,
    "op4_language": op4_language,
    "op5_tokens": op5_tokens,
    "op6_quality": op6_quality,
    "op7_html": op7_html,
    "op8_language_model": op8_language_model,
    "op9_jaccard": op9_jaccard,
    "op10_pii": op10_pii,
    "op11_codes": op11_codes,
    "op12_pieces": op12_pieces,
    "op13_resample": op13_resample,
}

SQL: dict[str, str] = {
    "op2_mix": """
WITH RECURSIVE n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
t AS (SELECT CAST(sum(n) AS DOUBLE) AS total, 1.0::DOUBLE / count(*) AS share FROM n),
r AS (SELECT source, share * total * 1.0::DOUBLE / n AS rate FROM n, t),
q AS (SELECT source, rate / greatest(ceil(rate / 400), 1) AS rate, CAST(greatest(ceil(rate / 400), 1) AS BIGINT) AS parts FROM r),
cdf AS (SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM q
  UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf
  WHERE k < CAST(trunc(rate + 12 * sqrt(rate) + 20) AS INTEGER)),
f AS (SELECT source, list(c ORDER BY k) AS cdf FROM cdf GROUP BY source),
d AS (SELECT row_number() OVER () AS row, doc_id, text, lang, d.source, n_chars, coalesce(CAST(doc_id AS VARCHAR), '') AS name, cdf, unnest(range(0, parts)) AS part
  FROM documents d JOIN q ON q.source IS NOT DISTINCT FROM d.source JOIN f ON f.source IS NOT DISTINCT FROM d.source),
u AS (SELECT *, CAST('0x' || substr(md5('17:' || name || '/' || part), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE AS u FROM d),
m AS (SELECT row, doc_id, text, lang, source, n_chars, name, CAST(sum(len(list_filter(cdf, lambda c: c <= u))) AS BIGINT) AS copies
  FROM u GROUP BY ALL),
e AS (SELECT doc_id, text, lang, source, n_chars, name, unnest(range(0, copies)) AS copy_no FROM m)
SELECT doc_id, text, lang, source, n_chars, copy_no,
  CAST('0x' || substr(md5('17:' || name || ':' || copy_no), 1, 12) AS BIGINT) AS mix_key FROM e""",
    "op9_jaccard": rf"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.x = b.x AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, (SELECT min(b) FROM r WHERE r.a = s.doc_id) AS component_id FROM s""",
    "op11_codes": codes_sql(),
    "op13_resample": r"""
WITH c AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS tab),
f AS (SELECT 'd' AS side, doc_id AS id, row_number() OVER () AS r, text FROM documents UNION ALL SELECT 'b', NULL, row_number() OVER (), text FROM benchmark),
w AS (SELECT side, r, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM f),
n AS (SELECT side, r, w, count(*) AS n FROM w GROUP BY ALL),
h AS (SELECT w, hex(encode(w)) AS x FROM (SELECT DISTINCT w FROM n)),
b AS (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
    lambda v, y: xor(v >> 8, tab[xor(v, y) % 256 + 1])), 4294967295) % 10000 AS bucket FROM h, c),
k AS (SELECT side, r, bucket, sum(n) AS n FROM n JOIN b USING (w) GROUP BY ALL),
s AS (SELECT bucket, CAST(coalesce(sum(n) FILTER (side = 'd'), 0) AS DOUBLE) AS s, CAST(coalesce(sum(n) FILTER (side = 'b'), 0) AS DOUBLE) AS t FROM k GROUP BY bucket),
a AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM s),
g AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000)))) AS BIGINT) AS gain FROM s, a),
m AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS total FROM k JOIN g USING (bucket) WHERE side = 'd' GROUP BY r),
o AS (SELECT id AS doc_id, coalesce(n_features, 0) AS n_features,
    coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) AS weight,
    CAST('0x' || substr(sha256('2024:' || coalesce(CAST(id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM f LEFT JOIN m USING (r) WHERE side = 'd'),
p AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM o),
q AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place FROM p)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT count(*) FROM q WHERE n_features >= 20) * 10 // 100 THEN place END AS rank FROM q""",
}
