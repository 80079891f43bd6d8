"""The queries of this package with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, divergence, flac, interpolation, jaccard, line_dedup, mixing, packing, quality, repeats, token_files, topk, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_segment_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op2_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digest(line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op5_certified_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"), width=3, percent=90)


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).drop("repeats")


def op8_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.media_round_trip(_table(spark, sf_dir, "documents"))


def op9_bwt_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_digest(repeats.remove_repeats(_table(spark, sf_dir, "documents")))


def op10_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.preference_rows(_table(spark, sf_dir, "conversations"))
    spans = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["start"].cast("string"), F.lit("+"), x["length"].cast("string"))), ",")
    return rows.withColumn("chosen_spans", spans("chosen_spans")).withColumn("rejected_spans", spans("rejected_spans"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolation.interpolated_scores(_table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_segment_top_k, op2_bradley_terry_quality, op3_token_orc, op4_line_dedup, op5_certified_packing, op6_jaccard_join, op7_source_mix, op8_flac_media, op9_bwt_repeats, op10_preference_chat, op11_embedding_whitening, op12_deleted_interpolation, op13_source_divergence)}


_TOP_K = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""

_LINES = r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
common AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (c.key IS NULL), '')) AS kept_sha256 FROM k LEFT JOIN common c ON k.key = c.key GROUP BY doc_id"""

_MIX = r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM d GROUP BY source),
r AS (SELECT *, source_size * 3.0::DOUBLE AS cap, sum(source_size) OVER ()::DOUBLE AS total, sum(w) OVER () AS ws FROM t),
c AS (SELECT *, cap / w < (total - coalesce(sum(cap) OVER b, 0)) / (ws - coalesce(sum(w) OVER b, 0)) AS capped FROM r WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE least(cap, w * (total - coalesce(sum(cap) FILTER (capped) OVER (), 0)) / sum(w) FILTER (NOT capped) OVER ()) END AS target FROM c),
p AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::BIGINT ELSE 0 END AS whole, CASE WHEN whole < 3 THEN target - whole * source_size ELSE 0 END AS rem FROM g),
x AS (SELECT d.*, source_size, target, whole, rem, sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upper, sum(size) OVER (PARTITION BY d.source, h) AS own FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN rem > 0 AND (upper <= rem OR upper - own <= rem AND upper - rem < rem - (upper - own)) THEN 1 ELSE 0 END))::BIGINT AS taken FROM x"""


_RENDER = "array_to_string(list_transform({0}, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)), '')"
_SPANS = "array_to_string(list_transform(list_filter(range(1, len({0}) + 1), lambda i: {0}[i].role = 'assistant'), lambda i: (coalesce(list_sum(list_transform({0}[1:i - 1], lambda x: length(x.role) + length(x.text) + 13)), 0)::BIGINT + length({0}[i].role) + 5)::VARCHAR || '+' || (length({0}[i].text) + 7)::VARCHAR), ',')"

_PAIRS = f"""WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, text) AS turns, md5(conv_id::VARCHAR) AS mixed FROM t GROUP BY conv_id),
u AS (SELECT *, ('0x' || substr(mixed, 1, 8))::BIGINT AS number, list_max(list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant')) AS last FROM c),
k AS (SELECT *, turns[1] AS opening, {{'mixed': mixed, 'id': conv_id, 'reply': turns[last].text}} AS given, count(*) OVER (PARTITION BY turns[1]) AS n, count(*) OVER () AS total FROM u WHERE last IS NOT NULL),
d AS (SELECT *, lead({{'id': conv_id, 'turns': turns}}) OVER (PARTITION BY opening, number // 64 % ceil(n / 512)::BIGINT ORDER BY mixed, conv_id) AS peer,
  lead(given) OVER b AS following, first_value(given) OVER b AS foremost, min(given) OVER () AS least, max(given) OVER () AS most FROM k WINDOW b AS (PARTITION BY number % ceil(total / 512)::BIGINT ORDER BY mixed, conv_id)),
e AS (SELECT *, CASE WHEN following IS NOT NULL THEN following WHEN foremost.id <> conv_id THEN foremost WHEN least.id <> conv_id THEN least WHEN most.id <> conv_id THEN most END AS donor FROM d),
p AS (SELECT conv_id, CASE WHEN peer IS NOT NULL THEN peer.id ELSE donor.id END AS other_id, turns AS chosen,
  CASE WHEN peer IS NOT NULL THEN peer.turns ELSE list_concat(list_concat(turns[1:last - 1], [{{'role': 'assistant', 'text': coalesce(donor.reply, '')}}]), turns[last + 1:]) END AS rejected FROM e),
q AS (SELECT *, coalesce(list_min(list_filter(range(1, least(len(chosen), len(rejected)) + 1), lambda i: chosen[i] <> rejected[i])) - 1, least(len(chosen), len(rejected)))::INT AS n_common FROM p),
f AS (SELECT *, chosen[n_common + 1:] AS a, rejected[n_common + 1:] AS b FROM q)
SELECT conv_id, other_id, n_common, {_RENDER.format("chosen[1:n_common]")} AS prompt, {_RENDER.format("a")} AS chosen_text, {_RENDER.format("b")} AS rejected_text, {_SPANS.format("a")} AS chosen_spans, {_SPANS.format("b")} AS rejected_spans FROM f"""


_SHARE = "1 + 1000000000::HUGEINT * ({0} + 5) // ({1} + 5 * v)"

_DIVERGENCE = rf"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT lang, source, r, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS c FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
l AS (SELECT g.lang, count(k.term) AS v, coalesce(sum(c), 0) AS n FROM (SELECT DISTINCT lang FROM d) g LEFT JOIN k USING (lang) GROUP BY g.lang),
c AS (SELECT lang, source, term, count(*) AS c FROM w SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT s.lang, s.source, l.v, l.n AS all_n, coalesce(sum(c.c), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) s JOIN l USING (lang) LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, {_SHARE.format("coalesce(c.c, 0)", "g.n")} AS p, {_SHARE.format("k.c", "g.all_n")} AS q FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
f AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = a.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
o AS (SELECT lang, source, 'pair' AS part, item, value FROM f UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM o) WHERE part = 'pair' OR rank <= 50"""


def oracle_sql() -> dict[str, str]:
    return {"op13_source_divergence": _DIVERGENCE, "op1_segment_top_k": _TOP_K, "op4_line_dedup": _LINES, "op7_source_mix": _MIX, "op10_preference_chat": _PAIRS}
