"""Queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import common, edit_embedding, embedding_dedup, fim, langid, license_rules, license_scan, line_dedup, mixing, near_dedup, packing, pivot_index, resampling, substring_dedup, tokens


def op1_license_scan(spark, sf_dir):
    return license_scan.scan(common.documents(spark, sf_dir))


def op2_language_id(spark, sf_dir):
    return langid.identify(common.documents(spark, sf_dir))


def op3_substring_dedup(spark, sf_dir):
    return substring_dedup.remove_repeats(common.documents(spark, sf_dir))


def op4_mixing(spark, sf_dir):
    return mixing.mix(common.documents(spark, sf_dir))


def op5_edit_embedding(spark, sf_dir):
    return edit_embedding.fingerprints(common.documents(spark, sf_dir))


def op6_embedding_dedup(spark, sf_dir):
    return embedding_dedup.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(common.documents(spark, sf_dir), size=4)


def op8_token_counts(spark, sf_dir):
    return tokens.token_counts(common.documents(spark, sf_dir))


def op9_line_dedup(spark, sf_dir):
    return line_dedup.digest(common.documents(spark, sf_dir))


def op10_packing(spark, sf_dir):
    return packing.pack_documents(common.documents(spark, sf_dir))


def op11_fill_in_middle(spark, sf_dir):
    return fim.digest(common.documents(spark, sf_dir))


def op12_resampling(spark, sf_dir):
    return resampling.resample(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_nearest_neighbours(spark, sf_dir):
    return pivot_index.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    found = (op1_license_scan, op2_language_id, op3_substring_dedup, op4_mixing, op5_edit_embedding, op6_embedding_dedup, op7_near_dedup, op8_token_counts, op9_line_dedup, op10_packing, op11_fill_in_middle, op12_resampling, op13_nearest_neighbours, pipeline)
    return {f.__name__: f for f in found}


UPPER, LOWER = license_scan.LOWER.upper(), license_scan.LOWER


def _license_sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {quote(r.label)}, {quote(r.keyword)}, {quote(license_scan.pattern(r))}, {r.priority}, {r.weight}e0, {str(r.base).lower()})" for i, r in enumerate(license_rules.rules()))
    blanks = lambda x: f"(len({x}) - len(replace({x}, ' ', '')))"
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    return f"""WITH rules(nth, label, keyword, pattern, priority, weight, base) AS (VALUES {rows}),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{word}') AS words FROM documents),
d AS (SELECT doc_id, len(words) AS n_words, ' ' || array_to_string(words, '  ') || ' ' AS norm FROM w),
m AS (SELECT doc_id, nth, label, priority, weight, base, string_split_regex(norm, pattern) AS gaps, regexp_extract_all(norm, pattern) AS hits FROM d JOIN rules ON contains(norm, keyword)),
h AS (SELECT * EXCLUDE (gaps, hits), unnest(range(1, len(hits) + 1)) AS i, list_transform(gaps, lambda x: {blanks("x")}) AS g, list_transform(hits, lambda x: {blanks("x")}) AS b FROM m),
s AS (SELECT doc_id, nth, label, priority, weight, base, CAST((list_sum(list_slice(g, 1, i)) + coalesce(list_sum(list_slice(b, 1, i - 1)), 0)) // 2 AS BIGINT) AS first,
  CAST((list_sum(list_slice(g, 1, i)) + list_sum(list_slice(b, 1, i))) // 2 - 1 AS BIGINT) AS last FROM h),
k AS (SELECT * FROM s a WHERE base OR NOT EXISTS (SELECT 1 FROM s b WHERE b.doc_id = a.doc_id AND b.first <= a.first AND b.last >= a.last
  AND (b.priority > a.priority OR b.priority = a.priority AND (b.first, -b.last, b.nth) < (a.first, -a.last, a.nth)))),
r AS (SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(first) FILTER (WHERE base) AS first_word, max(first) FILTER (WHERE base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(weight) AS score, count(*) AS n_detections FROM k GROUP BY 1)
SELECT d.doc_id, CAST(n_words AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  coalesce(score, 0e0) AS score, coalesce(n_detections, 0) AS n_detections FROM d LEFT JOIN r USING (doc_id)"""


_REACH = """reach AS (SELECT id AS d, id AS r FROM nodes UNION SELECT reach.d, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.r)"""

_NEAR_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' '))) END AS s FROM w),
e AS (SELECT doc_id, unnest(s) AS h FROM sets),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM e x JOIN e y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM c JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * n >= 80 * (len(x.s) + len(y.s) - n)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), nodes AS (SELECT doc_id AS id FROM sets), {_REACH}
SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, m AS component_id, m = sets.doc_id AS kept FROM sets JOIN (SELECT d, min(r) AS m FROM reach GROUP BY 1) ON d = sets.doc_id"""

_VECTOR_SQL = f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id < q.vec_id WHERE list_inner_product(p.x, q.x) / (sqrt(list_inner_product(p.x, p.x)) * sqrt(list_inner_product(q.x, q.x))) >= 0.9),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), nodes AS (SELECT vec_id AS id FROM v), {_REACH}
SELECT v.vec_id, (SELECT count(*) FROM both_ways WHERE a = v.vec_id) AS n_links, m AS component_id, m = v.vec_id AS kept FROM v JOIN (SELECT d, min(r) AS m FROM reach GROUP BY 1) ON d = v.vec_id"""


_FIM_SQL = r"""WITH u AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT *, len(units) AS n, CAST('0x' || substr(x, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(x, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(x, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(x, 25, 8) AS BIGINT) AS h4 FROM u),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(list_slice(units, 1, a), '') AS prefix, array_to_string(list_slice(units, a + 1, b), '') AS middle, array_to_string(list_slice(units, b + 1, n), '') AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""


def _crc32(text: str) -> str:
    """SQL of the unsigned crc32 of a text's UTF-8 bytes."""
    table = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        table.append(str(x))
    data = f"list_transform(range(0, octet_length(encode({text}))), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda c, b: xor(c >> 8, list_extract([{', '.join(table)}], xor(c & 255, b) + 1))), 4294967295)"


_RESAMPLING_SQL = f"""WITH t AS (SELECT true AS own, doc_id, text FROM documents UNION ALL SELECT false, item_id, text FROM benchmark),
w AS (SELECT row_number() OVER () AS r, own, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM t),
o AS (SELECT r, own, unnest(w) AS a, unnest(list_slice(w, 2, len(w))) AS b, unnest(list_slice(w, 3, len(w))) AS c FROM w),
f AS (SELECT r, own, unnest([a, a || ' ' || b, a || ' ' || b || ' ' || c]) AS g FROM o),
n AS (SELECT r, own, g, count(*) AS n FROM f WHERE g IS NOT NULL GROUP BY 1, 2, 3),
d AS (SELECT g, {_crc32('g')} % 10000 AS bucket FROM (SELECT DISTINCT g FROM n)),
k AS (SELECT r, own, bucket, sum(n) AS n FROM n JOIN d USING (g) GROUP BY 1, 2, 3),
s AS (SELECT bucket, sum(n) FILTER (WHERE own) AS s, coalesce(sum(n) FILTER (WHERE NOT own), 0) AS t FROM k GROUP BY 1),
z AS (SELECT CAST(sum(s) AS DOUBLE) AS s, CAST(sum(t) AS DOUBLE) AS t FROM s),
q AS (SELECT bucket, CAST(floor(1000 * ln((s.t + 1e0) * (z.s + 10000) / ((s.s + 1e0) * (z.t + 10000)))) AS BIGINT) AS gain FROM s, z WHERE s.s IS NOT NULL),
v AS (SELECT r, sum(n) AS n, sum(n * gain) AS weight FROM k JOIN q USING (bucket) WHERE own GROUP BY 1),
x AS (SELECT doc_id, len(w) >= 20 AS able, CAST(coalesce(v.n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM w LEFT JOIN v USING (r) WHERE own),
y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5e0) / 4294967296e0))) AS BIGINT) AS score FROM x),
ranks AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS p, count(*) OVER (PARTITION BY able) * 5 // 100 AS m FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND p <= m THEN p END AS rank FROM ranks"""


def oracle_sql():
    return {"op1_license_scan": _license_sql(), "op6_embedding_dedup": _VECTOR_SQL, "op7_near_dedup": _NEAR_SQL, "op11_fill_in_middle": _FIM_SQL, "op12_resampling": _RESAMPLING_SQL}
