"""The queries of this package, each with its production parameters, and their SQL where SQL has the means."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from attesta.llm import decontamination, exact, jaccard, licenses, manifest, packing, pii, quality, repeats, secrets, sharding, token_files, tries
from attesta.llm.shared import shared_dir, table

PII_KEY = "rotate-me"


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words", F.array_join("removed_lines", ",").alias("removed_lines")
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    map_path = f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    return sharding.shard_documents(table(spark, sf_dir, "documents"), map_path=map_path).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", "version"
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.matches(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), PII_KEY)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    kinds = F.array(*[F.lit(k) for k in secrets.KINDS])
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == secrets.KINDS.index(k))).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"), count("random"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.new_path(spark)
    token_files.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_files.read(spark, path, with_ids=False)


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.removal(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifest.manifest(table(spark, sf_dir, "documents"), {"tampered": manifest.tampered_leaf()})
    root = manifest.folded(F.coalesce("tampered", "leaf"), F.col("proof"))
    folded = rows.select("doc_id", "leaf", "subroot", "root", manifest.proof_hash(F.col("proof")).alias("proof_sha256"), root.alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.assign(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


OP2_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, source FROM documents),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
win AS (
  SELECT doc_id, unnest(generate_series(1, len(ws) - 2)) AS i, ws FROM w WHERE len(ws) >= 3),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM win),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY 1),
base AS (
  SELECT d.doc_id, source, len(ws)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (SELECT count(x) - count(DISTINCT x) FROM (SELECT unnest(string_split(d.text, chr(10))) AS x) WHERE regexp_matches(x, '[^\x20\x09-\x0D]'))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d JOIN w USING (doc_id) LEFT JOIN r USING (doc_id)),
ln AS (
  SELECT doc_id, source, text, i,
    md5(trim(regexp_replace(regexp_replace(lower(x), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'))) AS h,
    len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')) AS n
  FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
f AS (
  SELECT c.source, h FROM (SELECT source, h, count(DISTINCT text) AS n FROM ln GROUP BY 1, 2) c
  JOIN (SELECT source, count(*) AS nd FROM (SELECT DISTINCT source, text FROM documents) GROUP BY 1) t ON t.source IS NOT DISTINCT FROM c.source WHERE n > 5 AND n > 0.01 * nd),
rm AS (SELECT doc_id, sum(n)::BIGINT AS n_removed, string_agg(i::VARCHAR, ',' ORDER BY i) AS places FROM ln JOIN f ON f.h = ln.h AND f.source IS NOT DISTINCT FROM ln.source GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT coalesce(n_removed, 0) > 0.5 * n_words AS kept,
  coalesce(n_removed, 0) AS n_removed_words, coalesce(places, '') AS removed_lines
FROM base LEFT JOIN rm USING (doc_id)
"""


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM w WHERE len(ws) >= 5)
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY 1, 2, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT links.b, reach.r FROM reach JOIN links ON links.a = reach.doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r) AS component_id
FROM documents d JOIN reach USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY 1, 2
"""

OP9_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
p AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS m, array_to_string(ws[k:k + 9], ' ') AS g
  FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(len(ws) - 9, 1))) AS k FROM i WHERE len(ws) > 0)),
d AS (
  SELECT doc_id, k, m, array_to_string(ws[k:k + m - 1], ' ') AS g
  FROM (SELECT doc_id, ws, m, unnest(generate_series(1, len(ws) - m + 1)) AS k FROM w, (SELECT DISTINCT m FROM p) WHERE len(ws) >= m)),
h AS (SELECT doc_id, item_id, k, m FROM d JOIN p USING (m, g)),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + m - 1)) AS q FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""


#: CRC-32, folded byte by byte from its polynomial, of the decimal form of the ids ``{ids}``.
_CRC = """bits(b, k, v) AS (
  SELECT b, 0, b FROM range(256) t(b) UNION ALL SELECT b, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM bits WHERE k < 8),
tab AS (SELECT list(v ORDER BY b) AS t FROM bits WHERE k = 8),
crc(id, s, i, v) AS (
  SELECT DISTINCT {id}, {id}::VARCHAR, 0, 4294967295::BIGINT FROM {name}
  UNION ALL SELECT id, s, i + 1, xor(t[(xor(v, ascii(s[i + 1])) % 256) + 1], v // 256)::BIGINT FROM crc, tab WHERE i < length(s)),
crcs AS (SELECT id, xor(v, 4294967295) AS crc FROM crc WHERE i = length(s))"""

OP11_SQL = f"""
WITH RECURSIVE {_CRC.format(id="conv_id", name="conversations")},
t AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS ts FROM conversations GROUP BY 1),
b AS (
  SELECT t.conv_id, list_concat(coalesce(base.ts, [])[1:(crc % 9)], t.ts[(crc % 9) + 1:]) AS ts
  FROM t JOIN crcs ON crcs.id = t.conv_id LEFT JOIN t base ON base.conv_id = t.conv_id - t.conv_id % 5),
p AS (SELECT conv_id, d, len(ts) AS n, sha256(ts[1:d]::VARCHAR) AS k, sha256(ts[1:d - 1]::VARCHAR) AS up, octet_length(encode(ts[d].t)) AS bytes FROM (SELECT *, unnest(range(len(ts) + 1)) AS d FROM b)),
v AS (
  SELECT d, k, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(any_value(bytes), 0) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = n), '')) AS ends_sha256 FROM p GROUP BY 1, 2),
c AS (SELECT d - 1 AS d, up AS k, count(*) AS n FROM v WHERE d > 0 GROUP BY 1, 2),
w AS (SELECT v.*, coalesce(c.n, 0) AS n_children FROM v LEFT JOIN c USING (d, k)),
s AS (SELECT p.d, p.k, sum(w.saved) AS saved, count(*) FILTER (w.n_children = 0) AS leaves FROM w JOIN p ON p.conv_id = w.conv_id AND p.d <= w.d GROUP BY 1, 2)
SELECT w.conv_id, w.d AS depth, o.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, w.ends_sha256
FROM w JOIN s USING (d, k) LEFT JOIN v o ON o.d = w.d - 1 AND o.k = w.up
"""

_FIELD = "coalesce(octet_length(encode({0}::VARCHAR)) || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{n_chars}", "text")) + ")"

OP12_SQL = rf"""
WITH RECURSIVE {_CRC.format(id="doc_id", name="documents")},
leaf AS (
  SELECT doc_id, lang, {_LEAF.format(n_chars="n_chars")} AS leaf, {_LEAF.format(n_chars="(n_chars + 1)")} AS grown, crc % 7 = 0 AND n_chars IS NOT NULL AS hit
  FROM documents LEFT JOIN crcs ON id = doc_id),
ground AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaf),
lv(lang, k, pos, node, n) AS (
  SELECT lang, 0, pos, leaf, count(*) OVER (PARTITION BY lang) FROM ground
  UNION ALL SELECT lang, k + 1, pos // 2, h, (n + 1) // 2 FROM (
    SELECT lang, k, pos, n, sha256(node || coalesce(lead(node) OVER (PARTITION BY lang ORDER BY pos), '')) AS h FROM lv WHERE n > 1) WHERE pos % 2 = 0),
sub AS (SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, k AS height FROM lv WHERE n = 1),
up(k, pos, node, n) AS (
  SELECT 0, pos, subroot, count(*) OVER () FROM sub
  UNION ALL SELECT k + 1, pos // 2, h, (n + 1) // 2 FROM (SELECT k, pos, n, sha256(node || coalesce(lead(node) OVER (ORDER BY pos), '')) AS h FROM up WHERE n > 1) WHERE pos % 2 = 0),
walk(doc_id, lang, leaf, hit, pos, k, node, proof) AS (
  SELECT doc_id, lang, leaf, hit, pos, 0, CASE WHEN hit THEN grown ELSE leaf END, '' FROM ground
  UNION ALL SELECT w.doc_id, w.lang, w.leaf, w.hit, w.pos // 2, w.k + 1,
    CASE WHEN w.pos % 2 = 1 THEN sha256(s.node || w.node) ELSE sha256(w.node || coalesce(s.node, '')) END, w.proof || coalesce(s.node, '')
  FROM walk w JOIN lv ON lv.lang IS NOT DISTINCT FROM w.lang AND lv.k = w.k AND lv.pos = w.pos AND lv.n > 1
    LEFT JOIN lv s ON s.lang IS NOT DISTINCT FROM w.lang AND s.k = w.k AND s.pos = w.pos + 1 - 2 * (w.pos % 2)),
mid AS (SELECT w.doc_id, w.leaf, w.node, w.proof, sub.subroot, sub.pos FROM walk w JOIN sub ON sub.lang IS NOT DISTINCT FROM w.lang AND sub.height = w.k),
climb(doc_id, leaf, subroot, pos, k, node, proof) AS (
  SELECT doc_id, leaf, subroot, pos, 0, node, proof FROM mid
  UNION ALL SELECT c.doc_id, c.leaf, c.subroot, c.pos // 2, c.k + 1, CASE WHEN c.pos % 2 = 1 THEN sha256(s.node || c.node) ELSE sha256(c.node || coalesce(s.node, '')) END, c.proof || coalesce(s.node, '')
  FROM climb c JOIN up ON up.k = c.k AND up.pos = c.pos AND up.n > 1 LEFT JOIN up s ON s.k = c.k AND s.pos = c.pos + 1 - 2 * (c.pos % 2)),
top AS (SELECT node AS root, k FROM up WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified FROM climb JOIN top USING (k)
"""

OP13_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM n
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_conversation_trie": OP11_SQL, "op12_merkle_manifest": OP12_SQL, "op13_exact_dedup": OP13_SQL, "op2_quality_rules": OP2_SQL, "op8_ngram_jaccard": OP8_SQL, "op9_decontamination": OP9_SQL}
