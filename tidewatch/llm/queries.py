"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .fingerprints import edit_response, with_classes
from .jaccard import jaccard_groups
from .lines import without_repeated_lines
from .minhash import near_duplicates
from .mixing import mixed
from .quality_model import quality_scores
from .repair import repairs
from .repetition import quality_rules
from .storage import small_batches, text_key
from .style_tree import main_text
from .substrings import without_repeats
from .toxicity import toxic_passages
from .trie import prefix_trie


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The vocabulary file that the contract names; a parameter everywhere else."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(_table(spark, sf_dir, "pages"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(_table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "source", "size", "source_size", "target", "taken")


def op3_toxic_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxic_passages(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))


def op4_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, docs = tokenizer_path(), _table(spark, sf_dir, "documents").select("doc_id", "text")
    texts = bpe.decode(bpe.encode_texts(docs, path), path)
    digests = texts.select("key", F.size("ids").cast("long").alias("n_tokens"), bpe.ids_digest(F.col("ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
    return docs.select("doc_id", text_key().alias("key")).join(digests, "key").drop("key")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    digests = without_repeats(docs).select("key", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    return docs.select("doc_id", text_key().alias("key")).join(digests, "key").drop("key")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(_table(spark, sf_dir, "documents"), words=4, percent=85)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_fraction", "longest_repeat")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_classes(edit_response(_table(spark, sf_dir, "documents")))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), figures=True)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repairs(_table(spark, sf_dir, "conversations"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(_table(spark, sf_dir, "conversations"))


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), words=2, percent=80)


QUERIES = {f.__name__: f for f in (op1_main_text, op2_mix_sources, op3_toxic_passages, op4_bpe_encoding, op5_substring_dedup, op6_jaccard_join, op7_quality_rules, op8_fingerprints, op9_quality_classifier, op10_line_dedup, op11_conversation_repair, op12_prefix_trie, op13_minhash_dedup)}

_WORDS = r"list_filter(string_split_regex(coalesce({}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
#: crc32 of a string in SQL: each byte, then eight steps.
_CRC32 = "xor(list_reduce([4294967295::UBIGINT] || flatten(list_transform(range(1, strlen({0}) + 1), lambda i: [ascii(substr({0}, i, 1))::UBIGINT] || list_transform(range(8), lambda b: 4294967296::UBIGINT))), lambda c, x: CASE WHEN x < 4294967296 THEN xor(c, x) ELSE xor(c >> 1, 3988292384::UBIGINT * (c & 1)) END), 4294967295::UBIGINT)"
#: Where SQL can express a query; the others are tested against brute force, round trips or held-out labels.
ORACLE_SQL: dict[str, str] = {
    "op5_substring_dedup": f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format('text')} AS words FROM documents),
 k AS (SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
 h AS (SELECT r, i, md5(string_agg(word, ' ') OVER s) AS h, count(*) OVER s AS n FROM k WINDOW s AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
 often AS (SELECT h FROM h WHERE n = 35 GROUP BY h HAVING count(*) > 1),
 gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM h WHERE n = 35 AND h IN (SELECT h FROM often)),
 kept AS (SELECT k.r, string_agg(word, ' ' ORDER BY k.i) AS kept, count(*) AS n FROM k ANTI JOIN gone ON k.r = gone.r AND k.i = gone.i GROUP BY 1)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept ON w.r = kept.r""",
    "op6_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words FROM documents),
 k AS (SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i, len(words) AS m FROM w),
 a AS (SELECT r, i, m, string_agg(word, ' ') OVER s AS shingle, count(*) OVER s AS n FROM k WINDOW s AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
 s AS (SELECT DISTINCT r, shingle FROM a WHERE n = 4 OR (m < 4 AND i = 1)),
 c AS (SELECT r, count(*) AS n FROM s GROUP BY 1),
 pairs AS (SELECT x.r AS a, y.r AS b, count(*) AS shared FROM s x JOIN s y ON x.shingle = y.shingle AND x.r <> y.r GROUP BY 1, 2),
 links AS (SELECT a, b FROM pairs JOIN c ca ON ca.r = a JOIN c cb ON cb.r = b WHERE 100 * shared >= 85 * (ca.n + cb.n - shared)),
 reach AS (SELECT r AS a, r AS b FROM w UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
 least AS (SELECT reach.a, min(w.doc_id) AS component_id FROM reach JOIN w ON w.r = reach.b GROUP BY 1)
SELECT w.doc_id, coalesce(c.n, 0)::BIGINT AS n_shingles, component_id FROM w JOIN least ON least.a = w.r LEFT JOIN c ON c.r = w.r""",
    "op11_conversation_repair": f"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations),
 c AS (SELECT *, {_CRC32.format('s')} % 20 AS d FROM k),
 m AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM c),
 o AS (SELECT *, rtrim(text, E' \t\n\x0B\f\r') AS shown, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text), copy) AS i FROM m),
 f AS (SELECT *, CASE WHEN shown = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault,
  left(role, 1) AS letter, left(role, 1) || left(lead(role) OVER (PARTITION BY conv_id ORDER BY i), 1) AS two FROM o),
 t AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
  count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1),
 ids AS (SELECT DISTINCT conv_id FROM conversations),
 dp AS (SELECT conv_id, 0::BIGINT AS i, 0 AS q, {{'c': 0, 'a': ''}} AS w FROM ids UNION ALL
  SELECT conv_id, i, q, min(w) FROM (
   SELECT dp.conv_id, f.i, CASE edit WHEN 'D' THEN p.q WHEN 'K' THEN CASE letter WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE CASE WHEN p.q = 2 THEN 3 ELSE 2 END END AS q,
    {{'c': p.c + CASE edit WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN edit <> 'D' AND fault = 't' THEN 3 ELSE 0 END, 'a': p.a || edit}} AS w
   FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i + 1, (VALUES (0), (1)) v(ins), (VALUES ('K'), ('R'), ('D')) e(edit),
    LATERAL (SELECT CASE WHEN ins = 0 THEN dp.q WHEN dp.q = 2 THEN 3 ELSE 2 END AS q, dp.w.c + 3 * ins AS c, dp.w.a || repeat('I', ins) AS a) p
   WHERE edit = 'D' OR fault NOT IN ('b', 'd') AND (edit = 'R' OR letter = CASE WHEN p.q = 2 THEN 'a' ELSE 'u' END OR letter = 's' AND p.q = 0)) GROUP BY ALL),
 best AS (SELECT dp.conv_id, min({{'c': w.c + CASE q WHEN 2 THEN 3 ELSE 0 END, 'a': w.a || CASE q WHEN 2 THEN 'I' ELSE '' END}}) AS w FROM dp LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM dp.conv_id WHERE i = coalesce(n, 0) AND q <> 1 GROUP BY 1),
 x AS (SELECT conv_id, unnest(string_split(w.a, '')) AS edit, unnest(range(1, length(w.a) + 1)) AS j FROM best WHERE w.a <> ''),
 y AS (SELECT *, count(*) FILTER (edit <> 'I') OVER z AS i, count(*) FILTER (edit <> 'D') OVER z AS p FROM x WINDOW z AS (PARTITION BY conv_id ORDER BY j)),
 g AS (SELECT y.*, role, text, max(CASE WHEN p = 1 AND edit = 'K' AND letter = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY y.conv_id) AS s FROM y LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM y.conv_id AND f.i = y.i),
 r AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (p - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, E'\n' ORDER BY j) AS lines FROM g WHERE edit <> 'D' GROUP BY 1)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
 w.c::BIGINT AS cost, w.a AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM ids LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM ids.conv_id JOIN best ON best.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM ids.conv_id""",
    "op12_prefix_trie": f"""
WITH o AS (SELECT conv_id, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS m, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i FROM conversations WHERE conv_id IS NOT NULL),
 c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base, {_CRC32.format('conv_id::VARCHAR')} % 4 AS h FROM o),
 r AS (SELECT c.conv_id, m, words, i FROM c JOIN o ON o.conv_id = c.base AND i <= h UNION ALL SELECT c.conv_id, m, words, i FROM c JOIN o ON o.conv_id = c.conv_id AND i > h),
 p AS (SELECT conv_id, words, row_number() OVER z AS d, string_agg(m, '') OVER z AS key FROM r WINDOW z AS (PARTITION BY conv_id ORDER BY i)),
 whole AS (SELECT c.conv_id, coalesce(max(d), 0) AS depth FROM c LEFT JOIN p ON p.conv_id = c.conv_id GROUP BY 1),
 members AS (SELECT conv_id, 0 AS d, '' AS key, 0 AS words FROM c UNION ALL SELECT conv_id, d, key, words FROM p),
 nodes AS (SELECT key, d, any_value(words) AS words, min(m.conv_id) AS conv_id, count(*) AS n, string_agg(m.conv_id::VARCHAR, ',' ORDER BY m.conv_id) FILTER (whole.depth = d) AS ends FROM members m JOIN whole ON whole.conv_id = m.conv_id GROUP BY 1, 2),
 kids AS (SELECT left(key, length(key) - 32) AS key, count(*) AS children FROM nodes WHERE d > 0 GROUP BY 1),
 all_nodes AS (SELECT nodes.*, coalesce(children, 0) AS children FROM nodes LEFT JOIN kids ON kids.key = nodes.key),
 below AS (SELECT a.key, count(*) FILTER (b.children = 0) AS leaves, sum((b.n - 1) * b.words) AS saved FROM all_nodes a JOIN all_nodes b ON starts_with(b.key, a.key) GROUP BY 1)
SELECT a.conv_id, a.d::BIGINT AS depth, up.conv_id AS parent_conv_id, a.n::BIGINT AS n_convs, a.children::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(a.ends, '')) AS ends_sha256
FROM all_nodes a JOIN below ON below.key = a.key LEFT JOIN all_nodes up ON a.d > 0 AND up.key = left(a.key, length(a.key) - 32)""",
    "op13_minhash_dedup": f"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words FROM documents),
 k AS (SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i, len(words) AS m FROM w),
 a AS (SELECT r, i, m, word || ' ' || lead(word) OVER (PARTITION BY r ORDER BY i) AS pair, word FROM k),
 s AS (SELECT DISTINCT r, coalesce(pair, word) AS shingle FROM a WHERE pair IS NOT NULL OR m = 1),
 c AS (SELECT r, count(*) AS n FROM s GROUP BY 1),
 pairs AS (SELECT x.r AS a, y.r AS b, count(*) AS shared FROM s x JOIN s y ON x.shingle = y.shingle AND x.r <> y.r GROUP BY 1, 2),
 links AS (SELECT a, b FROM pairs JOIN c ca ON ca.r = a JOIN c cb ON cb.r = b WHERE 100 * shared >= 80 * (ca.n + cb.n - shared)),
 reach AS (SELECT r AS a, r AS b FROM w UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
 least AS (SELECT reach.a, min(w.doc_id) AS component_id FROM reach JOIN w ON w.r = reach.b GROUP BY 1)
SELECT w.doc_id, coalesce(c.n, 0)::BIGINT AS n_shingles, component_id, w.doc_id IS NOT DISTINCT FROM component_id AS kept FROM w JOIN least ON least.a = w.r LEFT JOIN c ON c.r = w.r""",
}
