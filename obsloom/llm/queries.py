"""The corpus queries by name, and the SQL of those that SQL can express."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, functions as F

import corpus_pipeline

from . import bwt_dedup, byte_bpe, extendible, max_sketch, mixing, neighbour_vote, order_minhash, prefix_tokens, secrets, sharding, simhash_ball, token_files, turn_repair


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_byte_bpe(spark, sf_dir):
    return byte_bpe.digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_order_minhash(spark, sf_dir):
    return order_minhash.edited_fingerprints(documents(spark, sf_dir))


def op3_secret_scan(spark, sf_dir):
    found = secrets.scan_documents(documents(spark, sf_dir))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op4_simhash_ball(spark, sf_dir):
    return simhash_ball.near_groups(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op5_mixing(spark, sf_dir):
    return mixing.mix(documents(spark, sf_dir))


def op6_suffix_dedup(spark, sf_dir):
    left = bwt_dedup.remove_repeats(documents(spark, sf_dir))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_token_files(spark, sf_dir):
    return token_files.read(token_files.write(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")))


def op8_neighbour_vote(spark, sf_dir):
    return neighbour_vote.score(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op9_sharding(spark, sf_dir):
    return sharding.shards(documents(spark, sf_dir))


def op10_extendible_dedup(spark, sf_dir):
    return extendible.dedup(documents(spark, sf_dir))


def op11_prefix_tokens(spark, sf_dir):
    return prefix_tokens.digests(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op12_turn_repair(spark, sf_dir):
    return turn_repair.damage_and_repair(table(spark, sf_dir, "conversations"))


def op13_max_sketch(spark, sf_dir):
    return max_sketch.search(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    own = [op1_byte_bpe, op2_order_minhash, op3_secret_scan, op4_simhash_ball, op5_mixing, op6_suffix_dedup, op7_token_files, op8_neighbour_vote, op9_sharding,
           op10_extendible_dedup, op11_prefix_tokens, op12_turn_repair, op13_max_sketch]
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    return {
        "op10_extendible_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
        "op12_turn_repair": r"""
WITH RECURSIVE bits(i, k, c) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
hashed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT)),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) % 20 AS hit FROM conversations, tab),
damaged AS (SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
  CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN hit = 3 THEN [0, 1] ELSE [0] END) AS copy FROM hashed WHERE hit <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, substr(role, 1, 1) AS ini,
  regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS final FROM damaged),
faulty AS (SELECT *, CASE WHEN final = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN final NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
  lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS pair FROM placed),
states(p, r, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
inserted(p, q, c, w) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 2, 'I'), (0, 3, 4, 'II'), (1, 2, 2, 'I'), (1, 3, 4, 'II'), (2, 3, 2, 'I'), (3, 2, 2, 'I')),
ways AS (SELECT conv_id, i, p, p AS q, 3 AS c, 'D' AS w FROM faulty, range(4) t(p)
  UNION ALL SELECT conv_id, i, p, q, (fault = 'truncated')::INT, 'K' FROM faulty JOIN states ON r = ini WHERE fault IN ('none', 'truncated')
  UNION ALL SELECT conv_id, i, p, q, 2 + (fault = 'truncated')::INT, 'R' FROM faulty, states WHERE r <> 's' AND fault IN ('none', 'truncated')),
walk(conv_id, i, q, best) AS (
  SELECT conv_id, 0::BIGINT, q, {'c': c, 'w': w} FROM (SELECT DISTINCT conv_id FROM faulty), inserted WHERE p = 0
  UNION ALL
  SELECT s.conv_id, s.i + 1, n.q, min({'c': s.best.c + x.c + n.c, 'w': s.best.w || x.w || n.w})
  FROM walk s JOIN ways x ON x.conv_id IS NOT DISTINCT FROM s.conv_id AND x.i = s.i + 1 AND x.p = s.q JOIN inserted n ON n.p = x.q GROUP BY s.conv_id, s.i, n.q),
sizes AS (SELECT conv_id, count(*) AS n, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM faulty GROUP BY conv_id),
chosen AS (SELECT w.conv_id, min(w.best) AS best FROM walk w JOIN sizes z ON w.conv_id IS NOT DISTINCT FROM z.conv_id AND w.i = z.n WHERE w.q IN (0, 3) GROUP BY w.conv_id),
letters AS (SELECT conv_id, unnest(string_split(best.w, '')) AS letter, generate_subscripts(string_split(best.w, ''), 1) AS k FROM chosen WHERE best.w <> ''),
dealt AS (SELECT *, count(*) FILTER (letter <> 'I') OVER (PARTITION BY conv_id ORDER BY k) AS i FROM letters),
kept AS (SELECT d.conv_id, d.k, d.letter, f.role, f.ini, f.text, row_number() OVER (PARTITION BY d.conv_id ORDER BY d.k) AS o FROM dealt d LEFT JOIN faulty f ON d.letter <> 'I' AND f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.i = d.i WHERE d.letter <> 'D'),
led AS (SELECT *, coalesce(bool_or(o = 1 AND letter = 'K' AND ini = 's') OVER (PARTITION BY conv_id), false)::INT AS led FROM kept),
shas AS (SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (o - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY k)) AS sha FROM led GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.w, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN sizes z ON z.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN chosen c ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN shas s ON s.conv_id IS NOT DISTINCT FROM e.conv_id""",
        "op13_max_sketch": r"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
docs AS (SELECT doc_id, len(terms) AS n, terms FROM words WHERE len(terms) > 0),
corpus AS (SELECT count(*) AS total, sum(n)::BIGINT AS length FROM docs),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM docs) GROUP BY ALL),
weighted AS (SELECT term, floor(1000 * ln((2 * total + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, corpus GROUP BY term, total),
scored AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * total) // length))))::BIGINT AS score
           FROM asked JOIN tf USING (term) JOIN weighted USING (term), corpus GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 50""",
    }
