"""The training-data queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontam, katz, langid, packing, pii, recount, sharding, simhash, topk, warc

QUERIES = {
    "op1_benchmark_leaks": decontam.op1_benchmark_leaks,
    "op2_katz_scores": katz.op2_katz_scores,
    "op3_edit_recount": recount.op3_edit_recount,
    "op4_jump_shards": sharding.op4_jump_shards,
    "op5_simhash_components": simhash.op5_simhash_components,
    "op6_language_profiles": langid.op6_language_profiles,
    "op7_warc_round_trip": warc.op7_warc_round_trip,
    "op8_pattern_packing": packing.op8_pattern_packing,
    "op9_topk": topk.op9_topk,
    "op10_personal_data": pii.op10_personal_data,
}

ORACLES = {
    "op4_jump_shards": """
        WITH RECURSIVE crc AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(range(0, 8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END, i)) AS t),
        d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
        k AS (SELECT row, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::HUGEINT AS key FROM d),
        j(row, n, key, b, j) AS (
          SELECT row, n::BIGINT, key, -1::BIGINT, 0::BIGINT FROM k, (SELECT unnest([16, 17]) AS n)
          UNION ALL
          SELECT row, n, nk, j, floor((j + 1) * (2147483648.0::DOUBLE / ((nk // 8589934592)::DOUBLE + 1)))::BIGINT
          FROM (SELECT row, n, j, (key * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS nk FROM j WHERE j < n)),
        s AS (SELECT row, max(b) FILTER (WHERE n = 16) AS shard, max(b) FILTER (WHERE n = 17) AS grown FROM j GROUP BY 1)
        SELECT doc_id, strlen(text)::BIGINT + 1 AS size,
          xor(list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT), lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32,
          'key' AS law, shard::INT AS shard, (row_number() OVER (PARTITION BY shard ORDER BY key % 512, doc_id) - 1)::BIGINT AS slot, grown::INT AS grown_shard
        FROM d JOIN k USING (row) JOIN s USING (row), crc
    """,
    "op7_warc_round_trip": """
        WITH d AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        s AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS s, min(page_id) OVER (PARTITION BY h) AS first FROM d)
        SELECT page_id, payload_bytes,
          list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            (((('0x' || substr(s, ((i // 4) * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), 'string_agg', '') AS payload_digest,
          CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM s
    """,
    "op9_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
        ), s AS (
            SELECT a.vec_id AS query_id, b.vec_id,
                   list_sum(list_transform(range(1, 65), lambda i: a.q[i] * b.q[i]))::BIGINT AS score
            FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
        )
        SELECT query_id, (row_number() OVER w)::INT AS rank, vec_id, score FROM s
        WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
        QUALIFY row_number() OVER w <= 5
    """,
}
