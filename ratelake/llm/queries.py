"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import chunks, conversations, decontaminate, neighbours, packing, quality, secrets, sharding, simhash, suffixes, toxicity, warc, whitening

QUERIES = {
    "op1_secrets": secrets.op1_secrets,
    "op2_simhash": simhash.op2_simhash,
    "op3_packing": packing.op3_packing,
    "op4_substring_dedup": chunks.op4_substring_dedup,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_neighbours": neighbours.op6_neighbours,
    "op7_warc": warc.op7_warc,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_suffix_dedup": suffixes.op9_suffix_dedup,
    "op10_quality": quality.op10_quality,
    "op11_conversations": conversations.op11_conversations,
    "op12_whitening": whitening.op12_whitening,
    "op13_sharding": sharding.op13_sharding,
}

#: CRC-32 in SQL: a table made by its rule, then one look-up for each byte of a blob ``{b}``; ``crc_table`` must be joined.
_CRC_TABLE = """bits AS (SELECT k, list_reduce(list_prepend(k, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(k)),
        crc_table AS (SELECT list(v ORDER BY k) AS tb FROM bits)"""
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length({b})), lambda i: ('0x' || hex({b}[i + 1 : i + 1]))::BIGINT)),
                lambda c, x: xor(tb[(xor(c, x) & 255) + 1], c >> 8)), 4294967295)"""

#: A run of capitalised words, each run of letters between marks 4 and 5.
_NAME_SQL = "\\x04\\p{Lu}\\p{Ll}+\\x05(?: \\x04\\p{Lu}\\p{Ll}+\\x05)*"

ORACLE_SQL: dict[str, str] = {
    "op7_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
                     max(page_id) OVER (PARTITION BY html) AS last FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
        FROM d""",
    "op8_decontaminate": f"""
        WITH plain AS (
            SELECT 0 AS side, doc_id AS id, translate(coalesce(text, ''), '#' || chr(1) || chr(2) || chr(3) || chr(4) || chr(5), '      ') AS p FROM documents
            UNION ALL SELECT 1, min(item_id), translate(coalesce(text, ''), '#' || chr(1) || chr(2) || chr(3) || chr(4) || chr(5), '      ') FROM benchmark GROUP BY text HAVING min(item_id) IS NOT NULL),
        runs AS (SELECT side, id, 0 AS v, regexp_replace(p, '(\\p{{L}}+)', chr(4) || '\\1' || chr(5), 'g') AS p FROM plain
            UNION ALL SELECT side, id, 1, regexp_replace(regexp_replace(p, '[\\s\\x0B\\p{{Z}}]+', ' ', 'g'), '(\\p{{L}}+)', chr(4) || '\\1' || chr(5), 'g') FROM plain),
        named AS (SELECT side, id, v, CASE v WHEN 0 THEN regexp_replace(p, '(\\p{{Ll}}\\x05[,;]? |[0-9] )({_NAME_SQL})', '\\1' || chr(1) || '\\2' || chr(3), 'g')
            ELSE regexp_replace(p, '({_NAME_SQL})', chr(1) || '\\1' || chr(3), 'g') END AS p FROM runs),
        units AS (SELECT side, id, v, lower(regexp_replace(regexp_replace(p, '([0-9]) ?\\x04((?i:{"|".join(decontaminate.UNITS)}))\\x05([^0-9]|$)', '\\1 ' || chr(2) || '\\2' || chr(3) || '\\3', 'g'),
            '(\\x04(?i:{"|".join(decontaminate.NUMBER_WORDS)})\\x05) \\x04((?i:{"|".join(u for u in decontaminate.UNITS if len(u) > 1)}))\\x05([^0-9]|$)', '\\1 ' || chr(2) || '\\2' || chr(3) || '\\3', 'g')) AS m FROM named),
        words AS (SELECT side, id, v,
            regexp_extract_all(translate(m, chr(4) || chr(5), ''), '[\\x01\\x02][^\\x03]*\\x03|[0-9]+(?:[.,:/][0-9]+)*|\\p{{L}}+') AS r,
            regexp_extract_all(translate(regexp_replace(regexp_replace(regexp_replace(regexp_replace(m, '\\x01[^\\x03]*\\x03', '#p', 'g'), '\\x02[^\\x03]*\\x03', '#u', 'g'),
                '[0-9]+(?:[.,:/][0-9]+)*', '#n', 'g'), '\\x04(?:{"|".join(decontaminate.NUMBER_WORDS)})\\x05', '#n', 'g'), chr(4) || chr(5), ''), '#[pun]|\\p{{L}}+') AS t FROM units),
        items AS (SELECT id AS item, t, arg_min(r, v) AS r, min(v) AS version, least(len(t), 5) AS size FROM words WHERE side = 1 AND len(t) > 0 GROUP BY id, t),
        item_windows AS (
            SELECT *, 2 * len(list_filter(w, lambda x: x NOT LIKE '#%')) >= size AS usable
            FROM (SELECT item, version, size, i, t[i : i + size - 1] AS w, r[i : i + size - 1] AS r FROM (SELECT *, unnest(range(1, len(t) - size + 2)) AS i FROM items))),
        wanted AS (SELECT *, CASE WHEN usable THEN [] ELSE r END AS own FROM item_windows JOIN (SELECT item, bool_or(usable) AS has FROM item_windows GROUP BY 1) USING (item) WHERE usable OR (NOT has AND version = 0)),
        total AS (SELECT item, version, count(DISTINCT {{'w': w, 'own': own}}) AS windows FROM wanted GROUP BY 1, 2),
        texts AS (SELECT id AS doc, v AS reading, r, t, size FROM words, (SELECT DISTINCT size FROM items) WHERE side = 0 AND len(t) >= size
            AND (v = 0 OR EXISTS (SELECT 1 FROM items WHERE list_contains(t, '#p')))),
        doc_windows AS (SELECT doc, reading, size, i, t[i : i + size - 1] AS w, r[i : i + size - 1] AS r FROM (SELECT *, unnest(range(1, len(t) - size + 2)) AS i FROM texts)),
        met AS (SELECT DISTINCT doc, item, version, reading, d.i - x.i AS shift, w, own,
                list_filter(list_transform(range(1, size + 1), lambda k: {{'slot': w[k] LIKE '#%', 'a': x.r[k], 'b': d.r[k]}}), lambda s: s.slot) AS slots
            FROM doc_windows d JOIN wanted x USING (size, w) WHERE usable OR d.r = x.r),
        pairs AS (SELECT DISTINCT doc, item, version, reading, shift, s.a AS a, s.b AS b FROM (SELECT *, unnest(slots) AS s FROM met)),
        torn AS (SELECT doc, item, version, reading, shift, coalesce(list(a) FILTER (na > 1), []) AS torn_a, coalesce(list(b) FILTER (nb > 1), []) AS torn_b FROM (
            SELECT *, count(*) OVER (PARTITION BY doc, item, version, reading, shift, a) AS na, count(*) OVER (PARTITION BY doc, item, version, reading, shift, b) AS nb FROM pairs) WHERE na > 1 OR nb > 1 GROUP BY ALL),
        kept AS (SELECT m.* FROM met m LEFT JOIN torn USING (doc, item, version, reading, shift)
            WHERE torn_a IS NULL OR len(list_filter(slots, lambda s: s.a <> s.b AND (list_contains(torn_a, s.a) OR list_contains(torn_b, s.b)))) = 0),
        found AS (SELECT doc, item, version, count(DISTINCT {{'w': w, 'own': own}}) AS matched, max(len(list_distinct(list_filter(slots, lambda s: s.a <> s.b)))) AS changed FROM kept GROUP BY 1, 2, 3),
        best AS (SELECT doc, item, matched, windows, changed FROM found JOIN total USING (item, version) WHERE matched >= 0.8 * windows QUALIFY row_number() OVER (PARTITION BY doc, item ORDER BY version) = 1)
        SELECT doc AS doc_id, item AS item_id, matched, windows, round(matched / windows, 6) AS similarity, CAST(changed AS INTEGER) AS changed_slots,
            CASE WHEN changed > 0 THEN 'reparameterised' ELSE 'exact' END AS kind FROM best""",
    "op9_suffix_dedup": """
        WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
        w AS (SELECT doc_id, s, md5(b[s + 1 : s + 400]) AS h FROM (SELECT *, unnest(range(0, octet_length(b) - 399)) AS s FROM d WHERE octet_length(b) >= 400)),
        r AS (SELECT doc_id, s FROM w QUALIFY count(*) OVER (PARTITION BY h) > 1),
        g AS (SELECT doc_id, s, CASE WHEN s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 400 THEN 1 ELSE 0 END AS new FROM r),
        k AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM g),
        p AS (SELECT doc_id, run, min(s) AS a, max(s) + 400 AS z FROM k GROUP BY 1, 2),
        e AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM p
              UNION ALL SELECT d.doc_id, octet_length(b), octet_length(b), coalesce(max(z), 0) FROM d LEFT JOIN p USING (doc_id) GROUP BY d.doc_id, b),
        c AS (SELECT doc_id, coalesce(string_agg(hex(b[before + 1 : a]), '' ORDER BY a, z), '') AS x FROM e JOIN d USING (doc_id) GROUP BY 1)
        SELECT d.doc_id, octet_length(b) AS n_bytes, CAST(coalesce(sum(z - a), 0) AS BIGINT) AS n_removed, count(a) AS n_spans, any_value(sha256(unhex(x))) AS kept_sha256
        FROM d LEFT JOIN p USING (doc_id) JOIN c USING (doc_id) GROUP BY d.doc_id, b""",
    "op11_conversations": f"""
        WITH RECURSIVE {_CRC_TABLE},
        c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')) AS k FROM conversations),
        n AS (SELECT conv_id, turn, role, text, {_CRC.format(b="k")} % 20 AS hit FROM c, crc_table),
        d AS (SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
                     CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                     unnest(CASE hit WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM n),
        s AS (SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
                     row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i FROM d),
        f AS (SELECT *, left(role, 1) AS o, CASE WHEN bare = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
                     WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault,
                     left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair FROM s),
        counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
                          count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
                          count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
        arcs(g, o, h) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
        fill(g, h, price, letters, lines) AS (
            SELECT g, g, 0, '', []::VARCHAR[] FROM range(4) r(g) UNION ALL
            VALUES (0, 2, 3, 'I', ['user:']), (0, 3, 6, 'II', ['user:', 'assistant:']), (1, 2, 3, 'I', ['user:']), (1, 3, 6, 'II', ['user:', 'assistant:']),
                   (2, 3, 3, 'I', ['assistant:']), (3, 2, 3, 'I', ['user:'])),
        step AS (
            SELECT f.conv_id, f.i, a.g, a.h, 'K' AS letter, CASE WHEN fault = 't' THEN 3 ELSE 0 END AS price, [role || ':' || text] AS lines FROM f JOIN arcs a USING (o) WHERE fault IN ('-', 't')
            UNION ALL SELECT f.conv_id, f.i, a.g, a.h, 'R', CASE WHEN fault = 't' THEN 6 ELSE 3 END, [CASE a.o WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text]
                      FROM f JOIN arcs a ON a.o <> 's' WHERE fault IN ('-', 't')
            UNION ALL SELECT f.conv_id, f.i, r.g, r.g, 'D', 4, []::VARCHAR[] FROM f, range(4) r(g)),
        arc AS (SELECT s.conv_id, s.i, p.g, s.h, p.price + s.price AS price, p.letters || s.letter AS letters, list_concat(p.lines, s.lines) AS lines FROM step s JOIN fill p ON p.h = s.g),
        walk(conv_id, i, g, w, lines) AS (
            SELECT conv_id, 0::BIGINT, 0::BIGINT, {{'cost': 0::BIGINT, 'audit': ''}}, []::VARCHAR[] FROM (SELECT DISTINCT conv_id FROM conversations)
            UNION ALL
            SELECT conv_id, i, g, w, lines FROM (
                SELECT a.conv_id, a.i, a.h::BIGINT AS g, {{'cost': (w.cost + a.price)::BIGINT, 'audit': w.audit || a.letters}} AS w, list_concat(v.lines, a.lines) AS lines
                FROM walk v JOIN arc a ON a.conv_id IS NOT DISTINCT FROM v.conv_id AND a.i = v.i + 1 AND a.g = v.g)
            QUALIFY row_number() OVER (PARTITION BY conv_id, g ORDER BY w.cost, w.audit) = 1),
        ends AS (SELECT v.conv_id, w.cost + p.price AS cost, w.audit || p.letters AS audit, list_concat(v.lines, p.lines) AS lines
                 FROM walk v LEFT JOIN counts k ON k.conv_id IS NOT DISTINCT FROM v.conv_id JOIN fill p ON p.g = v.g WHERE v.i = coalesce(k.n, 0) AND p.h IN (0, 3)
                 QUALIFY row_number() OVER (PARTITION BY v.conv_id ORDER BY w.cost + p.price, w.audit || p.letters) = 1)
        SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
               coalesce(illegal, 0) AS illegal, cost, audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
        FROM ends e LEFT JOIN counts k ON k.conv_id IS NOT DISTINCT FROM e.conv_id""",
    "op13_sharding": f"""
        WITH {_CRC_TABLE},
        d AS (SELECT doc_id, source, coalesce(text, '') AS t, encode(coalesce(text, '')) AS b FROM documents),
        r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('{sharding.SEED}:' || t), md5('{sharding.SEED}:' || coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST) AS k,
                     count(*) OVER (PARTITION BY source) AS of FROM d),
        p AS (SELECT *, row_number() OVER (ORDER BY ((k - 1)::DOUBLE + 0.5::DOUBLE) / of::DOUBLE, source NULLS FIRST, k) - 1 AS place, count(*) OVER () AS n FROM r)
        SELECT doc_id, octet_length(b)::BIGINT + 1 AS size, {_CRC.format(b="b")} AS text_crc32, 'rows' AS law,
               (place * {sharding.SHARDS} // n)::INTEGER AS shard, (place - ((place * {sharding.SHARDS} // n) * n + {sharding.SHARDS - 1}) // {sharding.SHARDS})::BIGINT AS slot,
               CAST(NULL AS INTEGER) AS grown_shard FROM p, crc_table""",
}
