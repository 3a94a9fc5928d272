"""The queries of parts in SQL: what each must return, stated for itself."""

from __future__ import annotations

SIZE = "(CASE WHEN {0} < 128 THEN 1 WHEN {0} < 16384 THEN 2 WHEN {0} < 2097152 THEN 3 WHEN {0} < 268435456 THEN 4 ELSE 5 END)"


def size(x: str) -> str:
    """Bytes of a number in the variable-byte code."""
    return SIZE.format(f"({x})")


def bodies(source: str) -> str:
    """term, fid, tf, body, r: postings of a source (term, fid, lid, t, e), their size in the code but for the recording number, and place in the list."""
    return f"""SELECT term, fid, tf, body + {size("tf")} AS body, row_number() OVER (PARTITION BY term ORDER BY fid) AS r FROM (
        SELECT term, fid, count(*) AS tf, sum({size("dl")} + {size("dt")} + {size("e")}) AS body FROM (
        SELECT term, fid, e, lid - lag(lid, 1, 0) OVER w AS dl, t - lag(t, 1, 0) OVER w AS dt FROM {source} WINDOW w AS (PARTITION BY term, fid ORDER BY lid)) GROUP BY term, fid)"""


def layout(source: str, chunk_bytes: int = 6553, block_bytes: int = 32768) -> str:
    """A walk through each list, one posting after another. full: the chunk before is complete; fresh: so is its block."""
    return f"""(WITH RECURSIVE walk AS (
        SELECT term, fid, tf, r, CAST(body + {size("fid")} AS BIGINT) AS bytes, 0 AS chunk, 1 AS block, 4 * (2 + 3 * tf) AS raw, CAST(body + {size("fid")} AS BIGINT) AS stored FROM {source} WHERE r = 1
        UNION ALL
        SELECT term, fid, tf, r, bytes, chunk, block, raw, CASE WHEN fresh THEN bytes ELSE stored + bytes END FROM (
            SELECT b.term, b.fid, b.tf, b.r, CAST(b.body + {size("CASE WHEN w.raw >= " + str(chunk_bytes) + " AND w.stored >= " + str(block_bytes) + " THEN b.fid ELSE b.fid - w.fid END")} AS BIGINT) AS bytes,
            CASE WHEN w.raw >= {chunk_bytes} THEN w.chunk + 1 ELSE w.chunk END AS chunk, CASE WHEN w.raw >= {chunk_bytes} AND w.stored >= {block_bytes} THEN w.block + 1 ELSE w.block END AS block,
            CASE WHEN w.raw >= {chunk_bytes} THEN 0 ELSE w.raw END + 4 * (2 + 3 * b.tf) AS raw, w.stored, w.raw >= {chunk_bytes} AND w.stored >= {block_bytes} AS fresh
            FROM walk w JOIN {source} b ON b.term = w.term AND b.r = w.r + 1))
        SELECT term, fid, tf, bytes, CAST(chunk AS INTEGER) AS chunk, CAST(block AS INTEGER) AS block FROM walk)"""


def headers(rows: str) -> str:
    return f"SELECT *, max(block) OVER (PARTITION BY term) AS block_count FROM (SELECT term, block, CAST(sum(bytes) AS BIGINT) AS body_size, max(fid) AS fid_max FROM {rows} GROUP BY term, block)"


def median_round(n: int) -> dict[str, str]:
    """Round n of k-medians: distances from the centroids before, the nearest one of each point, the new centroids."""
    return {
        f"kd{n}": f"SELECT p.point, c.code, sum(CASE WHEN p.bit <> c.bit THEN 1 ELSE 0 END) AS d FROM bitrows p JOIN kc{n - 1} c USING (i) GROUP BY p.point, c.code",
        f"ka{n}": f"SELECT point, code, d FROM (SELECT *, row_number() OVER (PARTITION BY point ORDER BY d, code) AS r FROM kd{n}) WHERE r = 1",
        f"km{n}": f"SELECT a.code, p.i, CASE WHEN 2 * sum(p.bit) > count(*) THEN 1 ELSE 0 END AS bit FROM ka{n} a JOIN bitrows p USING (point) GROUP BY a.code, p.i",
        f"kc{n}": f"SELECT c.code, c.i, coalesce(m.bit, c.bit) AS bit FROM kc{n - 1} c LEFT JOIN km{n} m USING (code, i)",
    }


def bits_of(hex_: str, word: str) -> str:
    """64-bit word number `word` of a hex string, the last one filled up with zeros."""
    return f"CAST('0x' || rpad(substr({hex_}, {word} * 16 + 1, 16), 16, '0') AS UBIGINT)"


def drawn(m: str, *key: object) -> str:
    """A number below m by the hash of a key."""
    text = " || ':' || ".join(str(k) if isinstance(k, str) else f"'{k}'" for k in key)
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) % {m}"


CTES: dict[str, str] = {
    "smp": """SELECT CAST(l_suppkey + 1 AS INTEGER) AS fid, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, x) - 1 AS i, x
        FROM (SELECT *, ((l_partkey * 7919 + l_orderkey * 31 + l_linenumber) % 65536 - 32768) / 32768.0::DOUBLE AS x FROM lineitem)""",
    "lens": "SELECT fid, count(*) AS n FROM smp GROUP BY fid",
    "norm": "SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 1000) / 1024) AS a FROM embeddings",
    "frames": "SELECT vec_id, unnest(embedding) * (0.54::DOUBLE - 0.46::DOUBLE * cos(2 * pi() * unnest(range(0, 64)) / 63)) AS x, unnest(range(0, 64)) AS n FROM embeddings",
    "dft": """SELECT vec_id, k, pow(sum(x * cos(2 * pi() * k * n / 2048)), 2) + pow(sum(x * sin(2 * pi() * k * n / 2048)), 2) AS energy
        FROM frames JOIN (SELECT CAST(64 * k AS INTEGER) AS k FROM range(0, 17) a(k)) ON true GROUP BY vec_id, k""",
    "cells": "SELECT r_regionkey AS r, t, f, (t * t * 31 + f * f * 17 + t * f * 7 + r_regionkey * 13) % 1009 + 1 AS x FROM region, range(0, 40) a(t), range(0, 640) b(f)",
    "box9": "SELECT r, t + dt AS t, f + df AS f, sum(x) AS s FROM cells, range(-1, 2) a(dt), range(-1, 2) b(df) GROUP BY 1, 2, 3",
    "near9": "SELECT c.r, c.t, c.f, c.x, b.s FROM cells c JOIN box9 b ON b.r = c.r AND b.t = c.t AND b.f = c.f",
    "spk": "SELECT r, t, f, s FROM near9 WHERE 7 * x > s AND t BETWEEN 10 AND 29 AND f BETWEEN 36 AND 556",
    "spt": "SELECT r, t, f FROM spk p WHERE NOT EXISTS (SELECT 1 FROM spk q WHERE q.r = p.r AND q.t BETWEEN p.t - 14 AND p.t + 14 AND q.f BETWEEN p.f - 31 AND p.f + 31 AND q.s > p.s)",
    "wen": "SELECT r, t + dt AS t, f + df AS f, CAST(sum(x) AS DOUBLE) AS e FROM cells, range(-1, 2) a(dt), range(-3, 4) b(df) GROUP BY 1, 2, 3",
    "win": "SELECT r, t, f, i, j, t - 9 + i AS wt, f - 15 + 3 * j AS wf FROM spt, range(0, 18) a(i), range(0, 10) b(j)",
    "wn": """SELECT w.r, w.t, w.f, w.i * 10 + w.j AS pos, coalesce(c.e, 0) AS c, coalesce(e1.e, 0) AS e1, coalesce(e2.e, 0) AS e2, coalesce(e3.e, 0) AS e3, coalesce(e4.e, 0) AS e4 FROM win w
        LEFT JOIN wen c ON c.r = w.r AND c.t = w.wt AND c.f = w.wf LEFT JOIN wen e1 ON e1.r = w.r AND e1.t = w.wt + 2 AND e1.f = w.wf LEFT JOIN wen e2 ON e2.r = w.r AND e2.t = w.wt - 2 AND e2.f = w.wf
        LEFT JOIN wen e3 ON e3.r = w.r AND e3.t = w.wt AND e3.f = w.wf + 6 LEFT JOIN wen e4 ON e4.r = w.r AND e4.t = w.wt AND e4.f = w.wf - 6""",
    "wc": """SELECT r, t, f, pos, CASE WHEN greatest(c, e1, e2, e3, e4) > 0 AND (2 * least(c, e1) < greatest(c, e1) OR 2 * least(c, e2) < greatest(c, e2) OR 2 * least(c, e3) < greatest(c, e3) OR 2 * least(c, e4) < greatest(c, e4))
        THEN CASE WHEN 4 * (c - e2) > gap THEN 1 ELSE 0 END + CASE WHEN 4 * (e1 - c) > gap THEN 2 ELSE 0 END + CASE WHEN 4 * (c - e3) > gap THEN 4 ELSE 0 END + CASE WHEN 4 * (e4 - c) > gap THEN 8 ELSE 0 END ELSE 0 END AS code
        FROM (SELECT *, greatest(abs(c - e1), abs(c - e2), abs(c - e3), abs(c - e4)) AS gap FROM wn)""",
    "cp": "SELECT CAST((f - 17) // 9 AS INTEGER) AS term, fid, lid, t, e FROM qlf",
    "cpb": bodies("cp"),
    "stb": bodies("st"),
    "book": "SELECT CAST(label AS INTEGER) AS word, count(*) AS n_points, CAST(sum(vec_id) AS DOUBLE) AS sum_d, substr(repeat(md5(CAST(label AS VARCHAR)), 6), 1, 180) AS h FROM embeddings GROUP BY label",
    "points": "SELECT vec_id, substr(repeat(md5('v' || vec_id), 6), 1, 180) AS h FROM embeddings",
    "whole": f"SELECT p.vec_id, b.word, CAST(sum(bit_count(xor({bits_of('p.h', 'i')}, {bits_of('b.h', 'i')}))) AS INTEGER) AS d FROM points p JOIN book b ON true JOIN range(0, 12) a(i) ON true GROUP BY p.vec_id, b.word",
    "seeded": "SELECT point, row_number() OVER (ORDER BY md5('1:' || point), point) - 1 AS code FROM bits",
    "kc0": "SELECT s.code, b.i, b.bit FROM seeded s JOIN bitrows b USING (point) WHERE s.code < 5",
    **median_round(1),
    **median_round(2),
    "cuts": f"SELECT *, {drawn('(greatest(n - 80, 0) + 1)', 1, 'fid', 'c')} AS start FROM lens, range(0, 3) a(c)",
    "secs": f"SELECT fid, unnest(range(0, 240 + {drawn('181', 1, 1, 'fid')})) AS s FROM range(1, 21) a(fid)",
    "draws": f"SELECT fid, s, unnest(range(0, 15 + {drawn('11', 1, 2, 'fid', 's')})) AS j FROM secs",
    "spots": f"SELECT DISTINCT fid, CAST(s * 73 + {drawn('73', 1, 3, 'fid', 's', 'j')} AS INTEGER) AS t, CAST(18 + {drawn('558', 1, 4, 'fid', 's', 'j')} AS INTEGER) AS f FROM draws",
}

_DECODED = "CASE bits WHEN 8 THEN least(greatest(round_even(x * 128, 0), -128), 127) / 128 ELSE x END"

QUERIES: dict[str, str] = {
    "audio_blocks": "SELECT fid, CAST(i // 128 AS INTEGER) AS block_no, CAST(count(*) AS INTEGER) AS n, round(sum(x), 6) AS total FROM smp GROUP BY fid, i // 128",
    "long_recordings": "SELECT fid, CAST(n AS DOUBLE) AS seconds FROM lens WHERE n >= 600",
    "channel_mix": """SELECT vec_id, round(list_sum(a), 6) AS total, round(list_sum(list_transform(list_zip(a, list_reverse(a)), lambda p: pow((p[1] + p[2]) / 2, 2))) / len(a), 9) AS mixed,
        CAST(least(2 * len(a), 100) AS INTEGER) AS n, least(2 * len(a), 100) / 100.0::DOUBLE AS seconds FROM norm""",
    "hamming_window": "SELECT CAST(i AS INTEGER) AS i, round(0.54::DOUBLE - 0.46::DOUBLE * cos(2 * pi() * i / 1023), 9) AS w FROM range(0, 1024) a(i)",
    "energy_frames": "SELECT vec_id, k, round(energy, 4) AS energy FROM dft",
    "spectrum_kinds": "SELECT vec_id, round(sum(energy), 4) AS energy, round(sum(energy / 1025), 4) AS power, round(sum(sqrt(energy)), 4) AS magnitude FROM dft GROUP BY vec_id",
    "signal_peaks": "SELECT r, CAST(t AS INTEGER) AS t, CAST(f AS INTEGER) AS f, CAST(s AS DOUBLE) AS peak FROM spk",
    "signal_points": "SELECT r, CAST(t AS INTEGER) AS t, CAST(f AS INTEGER) AS f FROM spt",
    "signal_descriptors": """SELECT r, CAST(t AS INTEGER) AS t, CAST(f AS INTEGER) AS f, string_agg(printf('%02x', CAST(byte AS INTEGER)), '' ORDER BY q) AS d
        FROM (SELECT r, t, f, pos // 2 AS q, sum(CASE WHEN pos % 2 = 0 THEN code ELSE 16 * code END) AS byte FROM wc GROUP BY r, t, f, pos // 2) GROUP BY r, t, f""",
    "wav_files": f"""SELECT fid, CAST(bits AS INTEGER) AS bits, CAST(place AS INTEGER) AS place, 11025 AS sample_rate, 1 AS channels, CAST(count(*) FILTER (i >= place AND (place = 0 OR i < place + 50)) AS INTEGER) AS n,
        round(coalesce(sum({_DECODED}) FILTER (i >= place AND (place = 0 OR i < place + 50)), 0.0::DOUBLE), 6) AS total FROM smp, (SELECT unnest([8, 16, 24, 32, 33]) AS bits) a, (SELECT unnest([0, 100]) AS place) b GROUP BY fid, bits, place""",
    "wav_data_source": "SELECT fid, 11025 AS sample_rate, CAST(count(*) AS INTEGER) AS n, round(sum(x), 6) AS total FROM smp GROUP BY fid",
    "numbered_files": "SELECT name, CAST(row_number() OVER (ORDER BY name) AS INTEGER) AS fid FROM (SELECT 'a' || fid % 3 || '/b/' || printf('%06d', fid) || '.wav' AS name FROM lens)",
    "id3_tags": """SELECT *, CASE WHEN coalesce(title, '') = '' THEN CAST(p_partkey AS VARCHAR) ELSE title || CASE WHEN artist <> '' THEN ' by ' || artist ELSE '' END END AS meta FROM (SELECT p_partkey,
        CASE p_partkey % 3 WHEN 0 THEN trim(substr(p_name, 1, 30)) WHEN 1 THEN trim(p_name) END AS title, CASE p_partkey % 3 WHEN 0 THEN trim(substr(p_type, 1, 30)) WHEN 1 THEN trim(p_type) END AS artist,
        CASE p_partkey % 3 WHEN 0 THEN trim(substr(p_brand, 1, 30)) WHEN 1 THEN trim(p_brand) END AS album FROM part)""",
    "clip_cuts": """SELECT CAST(c.fid * 3 + c.c AS INTEGER) AS query_id, c.fid, CAST(c.start AS INTEGER) AS start, CAST(count(*) AS INTEGER) AS n, round(sum(s.x), 6) AS total
        FROM cuts c JOIN smp s ON s.fid = c.fid AND s.i >= c.start AND s.i < c.start + 80 GROUP BY c.fid, c.c, c.start""",
    "vbyte_code": f"""SELECT fid, string_agg(array_to_string(list_transform(range(0, n), lambda b: printf('%02x', CAST(((v >> CAST(7 * b AS INTEGER)) & 127) + CASE WHEN b = n - 1 THEN 128 ELSE 0 END AS INTEGER))), ''), '' ORDER BY lid) AS code
        FROM (SELECT fid, lid, CAST(t AS BIGINT) * 1000 AS v, {size("CAST(t AS BIGINT) * 1000")} AS n FROM qlf) GROUP BY fid""",
    "vbyte_roundtrip": f"SELECT fid, CAST(count(*) AS INTEGER) AS n, CAST(sum({size('t')}) AS INTEGER) AS n_bytes, true AS same FROM qlf GROUP BY fid",
    "synthetic_corpus": f"""SELECT CAST(fid AS INTEGER) AS fid, CAST(row_number() OVER (PARTITION BY fid ORDER BY t, f) - 1 AS INTEGER) AS lid, t, f,
        CAST({drawn('100', 1, 5, 'fid', 't', 'f')} AS INTEGER) AS w, CAST(50 + {drawn('206', 1, 6, 'fid', 't', 'f')} AS INTEGER) AS e FROM spots""",
    "vbyte_table_function": "SELECT fid, lid AS pos, CAST(t AS BIGINT) * 1000 AS value FROM qlf",
    "block_layout": f"SELECT * FROM {layout('cpb')}",
    "block_layout_small": f"SELECT * FROM {layout('cpb', 500, 900)}",
    "block_headers": headers(layout("cpb", 500, 900)),
    "store_facts": """SELECT true AS empty_before, false AS empty, (SELECT count(DISTINCT fid) FROM qlf) AS recordings, (SELECT count(*) FROM bt) AS postings,
        (SELECT count(*) FROM bp) - (SELECT count(*) FROM bt) AS duplicates, 'XSCALE' AS kind, true AS cleared""",
    "store_lists": "SELECT 'list' AS what, fid, lid, t, e FROM st WHERE term = 3210 UNION ALL SELECT 'range', fid, lid, t, e FROM qlf WHERE fid = 7 AND lid BETWEEN 50 AND 80",
    "store_headers": headers(layout("stb")),
    "store_metadata": "SELECT CAST(s_suppkey + 1 AS INTEGER) AS fid, CASE WHEN (s_suppkey + 1) % 2 = 0 THEN s_name ELSE '' END AS meta FROM supplier",
    "store_reindex": "SELECT term, count(*) AS tf, count(DISTINCT fid) AS df FROM bt GROUP BY term",
    "codebook_records": "SELECT word, sum_d, n_points, h AS centroid FROM book",
    "quantize_whole": """SELECT vec_id, w, least(e, 255) AS e, from_first FROM (SELECT vec_id, word AS w, d AS e, row_number() OVER (PARTITION BY vec_id ORDER BY d, word DESC) AS r,
        first_value(d) OVER (PARTITION BY vec_id ORDER BY word) AS from_first FROM whole) WHERE r = 1""",
    "kmedians_rounds": """SELECT CAST(c.code AS INTEGER) AS code, string_agg(c.bit, '' ORDER BY c.i) AS bits, CAST(coalesce(any_value(s.d), 0) AS DOUBLE) AS sum_d, coalesce(any_value(s.n), 0) AS n_points
        FROM kc2 c LEFT JOIN (SELECT code, sum(d) AS d, count(*) AS n FROM ka2 GROUP BY code) s USING (code) GROUP BY c.code""",
    "seed_distances": "SELECT p.point, CAST(min(d) AS INTEGER) AS d FROM (SELECT b.point, s.code, sum(CASE WHEN b.bit <> c.bit THEN 1 ELSE 0 END) AS d FROM bitrows b JOIN bitrows c USING (i) JOIN seeded s ON s.point = c.point WHERE s.code < 3 GROUP BY b.point, s.code) p GROUP BY p.point",
    "term_limits": "SELECT 'MSCALE' AS kind, (100 << 6) | 62 AS max_term UNION ALL SELECT 'XSCALE', (100 << 19) | (3 << 17) | (100 << 10) | (15 << 6) | 43",
    "conversions": "SELECT p_partkey, CAST(p_size AS VARCHAR) AS text, TRY_CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER) AS number, round(log2(p_size), 9) AS log2 FROM part",
    "stream_sliding": "SELECT user_id, CAST(floor(epoch(ts) / 1800) * 1800 - 1800 * j AS BIGINT) AS start_s, count(*) AS n, round(sum(value), 4) AS total FROM events, range(0, 4) a(j) GROUP BY 1, 2",
}
