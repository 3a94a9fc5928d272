"""The catalogue in SQL, for engines that read the same tables: an independent statement of what each query returns."""

from __future__ import annotations

import re

from tonemark.plans import parts_sql

#: Common table expressions in order of dependence; a query gets those that it and its parts name.
CTES: dict[str, str] = {
    "qlf": """SELECT CAST(l_suppkey + 1 AS INTEGER) AS fid, CAST(lid AS INTEGER) AS lid, CAST(4 * lid + l_linenumber % 3 AS INTEGER) AS t,
        CAST(36 + (l_partkey * 37 + l_orderkey) % 521 AS INTEGER) AS f, CAST((l_partkey * 31 + l_linenumber * 17) % 100 AS INTEGER) AS w, CAST(50 + l_orderkey % 206 AS INTEGER) AS e
        FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS lid FROM lineitem)""",
    "q": """SELECT query_id, CAST(t // 130 AS INTEGER) AS block_no, lid, t, f, w, e FROM (
        SELECT fid AS query_id, lid - 100 AS lid, t - 400 AS t, f, CASE WHEN (lid - 100) % 5 = 0 THEN (w + 1) % 100 ELSE w END AS w, e FROM qlf WHERE fid % 10 = 0 AND lid BETWEEN 100 AND 219
        UNION ALL
        SELECT CAST(1000000 + o_custkey // 400 AS INTEGER), CAST(lid AS INTEGER), CAST(4 * lid + o_orderkey % 3 AS INTEGER), CAST(36 + (o_orderkey * 53 + o_custkey * 7) % 521 AS INTEGER),
        CAST((o_orderkey * 13 + o_custkey * 29) % 100 AS INTEGER), CAST(50 + o_custkey % 206 AS INTEGER)
        FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey // 400 ORDER BY o_orderkey) - 1 AS lid FROM orders WHERE o_custkey % 10 = 0))""",
    "st": "SELECT CAST(w * 64 | ((f - 17) // 9) AS INTEGER) AS term, fid, lid, t, e FROM qlf",
    "bp": """SELECT CAST((a.w << 19) | ((a.f // 186) << 17) | (n.w << 10) | (CAST(trunc(CAST(CAST(n.t AS FLOAT) / CAST(5 AS FLOAT) AS FLOAT) - CAST(CAST(a.t AS FLOAT) / CAST(5 AS FLOAT) AS FLOAT)) AS INTEGER) << 6)
        | (CAST(trunc(CAST(CAST(n.f AS FLOAT) / CAST(9 AS FLOAT) AS FLOAT) - CAST(CAST(a.f AS FLOAT) / CAST(9 AS FLOAT) AS FLOAT)) AS INTEGER) & 63) AS INTEGER) AS term, a.fid, a.lid, a.t, a.e, n.lid AS lid2
        FROM (SELECT *, row_number() OVER (PARTITION BY fid, f // 186 ORDER BY lid) AS r FROM qlf) a
        JOIN (SELECT *, row_number() OVER (PARTITION BY fid, f // 186 ORDER BY lid) AS r FROM qlf) n
        ON a.fid = n.fid AND a.f // 186 = n.f // 186 AND n.r BETWEEN a.r + 1 AND a.r + 10 AND n.t - a.t <= 73""",
    "bt": "SELECT DISTINCT term, fid, lid, t, e FROM bp",
    "b1": "SELECT *, CAST(lid // 20 AS INTEGER) AS batch, max(CASE WHEN lid % 20 = 19 THEN block_no END) OVER (PARTITION BY query_id, lid // 20) AS done_block FROM q",
    "ends": "SELECT query_id, block_no AS done_block, max(m) OVER (PARTITION BY query_id ORDER BY block_no) AS horizon FROM (SELECT query_id, block_no, max(lid) AS m FROM q GROUP BY query_id, block_no)",
    "b": "SELECT b1.query_id, b1.done_block, block_no, lid, t, f, w, e, batch, horizon FROM b1 JOIN ends USING (query_id, done_block)",
    "qt": "SELECT query_id, batch, term, min(lid) AS k, arg_min(e, lid) AS eq FROM (SELECT *, CAST(w * 64 | ((f - 17) // 9) AS INTEGER) AS term FROM b) GROUP BY query_id, batch, term",
    "hits": "SELECT query_id, batch, k, eq, fid, lid, t, e, CAST(t // 365 AS INTEGER) AS bin FROM qt JOIN st USING (term)",
    "firsts": "SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY query_id, batch, fid, bin, k ORDER BY lid) AS r FROM hits) WHERE r = 1",
    "ordered": "SELECT *, CASE WHEN t - lag(t, 1, 0) OVER (PARTITION BY query_id, batch, fid, bin ORDER BY k) >= -2 THEN 1 ELSE 0 END AS ordered FROM firsts",
    "counted": "SELECT *, sum(ordered) OVER w AS torder, row_number() OVER w AS n FROM ordered WINDOW w AS (PARTITION BY query_id, batch, fid, bin ORDER BY k ROWS UNBOUNDED PRECEDING)",
    "scored": "SELECT query_id, batch, fid, bin, k, lid, CAST((1000 * (720 - abs(eq - e))) // 720 + CASE WHEN ordered = 1 THEN (1000 * torder) // n ELSE 0 END AS BIGINT) AS score FROM counted",
    "bins": "SELECT query_id, batch, fid, bin, CAST(sum(score) AS BIGINT) AS score, max(k * 1000000 + lid) AS last FROM scored GROUP BY query_id, batch, fid, bin",
    "best": "SELECT query_id, batch, fid, bin, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, batch, fid ORDER BY score DESC, last) AS r FROM bins) WHERE r = 1",
    "placed": "SELECT *, CAST(dense_rank() OVER (PARTITION BY query_id, batch ORDER BY score DESC) AS INTEGER) AS place, row_number() OVER (PARTITION BY query_id, batch, score ORDER BY fid) AS tie FROM best WHERE score > 2000",
    "top": "SELECT query_id, batch, fid, bin, score, place FROM placed WHERE place <= 20 AND tie <= 11",
    "conf": "SELECT query_id, batch, max(score) AS top1, max(score) FILTER (place = 2) AS top2, 2.0::DOUBLE * max(score) / (max(score) + coalesce(max(score) FILTER (place = 2), 0)) - 1 AS conf FROM top GROUP BY query_id, batch",
    "unclear": "SELECT query_id, batch FROM conf WHERE conf <= 0.5",
    "peaks": """SELECT query_id, batch, fid, bin, score FROM (SELECT *, max(score) OVER (PARTITION BY query_id, batch, fid ORDER BY bin RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS most FROM bins
        WHERE (query_id, batch, fid) IN (SELECT (query_id, batch, fid) FROM top JOIN unclear USING (query_id, batch))) WHERE score = most AND score > 3000""",
    "pairs": "SELECT query_id, batch, fid, bin, k, lid, least(k, 15) AS l, least(15, horizon - k) AS r FROM scored JOIN (SELECT query_id, batch, fid, bin FROM peaks) USING (query_id, batch, fid, bin) JOIN (SELECT query_id, batch, lid AS k, horizon FROM b) USING (query_id, batch, k)",
    "qn": "SELECT c.query_id, c.batch, c.k, x.t AS ct, x.f AS cf, n.lid, n.t, n.f, n.w, n.e FROM (SELECT DISTINCT query_id, batch, k, l, r FROM pairs) c JOIN q x ON x.query_id = c.query_id AND x.lid = c.k JOIN q n ON n.query_id = c.query_id AND n.lid BETWEEN c.k - c.l AND c.k + c.r",
    "qe": """SELECT * FROM (SELECT i.query_id, i.batch, i.k, i.w AS wi, i.e AS ei, j.w AS wj, j.e AS ej,
        ((((2*j.t+5)//10 - (2*i.t+5)//10) & 255) << 24) | ((((2*j.f+9)//18 - (2*i.f+9)//18) & 255) << 16) | ((((2*i.ct+5)//10 - (2*i.t+5)//10) & 255) << 8) | (((2*i.cf+9)//18 - (2*i.f+9)//18) & 255) AS edge,
        row_number() OVER (PARTITION BY i.query_id, i.batch, i.k, edge ORDER BY i.lid DESC, j.lid DESC) AS rn
        FROM (SELECT query_id, batch, k, CAST(ct AS BIGINT) AS ct, CAST(cf AS BIGINT) AS cf, lid, CAST(t AS BIGINT) AS t, CAST(f AS BIGINT) AS f, w, e FROM qn) i JOIN (SELECT query_id, batch, k, lid, CAST(t AS BIGINT) AS t, CAST(f AS BIGINT) AS f, w, e FROM qn) j ON i.query_id = j.query_id AND i.batch = j.batch AND i.k = j.k AND i.lid < j.lid) WHERE rn = 1""",
    "rn": "SELECT c.fid, c.lid AS c, c.l, c.r, x.t AS ct, x.f AS cf, n.lid, n.t, n.f, n.w, n.e FROM (SELECT DISTINCT fid, lid, l, r FROM pairs) c JOIN qlf x ON x.fid = c.fid AND x.lid = c.lid JOIN qlf n ON n.fid = c.fid AND n.lid BETWEEN c.lid - c.l AND c.lid + c.r",
    "re": """SELECT * FROM (SELECT i.fid, i.c, i.l, i.r, i.w AS wi, i.e AS ei, i.t AS ti, j.w AS wj, j.e AS ej, j.t AS tj,
        ((((2*j.t+5)//10 - (2*i.t+5)//10) & 255) << 24) | ((((2*j.f+9)//18 - (2*i.f+9)//18) & 255) << 16) | ((((2*i.ct+5)//10 - (2*i.t+5)//10) & 255) << 8) | (((2*i.cf+9)//18 - (2*i.f+9)//18) & 255) AS edge,
        row_number() OVER (PARTITION BY i.fid, i.c, i.l, i.r, edge ORDER BY i.lid DESC, j.lid DESC) AS rn
        FROM (SELECT fid, c, l, r, CAST(ct AS BIGINT) AS ct, CAST(cf AS BIGINT) AS cf, lid, CAST(t AS BIGINT) AS t, CAST(f AS BIGINT) AS f, w, e FROM rn) i JOIN (SELECT fid, c, l, r, lid, CAST(t AS BIGINT) AS t, CAST(f AS BIGINT) AS f, w, e FROM rn) j ON i.fid = j.fid AND i.c = j.c AND i.l = j.l AND i.r = j.r AND i.lid < j.lid) WHERE rn = 1""",
    "common": """SELECT p.query_id, p.batch, p.fid, p.bin, p.k, p.lid, qe.edge,
        CAST(1000 + CASE WHEN qe.wi = re.wi THEN (1000 * (720 - abs(qe.ei - re.ei))) // 720 ELSE 0 END + CASE WHEN qe.wj = re.wj THEN (1000 * (720 - abs(qe.ej - re.ej))) // 720 ELSE 0 END AS BIGINT) AS score,
        CAST(re.ti // 365 AS INTEGER) AS bin1, CAST(re.tj // 365 AS INTEGER) AS bin2
        FROM pairs p JOIN qe ON qe.query_id = p.query_id AND qe.batch = p.batch AND qe.k = p.k JOIN re ON re.fid = p.fid AND re.c = p.lid AND re.l = p.l AND re.r = p.r AND re.edge = qe.edge""",
    "gs": "SELECT query_id, batch, fid, peak, bin, CAST(sum(half) AS BIGINT) AS score FROM (SELECT query_id, batch, fid, bin AS peak, score // 2 AS half, unnest([bin1, bin2]) AS bin FROM common) GROUP BY query_id, batch, fid, peak, bin",
    "gb": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, batch, fid, peak ORDER BY score DESC, bin) AS rn FROM gs) WHERE rn = 1",
    "again": "SELECT query_id, batch, fid, CAST(sum(score) AS BIGINT) AS score, first(bin ORDER BY score DESC, peak, bin) AS bin FROM gb GROUP BY query_id, batch, fid",
    "parts": "SELECT query_id, batch, fid, score, bin FROM top WHERE (query_id, batch) NOT IN (SELECT (query_id, batch) FROM unclear) UNION ALL SELECT query_id, batch, fid, score, bin FROM again",
    "acc": "SELECT g.query_id, g.batch, p.fid, CAST(sum(p.score) AS BIGINT) AS ac, arg_max(p.bin, p.batch) AS bin FROM (SELECT DISTINCT query_id, batch FROM b) g JOIN parts p ON p.query_id = g.query_id AND p.batch <= g.batch GROUP BY g.query_id, g.batch, p.fid",
    "final": "SELECT * FROM (SELECT *, CAST(dense_rank() OVER (PARTITION BY query_id, batch ORDER BY ac DESC) AS INTEGER) AS place FROM acc) WHERE place <= 20",
    "steps": """SELECT s.query_id, s.block_no, d.batch, (s.block_no + 1) * 1.804088::DOUBLE AS id_time FROM (SELECT query_id, CAST(unnest(range(0, n + 1)) AS INTEGER) AS block_no FROM (SELECT query_id, max(block_no) AS n FROM q GROUP BY query_id)) s
        LEFT JOIN (SELECT query_id, done_block AS block_no, max(batch) AS batch FROM b GROUP BY query_id, done_block) d USING (query_id, block_no)""",
    "tops": "SELECT *, max(ac) OVER (PARTITION BY query_id, batch) AS top1, max(CASE WHEN place = 2 THEN ac END) OVER (PARTITION BY query_id, batch) AS top2 FROM final",
    "stepbest": "SELECT query_id, block_no, id_time, fid, ac, bin, top1::DOUBLE / (top1 + coalesce(top2, 0)) AS conf FROM steps JOIN tops USING (query_id, batch) WHERE place = 1",
    "running": "SELECT *, avg(conf) OVER w AS mean_conf, count(*) OVER w * 1.804088::DOUBLE AS acc_time FROM stepbest WINDOW w AS (PARTITION BY query_id, fid ORDER BY block_no ROWS UNBOUNDED PRECEDING)",
    "fuzzyin": """SELECT query_id, block_no, id_time, fid, ac, bin, mean_conf, mean_conf AS c, CASE WHEN id_time < 20 THEN acc_time ELSE id_time END AS d FROM running
        UNION ALL SELECT query_id, block_no, id_time, NULL, NULL, NULL, NULL, 0.0::DOUBLE, id_time FROM steps WHERE (query_id, block_no) NOT IN (SELECT (query_id, block_no) FROM stepbest)""",
}


def fuzzy(mode: str, source: str) -> str:
    """SELECT that adds class to source, which has c (confidence) and d (time)."""
    low, med, high, short, mid, long_ = {
        "EASY": ((0.55, 0.65), (0.60, 0.70, 0.80), (0.75, 0.90), (1.5, 3.0), (2.0, 10.0, 22.0), (17.5, 20.0)),
        "STRICT": ((0.55, 0.65), (0.60, 0.70, 0.92), (0.875, 0.95), (2.0, 5.0), (2.8, 12.0, 19.2), (15.0, 20.0)),
    }[mode]
    d = lambda x: f"{x}::DOUBLE"
    fall = lambda x, p: f"(CASE WHEN {x} <= {d(p[0])} THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, ({d(p[1])} - {x}) / ({d(p[1])} - {d(p[0])})) END)"
    rise = lambda x, p: f"(CASE WHEN {x} >= {d(p[1])} THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, ({x} - {d(p[0])}) / ({d(p[1])} - {d(p[0])})) END)"
    hill = lambda x, p: f"(CASE WHEN {x} <= {d(p[1])} THEN greatest(0.0::DOUBLE, ({x} - {d(p[0])}) / ({d(p[1])} - {d(p[0])})) ELSE greatest(0.0::DOUBLE, ({d(p[2])} - {x}) / ({d(p[2])} - {d(p[1])})) END)"
    sets = f"{fall('c', low)} AS lo, {hill('c', med)} AS me, {rise('c', high)} AS hi, {fall('d', short)} AS sh, {hill('d', mid)} AS mi, {rise('d', long_)} AS lg"
    degrees = "least(lo, lg) AS u0, least(me, lg) AS u1, greatest(least(hi, mi), least(hi, lg)) AS u2, greatest(least(hi, sh), least(me, sh), least(me, mi), least(lo, sh), least(lo, mi)) AS u3"
    return f"""SELECT *, CASE WHEN u0 >= greatest(u1, u2, u3) THEN 'UNIDENTIFIED' WHEN u1 >= greatest(u2, u3) THEN 'SOUNDS_LIKE' WHEN u2 >= u3 THEN 'IDENTIFIED' ELSE 'LISTENING' END AS class
        FROM (SELECT *, {degrees} FROM (SELECT *, {sets} FROM {source}))"""


CTES["classed"] = fuzzy("EASY", "fuzzyin")
CTES["decided"] = "SELECT * FROM (SELECT *, min(block_no) OVER (PARTITION BY query_id) AS first_block FROM classed WHERE class <> 'LISTENING') WHERE block_no = first_block"
CTES["bincand"] = "SELECT query_id, block_no, id_time, fid, ac, bin, conf AS mean_conf, 'IDENTIFIED' AS class FROM stepbest WHERE conf >= 0.7"
CTES["binall"] = """SELECT * FROM bincand UNION ALL SELECT query_id, block_no, id_time, NULL, NULL, NULL, NULL, 'UNIDENTIFIED' FROM steps
    WHERE batch IS NOT NULL AND id_time >= 20 AND (query_id, block_no) NOT IN (SELECT (query_id, block_no) FROM bincand)"""
CTES["bindecided"] = "SELECT * FROM (SELECT *, min(block_no) OVER (PARTITION BY query_id) AS first_block FROM binall) WHERE block_no = first_block"


def results(source: str) -> str:
    return f"""SELECT i.query_id, CASE WHEN m.fid IS NOT NULL THEN 'MATCH' WHEN g.t IS NOT NULL THEN 'NO_MATCH' ELSE 'PENDING' END AS status, m.fid, m.confidence, m.score, m.id_class, m.cue_point, coalesce(m.id_time, round(g.t, 6)) AS id_time
        FROM (SELECT DISTINCT query_id FROM q) i
        LEFT JOIN (SELECT query_id, fid, round(mean_conf, 6) AS confidence, round(ac / 1000, 3) AS score, class AS id_class, CAST(trunc((365 * bin + 182) * 0.0138776::DOUBLE) AS INTEGER) AS cue_point, round(id_time, 6) AS id_time FROM {source} WHERE class IN ('IDENTIFIED', 'SOUNDS_LIKE')) m USING (query_id)
        LEFT JOIN (SELECT query_id, max(id_time) AS t FROM {source} GROUP BY query_id) g USING (query_id)"""


CTES["result"] = results("decided")

#: The incomplete last batch of queries that would end without a match: the same steps from terms to parts, under other names.
_AGAIN = ("b", "qt", "hits", "firsts", "ordered", "counted", "scored", "bins", "best", "placed", "top", "conf", "unclear", "peaks", "pairs", "qn", "qe", "rn", "re", "common", "gs", "gb", "again", "parts")


def renamed(text: str, tables: tuple[str, ...], end: str) -> str:
    return re.sub(r"\b(qe|re)\.(?=[a-z])", rf"\1{end}.", re.sub(rf"\b(FROM|JOIN) ({'|'.join(tables)})\b", rf"\1 \2{end}", text))


CTES["lost"] = "SELECT query_id, max(block_no) AS block_no, max(id_time) AS id_time FROM decided GROUP BY query_id HAVING bool_and(class = 'UNIDENTIFIED')"
CTES["got"] = "SELECT q.*, l.block_no AS done_block, max(q.lid) OVER (PARTITION BY q.query_id) AS horizon FROM q JOIN lost l ON l.query_id = q.query_id AND q.block_no <= l.block_no"
CTES["b_f"] = "SELECT * FROM (SELECT *, CAST(lid // 20 AS INTEGER) AS batch, count(*) OVER (PARTITION BY query_id) AS n FROM got WHERE lid // 20 = (horizon + 1) // 20) WHERE n >= 2"
CTES.update({f"{name}_f": renamed(CTES[name], _AGAIN, "_f") for name in _AGAIN[1:]})
CTES["both_f"] = """SELECT query_id, batch, fid, score, bin FROM parts_f UNION ALL SELECT p.query_id, p.batch, p.fid, p.score, p.bin FROM parts p
    JOIN (SELECT DISTINCT query_id, batch, done_block FROM b) d ON d.query_id = p.query_id AND d.batch = p.batch JOIN lost l ON l.query_id = p.query_id AND d.done_block <= l.block_no"""
CTES["tops_f"] = """SELECT *, max(ac) OVER w AS top1, max(CASE WHEN place = 2 THEN ac END) OVER w AS top2 FROM (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY ac DESC) AS place
    FROM (SELECT g.query_id, p.fid, CAST(sum(p.score) AS BIGINT) AS ac, arg_max(p.bin, p.batch) AS bin FROM (SELECT DISTINCT query_id, batch FROM b_f) g JOIN both_f p ON p.query_id = g.query_id AND p.batch <= g.batch GROUP BY g.query_id, p.fid)) WINDOW w AS (PARTITION BY query_id)"""
CTES["spans_f"] = "SELECT e.query_id, (e.t1 - coalesce(q.t, 0)) * 0.0138776::DOUBLE AS span FROM (SELECT query_id, max(t) AS t1, min(lid) AS lid FROM b_f GROUP BY query_id) e LEFT JOIN q ON q.query_id = e.query_id AND q.lid = e.lid - 1"
CTES["rows_f"] = """SELECT query_id, block_no, id_time, fid, ac, bin, mean_conf, mean_conf AS c, CASE WHEN id_time < 20 THEN acc_time ELSE id_time END AS d FROM (
    SELECT t.query_id, l.block_no, l.id_time, t.fid, t.ac, t.bin, (coalesce(e.c, 0) + t.top1::DOUBLE / (t.top1 + coalesce(t.top2, 0))) / (coalesce(e.n, 0) + 1) AS mean_conf, coalesce(e.n, 0) * 1.804088::DOUBLE + s.span AS acc_time
    FROM tops_f t JOIN lost l ON l.query_id = t.query_id JOIN spans_f s ON s.query_id = t.query_id
    LEFT JOIN (SELECT x.query_id, x.fid, sum(x.conf) AS c, count(*) AS n FROM stepbest x JOIN lost y ON y.query_id = x.query_id AND x.block_no <= y.block_no GROUP BY x.query_id, x.fid) e ON e.query_id = t.query_id AND e.fid = t.fid WHERE t.place = 1)"""
CTES["won_f"] = "SELECT * FROM (" + fuzzy("EASY", "rows_f") + ") WHERE class IN ('IDENTIFIED', 'SOUNDS_LIKE')"
CTES["decided_f"] = """SELECT query_id, block_no, id_time, fid, ac, bin, mean_conf, class FROM decided WHERE query_id NOT IN (SELECT query_id FROM won_f)
    UNION ALL SELECT query_id, block_no, id_time, fid, ac, bin, mean_conf, class FROM won_f"""
#: Search by pairs: terms of pairs of a query, their hits, and each bin as a walk over its hits in order.
_STEP = "CAST(trunc(CAST(CAST(n.{0} AS FLOAT) / CAST({1} AS FLOAT) AS FLOAT) - CAST(CAST(a.{0} AS FLOAT) / CAST({1} AS FLOAT) AS FLOAT)) AS INTEGER)"
_BANDED = "(SELECT *, row_number() OVER (PARTITION BY query_id, f // 186 ORDER BY lid) AS r FROM q)"
CTES["xp"] = f"""SELECT CAST((a.w << 19) | ((a.f // 186) << 17) | (n.w << 10) | ({_STEP.format("t", 5)} << 6) | ({_STEP.format("f", 9)} & 63) AS INTEGER) AS term, a.query_id, a.lid AS k, n.lid AS j, a.e AS eq
    FROM {_BANDED} a JOIN {_BANDED} n ON a.query_id = n.query_id AND a.f // 186 = n.f // 186 AND n.r BETWEEN a.r + 1 AND a.r + 10 AND n.t - a.t <= 73"""
CTES["xt"] = "SELECT * FROM (SELECT p.*, b.batch, row_number() OVER (PARTITION BY p.query_id, b.batch, p.term ORDER BY p.k, p.j) AS r FROM xp p JOIN b ON b.query_id = p.query_id AND b.lid = p.k WHERE p.j <= b.horizon) WHERE r = 1"
CTES["xh"] = """SELECT *, row_number() OVER (PARTITION BY query_id, batch, fid, bin ORDER BY k, j, lid, t, e, eq) AS r FROM (SELECT x.query_id, x.batch, x.k, x.j, x.eq, s.fid, s.lid, s.t, s.e, CAST(s.t // 365 AS INTEGER) AS bin
    FROM xt x JOIN bt s ON s.term = x.term)"""
_SIMILAR = "(1000 * (720 - abs(h.eq - h.e))) // 720"
CTES["xw"] = f"""SELECT * FROM (WITH RECURSIVE walk AS (
    SELECT query_id, batch, fid, bin, r, map([lid], [k]) AS owner, CAST({_SIMILAR} + CASE WHEN t >= -2 THEN 1000 ELSE 0 END AS BIGINT) AS score, CAST(t >= -2 AS INTEGER) AS ordered, t, k, j, lid FROM xh h WHERE r = 1
    UNION ALL
    SELECT query_id, batch, fid, bin, r, CASE WHEN takes AND mine IS NULL THEN map_concat(owner, map([hl], [hk])) ELSE owner END, CASE WHEN takes THEN score + sim + CASE WHEN fit = 1 THEN (1000 * (ordered + 1)) // (cardinality(owner) + CAST(mine IS NULL AS INTEGER)) ELSE 0 END ELSE score END,
    CASE WHEN takes THEN ordered + fit ELSE ordered END, CASE WHEN takes THEN ht ELSE t END, CASE WHEN takes THEN hk ELSE k END, CASE WHEN takes THEN hj ELSE j END, CASE WHEN takes THEN hl ELSE lid END
    FROM (SELECT w.query_id, w.batch, w.fid, w.bin, h.r, w.owner, w.score, w.ordered, w.t, w.k, w.j, w.lid, h.t AS ht, h.k AS hk, h.j AS hj, h.lid AS hl, {_SIMILAR} AS sim, CAST(h.t - w.t >= -2 AS INTEGER) AS fit, element_at(w.owner, h.lid)[1] AS mine,
        NOT (w.k = h.k AND w.j = h.j) AND coalesce(element_at(w.owner, h.lid)[1] = h.k, true) AS takes
        FROM walk w JOIN xh h ON h.query_id = w.query_id AND h.batch = w.batch AND h.fid = w.fid AND h.bin = w.bin AND h.r = w.r + 1))
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, batch, fid, bin ORDER BY r DESC) AS z FROM walk)) WHERE z = 1"""
CTES["bins_x"] = "SELECT query_id, batch, fid, bin, score FROM xw"
CTES["scored_x"] = "SELECT query_id, batch, fid, bin, unnest(map_values(owner)) AS k, unnest(map_keys(owner)) AS lid FROM xw"
CTES["best_x"] = "SELECT query_id, batch, fid, bin, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, batch, fid ORDER BY score DESC, k, j, lid) AS y FROM xw) WHERE y = 1"
_PAIRED = ("bins", "scored", "best", "placed", "top", "conf", "unclear", "peaks", "pairs", "qn", "qe", "rn", "re", "common", "gs", "gb", "again", "parts", "acc", "final", "tops", "stepbest", "running", "fuzzyin", "classed", "decided")
CTES.update({f"{name}_x": renamed(CTES[name], _PAIRED, "_x").replace("tie <= 11", "tie <= 10") for name in _PAIRED[3:]})
CTES["truth"] = "SELECT DISTINCT query_id, CASE WHEN query_id < 1000000 THEN query_id END AS fid FROM q"
CTES["bits"] = "SELECT vec_id AS point, label, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits FROM embeddings"
CTES["bitrows"] = "SELECT point, label, unnest(bits) AS bit, unnest(range(0, len(bits))) AS i FROM bits"
CTES["majority"] = "SELECT label, i, CASE WHEN 2 * sum(bit) > count(*) THEN 1 ELSE 0 END AS bit FROM bitrows GROUP BY label, i"
CTES["distances"] = "SELECT p.point, m.label AS code, CAST(sum(CASE WHEN p.bit <> m.bit THEN 1 ELSE 0 END) AS INTEGER) AS dist FROM bitrows p JOIN majority m USING (i) GROUP BY p.point, m.label"
CTES["outcomes"] = """SELECT t.query_id, CASE WHEN max(CASE WHEN r.fid = t.fid THEN 1 ELSE 0 END) = 1 THEN 'TP' WHEN count(r.fid) > 0 THEN 'FP' WHEN t.fid IS NULL THEN 'TN' ELSE 'FN' END AS outcome
    FROM truth t LEFT JOIN result r ON r.query_id = t.query_id AND r.fid IS NOT NULL GROUP BY t.query_id, t.fid"""
CTES["delta"] = "SELECT fid, lid, t, lid - lag(lid, 1, 0) OVER w AS dlid, t - lag(t, 1, 0) OVER w AS dt FROM qlf WINDOW w AS (PARTITION BY fid ORDER BY lid)"
CTES["audio"] = "SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a, list_transform(list_reverse(embedding), lambda x: CAST(x AS DOUBLE)) AS z FROM embeddings"

CTES.update(parts_sql.CTES)

#: The queries of fuzzy_identify_all in place of the query set.
ALL_QUERIES = """SELECT query_id, CAST(t // 130 AS INTEGER) AS block_no, lid, t, f, w, e FROM (
    SELECT fid AS query_id, lid - start AS lid, t - 4 * start AS t, f, CASE WHEN (lid - start) % 5 = 0 THEN (w + 1) % 100 ELSE w END AS w, e
    FROM (SELECT *, CAST(greatest(0, least(100, max(lid) OVER (PARTITION BY fid) + 1 - 120)) AS INTEGER) AS start FROM qlf) WHERE lid BETWEEN start AND start + 119
    UNION ALL
    SELECT CAST(1000000 + o_custkey // 40 AS INTEGER), CAST(lid AS INTEGER), CAST(4 * lid + o_orderkey % 3 AS INTEGER), CAST(36 + (o_orderkey * 53 + o_custkey * 7) % 521 AS INTEGER),
    CAST((o_orderkey * 13 + o_custkey * 29) % 100 AS INTEGER), CAST(50 + o_custkey % 206 AS INTEGER)
    FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey // 40 ORDER BY o_orderkey) - 1 AS lid FROM orders))"""

QUERIES: dict[str, str] = {
    **parts_sql.QUERIES,
    "qlf_corpus": "SELECT * FROM qlf",
    "query_fingerprints": "SELECT * FROM q",
    "terms_single": "SELECT * FROM st",
    "term_channel_hist": "SELECT CAST((f - 17) // 9 AS INTEGER) AS channel, count(*) AS n, count(DISTINCT fid) AS recordings FROM qlf GROUP BY 1",
    "postings_single": "SELECT term, fid, count(*) AS tf, string_agg(lid || ':' || t || ':' || e, ' ' ORDER BY lid) AS occ FROM st GROUP BY term, fid",
    "postings_stats": "SELECT term, count(DISTINCT fid) AS df, count(*) AS cf FROM st GROUP BY term",
    "biterms": "SELECT term, fid, lid, t, e FROM bp",
    "biterm_dedup": "SELECT count(*) AS n_pairs, (SELECT count(*) FROM bt) AS n_distinct, count(*) - (SELECT count(*) FROM bt) AS n_duplicates FROM bp",
    "postings_bi": "SELECT term, fid, count(*) AS tf, string_agg(lid || ':' || t || ':' || e, ' ' ORDER BY lid) AS occ FROM bt GROUP BY term, fid",
    "query_batches": "SELECT query_id, batch, lid, block_no, done_block, horizon FROM b",
    "query_term_dedup": "SELECT * FROM qt",
    "candidates_join": "SELECT * FROM hits",
    "bin_first_hit": "SELECT query_id, batch, fid, bin, k, lid, t, e, eq FROM firsts",
    "time_order_scores": "SELECT * FROM scored",
    "bin_scores": "SELECT query_id, batch, fid, bin, score FROM bins",
    "best_bin": "SELECT * FROM best",
    "topk_candidates": "SELECT * FROM top",
    "batch_confidence": "SELECT query_id, batch, top1, top2, round(conf, 6) AS conf FROM conf",
    "peak_bins": "SELECT * FROM peaks",
    "graph_edges": "SELECT query_id, batch, k, count(*) AS n_edges, CAST(sum(edge % 1000003) AS BIGINT) AS edge_sum FROM qe GROUP BY query_id, batch, k",
    "graph_common": "SELECT query_id, batch, fid, bin, k, lid, edge, score, bin1, bin2 FROM common",
    "graph_rerank": "SELECT * FROM again",
    "accumulate": "SELECT * FROM acc",
    "final_topk": "SELECT query_id, batch, fid, ac, place FROM final",
    "step_confidence": "SELECT query_id, block_no, fid, ac, round(conf, 6) AS conf FROM stepbest",
    "running_confidence": "SELECT query_id, block_no, fid, round(mean_conf, 6) AS mean_conf, round(acc_time, 6) AS acc_time FROM running",
    "fuzzy_easy": "SELECT c, d, class FROM (" + fuzzy("EASY", "(SELECT CAST(i AS DOUBLE) / 50 AS c, CAST(j AS DOUBLE) / 2 AS d FROM range(0, 51) a(i), range(0, 51) b(j))") + ")",
    "fuzzy_strict": "SELECT c, d, class FROM (" + fuzzy("STRICT", "(SELECT CAST(i AS DOUBLE) / 50 AS c, CAST(j AS DOUBLE) / 2 AS d FROM range(0, 51) a(i), range(0, 51) b(j))") + ")",
    "fuzzy_identify": "SELECT * FROM result",
    "fuzzy_identify_all": "SELECT * FROM result",
    "fuzzy_identify_flush": results("decided_f"),
    "xscale_bins": "SELECT query_id, batch, fid, bin, score, place FROM top_x",
    "xscale_match": results("decided_x"),
    "stream_identify": f"SELECT * FROM ({results('decided_f')}) WHERE status <> 'PENDING'",
    "binary_identify": results("bindecided"),
    "cue_points": "SELECT query_id, batch, fid, CAST(trunc((365 * bin + 182) * 0.0138776::DOUBLE) AS INTEGER) AS cue_point FROM best",
    "results_with_metadata": "SELECT r.query_id, r.status, r.fid, coalesce(s_name, '') AS meta FROM result r LEFT JOIN supplier ON s_suppkey + 1 = r.fid",
    "results_json": """SELECT query_id, CAST(to_json({'status': max(status), 'Matches': coalesce(list({'FID': fid, 'Score': score, 'Confidence': confidence, 'IdClass': id_class, 'Metadata': meta} ORDER BY fid) FILTER (fid IS NOT NULL), [])}) AS VARCHAR) AS json
        FROM (SELECT r.*, coalesce(s_name, '') AS meta FROM result r LEFT JOIN supplier ON s_suppkey + 1 = r.fid) GROUP BY query_id""",
    "hamming_matrix": "SELECT label AS a, b.l2 AS b, d AS dist FROM (SELECT m.label, n.label AS l2, CAST(sum(CASE WHEN m.bit <> n.bit THEN 1 ELSE 0 END) AS INTEGER) AS d FROM majority m JOIN majority n USING (i) GROUP BY m.label, n.label) b",
    "quantize": "SELECT point, CAST(code AS INTEGER) AS code, dist FROM (SELECT *, row_number() OVER (PARTITION BY point ORDER BY dist, code DESC) AS r FROM distances) WHERE r = 1",
    "bit_majority": "SELECT label, string_agg(bit, '' ORDER BY i) AS bits FROM majority GROUP BY label",
    "codebook_dupes": "SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates FROM (SELECT bits, count(*) AS n FROM (SELECT label % 3 AS l3, label, string_agg(bit, '' ORDER BY i) AS bits FROM majority GROUP BY label UNION ALL SELECT 0, label, string_agg(bit, '' ORDER BY i) FROM majority WHERE label < 3 GROUP BY label) GROUP BY bits)",
    "delta_encode": "SELECT fid, lid, CAST(dlid AS INTEGER) AS dlid, CAST(dt AS INTEGER) AS dt FROM delta",
    "delta_decode": "SELECT fid, lid, t FROM qlf",
    "index_invariants": """SELECT 'lid_consecutive' AS rule, count(*) FILTER (lid <> coalesce(pl + 1, 0)) AS violations FROM (SELECT *, lag(lid) OVER (PARTITION BY fid ORDER BY lid) AS pl FROM qlf)
        UNION ALL SELECT 't_monotone', count(*) FILTER (t < pt) FROM (SELECT *, lag(t) OVER (PARTITION BY fid ORDER BY lid) AS pt FROM qlf)
        UNION ALL SELECT 'f_range', count(*) FILTER (NOT f BETWEEN 18 AND 575) FROM qlf UNION ALL SELECT 'w_range', count(*) FILTER (NOT w BETWEEN 0 AND 99) FROM qlf
        UNION ALL SELECT 'e_range', count(*) FILTER (NOT e BETWEEN 0 AND 255) FROM qlf UNION ALL SELECT 'fid_positive', count(*) FILTER (fid < 1) FROM qlf""",
    "fid_monotonic": "SELECT fid, count(*) AS n, min(lid) AS first_lid, max(lid) AS last_lid, count(*) = max(lid) + 1 AND min(lid) = 0 AS good FROM qlf GROUP BY fid",
    "delta_merge": "SELECT term, count(*) AS tf, count(DISTINCT fid) AS df, max(fid) AS fid_max FROM st GROUP BY term",
    "ranged_fingerprint": "SELECT fid, lid, t, f, w, e FROM qlf WHERE fid = 7 AND lid BETWEEN 50 AND 80",
    "eval_metrics": """SELECT count(*) FILTER (outcome = 'TP') AS tp, count(*) FILTER (outcome = 'FP') AS fp, count(*) FILTER (outcome = 'TN') AS tn, count(*) FILTER (outcome = 'FN') AS fn,
        round(CAST(count(*) FILTER (outcome = 'TP') AS DOUBLE) / nullif(count(*) FILTER (outcome IN ('TP', 'FP')), 0), 6) AS "precision", round(CAST(count(*) FILTER (outcome = 'TN') AS DOUBLE) / nullif(count(*) FILTER (outcome IN ('TN', 'FN')), 0), 6) AS sensitivity,
        round(CAST(count(*) FILTER (outcome IN ('TP', 'TN')) AS DOUBLE) / nullif(count(*), 0), 6) AS accuracy FROM outcomes""",
    "eval_semi": "SELECT query_id, fid FROM result r WHERE fid IS NOT NULL AND EXISTS (SELECT 1 FROM truth t WHERE t.query_id = r.query_id AND t.fid = r.fid)",
    "eval_anti": "SELECT query_id, fid FROM result r WHERE fid IS NOT NULL AND NOT EXISTS (SELECT 1 FROM truth t WHERE t.query_id = r.query_id AND t.fid = r.fid)",
    "lf_rate_hist": """SELECT n, count(*) AS freq, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (), 6) AS pdf, round(CAST(count(*) AS DOUBLE) / max(count(*)) OVER (), 6) AS bar
        FROM (SELECT count(*) AS n FROM qlf GROUP BY fid, t // 73) GROUP BY n""",
    "mix_gain_power": """SELECT vec_id, round(list_sum(list_transform(list_zip(a, z), lambda p: ((p[1] + p[2]) / 2) * ((p[1] + p[2]) / 2))) / len(a), 9) AS mix_power,
        round(list_sum(list_transform(a, lambda x: greatest(least(x * 4.0::DOUBLE, 1.0::DOUBLE), -1.0::DOUBLE) * greatest(least(x * 4.0::DOUBLE, 1.0::DOUBLE), -1.0::DOUBLE))) / len(a), 9) AS gain_power, round(list_sum(list_transform(a, lambda x: x * x)) / len(a), 9) AS power FROM audio""",
    "snr": "SELECT label, round(10 * log10(sum(s) / sum(n)), 6) AS snr FROM (SELECT label, list_sum(list_transform(embedding[1:32], lambda x: CAST(x AS DOUBLE) * x)) AS s, list_sum(list_transform(embedding[33:64], lambda x: CAST(x AS DOUBLE) * x)) AS n FROM embeddings) GROUP BY label",
    "format_time": "SELECT o_orderkey, printf('%02d:%02d:%02d', CAST(s // 3600 AS INTEGER), CAST(s % 3600 // 60 AS INTEGER), CAST(s % 60 AS INTEGER)) AS hms FROM (SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS s FROM orders)",
    "supported_formats": "SELECT page_id, upper(regexp_extract(path, '\\.([^./]+)$', 1)) IN ('WAV','AIFF','AU','CDA','FLAC','MP3','M4A','AAC','OGG') AS supported FROM (SELECT page_id, 'clips/' || page_id || '_1.' || CASE page_id % 4 WHEN 0 THEN 'wav' WHEN 1 THEN 'Mp3' WHEN 2 THEN 'txt' ELSE 'flac' END AS path FROM pages)",
    "clip_truth": "SELECT page_id, CAST(page_id AS VARCHAR) AS truth FROM pages",
    "stream_tumbling": "SELECT user_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "session_windows": """SELECT user_id, count(*) AS n, CAST(floor(epoch(min(ts))) AS BIGINT) AS start_s, CAST(floor(epoch(max(ts))) AS BIGINT) AS last_s FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s
        FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR > ts THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""",
}


def sql(name: str) -> str:
    """A query with the expressions that it needs, in order."""
    body = QUERIES[name]
    need: set[str] = set()
    todo = [body]
    while todo:
        text = todo.pop()
        for k in CTES:
            if k not in need and re.search(rf"\b(FROM|JOIN)\s+{k}\b", text):
                need.add(k)
                todo.append(CTES[k])
    known = CTES | {"q": ALL_QUERIES} if name == "fuzzy_identify_all" else CTES
    parts = ", ".join(f"{k} AS MATERIALIZED ({v})" for k, v in known.items() if k in need)
    return f"WITH {parts} {body}" if parts else body


def oracle_sql() -> dict[str, str]:
    return {name: sql(name) for name in QUERIES}
