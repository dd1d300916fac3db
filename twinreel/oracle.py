"""DuckDB SQL that gives the registered media queries' results on the same tables."""

from __future__ import annotations

from twinreel import constants as K

_RATE = "CASE {k} % 4 WHEN 0 THEN 25.0::DOUBLE WHEN 1 THEN 30.0::DOUBLE WHEN 2 THEN 23.976::DOUBLE ELSE 50.0::DOUBLE END"

FRAMES = """
 f AS (SELECT vec_id, list_concat([0.0::FLOAT], list_transform(embedding[2:64], lambda x: x::FLOAT)) AS c FROM embeddings),
 fm AS (SELECT vec_id, c, (list_sort(c)[32] + list_sort(c)[33]) / 2 AS m FROM f),
 fu AS (SELECT vec_id, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN c[i] > m THEN (1::HUGEINT << (64 - i)::HUGEINT) ELSE 0::HUGEINT END))::HUGEINT AS u FROM fm),
 fh AS (SELECT vec_id, CASE WHEN u >= 9223372036854775808::HUGEINT THEN (u - 18446744073709551616::HUGEINT)::BIGINT ELSE u::BIGINT END AS hash FROM fu)"""

MEDIA = f"""
 media AS (SELECT doc_id AS media_id, '/' || source || '/' || doc_id || '.mp4' AS path, length(text)::BIGINT AS total_ms, length(text)::DOUBLE / 1000.0::DOUBLE AS duration,
   lang AS codec, {_RATE.format(k="doc_id")} AS frame_rate FROM documents)"""

SAMPLES = """
 l0 AS (SELECT doc_id, length(text)::BIGINT AS total_ms, string_split(text, chr(10)) AS l FROM documents),
 l1 AS (SELECT doc_id AS media_id, i - 1 AS seq, total_ms, l[i] AS line FROM l0, unnest(range(1, len(l) + 1)) AS t(i)),
 l2 AS (SELECT media_id, seq, total_ms, length(line) >= 20 AS valid,
   xor(('0x' || substr(md5(line), 1, 15))::BIGINT, coalesce(list_sum(list_transform(range(0, (CASE WHEN (media_id + seq) % 10 > 9 THEN 9 ELSE (media_id + seq) % 10 END)::BIGINT), lambda m: 1::BIGINT << ((seq * 7 + m * 13) % 60))), 0)::BIGINT) AS hash,
   coalesce(sum(length(line) + 1) OVER (PARTITION BY media_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS t_start FROM l1),
 l3 AS (SELECT *, coalesce(lead(t_start) OVER (PARTITION BY media_id ORDER BY t_start, seq), total_ms) AS t_end FROM l2),
 samples AS (SELECT media_id, (row_number() OVER (PARTITION BY media_id ORDER BY t_start, seq) - 1)::INTEGER AS idx, hash, t_start, t_end FROM l3 WHERE valid)"""


def _pairs(loose: int) -> str:
    return f"""
 fx AS (SELECT x.media_id AS a, y.media_id AS b, x.idx AS i, y.idx AS j, y.t_start - x.t_start AS "offset", bit_count(xor(x.hash, y.hash))::INTEGER AS dist
   FROM samples x JOIN samples y ON x.media_id < y.media_id AND bit_count(xor(x.hash, y.hash)) <= {loose})"""


_ELIGIBLE = """
 el AS (SELECT x.a, x.b, x.i, x.j, x.dist, count(w.a) AS eligible, count(DISTINCT w.i) AS wi, count(DISTINCT w.j) AS wj
   FROM fx x LEFT JOIN fx w ON w.a = x.a AND w.b = x.b AND abs(w."offset" - x."offset") <= 500 AND w.i <> x.i AND w.j <> x.j GROUP BY ALL)"""

_MARKS = f"{MEDIA},{SAMPLES},{_pairs(10)},{_ELIGIBLE},\n mk AS (SELECT a, b, i, j FROM el WHERE dist <= 4 OR eligible >= 1)"

_COVER = f"""{_MARKS},
 ca AS (SELECT a, b, sum(greatest(t_end - t_start, 0))::BIGINT AS ms_a, min_by(t_start, idx) AS start_a, max_by(t_end, idx) AS end_a
   FROM (SELECT DISTINCT a, b, i FROM mk) m JOIN samples s ON s.media_id = m.a AND s.idx = m.i GROUP BY a, b),
 cb AS (SELECT a, b, sum(greatest(t_end - t_start, 0))::BIGINT AS ms_b, min_by(t_start, idx) AS start_b, max_by(t_end, idx) AS end_b
   FROM (SELECT DISTINCT a, b, j FROM mk) m JOIN samples s ON s.media_id = m.b AND s.idx = m.j GROUP BY a, b),
 cv AS (SELECT a, b, ms_a, ms_b, start_a, end_a, start_b, end_b,
   CASE WHEN x.total_ms > 0 THEN least(ms_a::FLOAT / x.total_ms::FLOAT, 1.0::FLOAT) ELSE 0.0::FLOAT END AS coverage_a,
   CASE WHEN y.total_ms > 0 THEN least(ms_b::FLOAT / y.total_ms::FLOAT, 1.0::FLOAT) ELSE 0.0::FLOAT END AS coverage_b, x.duration AS da, y.duration AS db
   FROM ca JOIN cb USING (a, b) JOIN media x ON x.media_id = a JOIN media y ON y.media_id = b),
 mt AS (SELECT * FROM cv WHERE greatest(coverage_a, coverage_b) > 0 AND greatest(coverage_a, coverage_b) >= 0.2::FLOAT)"""

PARTS = f"""
 pm AS (SELECT p_partkey AS media_id, '/' || p_brand || '/' || p_partkey AS path, substr(p_type, 1, 4) AS codec, 60.0::DOUBLE + (p_partkey % 7) * 0.4::DOUBLE AS duration,
   p_size * 16 AS width, p_size * 9 AS height, floor(p_retailprice * 1000)::BIGINT AS file_size, {_RATE.format(k="p_partkey")} AS frame_rate FROM part),
 pf AS (SELECT *, width::BIGINT * height AS resolution, CASE WHEN duration > 0 THEN trunc(file_size * 8.0::DOUBLE / duration)::BIGINT ELSE 0 END AS bitrate FROM pm),
 pq AS (SELECT *, trunc(bitrate / frame_rate)::BIGINT AS quality FROM pf),
 pu AS (SELECT p_partkey % 200 + 1 AS group_no, p_partkey AS media_id, '/' || p_brand || '/' || p_partkey AS path FROM part
   UNION ALL SELECT p_partkey % 50 + 201, p_partkey, '/' || p_brand || '/' || p_partkey FROM part WHERE p_partkey % 3 = 0),
 pg AS (SELECT group_no, media_id, (row_number() OVER (PARTITION BY group_no ORDER BY path) - 1)::INTEGER AS pos FROM pu),
 mem AS (SELECT group_no, pos, pq.* FROM pg JOIN pq USING (media_id))"""

_VALUES = {"length": "floor(duration * 1000)", "resolution": "resolution", "quality": "quality::DOUBLE / max_quality", "size": "file_size::DOUBLE / max_size"}


def _tiers(source: str, keys: str) -> str:
    return f"""(SELECT *, (duration <= 0 OR duration >= max_duration - 1.0)::INTEGER AS tier_length,
   CASE WHEN max_resolution = 0 THEN 1 ELSE (resolution >= max_resolution * 0.95::DOUBLE)::INTEGER END AS tier_resolution,
   CASE WHEN max_quality = 0 OR frame_rate <= 0 OR duration <= 0 THEN 1 ELSE (quality >= max_quality * 0.95::DOUBLE)::INTEGER END AS tier_quality,
   CASE WHEN max_size = 0 THEN 1 ELSE (file_size >= max_size * 0.95::DOUBLE)::INTEGER END AS tier_size
   FROM (SELECT *, max(duration) OVER (PARTITION BY {keys}) AS max_duration, max(resolution) OVER (PARTITION BY {keys}) AS max_resolution,
     max(quality) OVER (PARTITION BY {keys}, codec) AS max_quality, max(file_size) OVER (PARTITION BY {keys}, codec) AS max_size FROM {source}))"""


def _order(priority: str) -> str:
    order = [priority, *(m for m in K.METRICS if m != priority)]
    return ", ".join([f"tier_{m} DESC" for m in order] + [f"{_VALUES[m]} DESC" for m in order] + ["path"])


def _best(tiered: str, keys: str, priority: str) -> str:
    return f"(SELECT {keys}, media_id AS best FROM {tiered} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {_order(priority)}) = 1)"


def _fold(tiered: str, keys: str, priority: str) -> str:
    """The best of each group where figures are unknown: members folded in path order, a later one wins if it is better."""
    order = [priority, *(m for m in K.METRICS if m != priority)]
    timed = "x.duration > 0 AND a.duration > 0"
    able = {"length": timed, "resolution": "true", "quality": f"{timed} AND x.frame_rate > 0 AND a.frame_rate > 0", "size": "true"}
    pair = {
        "length": ("floor(x.duration * 1000)", "floor(a.duration * 1000)"), "resolution": ("x.resolution", "a.resolution"),
        "quality": ("x.quality::HUGEINT * a.max_quality", "a.quality::HUGEINT * x.max_quality"), "size": ("x.file_size::HUGEINT * a.max_size", "a.file_size::HUGEINT * x.max_size"),
    }
    tests = [f"WHEN x.tier_{m} <> a.tier_{m} THEN x.tier_{m} > a.tier_{m}" for m in order] + [f"WHEN {able[m]} AND {pair[m][0]} <> {pair[m][1]} THEN {pair[m][0]} > {pair[m][1]}" for m in order]
    fields = ", ".join(["path", "media_id", "duration", "frame_rate", "resolution", "quality", "file_size", "max_quality", "max_size", *(f"tier_{m}" for m in K.METRICS)])
    packed = f"struct_pack({', '.join(f'{c} := {c}' for c in fields.split(', '))})"
    return f"""(SELECT {keys}, list_reduce(list({packed} ORDER BY path, media_id), lambda a, x: CASE WHEN (CASE {" ".join(tests)} ELSE x.path < a.path END) THEN x ELSE a END).media_id AS best
   FROM {tiered} GROUP BY {keys})"""


_BASE = "group_no, pos, media_id, path, codec, duration, width, height, file_size, frame_rate, resolution, bitrate, quality"


def _decide(priority: str, members: str = PARTS, best=_best) -> str:
    """Fates of the `mem` that `members` defines; unknown runtimes need `_fold`."""
    wanted = [m for m in K.REVIEW_METRICS if m != priority]
    short = " UNION ALL ".join(
        f"SELECT k.group_no, {n} AS n, b.best AS media_id FROM kt k JOIN {best('ti', 'group_no', m)} b USING (group_no) WHERE k.tier_{m} = 0 AND b.best <> k.keep" for n, m in enumerate(wanted)
    )
    return f"""{members},
 ti AS {_tiers("mem", "group_no")},
 kp AS (SELECT group_no, best AS keep FROM {best("ti", "group_no", priority)}),
 kt AS (SELECT kp.group_no, kp.keep, ti.* EXCLUDE (group_no) FROM kp JOIN ti ON ti.group_no = kp.group_no AND ti.media_id = kp.keep),
 un AS (SELECT group_no, media_id FROM mem WHERE duration <= 0),
 kn AS (SELECT {_BASE} FROM mem WHERE duration > 0 AND group_no IN (SELECT group_no FROM un)),
 um AS (SELECT * FROM un UNION SELECT c.group_no, CASE WHEN kt.duration > 0 THEN kt.keep ELSE c.best END FROM {best(_tiers("kn", "group_no"), "group_no", priority)} c JOIN kt USING (group_no)),
 sf AS (SELECT group_no, min_by(media_id, n) AS media_id FROM ({short}) GROUP BY group_no),
 co AS (SELECT {_BASE} FROM ti WHERE tier_length = 1 AND tier_resolution = 1),
 so AS (SELECT group_no FROM co GROUP BY group_no HAVING count(DISTINCT codec) > 1),
 ri AS (SELECT co.* FROM co JOIN so USING (group_no)),
 rb AS {best(_tiers("ri", "group_no, codec"), "group_no, codec", priority)},
 ok AS (SELECT ri.group_no, ri.codec, keep FROM ri JOIN kp ON kp.group_no = ri.group_no AND kp.keep = ri.media_id),
 st AS (SELECT rb.group_no, coalesce(keep, best) AS media_id FROM rb LEFT JOIN ok USING (group_no, codec)),
 rv AS (SELECT * FROM sf UNION SELECT * FROM st UNION SELECT * FROM um),
 dl AS (SELECT DISTINCT media_id FROM mem JOIN kp USING (group_no) WHERE media_id <> keep AND (group_no, media_id) NOT IN (SELECT (group_no, media_id) FROM rv)),
 ft AS (SELECT DISTINCT media_id, CASE WHEN media_id IN (SELECT media_id FROM rv) THEN 'REVIEW' WHEN media_id IN (SELECT media_id FROM dl) THEN 'DELETE' ELSE 'KEEP' END AS action FROM mem)"""


_TIMED = "60.0::DOUBLE + (p_partkey % 7) * 0.4::DOUBLE"
#: The same parts, the runtime of one in 17 unknown.
PARTS_UNMEASURED = PARTS.replace(_TIMED, f"CASE WHEN p_partkey % 17 = 0 THEN 0.0::DOUBLE ELSE {_TIMED} END")

#: Maximal cliques of the matches: partial cliques c, the nodes p that extend one and the nodes x that were tried before, grown one node
#: at a time; only what the node with the most neighbours in p does not reach is tried.
CLIQUES = f"""{_COVER},
 ed AS (SELECT a, b FROM mt UNION SELECT b, a FROM mt),
 rc AS (SELECT a AS node, a AS other FROM ed UNION SELECT rc.node, ed.b FROM rc JOIN ed ON ed.a = rc.other),
 cm AS (SELECT node, min(other) AS component FROM rc GROUP BY node),
 aj AS MATERIALIZED (SELECT a AS node, list(b) AS near FROM ed GROUP BY a),
 bk AS (SELECT component, []::BIGINT[] AS c, list(node ORDER BY node) AS p, []::BIGINT[] AS x FROM cm GROUP BY component
   UNION ALL
   SELECT s.component, list_append(s.c, v), list_filter(s.p, lambda y: list_contains(w.near, y) AND NOT list_contains(s.todo[1:i], y)),
     list_filter(list_concat(s.x, s.todo[1:i - 1]), lambda y: list_contains(w.near, y))
   FROM (SELECT component, c, any_value(p) AS p, any_value(x) AS x, list_filter(any_value(p), lambda y: NOT list_contains(arg_max(near, len(list_intersect(p, near))), y)) AS todo
     FROM (SELECT component, c, p, x, unnest(list_concat(p, x)) AS u FROM bk WHERE len(p) > 0) o JOIN aj ON aj.node = o.u GROUP BY component, c) s,
     unnest(s.todo) WITH ORDINALITY AS t(v, i) JOIN aj w ON w.node = t.v),
 cq AS (SELECT component, list_sort(c) AS members FROM bk WHERE len(p) = 0 AND len(x) = 0 AND len(c) > 1)"""

GROUPS = f"""{CLIQUES},
 pm AS (SELECT doc_id AS media_id, path, coalesce(codec, '') AS codec, duration, (640 * (1 + doc_id % 3))::INTEGER AS width, (360 * (1 + doc_id % 3))::INTEGER AS height, strlen(text)::BIGINT AS file_size, frame_rate
   FROM media JOIN documents ON doc_id = media_id),
 pf AS (SELECT *, width::BIGINT * height AS resolution, CASE WHEN duration > 0 THEN trunc(file_size * 8.0::DOUBLE / duration)::BIGINT ELSE 0 END AS bitrate FROM pm),
 pq AS (SELECT *, trunc(bitrate / frame_rate)::BIGINT AS quality FROM pf),
 cp AS (SELECT members, list(path ORDER BY path) AS paths, list(media_id ORDER BY path, media_id) AS ids FROM (SELECT members, unnest(members) AS media_id FROM cq) JOIN pm USING (media_id) GROUP BY members),
 gn AS (SELECT ids, row_number() OVER (ORDER BY len(ids) DESC, paths) AS group_no FROM cp),
 pg AS (SELECT group_no, ids[k] AS media_id, (k - 1)::INTEGER AS pos FROM gn, unnest(range(1, len(ids) + 1)) AS t(k)),
 mem AS (SELECT group_no, pos, pq.* FROM pg JOIN pq USING (media_id))"""


_RANKED = """
 gl AS (SELECT s.group_no, subject, other, y.path AS other_path, coverage::DOUBLE * x.duration AS matched_seconds, start_ms, end_ms,
   row_number() OVER (PARTITION BY s.group_no, subject ORDER BY coverage::DOUBLE * x.duration DESC, y.path) AS rank
   FROM lk JOIN pg s ON s.media_id = subject JOIN pg o ON o.media_id = other AND o.group_no = s.group_no JOIN pm x ON x.media_id = subject JOIN pm y ON y.media_id = other)"""

LINKS = f"""
 lp AS (SELECT DISTINCT s.media_id AS subject, o.media_id AS other FROM pg s JOIN pg o ON s.group_no = o.group_no AND s.media_id <> o.media_id),
 lk AS (SELECT subject, other, (((subject * 7 + other * 3) % 100) / 128.0::DOUBLE)::FLOAT AS coverage, subject % 50 * 1000 AS start_ms, subject % 50 * 1000 + 5000 AS end_ms FROM lp),{_RANKED}"""

#: The matches, seen from both sides.
MATCH_LINKS = f"""
 lk AS (SELECT a AS subject, b AS other, coverage_a AS coverage, start_a AS start_ms, end_a AS end_ms FROM mt UNION ALL SELECT b, a, coverage_b, start_b, end_b FROM mt),{_RANKED}"""


def _size(b: str) -> str:
    return f"CASE WHEN {b} >= 1073741824 THEN printf('%.1fGB', {b} / 1073741824.0::DOUBLE) WHEN {b} >= 1048576 THEN printf('%.1fMB', {b} / 1048576.0::DOUBLE) WHEN {b} >= 1024 THEN printf('%.1fKB', {b} / 1024.0::DOUBLE) ELSE {b} || 'B' END"


def _bitrate(b: str) -> str:
    return f"CASE WHEN {b} >= 1000000 THEN printf('%.1fMbps', {b} / 1000000.0::DOUBLE) WHEN {b} >= 1000 THEN printf('%.0fkbps', {b} / 1000.0::DOUBLE) ELSE {b} || 'bps' END"


def _quality(b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN '-' WHEN {b} >= 1000000 THEN printf('%.1fMb/f', {b} / 1000000.0::DOUBLE) WHEN {b} >= 1000 THEN printf('%.1fkb/f', {b} / 1000.0::DOUBLE) ELSE {b} || 'b/f' END"


def _duration(s: str) -> str:
    r = f"floor({s} + 0.5)::BIGINT"
    return f"printf('%02d:%02d:%02d', {r} // 3600, {r} % 3600 // 60, {r} % 60)"


def _fps(x: str) -> str:
    return f"CASE WHEN {x} <= 0 THEN '-' WHEN abs({x} - floor({x} + 0.5)) < 0.01 THEN floor({x} + 0.5)::BIGINT || 'fps' ELSE printf('%.2ffps', {x}) END"


def _shared(s: str) -> str:
    r, m = f"floor({s} + 0.5)::BIGINT", f"floor(floor({s} + 0.5) / 60.0::DOUBLE + 0.5)::BIGINT"
    return f"""CASE WHEN {s} IS NULL THEN '-' WHEN {s} <= 0 THEN '0s' WHEN {s} < 0.1 THEN '<0.1s' WHEN {s} < 10 THEN printf('%.1fs', {s}) WHEN {r} < 60 THEN {r} || 's'
   WHEN {r} < 3600 THEN printf('%dm%02ds', {r} // 60, {r} % 60) ELSE printf('%dh%02dm', {m} // 60, {m} % 60) END"""


_FILES = """
 pf AS (SELECT page_id AS request_pos, '/' || regexp_replace(url, '^https?://', '') AS path, page_id % 3 AS dev, (length(url) % 40)::BIGINT AS ino, html FROM pages)"""

_CLOCK = """
 ev AS (SELECT user_id AS media_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, epoch_us(ts) // 1000 % 100000000 AS ts, event_type, value FROM events),
 e1 AS (SELECT *, ts - lag(ts) OVER (PARTITION BY media_id ORDER BY seq) AS gap FROM ev),
 e2 AS (SELECT *, last_value(CASE WHEN gap > 0 THEN gap END IGNORE NULLS) OVER (PARTITION BY media_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e1),
 ck AS (SELECT media_id, seq, sum(CASE WHEN gap IS NULL THEN 0 WHEN gap >= 0 THEN gap ELSE greatest(coalesce(before, 1), 1) END) OVER (PARTITION BY media_id ORDER BY seq)::BIGINT AS elapsed, coalesce(gap < 0, false) AS restarted FROM e2)"""


def _stamps(name: str, shift: int) -> str:
    changed = f"CASE WHEN o_orderkey % 10 = {shift} THEN o_custkey + 1 ELSE o_custkey END" if shift else "o_custkey"
    return f"""
 {name} AS (SELECT '/f/' || o_orderkey AS path, {changed} AS mtime, o_orderkey % 1000 AS ns, floor(o_totalprice)::BIGINT AS size,
   CASE o_orderkey % 3 WHEN 0 THEN {-1.0 if shift else 0.0}::DOUBLE WHEN 1 THEN 'nan'::DOUBLE ELSE 2.0::DOUBLE END AS kf, CASE o_orderkey % 4 WHEN 0 THEN {12.0 + shift}::DOUBLE ELSE 12.0::DOUBLE END AS fl, o_orderkey FROM orders)"""


_SAME = """(x.mtime = y.mtime AND x.ns = y.ns AND x.size = y.size
   AND (((isnan(x.kf) OR x.kf <= 0) AND (isnan(y.kf) OR y.kf <= 0)) OR (NOT (isnan(x.kf) OR x.kf <= 0) AND NOT (isnan(y.kf) OR y.kf <= 0) AND x.kf = y.kf))
   AND (isnan(y.kf) OR y.kf <= 0 OR x.fl = y.fl))"""

_JOBS = """
 jb AS (SELECT p_partkey AS media_id, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_partkey % 90 END AS kf, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_size * 14400 END AS px,
   CASE WHEN p_partkey % 7 = 0 THEN 0.0::DOUBLE ELSE (p_partkey % 200)::DOUBLE END AS du, CASE p_partkey % 4 WHEN 0 THEN 1.7::DOUBLE WHEN 1 THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS cost,
   floor(p_retailprice * 1000)::BIGINT AS size FROM part),
 jk AS (SELECT *, CASE WHEN kf > 0 THEN kf WHEN du > 0 THEN greatest(ceil(du / 2.0), 1) END AS n FROM jb),
 jw AS (SELECT *, CASE WHEN px > 0 AND n IS NOT NULL THEN floor(greatest(n::DOUBLE * px * cost, 1.0)) ELSE greatest(floor(size * 3.8::DOUBLE), 1) END::BIGINT AS weight,
   CASE WHEN du > 0 THEN least(n, greatest(ceil(du / least(10.0::DOUBLE, du / 12.0::DOUBLE)), 1)) ELSE n END AS m FROM jk)"""


def _two(x: str) -> str:
    return f"floor({x} * 100 + 0.5) / 100"


def _clock(side: str, prefix: str = "") -> str:
    ends = (("from", f"{side}.start_ms / 1000.0::DOUBLE"), ("to", f"{side}.end_ms / 1000.0::DOUBLE"))
    return ", ".join(f"{_duration(x)} AS {prefix}matched_{name}, {_two(x)} AS {prefix}matched_{name}_seconds" for name, x in ends)


_PART_COUNTS = "SELECT l_partkey AS media_id, count(*) AS n FROM lineitem GROUP BY 1"


def _report_cells(counts: str = _PART_COUNTS) -> str:
    return f"""SELECT m.group_no, m.pos, action, m.path AS full_path, {_duration("duration")} AS length, printf('%.2f', duration) AS length_seconds, width || 'x' || height AS resolution,
   width::VARCHAR AS width, height::VARCHAR AS height, CASE WHEN frame_rate = floor(frame_rate) THEN floor(frame_rate)::BIGINT::VARCHAR ELSE (floor(frame_rate * 1000 + 0.5) / 1000)::VARCHAR END AS framerate_fps,
   codec, {_size("file_size")} AS size, file_size::VARCHAR AS size_bytes, {_bitrate("bitrate")} AS bitrate, bitrate::VARCHAR AS bitrate_bps, {_quality("quality")} AS quality,
   CASE WHEN quality > 0 THEN quality::VARCHAR ELSE '' END AS quality_bits_per_frame, coalesce(other_path, '') AS matched_with, coalesce(n, 0)::VARCHAR AS samples,
   coalesce(printf('%.2f', matched_seconds), '') AS matched_seconds, coalesce({_duration("start_ms / 1000.0::DOUBLE")}, '') AS matched_from, coalesce({_duration("end_ms / 1000.0::DOUBLE")}, '') AS matched_to,
   coalesce(printf('%.2f', start_ms / 1000.0::DOUBLE), '') AS matched_from_seconds, coalesce(printf('%.2f', end_ms / 1000.0::DOUBLE), '') AS matched_to_seconds
   FROM mem m JOIN ft USING (media_id) LEFT JOIN (SELECT * FROM gl WHERE rank = 1) g ON g.group_no = m.group_no AND g.subject = m.media_id
   LEFT JOIN ({counts}) c ON c.media_id = m.media_id"""


def oracle_sql() -> dict[str, str]:
    w = lambda ctes, rest: f"WITH {ctes}\n{rest}"
    out = {
        "frame_hash": w(FRAMES, "SELECT vec_id, hash FROM fh"),
        "hash_popcount": w(FRAMES, "SELECT bit_count(hash)::INTEGER AS bits, count(*) AS n FROM fh GROUP BY 1"),
        "featureless_filter": w(FRAMES, """, e AS (SELECT vec_id, list_sum(list_transform(c, lambda x: abs(x::DOUBLE * (1 + vec_id % 100) * 2))) / 64 AS e FROM f)
            SELECT vec_id, round(e, 4) AS energy, e < 8.0 AS featureless FROM e"""),
        "sample_clock": w(_CLOCK, "SELECT media_id, seq, elapsed, restarted FROM ck"),
        "keyframe_subsample": "WITH RECURSIVE" + _CLOCK + """,
            du AS (SELECT media_id, max(elapsed) / 1000.0::DOUBLE AS d FROM ck GROUP BY 1),
            iv AS (SELECT media_id, CASE WHEN d > 0 THEN least(5000.0::DOUBLE, d / 12.0) ELSE 0.0 END * 1000 AS every FROM du),
            r AS (SELECT media_id, min(seq) AS seq, min_by(elapsed, seq) AS elapsed FROM ck GROUP BY 1
                  UNION ALL SELECT media_id, min(seq), min_by(elapsed, seq) FROM (SELECT c.media_id, c.seq, c.elapsed FROM r JOIN iv USING (media_id) JOIN ck c ON c.media_id = r.media_id AND c.seq > r.seq AND (every <= 0 OR c.elapsed - r.elapsed >= every)) GROUP BY media_id)
            SELECT media_id, seq, elapsed FROM r""",
        "collapse_runs": w(_CLOCK, """SELECT media_id, seq, event_type AS state, value > 10 AS valid FROM ev WINDOW x AS (PARTITION BY media_id ORDER BY seq)
            QUALIFY lag(event_type) OVER x IS NULL OR event_type <> lag(event_type) OVER x OR (value > 10) <> lag(value > 10) OVER x"""),
        "drop_repeats": w(_CLOCK, "SELECT media_id, seq, event_type FROM ev WINDOW x AS (PARTITION BY media_id ORDER BY seq) QUALIFY lag(event_type) OVER x IS DISTINCT FROM event_type"),
        "restarted_runtime": w(_CLOCK, """SELECT media_id, round(CASE WHEN bool_or(restarted) THEN greatest((media_id % 7 * 10000)::DOUBLE, max(elapsed) / 1000.0::DOUBLE) ELSE media_id % 7 * 10000 END, 4)::DOUBLE AS runtime
            FROM ck GROUP BY media_id"""),
        "sample_spans": w(SAMPLES, "SELECT media_id, idx, hash, t_start, t_end FROM samples"),
        "sample_times_extend": w(_CLOCK, """, x AS (SELECT media_id, seq, CASE WHEN media_id % 5 = 0 AND seq = 3 THEN NULL ELSE seq * 1000 - 1000 END AS t, CASE WHEN media_id % 3 = 0 THEN 0 ELSE 20000 END AS total FROM ev),
            y AS (SELECT *, count(*) OVER p AS n, count(t) OVER p AS known FROM x WINDOW p AS (PARTITION BY media_id)),
            z AS (SELECT *, CASE WHEN known < n AND total = 0 THEN n ELSE total END AS total2 FROM y),
            q AS (SELECT media_id, seq, n, total2, CASE WHEN known = n THEN t ELSE (seq - 1) * total2 // n END AS t_start FROM z),
            v AS (SELECT *, max(t_start) OVER (PARTITION BY media_id) AS last FROM q)
            SELECT media_id, seq, t_start::BIGINT AS t_start, (CASE WHEN total2 <= last THEN last + greatest(last // greatest(n - 1, 1), 1) ELSE total2 END)::BIGINT AS total_ms FROM v"""),
        "aligned_offsets": w(f"{SAMPLES},{_pairs(10)}", "SELECT * FROM fx"),
        "strict_frame_matches": w(f"{SAMPLES},{_pairs(4)}", "SELECT a, b, count(*) AS n, min(dist) AS nearest FROM fx GROUP BY a, b"),
        "witness_counts": w(f"{SAMPLES},{_pairs(10)},{_ELIGIBLE}", "SELECT a, b, i, j, eligible FROM el"),
        "corroborated_q1": w(_MARKS, "SELECT a, b, i, j FROM mk"),
        "corroborated_q2": w(f"{SAMPLES},{_pairs(15)},{_ELIGIBLE}", "SELECT a, b, i, j FROM el WHERE dist <= 9 OR (dist <= 12 AND eligible >= 1) OR (wi >= 2 AND wj >= 2)"),
        # three disjoint witnesses exist unless two samples meet all eligible ones: two of one side, or one of either
        "corroborated_q3plus": w(f"{SAMPLES},{_pairs(18)},{_ELIGIBLE}", """,
            es AS (SELECT x.a, x.b, x.i, x.j, x.dist, list(struct_pack(i := w.i, j := w.j)) AS e FROM el x JOIN fx t USING (a, b, i, j) JOIN fx w
              ON w.a = x.a AND w.b = x.b AND abs(w."offset" - t."offset") <= 500 AND w.i <> x.i AND w.j <> x.j WHERE x.dist >= 16 AND x.wi >= 3 AND x.wj >= 3 GROUP BY ALL)
            SELECT a, b, i, j FROM el WHERE dist <= 12 OR (dist <= 15 AND wi >= 2 AND wj >= 2)
            UNION ALL SELECT a, b, i, j FROM es WHERE list_bool_and(list_transform(list_distinct(list_transform(e, lambda y: y.i)),
              lambda i0: len(list_distinct(list_transform(list_filter(e, lambda y: y.i <> i0), lambda y: y.j))) >= 2))"""),
        "maximal_cliques": "WITH RECURSIVE" + CLIQUES + " SELECT component, array_to_string(members, ',') AS members, NULL::VARCHAR AS problem FROM cq",
        "group_order": "WITH RECURSIVE" + GROUPS + " SELECT group_no, media_id, pos FROM pg",
        "duplicate_report": "WITH RECURSIVE" + _decide("length", GROUPS) + f",{MATCH_LINKS}\n{_report_cells('SELECT media_id, count(*) AS n FROM samples GROUP BY 1')}".replace("SELECT m.group_no, m.pos,", "SELECT m.group_no, 'group_' || m.group_no AS \"group\", m.pos,"),
        "coverage": w(_COVER, "SELECT a, b, ms_a, ms_b, round(coverage_a::DOUBLE, 6) AS coverage_a, round(coverage_b::DOUBLE, 6) AS coverage_b FROM cv"),
        "span_envelope": w(_COVER, "SELECT a, b, start_a, end_a, start_b, end_b FROM cv"),
        "match_gate": w(_COVER, "SELECT a, b FROM mt"),
        "min_duration_gate": w(_COVER, "SELECT a, b FROM mt WHERE least(CASE WHEN da > 0 THEN coverage_a::DOUBLE * da END, CASE WHEN db > 0 THEN coverage_b::DOUBLE * db END) >= 0.5"),
        "directed_links": w(_COVER, """SELECT subject, other, round(c::DOUBLE, 6) AS coverage, round(c::DOUBLE * d, 4) AS matched_seconds FROM
            (SELECT a AS subject, b AS other, coverage_a AS c, da AS d FROM mt UNION ALL SELECT b, a, coverage_b, db FROM mt)"""),
        "components": "WITH RECURSIVE" + _COVER + """, e AS (SELECT a, b FROM mt UNION SELECT b, a FROM mt),
            r AS (SELECT a AS node, a AS other FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.other)
            SELECT node, min(other) AS component FROM r GROUP BY node""",
        "group_maxima": w(PARTS, f"SELECT group_no, media_id, resolution, bitrate, quality, max_duration, max_resolution, max_quality, max_size FROM {_tiers('mem', 'group_no')}"),
        "tiers": w(PARTS, f"SELECT group_no, media_id, tier_length, tier_resolution, tier_quality, tier_size FROM {_tiers('mem', 'group_no')}"),
        "tiers_unmeasured": w(PARTS_UNMEASURED, f"SELECT group_no, media_id, tier_length, tier_resolution, tier_quality, tier_size FROM {_tiers('mem', 'group_no')}"),
        "find_best_unmeasured": w(PARTS_UNMEASURED, " UNION ALL ".join(f"SELECT '{m}' AS priority, group_no, best FROM {_fold(_tiers('mem', 'group_no'), 'group_no', m)}" for m in K.METRICS)),
        "codec_standoff": w(_decide("length"), "SELECT DISTINCT group_no, media_id FROM st"),
        "metric_shortfall": w(_decide("size"), "SELECT group_no, media_id FROM sf"),
        "fates": w(_decide("length"), "SELECT media_id, action FROM ft"),
        "unmeasured_review": w(_decide("length", PARTS_UNMEASURED, _fold), "SELECT DISTINCT group_no, media_id FROM um"),
        "fates_unmeasured": w(_decide("length", PARTS_UNMEASURED, _fold), "SELECT media_id, action FROM ft"),
        "reclaimable": w(_decide("length"), """SELECT (SELECT count(DISTINCT group_no) FROM mem) AS groups, count(*) AS files, count(*) FILTER (action = 'DELETE') AS delete_count,
            coalesce(sum(file_size) FILTER (action = 'DELETE'), 0)::BIGINT AS reclaimable_bytes FROM ft JOIN pm USING (media_id)"""),
        "strongest_link": w(f"{PARTS},{LINKS}", "SELECT group_no, subject, other, round(matched_seconds, 4) AS matched_seconds FROM gl WHERE rank = 1"),
        "ranked_links": w(f"{PARTS},{LINKS}", "SELECT group_no, subject, other, other_path, round(matched_seconds, 4) AS matched_seconds, rank::INTEGER AS rank FROM gl"),
        "report_rows": w(f"{_decide('length')},{LINKS}", _report_cells()),
        "report_json": w(f"{_decide('length')},{LINKS}", f"""SELECT 'group_' || m.group_no AS "group", m.pos, action, {_two('duration')} AS length_seconds, width, round(frame_rate, 3) AS framerate_fps, file_size AS size_bytes,
            bitrate AS bitrate_bps, {_quality("quality")} AS quality, nullif(quality, 0) AS quality_bits_per_frame, b.other_path AS matched_with, coalesce(n_samples, 0) AS samples, m.path AS full_path,
            {_two('b.matched_seconds')} AS matched_seconds, {_clock('b')}, (g.rank - 1)::INTEGER AS n, g.other_path AS link_full_path, {_two('g.matched_seconds')} AS link_matched_seconds, {_clock('g', 'link_')}
            FROM mem m JOIN ft USING (media_id) LEFT JOIN gl b ON b.group_no = m.group_no AND b.subject = m.media_id AND b.rank = 1 LEFT JOIN gl g ON g.group_no = m.group_no AND g.subject = m.media_id
            LEFT JOIN (SELECT l_partkey AS media_id, count(*) AS n_samples FROM lineitem GROUP BY 1) c ON c.media_id = m.media_id"""),
        "format_functions": f"""WITH o AS (SELECT o_orderkey, o_orderstatus, floor(o_totalprice * (1 + o_orderkey % 2000))::BIGINT AS n, o_totalprice / (1 + o_orderkey % 4000) AS s,
              o_orderkey % 70 + CASE o_orderkey % 3 WHEN 0 THEN 0.004::DOUBLE WHEN 1 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END AS r FROM orders)
            SELECT o_orderkey, {_size("n")} AS size, {_bitrate("n")} AS bitrate, {_quality("n")} AS quality, {_duration("s")} AS duration, {_shared("s")} AS shared, {_fps("r")} AS fps,
              CASE WHEN o_orderkey % 2 = 0 THEN '-' ELSE o_orderstatus END AS codec, CASE WHEN o_orderkey % 5 <> 0 THEN printf('%.2f', floor(s)) ELSE '' END AS cell FROM o""",
        "replay_verdicts": """WITH r AS (SELECT o_orderkey AS k,
              CASE o_orderkey % 7 WHEN 0 THEN ' DELETE ' WHEN 1 THEN 'keep' WHEN 2 THEN 'Zap' WHEN 3 THEN '' ELSE 'delete' END AS action,
              CASE o_orderkey % 11 WHEN 0 THEN '  ' WHEN 1 THEN 'rel/' || o_orderkey WHEN 2 THEN '/a/../' || o_orderkey ELSE '/f/' || (o_orderkey % 4000) END AS path,
              CASE o_orderkey % 13 WHEN 0 THEN '12x' WHEN 1 THEN '' WHEN 2 THEN '-4' ELSE ' ' || (o_orderkey * 3) || ' ' END AS size FROM orders),
            q AS (SELECT k, path, lower(trim(action)) AS act, CASE WHEN trim(size) SIMILAR TO '[0-9]+' THEN trim(size)::BIGINT END AS n FROM r),
            v AS (SELECT *, CASE WHEN act = '' THEN NULL WHEN act = 'zap' THEN 'action' WHEN act <> 'delete' THEN NULL WHEN trim(path) = '' THEN 'no full_path'
              WHEN NOT starts_with(path, '/') THEN 'is not an absolute path' WHEN contains(path, '/../') THEN 'contains a ".." component' WHEN n IS NULL THEN 'unusable size_bytes' END AS reason FROM q),
            u AS (SELECT *, act = 'delete' AND reason IS NULL AS go FROM v),
            x AS (SELECT *, row_number() OVER (PARTITION BY path, go ORDER BY k) AS rn FROM u),
            y AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'unusable' WHEN NOT go THEN 'ignore' WHEN rn > 1 THEN 'repeat' ELSE 'delete' END AS verdict FROM x)
            SELECT k AS row_no, verdict, reason, CASE WHEN verdict = 'delete' THEN n END AS bytes FROM y""",
        "extension_filter": w(_FILES, """SELECT request_pos, path, ext AS extension FROM (SELECT *, lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+\\.([^.]*)$', 1)) AS ext FROM pf)
            WHERE ext IN ('html', 'htm') OR request_pos % 10 = 0"""),
        "exclude_components": w(_FILES, """, ex AS (SELECT DISTINCT regexp_replace(array_to_string(string_split(path, '/')[1:3], '/'), '/+$', '') AS p FROM pf WHERE request_pos % 9 = 0)
            SELECT request_pos, path FROM pf WHERE NOT EXISTS (SELECT 1 FROM ex WHERE path = p OR starts_with(path, p || '/'))"""),
        "alias_dedup": w(_FILES, "SELECT request_pos, path, dev, ino FROM pf QUALIFY row_number() OVER (PARTITION BY dev, ino ORDER BY request_pos, path) = 1"),
        "probe_gate": w(_FILES, "SELECT request_pos, false AS media, least(strlen(html), CASE WHEN starts_with(html, '<') OR starts_with(html, '#') THEN 16384 ELSE 2048 END)::BIGINT AS probed FROM pf"),
        "common_parent": w(_FILES, """, s AS (SELECT request_pos % 60 AS k, string_split(path, '/')[:-2] AS f FROM pf),
            e AS (SELECT k, min(f) AS lo, max(f) AS hi FROM s GROUP BY k),
            n AS (SELECT k, lo, len(list_filter(range(1, len(lo) + 1), lambda i: lo[1:i] = hi[1:i])) AS n FROM e)
            SELECT k, CASE WHEN n = 0 THEN NULL WHEN array_to_string(lo[1:n], '/') = '' THEN '/' ELSE array_to_string(lo[1:n], '/') END AS parent FROM n"""),
        "cache_lookup": w(f"{_stamps('y', 3)},{_stamps('x', 0)}", f""", en AS (SELECT x.*, CASE o_orderkey % 6 WHEN 0 THEN 'refused' WHEN 1 THEN 'short' ELSE 'media' END AS kind, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE 9 END AS samples, o_orderkey % 50 AS d FROM x WHERE o_orderkey % 5 <> 0)
            SELECT y.path, CASE WHEN kind = 'media' THEN CASE WHEN samples > 0 THEN CASE WHEN d > 0 AND d < 10 THEN 'short' ELSE 'hit' END ELSE 'miss' END
              WHEN kind = 'refused' THEN 'refused' WHEN kind = 'short' AND d > 0 AND d < 10 THEN 'short' ELSE 'miss' END AS status FROM y LEFT JOIN en x ON x.path = y.path AND {_SAME}"""),
        "cache_prune": "SELECT '/c/' || c_custkey AS path FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')",
        "stamp_match": w(f"{_stamps('y', 3)},{_stamps('x', 0)}", f"SELECT y.path, {_SAME} AS same FROM x JOIN y USING (path)"),
        "tally_top20": """WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events)
            SELECT event_type AS category, count(*) AS count, string_agg('event ' || event_id, ';' ORDER BY event_id) FILTER (n <= 20) AS samples FROM r GROUP BY 1""",
        "transient_errors": f"SELECT o_orderkey, o_orderkey % 130 IN ({', '.join(map(str, K.TRANSIENT_ERRNO))}) AS transient FROM orders",
        "decode_weight": w(_JOBS, "SELECT media_id, weight, (CASE WHEN px > 0 AND m IS NOT NULL THEN floor(greatest(m::DOUBLE * px * cost, 1.0)) ELSE greatest(floor(size * 3.8::DOUBLE), 1) END)::BIGINT AS sampled_weight FROM jw"),
        "total_work": w(_JOBS, "SELECT sum(weight)::BIGINT AS total, count(*) AS jobs FROM jw"),
        "thread_share": """WITH o AS (SELECT o_orderkey, o_custkey AS w, CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE o_orderkey % 5000 END AS q, (o_orderkey % 21)::INTEGER AS f FROM orders),
            x AS (SELECT *, f * w::DOUBLE / (w::DOUBLE + q::DOUBLE) AS e FROM o)
            SELECT o_orderkey, (CASE WHEN f = 0 THEN 0 WHEN q = 0 THEN least(f, 16) ELSE least(greatest(CASE WHEN e > 1 THEN greatest(floor(e + 0.5), 2) ELSE floor(e + 0.5) END, 1), least(f, 16)) END)::INTEGER AS threads FROM x""",
        "runtime_filter": "WITH m AS (SELECT p_partkey AS media_id, CASE WHEN p_partkey % 17 = 0 THEN 0.0::DOUBLE ELSE 60.0::DOUBLE + (p_partkey % 7) * 0.4::DOUBLE END AS duration FROM part) SELECT * FROM m WHERE NOT (duration > 0 AND duration < 61.0)",
        "frame_rate_rules": """SELECT o_orderkey, round(CASE WHEN o_totalprice / 100 - 100 > 0 AND o_totalprice / 100 - 100 <= 1000 THEN o_totalprice / 100 - 100 ELSE 0.0 END, 4)::DOUBLE AS rate,
            round(CASE WHEN o_orderkey % 3 = 0 THEN 0.0::DOUBLE ELSE o_custkey::DOUBLE / (o_orderkey % 3) END, 4) AS ratio,
            (CASE WHEN o_orderkey % 2 > 0 THEN o_orderkey % 2 WHEN o_custkey % 3 > 0 THEN o_custkey % 3 ELSE 0 END)::DOUBLE AS runtime FROM orders""",
        "probe_mask_counts": """WITH RECURSIVE b(r, n) AS (SELECT 0, 1::BIGINT UNION ALL SELECT r + 1, n * (16 - r) // (r + 1) FROM b WHERE r < 8)
            SELECT r::INTEGER AS radius, sum(n) OVER (ORDER BY r)::BIGINT AS masks FROM b""",
        "witness_schedule": """WITH RECURSIVE b(d, c, s) AS (SELECT 0, 1.0::DOUBLE, 1.0::DOUBLE UNION ALL SELECT d + 1, c * (64 - d) / (d + 1), s + c * (64 - d) / (d + 1) FROM b WHERE d < 64),
            e AS (SELECT d, 64 * log10(2.0::DOUBLE) - log10(s) AS e FROM b),
            m AS (SELECT d, min(k) AS k FROM e, range(2, 65) AS t(k) WHERE k * e >= 2 * (SELECT e FROM e WHERE d = 12) - 1e-9 GROUP BY d)
            SELECT e.d::INTEGER AS distance, (k - 1)::INTEGER AS witnesses FROM e LEFT JOIN m USING (d)""",
    }
    for m in K.METRICS:
        out[f"find_best_{m}"] = w(PARTS, f"SELECT group_no, best FROM {_best(_tiers('mem', 'group_no'), 'group_no', m)}")
    direct = w(FRAMES, """, samples AS (SELECT vec_id // 10 AS media_id, (vec_id % 10)::INTEGER AS idx, hash, vec_id % 10 * 1000 AS t_start FROM fh),""" + _pairs(18) + "\nSELECT * FROM fx")
    out |= {"hamming_direct": direct, "hamming_index": direct}
    return out
