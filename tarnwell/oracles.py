"""DuckDB SQL that gives the results of the queries in ``queries``; written by hand, not derived from them."""

from __future__ import annotations

from tarnwell import moments_sql, nested_sql
from tarnwell.state_queries import _LINKS
from tarnwell.state_queries import ORACLES as _STATE

_I = "i AS (SELECT * FROM images WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1)"
_TRIM = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_CLASS = f"lower({_TRIM.format('class')})"
_B = f"""b AS (SELECT DISTINCT ON (id) id, image_id, {_CLASS} AS class, confidence FROM detections
    WHERE id IS NOT NULL AND image_id IS NOT NULL AND {_CLASS} <> '' AND confidence IS NOT NULL)"""
_SAID = f"""CASE lower({_TRIM}) WHEN 'present' THEN 'present' WHEN 'yes' THEN 'present' WHEN 'true' THEN 'present' WHEN 'absent' THEN 'absent'
    WHEN 'no' THEN 'absent' WHEN 'false' THEN 'absent' WHEN 'none' THEN 'absent' ELSE 'unsure' END"""
_V = f"""v AS (SELECT image_id, {_CLASS} AS class, {_SAID.format('verdict')} AS verdict, coalesce(confidence, 0) AS verdict_confidence
    FROM adjudications WHERE image_id IS NOT NULL AND {_CLASS} <> ''
    QUALIFY row_number() OVER (PARTITION BY image_id, {_CLASS} ORDER BY created_at DESC, id DESC) = 1)"""
_BANDS = """band AS (SELECT * FROM (VALUES ('cat', 0.65::DOUBLE, 0.35::DOUBLE, true), ('dog', 0.5, 0.3, false), ('person', 0.6, 0.35, true),
    ('car', 0.65, 0.35, true), ('bus', 0.65, 0.35, true), ('bicycle', 0.4, 0.35, true)) t(class, high, low, second))"""


def _decisions(boxes: str, ids: str) -> str:
    """CTEs ``e`` (evidence), ``r`` (doubt) and ``d`` (decisions) of the boxes and image ids in two tables."""
    n = lambda cls, x: f"count(*) FILTER (WHERE {f'class = {cls!r} AND ' if cls else ''}confidence >= {x})"
    return f"""
e AS (SELECT image_id, {n('cat', 0.65)} AS cat65, {n('dog', 0.5)} AS dog50, {n('person', 0.6)} AS person60, {n('person', 0.65)} AS person65,
    {n('car', 0.65)} AS car65, {n('bus', 0.65)} AS bus65, {n('bicycle', 0.4)} AS bicycle40, {n(None, 0.2)} AS any20, {n(None, 0.65)} AS any65
    FROM {boxes} GROUP BY image_id),
top AS (SELECT image_id, class, max(confidence) AS best FROM {boxes} GROUP BY ALL),
r AS (SELECT image_id, max((best >= coalesce(low, 0.35) AND best < coalesce(high, 0.65))::INT) AS doubt FROM top LEFT JOIN band USING (class) GROUP BY image_id),
f AS (SELECT x.image_id, coalesce(r.doubt, 0) AS needs_review, CASE
    WHEN coalesce(cat65, 0) >= 1 AND coalesce(dog50, 0) >= 1 THEN 'pets'
    WHEN coalesce(person60, 0) >= 3 THEN 'crowd'
    WHEN (coalesce(car65, 0) >= 1 OR coalesce(bus65, 0) >= 1 OR coalesce(bicycle40, 0) >= 1) AND NOT coalesce(person65, 0) >= 1 THEN 'street'
    WHEN coalesce(cat65, 0) >= 1 THEN 'cat' WHEN NOT coalesce(any20, 0) >= 1 THEN 'quiet' WHEN coalesce(any65, 0) >= 4 THEN 'busy' ELSE 'rest' END AS category
    FROM {ids} x LEFT JOIN e USING (image_id) LEFT JOIN r USING (image_id)),
d AS (SELECT image_id, category, CASE category WHEN 'crowd' THEN 'move' WHEN 'quiet' THEN 'ignore' WHEN 'busy' THEN 'delete' WHEN 'rest' THEN 'ignore' ELSE 'copy' END AS action,
    needs_review FROM f)"""


_ADJUDICATED = """
j AS (SELECT b.*, v.verdict, v.verdict_confidence, coalesce(high, 0.65) AS high, confidence < coalesce(high, 0.65) AS weak
    FROM b LEFT JOIN v USING (image_id, class) LEFT JOIN band USING (class)),
k AS (SELECT *, row_number() OVER (PARTITION BY image_id, class, weak ORDER BY confidence DESC, id) AS nth FROM j),
a AS (SELECT id, image_id, class, CASE WHEN weak AND verdict = 'present' AND nth = 1 THEN greatest(high, verdict_confidence) ELSE confidence END AS confidence
    FROM k WHERE NOT (weak AND coalesce(verdict, '') = 'absent'))"""
_ALL = f"ids AS (SELECT id AS image_id FROM i)"
_DECIDED = f"WITH {_I}, {_B}, {_BANDS}, {_ALL}, {_decisions('b', 'ids')}"
_RECHECKED = f"WITH {_I}, {_B}, {_V}, {_BANDS}, {_ADJUDICATED}, ids AS (SELECT id AS image_id FROM i WHERE missing = 0 AND deleted = 0 AND detect_state = 2), {_decisions('a', 'ids')}"

_READY = {
    "detect": "coalesce(missing = 0, false)",
    "adjudicate": "detect_state = 2 AND needs_review = 1 AND missing = 0 AND deleted = 0",
    "analyze": "detect_state = 2 AND adjudicate_state NOT IN (0, 1) AND missing = 0 AND deleted = 0 AND action IS NOT NULL AND action <> 'ignore'",
}
_COUNTS = ", ".join(
    f"count(*) FILTER (WHERE {s}_state = 0 AND {r}) AS {s}_pending, count(*) FILTER (WHERE {s}_state = 2) AS {s}_done, count(*) FILTER (WHERE {s}_state = 3) AS {s}_error"
    for s, r in _READY.items()
)

# Steps as the rules above plan them: the doubt rule moves, so a doubtful image has no step of its own rule.
_STEPS = f"""{_DECIDED},
s AS (SELECT i.id AS image_id, i.path, i.filename, d.action AS own, d.category, d.needs_review FROM i JOIN d ON d.image_id = i.id
    WHERE missing = 0 AND deleted = 0 AND detect_state = 2 AND d.category IN ('pets', 'crowd', 'street', 'cat', 'quiet', 'busy', 'rest')),
t AS (SELECT image_id, path, filename, CASE WHEN needs_review = 1 THEN 0 ELSE 1 END AS seq, CASE WHEN needs_review = 1 THEN 'move' ELSE own END AS action,
    CASE WHEN needs_review = 1 THEN '_Review' WHEN category = 'crowd' THEN 'People' ELSE upper(category[1]) || category[2:] END AS folder FROM s),
w AS (SELECT *, '/out/' || folder AS directory, row_number() OVER (PARTITION BY folder, filename ORDER BY image_id, seq) AS nth FROM t WHERE action IN ('copy', 'move')),
p AS (
    SELECT image_id, seq, action, path AS source, directory || '/' || CASE WHEN nth = 1 THEN filename
        ELSE regexp_replace(filename, '^(.+?)(\\.[^.]*)?$', '\\1_' || image_id || '\\2') END AS target FROM w
    UNION ALL SELECT image_id, seq, action, path, '/trash/' || CASE WHEN path LIKE '/lib/%' THEN path[6:] ELSE regexp_extract(path, '[^/]*$') END FROM t WHERE action = 'delete'),
plan AS (SELECT * FROM p WHERE NOT (action = 'move' AND target = source))"""

_META = "m AS (SELECT image_id, json FROM metadata WHERE image_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY created_at DESC) = 1)"
# The object of a reply, and its fields in the agreed shape.
_REPLY = f"""{_META}, w AS (SELECT image_id, CASE WHEN json_valid(trim(json)) THEN trim(json) ELSE regexp_extract(json, '(?s)\\{{.*\\}}', 0) END AS t FROM m),
o AS (SELECT image_id, t::JSON AS j FROM w WHERE json_valid(t) AND json_type(t) = 'OBJECT')"""


def _texts(field: str) -> str:
    bare = _TRIM.format("x")
    several = f"list_filter(list_transform(CAST(j->'$.{field}' AS VARCHAR[]), lambda x: {bare}), lambda x: x <> '')"
    one = f"list_filter([{_TRIM.format(f'(j->>{chr(39)}$.{field}{chr(39)})')}], lambda x: x <> '')"
    return f"CASE json_type(j, '$.{field}') WHEN 'ARRAY' THEN {several} WHEN 'VARCHAR' THEN {one} ELSE [] END"


def _int(field: str) -> str:
    text = f"(j->>'$.{field}')"
    return f"CASE json_type(j, '$.{field}') WHEN 'BOOLEAN' THEN ({text} = 'true')::INT ELSE coalesce(trunc(TRY_CAST({text} AS DOUBLE))::INT, 0) END"


def _plain(field: str) -> str:
    return f"CASE WHEN json_type(j, '$.{field}') = 'VARCHAR' THEN {_TRIM.format(f'(j->>{chr(39)}$.{field}{chr(39)})')} ELSE '' END"


def _shown(field: str) -> str:
    return f"array_to_string({_texts(field)}, ', ')"


_COERCED = ", ".join(
    [f"{_int(f'{c}_count')} AS {c}_count, array_to_string({_texts(f'{c}_kinds')}, '|') AS {c}_kinds" for c in ("bird", "cat", "dog")]
    + [f"array_to_string({_texts('activities')}, '|') AS activities", f"{_plain('environment')} AS environment", f"{_plain('notes')} AS notes"]
    + [f"greatest(0, least(10, {_int('quality')})) AS quality"]
    + ["CASE json_type(j, '$.is_main_subject') WHEN 'BOOLEAN' THEN (j->>'$.is_main_subject') = 'true' WHEN 'VARCHAR' THEN (j->>'$.is_main_subject') <> '' ELSE false END AS is_main_subject"]
)
_BITS = "h AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS s FROM embeddings)"
_FAR = "list_sum(list_transform(list_zip(a.s, b.s), lambda z: (z[1] <> z[2])::INT))"
_NEAR = f"{_BITS}, pairs AS (SELECT a.vec_id AS a, b.vec_id AS b, {_FAR} AS distance FROM h a JOIN h b ON a.vec_id < b.vec_id WHERE {_FAR} <= 18)"
# Components, then keepers one by one: each step takes the best of what is left of every component and all that is near it.
_PEELED = """edge AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach(a, b) AS (SELECT a, a FROM edge UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
label AS (SELECT a AS id, min(b) AS component FROM reach GROUP BY a),
peel(component, id, s, pixels, keeper, apart) AS (
    SELECT component, id, s, (id % 7) * 10, NULL::BIGINT, NULL::BIGINT FROM label JOIN h ON vec_id = id
    UNION ALL SELECT component, id, s, pixels, CASE WHEN far <= 18 THEN best END, far FROM (
        SELECT *, list_sum(list_transform(list_zip(s, bs), lambda z: (z[1] <> z[2])::INT))::BIGINT AS far FROM (
            SELECT *, first_value(id) OVER w AS best, first_value(s) OVER w AS bs FROM peel WHERE keeper IS NULL WINDOW w AS (PARTITION BY component ORDER BY pixels DESC, id)))),
members AS (SELECT component, keeper, id, round_even((64 - apart) * 100.0::DOUBLE / 64, 1) AS similarity FROM peel WHERE keeper IS NOT NULL QUALIFY count(*) OVER (PARTITION BY component, keeper) > 1)"""
_VIDEO = "regexp_matches(lower(path), '[^/]\\.(mp4|mov|m4v|avi|mkv|webm|3gp|3g2|mpg|mpeg|wmv)$')"

ORACLES = {
    "decide_first_match": f"{_DECIDED} SELECT image_id, category, action FROM d",
    "needs_review": f"{_DECIDED} SELECT image_id, needs_review FROM d",
    "uncertain_classes": f"""WITH {_B}, {_BANDS}, top AS (SELECT image_id, class, max(confidence) AS best FROM b GROUP BY ALL)
        SELECT image_id, string_agg(class, ',' ORDER BY class) AS classes FROM top LEFT JOIN band USING (class)
        WHERE best >= coalesce(low, 0.35) AND best < coalesce(high, 0.65) AND coalesce(second, true) GROUP BY image_id""",
    "class_bands": f"WITH {_BANDS} SELECT class, high AS confidence, low AS review_confidence, second AS second_opinion FROM band",
    "adjudicated_detections": f"WITH {_B}, {_V}, {_BANDS}, {_ADJUDICATED} SELECT id, image_id, class, confidence FROM a",
    "recheck": f"{_RECHECKED} SELECT * FROM d",
    "recheck_tally": f"{_RECHECKED} SELECT category, action, count(*) AS n, sum(needs_review)::BIGINT AS doubtful FROM d GROUP BY ALL",
    "merge_frames": """WITH f AS (SELECT user_id AS file_id, event_id % 8 AS frame, event_id AS seq, event_type AS class, least(value, 100) / 100 AS confidence FROM events),
        g AS (SELECT file_id, class, frame, count(*) AS n, max(confidence) AS top FROM f GROUP BY ALL),
        best AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY file_id, class ORDER BY n DESC, top DESC, frame) = 1)
        SELECT f.* FROM f JOIN best USING (file_id, class, frame)""",
    "frames_by_strength": """WITH f AS (SELECT user_id AS file_id, event_id % 8 AS frame, event_id AS seq, event_type AS class, least(value, 100) / 100 AS confidence FROM events),
        g AS (SELECT file_id, class, frame, count(*) AS n, max(confidence) AS top FROM f GROUP BY ALL),
        best AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY file_id, class ORDER BY n DESC, top DESC, frame) = 1)
        SELECT file_id, class, row_number() OVER (PARTITION BY file_id ORDER BY n DESC, top DESC, class)::INT - 1 AS place FROM best""",
    "video_boxes": f"""WITH {_I}, {_B}, x AS (SELECT class, confidence FROM b UNION ALL SELECT 'video', 1.0 FROM i WHERE {_VIDEO})
        SELECT class, count(*) AS n, max(confidence) AS top FROM x GROUP BY class""",
    "frame_positions": """SELECT p_partkey, array_to_string(list_transform(range(0, least(8, p_size)), lambda i: floor(p_size * (i + 0.5::DOUBLE) / 8)::INT), ',') AS frames, floor(p_size * 0.5::DOUBLE)::INT AS middle FROM part""",
    "pipeline_counts": f"""WITH {_I}, {_LINKS} SELECT count(*) FILTER (WHERE missing = 0) AS total, count(*) FILTER (WHERE missing = 1) AS missing, count(*) FILTER (WHERE deleted = 1) AS deleted, {_COUNTS},
        count(*) FILTER (WHERE detect_state = 2 AND missing = 0 AND deleted = 0 AND (needs_review = 1 OR adjudicate_state IN (2, 3))) AS adjudicate_total,
        count(*) FILTER (WHERE detect_state = 2 AND missing = 0 AND deleted = 0 AND action IS NOT NULL AND action <> 'ignore') AS analyze_total,
        count(*) FILTER (WHERE needs_review = 1 AND missing = 0) AS review, (SELECT count(*) FROM l) AS links_total FROM i""",
    "category_counts": f"WITH {_I} SELECT coalesce(category, 'unprocessed') AS category, count(*) AS n FROM i WHERE missing = 0 GROUP BY 1",
    "action_counts": f"WITH {_I} SELECT action, count(*) AS n FROM i WHERE missing = 0 AND action IS NOT NULL GROUP BY 1",
    "class_counts": f"WITH {_B} SELECT class, count(*) AS n FROM b GROUP BY 1",
    "verdict_counts": f"WITH {_V} SELECT verdict, count(*) AS n FROM v GROUP BY 1",
    "distinct_roots": f"WITH {_I} SELECT DISTINCT root FROM i",
    "exact_duplicates": f"WITH {_I} SELECT hash, count(*) OVER (PARTITION BY hash) AS n, path FROM i WHERE missing = 0 AND hash IS NOT NULL QUALIFY n > 1",
    "duplicate_listing": f"""WITH {_I} SELECT hash, count(*) AS n, string_agg(path, chr(10) ORDER BY path) AS paths FROM i WHERE missing = 0 AND hash IS NOT NULL
        GROUP BY hash HAVING count(*) > 1 ORDER BY n DESC, hash LIMIT 20""",
    "document_duplicates": "SELECT sha256(text) AS hash, count(*) OVER (PARTITION BY text) AS n, doc_id::VARCHAR AS path FROM documents WHERE text IS NOT NULL QUALIFY n > 1",
    "hamming_pairs": f"WITH {_NEAR} SELECT a, b, distance, round_even((64 - distance) * 100.0::DOUBLE / 64, 1) AS similarity FROM pairs",
    "similarity_components": f"""WITH RECURSIVE {_NEAR}, edge AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
        reach(a, b) AS (SELECT a, a FROM edge UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a)
        SELECT a AS id, min(b) AS component FROM reach GROUP BY a""",
    "duplicate_groups": f"WITH RECURSIVE {_NEAR}, {_PEELED} SELECT * FROM members",
    "largest_groups": f"""WITH RECURSIVE {_NEAR}, {_PEELED}, g AS (SELECT component, keeper, count(*) AS n, min(similarity) AS least FROM members GROUP BY ALL ORDER BY n DESC, least DESC, keeper LIMIT 10)
        SELECT m.keeper, n, least, row_number() OVER (PARTITION BY m.keeper ORDER BY similarity DESC, 'f' || (m.id % 10), m.id)::INT AS place, m.id, CASE WHEN m.id % 3 = 0 THEN 'keep' END AS mark
        FROM members m JOIN g USING (component, keeper)""",
    "dhash_bits": """WITH p AS (SELECT vec_id, list_concat(embedding, embedding[1:8]) AS px FROM embeddings),
        n AS (SELECT vec_id, list_transform(range(0, 16), lambda k: list_sum(list_transform(range(0, 4), lambda q:
            ((px[((4 * k + q) // 8) * 9 + (4 * k + q) % 8 + 1] > px[((4 * k + q) // 8) * 9 + (4 * k + q) % 8 + 2])::INT * (1 << (3 - q)))))) AS hx FROM p)
        SELECT vec_id, array_to_string(list_transform(hx, lambda x: '0123456789abcdef'[x::INT + 1]), '') AS dhash FROM n""",
    "sync_queues": f"""WITH {_I}, q AS (SELECT id, action, detect_state, analyze_state, CASE
        WHEN detect_state = 2 AND adjudicate_state = 4 AND needs_review = 1 AND missing = 0 AND deleted = 0 THEN 0
        WHEN detect_state = 2 AND adjudicate_state = 0 AND needs_review = 0 THEN 4 ELSE adjudicate_state END AS adjudicate_state FROM i)
        SELECT id, adjudicate_state, CASE WHEN detect_state = 2 AND analyze_state = 0 AND adjudicate_state NOT IN (0, 1) AND coalesce(action, 'ignore') = 'ignore'
        THEN 4 ELSE analyze_state END AS analyze_state FROM q""",
    "retry_count": f"WITH {_I} SELECT sum((detect_state = 3)::BIGINT + (adjudicate_state = 3)::BIGINT + (analyze_state = 3)::BIGINT)::BIGINT AS n FROM i",
    "stale_detections": f"WITH {_I}, {_B} SELECT class, count(*) AS n FROM b WHERE image_id IN (SELECT id FROM i WHERE needs_review = 1) GROUP BY class",
    "plan_actions": f"{_STEPS} SELECT * FROM plan",
    "dry_run_counts": f"{_STEPS} SELECT action, count(*) AS n FROM plan GROUP BY action",
    "prune_links": f"{_STEPS}, {_LINKS} SELECT * FROM l WHERE NOT EXISTS (SELECT 1 FROM plan WHERE action = 'copy' AND target = link_path AND plan.image_id = l.image_id)",
    "existing_links": f"{_STEPS}, {_LINKS} SELECT DISTINCT target AS link_path, plan.image_id FROM plan JOIN l ON target = link_path AND plan.image_id = l.image_id WHERE action = 'copy'",
    "apply_tally": f"""{_STEPS}, {_LINKS} SELECT CASE WHEN action = 'copy' AND link_path IS NOT NULL THEN 'existing' WHEN t.path IS NULL THEN 'skipped' WHEN action = 'copy' THEN 'created' ELSE 'done' END AS outcome,
        action, count(*) AS n FROM plan LEFT JOIN l ON target = link_path AND plan.image_id = l.image_id LEFT JOIN (SELECT DISTINCT path FROM i WHERE size > 0) t ON t.path = source GROUP BY ALL""",
    "plan_preview": f"{_STEPS} SELECT action, source, target FROM plan ORDER BY image_id, seq LIMIT 50",
    "starter_decisions": f"""WITH {_I}, {_B}, x AS (SELECT image_id, class, confidence FROM b UNION ALL SELECT id, 'video', 1.0 FROM i WHERE {_VIDEO}),
        s AS (SELECT DISTINCT image_id, class FROM x WHERE confidence >= 0.65), h AS (SELECT id AS image_id, id IN (SELECT image_id FROM s WHERE class = 'cat') AS cat,
        id IN (SELECT image_id FROM s WHERE class = 'dog') AS dog, id IN (SELECT image_id FROM s WHERE class = 'video') AS video FROM i)
        SELECT image_id, CASE WHEN cat AND dog THEN 'cat-dog' WHEN cat THEN 'cat' WHEN dog THEN 'dog' WHEN video THEN 'video' ELSE 'none' END AS category,
        CASE WHEN cat OR dog THEN 'copy' WHEN video THEN 'move' ELSE 'ignore' END AS action FROM h""",
    "rule_outcomes": """SELECT * FROM (VALUES
        ('starter', 'cat-dog,cat,dog,video,none,in-doubt', 'cat,dog,video', 0.35::DOUBLE, true, 'Cat-Dog,Cat,Dog,video,None,_Review', 0, true),
        ('moved', 'dog,cat-dog,cat,video,none,in-doubt', 'cat,dog,video', 0.35, true, 'Dog,Cat-Dog,Cat,video,None,_Review', 0, true),
        ('far', 'cat,dog,video,none,cat-dog,in-doubt', 'cat,dog,video', 0.35, true, 'Cat,Dog,video,None,Cat-Dog,_Review', 0, true),
        ('all kinds', 'pets,crowd,street,cat,off,quiet,busy,rest,in-doubt', 'bicycle,bus,car,cat,dog,person', 0.3, true, 'Pets,People,Street,Cat,Off,Quiet,Busy,Rest,_Review', 0, true),
        ('none', 'in-doubt', '', 0.35, false, '_Review', 0, true),
        ('bad', 'x,in-doubt', 'unicorn', 0.35, true, 'X,_Review', 4, true)) t(name, rules, classes, floor, asks, folders, problems, round_trip)""",
    "search_metadata": f"WITH {_I}, {_META} SELECT i.id, path, category FROM m JOIN i ON i.id = m.image_id WHERE missing = 0 AND lower(json) LIKE '%kitchen%'",
    "coerce_reply": f"WITH {_REPLY} SELECT image_id, {_COERCED} FROM o",
    "json_highlights": f"""WITH {_REPLY}, k AS (SELECT image_id, list_filter([CASE WHEN len({_texts('cat_kinds')}) > 0 THEN 'cat: ' || {_shown('cat_kinds')} END,
        CASE WHEN len({_texts('dog_kinds')}) > 0 THEN 'dog: ' || {_shown('dog_kinds')} END, CASE WHEN len({_texts('activities')}) > 0 THEN {_shown('activities')} END],
        lambda x: x IS NOT NULL) AS l FROM o) SELECT m.image_id, coalesce(array_to_string(l, '; '), '') AS highlights FROM m LEFT JOIN k USING (image_id)""",
    "parse_verdict": f"""WITH x AS (SELECT DISTINCT ON (id) * FROM adjudications)
        SELECT id, 'cat' AS class, {_SAID.format('verdict')} AS verdict, greatest(0, least(1, coalesce(confidence, 0))) AS confidence FROM x""",
    "history": f"WITH {_I} SELECT event_id AS id, event_type AS action, props::VARCHAR AS detail, path FROM events JOIN i ON i.id = user_id ORDER BY event_id DESC LIMIT 30",
    "samples": f"WITH {_I} SELECT id, path, filename, category, action, needs_review FROM i WHERE missing = 0 AND deleted = 0 AND category IS NOT NULL ORDER BY id LIMIT 60",
    "export_records": f"""WITH {_I}, {_B}, {_META}, x AS (SELECT image_id, count(*) AS boxes, max(confidence) AS top FROM b GROUP BY image_id)
        SELECT i.id, path, category, m.json AS metadata, coalesce(boxes, 0)::INT AS boxes, top FROM i LEFT JOIN m ON m.image_id = i.id LEFT JOIN x ON x.image_id = i.id WHERE missing = 0""",
    "export_csv": f"""WITH {_I}, {_B}, {_META}, x AS (SELECT image_id, string_agg(class || ':' || printf('%.2f', confidence), ';' ORDER BY confidence DESC, id) AS ds FROM b GROUP BY image_id)
        SELECT i.id, path, category, needs_review, width, height, taken_at, coalesce(ds, '') AS detections, coalesce(m.json, '') AS metadata
        FROM i LEFT JOIN m ON m.image_id = i.id LEFT JOIN x ON x.image_id = i.id WHERE missing = 0""",
    "detection_hints": f"""WITH {_B}, {_BANDS} SELECT image_id, string_agg(class || ' (' || printf('%.0f', confidence * 100) || '%)', ', ' ORDER BY confidence DESC, id) AS hint
        FROM b LEFT JOIN band USING (class) WHERE confidence >= coalesce(high, 0.65) GROUP BY image_id""",
} | {f"claim_{s}": f"WITH {_I} SELECT id, path FROM i WHERE {s}_state = 0 AND {r} ORDER BY id LIMIT 32" for s, r in _READY.items()} | moments_sql.ORACLES | nested_sql.ORACLES | _STATE
