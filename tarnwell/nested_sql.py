"""DuckDB SQL for nested records: trees of JSON values walked by hand, not derived from the Spark functions."""

from __future__ import annotations

_BARE = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_OWN, _NAME = _BARE.format("(atom->>'$')"), _BARE.format("(f.atom->>'$')")


def _named(sql: str) -> str:
    return sql.replace("{own}", _OWN).replace("{name}", _NAME)


_NODES = _named(r"""m AS (SELECT image_id, json FROM metadata WHERE image_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY created_at DESC) = 1),
-- the text, or the text that it is in JSON, or what stands between its first and last brace
t0 AS (SELECT image_id, trim(json, chr(32) || chr(9) || chr(10) || chr(13) || chr(65279)) AS t FROM m),
t1 AS (SELECT image_id, CASE WHEN t LIKE '"%' AND json_valid(t) THEN t::JSON->>'$' ELSE t END AS t FROM t0),
t2 AS (SELECT image_id, CASE WHEN json_valid(t) THEN t ELSE regexp_extract(t, '(?s)\{.*\}', 0) END AS t FROM t1),
ok AS (SELECT image_id, t FROM t2 WHERE json_valid(t) AND NOT regexp_matches(t, '[:\[,]\s*-?(NaN|Infinity|nan|inf)|,\s*[\]}]')),
tree0 AS (SELECT image_id, x.id, x.parent, x.key, x.type, x.value, x.atom FROM ok, json_tree(t) x),
-- a text within that holds the record
inner_text AS (SELECT image_id, atom->>'$' AS s FROM tree0 WHERE type = 'VARCHAR' AND contains(atom, 'rames')
    AND image_id NOT IN (SELECT image_id FROM tree0 WHERE lower(key) = 'frames' AND type IN ('ARRAY', 'OBJECT', 'NULL'))),
t3 AS (SELECT image_id, CASE WHEN json_valid(s) THEN s ELSE regexp_extract(s, '(?s)\{.*\}', 0) END AS t FROM inner_text),
tree AS (SELECT * FROM tree0 WHERE image_id NOT IN (SELECT image_id FROM inner_text)
    UNION ALL SELECT image_id, x.id, x.parent, x.key, x.type, x.value, x.atom FROM t3, json_tree(t) x WHERE json_valid(t)),
lists AS (SELECT image_id, id, type, parent FROM tree WHERE lower(key) = 'frames' AND type IN ('ARRAY', 'OBJECT', 'NULL') QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY id) = 1),
frame AS (
    SELECT l.image_id, x.id, x.key::BIGINT AS frame_no FROM lists l JOIN tree x ON x.image_id = l.image_id AND x.parent = l.id WHERE l.type = 'ARRAY' AND x.type = 'OBJECT'
    UNION ALL SELECT image_id, id, 0 FROM lists WHERE type = 'OBJECT'),
subject_list AS (SELECT f.*, x.id AS list, x.type AS kind FROM frame f JOIN tree x ON x.image_id = f.image_id AND x.parent = f.id AND lower(x.key) = 'subjects'),
subject AS (
    SELECT s.image_id, x.id, frame_no, x.key::BIGINT AS subject_no FROM subject_list s JOIN tree x ON x.image_id = s.image_id AND x.parent = s.list WHERE kind = 'ARRAY' AND x.type = 'OBJECT'
    UNION ALL SELECT image_id, list, frame_no, 0 FROM subject_list WHERE kind = 'OBJECT'),
kind_list AS (SELECT s.*, x.id AS list, x.type AS kind, x.atom FROM subject s JOIN tree x ON x.image_id = s.image_id AND x.parent = s.id AND lower(x.key) = 'kinds'),
kind AS (
    SELECT k.image_id, x.id, frame_no, subject_no, x.key::BIGINT AS kind_no, x.type, x.atom FROM kind_list k JOIN tree x ON x.image_id = k.image_id AND x.parent = k.list WHERE kind = 'ARRAY'
    UNION ALL SELECT image_id, list, frame_no, subject_no, 0, kind, atom FROM kind_list WHERE kind IN ('OBJECT', 'VARCHAR')),
fields AS (SELECT image_id, parent AS id, lower(key) AS key, type, atom FROM tree),
nodes AS (
    SELECT image_id, 'frame' AS node_type, frame_no, -1 AS subject_no, -1 AS kind_no, '' AS node_name FROM frame
    UNION ALL SELECT s.image_id, 'subject', frame_no, subject_no, -1, coalesce(lower({name}), '') FROM subject s LEFT JOIN fields f ON f.image_id = s.image_id AND f.id = s.id AND f.key = 'class' AND f.type = 'VARCHAR'
    UNION ALL SELECT k.image_id, 'kind', frame_no, subject_no, kind_no, {name} FROM kind k JOIN fields f ON f.image_id = k.image_id AND f.id = k.id AND f.key = 'name' AND f.type = 'VARCHAR' WHERE k.type = 'OBJECT' AND {name} <> ''
    UNION ALL SELECT image_id, 'kind', frame_no, subject_no, kind_no, {own} FROM kind WHERE type = 'VARCHAR' AND {own} <> '')""")
# The states of fields, and with them the shape of every node.
_SHAPES = _named(r"""st AS (SELECT image_id, id, parent, lower(key) AS key, type, CASE WHEN type = 'VARCHAR' THEN 'text' WHEN type = 'BOOLEAN' THEN 'boolean' WHEN type = 'OBJECT' THEN 'object' WHEN type = 'ARRAY' THEN 'list' WHEN type <> 'NULL' THEN 'number' END AS s FROM tree),
el AS (SELECT image_id, parent AS id, string_agg(DISTINCT s, '|' ORDER BY s) || '*' AS s FROM st GROUP BY ALL),
typed AS (SELECT image_id, id, 'frame' AS node_type, 'subjects' AS child FROM frame UNION ALL SELECT image_id, id, 'subject', 'kinds' FROM subject
    UNION ALL SELECT k.image_id, k.id, 'kind', '' FROM kind k JOIN fields f ON f.image_id = k.image_id AND f.id = k.id AND f.key = 'name' AND f.type = 'VARCHAR' WHERE k.type = 'OBJECT' AND {name} <> ''),
own AS (SELECT t.*, f.id AS field, f.key, f.type, f.s, el.s AS items FROM typed t LEFT JOIN st f ON f.image_id = t.image_id AND f.parent = t.id LEFT JOIN el ON el.image_id = f.image_id AND el.id = f.id),
parts AS (
    SELECT image_id, id, node_type, key, CASE WHEN type = 'ARRAY' THEN items WHEN key = child THEN s || '*' ELSE s END AS s FROM own WHERE type <> 'OBJECT' OR type IS NULL OR key = child
    UNION ALL SELECT o.image_id, o.id, node_type, o.key || '.' || x.key, x.s FROM own o JOIN st x ON x.image_id = o.image_id AND x.parent = o.field WHERE o.type = 'OBJECT' AND o.key <> o.child),
shape AS (SELECT image_id, id, node_type, '{' || coalesce(string_agg(key || ': ' || s, ', ' ORDER BY key) FILTER (s IS NOT NULL), '') || '}' AS variant FROM parts GROUP BY ALL
    UNION ALL SELECT image_id, id, 'kind', 'text' FROM kind WHERE type = 'VARCHAR' AND {own} <> '')""")
_BOX = "max(TRY_CAST(x.atom->>'$' AS DOUBLE)) FILTER (o.key = 'box' AND lower(x.key) = '{0}' AND x.type NOT IN ('VARCHAR', 'NULL'))"

ORACLES = {
    "p5_found": f"WITH {_NODES} SELECT * FROM nodes",
    "p5_variants": f"WITH {_NODES}, {_SHAPES} SELECT node_type, variant, count(*) AS n FROM shape GROUP BY ALL",
    "p5_subjects": f"""WITH {_NODES}, {_SHAPES}, counted AS (SELECT s.image_id, s.id, frame_no, subject_no, TRY_CAST(f.atom->>'$' AS DOUBLE) AS count
        FROM subject s JOIN fields f ON f.image_id = s.image_id AND f.id = s.id AND f.key = 'count' AND f.type NOT IN ('VARCHAR', 'NULL', 'BOOLEAN', 'ARRAY', 'OBJECT'))
        SELECT c.image_id, c.frame_no, c.subject_no, c.count, {", ".join(f"{_BOX.format(k)} AS box_{k}" for k in ("x1", "y1", "x2", "y2"))}
        FROM counted c LEFT JOIN own o ON o.image_id = c.image_id AND o.id = c.id LEFT JOIN tree x ON x.image_id = o.image_id AND x.parent = o.field AND o.type = 'OBJECT'
        GROUP BY ALL""",
}
