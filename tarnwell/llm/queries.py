"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from tarnwell.llm.components import p4_found, p4_links
from tarnwell.llm.cooccurrence import p3_found
from tarnwell.llm.packing import p8_containers, p8_violations
from tarnwell.llm.reading import p9_found, p9_levels
from tarnwell.llm.survivors import p6_found
from tarnwell.llm.term_counts import p1_counts, p1_found, p1_live
from tarnwell.llm.tokenize import p7_ids, p7_texts

QUERIES = {
    "p1_found": p1_found,
    "p1_counts": p1_counts,
    "p1_live": p1_live,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_links": p4_links,
    "p6_found": p6_found,
    "p7_ids": p7_ids,
    "p7_texts": p7_texts,
    "p8_containers": p8_containers,
    "p8_violations": p8_violations,
    "p9_found": p9_found,
    "p9_levels": p9_levels,
}

# The spelling of a term, as far as DuckDB goes: full-width letters by hand, for it has no NFKC.
_WIDE = "".join(chr(0xFF21 + i) for i in range(26)) + "".join(chr(0xFF41 + i) for i in range(26))
_PLAIN = "".join(chr(65 + i) for i in range(26)) + "".join(chr(97 + i) for i in range(26))


def _term(column: str) -> str:
    shown = f"regexp_replace({column}, '[\\x{{200B}}-\\x{{200F}}\\x{{FEFF}}\\x{{AD}}\\x{{2060}}]', '', 'g')"
    gaps = r"'[\s\x{A0}\x{2000}-\x{200A}\x{2010}-\x{2015}\x{202F}\x{3000}_-]+'"
    return f"nullif(trim(regexp_replace(lower(nfc_normalize(translate({shown}, '{_WIDE}', '{_PLAIN}'))), {gaps}, ' ', 'g')), '')"


_CURRENT = "(SELECT * FROM images WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1)"
_RECORDS = f"""
SELECT 'detections.class' AS field, id, any_value(image_id) AS image_id, {_term('any_value(class)')} AS term FROM detections GROUP BY id
UNION ALL SELECT 'adjudications.verdict', id, any_value(image_id), {_term('any_value(verdict)')} FROM adjudications GROUP BY id
UNION ALL SELECT 'images.category', id, id, {_term('category')} FROM {_CURRENT}
"""
_COUNTS = f"""
r AS (SELECT * FROM ({_RECORDS}) WHERE term IS NOT NULL),
c AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT image_id) AS images FROM r GROUP BY field, term),
n AS (SELECT field, count(DISTINCT image_id) AS total FROM r GROUP BY field)
"""

_HASHES = f"""raw AS (
    SELECT id, regexp_replace(lower(phash), '\\s', '', 'g') AS t FROM {_CURRENT} WHERE missing = 0 AND deleted = 0
),
digits AS (
    SELECT id, regexp_replace(CASE WHEN regexp_matches(t, '^[0-9a-f]{{2}}:') THEN t ELSE regexp_replace(t, '^([a-z]+[:=])?(0x)?', '') END, '[:_-]', '', 'g') AS d FROM raw
),
h AS (SELECT id, CAST('0x' || d AS UBIGINT) AS bits FROM digits WHERE regexp_matches(d, '^[0-9a-f]{{1,16}}$'))"""

ORACLES = {
    "p7_texts": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p8_violations": "SELECT count(*) FILTER (text <> '') AS items, 0::BIGINT AS lost, 0::BIGINT AS divided, 0::BIGINT AS overfull, 0::BIGINT AS overlapping FROM documents",
    "p1_counts": f"WITH {_COUNTS} SELECT * FROM c",
    "p1_live": f"""WITH gone AS (SELECT id FROM {_CURRENT} WHERE missing = 1 OR deleted = 1),
r AS (SELECT * FROM ({_RECORDS}) WHERE term IS NOT NULL AND (image_id IS NULL OR image_id NOT IN (FROM gone)))
SELECT field, term, count(*) AS occurrences, count(DISTINCT image_id) AS images FROM r GROUP BY field, term""",
    "p1_found": f"""WITH {_COUNTS}
SELECT field, term, 'rare' AS mark FROM c WHERE images < 5
UNION ALL SELECT field, term, 'common' FROM c JOIN n USING (field) WHERE images * 4 > total""",
    "p3_found": f"""
WITH b AS (SELECT DISTINCT image_id, {_term('class')} AS term FROM detections WHERE image_id IS NOT NULL),
o AS (SELECT * FROM b WHERE term IS NOT NULL), n AS (SELECT count(DISTINCT image_id) AS total FROM o),
m AS (SELECT term, count(*) AS k FROM o GROUP BY term),
p AS (SELECT x.term AS class_a, y.term AS class_b, count(*) AS k FROM o x JOIN o y USING (image_id) WHERE x.term < y.term GROUP BY ALL)
SELECT class_a, class_b FROM p JOIN m a ON a.term = class_a JOIN m b2 ON b2.term = class_b, n
WHERE p.k >= 5 AND 1000 * p.k >= total AND p.k * total >= 3 * a.k * b2.k""",
    "p4_found": f"""
WITH RECURSIVE {_HASHES},
link AS (
    SELECT a.id AS a, b.id AS b FROM h a JOIN h b ON a.id < b.id AND bit_count(xor(a.bits, b.bits)) <= 3
    WHERE NOT EXISTS (
        SELECT 1 FROM dupe_dismissals d WHERE least(image_id_a, image_id_b) = a.id AND greatest(image_id_a, image_id_b) = b.id
    )
),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(a, b) AS (SELECT a, a FROM edge UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a)
SELECT min(b) AS group_id, a AS image_id FROM reach GROUP BY a""",
    "p4_links": f"""
WITH {_HASHES}, d AS (SELECT DISTINCT bits, CASE WHEN bits >= 9223372036854775808 THEN (bits::HUGEINT - 18446744073709551616)::BIGINT ELSE bits::BIGINT END AS s FROM h)
SELECT a.s AS hash_a, b.s AS hash_b, bit_count(xor(a.bits, b.bits))::INT AS bits FROM d a JOIN d b ON a.s < b.s AND bit_count(xor(a.bits, b.bits)) <= 3""",
    "p6_found": f"""
WITH live AS (
    SELECT c.*, r.trust, regexp_extract(regexp_replace(lower(hash), '\\s', '', 'g'), '^(?:sha256:)?([0-9a-f]{{64}})$', 1) AS h,
        (coalesce(width, 0) > 0)::INT + (coalesce(height, 0) > 0)::INT + (coalesce(size, 0) > 0)::INT AS n
    FROM {_CURRENT} c LEFT JOIN library_roots r USING (root) WHERE missing = 0 AND deleted = 0
),
r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY trust DESC NULLS LAST, updated_at DESC, id) AS rank FROM live WHERE h <> '')
SELECT h AS hash, arg_min(id, (-n, rank)) AS keeper_id, CAST(arg_min(width, rank) FILTER (width > 0) AS BIGINT) AS width,
    CAST(arg_min(height, rank) FILTER (height > 0) AS BIGINT) AS height, arg_min(size, rank) FILTER (size > 0) AS size
FROM r GROUP BY h HAVING count(*) > 1""",
}
