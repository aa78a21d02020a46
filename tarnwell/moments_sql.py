"""DuckDB SQL for moments: timestamps read and converted by hand, not derived from the Spark functions."""

from __future__ import annotations

from tarnwell.functions.timestamps import ABBREVIATIONS

# How the names of months begin.
_MONTHS = {
    "jan": 1, "ene": 1, "feb": 2, "fév": 2, "mar": 3, "mär": 3, "mrz": 3, "apr": 4, "avr": 4, "abr": 4, "may": 5, "mai": 5, "juin": 6, "jun": 6,
    "juil": 7, "jul": 7, "aug": 8, "aoû": 8, "ago": 8, "sep": 9, "oct": 10, "okt": 10, "nov": 11, "dec": 12, "déc": 12, "dez": 12, "dic": 12,
}
_NAME = "coalesce(nullif(n.w, ''), nullif(e.w, ''), u.w)"
_MONTH = "CASE " + " ".join(f"WHEN {_NAME} LIKE '{k}%' THEN '{v}'" for k, v in _MONTHS.items()) + " END"


def _minutes(offset: str) -> int:
    return (-1 if offset[0] == "-" else 1) * (int(offset[1:3]) * 60 + int(offset[4:]))


_ZONE = "CASE upper(z) WHEN 'Z' THEN 0 " + " ".join(f"WHEN '{k}' THEN {_minutes(v)}" for k, v in ABBREVIATIONS.items()) + " END"

# raw: the bare text; cut: its notation; part: its parts; dated, timed: the clock time in microseconds and its zone; found: the moment.
_READ = r"""raw AS (SELECT id, root, mtime, regexp_replace(regexp_replace(replace(taken_at, '−', '-'), '^[\s"''\x00]+|[\s"''\x00]+$', '', 'g'), '\s+', ' ', 'g') AS t
    FROM i WHERE taken_at IS NOT NULL),
cut AS (SELECT raw.*, tz_name, coalesce(day_first, false) AS df,
    regexp_extract(t, '^(\d{4})[-:/.](\d{1,2})[-:/.](\d{1,2})(?:[T ](\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?)(.*))?$', ['y', 'm', 'd', 'c', 'z']) AS a,
    regexp_extract(t, '^(\d{4})(\d{2})(\d{2})(?:[T_]?(\d{2})(\d{2})(\d{2}))?$', ['y', 'm', 'd', 'h', 'n', 's']) AS b,
    regexp_extract(t, '^(\d{1,2})([/.])(\d{1,2})[/.](\d{4})(?:,? (\d{1,2}:\d{2}(?::\d{2})?)(.*))?$', ['d', 'k', 'm', 'y', 'c', 'z']) AS s,
    regexp_extract(lower(t), '^(?:[a-z]{2,4}\.?, )?(\d{1,2})\.? (?:de )?([a-zäéûô]+)\.? (?:de )?(\d{4})(?:(?:,| à| um)? (\d{1,2}:\d{2}(?::\d{2})?)(.*))?$', ['d', 'w', 'y', 'c', 'z']) AS n,
    regexp_extract(lower(t), '^([a-z]+) (\d{1,2}), (\d{4})(?:, (\d{1,2}:\d{2}(?::\d{2})?)(.*))?$', ['w', 'd', 'y', 'c', 'z']) AS e,
    regexp_extract(lower(t), '^[a-z]{3} ([a-z]{3}) (\d{1,2}) (\d{1,2}:\d{2}:\d{2}) (\d{4})$', ['w', 'd', 'c', 'y']) AS u
    FROM raw LEFT JOIN library_roots USING (root)),
part AS (SELECT id, root, mtime, tz_name, t,
    coalesce(nullif(a.y, ''), nullif(b.y, ''), nullif(s.y, ''), nullif(n.y, ''), nullif(e.y, ''), u.y) AS y,
    coalesce(nullif(a.m, ''), nullif(b.m, ''), nullif(CASE WHEN s.k = '.' OR df THEN s.m ELSE s.d END, ''),
        {month}) AS m,
    coalesce(nullif(a.d, ''), nullif(b.d, ''), nullif(CASE WHEN s.k = '.' OR df THEN s.d ELSE s.m END, ''), nullif(n.d, ''), nullif(e.d, ''), u.d) AS d,
    replace(coalesce(nullif(a.c, ''), nullif(CASE WHEN b.h <> '' THEN b.h || ':' || b.n || ':' || b.s ELSE '' END, ''), nullif(s.c, ''), nullif(n.c, ''), nullif(e.c, ''), nullif(u.c, ''), '0:0'), ',', '.') AS c,
    trim(coalesce(nullif(a.z, ''), nullif(s.z, ''), nullif(n.z, ''), nullif(e.z, ''), '')) AS z FROM cut),
clock AS (SELECT id, root, mtime, tz_name, t, TRY_CAST(y AS INT) AS y, TRY_CAST(m AS INT) AS m, TRY_CAST(d AS INT) AS d, TRY_CAST(split_part(c, ':', 1) AS INT) AS h, TRY_CAST(split_part(c, ':', 2) AS INT) AS n,
    coalesce(TRY_CAST(split_part(split_part(c, ':', 3), '.', 1) AS INT), 0) AS s, rpad(left(split_part(c, '.', 2), 6), 6, '0')::INT AS us,
    lower(left(z, 1)) IN ('a', 'p') AND regexp_matches(lower(z), '^[ap]\.?m\.?$') AS half, lower(left(z, 1)) AS ap,
    CASE WHEN regexp_matches(lower(z), '^([ap]\.?m\.?|uhr)$') THEN '' ELSE trim(z, '() ') END AS z FROM part WHERE y <> ''),
dated AS (SELECT *, regexp_extract(upper(z), '^(?:UTC|GMT)?([+-])(\d{1,2}):?(\d{2})?(?:\[.*\])?$', ['g', 'h', 'm']) AS o,
    CASE WHEN half THEN CASE WHEN h BETWEEN 1 AND 12 THEN h % 12 + CASE ap WHEN 'p' THEN 12 ELSE 0 END END ELSE CASE WHEN h <= 23 THEN h END END AS hh,
    TRY_CAST(y || '-' || lpad(m::VARCHAR, 2, '0') || '-' || lpad(d::VARCHAR, 2, '0') AS DATE) AS day FROM clock),
timed AS (SELECT *, epoch_us(day + to_hours(hh) + to_minutes(n) + to_seconds(s)) + us AS l,
    CASE WHEN z = '' THEN NULL WHEN o.g <> '' THEN (CASE o.g WHEN '-' THEN -1 ELSE 1 END) * (TRY_CAST(o.h AS INT) * 60 + coalesce(TRY_CAST(o.m AS INT), 0)) ELSE {zone} END AS minutes,
    CASE WHEN z = '' THEN tz_name WHEN z LIKE '%/%' AND o.g = '' THEN z END AS region FROM dated WHERE day IS NOT NULL AND y > 0 AND hh IS NOT NULL AND n <= 59 AND s <= 59),
-- the offset in force a day before, and the one in force then: the first holds unless the clock had changed by the time
off1 AS (SELECT *, l - 86400000000 AS before, epoch_us(timezone(region, make_timestamptz(l - 86400000000))) - (l - 86400000000) AS o1 FROM timed),
off2 AS (SELECT *, epoch_us(timezone(region, make_timestamptz(l - o1))) - (l - o1) AS o2 FROM off1),
off3 AS (SELECT *, epoch_us(timezone(region, make_timestamptz(l - o2))) - (l - o2) AS o3 FROM off2),
found AS (SELECT id, root, mtime, z, l, CASE WHEN region IS NOT NULL THEN l - CASE WHEN o2 = o1 OR o3 <> o2 THEN o1 ELSE o2 END ELSE l - minutes::BIGINT * 60000000 END AS us FROM off3
    WHERE region IS NOT NULL OR minutes IS NOT NULL)
""".replace("{month}", _MONTH).replace("{zone}", _ZONE)

_CURRENT = "i AS (SELECT * FROM images WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1)"

ORACLES = {
    "p2_found": f"""WITH {_CURRENT}, {_READ} SELECT id AS image_id, us AS taken_us FROM found
        UNION ALL SELECT id, CASE length(split_part(t, '.', 1)) WHEN 10 THEN split_part(t, '.', 1)::BIGINT * 1000000 + rpad(left(split_part(t, '.', 2), 6), 6, '0')::BIGINT
            WHEN 13 THEN t::BIGINT * 1000 ELSE t::BIGINT END FROM raw WHERE regexp_matches(t, '^(\\d{{10}}(\\.\\d+)?|\\d{{13}}|\\d{{16}})$')""",
    "p2_clocks": f"""WITH {_CURRENT}, {_READ} SELECT root, tz_name AS zone, count(id) AS n
        FROM library_roots LEFT JOIN (SELECT id, root FROM found WHERE z = '' AND mtime > 0) USING (root) GROUP BY ALL""",
}
