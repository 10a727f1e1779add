"""DuckDB SQL of the record queries (problems 1 to 3)."""

from __future__ import annotations

#: Lists of a record and lists inside their items; texts for no value, for yes and no.
TOP_LISTS = ("mentions", "matters", "relationships", "risks", "actions")
CHILD_LISTS = ("geographies", "attributes", "case_numbers", "legal_provisions")
FILLERS = ("", "-", "--", "?", "n/a", "na", "n.a.", "nil", "nil return", "none", "null", "not stated", "not available", "see notice", "tbc", "tba", "tbd", "unknown")
TRUE_WORDS = ("true", "yes", "y", "1", "t")
FALSE_WORDS = ("false", "no", "n", "0", "f")


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_TOPS = f"[{_quoted(TOP_LISTS)}]"
_OBJECTS = f"""
WITH ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source_ref, language ORDER BY extracted_at DESC NULLS LAST) AS rn FROM extractions
), raw AS (
  SELECT source_ref, language, try_cast(extraction_json AS JSON) AS j FROM ranked WHERE rn = 1
), plain AS (
  SELECT source_ref, language, CASE WHEN json_type(j) = 'VARCHAR' THEN try_cast(j ->> '$' AS JSON) ELSE j END AS j FROM raw
), rec AS (
  SELECT source_ref, language,
    CASE WHEN len(list_intersect(json_keys(j), {_TOPS})) > 0 THEN j
         ELSE list_filter(json_extract(j, '$.*'), lambda x: json_type(x) = 'OBJECT' AND len(list_intersect(json_keys(x), {_TOPS})) > 0)[1] END AS j
  FROM plain WHERE j IS NOT NULL
), top AS (
  SELECT source_ref, language, t.name AS path, json_extract(j, '$.' || t.name) AS l FROM rec, unnest({_TOPS}) AS t(name)
), items AS (
  SELECT source_ref, language, path, unnest(CASE json_type(l) WHEN 'ARRAY' THEN json_extract(l, '$[*]') WHEN 'OBJECT' THEN [l] END) AS o,
    generate_subscripts(CASE json_type(l) WHEN 'ARRAY' THEN json_extract(l, '$[*]') WHEN 'OBJECT' THEN [l] END, 1) - 1 AS item_pos
  FROM top
), item AS (SELECT * FROM items WHERE json_type(o) = 'OBJECT'
), sub AS (
  SELECT source_ref, language, path || '.' || c.name AS path, item_pos, json_extract(o, '$.' || c.name) AS l FROM item, unnest([{_quoted(CHILD_LISTS)}]) AS c(name)
), children AS (
  SELECT source_ref, language, path, item_pos, unnest(CASE json_type(l) WHEN 'ARRAY' THEN json_extract(l, '$[*]') WHEN 'OBJECT' THEN [l] END) AS o,
    generate_subscripts(CASE json_type(l) WHEN 'ARRAY' THEN json_extract(l, '$[*]') WHEN 'OBJECT' THEN [l] END, 1) - 1 AS child_pos
  FROM sub
)
"""
_P1 = _OBJECTS + """
SELECT source_ref, language, path, CAST(item_pos AS BIGINT) AS item_pos, CAST(-1 AS BIGINT) AS child_pos FROM item
UNION
SELECT source_ref, language, path, CAST(item_pos AS BIGINT), CAST(child_pos AS BIGINT) FROM children WHERE json_type(o) = 'OBJECT'
"""


def _single(o: str) -> str:
    """The object at ``o``, or the first of a list there."""
    return f"CASE json_type({o}) WHEN 'ARRAY' THEN {o} -> 0 ELSE {o} END"


def _scalar(o: str) -> str:
    """The scalar at ``o`` as text, or the first of a list there."""
    return f"CASE WHEN json_type({_single(o)}) IN ('ARRAY', 'OBJECT', 'NULL') THEN NULL ELSE {_single(o)} ->> '$' END"


def _list(o: str) -> str:
    """The scalars of the list at ``o``, a single one being a list of one, as JSON text."""
    return f"to_json(coalesce(list_transform(list_filter(CASE json_type({o}) WHEN 'ARRAY' THEN json_extract({o}, '$[*]') ELSE [{o}] END, lambda x: json_type(x) NOT IN ('ARRAY', 'OBJECT', 'NULL')), lambda x: x ->> '$'), []))"


def p1_table_sql(path: str, fields: tuple[str, ...], lists: tuple[str, ...], embedded: tuple[str, ...]) -> str:
    """One flat table of the objects of ``path``."""
    source, child = ("children", "child_pos") if "." in path else ("item", "-1")
    columns = [f"{_scalar(f'(o -> {chr(39)}$.{f}{chr(39)})')} AS {f}" for f in fields] + [f"CAST({_list(f'(o -> {chr(39)}$.{f}{chr(39)})')} AS VARCHAR) AS {f}" for f in lists]
    for e in embedded:
        *above, last = e.split(".")
        at = "o"
        for a in above:
            at = _single(f"({at} -> '$.{a}')")
        value = _scalar(f"({at} -> '$.{last}')")
        if e.endswith("evidence.quote"):
            plain = "o"
            for a in above[:-1]:
                plain = _single(f"({plain} -> '$.{a}')")
            value = f"coalesce({value}, {_scalar(f'({plain} -> {chr(39)}$.evidence{chr(39)})')})"
        columns.append(f"{value} AS {e.replace('.', '_')}")
    return _OBJECTS + f" SELECT source_ref, language, CAST(item_pos AS BIGINT) AS item_pos, CAST({child} AS BIGINT) AS child_pos, {', '.join(columns)} FROM {source} WHERE path = '{path}' AND json_type(o) = 'OBJECT'"


_REF = r"upper(regexp_replace({0}, '^\s+|\s+$', '', 'g'))"
_P2 = f"""
WITH link AS (
  SELECT {_REF.format("source_ref")} AS source_ref, {_REF.format("language")} AS language, {_REF.format("target_ref")} AS target_ref, min(recorded_at) AS at
  FROM release_links GROUP BY 1, 2, 3
), parent AS (
  SELECT {_REF.format("source_ref")} AS ref, {_REF.format("language")} AS language, min(try_cast(fetched_at AS TIMESTAMPTZ)) AT TIME ZONE 'UTC' AS seen FROM releases GROUP BY 1, 2
), gone AS (
  SELECT DISTINCT {_REF.format("source_ref")} AS ref, {_REF.format("language")} AS language FROM release_removals
), side AS (
  SELECT 'source' AS side, source_ref AS ref, * FROM link UNION ALL SELECT 'target', target_ref, * FROM link
), judged AS (
  SELECT side, source_ref, s.language, target_ref,
    CASE WHEN p.ref IS NULL AND g.ref IS NOT NULL THEN 'deleted' WHEN p.ref IS NULL THEN 'missing' WHEN p.seen > s.at THEN 'late' END AS reason,
    strftime(s.at, '%Y-%m') AS period, s.ref AS ref
  FROM side s LEFT JOIN parent p ON p.ref = s.ref AND p.language = s.language LEFT JOIN gone g ON g.ref = s.ref AND g.language = s.language
  WHERE s.ref IS NOT NULL AND s.language IS NOT NULL
)
"""
_P2_FOUND = _P2 + "SELECT side, source_ref, language, target_ref, reason, period FROM judged WHERE reason IS NOT NULL"
_P2_COUNTS = _P2 + "SELECT side, language, reason, period, count(*) AS n_links, count(DISTINCT ref) AS n_refs FROM judged WHERE reason IS NOT NULL GROUP BY ALL"

_NUMBER = r"^(?:[a-z]{0,3}\$|[a-z]{3} )? ?([+-]?[0-9][0-9,]*(?:\.[0-9]+)?) ?(thousand|million|billion|mn|bn|m|k)?(?:%| ?%| per ?cent| percent)?$"
_WHOLE = r"^(?:[a-z]+ )?([+-]?[0-9][0-9,]*)(?:\.0+)?(?: [a-z ]+)?$"
_P3 = f"""
WITH cell AS (
  SELECT source_ref, language, item_id, t.name, t.value_type AS kind, recorded_at AS made, trim(regexp_replace(value, '\\s+', ' ', 'g')) AS v
  FROM mention_attributes a JOIN attribute_types t ON lower(regexp_replace(a.name, '[^A-Za-z0-9]+', '', 'g')) = replace(t.name, '_', '')
), part AS (
  SELECT *, replace(regexp_extract(lower(v), '{_NUMBER}', 1), ',', '') AS num, regexp_extract(lower(v), '{_NUMBER}', 2) AS unit,
    replace(regexp_extract(lower(v), '{_WHOLE}', 1), ',', '') AS whole
  FROM cell WHERE v IS NOT NULL AND lower(v) NOT IN ({_quoted(FILLERS)})
), typed AS (
  SELECT *, CASE kind
    WHEN 'string' THEN v
    WHEN 'boolean' THEN CASE WHEN lower(v) IN ({_quoted(TRUE_WORDS)}) THEN 'true' WHEN lower(v) IN ({_quoted(FALSE_WORDS)}) THEN 'false' END
    WHEN 'int' THEN CAST(try_cast(nullif(whole, '') AS BIGINT) AS VARCHAR)
    WHEN 'decimal' THEN regexp_replace(regexp_replace(CAST(try_cast(nullif(num, '') AS DECIMAL(18, 6)) * CASE unit WHEN 'thousand' THEN 1000 WHEN 'k' THEN 1000
      WHEN '' THEN 1 WHEN 'billion' THEN 1000000000 WHEN 'bn' THEN 1000000000 ELSE 1000000 END AS VARCHAR), '(\\.\\d*?)0+$', '\\1'), '\\.$', '')
    WHEN 'date' THEN strftime(coalesce(try_strptime(regexp_replace(v, '^(\\d{{4}}-\\d\\d-\\d\\d)[T ].*$', '\\1'), '%Y-%m-%d'), try_strptime(v, '%Y/%m/%d'), try_strptime(v, '%Y%m%d'),
      try_strptime(v, '%d %B %Y'), try_strptime(v, '%d %b %Y'), try_strptime(v, '%B %d, %Y'), try_strptime(v, '%b %d, %Y')), '%Y-%m-%d')
    END AS cell_text
  FROM part
), last AS (
  SELECT *, row_number() OVER (PARTITION BY source_ref, language, item_id, name ORDER BY made DESC NULLS LAST, cell_text DESC) AS rn FROM typed WHERE cell_text IS NOT NULL
)
SELECT source_ref, language, item_id, name, cell_text FROM last WHERE rn = 1
"""


def oracle_sql(tables: dict[str, tuple]) -> dict[str, str]:
    """``tables``: name -> path, fields, lists, embedded, as in the queries."""
    return {f"p1_{name}": p1_table_sql(*spec) for name, spec in tables.items()} | {"p1_found": _P1, "p2_found": _P2_FOUND, "p2_counts": _P2_COUNTS, "p3_found": _P3}
