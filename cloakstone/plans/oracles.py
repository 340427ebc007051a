"""The same queries as plain SQL for DuckDB, over the same tables."""

from __future__ import annotations

from cloakstone.functions.detectors import BOOLEAN_SHAPE, DECIMAL_SHAPE, DETECTORS, INTEGER_SHAPE
from cloakstone.plans.event_view import MERGED_SQL
from cloakstone.plans.trial_view import COLUMNS, TRIAL_SQL

SQL: dict[str, str] = {}

BLANKS = r"E' \t\n\r'"
IDENTIFIERS = COLUMNS[:8]
CANARY_SSN, CANARY_NAME = "900-00-9999", "Philomena Nightingale"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def bare(regex: str) -> str:
    return regex.removeprefix("^").removesuffix("$")


# --- classification -------------------------------------------------------------------


def cells_sql(source: str, columns: dict[str, str], name: str = "cells") -> str:
    """Long form of a table; ``columns`` maps names to text expressions."""
    parts = [
        f"SELECT {i} AS ordinal, {lit(c)} AS name, coalesce({expr}, '') AS value FROM {source}"
        for i, (c, expr) in enumerate(columns.items())
    ]
    return f"{name} AS (SELECT *, trim(value, {BLANKS}) AS s FROM (" + " UNION ALL ".join(parts) + "))"


def verdict_sql(cells: str = "cells", name: str = "verdict") -> str:
    counts = ", ".join(
        f"count(*) FILTER (WHERE regexp_full_match(s, {lit(bare(d.regex))})) AS n_{d.pii_type}" for d in DETECTORS
    )
    anything = " OR ".join(f"regexp_full_match(s, {lit(bare(d.regex))})" for d in DETECTORS)
    best = "greatest(" + ", ".join(f"n_{d.pii_type}" for d in DETECTORS) + ")"
    ladder = " ".join(f"WHEN n_{d.pii_type} = best THEN {lit(d.pii_type)}" for d in DETECTORS)
    return f"""
{name}_profile AS (SELECT ordinal, name, count(*) AS n_cells, count(*) FILTER (WHERE s <> '') AS populated, {counts},
    count(*) FILTER (WHERE {anything}) AS n_any,
    count(*) FILTER (WHERE regexp_full_match(s, {lit(bare(INTEGER_SHAPE))})) AS n_integer,
    count(*) FILTER (WHERE regexp_full_match(s, {lit(bare(DECIMAL_SHAPE))})) AS n_decimal,
    count(*) FILTER (WHERE regexp_full_match(s, {lit(bare(BOOLEAN_SHAPE))})) AS n_boolean,
    count(DISTINCT CASE WHEN s <> '' THEN s END) AS n_distinct
  FROM {cells} GROUP BY ordinal, name),
{name}_best AS (SELECT *, {best} AS best FROM {name}_profile),
{name}_typed AS (SELECT *, CASE WHEN populated = 0 OR best = 0 OR best / populated::DOUBLE < 0.5 THEN NULL ELSE CASE {ladder} END END AS first_type
  FROM {name}_best),
{name} AS (SELECT ordinal::BIGINT AS ordinal, name,
    CASE WHEN populated > 0 AND n_integer = populated THEN 'bigint' WHEN populated > 0 AND n_decimal = populated THEN 'double'
         WHEN populated > 0 AND n_boolean = populated THEN 'boolean' ELSE 'string' END AS dtype,
    populated, n_cells - populated AS blank,
    CASE WHEN first_type = 'study_id' AND n_distinct / populated::DOUBLE < 0.95 THEN NULL ELSE first_type END AS pii_type,
    CASE WHEN populated > 0 THEN round_even(best / populated::DOUBLE, 4) ELSE 0.0 END::DOUBLE AS match_rate,
    CASE WHEN populated > 0 THEN round_even(n_any / populated::DOUBLE, 4) ELSE 0.0 END::DOUBLE AS any_identifier_rate
  FROM {name}_typed)"""


TRIAL_CELLS = cells_sql("trial", {c: c for c in COLUMNS})
SQL["classify_verdict"] = f"WITH {TRIAL_SQL}, {TRIAL_CELLS}, {verdict_sql()} SELECT * FROM verdict"
_DETECTED = ", ".join(f"n_{d.pii_type}" for d in DETECTORS)
SQL["detector_counts"] = (
    f"WITH {TRIAL_SQL}, {TRIAL_CELLS}, {verdict_sql()} SELECT name, n_cells, populated, n_any, {_DETECTED} FROM verdict_profile"
)
SQL["verdict_columns"] = f"""WITH {TRIAL_SQL}, {TRIAL_CELLS}, {verdict_sql()}
SELECT 1::BIGINT AS schema_version, 'run-1' AS run_id, (SELECT count(*) FROM trial) AS row_count,
  (SELECT count(*) FROM verdict) AS column_count,
  (SELECT string_agg(name, ',' ORDER BY ordinal) FROM verdict WHERE pii_type IS NOT NULL) AS pii_columns, name, pii_type
FROM verdict"""

_TABLES = {
    "orders": {
        "o_orderkey": "o_orderkey", "o_custkey": "o_custkey", "o_orderstatus": "o_orderstatus", "o_totalprice": "o_totalprice::DECIMAL(18,2)",
        "o_orderdate": "o_orderdate::DATE", "o_orderpriority": "o_orderpriority",
    },
    "customer": {"c_custkey": "c_custkey", "c_name": "c_name", "c_nationkey": "c_nationkey", "c_acctbal": "c_acctbal::DECIMAL(18,2)", "c_mktsegment": "c_mktsegment"},
    "supplier": {"s_suppkey": "s_suppkey", "s_name": "s_name", "s_nationkey": "s_nationkey", "s_acctbal": "s_acctbal::DECIMAL(18,2)"},
}
SQL["classify_orders_columns"] = "WITH " + ", ".join(
    cells_sql(t, {c: f"({e})::VARCHAR" for c, e in cs.items()}, f"cells_{t}") + ", " + verdict_sql(f"cells_{t}", f"verdict_{t}")
    for t, cs in _TABLES.items()
) + " " + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, name, dtype, populated, blank, pii_type, match_rate FROM verdict_{t}" for t in _TABLES
)

# The verdict's text holds names, counts and rates only, so no cell can be inside it; what
# remains to compare is the text with cells planted in it.
_UNSAFE = "site SITE-03 reports STUDY-0000041 and STUDY-0000042, Treatment arm, seen 1950-03-13"
_KEYS = [
    "schema_version", "run_id", "row_count", "column_count", "pii_columns", "columns", "name", "dtype",
    "populated", "blank", "pii_type", "match_rate", "example", "bigint", "double", "boolean", "string",
]
_ALLOWED = ", ".join(lit(x) for x in [*COLUMNS, *_KEYS, *(d.pii_type for d in DETECTORS)])
SQL["output_backstop"] = f"""WITH {TRIAL_SQL}, {TRIAL_CELLS}
SELECT 'leaky' AS output, name AS "column", count(DISTINCT s) AS values_exposed, max(length(s))::BIGINT AS longest
FROM cells WHERE length(s) >= 5 AND s NOT IN ({_ALLOWED}) AND contains({lit(_UNSAFE)}, s) GROUP BY name"""

# --- de-identification ----------------------------------------------------------------


def born_sql(value: str) -> str:
    d = f"trim({value}, {BLANKS})"
    return f"""CASE WHEN regexp_full_match({d}, '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') THEN try_strptime({d}, '%Y-%m-%d')
      WHEN regexp_full_match({d}, '\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}') THEN try_strptime({d}, '%m/%d/%Y')
      WHEN regexp_full_match({d}, '\\d{{1,2}} +[A-Za-z]{{3}} +\\d{{4}}') THEN try_strptime({d}, '%d %b %Y')
      WHEN regexp_full_match({d}, '[A-Za-z]{{3}} +\\d{{1,2}}, *\\d{{4}}') THEN try_strptime({d}, '%b %d, %Y') END::DATE"""


def age_sql(born: str) -> str:
    return f"floor((20260101 - (year({born})*10000 + month({born})*100 + day({born}))) / 10000)::BIGINT"


def measure_sql(value: str) -> str:
    return (
        f"CASE WHEN regexp_full_match(trim({value}, {BLANKS}), '[+-]?(?:\\d+\\.?\\d*|\\.\\d+)\\s*[A-Za-z%]*') "
        f"THEN regexp_extract(trim({value}, {BLANKS}), '^[+-]?(?:\\d+\\.?\\d*|\\.\\d+)')::DOUBLE END"
    )


def scrub_sql(source: str = "trial", name: str = "scrubbed") -> str:
    return f"""
{name}_aged AS (SELECT *, {age_sql('born')} AS age FROM (SELECT *, {born_sql('dob')} AS born FROM {source})),
{name} AS (SELECT substr(sha256(mrn), 1, 12) AS subject_pseudo_id,
    CASE WHEN age >= 0 THEN greatest(floor((age - 5) / 10)::BIGINT*10 + 5, 0)::VARCHAR || '-' || (floor((age - 5) / 10)::BIGINT*10 + 14)::VARCHAR END AS age_band,
    site,
    CASE WHEN lower(trim(arm, {BLANKS})) IN ('treatment', 'placebo') THEN lower(trim(arm, {BLANKS})) END AS arm,
    {measure_sql('baseline')} AS baseline, {measure_sql('followup')} AS followup, {measure_sql('outcome_measure')} AS outcome_measure,
    CASE WHEN lower(trim(adverse_event, {BLANKS})) IN ('yes', 'y', 'true', '1') THEN 1
         WHEN lower(trim(adverse_event, {BLANKS})) IN ('no', 'n', 'false', '0') THEN 0 END::BIGINT AS adverse_event
  FROM {name}_aged)"""


SCRUBBED = f"WITH {TRIAL_SQL}, {scrub_sql()}"
SQL["scrub_trial"] = f"{SCRUBBED} SELECT * FROM scrubbed"
SQL["scrub_by_verdict"] = SQL["scrub_trial"]
SQL["scrub_summary"] = f"""{SCRUBBED}
SELECT (SELECT count(*) FROM trial) AS row_count, 6::BIGINT AS columns_dropped, 1::BIGINT AS columns_hashed, 1::BIGINT AS columns_coarsened,
  (SELECT count(*) FROM trial WHERE trim(mrn) = '') AS pseudonym_missing,
  (SELECT count(*) FROM scrubbed_aged WHERE trim(dob) <> '' AND born IS NULL) AS dob_unparsed,
  (SELECT count(*) FROM scrubbed_aged WHERE age < 0) AS dob_in_future,
  (SELECT count(*) FROM scrubbed WHERE arm IS NULL) AS arm_unknown, (SELECT count(*) FROM scrubbed WHERE adverse_event IS NULL) AS flag_unknown,
  (SELECT count(*) FROM trial WHERE trim(baseline) <> '' AND {measure_sql('baseline')} IS NULL) AS baseline_unparsed,
  (SELECT count(*) FROM trial WHERE trim(followup) <> '' AND {measure_sql('followup')} IS NULL) AS followup_unparsed,
  (SELECT count(*) FROM trial WHERE trim(outcome_measure) <> '' AND {measure_sql('outcome_measure')} IS NULL) AS outcome_measure_unparsed"""
_PAD = b"a key of the release".ljust(64, b"\0")
_INNER, _OUTER = (bytes(b ^ x for b in _PAD).hex() for x in (0x36, 0x5C))
# HMAC by its definition: the outer block and the digest of the inner block and the text.
SQL["pseudonyms_keyed"] = f"""WITH {TRIAL_SQL}
SELECT substr(sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode(mrn)))), 1, 12) AS subject_pseudo_id, site FROM trial"""
SQL["dob_parse_failures"] = f"""WITH {TRIAL_SQL},
spoiled AS (SELECT * REPLACE (CASE WHEN i%97 = 0 THEN '31/31/1970' WHEN i%89 = 0 THEN 'unknown'
    WHEN i%83 = 0 THEN '  ' || dob || chr(9) WHEN i%79 = 0 THEN '' WHEN i%73 = 0 THEN '2030-01-01' ELSE dob END AS dob) FROM trial),
aged AS (SELECT *, {age_sql('born')} AS age FROM (SELECT *, {born_sql('dob')} AS born FROM spoiled))
SELECT count(*) AS row_count, count(*) FILTER (WHERE trim(dob, {BLANKS}) <> '' AND born IS NULL) AS dob_unparsed,
  count(*) FILTER (WHERE age < 0) AS dob_in_future FROM aged"""
SQL["age_bands"] = f"{SCRUBBED} SELECT age_band, count(*) AS n FROM scrubbed GROUP BY age_band"
SQL["pseudonym_collisions"] = f"""WITH {TRIAL_SQL}, p AS (SELECT substr(sha256(mrn), 1, 12) AS p, count(DISTINCT mrn) AS n FROM trial GROUP BY 1)
SELECT count(*) AS pseudonyms, count(*) FILTER (WHERE n > 1) AS collisions FROM p"""
_FIELDS = " || ".join(f"length({c})::VARCHAR || ':' || {c}" for c in COLUMNS)
SQL["table_digest_trial"] = f"""WITH {TRIAL_SQL}
SELECT count(*) AS row_count, sum(('0x' || substr(sha256({_FIELDS}), 1, 15))::BIGINT)::VARCHAR AS digest FROM trial"""

# --- verification ---------------------------------------------------------------------

_SCRUB_COLUMNS = "subject_pseudo_id,age_band,site,arm,baseline,followup,outcome_measure,adverse_event"
SQL["verify_scrubbed"] = f"""{SCRUBBED}, {cells_sql('scrubbed', {c: f'{c}::VARCHAR' for c in _SCRUB_COLUMNS.split(',')})}, {verdict_sql()}
SELECT 1::BIGINT AS schema_version, 'scrub' AS "check", (SELECT count(*) FROM scrubbed) AS row_count, '{_SCRUB_COLUMNS}' AS "columns",
  coalesce(string_agg(name || ':' || pii_type, ',' ORDER BY ordinal) FILTER (WHERE pii_type IS NOT NULL), '') AS survivors,
  (SELECT bool_or(contains(value, '{CANARY_SSN}') OR contains(value, '{CANARY_NAME}')) FROM cells) AS canary_present,
  'run-1' AS run_id, count(pii_type) = 0 AS passed, '' AS error FROM verdict"""
_PLANTED = f"""planted AS (SELECT * REPLACE (CASE WHEN i = 41 THEN '{CANARY_NAME}' ELSE patient_name END AS patient_name,
    CASE WHEN i = 41 THEN '{CANARY_SSN}' ELSE ssn END AS ssn) FROM trial)"""
SQL["verify_unscrubbed"] = f"""WITH {TRIAL_SQL}, {_PLANTED}, {cells_sql('planted', {c: c for c in COLUMNS})}, {verdict_sql()}
SELECT 1::BIGINT AS schema_version, 'scrub' AS "check", (SELECT count(*) FROM planted) AS row_count, '{",".join(COLUMNS)}' AS "columns",
  coalesce(string_agg(name || ':' || pii_type, ',' ORDER BY ordinal) FILTER (WHERE pii_type IS NOT NULL), '') AS survivors,
  (SELECT bool_or(contains(value, '{CANARY_SSN}') OR contains(value, '{CANARY_NAME}')) FROM cells) AS canary_present,
  'run-1' AS run_id, FALSE AS passed, '' AS error FROM verdict"""
SQL["verify_without_canary"] = f"""{SCRUBBED}, {cells_sql('scrubbed', {c: f'{c}::VARCHAR' for c in _SCRUB_COLUMNS.split(',')})}, {verdict_sql()}
SELECT 1::BIGINT AS schema_version, 'scrub' AS "check", (SELECT count(*) FROM scrubbed) AS row_count, '{_SCRUB_COLUMNS}' AS "columns",
  coalesce(string_agg(name || ':' || pii_type, ',' ORDER BY ordinal) FILTER (WHERE pii_type IS NOT NULL), '') AS survivors,
  NULL::BOOLEAN AS canary_present, 'run-1' AS run_id, FALSE AS passed, 'canary record not found' AS error FROM verdict"""
SQL["surviving_identifiers"] = f"""WITH {TRIAL_SQL},
{cells_sql('trial', {'notes': 'ssn', 'site': 'site', 'ref': 'subject_id', 'arm': 'lower(arm)'})}, {verdict_sql()}
SELECT name, pii_type, match_rate FROM verdict WHERE pii_type IS NOT NULL"""
SQL["canary_exactly_once"] = f"""WITH {TRIAL_SQL}, {_PLANTED}
SELECT count(*) FILTER (WHERE ssn = '{CANARY_SSN}') AS ssn_rows, count(*) FILTER (WHERE patient_name = '{CANARY_NAME}') AS name_rows FROM planted"""
SQL["canary_survival"] = """SELECT count(*) FILTER (WHERE contains(text, 'une le') OR contains(source, 'une le')) AS rows_with_phrase,
  count(*) FILTER (WHERE contains(text, 'hahaha') OR contains(source, 'hahaha')) AS rows_with_word, 0::BIGINT AS rows_with_empty FROM documents"""

# --- leak scan ------------------------------------------------------------------------

_MON = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]{0,6}"
# The same shapes with RE2's word edges.
SHAPES = {
    "us-ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "email": r"[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9.\-]{1,253}\.[A-Za-z]{2,24}",
    "us-phone": r"(?:\+?1[ .\-]?)?(?:\(\d{3}\)[ .\-]?|\b\d{3}[ .\-])\d{3}[ .\-]\d{4}\b",
    "date-of-birth": rf"\b(?:\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}/\d{{1,2}}/\d{{4}}|\d{{1,2}} {_MON} \d{{4}}|{_MON} \d{{1,2}}, \d{{4}})\b",
    "mrn": r"\b(?i:mrn)[ :#\-]{0,2}\d{5,10}\b",
    "us-street-address": r"\b\d{1,6} [A-Za-z][A-Za-z .'\-]{1,60}, [A-Za-z][A-Za-z .'\-]{1,60}, [A-Za-z]{2} \d{5}\b",
}


def hits_sql(source: str, key: str, text: str, name: str = "hits", canaries: dict[str, str] | None = None,
             shapes: dict[str, str] | None = None) -> str:
    parts = []
    for label, regex in (SHAPES if shapes is None else shapes).items():
        parts.append(
            f"SELECT {key}, 'pattern' AS severity, '{label}' AS label, regexp_extract_all({text}, {lit(regex)}) AS m, "
            f"string_split_regex({text}, {lit(regex)}) AS p FROM {source} WHERE regexp_matches({text}, {lit(regex)})"
        )
    for label, value in (canaries or {}).items():
        if value:
            parts.append(
                f"SELECT {key}, 'canary' AS severity, 'canary:{label}' AS label, "
                f"list_transform(range(len(string_split({text}, {lit(value)})) - 1), lambda x: {lit(value)}) AS m, "
                f"string_split({text}, {lit(value)}) AS p FROM {source} WHERE contains({text}, {lit(value)})"
            )
    return f"""
{name}_lists AS ({" UNION ALL ".join(parts)}),
{name}_at AS (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM {name}_lists),
{name} AS (SELECT {key}, severity, label, m[k] AS match,
    (list_sum(list_transform(p[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k-1], lambda x: length(x))), 0))::BIGINT AS "offset"
  FROM {name}_at)"""


EXCERPT = "CASE WHEN length(match) >= 8 THEN left(match, 3) || '…' || right(match, 3) ELSE '…' END AS excerpt"
DOC_HITS = hits_sql("documents", "doc_id", "text")
SQL["pattern_hits"] = f"""WITH {DOC_HITS} SELECT doc_id, severity, label, "offset", length(match)::BIGINT AS length, {EXCERPT} FROM hits"""
SQL["pattern_hits_pages"] = f"""WITH {hits_sql('pages', 'page_id', 'html')} SELECT page_id, severity, label, "offset", length(match)::BIGINT AS length, {EXCERPT} FROM hits"""
SQL["canary_scan"] = f"""WITH {hits_sql('documents', 'doc_id', 'text', canaries={'phrase': 'une le', 'word': 'hahaha'}, shapes={})}
SELECT doc_id, severity, label, "offset", length(match)::BIGINT AS length, {EXCERPT} FROM hits"""
SQL["pattern_summary"] = f"""WITH {DOC_HITS}
SELECT severity, label, count(*) AS hits, count(DISTINCT match) AS distinct_matches FROM hits GROUP BY severity, label"""
SQL["document_verdicts"] = f"""WITH {hits_sql('documents', 'doc_id', 'text', canaries={'phrase': 'une le', 'word': 'hahaha'})},
n AS (SELECT doc_id, count(*) FILTER (WHERE severity = 'canary') AS c, count(*) FILTER (WHERE severity = 'pattern') AS p FROM hits GROUP BY doc_id)
SELECT d.doc_id, length(d.text)::BIGINT AS scanned_chars, coalesce(c, 0) AS canary_hits, coalesce(p, 0) AS pattern_hits,
  coalesce(c, 0) = 0 AND coalesce(p, 0) = 0 AS clean, coalesce(c, 0) = 0 AS canary_clean FROM documents d LEFT JOIN n USING (doc_id)"""
_REDACTED = "replace(text, 'une le', '[canary:phrase:redacted]')"
for _label, _regex in SHAPES.items():
    _REDACTED = f"regexp_replace({_REDACTED}, {lit(_regex)}, '[{_label}:redacted]', 'g')"
SQL["redact_documents"] = f"""WITH r AS (SELECT doc_id, {_REDACTED} AS t FROM documents)
SELECT doc_id, length(t)::BIGINT AS n_chars, sha256(t) AS digest FROM r"""
SQL["pattern_candidates"] = f"""WITH {DOC_HITS}
SELECT DISTINCT substr(sha256(match), 1, 12) AS fingerprint, length(match)::BIGINT AS length FROM hits"""
SQL["adjudicate_candidates"] = f"""WITH {DOC_HITS}, c AS (SELECT DISTINCT match AS c FROM hits),
n AS (SELECT c, sum((length(html) - length(replace(html, c, ''))) // length(c))::BIGINT AS n FROM c, pages GROUP BY c)
SELECT substr(sha256(c), 1, 12) AS fingerprint, n AS occurrences, n > 0 AS leaked FROM n"""
SQL["value_scan_small"] = """SELECT d.doc_id, substr(sha256(b.text), 1, 12) AS fingerprint,
  ((length(d.text) - length(replace(d.text, b.text, ''))) // length(b.text))::BIGINT AS occurrences
FROM documents d JOIN (SELECT DISTINCT text FROM benchmark) b ON contains(d.text, b.text)"""

LOG = f"WITH {MERGED_SQL}"
VISIBLE = f"""{MERGED_SQL},
visible AS (SELECT * FROM (SELECT session_id || '/' || thread_id || '/' || id AS text_id, session_id, first_seq, type,
    concat_ws(chr(10), nullif(text, ''), nullif(reasoning, ''), nullif(arguments, '')) AS text
  FROM merged WHERE type IN ('model.message', 'tool.response')) WHERE text <> '')"""
VISIBLE_HITS = hits_sql("visible", "text_id", "text")
SQL["pattern_hits_allowed"] = f"""WITH {VISIBLE}, {VISIBLE_HITS}
SELECT text_id, label, "offset", length(match)::BIGINT AS length, {EXCERPT} FROM hits WHERE match NOT IN ('p5@example.com', 'p18@example.com')"""

# Every value that occurs starts with five characters that occur, so the texts' five-grams
# thin out the pairs before the exact test.
_ID_CELLS = cells_sql("trial", {c: c for c in IDENTIFIERS}, "id_cells")
SCANNED = f"""{TRIAL_SQL}, {_ID_CELLS},
dictionary AS (SELECT DISTINCT name, value, s FROM id_cells WHERE length(s) >= 5),
grams AS (SELECT DISTINCT text_id, substr(text, unnest(range(1, length(text) - 3)), 5) AS g FROM {{texts}}),
found AS (SELECT DISTINCT d.s FROM (SELECT DISTINCT s FROM dictionary) d JOIN grams ON g = left(d.s, 5)
    JOIN {{texts}} t ON t.text_id = grams.text_id AND contains(t.text, d.s)),
scanned AS (SELECT name, count(*) AS values_compared, count(found.s) AS distinct_values_found
  FROM dictionary LEFT JOIN found ON found.s = dictionary.s GROUP BY name)"""
SQL["value_scan_anchored"] = f"""WITH {VISIBLE}, {SCANNED.format(texts='visible')}
SELECT name AS "column", values_compared, distinct_values_found FROM scanned"""
SQL["value_scan_sliced"] = SQL["value_scan_anchored"]


def boundary_sql(texts: str, corpora: list[tuple[str, str]], incomplete: str = "0::BIGINT") -> str:
    """The verdict row over ``texts``; ``corpora`` are (table, row text) pairs to settle lookalikes in."""
    lines = " UNION ALL ".join(f"SELECT {expr} AS line FROM {source}" for source, expr in corpora)
    return f"""{hits_sql(texts, 'text_id', 'text', canaries={'ssn': CANARY_SSN, 'name': CANARY_NAME})},
corpus AS ({lines}),
suspects AS (SELECT DISTINCT match AS c FROM hits WHERE severity = 'pattern' AND match NOT IN ('{CANARY_SSN}', '{CANARY_NAME}')),
settled AS (SELECT c FROM suspects WHERE EXISTS (SELECT 1 FROM corpus WHERE contains(line, c))),
totals AS (SELECT (SELECT count(*) FROM {texts}) AS texts, (SELECT coalesce(sum(length(text)), 0)::BIGINT FROM {texts}) AS chars_scanned,
  (SELECT count(*) FROM hits WHERE severity = 'canary') AS canary_hits, (SELECT count(*) FROM hits WHERE severity = 'pattern') AS pattern_hits,
  (SELECT count(*) FROM suspects) AS lookalikes, (SELECT count(*) FROM settled) AS lookalikes_real,
  8::BIGINT AS columns_checked, (SELECT sum(values_compared)::BIGINT FROM scanned) AS values_compared,
  (SELECT sum(distinct_values_found)::BIGINT FROM scanned) AS values_found, {incomplete} AS sessions_incomplete),
boundary AS (SELECT *, CASE WHEN canary_hits > 0 THEN 'canary' WHEN lookalikes_real > 0 THEN 'lookalike found in the data'
    WHEN values_found > 0 THEN 'identifier value' WHEN values_compared = 0 THEN 'no values compared'
    WHEN sessions_incomplete > 0 THEN 'incomplete history' END AS first_failure FROM totals)"""


_TRIAL_LINE = " || ',' || ".join(COLUMNS)
_SCRUB_LINE = "concat_ws(',', subject_pseudo_id, coalesce(age_band, ''), site, arm, baseline, followup, outcome_measure, adverse_event)"
# Sessions of the log whose numbers have a hole: a message of the assistant has three numbers, every other event one.
_LOG_GAPS = """(SELECT count(*) FROM (SELECT session_id FROM (SELECT DISTINCT session_id,
    unnest(CASE WHEN id LIKE 'm-%' THEN [first_seq, first_seq + 1, first_seq + 2] ELSE [first_seq] END) AS seq FROM merged)
  GROUP BY session_id HAVING max(seq) - min(seq) + 1 <> count(*)))"""
SQL["boundary_verdict"] = f"""WITH {VISIBLE}, {SCANNED.format(texts='visible')}, {boundary_sql('visible', [('trial', _TRIAL_LINE)], _LOG_GAPS)}
SELECT *, first_failure IS NULL AS passed FROM boundary"""
SQL["boundary_documents"] = f"""WITH texts AS (SELECT doc_id AS text_id, text FROM documents),
{SCANNED.format(texts='texts')}, {boundary_sql('texts', [('trial', _TRIAL_LINE)])}
SELECT *, first_failure IS NULL AS passed FROM boundary"""
SQL["leak_proof_summary"] = f"""WITH {VISIBLE}, {SCANNED.format(texts='visible')}, {scrub_sql()},
{boundary_sql('visible', [('trial', _TRIAL_LINE), ('scrubbed', _SCRUB_LINE)], _LOG_GAPS)}
SELECT (SELECT count(*) FROM trial) AS data_rows, 8::BIGINT AS identifier_columns,
  (SELECT count(*) FROM (SELECT DISTINCT session_id, thread_id FROM merged WHERE thread_id NOT IN ('main', '__turn__'))) AS subagent_threads,
  texts, chars_scanned, canary_hits, pattern_hits, lookalikes, lookalikes_real, values_compared, values_found, sessions_incomplete, first_failure,
  first_failure IS NULL AS passed FROM boundary"""

# --- event log ------------------------------------------------------------------------

SQL["merge_deltas"] = f"""{LOG} SELECT session_id, thread_id, id, type, first_seq, last_seq, length(text)::BIGINT AS n_chars,
  sha256(text) AS digest, reasoning FROM merged"""
SQL["event_order"] = f"""{LOG} SELECT session_id, thread_id, id, min(first_seq) OVER (PARTITION BY session_id, thread_id) AS thread_first_seq, first_seq,
  row_number() OVER (PARTITION BY session_id, thread_id ORDER BY first_seq, id) AS position FROM merged"""
SQL["visible_text"] = f"WITH {VISIBLE} SELECT text_id, first_seq, type, text FROM visible"
SQL["main_text"] = f"""{LOG} SELECT session_id, id, first_seq, text FROM merged
WHERE thread_id = 'main' AND type = 'model.message' AND text <> ''"""
SQL["thread_summary"] = f"""{LOG} SELECT session_id, thread_id, sum(CASE WHEN id LIKE 'm-%' THEN 3 ELSE 1 END)::BIGINT AS raw_events,
  count(*) AS merged_events, min(first_seq) AS first_seq, bool_or(type = 'thread.done') AS done,
  thread_id NOT IN ('main', '__turn__') AS is_subagent FROM merged GROUP BY session_id, thread_id"""
SQL["session_summary"] = f"""{LOG} SELECT session_id, max(last_seq) AS last_sequence, max(CASE WHEN type = 'turn.created' THEN id END) AS turn_id,
  max(CASE WHEN type = 'sandbox.created' THEN id END) AS sandbox_id FROM merged GROUP BY session_id"""
SQL["last_sequence"] = "SELECT user_id::VARCHAR AS session_id, max(event_id)::BIGINT AS last_sequence FROM events GROUP BY user_id"
SQL["event_type_histogram"] = "SELECT event_type, count(*) AS n FROM events GROUP BY event_type"
SQL["log_type_histogram"] = f"""{LOG} SELECT type, count(*) AS n FROM merged GROUP BY type
UNION ALL SELECT 'model.message.delta', 2 * count(*) FROM merged WHERE id LIKE 'm-%'"""
SQL["sequence_gaps"] = """SELECT conv_id::VARCHAR AS session_id, min(turn) AS first_seq, max(turn) AS last_seq, count(DISTINCT turn) AS distinct_seqs,
  count(*) - count(DISTINCT turn) AS duplicates, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS missing, 0::BIGINT AS malformed,
  max(turn) - min(turn) + 1 = count(DISTINCT turn) AS complete FROM conversations GROUP BY conv_id"""
# Every number of the raw log: a message of the assistant has three, every other event one.
_NUMBERS = f"""{LOG}, numbers AS (SELECT DISTINCT session_id, unnest(CASE WHEN id LIKE 'm-%' THEN [first_seq, first_seq + 1, first_seq + 2] ELSE [first_seq] END) AS seq FROM merged),
gaps AS (SELECT session_id, min(seq)::BIGINT AS first_seq, max(seq)::BIGINT AS last_seq, count(*) AS distinct_seqs, 0::BIGINT AS malformed,
  (max(seq) - min(seq) + 1 - count(*))::BIGINT AS missing, max(seq) - min(seq) + 1 = count(*) AS complete FROM numbers GROUP BY session_id)"""
SQL["stream_gaps"] = f"{_NUMBERS} SELECT * FROM gaps"
_RESULTS = f"""{LOG}, e AS (SELECT s::VARCHAR AS session_id, 't-' || conv_id::VARCHAR || '-' || turn::VARCHAR AS id, pos + 8 AS first_seq,
  (conv_id + turn)%30 <> 0 AS success, CASE WHEN (conv_id + turn)%30 = 0 THEN NULL WHEN (conv_id + turn)%10 = 0 THEN 1 ELSE 0 END::BIGINT AS exit_code,
  output, lane FROM results)"""
SQL["exec_results"] = f"{_RESULTS} SELECT session_id, id, first_seq, success, exit_code, output FROM e"
SQL["exec_failures"] = f"""{_RESULTS} SELECT session_id, id, first_seq, exit_code, length(output)::BIGINT AS output_chars FROM e
WHERE NOT success OR exit_code <> 0"""
_PAYLOADS = f"""{_RESULTS}, payloads AS (SELECT *, regexp_extract(output, '\\{{"check".*?null\\}}') AS payload FROM e WHERE output <> '')"""
SQL["embedded_payloads"] = f"{_PAYLOADS} SELECT session_id, id, first_seq, 0::BIGINT AS ordinal, payload FROM payloads"
SQL["embedded_payloads_sql"] = SQL["embedded_payloads"]
SQL["bound_payloads"] = f"""{_PAYLOADS} SELECT session_id, 'verification' AS kind, arg_min(payload, first_seq) AS payload
FROM payloads WHERE lane IN (0, 3) GROUP BY session_id"""
SQL["rejected_payloads"] = f"""{_PAYLOADS} SELECT 'verification' AS kind, CASE WHEN lane = 1 THEN 'other run' ELSE 'malformed' END AS reason,
  count(*) AS n FROM payloads WHERE lane IN (1, 2) GROUP BY ALL"""

# --- streaming ------------------------------------------------------------------------

SQL["stream_merge"] = SQL["merge_deltas"]
SQL["stream_value_scan"] = SQL["value_scan_anchored"]
SQL["stream_live_hits"] = f"""WITH {VISIBLE}, {VISIBLE_HITS}
SELECT text_id, label, "offset", length(match)::BIGINT AS length, {EXCERPT} FROM hits"""

SQL["stream_verdict"] = f"""WITH {VISIBLE}, {VISIBLE_HITS}, {_NUMBERS[len(LOG) + 2:]}
SELECT (SELECT count(*) FROM gaps) AS sessions, (SELECT count(*) FROM gaps WHERE NOT complete) AS sessions_incomplete, 0::BIGINT AS canary_hits,
  (SELECT count(*) FROM hits) AS pattern_hits, (SELECT bool_and(complete) FROM gaps) AS complete, (SELECT bool_and(complete) FROM gaps) AS passed"""
SQL["stream_evicted"] = f"""{LOG}, ended AS (SELECT DISTINCT s::VARCHAR AS session_id FROM conv WHERE s%4 <> 3),
rows AS (SELECT session_id, thread_id, id, type, text FROM merged
  UNION ALL SELECT session_id, '__turn__', 'done-' || session_id, 'turn.done', '' FROM ended
  UNION ALL SELECT 'clock', '__turn__', 'clock', 'clock', '')
SELECT session_id, thread_id, id, type, length(text)::BIGINT AS n_chars, sha256(text) AS digest,
  session_id IN (SELECT session_id FROM ended) AS evicted FROM rows"""
SQL["stream_late_verdict"] = f"""{LOG}, sent AS (SELECT session_id,
    unnest(CASE WHEN id LIKE 'm-%' THEN [first_seq, first_seq + 1, first_seq + 2] ELSE [first_seq] END) AS seq FROM merged
  UNION ALL SELECT 'clock', 3000000),
judged AS (SELECT *, seq%7 = 3 AND seq <= 400000 AS late FROM sent),
held AS (SELECT session_id, max(seq) - min(seq) + 1 = count(DISTINCT seq) AS complete FROM judged WHERE NOT late GROUP BY session_id)
SELECT (SELECT count(*) FROM judged) AS arrived, (SELECT count(*) FROM judged WHERE NOT late) AS taken,
  (SELECT count(*) FROM judged WHERE late) AS late, 0::BIGINT AS unaccounted, (SELECT count(*) FROM held) AS sessions,
  (SELECT count(*) FROM held WHERE NOT complete) AS sessions_incomplete,
  NOT EXISTS (SELECT 1 FROM judged WHERE late) AND NOT EXISTS (SELECT 1 FROM held WHERE NOT complete) AS passed"""
SQL["stream_trace"] = f"""WITH {VISIBLE}, masked AS (SELECT text_id, {_REDACTED} AS t FROM visible)
SELECT text_id, 0::BIGINT AS skipped, length(t)::BIGINT AS n_chars, sha256(t) AS digest FROM masked"""
SQL["stream_live_values"] = f"""WITH {VISIBLE}, {SCANNED.format(texts='visible')}
SELECT DISTINCT text_id, substr(sha256(s), 1, 12) AS fingerprint FROM found JOIN visible ON contains(text, s)"""
SQL["paged_history"] = SQL["merge_deltas"]
SQL["event_log_roundtrip"] = SQL["merge_deltas"]

# --- approval audit -------------------------------------------------------------------

SQL["approval_pending"] = f"""{LOG} SELECT s::VARCHAR AS session_id, 'main' AS thread_id,
  'call-' || s::VARCHAR || '-' || min(r)::VARCHAR AS tool_call_id,
  '{{"title":"Summary ' || s::VARCHAR || '","summary":"round ' || min(r)::VARCHAR || '"}}' AS arguments FROM rounds WHERE undecided GROUP BY s"""
SQL["approval_decisions"] = f"""{LOG} SELECT s::VARCHAR AS session_id, 1000002 + r*4 AS seq, 'call-' || s::VARCHAR || '-' || r::VARCHAR AS tool_call_id,
  NOT denied AS allowed, CASE WHEN denied THEN 'revise ' || r::VARCHAR END AS reason FROM rounds WHERE NOT undecided"""
# A run ends at an allow or after four denials: walk the decisions one by one.
_OUTCOME = f"""{LOG.replace('WITH', 'WITH RECURSIVE', 1)}, taken AS (SELECT s, 1000002 + r*4 AS seq, denied, 'revise ' || r::VARCHAR AS reason,
    row_number() OVER (PARTITION BY s ORDER BY r) AS k FROM rounds WHERE NOT undecided),
walk AS (SELECT s, k, seq, denied, reason, 0 AS run, 1 AS round FROM taken WHERE k = 1
  UNION ALL SELECT t.s, t.k, t.seq, t.denied, t.reason, CASE WHEN w.denied AND w.round < 4 THEN w.run ELSE w.run + 1 END,
    CASE WHEN w.denied AND w.round < 4 THEN w.round + 1 ELSE 1 END FROM walk w JOIN taken t ON t.s = w.s AND t.k = w.k + 1),
outcome AS (SELECT s, run::BIGINT AS run, bool_or(NOT denied) AS approved, count(*) AS rounds,
  coalesce(string_agg(reason, '|' ORDER BY k) FILTER (WHERE denied), '') AS denials, count(*) = 4 AND bool_and(denied) AS exhausted,
  max(seq)::BIGINT AS decided FROM walk GROUP BY s, run)"""
SQL["approval_outcome"] = f"{_OUTCOME} SELECT s::VARCHAR AS session_id, run, approved, rounds, denials, exhausted, decided FROM outcome"
# Releases in order, each uses the oldest unused approval before it.
SQL["release_reconciliation"] = f"""{_OUTCOME},
released AS (SELECT s, 1000003 + ((s//3)%6)*4 - CASE WHEN s%4 = 0 THEN 3 ELSE 0 END + copy AS moment FROM
  (SELECT s, unnest(range(CASE WHEN s%9 = 0 THEN 2 ELSE 1 END)) AS copy FROM conv WHERE turn = 0 AND lane = 0
    AND ((s%3 = 0 AND s%15 <> 0) OR s%21 = 1))),
numbered AS (SELECT s, moment, row_number() OVER (PARTITION BY s ORDER BY moment) AS k FROM released),
granted AS (SELECT s, decided, row_number() OVER (PARTITION BY s ORDER BY decided) AS k FROM outcome WHERE approved),
used AS (SELECT n.s, n.k, n.moment, 0 AS spent, (SELECT count(*) FROM granted g WHERE g.s = n.s AND g.decided <= n.moment) AS free
  FROM numbered n WHERE n.k = 1
  UNION ALL SELECT n.s, n.k, n.moment, u.spent + CASE WHEN u.free > u.spent THEN 1 ELSE 0 END,
    (SELECT count(*) FROM granted g WHERE g.s = n.s AND g.decided <= n.moment) FROM used u JOIN numbered n ON n.s = u.s AND n.k = u.k + 1),
counted AS (SELECT s, count(*) AS releases, count(*) FILTER (WHERE free <= spent) AS without_approval FROM used GROUP BY s),
sides AS (SELECT coalesce(g.s, c.s) AS s, coalesce(g.approvals, 0) AS approvals, coalesce(releases, 0) AS releases, coalesce(without_approval, 0) AS without_approval
  FROM (SELECT s, count(*) AS approvals FROM granted GROUP BY s) g FULL OUTER JOIN counted c ON g.s = c.s)
SELECT s::VARCHAR AS session_id, approvals, releases, without_approval, approvals - (releases - without_approval) AS not_released FROM sides
WHERE without_approval > 0 OR approvals - (releases - without_approval) > 0"""

# --- statistics -----------------------------------------------------------------------


def welch_sql(source: str, value: str, arm: str, treated: str, control: str, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    one = lambda fn, level: f"{fn}({value}) FILTER (WHERE {arm} = '{level}')"
    return f"""
moments AS (SELECT {keys}{one('count', treated)} AS n_t, {one('avg', treated)} AS mean_t, {one('stddev_samp', treated)} AS sd_t,
    {one('count', control)} AS n_c, {one('avg', control)} AS mean_c, {one('stddev_samp', control)} AS sd_c FROM {source} {group}),
spread AS (SELECT *, sd_t*sd_t/nullif(n_t, 0) AS e1, sd_c*sd_c/nullif(n_c, 0) AS e2, mean_t - mean_c AS difference FROM moments),
welch AS (SELECT {keys}n_t, mean_t, sd_t, n_c, mean_c, sd_c, difference, sqrt(e1 + e2) AS standard_error,
    difference / nullif(sqrt(e1 + e2), 0) AS t_statistic,
    (e1 + e2)*(e1 + e2) / nullif(e1*e1/nullif(n_t - 1, 0) + e2*e2/nullif(n_c - 1, 0), 0) AS degrees,
    difference / nullif(sqrt(((n_t - 1)*sd_t*sd_t + (n_c - 1)*sd_c*sd_c) / nullif(n_t + n_c - 2, 0)), 0) AS cohens_d FROM spread)"""


_W = ["mean_t", "sd_t", "mean_c", "sd_c", "difference", "standard_error", "t_statistic", "degrees", "cohens_d"]
_ROUNDED = "n_t, n_c, " + ", ".join(f"round({c}, 6) AS {c}" for c in _W)
_TRIAL_ARMS = ("scrubbed", "outcome_measure", "arm", "treatment", "placebo")
_LINES = ("lineitem", "l_extendedprice", "l_linestatus", "F", "O")
SQL["arm_summary"] = f"""{SCRUBBED} SELECT arm, count(outcome_measure) AS n, round(avg(outcome_measure), 6) AS mean,
  round(stddev_samp(outcome_measure), 6) AS sd FROM scrubbed GROUP BY arm"""
SQL["welch_primary"] = f"{SCRUBBED}, {welch_sql(*_TRIAL_ARMS)} SELECT {_ROUNDED} FROM welch"
SQL["welch_by_site"] = f"{SCRUBBED}, {welch_sql(*_TRIAL_ARMS, by='site, age_band')} SELECT site, age_band, {_ROUNDED} FROM welch"
SQL["welch_lineitem"] = f"WITH {welch_sql(*_LINES)} SELECT {_ROUNDED} FROM welch"
# p by Simpson's rule over the t density, the quantile by its expansion in 1/df.
SQL["welch_p"] = f"""WITH {welch_sql(*_LINES)},
grid AS (SELECT unnest(range(0, 4001)) AS k),
density AS (SELECT k, abs(t_statistic) / 4000 AS h,
    exp(lgamma((degrees + 1)/2) - lgamma(degrees/2)) / sqrt(degrees * 3.141592653589793)
      * pow(1 + (k*abs(t_statistic)/4000) * (k*abs(t_statistic)/4000) / degrees, -(degrees + 1)/2) AS f FROM welch, grid),
inside AS (SELECT sum(f * CASE WHEN k = 0 OR k = 4000 THEN 1 WHEN k%2 = 1 THEN 4 ELSE 2 END) * max(h) / 3 AS area FROM density),
z AS (SELECT 1.959963984540054::DOUBLE AS z),
quantile AS (SELECT z + (pow(z, 3) + z)/(4*degrees) + (5*pow(z, 5) + 16*pow(z, 3) + 3*z)/(96*degrees*degrees) AS q FROM welch, z)
SELECT round(1 - 2*area, 5) AS p_value, round(difference - q*standard_error, 5) AS ci_low, round(difference + q*standard_error, 5) AS ci_high
FROM welch, inside, quantile"""


def chi2_sql(source: str, row: str, column: str, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    using = f"USING ({by})" if by else "ON TRUE"
    cell_using = f"USING ({keys}r, c)"
    group = f"GROUP BY {by}" if by else ""
    return f"""
o AS (SELECT {keys}{row}::VARCHAR AS r, {column}::VARCHAR AS c, count(*) AS o FROM {source}
  WHERE {row} IS NOT NULL AND {column} IS NOT NULL GROUP BY ALL),
rt AS (SELECT {keys}r, sum(o) AS rt FROM o GROUP BY ALL), ct AS (SELECT {keys}c, sum(o) AS ct FROM o GROUP BY ALL),
tt AS (SELECT {keys}sum(o) AS n, (count(DISTINCT r) - 1) * (count(DISTINCT c) - 1) AS degrees FROM o {group}),
g AS (SELECT *, rt * ct / n::DOUBLE AS e FROM rt JOIN ct {using} JOIN tt {using}),
x AS (SELECT {keys}n, degrees, e, abs(coalesce(o, 0) - e) AS gap FROM g LEFT JOIN o {cell_using}),
y AS (SELECT *, CASE WHEN degrees = 1 THEN gap - least(0.5, gap) ELSE gap END AS d FROM x),
chi AS (SELECT {keys}round(sum(d*d/e), 6) AS chi2, max(degrees)::BIGINT AS degrees, max(n)::BIGINT AS n, sum(d*d/e) AS raw FROM y {group})"""


SQL["chi2_safety"] = f"{SCRUBBED}, {chi2_sql('scrubbed', 'arm', 'adverse_event')} SELECT chi2, degrees, n FROM chi"
SQL["chi2_by_site"] = f"{SCRUBBED}, {chi2_sql('scrubbed', 'arm', 'adverse_event', 'site')} SELECT site, chi2, degrees, n FROM chi"
SQL["chi2_orders"] = f"""WITH {chi2_sql('orders', 'o_orderstatus', 'o_orderpriority')}
SELECT chi2, degrees, n, round(exp(-raw/2) * (1 + raw/2 + pow(raw/2, 2)/2 + pow(raw/2, 3)/6), 6) AS p_value FROM chi"""
SQL["contingency_safety"] = f"""{SCRUBBED} SELECT arm AS "row", adverse_event::VARCHAR AS "column", count(*) AS observed FROM scrubbed
WHERE arm IS NOT NULL AND adverse_event IS NOT NULL GROUP BY ALL"""
SQL["disposition"] = f"""{SCRUBBED} SELECT arm, count(*) AS randomised, count(outcome_measure) AS completed,
  count(*) FILTER (WHERE outcome_measure IS NULL) AS dropped_out FROM scrubbed GROUP BY arm"""
_REPORT = [
    ("disposition", "randomised", "count(*)"), ("disposition", "completed", "count(outcome_measure)"),
    ("disposition", "dropped_out", "count(*) - count(outcome_measure)"), ("primary", "mean", "avg(outcome_measure)"),
    ("primary", "sd", "stddev_samp(outcome_measure)"), ("safety", "adverse", "count(*) FILTER (WHERE adverse_event = 1)"),
    ("safety", "no_adverse", "count(*) FILTER (WHERE adverse_event = 0)"),
]
SQL["report_table"] = (
    f"{SCRUBBED}, {welch_sql(*_TRIAL_ARMS)}, {chi2_sql('scrubbed', 'arm', 'adverse_event')} "
    + " UNION ALL ".join(
        f"SELECT '{section}' AS section, '{metric}' AS metric, arm, round(({expr})::DOUBLE, 6) AS value FROM scrubbed GROUP BY arm"
        for section, metric, expr in _REPORT
    )
    + "".join(
        f" UNION ALL SELECT 'primary', '{m}', 'both', round({m}, 6) FROM welch"
        for m in ("difference", "standard_error", "t_statistic", "degrees", "cohens_d")
    )
    + " UNION ALL SELECT 'safety', 'chi2', 'both', chi2 FROM chi"
)

SQL["analysis_document"] = f"""{SCRUBBED}, {welch_sql(*_TRIAL_ARMS)}, {chi2_sql('scrubbed', 'arm', 'adverse_event')}
SELECT 'run-1' AS run_id, round(difference, 6) AS difference, round(t_statistic, 6) AS t_statistic, round(cohens_d, 6) AS cohens_d,
  round(mean_t, 6) AS mean_t, round(sd_c, 6) AS sd_c, chi2,
  (SELECT count(*) FROM scrubbed WHERE arm = 'treatment' AND adverse_event = 1)::DOUBLE AS adverse_t,
  (SELECT count(*) FROM scrubbed WHERE arm = 'placebo' AND outcome_measure IS NULL)::DOUBLE AS dropped_c FROM welch, chi"""

SQL["aggregate_only_report"] = f"""WITH report AS ({SQL['report_table']}),
flat AS (SELECT metric AS metric_name, concat_ws(' ', section, metric, arm, value) AS text FROM report),
{hits_sql('flat', 'metric_name', 'text', canaries={'ssn': CANARY_SSN, 'name': CANARY_NAME})} SELECT count(*) AS hits FROM hits"""

# Twice the normal tail beyond sqrt(chi2), by Simpson's rule.
SQL["chi2_yates_p"] = f"""{SCRUBBED}, {chi2_sql('scrubbed', 'arm', 'adverse_event')},
grid AS (SELECT unnest(range(0, 4001)) AS k),
area AS (SELECT sum(exp(-(k*sqrt(raw)/4000)*(k*sqrt(raw)/4000)/2) / sqrt(2*3.141592653589793)
    * CASE WHEN k = 0 OR k = 4000 THEN 1 WHEN k%2 = 1 THEN 4 ELSE 2 END) * max(sqrt(raw)) / 4000 / 3 AS a FROM chi, grid)
SELECT degrees, round(1 - 2*a, 5) AS p_value FROM chi, area"""

# --- sources and sinks ------------------------------------------------------------------

SQL["csv_roundtrip"] = """SELECT page_id::VARCHAR AS key, coalesce(url, '') AS url, sha256(coalesce(html, '')) AS digest FROM pages
UNION ALL SELECT c_custkey::VARCHAR, '  ' || c_name || chr(9) || '"x",' || chr(10) || 'y ', sha256(coalesce(c_mktsegment, '')) FROM customer"""
SQL["csv_types"] = """SELECT 'string' AS name_type, sum(c_custkey)::BIGINT AS keys, sum(c_nationkey)::BIGINT AS nations FROM customer"""
SQL["corpus_lines"] = """WITH parts AS (SELECT 'pages' AS corpus, html AS t FROM pages UNION ALL SELECT 'documents', text FROM documents),
lines AS (SELECT corpus, unnest(string_split(replace(replace(regexp_replace(coalesce(t, ''), '(\r\n|\r|\n)$', ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS line FROM parts)
SELECT corpus, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars, 2::BIGINT AS sources FROM lines GROUP BY corpus"""
SQL["json_documents"] = "SELECT conv_id, turn, role, nullif(text, '') AS text FROM conversations"
SQL["scrubbed_sink"] = SQL["scrub_trial"]
SQL["classify_file"] = SQL["verdict_columns"]
SQL["candidate_list"] = "SELECT DISTINCT substr(sha256(text), 1, 12) AS fingerprint FROM benchmark"
SQL["minted_once"] = f"WITH {TRIAL_SQL} SELECT count(*) FILTER (WHERE i = 41) AS ssn_rows, count(*) FILTER (WHERE i = 41) AS name_rows FROM trial"
SQL["releases_of_approvals"] = f"""{_OUTCOME} SELECT s::VARCHAR AS session_id, decided + 1 AS at, 'Summary' AS title, true AS reconciled
FROM outcome WHERE approved"""
SQL["release_log_rows"] = f"""{_OUTCOME} SELECT s::VARCHAR AS session_id, decided + 1 AS at, 'Summary' AS title FROM outcome WHERE approved"""
SQL["release_commits"] = f"""{_OUTCOME}, gone AS (SELECT s, decided, decided + 1 AS moment FROM outcome WHERE approved)
SELECT s::VARCHAR AS session_id, decided, moment AS at, 'Summary ' || s::VARCHAR AS title,
  moment > decided AND count(*) OVER (PARTITION BY s) = (SELECT count(*) FROM outcome o WHERE o.s = gone.s AND o.approved) AS reconciled FROM gone"""
SQL["stream_resumed"] = SQL["merge_deltas"]
SQL["stream_deduplicated"] = f"{_NUMBERS} SELECT session_id, distinct_seqs AS n_events FROM gaps"
