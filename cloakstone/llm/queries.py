"""Registered queries of the corpus operators, each over its whole table, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from cloakstone.llm import attention_lm, bpe, chunks, conversations, decontaminate, html_cut, importance, line_runs, minhash, mixing, quality_model, quality_rules, url_filter
from cloakstone.sources.session import tune

# The URL rules of the contract.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

WORD_PIECES = "/opt/tokenizers/word_bpe_49k.json"  # a public vocabulary; the path is a parameter of the operator


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in URL_RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS rules(host, path, verdict)")
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), rules)


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.repeated_spans(_table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge_text(F.col("text"))
    return (
        _table(spark, sf_dir, "documents")
        .select("doc_id", judged.alias("judged"))
        .select(
            "doc_id",
            *[f"judged.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
            "judged.base_failed",
            "judged.lost_words",
            "judged.kept",
            F.length("judged.cleaned").cast("long").alias("cleaned_chars"),
            F.sha2("judged.cleaned", 256).alias("cleaned_sha256"),
        )
    )


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.score_texts(_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_runs.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select(
        "doc_id",
        F.col("__n_lines").alias("n_lines"),
        F.col("__n_dropped").alias("n_dropped"),
        F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"),
    )


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_cut.extract(_table(spark, sf_dir, "pages"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coder = bpe.build(docs, WORD_PIECES)
    report = bpe.digests(bpe.encode(F.col("text"), coder), coder)
    return docs.select("doc_id", report.alias("report")).select("doc_id", "report.*")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.report(conversations.damaged(_table(spark, sf_dir, "conversations")), "dropped")


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_minhash": op2_minhash,
    "op3_mixing": op3_mixing,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_quality_rules": op6_quality_rules,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_decontamination": op8_decontamination,
    "op9_line_dedup": op9_line_dedup,
    "op10_html_extraction": op10_html_extraction,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_bpe": op12_bpe,
    "op13_conversation_repair": op13_conversation_repair,
    "pipeline": corpus_pipeline.run,
}

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_W = "[^\\x20\\x09-\\x0D]+"
_SEPARATOR = "x IN ('|', '>', '/', '»', '•', '·', '::')"
_PHRASE = "|".join(p.decode().replace("(", "[(]").replace(")", "[)]") for p in quality_rules.PHRASES)

_CRC_TABLE = """crc_table AS (
    SELECT list_transform(range(256), lambda i: list_reduce(range(8),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS tab)"""


def _crc(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes in SQL; ``tab`` is the table of :data:`_CRC_TABLE`."""
    byte = f"('0x' || substr(hex({text}), 2 * k + 1, 2))::BIGINT"
    return (
        f"xor(list_reduce(list_transform(range(strlen({text})), lambda k: {byte}), "
        "lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"
    )


SQL = {
    "op1_url_filter": f"""
WITH rules(r_host, r_path, r_verdict) AS (
    VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
           ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
cut AS (
    SELECT page_id, row_number() OVER () AS n,
           CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
    FROM pages),
parts AS (
    SELECT page_id, n, translate(regexp_extract(rest, '^[^/?#]*'), '{_UP}', '{_LOW}') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM cut),
fits AS (
    SELECT n, r_host || r_path AS rule, r_verdict,
           row_number() OVER (PARTITION BY n ORDER BY length(r_host || r_path) DESC, length(r_host) DESC) AS place
    FROM parts JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM fits WHERE place = 1) USING (n)
""",
    "op2_minhash": f"""
WITH RECURSIVE texts AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\\x20\\x09-\\x0D]+') AS w
    FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s
    FROM texts),
sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
    SELECT one.doc_id AS a, two.doc_id AS b, count(*) AS c FROM shingles one JOIN shingles two USING (s)
    WHERE one.doc_id <> two.doc_id GROUP BY a, b),
links AS (
    SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reached AS (
    SELECT doc_id, doc_id AS other FROM texts
    UNION SELECT doc_id, b FROM reached JOIN links ON a = other)
SELECT doc_id, coalesce(n, 0) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
FROM reached LEFT JOIN sizes USING (doc_id) GROUP BY doc_id, n
""",
    "op3_mixing": """
WITH sized AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size
    FROM documents),
sources AS (
    SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
    SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT] AS w FROM sources),
filled AS (
    SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w,
           coalesce(sum(source_size) OVER (ORDER BY source_size / w, source NULLS LAST
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
           coalesce(sum(w) OVER (ORDER BY source_size / w, source NULLS LAST
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held_w
    FROM ranked),
levels AS (
    SELECT *, (1.5::DOUBLE * total - 2.0::DOUBLE * held) / (all_w - held_w) AS level FROM filled),
chosen AS (
    SELECT level FROM levels WHERE 2.0::DOUBLE * source_size >= level * w
    ORDER BY source_size / w, source NULLS LAST LIMIT 1),
aimed AS (
    SELECT source, source_size, least(2.0::DOUBLE * source_size, chosen.level * w) AS target FROM ranked, chosen),
rated AS (
    SELECT doc_id, size, source_size, target,
           CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
           ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE
               / 4503599627370496 AS u
    FROM sized JOIN aimed ON sized.source IS NOT DISTINCT FROM aimed.source)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
""",
    "op6_quality_rules": f"""
WITH texts AS (
    SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '{_W}') AS w FROM documents),
lines AS (
    SELECT n, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM texts),
counted AS (
    SELECT *, regexp_extract_all(line, '{_W}') AS w,
           length(regexp_replace(line, '[^A-Za-z]', '', 'g')) AS letters, length(regexp_replace(line, '[^A-Z]', '', 'g')) AS capitals,
           length(regexp_replace(line, '[^!]', '', 'g')) AS marks, length(regexp_replace(line, '[^.!?;:,]', '', 'g')) AS stops
    FROM lines),
judged AS (
    SELECT *, len(w) AS words, len(list_filter(w, lambda x: {_SEPARATOR})) AS separators,
           len(list_filter(w, lambda x: regexp_matches(x, '[#*$%&|<>]') AND NOT {_SEPARATOR})) AS marked,
           regexp_matches(w[-1], '[.!?:;"'')\\]}}…”’»]$') AS closed, row_number() OVER (PARTITION BY n, line ORDER BY pos) > 1 AS again
    FROM counted),
flagged AS (
    SELECT *, coalesce((NOT closed AND words >= 12 AND 20 * stops < words) OR (words > 0 AND 3 * marked >= words)
        OR (words >= 3 AND 10 * capitals >= 7 * letters AND 2 * marks >= words) OR (separators >= 2 AND 6 * separators >= words)
        OR (words <= 40 AND regexp_matches(translate(line, '{_UP}', '{_LOW}'), '{_PHRASE}')), false) AS bad
    FROM judged),
lost AS (
    SELECT n, count(*) FILTER (WHERE again AND words > 0) AS n_dup_lines, coalesce(sum(words) FILTER (WHERE bad), 0)::BIGINT AS lost_words,
           coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT bad), '') AS cleaned
    FROM flagged GROUP BY n),
windows AS (
    SELECT n, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT n, w, unnest(range(1, len(w) - 6)) AS i FROM texts)),
twice AS (
    SELECT n, i FROM (SELECT *, count(*) OVER (PARTITION BY n, s) AS c FROM windows) WHERE c > 1),
covered AS (
    SELECT n, count(DISTINCT i + k)::BIGINT AS c FROM twice, (SELECT unnest(range(8)) AS k) GROUP BY n),
base AS (
    SELECT n, doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
           length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, n_dup_lines,
           coalesce(c, 0) AS n_repeat_words, lost_words, length(cleaned)::BIGINT AS cleaned_chars, sha256(cleaned) AS cleaned_sha256
    FROM texts JOIN lost USING (n) LEFT JOIN covered USING (n)),
failed AS (
    SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)
SELECT * EXCLUDE (n), NOT base_failed AND 10 * lost_words <= 6 * n_words AS kept FROM failed
""",
    "op9_line_dedup": f"""
WITH texts AS (
    SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
    SELECT n, doc_id, unnest(string_split(text, chr(10))) AS line,
           generate_subscripts(string_split(text, chr(10)), 1) AS pos
    FROM texts),
keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UP}', '{_LOW}') AS key
    FROM lines),
frequent AS (
    SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 AND doc_id IS NOT NULL
    GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (
    SELECT n, pos, line, keeper IS NOT NULL AND doc_id <> keeper AS dropped
    FROM keyed LEFT JOIN frequent USING (key)),
kept AS (
    SELECT n, count(*) AS n_lines, count(*) FILTER (WHERE dropped IS TRUE) AS n_dropped,
           coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE dropped IS NOT TRUE), '') AS text
    FROM judged GROUP BY n)
SELECT doc_id, n_lines, n_dropped, sha256(kept.text) AS kept_sha256 FROM texts JOIN kept USING (n)
""",
    "op11_importance_resampling": f"""
WITH {_CRC_TABLE},
texts AS (
    SELECT row_number() OVER () AS n, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w
    FROM documents),
aimed AS (
    SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS f
    FROM benchmark),
had AS (
    SELECT n, unnest(w) AS f FROM texts),
hashed AS (
    SELECT f, {_crc('f')} % 10000 AS bucket FROM (SELECT f FROM had UNION SELECT f FROM aimed), crc_table),
source AS (
    SELECT bucket, count(*) AS s FROM had JOIN hashed USING (f) GROUP BY bucket),
target AS (
    SELECT bucket, count(*) AS t FROM aimed JOIN hashed USING (f) GROUP BY bucket),
totals AS (
    SELECT (SELECT count(*) FROM had) + 10000 AS all_s, (SELECT count(*) FROM aimed) + 10000 AS all_t),
gains AS (
    SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * all_s)::DOUBLE / ((s + 1) * all_t)::DOUBLE))::BIGINT AS gain
    FROM source LEFT JOIN target USING (bucket), totals),
weights AS (
    SELECT n, sum(gain) AS gained FROM had JOIN hashed USING (f) JOIN gains USING (bucket) GROUP BY n),
scored AS (
    SELECT doc_id, len(w) AS n_features,
           CASE WHEN len(w) = 0 THEN 0 ELSE (gained - ((gained % len(w)) + len(w)) % len(w)) // len(w) END::BIGINT AS weight,
           floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE)
               / 4294967296::DOUBLE)))::BIGINT AS luck
    FROM texts LEFT JOIN weights USING (n)),
placed AS (
    SELECT doc_id, n_features, weight, weight + luck AS score,
           row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + luck DESC, doc_id, n_features) AS place,
           10 * count(*) FILTER (WHERE n_features >= 20) OVER () // 100 AS drawn
    FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= drawn THEN place END AS rank FROM placed
""",
    "op13_conversation_repair": f"""
WITH RECURSIVE {_CRC_TABLE},
harmed AS (
    SELECT row_number() OVER () AS given, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           {_crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS harm
    FROM conversations, crc_table),
after AS (
    SELECT given, copy, conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
           CASE harm WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
    FROM harmed, (VALUES (1), (2)) twice(copy) WHERE harm <> 0 AND (copy = 1 OR harm = 3)),
ranked AS (
    SELECT *, left(role, 1) AS r, row_number() OVER own AS i, row_number() OVER (PARTITION BY conv_id, role, text
           ORDER BY turn NULLS FIRST, given, copy) AS nth,
           right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last
    FROM after WINDOW own AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, given, copy)),
judged AS (
    SELECT *, lead(r) OVER (PARTITION BY conv_id ORDER BY i) AS next_r,
           CASE WHEN last = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated'
                ELSE '' END AS fault
    FROM ranked),
counted AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
           count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
           count(*) FILTER (WHERE fault = 'truncated') AS truncated,
           count(*) FILTER (WHERE next_r IS NOT NULL AND r || ':' || next_r NOT IN ('s:u', 'u:a', 'a:u')) AS illegal,
           count(*) AS n
    FROM judged GROUP BY conv_id),
options AS (
    -- costs of keeping at the four places (start, s, u, a), and of renaming; 1000000 for never
    SELECT conv_id, i, role, text,
           CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000 WHEN fault = 'truncated' THEN 6 ELSE 1 END AS ren,
           CASE WHEN fault IN ('blank', 'duplicate') OR r NOT IN ('s', 'u') THEN 1000000 WHEN fault = 'truncated' THEN 5 ELSE 0 END AS k0,
           CASE WHEN fault IN ('blank', 'duplicate') OR r <> 'u' THEN 1000000 WHEN fault = 'truncated' THEN 5 ELSE 0 END AS k1,
           CASE WHEN fault IN ('blank', 'duplicate') OR r <> 'a' THEN 1000000 WHEN fault = 'truncated' THEN 5 ELSE 0 END AS k2,
           r = 's' AS is_s
    FROM judged),
costs(conv_id, i, f0, f1, f2, f3) AS (
    -- cost of finishing from each place before row i
    SELECT conv_id, n + 1, 0, 10, 5, 0 FROM counted
    UNION ALL
    SELECT conv_id, i - 1, least(g0, 5 + g2, 10 + g3), least(g1, 5 + g2, 10 + g3), least(g2, 5 + g3), least(g3, 5 + g2)
    FROM (
        SELECT c.conv_id, c.i, least(2 + f0, ren + f2, k0 + CASE WHEN is_s THEN f1 ELSE f2 END) AS g0,
               least(2 + f1, ren + f2, k1 + f2) AS g1, least(2 + f2, ren + f3, k2 + f3) AS g2, least(2 + f3, ren + f2, k1 + f2) AS g3
        FROM costs c JOIN options o ON o.conv_id IS NOT DISTINCT FROM c.conv_id AND o.i = c.i - 1)),
walk(conv_id, i, place, audit, parts, done) AS (
    SELECT conv_id, 1::BIGINT, 0, '', []::VARCHAR[], false FROM counted
    UNION ALL
    SELECT conv_id, CASE WHEN e IN ('D', 'K', 'R') THEN i + 1 ELSE i END,
           CASE WHEN e IN ('D', '') THEN place WHEN e = 'K' AND is_s THEN 1 WHEN place = 2 THEN 3 ELSE 2 END, audit || e,
           CASE WHEN e IN ('D', '') THEN parts WHEN e = 'K' THEN list_append(parts, role || ':' || text)
                ELSE list_append(parts, CASE WHEN place = 2 THEN 'assistant:' ELSE 'user:' END
                                        || CASE WHEN e = 'R' THEN text ELSE '' END) END,
           e = ''
    FROM (
        SELECT w.*, o.role, o.text, o.is_s,
               CASE WHEN o.i IS NULL THEN CASE WHEN place IN (1, 2) THEN 'I' ELSE '' END
                    WHEN here = 2 + list_extract([d.f0, d.f1, d.f2, d.f3], place + 1) THEN 'D'
                    WHEN here = 5 + CASE WHEN place = 2 THEN c.f3 ELSE c.f2 END THEN 'I'
                    WHEN here = CASE place WHEN 0 THEN k0 WHEN 2 THEN k2 ELSE k1 END
                         + CASE WHEN place = 0 AND is_s THEN d.f1 WHEN place = 2 THEN d.f3 ELSE d.f2 END THEN 'K'
                    ELSE 'R' END AS e
        FROM (SELECT * FROM walk WHERE NOT done) w
        JOIN costs c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.i = w.i
        LEFT JOIN costs d ON d.conv_id IS NOT DISTINCT FROM w.conv_id AND d.i = w.i + 1
        LEFT JOIN options o ON o.conv_id IS NOT DISTINCT FROM w.conv_id AND o.i = w.i,
        LATERAL (SELECT list_extract([c.f0, c.f1, c.f2, c.f3], place + 1) AS here))),
mended AS (
    SELECT conv_id, audit, array_to_string(parts, chr(10)) AS repaired FROM walk WHERE done)
SELECT all_ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(f0, 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) all_ids
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM all_ids.conv_id
LEFT JOIN costs f ON f.conv_id IS NOT DISTINCT FROM all_ids.conv_id AND f.i = 1
LEFT JOIN mended m ON m.conv_id IS NOT DISTINCT FROM all_ids.conv_id
""",
}
