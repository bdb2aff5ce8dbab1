"""The registered queries: thin forms of the operators over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import containment, convrepair, exactdedup, ledger, linededup, mainhtml, mixing, pii, simhash, suffixdedup, urlfilter, warc, whitening
from .common import table

# Keys as the operator makes them. DuckDB's trim takes a set of characters.
OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, text, UNNEST(string_split(COALESCE(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(COALESCE(text, ''), chr(10)), 1) AS n
  FROM documents
), keyed AS (
  SELECT doc_id, n, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), repeated AS (
  SELECT key, MIN(doc_id) AS least FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING COUNT(DISTINCT doc_id) >= 2
)
SELECT k.doc_id, COUNT(*) AS n_lines,
       COUNT(*) FILTER (r.least < k.doc_id) AS n_dropped,
       sha256(COALESCE(string_agg(k.line, chr(10) ORDER BY k.n)
                       FILTER (r.least IS NULL OR r.least >= k.doc_id), '')) AS kept_sha256
FROM keyed k LEFT JOIN repeated r ON r.key = k.key
GROUP BY k.doc_id
"""


# The formulas of the operator; only verdicts are compared, as sums of doubles depend on their order.
OP1_SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(COALESCE(rest, ''), '^[^/?#]*'),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(COALESCE(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), rules(verdict, name, start) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), ruled AS (
  SELECT s.*, (SELECT arg_max(struct_pack(rule := name || start, verdict := verdict), length(name || start))
               FROM rules WHERE (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start)) AS r
  FROM split s
), outcome AS (
  SELECT doc_id AS page_id, MAX((COALESCE(toxic = 1, FALSE) OR COALESCE(quality = 0, FALSE))::INT) AS bad
  FROM labels GROUP BY doc_id
), hosts AS (
  SELECT host, array_to_string(string_split(host, '.')[-2:], '.') AS domain,
         string_split(host, '.')[-1] AS suffix, COUNT(bad) AS n, COALESCE(SUM(bad), 0) AS k
  FROM split LEFT JOIN outcome USING (page_id) GROUP BY host
), r0 AS (
  SELECT suffix, SUM(n) AS n, SUM(k) AS k,
         (SELECT (SUM(k) + 1) / (SUM(n) + 2) FROM hosts) AS mean FROM hosts GROUP BY suffix
), s0 AS (
  SELECT SUM((k - n * mean) ^ 2 / n - mean * (1 - mean)) AS top, SUM(mean * (1 - mean) * (n - 1)) AS bottom
  FROM r0 WHERE n > 0
), p0 AS (
  SELECT suffix, (k + s * mean) / (n + s) AS mean
  FROM r0, (SELECT CASE WHEN COALESCE(top, 0) <= 0 OR bottom = 0 THEN 1e6
                        ELSE least(greatest(bottom / top - 1, 1), 1e6) END AS s FROM s0)
), r1 AS (
  SELECT h.suffix, domain, SUM(n) AS n, SUM(k) AS k, p0.mean FROM hosts h JOIN p0 ON p0.suffix = h.suffix
  GROUP BY h.suffix, domain, p0.mean
), s1 AS (
  SELECT SUM((k - n * mean) ^ 2 / n - mean * (1 - mean)) AS top, SUM(mean * (1 - mean) * (n - 1)) AS bottom
  FROM r1 WHERE n > 0
), p1 AS (
  SELECT domain, (k + s * mean) / (n + s) AS mean
  FROM r1, (SELECT CASE WHEN COALESCE(top, 0) <= 0 OR bottom = 0 THEN 1e6
                        ELSE least(greatest(bottom / top - 1, 1), 1e6) END AS s FROM s1)
), r2 AS (
  SELECT host, n, k, p1.mean FROM hosts h JOIN p1 ON p1.domain = h.domain
), s2 AS (
  SELECT SUM((k - n * mean) ^ 2 / n - mean * (1 - mean)) AS top, SUM(mean * (1 - mean) * (n - 1)) AS bottom
  FROM r2 WHERE n > 0
), p2 AS (
  SELECT host, n + s AS w, (k + s * mean) / (n + s) AS mean
  FROM r2, (SELECT CASE WHEN COALESCE(top, 0) <= 0 OR bottom = 0 THEN 1e6
                        ELSE least(greatest(bottom / top - 1, 1), 1e6) END AS s FROM s2)
)
SELECT page_id, ruled.host, path, r.rule AS rule,
       COALESCE(r.verdict, CASE WHEN mean - 1.645 * sqrt(mean * (1 - mean) / (w + 1)) > 0.5
                                THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled JOIN p2 ON p2.host = ruled.host
"""


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = urlfilter.page_outcomes(table(spark, sf_dir, "labels"))
    return urlfilter.judged(table(spark, sf_dir, "pages"), outcomes).drop("bad_rate", "bound")


OP3_SQL = r"""
WITH w AS (
  SELECT doc_id, COALESCE(text, '') AS text,
         regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(words[i : i + 4], ' ') AS win
  FROM (SELECT doc_id, words, UNNEST(range(1, len(words) - 3)) AS i FROM w WHERE len(words) > 4)
), often AS (
  SELECT doc_id, win FROM windows GROUP BY doc_id, win HAVING COUNT(*) > 1
), covered AS (
  SELECT doc_id, COUNT(*) AS n_repeat_words FROM (
    SELECT DISTINCT doc_id, UNNEST(range(i, i + 5)) AS word FROM windows SEMI JOIN often USING (doc_id, win)
  ) GROUP BY doc_id
), lines AS (
  SELECT doc_id, COUNT(*) AS n_lines, COUNT(*) - COUNT(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, UNNEST(string_split(text, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), measured AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words,
         length(array_to_string(words, ''))::BIGINT AS word_chars,
         (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         COALESCE(n_lines, 0)::BIGINT AS n_lines, COALESCE(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         COALESCE(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(list_filter(words, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]')))::BIGINT AS n_upper,
         len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1]))::BIGINT AS n_stutter
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
), judged AS (
  SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT
         + 4 * (10 * n_symbols > n_words)::BIGINT + 8 * (2 * n_upper > n_words)::BIGINT
         + 16 * (3 * n_stutter > n_words)::BIGINT + 32 * (2 * n_dup_lines > n_lines)::BIGINT
         + 64 * (word_chars > 20 * n_words)::BIGINT AS failures
  FROM measured
)
SELECT *, failures % 4 <> 0 AS base_failed, failures = 0 AS kept FROM judged
"""


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.repeated_bytes(table(spark, sf_dir, "documents")).drop("spans")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.quality_report(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op5_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.linked(table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(COALESCE(html, '')))::BIGINT AS payload_bytes,
         sha1(COALESCE(html, '')) AS payload_digest
  FROM pages
), k AS (
  SELECT payload_digest, MAX(page_id) AS keep FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM COALESCE(keep, page_id) THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM COALESCE(keep, page_id) THEN keep END AS refers_to
FROM p LEFT JOIN k USING (payload_digest)
"""


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archived(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# The items' shingles anywhere in a document; no sketch needed at this size.
OP7_SQL = r"""
WITH texts AS (
  SELECT 'd' AS kind, doc_id AS id, lower(text) AS text FROM documents
  UNION ALL SELECT 'b', item_id, lower(text) FROM benchmark
), words AS (
  SELECT kind, id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM texts WHERE text IS NOT NULL
), shingles AS (
  SELECT DISTINCT kind, id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT kind, id, w, UNNEST(range(1, len(w) - 3)) AS i FROM words WHERE len(w) > 4)
), items AS (
  SELECT id, s, COUNT(*) OVER (PARTITION BY id) AS n FROM shingles WHERE kind = 'b'
)
SELECT d.id AS doc_id, i.id AS item_id, COUNT(*) AS n_common, i.n AS n_shingles,
       COUNT(*) / i.n AS containment
FROM shingles d JOIN items i USING (s) WHERE d.kind = 'd'
GROUP BY d.id, i.id, i.n HAVING 5 * COUNT(*) >= 4 * i.n
"""


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainhtml.main_texts(table(spark, sf_dir, "pages"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(table(spark, sf_dir, "documents"))


OP11_SQL = """
WITH t AS (
  SELECT doc_id, length(COALESCE(text, '')) AS n_chars,
         translate(COALESCE(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS norm
  FROM documents
), k AS (
  SELECT doc_id, norm, COUNT(*) OVER (PARTITION BY norm) AS group_size,
         FIRST_VALUE(doc_id) OVER (PARTITION BY norm ORDER BY n_chars DESC, doc_id) AS keep_id
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k
"""


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_copies(table(spark, sf_dir, "documents"))


# The same plans found forwards: per state the least of cost and letters, as one text. A second walk
# along the letters speaks the repaired turns.
def _op12_sql() -> str:
    def edit(v: str, cost: str, letter: str) -> str:
        return f"(lpad((substr({v}, 1, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr({v}, 10) || '{letter}')"

    def to(state: int, keep: str, sources: tuple[int, ...]) -> str:
        options = [edit(f"i{state}", "3", "D")]
        for s in sources:
            options.append(f"CASE WHEN NOT must AND initial = '{keep}' THEN {edit(f'i{s}', 'cut', 'K')} END")
            if state != 1:
                options.append(f"CASE WHEN NOT must THEN {edit(f'i{s}', '2 + cut', 'R')} END")
        return f"least({', '.join(options)}) AS v{state}"

    def inserted(v: str) -> str:
        a2 = f"least(v2, {edit('v0', '2', 'I')}, {edit('v1', '2', 'I')}, {edit('v3', '2', 'I')})"
        return f"SELECT *, v0 AS i0, v1 AS i1, {a2} AS i2, least(v3, {edit(a2, '2', 'I')}) AS i3 FROM {v}"

    last = r"[.!?][\x20\x09-\x0D]*$"
    bits = "list_reduce([v, 0, 0, 0, 0, 0, 0, 0, 0], lambda w, z: CASE WHEN w % 2 = 1 THEN xor(w >> 1, 3988292384) ELSE w >> 1 END)"
    crc = f"list_reduce(list_concat([4294967295], list_transform(string_split(name, ''), lambda x: unicode(x)::BIGINT)), lambda c, b: {bits.replace('[v,', '[xor(c, b),')})"
    return rf"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, COALESCE(role, ' ') AS role, COALESCE(text, ' ') AS text,
         COALESCE(conv_id::VARCHAR, ' ') || ':' || COALESCE(turn::VARCHAR, ' ') AS name,
         dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS g
  FROM conversations
), harmed AS (
  SELECT *, xor({crc}, 4294967295) % 20 AS harm FROM named
), rows0 AS (
  SELECT g, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
         CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         UNNEST(range(CASE WHEN harm = 3 THEN 2 ELSE 1 END)) AS copy
  FROM harmed WHERE harm <> 0
), ranked AS (
  SELECT g, turn, role, text, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i
  FROM rows0
), flagged AS (
  SELECT *, left(role, 1) AS initial, NOT regexp_matches(text, '[^ 	-]') AS blank,
         row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 AS again,
         NOT regexp_matches(text, '{last}') AS open_end,
         lag(left(role, 1)) OVER (PARTITION BY g ORDER BY i) AS before
  FROM ranked
), f AS (
  SELECT *, blank OR again AS must, (open_end AND NOT (blank OR again))::BIGINT AS cut FROM flagged
), counts AS (
  SELECT g, COALESCE(MAX(turn) - MIN(turn) + 1 - COUNT(DISTINCT turn), 0) AS gaps, COUNT(*) FILTER (blank) AS blank,
         COUNT(*) FILTER (again AND NOT blank) AS duplicate, SUM(cut)::BIGINT AS truncated,
         COUNT(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal, MAX(i) AS n
  FROM f GROUP BY g
), walk AS (
  SELECT g, 0::BIGINT AS i, '000000000' AS v0, NULL::VARCHAR AS v1, NULL::VARCHAR AS v2, NULL::VARCHAR AS v3 FROM counts
  UNION ALL
  SELECT g, i, {to(0, '', ())}, {to(1, 's', (0,))}, {to(2, 'u', (0, 1, 3))}, {to(3, 'a', (2,))}
  FROM (SELECT w.*, f.initial, f.must, f.cut
        FROM (SELECT g, i + 1 AS i, i0, i1, i2, i3 FROM ({inserted('walk')})) w JOIN f ON f.g = w.g AND f.i = w.i)
), best AS (
  SELECT g, least(i0, i3) AS v FROM ({inserted('(SELECT walk.* FROM walk JOIN counts ON counts.g = walk.g AND walk.i = counts.n)')})
), said AS (
  SELECT g, 0::BIGINT AS p, 1::BIGINT AS i, 0 AS state, substr(v, 10) AS audit, NULL::VARCHAR AS line FROM best
  UNION ALL
  SELECT s.g, s.p + 1, CASE WHEN letter = 'I' THEN s.i ELSE s.i + 1 END,
         CASE WHEN letter = 'D' THEN state WHEN letter = 'K' THEN CASE initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END
              WHEN state = 2 THEN 3 ELSE 2 END, audit,
         CASE WHEN letter <> 'D' THEN CASE WHEN letter = 'K' THEN role WHEN state = 2 THEN 'assistant' ELSE 'user' END
              || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END END
  FROM (SELECT *, substr(audit, p + 1, 1) AS letter FROM said WHERE p < length(audit)) s
  LEFT JOIN f ON f.g = s.g AND f.i = s.i
), spoken AS (
  SELECT g, string_agg(line, chr(10) ORDER BY p) AS repaired FROM said GROUP BY g
)
SELECT k.conv_id, COALESCE(gaps, 0) AS gaps, COALESCE(blank, 0) AS blank, COALESCE(duplicate, 0) AS duplicate,
       COALESCE(truncated, 0) AS truncated, COALESCE(illegal, 0) AS illegal,
       COALESCE(substr(v, 1, 9)::BIGINT, 0) AS cost, COALESCE(substr(v, 10), '') AS audit,
       sha256(COALESCE(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT g, conv_id FROM named) k LEFT JOIN counts ON counts.g = k.g
LEFT JOIN best ON best.g = k.g LEFT JOIN spoken ON spoken.g = k.g
"""


OP12_SQL = _op12_sql()


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations")
    report = convrepair.repair_report(convrepair.damaged(said), said.select(F.col("conv_id").alias("conv")))
    return report.withColumnRenamed("conv", "conv_id")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitening_report(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_url_filter": (op1_url_filter, OP1_SQL),
    "op2_suffix_dedup": (op2_suffix_dedup, None),
    "op3_quality_rules": (op3_quality_rules, OP3_SQL),
    "op4_pii": (op4_pii, None),
    "op5_simhash_neardup": (op5_simhash_neardup, None),
    "op6_warc": (op6_warc, OP6_SQL),
    "op7_decontamination": (op7_decontamination, OP7_SQL),
    "op8_main_text": (op8_main_text, None),
    "op9_mixing": (op9_mixing, None),
    "op10_line_dedup": (op10_line_dedup, OP10_SQL),
    "op11_exact_dedup": (op11_exact_dedup, OP11_SQL),
    "op12_conversation_repair": (op12_conversation_repair, OP12_SQL),
    "op13_whitening": (op13_whitening, None),
}
