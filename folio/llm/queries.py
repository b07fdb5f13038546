"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import read_table
from folio.llm.decontam import contamination_report
from folio.llm.exact import exact_dedup
from folio.llm.langid import language_id
from folio.llm.lexical import ranked
from folio.llm.linededup import line_dedup
from folio.llm.minhash import near_duplicates
from folio.llm.mixing import mix
from folio.llm.packing import pack_documents
from folio.llm import quality as rules
from folio.llm.quality import quality_report
from folio.llm.suffix import suffix_dedup
from folio.llm.tokens import token_counts
from folio.llm.vectorcodes import ENTRIES, MOST, PARTS, ROUNDS, SCALE, code_report
from folio.llm.warc import warc_round_trip


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), limit=512)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(read_table(spark, sf_dir, "pages"), min_bytes=0)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), percent=75)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), capacity=1024)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(read_table(spark, sf_dir, "documents"), length=200).drop("kept_bytes")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(read_table(spark, sf_dir, "documents", dealt=False))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(read_table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs, min_chars=40, min_docs=5).select(
        "doc_id",
        F.col("__line_total").alias("n_lines"),
        F.col("__line_drops").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_report(read_table(spark, sf_dir, "embeddings"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark", dealt=False), window=10)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark", dealt=False), k=10)


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_warc": op2_warc,
    "op3_mixing": op3_mixing,
    "op4_minhash": op4_minhash,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_packing": op6_packing,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_language_id": op9_language_id,
    "op10_line_dedup": op10_line_dedup,
    "op11_vector_codes": op11_vector_codes,
    "op12_decontamination": op12_decontamination,
    "op13_lexical_search": op13_lexical_search,
}

_SPACES = r"\x20\x09-\x0D"
_WORD = rf"[^{_SPACES}]+"
_WORDS = rf"list_filter(regexp_split_to_array(%s, '[{_SPACES}]+'), lambda w: w <> '')"
_COUNT = "len(regexp_extract_all(line, '{}'))"
_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_quoted = lambda pattern: pattern.replace("'", "''")
_NO_WORD = r"[^\p{L}\p{M}\p{N}_]"

# the words of operators 12 and 13: lower-case ASCII letters, digits and all beyond ASCII
_TERMS = rf"list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_LETTERS}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"


def _vector_codes_sql() -> str:
    """The rounds of operator 11 one after another, every part held against every entry."""
    gap = "CAST(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS BIGINT)"
    nearest = f"SELECT k, p, any_value(x) AS x, min((e, g)) FILTER (WHERE g = m)[1] AS e, min(g) AS g FROM (SELECT *, min(g) OVER (PARTITION BY k, p) AS m FROM (SELECT k, v.p, x, e, {gap} AS g FROM v JOIN {{}} b ON b.p = v.p)) GROUP BY k, p"
    steps = [
        f"r AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, x) AS k, * FROM (SELECT vec_id, label, list_transform(embedding, lambda y: CAST(floor(CAST(y AS DOUBLE) * {SCALE}) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR isnan(y) OR abs(CAST(y AS DOUBLE) * {SCALE}) >= {MOST})) = 0))",
        f"v AS MATERIALIZED (SELECT k, p, x[p * len(x) // {PARTS} + 1:(p + 1) * len(x) // {PARTS}] AS x FROM r, range({PARTS}) t(p))",
        f"b0 AS MATERIALIZED (SELECT p, k - 1 AS e, x AS c FROM v WHERE k <= {ENTRIES})",
    ]
    for n in range(ROUNDS):
        steps.append(f"a{n} AS MATERIALIZED ({nearest.format(f'b{n}')})")
        means = f"SELECT p, e, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS c FROM (SELECT p, e, i, sum(y) AS s, count(*) AS n FROM (SELECT p, e, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM a{n}) GROUP BY p, e, i) GROUP BY p, e"
        steps.append(f"b{n + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{n} b LEFT JOIN ({means}) m ON m.p = b.p AND m.e = b.e)")
    steps.append(f"z AS MATERIALIZED ({nearest.format(f'b{ROUNDS}')})")
    steps.append("o AS (SELECT k, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(g) AS BIGINT) AS error FROM z GROUP BY k)")
    steps.append(f"h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS d FROM b{ROUNDS})")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, d AS codebooks_sha256 FROM r JOIN o USING (k), h"


ORACLES = {
    "op2_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        h AS (SELECT page_id, strlen(body) AS n, sha1(body) AS x, max(page_id) OVER (PARTITION BY body) AS top FROM p)
        SELECT page_id, n AS payload_bytes,
               list_reduce(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(x, CAST(i * 5 // 4 + 1 AS BIGINT), 2) AS INTEGER) >> CAST(3 - i * 5 % 4 AS INTEGER)) & 31) + 1, 1)), lambda a, b: a || b) AS payload_digest,
               CASE WHEN top = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN top <> page_id THEN top END AS refers_to
        FROM h""",
    "op4_minhash": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS % f"translate(coalesce(text, ''), {_LETTERS})"} AS ws FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
        n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles FROM s),
        e AS (SELECT doc_id, unnest(sh) AS sh FROM s),
        c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM e a JOIN e b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 75 * (p.n_shingles + q.n_shingles - k)),
        b AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        r(a, z) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, b.y FROM r JOIN b ON b.x = r.z),
        m AS (SELECT a AS doc_id, min(z) AS component_id FROM r GROUP BY a)
        SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN m USING (doc_id)""",
    "op8_quality_rules": f"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        w AS (SELECT doc_id, text, {_WORDS % 'text'} AS ws FROM t),
        g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
        r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
        rw AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
        l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM t),
        s AS (SELECT *, regexp_matches(line, '{_WORD}') AS word, length(line) < {rules.SHORT_LINE} AS short,
              ({_COUNT.format(rules.SEPARATOR)} >= 2 AND 5 * {_COUNT.format(rules.SEPARATOR)} >= {_COUNT.format(_WORD)})
              OR (regexp_matches(line, '[#*$%&|<>]') AND 10 * length(regexp_replace(line, '{rules.NOT_SYMBOLS}', '', 'g')) >= length(line))
              OR ({_COUNT.format(rules.DOUBLED)} >= 2 AND 4 * {_COUNT.format(rules.DOUBLED)} >= {_COUNT.format(_WORD)})
              OR CASE WHEN length(line) < {rules.SHORT_LINE} THEN regexp_matches(line, '{rules.COPYRIGHT}') OR regexp_matches(lower(line), '(^|{_NO_WORD})({"|".join(rules.BOILERPLATE)})($|{_NO_WORD})')
                 OR 2 * length(regexp_replace(line, '{rules.UNSIGNED}', '', 'g')) > length(line) ELSE regexp_matches(line, '{rules.SIGN_RUN}') END AS bad FROM l),
        kl AS (SELECT *, CASE WHEN NOT word THEN {rules.BLANK} WHEN bad THEN {rules.FAILS} WHEN NOT short OR regexp_matches(line, '{_quoted(rules.SENTENCE_END)}') THEN {rules.PASSES}
               WHEN regexp_matches(line, '{rules.FOUR_WORDS}') THEN {rules.UNENDED} WHEN regexp_matches(line, '{rules.LOWER_START}') THEN {rules.PASSES} ELSE {rules.FRAGMENT} END AS alone FROM s),
        kr AS (SELECT *, count_if(alone NOT IN ({rules.FRAGMENT}, {rules.BLANK})) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM kl),
        k AS (SELECT *, CASE WHEN alone IN ({rules.UNENDED}, {rules.FAILS}) THEN alone WHEN alone = {rules.FRAGMENT} AND count_if(alone = {rules.FRAGMENT}) OVER (PARTITION BY doc_id, run) >= {rules.MENU_LINES} THEN {rules.FAILS} ELSE {rules.PASSES} END AS kind FROM kr),
        n AS (SELECT *, lead(line) OVER o AS line2, lead(word) OVER o AS word2, lead(kind) OVER o AS kind2 FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        j AS (SELECT *, coalesce(word AND word2 AND kind <> {rules.FAILS} AND kind2 <> {rules.FAILS} AND (4 * (length(line) + 1 + length(regexp_extract(line2, '{_WORD}'))) > 3 * length(line2) OR regexp_matches(line2, '{rules.LOWER_START}')), false) AS reads_on FROM n),
        p AS (SELECT *, count_if(NOT reads_on) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS passage FROM j),
        q AS (SELECT *, count(*) OVER v > 1 AND bool_or(regexp_matches(line, '{_quoted(rules.SENTENCE)}')) OVER v AS ended FROM p WINDOW v AS (PARTITION BY doc_id, passage)),
        f AS (SELECT doc_id, line, length(regexp_replace(line, '[{_SPACES}]+', '', 'g')) AS chars, kind = {rules.FAILS} OR (kind = {rules.UNENDED} AND NOT ended) AS fails FROM q WHERE word),
        d AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup, coalesce(sum(CASE WHEN fails THEN chars END), 0) AS lost FROM f GROUP BY doc_id),
        a AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
              CAST(coalesce(d.dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rw.n, 0) AS BIGINT) AS n_repeat_words, coalesce(d.lost, 0) AS lost FROM w LEFT JOIN d USING (doc_id) LEFT JOIN rw USING (doc_id)),
        v AS (SELECT *, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEATED} * n_words AS base_failed FROM a)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * (word_chars - lost) >= {rules.MIN_KEPT} * word_chars AS kept FROM v""",
    "op5_exact_dedup": rf"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[{_SPACES}]', '', 'g') AS norm, length(coalesce(text, '')) AS n FROM documents),
        r AS (SELECT doc_id, norm, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, row_number() OVER w AS rn
              FROM d WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id))
        SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, rn = 1 AS kept, sha256(norm) AS text_sha256 FROM r""",
    "op10_line_dedup": rf"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
        k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[{_SPACES}]+', ''), '[{_SPACES}]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
        m AS (SELECT k.doc_id, k.line, k.i, f.last IS NOT NULL AND f.last <> k.doc_id AS gone FROM k LEFT JOIN f ON k.key = f.key)
        SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
    "op11_vector_codes": _vector_codes_sql(),
    "op12_decontamination": f"""
        WITH d AS (SELECT doc_id, {_TERMS} AS ws FROM documents),
        b AS (SELECT item_id, {_TERMS} AS ws FROM benchmark),
        w AS (SELECT DISTINCT item_id, n, array_to_string(ws[k:k + n - 1], ' ') AS g FROM (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS k FROM b WHERE len(ws) > 0)),
        o AS (SELECT doc_id, n, k, array_to_string(ws[k:k + n - 1], ' ') AS g FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM w))),
        m AS (SELECT o.doc_id, o.n, o.k, w.item_id FROM o JOIN w ON w.n = o.n AND w.g = o.g),
        h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM m) GROUP BY doc_id),
        i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)""",
    "op13_lexical_search": f"""
        WITH d AS (SELECT doc_id, {_TERMS} AS ws FROM documents),
        s AS (SELECT count(*) AS docs, CAST(sum(len(ws)) AS BIGINT) AS len FROM d WHERE len(ws) > 0),
        t AS (SELECT doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n, unnest(ws) AS term FROM d) GROUP BY doc_id, term),
        w AS (SELECT term, CAST(floor(1000 * ln((2 * CAST(docs AS DOUBLE) + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM t GROUP BY term), s),
        p AS (SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // len)) AS impact FROM t, s),
        q AS (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark),
        c AS (SELECT item_id, doc_id, CAST(sum(w * impact) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN p USING (term) GROUP BY item_id, doc_id)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM c WHERE score > 0) WHERE rank <= 10""",
}
