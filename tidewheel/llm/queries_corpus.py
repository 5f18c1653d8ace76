"""Queries on spelling variants, quality rules and the manifest, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import merkle, quality_rules, spelling


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words, forms and roots."""
    return spelling.variants(documents(spark, sf_dir))


#: A column t of 256 numbers: the crc32 of one byte, before and after which all bits are turned.
_CRC_TABLE = """
SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
  lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
"""


def _crc(data: str) -> str:
    """crc32 of a text's bytes, with the table t at hand; characters up to U+07FF."""
    code = "unicode(ch)"
    of_character = f"CASE WHEN {code} < 128 THEN [{code}] ELSE [192 | ({code} >> 6), 128 | ({code} & 63)] END"
    codes = f"flatten(list_transform(string_split({data}, ''), lambda ch: {of_character}))"
    step = "xor(c >> 8, t[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}::BIGINT[]), lambda c, b: {step}), 4294967295)"


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11_SQL = rf"""
WITH RECURSIVE crc AS ({_CRC_TABLE}),
r AS (
  SELECT doc_id, run, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) GROUP BY ALL
),
h AS (SELECT run, k, {_crc("doc_id || ':' || run")} AS h FROM r, crc WHERE length(run) >= 6),
w AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word,
    CAST(sum(k) AS BIGINT) AS n
  FROM h GROUP BY 1 HAVING length(word) >= 6 AND sum(k) >= 5
),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
less AS (SELECT DISTINCT word, n, rest FROM cut),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT w.word, l.word, l.n FROM w JOIN less l ON w.word = l.rest
  UNION SELECT l.word, w.word, w.n FROM w JOIN less l ON w.word = l.rest
),
best AS (SELECT word, count(*) AS n_near, min({{'m': -other_n, 'o': other}}) AS b FROM near GROUP BY word),
f AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= 5 * w.n THEN b.o END AS form, CASE WHEN -b.m >= 5 * w.n THEN -b.m END AS form_n
  FROM w LEFT JOIN best ON w.word = best.word
),
walk AS (
  SELECT word, word AS last, 0 AS d FROM f
  UNION ALL SELECT walk.word, f.form, d + 1 FROM walk JOIN f ON walk.last = f.word WHERE f.form IS NOT NULL
)
SELECT f.word, root, form, n, n_near, form_n
FROM f JOIN (SELECT word, max_by(last, d) AS root FROM walk GROUP BY word) x ON f.word = x.word
"""


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements of every document, its failed rules as bits, and the verdict of the current policy."""
    entries = quality_rules.judged(quality_rules.ledger(documents(spark, sf_dir), ["doc_id"]))
    base = F.col("failed").bitwiseAND(F.lit(quality_rules.BASE)) != 0
    return entries.select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed")


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d)),
t AS (SELECT *, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
g AS (SELECT *, CASE WHEN w2 IS NOT NULL THEN count(*) OVER (PARTITION BY r, w, w1, w2) ELSE 0 END AS k FROM t),
c AS (SELECT r, w, greatest(k, lag(k, 1, 0) OVER o, lag(k, 2, 0) OVER o) AS hit FROM g WINDOW o AS (PARTITION BY r ORDER BY i)),
a AS (
  SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars, count(*) FILTER (WHERE hit > 1) AS n_repeat_words,
    count(*) FILTER (WHERE regexp_matches(w, '[^\x00-\x40\x5B-\x60\x7B-\x7F]')) AS n_letter_words, max(length(w)) AS longest_word
  FROM c GROUP BY r
),
l AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r
),
m AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(n_letter_words, 0) AS n_letter_words, coalesce(longest_word, 0) AS longest_word
  FROM d LEFT JOIN a USING (r) LEFT JOIN l USING (r)
),
b AS (
  SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (word_chars < 2 * n_words OR word_chars > 12 * n_words)::INT
    + 8 * (10 * n_symbols > n_words)::INT + 16 * (100 * n_dup_lines > 40 * n_lines)::INT + 32 * (100 * n_letter_words < 70 * n_words)::INT + 64 * (longest_word > 1000)::INT AS BIGINT) AS failed
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed & 63 = 0 AS kept, failed FROM b
"""


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf and proof in the manifest, and whether it still verifies after some were changed."""
    return merkle.verified(documents(spark, sf_dir))


def _field(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _tree_sql(name: str, levels: int) -> str:
    """CTEs name0 (g, p, h) to name<levels>, each level from the last, and name0s and so on with the siblings left and right."""
    out = []
    for k in range(1, levels + 1):
        out.append(
            f"{name}{k} AS (SELECT g, p // 8 AS p, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY p)) END AS h "
            f"FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {name}{k - 1}) GROUP BY g, p // 8)"
        )
    for k in range(levels):
        run = "PARTITION BY g, p // 8 ORDER BY p ROWS BETWEEN"
        out.append(
            f"{name}{k}s AS (SELECT g, p, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a, "
            f"coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b, count(*) OVER (PARTITION BY g) > 1 AS more FROM {name}{k})"
        )
    return ",\n".join(out)


def _climb_sql(start: str, name: str, levels: int, tag: str) -> str:
    """CTEs tag1 to tag<levels>: the proof and folded value of each leaf, one level further each."""
    out, last = [], start
    for k in range(levels):
        out.append(
            f"{tag}{k + 1} AS (SELECT c.* REPLACE (c.proof || s.a || s.b AS proof, CASE WHEN s.more THEN sha256(s.a || c.folded || s.b) ELSE c.folded END AS folded) "
            f"FROM {last} c JOIN {name}{k}s s ON c.g IS NOT DISTINCT FROM s.g AND c.p // {8**k} = s.p)"
        )
        last = f"{tag}{k + 1}"
    return ",\n".join(out)


#: Levels written out in the SQL: enough for 8**7 documents of one language, and 64 languages.
_DEEP, _WIDE = 7, 2
OP13_SQL = f"""
WITH crc AS ({_CRC_TABLE}),
x AS (
  SELECT lang, doc_id, {_leaf("text")} AS leaf,
    CASE WHEN {_crc("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {_leaf("(" + _LOWER.format("text") + ")")} ELSE {_leaf("text")} END AS other
  FROM documents, crc
),
n AS (SELECT lang AS g, doc_id, leaf, other, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM x),
a0 AS (SELECT g, p, leaf AS h FROM n),
{_tree_sql("a", _DEEP)},
s AS (SELECT g AS lang, h AS subroot, row_number() OVER (ORDER BY encode(g) NULLS FIRST) - 1 AS p FROM a{_DEEP}),
b0 AS (SELECT 0 AS g, p, subroot AS h FROM s),
{_tree_sql("b", _WIDE)},
c0 AS (SELECT g, p, doc_id, leaf, other AS folded, '' AS proof FROM n),
{_climb_sql("c0", "a", _DEEP, "c")},
u0 AS (SELECT c.doc_id, c.leaf, c.folded, c.proof, s.subroot, 0 AS g, s.p FROM c{_DEEP} c JOIN s ON c.g IS NOT DISTINCT FROM s.lang),
{_climb_sql("u0", "b", _WIDE, "u")}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM u{_WIDE}, (SELECT h AS root FROM b{_WIDE})
"""

QUERIES = (op11_spelling_variants, op12_quality_rules, op13_merkle_manifest)
SQL = {"op11_spelling_variants": OP11_SQL, "op12_quality_rules": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
