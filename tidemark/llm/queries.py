"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import alignment, bpe, decontaminate, fingerprints, jaccard, language, licenses, lines, neardup, pii, quality, substrings, tries
from tidemark.llm.shared import saved

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


#: Bytes of rows that go to a Python worker at once; the session's own setting stays where it is smaller.
ARROW_BYTES = 1 << 20
_ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. Whole texts go through Python workers, so the session's Arrow batches are bounded by bytes."""
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > ARROW_BYTES:
        spark.conf.set(_ARROW, str(ARROW_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def token_digests(docs: DataFrame) -> DataFrame:
    path, pattern = str(public_tokenizers.path(VOCABULARY)), public_tokenizers.PATTERN
    done = bpe.encode(docs.select("doc_id", "text"), path, pattern, decoded="decoded")
    return done.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the decoded bytes, for each document."""
    return token_digests(table(spark, sf_dir, "documents"))


def remainder(n: int, id: str = "doc_id") -> F.Column:
    """crc32 of the id as text modulo n; null for a null id, which is in no part and held out of none."""
    return F.pmod(F.crc32(F.col(id).cast("string")), F.lit(n))


def op1_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of each vector with others of its label at a cosine of 0.93 or more, and its component."""
    return neardup.find(table(spark, sf_dir, "embeddings"), cosine=0.93)


def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each document in strings of 100 that also start earlier, and the digest of the rest."""
    done = substrings.dedup(table(spark, sf_dir, "documents"), length=100)
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    return done.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in all and deleted, and the digest of what stays, for each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).alias("n"))
    done = lines.dedup(docs)
    gone = F.aggregate("removed_runs", F.lit(0), lambda a, r: a + r["end"] - r["first"])
    return done.select("doc_id", F.col("n").cast("long").alias("n_lines"), gone.cast("long").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: The same by windows of lines: a window that also begins earlier takes its lines away.
LINE_SQL = """
WITH cut AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL),
line AS (SELECT doc_id, unnest(x) AS t, generate_subscripts(x, 1) - 1 AS k FROM cut),
pair AS (SELECT doc_id, k, t, lead(t) OVER (PARTITION BY doc_id ORDER BY k) AS u FROM line),
win AS (
  SELECT doc_id, k, 2 AS n, t || chr(10) || u AS c FROM pair WHERE u IS NOT NULL
  UNION ALL SELECT doc_id, k, 1, t FROM line WHERE length(t) - length(replace(t, ' ', '')) + 1 >= 20
),
later AS (SELECT doc_id, k, n FROM (SELECT *, row_number() OVER (PARTITION BY n, c ORDER BY doc_id, k) AS r FROM win) WHERE r > 1),
gone AS (SELECT doc_id, k FROM later UNION SELECT doc_id, k + 1 FROM later WHERE n = 2)
SELECT d.doc_id, count(l.k) AS n_lines, count(g.k) AS n_removed,
  sha256(coalesce(string_agg(l.t, chr(10) ORDER BY l.k) FILTER (WHERE g.k IS NULL), '')) AS kept_sha256
FROM documents d LEFT JOIN line l ON l.doc_id = d.doc_id LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.k = l.k
GROUP BY d.doc_id
"""


def op5_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document, learned from two thirds of them."""
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(remainder(3) != 1))
    done = language.predict(docs.select("doc_id", "text"), model)
    return done.select("doc_id", (remainder(3) == 1).alias("held_out"), "lang_pred", "score")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences that each document names, with the largest share of a template that a window holds."""
    done = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id",
        F.size("licenses").cast("long").alias("n_licenses"),
        F.array_join(F.array_sort(F.transform("licenses", lambda m: m["license"])), ",").alias("licenses"),
        F.array_max(F.transform("licenses", lambda m: m["share"])).alias("share"),
    )


def op7_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for each document, learned from the labels of four fifths of them."""
    docs = table(spark, sf_dir, "documents")
    weights = quality.fit(docs, table(spark, sf_dir, "labels").where(remainder(5) != 0))
    done = quality.score(docs.select("doc_id", "text"), weights)
    return done.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the sets of 4-word shingles and components of documents with a similarity of 0.85 or more."""
    return jaccard.find(table(spark, sf_dir, "documents"), shingle=4, percent=85)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and places of personal data in each document."""
    done = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [k.name for k in pii.BASE]
    of = lambda *names: F.filter("spans", lambda s: s["kind"].isin(*names))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return done.select(
        "doc_id",
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in base),
        F.sha2(written(of(*base)), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item within its budget of edits, with the items."""
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of conversations that begin like every fifth one."""
    return tries.trie(tries.branched(tries.numbered(table(spark, sf_dir, "conversations"))))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the tokens of two public tokenizers in each document, with the corpus-wide counts of linked ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    a, b = (str(public_tokenizers.path(name)) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    counts = ["n_a", "n_b", "n_groups", "n_links"]
    aligned = alignment.align(docs, a, b, public_tokenizers.PATTERN).select("doc_id", *counts, F.coalesce(F.sha2("groups", 256), F.lit("")).alias("groups_sha256"), "pairs")
    return alignment.scored(saved(aligned, "aligned"), ["doc_id", *counts, "groups_sha256"])


def op13_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of each document and of its edited text, and how alike they and the next document's are."""
    return fingerprints.compare_edited(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_neardup": op1_embedding_neardup,
    "op2_suffix_array": op2_suffix_array,
    "op3_line_dedup": op3_line_dedup,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_language_crf": op5_language_crf,
    "op6_license_scan": op6_license_scan,
    "op7_quality_ftrl": op7_quality_ftrl,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_pii": op9_pii,
    "op10_decontamination": op10_decontamination,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_token_alignment": op12_token_alignment,
    "op13_imatch": op13_imatch,
}

#: Links by brute force; components by following them.
REACH_SQL = """
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a, b FROM edge UNION SELECT r.a, x.b FROM reach r JOIN edge x ON x.a = r.b),
least AS (SELECT a, min(least(a, b)) AS c FROM reach GROUP BY 1)
"""

VECTOR_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id AS i, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT p.i AS a, q.i AS b FROM v p JOIN v q ON p.label = q.label AND len(p.e) = len(q.e) AND p.i < q.i AND list_cosine_similarity(p.e, q.e) >= 0.93), {REACH_SQL},
degree AS (SELECT a, count(*) AS n FROM edge GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, vec_id = coalesce(c, vec_id) AS kept
FROM embeddings LEFT JOIN degree ON degree.a = vec_id LEFT JOIN least ON least.a = vec_id
"""

JACCARD_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id AS i, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT i, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda k: array_to_string(w[k:k + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
one AS (SELECT i, len(s) AS n, unnest(s) AS x FROM s),
link AS (SELECT p.i AS a, q.i AS b FROM one p JOIN one q ON p.x = q.x AND p.i < q.i GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (any_value(p.n) + any_value(q.n) - count(*))), {REACH_SQL}
SELECT s.i AS doc_id, len(s.s) AS n_shingles, coalesce(c, s.i) AS component_id FROM s LEFT JOIN least ON least.a = s.i
"""

#: Windows of 100 bytes (200 hexadecimal digits) that also start earlier, joined to runs; then what lies between the runs.
SUBSTRING_SQL = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT doc_id, 100 * j AS k, x[200 * j + 1:200 * j + 398] AS y FROM (SELECT doc_id, x, unnest(range((len(x) // 2 - 99 + 99) // 100)) AS j FROM d WHERE len(x) >= 200)),
w AS (SELECT doc_id, k, y, unnest(range(len(y) // 2 - 99)) AS j FROM b WHERE len(y) >= 200),
c AS (SELECT doc_id, k + j AS k, md5_number(y[2 * j + 1:2 * j + 200]) AS c FROM w),
later AS (SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY c ORDER BY doc_id, k) AS r FROM c) WHERE r > 1),
cut AS (SELECT doc_id, k, CASE WHEN k > lag(k) OVER (PARTITION BY doc_id ORDER BY k) + 100 THEN 1 ELSE 0 END AS new FROM later),
run AS (SELECT doc_id, min(k) AS a, max(k) + 100 AS b FROM (SELECT doc_id, k, sum(new) OVER (PARTITION BY doc_id ORDER BY k) AS r FROM cut) GROUP BY doc_id, r),
part AS (SELECT d.doc_id, coalesce(lag(b) OVER (PARTITION BY d.doc_id ORDER BY a), 0) AS p, a, b, x, lead(a) OVER (PARTITION BY d.doc_id ORDER BY a) IS NULL AS last FROM run JOIN d ON d.doc_id = run.doc_id),
kept AS (SELECT doc_id, count(*) AS n, sum(b - a) AS gone, string_agg(x[2 * p + 1:2 * a] || CASE WHEN last THEN x[2 * b + 1:] ELSE '' END, '' ORDER BY a) AS x FROM part GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(kept.x, d.x))) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

_LUHN = "list_sum(list_transform(range(1, len(g) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse(g)[i] AS INT) ELSE 2 * CAST(reverse(g)[i] AS INT) - CASE WHEN CAST(reverse(g)[i] AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
_MOD97 = "list_reduce(list_prepend(0, list_transform(range(1, len(m) + 1), lambda i: CASE WHEN (m[5:] || m[1:4])[i] BETWEEN '0' AND '9' THEN ascii((m[5:] || m[1:4])[i]) - 48 ELSE ascii((m[5:] || m[1:4])[i]) - 55 END)), lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1"
#: (kind, pattern of maximal candidates, which of them the kind's pattern takes, which of those are valid)
_KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true", "true"),
    ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "true", "list_max(list_transform(string_split(m, '.'), lambda p: CAST(p AS HUGEINT))) <= 255"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", "true", f"len(g) BETWEEN 16 AND 19 AND {_LUHN}"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "true", "len(g) BETWEEN 8 AND 15"),
    ("iban", "[A-Za-z0-9]+", "regexp_full_match(m, '[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}')", _MOD97),
    ("ssn", "[0-9-]+", "regexp_full_match(m, '[0-9]{3}-[0-9]{2}-[0-9]{4}')", "NOT regexp_matches(m, '^(000|666|9..)|-00-|-0000$') AND regexp_matches(near, '(?i)ssn|social|security')"),
]


def _spans_sql(no: int, kind: str, pattern: str, takes: str, valid: str) -> str:
    return f"""
c{no} AS (SELECT doc_id, t, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS p FROM d WHERE regexp_matches(t, '{pattern}')),
e{no} AS (SELECT doc_id, t, unnest(m) AS m, unnest(p[:len(m)]) AS p, generate_subscripts(m, 1) AS k FROM c{no}),
f{no} AS (SELECT *, sum(len(p) + len(m)) OVER (PARTITION BY doc_id ORDER BY k) AS e FROM e{no}),
g{no} AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY k), 0) AS before FROM f{no} WHERE {takes}),
s{no} AS (SELECT doc_id, {no} AS no, '{kind}' AS kind, e - len(m) AS a, e AS b FROM
  (SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS g, CASE WHEN {int(kind == "ssn")} = 1 THEN t[CAST(greatest(before, e - len(m) - 48) AS BIGINT) + 1:CAST(e - len(m) AS BIGINT)] END AS near FROM g{no}) WHERE {valid})"""


PII_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {",".join(_spans_sql(k, *x) for k, x in enumerate(_KINDS))},
s AS (SELECT *, kind || ':' || CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT) AS x FROM ({" UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(len(_KINDS)))}))
SELECT d.doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k, *_ in _KINDS[:4])},
  sha256(coalesce(string_agg(x, ',' ORDER BY no, a) FILTER (WHERE no < 4), '')) AS base_sha256, coalesce(string_agg(x, ',' ORDER BY no, a), '') AS spans
FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""

#: Every window that holds a shingle of a template, without bands.
LICENSE_SQL = f"""
WITH template AS MATERIALIZED (SELECT * FROM (VALUES {", ".join("({}, '{}', '{}')".format(k, n, t.replace("'", "''")) for k, (n, t) in enumerate(sorted(licenses.templates().items())))}) AS v(k, name, t)),
text AS (SELECT doc_id AS i, coalesce(text, '') AS t FROM documents UNION ALL SELECT -1 - k, t FROM template),
word AS (SELECT i, list_filter(string_split_regex(lower(t), '[^a-z0-9\\x{{80}}-\\x{{10ffff}}]+'), lambda w: w <> '') AS w FROM text),
five AS MATERIALIZED (SELECT i, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) AS x, unnest(range(len(w) - 4)) AS k FROM word WHERE len(w) >= 5),
want AS (SELECT DISTINCT -1 - i AS t, x FROM five WHERE i < 0),
sized AS (SELECT t, count(*) AS n, greatest(1, count(*) // 4) AS step FROM want GROUP BY t),
hit AS (SELECT i, want.t, five.x, k, n, step FROM five JOIN want USING (x) JOIN sized ON sized.t = want.t WHERE i >= 0),
enough AS (SELECT i, t FROM hit GROUP BY i, t, n HAVING count(DISTINCT x) >= 0.8 * n),
win AS (SELECT i, t, x, k, n, step, unnest(range(greatest(0, (k - n - step) // step), k // step + 1)) * step AS s FROM hit SEMI JOIN enough USING (i, t)),
held AS (SELECT i, t, s, count(DISTINCT x) / n AS share FROM win WHERE s <= k AND k < s + n + step GROUP BY i, t, s, n HAVING count(DISTINCT x) / n >= 0.8),
first AS (SELECT i, t, arg_min(share, s) AS share FROM held GROUP BY i, t)
SELECT doc_id, count(name) AS n_licenses, coalesce(string_agg(name, ',' ORDER BY name), '') AS licenses, max(share) AS share
FROM documents LEFT JOIN first ON first.i = doc_id LEFT JOIN template ON template.k = first.t GROUP BY doc_id
"""

#: Paths as lists of digests of turns. DuckDB has no crc32, so the table's polynomial is worked out bit by bit over the decimal digits.
TRIE_SQL = """
WITH RECURSIVE
t AS (SELECT conv_id AS c, CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '') AS m, strlen(coalesce(text, '')) AS b, turn FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list({'m': md5(m), 'b': b} ORDER BY turn NULLS FIRST, md5(m)) AS p FROM t GROUP BY c),
crc AS (SELECT c, 0 AS k, CAST(4294967295 AS BIGINT) AS v FROM own
  UNION ALL SELECT c, k + 1, CASE WHEN u % 2 = 1 THEN xor(u // 2, 3988292384) ELSE u // 2 END FROM
    (SELECT c, k, CASE WHEN k % 8 = 0 THEN xor(v, CAST(ascii(CAST(c AS VARCHAR)[k // 8 + 1]) AS BIGINT)) ELSE v END AS u FROM crc WHERE k < 8 * length(CAST(c AS VARCHAR)))),
h AS (SELECT c, xor(v, CAST(4294967295 AS BIGINT)) % 9 AS h FROM crc WHERE k = 8 * length(CAST(c AS VARCHAR))),
path AS (SELECT own.c, coalesce(base.p[1:h], []) || own.p[h + 1:] AS p FROM own JOIN h ON h.c = own.c LEFT JOIN own base ON base.c = own.c - own.c % 5),
step AS (SELECT c, d, p, len(p) AS n, array_to_string([x.m FOR x IN p[1:d]], '') AS node, array_to_string([x.m FOR x IN p[1:d - 1]], '') AS up FROM (SELECT c, p, unnest(range(len(p) + 1)) AS d FROM path)),
node AS (SELECT d, node, any_value(up) AS up, min(c) AS c, count(*) AS n, max(n) AS deep, (count(*) - 1) * (CASE WHEN d = 0 THEN 0 ELSE any_value(p[d].b) END) AS s, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d) AS ends FROM step GROUP BY d, node),
above AS (SELECT node[1:32 * k] AS node, s, deep = d AS leaf FROM (SELECT *, unnest(range(d + 1)) AS k FROM node)),
total AS (SELECT node, sum(s) AS s, count(*) FILTER (WHERE leaf) AS leaves FROM above GROUP BY node),
child AS (SELECT up, count(*) AS n FROM node WHERE d > 0 GROUP BY up)
SELECT node.c AS conv_id, node.d AS depth, CASE WHEN node.d > 0 THEN parent.c END AS parent_conv_id, node.n AS n_convs, coalesce(child.n, 0) AS n_children, leaves AS n_leaves, CAST(total.s AS BIGINT) AS saved_tokens, sha256(coalesce(node.ends, '')) AS ends_sha256
FROM node JOIN total ON total.node = node.node LEFT JOIN child ON child.up = node.node LEFT JOIN node parent ON parent.node = node.up AND parent.d = node.d - 1
"""

ORACLES: dict[str, str] = {
    "op1_embedding_neardup": VECTOR_SQL, "op2_suffix_array": SUBSTRING_SQL, "op3_line_dedup": LINE_SQL, "op6_license_scan": LICENSE_SQL, "op8_ngram_jaccard": JACCARD_SQL, "op9_pii": PII_SQL,
    "op11_conversation_trie": TRIE_SQL,
}
