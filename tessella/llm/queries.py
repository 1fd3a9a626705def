"""The registered queries of the training-data operators, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import packing, quality, spelling, toxicity
from tessella.llm._common import learnable, sha_of_joined, texts
from tessella.llm.decontaminate import decontaminate
from tessella.llm.licenses import TEMPLATES, scan_licenses
from tessella.llm.lines import drop_lines
from tessella.llm.minhash import near_duplicates
from tessella.llm.negatives import hard_negatives
from tessella.llm.simhash import near_copies
from tessella.llm.substring import drop_repeats
from tessella.llm.token_file import crc32_of, read_tokens, write_tokens
from tessella.llm.topk import top_k
from tessella.tables import read


def _scored(scores: DataFrame, threshold: float) -> DataFrame:
    return scores.select("doc_id", (~learnable()).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")), 0.5)


def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_tokens(read(spark, sf_dir, "documents"))
    return read_tokens(spark, path).mapInArrow(crc32_of, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        sha_of_joined("items").alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_repeats(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_lines(texts(read(spark, sf_dir, "documents")))
    return found.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(read(spark, sf_dir, "documents"))
    joined = {c: F.array_join(c, ",") for c in ("base_labels", "labels")}
    return found.withColumns(joined)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")), 0.3)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.misspelt(spelling.word_runs(read(spark, sf_dir, "documents")))
    return spelling.group_variants(spelling.vocabulary(words))


def op12_simhash_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(read(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(read(spark, sf_dir, "embeddings").withColumn("label", moved))


_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"regexp_extract_all(" + _FOLD.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SOLID = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP3_SQL = f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
i AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
pat AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, list_slice(w, s, s + least(len(w), 10) - 1) AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
occ AS (
  SELECT doc_id, p.item_id, s, p.m
  FROM (SELECT DISTINCT m FROM pat) ms
  JOIN (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS s FROM d) x ON s + ms.m - 1 <= len(w)
  JOIN pat p ON p.m = ms.m AND p.g = list_slice(x.w, s, s + ms.m - 1)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(s, s + m)) AS k FROM occ) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS x
        FROM (SELECT DISTINCT doc_id, cast(item_id AS VARCHAR) AS item_id FROM occ) GROUP BY 1)
SELECT d.doc_id, cast(len(w) AS BIGINT) AS n_words, cast(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
       cast(coalesce(its.n, 0) AS BIGINT) AS n_items, sha256(coalesce(its.x, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP4_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x AS DOUBLE)) AS DOUBLE)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, cast(list_dot_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, cast(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

OP5_SQL = f"""
WITH d AS (SELECT doc_id, {_SOLID.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, s, list_slice(w, s, s + 12) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d WHERE len(w) >= 13)),
low AS (SELECT g, min(doc_id) AS lowest FROM win GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS k FROM win JOIN low USING (g) WHERE doc_id > lowest),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY k) AS t
         FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM d) ANTI JOIN gone USING (doc_id, k) GROUP BY 1)
SELECT d.doc_id, cast(len(w) AS BIGINT) AS n_words, cast(len(w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP6_SQL = r"""
WITH l AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
x AS (SELECT doc_id, unnest(ls) AS t, unnest(range(len(ls))) AS line FROM l),
y AS (SELECT doc_id, line, list_transform(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), lambda k: CASE WHEN regexp_matches(k, '[0-9]') THEN '<*>' ELSE k END) AS w FROM x),
z AS (SELECT doc_id, line, w, len(w) AS n FROM y WHERE len(w) > 0),
v AS (
  SELECT doc_id, line, 2 AS need, w AS m FROM z
  UNION ALL SELECT doc_id, line, 3, list_transform(w, lambda k, i: CASE WHEN i > 1 AND regexp_matches(k, '^[A-Z]') THEN '<*>' ELSE k END) FROM z WHERE len(list_filter(w[2:], lambda k: regexp_matches(k, '^[A-Z]'))) > 0),
c AS (SELECT *, len(list_filter(m, lambda k: k <> '<*>')) AS c FROM v),
tm AS (SELECT need, m, min(doc_id) AS first FROM c WHERE (c >= 3 AND 2 * c >= len(m)) OR (need = 2 AND c = len(m)) GROUP BY need, m HAVING count(DISTINCT doc_id) >= need),
-- distinct lines, their first documents, their segments and how many constants each has
d AS (SELECT w, len(w) AS n, least(len(w), 12) AS s, least(3, 2 * least(len(w), 12) // 5) AS f, list_sort(list(DISTINCT doc_id))[1:3] AS ds FROM z WHERE len(w) >= 4 AND doc_id IS NOT NULL GROUP BY w),
e AS (SELECT *, row_number() OVER () AS id, list_transform(range(s), lambda i: w[i * n // s + 1 : (i + 1) * n // s]) AS g FROM d),
g AS (SELECT *, list_transform(g, lambda q: len(list_filter(q, lambda k: k <> '<*>'))) AS cs FROM e),
-- lines that differ in at most f segments, and which those are
p AS (SELECT a.id, b.ds, list_filter(range(a.s), lambda i: a.g[i + 1] <> b.g[i + 1]) AS o FROM g a JOIN g b ON a.n = b.n AND len(list_filter(range(a.s), lambda i: a.g[i + 1] <> b.g[i + 1])) <= a.f),
-- a line with one or two others: three documents, f open segments that hold all differences, constants enough in the rest
t AS (SELECT id, p.ds || q.ds AS ds, list_distinct(p.o || q.o) AS o FROM p JOIN p q USING (id)),
u AS (SELECT id, w, n, list_min(g.ds || t.ds) AS low,
             list_sum(cs) - coalesce(list_sum(list_transform(o, lambda i: cs[i + 1])), 0)
               - coalesce(list_sum(list_sort(list_transform(list_filter(range(s), lambda i: NOT list_contains(o, i)), lambda i: cs[i + 1]))[1 : f - len(o)]), 0) AS c
      FROM t JOIN g USING (id) WHERE len(o) <= f AND len(list_distinct(g.ds || t.ds)) >= 3),
merged AS (SELECT w, min(low) AS first FROM u WHERE c >= 3 AND 2 * c >= n GROUP BY w),
gone AS (SELECT doc_id, line FROM v JOIN tm USING (need, m) WHERE doc_id > first UNION SELECT doc_id, line FROM z JOIN merged USING (w) WHERE doc_id > first),
kept AS (SELECT doc_id, count(*) AS n, string_agg(t, chr(10) ORDER BY line) AS t FROM x ANTI JOIN gone USING (doc_id, line) GROUP BY 1)
SELECT doc_id, cast(CASE WHEN text = '' THEN 0 ELSE len(ls) END AS BIGINT) AS n_lines,
       cast(CASE WHEN text = '' THEN 0 ELSE len(ls) - coalesce(kept.n, 0) END AS BIGINT) AS n_dropped, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM l LEFT JOIN kept USING (doc_id)
"""

_SHINGLES = _SOLID.format(_FOLD.format("coalesce(text, '')"))
OP10_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SHINGLES} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, list_slice(w, s, s + 4) AS g
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
both_sets AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM both_sets JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 75 * (na.n + nb.n - i)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(doc_id, other) AS (SELECT a, b FROM edge UNION SELECT r.doc_id, e.b FROM reach r JOIN edge e ON e.a = r.other),
comp AS (SELECT doc_id, min(other) AS low FROM reach GROUP BY 1)
SELECT d.doc_id, cast(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(comp.low, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(comp.low, d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)
"""

# the checksum of each byte value, then of each word after its document's id; near words share a word with one letter less, or lack the same place
OP11_SQL = r"""
WITH RECURSIVE bit(i, c, k) AS (
  SELECT i, i, 0 FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bit WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM bit WHERE k = 8),
run AS (SELECT doc_id, w, count(*) AS m
        FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS w FROM documents) GROUP BY 1, 2),
byte AS (SELECT w, m, flatten(list_transform(string_split(doc_id || ':' || w, ''),
           lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] END)) AS b FROM run),
crc AS (SELECT w, m, xor(list_reduce(list_prepend(4294967295, list_transform(b, lambda x: cast(x AS BIGINT))), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM byte, tab),
vocab AS (SELECT word, cast(sum(m) AS BIGINT) AS n
          FROM (SELECT m, CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM crc)
          WHERE length(word) >= 6 GROUP BY 1 HAVING sum(m) >= 5),
less AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM vocab)),
pair AS (SELECT a.word, b.word AS other FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
         UNION SELECT word, rest FROM less WHERE rest IN (SELECT word FROM vocab) UNION SELECT rest, word FROM less WHERE rest IN (SELECT word FROM vocab)),
near AS (SELECT p.word, count(*) AS n_near, min({'n': -o.n, 'w': o.word}) AS top FROM pair p JOIN vocab o ON o.word = p.other GROUP BY 1),
form AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -top.n >= 5 * v.n THEN -top.n END AS form_n, CASE WHEN -top.n >= 5 * v.n THEN top.w END AS form
         FROM vocab v LEFT JOIN near USING (word)),
walk(word, place) AS (SELECT word, word FROM form UNION ALL SELECT walk.word, form.form FROM walk JOIN form ON form.word = walk.place WHERE form.form IS NOT NULL)
SELECT f.word, f.form, w.place AS root, f.n, f.n_near, f.form_n
FROM form f JOIN walk w ON w.word = f.word JOIN form l ON l.word = w.place AND l.form IS NULL
"""

OP13_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: cast(floor(256 * cast(x AS DOUBLE)) AS DOUBLE)) AS q FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, cast(list_dot_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (SELECT anchor_id, p.other_id AS positive_id, row_number() OVER (PARTITION BY anchor_id, p.other_id ORDER BY s.score DESC, s.other_id) AS rank,
        s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score
      FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, cast(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

_TEMPLATES = ", ".join(f"('{t.label}', string_split('{t.words}', ' '), string_split('{t.key}', ' '), {str(t.base).lower()})" for t in TEMPLATES)
OP7_SQL = f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
t0(label, tw, kw, base) AS (VALUES {_TEMPLATES}),
t AS (SELECT *, (SELECT min(s) FROM (SELECT unnest(range(1, len(tw) - len(kw) + 2)) AS s) WHERE list_slice(tw, s, s + len(kw) - 1) = kw) AS ko FROM t0),
occ AS (
  SELECT doc_id, label, base, p,
         len(list_filter(range(1, len(tw) + 1), lambda j: p - ko + j >= 1 AND w[p - ko + j] IS NOT NULL AND w[p - ko + j] = tw[j])) / len(tw) AS score
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d) x JOIN t ON x.w[p] = t.kw[1]
  WHERE list_slice(w, p, p + len(kw) - 1) = kw),
g AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(p) FILTER (base) - 1 AS first_word, max(p) FILTER (base) - 1 AS last_word,
         array_to_string(list_sort(list_distinct(list(label) FILTER (base))), ',') AS base_labels,
         array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(score) AS score
  FROM occ GROUP BY 1)
SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, cast(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, cast(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN g USING (doc_id)
"""

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_token_file": op2_token_file,
    "op3_decontaminate": op3_decontaminate,
    "op4_top_k": op4_top_k,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_license_scan": op7_license_scan,
    "op8_quality": op8_quality,
    "op9_packing": op9_packing,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_simhash_copies": op12_simhash_copies,
    "op13_hard_negatives": op13_hard_negatives,
}
#: The classifiers, the token file, packing and XXH64 fingerprints have no SQL form; tests hold them against held-out labels, a round trip and plain versions.
ORACLE_SQL = {
    "op3_decontaminate": OP3_SQL,
    "op4_top_k": OP4_SQL,
    "op5_substring_dedup": OP5_SQL,
    "op6_line_dedup": OP6_SQL,
    "op7_license_scan": OP7_SQL,
    "op10_near_duplicates": OP10_SQL,
    "op11_spelling_variants": OP11_SQL,
    "op13_hard_negatives": OP13_SQL,
}
