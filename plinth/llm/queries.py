"""The query of each operator over its whole table, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm import ann, decontaminate, fingerprints, license_scan, line_dedup, ngram_join, packing, quality, ranked_search, spelling, substring_dedup, suffix_dedup, suffix_tree_lm


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_spans(_table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda doc_id: F.crc32(doc_id.cast("string")) % 7
    return suffix_tree_lm.score_texts(_table(spark, sf_dir, "documents"), lambda i: part(i) == 2, lambda i: part(i) != 2)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents"), deleted="n_deleted").select("doc_id", "n_deleted", "text")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_suffixes(_table(spark, sf_dir, "documents"))


def op9_approximate_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_copies(_table(spark, sf_dir, "documents"))


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(_table(spark, sf_dir, "documents"))


def op12_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(ranked_search.build_index(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "benchmark"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_packing": op5_packing,
    "op6_line_dedup": op6_line_dedup,
    "op7_decontamination": op7_decontamination,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_approximate_nearest_neighbours": op9_approximate_nearest_neighbours,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_document_fingerprints": op11_document_fingerprints,
    "op12_ranked_lexical_search": op12_ranked_lexical_search,
    "op13_spelling_variants": op13_spelling_variants,
}

_SHINGLES = r"""
w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT w.doc_id, count(s.s) AS n_shingles FROM w LEFT JOIN s USING (doc_id) GROUP BY 1)"""

#: Lines that are not blank, by place; pairs of neighbours that an earlier place has too; their lines go.
_LINE_DEDUP = r"""
raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM {docs} WHERE text IS NOT NULL),
ln AS (SELECT doc_id, line, k, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS p FROM raw WHERE NOT regexp_full_match(line, '[\x20\x09-\x0D]*')),
pr AS (SELECT a.doc_id, a.p, a.line AS l1, b.line AS l2 FROM ln a JOIN ln b ON a.doc_id = b.doc_id AND b.p = a.p + 1),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY l1, l2 ORDER BY doc_id, p) AS n FROM pr) WHERE n > 1),
gone AS (SELECT doc_id, p FROM later UNION SELECT doc_id, p + 1 FROM later),
kept AS (SELECT raw.doc_id, string_agg(raw.line, chr(10) ORDER BY raw.k) FILTER (WHERE g.p IS NULL) AS text, count(g.p) AS n_deleted FROM raw LEFT JOIN ln USING (doc_id, k) LEFT JOIN gone g ON g.doc_id = ln.doc_id AND g.p = ln.p GROUP BY 1)"""

#: Templates as regular expressions over words that each end in a blank.
_TEMPLATES = ", ".join(f"CASE WHEN regexp_matches(j, '(?:^| ){license_scan.regex(m)}') THEN '{label}' END" for label, m in license_scan.TEMPLATES.items())

#: Every window that shares a shingle's place with an item, held against the item itself.
_LEAKS = r"""
dw AS (SELECT DISTINCT doc_id, string_split(trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM documents WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, string_split(trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM benchmark WHERE text IS NOT NULL),
ds AS (SELECT doc_id, len(w) AS n, unnest(range(0, len(w) - 4)) AS p, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM dw WHERE len(w) >= 5),
bs AS (SELECT item_id, len(w) AS n, unnest(range(0, len(w) - 4)) AS p, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM bw WHERE len(w) >= 5),
win AS (SELECT DISTINCT ds.doc_id, bs.item_id, greatest(0, least(ds.p - bs.p, ds.n - bs.n)) AS start, bs.n AS len FROM ds JOIN bs USING (s)),
wc AS (SELECT win.doc_id, win.item_id, win.start, ds.s, count(*) AS c FROM win JOIN ds ON ds.doc_id = win.doc_id AND ds.p BETWEEN win.start AND win.start + win.len - 5 GROUP BY ALL),
wn AS (SELECT doc_id, item_id, start, sum(c) AS n FROM wc GROUP BY ALL),
bc AS (SELECT item_id, s, count(*) AS c FROM bs GROUP BY ALL),
bn AS (SELECT item_id, count(*) AS n FROM bs GROUP BY 1),
com AS (SELECT wc.doc_id, wc.item_id, wc.start, sum(least(wc.c, bc.c)) AS c FROM wc JOIN bc USING (item_id, s) GROUP BY ALL),
sim AS (SELECT com.doc_id, com.item_id, com.start, com.c / (wn.n + bn.n - com.c) AS sim FROM com JOIN wn USING (doc_id, item_id, start) JOIN bn USING (item_id))"""

ORACLE_SQL: dict[str, str] = {
    "op2_license_scan": rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT *, list_filter(range(1, len(w) + 1), lambda i: w[i] = 'mit' AND w[i + 1] = 'license') AS m, list_filter(range(1, len(w) + 1), lambda i: w[i] = 'apache' AND w[i + 1] = 'license') AS a,
  list_filter(range(1, len(w) + 1), lambda i: w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license') AS g, list_aggregate(list_transform(w, lambda x: x || ' '), 'string_agg', '') AS j FROM w),
l AS (SELECT *, list_concat(list_concat(m, a), g) AS places, list_filter([CASE WHEN len(a) > 0 THEN 'apache' END, CASE WHEN len(g) > 0 THEN 'gpl' END, CASE WHEN len(m) > 0 THEN 'mit' END], lambda x: x IS NOT NULL) AS bl,
  list_filter([{_TEMPLATES}], lambda x: x IS NOT NULL) AS tl FROM b)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, CAST(list_min(places) - 1 AS BIGINT) AS first_word, CAST(list_max(places) - 1 AS BIGINT) AS last_word,
  array_to_string(list_sort(bl), ',') AS base_labels, array_to_string(list_sort(list_concat(bl, tl)), ',') AS labels, CASE WHEN len(tl) > 0 THEN 1.0 WHEN len(places) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score FROM l""",
    "op7_decontamination": f"""
WITH {_LEAKS.format()}
SELECT doc_id, item_id, max(sim) AS similarity, CAST(arg_min(start, struct_pack(a := -sim, b := start)) AS BIGINT) AS first_word FROM sim WHERE sim >= 0.75 GROUP BY 1, 2""",
    "op6_line_dedup": f"""
WITH {_LINE_DEDUP.format(docs="documents")}
SELECT d.doc_id, coalesce(k.n_deleted, 0) AS n_deleted, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text FROM documents d LEFT JOIN kept k USING (doc_id)""",
    "op13_spelling_variants": r"""
WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
run AS (SELECT doc_id, run, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents WHERE text IS NOT NULL) GROUP BY ALL HAVING length(run) >= 6),
hx AS (SELECT *, hex(doc_id || ':' || run) AS hx FROM run),
bt AS (SELECT doc_id, run, c, list_transform(range(length(hx) // 2), lambda i: CAST(16 * (instr('0123456789ABCDEF', hx[2 * i + 1]) - 1) + instr('0123456789ABCDEF', hx[2 * i + 2]) - 1 AS BIGINT)) AS b FROM hx),
cr AS (SELECT doc_id, run, c, xor(list_reduce(list_prepend(4294967295, b), lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295) AS h FROM bt, tab),
ww AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, c FROM cr),
w AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM ww WHERE length(word) >= 6 GROUP BY 1 HAVING sum(c) >= 5),
d AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS s FROM (SELECT word, unnest(range(length(word))) AS i FROM w)),
near AS (SELECT a.word, b.word AS other FROM d a JOIN d b ON a.s = b.s AND a.i = b.i AND a.word <> b.word UNION SELECT d.word, w.word FROM d JOIN w ON d.s = w.word UNION SELECT w.word, d.word FROM d JOIN w ON d.s = w.word),
nn AS (SELECT near.word, count(*) AS n_near, arg_min(other, struct_pack(a := -o.n, b := encode(other))) AS best, max(o.n) AS best_n FROM near JOIN w o ON o.word = near.other GROUP BY 1),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * n THEN best END AS form, CASE WHEN best_n >= 5 * n THEN best_n END AS form_n FROM w LEFT JOIN nn USING (word)),
ch(word, root, k) AS (SELECT word, word, 0 FROM f UNION ALL SELECT ch.word, f.form, k + 1 FROM ch JOIN f ON f.word = ch.root WHERE f.form IS NOT NULL)
SELECT word, form, (SELECT arg_max(root, k) FROM ch WHERE ch.word = f.word) AS root, n, n_near, form_n FROM f""",
    "op12_ranked_lexical_search": rf"""
WITH dt AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{ranked_search._PATTERN}')) AS term FROM documents),
bt AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{ranked_search._PATTERN}')) AS term FROM benchmark) GROUP BY ALL),
tf AS (SELECT doc_id, term, count(*) AS tf FROM dt GROUP BY ALL), dn AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY 1), s AS (SELECT count(*) AS n_all, CAST(sum(n) AS BIGINT) AS l FROM dn),
m AS (SELECT doc_id, 75 + (25 * n * n_all) // l AS m FROM dn, s), w AS (SELECT term, CAST(floor(1000 * ln((2 * max(n_all) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY 1),
sc AS (SELECT bt.item_id, tf.doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM bt JOIN tf USING (term) JOIN w USING (term) JOIN m ON m.doc_id = tf.doc_id GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 20""",
    "op10_ngram_jaccard_join": f"""
WITH RECURSIVE {_SHINGLES},
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 75 * (x.n_shingles + y.n_shingles - c)),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a),
g AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY 1)
SELECT n.doc_id, n.n_shingles, g.component_id FROM n JOIN g USING (doc_id)""",
}
