"""One query for each operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomwork.llm import decontamination, media, near, packing, periodic, pii, pseudo, quality, ranking, substrings, suffixes, toxicity, warc
from loomwork.llm.common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.ogg_digests(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "copy_id", "class_id", "n_links")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_dedup(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op10_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo.pseudo_likelihood(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digests(periodic.with_planted_periods(table(spark, sf_dir, "documents")))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.suffix_dedup(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_best_fit_packing, op2_toxicity, op3_quality, op4_decontamination, op5_ogg, op6_pii, op7_jaccard_join, op8_substring_dedup, op9_warc, op10_pseudo_likelihood, op11_periodic_runs, op12_lexical_search, op13_suffix_dedup)}

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP4 = f"""
WITH d AS (SELECT doc_id, {_PLAIN.format("coalesce(text, '')")} AS words FROM documents),
b AS (SELECT item_id, {_PLAIN.format("coalesce(text, '')")} AS words FROM benchmark),
sizes AS (SELECT item_id, words, least(13, len(words)) AS k FROM b WHERE len(words) > 0),
starts AS (SELECT item_id, words, k, unnest(range(1, len(words) - k + 2)) AS s FROM sizes),
wanted AS (SELECT DISTINCT item_id, k, array_to_string(words[s:s + k - 1], ' ') AS key FROM starts),
lengths AS (SELECT DISTINCT k FROM wanted),
places AS (SELECT doc_id, words, k, unnest(range(1, len(words) - k + 2)) AS s FROM d, lengths WHERE len(words) >= k),
windows AS (SELECT doc_id, k, s, array_to_string(words[s:s + k - 1], ' ') AS key FROM places),
hits AS (SELECT w.doc_id, w.k, w.s, x.item_id FROM windows w JOIN wanted x ON w.k = x.k AND w.key = x.key),
words_hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hits) h GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) i GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items, sha256(coalesce(i.listed, '')) AS items_sha256,
  coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(d.words) AS contaminated
FROM d LEFT JOIN words_hit h ON d.doc_id = h.doc_id LEFT JOIN items i ON d.doc_id = i.doc_id
"""

_OP7 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_PLAIN.format("coalesce(text, '')")} AS words FROM documents),
places AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS s FROM d WHERE len(words) > 0),
grams AS (SELECT DISTINCT doc_id, array_to_string(words[s:s + 4], ' ') AS g FROM places),
sizes AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS kind FROM grams GROUP BY doc_id),
kinds AS (SELECT kind, min(doc_id) AS rep, count(*) AS copies, any_value(n) AS n FROM sizes GROUP BY kind),
own AS (SELECT g.doc_id AS rep, g.g FROM grams g JOIN kinds k ON g.doc_id = k.rep),
pairs AS (SELECT a.rep AS a, b.rep AS b, count(*) AS shared FROM own a JOIN own b ON a.g = b.g AND a.rep <> b.rep GROUP BY 1, 2),
links AS (SELECT p.a, p.b, y.copies FROM pairs p JOIN kinds x ON p.a = x.rep JOIN kinds y ON p.b = y.rep WHERE 10 * p.shared >= 8 * (x.n + y.n - p.shared)),
reach AS (SELECT rep AS node, rep AS other FROM kinds UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a),
roots AS (SELECT node, min(other) AS class_id FROM reach GROUP BY node),
linked AS (SELECT a, sum(copies) AS n FROM links GROUP BY a)
SELECT d.doc_id, coalesce(k.rep, d.doc_id) AS copy_id, coalesce(r.class_id, d.doc_id) AS class_id, CAST(coalesce(k.copies - 1, 0) + coalesce(l.n, 0) AS BIGINT) AS n_links
FROM d LEFT JOIN sizes s ON d.doc_id = s.doc_id LEFT JOIN kinds k ON s.kind = k.kind LEFT JOIN roots r ON k.rep = r.node LEFT JOIN linked l ON k.rep = l.a
"""

_OP8 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
places AS (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS s FROM d WHERE len(words) >= 20),
windows AS (SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(words[s:s + 19], ' ') ORDER BY doc_id, s) AS r FROM places),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(s, s + 20)) AS p FROM windows WHERE r > 1) x),
each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM d),
kept AS (SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.p) AS text FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p WHERE g.p IS NULL GROUP BY e.doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256 FROM d LEFT JOIN counts c ON d.doc_id = c.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

_BASE32 = " || ".join(f"to_base(CAST('0x' || substr(sha, {1 + 10 * k}, 10) AS BIGINT), 32, 8)" for k in range(4))
_OP9 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
f AS (SELECT sha, min(page_id) AS first FROM p GROUP BY sha)
SELECT p.page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, translate({_BASE32.replace("sha,", "p.sha,")}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
  CASE WHEN p.page_id = f.first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN p.page_id <> f.first THEN f.first END AS refers_to
FROM p JOIN f ON p.sha = f.sha
"""

_OP12 = f"""
WITH d AS (SELECT doc_id, {_PLAIN.format("coalesce(text, '')")} AS terms FROM documents),
c AS (SELECT count(*) FILTER (len(terms) > 0) AS n, CAST(sum(len(terms)) AS BIGINT) AS l FROM d),
q AS (SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest({_PLAIN.format("coalesce(text, '')")}) AS t FROM benchmark) b),
tf AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS t FROM d) x WHERE t IN (SELECT t FROM q) GROUP BY doc_id, t),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * c.n + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM df, c),
m AS (SELECT doc_id, 100 - 50 + ((50 * CAST(len(terms) AS BIGINT) * c.n) // c.l) AS m FROM d, c WHERE len(terms) > 0),
s AS (SELECT q.item_id, tf.doc_id, CAST(sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * m.m))) AS BIGINT) AS score
  FROM q JOIN tf ON q.t = tf.t JOIN w ON q.t = w.t JOIN m ON tf.doc_id = m.doc_id GROUP BY q.item_id, tf.doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""

#: SQL for the queries whose results SQL can express; the others are held against plain versions in the tests.
ORACLES: dict[str, str] = {"op4_decontamination": _OP4, "op7_jaccard_join": _OP7, "op8_substring_dedup": _OP8, "op9_warc": _OP9, "op12_lexical_search": _OP12}
