"""The ten operators over the driver's tables, with their production parameters, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, embeddings, langid, licenses, linededup, lmscore, packing, quality, simhash, toxicity
from .common import fold_of, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed. A null or empty text is one piece with the closing 0; rows that repeat give their pieces again; an empty table gives none."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), word_bpe())


@query
def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and component. Null, empty and wordless texts have fingerprint zero and are linked; repeated rows repeat."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def held_out(column: str, folds: int, fold: int) -> F.Column:
    """Whether an id is of the fold that isn't learned from; a null id isn't."""
    return F.coalesce(fold_of(column, folds) == fold, F.lit(False)).alias("held_out")


def _learned(spark: SparkSession, sf_dir: str, folds: int, held: int) -> tuple[DataFrame, DataFrame]:
    """Documents and the labels that may be learned."""
    return table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter(fold_of("doc_id", folds) != held)


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored. Null and empty texts score like a text without words; a null id is not held out and teaches nothing; without labels all scores are equal and below 0.7."""
    docs, labels = _learned(spark, sf_dir, 3, 1)
    found = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, labels), keep=["doc_id"])
    return found.select("doc_id", held_out("doc_id", 3, 1), "score", "predicted", "language")


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its language. Null texts and those without a letter are `und` with score 0; a null id is not held out; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(fold_of("doc_id", 4) != 2))
    found = langid.predict(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", held_out("doc_id", 4, 2), "lang_pred", "score", "code_bits")


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored. Null and empty texts score like a text without features; a null id is not held out and teaches nothing; without labels every score is 0.5."""
    docs, labels = _learned(spark, sf_dir, 3, 1)
    found = quality.score(docs.select("doc_id", "text"), quality.fit(docs, labels), keep=["doc_id"])
    return found.select("doc_id", held_out("doc_id", 3, 1), "score", "predicted")


@query
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scanned. A null text is an empty one: no words, no labels, score 0; repeated rows repeat."""
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"]).drop("spans")


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its lines, those dropped, and the rest. Null html has no lines and a null text; a null url is a site of its own; repeated pages count as pages each."""
    pages = table(spark, sf_dir, "pages")
    return linededup.drop_boilerplate(pages, linededup.host("url"), linededup.html_lines("html"), keep=["page_id"])


ORACLES["op2_line_dedup"] = r"""
WITH lined AS (
  SELECT page_id, coalesce(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS site,
    list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
      '<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'gis'), '[\s\x{A0}]+', ' ', 'g'),
      '</?(p|div|li|ul|ol|br|h[1-6]|tr|td|th|table|article|section|nav|header|footer|title|head|body|html)\b[^>]*>', chr(10), 'gi'),
      '<[^>]*>', '', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines
  FROM pages),
totals AS (SELECT site, count(*) AS total FROM lined GROUP BY site),
often AS (SELECT site, line, count(*) AS n FROM (SELECT site, unnest(list_distinct(lines)) AS line FROM lined) GROUP BY site, line),
bad AS (SELECT site, list(line) AS bad FROM often JOIN totals USING (site) WHERE n >= 4 AND n > 0.1 * total GROUP BY site),
kept AS (SELECT page_id, lines, list_filter(lines, lambda x: NOT coalesce(list_contains(bad, x), false)) AS k FROM lined LEFT JOIN bad USING (site))
SELECT page_id, len(lines)::BIGINT AS n_lines, (len(lines) - len(k))::BIGINT AS n_dropped, array_to_string(k, chr(10)) AS clean_text FROM kept
"""


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leak of a benchmark item in a document, at its best place. Null and empty texts leak nothing; repeated rows give their leaks once."""
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# windows at every offset that a shared shingle gives, compared by weighted Jaccard similarity; no fingerprints
ORACLES["op6_decontamination"] = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
d AS (SELECT doc_id, len(w) AS n, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) AS s FROM w WHERE len(w) >= 5),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, len(w) AS size, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) AS t FROM iw WHERE len(w) >= 5),
dp AS (SELECT doc_id, n, unnest(s) AS h, generate_subscripts(s, 1) - 1 AS place FROM d),
ip AS (SELECT item_id, size, h, min(p) AS p FROM (SELECT item_id, size, unnest(t) AS h, generate_subscripts(t, 1) - 1 AS p FROM i) GROUP BY ALL),
win AS (SELECT DISTINCT doc_id, n, size, greatest(0, least(place - p, n - size)) AS start_word FROM dp JOIN ip USING (h)),
own AS (SELECT win.doc_id, size, start_word, least(size, win.n) AS n_words, s[start_word + 1 : start_word + least(size, win.n) - 4] AS o FROM win JOIN d USING (doc_id)),
pairs AS (SELECT doc_id, item_id, start_word, n_words, o, t, list_aggregate(list_transform(list_intersect(o, t), lambda v: least(len(list_filter(o, lambda x: x = v)), len(list_filter(t, lambda x: x = v)))), 'sum') AS m FROM own JOIN i USING (size)),
sim AS (SELECT doc_id, item_id, start_word, n_words, m / (len(o) + len(t) - m) AS similarity FROM pairs)
SELECT doc_id, item_id, start_word::BIGINT AS start_word, n_words::BIGINT AS n_words, round(similarity, 6) AS similarity FROM sim WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start_word) = 1
"""


@query
def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored against conversations. Texts without words have 0 tokens and null scores; repeated rows count and are scored as often as they stand."""
    found = lmscore.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "conversations"))
    return found.select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")])


ORACLES["op3_lm_scoring"] = r"""
WITH words AS (
  SELECT 'b' AS m, doc_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL
  SELECT 't', NULL, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') FROM conversations),
ids AS (SELECT m, id, list_transform(w, lambda x: ('0x' || substr(md5(x), 1, 5))::BIGINT) AS v FROM words),
uni AS (SELECT m, u, count(*) AS n FROM (SELECT m, unnest(v) AS u FROM ids) GROUP BY ALL),
tot AS (SELECT m, sum(n) AS n FROM uni GROUP BY m),
pairs AS (SELECT m, id, unnest(v[:-2]) AS h, unnest(v[2:]) AS u FROM ids WHERE len(v) > 1),
pc AS (SELECT m, h, u, count(*) AS n FROM pairs GROUP BY ALL),
ctx AS (SELECT m, h, sum(n) AS n FROM pc GROUP BY ALL),
own AS (SELECT id, h, u, count(*) AS k FROM pairs WHERE m = 'b' GROUP BY ALL),
model AS (SELECT 't' AS m UNION ALL SELECT 'b'),
pl AS (SELECT o.id, model.m, sum(o.k * -ln((coalesce(pc.n, 0) + 5.0 * ((coalesce(uni.n, 0) + 0.1) / (tot.n + 0.1 * 1048576))) / (coalesce(ctx.n, 0) + 5.0))) AS loss
  FROM own o CROSS JOIN model JOIN tot ON tot.m = model.m LEFT JOIN pc ON pc.m = model.m AND pc.h = o.h AND pc.u = o.u
  LEFT JOIN uni ON uni.m = model.m AND uni.u = o.u LEFT JOIN ctx ON ctx.m = model.m AND ctx.h = o.h GROUP BY ALL),
fl AS (SELECT ids.id, tot.m, len(v) AS n, -ln((coalesce(uni.n, 0) + 0.1) / (tot.n + 0.1 * 1048576)) AS loss
  FROM ids CROSS JOIN tot LEFT JOIN uni ON uni.m = tot.m AND uni.u = ids.v[1] WHERE ids.m = 'b'),
per AS (SELECT fl.id, fl.m, fl.n, CASE WHEN fl.n > 0 THEN (fl.loss + coalesce(pl.loss, 0)) / fl.n END AS loss FROM fl LEFT JOIN pl ON pl.id = fl.id AND pl.m = fl.m)
SELECT id AS doc_id, any_value(n)::BIGINT AS n_tokens, round(max(loss) FILTER (m = 't'), 6) AS target_loss, round(max(loss) FILTER (m = 'b'), 6) AS background_loss,
  round(max(loss) FILTER (m = 't') - max(loss) FILTER (m = 'b'), 6) AS score FROM per GROUP BY id
"""


@query
def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its links and component. Null, zero and non-finite vectors and null labels link with nothing; equal vectors are linked like others."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


# every pair of a label, which only small tables allow
ORACLES["op7_embedding_near_dedup"] = r"""
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.v, b.v) >= 0.93 * sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM comp LEFT JOIN n USING (vec_id)
"""


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, as corpus_pipeline.run() describes."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
