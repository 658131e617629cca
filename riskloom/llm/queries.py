"""The queries opN_<name> of this package, and SQL that checks them."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.decontamination import contaminated
from riskloom.llm.filter_audit import audit_documents
from riskloom.llm.html_text import extract_pages
from riskloom.llm.line_crf import fit_line_field, line_quality
from riskloom.llm.mixing import mix_sources
from riskloom.llm.near_duplicates import near_duplicates
from riskloom.llm.paragraphs import repeated_paragraphs
from riskloom.llm.prefix_trie import prefix_trie
from riskloom.llm.repeats import remove_repeats
from riskloom.llm.shared import sized_broadcast, stored
from riskloom.llm.surrogates import replace_entities
from riskloom.llm.token_counts import TokenCountParams, token_counts
from riskloom.llm.token_files import TokenFileParams, token_files
from riskloom.llm.toxicity import fit_toxicity, toxicity_scores

#: Labelled ids that are broadcast; more are joined by a shuffle.
LABELS_SENT = 1_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of the labelled documents outside the held-out fifth; copies of a text are one piece of evidence."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out())
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    labelled = docs.select("doc_id", "text").join(sized_broadcast(known, LABELS_SENT), "doc_id")
    once = labelled.groupBy(F.md5("text").alias("print"), "toxic").agg(F.min("doc_id").alias("doc_id"))
    once = stored(once.select("doc_id", "toxic"), "labelled")
    return docs.select("doc_id", "text").join(sized_broadcast(once, LABELS_SENT), "doc_id").select("text", "toxic")


def op2_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op1_pii_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    return replace_entities(table(spark, folder, "documents"))


def op3_line_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").where("quality is not null").groupBy("doc_id").agg((F.max("quality") > 0).alias("good"))
    field = fit_line_field(docs.join(sized_broadcast(labels, LABELS_SENT), "doc_id").select("text", "good"))
    return line_quality(docs, field)


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = fit_toxicity(training_rows(docs, table(spark, folder, "labels")))
    scores = toxicity_scores(docs.select("doc_id", "text"), model, ["doc_id"])
    return scores.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op6_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract_pages(table(spark, folder, "pages"))


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    documents, _ = mix_sources(table(spark, folder, "documents"))
    return documents.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def token_params() -> TokenFileParams:
    return TokenFileParams(vocabulary=public_tokenizers.path("word_bpe_49k.json"))


def op8_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files(table(spark, folder, "documents"), token_params())


def op9_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_paragraphs(table(spark, folder, "documents"))


def op10_repeats(spark: SparkSession, folder: str) -> DataFrame:
    found = remove_repeats(table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie(table(spark, folder, "conversations"))


def op12_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    params = TokenCountParams(vocabulary=public_tokenizers.path("word_bpe_49k.json"))
    return token_counts(table(spark, folder, "documents"), params)


def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


QUERIES = {
    "op1_pii_surrogates": op1_pii_surrogates,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_line_quality": op3_line_quality,
    "op4_toxicity": op4_toxicity,
    "op5_decontamination": op5_decontamination,
    "op6_html_text": op6_html_text,
    "op7_mixing": op7_mixing,
    "op8_token_files": op8_token_files,
    "op9_paragraphs": op9_paragraphs,
    "op10_repeats": op10_repeats,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_token_counts": op12_token_counts,
    "op13_filter_audit": op13_filter_audit,
}

_OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
items AS (SELECT doc_id, unnest(s) AS g FROM sets),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM items a JOIN items b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM both_ JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * n >= 75 * (len(x.s) + len(y.s) - n)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, ways.b FROM reach JOIN ways ON ways.a = reach.b),
found AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN found USING (doc_id)
"""

_OP13_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
rows_ AS (
  SELECT t.doc_id, part,
    (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY t), false)::INT AS mask,
    coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM t LEFT JOIN l ON l.doc_id = t.doc_id),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM rows_ GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (
  SELECT o, s, 1 << (ascii(substr(o, s, 1)) - 65) AS f,
    list_sum(list_transform(range(1, s), lambda i: 1 << (ascii(substr(o, i, 1)) - 65)))::BIGINT AS earlier
  FROM orders, (SELECT unnest(range(1, 6)) AS s)),
counted AS (
  SELECT part, o, s, f,
    coalesce(sum(n) FILTER (WHERE mask & (coalesce(earlier, 0) | f) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (WHERE mask & coalesce(earlier, 0) = 0 AND mask & f > 0), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE mask & coalesce(earlier, 0) > 0 AND mask & f > 0), 0) AS redundant,
    coalesce(sum(n) FILTER (WHERE mask = f), 0) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE mask & coalesce(earlier, 0) = 0 AND mask & f > 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE mask & coalesce(earlier, 0) = 0 AND mask & f > 0), 0) AS toxic_lost
  FROM cells, steps GROUP BY ALL)
SELECT part, o AS filter_order, s::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM counted
"""

_OP11_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
      md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
    xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda a, b: list_reduce(
        list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, i: xor(c >> 1, (c & 1) * 3988292384::BIGINT))),
      4294967295::BIGINT) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
turns AS (
  SELECT ids.conv_id, 0 AS part, place, role, text FROM ids JOIN t ON t.conv_id = ids.base AND place <= h
  UNION ALL SELECT ids.conv_id, 1, place, role, text FROM ids JOIN t ON t.conv_id = ids.conv_id AND place > h),
paths AS (
  SELECT ids.conv_id, coalesce(l, []) AS l FROM ids LEFT JOIN (
    SELECT conv_id, list({'role': role, 'text': text} ORDER BY part, place) AS l FROM turns GROUP BY 1) x ON x.conv_id = ids.conv_id),
prefixes AS (
  SELECT conv_id, d, md5(l[1:d]::JSON::VARCHAR) AS k, d = len(l) AS ends,
    CASE WHEN d > 0 THEN md5(l[1:d - 1]::JSON::VARCHAR) END AS up,
    CASE WHEN d > 0 THEN len(list_filter(string_split_regex(l[d].text, '[ 	-
]+'), lambda x: x <> '')) ELSE 0 END AS words
  FROM (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS d FROM paths)),
nodes AS (
  SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, min(up) AS up, min(words) AS words,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM prefixes GROUP BY 1, 2),
kids AS (SELECT d - 1 AS d, up AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2),
full_ AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids ON kids.d = nodes.d AND kids.k = nodes.k),
sums AS (
  SELECT p.d, p.k, sum((n_children = 0)::INT) AS n_leaves, sum((n_convs - 1) * f.words) AS saved
  FROM full_ f JOIN prefixes p ON p.conv_id = f.conv_id AND p.d <= f.d GROUP BY 1, 2)
SELECT f.conv_id, f.d::BIGINT AS depth, up.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children,
  n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, f.ends_sha256
FROM full_ f JOIN sums ON sums.d = f.d AND sums.k = f.k LEFT JOIN nodes up ON up.d = f.d - 1 AND up.k = f.up
"""

SQL = {"op2_near_duplicates": _OP2_SQL, "op11_prefix_trie": _OP11_SQL, "op13_filter_audit": _OP13_SQL}
