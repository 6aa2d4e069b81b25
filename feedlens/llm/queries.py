"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_library
from ..sources.tables import table
from . import (decontamination, jaccard, langid, licences, mixing, neighbours, quality, sharding, simhash,
               spelling, toxicity, urls, whitening)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register `fn(spark, sf_dir)` under `name`, with its DuckDB SQL when there is one."""
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_library(spark)
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return wrap


MIXING_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS k
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w
  FROM rows GROUP BY source),
caps AS (SELECT *, source_size * 3 AS cap FROM sources),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::BIGINT - ((sum(cap) OVER up)::BIGINT - cap))::DOUBLE
            / (sum(w) OVER () - (sum(w) OVER up - w)) AS level
  FROM caps
  WINDOW up AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
plan AS (
  SELECT source, source_size,
         least(cap::DOUBLE, w * max(CASE WHEN level * w <= cap THEN level END) OVER ()) AS target
  FROM levels),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(floor(target + 0.5) / source_size) ELSE 0 END::BIGINT AS whole
  FROM plan),
placed AS (
  SELECT r.doc_id, r.size, b.source_size, b.target, b.whole,
         (floor(b.target + 0.5)::BIGINT - b.whole * b.source_size) AS rest,
         coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.k, r.doc_id NULLS FIRST, r.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM rows r JOIN budgets b ON r.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       (whole * size + least(size, greatest(0, rest - before)))::BIGINT AS taken
FROM placed
"""


@query("op2_mixing", MIXING_SQL)
def op2_mixing(spark, sf_dir):
    """Words each document gives to the mix of all sources (weights 1, 2, 3; at most three epochs)."""
    return mixing.mix_rows(table(spark, sf_dir, "documents"))


@query("op3_simhash")
def op3_simhash(spark, sf_dir):
    """SimHash fingerprint and component of every document (three-word shingles, two bits)."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, radius=2)


@query("op7_sharding")
def op7_sharding(spark, sf_dir):
    """All documents in 16 contiguous shards of near equal bytes."""
    rows = sharding.shard_rows(table(spark, sf_dir, "documents"), 16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                       F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


@query("op8_toxicity")
def op8_toxicity(spark, sf_dir):
    """Toxicity score of every document, learnt from the labelled rows of three folds."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_decontamination")
def op9_decontamination(spark, sf_dir):
    """Every document that holds a benchmark item, with the item, its BM25 share and overlaps."""
    return decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op1_licences")
def op1_licences(spark, sf_dir):
    """Licence of every document, by its own header or by its nearest ancestor directory's file."""
    return licences.scan(licences.as_files(table(spark, sf_dir, "documents")), "doc_id")


@query("op4_langid")
def op4_langid(spark, sf_dir):
    """Language of every document by compression against per-language dictionaries."""
    return langid.language(table(spark, sf_dir, "documents"))


@query("op5_urls")
def op5_urls(spark, sf_dir):
    """Verdict on every page's URL: the longest rule that fits, else the trees'."""
    return urls.verdicts(table(spark, sf_dir, "pages"))


@query("op6_quality")
def op6_quality(spark, sf_dir):
    """Quality score of every document, learnt from positives and unlabelled text."""
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_neighbours")
def op10_neighbours(spark, sf_dir):
    """The 20 nearest others, by inner product, of every vector whose id is divisible by 20."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


JACCARD_SQL = r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT DISTINCT rid, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                     ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s
  FROM words),
sizes AS (SELECT rid, count(*) AS n FROM sets GROUP BY rid),
links AS (
  SELECT a.rid AS u, b.rid AS v
  FROM sets a JOIN sets b ON a.s = b.s AND a.rid <> b.rid
  JOIN sizes x ON x.rid = a.rid JOIN sizes y ON y.rid = b.rid
  GROUP BY a.rid, b.rid, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reach AS (
  SELECT rid AS u, rid AS v FROM words
  UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v)
SELECT any_value(w.doc_id) AS doc_id, coalesce(any_value(z.n), 0)::BIGINT AS n_shingles,
       min(o.doc_id) AS component_id
FROM reach r JOIN words w ON w.rid = r.u JOIN words o ON o.rid = r.v LEFT JOIN sizes z ON z.rid = r.u
GROUP BY r.u
"""


@query("op11_jaccard", JACCARD_SQL)
def op11_jaccard(spark, sf_dir):
    """Set size and component of every document; links at 85 % of common four-word shingles."""
    return jaccard.similar(table(spark, sf_dir, "documents"), width=4, num=85, den=100)


@query("op12_whitening")
def op12_whitening(spark, sf_dir):
    """Every vector on the first 16 principal components of the distinct vectors, at unit variance."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), most=16)


SPELLING_SQL = r"""
WITH RECURSIVE crc_table AS (  -- entries 0 to 255 of the CRC-32 table, as a list
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z:
              CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256))::BIGINT AS i)),
runs AS (
  SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents)
  GROUP BY ALL),
coded AS (
  SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(range(0, len(x)::BIGINT, 2), lambda k: ('0x' || x[k + 1:k + 2])::BIGINT)),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
  FROM coded, crc_table),
words AS (
  SELECT CASE WHEN h % 31 = 0 THEN run[:h % len(run)] || run[h % len(run) + 2:] ELSE run END AS word, sum(n)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING len(word) >= 7 AND sum(n) >= 2),
places AS (SELECT word, unnest(range(len(word)))::BIGINT AS k FROM words),
holes AS (  -- a word with one code point replaced, or left out
  SELECT word, k, word[:k] || '*' || word[k + 2:] AS replaced, word[:k] || word[k + 2:] AS deleted FROM places),
pairs AS (
  SELECT a.word, b.word AS other FROM holes a JOIN holes b ON a.replaced = b.replaced AND a.k = b.k AND a.word <> b.word
  UNION SELECT a.word, b.word FROM holes a JOIN words b ON a.deleted = b.word
  UNION SELECT b.word, a.word FROM holes a JOIN words b ON a.deleted = b.word),
ranked AS (
  SELECT p.word, w.word AS other, w.n AS other_n, count(*) OVER (PARTITION BY p.word) AS n_near,
         row_number() OVER (PARTITION BY p.word ORDER BY w.n DESC, w.word) AS place
  FROM pairs p JOIN words w ON w.word = p.other),
formed AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0)::BIGINT AS n_near, CASE WHEN r.other_n >= 10 * w.n THEN r.other END AS form,
         CASE WHEN r.other_n >= 10 * w.n THEN r.other_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1),
chain AS (
  SELECT word, word AS root, form FROM formed
  UNION ALL SELECT c.word, c.form, f.form FROM chain c JOIN formed f ON f.word = c.form WHERE c.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n
FROM formed f JOIN chain c ON c.word = f.word AND c.form IS NULL
"""


@query("op13_spelling", SPELLING_SQL)
def op13_spelling(spark, sf_dir):
    """Every word with its near words' number, its common form and the last form it leads to."""
    return spelling.variants(table(spark, sf_dir, "documents"))
