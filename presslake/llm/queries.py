"""The dealt operators as registered queries with their contracts' parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presslake.llm import (
    chat,
    forest,
    graph,
    licenses,
    mixing,
    ngrams,
    packing,
    phrases,
    quality,
    simhash,
    suffix_dedup,
    toxicity,
    whitening,
)
from presslake.llm.common import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def registered(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(tune(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return fn


@registered
def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3)


@registered
def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return suffix_dedup.remove_repeats(docs, min_len=100).select(
        F.col("row.doc_id").alias("doc_id"),
        "n_bytes",
        gone.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@registered
def op2_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(table(spark, sf_dir, "documents"), cycle=(1, 2, 3), max_repeats=3)
    each = planned.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return each.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


SQL["op2_mixing_sources"] = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS line
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(3 * sum(size) AS BIGINT) AS cap,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source),
ranked AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS budget,
         CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER upto, 0) AS BIGINT) AS rest,
         CAST(sum(weight) OVER () - coalesce(sum(weight) OVER upto, 0) AS BIGINT) AS weights
  FROM sources
  WINDOW upto AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
free AS (
  SELECT rest AS free_rest, weights AS free_weights FROM ranked WHERE rest * weight < cap * weights
  ORDER BY cap / weight, source NULLS LAST LIMIT 1),
goals AS (
  SELECT source, source_size, budget,
         CASE WHEN rest * weight >= cap * weights THEN CAST(cap AS DOUBLE)
              ELSE (free_rest * weight) / free_weights END AS target
  FROM ranked LEFT JOIN free ON true),
queue AS (
  SELECT s.*, g.source_size, g.target, g.budget,
         CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.line ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
turns AS (SELECT q.*, (upto + turn * source_size) / target AS finish FROM queue q, range(3) AS r(turn) WHERE size > 0),
used AS (
  SELECT *, sum(size) OVER (ORDER BY finish, line, source NULLS FIRST ROWS UNBOUNDED PRECEDING) AS used FROM turns),
counted AS (SELECT doc_id, count(*) AS copies FROM used WHERE used <= budget GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(q.size * coalesce(c.copies, 0) AS BIGINT) AS taken
FROM queue q LEFT JOIN counted c ON q.doc_id = c.doc_id
"""


def fold(parts: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts))


def judged(scored: DataFrame, parts: int, held: int, threshold: float) -> DataFrame:
    return scored.select(
        "doc_id",
        (fold(parts) == held).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= threshold).cast("int").alias("predicted"),
    )


@registered
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), "quality", train=fold(3) != 1)
    return judged(quality.score(docs, model, ["doc_id"]), 3, 1, 0.5)


@registered
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", train=fold(4) != 2)
    return judged(toxicity.score(docs, model, ["doc_id"]), 4, 2, 0.3)


@registered
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), tokenizer_path(), length=1024, end_id=2), length=1024)


@registered
def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = ngrams.fit(docs, train=fold(7) != 2)
    return ngrams.score(docs, model, ["doc_id"]).select(
        "doc_id",
        (fold(7) == 2).alias("held_out"),
        F.col("_n_tokens").alias("n_tokens"),
        F.col("_n_known").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        F.col("_base_score").alias("base_score"),
        F.col("_score").alias("score"),
    )


@registered
def op6_approximate_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@registered
def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"), instructing=("system",))


SQL["op5_chat_formatting"] = r"""
WITH views AS (SELECT DISTINCT conv_id, role AS perspective FROM conversations WHERE role IS NULL OR role <> 'system'),
seen AS (
  SELECT t.conv_id, v.perspective, t.turn, t.role AS speaker,
         CASE WHEN t.role = 'system' THEN 'system' WHEN t.role IS NOT DISTINCT FROM v.perspective THEN 'assistant' ELSE 'user' END AS role,
         CASE WHEN t.role IS DISTINCT FROM 'system' AND t.role IS DISTINCT FROM v.perspective
              THEN replace(coalesce(t.role, 'unknown'), '<|im_', '< |im_') END AS name,
         replace(coalesce(t.text, ''), '<|im_', '< |im_') || '<|im_end|>' || chr(10) AS body, t.text
  FROM conversations t JOIN views v ON t.conv_id IS NOT DISTINCT FROM v.conv_id),
made AS (
  SELECT *, '<|im_start|>' || role || coalesce(' name=' || name, '') || chr(10) AS head FROM seen),
placed AS (
  SELECT *, CAST(sum(length(head) + length(body)) OVER (
      PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, speaker NULLS LAST, text NULLS LAST
      ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop
  FROM made)
SELECT conv_id, perspective, turn, speaker, role, name, head || body AS rendered,
       CAST(stop - length(head) - length(body) AS BIGINT) AS start,
       CASE WHEN role = 'assistant' AND speaker IS NOT DISTINCT FROM perspective THEN CAST(stop - length(body) AS BIGINT) END AS mask_start,
       CASE WHEN role = 'assistant' AND speaker IS NOT DISTINCT FROM perspective THEN stop END AS mask_end
FROM placed
"""


@registered
def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


SQL["op1_embedding_near_dedup"] = r"""
WITH RECURSIVE clean AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, len(embedding) AS n FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
usable AS (SELECT * FROM clean),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id
          WHERE CASE WHEN a.n = b.n THEN list_cosine_similarity(a.v, b.v) >= 0.95 ELSE false END),
reach AS (SELECT vec_id AS a, vec_id AS b FROM usable UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
found AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, coalesce(f.component_id, e.vec_id) AS component_id,
       e.vec_id = coalesce(f.component_id, e.vec_id) AS kept
FROM embeddings e LEFT JOIN found f USING (vec_id) LEFT JOIN counts c USING (vec_id)
"""

SQL["op3_suffix_array_dedup"] = r"""
WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
places AS (SELECT doc_id, h, unnest(range(n - 99)) AS p FROM bytes WHERE n >= 100),
strings AS (SELECT doc_id, p, md5_number(substring(h, 2 * p + 1, 200)) AS s FROM places),
repeats AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS nth FROM strings) WHERE nth > 1),
edges AS (SELECT doc_id, p, p > lag(p, 1, -1000) OVER (PARTITION BY doc_id ORDER BY p) + 100 AS opens FROM repeats),
runs AS (SELECT doc_id, p, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM edges),
spans AS (SELECT doc_id, run, min(p) AS a, max(p) + 100 AS b FROM runs GROUP BY doc_id, run),
cuts AS (
  SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b FROM spans GROUP BY doc_id)
SELECT x.doc_id, x.n AS n_bytes, CAST(coalesce(c.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(c.n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN c.doc_id IS NULL THEN h ELSE
         array_to_string(list_transform(range(len(a) + 1), lambda i:
           substring(h, 2 * (CASE WHEN i = 0 THEN 0 ELSE b[i] END) + 1,
                     2 * ((CASE WHEN i = len(a) THEN n ELSE a[i + 1] END) - (CASE WHEN i = 0 THEN 0 ELSE b[i] END)))), '') END)) AS kept_sha256
FROM bytes x LEFT JOIN cuts c ON x.doc_id = c.doc_id
"""


@registered
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"), max_words=5, min_count=100, scale=1000, best=2000)


SQL["op11_phrase_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM words GROUP BY lang),
places AS (SELECT lang, w, unnest(range(len(w))) AS p FROM words),
windows AS (
  SELECT lang, m, array_to_string(w[p + 1 : p + m], ' ') AS phrase FROM places, range(1, 6) AS r(m)
  WHERE p + m <= len(w)),
counts AS (SELECT lang, phrase, any_value(m) AS m, CAST(count(*) AS HUGEINT) AS f FROM windows GROUP BY lang, phrase HAVING count(*) >= 100),
parts AS (SELECT lang, phrase, m, f, string_split(phrase, ' ') AS w FROM counts),
inner_ones AS (
  SELECT x.lang, array_to_string(x.w[s + 1 : s + k], ' ') AS phrase, max(x.f) AS best
  FROM parts x, range(0, 4) AS a(s), range(2, 5) AS b(k) WHERE k < x.m AND s + k <= x.m GROUP BY ALL),
kept AS (
  SELECT x.* FROM parts x LEFT JOIN inner_ones i ON x.lang = i.lang AND x.phrase = i.phrase
  WHERE x.m >= 2 AND (i.best IS NULL OR 100 * i.best < 100 * x.f)),
cuts AS (
  SELECT x.lang, x.phrase, x.f AS a, k, l.f AS l, r.f AS r, t.n, (1000 * x.f * t.n) // (l.f * r.f) AS score
  FROM kept x JOIN range(1, 5) AS c(k) ON k < x.m
  JOIN counts l ON l.lang = x.lang AND l.phrase = array_to_string(x.w[1 : k], ' ')
  JOIN counts r ON r.lang = x.lang AND r.phrase = array_to_string(x.w[k + 1 : x.m], ' ')
  JOIN totals t ON t.lang = x.lang),
weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
       CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM weakest QUALIFY rank <= 2000
"""


@registered
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=4, scale=256)


@registered
def op13_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), k=3, similarity=0.8).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )
