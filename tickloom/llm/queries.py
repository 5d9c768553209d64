"""The opN queries over the given tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import base

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return base.prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of documents by 2-word shingles at 80 percent; nulls, ties and repeats as in minhash.near_duplicates."""
    from .minhash import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"), k=2, threshold=80)


def op2_warc_seekable_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, written and read back; a null html is an empty payload, as in warc.write_bundles."""
    from .warc import round_trip

    return round_trip(_read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op3_token_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document in plane files, read back; null texts have their end id, as in tokens.write_tokens."""
    from .tokens import round_trip

    return round_trip(_read(spark, sf_dir, "documents"), tokenizer_file(), 1).select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_mix_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents and the shards that each is drawn for, as in mixing.mix."""
    from .mixing import mix

    return mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "draws.shard")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document by a model of those that aren't held out; und without a letter, as in language.identify.
    A null doc_id isn't held out.
    """
    from pyspark.sql import functions as F

    from .language import fit, identify, third

    docs = _read(spark, sf_dir, "documents")
    model = fit(docs.where(F.coalesce(third("doc_id") != 1, F.lit(True))))
    named = identify(docs.select("doc_id", "text"), model)
    return named.select("doc_id", F.coalesce(third("doc_id") == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op6_ngram_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by a model of those that aren't held out, as in ngram.score.  A null doc_id isn't held out."""
    from pyspark.sql import functions as F

    from .ngram import score, train

    docs = _read(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    scored = score(docs, train(docs.where(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_pii_boosted_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document, with what the trees add and secrets, as in pii.digest."""
    from .pii import digest, fit

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(docs, fit(docs))


def op8_media_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a stored WAV object, read back, inspected and described, as in media.features."""
    from .media import features

    return features(_read(spark, sf_dir, "documents"))


def op9_html_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, as in html.extract."""
    from .html import extract

    return extract(_read(spark, sf_dir, "pages"))


def op10_decontaminate_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in every document, as in decontaminate.contamination."""
    from .decontaminate import contamination

    return contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in every document, a tenth of them rewritten to repeat from some word on, as in periodic.collapse.
    A null doc_id is in no tenth; without runs the four columns of the strongest are null.
    """
    from pyspark.sql import functions as F

    from .periodic import collapse, strongest

    docs = _read(spark, sf_dir, "documents")
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda x: x != "")
    h = F.crc32(F.col("doc_id").cast("string"))
    repeated = F.expr("""array_join(transform(w, (x, i) -> if(i < g % size(w), x,
        w[cast(g % size(w) + (i - g % size(w)) % (1 + (size(w) - g % size(w)) div (3 + g % 8)) as int)])), ' ')""")
    chosen = docs.select("doc_id", "text", F.expr("crc32(cast(doc_id as string)) div 10").alias("g"), F.when((h % 10 == 0) & F.col("text").isNotNull(), words).alias("w"))
    found = collapse(chosen.select("doc_id", F.when(F.size("w") > 0, repeated).otherwise(F.col("text")).alias("text")), texts=False)
    best = strongest("runs")
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.col("kept_sha256").alias("collapsed_sha256"),
    )


def op12_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors of greatest integer inner product for every 20th vector, as in topk.nearest."""
    from pyspark.sql import functions as F

    from .topk import nearest

    return nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 strongest phrases of each language in all documents, as in phrases.collocations."""
    from .phrases import collocations

    return collocations(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_warc_seekable_bundles": op2_warc_seekable_bundles,
    "op3_token_bit_planes": op3_token_bit_planes,
    "op4_mix_to_weights": op4_mix_to_weights,
    "op5_language_id": op5_language_id,
    "op6_ngram_lm_score": op6_ngram_lm_score,
    "op7_pii_boosted_candidates": op7_pii_boosted_candidates,
    "op8_media_signatures": op8_media_signatures,
    "op9_html_text_density": op9_html_text_density,
    "op10_decontaminate_pigeonhole": op10_decontaminate_pigeonhole,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_pivot_topk": op12_pivot_topk,
    "op13_phrase_collocations": op13_phrase_collocations,
}

ORACLE: dict[str, str] = {
    "op1_minhash_near_dedup": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
  FROM words),
parts AS (SELECT doc_id, unnest(s) AS g FROM sets),
same AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM parts a JOIN parts b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM same JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
  WHERE 100 * i >= 80 * (len(x.s) + len(y.s) - i)),
twoway AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM sets UNION SELECT r.doc_id, b.b FROM reach r JOIN twoway b ON r.other = b.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.other) AS component_id, s.doc_id = min(r.other) AS kept
FROM sets s JOIN reach r USING (doc_id) GROUP BY s.doc_id, s.s""",
    "op2_warc_seekable_bundles": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY sha1(h)) AS last FROM p)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(x, 1 + (i // 4) * 5, 5))::INTEGER >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM d""",
    "op12_pivot_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op13_phrase_collocations": r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT row_number() OVER () AS id, lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
u AS (SELECT id, lang, unnest(w) AS x, unnest(range(len(w))) AS i FROM w),
t AS (
  SELECT lang, x AS w1, lead(x) OVER o AS w2, lead(x, 2) OVER o AS w3 FROM u WINDOW o AS (PARTITION BY id ORDER BY i)),
f AS (
  SELECT lang, 1 AS size, w1, NULL AS w2, NULL AS w3, w1 AS phrase, count(*) AS a FROM t GROUP BY ALL
  UNION ALL SELECT lang, 2, w1, w2, NULL, w1 || ' ' || w2, count(*) FROM t WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, w1, w2, w3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM t WHERE w3 IS NOT NULL GROUP BY ALL),
c AS (SELECT * FROM f WHERE size > 1 AND a >= 10),
split AS (
  SELECT lang, phrase, a, 1 AS k, w1 AS p, CASE size WHEN 2 THEN w2 ELSE w2 || ' ' || w3 END AS q FROM c
  UNION ALL SELECT lang, phrase, a, 2, w1 || ' ' || w2, w3 FROM c WHERE size = 3),
cuts AS (
  SELECT s.lang, s.phrase, s.a, k, x.a AS l, y.a AS r, ((1000000::HUGEINT * s.a * s.a) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM split s JOIN f x ON x.lang = s.lang AND x.phrase = s.p JOIN f y ON y.lang = s.lang AND y.phrase = s.q),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, w1 || ' ' || w2 AS phrase, a FROM c WHERE size = 3 UNION ALL SELECT lang, w2 || ' ' || w3, a FROM c WHERE size = 3)
  GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN longer x ON b.lang = x.lang AND b.phrase = x.phrase WHERE x.a IS NULL OR 100 * x.a < 50 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE size = 1 GROUP BY ALL)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000""",
}
