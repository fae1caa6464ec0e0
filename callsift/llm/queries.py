"""Registered queries of the training-data operators and their DuckDB oracles.

Where SQL cannot express an operator there is no oracle; tests/llm holds it
against a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callsift.llm import (
    block_topk,
    ftrl_langid,
    path_tree,
    periodic_runs,
    phrase_dedup,
    poisson_mix,
    prefix_trie,
    prob_minhash,
    pu_quality,
    rank_codec,
    spherical_dedup,
    swap_pack,
    warc_index,
)
from callsift.llm.work import Work, id_remainder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = ftrl_langid.fit(docs.filter(id_remainder() != 0).select("text", "lang"))
    return ftrl_langid.predict(docs.select("doc_id", (id_remainder() == 0).alias("held_out"), "text"), model).drop("text")


@register("op2_substring_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Work(spark, "phrase-dedup")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return work.finish(phrase_dedup.remove_repeats(docs, with_text=False, work=work).select(
        "doc_id", "n_words", "n_removed", "kept_sha256"))


# Fixed rules of the URL filter: (host, path, verdict).
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@register("op3_url_filter")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is that of the document whose id is the last number of
    its path (good: quality 1 and not toxic)."""
    pages, labels = table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels")
    path = path_tree.host_path(F.col("url"))[1]
    number = F.expr("try_cast(n AS bigint)").alias("doc_id")
    of = pages.select("page_id", F.regexp_extract(path, "([0-9]+)[^0-9]*$", 1).alias("n")).select("page_id", number)
    known = labels.filter("quality IS NOT NULL AND toxic IS NOT NULL").select(
        "doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    work = Work(spark, "path-tree")
    judged = path_tree.judge(pages, of.join(known, "doc_id").select("page_id", "good"), URL_RULES, work=work)
    return work.finish(judged.select("page_id", "host", "path", "rule", "verdict", "template"))


@register("op4_best_fit_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Work(spark, "swap-pack")
    return work.finish(swap_pack.pack(table(spark, sf_dir, "documents"), tokenizer_path(), work=work))


@register("op5_topk_search", """
    WITH v AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                 AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
         s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
               FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
         r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
               FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_topk.top_k(table(spark, sf_dir, "embeddings"))


@register("op6_embedding_near_dedup", """
    WITH RECURSIVE v AS (
           SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
         l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
               WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
         c(a, b) AS (SELECT a, b FROM l UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a),
         n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
         m AS (SELECT a, min(b) AS low FROM c GROUP BY a)
    SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(m.low, vec_id)) AS component_id,
           vec_id = least(vec_id, coalesce(m.low, vec_id)) AS kept
    FROM embeddings e LEFT JOIN n ON e.vec_id = n.a LEFT JOIN m ON e.vec_id = m.a""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spherical_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


_U = "CAST(CAST('0x' || substr(md5({}), 1, 13) AS BIGINT) AS {})"


@register("op7_poisson_mix", f"""
    WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
         w AS (SELECT source, n, sqrt(n) / (SELECT sum(sqrt(n)) FROM n) AS share FROM n),
         r AS (SELECT source, share * (SELECT sum(n) FROM n) / n AS rate FROM w),
         m AS (SELECT *, CAST(greatest(ceil(rate / 64), 1) AS INTEGER) AS draws FROM r),
         p AS (SELECT source, draws, k,
                      sum(exp(-rate / draws + k * ln(rate / draws) - lgamma(k + 1)))
                          OVER (PARTITION BY source ORDER BY k) AS cdf
               FROM m, (SELECT CAST(unnest(range(0, 200)) AS DOUBLE) AS k)),
         j AS (SELECT source, rate, draws, unnest(range(1, draws + 1)) AS j FROM m),
         u AS (SELECT doc_id, d.source, j.j, j.rate,
                      {_U.format("'mix-7|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || j.j", "DOUBLE")}
                          / 4503599627370496.0 AS u
               FROM (SELECT DISTINCT doc_id, source FROM documents) d
               JOIN j ON d.source IS NOT DISTINCT FROM j.source),
         k AS (SELECT u.doc_id, u.source, u.rate, count(*) AS n_copies FROM u
               JOIN p ON u.source IS NOT DISTINCT FROM p.source AND p.cdf <= u.u GROUP BY ALL),
         c AS (SELECT d.*, k.rate, k.n_copies FROM documents d
               JOIN k ON d.doc_id IS NOT DISTINCT FROM k.doc_id AND d.source IS NOT DISTINCT FROM k.source),
         x AS (SELECT *, unnest(range(0, CAST(n_copies AS BIGINT))) AS copy FROM c)
    SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INTEGER) AS copy, CAST(n_copies AS INTEGER) AS n_copies,
           round(rate, 9) AS rate,
           {_U.format("'mix-7-order|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || copy", "BIGINT")} AS shuffle_key
    FROM x""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poisson_mix.replicate(table(spark, sf_dir, "documents")).withColumn("rate", F.round("rate", 9))


@register("op8_pu_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learn = id_remainder() != 0
    model = pu_quality.fit(docs.filter(learn).select("doc_id", "text"), labels.filter(learn).select("doc_id", "quality"))
    scored = pu_quality.score(docs.select("doc_id", (id_remainder() == 0).alias("held_out"), "text"), model).drop("text")
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@register("op9_warc_index", """
    WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
         d AS (SELECT page_id, octet_length(encode(h)) AS n, sha256(h) AS d FROM p),
         m AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) END AS low FROM d)
    SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
           CASE WHEN low IS NULL OR page_id = low THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN low IS NULL OR page_id = low THEN NULL ELSE low END AS refers_to
    FROM m""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages carry no time of capture; page n is taken n seconds after 2020 began."""
    at = F.timestamp_seconds(F.lit(1577836800) + F.coalesce(F.col("page_id"), F.lit(0)))
    work = Work(spark, "warc")
    return work.finish(warc_index.archive_and_index(table(spark, sf_dir, "pages"), at, work=work).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


@register("op10_minhash_near_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prob_minhash.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", "component_id", "n_copies", "kept")


@register("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.with_cycles(table(spark, sf_dir, "documents"))
    found = periodic_runs.periodic_runs(docs).withColumn("best", periodic_runs.strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"))


def _trie_oracle() -> str:
    """Every rebuilt conversation lists the names of its prefixes; a node's
    subtree is what its smallest member's prefixes lie above."""
    crc = ("xor(list_reduce([4294967295] || [CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(conv_id AS VARCHAR), '')], "
           "lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], "
           "lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)")
    return f"""
    WITH z AS (SELECT conv_id, turn, coalesce(text, '') AS text,
                      md5(length(coalesce(role, '')) || ' ' || coalesce(role, '') || coalesce(text, '')) AS k
               FROM conversations WHERE conv_id IS NOT NULL),
         t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS p FROM z),
         c AS (SELECT DISTINCT conv_id, CAST({crc} AS BIGINT) % 4 AS h FROM conversations WHERE conv_id IS NOT NULL),
         r AS (SELECT c.conv_id, 0 AS part, p, k, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND p <= h
               UNION ALL SELECT c.conv_id, 1, p, k, text FROM c JOIN t ON t.conv_id = c.conv_id AND p > h),
         s AS (SELECT conv_id, row_number() OVER w AS depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words, k
               FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, p)),
         x AS (SELECT conv_id, depth, words, md5(string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS name FROM s
               UNION ALL SELECT conv_id, 0, 0, '' FROM c),
         e AS (SELECT name, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends
               FROM (SELECT conv_id, arg_max(name, depth) AS name FROM x GROUP BY conv_id) GROUP BY name),
         n AS (SELECT name, depth, any_value(words) AS words, min(conv_id) AS low, count(*) AS n FROM x GROUP BY name, depth),
         m AS (SELECT n.*, q.name AS up, u.low AS up_low FROM n
               LEFT JOIN x q ON q.conv_id = n.low AND q.depth = n.depth - 1 LEFT JOIN n u ON u.name = q.name),
         k AS (SELECT up AS name, count(*) AS kids FROM m WHERE up IS NOT NULL GROUP BY up),
         g AS (SELECT a.name, sum(CAST(k.kids IS NULL AS INTEGER)) AS leaves, sum((n.n - 1) * n.words) AS saved
               FROM n LEFT JOIN k USING (name) JOIN x a ON a.conv_id = n.low AND a.depth <= n.depth GROUP BY a.name)
    SELECT m.low AS conv_id, CAST(m.depth AS BIGINT) AS depth, m.up_low AS parent_conv_id, CAST(m.n AS BIGINT) AS n_convs,
           CAST(coalesce(k.kids, 0) AS BIGINT) AS n_children, CAST(g.leaves AS BIGINT) AS n_leaves,
           CAST(g.saved AS BIGINT) AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
    FROM m JOIN g ON m.name = g.name LEFT JOIN k ON m.name = k.name LEFT JOIN e ON m.name = e.name"""


@register("op12_prefix_trie", _trie_oracle())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.sequences(table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(prefix_trie.rebuilt(turns))


@register("op13_token_files")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Work(spark, "token-files")
    path = work.path("files")
    rank_codec.write_ids(table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"), work=work)
    return work.finish(rank_codec.read_ids(spark, path, with_ids=False, work=work))
