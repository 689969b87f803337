"""One query for each operator over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortia.llm import align, html, mixing, mixlm, neardup, packing, phrases, quality, search, secrets, tokenfiles, tokens, toxicity, warc
from cohortia.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = " ".join(sql.split())
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_mix_sources")
def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


_WINDOWS = """
    g{k} AS (SELECT rid, i, hash(w[i:i + {k} - 1]) AS g FROM (SELECT rid, w, unnest(range(1, len(w) - {k} + 2)) AS i FROM d)),
    c{k} AS (SELECT rid, count(DISTINCT p) AS n FROM (
        SELECT rid, unnest(range(i, i + {k})) AS p FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g{k}) WHERE n > 1)
        GROUP BY rid)"""


@query("op2_suffix_repetition", f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
                      regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    {_WINDOWS.format(k=3)}, {_WINDOWS.format(k=10)},
    g101 AS (SELECT rid, i, hash(w[i:i + 100]) AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 99)) AS i FROM d)),
    long AS (SELECT DISTINCT rid FROM (SELECT rid, g FROM g101 GROUP BY rid, g HAVING count(*) > 1)),
    l AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
    dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
    m AS (SELECT d.rid, doc_id, len(w) AS n_words, coalesce(list_sum([length(x) FOR x IN w]), 0) AS word_chars,
                 length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
                 coalesce(c3.n, 0) AS n_repeat_words, coalesce(c10.n, 0) AS n_covered_words, long.rid IS NOT NULL AS too_long
          FROM d LEFT JOIN dup ON dup.rid = d.rid LEFT JOIN c3 ON c3.rid = d.rid LEFT JOIN c10 ON c10.rid = d.rid
          LEFT JOIN long ON long.rid = d.rid),
    v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
    SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
           n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
           NOT base_failed AND 100 * n_covered_words <= 30 * n_words AND NOT too_long AS kept FROM v""")
def suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op3_minhash_near_dedup", """
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, hash(w[i:i + 4]) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
          UNION ALL SELECT doc_id, hash(w) FROM d WHERE len(w) BETWEEN 1 AND 4),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
    e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
    ab AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
    r(doc_id, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, ab.b FROM r JOIN ab ON ab.a = r.seen)
    SELECT r.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(seen) AS component_id, r.doc_id = min(seen) AS kept
    FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id, n.n""")
def minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op4_context_mixing")
def context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixlm.score(table(spark, sf_dir, "documents"))


@query("op5_html_tree_scoring")
def html_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


@query("op6_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut_up = packing.pieces(table(spark, sf_dir, "documents"), tokens.vocabulary())
    return packing.pack(cut_up.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


@query("op7_arrow_token_files")
def arrow_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.read(tokenfiles.write(table(spark, sf_dir, "documents"), tokens.vocabulary()))


@query("op8_noisy_channel_toxicity")
def noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_exact_top_k", """
    WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
               AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
    FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""")
def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search.top_k(vectors, vectors.filter("vec_id % 50 = 0"))


@query("op10_structural_secrets")
def structural_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [F.size(F.array_compact(F.transform(kinds, lambda x: F.when(x == F.lit(kind), x)))).cast("long").alias(f"n_{kind}")
              for kind in secrets.BASE]
    return found.select("doc_id", *counts, F.sha2(secrets.joined(secrets.base_spans()), 256).alias("base_sha256"),
                        secrets.joined("spans").alias("spans"))


@query("op13_token_alignment")
def token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = tokens.vocabulary("byte_bpe_50k.json"), tokens.vocabulary("piece_bpe_32k.model")
    return align.link_strength(table(spark, sf_dir, "documents"), *paths)


@query("op11_warc_source", """
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
    d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
    f AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_bytes, payload_digest) END AS last FROM d)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN last <> page_id THEN last END AS refers_to FROM f""")
def warc_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.write(warc.page_records(table(spark, sf_dir, "pages")), scratch_path(spark, "warc"))
    columns = ["record_type", "record_id", "refers_to", "payload_digest", "payload_bytes", "payload_sha1"]
    found = warc.read(spark, folder, columns).filter(F.col("record_type").isin("response", "revisit"))
    return found.select(warc.page_of(F.col("record_id")).alias("page_id"), "payload_bytes", F.coalesce("payload_sha1", "payload_digest").alias("payload_digest"),
                        "record_type", warc.page_of(F.col("refers_to")).alias("refers_to"))


@query("op12_dynamic_phrases", """
    WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang,
                      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    p AS (SELECT lang, regexp_extract_all(x, '[^\\x20\\x09]+') AS w FROM (
        SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS x FROM d)),
    g AS (SELECT lang, 1 AS m, unnest(w) AS phrase FROM p
          UNION ALL SELECT lang, 2, w[i] || ' ' || w[i + 1] FROM (SELECT lang, w, unnest(range(1, len(w))) AS i FROM p)
          UNION ALL SELECT lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM (SELECT lang, w, unnest(range(1, len(w) - 1)) AS i FROM p)),
    f AS (SELECT lang, m, phrase, count(*) AS n FROM g GROUP BY ALL),
    tot AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
    c AS (SELECT lang, m, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND n >= 10),
    k AS (SELECT c.*, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:], ' ') AS rp
          FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c),
    s AS (SELECT k.*, x.n AS l, y.n AS r, (1000000::HUGEINT * a * a // (x.n::HUGEINT * y.n))::BIGINT AS score
          FROM k JOIN f x ON x.lang = k.lang AND x.phrase = k.lp AND x.m = k.k JOIN f y ON y.lang = k.lang AND y.phrase = k.rp AND y.m = k.m - k.k),
    best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    up AS (SELECT lang, q AS phrase, max(a) AS a FROM (
        SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS q, a FROM c WHERE m = 3) GROUP BY ALL),
    v AS (SELECT best.* FROM best LEFT JOIN up ON up.lang = best.lang AND up.phrase = best.phrase AND best.m = 2
          WHERE up.a IS NULL OR 100 * up.a < 50 * best.a),
    r AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM v)
    SELECT r.lang, rank, phrase, a, l, r, tot.n, score FROM r JOIN tot ON tot.lang = r.lang WHERE rank <= 2000""")
def dynamic_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))
