"""Queries over the corpus tables, each applying one operator, and SQL for their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glintframe.llm import chat, dedup, divergence, html_extract, mixing, ngram_join, packing, quality, sharding, token_files, toxicity, warc, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> tuple[str, str, str]:
    """Vocabulary, its ranks and its pattern, for packing.Ids."""
    import public_tokenizers as P

    return P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive_folder(spark)
    index = warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.read_records(index, folder, payloads=False).drop("payload", "url")


def op2_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", marked), (-7, 1, "assistant", marked)], "conv_id long, turn long, role string, text string")
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(own)
    return chat.read_back(chat.examples(told)).drop("examples")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_groups(table(spark, sf_dir, "documents"))


def op4_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.byte_shards(table(spark, sf_dir, "documents"), 16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(table(spark, sf_dir, "documents"), width=3, num=90, den=100)


def op6_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op7_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op8_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    """From the labels whose crc32(doc_id as text) mod 3 isn't 1."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    return toxicity.fit(docs, labels)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.scored(docs, toxicity_model(spark, docs, sf_dir))
    return out.select(
        F.col("id").alias("doc_id"), (F.crc32(F.col("id").cast("string")) % 3 == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer()).select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset"
    )


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.token_folder(spark)
    files = token_files.write_tokens(table(spark, sf_dir, "documents"), folder, tokenizer())
    return token_files.read_tokens(files, folder, ids=False)


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_warc, op2_prefix_targets, op3_exact_dedup, op4_byte_shards, op5_ngram_join, op6_divergence_rules, op7_text_density, op8_pivotal_mix, op9_toxicity, op10_best_fit_packing,
            op11_source_divergence, op12_whitening, op13_token_files,
        )
    }


SQL = {
    "op1_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        q AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
        FROM q""",
    "op2_prefix_targets": r"""
        WITH told AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        sized AS (
          SELECT *, length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) + length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')) + 15 AS n
          FROM told),
        placed AS (
          SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto,
                 row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1 AS is_last FROM sized)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(upto) FILTER (role = 'assistant' OR is_last)::BIGINT AS formatted_chars
        FROM placed GROUP BY conv_id""",
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op4_byte_shards": r"""
        WITH tab AS (
          SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
        d AS (
          SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size,
                 xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT),
                                 lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS text_crc32
          FROM documents, tab),
        p AS (
          SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS at_byte, sum(size) OVER () AS total,
                 row_number() OVER (ORDER BY doc_id, text_crc32, size) AS place FROM d),
        s AS (SELECT *, (at_byte * 16) // total AS shard FROM p)
        SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard::INT AS shard,
               row_number() OVER (PARTITION BY shard ORDER BY place) - 1 AS slot, NULL::INT AS grown_shard
        FROM s""",
    "op5_ngram_join": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        g AS (
          SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS gram
          FROM w, LATERAL (SELECT unnest(range(1, greatest(len(w) - 1, 2))) AS i) WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
        link AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
        edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
        reach(a, b) AS (SELECT a, b FROM edge UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a)
        SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
        FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) ON a = d.doc_id""",
    "op6_divergence_rules": r"""
        WITH d AS (SELECT doc_id, coalesce('=' || lang, '') AS lang, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM d),
        win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM w, LATERAL (SELECT unnest(range(1, len(w) - 6)) AS i) WHERE len(w) >= 8),
        rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
        cov AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM rep, range(8) r(k) GROUP BY doc_id),
        c1 AS (SELECT *, regexp_replace(t, '[a-z]+', '', 'g') AS r1 FROM w),
        c2 AS (SELECT *, regexp_replace(r1, '[\x20\x09-\x0D]+', '', 'g') AS r2 FROM c1),
        c3 AS (SELECT *, regexp_replace(r2, '[A-Z]+', '', 'g') AS r3 FROM c2),
        c4 AS (SELECT *, regexp_replace(r3, '[\p{L}\p{M}]+', '', 'g') AS r4 FROM c3),
        c5 AS (SELECT *, regexp_replace(r4, '\p{N}+', '', 'g') AS r5 FROM c4),
        c6 AS (SELECT *, regexp_replace(r5, '[.,;:!?''"()\-]+', '', 'g') AS r6 FROM c5),
        base AS (
          SELECT doc_id, lang, w, len(w) AS n_words, list_sum(list_transform(w, lambda x: length(x)))::BIGINT AS word_chars,
                 length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, length(t) AS chars,
                 [length(t) - length(r1), length(r1) - length(r2), length(r2) - length(r3), length(r3) - length(r4), length(r4) - length(r5), length(r5) - length(r6), length(r6)] AS kinds
          FROM c6),
        cls AS (SELECT lang, k, sum(kinds[k])::DOUBLE AS n FROM base, range(1, 8) r(k) GROUP BY ALL),
        cref AS (SELECT lang, k, n / greatest(sum(n) OVER (PARTITION BY lang), 1) AS q FROM cls),
        tot AS (SELECT lang, sum(n_words) AS n FROM base GROUP BY lang),
        cnt AS (SELECT lang, x, count(*) AS n FROM (SELECT lang, unnest(w) AS x FROM base) GROUP BY ALL),
        com AS (SELECT lang, x, cnt.n AS n FROM cnt JOIN tot USING (lang) WHERE cnt.n >= 0.005 * tot.n QUALIFY row_number() OVER (PARTITION BY lang ORDER BY cnt.n DESC, x) <= 12),
        wref AS (SELECT lang, x, com.n / greatest(tot.n, 1)::DOUBLE AS q FROM com JOIN tot USING (lang)
                 UNION ALL SELECT lang, NULL, (tot.n - coalesce((SELECT sum(n) FROM com WHERE com.lang = tot.lang), 0)) / greatest(tot.n, 1)::DOUBLE FROM tot),
        hit AS (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, lang, unnest(w) AS x FROM base) JOIN com USING (lang, x) GROUP BY ALL),
        own AS (SELECT b.doc_id, b.n_words, r.q, CASE WHEN r.x IS NULL THEN b.n_words - coalesce((SELECT sum(n) FROM hit h WHERE h.doc_id = b.doc_id), 0) ELSE coalesce(h.n, 0) END / greatest(b.n_words, 1)::DOUBLE AS p
                FROM base b JOIN wref r USING (lang) LEFT JOIN hit h ON h.doc_id = b.doc_id AND h.x = r.x),
        term(doc_id, kind, p, q) AS (
          SELECT doc_id, 'w', p, q FROM own WHERE n_words >= 40
          UNION ALL SELECT doc_id, 'c', kinds[k] / greatest(chars, 1)::DOUBLE, q FROM base JOIN cref USING (lang) WHERE chars >= 200),
        js AS (
          SELECT doc_id, kind, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0)) AS dist
          FROM term GROUP BY ALL),
        far AS (SELECT DISTINCT doc_id FROM js WHERE dist > CASE WHEN kind = 'c' THEN 0.3 ELSE 0.45 END),
        done AS (
          SELECT base.*, coalesce(n_repeat_words, 0) AS n_repeat_words, n_words < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * n_words AS base_failed
          FROM base LEFT JOIN cov USING (doc_id))
        SELECT doc_id, n_words::BIGINT AS n_words, coalesce(word_chars, 0) AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
               base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM far) AS kept
        FROM done""",
    "op11_source_divergence": r"""
        WITH d AS (
          SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        occ AS (SELECT lang, source, r, term, count(*) AS n FROM (SELECT lang, source, r, unnest(w) AS term FROM d) GROUP BY ALL),
        kept AS (SELECT lang, term, sum(n) AS n FROM occ GROUP BY lang, term HAVING count(*) >= 3),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT lang, source, term, sum(n) AS n FROM occ GROUP BY ALL),
        cnt AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        p AS (SELECT *, (1 + (1000000000 * (n + 1)) // (sum(n) OVER w + count(*) OVER w))::BIGINT AS p FROM cnt WINDOW w AS (PARTITION BY lang, source)),
        q AS (SELECT *, (1 + (1000000000 * (n + 1)) // (sum(n) OVER w + count(*) OVER w))::BIGINT AS p FROM kept WINDOW w AS (PARTITION BY lang)),
        apart AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        part AS (
          SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
          UNION ALL SELECT p.lang, p.source, 'term', p.term, ((p.p - q.p) * (p.p - q.p)) // q.p FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.p)
        SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
        FROM part QUALIFY part = 'pair' OR rank <= 200""",
}
