"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Key of the pseudonyms on the synthetic tables. It is public: real data take a secret one, in the setting below.
DEMONSTRATION_KEY = "public-demo-key"


def pii_key(spark: SparkSession) -> str:
    return spark.conf.get("spark.murmuration.pii.key", DEMONSTRATION_KEY)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_bpe import encode_texts

    return encode_texts(_table(spark, sf_dir, "documents"), tokenizer_path(), ids=False, decoded=False)


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_duplicate_embeddings

    return near_duplicate_embeddings(_table(spark, sf_dir, "embeddings"), 0.93)


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk_search import top_k_inner_product

    return top_k_inner_product(_table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256.0)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import near_duplicate_documents

    return near_duplicate_documents(_table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract_text

    return extract_text(_table(spark, sf_dir, "pages"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    mixed = mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import chat_digest, format_turns, turns_from_rows

    said = "</s>[INST] ok [/INST]"
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).selectExpr("-7L AS conv_id", "id AS turn", "IF(id = 0, 'user', 'assistant') AS role", f"'{said}' AS text")
    return chat_digest(format_turns(turns_from_rows(rows.union(more))))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import fresh_path
    from .warc import read_warc, write_warc

    path = fresh_path(spark, "warc")
    write_warc(_table(spark, sf_dir, "pages"), path)
    records = read_warc(spark, path, payload="digest").where("rec_type IN ('response', 'revisit')")
    return records.select("page_id", "payload_bytes", "payload_digest", records.rec_type.alias("record_type"), "refers_to")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pseudonymize

    return pseudonymize(_table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import fit, predict

    documents = _table(spark, sf_dir, "documents")
    return predict(documents, fit(documents))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import conversation_trie

    return conversation_trie(_table(spark, sf_dir, "conversations"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resample import resample

    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .byte_bpe import encode_byte_bpe

    return encode_byte_bpe(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), ids=False, decoded=False)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_sentencepiece, op2_embedding_near_dedup, op3_exact_top_k, op4_ngram_jaccard_join, op5_html_extraction, op6_source_mixing, op7_chat_formatting, op8_warc, op9_pii, op10_language_id, op11_conversation_trie, op12_importance_resampling, op13_byte_bpe, pipeline)}

#: CRC-32 of UTF-8 strings for DuckDB, which has none: its table, and the fold over the bytes of x.
_CRC_TABLE = """crc AS (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS tab FROM range(0, 256) r(n))"""


def _crc(x: str) -> str:
    digit = lambda i: f"(instr('0123456789ABCDEF', substr(hex({x}), {i}, 1)) - 1)"
    byte = f"(16 * {digit('2 * j + 1')} + {digit('2 * j + 2')})::BIGINT"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, strlen({x})), lambda j: {byte})), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


ORACLE: dict[str, str] = {
    "op11_conversation_trie": f"""
        WITH {_CRC_TABLE},
        t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        o AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, left(sha256(strlen(role) || ':' || role || text), 32)) AS own FROM t GROUP BY conv_id),
        h AS (SELECT conv_id, own, {_crc('conv_id::VARCHAR')} % 9 AS h FROM o, crc),
        r AS (SELECT c.conv_id, list_concat(coalesce(b.own[1:c.h], []), c.own[c.h + 1:]) AS seq FROM h c LEFT JOIN o b ON b.conv_id = c.conv_id - c.conv_id % 5),
        m AS (SELECT conv_id, d AS depth, sha256(to_json(seq[1:d])::VARCHAR) AS k, CASE WHEN d > 0 THEN sha256(to_json(seq[1:d - 1])::VARCHAR) END AS parent,
          CASE WHEN d > 0 THEN strlen(seq[d].text) ELSE 0 END AS size, d = len(seq) AS ends FROM (SELECT *, unnest(range(0, len(seq) + 1)) AS d FROM r)),
        n AS (SELECT k, parent, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS own, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends) AS said FROM m GROUP BY k, parent, depth),
        c AS (SELECT parent AS k, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
        l AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (k)),
        s AS (SELECT m.k, sum(CASE WHEN l.n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum(l.own)::BIGINT AS saved FROM l JOIN m ON m.conv_id = l.conv_id AND m.depth <= l.depth GROUP BY m.k)
        SELECT l.conv_id, l.depth, p.conv_id AS parent_conv_id, l.n_convs, l.n_children, s.n_leaves, s.saved AS saved_tokens, sha256(coalesce(l.said, '')) AS ends_sha256
        FROM l JOIN s USING (k) LEFT JOIN n p ON p.k = l.parent""",
    "op12_importance_resampling": rf"""
        WITH {_CRC_TABLE},
        a AS (SELECT 'd' AS side, doc_id, row_number() OVER () AS i, text FROM documents UNION ALL SELECT 'b', NULL, row_number() OVER (), text FROM benchmark),
        w AS (SELECT side, doc_id, i, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words FROM a),
        f AS (SELECT side, i, unnest(words) AS word FROM w),
        k AS (SELECT word, {_crc('word')} % 10000 AS bucket FROM (SELECT DISTINCT word FROM f), crc),
        n AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM f JOIN k USING (word) GROUP BY bucket),
        g AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM n) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM n) + 10000)::DOUBLE))) AS gain FROM n),
        q AS (SELECT i, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight FROM f JOIN k USING (word) JOIN g USING (bucket) WHERE side = 'd' GROUP BY i),
        r AS (SELECT doc_id, len(words) AS words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
          list_reduce(list_transform(range(1, 9), lambda j: (instr('0123456789abcdef', substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), j, 1)) - 1)::BIGINT), lambda x, y: 16 * x + y) AS h FROM w LEFT JOIN q USING (i) WHERE side = 'd'),
        z AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM r),
        o AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS place FROM z)
        SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND place <= (SELECT count(*) * 10 // 100 FROM z WHERE words >= 20) THEN place END AS rank FROM o""",
    "op8_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest,
          CASE WHEN strlen(h) >= 100 THEN min(page_id) OVER (PARTITION BY h) ELSE page_id END AS f FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN f = page_id THEN 'response' ELSE 'revisit' END AS record_type,
          CASE WHEN f <> page_id THEN f END AS refers_to FROM d""",
    "op7_chat_formatting": r"""
        WITH c AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -7, i, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)),
        e AS (SELECT *,
          len(regexp_extract_all(text, '(<s>|</s>|\[/?INST\]|<</?SYS>>)')) + len(regexp_extract_all(text, '<\|')) + len(regexp_extract_all(text, '\|>'))
            + len(text) - len(replace(text, chr(92), '')) AS more FROM c)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
          coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
          sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
          sum(len(text) + more + len(role) + 27)::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op4_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (
          SELECT doc_id, CASE WHEN len(w) = 0 OR w IS NULL THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s FROM w),
        t AS (SELECT doc_id, unnest(s) AS t, len(s) AS n FROM s),
        i AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS i FROM t a JOIN t b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM i WHERE 100 * i >= 85 * (na + nb - i)),
        reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
        SELECT s.doc_id, len(s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(c.c, s.doc_id)) AS component_id
        FROM s LEFT JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) c ON c.a = s.doc_id""",
    "op2_embedding_near_dedup": """
        WITH RECURSIVE ok AS (
          SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
          WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (
          SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
          WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
        reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
        SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(c.c, e.vec_id)) AS component_id,
          e.vec_id <= coalesce(c.c, e.vec_id) AS kept
        FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = e.vec_id
        LEFT JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) c ON c.a = e.vec_id""",
    "op3_exact_top_k": """
        WITH ok AS (
          SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
          WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
          FROM ok q JOIN ok c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5""",
}
