"""The registered queries of this subpackage, with their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm.context_mixing import score_documents
from plumbline.llm.decontamination import contaminated
from plumbline.llm.fill_in_middle import fill_in_middle
from plumbline.llm.mixing import mix_sources
from plumbline.llm.near_duplicates import near_duplicates
from plumbline.llm.personal_data import find_personal_data
from plumbline.llm.prefix_trie import conversation_trie
from plumbline.llm.quality import classify_quality
from plumbline.llm.token_counts import token_counts
from plumbline.llm.token_files import encode_to_files
from plumbline.llm.top_k import exact_top_k
from plumbline.llm.toxicity import classify_toxicity
from plumbline.llm.warc import archive_and_read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
END_ID = 2


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_token_counts")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents"), tokenizer_path())


@query("op8_token_files")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return encode_to_files(table(spark, folder, "documents"), tokenizer_path(), END_ID)


@query("op9_source_mix")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(table(spark, folder, "documents"), (5, 2, 1), most_copies=3)


@query(
    "op10_exact_top_k",
    """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
        FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    scored AS (
        SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
        FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id
        WHERE q.vec_id % 100 = 0
    ),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS nth FROM scored
    )
    SELECT query_id, CAST(nth AS INTEGER) AS rank, vec_id, score FROM ranked WHERE nth <= 10
    """,
)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return exact_top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


@query(
    "op3_web_archive",
    """
    WITH p AS (
        SELECT page_id, coalesce(strlen(html), 0) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
        FROM pages
    ),
    m AS (
        SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS response
        FROM p
    )
    SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
           CASE WHEN response <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN response <> page_id THEN response END AS refers_to
    FROM m
    """,
)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return archive_and_read(table(spark, folder, "pages"))


@query("op5_toxicity")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return classify_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op4_quality")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return classify_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op6_near_duplicates")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


@query("op7_decontamination")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op2_personal_data")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return find_personal_data(table(spark, folder, "documents"))


@query(
    "op11_prefix_trie",
    r"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
               substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS code
        FROM conversations WHERE conv_id IS NOT NULL
    ),
    own AS (
        SELECT conv_id, code, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, code) AS k
        FROM turns
    ),
    -- CRC-32, bit by bit: the reversed polynomial 0xEDB88320.
    convs AS (
        SELECT conv_id, conv_id - conv_id % 20 AS head,
               xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                   lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                       lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) % 4 AS h
        FROM (SELECT DISTINCT conv_id FROM own)
    ),
    rebuilt AS (
        SELECT c.conv_id, o.code, o.words, o.k AS place FROM convs AS c JOIN own AS o ON o.conv_id = c.head AND o.k <= c.h
        UNION ALL
        SELECT c.conv_id, o.code, o.words, o.k + 1000000000 AS place FROM convs AS c JOIN own AS o ON o.conv_id = c.conv_id AND o.k > c.h
    ),
    prefixes AS (
        SELECT conv_id, words, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS depth,
               sha256(string_agg(code, '') OVER (PARTITION BY conv_id ORDER BY place)) AS node, count(*) OVER (PARTITION BY conv_id) AS length
        FROM rebuilt
        UNION ALL
        SELECT c.conv_id, 0, 0, '', count(r.code) FROM convs AS c LEFT JOIN rebuilt AS r USING (conv_id) GROUP BY c.conv_id
    ),
    up AS (
        SELECT p.*, q.node AS parent FROM prefixes AS p LEFT JOIN prefixes AS q ON q.conv_id = p.conv_id AND q.depth = p.depth - 1
    ),
    nodes AS (
        SELECT node, depth, min(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(words) AS own,
               sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE length = depth), '')) AS ends_sha256
        FROM up GROUP BY node, depth
    ),
    counted AS (
        SELECT n.*, (SELECT count(*) FROM nodes AS c WHERE c.parent = n.node AND c.depth = n.depth + 1) AS n_children FROM nodes AS n
    ),
    sums AS (
        SELECT p.node, p.depth, sum(c.own) AS saved_tokens, count(*) FILTER (WHERE c.n_children = 0) AS n_leaves
        FROM counted AS c JOIN prefixes AS p ON p.conv_id = c.conv_id AND p.depth <= c.depth
        GROUP BY p.node, p.depth
    )
    SELECT n.conv_id, n.depth, m.conv_id AS parent_conv_id, n.n_convs, n.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
           CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
    FROM counted AS n JOIN sums AS s ON s.node = n.node AND s.depth = n.depth
    LEFT JOIN nodes AS m ON m.node = n.parent AND m.depth = n.depth - 1
    """,
)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_trie(table(spark, folder, "conversations"))


@query("op12_language_model")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return score_documents(table(spark, folder, "documents"))


@query(
    "op13_fill_in_middle",
    r"""
    WITH t AS (
        SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
               regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
        FROM documents
    ),
    d AS (
        SELECT *, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS b,
               ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 50 OR text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') AS plain,
               ('0x' || substr(h, 25, 8))::BIGINT % 100 < 80 AS spm
        FROM t
    ),
    p AS (
        SELECT *, array_to_string(u[1:least(a, b)], '') AS prefix, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS middle,
               array_to_string(u[greatest(a, b) + 1:], '') AS suffix
        FROM d
    )
    SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
           CASE WHEN NOT plain THEN length(prefix) END AS prefix_chars, CASE WHEN NOT plain THEN length(middle) END AS middle_chars,
           sha256(CASE WHEN plain THEN text WHEN spm THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
                       ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
           sha256(text) AS restored_sha256
    FROM p
    """,
)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return fill_in_middle(table(spark, folder, "documents"))
