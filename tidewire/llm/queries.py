"""The registered queries of this subpackage and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(run=None, *, sql: str | None = None):
    if run is None:
        return lambda run: _query(run, sql=sql)
    QUERIES[run.__name__] = run
    if sql is not None:
        ORACLES[run.__name__] = sql
    return run


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidewire.llm.bpe import encode_decode

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    outputs = ("n_tokens", "ids_sha256", "decoded_sha256")
    return encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"), outputs).drop("text")


@_query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.decontamination import contamination

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@_query
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.jaccard import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"))


@_query(
    sql="""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
k AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest,
             CASE WHEN strlen(h) >= 1000 THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS kept FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN kept = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN kept <> page_id THEN kept END AS refers_to
FROM k"""
)
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.warc import archive_round_trip

    found = archive_round_trip(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.frames import crc32_of_id
    from tidewire.llm.language import fit_languages, identify

    docs = _table(spark, sf_dir, "documents")
    held_out = crc32_of_id() % 5 == 0
    models = fit_languages(docs.filter(~held_out))
    found = identify(docs.select("doc_id", "text", held_out.alias("held_out")), models)
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


@_query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.frames import crc32_of_id
    from tidewire.llm.toxicity import fit_toxicity, score_toxicity

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").filter(crc32_of_id() % 3 != 1)
    model = fit_toxicity(docs, labels.select("doc_id", "toxic"))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", (crc32_of_id() % 3 == 1).alias("held_out"), "score", "predicted")


@_query
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.sharding import balanced_shards

    return balanced_shards(_table(spark, sf_dir, "documents"))


@_query(
    sql="""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place FROM conversations),
c AS (SELECT conv_id, count(*) AS n_turns, list({'r': role, 't': text} ORDER BY place) AS turns FROM t GROUP BY conv_id),
heads AS (SELECT DISTINCT turns[1:k] AS head
          FROM (SELECT turns, unnest(range(1, n_turns)) AS k FROM c)),
d AS (SELECT min(conv_id) AS conv_id, any_value(n_turns) AS n_turns, count(*) AS n_snapshots, turns FROM c GROUP BY turns),
kept AS (SELECT conv_id, n_turns, n_snapshots FROM d WHERE turns NOT IN (SELECT head FROM heads))
SELECT conv_id, (place - 1) // 1024 AS part, n_turns, n_snapshots,
       string_agg('<|im_start|>' || coalesce(role, 'user') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10),
                  '' ORDER BY place) AS rendered
FROM kept JOIN t USING (conv_id) GROUP BY ALL"""
)
def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.chat import format_chats

    return format_chats(_table(spark, sf_dir, "conversations"))


@_query
def op8_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.lattice import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"))


@_query
def op10_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidewire.llm.frames import crc32_of_id
    from tidewire.llm.lattice_lm import score_texts

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    marked = docs.withColumn("train", crc32_of_id() % 7 != 2)
    vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    found = score_texts(marked, vocabulary, class_column="lang")
    return found.select(
        "doc_id", (crc32_of_id() % 7 == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens",
        "base_score", "score", "lattice_score",
    )


@_query(
    sql="""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
a AS (
  SELECT c, list({'r': r, 'x': x} ORDER BY p) AS v,
         xor(4294967295, list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
           lambda crc, b: list_reduce(
             list_prepend(xor(crc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
             lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384::BIGINT) ELSE y // 2 END))) % 6 AS h
  FROM t GROUP BY c),
rebuilt AS (
  SELECT a.c, list_concat(coalesce(b.v, [])[1:a.h], a.v[a.h + 1:]) AS v
  FROM a LEFT JOIN a AS b ON b.c = a.c - a.c % 100),
heads AS (SELECT c, v, v[1:d] AS k, d FROM (SELECT c, v, unnest(range(0, len(v) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT k, d, min(c) AS conv_id, count(*) AS n,
         sha256(coalesce(string_agg(CASE WHEN len(v) = d THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends
  FROM heads GROUP BY k, d),
children AS (SELECT k[1:d - 1] AS k, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
facts AS (
  SELECT nodes.*, coalesce(children.n, 0) AS kids, CASE WHEN nodes.d = 0 THEN 0 ELSE (nodes.n - 1) * length(nodes.k[-1].x) END AS saved
  FROM nodes LEFT JOIN children ON children.d = nodes.d AND children.k = nodes.k),
below AS (
  SELECT k[1:j] AS k, j AS d, sum((kids = 0)::BIGINT)::BIGINT AS leaves, sum(saved)::BIGINT AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS j FROM facts) GROUP BY ALL)
SELECT f.conv_id, f.d AS depth, p.conv_id AS parent_conv_id, f.n AS n_convs, f.kids AS n_children, below.leaves AS n_leaves,
       below.saved AS saved_tokens, f.ends AS ends_sha256
FROM facts f JOIN below ON below.d = f.d AND below.k = f.k
     LEFT JOIN nodes p ON p.d = f.d - 1 AND p.k = f.k[1:f.d - 1]"""
)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.trie import prefix_trie, sequences, with_shared_openings

    return prefix_trie(with_shared_openings(sequences(_table(spark, sf_dir, "conversations"))))


@_query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.whitening import whiten

    return whiten(_table(spark, sf_dir, "embeddings"))


@_query(
    sql="""
WITH d AS (SELECT doc_id, coalesce(text, '') AS own FROM documents),
n AS (
  SELECT doc_id, own, length(own) // 3 AS moved,
         coalesce(lead(own) OVER (ORDER BY doc_id DESC), first_value(own) OVER (ORDER BY doc_id DESC)) AS next
  FROM d),
e AS (
  SELECT doc_id, own, substring(own, 1, length(own) - moved) || substring(next, 1, moved) AS edited, next FROM n),
texts AS (SELECT DISTINCT t FROM (SELECT unnest([own, edited, next]) AS t FROM e)),
clauses AS (
  SELECT t, list_transform(string_split(t, chr(10)), lambda p: list_transform(
           regexp_extract_all(p, '[^.,;:!?]*[.,;:!?]|[^.,;:!?]+'), lambda x: md5(x))) AS c
  FROM texts),
paragraphs AS (SELECT t, c, list_transform(c, lambda x: md5(array_to_string(x, ''))) AS p FROM clauses),
shown AS (
  SELECT t, list_distinct(list_transform(flatten(c), lambda x: x[:8])) AS leaves, p,
         list_transform(range(1, len(p) + 1), lambda i: '|' || p[i][:12] || '='
           || array_to_string(list_transform(c[i], lambda x: x[:8]), ',')) AS b
  FROM paragraphs),
sections AS (
  SELECT t, leaves,
         list_transform(string_split(rtrim(array_to_string(list_transform(p, lambda x: x
           || CASE WHEN x < '4' THEN '/' ELSE '' END), ''), '/'), '/'), lambda x: md5(x)) AS s,
         string_split(rtrim(array_to_string(list_transform(range(1, len(p) + 1), lambda i: b[i]
           || CASE WHEN p[i] < '4' THEN '/' ELSE '' END), ''), '/'), '/') AS b
  FROM shown),
trees AS (
  SELECT t, leaves, md5(array_to_string(s, '')) AS root,
         md5(array_to_string(s, '')) || array_to_string(
           list_transform(range(1, len(s) + 1), lambda i: '/' || s[i][:16] || b[i]), '') AS tree
  FROM sections),
pairs AS (
  SELECT e.doc_id, e.own, e.edited, x.tree AS fingerprint, y.tree AS edited_fingerprint,
         CASE WHEN x.root = y.root THEN 1.0e0 WHEN greatest(len(x.leaves), len(y.leaves)) = 0 THEN 0.0e0
              ELSE len(list_intersect(x.leaves, y.leaves)) / greatest(len(x.leaves), len(y.leaves))::DOUBLE END AS near_edited,
         CASE WHEN x.root = z.root THEN 1.0e0 WHEN greatest(len(x.leaves), len(z.leaves)) = 0 THEN 0.0e0
              ELSE len(list_intersect(x.leaves, z.leaves)) / greatest(len(x.leaves), len(z.leaves))::DOUBLE END AS near_next
  FROM e JOIN trees x ON x.t = e.own JOIN trees y ON y.t = e.edited JOIN trees z ON z.t = e.next)
SELECT doc_id, length(own)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, fingerprint, edited_fingerprint,
       near_edited, near_next
FROM pairs"""
)
def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.merkle import edited_fingerprints

    return edited_fingerprints(_table(spark, sf_dir, "documents"))
