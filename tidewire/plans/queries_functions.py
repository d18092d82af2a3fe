"""Registered queries for the scalar functions, over all events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import grouping, text, times
from tidewire.functions.jsonpath import JsonBody, parse_path
from tidewire.functions.keyvalue import KeyValue, numeric_fields, text_fields
from tidewire.plans import inputs
from tidewire.plans.catalog import MESSAGES, query, with_
from tidewire.plans.inputs import messages


@query(
    "regex_transform",
    with_(MESSAGES, select=r"""
SELECT message_id,
       CASE WHEN regexp_full_match(address, 'data\.users\.(\d+)\.(click|view)')
            THEN regexp_replace(address, '^data\.users\.(\d+)\.(click|view)$', '\2:\1-$') ELSE address END AS text,
       CASE WHEN regexp_full_match(address, 'data\.users\.\d\d+\.[a-z]{5,}')
            THEN regexp_replace(address, '^data\.users\.(\d)(\d)(\d*)\.([a-z])([a-z])([a-z])([a-z])([a-z])([a-z]*)$', '\9/\20\1') || '$'
            ELSE address END AS many
FROM messages"""),
)
def _regex_transform(spark, sf_dir):
    made = text.regex_transform(F.col("address"), r"data\.users\.(\d+)\.(click|view)", "$2:$1-$")
    # notations that only Java has, and more groups than references can name
    pattern = r"\Qdata.users.\E(\d)(\d)(\d*)\.(\p{Lower})([a-z&&[^A-Z]])(\p{Alpha})([a-z])([a-z])([a-z]*)()()()"
    many = text.regex_transform(F.col("address"), pattern, "$9/$20$1$")
    return messages(spark, sf_dir).select("message_id", made.alias("text"), many.alias("many"))


@query(
    "bucket_template",
    with_(MESSAGES, select="""
SELECT message_id, 'b-' || event_type || '-' || k || '-' || user_id AS bucket FROM messages"""),
)
def _bucket_template(spark, sf_dir):
    template = text.Template.parse(r"b-{BODY|$.type}-{BODY|$.props.k}-{ADDRESS|data\.users\.(\d+)\..*|$1}")
    body = JsonBody()
    for path in template.paths():
        body.need(path)
    made = template.column(F.col("address"), body).alias("bucket")
    return body.attach(messages(spark, sf_dir)).select("message_id", made)


@query(
    "json_path",
    with_(MESSAGES, select="""
SELECT message_id, CAST(k AS VARCHAR) AS k, CAST(cents AS VARCHAR) AS cents, event_type AS type,
       CAST(NULL AS VARCHAR) AS nothing
FROM messages"""),
)
def _json_path(spark, sf_dir):
    paths = {"k": "props.k", "cents": "$['cents']", "type": "$.type", "nothing": "$.props.k.deeper"}
    body = JsonBody()
    parsed = {name: body.need(parse_path(path)) for name, path in paths.items()}
    return body.attach(messages(spark, sf_dir)).select(
        "message_id", *[body.value(path).alias(name) for name, path in parsed.items()]
    )


def _entries(df: DataFrame, maps: dict[str, Column]) -> DataFrame:
    """Maps as rows ``message_id, kind, key, value``."""

    def rows(kind: str, m: Column) -> Column:
        entry = lambda e: F.struct(F.lit(kind).alias("kind"), e["key"], e["value"])
        return F.transform(F.map_entries(m), entry)

    pairs = [rows(kind, m) for kind, m in maps.items()]
    # the outer form, as a plain explode would put a second copy of all maps into a filter on the input
    listed = df.select("message_id", F.concat(*pairs).alias("all"))
    rows = listed.select("message_id", F.explode_outer("all").alias("e")).filter("e IS NOT NULL")
    return rows.select("message_id", "e.*")


@query(
    "field_typing",
    with_(MESSAGES, select="""
SELECT message_id, 'num' AS kind, 'cents' AS key, CAST(CAST(cents AS DOUBLE) AS BIGINT) AS number, NULL AS text FROM messages
UNION ALL
SELECT message_id, 'str', 'type', NULL, event_type FROM messages"""),
)
def _field_typing(spark, sf_dir):
    body = JsonBody()
    for path in ("$.cents", "$.type"):
        body.need(parse_path(path))
    fields = F.create_map(
        F.lit("cents"), body.value(parse_path("$.cents")), F.lit("type"), body.value(parse_path("$.type"))
    )
    df = body.attach(messages(spark, sf_dir)).withColumn("fields", fields)
    numbers = df.select("message_id", F.explode(numeric_fields(F.col("fields"))).alias("key", "number"))
    texts = df.select("message_id", F.explode(text_fields(F.col("fields"))).alias("key", "text"))
    return numbers.select(
        "message_id", F.lit("num").alias("kind"), "key", F.col("number").cast("bigint").alias("number"),
        F.lit(None).cast("string").alias("text"),
    ).unionByName(
        texts.select(
            "message_id", F.lit("str").alias("kind"), "key", F.lit(None).cast("bigint").alias("number"), "text"
        )
    )


def _time_query(expression: str):
    def run(spark, sf_dir):
        rule = times.TimeRule.parse(expression)
        body = JsonBody()
        body.need(rule.path)
        quote = F.when(F.col("message_id") % 2 == 0, '"').otherwise("")
        stamped = F.concat(
            F.lit('{"date":'), quote, F.unix_millis("ts"),
            # nanoseconds, which are no time in milliseconds
            F.when(F.col("message_id") % 10 == 3, "000000").otherwise(""), quote,
            F.lit(',"text":"'),
            F.when(F.col("message_id") % 7 != 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss 'UTC'")).otherwise("soon"),
            F.lit('"}'),
        )
        df = body.attach(messages(spark, sf_dir).withColumn("body", stamped))
        return df.select("message_id", times.millis(rule.column(body)).alias("time_ms"))

    return run


query(
    "time_epoch",
    with_(MESSAGES, select=" SELECT message_id, CASE WHEN message_id % 10 <> 3 THEN ms END AS time_ms FROM messages"),
)(
    _time_query("BODY|$.date|TIMESTAMP")
)
query(
    "time_pattern",
    with_(MESSAGES, select="""
SELECT message_id, CASE WHEN message_id % 7 <> 0 THEN us // 1000000 * 1000 END AS time_ms FROM messages"""),
)(_time_query("BODY|$.text|yyyy-MM-dd HH:mm:ss z"))


@query(
    "group_key_json",
    with_(MESSAGES, select="""
SELECT message_id, CASE WHEN message_id % 9 <> 0 THEN CAST(k AS VARCHAR) END AS group_key,
       CASE WHEN message_id % 9 <> 0 THEN '{k=' || k || '}' END AS object_key
FROM messages"""),
)
def _group_key_json(spark, sf_dir):
    broken = F.when(F.col("message_id") % 9 == 0, F.lit('{"ad2"}')).otherwise(F.col("body"))
    return messages(spark, sf_dir).withColumn("body", broken).select(
        "message_id",
        grouping.group_key_json(F.col("body"), "props.k").alias("group_key"),
        grouping.group_key_json(F.col("body"), "$.props").alias("object_key"),
    )


@query(
    "group_key_xml",
    with_(MESSAGES, select=r"""
, xml AS (SELECT message_id, CASE WHEN message_id % 9 = 0 THEN '<root><k>' ELSE
    '<root><id>' || event_id || '</id><place><k>' || k || '</k></place></root>' END AS body FROM messages)
SELECT message_id, CASE WHEN message_id % 9 <> 0 THEN regexp_extract(body, '<k>(\d+)</k>', 1) END AS group_key,
       CASE WHEN message_id % 9 <> 0 THEN '' END AS absent
FROM xml"""),
)
def _group_key_xml(spark, sf_dir):
    whole = F.concat(
        F.lit("<root><id>"), F.col("message_id"), F.lit("</id><place><k>"),
        F.get_json_object("body", "$.props.k"), F.lit("</k></place></root>"),
    )
    xml = F.when(F.col("message_id") % 9 == 0, F.lit("<root><k>")).otherwise(whole)
    key, absent = grouping.group_keys_xml(F.col("body"), ["/root/place/k", "/root/none"])
    sent = messages(spark, sf_dir).select("message_id", xml.alias("body"))
    return sent.select("message_id", key.alias("group_key"), absent.alias("absent"))


@query(
    "group_key_property",
    with_(MESSAGES, select="""
SELECT message_id, application AS group_key, CAST(NULL AS VARCHAR) AS absent FROM messages"""),
)
def _group_key_property(spark, sf_dir):
    return messages(spark, sf_dir).select(
        "message_id",
        grouping.group_key_property(F.col("properties"), "application").alias("group_key"),
        grouping.group_key_property(F.col("properties"), "none").alias("absent"),
    )


def _array_bodies(spark, sf_dir) -> DataFrame:
    """Messages with lists in the body: two tags, one to three names, a list of small objects."""
    k = F.get_json_object("body", "$.props.k").cast("bigint")
    names = F.when(k % 3 == 0, F.lit('["n0"]')).when(k % 3 == 1, F.lit('["n0","n1"]')).otherwise(
        F.lit('["n0","n1","n2"]')
    )
    body = F.concat(
        F.lit('{"user":{"name":"u'), F.col("message_id") % 5, F.lit('"},"tags":[{"k":"a","v":"'), k,
        F.lit('"},{"k":"b","v":"'), F.col("message_id") % 7, F.lit('"}],"names":'), names,
        F.lit(',"more":[{"x":"'), k, F.lit('"},7,{"y":"z"}],"empty":[]}'),
    )
    return messages(spark, sf_dir).withColumn("body", body)


def _kv_rows(spark, sf_dir, expressions: dict[str, str]) -> DataFrame:
    body = JsonBody()
    parsed = {kind: KeyValue.parse(e) for kind, e in expressions.items()}
    for kv in parsed.values():
        kv.register(body)
    made = {f"__{kind}": kv.column(body) for kind, kv in parsed.items()}
    df = body.attach(_array_bodies(spark, sf_dir)).select("message_id", *[m.alias(n) for n, m in made.items()])
    return _entries(df, {kind: F.col(f"__{kind}") for kind in parsed})


@query(
    "kv_extract",
    with_(MESSAGES, select="""
, names AS (SELECT message_id, k, unnest(CASE k % 3 WHEN 0 THEN ['n0'] WHEN 1 THEN ['n0', 'n1'] ELSE ['n0', 'n1', 'n2'] END) AS name
            FROM messages)
SELECT message_id, 'last' AS kind, 'tag' AS key, CAST(message_id % 7 AS VARCHAR) AS value FROM messages
UNION ALL SELECT message_id, 'literal', 'fixed', 'yes' FROM messages
UNION ALL SELECT message_id, 'each', name, 'true' FROM names
UNION ALL SELECT message_id, 'repeat', name, 'u' || (message_id % 5) FROM names
UNION ALL SELECT message_id, 'zip', 'a', CAST(k AS VARCHAR) FROM messages
UNION ALL SELECT message_id, 'zip', 'b', CAST(message_id % 7 AS VARCHAR) FROM messages
UNION ALL SELECT message_id, 'fill', 'a', 'n0' FROM messages
UNION ALL SELECT message_id, 'fill', 'b', CASE k % 3 WHEN 0 THEN 'n0' ELSE 'n1' END FROM messages
UNION ALL SELECT message_id, 'fill', '$.tags[*].k', 'n2' FROM messages WHERE k % 3 = 2
UNION ALL SELECT message_id, 'context', 'name', 'u' || (message_id % 5) FROM messages"""),
)
def _kv_extract(spark, sf_dir):
    return _kv_rows(
        spark,
        sf_dir,
        {
            "last": "BODY|$|tag|$.tags[*].v",
            "literal": "BODY|$|fixed|yes",
            "each": "BODY|$|$.names[*]|true",
            "repeat": "BODY|$|$.names[*]|$.user.name",
            "zip": "BODY|$|$.tags[*].k|$.tags[*].v",
            "fill": "BODY|$|$.tags[*].k|$.names[*]",
            "none": "BODY|$|nothing|$.empty[*]",
            "context": "BODY|$.user|name|$.name",
        },
    )


@query(
    "kv_lite",
    with_(MESSAGES, select="""
SELECT message_id, 'objects' AS kind, 'x' AS key, CAST(k AS VARCHAR) AS value FROM messages
UNION ALL SELECT message_id, 'objects', 'y', 'z' FROM messages
UNION ALL SELECT message_id, 'one', 'name', 'u' || (message_id % 5) FROM messages"""),
)
def _kv_lite(spark, sf_dir):
    return _kv_rows(
        spark, sf_dir, {"objects": "BODY|$|$.more[*]", "one": "BODY|$|$.user", "failed": "BODY|$|$.nothing"}
    )


@query(
    "kv_address",
    with_(MESSAGES, select="""
SELECT message_id, event_type AS key, CAST(user_id AS VARCHAR) AS value
FROM messages WHERE event_type IN ('click', 'view')"""),
)
def _kv_address(spark, sf_dir):
    kv = KeyValue.parse(r"ADDRESS|data\.users\.(\d+)\.(click|view)|$2:$1:")
    df = messages(spark, sf_dir).withColumn("__text", kv.address_text(F.col("address")))
    return df.select("message_id", F.explode(kv.column(JsonBody(), F.col("__text"))).alias("key", "value"))


@query(
    "normalize_topic",
    with_(MESSAGES, select="""
SELECT message_id, address AS topic, replace(address, '.', '/') AS slashes, address AS dots FROM messages"""),
)
def _normalize_topic(spark, sf_dir):
    scheme = F.when(F.col("message_id") % 2 == 0, "topic://").otherwise("")
    df = messages(spark, sf_dir).withColumn("address", F.concat(scheme, F.col("address")))
    topic = text.normalize_topic(F.col("address"))
    return df.select(
        "message_id",
        topic.alias("topic"),
        text.to_slashes(topic).alias("slashes"),
        text.to_dots(text.to_slashes(topic)).alias("dots"),
    )


@query(
    "body_decode",
    with_(MESSAGES, select=" SELECT message_id, body FROM messages"),
)
def _body_decode(spark, sf_dir):
    """Half of the messages come as bytes only."""
    from tidewire.sources.messages import with_text_body

    as_bytes = F.col("message_id") % 2 == 0
    df = messages(spark, sf_dir).withColumns(
        {
            "body_bytes": F.when(as_bytes, F.encode("body", "UTF-8")),
            "body": F.when(~as_bytes, F.col("body")),
        }
    )
    return with_text_body(df).select("message_id", "body")
