"""Vectors for the scalar functions."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidewire.functions import attributes, grouping, jsonpath, text, times
from tidewire.functions.filters import MessageFilter, filter_messages
from tidewire.functions.jsonpath import JsonBody, parse_path
from tidewire.functions.keyvalue import KeyValue, numeric_fields, text_fields

# Bodies, expressions and results of the conformance vectors.
P = '{"name":"pepito","surname":"lospalotes","addresses":["calle de la piruleta 33","rue de la fua"]}'
U = (
    '{"user":{"profile":{"firstName":"John","lastName":"Doe","age":30,"roles":["admin","reader"],'
    '"tags":[{"k":"a","v":"1"},{"k":"b","v":"2"}],"tags2":[{"a":"1"},{"b":"2"}],'
    '"addresses":[{"street":"123 Main St","city":"New York"},{"street":"456 Oak Ave","city":"Boston"}]}}}'
)


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


def with_body(spark, body_text, register, build, address="a"):
    body = JsonBody()
    register(body)
    df = spark.createDataFrame([(body_text, address)], "body string, address string")
    return body.attach(df).select(build(body)).first()[0]


@pytest.mark.parametrize(
    "pattern, template, given, expected",
    [
        ("(.*)", "$1", "a", "a"),
        ("(.*)", "$1$1", "a", "aa"),
        ("(.*)", "$1-$1", "a", "a-a"),
        (r"pepito\.(.*)\.palotes", "$1", "pepito.los.palotes", "los"),
        (r"(.*)\.(.*)\.(.*)", "$1.$3", "pepito.los.palotes", "pepito.palotes"),
        (r"(.*)\.(.*)\.(.*)", "$1.eldelos.$3", "pepito.los.palotes", "pepito.eldelos.palotes"),
        ("(.*)", "$1", "", ""),
        (r".*?(\d+).*", "$1", "abc123def", "123"),
        (r"(\w+)\s+(\w+)", "$1-$2", "hello world", "hello-world"),
        ("nonmatching", "replacement", "original", "original"),
        # a template without that group, and signs with a meaning in replacements
        ("(a)", "$2$1\\$", "a", "$2a\\$"),
        ("(a)", "$10", "a", "a0"),
        ("a", "b", "a\n", "a\n"),
    ],
)
def test_regex_transform(spark, pattern, template, given, expected):
    assert one(spark, text.regex_transform(F.col("t"), pattern, template), t=given) == expected


@pytest.mark.parametrize(
    "pattern, groups",
    [
        ("(a)" * 12, 12), (r"\(a\)(b)", 1), (r"\Q(a)(\E(b)", 1), ("[(](b)", 1), ("[[(]x](b)", 1), ("[](](b)", 1),
        ("[^](](b)", 1), ("(?:a)(?<n>b)(?<=c)(?<!d)(?=e)(?i)(f)", 2), (r"\p{Alpha}\h([\p{L}&&[^x]])", 1), ("", 0),
        (r"\Q(", 0),
    ],
)
def test_groups_of_java_patterns(pattern, groups):
    assert text.count_groups(pattern) == groups


def test_regex_transform_takes_any_number_of_groups(spark):
    made = text.regex_transform(F.col("t"), "(.)" * 11, "$1-$10-$9")
    assert one(spark, made, t="abcdefghijk") == "a-a0-i"
    assert one(spark, text.regex_transform(F.col("t"), r"(\p{Alpha})\Q.\E([a-z&&[^x]])", "$2$1"), t="Q.b") == "bQ"


@pytest.mark.parametrize("given", ["1700000000000000000", "-9223372036854775808", "99999999999999999999", "1e12", ""])
def test_epochs_out_of_range_are_null(spark, given):
    assert one(spark, times.millis(times.from_epoch(F.col("t"))), t=given) is None


@pytest.mark.parametrize("given", [0, -1, 9223372036854775, -9223372036854775])
def test_epochs_in_range(spark, given):
    assert one(spark, times.millis(times.from_epoch(F.col("t"))), t=str(given)) == given


def test_root_fields_that_differ_in_case(spark):
    body = JsonBody()
    paths = [body.need(parse_path(p)) for p in ("$.Type", "$.type", "$.TYPE.a", "$.other")]
    body.need_map(parse_path("$.Type"))
    df = spark.createDataFrame([('{"Type":{"x":"1"},"type":"low","TYPE":{"a":2},"other":3}',)], "body string")
    row = body.attach(df).select(*[body.value(p).alias(f"c{i}") for i, p in enumerate(paths)], body.text_map(paths[0]).alias("m"))
    assert tuple(row.first()) == ('{"x":"1"}', "low", "2", "3", {"x": "1"})


LAST = r"{ADDRESS|.+\.([^\.]*)$|$1}"


@pytest.mark.parametrize(
    "expression, address, body_text, expected",
    [
        (LAST, "super.fancy.address", None, "address"),
        ("{BODY|$.name}-{BODY|$.surname}", "", P, "pepito-lospalotes"),
        ("{BODY|$.addresses[0]}", "", P, "calle de la piruleta 33"),
        ("{BODY|$.addresses[3]}", "", P, None),
        ("{BODY|$.addresses[*]}", "", P, "calle de la piruleta 33"),
        ("{BODY|$.name[*]}", "", P, "{BODY|$.name[*]}"),
        ("{BODY|$.user.profile.firstName}", "", U, "John"),
        ("{BODY|$.user.profile.age}", "", U, "30"),
        ("{BODY|$.user.profile.addresses[0].street}", "", U, "123 Main St"),
        ("{BODY|$.user.profile.addresses[1].city}", "", U, "Boston"),
        ("{BODY|$.user.profile.firstName}-{BODY|$['user'].profile.lastName}-" + LAST, "super.fancy.address", U, "John-Doe-address"),
        ("{BODY|$.user.profile.nonexistent}", "", U, None),
        ("{BODY|$.user.profile.addresses[5]}", "", U, None),
        ("{BODY|$.name}", "", '\n\t {"name":"a"}\r\n', "a"),
        ("{BODY|$.tags[*].v}", "", '{"tags":\n[{"v":7}]}', "7"),
        ("{BODY|$.name}", "", None, None),
        ("{BODY|$.name}", "", "{}", None),
        ("{BODY|$.name}", "", '{"name":"a", broken', None),
        ("plain", "", None, "plain"),
    ],
)
def test_template(spark, expression, address, body_text, expected):
    template = text.Template.parse(expression)
    got = with_body(
        spark,
        body_text,
        lambda body: [body.need(p) for p in template.paths()],
        lambda body: template.column(F.col("address"), body),
        address,
    )
    assert got == expected


PROFILE = "$.user.profile"


@pytest.mark.parametrize(
    "expression, expected",
    [
        (f"BODY|$|{PROFILE}.firstName|{PROFILE}.lastName", {"John": "Doe"}),
        (f"BODY|$|{PROFILE}.roles[*]|true", {"admin": "true", "reader": "true"}),
        (f"BODY|$|{PROFILE}.roles[*]|{PROFILE}.firstName", {"admin": "John", "reader": "John"}),
        (f"BODY|$|{PROFILE}.tags[*].k|{PROFILE}.tags[*].v", {"a": "1", "b": "2"}),
        (f"BODY|$|{PROFILE}.tags2[*]", {"a": "1", "b": "2"}),
        (f"BODY|{PROFILE}|years|$.age", {"years": "30"}),
        ("BODY|$|fixed|yes", {"fixed": "yes"}),
        (f"BODY|$|k|{PROFILE}.none", None),
        (f"BODY|$|k|{PROFILE}.tags2[*].b", None),
        (f"BODY|$|k|{PROFILE}.roles[*].b", {}),
        (f"BODY|$|k|{PROFILE}.none[*]", None),
        (f"BODY|$|{PROFILE}.none", {}),
        (f"BODY|$|{PROFILE}.tags[?(@.v==2)].k|x", None),
        (r"ADDRESS|.*\.vehicles\.(.*)\.location$|vid:$1", {"vid": "LX23"}),
        (r"ADDRESS|.*\.ships\.(.*)|vid:$1", None),
    ],
)
def test_key_value(spark, expression, expected):
    if "?(" in expression:
        with pytest.raises(ValueError):
            KeyValue.parse(expression)
        return
    kv = KeyValue.parse(expression)
    address = "data.vehicles.LX23.location"
    got = with_body(
        spark, U, kv.register, lambda body: kv.column(body, kv.address_text(F.col("address")) if kv.kind == "address" else None), address
    )
    assert got == expected


def test_one_map_and_its_fields_share_a_parse(spark):
    lite, single = KeyValue.parse("BODY|$|$.a"), parse_path("$.a.x")
    body = JsonBody()
    lite.register(body)
    body.need(single)
    df = spark.createDataFrame([('{"a":{"x":1,"y":"q"}}',), ('{"a":{"x":null}}',), ('{"a":[1]}',)], "body string")
    rows = body.attach(df).select(lite.column(body), body.value(single)).collect()
    assert [tuple(r) for r in rows] == [({"x": "1", "y": "q"}, "1"), ({}, None), ({}, None)]


@pytest.mark.parametrize("path", ["$..a", "$.a[1:2]", "$.a.length()", "", "$.a[?(@.x=~/b/)]"])
def test_unsupported_paths_are_refused(path):
    with pytest.raises(ValueError):
        parse_path(path)


@pytest.mark.parametrize("expression", ["nothing", "BODY|$", "BODY|$|k", "HEADER|x|y"])
def test_invalid_key_value_is_refused(expression):
    with pytest.raises(ValueError):
        KeyValue.parse(expression)


@pytest.mark.parametrize(
    "expression, body_text, expected",
    [
        (".*|$|OR", U, True),
        (".*|$|AND", U, True),
        (".*|$.pepe|AND", U, False),
        (".*|$.pepe|OR", U, True),
        ("topic|$[?(@.age<50)]|OR", '{"age":30}', True),
        ("topic|$.[?(@.age<50)]|OR", '{"age":30}', True),
        ("topic|$.[?(@.age<50)]|OR", '{"age":50}', False),
        (".*|$|AND", None, False),
        (".*|$|OR", None, True),
        (".*|$|AND", "not json", False),
        (".*|$|AND", "[1]", True),
        (".*|$[0]|AND", "[1]", True),
        (".*|$.user.profile.name.first|AND", U, False),
        (".*|$.user.profile.roles.x|AND", U, False),
        ("is.a|$|AND", U, False),
    ],
)
def test_filter(spark, expression, body_text, expected):
    df = spark.createDataFrame([(body_text, "this.is.a.super.complex.topic")], "body string, address string")
    assert (filter_messages(df, expression).count() == 1) is expected


def test_malformed_filter_is_refused():
    with pytest.raises(ValueError):
        MessageFilter.parse("a|b|XOR")


def test_filter_sees_validity_beside_other_types(spark):
    """A value of another type than a path expects does not make the body invalid."""
    body = JsonBody()
    body.need(parse_path("$.a.b"))
    df = spark.createDataFrame([('{"a":"text"}',), ('{"a":"text"',)], "body string")
    assert [r[0] for r in body.attach(df).select(body.valid()).collect()] == [True, False]


def test_time(spark):
    moment = datetime.datetime(2024, 5, 6, 7, 8, 9)
    ms = 1714979289000
    for expression, body_text in [
        ("BODY|$.date|yyyy-MM-dd HH:mm:ss z", '{"date":"2024-05-06 07:08:09 UTC"}'),
        ("BODY|$.date|TIMESTAMP", f'{{"date":"{ms}"}}'),
        ("BODY|$.date|TIMESTAMP", f'{{"date":{ms}}}'),
    ]:
        rule = times.TimeRule.parse(expression)
        got = with_body(spark, body_text, lambda b: b.need(rule.path), lambda b: times.millis(rule.column(b)))
        assert got == ms, (expression, moment)
    rule = times.TimeRule.parse("BODY|$.date|TIMESTAMP")
    for bad in ('{"date":"12.5"}', "{}", None):
        assert with_body(spark, bad, lambda b: b.need(rule.path), lambda b: rule.column(b)) is None


@pytest.mark.parametrize("value", [-7, -6, -1, 0, 1, 5, 6, 7, 2**61])
def test_whole_division(spark, value):
    got = spark.range(1).select(
        times.floor_div(F.lit(value).cast("bigint"), 6), times.ceil_div(F.lit(value).cast("bigint"), 6)
    ).first()
    assert tuple(got) == (value // 6, -(-value // 6))


FIRST = '{"address":{"city":"Lleida","street":"C\\\\Cavallers"},"name":"Jon doe","age":"22"}'
XML = "<root><address><city>Lleida</city><street>C\\Cavallers</street></address><age>22</age></root>"


def test_group_keys(spark):
    def key(source, expression, body_text):
        df = spark.createDataFrame([(body_text, {"p": "v"})], "body string, properties map<string,string>")
        return df.select(grouping.group_key(source, expression)).first()[0]

    assert key("BODY_JSON", "address.city", FIRST) == "Lleida"
    assert key("BODY_JSON", "address.city", '{"ad2"}') is None
    assert key("BODY_JSON", "address", FIRST) == "{city=Lleida, street=C\\Cavallers}"
    assert key("BODY_XML", "/root/address/city", XML) == "Lleida"
    whole = key("BODY_XML", "/root/address", XML)
    assert "Lleida" in whole and "Cavallers" in whole
    assert key("BODY_XML", "/root/none", XML) == ""
    for broken in ("<root><a>", "no xml", "", None):
        assert key("BODY_XML", "/root/a", broken) is None
    assert key("PROPERTY", "p", None) == "v"
    assert key("PROPERTY", "q", None) is None


def test_field_typing(spark):
    values = {"a": "1", "b": "1.5f", "c": " 2 ", "d": "x", "e": "0x1p3", "f": "1e3", "g": "", "h": "nan"}
    df = spark.createDataFrame([(values,)], "m map<string,string>")
    numbers, texts = df.select(numeric_fields(F.col("m")), text_fields(F.col("m"))).first()
    assert numbers == {"a": 1.0, "b": 1.5, "c": 2.0, "e": 8.0, "f": 1000.0}
    assert texts == {"d": "x", "g": "", "h": "nan"}


def test_attributes(spark):
    cases = {"[true]": True, "[Yes]": True, "1": True, "T": True, "[false]": False, "": False, "[[true]]": False}
    for value, expected in cases.items():
        assert one(spark, attributes.is_true(attributes.unwrap(F.col("v"))), v=value) is expected


LIST_BODIES = [
    '{"l":[{"k":"a","v":1},{"k":"b"},{"v":2.50},{}]}', '{"l":[{"k":"a"},7,"x",null,[1],{"k":null}]}', '{"l":[]}', '{"l":null}',
    '{"l":{"p":{"k":"a"},"q":{"k":{"n":[1,2]}}}}', '{"l":5}', '{"l":"text"}', "{}", "[1]", "no json", None, '{"l":[1,"b",null,{"z":1},[2]]}',
    '{"l":[{"k":[1,{"a":2}]},{"k":true}],"other":{"bad":1}}', '{"l":[{"K":"upper","k":"lower"}]}', '{"l":[{"k":"a"}',
]


@pytest.mark.parametrize("others", [(), ("$.other",), ("$.l",), ("$.l[0]",), ("$.l[*]",), ("$.l[*].v", "$.l[*].K")])
@pytest.mark.parametrize("wanted", ["$.l[*].k", "$.l[*]"])
def test_lists_from_the_parse_equal_lists_from_the_text(spark, wanted, others):
    """Whatever else is read, and whatever types the elements have."""
    df = spark.createDataFrame([(i, b) for i, b in enumerate(LIST_BODIES)], "id int, body string")
    body = jsonpath.JsonBody()
    path = body.need(jsonpath.parse_path(wanted))
    for other in others:
        body.need(jsonpath.parse_path(other))
    definite = F.get_json_object("body", "$.l")
    text = body._listed_from(path, F.when(jsonpath.is_object(F.col("body")), definite))
    attached = body.attach(df)
    rows = attached.select("id", body.values(path).alias("parsed"), text.alias("text")).collect()
    for r in rows:
        assert r.parsed == r.text, LIST_BODIES[r.id]


def test_several_xml_paths_at_once(spark):
    bodies = ["<r><a>1</a><b> x </b><a>2</a></r>", "<r/>", "<r><a>", None, "text", "<r><a><c>in</c>ner</a></r>"]
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    paths = ["/r/a", "/r/b", "/r/none", "count(/r/a)"]
    many = grouping.group_keys_xml(F.col("body"), paths)
    single = [grouping.group_key_xml(F.col("body"), p) for p in paths]
    one = grouping.group_keys_xml(F.col("body"), ["/r/a"])
    for r in df.select(F.array(*many).alias("many"), F.array(*single).alias("single"), one[0].alias("one")).collect():
        assert r["many"] == r["single"] and r["one"] == r["single"][0]
