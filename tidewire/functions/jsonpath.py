"""JSON paths compiled to columns.

A path is parsed on the driver. All definite paths that a query needs are read from **one** parse of
the body (``JsonBody``), however many rules ask for them. Supported: ``$``, ``.name``, ``['name']``,
``[i]``, ``[*]`` / ``.*``, and one trailing ``[?(@.field op literal)]``; anything else is refused.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EACH = "*"

_TOKEN = re.compile(
    r"""\.(?P<name>[^.\[\]*?()'"\s]+)
      | \[(?P<quote>['"])(?P<quoted>[^'"\]]+)(?P=quote)\]
      | \[(?P<index>\d+)\]
      | (?P<each>\[\*\]|\.\*)
      | \.?\[\?\(\s*@\.(?P<field>[\w.]+)\s*(?P<op><=|>=|==|!=|<|>)\s*(?P<value>[^()]+?)\s*\)\]$
    """,
    re.VERBOSE,
)


@dataclass(frozen=True)
class Condition:
    """``@.field op value`` on one object."""

    field: str
    op: str
    value: str | float | bool

    def test(self, raw: Column) -> Column:
        found = F.get_json_object(raw, f"$.{self.field}")
        if isinstance(self.value, bool):
            left, right = found, F.lit(str(self.value).lower())
        elif isinstance(self.value, float):
            left, right = found.try_cast("double"), F.lit(self.value)
        else:
            left, right = found, F.lit(self.value)
        outcome = {
            "<": left < right,
            "<=": left <= right,
            ">": left > right,
            ">=": left >= right,
            "==": left == right,
            "!=": left != right,
        }[self.op]
        return F.coalesce(outcome, F.lit(False))


@dataclass(frozen=True)
class JsonPath:
    """Steps are a field name, an array index, or ``EACH``."""

    text: str
    steps: tuple[str | int, ...]
    condition: Condition | None = None
    each_at: tuple[int, ...] = field(default=())

    @property
    def definite(self) -> bool:
        return not self.each_at and self.condition is None

    def below(self, context: "JsonPath") -> "JsonPath":
        """The same path, read from the value that ``context`` selects."""
        if not context.definite:
            raise ValueError(f"the context must select one value: {context.text}")
        steps = context.steps + self.steps
        return JsonPath(self.text, steps, self.condition, _each_positions(steps))


def _each_positions(steps) -> tuple[int, ...]:
    return tuple(i for i, step in enumerate(steps) if step is EACH)


def _literal(text: str) -> str | float | bool:
    if text in ("true", "false"):
        return text == "true"
    if len(text) >= 2 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1]
    try:
        return float(text)
    except ValueError:
        raise ValueError(f"unsupported literal in JSON path condition: {text}") from None


def parse_path(text: str) -> JsonPath:
    """Parse ``$.a.b[0]``; a bare ``a.b`` means ``$.a.b``."""
    source = text.strip()
    if not source:
        raise ValueError("empty JSON path")
    rest = source[1:] if source.startswith("$") else ("." + source)
    steps: list[str | int] = []
    condition = None
    at = 0
    while at < len(rest):
        found = _TOKEN.match(rest, at)
        if found is None:
            raise ValueError(f"unsupported JSON path: {text}")
        if found["name"] is not None:
            steps.append(found["name"])
        elif found["quoted"] is not None:
            steps.append(found["quoted"])
        elif found["index"] is not None:
            steps.append(int(found["index"]))
        elif found["each"] is not None:
            steps.append(EACH)
        else:
            condition = Condition(found["field"], found["op"], _literal(found["value"]))
        at = found.end()
    return JsonPath(text, tuple(steps), condition, _each_positions(steps))


def spark_path(steps) -> str:
    """The steps in the notation of ``get_json_object``."""
    out = ["$"]
    for step in steps:
        out.append(f"[{step}]" if isinstance(step, int) else f"['{step}']")
    return "".join(out)


def _start(raw: Column) -> Column:
    return F.ltrim(raw, F.lit(" \t\r\n"))


def is_object(raw: Column) -> Column:
    return _start(raw).startswith("{")


def _is_array(raw: Column) -> Column:
    return _start(raw).startswith("[")


def _members(raw: Column) -> Column:
    """Values of an array or of an object; nothing for other values; null stays null."""
    return (
        F.when(_is_array(raw), F.from_json(raw, "array<string>"))
        .when(is_object(raw), F.map_values(F.from_json(raw, "map<string,string>")))
        .when(raw.isNotNull(), F.array().cast("array<string>"))
    )


def _spread(members: Column, tail: tuple[str | int, ...]) -> Column:
    """Follow ``tail`` from every member, one list over all of them."""
    if not tail:
        return members
    if EACH in tail:
        cut = tail.index(EACH)
        head, rest = tail[:cut], tail[cut + 1 :]

        def nested(member: Column) -> Column:
            raw = F.get_json_object(member, spark_path(head)) if head else member
            return F.coalesce(_spread(_members(raw), rest), F.array().cast("array<string>"))

        return F.flatten(F.transform(members, nested))
    if isinstance(tail[-1], str):
        # an object without the last field counts as null; what is no object is left out
        def owner(member: Column) -> Column:
            raw = F.get_json_object(member, spark_path(tail[:-1])) if tail[:-1] else member
            return F.coalesce(is_object(raw), F.lit(False))

        return F.transform(
            F.filter(members, owner), lambda member: F.get_json_object(member, spark_path(tail))
        )
    values = F.transform(members, lambda member: F.get_json_object(member, spark_path(tail)))
    return F.filter(values, lambda value: value.isNotNull())


TEXT_MAP = T.MapType(T.StringType(), T.StringType())


@dataclass
class _Node:
    wanted: bool = False
    wanted_map: bool = False
    fields: dict[str, "_Node"] = field(default_factory=dict)
    items: "_Node | None" = None

    @property
    def mapped(self) -> bool:
        """Read as a map of texts: wanted so, and nothing else is needed but single fields."""
        plain = all(child.leaf and not child.wanted_map for child in self.fields.values())
        return self.wanted_map and not self.wanted and self.items is None and plain

    @property
    def leaf(self) -> bool:
        return not self.fields and self.items is None

    @property
    def raw(self) -> bool:
        """Kept as text: a leaf, or a value that cannot be given one struct or array type."""
        if self.mapped:
            return False
        if self.wanted or self.wanted_map or (self.fields and self.items is not None):
            return True
        if self.leaf:
            return True
        return len({name.lower() for name in self.fields}) < len(self.fields)

    def type(self) -> T.DataType:
        if self.raw:
            return T.StringType()
        if self.mapped:
            return TEXT_MAP
        if self.items is not None:
            return T.ArrayType(self.items.type())
        return T.StructType([T.StructField(n, child.type()) for n, child in self.fields.items()])


class JsonBody:
    """The set of paths a query reads from one body column.

    Call ``need`` for each path first, then ``attach`` once, then ``value``/``values``/``found``.
    """

    CORRUPT = "__corrupt"

    def __init__(self, body: str = "body", column: str = "__json"):
        self.body = body
        self.column = column
        self.root = _Node()
        self.lists: dict[JsonPath, str] = {}

    def need(self, path: JsonPath) -> JsonPath:
        """Register the longest definite part of ``path``, and its list of results if it has one."""
        if not path.definite:
            self.lists.setdefault(path, f"{self.column}_{len(self.lists)}")
        if self._one_list(path):
            items = self._items(self._definite_part(path))
            if items is not None:
                for name in path.steps[path.each_at[0] + 1 :]:
                    items = items.fields.setdefault(name, _Node())
                items.wanted = True
                return path
        if node := self._node(self._definite_part(path)):
            node.wanted = True
        return path

    def need_map(self, path: JsonPath) -> JsonPath:
        """Register a definite path whose object is wanted as a map of texts."""
        if node := self._node(path.steps):
            node.wanted_map = True
        return path

    def _node(self, steps: tuple[str | int, ...]) -> _Node | None:
        """The place of a path in the parsed body; none for the whole body."""
        if not steps or isinstance(steps[0], int):
            return None
        node = self.root
        for step in steps:
            if isinstance(step, int):
                node.items = node.items or _Node()
                node = node.items
            else:
                node = node.fields.setdefault(step, _Node())
        return node

    @staticmethod
    def _one_list(path: JsonPath) -> bool:
        """A list whose elements, or one field of each, are wanted: the parse of the body can give it."""
        tail = path.steps[path.each_at[0] + 1 :] if path.each_at else ()
        return len(path.each_at) == 1 and path.condition is None and (
            not tail or (len(tail) == 1 and isinstance(tail[0], str))
        )

    def _items(self, steps: tuple[str | int, ...]) -> _Node | None:
        """The elements of the list at a definite path."""
        node = self._node(steps)
        if node is None or any(isinstance(step, int) for step in steps):
            return None
        node.items = node.items or _Node()
        return node.items

    def _parsed_list(self, path: JsonPath) -> Column | None:
        """The list as the parse of the body gives it; none where the body had to be kept as text.

        Right only where the parse was clean: an element of another type than the rest is an error there.
        """
        steps = self._definite_part(path)
        if not self._one_list(path) or not steps or any(isinstance(s, int) for s in steps) or steps[0] in self._ambiguous():
            return None
        node, value = self.root, F.col(self.column)
        for step in steps:
            value, node = value[step], node.fields[step]
            if node.raw or node.mapped:
                return None
        if node.items is None:
            return None
        tail = path.steps[path.each_at[0] + 1 :]
        if not tail:
            return value if node.items.raw else None
        if node.items.raw or node.items.mapped or not node.items.fields[tail[0]].raw:
            return None
        there = F.filter(value, lambda element: element.isNotNull())
        return F.transform(there, lambda element: element[tail[0]])

    @staticmethod
    def _definite_part(path: JsonPath) -> tuple[str | int, ...]:
        return path.steps[: path.each_at[0]] if path.each_at else path.steps

    def attach(self, df: DataFrame) -> DataFrame:
        """Add the parsed body as one struct column, and one column for each list of results."""
        fields = [
            T.StructField(n, child.type())
            for n, child in self.root.fields.items()
            if n not in self._ambiguous()
        ]
        schema = T.StructType([*fields, T.StructField(self.CORRUPT, T.StringType())])
        parsed = F.from_json(
            F.when(is_object(F.col(self.body)), F.col(self.body)),
            schema,
            {"columnNameOfCorruptRecord": self.CORRUPT, "mode": "PERMISSIVE"},
        )
        attached = df.withColumn(self.column, parsed)
        lists = {name: self._listed(path) for path, name in self.lists.items()}
        return attached.withColumns(lists) if lists else attached

    def _ambiguous(self) -> set[str]:
        """Root fields that differ only in case; they are read from the text of the body."""
        spelled: dict[str, list[str]] = {}
        for name in self.root.fields:
            spelled.setdefault(name.lower(), []).append(name)
        return {name for names in spelled.values() if len(names) > 1 for name in names}

    def drop(self, df: DataFrame) -> DataFrame:
        return df.drop(self.column, *self.lists.values())

    def _clean(self) -> Column:
        """The body could be parsed and all values have the types that were expected."""
        doc = F.col(self.column)
        return doc.isNotNull() & doc[self.CORRUPT].isNull()

    def valid(self) -> Column:
        """The body is a JSON document."""
        clean = self._clean()
        # a value of another type than the paths expect also marks the record; look again then
        return F.when(clean, F.lit(True)).otherwise(
            F.get_json_object(F.col(self.body), "$").isNotNull()
        )

    def _raw(self, steps: tuple[str | int, ...]) -> Column:
        """Text of the value at definite ``steps``."""
        if not steps or isinstance(steps[0], int) or steps[0] in self._ambiguous():
            return F.get_json_object(F.col(self.body), spark_path(steps))
        node, value = self.root, F.col(self.column)
        for at, step in enumerate(steps):
            if at and node.raw:
                return F.get_json_object(value, spark_path(steps[at:]))
            if at and node.mapped:
                return F.try_element_at(value, F.lit(step))
            if isinstance(step, int):
                value, node = F.get(value, F.lit(step)), node.items
            else:
                value, node = value[step], node.fields[step]
        return value

    def text_map(self, path: JsonPath) -> Column:
        """The object at a definite path as a map of texts; null when there is none."""
        value = self._raw(path.steps)
        node = self._node(path.steps)
        if node is not None and node.mapped and path.steps[0] not in self._ambiguous():
            return value
        return F.when(is_object(value), F.from_json(value, TEXT_MAP))

    def value(self, path: JsonPath) -> Column:
        """Text of the first result; null when there is none or it is null."""
        if path.definite:
            return self._raw(path.steps)
        return F.get(self.values(path), F.lit(0))

    def values(self, path: JsonPath) -> Column:
        """All results as text; a null list means that the path failed."""
        if path.definite:
            raw = self._raw(path.steps)
            return F.when(raw.isNotNull(), F.array(raw))
        return F.col(self.lists[path])

    def _listed(self, path: JsonPath) -> Column:
        steps = self._definite_part(path)
        if self._kept_as_text(steps):
            return self._listed_from(path, self._raw(steps))
        # what the parse does not give is read from the text of the body
        body = F.col(self.body)
        text = self._listed_from(path, F.when(is_object(body), F.get_json_object(body, spark_path(steps))))
        parsed = self._parsed_list(path)
        return text if parsed is None else F.when(self._clean(), parsed).otherwise(text)

    def _kept_as_text(self, steps: tuple[str | int, ...]) -> bool:
        """Whether ``_raw`` gives the value at definite ``steps`` as text."""
        if not steps or isinstance(steps[0], int) or steps[0] in self._ambiguous():
            return True
        node = self.root
        for at, step in enumerate(steps):
            if at and (node.raw or node.mapped):
                return True
            node = node.items if isinstance(step, int) else node.fields[step]
        return node.raw

    def _listed_from(self, path: JsonPath, raw: Column) -> Column:
        if path.each_at:
            first = path.each_at[0]
            found = _spread(_members(raw), path.steps[first + 1 :])
            if path.condition:
                found = F.filter(found, path.condition.test)
            return found
        # a condition applies to the object itself, or to each element of an array
        return F.when(
            is_object(raw), F.filter(F.array(raw), path.condition.test)
        ).otherwise(F.filter(_members(raw), path.condition.test))

    def found(self, path: JsonPath) -> Column:
        """The first result exists and is not null; never null itself."""
        if path.steps == () and path.condition is None:
            return self.valid()
        return self.value(path).isNotNull()
