"""Text functions: full matches, regex transforms and templates."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.jsonpath import JsonBody, JsonPath, parse_path

# The placeholder formats of template strings. The address form is greedy, so a
# template holds one of them and it is best placed last.
ADDRESS_PLACEHOLDER = re.compile(r"\{ADDRESS\|(.+)\|(.+)\}")
BODY_PLACEHOLDER = re.compile(r"\{BODY\|([^}]+)\}")


def whole(pattern: str) -> str:
    """The pattern as one that must match the whole text."""
    return rf"\A(?:{pattern})\z"


def match_address(address: Column, pattern: str, mode: str = "full") -> Column:
    """Test an address; ``mode`` is ``full`` (whole text) or ``find`` (any part)."""
    if mode not in ("full", "find"):
        raise ValueError(f"unknown match mode: {mode}")
    return F.coalesce(address.rlike(whole(pattern) if mode == "full" else pattern), F.lit(False))


def regex_transform(text: Column, pattern: str, template: str) -> Column:
    """Whole match: the template with ``$1`` … ``$9`` filled in. No match: the text unchanged.

    The anchored pattern matches at most once, so one replacement does both. References have one
    digit: ``$10`` is the first group and a zero, however many groups there are.
    """
    groups = count_groups(pattern)
    replacement = ""
    for part in re.split(r"(\$[1-9])", template):
        if re.fullmatch(r"\$[1-9]", part) and int(part[1]) <= groups:
            replacement += part
            continue
        literal = part.replace("\\", "\\\\").replace("$", "\\$")
        # a digit after a reference must not become a part of it
        replacement += "\\" + literal if literal[:1].isdigit() else literal
    return F.regexp_replace(text, whole(pattern), replacement)


def count_groups(pattern: str) -> int:
    """The number of capturing groups of a Java pattern."""
    groups = at = depth = 0  # depth of nested character classes
    while at < len(pattern):
        if pattern.startswith("\\Q", at):
            end = pattern.find("\\E", at)
            at = len(pattern) if end < 0 else end + 2
            continue
        c = pattern[at]
        if c == "\\":
            at += 1
        elif c == "[":
            depth += 1
            # a bracket right at the start of a class belongs to it
            at += pattern.startswith("^", at + 1)
            at += pattern.startswith("]", at + 1)
        elif c == "]" and depth:
            depth -= 1
        elif c == "(" and not depth:
            named = re.match(r"\(\?<[A-Za-z]", pattern[at:])
            groups += bool(named) or not pattern.startswith("(?", at)
        at += 1
    return groups


@dataclass
class Template:
    """Literals, ``{ADDRESS|regex|template}`` and ``{BODY|path}`` joined to one text.

    The column is null when a body value is missing or null: the record has no such text.
    """

    expression: str
    parts: list[tuple] = field(default_factory=list)

    @classmethod
    def parse(cls, expression: str) -> "Template":
        made = cls(expression)
        at = 0
        for hit in ADDRESS_PLACEHOLDER.finditer(expression):
            made._literals(expression[at : hit.start()])
            made.parts.append(("address", hit[1], hit[2]))
            at = hit.end()
        made._literals(expression[at:])
        return made

    def _literals(self, text: str) -> None:
        at = 0
        for hit in BODY_PLACEHOLDER.finditer(text):
            if hit.start() > at:
                self.parts.append(("literal", text[at : hit.start()]))
            self.parts.append(("body", hit[0], parse_path(hit[1])))
            at = hit.end()
        if at < len(text):
            self.parts.append(("literal", text[at:]))

    def paths(self) -> list[JsonPath]:
        return [part[2] for part in self.parts if part[0] == "body"]

    def column(self, address: Column, body: JsonBody) -> Column:
        columns = []
        for kind, *rest in self.parts:
            if kind == "literal":
                columns.append(F.lit(rest[0]))
            elif kind == "address":
                columns.append(regex_transform(address, *rest))
            else:
                placeholder, path = rest
                value = body.value(path)
                if not path.definite:
                    # a list path without results leaves the placeholder as it is
                    value = F.when(F.size(body.values(path)) == 0, F.lit(placeholder)).otherwise(value)
                columns.append(value)
        return F.concat(*columns) if columns else F.lit("")


def strip_backslashes(address: Column) -> Column:
    return F.translate(address, "\\", "")


def normalize_topic(topic: Column) -> Column:
    """Address without the ``topic://`` scheme."""
    return F.regexp_replace(topic, r"\Atopic://", "")


def to_slashes(address: Column) -> Column:
    return F.translate(address, ".", "/")


def to_dots(topic: Column) -> Column:
    return F.translate(topic, "/", ".")
