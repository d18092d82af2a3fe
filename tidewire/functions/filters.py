"""The message filter ``<address regex>|<json path>|AND or OR``."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.jsonpath import JsonBody, JsonPath, parse_path
from tidewire.functions.text import match_address

# Fixed value: the format of a filter expression.
FILTER_FORMAT = re.compile(r"^(.+)\|(.+)\|(AND|OR)$")


@dataclass(frozen=True)
class MessageFilter:
    address_regex: str
    path: JsonPath
    both: bool

    @classmethod
    def parse(cls, expression: str) -> "MessageFilter":
        found = FILTER_FORMAT.match(expression)
        if not found:
            raise ValueError(f"not a filter expression: {expression}")
        return cls(found[1], parse_path(found[2]), found[3] == "AND")

    def possible(self, address: Column) -> Column:
        """What the address alone decides: false where no body can make the message pass."""
        return match_address(address, self.address_regex) if self.both else F.lit(True)

    def column(self, address: Column, body: JsonBody) -> Column:
        """Never null: a body that cannot be read counts as not matching."""
        on_address = match_address(address, self.address_regex)
        on_body = body.found(self.path)
        # the address test is the cheaper one and comes first
        return (on_address & on_body) if self.both else (on_address | on_body)


def filter_messages(messages: DataFrame, expression: str) -> DataFrame:
    """Messages that pass the filter, with their columns unchanged."""
    rule = MessageFilter.parse(expression)
    body = JsonBody()
    body.need(rule.path)
    candidates = messages.filter(rule.possible(F.col("address")))
    return body.drop(body.attach(candidates).filter(rule.column(F.col("address"), body)))
