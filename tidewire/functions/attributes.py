"""Role attributes: one-element lists written as text, with yes/no values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mean yes, in any case.
TRUE_WORDS = ("true", "yes", "1", "t")

# The permission flags of a role; the first ten take part in policies.
POLICY_FLAGS = (
    "read", "write", "send", "consume", "createAddress", "deleteAddress", "createDurableQueue",
    "deleteDurableQueue", "createNonDurableQueue", "deleteNonDurableQueue",
)
EXTRA_FLAGS = ("manage", "browse", "view", "edit")
ROLE_FLAGS = POLICY_FLAGS + EXTRA_FLAGS


def unwrap(text: Column) -> Column:
    """Drop one ``[`` at the start and one ``]`` at the end."""
    return F.regexp_replace(text, r"^\[|\]$", "")


def is_true(text: Column) -> Column:
    return F.coalesce(F.lower(text).isin(*TRUE_WORDS), F.lit(False))


def flag(attributes: Column, name: str) -> Column:
    """A yes/no attribute; absent means no."""
    return is_true(unwrap(F.try_element_at(attributes, F.lit(name))))
