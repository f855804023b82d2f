"""Access to VARIANT values by path.

Path grammar: `name`, `.name`, `[3]`, `["any text"]`. Keys holding a dot or a bracket take the quoted form.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_STEP = re.compile(
    r"""\["(?P<double>[^"]+)"\] | \['(?P<single>[^']+)'\] | \[(?P<index>\d+)\]
        | \.?(?P<plain>(?:[^.\[] | \[(?!\d+\]|["']))+)""",
    re.VERBOSE,
)
PLAIN_KEY = r"^[^.\[\]\"']+$"


def parse_path(path: str) -> list[str | int]:
    """Split a path into keys and list positions."""
    steps: list[str | int] = []
    at = 0
    while at < len(path):
        found = _STEP.match(path, at)
        if not found:
            raise ValueError(f"bad path {path!r} at {at}")
        if found["index"] is not None:
            steps.append(int(found["index"]))
        else:
            steps.append(found["double"] or found["single"] or found["plain"])
        at = found.end()
    return steps


def variant_path(steps: list[str | int]) -> str:
    """The path in the spelling of `variant_get`."""
    spelled = ["$"]
    for step in steps:
        if isinstance(step, int):
            spelled.append(f"[{step}]")
        elif '"' not in step:
            spelled.append(f'["{step}"]')
        elif "'" not in step:
            spelled.append(f"['{step}']")
        else:
            raise ValueError(f"key {step!r} holds both kinds of quotes")
    return "".join(spelled)


def value_at(json: Column, *steps: str | int, as_type: str = "string", default=None) -> Column:
    """Nested access: a missing step, a wrong container or a JSON null gives `default`."""
    found = F.try_variant_get(json, variant_path(list(steps)), as_type)
    return found if default is None else F.coalesce(found, F.lit(default))


def text_at(json: Column, path: str) -> Column:
    """The value at `path` if it is a JSON string, else NULL. Numbers are not turned into text."""
    node = F.try_variant_get(json, variant_path(parse_path(path)), "variant")
    return F.when(F.schema_of_variant(node) == "STRING", F.try_variant_get(node, "$", "string"))


def answer_of(json: Column, key: str) -> Column:
    """`answer` of the first entry in the list under `key`; empty or missing gives NULL."""
    return F.nullif(value_at(json, key, 0, "answer"), F.lit(""))
