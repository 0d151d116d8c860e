"""Names of servers, databases and tables."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinkeep.functions.fixed import DEFAULT_SCHEMA


def clean_name(name: Column) -> Column:
    """Keep letters and digits of any script, ``_`` and ``-``."""
    return F.regexp_replace(name, r"[^\p{L}\p{N}_-]", "")


def namespace_name(server: Column, database: Column) -> Column:
    """Target namespace ``<server>_<database>``, dashes and blanks as ``_``."""
    return F.translate(F.concat_ws("_", clean_name(server), database), "- ", "__")


def schema_part(name: Column) -> Column:
    """What stands before the first dot, or the default schema."""
    dot = F.instr(name, ".")
    return F.when(dot > 0, F.substring(name, F.lit(1), dot - 1)).otherwise(F.lit(DEFAULT_SCHEMA))


def table_part(name: Column) -> Column:
    """What stands after the first dot, or the whole name."""
    dot = F.instr(name, ".")
    return F.when(dot > 0, F.substring(name, dot + 1, F.length(name))).otherwise(name)


def qualified(schema: Column, table: Column) -> Column:
    return F.concat_ws(".", schema, table)


def clean_text(name: str) -> str:
    """``clean_name`` for a single Python string (table and column identifiers)."""
    return re.sub(r"[^\w-]", "", name)


def namespace_text(server: str, database: str) -> str:
    return re.sub("[- ]", "_", f"{clean_text(server)}_{database}")


def split_text(name: str) -> tuple[str, str]:
    schema, dot, table = name.partition(".")
    return (schema, table) if dot else (DEFAULT_SCHEMA, name)


def identifier(*parts: str) -> str:
    """A catalog identifier, each part quoted."""
    return ".".join("`" + part.replace("`", "``") + "`" for part in parts)


def literal(text: str) -> str:
    """SQL text of a string value."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def target_table(server: str, database: str, table: str) -> str:
    """``<server>_<database>.<schema>_<table>`` as a catalog identifier. Dots,
    dashes and blanks of a table name become ``_``: catalogs refuse them."""
    return identifier(
        namespace_text(server, database), re.sub("[-. ]", "_", "_".join(split_text(table)))
    )


def shared_targets(server: str, database: str, tables: Iterable[str]) -> dict[str, list[str]]:
    """Target tables that more than one of ``tables`` maps to, with those tables."""
    by_target: dict[str, list[str]] = {}
    for name in tables:
        by_target.setdefault(target_table(server, database, name).lower(), []).append(name)
    return {target: names for target, names in by_target.items() if len(names) > 1}
