"""Statements that Spark and DuckDB both run: one text, with a few words that each engine spells its own way."""

from __future__ import annotations

import re

#: Our word: (Spark, DuckDB).
WORDS = {
    "RX'": ("r'", "'"), " ALL_G": ("", ", 'g'"), "MATCHES(": ("regexp_like(", "regexp_matches("), "SPLIT_RX(": ("split(", "string_split_regex("),
    "LIST_SIZE(": ("size(", "len("), "LIST_JOIN(": ("array_join(", "array_to_string("), "LIST_FILTER(": ("filter(", "list_filter("), "LIST_MAP(": ("transform(", "list_transform("),
    "LIST_SORT(": ("array_sort(", "list_sort("), "LIST_SET(": ("array_distinct(", "list_distinct("), "LIST_COMMON(": ("array_intersect(", "list_intersect("), "LIST_HAS(": ("array_contains(", "list_contains("),
    "EXPLODE(": ("explode(", "unnest("), "COLLECT(": ("collect_list(", "list("), "JSON_GET(": ("get_json_object(", "json_extract_string("), "STRPOS(": ("instr(", "strpos("),
    "AT_LEAST_ZERO(": ("greatest(0e0, ", "greatest(0e0, "), "[FIRST]": ("[0]", "[1]"), "[SECOND]": ("[1]", "[2]"),
}


def spell(text: str, spark: bool) -> str:
    for word, forms in WORDS.items():
        text = text.replace(word, forms[not spark])
    return re.sub(r"\bFN (\w+):", r"\1 ->" if spark else r"lambda \1:", text)


def bind(text: str, names) -> str:
    """For spark.sql(): braces doubled, and every frame named after FROM or JOIN in braces."""
    text = text.replace("{", "{{").replace("}", "}}")
    return re.sub(rf"\b(FROM|JOIN)(\s+)({'|'.join(map(re.escape, names))})\b", r"\1\2{\3}", text) if names else text


def with_roles(text: str, roles: dict[str, str]) -> str:
    """The statement with its roles as common table expressions in front."""
    heads = ", ".join(f"{name} AS ({body})" for name, body in roles.items())
    text = text.strip()
    if not heads:
        return text
    recursive = text.upper().startswith("WITH RECURSIVE ")
    rest = text[15:] if recursive else text[5:] if text.upper().startswith("WITH ") else None
    return f"WITH {'RECURSIVE ' * recursive}{heads}{', ' + rest if rest else ' ' + text}"
