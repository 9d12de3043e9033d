"""Pieces of SQL for the oracle side, written for RE2 regular expressions."""

from __future__ import annotations

from readlake.functions.text import BLOCK_TAGS, CONTAINERS, ENTITIES

WS = r"[ \t\n\x0b\f\r]"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(x: str, pattern: str, by: str, flags: str = "g") -> str:
    return f"regexp_replace({x}, {quote(pattern)}, {quote(by)}, '{flags}')"


def strip(x: str) -> str:
    return sub(x, f"^{WS}+|{WS}+$", "")


def collapse(x: str) -> str:
    return strip(sub(x, f"{WS}+", " "))


def newlines(x: str) -> str:
    return strip(f"replace({sub(x, '^' + chr(0xFEFF), '')}, chr(13) || chr(10), chr(10)).replace(chr(13), chr(10))")


def escape(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def entities(x: str) -> str:
    for name, value in ENTITIES.items():
        x = sub(x, f"(?i)&{name};", value.replace("\\", "\\\\"))
    return x


def without_containers(x: str) -> str:
    for tag in CONTAINERS:
        x = sub(x, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    return x


def visible(x: str) -> str:
    text = sub(sub(x, rf"(?is)<\s*/?\s*({BLOCK_TAGS})\b[^>]*>", "\n"), "(?s)<[^>]*>", "")
    return f"list_filter(list_transform(string_split({entities(text)}, chr(10)), lambda q: {strip('q')}), lambda q: q <> '')"


def words(x: str) -> str:
    return f"len(regexp_split_to_array({x}, '{WS}+'))"


def paragraphs(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({newlines(x)}, {quote(chr(10) + '[ \\t\\x0b\\f\\r]*' + chr(10))}), lambda q: {strip('q')}), lambda q: q <> '')"
