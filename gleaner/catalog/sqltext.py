"""SQL fragments shared by the counterpart queries (RE2 patterns, list functions)."""

from __future__ import annotations

import re

WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NL = "chr(10)"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(s: str) -> str:
    return lit(s)


def words(items) -> str:
    return lit("|".join(re.sub(r"([\\.^$*+?()\[\]{}|])", r"\\\1", w) for w in items))


def listed(items) -> str:
    return ", ".join(lit(w) for w in items)


def sub(x: str, pattern: str, to: str) -> str:
    """Replace all; ``to`` is an SQL expression."""
    return f"regexp_replace({x}, {rx(pattern)}, {to}, 'g')"


def strip(x: str) -> str:
    return sub(x, f"^{WS}+|{WS}+$", "''")


def inline(x: str) -> str:
    return f"trim({sub(x, WS + '+', chr(39) + ' ' + chr(39))})"


def clean(x: str, trailing: bool = True) -> str:
    t = sub(f"replace({x}, chr(160), ' ')", r"[ \t]+", "' '")
    t = sub(f"replace({t}, chr(13), {NL})", r"\n[ \t]*\n+", f"{NL}||{NL}")
    return strip(sub(t, r"[ \t]+\n", NL) if trailing else t)


def line_list(x: str) -> str:
    return (f"list_filter(list_transform(string_split(replace({x}, chr(13), {NL}), {NL}), "
            f"lambda l: {inline('l')}), lambda l: l <> '')")


def block(x: str) -> str:
    return f"array_to_string({line_list(x)}, {NL})"


def count_words(x: str, items) -> str:
    return "(" + " + ".join(f"(contains({x}, {lit(w)}))::int" for w in items) + ")"


def greedy(files: str) -> str:
    """Fold a list of structs (n, u): keep one whose name and url are both new."""
    return (f"list_reduce(list_transform({files}, lambda f: [f]), lambda acc, x: case when len(list_filter(acc, "
            "lambda k: k.n = x[1].n or k.u = x[1].u)) > 0 then acc else list_concat(acc, x) end)")


def first_match(x: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({x}, {rx(pattern)}, {group})"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {rx(pattern)})"
