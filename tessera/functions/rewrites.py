"""Functions of the dialect in terms of Spark's, as text: each takes the texts of its arguments.

Catalyst sees built-in expressions only, so everything stays within whole-stage code generation.
"""

from __future__ import annotations

import re
from collections.abc import Callable

# Strftime codes and the Java patterns they stand for.
_STRFTIME = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD", "y": "yy", "p": "a", "I": "hh"}
# Type names of the dialect that Spark lacks or reads otherwise, and the integer types.
TYPES = {"varchar": "STRING", "char": "STRING", "text": "STRING", "bool": "BOOLEAN", "real": "FLOAT", "datetime": "TIMESTAMP", "decimal": "DOUBLE", "numeric": "DOUBLE"}
INTEGERS = {"tinyint", "smallint", "int", "integer", "bigint"}


def java_pattern(code: str) -> str:
    """A strftime format as a Java pattern."""
    out, i = [], 0
    while i < len(code):
        if code[i] == "%" and i + 1 < len(code):
            if code[i + 1] == "%":
                out.append("%")
            elif code[i + 1] in _STRFTIME:
                out.append(_STRFTIME[code[i + 1]])
            else:
                raise ValueError(f"strftime code %{code[i + 1]} is not supported")
            i += 2
        else:
            out.append(f"'{code[i]}'" if code[i].isalpha() else "''" if code[i] == "'" else code[i])
            i += 1
    return "".join(out)


def unquoted(arg: str) -> str:
    arg = arg.strip()
    if not re.fullmatch(r"'(?:[^']|'')*'", arg):
        raise ValueError(f"a quoted text is needed, not {arg}")
    return arg[1:-1].replace("''", "'").replace("$\\{", "${").replace("\\\\", "\\")


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _concat(a: list[str]) -> str:
    return f"concat_ws('', {', '.join(a)})"


def _log(a: list[str]) -> str:
    return f"log10({a[0]})" if len(a) == 1 else f"log({a[0]}, {a[1]})"


# Option letters of regular expressions and the flags they stand for; g is taken by regexp_replace alone.
_OPTIONS = {"i": "i", "c": "", "s": "s", "m": "m", "n": "m", "p": "m", "l": ""}


def _pattern(pattern: str, options: str | None, more: str = "") -> tuple[str, set[str]]:
    """A pattern's text with its options as inline flags, and the options that are no flags."""
    given = set(unquoted(options)) if options else set()
    if unknown := given - set(_OPTIONS) - set(more):
        raise ValueError(f"regular expressions have no option {sorted(unknown)[0]!r}")
    flags = "".join(sorted({_OPTIONS[o] for o in given & set(_OPTIONS)}))
    return (f"concat({quoted(f'(?{flags})')}, {pattern})" if flags else pattern), given


def _replace(a: list[str]) -> str:
    """The first match replaced, or with option g each; \\1 and so on in the replacement are groups, $ is itself.

    What follows the first match is taken along to the end and put back, so nothing is left to match again; (?!\\G) keeps an empty
    match from being found a second time at the end.
    """
    if not 3 <= len(a) <= 4:
        raise ValueError("regexp_replace takes three or four arguments")
    pattern, given = _pattern(a[1], a[3] if len(a) == 4 else None, "g")
    replacement = f"regexp_replace(replace({a[2]}, '$', {quoted(chr(92) + '$')}), {quoted(chr(92) * 2 + '([0-9])')}, {quoted(chr(92) + '$$1')})"
    if "g" in given:
        return f"regexp_replace({a[0]}, {pattern}, {replacement})"
    head, tail = quoted(r"(?:\A|(?!\G))(?:"), quoted(r")(?<afterwards>(?s:.*))\z")
    return f"regexp_replace({a[0]}, concat({head}, {pattern}, {tail}), concat({replacement}, '$', '{{afterwards}}'))"


def _matches(a: list[str]) -> str:
    if not 2 <= len(a) <= 3:
        raise ValueError("regexp_matches takes two or three arguments")
    return f"regexp_like({a[0]}, {_pattern(a[1], a[2] if len(a) == 3 else None)[0]})"


def _trunc(a: list[str]) -> str:
    if len(a) == 2 and a[1].strip().startswith("'"):
        return f"trunc({a[0]}, {a[1]})"
    if len(a) == 1:
        return f"(sign({a[0]}) * CAST(floor(abs({a[0]})) AS DOUBLE))"
    return f"(sign({a[0]}) * floor(abs({a[0]}) * power(10, {a[1]})) / power(10, {a[1]}))"


def _split_part(a: list[str]) -> str:
    return f"(CASE WHEN {a[2]} = 0 THEN '' ELSE split_part({a[0]}, {a[1]}, CASE WHEN {a[2]} = 0 THEN 1 ELSE {a[2]} END) END)"


def _datediff(a: list[str]) -> str:
    if len(a) != 3:
        return f"datediff({', '.join(a)})"
    return f"timestampdiff({unquoted(a[0]).upper()}, {a[1]}, {a[2]})"


def _initcap(a: list[str]) -> str:
    parts = f"regexp_extract_all({a[0]}, {quoted('(' + chr(92) + 'p{L}+|' + chr(92) + 'P{L}+)')}, 1)"
    return f"array_join(transform({parts}, x -> initcap(x)), '')"


def extract(arg: str) -> str:
    m = re.fullmatch(r"\s*(\w+)\s+from\s+(.*)", arg, re.I | re.S)
    if not m:
        return f"extract({arg})"
    unit, x = m[1].lower(), m[2]
    if unit == "dow":
        return f"(dayofweek({x}) - 1)"
    if unit == "epoch":
        return f"(unix_micros(CAST({x} AS TIMESTAMP)) / 1000000.0D)"
    return f"extract({m[1]} FROM {x})"


def _trimmer(side: str) -> Callable[[list[str]], str]:
    def rewrite(a: list[str]) -> str:
        name = {"both": "trim", "leading": "ltrim", "trailing": "rtrim"}[side]
        return f"{name}({a[0]})" if len(a) == 1 else f"trim({side.upper()} {a[1]} FROM {a[0]})"

    return rewrite


def cast(operand: str, target: str) -> str:
    """A cast in which fractions are rounded on their way to integers and types without a length are open ones."""
    known = TYPES.get(target.strip().lower(), target.strip())
    if known.lower() not in INTEGERS or re.fullmatch(r"\s*(-?\d+|null|'[^']*')\s*", operand, re.I):
        return f"CAST({operand} AS {known})"
    x = operand.strip()
    return (
        f"(CASE WHEN typeof({x}) IN ('double', 'float') THEN CAST(rint(CAST({x} AS DOUBLE)) AS {known})"
        f" WHEN typeof({x}) LIKE 'decimal%' THEN CAST(round(CAST({x} AS DOUBLE)) AS {known}) ELSE CAST({x} AS {known}) END)"
    )


FUNCTIONS: dict[str, Callable[[list[str]], str]] = {
    "log": _log,
    "concat": _concat,
    "regexp_replace": _replace,
    "trunc": _trunc,
    "split_part": _split_part,
    "datediff": _datediff,
    "initcap": _initcap,
    "trim": _trimmer("both"),
    "ltrim": _trimmer("leading"),
    "rtrim": _trimmer("trailing"),
    "dayname": lambda a: f"date_format({a[0]}, 'EEEE')",
    "monthname": lambda a: f"date_format({a[0]}, 'MMMM')",
    "dayofweek": lambda a: f"(dayofweek({a[0]}) - 1)",
    "ceil": lambda a: f"CAST(ceil({a[0]}) AS DOUBLE)",
    "floor": lambda a: f"CAST(floor({a[0]}) AS DOUBLE)",
    "sign": lambda a: f"CAST(sign({a[0]}) AS INT)",
    "strpos": lambda a: f"instr({a[0]}, {a[1]})",
    "regexp_matches": _matches,
    "strftime": lambda a: f"date_format({a[0]}, {quoted(java_pattern(unquoted(a[1])))})",
    "logical_and": lambda a: f"bool_and({a[0]})",
    "logical_or": lambda a: f"bool_or({a[0]})",
    "grouping": lambda a: f"grouping({a[0]})" if len(a) == 1 else f"grouping_id({', '.join(a)})",
    "round_int": lambda a: f"CAST(rint({a[0]}) AS BIGINT)",
}
