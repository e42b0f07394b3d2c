"""Regular expressions and replacement templates of linear-time engines, as Java regular expressions.

The rules are checked once, on the driver, when an operator is built.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import SparkSession

_REFUSED = re.compile(r"\(\?(?:=|!|<=|<!|>)|\\[1-9]|\\k<|[*+?}]\+")


def java_pattern(pattern: str, max_bytes: int | None = None) -> str:
    """The same expression for Java: `.` excludes only line feeds, named groups, Unicode case folding.

    Raises ValueError for what linear-time engines lack (look-around, back-references, possessive
    repetition) and for expressions that do not compile.
    """
    if max_bytes is not None and len(pattern.encode()) > max_bytes:
        raise ValueError(f"pattern longer than {max_bytes} bytes")
    if _REFUSED.search(pattern.replace("\\\\", "")):
        raise ValueError(f"unsupported in a linear-time expression: {pattern!r}")
    out = pattern.replace("(?P<", "(?<").replace("(?i)", "(?iu)")
    spark = SparkSession.getActiveSession()
    if spark is not None:
        try:
            spark._jvm.java.util.regex.Pattern.compile(out)
        except Exception as e:
            raise ValueError(f"bad pattern {pattern!r}") from e
    else:
        re.compile(pattern)
    return "(?d)" + out


def anchored(pattern: str) -> str:
    r"""Matches whole texts only; `\z`, since `$` also matches before a last line feed."""
    return java_pattern(pattern).replace("(?d)", r"(?d)\A(?:", 1) + r")\z"


def restarting(pattern: str) -> str:
    r"""A pattern of java_pattern whose search begins anew, in the rest of the text, after each match.

    What looks at the text before a match then sees its end as the beginning: `^` and `\A` hold there, `\b` where a word
    begins. `\G` is where the last match ended.
    """
    held = {"A": r"(?:\G|\A)", "b": r"(?:(?!\G)\b|\G(?=\w))", "B": r"(?:(?!\G)\B|\G(?!\w))"}
    out, in_class, at = [], 0, 0
    while at < len(pattern):
        two = pattern[at : at + 2]
        if two == "\\Q":
            end = pattern.find("\\E", at)
            end = len(pattern) if end < 0 else end + 2
            out.append(pattern[at:end])
            at = end
            continue
        if two[0] == "\\" and len(two) == 2:
            out.append(two if in_class else held.get(two[1], two))
            at += 2
            continue
        c = two[0]
        if c == "[":
            in_class += 1
            # a negation, and a bracket that comes first, are no anchors and no ends
            head = re.match(r"\[\^?\]?", pattern[at:])[0]
            out.append(head)
            at += len(head)
            continue
        in_class -= bool(in_class) and c == "]"
        out.append(r"(?:\G|^)" if c == "^" and not in_class else c)
        at += 1
    return "".join(out)


def matches_empty(pattern: str) -> bool:
    return re.search(pattern.replace("(?<", "(?P<") if "(?P<" not in pattern else pattern, "") is not None


def group_names(pattern: str) -> dict[str, int]:
    return re.compile(pattern).groupindex


def group_count(pattern: str) -> int:
    return re.compile(pattern).groups


def template_parts(template: str) -> list[str | int | tuple[str, str]]:
    """A replacement template as literals, group numbers and (`name`, group name) pairs.

    A name is the longest run of letters, digits and underscores after `$`, or what stands in
    `${...}`; it is a number only if all of it is digits. `$$` is a dollar sign; a lone `$` stays.
    """
    out: list[str | int | tuple[str, str]] = []
    at = 0
    for m in re.finditer(r"\$(?:(\$)|\{([A-Za-z0-9_]+)\}|([A-Za-z0-9_]+))", template):
        out.append(template[at : m.start()])
        at = m.end()
        name = m[2] or m[3]
        out.append("$" if m[1] else int(name) if name.isdigit() else ("name", name))
    return [p for p in [*out, template[at:]] if p != ""]


def expand(template: str, text: Column, pattern: str) -> Column:
    """The template filled from the match of the whole text; unknown groups are empty."""
    java, groups, names = anchored(pattern), group_count(pattern), group_names(pattern)
    parts = []
    for p in template_parts(template):
        if isinstance(p, str):
            parts.append(F.lit(p))
            continue
        number = names.get(p[1], -1) if isinstance(p, tuple) else p
        parts.append(F.coalesce(F.regexp_extract(text, java, number), F.lit("")) if 0 <= number <= groups else F.lit(""))
    return F.concat(*parts) if parts else F.lit("")


def quoted_replacement(text: str) -> str:
    """A replacement that regexp_replace takes literally."""
    return text.replace("\\", "\\\\").replace("$", "\\$")
