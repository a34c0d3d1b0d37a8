"""Source text read by its tokens: strings and comments masked, heads joined over lines.

One alternation of token patterns a language, scanned from left to right, is the
lexer: whatever starts first wins, so a quote in a comment or a comment sign in a
string is part of what surrounds it. Masking keeps every line and column in place:

- comments become blanks,
- of strings, templates and regular-expression literals the first character stays
  and the rest becomes ``FILL`` (so a line inside a string never looks like code,
  and is told from one where a string begins).

Brackets that hold no statements are then joined over lines (``JOIN`` stands for a
line end), so a declaration is read as one line however it is laid out.

Not seen: code inside templates and f-strings; JSX text with ``//`` reads as a comment.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sourceweave.functions.lines import sql_text

FILL, JOIN = "\u0001", "\u0002"
#: Stands for a possessive mark: Java then repeats without recursion; other engines need none.
_HOLD = "{+}"


def _quoted(mark: str) -> str:
    return rf"{mark}[^{mark}\\\n]*{_HOLD}(?:\\[\s\S][^{mark}\\\n]*{_HOLD})*{_HOLD}{mark}"


def _to_end(start: str, end: str) -> str:
    return rf"{start}[\s\S]*?(?:{end}|\z)"


_COMMENTS = [_to_end(r"/\*", r"\*/"), r"//[^\n]*"]
_TEMPLATE = rf"`[^`\\]*{_HOLD}(?:\\[\s\S][^`\\]*{_HOLD})*{_HOLD}`"
_CLASS = r"\[(?:[^\]\\\n]|\\.)*\]"
_REGEX = rf"[(,=:\[!&|?{{}};]\s*/(?:[^*/\\\[\n]|\\.|{_CLASS})(?:[^/\\\[\n]|\\.|{_CLASS})*{_HOLD}/"

_TOKENS = {
    "python": [_to_end('"""', '"""'), _to_end("'''", "'''"), _quoted('"'), _quoted("'"), r"#[^\n]*"],
    "script": [*_COMMENTS, _quoted('"'), _quoted("'"), _TEMPLATE, _REGEX],
    "java": [*_COMMENTS, _to_end('"""', '"""'), _quoted('"'), _quoted("'")],
    "go": [*_COMMENTS, _quoted('"'), _quoted("'"), r"`[^`]*`"],
}
LANGUAGES = {"python": ["python"], "script": ["javascript", "typescript"], "java": ["java"], "go": ["go"]}


def nested(depth: int) -> str:
    """What stands between two brackets of any kind, with ``depth`` further levels."""
    plain = rf"[^()\[\]{{}}]*{_HOLD}"
    return plain if not depth else rf"{plain}(?:[(\[{{]{nested(depth - 1)}[)\]}}]{plain})*{_HOLD}"


def _head(depth: int) -> str:
    """What stands between the parentheses of a head: no statement, and no body after ``)`` or ``=>``."""
    if not depth:
        return rf"[^(){{}};]*{_HOLD}"
    inner = _head(depth - 1)
    return rf"\s*(?:\{{{inner}\}})?(?:[^(){{}};>\s]\s*\{{{inner}\}}|[^(){{}};]|\({inner}\))*{_HOLD}"


_BRACED = rf"\({_head(3)}\)(?:\s*throws\s[^(){{}};]*)?|\b(?:class|interface|enum|record)\s+\w[^(){{}};]*\{{"
_HEADS = {"python": rf"[(\[{{]{nested(4)}[)\]}}]", "script": _BRACED, "java": _BRACED, "go": _BRACED}

ANGLE = r"<[^<>]*(?:<[^<>]*(?:<[^<>]*>[^<>]*)*>[^<>]*)*>"


def item(angle: bool) -> str:
    """One item of a list: commas inside brackets do not end it; with ``angle``, ``<...>`` is a bracket too."""
    return rf"((?:[(\[{{]{nested(3)}[)\]}}]|{'=>|' + ANGLE + '|' if angle else ''}[^,()\[\]{{}}])+)"


def java(pattern: str) -> str:
    return pattern.replace(_HOLD, "+")


def plain(pattern: str) -> str:
    """The pattern for engines without possessive marks; the language is the same."""
    return pattern.replace(_HOLD, "")


def tokens(family: str) -> str:
    return "|".join(_TOKENS[family])


def heads(family: str) -> str:
    return _HEADS[family]


def _replaced(text: str, pattern: str, change: str) -> str:
    """SQL that changes every match of ``pattern``; ``change`` is SQL over ``get(v.t, i)``."""
    p = sql_text(java(pattern))
    return (
        f"element_at(transform(array(named_struct('p', split({text}, {p}, -1), 't', regexp_extract_all({text}, {p}, 0))), "
        f"v -> array_join(transform(v.p, (x, i) -> concat(x, coalesce({change}, ''))), '')), 1)"
    )


_COMMENT = "startswith(get(v.t, i), '#') or startswith(get(v.t, i), '//') or startswith(get(v.t, i), '/*')"


def _covered(text: str, sign: str) -> str:
    """SQL of ``sign`` for every character of ``text`` but line ends."""
    return rf"case when contains({text}, '\n') then regexp_replace({text}, '[^\\n]', '{sign}') else repeat('{sign}', length({text})) end"


_BLANK = _covered("get(v.t, i)", " ")
_FILLED = f"concat(substr(get(v.t, i), 1, 1), {_covered('substr(get(v.t, i), 2)', FILL)})"


def _by_language(language: str, sql) -> str:
    cases = " ".join(
        f"when {language} in ({', '.join(repr(x) for x in names)}) then {sql(family)}" for family, names in LANGUAGES.items()
    )
    return f"case {cases} end"


def masked(content: str = "content", language: str = "language") -> Column:
    """The text with strings and comments masked; null for other languages."""
    change = f"case when {_COMMENT} then {_BLANK} else {_FILLED} end"
    return F.expr(_by_language(language, lambda family: _replaced(content, tokens(family), change)))


def code_lines(code: str = "code", language: str = "language") -> Column:
    """Lines of masked text: ``array<struct<text, whole, inside>>``.

    ``whole`` is the line with all that its brackets continue on the next lines;
    a line that continues one is ``inside`` and has no ``whole`` of its own.
    """
    joined = _by_language(language, lambda family: _replaced(code, heads(family), rf"replace(get(v.t, i), '\n', '{JOIN}')"))
    return F.expr(
        rf"flatten(transform(split({joined}, '\n', -1), x -> transform(split(x, '{JOIN}', -1), (y, j) -> named_struct("
        f"'text', y, 'whole', case when j = 0 then replace(x, '{JOIN}', ' ') else '' end, 'inside', j > 0))))"
    )


def items_of(code: str, text: str, angle: str | None = None) -> str:
    """SQL array of the trimmed items of a list; ``code`` is ``text`` masked, ``angle`` a condition for angle brackets."""

    def cut(pattern: str) -> str:
        p = sql_text(java(pattern))
        return (
            f"aggregate(regexp_extract_all({code}, {p}, 1), named_struct('at', 1, 'out', cast(array() as array<string>)), (s, t) -> "
            rf"named_struct('at', s.at + length(t) + 1, 'out', concat(s.out, array(regexp_replace(substr({text}, s.at, length(t)), '^\\s+|\\s+$', '')))), s -> s.out)"
        )

    every = cut(item(False)) if angle is None else f"case when {angle} then {cut(item(True))} else {cut(item(False))} end"
    return f"filter({every}, x -> x <> '')"
