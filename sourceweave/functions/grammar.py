"""Declaration patterns per language, as data."""

from __future__ import annotations

from sourceweave.functions.lexer import ANGLE, nested
from sourceweave.functions.lines import sql_text as sql  # noqa: F401

# (kind, pattern with the name in group 1); the first match on a line wins.
# ``function`` and ``method`` open a callable, ``class`` a type, ``arrow`` a bound function.
_JS_METHOD = (
    r"^\s+(?:(?:public|private|protected|static|async|readonly|get|set|abstract|override)\s+)*(\w+)\s*(?:<[^>]*>)?"
    r"\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::\s*[^{;=]+)?\{"
)
_JS = [
    ("class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"),
    ("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)\s*(?:<[^>]*>)?\("),
    (
        "arrow",
        r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::\s*[^=]+)?=\s*(?:async\s*)?(?:function\b|\([^()]*\)\s*(?::\s*[^=]+)?=>|\w+\s*=>)",
    ),
    ("method", _JS_METHOD),
]
DECLARATIONS = {
    "python": [
        ("function", r"^\s*(?:async\s+)?def\s+(\w+)\s*\("),
        ("class", r"^\s*class\s+(\w+)"),
    ],
    "javascript": _JS,
    "typescript": [("class", r"^\s*(?:export\s+)?interface\s+(\w+)"), *_JS],
    "java": [
        ("class", r"^\s*(?:(?:public|private|protected|static|final|abstract)\s+)*(?:class|interface|enum)\s+(\w+)"),
        # without a modifier a type must come first and a body must follow
        ("method", r"^\s*(?:<[^()]*>\s*)?[\w<>\[\],.?]+\s+(\w+)\s*\([^()]*\)\s*(?:throws\s+[\w.,\s]+)?\{"),
        (
            "method",
            r"^\s*(?:(?:public|private|protected|static|final|synchronized|abstract|default|native)\s+)+(?:<[^()]*>\s*)?(?:[\w<>\[\],.?]+\s+)?(\w+)\s*\([^()]*\)\s*(?:throws\s+[\w.,\s]+)?[{;]",
        ),
    ],
    "go": [
        ("function", r"^func\s+(\w+)\s*(?:\[[^()]*\])?\s*\("),
        ("method", r"^func\s+\(\s*\w+\s+\*?\w+(?:\[[^()]*\])?\s*\)\s*(\w+)\s*\("),
        ("class", r"^type\s+(\w+)\s*(?:\[[^()]*\])?\s+(?:struct|interface)\b"),
    ],
}
#: A line without any of these words cannot hold a declaration of the language.
GUARDS = {
    "python": ["def", "class"],
    "javascript": ["{", "=>", "function", "class"],
    "typescript": ["{", "=>", "function", "class", "interface"],
    "java": ["(", "class", "interface", "enum"],
    "go": ["func", "type"],
}
#: What a line with a declaration of that kind has, whatever its rule.
RULE_GUARDS = {
    **{(lang, kind): words for lang in ("javascript", "typescript") for kind, words in {"function": ["function"], "arrow": ["="], "method": ["(", "{"]}.items()},
    ("python", "function"): ["def"], ("python", "class"): ["class"], ("javascript", "class"): ["class"], ("java", "method"): ["("],
    ("go", "function"): ["func"], ("go", "method"): ["func"], ("go", "class"): ["type"],
}
#: Words that look like a method declaration or a call but are statements.
KEYWORDS = [
    "if", "for", "while", "switch", "catch", "return", "function", "elif", "not", "and", "or", "in", "with",
    "await", "yield", "def", "class", "lambda", "func", "assert", "except", "import", "typeof", "async",
    "else", "do", "try", "new", "case", "is", "raise", "throw", "default",
]
CALL = r"(\.?[A-Za-z_$][\w.$]*)\s*\("
#: What stands right before a name that is declared or constructed, and before a Go method's name.
NOT_CALLED = r"\b(?:def|class|function|func|new)\s+$"
RECEIVER = r"^[^()]*\)\s*$"
# A parameter list with two levels of nested brackets: text before it, inside, and after it.
_INNER = r"[^()]*(?:\([^()]*(?:\([^()]*\)[^()]*)*\)[^()]*)*"
SIGNATURE = rf"^((?:func\s+\([^)]*\)\s*)?[^(]*\()({_INNER})\)([^\n]*)"
#: Languages whose angle brackets hold types.
ANGLED = "language in ('typescript', 'java')"
# Head of a Python block up to its first statement.
PY_HEAD = rf"^\s*(?:async\s+)?def\s+\w+\s*\({_INNER}\)[^:\n]*:\s*"
PY_CLASS_HEAD = rf"^\s*class\s+\w+\s*(?:\({_INNER}\))?\s*:\s*"
DOCSTRINGS = [r'"""([\s\S]*?)"""', r"'''([\s\S]*?)'''", r'"([^"\n]*)"', r"'([^'\n]*)'"]
PY_BASES = rf"\bclass\s+\w+\s*\(({_INNER})\)"
OWN_TYPES = rf"(\b(?:class|interface|record)\s+\w+\s*){ANGLE}"
BASES = [
    r"\bextends\s+(.*?)\s*(?:\bimplements\b|\bpermits\b|\{|$)",
    r"\bimplements\s+(.*?)\s*(?:\bpermits\b|\{|$)",
]
# Names and values of fields that stand directly in a class body.
_TYPE = rf"[\w.$]+(?:\s*{ANGLE})?(?:\[\])*"
_JAVA_FIELD = rf"^\s*(?:@[\w.]+(?:\([^()]*\))?\s+)*(?:(?:public|private|protected|static|final|transient|volatile)\s+)*({_TYPE})\s+(\w+\s*(?:;|[=,].*$))"
FIELDS = {
    "python": r"^\s*([\w.]+)\s*(?::[^=]+)?=\s*[^=]",
    "typescript": r"^\s*(?:(?:public|private|protected|readonly|static|declare)\s+)*(\w+)[?!]?\s*:\s*[^({]+;?$",
    "java": _JAVA_FIELD.replace(rf"({_TYPE})", _TYPE),
    "go": r"^\s*(\w+(?:\s*,\s*\w+)*|\*?[\w.]+)(?:\s+[^\s`\"\x01][^`\"\x01]*?)?\s*(?:[`\"]\x01*)?\s*$",
}
UP_TO_VALUE = r"^[^=]*=\s*"
FIELD_VALUES = {
    "python": rf"{UP_TO_VALUE}(.*?)\s*$",
    "typescript": r":\s*([^;=]+)",
    "java": _JAVA_FIELD,
    "go": r"^\s*(?:\w+(?:\s*,\s*\w+)*\s+)?([^\s`\"\x01][^`\"\x01]*?)\s*(?:[`\"]\x01*)?\s*$",
}
DECORATOR = rf"^\s*@[\w.$]+\s*(?:\({nested(3)}\))?\s*$"
# Imports: whole text and module, module and names (Python); names and module (scripts); block or module (Go).
PY_IMPORT = r"(?m)^(?:import[ \t]+(([^,\n]+)[^\n]*)|from[ \t]+(\S+)[ \t]+import[ \t]+(\([^)]*\)|[^\n]+))"
SCRIPT_IMPORT = r"""(?m)^\s*import\b\s*(?:([^;"']*?)\s*from\s*)?["']([^"']+)["']"""
JAVA_IMPORT = r"(?m)^\s*(import\s+[^;]+;)"
GO_IMPORT = r'(?m)^import\s*(?:\(([^)]*)\)|(?:[\w.]+\s+)?"([^"]+)")'
# Assignments: all up to the value, name, type, value.
PY_VARIABLE = r"^(([A-Za-z_]\w*)\s*(?::\s*([^=]+?))?\s*=\s*)([^=].*?)\s*$"
SCRIPT_VARIABLE = r"^(\s*(?:export\s+)?(?:const|let|var)\s+(\w+|\[[^\]]*\]|\{[^}]*\})\s*(?::\s*([^=]+?))?\s*=\s*)(.+?);?\s*$"
