"""Structural hashes: bodies that differ in names and literals only are equal."""

from __future__ import annotations

import hashlib
import re

#: Words that keep their name (fixed values).
KEPT = set(
    "if else while for do return throw throws try catch finally switch case default break continue await async yield let const var function class struct interface new this self super null undefined true false nil none "
    "import export pub fn mut impl match type enum void int string bool boolean float double char".split()
)
_COMMENTS = re.compile(r"/\*.*?\*/|//[^\n]*", re.S)
_TOKEN = re.compile(r"""(?P<number>[0-9]+(?:\.[0-9]+)?)|(?P<string>'[^']*'|"[^"]*"|`[^`]*`)|(?P<name>[a-zA-Z_$][a-zA-Z0-9_$]*)|(?P<sign>===|!==|==|!=|<=|>=|=>|\+\+|--|\+=|-=|\*=|&&|\|\||[{}()\[\].,;:?+\-*/%&|^~=<>!])""")


def normalize(code: str) -> str:
    """Numbers become 0, strings "", a declared function $fn, other names $v1, $v2 in order; keywords, properties and callees stay."""
    tokens = [(m.lastgroup, m.group()) for m in _TOKEN.finditer(_COMMENTS.sub("", code).strip())]
    names: dict[str, str] = {}
    out = []
    for i, (kind, token) in enumerate(tokens):
        before, after = tokens[i - 1][1] if i else "", tokens[i + 1][1] if i + 1 < len(tokens) else ""
        if kind == "number":
            out.append("0")
        elif kind == "string":
            out.append('""')
        elif kind == "sign" or token in KEPT:
            out.append(token)
        elif before in ("function", "fn", "func", "def"):
            out.append("$fn")
        elif before == "." or after == "(":
            out.append(token)
        else:
            out.append(names.setdefault(token, f"$v{len(names) + 1}"))
    return " ".join(out)


def structural_hash(code: str) -> str:
    return hashlib.sha256(normalize(code).encode()).hexdigest()[:16]
