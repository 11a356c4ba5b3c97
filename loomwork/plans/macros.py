"""Named fragments in SQL text: MEASURE(x), DIM(x), SEGMENT(x), CROSSFILTER(cell) and @cell.

Only names are replaced, and only outside quotes and comments; Spark parses the result.
"""

from __future__ import annotations

import re

NAME = re.compile(r"[a-z_][a-z0-9_]{0,63}")
_PROTECTED = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.S)
_MACRO = re.compile(r"\b(MEASURE|DIM|SEGMENT|CROSSFILTER)\s*\(\s*([A-Za-z_]\w*)\s*\)", re.I)
_CELL = re.compile(r"@([A-Za-z_]\w*)")
#: What an unknown name becomes, so that the text still parses when it is shown.
UNKNOWN = {"MEASURE": "NULL", "DIM": "NULL", "SEGMENT": "FALSE", "CROSSFILTER": "TRUE"}
DEPTH = 10
_FORBIDDEN = re.compile(r"\b(insert|update|delete|drop|create|alter|attach|copy|install|load|pragma|set|call|truncate|merge|grant|revoke)\b|;", re.I)


class UnknownMacro(ValueError):
    """A statement names a macro that does not exist."""


class MacroCycle(ValueError):
    """Fragments name each other in a circle or too deeply."""


def outside(sql: str, replace) -> str:
    """Apply ``replace`` to the parts of a statement outside quotes and comments."""
    out, at = [], 0
    for m in _PROTECTED.finditer(sql):
        out += [replace(sql[at : m.start()]), m[0]]
        at = m.end()
    return "".join([*out, replace(sql[at:])])


def valid_name(name: str) -> bool:
    return NAME.fullmatch(name) is not None


def valid_fragment(text: str) -> bool:
    """No statement keyword and no semicolon outside literals."""
    return bool(text.strip()) and not _FORBIDDEN.search(_PROTECTED.sub("''", text))


def expand(sql: str, measures=None, dimensions=None, segments=None, filters=None) -> tuple[str, list[str]]:
    """The statement with all fragments put in, and the names it could not find."""
    tables = {"MEASURE": measures or {}, "DIM": dimensions or {}, "SEGMENT": segments or {}, "CROSSFILTER": filters or {}}
    unknown: list[str] = []

    def once(text: str, depth: int) -> str:
        if depth > DEPTH:
            raise MacroCycle(f"fragments nest more than {DEPTH} deep")

        def put(m: re.Match) -> str:
            kind, name = m[1].upper(), m[2]
            if name not in tables[kind]:
                unknown.append(f"{kind}({name})")
                return UNKNOWN[kind]
            fragment = tables[kind][name]
            if not fragment:  # a cleared selection; without parentheses, as `where (true)` could read as an alias list
                return "TRUE"
            return f"({once(fragment, depth + 1)})"

        return outside(text, lambda part: _MACRO.sub(put, part))

    return once(sql, 0), unknown


def expanded(sql: str, **tables) -> str:
    """As ``expand``, but an unknown name is an error before anything runs."""
    text, unknown = expand(sql, **tables)
    if unknown:
        raise UnknownMacro(", ".join(unknown))
    return text


def cycles(fragments: dict[str, str]) -> list[list[str]]:
    """Circles among measures, one path each."""
    links = {n: [m[2] for m in _MACRO.finditer(_PROTECTED.sub("''", t)) if m[2] in fragments] for n, t in fragments.items()}
    found, state = [], {}

    def visit(node: str, path: list[str]) -> None:
        state[node] = 1
        for other in links[node]:
            if state.get(other) == 1:
                found.append(path[path.index(other) :] + [other])
            elif other not in state:
                visit(other, [*path, other])
        state[node] = 2

    for n in sorted(fragments):
        if n not in state:
            visit(n, [n])
    return found


def cell_references(sql: str) -> list[str]:
    """Names of the cells that a statement reads."""
    found: list[str] = []

    def note(part: str) -> str:
        found.extend(m[1] for m in _CELL.finditer(part))
        return part

    outside(sql, note)
    return list(dict.fromkeys(found))


def bind_cells(sql: str, views: dict[str, str], inputs: dict[str, object] | None = None) -> tuple[str, dict]:
    """@cell becomes its view; @input a named parameter for ``spark.sql(text, args)``; unknown names a quoted identifier."""
    args: dict[str, object] = {}

    def put(m: re.Match) -> str:
        name = m[1]
        if inputs and name in inputs:
            args[name] = inputs[name]
            return f":{name}"
        return f"`{views[name]}`" if name in views else f"`{name}`"

    return outside(sql, lambda part: _CELL.sub(put, part)), args
