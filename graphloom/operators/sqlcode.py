"""SQL scripts to nodes and edges, statement by statement."""

from __future__ import annotations

import re

_NAME = r"(?:[`\"\[]?[\w$]+[`\"\]]?\.)*[`\"\[]?[\w$]+[`\"\]]?"
CREATE = re.compile(rf"^\s*(?:create|attach)\s+(?:or\s+replace\s+)?(?:(?:temp|temporary|global|external|unlogged)\s+)*(table|materialized\s+view|view|dictionary|function|procedure|database|schema|index|trigger)\s+(?:if\s+not\s+exists\s+)?({_NAME})", re.I)
READS = re.compile(rf"\b(?:from|join|using)\s+(?:only\s+|lateral\s+)?({_NAME})(?!\s*\()", re.I)
WRITES = re.compile(rf"\b(?:insert\s+(?:overwrite\s+)?into(?:\s+table)?|merge\s+into|update|delete\s+from|truncate(?:\s+table)?|to)\s+({_NAME})", re.I)
ALTERS = re.compile(rf"^\s*alter\s+table\s+(?:if\s+exists\s+)?(?:only\s+)?({_NAME})", re.I)
REFERENCES = re.compile(rf"\breferences\s+({_NAME})", re.I)
CLONES = re.compile(rf"\)?\s*(?:\bas|\bclone|\blike)\s+({_NAME})\s*(?:engine\b.*)?$", re.I | re.S)
COMMENT = re.compile(r"--[^\n]*|/\*.*?\*/", re.S)
QUOTED = re.compile(r"\$(\w*)\$.*?\$\1\$|'(?:[^']|'')*'", re.S)
NOT_NAMES = frozenset("select values table set where on lateral unnest only dual as to from into".split())
CONSTRAINTS = frozenset("primary foreign unique check constraint index key exclude projection like period".split())


def _plain(name: str) -> str:
    return re.sub(r"[`\"\[\]]", "", name)


def statements(text: str) -> list[tuple[int, str]]:
    """``(line, statement)``, without comments, cut at semicolons outside of quotes."""
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    hidden = QUOTED.sub(blank, COMMENT.sub(blank, text))
    out, at = [], 0
    for end in [*[m.start() for m in re.finditer(";", hidden)], len(hidden)]:
        part = hidden[at:end]
        if part.strip():
            out.append((text.count("\n", 0, at + len(part) - len(part.lstrip())) + 1, part.strip()))
        at = end + 1
    return out


def columns_of(statement: str) -> list[tuple[str, str]]:
    """Name and type of the columns in a table's first brackets."""
    start = statement.find("(")
    if start < 0:
        return []
    depth, parts, at = 0, [], start + 1
    for i in range(start, len(statement)):
        c = statement[i]
        depth += (c == "(") - (c == ")")
        if (c == "," and depth == 1) or depth == 0:
            parts.append(statement[at:i].strip())
            at = i + 1
        if depth == 0:
            break
    out = []
    for p in parts:
        words = p.split(None, 2)
        if len(words) >= 2 and _plain(words[0]).lower() not in CONSTRAINTS:
            out.append((_plain(words[0]), words[1]))
    return out


def from_sql(path: str, text: str):
    """Tables, views, columns and functions, and which read, write, refer to, alter or clone which."""
    from graphloom.operators.code import _Out, identifier

    out = _Out(path)
    known: dict[str, str] = {}
    out.nodes[0]["label"] = path.rsplit("/", 1)[-1]

    def place(name: str) -> str:
        key = _plain(name).lower()
        return known.get(key) or known.get(key.rsplit(".", 1)[-1]) or out.node("sql_" + identifier(key), _plain(name), "struct", None)

    script = statements(text)
    for line, s in script:
        if m := CREATE.match(s):
            kind, name = re.sub(r"\s+", " ", m[1].lower()), _plain(m[2])
            if kind in ("database", "schema", "index", "trigger"):
                continue
            node = out.node(identifier(path, name), name, {"table": "struct", "dictionary": "struct", "view": "module", "materialized view": "module"}.get(kind, "function"), line)
            out.edge(out.file, node, "defines")
            known[name.lower()] = known[name.lower().rsplit(".", 1)[-1]] = node
            if kind in ("table", "dictionary"):
                for column, _ in columns_of(s[m.end() :]):
                    out.edge(node, out.node(identifier(path, name, column), f"{name}.{column}", "variable", line), "has_column")
    for _, s in script:
        made = CREATE.match(s)
        own = known.get(_plain(made[2]).lower()) if made else None
        for m in REFERENCES.finditer(s):
            out.edge(own or out.file, place(m[1]), "references")
        if m := ALTERS.match(s):
            out.edge(out.file, place(m[1]), "alters")
            continue
        if made and made[1].lower() == "table" and (m := CLONES.search(s[made.end() :])) and _plain(m[1]).lower() not in NOT_NAMES:
            out.edge(own or out.file, place(m[1]), "clones")
        for m in READS.finditer(re.sub(r"\bdelete\s+from\b", "delete_from", s, flags=re.I)):
            if _plain(m[1]).lower() not in NOT_NAMES and place(m[1]) != own:
                out.edge(own or out.file, place(m[1]), "reads_from")
        for m in WRITES.finditer(s):
            word = m[0].split()[0].lower()
            if _plain(m[1]).lower() not in NOT_NAMES and (word != "to" or made and "view" in made[1].lower()) and place(m[1]) != own:
                out.edge(own or out.file, place(m[1]), "writes_to")
    return out.rows()
