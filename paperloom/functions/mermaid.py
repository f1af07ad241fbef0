"""Diagram code in Mermaid: finding it, mending what breaks renderers, checking it.

Code is short and line-based; it is handled in Arrow batches by Python functions that work token
by token: an identifier, a bracketed label, an arrow, anything else.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# First words of diagram code; characters that need quotes in a label.
KEYWORDS = ("flowchart", "graph", "sequencediagram", "classdiagram", "statediagram", "erdiagram", "mindmap", "gantt", "pie", "gitgraph", "c4context", "blockbeta")
RISKY = set("()<>:/;&#, ")
ARROWS = ("-->", "-.->", "==>", "<-->", "<--", "<-.-", "<==", "---")
_SHAPES = (("((", "))"), ("([", "])"), ("[(", ")]"), ("[", "]"), ("{", "}"))
_NODE = re.compile(r'\b(\w+)\["([^"\n]+)"\]')
_KEEP = ("style ", "class ", "subgraph", "end", "linkstyle", "click")


def _opens(line: str) -> bool:
    return re.sub(r"[\s-]", "", line.lower()).startswith(KEYWORDS)


def extract(text: str | None) -> str | None:
    """The diagram code in a text: from its fence or from the first line that opens a diagram; None without one."""
    if not text or not text.strip():
        return None
    m = re.search(r"```(?:mermaid)?\s*([\s\S]*?)\s*```", text, re.I)
    lines = (m.group(1) if m else text).replace("\r\n", "\n").strip().split("\n")
    first = next((k for k, x in enumerate(lines) if x.strip() and _opens(x.strip())), None)
    return None if first is None else "\n".join(lines[first:]).strip()


def _label(raw: str) -> str:
    t = re.sub(r"<br\s*/?>", "<br/>", raw.strip(), flags=re.I).replace('\\"', "'").rstrip("]").strip()
    for a, z in (("('", "')"), ('("', '")')):
        if t.startswith(a) and t.endswith(z):
            t = t[2:-2].strip()
    quoted = len(t) > 1 and t[0] == t[-1] == '"'
    inner = t[1:-1] if quoted else t
    return '"' + inner.replace('"', "'") + '"' if quoted or RISKY & set(inner) else inner


def _mend_labels(line: str) -> str:
    """Scan a line from left to right; a bracket right after an identifier opens a label."""
    out, k = [], 0
    while k < len(line):
        shape = next((s for s in _SHAPES if line.startswith(s[0], k)), None) if k and (line[k - 1].isalnum() or line[k - 1] == "_") else None
        if shape is None:
            out.append(line[k])
            k += 1
            continue
        opened, closing = shape
        at = k + len(opened)
        if line.startswith('"', at):
            quote = line.find('"', at + 1)
            end = line.find(closing, quote + 1) if quote > 0 else -1
        else:
            end = line.find(closing, at)
        if end < 0:
            out.append(line[k])
            k += 1
            continue
        out.append(opened + _label(line[at:end]) + closing)
        k = end + len(closing)
        while closing in ("]", "}") and line.startswith(closing, k):  # a bracket closed twice
            k += 1
    return re.sub(r'(\]|\)|\})\s*<br\s*/?>[^-=<]*(?=-->|---|-\.->|==>)', r"\1 ", "".join(out), flags=re.I)


def _has_arrow(line: str) -> bool:
    bare = re.sub(r'"[^"]*"', '""', line)
    return any(a in bare for a in ARROWS)


def sanitize(text: str | None) -> str | None:
    """Diagram code that renders: quoted labels, ``flowchart`` for ``graph``, no node in a group of its own name, no edge twice."""
    code = extract(text)
    if code is None:
        return None
    out: list[str] = []
    groups: list[str] = []
    labels: dict[str, str] = {}
    edges: set[str] = set()
    for line in code.split("\n"):
        s = line.strip()
        if not s or s.startswith("%%"):
            out.append(line)
            continue
        line = re.sub(r"^(\s*)graph(?=\s+(?:TD|TB|LR|RL|BT)\b)", r"\1flowchart", line, flags=re.I)
        if s.startswith("classDef"):
            head, _, props = s.partition(" ")
            name, _, rest = props.strip().partition(" ")
            kept = [p for p in rest.rstrip(";").split(",") if p.strip() and not re.match(r"\s*r[xy]\s*:", p)]
            out.append(f"{head} {name} {','.join(kept)};")
            continue
        group = re.match(r"subgraph\s+(\w+)", s, re.I)
        if group:
            groups.append(group.group(1))
        elif s.lower() == "end" and groups:
            groups.pop()
        if s.lower().startswith(_KEEP):
            out.append(line)
            continue
        line = _mend_labels(line)
        if groups and _has_arrow(line):
            line = "".join(p if p.startswith('"') else re.sub(rf"\b{re.escape(groups[-1])}\b", f"{groups[-1]}_node", p) for p in re.split(r'("[^"]*")', line))
        for node, label in _NODE.findall(line):
            known = labels.setdefault(node, label.strip())
            if known != label.strip() and groups:
                renamed = f"{groups[-1]}_{node}"
                line = re.sub(rf"\b{re.escape(node)}\b", renamed, line)
                labels[renamed] = label.strip()
        edge = " ".join(line.split())
        if _has_arrow(line):
            if edge in edges:
                continue
            edges.add(edge)
        out.append(line)
    return "\n".join(out)


def problem(code: str | None) -> str | None:
    """The first thing wrong with diagram code, or None."""
    lines = [x.strip() for x in (code or "").split("\n") if x.strip()]
    if not lines:
        return "empty"
    if re.match(r"graph\b", lines[0], re.I):
        return "graph instead of flowchart"
    if not _opens(lines[0]):
        return "unknown header"
    bare = re.sub(r'"[^"\\]*(?:\\.[^"\\]*)*"', '""', code or "")
    if re.search(r"(?<=\w)\[[^\]\n]*\]\]", bare):
        return "bracket closed twice"
    if re.search(r"[\])}]\s*<br\s*/?>", bare, re.I):
        return "line break outside a label"
    if re.search(r'\b\w+\[[^"\]\n]*[()][^"\]\n]*\]', bare):
        return "brackets in a label without quotes"
    groups: list[str] = []
    for s in lines:
        m = re.match(r"subgraph\s+(\w+)", s, re.I)
        if m:
            groups.append(m.group(1))
        elif s.lower() == "end" and groups:
            groups.pop()
        elif groups and _has_arrow(s) and re.search(rf"\b{re.escape(groups[-1])}\b", s):
            return "group inside itself"
    labels: dict[str, str] = {}
    for node, label in _NODE.findall(code or ""):
        if labels.setdefault(node, label.strip()) != label.strip():
            return "node with two labels"
    return next((f"unbalanced {a}{z}" for a, z in ("[]", "{}", "()") if abs(bare.count(a) - bare.count(z)) > 1), None)


def is_flowchart(text: str | None) -> bool:
    code = sanitize(text)
    return bool(code) and code.strip().split("\n")[0].strip().lower().startswith("flowchart ")


def retain_flowcharts(text: str | None) -> str | None:
    """A text in which only flow charts stay as code, mended."""
    if text is None:
        return None
    return re.sub(r"```mermaid\s*([\s\S]*?)\s*```", lambda m: f"```mermaid\n{sanitize(m.group(1))}\n```" if is_flowchart(m.group(1)) else "", text, flags=re.I)


def _each(function, kind):
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([function(x if isinstance(x, str) else None) for x in s], dtype=object)

    return run


def sanitized(column):
    return _each(sanitize, T.StringType())(column)


def problems(column):
    return _each(problem, T.StringType())(column)


def flowcharts_only(column):
    return _each(retain_flowcharts, T.StringType())(column)
