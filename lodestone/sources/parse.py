"""Source text to symbols and references, one language each, behind one Arrow function.

Python is read with the standard library's parser. The other languages are read by lexical rules: comments
and strings are blanked, declarations found at brace depth, a body ends where its braces close. That gives
declarations, nesting, spans and signatures of ordinary code; macros, templates and generated text may be
missed.
"""

from __future__ import annotations

import ast
import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Language of each file extension (fixed values).
LANGUAGES = {"ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "jsx", "py": "python", "rs": "rust", "php": "php", "go": "go"}

_GO_BUILTIN = {"string", "int", "int8", "int16", "int32", "int64", "uint", "uint8", "uint16", "uint32", "uint64", "float32", "float64", "bool", "byte", "rune", "error", "any", "uintptr", "complex64", "complex128"}


def language_of(path: Column) -> Column:
    """Language by extension; null for any other file."""
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(known, extension)


class _Sink:
    def __init__(self, path: str, lines: list[str]):
        self.path, self.lines, self.symbols, self.edges = path, lines, [], []

    def symbol(self, name: str, kind: str, start: int, end: int, parent: str | None = None, signature: str | None = None, doc: str | None = None) -> str:
        fqn = f"{self.path}::{parent}::{name}" if parent else f"{self.path}::{name}"
        body = "\n".join(self.lines[start - 1 : end])
        self.symbols.append((fqn, name, kind, start, end, signature, doc, hashlib.sha256(body.encode("utf-8", "surrogatepass")).hexdigest(), f"{self.path}::{parent}" if parent else None))
        return fqn

    def edge(self, source: str, target: str, kind: str) -> None:
        self.edges.append((source, target, kind))


def _python(sink: _Sink, text: str) -> None:
    tree = ast.parse(text)

    def head(node) -> str:
        rows = sink.lines[node.lineno - 1 : node.body[0].lineno]
        return " ".join(x.strip() for x in rows).split(":\n")[0].rsplit(":", 1)[0].strip() if len(rows) > 1 else rows[0].strip().split(":")[0]

    def visit(nodes, owner: str | None) -> None:
        for node in nodes:
            if isinstance(node, (ast.Import, ast.ImportFrom)):
                module = getattr(node, "module", None) or ""
                for alias in node.names:
                    sink.edge(sink.path, f"{module}.{alias.name}".lstrip("."), "imports")
            elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                sink.symbol(node.name, "method" if owner else "function", node.lineno, node.end_lineno, owner, head(node), ast.get_docstring(node))
                visit([x for x in node.body if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Import, ast.ImportFrom))], None)
            elif isinstance(node, ast.ClassDef):
                sink.symbol(node.name, "class", node.lineno, node.end_lineno, None, head(node), ast.get_docstring(node))
                typed = {x.target.id: x for x in node.body if isinstance(x, ast.AnnAssign) and isinstance(x.target, ast.Name)}
                for name, x in typed.items():
                    sink.symbol(name, "field", x.lineno, x.end_lineno, node.name, sink.lines[x.lineno - 1].strip())
                for init in (x for x in node.body if isinstance(x, ast.FunctionDef) and x.name == "__init__"):
                    for x in init.body:
                        targets = x.targets if isinstance(x, ast.Assign) else [x.target] if isinstance(x, ast.AnnAssign) else []
                        for target in targets:
                            if isinstance(target, ast.Attribute) and isinstance(target.value, ast.Name) and target.value.id == "self" and target.attr not in typed:
                                typed[target.attr] = x
                                sink.symbol(target.attr, "field", x.lineno, x.end_lineno, node.name, sink.lines[x.lineno - 1].strip())
                visit(node.body, node.name)

    visit(tree.body, None)


def blanked(text: str, line_comment: str = "//", quotes: str = "\"'`") -> str:
    """Text with comments and string contents as spaces, line breaks kept."""
    pattern = re.compile(rf"{re.escape(line_comment)}[^\n]*|/\*.*?\*/|" + "|".join(rf"{q}(?:\\.|[^{q}\\{'' if q == '`' else chr(10)}])*{q}" for q in quotes), re.S)
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _close(text: str, at: int) -> int:
    """Place of the brace that closes the first one from ``at`` on; the end of the line without one."""
    depth = 0
    for k in range(at, len(text)):
        c = text[k]
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0:
                return k
        elif c == ";" and depth == 0:
            return k
    return len(text) - 1


def _declared(text: str, rules: list[tuple[str, str]]):
    """(kind, match, end) of declarations in order of place."""
    found = [(m.start(), kind, m) for kind, pattern in rules for m in re.finditer(pattern, text, re.M)]
    for _, kind, m in sorted(found, key=lambda x: x[0]):
        yield kind, m, _close(text, m.end())


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def _signature(text: str, start: int, end: int) -> str:
    piece = text[start : end + 1]
    return re.split(r"\{|;", piece, maxsplit=1)[0].strip()


def _members(sink: _Sink, text: str, clean: str, start: int, end: int, parent: str, rules: list[tuple[str, str]]) -> None:
    body = clean.find("{", start)
    if body < 0 or body > end:
        return
    inside = clean[body + 1 : end]
    flat, depth = [], 0
    for c in inside:  # only what lies at the body's own depth
        if c == "}":
            depth -= 1
        flat.append(c if depth == 0 or c == "\n" else " ")
        if c == "{":
            depth += 1
    for kind, m, _ in _declared("".join(flat), rules):
        a = body + 1 + m.start(1)
        b = _close(clean, body + 1 + m.end()) if "(" in m[0] else clean.find("\n", a)
        b = min(b if b >= 0 else end, end)
        begin = max(body, *[clean.rfind(c, 0, a) for c in "\n;}"]) + 1
        sink.symbol(m[1], kind, _line(clean, a), _line(clean, b), parent, _signature(text, begin, b) or text[a : b + 1].strip())


def _typescript(sink: _Sink, text: str) -> None:
    clean = blanked(text)
    word = r"[A-Za-z_$][\w$]*"
    rules = [("function", rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*({word})"), ("class", rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+({word})"), ("interface", rf"^\s*(?:export\s+)?interface\s+({word})"), ("enum", rf"^\s*(?:export\s+)?(?:const\s+)?enum\s+({word})"), ("type_alias", rf"^\s*(?:export\s+)?type\s+({word})[^=\n]*="), ("function", rf"^\s*(?:export\s+)?(?:const|let|var)\s+({word})\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^)]*\)|{word})\s*(?::[^=\n]+)?=>")]
    not_calls = {"if", "for", "while", "switch", "catch", "function", "return", "super", "typeof", "new", "await"}
    for kind, m, end in _declared(clean, rules):
        start = m.start(1)
        fqn = sink.symbol(m[1], kind, _line(clean, start), _line(clean, end), None, _signature(text, text.rfind("\n", 0, start) + 1, end))
        head = clean[m.end() : clean.find("{", m.end()) if "{" in clean[m.end() :] else end]
        if kind in ("class", "interface"):
            for how in ("extends", "implements"):
                for names in re.findall(rf"\b{how}\s+([\w$.,\s]+)", head):
                    for name in re.split(r"\bimplements\b|\bextends\b", names)[0].split(","):
                        if name.strip():
                            sink.edge(fqn, name.strip(), how)
        if kind == "class":
            _members(sink, text, clean, start, end, m[1], [("method", rf"^\s*(?:(?:public|private|protected|static|async|override|get|set)\s+)*({word})\s*(?:<[^>]*>)?\("), ("field", rf"^\s*(?:(?:public|private|protected|static|readonly)\s+)*({word})\s*[?!]?\s*[:=](?!=)")])
        if kind == "interface":
            _members(sink, text, clean, start, end, m[1], [("method", rf"^\s*({word})\s*\??\("), ("field", rf"^\s*(?:readonly\s+)?({word})\s*\??\s*:")])
        if kind == "enum":
            _members(sink, text, clean, start, end, m[1], [("enum_variant", rf"(?:^|[,{{])\s*({word})\s*(?==|,|$)")])
        if kind in ("function", "class"):
            for name in dict.fromkeys(re.findall(rf"(?<![\w$.])({word})\s*\(", clean[m.end() : end])):
                if name not in not_calls and name != m[1]:
                    sink.edge(fqn, name, "calls")
            for name in dict.fromkeys(re.findall(r":\s*([A-Z][\w$]*)", clean[m.end() : end])):
                sink.edge(fqn, name, "uses_type")
    for module in re.findall(r"^\s*import\b[^'\"\n]*['\"]([^'\"]+)['\"]", text, re.M):
        sink.edge(sink.path, module, "imports")


def _rust(sink: _Sink, text: str) -> None:
    clean = blanked(text, quotes='"')
    vis = r"(?:pub(?:\([^)]*\))?\s+)?"
    owner_spans: list[tuple[int, int]] = []
    for kind, m, end in _declared(clean, [("impl", r"^\s*(?:unsafe\s+)?impl(?:<[^>]*>)?\s+([^{]+?)\s*(?:where[^{]*)?(?=\{)"), ("struct", rf"^\s*{vis}struct\s+(\w+)"), ("enum", rf"^\s*{vis}enum\s+(\w+)"), ("trait", rf"^\s*{vis}(?:unsafe\s+)?trait\s+(\w+)"), ("function", rf"^\s*{vis}(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+(\w+)")]):
        start = m.start(1)
        if kind == "impl":
            parts = re.split(r"\s+for\s+", re.sub(r"<[^<>]*>", "", m[1]))
            parent = f"{parts[1].strip()}::<{parts[0].strip()}>" if len(parts) == 2 else parts[0].strip()
            owner_spans.append((start, end))
            _members(sink, text, clean, start, end, parent, [("method", rf"^\s*{vis}(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+(\w+)[^(]*\(")])
            continue
        if kind == "function" and any(a <= start <= b for a, b in owner_spans):
            continue
        sink.symbol(m[1], kind, _line(clean, start), _line(clean, end), None, _signature(text, text.rfind("\n", 0, start) + 1, end))
        if kind == "struct":
            _members(sink, text, clean, start, end, m[1], [("field", rf"^\s*{vis}(\w+)\s*:")])
        if kind == "enum":
            _members(sink, text, clean, start, end, m[1], [("enum_variant", r"^\s*([A-Z]\w*)")])
        if kind == "trait":
            owner_spans.append((start, end))
            _members(sink, text, clean, start, end, m[1], [("trait_method", r"^\s*(?:async\s+)?fn\s+(\w+)[^(]*\("), ("associated_type", r"^\s*type\s+(\w+)"), ("constant", r"^\s*const\s+(\w+)")])
    for name in re.findall(r"^\s*(?:pub\s+)?use\s+([^;]+);", clean, re.M):
        sink.edge(sink.path, re.sub(r"\s+", "", name), "imports")


def _go_type(name: str) -> str | None:
    """Base name of a Go type: pointers, slices, arrays and channels to their element, maps to their value."""
    name = name.strip()
    while True:
        short = re.sub(r"^(?:\*|\[\w*\]|\.\.\.|<-chan\s+|chan(?:<-)?\s+|map\[[^\]]*\])", "", name).strip()
        if short == name:
            break
        name = short
    name = re.sub(r"\[.*", "", name).split(".")[-1]
    return name if re.fullmatch(r"[A-Za-z_]\w*", name) and name not in _GO_BUILTIN else None


def _go(sink: _Sink, text: str) -> None:
    clean = blanked(text)
    for kind, m, end in _declared(clean, [("func", r"^func\s+(?:\((?:\w+\s+)?\*?(\w+)[^)]*\)\s*)?(\w+)\s*(?:\[[^\]]*\])?\(([^)]*)\)\s*(\([^)]*\)|[^{\n]*)"), ("type", r"^type\s+(\w+)\s+(struct|interface|=?\s*[^\s{]+)"), ("const", r"^const\s+(\w+)")]):
        if kind == "func":
            fqn = sink.symbol(m[2], "method" if m[1] else "function", _line(clean, m.start(2)), _line(clean, end), m[1], _signature(text, m.start(), end))
            for name in dict.fromkeys(re.findall(r"(?:\b\w+\.)?\b([A-Za-z_]\w*)\s*\(", clean[m.end() : end])):
                if name not in ("if", "for", "switch", "func", "return", "make", "len", "append", "panic", "new", "cap", "copy", "delete", "close"):
                    sink.edge(fqn, name, "calls")
            pieces = [p.split()[-1] if p.split() else "" for p in m[3].split(",")] + [p.split()[-1] if p.split() else "" for p in m[4].strip("() ").split(",")]
            for name in dict.fromkeys(filter(None, map(_go_type, pieces))):
                sink.edge(fqn, name, "uses_type")
        elif kind == "type":
            what = {"struct": "class", "interface": "interface"}.get(m[2], "type_alias")
            stop = end if what != "type_alias" else clean.find("\n", m.end())
            sink.symbol(m[1], what, _line(clean, m.start(1)), _line(clean, stop), None, _signature(text, m.start(), stop))
            if what == "interface":
                _members(sink, text, clean, m.start(1), end, m[1], [("method", r"^\s*([A-Z]\w*)\(")])
            if what == "class":
                _members(sink, text, clean, m.start(1), end, m[1], [("field", r"^\s*([A-Za-z_]\w*)\s+[\w*\[\]]")])
        else:
            sink.symbol(m[1], "constant", _line(clean, m.start(1)), _line(clean, m.start(1)), None, sink.lines[_line(clean, m.start(1)) - 1].strip())
    for block in re.findall(r"^import\s*(?:\(([^)]*)\)|(\"[^\"]+\"))", text, re.M):
        for name in re.findall(r'"([^"]+)"', "".join(block)):
            sink.edge(sink.path, name, "imports")


def _php(sink: _Sink, text: str) -> None:
    clean = re.sub(r"(?m)#[^\[\n][^\n]*", lambda m: " " * len(m[0]), blanked(text, quotes="\"'"))
    space = re.search(r"^\s*namespace\s+([\w\\]+)\s*[;{]", clean, re.M)
    full = lambda name: f"{space[1]}\\{name}" if space else name
    spans: list[tuple[int, int]] = []
    for kind, m, end in _declared(clean, [("class", r"^\s*(?:abstract\s+|final\s+|readonly\s+)*class\s+(\w+)"), ("trait", r"^\s*trait\s+(\w+)"), ("interface", r"^\s*interface\s+(\w+)"), ("function", r"^\s*function\s+&?(\w+)\s*\(")]):
        start = m.start(1)
        if any(a <= start <= b for a, b in spans):
            continue
        fqn = sink.symbol(full(m[1]), kind, _line(clean, start), _line(clean, end), None, _signature(text, text.rfind("\n", 0, start) + 1, end))
        if kind != "function":
            spans.append((start, end))
            _members(sink, text, clean, start, end, full(m[1]), [("method", r"^\s*(?:(?:public|private|protected|static|abstract|final)\s+)*function\s+&?(\w+)\s*\("), ("field", r"^\s*(?:(?:public|private|protected|static|readonly|var)\s+)+(?:\??[\w\\|]+\s+)?\$(\w+)")])
            for name in re.findall(r"^\s*use\s+([\w\\, ]+)[;{]", clean[start:end], re.M):
                for each in name.split(","):
                    sink.edge(fqn, each.strip().split("\\")[-1], "uses_trait")
        for hook, target in re.findall(r"\b(?:add_action|add_filter)\s*\(\s*['\"]([^'\"]+)['\"]\s*,\s*['\"](\w+)['\"]", text[start:end]):
            sink.edge(fqn, target, "hooks_into")
        for target in re.findall(r"\b(?:do_action|apply_filters)\s*\(\s*['\"]([^'\"]+)['\"]", text[start:end]):
            sink.edge(fqn, target, "fires_hook")
    for name in re.findall(r"^use\s+([\w\\]+)", clean, re.M):
        sink.edge(sink.path, name, "imports")


_PARSERS = {"python": _python, "typescript": _typescript, "tsx": _typescript, "javascript": _typescript, "jsx": _typescript, "rust": _rust, "go": _go, "php": _php}


def parse_file(path: str, text: str, language: str | None = None) -> tuple[list[tuple], list[tuple]]:
    """Symbols and references of a file; nothing for a language without a parser or text that does not parse."""
    language = language or LANGUAGES.get(path.rsplit(".", 1)[-1].lower())
    sink = _Sink(path, text.split("\n"))
    if language not in _PARSERS:
        return [], []
    try:
        _PARSERS[language](sink, text)
    except (SyntaxError, ValueError, RecursionError):
        return [], []
    return sink.symbols, sink.edges


_SYMBOL = "fqn string, name string, kind string, start_line int, end_line int, signature string, docstring string, source_hash string, parent_fqn string"
PARSED_SCHEMA = f"path string, symbols array<struct<{', '.join(': '.join(x.split()) for x in _SYMBOL.split(', '))}>>, edges array<struct<source: string, target: string, kind: string>>"


def _parse_batches(batches):
    import pandas as pd

    names = [x.split()[0] for x in _SYMBOL.split(", ")]
    for frame in batches:
        rows = []
        for path, text in zip(frame["path"], frame["text"]):
            symbols, edges = parse_file(path, text or "")
            rows.append((path, [dict(zip(names, s)) for s in symbols], [dict(zip(("source", "target", "kind"), e)) for e in edges]))
        yield pd.DataFrame(rows, columns=["path", "symbols", "edges"])


def parse(files: DataFrame) -> DataFrame:
    """Parsed files (path, text): path, symbols, edges."""
    return files.select("path", "text").mapInPandas(_parse_batches, PARSED_SCHEMA)


def symbols_of(parsed: DataFrame) -> DataFrame:
    """One row per symbol; of equal names in a file the first counts."""
    from lodestone.operators.structure import first_by

    each = parsed.select("path", F.posexplode("symbols").alias("at", "s")).select("path", "at", "s.*")
    return first_by(each, ["fqn"], "at").drop("at")


def edges_of(parsed: DataFrame) -> DataFrame:
    """References that are stored: imports are not."""
    return parsed.select("path", F.explode("edges").alias("e")).select("path", "e.*").where("kind <> 'imports'").distinct()
