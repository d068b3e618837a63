"""Entities and relations of source code: by syntax for Python, by the shape of lines for other languages."""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: By language: (type of entity, expression of its first line; group 1 is the name).
SHAPES = {
    "rust": (
        ("function", r"^\s*(?:pub(?:\([a-z]+\))?\s+)?(?:async\s+|const\s+|unsafe\s+)*fn\s+(\w+)"), ("struct", r"^\s*(?:pub(?:\([a-z]+\))?\s+)?struct\s+(\w+)"), ("enum", r"^\s*(?:pub(?:\([a-z]+\))?\s+)?enum\s+(\w+)"),
        ("trait", r"^\s*(?:pub(?:\([a-z]+\))?\s+)?trait\s+(\w+)"), ("module", r"^\s*(?:pub\s+)?mod\s+(\w+)\s*[;{]"), ("constant", r"^\s*(?:pub\s+)?(?:const|static)\s+(\w+)\s*:"), ("macro", r"^\s*macro_rules!\s+(\w+)"),
    ),
    "go": (("function", r"^func\s+(?:\([^)]*\)\s*)?(\w+)"), ("struct", r"^type\s+(\w+)\s+struct\b"), ("interface", r"^type\s+(\w+)\s+interface\b"), ("constant", r"^const\s+(\w+)")),
    "java": (("class", r"^\s*(?:(?:public|private|protected|static|final|abstract)\s+)*class\s+(\w+)"), ("interface", r"^\s*(?:(?:public|private|protected|static)\s+)*interface\s+(\w+)"), ("enum", r"^\s*(?:(?:public|private|protected|static)\s+)*enum\s+(\w+)")),
    "javascript": (("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)"), ("class", r"^\s*(?:export\s+)?(?:default\s+)?class\s+(\w+)"), ("constant", r"^(?:export\s+)?const\s+(\w+)")),
    "c": (("struct", r"^\s*(?:typedef\s+)?struct\s+(\w+)\s*\{"), ("enum", r"^\s*(?:typedef\s+)?enum\s+(\w+)\s*\{"), ("macro", r"^#define\s+(\w+)"), ("function", r"^(?!\s)(?!(?:return|else|typedef|struct|enum)\b)[\w*\s]+?\b(\w+)\s*\([^;]*\)\s*\{")),
}
SHAPES["typescript"] = (*SHAPES["javascript"], ("interface", r"^\s*(?:export\s+)?interface\s+(\w+)"), ("enum", r"^\s*(?:export\s+)?enum\s+(\w+)"), ("type", r"^\s*(?:export\s+)?type\s+(\w+)\s*="))
#: By language: expressions of relations; groups 1 and 2 are the ends, or 1 alone the target for the file.
LINKS = {
    "rust": (("implements", r"^\s*impl(?:<[^>]*>)?\s+(\w+)(?:<[^>]*>)?\s+for\s+(\w+)", True), ("imports", r"^\s*(?:pub\s+)?use\s+([\w:]+)", False)),
    "go": (("imports", r'^\s*(?:import\s+)?"([\w./-]+)"', False),),
    "java": (("extends", r"\bclass\s+(\w+)\s+extends\s+(\w+)", False), ("implements", r"\bclass\s+(\w+)(?:\s+extends\s+\w+)?\s+implements\s+(\w+)", False), ("imports", r"^import\s+([\w.]+)", False)),
    "javascript": (("extends", r"\bclass\s+(\w+)\s+extends\s+(\w+)", False), ("imports", r"""^import\b.*?from\s+['"]([^'"]+)""", False)),
    "c": (("imports", r'^#include\s+[<"]([^>"]+)', False),),
}
LINKS["typescript"] = (*LINKS["javascript"], ("implements", r"\bclass\s+(\w+)(?:\s+extends\s+\w+)?\s+implements\s+(\w+)", False))


def unfenced(text: str) -> str:
    """The code of a Markdown text's fences; a text without fences is code itself."""
    parts = re.findall(r"(?ms)^```[^\n]*\n(.*?)^```", text)
    return "\n".join(parts) if parts else text


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _python(code: str, file: str) -> tuple[list[tuple], list[tuple]]:
    entities, links = [], []

    def called(node: ast.AST) -> set[str]:
        return {n.func.id if isinstance(n.func, ast.Name) else n.func.attr for n in ast.walk(node) if isinstance(n, ast.Call) and isinstance(n.func, (ast.Name, ast.Attribute))}

    def visit(body: list[ast.stmt], owner: str | None) -> None:
        for n in body:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                name = f"{owner}.{n.name}" if owner else n.name
                entities.append((name, "function", n.lineno, _digest(ast.dump(n))))
                links.extend((name, c, "calls") for c in sorted(called(n)))
            elif isinstance(n, ast.ClassDef):
                entities.append((n.name, "class", n.lineno, _digest(ast.dump(n))))
                links.extend((n.name, b.id if isinstance(b, ast.Name) else b.attr, "extends") for b in n.bases if isinstance(b, (ast.Name, ast.Attribute)))
                links.extend((n.name, f"{n.name}.{m.name}", "contains") for m in n.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef)))
                visit(n.body, n.name)
            elif isinstance(n, ast.Import):
                links.extend((file, a.name, "imports") for a in n.names)
            elif isinstance(n, ast.ImportFrom):
                links.append((file, "." * n.level + (n.module or ""), "imports"))

    visit(ast.parse(code).body, None)
    return entities, links


def extract(text: str, language: str, file: str = "") -> tuple[list[tuple], list[tuple]]:
    """Entities (name, type, line, hash of the item) and relations (source, target, type) of a text; none for other languages or broken Python."""
    code = unfenced(text)
    if language == "python":
        try:
            return _python(code, file)
        except (SyntaxError, ValueError, RecursionError):
            return [], []
    lines, at = code.split("\n"), []
    for k, line in enumerate(lines):
        for kind, shape in SHAPES.get(language, ()):
            if m := re.match(shape, line):
                at.append((k, m[1], kind))
                break
    ends = [*(k for k, _, _ in at[1:]), len(lines)][: len(at)]
    entities = [(name, kind, k + 1, _digest("\n".join(lines[k:end]).strip())) for (k, name, kind), end in zip(at, ends, strict=True)]
    links = []
    for line in lines:
        for kind, shape, swapped in LINKS.get(language, ()):
            if m := re.search(shape, line):
                a, b = (m[2], m[1]) if swapped else (m[1], m[2]) if m.re.groups > 1 else (file, m[1])
                links.append((a, b, kind))
    names = {name for name, _, _, _ in entities}
    for (k, name, kind), end in zip(at, ends, strict=True):
        if kind == "function":
            said = set(re.findall(r"\b(\w+)\s*\(", "\n".join(lines[k:end])))
            links.extend((name, c, "calls") for c in sorted(said & names - {name}))
    return entities, links


def entities_of(files: DataFrame) -> DataFrame:
    """id, name, node_type, line, ast_hash of files (id, language, text)."""
    return _extracted(files, 0, ["name", "node_type", "line", "ast_hash"], [pa.string(), pa.string(), pa.int64(), pa.string()], "name string, node_type string, line long, ast_hash string")


def relations_of(files: DataFrame) -> DataFrame:
    """id, source, target, rel_type of files (id, language, text)."""
    return _extracted(files, 1, ["source", "target", "rel_type"], [pa.string()] * 3, "source string, target string, rel_type string")


def _extracted(files: DataFrame, which: int, names: list[str], types: list[pa.DataType], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *x) for i, lang, t in zip(*(c.to_pylist() for c in b.columns), strict=True) for x in extract(t or "", lang or "", str(i))[which]]
            cols = list(zip(*rows, strict=True)) or [()] * (len(names) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), *types], strict=True)], names=["id", *names])

    from pyspark.sql import functions as F

    return files.select(F.col("id").cast("long").alias("id"), "language", "text").mapInArrow(run, "id long, " + schema)
