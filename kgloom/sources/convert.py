"""Turning what comes in (HTML, Markdown, code) into text, and reading its metadata. Expressions where they will do."""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

_GONE = ("script", "style", "nav", "header", "footer", "aside", "noscript")
# Classes of divisions that are no content.
_DIVS = ("cookie", "consent", "gdpr", "banner", "advert", "sidebar", "social-share", "related-posts", "comments")
#: (pattern, replacement), in order; both Java and RE2 read them alike.
HTML_STEPS = (
    *((rf"(?is)<{t}\b[^>]*>.*?</{t}>", " ") for t in _GONE), (r"(?s)<!--.*?-->", ""), (rf"(?is)<div[^>]*class=\"[^\"]*({'|'.join(_DIVS)})[^\"]*\"[^>]*>.*?</div>", " "),
    *((rf"(?i)<h{n}\b[^>]*>", "\n\n" + "#" * n + " ") for n in (1, 2, 3, 4)), (r"(?i)</h[1-6]>", "\n\n"), (r"(?i)<li\b[^>]*>", "\n- "), (r"(?i)<br\s*/?>", "\n"), (r"(?i)</?(p|div|article|section|ul|ol|table|tr|main|body|html|head)\b[^>]*>", "\n\n"), (r"(?is)<title\b[^>]*>.*?</title>", ""), (r"<[^>]*>", ""),
)
TIDY_STEPS = ((r"[ \t]+", " "), (r" *\n *", "\n"), (r"\n{3,}", "\n\n"))


def strip_html(html: Column) -> Column:
    """The text of a page, with headings and lists as Markdown; no navigation, scripts, consent or advert boxes."""
    out = html
    for pattern, new in HTML_STEPS:
        out = F.regexp_replace(out, pattern, new)
    out = T.decoded(out)
    for pattern, new in TIDY_STEPS:
        out = F.regexp_replace(out, pattern, new)
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"^\n+", ""), r"\n+$", ""))


def is_html(content: Column) -> Column:
    start = F.lower(F.substring(F.regexp_replace(content, r"^[\s﻿]+", ""), 1, 14))
    return start.startswith("<!doctype") | start.startswith("<html")


def html_title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def meta_content(html: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(html, rf"(?i)<meta[^>]+(?:name|property)=\"{name}\"[^>]+content=\"([^\"]*)\"", 1), F.lit(""))


def source_type_of(url: Column) -> Column:
    low, host = F.lower(url), F.lower(F.parse_url(url, F.lit("HOST")))
    return F.when(host.rlike(r"(^|\.)(github|gitlab)\."), "code").when(host.rlike(r"(^|\.)(twitter|x|reddit|slack)\.com$"), "conversation").when(low.rlike(r"\.pdf(\?|#|$)") | host.rlike(r"(^|\.)arxiv\."), "document").when(low.contains("/api/"), "api").when(low.rlike(r"/(docs|manual)/"), "manual").otherwise("web_page")


def heading_title(markdown: Column) -> Column:
    return F.nullif(F.regexp_extract(markdown, r"(?m)^# (.+)$", 1), F.lit(""))


def converted(content: Column, mime: Column) -> Column:
    """By MIME type without its parameters, any case; HTML by sniffing where the type says nothing. Null for what no converter takes, or leaves empty."""
    kind = F.lower(F.trim(F.split(F.coalesce(mime, F.lit("")), ";").getItem(0)))
    plain = kind.isin("text/plain", "text/markdown", "text/x-markdown", "")
    out = F.when(kind.isin("text/html", "application/xhtml+xml") | ((kind == "") & is_html(content)), strip_html(content)).when(plain, content)
    return F.nullif(F.trim(out), F.lit(""))


def linearised(markdown: str | None) -> str | None:
    """Tables as sentences: 'header: value, ...' a row; 'Column n' without a header."""
    if markdown is None or "|" not in markdown:
        return markdown
    out, rows = [], []

    def cells(line: str) -> list[str]:
        return [c.strip() for c in line.strip().strip("|").split("|")]

    def flush() -> None:
        if not rows:
            return
        head = len(rows) > 1 and all(re.fullmatch(r":?-{1,}:?", c) for c in cells(rows[1]))
        names = cells(rows[0]) if head else []
        for r in rows[2 if head else 0 :]:
            pairs = [f"{names[k] if k < len(names) and names[k] else f'Column {k + 1}'}: {c}" for k, c in enumerate(cells(r)) if c]
            if pairs:
                out.append(", ".join(pairs) + ".")
        rows.clear()

    for line in markdown.split("\n"):
        s = line.strip()
        if len(s) > 2 and s[0] == "|" and s[-1] == "|":
            rows.append(s)
        else:
            flush()
            out.append(line)
    flush()
    return "\n".join(out)


def linearise(markdown: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(linearised, na_action="ignore")

    return run(markdown)


def html_windows(html: str, most: int = 8000) -> list[str]:
    """Parts of at most ``most`` characters, cut before section, article, div, main or a heading where one is near."""
    cuts = [m.start() for m in re.finditer(r"(?i)<(?:section|article|div|main|h[1-3])\b", html)] + [len(html)]
    out, begin = [], 0
    while begin < len(html):
        if len(html) - begin <= most:
            end = len(html)
        else:
            end = max((c for c in cuts if begin < c <= begin + most), default=begin + most)
        out.append(html[begin:end])
        begin = end
    return out


def split_html(pages: DataFrame, most: int = 8000) -> DataFrame:
    """page_id, window, html."""

    @F.pandas_udf("array<string>")
    def windows(s: pd.Series) -> pd.Series:
        return s.map(lambda x: html_windows(x or "", most))

    return pages.select("page_id", F.posexplode(windows("html")).alias("window", "html"))


_TOP = {"rust": r"^(pub )?(fn|struct|enum|trait|impl|mod|const)\b", "go": r"^(func|type|const|var)\b", "typescript": r"^(export )?(default )?(function|class|interface|type|const)\b", "javascript": r"^(export )?(default )?(function|class|const)\b", "java": r"^\s{0,4}(public|private|protected|class|interface|enum)\b", "c": r"^[a-zA-Z_][\w\s*]*\([^;]*$|^(struct|typedef|enum)\b"}


def code_to_markdown(source: str, language: str) -> str:
    """Top-level items as headed, fenced blocks: by syntax for Python, by the shape of lines for others."""
    lines, starts = source.split("\n"), []
    if language == "python":
        try:
            for node in ast.parse(source).body:
                if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                    first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
                    starts.append((first - 1, f"{'class' if isinstance(node, ast.ClassDef) else 'function'} {node.name}"))
        except SyntaxError:
            pass
    else:
        starts = [(k, x.strip().rstrip("{ ")) for k, x in enumerate(lines) if re.match(_TOP.get(language, r"^\b$"), x)]
    fence = lambda body: f"```{language}\n{body.strip(chr(10))}\n```"
    if not starts:
        return f"# Source\n\n{fence(source)}"
    out = [fence("\n".join(lines[: starts[0][0]]))] if "".join(lines[: starts[0][0]]).strip() else []
    for (k, label), end in zip(starts, [*(s for s, _ in starts[1:]), len(lines)], strict=True):
        out.append(f"# {label}\n\n{fence(chr(10).join(lines[k:end]))}")
    return "\n\n".join(out)


def markdown_of(code: Column, language: Column) -> Column:
    @F.arrow_udf("string")
    def run(texts: pa.Array, languages: pa.Array) -> pa.Array:
        return pa.array([code_to_markdown(t or "", lang or "") for t, lang in zip(texts.to_pylist(), languages.to_pylist(), strict=True)], pa.string())

    return run(code, language)


def manifest(text: str) -> dict[str, list]:
    """An extension's ontology from its manifest in JSON: entity types, relations, rules, views, noise patterns; absent parts are empty."""
    data = json.loads(text)
    return {k: list(data.get(k, [])) for k in ("entity_types", "relationships", "domain_rules", "views", "noise_patterns")} | {"name": data["name"]}
