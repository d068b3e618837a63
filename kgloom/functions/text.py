"""Expressions over texts: terms, overlap, trigrams, intents, normalisation, chunk and name predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, as results must be the same: stop words of queries, bibliographic relations, relations that graph search doesn't follow.
STOP = (
    "the", "and", "for", "are", "but", "not", "you", "all", "can", "has", "her", "was", "one", "our", "out", "how", "its", "may", "use", "who", "did", "get", "let",
    "say", "she", "too", "via", "from", "with", "this", "that", "what", "when", "will", "been", "have", "each", "make", "like", "does", "into", "them", "then", "than",
    "more", "some", "such", "also", "about", "which", "their", "would", "there", "these", "other", "could", "should",
)
BIBLIOGRAPHIC = ("authored", "published_in", "works_at", "has_preprint_id", "edited_by", "affiliated_with")
DENIED = ("authored", "published_in", "works_at", "evaluated_on", "trained_on", "uses_dataset", "created_by", "edited_by")


def any_of(*tests: Column) -> Column:
    return reduce(lambda a, b: a | b, tests)


def terms(text: Column) -> Column:
    """Query terms: lower-case words of three bytes or more that aren't stop words."""
    return F.filter(F.split(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))), " "), lambda w: (F.octet_length(w) >= 3) & ~w.isin(*STOP))


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(text, r"[ \t\n\r]+", " "), " "), "")


def overlap(a: Column, b: Column) -> Column:
    """Jaccard's coefficient of word sets; 0 if both are empty."""
    x, y = words(a), words(b)
    n = F.size(F.array_union(x, y))
    return F.when(n > 0, F.size(F.array_intersect(x, y)) / n).otherwise(0.0)


def update_class(score: Column) -> Column:
    return F.when(score >= 0.8, "correction").when(score < 0.2, "refactor").otherwise("versioned")


def trigrams(text: Column) -> Column:
    """The set of trigrams of each word, with two blanks before and one after it."""
    ws = F.array_remove(F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "), " "), "")
    of = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(ws, of)))


def similarity(a: Column, b: Column) -> Column:
    """Of trigram sets given as arrays."""
    n = F.size(F.array_union(a, b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(0.0)


def intent(text: Column) -> Column:
    """Which strategy a query's words ask for; substrings count, so that 'renewal' is recent."""
    low = F.lower(text)
    recent = any_of(*(low.contains(w) for w in ("last", "latest", "new", "recent", "today", "yesterday")))
    explore = any_of(*(low.contains(w) for w in ("connected to", "related to", "relationship between", "tell me about", "who is")))
    return F.when(recent, "recent").when(explore, "exploratory").otherwise("balanced")


def normalised(text: Column) -> Column:
    """Control characters go, blanks collapse (line feeds stay), ends are trimmed, blank lines collapse to one."""
    out = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    out = F.regexp_replace(F.regexp_replace(out, r"\r\n?", "\n"), r"[ \t]+", " ")
    out = F.regexp_replace(out, r" *\n *", "\n")
    return F.trim(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def unmarked(text: Column) -> Column:
    """Without inline Markdown: emphasis, code, links."""
    out = F.regexp_replace(text, r"\[([^\]]*)\]\([^)]*\)", "$1")
    return F.regexp_replace(out, r"[*_`]+", "")


def unnumbered(heading: Column) -> Column:
    return F.regexp_replace(heading, r"^[0-9]+(\.[0-9]+)*\.?\s+", "")


def label(text: Column) -> Column:
    """For a path: all but letters and digits becomes an underscore."""
    return F.regexp_replace(F.lower(text), r"[^a-z0-9]", "_")


def decoded(text: Column) -> Column:
    """HTML entities as characters."""
    out = text
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def unfenced(text: Column) -> Column:
    """Without a code fence around the whole."""
    return F.regexp_replace(F.trim(text), r"(?s)^```[a-z]*\n(.*?)\n?```$", "$1")


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.trim(x)), lambda x: x != "")


def metadata_only(text: Column) -> Column:
    solid = F.length(F.regexp_replace(text, r"\s", ""))
    labels = F.forall(_lines(text), lambda x: x.rlike(r"^\*\*.*:\*\*") | (x.rlike(r"^\[[0-9]{4}") & (F.octet_length(x) < 20)))
    return (solid < 30) | ((F.octet_length(F.trim(text)) < 80) & labels)


# Fixed values, as results must be the same: what lines of scraped pages hold that are no text, and headings whose chunks go.
PAGE_FURNITURE = (
    "view pdf", "view a pdf", "html (experimental)", "cite as:", "subjects:", "comments:", "download pdf", "download:", "bibtex", "submission history", "< prev", "next >",
    "report issue for preceding element", "report github issue", "submit without github", "submit in github", "content selection saved", "back to arxiv", "back to abstract",
    "why html?", "tex source", "view license", "browse context", "current browse context", "change to browse by",
)
ARTIFACT_HEADINGS = ("report issue for preceding element",)


def artifact_heading(path: Column) -> Column:
    """Whether a heading path (array) has a heading that only scraping leaves."""
    return F.exists(path, lambda h: any_of(*(F.lower(h).contains(a) for a in ARTIFACT_HEADINGS)))


def boilerplate_line(line: Column) -> Column:
    low = F.lower(line)
    short = F.octet_length(line) < 15
    return any_of(*(low.contains(p) for p in PAGE_FURNITURE), line.rlike(r"^\*\*.*:\*\*"), short & low.rlike(r"(:|\.\.\.)$"), line.rlike(r"^[0-9.]*\s*\[.*\]\(.*://"), (F.octet_length(line) <= 3) & ~line.rlike(r"\p{L}"), short & line.rlike(r"^\|*\s*[0-9]{4}-[0-9]{2}"))


def boilerplate_heavy(text: Column) -> Column:
    ls = _lines(text)
    return (F.size(ls) > 0) & (F.size(F.filter(ls, boilerplate_line)) >= 0.6 * F.size(ls))


MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]"


def author_block(text: Column) -> Column:
    ls = _lines(text)
    mails = F.size(F.filter(ls, lambda x: x.rlike(MAIL)))
    early = F.exists(F.slice(ls, 1, 6), lambda x: x.rlike(MAIL)) & F.exists(ls, lambda x: x.startswith("#"))
    return F.lower(F.trim(text)).rlike(r"^authors?:") | ((F.size(ls) >= 2) & (mails >= 0.4 * F.size(ls))) | early


CITATION = r"^\[[0-9]+\]|^[0-9]+\. [A-Z]\.|doi\.org/|arXiv:[0-9]{4}|\((19|20)[0-9]{2}[a-z]?\)\.|et al\.,? (19|20)[0-9]{2}|^- [A-Z][a-z]+, [A-Z]\."


def bibliography_entry(text: Column) -> Column:
    return (F.length(text) <= 300) & F.trim(text).rlike(CITATION)


def reference_section(text: Column) -> Column:
    ls = _lines(text)
    return (F.length(text) >= 300) & (F.size(ls) >= 5) & (F.size(F.filter(ls, lambda x: x.rlike(CITATION))) > 0.3 * F.size(ls))


def title_only(text: Column) -> Column:
    ls = F.filter(_lines(text), lambda x: x.rlike(r"[\p{L}\p{N}]"))
    return (F.size(ls) <= 1) | ((F.size(ls) == 2) & (F.octet_length(F.element_at(F.concat(ls, F.array(F.lit(""), F.lit(""))), 2)) < 30))


def trivial_code(text: Column) -> Column:
    code = F.trim(F.regexp_replace(text, r"(?m)^\s*(//|#|/\*).*$", ""))
    return code.rlike(r"^(pub )?(mod|use|import|from|package|#include)\b[^\n]*$") | (F.length(F.regexp_replace(code, r"[\s{}();]", "")) < 10)


#: Names that say too little to be entities.
GENERIC = tuple("approach area class code content data document example figure file function input item list method model name number object output page paper part problem result section set source step string system table text thing type user value variable work".split())
SHORT_NAMES = ("AI", "C", "CI", "DB", "Go", "IO", "ML", "OS", "R", "UI")
PRIMITIVES = tuple("bool boolean char double f32 f64 float i32 i64 int integer none null str u32 u64 u8 undefined void".split())


def noise_name(name: Column) -> Column:
    """Whether a name can't be that of an entity."""
    n, low = F.trim(name), F.lower(F.trim(name))
    # Most names are letters, digits and blanks, of which the rules for signs can't be true.
    few = [(F.length(n) <= 2) & ~n.isin(*SHORT_NAMES), low.isin(*PRIMITIVES, *GENERIC), F.length(n) > 120, n.rlike(r"^(?:[0-9]+$|(?:section|figure|table|chapter|eq) [0-9])"), low.rlike(r"^(?:(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]* [0-9]{1,4}|(?:the|this|that|these|those|our|their) \w+)$")]
    every = any_of(
        n == "", n.contains("\n"), n.rlike(r"</?[a-z]+[^>]*>"), n.rlike(r"^\W+$"), (F.length(n) <= 2) & ~n.isin(*SHORT_NAMES), low.isin(*PRIMITIVES), low.isin(*GENERIC), low.rlike(r"^(https?|ftp)://|^www\."), n.rlike(MAIL),
        n.rlike(r"^[+-]?[0-9][0-9.,%]*$"), n.rlike(r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), low.rlike(r"^(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]* [0-9]{1,4}$"), n.rlike(r"[{};=]|->|=>|::<|\(\)$"), n.rlike(r"^\$.*\$$|\\[a-z]+\{"),
        low.rlike(r"^(how|what|when|where|which|who|why) .*\?$"), low.rlike(r"^(the|this|that|these|those|our|their) \w+$"), F.length(n) > 120, n.rlike(r"^(section|figure|table|chapter|eq\.?) [0-9]"), n.rlike(r"^[._/]|/.*/.*\.[a-z]{1,4}$"),
    )
    return F.when(n.rlike(r"^[A-Za-z0-9][A-Za-z0-9 ]*\z"), any_of(*few)).otherwise(every)


# Fixed values, as results must be the same: node types that are code.
CODE = ("function", "struct", "trait", "enum", "impl_block", "constant", "module", "class", "macro", "code_function", "code_struct", "code_trait", "code_module", "code_impl", "code_type", "code_test")


def entity_class(node_type: Column, domain: Column | None = None) -> Column:
    """Code of a source that isn't code is a mention, so of class domain."""
    code = F.lit(True) if domain is None else F.coalesce(domain == "code", F.lit(True))
    return F.when(node_type.isin(*CODE), F.when(code, "code").otherwise("domain")).when(node_type.isin("person", "organization", "location", "role"), "actor").when(node_type == "component", "analysis").otherwise("domain")


def failure(error: Column) -> Column:
    low = F.lower(F.coalesce(error, F.lit("")))
    return F.when(low.rlike("429|rate limit|quota|too many requests"), "rate_limit").when(low.rlike("not found|invalid|unsupported|constraint|parse"), "permanent").otherwise("transient")


def backoff(kind: Column, attempt: Column, base: float = 30.0, cap: float = 7200.0) -> Column:
    """Seconds until the next attempt."""
    double = F.pow(F.lit(2.0), attempt - 1)
    return F.when(kind == "permanent", 0.0).when(kind == "rate_limit", F.least(900 * double, F.lit(cap))).otherwise(F.least(base * double, F.lit(cap)))
