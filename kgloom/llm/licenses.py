"""Operator 8: licence scans by Dice coefficient over word bigrams, in SQL expressions only.

A text is normalised (lower case, all but letters and digits becomes a blank) and taken line by line, as notices stand in
lines of longer texts; ``line`` 0 is the whole text. A unit is compared with the templates by Dice's coefficient of
their sets of word bigrams, and the best template of ``LEAST`` or more is its licence. Two bounds, both without loss, come first:

* size: 2|A∩B| / (|A|+|B|) >= t needs |A| between t/(2-t) and (2-t)/t times |B|, so a unit of other sizes has no candidates;
* shared: for the same reason at least t/(2-t) of |A| must be bigrams of some template, whichever it is.

Few units pass both, and only these are compared with the templates whose size bounds they meet. Before that a text must
hold a cue, one of a few words chosen from the templates: of each, fewer than t/(2-t) of the bigrams are without a cue, so
that a unit within t of it has one. This is without loss too.

Runs of adjacent lines (blank ones apart) are units too, as notices are wrapped. A run counts where it is nearer to its template than
any of its lines is to one; of runs that share lines the nearest counts, of equally near ones the longest. Its hit has the first and ``last`` line. Runs are looked at
only in texts that hold t/(2-t) of some template's bigrams, which each run within t must.

Defined results: a null or empty text has no licences; ties go to the first template by name; repeated rows are scanned each
for itself; a null doc_id is carried along; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table
from .license_texts import TEMPLATES
from .quality import STOP_WORDS

LEAST = 0.8
NOT_WORD = r"[^\p{L}\p{N}\n]+"


def bigrams_of(text: str) -> list[str]:
    words = re.findall(r"[^\W_]+", text.lower())
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def cues(known: dict[str, list[str]], share: float) -> list[str]:
    """Words such that of each template fewer than ``share`` of the bigrams are without one; long words first, as they are rarer, function words last."""
    left = {k: [b.split(" ") for b in bs] for k, bs in known.items()}
    short = lambda: {k: bs for k, bs in left.items() if len(bs) >= share * len(known[k]) - 1e-9}
    out = []
    while todo := short():
        words = {w for bs in todo.values() for b in bs for w in b}
        gain = lambda w: sum(sum(w in b for b in bs) / len(known[k]) for k, bs in todo.items())
        best = max(sorted(words), key=lambda w: (len(w) >= 6, w not in STOP_WORDS and not w.isdigit(), gain(w)))
        out.append(best)
        left = {k: [b for b in bs if best not in b] for k, bs in left.items()}
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """doc_id, hits (array of line, last, license, dice; line 0: the whole text; line < last: a run of lines), in order of lines."""
    known = {k: bigrams_of(v) for k, v in sorted((templates or TEMPLATES).items())}
    share = least / (2 - least)
    low, high = min(map(len, known.values())) * share, max(map(len, known.values())) / share
    every = sorted({b for bs in known.values() for b in bs})

    def best(a: Column) -> Column:
        """(dice, license) of the best template for the bigrams ``a``."""
        scored = [
            F.when(
                F.size(a).between(int(len(b) * share), int(len(b) / share) + 1),
                F.struct((-2.0 * F.size(F.array_intersect(a, F.lit(b))) / (F.size(a) + len(b))).alias("minus"), F.lit(k).alias("license")),
            )
            for k, b in known.items()
        ]
        return F.array_min(F.filter(F.array(*scored), lambda x: x.isNotNull()))

    def pairs_of(words: Column) -> Column:
        return F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words)), lambda x, y: F.concat(x, F.lit(" "), y))

    known_of = lambda a: F.filter(a, lambda x: x.isin(*every))

    def of_set(a: Column) -> Column:
        return F.when(F.size(a).between(int(low), int(high) + 1) & (F.size(known_of(a)) >= share * F.size(a) - 1e-9), best(a))

    def of_words(words: Column) -> Column:
        return F.when(F.size(words) >= 2, let(pairs_of(words), lambda pairs: F.when(F.size(known_of(pairs)) > 0, let(F.array_distinct(pairs), of_set))))

    def of_unit(unit: Column) -> Column:
        words = F.array_remove(F.split(unit, " ", -1), "")
        return let(words, of_words)

    plain = F.col("_plain")
    lines = F.transform(F.split(plain, "\n", -1), lambda x, k: F.struct((k + 1).alias("line"), x.alias("unit")))
    # The whole text is a unit of its own only if it has several lines. A text with far more characters than its candidates'
    # size allows could still have few distinct bigrams, so that its size is taken from the bigrams, not from the text.
    whole = F.when(F.instr(plain, "\n") > 0, F.array(F.struct(F.lit(0).alias("line"), F.replace(plain, F.lit("\n"), F.lit(" ")).alias("unit")))).otherwise(F.expr("cast(array() as array<struct<line:int,unit:string>>)"))
    units = F.concat(whole, lines)
    scored = F.transform(units, lambda u: F.struct(u["line"].alias("line"), of_unit(u["unit"]).alias("best")))
    hits = F.transform(
        F.filter(scored, lambda x: F.coalesce(-x["best"]["minus"] >= least - 1e-9, F.lit(False))),
        lambda x: F.struct(x["line"].alias("line"), x["line"].alias("last"), x["best"]["license"].alias("license"), F.round(-x["best"]["minus"], 6).alias("dice")),
    )
    found = "array<struct<minus:double,fewer:int,line:int,last:int,license:string>>"

    def runs_from(rows: Column, k: Column) -> Column:
        """The runs from the ``k``-th row on that are near a template. A run only gains bigrams, so that it ends at the size bound."""

        def longer(state: Column, row: Column) -> Column:
            words = F.when(state["prev"].isNull(), row["words"]).otherwise(F.concat(F.array(state["prev"]), row["words"]))

            def taken(a: Column) -> Column:
                near = F.when(~state["prev"].isNull(), of_set(a))
                more = let(near, lambda b: F.when(F.coalesce(-b["minus"] >= least - 1e-9, F.lit(False)), F.array(F.struct(b["minus"].alias("minus"), (-1 - state["lines"]).alias("fewer"), state["line"].alias("line"), row["line"].alias("last"), b["license"].alias("license")))).otherwise(F.expr(f"cast(array() as {found})")))
                return F.struct(F.element_at(row["words"], -1).alias("prev"), a.alias("set"), (state["lines"] + 1).alias("lines"), F.coalesce(state["line"], row["line"]).alias("line"), F.concat(state["found"], more).cast(found).alias("found"))

            return F.when(F.size(state["set"]) > int(high) + 1, state).otherwise(let(F.array_union(state["set"], pairs_of(words)), taken))

        first = F.expr(f"cast(struct(null, array(), 0, null, array()) as struct<prev:string,set:array<string>,lines:int,line:int,found:{found}>)")
        return F.aggregate(F.slice(rows, k, F.size(rows)), first, longer, lambda state: state["found"])

    def apart(runs: Column) -> Column:
        """The nearest runs (of equals the longest, then the first) that share no line."""
        pick = lambda kept, x: F.when(F.exists(kept, lambda y: (y["line"] <= x["last"]) & (x["line"] <= y["last"])), kept).otherwise(F.concat(kept, F.array(x)).cast(found))
        return F.aggregate(F.array_sort(runs), F.expr(f"cast(array() as {found})"), pick)

    def runs_of(rows: Column, hits: Column, n: Column) -> Column:
        # Without a first row that has no known bigram a run is nearer to its template, so that none begins there.
        after = lambda k: F.when(k < F.size(rows), F.slice(F.element_at(rows, k + 1)["words"], 1, 1)).otherwise(F.expr("cast(array() as array<string>)"))
        starts = F.filter(F.sequence(F.lit(1), F.size(rows) - 1), lambda k: F.exists(pairs_of(F.concat(F.element_at(rows, k)["words"], after(k))), lambda x: x.isin(*every)))
        runs = F.flatten(F.transform(starts, lambda k: runs_from(rows, k)))
        beaten = lambda x: F.exists(hits, lambda h: h["line"].between(x["line"], x["last"]) & (h["dice"] >= F.round(-x["minus"], 6)))
        whole = lambda x: x["fewer"] == -n
        left = F.filter(runs, lambda x: ~beaten(x) & ~whole(x))
        return F.transform(apart(left), lambda x: F.struct(x["line"].alias("line"), x["last"].alias("last"), x["license"].alias("license"), F.round(-x["minus"], 6).alias("dice")))

    def held(rows: Column) -> Column:
        """Whether all rows together hold as much of some template as a run must."""
        enough = lambda a: F.exists(F.array(*(F.size(F.array_intersect(a, F.lit(b))) >= share * len(b) - 1e-9 for b in known.values())), lambda x: x)
        of_known = lambda a: F.when(F.size(a) >= share * min(map(len, known.values())) - 1e-9, enough(a)).otherwise(False)
        return let(F.flatten(F.transform(rows, lambda x: x["words"])), lambda w: F.when(F.size(w) >= 2, let(known_of(pairs_of(w)), of_known)).otherwise(False))

    def with_runs(hits: Column) -> Column:
        words = lambda x: F.array_remove(F.split(x, " ", -1), "")
        rows = F.filter(F.transform(F.split(plain, "\n", -1), lambda x, k: F.struct((k + 1).alias("line"), words(x).alias("words"))), lambda x: F.size(x["words"]) > 0)
        # No run is nearer than a line that is a whole template, so that none holds such a line.
        free = lambda rows: F.filter(rows, lambda x: ~F.exists(hits, lambda h: (h["line"] == x["line"]) & (h["dice"] >= 1)))
        of_free = lambda rows, n: F.when((F.size(rows) >= 2) & held(rows), F.array_sort(F.concat(hits, runs_of(rows, hits, n)))).otherwise(hits)
        of_rows = lambda rows: F.when(F.size(rows) >= 3, let(free(rows), lambda x: of_free(x, F.size(rows)))).otherwise(hits)
        return F.when(F.instr(plain, "\n") > 0, let(rows, of_rows)).otherwise(hits)

    # A cue is of letters and digits, so that the text holds it if its normal form does. Short ones must stand alone.
    held_cue = lambda c: F.contains("_lower", F.lit(c)) if len(c) >= 5 else F.col("_lower").rlike(rf"(?<![\p{{L}}\p{{N}}]){c}(?![\p{{L}}\p{{N}}])")
    lower = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("_lower"))
    cued = reduce(lambda a, b: a | b, (held_cue(c) for c in few)) if len(few := cues(known, share)) <= 64 else F.lit(True)
    plains = lower.select("doc_id", F.when(cued, F.regexp_replace("_lower", NOT_WORD, " ")).alias("_plain"))
    none = F.expr("cast(array() as array<struct<line:int,last:int,license:string,dice:double>>)")
    return plains.select("doc_id", F.when(plain.isNull(), none).otherwise(let(hits, with_runs)).alias("hits"))


def op8_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = scan(table(spark, sf_dir, "documents"))
    lines = F.array_join(F.transform("hits", lambda x: F.concat_ws(":", F.when(x["line"] < x["last"], F.concat_ws("-", x["line"], x["last"])).otherwise(x["line"].cast("string")), x["license"], F.format_number(x["dice"], 4))), ",")
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("hits", lambda x: x["license"]))), ",")
    return hits.select("doc_id", F.size("hits").cast("long").alias("n_hits"), names.alias("licenses"), lines.alias("hits"))


_KNOWN = ", ".join(f"('{k}', '{b}')" for k, v in TEMPLATES.items() for b in bigrams_of(v))
ORACLE = rf"""
WITH known(license, b) AS (VALUES {_KNOWN}),
sizes AS (SELECT license, count(*) AS n FROM known GROUP BY license),
d AS (SELECT row_number() OVER () AS k, doc_id, regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') AS t FROM documents),
u AS (
  SELECT k, 0 AS line, replace(t, chr(10), ' ') AS unit FROM d WHERE contains(t, chr(10))
  UNION ALL SELECT k, i AS line, string_split(t, chr(10))[i] AS unit FROM (SELECT k, t, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM d)),
w AS (SELECT k, line, list_filter(string_split(unit, ' '), lambda x: x <> '') AS words FROM u),
b AS (SELECT DISTINCT k, line, words[i] || ' ' || words[i+1] AS b FROM (SELECT k, line, words, unnest(range(1, len(words))) AS i FROM w)),
n AS (SELECT k, line, count(*) AS n FROM b GROUP BY k, line),
c AS (SELECT k, line, license, count(*) AS shared FROM b JOIN known USING (b) GROUP BY ALL),
s AS (SELECT k, line, license, 2.0 * shared / (n.n + sizes.n) AS dice FROM c JOIN n USING (k, line) JOIN sizes USING (license)),
h AS (SELECT *, row_number() OVER (PARTITION BY k, line ORDER BY dice DESC, license) AS r FROM s WHERE dice >= {LEAST} - 1e-9)
SELECT doc_id, count(h.k) AS n_hits,
       coalesce(array_to_string(list_sort(list_distinct(list(license) FILTER (license IS NOT NULL))), ','), '') AS licenses,
       coalesce(string_agg(line || ':' || license || ':' || printf('%.4f', dice), ',' ORDER BY line), '') AS hits
FROM d LEFT JOIN (SELECT * FROM h WHERE r = 1) h USING (k) GROUP BY d.k, doc_id
"""
