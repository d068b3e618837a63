"""Jobs and edits over the graph's frames: corrections with an audit, reprocessing, per-chunk entities, summaries, delivery, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.lineage import dealt, without
from . import memory, retrieve

#: What the definition of a node looks like in code, by type; other types are looked for by name alone.
DEFINED_BY = {"function": "fn ", "struct": "struct ", "enum": "enum ", "trait": "trait ", "impl_block": "impl ", "module": "mod ", "constant": "const ", "macro": "macro_rules! "}
#: Texts below this many bytes aren't summarised.
SHORT = 50


def data_health(nodes: DataFrame, edges: DataFrame, sources: DataFrame, chunks: DataFrame, extractions: DataFrame) -> DataFrame:
    """One row of counters: superseded sources and their chunks, nodes that nothing was extracted for (and those of them with edges), sources that share
    a URI, nodes without a vector, code and sources without a summary. ``nodes`` has embedding and summary; ``sources`` superseded_by and summary."""
    none = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    old = F.col("superseded_by").isNotNull()
    ends = edges.select(F.col("src").alias("id")).unionAll(edges.select("dst")).distinct()
    orphans = without(nodes.select("id"), extractions.select(F.col("entity_id").alias("id")).distinct(), "id")
    once = orphans.join(ends.withColumn("_e", F.lit(1)), "id", "left").agg(F.count("*").alias("orphan_nodes"), F.count("_e").alias("orphan_nodes_with_edges"))
    rows = [
        sources.agg(F.count_if(old).alias("superseded_sources"), F.count_if(~old & none("summary")).alias("unsummarized_sources")),
        chunks.groupBy("source_id").agg(F.count("*").alias("_n")).join(sources.filter(old).select(F.col("id").alias("source_id")), "source_id", "left_semi").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("superseded_chunks")),
        once,
        sources.filter(~old & F.col("uri").isNotNull()).groupBy("uri").count().filter("count > 1").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("duplicate_sources")),
        nodes.agg(F.count_if(F.col("embedding").isNull()).alias("unembedded_nodes"), F.count_if((F.col("entity_class") == "code") & none("summary")).alias("unsummarized_code")),
    ]
    first, *rest = rows
    for r in rest:
        first = first.join(F.broadcast(r))
    return first


def whitespace(sources: DataFrame, mentions: DataFrame, nodes: DataFrame, bridges: DataFrame, least: int = 1, most: int = 10) -> DataFrame:
    """source_id, nodes, representatives, score of the research sources (id) none of whose nodes has a bridge edge (bridges: src or dst): ``most`` node names by
    mentions; score is the share of such sources among those with ``least`` nodes or more. ``mentions``: source_id, id."""
    ends = bridges.select(F.col("src").alias("id")).unionAll(bridges.select("dst")).distinct().withColumn("_b", F.lit(1))
    m = mentions.select("source_id", "id").distinct().join(sources.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    per = m.join(ends, "id", "left").groupBy("source_id").agg(F.count("*").alias("nodes"), F.count("_b").alias("_bridged")).filter(F.col("nodes") >= least)
    share = per.agg((F.count_if(F.col("_bridged") == 0) / F.count("*")).alias("score"))
    gaps = per.filter("_bridged = 0").select("source_id", "nodes")
    best = m.join(gaps.select("source_id"), "source_id", "left_semi").join(nodes.select("id", "name", "mention_count"), "id").withColumn("k", F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("mention_count"), "id"))).filter(F.col("k") <= most)
    names = best.groupBy("source_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "name"))), lambda x: x["name"]), ", ").alias("representatives"))
    return gaps.join(names, "source_id").join(F.broadcast(share)).select("source_id", "nodes", "representatives", "score")


def edges_corrected(edges: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges, and an audit (target, action, changes as JSON), after corrections (id, rel_type, confidence; null leaves a value).

    A correction whose confidence is no number in [0, 1] is refused as a whole, and is in the audit as such; one of an edge that isn't there
    too. Of several for one edge the one with the largest (rel_type, confidence) counts, so that the result hangs on no order.
    """
    one = corrections.groupBy("id").agg(F.max(F.struct("rel_type", "confidence")).alias("c")).select("id", F.col("c.rel_type").alias("_rel"), F.col("c.confidence").alias("_conf"))
    fine = F.coalesce(~F.isnan("_conf") & F.col("_conf").between(0.0, 1.0), F.lit(True))
    j = edges.join(one.filter(fine), "id", "left")
    out = j.withColumns({"rel_type": F.coalesce("_rel", "rel_type"), "confidence": F.coalesce("_conf", "confidence")}).select(*edges.columns)
    old = one.join(edges.select("id", "rel_type", "confidence", F.lit(True).alias("_there")), "id", "left")
    change = lambda new, was: F.when(F.col(new).isNotNull(), F.struct(F.col(was).alias("old"), F.col(new).alias("new")))
    changes = F.to_json(F.struct(change("_rel", "rel_type").alias("rel_type"), change("_conf", "confidence").alias("confidence")))
    action = F.when(F.col("_there").isNull(), "not_found").when(~fine, "refused").otherwise("edge_correct")
    return out, old.select(F.col("id").alias("target"), action.alias("action"), F.when(action == "edge_correct", changes).alias("changes"))


def edges_deleted(edges: DataFrame, deletions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges, and an audit (target, action, changes), after deletions (id, reason); of several for one edge the first reason by the alphabet."""
    left, gone = dealt(edges.count(), (edges, ["id"]), (deletions, ["id"]))
    one = gone.groupBy("id").agg(F.min("reason").alias("reason"))
    there = one.join(left.select("id", F.lit(True).alias("_there")), "id", "left")
    action = F.when(F.col("_there").isNull(), "not_found").otherwise("edge_delete")
    return without(left, one, "id"), there.select(F.col("id").alias("target"), action.alias("action"), F.to_json(F.struct(F.col("id").alias("edge_id"), "reason")).alias("changes"))


def reprocessed(sources: DataFrame, derived: dict[str, DataFrame], again: DataFrame) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """Sources with a higher version and no summary where they are in ``again`` (id); the derived frames (source_id) without their rows; and the
    sources to be run anew."""
    ids = again.select("id").distinct()
    hit = sources.join(ids.withColumn("_hit", F.lit(True)), "id", "left")
    out = hit.withColumns({"version": F.col("version") + F.when(F.col("_hit"), 1).otherwise(0), "summary": F.when(F.col("_hit").isNull(), F.col("summary"))}).select(*sources.columns)
    left = {k: df.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_anti").select(*df.columns) for k, df in derived.items()}
    return out, left, out.join(ids, "id", "left_semi")


def chunk_entities(mentions: DataFrame) -> DataFrame:
    """Of each chunk's mentions (chunk_id, name, node_type, confidence) that aren't noise one for each lower-case name: the most confident."""
    m = mentions.filter(~T.noise_name(F.col("name"))).withColumn("key", F.lower(F.trim("name")))
    return m.groupBy("chunk_id", "key").agg(F.max(F.struct("confidence", "name", "node_type")).alias("m")).select("chunk_id", "key", "m.name", "m.node_type", "m.confidence")


def chunk_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations (chunk_id, source, target, rel_type) of a chunk both of whose ends are among its entities (chunk_id, key)."""
    r = relations.withColumns({"_s": F.lower(F.trim("source")), "_t": F.lower(F.trim("target"))}).filter("_s <> _t")
    for end in ("_s", "_t"):
        r = r.join(entities.select("chunk_id", F.col("key").alias(end)), ["chunk_id", end], "left_semi")
    return r.select("chunk_id", F.col("_s").alias("source"), F.col("_t").alias("target"), "rel_type").distinct()


def definition(node_type: Column, name: Column) -> Column:
    out = name
    for kind, before in DEFINED_BY.items():
        out = F.when(node_type == kind, F.concat(F.lit(before), name)).otherwise(out)
    return out


def summary_texts(nodes: DataFrame, extractions: DataFrame, chunks: DataFrame) -> DataFrame:
    """id, chunk_id, text for nodes (id, name, node_type, source_id, description, summary) without a summary: the chunk to summarise.

    Of the chunks it was extracted from that hold its definition the one of best confidence; else the shortest chunk of its source
    that does; else the description, or the name. Texts under 50 bytes go. Ties by the chunk's id.
    """
    n = nodes.filter(F.coalesce(F.col("summary"), F.lit("")) == "").withColumn("_def", definition(F.col("node_type"), F.col("name")))
    c = chunks.select(F.col("id").alias("chunk_id"), F.col("source_id").alias("_src"), F.col("content").alias("_text"))
    own = n.join(extractions.select(F.col("entity_id").alias("id"), "chunk_id", F.col("confidence").alias("_c")), "id").join(c, "chunk_id").filter(F.contains("_text", F.col("_def")))
    own = own.groupBy("id").agg(F.max(F.struct("_c", (-F.col("chunk_id")).alias("minus"))).alias("m")).select("id", (-F.col("m.minus")).alias("own"))
    rest = n.join(own, "id", "left_anti").join(c, F.col("source_id") == F.col("_src")).filter(F.contains("_text", F.col("_def")))
    rest = rest.groupBy("id").agg(F.min(F.struct(F.octet_length("_text").alias("n"), "chunk_id")).alias("m")).select("id", F.col("m.chunk_id").alias("other"))
    j = n.join(own, "id", "left").join(rest, "id", "left").withColumn("chunk_id", F.coalesce("own", "other"))
    out = j.join(c.select("chunk_id", "_text"), "chunk_id", "left").select("id", "chunk_id", F.coalesce("_text", "description", "name").alias("text"))
    return out.filter(F.octet_length("text") >= SHORT)


def composed_summaries(nodes: DataFrame, source_of: DataFrame) -> DataFrame:
    """source_id, entities, summary: the summaries of a source's nodes ((id, source_id) pairs), by type and name, as 'name (type): summary' lines."""
    j = source_of.select("source_id", "id").distinct().join(nodes.filter("summary IS NOT NULL"), "id")
    line = F.concat("name", F.lit(" ("), "node_type", F.lit("): "), "summary")
    g = j.groupBy("source_id").agg(F.sort_array(F.collect_list(F.struct("node_type", "name", "id", line.alias("t")))).alias("x"))
    return g.select("source_id", F.size("x").cast("long").alias("entities"), F.array_join(F.transform("x", lambda x: x["t"]), "\n").alias("summary"))


def community_nodes(mentions: DataFrame, sources: DataFrame, members: DataFrame) -> DataFrame:
    """community, ordinal, id: the nodes of the given sources (source_id, place) that are in a community, each once, in order of the first
    source and place that mention them. ``mentions``: source_id, place, id."""
    j = mentions.join(sources.select("source_id", F.col("place").alias("_s")), "source_id").join(members.select("id", "community"), "id")
    first = j.groupBy("community", "id").agg(F.min(F.struct("_s", "place")).alias("at"))
    w = Window.partitionBy("community").orderBy("at", "id")
    return first.select("community", F.row_number().over(w).cast("long").alias("ordinal"), "id")


def group_domains(groups: DataFrame, wanted: DataFrame, fallback: dict[str, list[str]]) -> DataFrame:
    """group, domains: those that the ontology (groups: group, domain) has for a wanted group, else the fixed ones, else none."""
    known = groups.groupBy("group").agg(F.array_sort(F.collect_set("domain")).alias("domains"))
    fixed = F.expr("cast(array() as array<string>)")
    for name, domains in fallback.items():
        fixed = F.when(F.col("group") == name, F.array(*map(F.lit, domains))).otherwise(fixed)
    return wanted.select("group").distinct().join(known, "group", "left").select("group", F.coalesce("domains", fixed).alias("domains"))


def delivered(results: DataFrame, by: str, mode: str = "results", limit: int = 10) -> DataFrame:
    """Results (by, id, score, result_type, content, snippet, name, source) of queries as they are handed out: at most ``limit``, 200 at most, of
    each; chunks are judged again, as promotion to sections may have changed their text. ``context``: assembled into blocks."""
    keep = (F.coalesce("result_type", F.lit("chunk")) != "chunk") | F.col("content").isNull() | ~retrieve.low_quality(F.col("content"))
    r = results.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "id"))).filter(F.col("_k") <= min(limit, 200)).drop("_k").filter(keep)
    return memory.context(r, by) if mode == "context" else r


def metadata_errors(items: DataFrame, schemas: dict[str, dict], kind: str) -> DataFrame:
    """id, errors of items (id, ``kind``, metadata as JSON) against the schema of their kind: {'required': [names], 'types': {name: type}}.

    Types: string, number, boolean, array, object. A kind without a schema has no errors; text that is no JSON object has one.
    """
    value = lambda name: F.get_json_object("metadata", f"$.{name}")
    parsed = F.try_parse_json("metadata")

    def type_of(name: str) -> Column:
        t = F.schema_of_variant(F.try_variant_get(parsed, f"$.{name}", "variant"))
        return F.when(t.startswith("ARRAY"), "array").when(t.startswith("OBJECT"), "object").when(t == "STRING", "string").when(t == "BOOLEAN", "boolean").when(t == "VOID", "null").otherwise("number")

    out = F.expr("cast(array() as array<string>)")
    for name, s in schemas.items():
        missing = [F.when(value(f).isNull(), F.lit(f"{f} is missing")) for f in s.get("required", [])]
        wrong = [F.when(value(f).isNotNull() & (type_of(f) != t), F.lit(f"{f} is no {t}")) for f, t in s.get("types", {}).items()]
        found = F.filter(F.array(*missing, *wrong), lambda x: x.isNotNull()) if missing or wrong else out
        out = F.when(F.col(kind) == name, F.when(F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False)), found).otherwise(F.array(F.lit("no object")))).otherwise(out)
    return items.select("id", out.alias("errors"))


def flushes(changes: DataFrame, quiet: int = 10, most: int = 10_000) -> DataFrame:
    """Adds flush to changes (seq_id, ts): which application of the debounced log each belongs to: after ``quiet`` seconds of silence, or
    ``most`` changes since the last silence. Silences are found by hour first, so that the log is in no single window."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    c = changes.withColumns({"_at": at, "_hour": F.date_trunc("hour", "ts")})
    inside = Window.partitionBy("_hour").orderBy("_at", "seq_id")
    hours = c.groupBy("_hour").agg(F.max("_at").alias("_last"))
    hours = hours.withColumn("_prev", F.max("_last").over(Window.orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)))  # a row an hour
    c = c.join(F.broadcast(hours.select("_hour", "_prev")), "_hour").withColumn("_before", F.coalesce(F.lag("_at").over(inside), "_prev"))
    c = c.withColumn("_new", F.coalesce(F.col("_at") - F.col("_before") >= quiet * 1_000_000, F.lit(True)).cast("long"))
    c = c.withColumns({"_s": F.sum("_new").over(inside), "_k": F.row_number().over(inside)})
    of_hour = c.groupBy("_hour").agg(F.sum("_new").alias("n"))
    of_hour = of_hour.select("_hour", F.coalesce(F.sum("n").over(Window.orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    c = c.join(F.broadcast(of_hour), "_hour").withColumn("_session", F.col("_base") + F.col("_s"))
    # A session may go over hours: its place is that inside the hour and the session's rows of the hours before.
    parts = c.groupBy("_session", "_hour").agg(F.count("*").alias("n"), F.min("_k").alias("_first"))
    parts = parts.withColumn("_skip", F.coalesce(F.sum("n").over(Window.partitionBy("_session").orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    c = c.join(parts.select("_session", "_hour", "_first", "_skip"), ["_session", "_hour"])
    return c.withColumn("flush", F.struct(F.col("_session").alias("session"), F.floor((F.col("_skip") + F.col("_k") - F.col("_first")) / most).cast("long").alias("part"))).select(*changes.columns, "flush")


def ticks(spans: DataFrame, every: dict[str, int]) -> DataFrame:
    """id, job, due: when the periodic jobs (name: seconds) of each span (id, begin, end) come due, the first one interval after its beginning."""
    rows = []
    for name, seconds in every.items():
        n = F.floor((F.unix_micros(F.col("end").cast("timestamp")) - F.unix_micros(F.col("begin").cast("timestamp"))) / 1_000_000 / seconds).cast("int")
        k = F.explode(F.when(n >= 1, F.sequence(F.lit(1), n)))
        rows.append(spans.select("id", F.lit(name).alias("job"), "begin", k.alias("k")).select("id", "job", (F.col("begin") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("k") * seconds)).alias("due")))
    first, *rest = rows
    for r in rest:
        first = first.unionByName(r)
    return first


def traced(results: DataFrame, by: str, lists: DataFrame, strategy: Column) -> DataFrame:
    """A row for each query's run: strategy, results, best score, and how many each dimension gave, to be appended to the trace table and replayed."""
    n = lists.groupBy(by, "dimension").agg(F.count("*").alias("n")).groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("dimension", "n")))).alias("found"))
    r = results.groupBy(by).agg(F.count("*").alias("results"), F.max("score").alias("best"))
    return n.join(r, by, "left").select(by, strategy.alias("strategy"), F.to_json("found").alias("found"), F.coalesce("results", F.lit(0)).alias("results"), "best")


def replayed(trace: DataFrame, again: DataFrame, by: str) -> DataFrame:
    """by, before, now: the queries whose number of results has changed since they were traced."""
    return trace.select(by, F.col("results").alias("before")).join(again.select(by, F.col("results").alias("now")), by, "full_outer").filter(~F.col("before").eqNullSafe(F.col("now")))


def coref_windows(docs: DataFrame, size: int = 15_000, overlap: int = 500) -> DataFrame:
    """id, window, start, text: windows of ``size`` characters that overlap, each reaching ``overlap`` into the one before."""
    step, n = size - overlap, F.length("text")
    last = F.greatest(F.ceil((n - overlap) / step).cast("int"), F.lit(1))
    # One pass: each match takes ``step`` characters and looks ahead at ``size``. Counting to each window from the text's start would be quadratic.
    parts = F.when(n > 0, F.slice(F.regexp_extract_all("text", F.lit(f"(?s)(?=(.{{1,{size}}})).{{1,{step}}}"), F.lit(1)), F.lit(1), last)).otherwise(F.array("text"))
    return docs.select("id", F.posexplode(parts).alias("window", "text")).select("id", "window", (F.col("window") * step).cast("long").alias("start"), "text")


def occurrences(text: Column, word: str) -> Column:
    """Where ``word`` stands in a text, from 0, in characters; places that overlap one before are no others. One pass over the text."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    put = lambda s, p: F.struct((s["at"] + F.length(p) + len(word)).alias("at"), F.concat(s["out"], F.array(s["at"] + F.length(p))).alias("out"))
    parts = F.split(text, r"\Q" + word.replace(r"\E", r"\E\\E\Q") + r"\E", -1)
    return F.aggregate(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), start, put, lambda s: s["out"])


def coref_merged(found: DataFrame, overlap: int = 500) -> DataFrame:
    """id, start, end, label: what each window found (id, window, start of the window, at, size, label) on the whole text. What lies wholly
    in the part that a window shares with the one before counts there, and goes here."""
    return found.filter((F.col("window") == 0) | (F.col("at") + F.col("size") > overlap)).select("id", (F.col("start") + F.col("at")).alias("start"), (F.col("start") + F.col("at") + F.col("size")).alias("end"), "label")
