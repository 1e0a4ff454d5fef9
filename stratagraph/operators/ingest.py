"""Facts to rows: validation, canonical keys, merging of duplicates, upsert and purge.

Facts are one table with a row for each; all of it is grouped aggregations and anti joins, so a
batch is merged as a whole, not in windows.
"""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagraph import model
from stratagraph.plans.graph import EDGE_DEFAULTS
from stratagraph.sources.tables import settle, settled_small

#: A fact: envelope, then the fields of all kinds. `seq` is the order in which facts came. An edge may bring its own evidence.
FACTS = (
    "seq long, kind string, produced_by array<string>, confidence double, symbol_kind string, name string, qualified_name string, file_path string, line long, end_line long, line_count long, exported boolean, doc string, owning_class string, "
    "edge_kind string, src_symbol string, dst_symbol string, derivation string, access_path string, site_file string, site_line long, log_level string, template string, subsystem string, registration_api string, resolution_kind string, timer_condition string, "
    "source_kind string, attached_kind string, attached_to string, evidence_file string, evidence_line long, observation_kind string, subject string, observed_at string, data string, "
    "type_kind string, spelling string, symbol_name string, aggregate_symbol string, ordinal long, tags string"
)


def problem() -> Column:
    """Why a fact is rejected, or null."""
    gone = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    kind = F.col("kind")
    return (
        F.when(kind.isNull() | ~kind.isin(*model.FACT_KINDS), "unknown fact kind")
        .when(F.col("confidence").isNull() | F.isnan("confidence") | ~F.col("confidence").between(0, 1), "confidence outside 0 to 1")
        .when(F.coalesce(F.size("produced_by"), F.lit(0)) <= 0, "no producer")
        .when((kind == "symbol") & (gone("name") | gone("symbol_kind")), "a symbol without name or kind")
        .when((kind == "type") & (gone("spelling") | gone("type_kind")), "a type without spelling or kind")
        .when((kind == "aggregate-field") & (gone("aggregate_symbol") | gone("name")), "a field without aggregate or name")
        .when((kind == "edge") & (gone("edge_kind") | (gone("src_symbol") & gone("dst_symbol")) | gone("derivation")), "an edge without kind, ends or derivation")
        .when((kind == "evidence") & (gone("source_kind") | gone("attached_to")), "evidence without source or what it is of")
        .when((kind == "observation") & (gone("observation_kind") | gone("subject")), "an observation without kind or subject")
    )


def validate(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted facts, and rejected ones with their `reason`."""
    checked = facts.withColumn("reason", problem())
    return checked.filter("reason IS NULL").drop("reason"), checked.filter("reason IS NOT NULL")


def canonical_key() -> Column:
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    symbol = F.coalesce("qualified_name", "name")
    place = lambda file, line: F.when(F.col(file).isNotNull(), F.concat(F.col(file), F.lit(":"), part(line))).otherwise("")
    return (
        F.when(F.col("kind") == "symbol", F.concat_ws("|", F.lit("symbol"), part("symbol_kind"), symbol, place("file_path", "line")))
        .when(F.col("kind") == "type", F.concat_ws("|", F.lit("type"), part("type_kind"), part("spelling"), part("symbol_name")))
        .when(F.col("kind") == "aggregate-field", F.concat_ws("|", F.lit("field"), part("aggregate_symbol"), part("name"), part("ordinal")))
        .when(F.col("kind") == "edge", F.concat_ws("|", F.lit("edge"), part("edge_kind"), F.concat(part("src_symbol"), F.lit("->"), part("dst_symbol")), place("site_file", "site_line")))
        .when(F.col("kind") == "evidence", F.concat_ws("|", F.lit("evidence"), part("attached_kind"), part("attached_to"), part("source_kind"), place("evidence_file", "evidence_line")))
        .otherwise(F.concat_ws("|", F.lit("obs"), part("observation_kind"), part("subject"), part("observed_at")))
    )


def merge(facts: DataFrame) -> DataFrame:
    """One fact for each canonical key: all producers, the most confidence, and the payload of the first with it."""
    keyed = facts.withColumn("fact_key", canonical_key())
    payload = [c for c in facts.columns if c not in ("seq", "confidence", "produced_by")]
    best = F.max_by(F.struct(*payload), F.struct("confidence", -F.col("seq"))).alias("p")
    by = keyed.groupBy("fact_key").agg(best, F.max("confidence").alias("confidence"), F.min("seq").alias("seq"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("produced_by")))).alias("produced_by"))
    return by.select("fact_key", "seq", "confidence", "produced_by", "p.*")


def symbol_id(snapshot: int, name: Column | str) -> Column:
    name = F.col(name) if isinstance(name, str) else name
    return F.concat(F.lit(f"graph_node:{snapshot}:symbol:"), name)


def provenance() -> Column:
    return F.to_json(F.struct(F.struct(F.col("produced_by").alias("producedBy"), F.col("confidence").alias("busConfidence")).alias("_provenance")))


def graph_id(kind: str, snapshot: int, *parts: Column | str) -> Column:
    """An identity: its parts by colons, without empty ones."""
    some = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.concat_ws(":", F.lit(f"graph_{kind}:{snapshot}"), *(F.when(c.cast("string") != "", c.cast("string")) for c in some))


def to_rows(facts: DataFrame, snapshot: int) -> dict[str, DataFrame]:
    """Merged facts as rows of the tables; types and aggregate fields are counted only.

    Identities follow names, so that symbols of one name are one node (the surest, then first), and
    edges between the same names are one edge. Evidence of an edge fact is that edge's; evidence that
    comes alone is kept under what it says it is of.
    """
    name = F.coalesce("qualified_name", "name")
    one = lambda df, key: df.groupBy(key).agg(F.max_by(F.struct(*(c for c in df.columns if c not in (key, "seq"))), F.struct("confidence", -F.col("seq"))).alias("r")).select(F.lit(snapshot).cast("long").alias("snapshot_id"), key, "r.*")
    s = facts.filter("kind = 'symbol'").select(symbol_id(snapshot, name).alias("node_id"), "seq", "confidence", name.alias("canonical_name"), F.col("symbol_kind").alias("kind"), "file_path", "line", "end_line", "line_count", "exported", "doc", "owning_class", provenance().alias("payload"))
    e = facts.filter("kind = 'edge'")
    end = lambda c: F.when(F.col(c) != "", symbol_id(snapshot, c))
    edge_id = graph_id("edge", snapshot, "edge_kind", "src_symbol", "dst_symbol")
    own = e.filter("source_kind IS NOT NULL").select(F.concat(F.lit(f"graph_evidence:{snapshot}:"), edge_id).alias("evidence_id"), "seq", "confidence", edge_id.alias("edge_id"), F.lit(None).cast("string").alias("node_id"), "source_kind", F.col("evidence_file").alias("file_path"), F.col("evidence_line").alias("line"), F.col("data").alias("payload"))
    e = e.select(edge_id.alias("edge_id"), "seq", "edge_kind", end("src_symbol").alias("src_node_id"), end("dst_symbol").alias("dst_node_id"), "confidence", "derivation", *EDGE_DEFAULTS, provenance().alias("metadata"))
    alone = F.concat(F.lit("synth-evidence:"), F.col("attached_to"))
    v = facts.filter("kind = 'evidence'").select(alone.alias("evidence_id"), "seq", "confidence", F.when(F.col("attached_kind") == "edge", alone).alias("edge_id"), F.when(F.col("attached_kind") == "symbol", alone).alias("node_id"), "source_kind", F.col("evidence_file").alias("file_path"), F.col("evidence_line").alias("line"), F.col("data").alias("payload"))
    o = facts.filter("kind = 'observation'").select(F.concat_ws(":", F.lit("obs"), "observation_kind", "subject", F.coalesce("observed_at", F.lit(""))).alias("observation_id"), "seq", F.col("subject").alias("node_id"), F.col("observation_kind").alias("kind"), F.to_timestamp("observed_at").alias("observed_at"), "confidence", F.get_json_object("data", "$.target_api").alias("target_api"), F.get_json_object("data", "$.immediate_invoker").alias("immediate_invoker"), F.get_json_object("data", "$.runtime_trigger").alias("runtime_trigger"), F.get_json_object("data", "$.dispatch_chain").alias("dispatch_chain"), F.col("data").alias("payload"))
    return {"nodes": one(s, "node_id").drop("confidence"), "edges": one(e, "edge_id"), "evidence": one(own.unionByName(v), "evidence_id").drop("confidence"), "observations": one(o, "observation_id")}


def captured(nodes: DataFrame) -> DataFrame:
    """The functions among rows on their way into the store: name and place, for a producer that wants to know them."""
    return nodes.filter("kind = 'function'").select(F.col("canonical_name").alias("name"), "file_path", "line")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The new rows, and the old ones whose key isn't among them."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def purge_files(tables: dict[str, DataFrame], paths: DataFrame) -> dict[str, DataFrame]:
    """Tables without what the files (file_path) define: their nodes, the nodes' outgoing edges, and evidence and observations of both.

    Edges into them from other files stay, dangling until the file is read again.
    """
    gone = tables["nodes"].join(paths, "file_path", "left_semi").select("node_id").distinct()
    without = lambda df, key: df.join(gone.select(F.col("node_id").alias(key)), key, "left_anti")
    dropped = tables["edges"].join(gone.select(F.col("node_id").alias("src_node_id")), "src_node_id", "left_semi").select("edge_id").distinct()
    return {
        "nodes": without(tables["nodes"], "node_id"), "edges": without(tables["edges"], "src_node_id"),
        "evidence": without(tables["evidence"].join(dropped, "edge_id", "left_anti"), "node_id"), "observations": without(tables["observations"], "node_id"),
    }


def link_callers(rows: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runtime caller rows (target_api, ..) whose target is a known function, and the others with a warning."""
    known = nodes.filter("kind = 'function'").select(F.col("canonical_name").alias("target_api")).distinct()
    warning = F.concat(F.lit("no symbol for "), F.col("target_api")).alias("warning")
    return rows.join(known, "target_api", "left_semi"), rows.join(known, "target_api", "left_anti").select("*", warning)


def caller_rows(callers: DataFrame) -> DataFrame:
    """Indirect callers (target_api, name, file_path, line, registration_api, container_type, dispatch_function, trigger_kind,
    trigger_key, pattern_name, score) as runtime caller rows; those without name or file are left out."""
    known = callers.filter((F.coalesce("name", F.lit("")) != "") & (F.coalesce("file_path", F.lit("")) != ""))
    chain = F.filter(F.array("registration_api", "container_type", "dispatch_function"), lambda x: F.coalesce(x, F.lit("")) != "")
    sure = F.when(F.col("score").isNull(), F.lit(0.5)).otherwise(F.least(F.col("score") / 5, F.lit(1.0)))
    return known.select("target_api", F.col("name").alias("immediate_invoker"), chain.alias("dispatch_chain"), F.col("file_path").alias("site_file"), F.col("line").alias("site_line"), F.coalesce("trigger_kind", "trigger_key", "pattern_name", F.lit("unknown")).alias("runtime_trigger"), sure.alias("confidence"))


#: Kinds whose nodes are symbols; others are runtime nodes, under their kind.
SYMBOL_BACKED = ("function", "struct", "union", "enum", "typedef", "macro", "global_var", "field", "param")


def participant_id(snapshot: int, name: Column, kind: Column) -> Column:
    return F.when(kind.isin(*SYMBOL_BACKED), symbol_id(snapshot, name)).otherwise(graph_id("node", snapshot, F.lit("runtime"), kind, name))


def materialize_chains(rows: DataFrame, snapshot: int) -> dict[str, DataFrame]:
    """Runtime caller rows as participants, runtime_calls edges along the chain, an observation each, and evidence if a row brings any.

    rows: target_api, immediate_invoker, runtime_trigger, dispatch_chain array, confidence, and optionally target_kind,
    participants array<struct<name, kind, role>>, source_kind, evidence_file, evidence_line. A row without a chain goes from
    its invoker to its target. The step from invoker to target is the observed call, any other a step of the chain.
    Of several rows that make one node, edge or observation the last by (target, invoker, trigger, chain) wins.
    """
    for name, kind in (("target_kind", "string"), ("participants", "array<struct<name:string,kind:string,role:string>>"), ("source_kind", "string"), ("evidence_file", "string"), ("evidence_line", "long")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    given = F.coalesce("dispatch_chain", F.array().cast("array<string>"))
    r = rows.withColumns({"given": F.array_join(given, " -> "), "chain": F.when(F.size(given) > 0, given).otherwise(F.array("immediate_invoker", "target_api"))})
    r = r.withColumn("order", F.struct("target_api", "immediate_invoker", F.coalesce("runtime_trigger", F.lit("")).alias("t"), "given", F.col("confidence").alias("c")))
    plain = lambda kind: F.when(kind == "api", "function").otherwise(kind)
    named = F.map_from_entries(F.transform(F.coalesce("participants", F.array().cast("array<struct<name:string,kind:string,role:string>>")), lambda p: F.struct(p["name"], F.struct(plain(p["kind"]).alias("kind"), p["role"].alias("role")))))
    r = r.withColumn("named", named).withColumn("target_kind", plain(F.coalesce("target_kind", F.lit("function"))))
    kind_of = lambda c: F.coalesce(F.try_element_at("named", c)["kind"], F.when(c == F.col("target_api"), F.col("target_kind")).otherwise("unknown"))
    last = lambda df, key: df.groupBy(key).agg(F.max_by(F.struct(*(c for c in df.columns if c not in (key, "order"))), "order").alias("r")).select(key, "r.*")
    names = F.array_distinct(F.concat(F.map_keys("named"), F.array("target_api", "immediate_invoker"), "chain"))
    n = r.select("order", "target_api", "immediate_invoker", "target_kind", "named", "chain", F.explode(names).alias("canonical_name"))
    at = F.array_position("chain", F.col("canonical_name"))
    role = F.coalesce(F.try_element_at("named", F.col("canonical_name"))["role"], F.when(F.col("canonical_name") == F.col("target_api"), "target").when(F.col("canonical_name") == F.col("immediate_invoker"), "invoker").when(at == 1, "trigger").otherwise("dispatch_step"))
    kind = kind_of(F.col("canonical_name"))
    nodes = last(n.select("order", participant_id(snapshot, F.col("canonical_name"), kind).alias("node_id"), "canonical_name", kind.alias("kind"), role.alias("role")), "node_id")
    steps = F.expr("transform(sequence(0, size(chain) - 2), i -> struct(i as i, chain[i] as a, chain[i + 1] as b))")
    e = r.select("*", F.explode(F.when(F.size("chain") > 1, steps).otherwise(F.expr("cast(array() as array<struct<i: int, a: string, b: string>>)"))).alias("p"))
    observed = (F.col("p.a") == F.col("immediate_invoker")) & (F.col("p.b") == F.col("target_api"))
    edge_id = F.when(observed, graph_id("edge", snapshot, F.lit("runtime_invokes"), "immediate_invoker", "target_api")).otherwise(graph_id("edge", snapshot, F.lit("runtime_chain"), "p.i", "p.a", "p.b"))
    side = lambda c: participant_id(snapshot, F.col(c), kind_of(F.col(c)))
    edges = e.select("order", edge_id.alias("edge_id"), F.lit("runtime_calls").alias("edge_kind"), side("p.a").alias("src_node_id"), side("p.b").alias("dst_node_id"), "confidence", F.lit("runtime").alias("derivation"), F.when(observed, "runtime_observed").otherwise("runtime_chain_step").alias("runtime_call_kind"), F.col("p.i").cast("long").alias("chain_index"))
    obs = r.select("order", graph_id("observation", snapshot, "target_api", "immediate_invoker").alias("observation_id"), participant_id(snapshot, F.col("target_api"), kind_of(F.col("target_api"))).alias("node_id"), F.lit("runtime_invocation").alias("kind"), "target_api", "immediate_invoker", "runtime_trigger", F.col("given").alias("dispatch_chain"), "confidence")
    # the edge that evidence is of: the observed call, or else the chain's last step
    pairs = F.size("chain") - 1
    direct = F.coalesce(F.exists(F.when(F.size("chain") > 1, steps).otherwise(F.expr("cast(array() as array<struct<i: int, a: string, b: string>>)")), lambda p: (p["a"] == F.col("immediate_invoker")) & (p["b"] == F.col("target_api"))), F.lit(False))
    invokes = graph_id("edge", snapshot, F.lit("runtime_invokes"), "immediate_invoker", "target_api")
    step = graph_id("edge", snapshot, F.lit("runtime_chain"), pairs - 1, F.try_element_at("chain", pairs.cast("int")), F.try_element_at("chain", (pairs + 1).cast("int")))
    primary = F.when(direct | (pairs < 1), invokes).otherwise(step)
    v = r.filter("source_kind IS NOT NULL").select("order", F.concat(F.lit(f"graph_evidence:{snapshot}:"), primary).alias("evidence_id"), primary.alias("edge_id"), "source_kind", F.col("evidence_file").alias("file_path"), F.col("evidence_line").alias("line"))
    return {"nodes": nodes, "edges": last(edges, "edge_id"), "observations": last(obs, "observation_id"), "evidence": last(v, "evidence_id")}


#: How a template says that it is for a struct's field instead of a function: this, the struct, a dot, the field.
STRUCT_FIELD = "__struct_field:"


def runtime_calls(registrations: DataFrame, templates: DataFrame) -> DataFrame:
    """Registrations (registrar, callback, dispatch_key, struct_type, file_path, line) with the chain of their template, if there is one.

    templates: (seq, registration_api, chain array, trigger_kind, trigger_description). One for the registrar goes before one for
    the struct's field, that before the first for any field of the struct, in whose chain the last part of a->b is the key.
    %CALLBACK% and %KEY% are replaced.
    """
    t = settled_small(templates.select("seq", F.col("registration_api").alias("t_api"), "chain", "trigger_kind", "trigger_description"))
    kind = F.trim(F.regexp_replace(F.coalesce("struct_type", F.lit("")), r"\b(?:static|const|volatile|struct|enum|union)\b", ""))
    keyed = (F.coalesce("struct_type", F.lit("")) != "") & (F.coalesce("dispatch_key", F.lit("")) != "")
    r = registrations.withColumn("__struct", F.when(keyed, kind)).withColumn("__field", F.when(keyed, F.concat(F.lit(STRUCT_FIELD), kind, F.lit("."), F.col("dispatch_key"))))
    of_struct = t.filter(F.col("t_api").startswith(STRUCT_FIELD)).withColumn("t_struct", F.regexp_extract("t_api", f"^{STRUCT_FIELD}(.*)\\.[^.]*$", 1))
    adapt = F.transform("chain", lambda s: F.when(s.contains("->") & ~s.contains("%"), F.concat(F.regexp_replace(s, "[^>]*$", ""), F.col("dispatch_key"))).otherwise(s))
    by = lambda table, cond, rank, chain=F.col("chain"): r.join(table, cond).select(*r.columns, F.struct(F.lit(rank).alias("rank"), "seq", chain.alias("chain"), "trigger_kind", "trigger_description").alias("__t"))
    met = by(t, F.col("registrar") == F.col("t_api"), 0).unionByName(by(t, F.col("__field") == F.col("t_api"), 1)).unionByName(by(of_struct, F.col("__struct") == F.col("t_struct"), 2, adapt))
    best = met.groupBy(*registrations.columns).agg(F.min("__t").alias("t"))
    put = lambda s: F.replace(F.replace(s, F.lit("%CALLBACK%"), F.col("callback")), F.lit("%KEY%"), F.coalesce("dispatch_key", F.lit("")))
    out = best.select(*registrations.columns, F.transform("t.chain", put).alias("dispatch_chain"), "t.trigger_kind", put(F.col("t.trigger_description")).alias("trigger_description"))
    source = F.when(F.size("dispatch_chain") >= 3, F.try_element_at("dispatch_chain", F.lit(-2))).otherwise(F.try_element_at("dispatch_chain", F.lit(1)))
    return out.select("*", source.alias("src_symbol"), F.col("callback").alias("dst_symbol"), F.lit("runtime_calls").alias("edge_kind"), F.lit(0.9).alias("confidence"))


def hardware_dispatch(calls: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The hardware entities (name, kind, step) that stand for steps of runtime_calls() chains, and dispatches_to edges from them to the next step."""
    e = settled_small(entities.select("step", F.col("name").alias("hw_name"), F.col("kind").alias("hw_kind")))
    steps = calls.select("dispatch_chain", "trigger_kind", F.posexplode("dispatch_chain").alias("position", "at")).join(e, F.col("at") == F.col("step"))
    nodes = steps.select(F.col("hw_name").alias("name"), F.lit("function").alias("symbol_kind"), "hw_kind").distinct()
    following = F.expr("try_element_at(dispatch_chain, position + 2)")
    edges = steps.select(F.col("hw_name").alias("src_symbol"), following.alias("dst_symbol"), F.lit("dispatches_to").alias("edge_kind"), F.col("position").cast("long").alias("position"), "trigger_kind", F.lit(0.9).alias("confidence"))
    return nodes, edges.filter("dst_symbol IS NOT NULL").distinct()


def roll_up_aggregates(contains: DataFrame, field_of_type: DataFrame, confidence: float = 0.95) -> DataFrame:
    """One aggregates edge for each type and each target of its fields: (src, dst) of contains and field_of_type."""
    f = field_of_type.select(F.col("src").alias("field"), F.col("dst").alias("target"))
    return contains.join(f, contains["dst"] == f["field"]).select("src", F.col("target").alias("dst")).distinct().select("src", "dst", F.lit("aggregates").alias("edge_kind"), F.lit(confidence).alias("confidence"))


def enclosing_function(sites: DataFrame, functions: DataFrame, reach: int = 500) -> DataFrame:
    """Sites (site_id, file_path, line) with the first function that starts at most `reach` lines before them, or '(file-scope)'.

    A range join as an equi-join on the file and runs of `reach` lines: a site meets the functions of its run and the one before.
    """
    f = functions.select("canonical_name", F.col("file_path").alias("f"), F.col("line").alias("start"), F.explode(F.array(F.floor(F.col("line") / reach), F.floor(F.col("line") / reach) + 1)).alias("run"))
    s = sites.withColumn("at", F.floor(F.col("line") / reach))
    met = s.join(f, (F.col("file_path") == F.col("f")) & (F.col("at") == F.col("run")) & F.col("line").between(F.col("start"), F.col("start") + reach), "left")
    return met.groupBy("site_id").agg(F.min(F.struct("start", "canonical_name")).alias("m")).select("site_id", F.coalesce("m.canonical_name", F.lit("(file-scope)")).alias("function"))


def run_producers(spark, producers: dict, context) -> tuple[DataFrame, list[dict]]:
    """All producers' facts, and a report with how many facts of each kind each gave and the seconds it took.

    Producers run beside each other, each writing its facts to a table of its own; one that fails is reported and
    leaves the others alone.
    """
    def one(item: tuple) -> tuple[DataFrame | None, dict]:
        name, producer = item
        began = time.monotonic()
        try:
            if not producer.applies_to(context):
                return None, {"producer": name, "status": "skipped"}
            facts = settle(producer.facts(spark, context))
            counts = {r["kind"]: r["count"] for r in facts.groupBy("kind").count().collect()}
            return facts, {"producer": name, "status": "ok", "counts": counts, "seconds": time.monotonic() - began}
        except Exception as e:  # a producer is foreign code; its failure is its row in the report
            return None, {"producer": name, "status": "failed", "error": str(e), "seconds": time.monotonic() - began}

    with ThreadPoolExecutor(max(1, min(8, len(producers)))) as pool:
        done = list(pool.map(one, producers.items()))
    out = spark.createDataFrame([], FACTS)
    for facts, _ in done:
        if facts is not None:
            out = out.unionByName(facts, allowMissingColumns=True)
    return out, [report for _, report in done]
