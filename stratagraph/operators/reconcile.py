"""Reconciling expected entities with what the engine answers: comparison, classification, scores and trends.

Relations are tables (entity, bucket, src, dst, edge_kind, confidence, derivation, seq), where seq is
the order in which they came; answers are (entity, intent, status, items), a row for each question
asked. Everything is joins, windows and grouped aggregations over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratagraph.operators.respond import BUCKETS, bucket_of

# Fixed values of the method: severities by mismatch and field, outcomes, weights, thresholds and hints.
RULES = {
    "consistency|status": ("S0", "CONSISTENCY_STATUS"),
    "missing|data.items.length": ("S0", "MISSING_ITEMS"),
    "source_mismatch|kind": ("S1", "SOURCE_KIND"),
    "source_mismatch|kind_verbose": ("S1", "SOURCE_KIND_VERBOSE"),
    "unresolved_alias|canonical_name": ("S2", "ALIAS_CANONICAL_NAME"),
    "extra|rel.calls_out": ("S2", "EXTRA_RELATION"),
    "evidence_weak|rel.structures (minimum_count)": ("S3", "WEAK_EVIDENCE"),
}
OUTCOME = {"S0": "fail", "S1": "fail", "S2": "warn", "S3": "pass"}
WEIGHTS = {"coverage": 0.25, "backend": 0.35, "evidence": 0.20, "consistency": 0.20}
PASS_AT, WARN_AT, TREND_STEP = 0.85, 0.70, 0.05
HINTS = (
    ("coverage", 0.5, "Run enrichment pipeline to populate missing relation buckets"),
    ("backend", 0.7, "Backend is missing fixture-expected relations — check DB snapshot freshness"),
    ("evidence", 0.7, "Relations have weak evidence — re-run enrichment with higher confidence threshold"),
    ("consistency", 1.0, "Mock/live backend inconsistency detected — investigate DB query path"),
    ("confidence", WARN_AT, "Entity below release threshold — remediate before merge"),
)
SEVERITY_ORDER = {"S0": 4, "S1": 3, "S2": 2, "S3": 1, "none": 0}
#: Points of a tier, of 10, and the buckets of which one must have relations.
TIERS = ((5, ("calls_in_direct", "calls_in_runtime", "registrations_in")), (4, ("calls_out", "structures", "logs", "owns")), (1, ("uses", "registrations_out")))
#: What a bucket with relations requires: relation kind and direction; buckets in order.
CONTRACT = {
    "calls_in_direct": ("call_direct", "incoming"), "calls_in_runtime": ("call_runtime", "incoming"), "calls_out": ("call_direct", "outgoing"),
    "registrations_in": ("register", "incoming"), "structures": (None, None), "logs": ("emit_log", None), "owns": (None, None),
}
FAMILIES = {
    "api": ("calls_in_runtime", "calls_in_direct", "registrations_in"), "struct": ("structures",), "ring": ("registrations_out", "uses"), "hw_block": ("registrations_out", "uses"),
    "thread": ("calls_in_runtime", "calls_out"), "signal": ("calls_in_runtime",), "interrupt": ("calls_out", "registrations_out"), "timer": ("calls_out", "registrations_out"),
    "dispatch_table": ("calls_out",), "message": ("calls_in_runtime", "calls_out"), "log_point": ("logs",),
}
#: The intents that an entity is asked about to enrich it.
ENRICHING = (
    "who_calls_api", "who_calls_api_at_runtime", "what_api_calls", "show_registration_chain", "find_callback_registrars", "find_api_logs", "find_api_logs_by_level", "find_api_struct_writes",
    "find_api_struct_reads", "find_struct_owners",
)
DEFAULTS = {"edge_kind": "unknown", "derivation": "clangd", "confidence": 0.5}


def _map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def _either(*names: str) -> Column:
    """The first that isn't empty."""
    return F.coalesce(*(F.when(F.col(n) != "", F.col(n)) for n in names))


def normalized(edges: DataFrame) -> DataFrame:
    """Edges (entity, intent, caller, callee, .., seq) as relations with a bucket and the defaults of what they lack."""
    have = set(edges.columns)
    end = lambda *names: _either(*(n for n in names if n in have))
    sure = F.col("confidence").cast("double")
    return edges.select(
        "entity", bucket_of(F.col("intent")).alias("bucket"), end("caller", "api").alias("src"), end("callee", "struct").alias("dst"), F.coalesce(_either("edge_kind"), F.lit(DEFAULTS["edge_kind"])).alias("edge_kind"),
        F.when(F.coalesce(sure, F.lit(0.0)) == 0, F.lit(DEFAULTS["confidence"])).otherwise(sure).alias("confidence"), F.coalesce(_either("derivation"), F.lit(DEFAULTS["derivation"])).alias("derivation"), F.col("intent").alias("source_intent"), "seq",
    )


def dedupe(relations: DataFrame) -> DataFrame:
    """One relation for each (entity, src, dst, edge_kind), whatever its bucket: the surest; of equal ones the last from
    clangd, or else the first. `seq` becomes that of the first of its key."""
    key = ["entity", "src", "dst", "edge_kind"]
    rest = [c for c in relations.columns if c not in (*key, "seq")]
    known = F.coalesce(F.col("derivation") == "clangd", F.lit(False))
    order = F.struct("confidence", known, F.when(known, F.col("seq")).otherwise(-F.col("seq")))
    out = relations.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("b"), F.min("seq").alias("seq"))
    return out.select(*key, "b.*", "seq").select(*(c for c in relations.columns))


def enrich(existing: DataFrame, found: DataFrame) -> DataFrame:
    """What entities have, and after it what answers found, each key once, in order of confidence inside a bucket: with `position`."""
    columns = ["entity", "bucket", "src", "dst", "edge_kind", "confidence", "derivation", "seq"]
    both = existing.select(*columns, F.lit(0).alias("late")).unionByName(dedupe(found).select(*columns, F.lit(1).alias("late")))
    w = Window.partitionBy("entity", "bucket").orderBy(F.coalesce("confidence", F.lit(0.0)).desc(), "late", "seq", "src", "dst", "edge_kind")
    return both.withColumn("position", F.row_number().over(w).cast("long")).drop("late")


def contracts(relations: DataFrame) -> DataFrame:
    """For each entity the required relation kinds, directions and minimum counts that its filled buckets make."""
    buckets = list(CONTRACT)
    place = F.array_position(F.array(*map(F.lit, buckets)), F.col("bucket")).cast("long")
    kinds = {b: [k] for b, (k, _) in CONTRACT.items() if k}
    one = F.when(F.col("bucket") == "structures", F.when(F.col("edge_kind") == "read", F.lit("read")).when(F.col("edge_kind") == "write", F.lit("write"))).otherwise(F.try_element_at(_map({b: k[0] for b, k in kinds.items()}), F.col("bucket")))
    rank = place * 2 + F.when(F.col("edge_kind") == "write", 1).otherwise(0)
    rows = relations.filter(F.col("bucket").isin(*buckets)).select("entity", "bucket", one.alias("kind"), F.try_element_at(_map({b: d for b, (_, d) in CONTRACT.items() if d}), F.col("bucket")).alias("direction"), rank.alias("rank")).distinct()
    listed = lambda c: F.array_distinct(F.transform(F.array_sort(F.collect_set(F.when(F.col(c).isNotNull(), F.struct("rank", c)))), lambda x: x[c]))
    out = rows.groupBy("entity").agg(listed("kind").alias("required_relation_kinds"), listed("direction").alias("required_directions"), F.array_sort(F.collect_set("bucket")).alias("minimum_buckets"))
    return relations.select("entity").distinct().join(out, "entity", "left").select("entity", *(F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("required_relation_kinds", "required_directions", "minimum_buckets")))


def minimums(contract: DataFrame) -> DataFrame:
    """(entity, bucket, minimum) of contracts: one relation each."""
    return contract.select("entity", F.explode("minimum_buckets").alias("bucket"), F.lit(1).cast("long").alias("minimum"))


def relation_key() -> Column:
    part = lambda c: F.coalesce(F.col(c), F.lit(""))
    return F.concat_ws("|", part("src"), part("dst"), part("edge_kind"))


def mismatch(field: Column, first: Column) -> Column:
    """The kind of mismatch that a differing field is."""
    return (
        F.when(first & (field == "status"), "consistency").when(field == "data.items.length", "missing").when(field.isin("kind", "kind_verbose"), "source_mismatch").when(field == "canonical_name", "unresolved_alias")
        .when(field.startswith("rel.") & field.contains("minimum_count"), "evidence_weak").when(field.startswith("rel."), "extra").otherwise("source_mismatch")
    )


def classify(differences: DataFrame) -> DataFrame:
    """(.., field, mismatch_type) with severity, rule_id and outcome; what no rule names is S3, with a rule id made from both."""
    key = F.concat_ws("|", "mismatch_type", "field")
    made = F.concat(F.lit("UNKNOWN_"), F.upper("mismatch_type"), F.lit("_"), F.upper(F.replace(F.col("field"), F.lit("."), F.lit("_"))))
    out = differences.withColumn("severity", F.coalesce(F.try_element_at(_map({k: s for k, (s, _) in RULES.items()}), key), F.lit("S3")))
    out = out.withColumn("rule_id", F.coalesce(F.try_element_at(_map({k: r for k, (_, r) in RULES.items()}), key), made))
    return out.withColumn("outcome", _map(OUTCOME)[F.col("severity")])


def compare(expected: DataFrame, answers: DataFrame, found: DataFrame, minimum: DataFrame | None = None) -> DataFrame:
    """Classified differences: entity, intent, bucket, field, expected, actual, mismatch_type, severity, rule_id, outcome.

    answers: (entity, intent, status, items); found: (entity, intent, bucket, src, dst, edge_kind), the relations of all
    items. Without items nothing else of an answer is compared. A repeated expected relation that is missing counts
    each time, an unexpected one once.
    """
    asked = answers.select("entity", "intent", bucket_of(F.col("intent")).alias("bucket"), "status", "items")
    row = lambda df, field, want, have, first: df.select("entity", "intent", "bucket", field.alias("field"), want.cast("string").alias("expected"), have.cast("string").alias("actual"), first.alias("first"))
    none = F.lit(None)
    odd = row(asked.filter(~F.coalesce(F.col("status").isin("hit", "enriched"), F.lit(False))), F.lit("status"), F.lit("hit|enriched"), F.col("status"), F.lit(True))
    empty = row(asked.filter(F.coalesce("items", F.lit(0)) <= 0), F.lit("data.items.length"), F.lit(">0"), F.lit(0), F.lit(False))
    full = asked.filter(F.col("items") > 0).select("entity", "intent", "bucket")
    at = F.concat(F.lit("rel."), F.col("bucket"))
    want = full.join(expected.select("entity", "bucket", relation_key().alias("key")), ["entity", "bucket"])
    have = full.join(found.select("entity", "intent", "bucket", relation_key().alias("key")), ["entity", "intent", "bucket"])
    on = ["entity", "intent", "bucket", "key"]
    missing = row(want.join(have.select(*on).distinct(), on, "left_anti"), at, F.col("key"), none, F.lit(False))
    extra = row(have.select(*on).distinct().join(want.select(*on).distinct(), on, "left_anti"), at, none, F.col("key"), F.lit(False))
    out = odd.unionByName(empty).unionByName(missing).unionByName(extra)
    if minimum is not None:
        per = ["entity", "intent", "bucket"]
        counted = want.groupBy(*per).agg(F.count(F.lit(1)).alias("wanted")).join(minimum, ["entity", "bucket"]).join(have.groupBy(*per).agg(F.count(F.lit(1)).alias("n")), per, "left")
        short = counted.withColumn("n", F.coalesce("n", F.lit(0))).filter(F.col("n") < F.col("minimum"))
        out = out.unionByName(row(short, F.concat(at, F.lit(" (minimum_count)")), F.concat(F.lit(">="), F.col("minimum").cast("string")), F.col("n"), F.lit(False)))
    return classify(out.withColumn("mismatch_type", mismatch(F.col("field"), F.col("first"))).drop("first"))


_WORST = {"fail": 0, "warn": 1, "pass": 2}


def results(answers: DataFrame, differences: DataFrame) -> DataFrame:
    """For each answer its outcome and how many differences there are of each."""
    n = lambda o: F.sum((F.col("outcome") == o).cast("long"))
    by = differences.groupBy("entity", "intent").agg(F.count(F.lit(1)).alias("total_diffs"), n("fail").alias("fail_count"), n("warn").alias("warn_count"), n("pass").alias("pass_count"))
    out = answers.select("entity", "intent", bucket_of(F.col("intent")).alias("bucket")).join(by, ["entity", "intent"], "left").fillna(0, ["total_diffs", "fail_count", "warn_count", "pass_count"])
    return out.withColumn("ci_outcome", F.when(F.col("fail_count") > 0, "fail").when(F.col("warn_count") > 0, "warn").otherwise("pass"))


def report(result: DataFrame) -> DataFrame:
    """The worst outcome of each entity."""
    worst = F.min(_map(_WORST)[F.col("ci_outcome")])
    return result.groupBy("entity").agg(worst.alias("w")).select("entity", F.element_at(F.array(*map(F.lit, _WORST)), F.col("w") + 1).alias("ci_outcome"))


def aggregate(entities: DataFrame) -> DataFrame:
    """One row: entities by outcome, and the whole run's."""
    n = lambda o: F.coalesce(F.sum((F.col("ci_outcome") == o).cast("long")), F.lit(0)).alias(f"{o}_entities")
    out = entities.agg(F.count(F.lit(1)).alias("total_entities"), n("fail"), n("warn"), n("pass"))
    return out.withColumn("ci_outcome", F.when(F.col("fail_entities") > 0, "fail").when(F.col("warn_entities") > 0, "warn").otherwise("pass"))


def run_id(names: list[str]) -> str:
    """The same for the same names: a 32-bit multiply-by-33 hash with xor over their sorted list."""
    h = 5381
    for c in ",".join(sorted(names)):
        h = (h * 33 ^ ord(c)) & 0xFFFFFFFF
    return f"run-{h:08x}"


def run_ids(entities: DataFrame, by: str) -> DataFrame:
    """run_id() of the names of each group; a group is a run's entities, whose names fit in a row."""
    code = "ascii(substring(s, i, 1))"
    step = f"aggregate(sequence(1, length(s)), cast(5381 as bigint), (h, i) -> ((h * 33) & 4294967295L) ^ {code})"
    listed = entities.select(by, "entity").distinct().groupBy(by).agg(F.array_join(F.array_sort(F.collect_set("entity")), ",").alias("s"))
    return listed.select(by, F.concat(F.lit("run-"), F.lpad(F.lower(F.hex(F.expr(f"if(length(s) = 0, 5381L, {step})"))), 8, "0")).alias("run_id"))


def _outcome(score: str, hard: Column) -> Column:
    return F.when(hard, "FAIL").when(F.col(score) >= PASS_AT, "PASS").when(F.col(score) >= WARN_AT, "WARN").otherwise("FAIL")


def score(inputs: DataFrame) -> DataFrame:
    """Inputs (entity, family, coverage, backend, evidence, consistency in [0, 1], has_s0_s1) with confidence, outcome and hints."""
    total = sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0))
    out = inputs.withColumn("confidence", total).withColumn("outcome", _outcome("confidence", F.coalesce(F.col("has_s0_s1"), F.lit(False))))
    return out.withColumn("hints", F.filter(F.array(*(F.when(F.col(c) < limit, F.lit(text)) for c, limit, text in HINTS)), lambda x: x.isNotNull()))


def families(scored: DataFrame) -> DataFrame:
    """Average confidence, outcome and the entities below the lower threshold of each family."""
    by = scored.groupBy("family").agg(
        F.count(F.lit(1)).alias("entity_count"), F.avg("confidence").alias("avg_confidence"), F.max(F.coalesce(F.col("has_s0_s1"), F.lit(False))).alias("hard"),
        F.array_sort(F.collect_set(F.when(F.col("confidence") < WARN_AT, F.col("entity")))).alias("low_confidence_entities"),
    )
    return by.select("family", "entity_count", "avg_confidence", _outcome("avg_confidence", F.col("hard")).alias("ci_outcome"), "low_confidence_entities")


def trend(runs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Each run (run_id, ts, confidence, max_severity) against the one before it: change, crossing of a threshold, worse severity, verdict."""
    w = Window.partitionBy(*(by or [])).orderBy("ts", "run_id")
    was = {f"prior_{c}": F.lag(c).over(w) for c in ("run_id", "confidence", "max_severity")}
    r = runs.withColumns(was).filter("prior_run_id IS NOT NULL")
    grade = lambda c: F.when(F.col(c) >= PASS_AT, "PASS").when(F.col(c) >= WARN_AT, "WARN").otherwise("FAIL")
    steps = F.concat_ws("->", grade("prior_confidence"), grade("confidence"))
    rank = _map(SEVERITY_ORDER)
    delta = F.col("confidence") - F.col("prior_confidence")
    r = r.withColumn("confidence_delta", delta).withColumn("severity_escalated", F.coalesce(F.try_element_at(rank, "max_severity") > F.try_element_at(rank, "prior_max_severity"), F.lit(False)))
    r = r.withColumn("ci_boundary_crossed", F.when(steps.isin("PASS->WARN", "PASS->FAIL", "WARN->FAIL"), steps).otherwise("none"))
    verdict = F.when(F.col("ci_boundary_crossed") != "none", "THRESHOLD_BREACH").when(F.col("confidence_delta") > TREND_STEP, "IMPROVING").when((F.col("confidence_delta") < -TREND_STEP) | F.col("severity_escalated"), "DEGRADING").otherwise("STABLE")
    return r.withColumn("verdict", verdict)


def completeness(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """For each entity its relations by bucket, which tiers it has, the missing buckets, and the percent of all points."""
    n = [F.sum(F.when(F.col("bucket") == b, 1).otherwise(0)).cast("long").alias(b) for b in BUCKETS]
    out = entities.select("entity").distinct().join(relations.groupBy("entity").agg(*n), "entity", "left").fillna(0, list(BUCKETS))
    any_of = lambda names: F.greatest(*(F.col(b) for b in names)) > 0
    for k, (_, names) in enumerate(TIERS, 1):
        out = out.withColumn(f"tier{k}_complete", any_of(names))
    points = sum((F.when(F.col(f"tier{k}_complete"), p).otherwise(0) for k, (p, _) in enumerate(TIERS, 1)), F.lit(0))
    missing = F.filter(F.array(*(F.when(F.col(b) == 0, F.lit(b)) for b in BUCKETS)), lambda x: x.isNotNull())
    return out.withColumn("completeness_score", points / F.lit(10) * 100).withColumn("missing_relations", missing)


def audit(scores: DataFrame) -> DataFrame:
    """One row: entities, average score, how many have the tiers 1, 1 and 2, and all, with percents, and all relations."""
    t = [F.col(f"tier{k}_complete") for k in (1, 2, 3)]
    n = lambda cond: F.coalesce(F.sum(cond.cast("long")), F.lit(0))
    tiers = {"tier1_only": t[0] & ~t[1] & ~t[2], "tier1_and_2": t[0] & t[1] & ~t[2], "tier1_and_2_and_3": t[0] & t[1] & t[2]}
    out = scores.agg(F.count(F.lit(1)).alias("total_apis"), F.round(F.avg("completeness_score"), 1).alias("average_completeness_score"), *(n(c).alias(k) for k, c in tiers.items()), F.coalesce(F.sum(sum((F.col(b) for b in BUCKETS), F.lit(0))), F.lit(0)).alias("total_relations"))
    return out.withColumns({f"{k}_percentage": F.round(F.col(k) * 100 / F.col("total_apis"), 1) for k in tiers})


def needing_follow_up(scores: DataFrame, below: float = 70.0, worst: int = 10) -> DataFrame:
    """The least complete entities below a limit; this report lists ten."""
    return scores.filter(F.col("completeness_score") < below).orderBy("completeness_score", "entity").limit(worst).select("entity", "completeness_score", "missing_relations")


def schema_errors(fixtures: DataFrame) -> DataFrame:
    """Rows (entity, field, severity) for what breaks the form, from fixtures (entity, json); entity tells documents apart."""
    v = F.try_parse_json(F.col("json"))

    def kind(path: str) -> Column:
        """The JSON type at a path: null where there is nothing."""
        return F.split(F.schema_of_variant(F.try_variant_get(v, path, "variant")), "<")[0]

    text = lambda path: F.try_variant_get(v, path, "string")
    is_text = lambda path: F.coalesce((kind(path) == "STRING") & (F.length(text(path)) > 0), F.lit(False))
    is_kind = lambda path, name: F.coalesce(kind(path) == name, F.lit(False))
    given = lambda path: kind(path).isNotNull()
    count = lambda path: F.coalesce(F.json_array_length(F.get_json_object("json", path)), F.lit(0))
    whole = is_kind("$", "OBJECT")
    sourced, related = is_kind("$.source", "OBJECT"), is_kind("$.relations", "OBJECT")
    number = F.try_variant_get(v, "$.source.line", "double")
    line = F.coalesce(kind("$.source.line").isin("BIGINT", "DOUBLE") | kind("$.source.line").startswith("DECIMAL"), F.lit(False)) & F.coalesce((number > 0) & (number == F.floor(number)), F.lit(False))
    kinds = list(FAMILIES)
    errors = [("(root)", ~whole), ("kind", whole & ~(is_text("$.kind") & F.coalesce(text("$.kind").isin(*kinds), F.lit(False))))]
    errors += [(name, whole & ~is_text(f"$.{name}")) for name in ("kind_verbose", "canonical_name")]
    errors += [("aliases", whole & ~is_kind("$.aliases", "ARRAY")), ("source", whole & ~sourced), ("source.file", sourced & ~is_text("$.source.file")), ("source.line", sourced & ~line), ("description", whole & ~is_text("$.description")), ("relations", whole & ~related)]
    errors += [(f"relations.{b}", related & ~is_kind(f"$.relations.{b}", "ARRAY")) for b in BUCKETS]
    for family, needed in FAMILIES.items():
        filled = F.greatest(*(count(f"$.relations.{b}") for b in needed), F.lit(0)) > 0
        errors.append((f"relations[{'|'.join(needed)}]", related & is_text("$.kind") & (text("$.kind") == family) & ~filled))
    contract = given("$.contract") & (kind("$.contract") != "VOID")
    errors.append(("contract", contract & ~is_kind("$.contract", "OBJECT")))
    errors += [(f"contract.{c}", is_kind("$.contract", "OBJECT") & given(f"$.contract.{c}") & ~is_kind(f"$.contract.{c}", t)) for c, t in (("required_relation_kinds", "ARRAY"), ("required_directions", "ARRAY"), ("minimum_counts", "OBJECT"))]
    item = lambda field, severity: F.struct(F.lit(field).alias("field"), F.lit(severity).alias("severity"))
    found = [F.when(F.coalesce(broken, F.lit(False)), item(field, "error")) for field, broken in errors]
    found.append(F.when(whole & is_text("$.description") & (F.length(text("$.description")) < 10), item("description", "warning")))
    return fixtures.select("entity", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("e")).select("entity", "e.*")


def verify(expected: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each entity as pass (all relations in the graph), partial, fail (none), node-only (nothing expected) or node-missing."""
    have = edges.select("src", "dst", "edge_kind").distinct().withColumn("hit", F.lit(1))
    met = expected.join(have, ["src", "dst", "edge_kind"], "left").groupBy("entity").agg(F.count("src").alias("want"), F.count("hit").alias("have"))
    known = nodes.select(F.col("canonical_name").alias("entity")).distinct().withColumn("node", F.lit(True))
    out = met.join(known, "entity", "left")
    status = F.when(F.col("node").isNull(), "node-missing").when(F.col("want") == 0, "node-only").when(F.col("have") == F.col("want"), "pass").when(F.col("have") > 0, "partial").otherwise("fail")
    return out.select("entity", "want", "have", status.alias("status"))


_BADGE = {"fail": "❌ FAIL", "warn": "⚠️  WARN", "pass": "✅ PASS"}


def markdown(result: DataFrame, differences: DataFrame, generated: str) -> str:
    """The report of a run as a page: the run, its outcome, counts, and a table of each answer's differences.

    A rendered page is read on the driver: it is for runs whose differences a person reads.
    """
    import json

    rows, found = result.orderBy("entity", "intent").collect(), differences.orderBy("entity", "intent", "field", "expected", "actual").collect()
    by: dict[tuple, list] = {}
    for d in found:
        by.setdefault((d["entity"], d["intent"]), []).append(d)
    entities: dict[str, list] = {}
    for r in rows:
        entities.setdefault(r["entity"], []).append(r)
    worst = lambda rs: min((r["ci_outcome"] for r in rs), key=_WORST.get, default="pass")
    counts = {o: sum(worst(rs) == o for rs in entities.values()) for o in _WORST}
    out = ["# Comparator Report", "", f"**Run ID:** `{run_id(list(entities))}`  ", f"**Generated:** {generated}  ", f"**Fixtures:** {len(entities)}", "", f"## CI Outcome: {_BADGE[worst(rows)]}", ""]
    out += ["## Aggregate Summary", "", "| Metric | Count |", "|--------|-------|", f"| Total entities | {len(entities)} |", *(f"| {o.title()} entities | {n} |" for o, n in counts.items()), ""]
    if entities:
        out += ["## Entity Results", ""]
    for name, rs in entities.items():
        out += [f"### {name} {_BADGE[worst(rs)]}", ""]
        for r in rs:
            if not (diffs := by.get((name, r["intent"]))):
                continue
            out += [f"#### Intent: `{r['intent']}` (bucket: `{r['bucket']}`)", "", "| Field | Expected | Actual | Mismatch Type | Severity | Rule ID |", "|-------|----------|--------|---------------|----------|---------|"]
            out += [f"| `{d['field']}` | {json.dumps(d['expected'])} | {json.dumps(d['actual'])} | {d['mismatch_type']} | {d['severity']} | `{d['rule_id']}` |" for d in diffs]
            out.append("")
    return "\n".join(out)


def write_report(result: DataFrame, differences: DataFrame, path: str) -> None:
    """The run's tables as JSON lines, written by the executors: answers and differences."""
    result.write.mode("overwrite").json(f"{path}/results")
    differences.write.mode("overwrite").json(f"{path}/differences")
