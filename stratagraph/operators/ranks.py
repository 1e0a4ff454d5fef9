"""Rankings, counts and summaries: aggregates whose partial sums are combined before any shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagraph.operators.hops import LIMIT
from stratagraph.plans.graph import Graph, resolved

FUNCTIONS = ("function", "method")


def _ranked(df: DataFrame, kind: Column | str, name: str, edge_kind: str, rank: str, limit: int, *more: str) -> DataFrame:
    kind = F.col(kind) if isinstance(kind, str) else kind
    shown = df.select(kind.alias("kind"), F.col(name).alias("canonical_name"), F.lit(edge_kind).alias("edge_kind"), F.lit(1.0).alias("confidence"), F.lit("clangd").alias("derivation"), F.col(rank).cast("long").alias(rank), *more)
    if rank != "incoming_count":
        shown = shown.withColumn("incoming_count", F.col(rank))
    return shown.orderBy(F.col(rank).desc(), "canonical_name", "kind").limit(limit)


def top_by_incoming(g: Graph, edge_kind: str, kind: str | None = None, limit: int = LIMIT) -> DataFrame:
    e = g.of(edge_kind)
    if kind:
        e = e.filter(F.col("dst_kind") == kind)
    return _ranked(e.groupBy("dst", "dst_kind").agg(F.count(F.lit(1)).alias("incoming_count")), "dst_kind", "dst", edge_kind, "incoming_count", limit)


def largest_modules(g: Graph, limit: int = LIMIT) -> DataFrame:
    n = g.nodes.filter((F.col("kind") == "module") & F.col("line_count").isNotNull())
    return n.select("kind", "canonical_name", "file_path", F.col("line").alias("line_number"), "line_count").orderBy(F.col("line_count").desc(), "canonical_name").limit(limit)


def long_functions(g: Graph, min_lines: int = 50, limit: int = LIMIT) -> DataFrame:
    n = g.nodes.filter(F.col("kind").isin(*FUNCTIONS) & (F.col("line_count") >= min_lines))
    return n.select("kind", "canonical_name", "file_path", F.col("line").alias("line_number"), "line_count").orderBy(F.col("line_count").desc(), "canonical_name").limit(limit)


def modules_by_directory(g: Graph, limit: int = LIMIT) -> DataFrame:
    n = g.nodes.filter((F.col("kind") == "module") & F.startswith(F.lower(F.col("canonical_name")), F.lit("module:")) & F.col("canonical_name").substr(9, 1 << 20).contains("/"))
    by = n.groupBy(F.regexp_replace("canonical_name", "/[^/]*$", "").alias("dir")).agg(F.count(F.lit(1)).alias("module_count"), F.sum(F.coalesce("line_count", F.lit(0).cast("long"))).alias("total_lines"))
    return by.select(F.lit("directory").alias("kind"), F.col("dir").alias("canonical_name"), "module_count", "total_lines").orderBy(F.col("module_count").desc(), "canonical_name").limit(limit)


def members_per_type(g: Graph, kinds: tuple[str, ...], member: str, column: str, limit: int = LIMIT) -> DataFrame:
    c = g.of("contains").filter(F.col("src_kind").isin(*kinds) & (F.col("dst_kind") == member))
    return _ranked(c.groupBy("src", "src_kind").agg(F.count(F.lit(1)).alias(column)), "src_kind", "src", "contains", column, limit)


def module_of(column: str) -> Column:
    return F.substring_index(F.col(column), "#", 1)


def widely_referenced_types(g: Graph, limit: int = LIMIT) -> DataFrame:
    e = g.of("references_type").filter(F.col("dst_kind").isin("class", "interface", "typedef") & F.col("src").contains("#"))
    # distinct pairs first: a type that everything refers to doesn't gather its modules in one task
    pairs = e.select("dst", "dst_kind", module_of("src").alias("m")).distinct()
    return _ranked(pairs.groupBy("dst", "dst_kind").agg(F.count(F.lit(1)).alias("module_count")), "dst_kind", "dst", "references_type", "module_count", limit)


def tightly_coupled_modules(g: Graph, limit: int = LIMIT) -> DataFrame:
    e = g.of("calls", "references_type").filter(F.col("src").contains("#") & F.col("dst").contains("#"))
    by = e.groupBy(module_of("src").alias("caller"), module_of("dst").alias("callee")).agg(F.count(F.lit(1)).alias("edge_count")).filter("caller != callee")
    return by.select(F.lit("module").alias("kind"), F.col("caller").alias("canonical_name"), "caller", "callee", "edge_count").orderBy(F.col("edge_count").desc(), "caller", "callee").limit(limit)


TYPES = ("class", "struct", "interface")


def top_touched_types(g: Graph, limit: int = LIMIT) -> DataFrame:
    owned = g.of("contains").filter(F.col("src_kind").isin(*TYPES) & (F.col("dst_kind") == "field")).select(F.col("src").alias("owner"), F.col("src_kind").alias("owner_kind"), F.col("dst_node_id").alias("fid"), F.col("dst").alias("field"))
    access = g.of("reads_field", "writes_field").select(F.col("dst_node_id").alias("fid"), "src")
    touched = access.distinct().join(owned, "fid").groupBy("owner", "owner_kind", "src").agg(F.lit(1)).groupBy("owner", "owner_kind").agg(F.count(F.lit(1)).alias("toucher_count"))
    fields = owned.select(F.col("owner").alias("o"), "field").distinct().groupBy("o").agg(F.count(F.lit(1)).alias("field_count"))
    return _ranked(touched.join(fields, touched["owner"] == fields["o"]), "owner_kind", "owner", "touches", "toucher_count", limit, "field_count")


def top_field_accessors(g: Graph, edge_kind: str, limit: int = LIMIT) -> DataFrame:
    e = g.edges.filter((F.col("edge_kind") == edge_kind) & F.col("src_kind").isin(*FUNCTIONS))
    pairs = e.select("src", "src_kind", "dst_node_id").distinct()
    return _ranked(pairs.groupBy("src", "src_kind").agg(F.count("dst_node_id").alias("field_count")), "src_kind", "src", edge_kind, "field_count", limit)


def top_hot_fields(g: Graph, limit: int = LIMIT) -> DataFrame:
    e = g.of("reads_field", "writes_field").filter("dst_kind = 'field'")
    one = e.groupBy("dst", "dst_kind", "src_node_id").agg(F.sum((F.col("edge_kind") == "reads_field").cast("long")).alias("r"), F.sum((F.col("edge_kind") == "writes_field").cast("long")).alias("w"))
    by = one.groupBy("dst", "dst_kind").agg(F.count(F.lit(1)).alias("accessor_count"), F.sum("r").alias("read_count"), F.sum("w").alias("write_count"))
    return _ranked(by, "dst_kind", "dst", "field_access", "accessor_count", limit, "read_count", "write_count")


def field_co_access(g: Graph, limit: int = LIMIT) -> DataFrame:
    """Pairs of fields of one type that at least two callers touch together."""
    owned = g.of("contains").filter("dst_kind = 'field'").select(F.col("src").alias("owner"), F.col("dst_node_id").alias("fid"), F.col("dst").alias("field"))
    a = g.of("reads_field", "writes_field").select(F.col("src_node_id").alias("toucher"), F.col("dst_node_id").alias("fid")).distinct().join(owned, "fid").select("toucher", "owner", "field").distinct()
    b = a.withColumnRenamed("field", "other")
    pairs = a.join(b, ["toucher", "owner"]).filter("field < other").groupBy("owner", "field", "other").agg(F.count(F.lit(1)).alias("co_count")).filter("co_count >= 2")
    return pairs.select(F.lit("field").alias("kind"), F.col("field").alias("canonical_name"), F.col("field").alias("caller"), F.col("other").alias("callee"), "owner", "co_count").orderBy(F.col("co_count").desc(), "caller", "callee", "owner").limit(limit)


def unique_callers(g: Graph, limit: int = LIMIT) -> DataFrame:
    e = g.of("calls").filter(F.col("dst_kind").isin(*FUNCTIONS) & (F.col("src_node_id") != F.col("dst_node_id")))
    by = e.groupBy("dst", "dst_kind").agg(F.min("src_node_id").alias("a"), F.max("src_node_id").alias("b"), F.min("src").alias("unique_caller")).filter("a = b")
    return by.select(F.col("dst_kind").alias("kind"), F.col("dst").alias("canonical_name"), F.col("unique_caller").alias("caller"), F.col("dst").alias("callee"), "unique_caller").orderBy("canonical_name", "kind").limit(limit)


def god_methods(g: Graph, limit: int = LIMIT) -> DataFrame:
    """Calls in, calls out and distinct fields touched, of functions that have any."""
    # each edge gives a count to its ends; one aggregation instead of three joins
    calls = g.edges.filter("edge_kind = 'calls'")
    into = calls.select(F.col("dst_node_id").alias("node_id"), F.lit(1).alias("i"), F.lit(0).alias("o"), F.lit(0).alias("f"))
    out = calls.select(F.col("src_node_id").alias("node_id"), F.lit(0).alias("i"), F.lit(1).alias("o"), F.lit(0).alias("f"))
    touch = g.edges.filter(F.col("edge_kind").isin("reads_field", "writes_field")).select(F.col("src_node_id").alias("node_id"), "dst_node_id").distinct().select("node_id", F.lit(0).alias("i"), F.lit(0).alias("o"), F.lit(1).alias("f"))
    by = into.unionByName(out).unionByName(touch).groupBy("node_id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"), F.sum("f").alias("field_touches"))
    n = g.nodes.filter(F.col("kind").isin(*FUNCTIONS)).select("node_id", "kind", "canonical_name")
    scored = n.join(by, "node_id").withColumn("score", F.col("fan_in") + F.col("fan_out") + F.col("field_touches")).filter("score > 0")
    return _ranked(scored, "kind", "canonical_name", "god_method", "score", limit, "fan_in", "fan_out", "field_touches")


def module_top_exports(g: Graph, name: str, limit: int = LIMIT) -> DataFrame:
    at = resolved(g.nodes, [name])
    c = g.of("contains")
    kids = c.join(at, c["src"] == at["name"], "left_semi").select("dst_node_id", F.col("dst").alias("canonical_name"), F.col("dst_kind").alias("kind"))
    kids = kids.join(g.nodes.filter("exported").select(F.col("node_id").alias("dst_node_id")), "dst_node_id", "left_semi")
    used = g.edges.filter(F.col("edge_kind").isin("calls", "references_type")).groupBy("dst_node_id").agg(F.count(F.lit(1)).alias("n"))
    return _ranked(kids.join(used, "dst_node_id", "left").withColumn("usage_count", F.coalesce("n", F.lit(0).cast("long"))), "kind", "canonical_name", "contains", "usage_count", limit)


def symbol_degree(g: Graph, name: str) -> DataFrame:
    at = resolved(g.nodes, [name])
    ids = F.broadcast(g.nodes.join(at, g.nodes["canonical_name"] == at["name"], "left_semi").select(F.col("node_id").alias("id")))
    side = lambda end, label: g.edges.join(ids, g.edges[f"{end}_node_id"] == ids["id"]).groupBy("edge_kind").agg(F.count(F.lit(1)).alias("edge_count")).select(F.lit(label).alias("direction"), "edge_kind", "edge_count")
    return side("src", "outgoing").unionByName(side("dst", "incoming")).orderBy("direction", F.col("edge_count").desc(), "edge_kind")


def modules_overview(g: Graph, limit: int | None = LIMIT, name: str | None = None) -> DataFrame:
    """For each module its symbols, exported symbols, and imports both ways."""
    m = g.nodes.filter("kind = 'module'")
    if name is not None:
        at = resolved(g.nodes, [name])
        m = m.join(at, m["canonical_name"] == at["name"], "left_semi")
    m = m.select("node_id", "kind", "canonical_name", "file_path", F.col("line").alias("line_number"), "line_count")
    kids = g.edges.filter("edge_kind = 'contains'").join(g.nodes.select(F.col("node_id").alias("dst_node_id"), "exported"), "dst_node_id")
    count = lambda df, key, *aggs: df.groupBy(F.col(key).alias("node_id")).agg(*aggs)
    one = F.count(F.lit(1))
    inside = count(kids, "src_node_id", one.alias("symbol_count"), F.sum(F.coalesce(F.col("exported"), F.lit(False)).cast("long")).alias("exported_count"))
    imports = g.edges.filter("edge_kind = 'imports'")
    out = m.join(inside, "node_id", "left").join(count(imports, "src_node_id", one.alias("outgoing_imports")), "node_id", "left").join(count(imports, "dst_node_id", one.alias("incoming_imports")), "node_id", "left")
    out = out.fillna(0, ["symbol_count", "exported_count", "outgoing_imports", "incoming_imports"]).drop("node_id").orderBy("canonical_name")
    return out if limit is None else out.limit(limit)


def external_imports(g: Graph, limit: int = LIMIT) -> DataFrame:
    """Imported names without a node. The names are the ids without their prefix."""
    e = g.edges.filter((F.col("edge_kind") == "imports") & F.col("dst").isNull() & F.col("dst_node_id").isNotNull())
    by = e.groupBy(F.regexp_replace("dst_node_id", "^graph_node:[0-9]+:symbol:", "").alias("name")).agg(F.count(F.lit(1)).alias("incoming_count"))
    return by.select(F.lit("external").alias("kind"), F.col("name").alias("canonical_name"), "incoming_count").orderBy(F.col("incoming_count").desc(), "canonical_name").limit(limit)


