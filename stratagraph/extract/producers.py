"""Front ends as producers: files read and parsed by the workers, then joined for what one file can't tell.

A file is parsed where it is read, in Arrow batches; nothing of a workspace is on the driver. What needs
other files are joins: marked paths with the list of files, in the order in which a language looks for
them, and targets of C with the names of known functions and types.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.extract import c, packs, rust, typescript
from stratagraph.extract.facts import EDGE, MARK, SYMBOL, TYPE, Facts
from stratagraph.operators.ingest import FACTS
from stratagraph.sources import files
from stratagraph.sources.tables import settle, settled_small, ship

# How languages look for the file of a path, in order.
_JS = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs")
_STRIPPED = (".js", ".mjs", ".cjs", ".jsx")

_LANGUAGES = {"typescript": typescript.extract, "rust": rust.extract, "c": c.extract}

#: The kinds of facts that front ends find, and the columns of those that aren't text.
KINDS = ("symbol", "edge", "type")
_COLUMNS = {"symbol": SYMBOL, "edge": EDGE, "type": TYPE}
_TYPES = dict.fromkeys(("at_line", "end_line", "line_count", "rank"), "long") | dict.fromkeys(("confidence", "otherwise_confidence"), "double") | dict.fromkeys(("exported", "evidence"), "boolean")
#: What columns of FACTS are made of where that isn't a column of the same name, and what the joins of a language look at.
_MADE_OF = {
    "file_path": ("at_file",), "line": ("at_line",), "site_file": ("at_file",), "site_line": ("at_line",), "source_kind": ("evidence",), "evidence_file": ("at_file", "evidence"), "evidence_line": ("at_line", "evidence"),
}
_BY_PATHS = ("dst_symbol", "confidence", "resolution_kind", "otherwise_dst", "otherwise_confidence", "otherwise_kind")
_BY_NAMES = ("symbol_kind", "name", "edge_kind", "src_symbol", "dst_symbol", "at_file", "at_line", "tags", "needs", "rank", "seq")
#: Rows of a batch on its way to the JVM.
_ROWS = 10_000


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(p.split()[0], kinds[p.split()[1]]) for p in ddl.split(", ")])


def _schema(kinds: tuple[str, ...], only: set[str] | None = None) -> str:
    """What the workers hand over: the columns of the kinds, or some of them. The wide rows of FACTS follow from these."""
    return ", ".join(["kind string", *(f"{name} {_TYPES.get(name, 'string')}" for name in dict.fromkeys(n for k in kinds for n in _COLUMNS[k]) if only is None or name in only)])


def _batches(facts: Facts, schema: pa.Schema):
    """The facts so far, a batch for each kind; columns are made at once, not row by row."""
    for kind, columns, rows in facts.kinds:
        for k in range(0, len(rows), _ROWS):
            some = rows[k : k + _ROWS]
            given = dict(zip(columns, zip(*some)))
            made = [pa.array(given[f.name], f.type) if f.name in given else pa.repeat(pa.scalar(kind), len(some)) if f.name == "kind" else pa.nulls(len(some), f.type) for f in schema]
            yield pa.RecordBatch.from_arrays(made, schema=schema)
        rows.clear()


def parsed(sources: DataFrame, language: str, kinds: tuple[str, ...] = KINDS, only: set[str] | None = None, **options) -> DataFrame:
    """Facts of some kinds of the files (file_path, text), and what they still need. A file that a front end can't read gives its module only, with the error."""
    schema = _schema(kinds, only)
    arrow, extract = _arrow(schema), _LANGUAGES[language]
    ship(sources.sparkSession)

    def run(batches):
        f = Facts(language, kinds)
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                before = f.mark()
                try:
                    extract(path, text or "", f, **options)
                except (IndexError, KeyError, RecursionError, ValueError) as e:  # a file of any kind may come
                    f.back(before)
                    f.symbol("module", f"module:{path}", path, 1, error=f"{type(e).__name__}: {e}")
                if len(f) >= _ROWS:
                    yield from _batches(f, arrow)
            yield from _batches(f, arrow)

    out = sources.select(F.col("file_path").cast("string"), F.col("text").cast("string")).mapInArrow(run, schema)
    return out if only is not None and "seq" not in only else out.withColumn("seq", F.monotonically_increasing_id())


def _wide(facts: DataFrame, language: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """The rows as ingest takes them, or some of their columns."""
    symbol, edge, evidence = F.col("kind") == "symbol", F.col("kind") == "edge", F.col("evidence") if "evidence" in facts.columns else F.lit(False)
    follows = {
        "produced_by": F.array(F.lit(language)), "file_path": F.when(symbol, F.col("at_file")), "line": F.when(symbol, F.col("at_line")), "site_file": F.when(edge, F.col("at_file")), "site_line": F.when(edge, F.col("at_line")),
        "derivation": F.when(edge, F.lit("clangd")), "source_kind": F.when(evidence, F.lit("file_line")), "evidence_file": F.when(evidence, F.col("at_file")), "evidence_line": F.when(evidence, F.col("at_line")),
    }
    fields = [p.split() for p in FACTS.split(", ")]
    if columns is not None:
        kinds = dict(fields)
        fields = [(n, kinds[n]) for n in columns]
    return facts.select(*(follows[n].alias(n) if n in follows else F.col(n) if n in facts.columns else F.lit(None).cast(kind).alias(n) for n, kind in fields))


def _candidates(language: Column, path: Column) -> Column:
    """The files that a marked path may mean, first ones first."""
    add = lambda base, ends: F.array(*(F.concat(base, F.lit(e)) for e in ends))
    bare = F.regexp_replace(path, r"\.(?:js|mjs|cjs|jsx)$", "")
    stripped = bare != path
    none = F.array().cast("array<string>")
    indexes = tuple(f"/index{e}" for e in _JS)
    js = F.concat(F.when(stripped, add(bare, _JS)).otherwise(none), add(path, _JS), add(path, indexes), F.when(stripped, add(bare, indexes)).otherwise(none))
    src = F.concat(F.lit("src/"), path)
    parent = F.regexp_replace(src, "/[^/]*$", "")
    deep = path.contains("/")
    rs = F.concat(add(src, (".rs", "/mod.rs")), F.when(deep, add(parent, (".rs",))).otherwise(none))
    rs2 = F.concat(add(src, (".rs", "/mod.rs")), F.when(deep, add(parent, (".rs", "/mod.rs"))).otherwise(none))
    return F.when(language == "rs", rs).when(language == "rs2", rs2).otherwise(js)


def _mark(name: Column) -> Column:
    """What stands between the marks of a name, or null."""
    return F.when(name.contains(MARK), F.substring_index(F.substring_index(name, MARK, 2), MARK, -1))


def with_paths(facts: DataFrame, paths: DataFrame) -> DataFrame:
    """Facts in which every marked path is the file that it means, among `paths` (file_path), or else what stands for it.

    Every mark is looked up once, however many facts have it; facts without one take no part in a join.
    """
    target, other = _mark(F.col("dst_symbol")), _mark(F.col("otherwise_dst"))
    has = lambda name: F.coalesce(F.col(name).contains(MARK), F.lit(False))
    marked = facts.filter(has("dst_symbol"))
    asked = marked.select(F.explode(F.array(target, other)).alias("__m")).filter("__m IS NOT NULL").distinct()
    part = lambda k: F.get(F.split("__m", r"\|"), F.lit(k))
    places = asked.select("__m", F.posexplode(_candidates(part(0), part(1))).alias("rank", "file_path"))
    known = settled_small(places.join(paths.select("file_path").distinct(), "file_path").groupBy("__m").agg(F.min(F.struct("rank", "file_path"))["file_path"].alias("__file")))

    def put(df: DataFrame) -> DataFrame:
        df = df.withColumn("__mark", _mark(F.col("dst_symbol"))).join(known, F.col("__mark") == F.col("__m"), "left")
        lost = F.col("__file").isNull()
        other = lost & F.col("otherwise_dst").isNotNull()
        name = F.concat(F.substring_index("dst_symbol", MARK, 1), F.coalesce("__file", F.get(F.split("__mark", r"\|"), F.lit(2)), F.lit("")), F.substring_index("dst_symbol", MARK, -1))
        df = df.withColumns({
            "confidence": F.when(other, F.col("otherwise_confidence")).otherwise(F.col("confidence")),
            "resolution_kind": F.when(other, F.col("otherwise_kind")).otherwise(F.col("resolution_kind")),
            "dst_symbol": F.when(other, F.col("otherwise_dst")).otherwise(name),
        })
        return df.drop("__mark", "__m", "__file")

    second = has("otherwise_dst")  # a replaced target may itself hold a mark: that of an import
    again = put(marked.filter(second)).filter(has("dst_symbol")).withColumn("otherwise_dst", F.lit(None).cast("string"))
    return facts.filter(~has("dst_symbol")).unionByName(put(marked).filter(~(second & has("dst_symbol")))).unionByName(put(again))


def with_known(facts: DataFrame) -> DataFrame:
    """Facts without edges to names that aren't of a known function or type; of ranked ones the first known one.

    Names that their own file defines are known to the front end already, and need nothing. Every other
    name is looked up once, however many edges have it.
    """
    asked = facts.filter("needs IS NOT NULL")
    symbols = facts.filter("kind = 'symbol'").select(F.when(F.col("symbol_kind") == "function", "functions").when(F.col("symbol_kind").isin("struct", "enum", "typedef"), "types").alias("__n"), F.col("name").alias("__k"))
    names = asked.select(F.col("needs").alias("__n"), F.col("dst_symbol").alias("__k")).distinct()
    known = settled_small(names.join(symbols.filter("__n IS NOT NULL"), ["__n", "__k"], "left_semi"))
    there = asked.join(known, (F.col("needs") == F.col("__n")) & (F.col("dst_symbol") == F.col("__k")), "left_semi")
    ranked = there.filter("rank IS NOT NULL")
    how = F.get_json_object("tags", "$.registration_kind").alias("how")
    place = F.when(F.col("edge_kind") == "registers_callback", F.col("at_line")).alias("place")
    first = ranked.groupBy("edge_kind", "src_symbol", "at_file", place, how).agg(F.min_by(F.struct(*ranked.columns), F.struct("rank", "seq")).alias("r")).select("r.*")
    return facts.filter("needs IS NULL").unionByName(there.filter("rank IS NULL")).unionByName(first)


def registrations(facts: DataFrame) -> DataFrame:
    """The registrations among the facts, as ingest.runtime_calls() takes them."""
    tag = lambda name: F.get_json_object("tags", f"$.{name}")
    return facts.filter("edge_kind = 'registers_callback'").select(F.col("src_symbol").alias("registrar"), F.col("dst_symbol").alias("callback"), tag("dispatch_key").alias("dispatch_key"), tag("struct_type").alias("struct_type"), F.col("site_file").alias("file_path"), F.col("site_line").alias("line"))


def sources(spark: SparkSession, root: str, extensions: tuple[str, ...], skip: tuple[str, ...] = files.SKIPPED, only: DataFrame | None = None) -> DataFrame:
    """file_path and text of the files below a root, hidden directories left out."""
    found = files.walk(spark, root, extensions, skip, only).filter(~F.exists(F.split("file_path", "/"), lambda p: p.startswith(".")))
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.col("path").alias("__p"), "content")
    return found.join(read, F.col("path") == F.col("__p")).select("file_path", F.decode("content", "UTF-8").alias("text"))


@dataclass
class Producer:
    """A front end for ingest.run_producers(): context is the root of a workspace, or a DataFrame of (file_path, text)."""

    language: str
    extensions: tuple[str, ...]
    options: dict = field(default_factory=dict)

    def _files(self, spark: SparkSession, context) -> DataFrame:
        if isinstance(context, DataFrame):
            ends = F.concat(F.lit("."), F.lower(F.element_at(F.split("file_path", r"\."), -1)))
            return context.filter(ends.isin(*self.extensions))
        return sources(spark, context, self.extensions)

    def applies_to(self, context) -> bool:
        if isinstance(context, DataFrame):
            return not self._files(context.sparkSession, context).isEmpty()
        return not files.walk(SparkSession.active(), context, self.extensions).isEmpty()

    def facts(self, spark: SparkSession, context, kinds: tuple[str, ...] = KINDS, columns: tuple[str, ...] | None = None) -> DataFrame:
        """The facts of some kinds, with some of the columns of FACTS; what isn't asked for is neither made nor written. Without edges no other file is needed, and nothing is written in between."""
        found = self._files(spark, context)
        read = (*kinds, "symbol") if self.language == "c" and "edge" in kinds and "symbol" not in kinds else kinds
        joined = () if "edge" not in kinds else _BY_NAMES if self.language == "c" else _BY_PATHS
        out = parsed(found, self.language, read, None if columns is None else {*joined, *(n for c in columns for n in _MADE_OF.get(c, (c,)))}, **self.options)
        if "edge" in kinds:
            out = with_known(settle(out)) if self.language == "c" else with_paths(settle(out), found)
        return _wide(out if read == kinds else out.filter(F.col("kind").isin(*kinds)), self.language, columns)


TYPESCRIPT = Producer("typescript", typescript.EXTENSIONS)
RUST = Producer("rust", rust.EXTENSIONS)
C = Producer("c", c.EXTENSIONS, {"log_macros": packs.LOG_MACROS, "registrations": packs.REGISTRATIONS})
