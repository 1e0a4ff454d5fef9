"""URL filters: listed rules first, then a tree of path templates per host, judged by labelled purity.

Segments of a path become shapes (digit runs, hexadecimal keys and UUIDs are wildcards). Then, from
the root of each host's tree down, a node with more than BRANCH children keeps those with at least
1 / BRANCH of its pages, and the others become one wildcard; only segments that are wildcards as a
whole are left out. Then, from the deepest level up to the root, branches that differ in one segment
merge into one where their label rates can't be told apart from the pooled rate (|z| < Z); branches
without labels join them if no other one differs, and a branch that is alone keeps its segment. A
template's purity is its labelled pages' rate, shrunk towards its host's, which is shrunk towards the
rate over all; a template below `purity` is blocked.

The tree is built from counts per (host, shape path), combined before any shuffle; pages meet
their template again by one join on narrow rows.

Defined results: a url that is null or has no `://` has empty host and path, which is a template of
its own; several labels of one key count as their mean; repeated rows are judged alike, each in a
row of its own; an empty table gives an empty result; further columns are ignored.

Paths are taken whole, so the tree is as deep as the longest path and takes two steps for each level.

sql() reads MAX_DEPTH segments, leaves out of both rules all segments with a digit run in them and merges at the last
literal segment only: it is the same for short paths with one literal segment, like those of the given tables, and not
for others.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratagraph.llm.runtime import cut, small_side

#: MAX_DEPTH is that of sql() only.
MAX_DEPTH, BRANCH, Z = 6, 30, 1.96
STRENGTH, PURITY = 20.0, 0.5
#: (verdict, rule): a rule is a host and the start of a path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Segments that are wildcards by their shape; the same expressions hold in Java and RE2.
UUID, HEX = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", "^[0-9a-fA-F]{12,}$"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.expr("substring(__url, instr(__url, '://') + 3)")).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def by_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the last one that fits wins
        h, slash, p = text.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(slash + p))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _shape(segment: Column) -> Column:
    return F.when(segment.rlike(UUID), F.lit("{u}")).when(segment.rlike(HEX) & segment.rlike("[0-9]"), F.lit("{h}")).otherwise(F.regexp_replace(segment, "[0-9]+", "{n}"))


def _shapes(path: Column) -> Column:
    return F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), _shape)


#: Segments that are wildcards as a whole.
WILD = ("{n}", "{u}", "{h}", "{*}")


def _starred(d: int) -> Column:
    """segs with a wildcard at place d."""
    return F.concat(F.slice("segs", 1, d), F.array(F.lit("{*}")), F.slice("segs", d + 2, F.size("segs")))


def _branched(nodes: DataFrame, branch: int) -> DataFrame:
    """The nodes with the small ones of very many branches as one, from the root down."""
    # the most nodes of a host that are as long or longer; a level with `branch` of them has nothing to join
    sizes = nodes.groupBy("host", F.size("segs").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    longer = F.sum("n").over(Window.partitionBy("host").orderBy(F.desc("s")))
    most = {r["s"]: r["n"] for r in sizes.select("s", longer.alias("n")).groupBy("s").agg(F.max("n").alias("n")).collect()}
    for d in range(max(most, default=0)):
        if max(n for s, n in most.items() if s > d) <= branch:
            break
        t = nodes.withColumns({"prefix": F.array_join(F.slice("segs", 1, d), "/"), "seg": F.get("segs", F.lit(d))})
        kids = t.filter(F.col("seg").isNotNull()).groupBy("host", "prefix", "seg").agg(F.sum("n").alias("kid"))
        of = kids.groupBy("host", "prefix").agg(F.count(F.lit(1)).alias("kids"), F.sum("kid").alias("all")).filter(F.col("kids") > branch)
        wild = cut(kids.join(of, ["host", "prefix"]).filter((F.col("kid") * branch < F.col("all")) & ~F.col("seg").isin(*WILD)).select("host", "prefix", "seg", F.lit(True).alias("wild")))
        if not wild.isEmpty():
            t = t.join(wild, ["host", "prefix", "seg"], "left")
            nodes = cut(t.select("node", "host", F.when(F.col("wild"), _starred(d)).otherwise(F.col("segs")).alias("segs"), "n", "labelled", "good"))
    return nodes


def _merged(nodes: DataFrame, d: int, z: float) -> DataFrame:
    """The nodes, all longer than d, with a wildcard at d where their branch's label rate is like that of all that differ only there."""
    t = nodes.withColumn("star", F.when(F.get("segs", F.lit(d)).isin(*WILD), F.col("segs")).otherwise(_starred(d)))
    t = t.withColumns({"own": F.array_join("segs", "/"), "general": F.array_join("star", "/")})
    mine = t.groupBy("host", "general", "own").agg(F.sum("labelled").alias("l"), F.sum("good").alias("g"))
    pool = mine.groupBy("host", "general").agg(F.try_divide(F.sum("g"), F.sum("l")).alias("p"), F.count(F.lit(1)).alias("branches"))
    l = F.greatest(F.col("l"), F.lit(1e-9))
    far = (F.col("l") > 0) & (F.abs(F.col("g") / l - F.col("p")) > z * F.sqrt(F.col("p") * (1 - F.col("p")) / l))
    mine = cut(mine.join(pool, ["host", "general"]).select("host", "general", "own", "l", "branches", F.coalesce(far, F.lit(False)).alias("far")))
    apart = mine.groupBy("host", "general").agg(F.max("far").alias("apart"))
    alike = (F.col("branches") > 1) & ~F.col("far") & ((F.col("l") > 0) | ~F.col("apart"))
    mine = mine.join(apart, ["host", "general"]).select("host", "general", "own", alike.alias("alike"))
    return t.join(mine, ["host", "general", "own"]).select("node", "host", F.when(F.col("alike"), F.col("star")).otherwise(F.col("segs")).alias("segs"), "n", "labelled", "good")


def templates(nodes: DataFrame, branch: int = BRANCH, z: float = Z) -> DataFrame:
    """node and template of the rows (node, host, segs, n, labelled, good), one for each node."""
    nodes = _branched(nodes, branch)
    merged = nodes.filter(F.size("segs") == 0)
    depth = nodes.agg(F.max(F.size("segs"))).first()[0] or 0
    for d in reversed(range(depth)):  # a level only has the nodes that reach it
        longer = nodes.filter(F.size("segs") == d + 1)
        up = cut(_merged(longer if d + 1 == depth else up.unionByName(longer), d, z))
    if depth:
        merged = merged.unionByName(up)
    return merged.select("node", "host", F.concat(F.lit("/"), F.array_join("segs", "/")).alias("template"), "labelled", "good")


def judge(pages: DataFrame, labels: DataFrame, label_key: Column, id_col: str = "page_id", url: str = "url", rules=RULES, strength: float = STRENGTH, purity: float = PURITY) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity for each row.

    labels: (key, good); label_key: the key of a page, from its columns host and path.
    """
    host, path = split_url(F.col("__url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url).cast("string").alias("__url")).select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("segs", _shapes(F.col("path"))).withColumn("node", F.concat(F.col("host"), F.lit("/"), F.array_join("segs", "/"))).withColumn("__key", label_key)
    known = labels.filter(F.col("key").isNotNull()).groupBy("key").agg(F.avg(F.col("good").cast("double")).alias("good"))
    rows = cut(rows.join(known, F.col("__key") == F.col("key"), "left").drop("key", "__key"))
    nodes = cut(rows.groupBy("node", "host", "segs").agg(F.count(F.lit(1)).alias("n"), F.count("good").cast("double").alias("labelled"), F.coalesce(F.sum("good"), F.lit(0.0)).alias("good")))
    found = cut(templates(nodes))
    total = found.agg(F.sum("labelled").alias("l"), F.sum("good").alias("g")).first()
    overall = total["g"] / total["l"] if total["l"] else 1.0
    smooth = lambda towards: (F.sum("good") + strength * towards) / (F.sum("labelled") + strength)
    hosts = found.groupBy("host").agg(smooth(F.lit(float(overall))).alias("p_host"))
    of = found.groupBy("host", "template").agg(F.sum("labelled").alias("l"), F.sum("good").alias("g")).join(hosts, "host")
    of = of.select("host", "template", ((F.col("g") + strength * F.col("p_host")) / (F.col("l") + strength)).alias("purity"))
    of = small_side(cut(found.select("node", "host", "template").join(of, ["host", "template"]).select(F.col("node").alias("__n"), "template", "purity")))
    rule, listed = by_rules(F.col("host"), F.col("path"), rules)
    out = rows.join(of, F.col("node") == F.col("__n"), "left")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(listed, F.when(F.col("purity") < purity, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "template", "purity")


#: The number at the end of a page's path is that of the document it shows.
DOC_NUMBER = "/([0-9]{1,18})(?:[.]html)?/?$"


def page_document(path: Column) -> Column:
    number = F.regexp_extract(path, DOC_NUMBER, 1)
    return F.when(number != "", number).cast("long")


def sql(rules=RULES) -> str:
    """DuckDB's equivalent of the query over `pages` and `labels`."""
    case = {"rule": "NULL", "verdict": "NULL"}
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, slash, p = text.partition("/")
        fits = f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{slash}{p}')"
        case = {"rule": f"CASE WHEN {fits} THEN '{text}' ELSE {case['rule']} END", "verdict": f"CASE WHEN {fits} THEN '{kind}' ELSE {case['verdict']} END"}
    levels = ""
    for d in range(MAX_DEPTH + 1):
        levels += f"""
k{d} AS (SELECT host, array_to_string(segs[1:{d}], '/') AS prefix, segs[{d + 1}] AS seg, sum(n) AS kid FROM t{d} WHERE len(segs) > {d} GROUP BY ALL),
o{d} AS (SELECT host, prefix FROM (SELECT host, prefix, count(*) AS kids FROM k{d} GROUP BY ALL) WHERE kids > {BRANCH}),
w{d} AS (SELECT k.host, k.prefix, k.seg FROM (SELECT *, sum(kid) OVER (PARTITION BY host, prefix) AS everything FROM k{d}) k JOIN o{d} USING (host, prefix) WHERE kid * {BRANCH} < everything AND NOT contains(seg, '{{')),
t{d + 1} AS (SELECT node, t.host, CASE WHEN w.seg IS NOT NULL THEN t.segs[1:{d}] || ['{{*}}'] || t.segs[{d + 2}:] ELSE t.segs END AS segs, n, labelled, good
  FROM t{d} t LEFT JOIN w{d} w ON t.host = w.host AND array_to_string(t.segs[1:{d}], '/') = w.prefix AND t.segs[{d + 1}] = w.seg),"""
    return f"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
s AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM h),
g AS (SELECT *, list_transform(parts[1:{MAX_DEPTH}], lambda x: CASE WHEN regexp_matches(x, '{UUID}') THEN '{{u}}' WHEN regexp_matches(x, '{HEX}') AND regexp_matches(x, '[0-9]') THEN '{{h}}' ELSE regexp_replace(x, '[0-9]+', '{{n}}', 'g') END)
  || CASE WHEN len(parts) > {MAX_DEPTH} THEN ['{{**}}'] ELSE [] END AS segs FROM s),
y AS (SELECT doc_id, avg(CASE WHEN quality = 1 AND toxic = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS good FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
r AS (SELECT g.*, host || '/' || array_to_string(segs, '/') AS node, y.good FROM g LEFT JOIN y ON try_cast(nullif(regexp_extract(path, '{DOC_NUMBER}', 1), '') AS BIGINT) = y.doc_id),
t0 AS (SELECT node, host, segs, count(*) AS n, count(good)::DOUBLE AS labelled, coalesce(sum(good), 0)::DOUBLE AS good FROM r GROUP BY ALL),{levels}
a AS (SELECT *, list_max(list_transform(segs, lambda x, i: CASE WHEN contains(x, '{{') THEN 0 ELSE i END)) AS pos FROM t{MAX_DEPTH + 1}),
e AS (SELECT node, host, labelled, good, '/' || array_to_string(segs, '/') AS own,
  '/' || array_to_string(CASE WHEN coalesce(pos, 0) = 0 THEN segs ELSE segs[1:pos - 1] || ['{{*}}'] || segs[pos + 1:] END, '/') AS general FROM a),
m AS (SELECT host, general, own, sum(labelled) AS l, sum(good) AS g FROM e GROUP BY ALL),
p AS (SELECT *, count(*) OVER w AS branches, CASE WHEN sum(l) OVER w > 0 THEN sum(g) OVER w / sum(l) OVER w END AS p FROM m WINDOW w AS (PARTITION BY host, general)),
z AS (SELECT *, coalesce(l > 0 AND abs(g / greatest(l, 1e-9) - p) > {Z} * sqrt(p * (1 - p) / greatest(l, 1e-9)), false) AS far FROM p),
q AS (SELECT host, general, own, CASE WHEN branches > 1 AND NOT far AND (l > 0 OR NOT bool_or(far) OVER (PARTITION BY host, general)) THEN general ELSE own END AS template FROM z),
f AS (SELECT e.*, q.template FROM e JOIN q USING (host, general, own)),
v AS (SELECT CASE WHEN sum(labelled) > 0 THEN sum(good) / sum(labelled) ELSE 1.0::DOUBLE END AS overall FROM f),
b AS (SELECT host, (sum(good) + {STRENGTH} * (SELECT overall FROM v)) / (sum(labelled) + {STRENGTH}) AS p_host FROM f GROUP BY host),
c AS (SELECT host, template, (sum(good) + {STRENGTH} * any_value(p_host)) / (sum(labelled) + {STRENGTH}) AS purity FROM f JOIN b USING (host) GROUP BY host, template)
SELECT page_id, host, path, {case['rule']} AS rule, coalesce({case['verdict']}, CASE WHEN purity < {PURITY} THEN 'block' ELSE 'allow' END) AS verdict, template, purity::DOUBLE AS purity
FROM r JOIN (SELECT node, template FROM f) USING (node) JOIN c USING (host, template)
"""


