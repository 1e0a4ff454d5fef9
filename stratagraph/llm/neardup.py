"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF shingles, banded and verified.

A text's shingles are its windows of five words (ASCII letters in lower case; a shorter text is one
shingle). A shingle weighs (1 + ln tf) * idf. Document frequencies come from a count sketch of
fixed size, summed over all documents: counters of 2**20 hash slots, less the mean that chance adds.
The idf is smoothed to [IDF_FLOOR, 1]: plain idf would make a word changed in one of a thousand
near copies outweigh the shared rest many times over.

For each of BANDS * BAND_ROWS samples a text draws the shingle with the least a = ln c - r (t - beta) - r,
where t = floor(ln w / r + beta) and r, c, beta come from a table indexed by the shingle's hash; equal
shingles with equal t then meet with the probability of the weighted Jaccard similarity. Texts that
agree in a band share a bucket. In each bucket every text is compared with its most typical one
(of the least mean idf: the one that the others were edited from, if any), and then those that
aren't of its class with the most typical of these. Whatever is still outside its bucket's main
class goes through an exact similarity join with all texts of such buckets that aren't of its
class: texts that are alike must share one of their rarest shingles, and enough must follow it in
both. So no link between different texts of a bucket stays unseen, yet copies aren't expanded into
all pairs. Pairs are verified by the exact weighted Jaccard similarity; classes are the links'
connected components.

Copies of a text are one text all the while. Nothing grows on the driver: it gets the sketch, of
4 MB whatever the input, and counts.

Defined results: a text without words is a class of its own, whatever others there are; class ids
are the least non-null id of the class; repeated rows share a class; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagraph.llm import words as W
from stratagraph.llm.components import components
from stratagraph.llm.runtime import BROADCAST_ROWS, cut, ship, small_side, text_batches, tidy

SHINGLE, THRESHOLD = 5, 0.8
BANDS, BAND_ROWS = 20, 5
SAMPLES = BANDS * BAND_ROWS
SKETCH_BITS, SKETCH_BLOCK = 20, 1 << 12
IDF_FLOOR = 0.75
#: Rounds in which a bucket's texts meet one of them.
STAR_ROUNDS = 2
#: Rows of a bucket or token from which its rows aren't gathered in one task, but met where they are or in SALTS parts.
HOT_ROWS, SALTS = 1_000, 32
_TABLE_BITS = 13


def shingles(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """32-bit hashes of all shingles in order of row and hash, the row of each, and words of each row."""
    raw = W.ASCII_LOWER[raw]
    starts, ends, firsts = W.spans(raw, offsets)
    hashes = W.word_hashes(raw, starts, ends)
    sizes = np.diff(firsts)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    keys, at = W.windows(hashes, firsts, SHINGLE)
    of = rows[at]
    short = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k in range(SHINGLE - 1):
            has = sizes[short] > k
            whole[has] = W.mix(whole[has] * np.uint64(31) + hashes[firsts[short[has]] + k] + np.uint64(k + 1))
        keys, of = np.concatenate([keys, whole]), np.concatenate([of, short])
    both = np.sort((of.astype(np.uint64) << np.uint64(32)) | (keys >> np.uint64(32)))
    return (both & np.uint64(0xFFFFFFFF)).astype(np.uint32), (both >> np.uint64(32)).astype(np.int64), sizes


def _distinct(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first of equal shingles of a row, and how many they are."""
    first = np.ones(len(hashes), dtype=bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    at = np.flatnonzero(first)
    return at, np.diff(np.append(at, len(hashes)))


def sketch(texts: DataFrame) -> np.ndarray:
    """Smoothed idf by the top SKETCH_BITS of a shingle's hash, from all rows of the column `text`."""

    def count(batches):
        total, n = np.zeros(1 << SKETCH_BITS, dtype=np.int64), 0
        for batch in batches:
            for _, raw, offsets in text_batches(batch, "text"):
                hashes, rows, sizes = shingles(raw, offsets)
                at, _ = _distinct(hashes, rows)
                total += np.bincount(hashes[at] >> np.uint32(32 - SKETCH_BITS), minlength=len(total))
                n += int((sizes > 0).sum())
            tidy()
        if n:
            blocks = total.reshape(-1, SKETCH_BLOCK)
            data = [zlib.compress(b.tobytes(), 1) for b in blocks]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(data)), pa.int32()), pa.array([n] * len(data), pa.int64()), pa.array(data, pa.binary())], ["block", "n", "data"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(SKETCH_BLOCK, dtype=np.int64)
        for data in table.column("data"):
            total += np.frombuffer(zlib.decompress(data.as_py()), dtype=np.int64)
        return pa.table({"block": table.column("block")[:1], "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()), "data": pa.array([total.tobytes()], pa.binary())})

    schema = "block int, n long, data binary"
    rows = texts.select("text").mapInArrow(count, schema).groupBy("block").applyInArrow(add, schema).collect()
    counts, n = np.zeros((1 << SKETCH_BITS) // SKETCH_BLOCK * SKETCH_BLOCK, dtype=np.float64), 1
    for r in rows:
        counts[r["block"] * SKETCH_BLOCK : (r["block"] + 1) * SKETCH_BLOCK] = np.frombuffer(bytes(r["data"]), dtype=np.int64)
        n = r["n"]
    return smoothed_idf(counts, n)


def smoothed_idf(counts: np.ndarray, n: int) -> np.ndarray:
    df = np.maximum(counts - counts.mean(), 1.0)
    share = np.log(np.maximum(n / df, 1.0)) / np.log(max(n, 2))
    return (IDF_FLOOR + (1 - IDF_FLOOR) * np.clip(share, 0, 1)).astype(np.float32)


def weights(hashes: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return (1 + np.log(tf)).astype(np.float32) * idf[hashes >> np.uint32(32 - SKETCH_BITS)]


_draws: list[np.ndarray] = []


def draws() -> list[np.ndarray]:
    """r, ln c and beta of each table row and sample; the same everywhere."""
    if not _draws:
        rng = np.random.Generator(np.random.PCG64(12345))
        size = (1 << _TABLE_BITS, SAMPLES)
        u = [rng.random(size) for _ in range(5)]
        _draws.extend(x.astype(np.float32) for x in (-np.log(u[0] * u[1] + 1e-300), np.log(-np.log(u[2] * u[3] + 1e-300)), u[4]))
    return _draws


def band_keys(hashes: np.ndarray, rows: np.ndarray, n: int, idf: np.ndarray, step: int = 8192) -> np.ndarray:
    """n x BANDS bucket keys; 0 for rows without shingles."""
    r, ln_c, beta = draws()
    at, tf = _distinct(hashes, rows)
    h, row = hashes[at], rows[at]
    ln_w = np.log(weights(h, tf, idf))[:, None]
    best = np.full((n, SAMPLES), np.iinfo(np.uint64).max, dtype=np.uint64)
    slot = (W.mix(h.astype(np.uint64)) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
    for k in range(0, len(h), step):
        s = slot[k : k + step]
        rs, bs = r[s], beta[s]
        t = np.floor(ln_w[k : k + step] / rs + bs)
        a = ln_c[s] - rs * (t - bs) - rs
        # the least a and, among equal ones, the least identity; a + 64 is positive, so its bits are in order
        ident = (h[k : k + step, None] * np.uint32(0x9E3779B1)) ^ (t.astype(np.int32).view(np.uint32) * np.uint32(0x85EBCA77))
        packed = ((a + np.float32(64)).view(np.uint32).astype(np.uint64) << np.uint64(32)) | ident
        own = row[k : k + step]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        least = np.minimum.reduceat(packed, first, axis=0)
        best[own[first]] = np.minimum(best[own[first]], least)
    ident = best & np.uint64(0xFFFFFFFF)
    keys = np.zeros((n, BANDS), dtype=np.uint64)
    for j in range(BAND_ROWS):
        keys = W.mix(keys + ident[:, j::BAND_ROWS] + np.uint64(j + 1) + (np.arange(BANDS, dtype=np.uint64) << np.uint64(40)))
    return keys


def similarity(x: np.ndarray, y: np.ndarray, idf: np.ndarray) -> float:
    """Weighted Jaccard of two texts, from their sorted shingle hashes."""
    if len(x) == len(y) and np.array_equal(x, y):
        return 1.0
    (hx, nx), (hy, ny) = np.unique(x, return_counts=True), np.unique(y, return_counts=True)
    wx, wy = weights(hx, nx, idf).astype(np.float64), weights(hy, ny, idf).astype(np.float64)
    _, i, j = np.intersect1d(hx, hy, assume_unique=True, return_indices=True)
    shared = float(np.minimum(wx[i], wy[j]).sum())
    total = float(wx.sum() + wy.sum()) - shared
    return shared / total if total else 0.0


def _text_key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def signatures(rows: DataFrame, idf) -> DataFrame:
    """id, key, n_words, rarity (mean idf) and bucket keys of the rows (id, key, text)."""
    names = [f"b{i}" for i in range(BANDS)]
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        table = idf.value
        for batch in batches:
            words, keys, rare = [], [], []
            for _, raw, offsets in text_batches(batch, "text"):
                hashes, of, sizes = shingles(raw, offsets)
                words.append(sizes)
                keys.append(band_keys(hashes, of, len(sizes), table))
                total = np.bincount(of, weights=table[hashes >> np.uint32(32 - SKETCH_BITS)], minlength=len(sizes))
                rare.append(np.round(total / np.maximum(np.bincount(of, minlength=len(sizes)), 1), 6))
            k = np.concatenate(keys).view(np.int64) if keys else np.zeros((0, BANDS), np.int64)
            w = np.concatenate(words) if words else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(w, pa.int64()), pa.array(np.concatenate(rare) if rare else np.zeros(0)), *(pa.array(np.ascontiguousarray(k[:, i])) for i in range(BANDS))], ["id", "key", "n_words", "rarity", *names])
            tidy()

    return rows.mapInArrow(run, f"id {kind}, key binary, n_words long, rarity double, " + ", ".join(f"{b} long" for b in names))


def _shingle_lists(rows: DataFrame) -> DataFrame:
    """tid and the sorted shingle hashes (as signed ints) of the rows (tid, text)."""

    def run(batches):
        for batch in batches:
            for k, raw, offsets in text_batches(batch, "text"):
                hashes, of, sizes = shingles(raw, offsets)
                bounds = np.searchsorted(of, np.arange(len(sizes) + 1))
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(hashes.view(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, len(sizes)), lists], ["tid", "sh"])
            tidy()

    return rows.mapInArrow(run, "tid long, sh array<int>")


def _with_lists(pairs: DataFrame, lists: DataFrame, end: str, name: str) -> DataFrame:
    """The pairs with the lists of one end as `name`: ends of very many pairs are dealt out in parts, each with the list."""
    own = lists.select(F.col("tid").alias(end), F.col("sh").alias(name))
    hot = cut(pairs.groupBy(end).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= HOT_ROWS).select(F.col(end).alias("__e")))
    if hot.isEmpty():
        return pairs.join(own, end)
    hot = small_side(hot)
    is_hot = lambda df, how: df.join(hot, F.col(end) == F.col("__e"), how)
    parts = is_hot(pairs, "left_semi").withColumn("__salt", F.pmod(F.xxhash64("a", "b"), F.lit(SALTS)).cast("int"))
    many = is_hot(own, "left_semi").withColumn("__salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return is_hot(pairs, "left_anti").join(own, end).unionByName(parts.join(many, [end, "__salt"]).drop("__salt"))


def _verified(pairs: DataFrame, lists: DataFrame, idf, threshold: float) -> DataFrame:
    """The pairs (a, b) with a similarity of at least the threshold."""
    both = _with_lists(_with_lists(pairs, lists, "a", "x"), lists, "b", "y").select("a", "b", "x", "y")

    def run(batches):
        table = idf.value
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            xs, ys = (c.values.to_numpy().view(np.uint32) for c in (x, y))
            xo, yo = (c.offsets.to_numpy() for c in (x, y))
            sim = np.array([similarity(xs[xo[k] : xo[k + 1]], ys[yo[k] : yo[k + 1]], table) for k in range(len(batch))], dtype=float)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sim)], ["a", "b", "sim"]).filter(pa.array(sim >= threshold))
            tidy()

    return both.mapInArrow(run, "a long, b long, sim double")


def _pairs(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _prefixes(lists: DataFrame, idf, threshold: float) -> DataFrame:
    """The rows (tid, sh) as their rarest shingles: token, tid, rest and weight.

    Shingles are in one order for all texts, rare ones first. Texts that are alike enough overlap in
    `threshold` of either's weight, so the first shingle that they share stands where at least so
    much of each is left; only such places are emitted. `rest` is the weight from there on.
    """

    def run(batches):
        table = idf.value
        for batch in batches:
            tokens, tids, rests, totals = [], [], [], []
            for tid, sh in zip(batch.column(0).to_pylist(), batch.column(1)):
                h, n = np.unique(sh.values.to_numpy().view(np.uint32), return_counts=True)
                w = weights(h, n, table).astype(np.float64)
                order = np.lexsort((h, -table[h >> np.uint32(32 - SKETCH_BITS)]))
                w = w[order]
                rest = np.cumsum(w[::-1])[::-1]
                first = rest >= threshold * rest[0] - 1e-6
                tokens.append(h[order][first].view(np.int32))
                tids.append(np.full(int(first.sum()), tid))
                rests.append(rest[first])
                totals.append(np.full(int(first.sum()), rest[0]))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, tids, rests, totals)], ["token", "tid", "rest", "weight"])

    return lists.mapInArrow(run, "token int, tid long, rest double, weight double")


def _by_bucket(rows: DataFrame, side: DataFrame) -> DataFrame:
    """The rows (bucket, tid, ..) with the columns of `side`, which has a row for a bucket and `n`, its rows: those of buckets with very many stay where they are."""
    side = cut(side.withColumnRenamed("bucket", "__b"))
    hot, cold = side.filter(F.col("n") >= HOT_ROWS), side.filter(F.col("n") < HOT_ROWS).drop("n")
    same = F.col("bucket") == F.col("__b")
    if hot.isEmpty():
        return rows.join(cold, same).drop("__b")
    hot = small_side(hot.drop("n"))
    met = rows.join(hot.select("__b"), same, "left_anti").join(cold, same).drop("__b")
    if hot.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return met.unionByName(rows.join(hot, same).drop("__b"))
    parts = hot.withColumn("__s", F.explode(F.array(*map(F.lit, range(SALTS)))))
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64("tid"), F.lit(SALTS)).cast("int"))
    return met.unionByName(salted.join(parts, (F.col("bucket") == F.col("__b")) & (F.col("__salt") == F.col("__s"))).drop("__b", "__s", "__salt"))


def _open(members: DataFrame, comp: DataFrame) -> DataFrame:
    """The buckets that hold several classes: bucket, tid, lead, rarity, comp, and main, the lead's class."""
    known = members.join(comp, members["tid"] == comp["node"], "left").select("bucket", "tid", "lead", "rarity", F.coalesce("component", "tid").alias("comp"))
    spread = known.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min(F.when(F.col("tid") == F.col("lead"), F.col("comp"))).alias("main"), F.count(F.lit(1)).alias("n")).filter("low != high")
    return cut(_by_bucket(known, spread.select("bucket", "main", "n")))


def _by_token(x: DataFrame, y: DataFrame, near) -> DataFrame:
    """Rows of x and y with one token that fulfil `near`; a token with very many rows is dealt out in parts of y, each with all of x."""
    hot = cut(y.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= HOT_ROWS).select(F.col("token").alias("__t")))
    if hot.isEmpty():
        return x.join(y, "token").filter(near)
    hot = small_side(hot)
    is_hot = lambda df, how: df.join(hot, F.col("token") == F.col("__t"), how)
    parts = is_hot(y, "left_semi").withColumn("__salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    all_x = is_hot(x, "left_semi").withColumn("__salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    split = all_x.join(parts, ["token", "__salt"]).drop("__salt")
    return is_hot(x, "left_anti").join(is_hot(y, "left_anti"), "token").unionByName(split).filter(near)


def _joined(comp: DataFrame, found: DataFrame) -> DataFrame:
    """The classes (node, component) with the links `found` (a, b) added: components of the few classes that they join."""
    if found.isEmpty():
        return comp
    of = lambda end: comp.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
    between = found.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).filter("a != b")
    to = components(between).select(F.col("node").alias("component"), F.col("component").alias("to"))
    new = found.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(comp, "node", "left_anti").select("node", F.col("node").alias("component"))
    return cut(comp.unionByName(new).join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component")))


def _classes(members: DataFrame, lists: DataFrame, idf, threshold: float) -> DataFrame:
    """node and component: the classes that all links inside the buckets (bucket, tid, rarity, lead) make."""
    pairs = cut(members.filter("tid != lead").select(*_pairs("lead", "tid")).distinct())
    comp = components(cut(_verified(pairs, lists, idf, threshold)))
    for _ in range(STAR_ROUNDS - 1):  # the most typical of each bucket's other texts, with all that aren't of its class
        open_ = _open(members, comp)
        other = open_.groupBy("bucket").agg(F.min(F.when(F.col("comp") != F.col("main"), F.struct("rarity", "tid", "comp"))).alias("l"), F.count(F.lit(1)).alias("n"))
        met = _by_bucket(open_.filter("tid != lead"), other).filter("comp != l.comp").select("tid", F.col("l.tid").alias("leader"))
        comp = _joined(comp, cut(_verified(cut(met.select(*_pairs("leader", "tid")).distinct()), lists, idf, threshold)))
    # what is still outside its bucket's main class meets, exactly, all that it may be alike to
    open_ = _open(members, comp)
    if open_.isEmpty():
        return comp
    texts = cut(open_.groupBy("tid").agg(F.max((F.col("comp") != F.col("main"))).alias("loose"), F.min("comp").alias("comp")))
    rows = cut(_prefixes(lists.join(texts.select("tid"), "tid", "left_semi"), idf, threshold).join(texts, "tid"))
    x = rows.filter("loose").select("token", F.col("tid").alias("a"), F.col("rest").alias("ra"), F.col("weight").alias("wa"), F.col("comp").alias("ca"))
    y = rows.select("token", F.col("tid").alias("b"), F.col("rest").alias("rb"), F.col("weight").alias("wb"), F.col("comp").alias("cb"), F.col("loose").alias("lb"))
    least = threshold / (1 + threshold) * (F.col("wa") + F.col("wb")) - 1e-6
    near = (F.col("ca") != F.col("cb")) & (F.col("ra") >= least) & (F.col("rb") >= least) & (~F.col("lb") | (F.col("a") < F.col("b")))
    met = cut(_by_token(x, y, near).select(*_pairs("a", "b")).distinct())
    return _joined(comp, cut(_verified(met, lists, idf, threshold)))


def classes(docs: DataFrame, text: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id and n_words for each row."""
    ship(docs)
    spark = docs.sparkSession
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), _text_key(t).alias("key"), t.alias("text"))
    idf = spark.sparkContext.broadcast(sketch(rows))
    marks = cut(signatures(rows, idf))
    bands = [f"b{i}" for i in range(BANDS)]
    texts = marks.filter("n_words > 0").groupBy("key").agg(F.min("id").alias("rep"), F.min("rarity").alias("rarity"), *(F.min(b).alias(b) for b in bands))
    texts = cut(texts.withColumn("tid", F.monotonically_increasing_id()))
    buckets = texts.select("tid", "rarity", F.explode(F.array(*bands)).alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rarity", "tid")).alias("l")).filter("n > 1")
    members = cut(_by_bucket(buckets, shared.select("bucket", F.col("l.tid").alias("lead"), "n")))
    wanted = members.select("tid").distinct().join(texts.select("tid", "key", "rep"), "tid")
    wanted = small_side(cut(wanted.select("tid", F.col("key").alias("__k"), "rep")))
    # one row of each text that shares a bucket; ids spread the rows of a text with very many copies
    chosen = rows.join(wanted, (F.col("key") == F.col("__k")) & F.col("id").eqNullSafe(F.col("rep")))
    lists = cut(_shingle_lists(chosen.select("tid", "text")).dropDuplicates(["tid"]))
    comp = _classes(members, lists, idf, threshold)
    found = texts.select("tid", "key", "rep").join(comp, F.col("tid") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "tid"))
    least = found.groupBy("comp").agg(F.min("rep").alias("class_id"))
    of_text = found.join(least, "comp").select(F.col("key").alias("__k"), "class_id")
    out = marks.select("id", "key", "n_words").join(of_text, (F.col("n_words") > 0) & (F.col("key") == F.col("__k")), "left")
    return out.select(F.col("id").alias("doc_id"), F.when(F.col("n_words") > 0, F.col("class_id")).otherwise(F.col("id")).alias("class_id"), "n_words")
