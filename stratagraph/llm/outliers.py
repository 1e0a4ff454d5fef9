"""Quality rules: text statistics, and robust outliers among them.

Each document with enough words gives a vector of four transformed statistics. For every
(language, source) pair, every language and all rows the minimum-covariance-determinant estimate of
centre and scatter is found by concentration steps from several deterministic starts: the medians
with absolute deviations, with the correlations of squashed coordinates, and with those of directions
alone. A step keeps the 75 % of rows with the smallest Mahalanobis distances and takes their mean and
covariance, which never raises the determinant; of the starts the one that ends with the least
determinant is the estimate. A pair's estimate is shrunk towards its language's and that towards all
rows', by how many rows each has, so that no size makes a switch. Documents whose squared distance
lies beyond the chi-square quantile that one in a million normal vectors passes are rejected.

Each step is two grouped aggregations over narrow rows; no group is gathered anywhere. Quantiles come
from histograms, so that reruns agree.

Defined results: a null or empty text has zero counts and fails the base rules; null languages
and sources are groups like others; repeated rows are judged alike, and each gives a row; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratagraph.llm import words as W
from stratagraph.llm.runtime import cut, ship, small_side, text_batches, tidy

DIMS = 4
#: Share of rows that a step keeps, steps, starts, and the rows' worth that a group's elders have in its estimate.
SHARE, STEPS, STARTS, ELDERS = 0.75, 4, 3, 200.0
#: What a coordinate can't resolve: 3 % of the mean word length; the root of one symbol, line or repeated word in 64 to 72 words.
FLOORS = (0.03, 0.12, 0.12, 0.12)
#: Share of normal vectors that are rejected.
TAIL = 1e-6
BINS = 40

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which of the entries have an equal key in the same row, and which of them aren't the first such."""
    both = W.mix(rows.astype(np.uint64) + np.uint64(1)) + keys
    order = np.argsort(both, kind="stable")
    same = both[order][1:] == both[order][:-1]
    again = np.zeros((2, len(keys)), dtype=bool)
    again[1, order[1:]] = same
    again[0] = again[1]
    again[0, order[:-1]] |= same
    return again


def text_counts(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of each row of UTF-8 bytes."""
    n = len(offsets) - 1
    starts, ends, firsts = W.spans(raw, offsets)
    sums = W.prefix_hash(raw)
    hashes = W.slice_hash(sums, starts, ends)
    n_words = np.diff(firsts)
    rows = np.repeat(np.arange(n), n_words)

    keys, at = W.windows(hashes, firsts, 3)
    twice = at[_repeats(keys, rows[at])[0]]
    covered = np.zeros(len(starts) + 1, dtype=bool)
    for k in range(3):
        covered[twice + k] = True

    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[offsets] = True
    breaks = np.flatnonzero(raw == 10)
    line_starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    line_ends = np.sort(np.concatenate([offsets[1:], breaks]))
    line_rows = np.searchsorted(offsets, line_ends, side="left")  # an end is in (start of the row, its end]
    worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends, line_rows = line_starts[worded], line_ends[worded], line_rows[worded]
    dup = _repeats(W.slice_hash(sums, line_starts, line_ends), line_rows)[1]
    return {
        "n_words": n_words,
        "word_chars": _per_row(~W.SPACE[raw] & ((raw & 0xC0) != 0x80), offsets),
        "n_symbols": _per_row(_SYMBOL[raw], offsets),
        "n_dup_lines": np.bincount(np.clip(line_rows[dup] - 1, 0, None), minlength=n)[:n] if n else np.zeros(0, np.int64),
        "n_repeat_words": np.bincount(rows[covered[:-1]], minlength=n)[:n] if n else np.zeros(0, np.int64),
    }


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def text_statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """`keep` columns with the base counts of every whole text; one pass, no shuffle."""
    ship(docs)
    slim = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name != "__text"), *(f"{c} long" for c in COUNTS)])

    def run(batches):
        for batch in batches:
            parts = [text_counts(raw, offsets) for _, raw, offsets in text_batches(batch, "__text")]
            cols = [pa.array(np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64), pa.int64()) for c in COUNTS]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *cols], [*keep, *COUNTS])
            tidy()

    return slim.mapInArrow(run, schema)


def _vector() -> list[Column]:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        F.sqrt(F.col("n_symbols") / words),
        F.sqrt(F.col("n_dup_lines") / words),
        F.sqrt(F.col("n_repeat_words") / words),
    ]


def cutoff(tail: float = TAIL) -> float:
    """The chi-square quantile of 4 degrees that a share `tail` lies beyond."""
    low, high = 0.0, 1500.0
    for _ in range(200):
        q = (low + high) / 2
        low, high = (q, high) if math.exp(-q / 2) * (1 + q / 2) > tail else (low, q)
    return q


def consistency(share: float) -> float:
    """What makes the scatter of the closest `share` of a 4-variate normal sample that of the whole."""
    q = cutoff(1 - share)
    return share / (1 - math.exp(-q / 2) * (1 + q / 2 + q * q / 8))


X = [f"x{i}" for i in range(DIMS)]
PAIRS = [(i, j) for i in range(DIMS) for j in range(i, DIMS)]
CENTRE, PRECISION, SCATTER = [f"m{i}" for i in range(DIMS)], [f"p{i}{j}" for i, j in PAIRS], [f"c{i}{j}" for i, j in PAIRS]
#: An estimate: rows, centre, scatter of the kept rows, its precision, and the logarithm of its determinant.
_ESTIMATE = pa.schema([("key", pa.string()), ("start", pa.int32()), ("n", pa.float64()), *((c, pa.float64()) for c in (*CENTRE, *SCATTER, *PRECISION)), ("log_det", pa.float64())])
_ESTIMATE_SQL = "key string, start int, n double, " + ", ".join(f"{c} double" for c in (*CENTRE, *SCATTER, *PRECISION)) + ", log_det double"


def distance() -> Column:
    """Squared Mahalanobis distance from a row's x and its group's centre m and precision p."""
    d = [F.col(x) - F.col(f"m{i}") for i, x in enumerate(X)]
    out = F.lit(0.0)
    for i, j in PAIRS:
        out = out + F.col(f"p{i}{j}") * d[i] * d[j] * (1.0 if i == j else 2.0)
    return F.greatest(out, F.lit(0.0))


def precision(cov: np.ndarray) -> np.ndarray:
    """The inverse of a scatter, in which what isn't resolved counts as spread."""
    return np.linalg.inv(cov + np.diag(np.square(FLOORS)))


def _columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {name: batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k, name in enumerate(batch.schema.names) if name not in ("key", "start")}


def _symmetric(t: dict[str, np.ndarray], prefix: str, n: int) -> np.ndarray:
    out = np.zeros((n, DIMS, DIMS))
    for i, j in PAIRS:
        out[:, i, j] = out[:, j, i] = t[f"{prefix}{i}{j}"]
    return out


def _estimates(key: pa.Array, start: pa.Array, n: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> pa.RecordBatch:
    whole = cov + np.diag(np.square(FLOORS))
    p = np.linalg.inv(whole) if len(whole) else whole
    pick = lambda m: [pa.array(np.ascontiguousarray(m[:, i, j])) for i, j in PAIRS]
    return pa.RecordBatch.from_arrays([key, start, pa.array(n), *(pa.array(np.ascontiguousarray(mean[:, i])) for i in range(DIMS)), *pick(cov), *pick(p), pa.array(np.linalg.slogdet(whole)[1] if len(whole) else np.zeros(0))], schema=_ESTIMATE)


def _estimate(rows: DataFrame, factor: float) -> DataFrame:
    """The estimate of each key's and start's rows; the moments are combined before the shuffle."""
    sums = [F.count(F.lit(1)).alias("n"), *(F.sum(x).alias(f"s{i}") for i, x in enumerate(X)), *(F.sum(F.col(X[i]) * F.col(X[j])).alias(f"q{i}{j}") for i, j in PAIRS)]
    moments = rows.groupBy("key", "start").agg(*sums)

    def solve(batches):
        for b in batches:
            t = _columns(b)
            mean = np.stack([t[f"s{i}"] / t["n"] for i in range(DIMS)], axis=1)
            cov = _symmetric(t, "q", len(mean)) / t["n"][:, None, None] - mean[:, :, None] * mean[:, None, :]
            yield _estimates(b.column(0), b.column(1), t["n"], mean, factor * cov)

    return moments.mapInArrow(solve, _ESTIMATE_SQL)


def _quantile(binned: DataFrame, by: list[str], share: float) -> DataFrame:
    """For each `by` the bin that reaches `share` of its rows; from counts of bins, which are few."""
    counts = binned.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by)
    below = F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("below", below).withColumn("all", F.sum("n").over(w)).filter(F.col("below") >= F.col("all") * share).groupBy(*by).agg(F.min("bin").alias("cut"))


def _medians(rows: DataFrame, of: list[Column]) -> DataFrame:
    """For each key the medians of the columns, to a 1/BINS part of the coordinate's floor."""
    width = [f * 4 / BINS for f in FLOORS]
    long = rows.select("key", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.floor(c / width[i]).alias("bin")) for i, c in enumerate(of)))).alias("e")).select("key", "e.i", "e.bin")
    cuts = _quantile(long, ["key", "i"], 0.5)
    return cuts.groupBy("key").agg(*(F.max(F.when(F.col("i") == i, (F.col("cut") + 0.5) * width[i])).alias(f"c{i}") for i in range(DIMS)))


def starts(rows: DataFrame) -> DataFrame:
    """Estimates to start from for each key: medians, with the deviations alone and with the correlations of squashed rows and of directions."""
    centre = small_side(cut(_medians(rows, [F.col(x) for x in X])))
    around = rows.join(centre, "key")
    spread = _medians(around, [F.abs(F.col(x) - F.col(f"c{i}")) for i, x in enumerate(X)]).select("key", *(F.col(f"c{i}").alias(f"a{i}") for i in range(DIMS)))
    scaled = rows.join(small_side(cut(centre.join(spread, "key"))), "key")
    z = [(F.col(x) - F.col(f"c{i}")) / F.sqrt(F.pow(F.col(f"a{i}") * 1.4826, 2) + FLOORS[i] ** 2) for i, x in enumerate(X)]
    scaled = scaled.select("key", *(F.col(f"c{i}") for i in range(DIMS)), *(F.col(f"a{i}") for i in range(DIMS)), *(c.alias(f"z{i}") for i, c in enumerate(z)))
    norm = F.sqrt(sum((F.col(f"z{i}") ** 2 for i in range(DIMS)), F.lit(0.0)))
    unit = lambda i: F.when(norm > 0, F.col(f"z{i}") / norm).otherwise(0.0)
    same = [F.first(f"{c}{i}").alias(f"{c}{i}") for c in "ca" for i in range(DIMS)]  # a key has one value of each
    sums = [*(F.sum(F.tanh(f"z{i}") * F.tanh(f"z{j}")).alias(f"t{i}{j}") for i, j in PAIRS), *(F.sum(unit(i) * unit(j)).alias(f"u{i}{j}") for i, j in PAIRS)]
    found = scaled.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *same, *sums)

    def solve(batches):
        for b in batches:
            t = _columns(b)
            k = len(t["n"])
            scale = np.sqrt(np.stack([(1.4826 * t[f"a{i}"]) ** 2 + FLOORS[i] ** 2 for i in range(DIMS)], axis=1))
            mean = np.stack([t[f"c{i}"] for i in range(DIMS)], axis=1)
            for start, prefix in enumerate(("", "t", "u")):
                r = np.broadcast_to(np.eye(DIMS), (k, DIMS, DIMS)).copy()
                if prefix:
                    m = _symmetric(t, prefix, k)
                    d = np.sqrt(np.maximum(np.einsum("kii->ki", m), 1e-12))
                    r = 0.99 * m / d[:, :, None] / d[:, None, :] + 0.01 * r
                    r[:, range(DIMS), range(DIMS)] = 1
                yield _estimates(b.column(0), pa.array([start] * k, pa.int32()), t["n"], mean, r * scale[:, :, None] * scale[:, None, :])

    return found.mapInArrow(solve, _ESTIMATE_SQL)


def fit(rows: DataFrame, steps: int = STEPS, share: float = SHARE) -> DataFrame:
    """key, rows, centre, scatter, precision and log_det of the estimate with the least determinant for each key of rows (key, x0..x3)."""
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).cast("double").alias("rows"))
    params = cut(starts(rows))
    wide = rows.withColumn("start", F.explode(F.array(*map(F.lit, range(STARTS)))))
    factor = consistency(share)
    for _ in range(steps):
        near = wide.join(small_side(params.select("key", "start", *CENTRE, *PRECISION)), ["key", "start"]).withColumn("bin", F.floor(F.log1p(distance()) * BINS))
        cuts = small_side(cut(_quantile(near, ["key", "start"], share)))
        params = cut(_estimate(near.join(cuts, ["key", "start"]).filter("bin <= cut").select("key", "start", *X), factor))
    least = params.groupBy("key").agg(F.min(F.struct(F.round("log_det", 9).alias("d"), "start")).alias("l")).select(F.col("key").alias("k"), F.col("l.start").alias("s"))
    return params.join(small_side(cut(least)), (F.col("key") == F.col("k")) & (F.col("start") == F.col("s"))).drop("k", "s", "start").join(sizes, "key")


def shrunk(params: DataFrame, elders: DataFrame) -> DataFrame:
    """Estimates (key, elder, rows, centre, scatter) weighted by their rows against ELDERS rows' worth of their elder's: (key, rows, centre, scatter)."""
    up = elders.select(F.col("key").alias("e"), *(F.col(c).alias(f"e_{c}") for c in (*CENTRE, *SCATTER)))
    own = F.col("rows") / (F.col("rows") + ELDERS)
    both = params.join(small_side(cut(up)), F.col("elder") == F.col("e"))
    return cut(both.select("key", "rows", *((own * F.col(c) + (1 - own) * F.col(f"e_{c}")).alias(c) for c in (*CENTRE, *SCATTER))))


def judge(docs: DataFrame, text: str = "text", id_col: str = "doc_id", lang: str = "lang", source: str = "source", tail: float = TAIL) -> DataFrame:
    """Each row's id with the base counts, base_failed, distance (null if base_failed) and kept."""
    stats = text_statistics(docs, text, (id_col, lang, source))
    stats = stats.select(F.col(id_col).alias("doc_id"), F.col(lang).cast("string").alias("__lang"), F.col(source).cast("string").alias("__source"), *COUNTS)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = cut(stats.withColumn("base_failed", failed).select("*", *(v.alias(x) for v, x in zip(_vector(), X))))
    good = stats.filter(~F.col("base_failed"))
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    of_lang = F.concat(F.lit("L"), name("__lang"))
    of_pair = F.concat(F.lit("S"), F.length(name("__lang")), name("__lang"), name("__source"))
    found = cut(fit(good.select(F.explode(F.array(F.lit("*"), of_lang, of_pair)).alias("key"), *X)))
    elder = good.select(of_pair.alias("key"), of_lang.alias("elder")).distinct()
    every = found.filter("key = '*'")
    langs = shrunk(found.filter("key LIKE 'L%'").withColumn("elder", F.lit("*")), every)
    pairs = shrunk(found.filter("key LIKE 'S%'").join(small_side(cut(elder)), "key"), langs)

    def invert(batches):
        for b in batches:
            t = _columns(b)
            mean = np.stack([t[c] for c in CENTRE], axis=1)
            yield _estimates(b.column(0), pa.array([0] * len(mean), pa.int32()), t["rows"], mean, _symmetric(t, "c", len(mean)))

    params = small_side(cut(pairs.mapInArrow(invert, _ESTIMATE_SQL).select("key", *CENTRE, *PRECISION)))
    out = good.withColumn("key", of_pair).join(params, "key", "left").withColumn("distance", distance())
    cols = ["doc_id", *COUNTS, "base_failed"]
    passed = out.select(*cols, "distance", F.coalesce(F.col("distance") <= cutoff(tail), F.lit(True)).alias("kept"))
    return passed.unionByName(stats.filter("base_failed").select(*cols, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept")))
