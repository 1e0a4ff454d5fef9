"""Quality classifier: a document's own evidence combined with its site's by hierarchical empirical Bayes.

A logistic regression on text statistics and hashed words, fitted on a bounded sample of labelled
rows, gives each document a probability of good quality. Sites have two levels, host and path (host,
directory); all rows count towards them, a labelled one by its label, another by the classifier's
probability at a lower weight. Posteriors shrink: a host's mean towards the global mean, a path's
towards its host's, each by a prior strength that the method of moments finds from the spread between
sites; so a site with little evidence says little. A document's own evidence is left out of its site's
posteriors, so that its label or text doesn't count twice. Its posterior log-odds are the classifier's
plus those of its path over the global ones.

Sites are only grouped and summed up: partial sums are combined before they are shuffled, and a
site's posterior joins its documents' narrow rows.

Defined results: a null or empty text has the statistics of an empty text; null hosts or paths are
sites like others; several labels of one id count as their mean, null ones not; without any labels every
document gets the prior 0.5 and is kept; repeated rows are judged alike, each in a row of its own;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagraph.llm import words as W
from stratagraph.llm.outliers import text_counts
from stratagraph.llm.runtime import cut, ship, small_side, text_batches, tidy

#: The bound of the labelled sample that the classifier is fitted on.
SAMPLE_ROWS = 8_000
#: What a document without a label counts as site evidence, and the bounds of a prior's strength.
SOFT_WEIGHT, STRENGTH = 0.25, (20.0, 2_000.0)
#: Most log-odds that a site may add or take.
SITE_LIMIT = 2.0
KEEP = 0.5
#: Hash slots of words, and how the classifier is trained.
SLOT_BITS, EPOCHS, BATCH, RATE, PENALTY, SEED = 12, 30, 256, 0.1, 1e-3, 7

FEATURES = ("log_words", "word_chars", "symbols", "pipes", "marks", "digits", "upper", "dup_lines", "repeats", "stops")
_CLASSES = {
    "symbols": b"#*$%&<>", "pipes": b"|", "marks": b"!?", "digits": b"0123456789", "upper": bytes(range(65, 91)), "stops": b".,;:",
}


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


_TABLES = {k: _flags(v) for k, v in _CLASSES.items()}


def text_features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each row of UTF-8 bytes."""
    c = text_counts(raw, offsets)
    n = np.maximum(c["n_words"], 1).astype(float)
    solid = np.maximum(c["word_chars"], 1).astype(float)

    def share(name: str) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(_TABLES[name][raw])])
        return total[offsets[1:]] - total[offsets[:-1]]

    return np.stack([
        np.log1p(c["n_words"]), np.log(solid / n), np.minimum(share("symbols") / n, 3), np.minimum(share("pipes") / n, 1), np.minimum(share("marks") / n, 3),
        share("digits") / solid, share("upper") / solid, c["n_dup_lines"] / n, c["n_repeat_words"] / n, np.minimum(share("stops") / n, 1),
    ], axis=1)


def word_features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots and weights of each row's words, and where the rows begin: 1 + ln of a slot's count, scaled to the length 1 of a row."""
    low = W.ASCII_LOWER[raw]
    starts, ends, firsts = W.spans(low, offsets)
    slots = (W.word_hashes(low, starts, ends) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
    both, counts = np.unique(rows << SLOT_BITS | slots, return_counts=True)
    rows, slots, weights = both >> SLOT_BITS, both & ((1 << SLOT_BITS) - 1), 1 + np.log(counts)
    norm = np.sqrt(np.bincount(rows, weights=weights**2, minlength=len(offsets) - 1))
    return slots, weights / norm[rows], np.searchsorted(rows, np.arange(len(offsets)))


@dataclass
class Classifier:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    words: np.ndarray
    bias: float

    def probability(self, x: np.ndarray, slots: np.ndarray, values: np.ndarray, begins: np.ndarray) -> np.ndarray:
        rows = np.repeat(np.arange(len(x)), np.diff(begins))
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + np.bincount(rows, weights=self.words[slots] * values, minlength=len(x)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -8, 8)))

    def of(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The probability of each row of UTF-8 bytes."""
        return self.probability(text_features(raw, offsets), *word_features(raw, offsets))


def train(x: np.ndarray, slots: np.ndarray, values: np.ndarray, begins: np.ndarray, y: np.ndarray) -> Classifier:
    """Ridge logistic regression by AdaGrad on standardised statistics and words, rows in a seeded random order."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-6] = 1.0
    z = np.c_[np.clip((x - mean) / scale, -8, 8), np.ones(len(x))]
    w, words = np.zeros(z.shape[1]), np.zeros(1 << SLOT_BITS)
    w[-1] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    squares = [np.full(len(w), 1e-4), np.full(len(words), 1e-4)]
    rng, sizes = np.random.default_rng(SEED), np.diff(begins)
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for low in range(0, len(order), BATCH):
            rows = order[low : low + BATCH]
            n = sizes[rows]
            at = np.arange(int(n.sum())) + np.repeat(begins[rows] - (np.cumsum(n) - n), n)
            owner = np.repeat(np.arange(len(rows)), n)
            score = z[rows] @ w + np.bincount(owner, weights=words[slots[at]] * values[at], minlength=len(rows))
            diff = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - y[rows]
            grads = (z[rows].T @ diff / len(rows) + PENALTY * np.r_[w[:-1], 0.0], np.bincount(slots[at], weights=diff[owner] * values[at], minlength=len(words)) / len(rows) + PENALTY * words)
            for value, grad, square in zip((w, words), grads, squares):
                square += grad * grad
                value -= RATE * grad / np.sqrt(square)
    return Classifier(mean, scale, w[:-1], words, float(w[-1]))


def _sampled(rows: DataFrame, most: int) -> tuple:
    """Features of rows (id, digest, y, text), of at most so many, in order of id and digest: statistics, slots, weights, begins, labels."""

    def run(batches):
        for batch in batches:
            for k, raw, offsets in text_batches(batch, "text"):
                x = text_features(raw, offsets)
                slots, values, begins = word_features(raw, offsets)
                lists = lambda bounds, of, kind: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(of, kind))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(k, len(x)) for i in (0, 1, 2)), lists(np.arange(len(x) + 1) * x.shape[1], x.ravel(), pa.float64()), lists(begins, slots, pa.int16()), lists(begins, values, pa.float32())], ["id", "digest", "y", "x", "slots", "values"])
            tidy()

    found = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, digest string, y double, x array<double>, slots array<short>, values array<float>")
    t = found.orderBy(F.xxhash64("id", "digest"), "id", "digest").limit(most).toArrow().sort_by([("id", "ascending"), ("digest", "ascending")]).combine_chunks()
    flat = lambda c: pc.list_flatten(t.column(c)).to_numpy()
    begins = np.concatenate([[0], np.cumsum(pc.list_value_length(t.column("slots")).to_numpy())]).astype(np.int64)
    return flat("x").reshape(-1, len(FEATURES)), flat("slots").astype(np.int64), flat("values").astype(float), begins, t.column("y").to_numpy()


def fit(rows: DataFrame, y: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Classifier | None:
    """The classifier from the rows (id, text) of a sample of the labels (__i, y): about sample_rows of them, drawn by a hash of the id, each text of an id once."""
    n = y.count()
    if not n:
        return None
    draw = F.pmod(F.xxhash64(F.col("__i").cast("string"), F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    some = F.broadcast(cut(y.filter(draw < sample_rows / n).orderBy(draw, "__i").limit(sample_rows)))
    known = rows.select("id", "text").join(some, F.col("id") == F.col("__i")).select("id", F.md5("text").alias("digest"), "y", "text").dropDuplicates(["id", "digest"])
    sample = _sampled(known, sample_rows)  # an id may stand for many texts: so many of them as the sample may have
    model = train(*sample) if len(sample[-1]) else None
    del sample
    tidy()
    return model


def _probabilities(rows: DataFrame, model: Classifier) -> DataFrame:
    """The rows (.., text) with p_text in place of text."""
    names = [c for c in rows.columns if c != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text") + ", p_text double"
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            parts = [model.of(raw, offsets) for _, raw, offsets in text_batches(batch, "text")]
            p = pa.array(np.concatenate(parts) if parts else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), p], [*names, "p_text"])
            tidy()

    return rows.select(*names, "text").mapInArrow(run, schema)


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _clip(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))


def _strength(sites: DataFrame, mean: float) -> float:
    """Prior observations that explain how far site means lie apart (method of moments), within bounds."""
    m = sites.agg(F.count(F.lit(1)).alias("k"), F.sum("w").alias("w"), F.sum(F.col("w") ** 2).alias("w2"), F.sum(F.col("w") * (F.col("s") / F.col("w") - mean) ** 2).alias("ss")).first()
    if not m["k"] or m["k"] < 2 or mean in (0.0, 1.0):
        return STRENGTH[1]
    within = mean * (1 - mean)
    spread = (m["ss"] - (m["k"] - 1) * within) / max(m["w"] - m["w2"] / m["w"], 1e-9)
    return float(min(max(within / spread - 1, STRENGTH[0]), STRENGTH[1])) if spread > 0 else STRENGTH[1]


def classify(docs: DataFrame, labels: DataFrame, sites: DataFrame | None = None, id_col: str = "doc_id", text: str = "text", host: str = "source", section: str = "lang", keep: float = KEEP, sample_rows: int = SAMPLE_ROWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, host, path, p_text (the classifier's), p_path (the site's) and posterior, whether it is kept, and the columns `carry`.

    labels: (id, quality). sites: optional (id, host, section) with one row for an id, which goes before the columns.
    """
    ship(docs)
    rows = docs.select(F.col(id_col).alias("id"), F.col(host).cast("string").alias("host"), F.col(section).cast("string").alias("section"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), *carry)
    y = cut(labels.select(F.col(id_col).alias("__i"), F.col("quality").cast("double").alias("quality")).filter(F.col("__i").isNotNull() & F.col("quality").isNotNull()).groupBy("__i").agg(F.avg("quality").alias("y")))
    model = fit(rows, y, sample_rows)
    if model is None:
        return rows.select(F.col("id").alias("doc_id"), "host", F.concat_ws("/", "host", "section").alias("path"), F.lit(0.5).alias("p_text"), F.lit(0.5).alias("p_path"), F.lit(0.5).alias("posterior"), F.lit(True).alias("kept"), *carry)
    marked = _probabilities(rows, model).join(y, F.col("id") == F.col("__i"), "left").drop("__i")
    if sites is not None:
        own = sites.select(F.col(id_col).alias("__i"), F.col("host").alias("__h"), F.col("section").alias("__s")).filter(F.col("__i").isNotNull())
        marked = marked.join(own, F.col("id") == F.col("__i"), "left").withColumns({"host": F.coalesce("__h", "host"), "section": F.when(F.col("__h").isNotNull(), F.col("__s")).otherwise(F.col("section"))}).drop("__i", "__h", "__s")
    weight = F.when(F.col("y").isNotNull(), F.lit(1.0)).otherwise(F.lit(SOFT_WEIGHT))
    scored = cut(marked.select("id", "host", "section", "p_text", weight.alias("w0"), (weight * F.coalesce("y", "p_text")).alias("s0"), *carry))
    paths = cut(scored.groupBy("host", "section").agg(F.sum("w0").alias("w"), F.sum("s0").alias("s")))
    hosts = cut(paths.groupBy("host").agg(F.sum("w").alias("w"), F.sum("s").alias("s")))
    total = hosts.agg(F.sum("w").alias("w"), F.sum("s").alias("s")).first()
    mean = float(min(max(total["s"] / total["w"], 1e-4), 1 - 1e-4)) if total["w"] else 0.5
    k_host, k_path = _strength(hosts, mean), _strength(paths, mean)
    of_host = hosts.select(F.col("host").alias("__h0"), F.col("w").alias("w2"), F.col("s").alias("s2"))
    sited = paths.join(small_side(of_host), F.col("host").eqNullSafe(F.col("__h0"))).select(F.col("host").alias("__h"), F.col("section").alias("__s"), F.col("w").alias("w1"), F.col("s").alias("s1"), "w2", "s2")
    out = scored.join(small_side(cut(sited)), F.col("host").eqNullSafe(F.col("__h")) & F.col("section").eqNullSafe(F.col("__s")))
    # a site's evidence without the row's own
    rest = lambda total, mine: F.greatest(F.col(total) - F.col(mine), F.lit(0.0))
    p_host = (rest("s2", "s0") + k_host * mean) / (rest("w2", "w0") + k_host)
    out = out.withColumn("p_path", (rest("s1", "s0") + k_path * p_host) / (rest("w1", "w0") + k_path))
    shift = _logit(_clip(F.col("p_path"))) - float(np.log(mean / (1 - mean)))
    odds = _logit(_clip(F.col("p_text"))) + F.least(F.greatest(shift, F.lit(-SITE_LIMIT)), F.lit(SITE_LIMIT))
    out = out.withColumn("posterior", 1 / (1 + F.exp(-odds)))
    return out.select(F.col("id").alias("doc_id"), "host", F.concat_ws("/", "host", "section").alias("path"), "p_text", "p_path", "posterior", (F.col("posterior") >= keep).alias("kept"), *carry)


def page_sites(pages: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, host, section) of the documents that pages show: their urls end in the document's number. One row for an id."""
    path = F.regexp_extract(F.col("url"), r"^[^:]*://[^/?#]*([^?#]*)", 1)
    number = F.regexp_extract(path, r"/([0-9]{1,18})(?:\.html)?/?$", 1)
    rows = pages.select(
        F.when(number != "", number).cast("long").alias(id_col),
        F.lower(F.regexp_extract(F.col("url"), r"^[^:]*://([^/?#]*)", 1)).alias("host"),
        F.regexp_extract(path, r"^/(.*)/[^/]+/?$", 1).alias("section"),
    )
    return rows.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(F.struct("host", "section")).alias("s")).select(id_col, "s.host", "s.section")
