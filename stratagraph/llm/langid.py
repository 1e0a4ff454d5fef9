"""Language of every word by a linear-chain conditional random field, and of every text.

A word's features are its letters as a whole (the lexicon), prefixes and suffixes of one to four
bytes and all its byte trigrams, hashed into one table of weights for each language. With the
learned transition scores they make a linear chain over the words of a text that have letters;
forward-backward gives each word's distribution over the languages. label_words() emits these for
code-switched text; a text's language is the one with the largest expected share of its words, and
that share, to six places, is the score.

Chains are cut into blocks of words, and all blocks run a word at a time together: first each
block's messages as a matrix, which carries the state before the block to that behind it, then a
vector through the matrices of a chain, then the words inside the blocks from what enters them. So
a text of millions of words takes few steps more than a short one. Long texts are scored in parts,
between words, and only the words' scores are held whole.

The field is trained by AdaGrad on the likelihood of labelled documents: a sample of at most about
`docs_per_lang` whole texts of each language, chosen by a hash of id and text, equal rows once; the
`max_langs` most frequent languages can be learned. Training chains are made of runs of words from
different documents, so that transitions learn what switching costs.

Defined results: a text that is null or has no letter is `und` with score 0, and so is every text
if nothing is labelled; ties go to the language first by code point; repeated rows are predicted
alike, each in a row of its own; a null id is held out by its null remainder no more than others
(false) but never trained on; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratagraph.llm import words as W
from stratagraph.llm.runtime import ship, text_batches, tidy, tidy_driver

TABLE_BITS = 17
AFFIXES = 4
#: The bound of the training sample, and how it is trained.
DOCS_PER_LANG, CHAIN, RUN, EPOCHS, BATCH, RATE, DECAY, SEED = 250, 40, 14, 2, 1024, 0.25, 1e-6, 7
#: The languages that are learned: the most frequent ones, at most so many.
MAX_LANGS = 200
#: Bytes of text that are scored at once and whose chains are run together, and words of a block.
GROUP_BYTES, BLOCK = 1 << 20, 128

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_ASCII_LETTER = _LETTER.copy()
_ASCII_LETTER[128:] = False


@dataclass
class Words:
    """The words with letters of some rows: table places of their features, and where the rows' words begin."""

    ids: np.ndarray  # words x features
    grams: np.ndarray  # of every byte position that begins a trigram
    gram_from: np.ndarray
    gram_to: np.ndarray
    firsts: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def _slot(h: np.ndarray, salt: int) -> np.ndarray:
    return (W.mix(h + np.uint64(salt * 0x9E3779B9)) >> np.uint64(64 - TABLE_BITS)).astype(np.int32)


def features(raw: np.ndarray, offsets: np.ndarray) -> Words:
    starts, ends, firsts = W.spans(raw, offsets)
    letter = _LETTER[raw]
    # the core of a word: from its first to its last letter
    at = np.flatnonzero(letter)
    place = np.searchsorted(at, starts)
    last = np.searchsorted(at, ends) - 1
    has = place <= last
    count = np.concatenate([[0], np.cumsum(has)])
    s, e = at[place[has]] if len(at) else starts[:0], (at[last[has]] + 1) if len(at) else ends[:0]
    low = W.ASCII_LOWER[raw]
    sums = W.prefix_hash(low)
    cols = [_slot(W.slice_hash(sums, s, e), 1)]
    for k in range(1, AFFIXES + 1):
        cols.append(_slot(W.slice_hash(sums, s, np.minimum(s + k, e)), 10 + k))
        cols.append(_slot(W.slice_hash(sums, np.maximum(e - k, s), e), 20 + k))
    wide = low.astype(np.uint32)
    tri = (wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]) * np.uint32(2654435761) if len(low) > 2 else np.zeros(0, np.uint32)
    grams = ((tri ^ tri >> np.uint32(15)) * np.uint32(0x85EBCA6B) >> np.uint32(32 - TABLE_BITS)).astype(np.int32)
    return Words(np.stack(cols, axis=1) if len(s) else np.zeros((0, 2 * AFFIXES + 1), np.int32), grams, s, np.maximum(e - 2, s), count[firsts], s, e)


def emissions(w: Words, theta: np.ndarray, step: int = GROUP_BYTES) -> np.ndarray:
    """Scores of every word for each language; trigrams are summed `step` of them at a time."""
    out = theta[w.ids[:, 0]]
    for k in range(1, w.ids.shape[1]):
        out += theta[w.ids[:, k]]
    for low in range(0, len(w.grams), step):
        grams = w.grams[low : low + step]
        sums = np.zeros((len(grams) + 1, theta.shape[1]))
        np.cumsum(theta[grams], axis=0, out=sums[1:])
        own = slice(int(np.searchsorted(w.gram_to, low, side="right")), int(np.searchsorted(w.gram_from, low + len(grams))))
        out[own] += sums[np.clip(w.gram_to[own] - low, 0, len(grams))] - sums[np.clip(w.gram_from[own] - low, 0, len(grams))]
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    """Each row of x scaled to the sum 1, in place."""
    x /= x.reshape(len(x), -1).sum(axis=1).reshape(-1, *[1] * (x.ndim - 1))
    return x


def marginals(scores: np.ndarray, firsts: np.ndarray, trans: np.ndarray, prior: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Each word's distribution given its whole chain; chains run in blocks of words, all together."""
    n, k = scores.shape
    kind = scores.dtype
    emit = np.exp(scores - scores.max(axis=1, keepdims=True)) if n else scores
    a, p = np.exp(trans).astype(kind), np.exp(prior).astype(kind)
    of_chain = -(-np.diff(firsts) // block)  # blocks of each chain
    tops = np.concatenate([[0], np.cumsum(of_chain)])
    blocks = int(tops[-1])
    chain = np.repeat(np.arange(len(of_chain)), of_chain)
    nth = np.arange(blocks) - tops[chain]
    begin = firsts[chain] + nth * block
    length = np.minimum(firsts[chain + 1] - begin, block)
    order = np.argsort(-length, kind="stable")
    begin, length, opens = begin[order], length[order], np.flatnonzero(nth[order] == 0)
    live = np.searchsorted(-length, -np.arange(1, int(length.max(initial=0)) + 1), side="right")  # blocks longer than t

    def step(now: np.ndarray, t: int) -> np.ndarray:
        m = int(live[t])
        out = (now[:m].reshape(-1, k) @ a).reshape(now[:m].shape)
        if t == 0:
            out[opens] = p
        at = begin[:m] + t
        out *= emit[at] if out.ndim == 2 else emit[at][:, None, :]
        return _unit(out)

    # what enters each block from before (ahead) and from behind, by the matrices of the blocks between
    ahead, behind = np.full((blocks, k), 1 / k, dtype=kind), np.ones((blocks, k), dtype=kind)
    long = np.flatnonzero(of_chain > 1)
    if len(long):
        through = np.broadcast_to(np.eye(k, dtype=kind), (blocks, k, k)).copy()
        for t in range(len(live)):
            through[: live[t]] = step(through, t)
        place = np.empty(blocks, dtype=np.int64)
        place[order] = np.arange(blocks)
        long = long[np.argsort(-of_chain[long], kind="stable")]
        has = np.searchsorted(-of_chain[long], -np.arange(1, int(of_chain[long[0]]) + 1), side="right")
        now = np.full((len(long), k), 1 / k, dtype=kind)
        for r in range(len(has) - 1):
            at = place[tops[long[: has[r + 1]]] + r]
            now = _unit(np.matmul(now[: has[r + 1], None, :], through[at])[:, 0])
            ahead[place[tops[long[: has[r + 1]]] + r + 1]] = now
        now = np.ones((len(long), k), dtype=kind)
        for r in range(len(has) - 1, 0, -1):
            m = has[r]
            now[:m] = _unit(np.matmul(through[place[tops[long[:m]] + r]], now[:m, :, None])[:, :, 0])
            behind[place[tops[long[:m]] + r - 1]] = now[:m]
        del through
    out = np.empty((n, k), dtype=kind)
    for t in range(len(live)):
        ahead = step(ahead, t)
        out[begin[: live[t]] + t] = ahead
    for t in range(len(live) - 1, -1, -1):
        m = int(live[t])
        at = begin[:m] + t
        out[at] = _unit(out[at] * behind[:m])
        behind[:m] = _unit((emit[at] * behind[:m]) @ a.T)
    return out


@dataclass
class Model:
    langs: list[str]
    theta: np.ndarray
    trans: np.ndarray
    prior: np.ndarray

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the words of some rows and where the rows begin; a single long row goes in parts, between words."""
        cuts = [0]
        while len(offsets) == 2 and len(raw) - cuts[-1] > 2 * GROUP_BYTES:
            gap = np.flatnonzero(W.SPACE[raw[cuts[-1] + GROUP_BYTES : cuts[-1] + 2 * GROUP_BYTES]])
            if not len(gap):  # a word longer than that stays whole
                far = np.flatnonzero(W.SPACE[raw[cuts[-1] + 2 * GROUP_BYTES :]])
                if not len(far):
                    break
                gap = far + GROUP_BYTES
            cuts.append(cuts[-1] + GROUP_BYTES + int(gap[0]))
        if len(cuts) == 1:
            w = features(raw, offsets)
            return emissions(w, self.theta), w.firsts
        parts = [emissions(features(part, np.array([0, len(part)])), self.theta) for part in np.split(raw, cuts[1:])]
        return np.concatenate(parts), np.array([0, sum(map(len, parts))])

    def label(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
        """The words with letters of some rows, and each one's distribution over the languages."""
        w = features(raw, offsets)
        return w, marginals(emissions(w, self.theta), w.firsts, self.trans, self.prior)

    def shares(self, parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """For each row of the parts (bytes, offsets) the languages' expected shares of its words; 0 if it has none."""
        found = [self.scores(raw, offsets) for raw, offsets in parts]
        sizes = np.concatenate([np.diff(f) for _, f in found])
        firsts = np.concatenate([[0], np.cumsum(sizes)])
        scores = np.concatenate([s for s, _ in found])
        del found
        g = marginals(scores, firsts, self.trans, self.prior)
        out = np.zeros((len(sizes), g.shape[1]))
        some = np.flatnonzero(sizes)
        if len(some):
            out[some] = np.add.reduceat(g, firsts[some], axis=0, dtype=np.float64) / sizes[some, None]
        return out


def _chains(texts: list[str], labels: np.ndarray, rng: np.random.Generator) -> tuple[Words, np.ndarray, np.ndarray]:
    """All words, and chains of CHAIN of them (a row each): runs of about RUN words from documents in random order."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in raw])])
    w = features(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets)
    y = np.repeat(labels, np.diff(w.firsts))
    runs = []
    for begin, end in zip(w.firsts[:-1], w.firsts[1:]):
        at = begin
        while at < end:
            to = min(end, at + 1 + int(rng.geometric(1 / RUN)))
            runs.append((at, to))
            at = to
    rng.shuffle(runs)
    order = np.concatenate([np.arange(a, b) for a, b in runs]) if runs else np.zeros(0, np.int64)
    return w, y, order[: len(order) // CHAIN * CHAIN].reshape(-1, CHAIN)


def train(texts: list[str], langs: list[str], epochs: int = EPOCHS, seed: int = SEED) -> Model | None:
    """The field from whole labelled texts; None if there are no words."""
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    w, y, chains = _chains(texts, np.array([names.index(x) for x in langs], dtype=np.int64), rng)
    if not len(w.ids):
        return None
    if not len(chains):
        chains = np.arange(len(w.ids))[None, :]
    k, size = len(names), 1 << TABLE_BITS
    length = chains.shape[1]
    theta, trans, prior = np.zeros((size, k)), np.zeros((k, k)), np.zeros(k)
    g2, t2, p2 = (np.full(x.shape, 1e-4) for x in (theta, trans, prior))
    n_grams = w.gram_to - w.gram_from
    for _ in range(epochs):
        order = rng.permutation(len(chains))
        for low in range(0, len(order), BATCH):
            c = chains[order[low : low + BATCH]]
            flat = c.ravel()
            tri = np.repeat(w.gram_from[flat] - np.concatenate([[0], np.cumsum(n_grams[flat])[:-1]]), n_grams[flat]) + np.arange(n_grams[flat].sum())
            owner = np.repeat(np.arange(len(flat)), n_grams[flat])
            grams = w.grams[tri]
            scores = theta[w.ids[flat]].sum(axis=1)
            by_gram = theta[grams]
            for j in range(k):
                scores[:, j] += np.bincount(owner, weights=by_gram[:, j], minlength=len(flat))
            emit = np.exp(scores - scores.max(axis=1, keepdims=True)).reshape(len(c), length, k)
            a = np.exp(trans)
            alpha, beta = np.empty_like(emit), np.ones_like(emit)
            for t in range(length):
                alpha[:, t] = emit[:, t] * (np.exp(prior) if t == 0 else alpha[:, t - 1] @ a)
                alpha[:, t] /= alpha[:, t].sum(axis=1, keepdims=True)
            pairs = np.zeros((k, k))
            for t in range(length - 2, -1, -1):
                eb = emit[:, t + 1] * beta[:, t + 1]
                xi = alpha[:, t, :, None] * a[None] * eb[:, None, :]
                pairs += (xi / xi.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
                beta[:, t] = eb @ a.T
                beta[:, t] /= beta[:, t].sum(axis=1, keepdims=True)
            gamma = alpha * beta
            gamma /= gamma.sum(axis=2, keepdims=True)
            gold = np.eye(k)[y[c]]
            seen = np.zeros((k, k))
            np.add.at(seen, (y[c[:, :-1]].ravel(), y[c[:, 1:]].ravel()), 1)
            diff = (gold - gamma).reshape(-1, k)
            step = np.stack([np.bincount(w.ids[flat].ravel(), weights=np.repeat(diff[:, j], w.ids.shape[1]), minlength=size) + np.bincount(grams, weights=diff[owner, j], minlength=size) for j in range(k)], axis=1)
            n = len(flat)
            for value, grad, square in ((theta, step / n, g2), (trans, (seen - pairs) / n, t2), (prior, (gold - gamma)[:, 0].sum(axis=0) / n, p2)):
                grad -= DECAY * value
                square += grad * grad
                value += RATE * grad / np.sqrt(square)
    return Model(names, theta.astype(np.float32), trans, prior)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", docs_per_lang: int = DOCS_PER_LANG, max_langs: int = MAX_LANGS) -> Model | None:
    """Trains on a sample, bounded by docs_per_lang and max_langs, of the labelled documents that aren't held out."""
    rows = docs.select(F.col(id_col).cast("string").alias("i"), F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("l"))
    rows = rows.filter(F.col("l").isNotNull() & F.col("i").isNotNull() & ~held_out(F.col("i")))
    # a hash threshold for each language takes about as many as asked for
    counts = rows.groupBy("l").count().orderBy(F.col("count").desc(), "l").limit(max_langs).collect()
    if not counts:
        return None
    share = F.create_map(*(x for r in sorted(counts) for x in (F.lit(r["l"]), F.lit(docs_per_lang / r["count"]))))
    draw = F.pmod(F.xxhash64("i", "t"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.filter(F.col("t").isNotNull() & (draw < F.coalesce(share[F.col("l")], F.lit(0.0)))).distinct().toPandas()
    tidy_driver(docs.sparkSession)
    sample = sample.sort_values(["l", "i", "t"])
    model = train(sample["t"].tolist(), sample["l"].tolist()) if len(sample) else None
    del sample
    tidy()
    return model


def _known(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each row has a letter."""
    letters = np.concatenate([[0], np.cumsum(_ASCII_LETTER[raw], dtype=np.int64)])[offsets]
    out = letters[1:] > letters[:-1]
    for k in np.flatnonzero(~out):
        out[k] = any(map(str.isalpha, raw[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace")))
    return out


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, lang_pred and score of every whole text; one pass, no shuffle. The id may be a struct of a whole row, and the text a string in it, `row.text`."""
    ship(docs)
    slim = docs.select(F.col(id_col), F.col(text).cast("string").alias("__t"))
    own = text.removeprefix(f"{id_col}.") if text.startswith(f"{id_col}.") and isinstance(docs.select(text).schema[0].dataType, T.StringType) else None
    if own and model is not None:  # texts go to the workers once
        slim = slim.select(id_col)
    if model is None:
        return slim.select(id_col, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    schema = T.StructType([slim.schema[0], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        names = pa.array([*model.langs, "und"], pa.string())
        for batch in batches:
            pred, score = [np.zeros(0, np.int64)], [np.zeros(0)]
            group: list[tuple[np.ndarray, np.ndarray]] = []

            def flush():
                if not group:
                    return
                shares = model.shares(group)
                known = np.concatenate([_known(*part) for part in group])
                best = shares.round(6).argmax(axis=1)
                pred.append(np.where(known, best, len(model.langs)))
                score.append(np.where(known, np.minimum(shares[np.arange(len(best)), best].round(6), 1.0), 0.0))
                group.clear()

            texts = pa.RecordBatch.from_arrays([pc.struct_field(batch.column(0), own)], ["__t"]) if own else batch
            for _, raw, offsets in text_batches(texts, "__t", GROUP_BYTES // 4):
                group.append((raw, offsets))
                if sum(len(r) for r, _ in group) >= GROUP_BYTES:
                    flush()
            flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), names.take(pa.array(np.concatenate(pred))), pa.array(np.concatenate(score))], [id_col, "lang_pred", "score"])
            tidy()

    return slim.mapInArrow(run, schema)


def label_words(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id and words, an array of (word, lang, score) of the words with letters in their order; null text: empty."""
    ship(docs)
    slim = docs.select(F.col(id_col), F.col(text).cast("string").alias("__t"))
    word = T.StructType([T.StructField("word", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])
    schema = T.StructType([slim.schema[0], T.StructField("words", T.ArrayType(word))])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        names = pa.array(model.langs, pa.string())
        for batch in batches:
            for k, raw, offsets in text_batches(batch, "__t", GROUP_BYTES):
                w, g = model.label(raw, offsets)
                words = pa.array([raw[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(w.starts, w.ends)], pa.string())
                rows = pa.StructArray.from_arrays([words, names.take(pa.array(g.argmax(axis=1))), pa.array(g.max(axis=1).astype(np.float64).round(6))], ["word", "lang", "score"])
                lists = pa.ListArray.from_arrays(pa.array(w.firsts, pa.int32()), rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, len(offsets) - 1), lists], [id_col, "words"])

    return slim.mapInArrow(run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", docs_per_lang: int = DOCS_PER_LANG) -> DataFrame:
    """id, held_out, lang_pred and score of each row."""
    model = fit(docs, id_col, text, lang, docs_per_lang)
    return predict(docs, model, id_col, text).select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), "lang_pred", "score")
