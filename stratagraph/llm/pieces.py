"""Sampled SentencePiece segmentations, and decoding that gives the text back.

A text is cut before every run of spaces, which no piece spans but at its start; each such chunk is
a lattice of vocabulary pieces, with the byte pieces of a character where no piece covers it alone. Forward filtering sums the weights of all
segmentations up to each place of a chunk; backward sampling then draws the last piece by its share
of the sum, and so on to the start: an exact draw from all segmentations, with probability in
proportion to the product of the pieces' weights. A piece weighs the alpha-th power of its
probability. Draws come from a hash of seed, row key and the place in the text, so a row's
segmentation depends on nothing else, and reruns agree.

The filtering of a chunk depends on its string only, so it is done once for each distinct chunk of
a batch, for all of them together by their places, and a worker keeps the lattices that it met first,
up to BOOK_CHARS; then all chunks are sampled together, a piece of each at a time. Shares are rounded
to 32 bits, so that no draw depends on what else is in a batch or what a worker has kept.

The model's file has merge ranks, not probabilities: a piece of rank r gets one in proportion to
1 / (r + 100), byte pieces as the rarest.

Spaces are the model's lower-one-eighth blocks; that character itself is always spelled in bytes,
which keeps decoding lossless, as does the leading space that isn't added.

Defined results: null and empty texts have no pieces and decode to the empty text; rows with equal
keys and texts get equal pieces; a null key is a key; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.llm.runtime import ship, tidy
from stratagraph.llm.words import mix, prefix_hash, slice_hash

SPACE = "▁"
#: Where the model lies if no path is given: a file that the installed package of public tokenizers names.
MODEL = "piece_bpe_32k.model"
RANK_OFFSET, ALPHA, SEED = 100.0, 0.5, 20
#: Bytes of text that are encoded together; a longer text is done alone. Characters of chunks whose lattices a worker keeps.
BATCH_BYTES, BOOK_CHARS = 1 << 19, 1 << 19


def model_path(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(MODEL)


class Vocabulary:
    """Pieces with ids and log-probabilities, found by the hashes of their code points."""

    def __init__(self, path: str | None = None, rank_offset: float = RANK_OFFSET):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path(path))
        n = model.get_piece_size()
        usable = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        self.byte_ids = np.array([i for i in range(n) if model.is_byte(i)])
        self.strings: list[bytes] = [b""] * n
        for b, i in enumerate(self.byte_ids):
            self.strings[i] = bytes((b,))
        usable.sort(key=lambda i: (-model.get_score(i), i))
        self.pieces: dict[str, tuple[int, float]] = {}
        for rank, i in enumerate(usable):
            piece = model.id_to_piece(i).replace(SPACE, " ")
            self.strings[i] = piece.encode()
            if piece and " " not in piece.lstrip(" "):  # chunks begin at every run of spaces
                self.pieces[piece] = (i, -float(np.log(rank + rank_offset)))
        self.byte_score = -float(np.log(n + rank_offset))
        self.longest = max(map(len, self.pieces))
        code = np.frombuffer("".join(self.pieces).encode("utf-32-le"), dtype=np.uint32)
        ends = np.cumsum([len(p) for p in self.pieces])
        hashes = slice_hash(prefix_hash(code), np.concatenate([[0], ends[:-1]]), ends)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.ids = np.array([i for i, _ in self.pieces.values()])[order]
        self.scores = np.array([s for _, s in self.pieces.values()])[order]
        self.books: dict[float, Book] = {}
        # hashes with equal first 20 bits stand together, from `start` of these
        self.start = np.searchsorted(self.hashes >> np.uint64(44), np.arange((1 << 20) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are pieces', and their places in ids and scores."""
        top = (hashes >> np.uint64(44)).astype(np.int32)
        at = np.flatnonzero(self.start[top] < self.start[top + 1])
        place, end = self.start[top[at]], self.start[top[at] + 1]
        found, places = [], []
        while len(at):
            hit = self.hashes[place] == hashes[at]
            found.append(at[hit])
            places.append(place[hit])
            on = ~hit & (place + 1 < end)
            at, place, end = at[on], place[on] + 1, end[on]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found, places = np.concatenate(found), np.concatenate(places)
        order = np.argsort(found, kind="stable") if len(found) > 1 else slice(None)
        return found[order], places[order]


@cache
def vocabulary(path: str | None) -> Vocabulary:
    return Vocabulary(path)


class Lattices:
    """Filtered lattices of distinct chunks, in flat arrays.

    A state is a place in a chunk after its start; an edge is a piece that ends there. Edges are in
    order of their end states, `first` has where a state's begin, `part` the cumulated share of the
    state's sum up to each, `to` the state before each, or -1, and `last` the end state of each chunk.
    """

    def __init__(self, first: np.ndarray, part: np.ndarray, piece: np.ndarray, to: np.ndarray, last: np.ndarray):
        self.first, self.part, self.piece, self.to, self.last = first, part, piece, to, last

    @classmethod
    def of(cls, vocab: Vocabulary, alpha: float, code: np.ndarray, begin: np.ndarray, length: np.ndarray) -> Lattices:
        """Chunks as slices of the code points `code`."""
        base = np.concatenate([[0], np.cumsum(length)])
        n = int(base[-1])
        chunk = np.repeat(np.arange(len(length)), length)
        place = np.arange(n) - base[chunk]  # of a state (or its last character) in its chunk
        char = code[place + begin[chunk]].astype(np.int64)
        left = length[chunk] - place

        sums = prefix_hash(char)
        starts, sizes, ids, weights = [], [], [], []
        alone = np.zeros(n, dtype=bool)
        at = np.arange(n)
        for size in range(1, vocab.longest + 1):
            at = at[left[at] >= size]
            if not len(at):
                break
            hit, found = vocab.find(slice_hash(sums, at, at + size))
            if size == 1:
                alone[at[hit]] = True
            starts.append(at[hit])
            sizes.append(size)
            ids.append(vocab.ids[found])
            weights.append(alpha * vocab.scores[found])
        bare = np.flatnonzero(~alone)  # characters that only bytes spell; -1 and lower stand for them
        starts.append(bare)
        sizes.append(1)
        ids.append(-1 - char[bare])
        weights.append(alpha * vocab.byte_score * utf8_length(char[bare]))

        # edges to their places by end state, sizes in order
        ends = [x + k - 1 for x, k in zip(starts, sizes)]
        counts = np.zeros(n, dtype=np.int64)
        for x in ends:
            counts[x] += 1
        first = np.concatenate([[0], np.cumsum(counts)])
        total = int(first[-1])
        free = first[:-1].copy()
        start, piece, weight = np.empty(total, np.int64), np.empty(total, np.int64), np.empty(total)
        for x, e, i, w in zip(starts, ends, ids, weights):
            to = free[e]
            start[to], piece[to], weight[to] = x, i, w
            free[e] += 1
        del starts, ends, ids, weights
        opens = place[start] == 0
        log_sum = np.zeros(n + 1)  # the last is that of all starts
        before = np.where(opens, n, start - 1)
        share = np.empty(total)
        by_place = np.argsort(place.astype(np.int32), kind="stable")  # states
        bounds = np.concatenate([[0], np.cumsum(np.bincount(place))]) if n else np.zeros(1, np.int64)
        for low, high in zip(bounds[:-1], bounds[1:]):
            state = by_place[low:high]
            many = counts[state]
            tops = np.cumsum(many) - many
            edges = np.arange(int(many.sum())) + np.repeat(first[state] - tops, many)
            x = log_sum[before[edges]] + weight[edges]
            most = np.maximum.reduceat(x, tops)
            x = np.exp(x - np.repeat(most, many))
            summed = np.add.reduceat(x, tops)
            log_sum[state] = most + np.log(summed)
            share[edges] = x / np.repeat(summed, many)
        for r in range(1, int(counts.max(initial=0))):
            at = first[:-1][counts > r] + r
            share[at] += share[at - 1]
        part = np.minimum(np.floor(share * 2.0**32), 2.0**32 - 1).astype(np.uint32)
        if total:
            part[first[1:] - 1] = np.uint32(2**32 - 1)
        return cls(first.astype(np.int32), part, piece.astype(np.int32), np.where(opens, -1, start - 1).astype(np.int32), (base[1:] - 1).astype(np.int32))

    def plus(self, other: Lattices) -> Lattices:
        states, edges = len(self.first) - 1, len(self.part)
        return Lattices(
            np.concatenate([self.first, other.first[1:] + np.int32(edges)]), np.concatenate([self.part, other.part]), np.concatenate([self.piece, other.piece]),
            np.concatenate([self.to, np.where(other.to < 0, other.to, other.to + np.int32(states))]), np.concatenate([self.last, other.last + np.int32(states)]),
        )

    def sample(self, chunks: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all the chunks in order, and the number of each one's. draws: a 64-bit number for each."""
        state, at, h, found = self.last[chunks], np.arange(len(chunks)), draws, []
        counts = np.zeros(len(chunks), dtype=np.int64)
        while len(at):
            edge = self.first[state]
            h = mix(h + np.uint64(0x9E3779B97F4A7C15))
            u = (h >> np.uint64(32)).astype(np.uint32)
            low = np.flatnonzero(self.part[edge] < u)
            while len(low):
                edge[low] += 1
                low = low[self.part[edge[low]] < u[low]]
            found.append((at, self.piece[edge]))
            counts[at] += 1
            state = self.to[edge]
            on = np.flatnonzero(state >= 0)
            state, at, h = state[on], at[on], h[on]
        place = np.cumsum(counts)
        out = np.empty(int(place[-1]) if len(place) else 0, dtype=np.int64)
        for k, (where, p) in enumerate(found):
            out[place[where] - 1 - k] = p
        return out, counts


class Book:
    """The lattices that a worker keeps, by the hashes of their chunks."""

    def __init__(self):
        none = np.zeros(0, np.int32)
        self.lattices = Lattices(np.zeros(1, np.int32), np.zeros(0, np.uint32), none, none, none)
        self.hashes, self.index = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The chunks of the hashes, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[place] == hashes, self.index[place], -1)

    def add(self, hashes: np.ndarray, lattices: Lattices) -> bool:
        """Whether there was room for them."""
        if len(self.lattices.first) + len(lattices.first) > BOOK_CHARS:
            return False
        index = np.concatenate([self.index, np.arange(len(hashes)) + len(self.lattices.last)])
        both = np.concatenate([self.hashes, hashes])
        order = np.argsort(both, kind="stable")
        self.hashes, self.index, self.lattices = both[order], index[order], self.lattices.plus(lattices)
        return True


def utf8_length(code: np.ndarray) -> np.ndarray:
    return 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)


def spell(pieces: np.ndarray, byte_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces with the byte pieces of each character that stands as -1 - code point, and how many each became."""
    code = np.where(pieces < 0, -1 - pieces, 0)
    sizes = np.where(pieces < 0, utf8_length(code), 1)
    out = np.repeat(pieces, sizes)
    ends = np.cumsum(sizes)
    for size in range(1, 5):
        at = np.flatnonzero((pieces < 0) & (sizes == size))
        for k in range(size):  # the last byte has the lowest six bits
            bits = code[at] >> 6 * k
            byte = bits if size == 1 else (bits & 63) | 128 if k < size - 1 else bits | {2: 0xC0, 3: 0xE0, 4: 0xF0}[size]
            out[ends[at] - 1 - k] = byte_ids[byte]
    return out, sizes


def _sampled(vocab: Vocabulary, alpha: float, code: np.ndarray, begin: np.ndarray, length: np.ndarray, hashes: np.ndarray, same: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of all chunks in order, and the number of each one's: of distinct chunks, of which each chunk is the one `same` says."""
    book = vocab.books.setdefault(alpha, Book())
    known = book.find(hashes)
    new = np.flatnonzero(known < 0)
    fresh = Lattices.of(vocab, alpha, code, begin[new], length[new])
    if len(new) and book.add(hashes[new], fresh):
        known, new = book.find(hashes), new[:0]
    if not len(new):
        return book.lattices.sample(known[same], draws)
    own = np.full(len(hashes), -1)
    own[new] = np.arange(len(new))
    sizes, parts = np.zeros(len(same), dtype=np.int64), []
    for lattices, index in ((book.lattices, known), (fresh, own)):
        at = np.flatnonzero(index[same] >= 0)
        pieces, n = lattices.sample(index[same[at]], draws[at])
        sizes[at] = n
        parts.append((at, pieces, n))
    begins = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), dtype=np.int64)
    for at, pieces, n in parts:
        out[np.arange(len(pieces)) + np.repeat(begins[at] - (np.cumsum(n) - n), n)] = pieces
    return out, sizes


def encode(vocab: Vocabulary, keys: list[str], texts: list[str], alpha: float = ALPHA, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in order, and the bounds of each text's in them."""
    code = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    rows = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    n = len(code)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(rows), np.int64)
    begins = code == 32  # a chunk begins at each run of spaces and at the start of each text
    begins[1:] &= code[:-1] != 32
    begins[rows[:-1][np.diff(rows) > 0]] = True
    begin = np.flatnonzero(begins)
    length = np.diff(np.append(begin, n))
    of_row = np.searchsorted(begin, rows)
    hashes, one, same = np.unique(slice_hash(prefix_hash(code), begin, begin + length), return_index=True, return_inverse=True)
    seeds = np.frombuffer(b"".join(hashlib.blake2b(f"{seed}:{k}".encode(), digest_size=8).digest() for k in keys), dtype=np.uint64)
    counts = np.diff(of_row)
    nth = np.arange(len(begin)) - np.repeat(of_row[:-1], counts)
    draws = mix(np.repeat(seeds, counts) + mix(nth.astype(np.uint64) + np.uint64(1)))
    pieces, sizes = _sampled(vocab, alpha, code, begin[one], length[one], hashes, same, draws)
    ids, spelled = spell(pieces, vocab.byte_ids)
    bounds = np.concatenate([[0], np.cumsum(sizes)])[of_row]
    return ids, np.concatenate([[0], np.cumsum(spelled)])[bounds]


def decode(ids, path: str | None = None) -> str:
    """The text of any segmentation."""
    strings = vocabulary(path).strings
    return b"".join([strings[i] for i in ids]).decode("utf-8", "surrogatepass")


def _slices(batch: pa.RecordBatch, bytes_each: int = BATCH_BYTES):
    size = max(1, batch.nbytes)
    step = max(1, min(len(batch), bytes_each * len(batch) // size))
    for k in range(0, len(batch), step):
        yield batch.slice(k, step)


def _schema(df: DataFrame, n: int) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:n])


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None, alpha: float = ALPHA, seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """id, `carry` columns, text's length in code points and ids (array<int>) of each row; no shuffle."""
    ship(docs)
    slim = docs.select(F.col(id_col), *carry, F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("__k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__t"))

    own = 1 + len(carry)

    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            for b in _slices(batch):
                ids, bounds = encode(vocab, b.column(own).to_pylist(), b.column(own + 1).to_pylist(), alpha, seed)
                pieces = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*b.columns[:own], pc.utf8_length(b.column(own + 1)).cast(pa.int64()), pieces], [id_col, *carry, "n_chars", "ids"])
            tidy()

    return slim.mapInArrow(run, _schema(slim, own) + ", n_chars long, ids array<int>")


def _spelled(table: pa.Array, col: pa.Array) -> pa.Array:
    """The texts that lists of ids spell."""
    flat = pc.take(table, pc.list_flatten(col))
    bounds = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False))])
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), flat), b"").cast(pa.string())


def decode_ids(encoded: DataFrame, id_col: str = "doc_id", ids: str = "ids", path: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """id, `carry` columns, ids and the text they spell."""
    ship(encoded)
    slim = encoded.select(id_col, *carry, ids)
    own = 1 + len(carry)

    def run(batches):
        table = pa.array(vocabulary(path).strings, pa.binary())
        for batch in batches:
            for b in _slices(batch):
                col = b.column(own)
                yield pa.RecordBatch.from_arrays([*b.columns[:own], col, _spelled(table, col)], [id_col, *carry, ids, "text"])
            tidy()

    return slim.mapInArrow(run, _schema(slim, own) + f", `{ids}` array<int>, text string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None, alpha: float = ALPHA, seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """decode_ids() of encode_texts(), by one worker: id, `carry` columns, ids, and the text that they spell."""
    ship(docs)
    slim = docs.select(F.col(id_col), *carry, F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("__k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__t"))
    own = 1 + len(carry)

    def run(batches):
        vocab = vocabulary(path)
        table = pa.array(vocab.strings, pa.binary())
        for batch in batches:
            for b in _slices(batch):
                ids, bounds = encode(vocab, b.column(own).to_pylist(), b.column(own + 1).to_pylist(), alpha, seed)
                col = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*b.columns[:own], col, _spelled(table, col)], [id_col, *carry, "ids", "text"])
            tidy()

    return slim.mapInArrow(run, _schema(slim, own) + ", ids array<int>, text string")
