"""Hidden Markov language model: Baum-Welch over partitions, exact likelihood of whole texts.

Tokens are the lower-cased (A-Z) words ``[^\\x20\\x09-\\x0D]+`` of a text and one end token.
Documents whose ``crc32(doc_id as text) mod 7`` is 2 are held out; all others train.

Model.  A text is a path of ``STATES`` latent states with a token drawn in each:
start probabilities, transitions, and in state k the token w with probability

    b_k(w) = q(w) * ratio_k(symbol of w),
    ratio_k(s) = (1 - FLOOR) * (n_k(s) / n_k) / Q(s) + FLOOR,

where ``q(w) = (c + 1) / (N + V + 1)`` is the add-one unigram over all training tokens (the
extra one is the unknown word) and ``Q(s)`` is its sum over the words of symbol s.  A
word that makes up at least one in ``PROFILES`` training tokens (twice or more) is a
symbol of its own; by counting there are at most ``PROFILES`` of these at any size.  The
other words share ``SHAPES`` symbols by the digest of their last bytes, and those seen once
share symbol 0 with the unknown word.  Every b_k sums to 1 over words and unknown, so the scaled
forward recursion gives the exact log probability; it is summed over all paths.

Jobs.  (1) Texts become chunks of token ids with the chunk's own word list.  (2) One
exchange by word sums the counts over all chunks; every word of the corpus is
counted, whatever its frequency.  (3) Each chunk meets the counts of its words again, which
gives the unigram scores and turns words into symbols.  (4) Each Baum-Welch step is one
pass over the stored symbols: tasks run forward-backward and emit expected counts, which
are summed per symbol.  Parameters are at most 2^16 x STATES numbers, the only thing that
passes through the driver.  (5) A last forward pass scores all documents.

Long texts are cut into pieces whose transfer matrices are combined first, so that all pieces of a
chunk go forward (and backward) side by side; results don't depend on the cut.  A task
holds a chunk's ids and the probabilities of ``WINDOW`` tokens at a time.

Cases: null text is empty (the end token alone); a null id is not held out; repeated rows are
texts of their own; without training texts q is 1 for the unknown word and all scores are 0;
an empty table gives an empty result; clashing column names don't matter, since only id and
text are read.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.llm.common import slices, stored, table

STATES = 4
STEPS = 5  # Baum-Welch passes
PROFILES = 61_440  # a word of at least 1 / PROFILES of the training tokens has its own profile
SHAPES = 4_096  # symbols of all other words; SHAPES + PROFILES = 2^16
MAX_PROFILE_BYTES = 256  # longer words are told apart by their last bytes, whatever their count
FLOOR = 0.05
CHUNK_TOKENS = 1 << 22
WINDOW = 1 << 18  # tokens whose probabilities are held at once
PIECE = 256
HELD_OUT = (7, 2)
END = b" "  # no word holds a space


def numbered() -> defaultdict:
    """Numbers words in order of their first use."""
    return defaultdict(count().__next__)


def chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of up to about ``CHUNK_TOKENS`` tokens of whole documents.

    ``chunk`` numbers them; ``ids`` are token ids (uint32, deflated) in the order of the
    ``words`` list; ``doc_ids``, ``lens`` and ``held`` have an entry per document, ``train`` one per word.
    """
    key = F.col(doc_id)
    crc = F.crc32(key.cast("string").cast("binary"))
    src = docs.select(key.alias("id"), F.coalesce(crc % HELD_OUT[0] == HELD_OUT[1], F.lit(False)).alias("held"), F.col(text).alias("text"))
    id_type = src.schema["id"].dataType
    schema = T.StructType([
        T.StructField("chunk", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("words", T.ArrayType(T.BinaryType())),
        T.StructField("train", T.ArrayType(T.IntegerType())), T.StructField("doc_ids", T.ArrayType(id_type)),
        T.StructField("lens", T.ArrayType(T.IntegerType())), T.StructField("held", T.ArrayType(T.BooleanType())),
    ])
    limit = CHUNK_TOKENS

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        index, tokens, doc_ids, lens, held, kind = numbered(), [], [], [], [], None
        n = 0

        def flush():
            nonlocal index, tokens, doc_ids, lens, held, n, number
            ids = np.concatenate(tokens)
            trains = np.repeat(~np.array(held, bool), lens)
            train = np.bincount(ids[trains], minlength=len(index)).astype(np.int32)
            lists = [(list(index), pa.binary()), (train, pa.int32()), (doc_ids, kind), (lens, pa.int32()), (held, pa.bool_())]
            wrap = lambda v, t: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, t))
            out = pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([zlib.compress(ids.tobytes(), 1)], pa.binary()), *[wrap(v, t) for v, t in lists]],
                names=schema.names,
            )
            index, tokens, doc_ids, lens, held, n = numbered(), [], [], [], [], 0
            number += 1
            return out

        for rb in slices(batches, 64):
            kind = rb.schema.field(0).type
            for i, h, t in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), rb.column(2).to_pylist()):
                words = (t or "").encode().lower().split()  # bytes: A-Z only, ASCII white space only
                words.append(END)
                tokens.append(np.fromiter(map(index.__getitem__, words), np.uint32, len(words)))
                doc_ids.append(i)
                lens.append(len(words))
                held.append(h)
                n += len(words)
                if n >= limit:
                    yield flush()
        if doc_ids:
            yield flush()

    return src.mapInArrow(run, schema)


def word_counts(parts: DataFrame) -> DataFrame:
    """(chunk, at, word, c, head): every word of every chunk with its training count in the
    whole corpus; ``head`` marks one row of each word."""
    rows = parts.select("chunk", F.posexplode(F.arrays_zip("words", "train")).alias("at", "w"))
    rows = rows.select("chunk", "at", F.col("w.words").alias("word"), F.col("w.train").cast("long").alias("k"))
    same = Window.partitionBy("word")
    return rows.select("chunk", "at", "word", F.sum("k").over(same).alias("c"), (F.min("chunk").over(same) == F.col("chunk")).alias("head"))


def shape(word: bytes) -> int:
    """Symbol of a word without a profile, from its last bytes; 0 is kept for words seen once."""
    return 1 + zlib.crc32(word[-3:]) % (SHAPES - 1)


def symbol_of(word: bytes, count: int, profiled: dict[bytes, int]) -> int:
    if count <= 1:
        return 0
    own = profiled.get(word)
    return shape(word) if own is None else own


def symbols(parts: DataFrame, counts: DataFrame, n: int, v: int, profiled: dict[bytes, int]) -> DataFrame:
    """Per chunk: symbols (uint16, deflated), and per document its id, length, held, known tokens and unigram score."""
    spark = parts.sparkSession
    known = spark.sparkContext.broadcast(profiled)  # PROFILES words of MAX_PROFILE_BYTES at most
    id_type = parts.schema["doc_ids"].dataType
    out = T.StructType([
        T.StructField("chunk", T.LongType()), T.StructField("symbols", T.BinaryType()), T.StructField("doc_ids", id_type),
        T.StructField("lens", T.ArrayType(T.IntegerType())), T.StructField("held", T.ArrayType(T.BooleanType())),
        T.StructField("n_known", T.ArrayType(T.LongType())), T.StructField("base", T.ArrayType(T.DoubleType())),
    ])
    floor = math.log10(n + v + 1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = np.frombuffer(zlib.decompress(left["ids"][0].as_py()), np.uint32)
        lens = left["lens"].combine_chunks().flatten().to_numpy()
        at = right["at"].to_numpy()
        c = np.zeros(len(at), np.int64)
        c[at] = right["c"].to_numpy()
        sym = np.zeros(len(at), np.uint16)
        profiled, words, counts = known.value, right["word"].to_pylist(), right["c"].to_pylist()
        sym[at] = [symbol_of(w, k, profiled) for w, k in zip(words, counts)]
        starts = np.concatenate(([0], np.cumsum(lens)[:-1]))
        base = np.add.reduceat((np.log10(c + 1.0) - floor)[ids], starts)
        n_known = np.add.reduceat((c > 0).astype(np.int64)[ids], starts)
        one = lambda values, t: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, t))
        same = lambda name: left[name].combine_chunks()
        return pa.table({
            "chunk": same("chunk"), "symbols": pa.array([zlib.compress(sym[ids].tobytes(), 1)], pa.binary()), "doc_ids": same("doc_ids"),
            "lens": same("lens"), "held": same("held"), "n_known": one(n_known, pa.int64()), "base": one(base, pa.float64()),
        })

    left = parts.select("chunk", "ids", "doc_ids", "lens", "held").groupBy("chunk")
    return left.cogroup(counts.select("chunk", "at", "word", "c").groupBy("chunk")).applyInArrow(run, out)


class Model:
    """Start probabilities, transitions and emission ratios (symbol x state)."""

    def __init__(self, start: np.ndarray, trans: np.ndarray, ratio: np.ndarray):
        self.start, self.trans, self.ratio = start, trans, ratio

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What is broadcast: executors don't have this package to unpickle a class from."""
        return self.start, self.trans, self.ratio

    @classmethod
    def first(cls, q: np.ndarray, states: int) -> Model:
        """Equal starts, states that tend to stay, and profiles tilted by the digest of symbol and state."""
        tilt = np.array([[0.5 + zlib.crc32(b"%d:%d" % (s, k)) / 2**32 for k in range(states)] for s in range(len(q))])
        emit = q[:, None] * tilt
        emit /= emit.sum(0)
        stay = 0.9 if states > 1 else 1.0
        trans = np.full((states, states), (1 - stay) / max(1, states - 1))
        np.fill_diagonal(trans, stay)
        return cls(np.full(states, 1 / states), trans, cls.ratios(emit, q))

    @staticmethod
    def ratios(emit: np.ndarray, q: np.ndarray) -> np.ndarray:
        ml = np.divide(emit, q[:, None], out=np.zeros_like(emit), where=q[:, None] > 0)
        return (1 - FLOOR) * ml + FLOOR

    @classmethod
    def fitted(cls, starts: np.ndarray, moves: np.ndarray, emit: np.ndarray, q: np.ndarray) -> Model:
        """From expected counts.  A state that nothing was drawn in keeps the unigram."""
        states = len(starts)
        start = (starts + 1) / (starts.sum() + states)
        trans = (moves + 1) / (moves.sum(1, keepdims=True) + states)
        total = emit.sum(0)
        share = np.where(total > 0, emit / np.where(total > 0, total, 1), q[:, None])
        return cls(start, trans, cls.ratios(share, q))


class Pieces:
    """Documents' symbols cut into pieces of up to ``PIECE`` tokens, longest first, that go side by side."""

    def __init__(self, lens: np.ndarray):
        per_doc = -(-lens // PIECE)
        doc = np.repeat(np.arange(len(lens)), per_doc)
        number = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
        begin = np.concatenate(([0], np.cumsum(lens)))[doc] + number * PIECE
        size = np.minimum(PIECE, lens[doc] - number * PIECE)
        self.order = np.argsort(-size, kind="stable")
        self.place = np.empty_like(self.order)
        self.place[self.order] = np.arange(len(self.order))
        self.begin, self.size = begin[self.order], size[self.order]
        self.first = (number == 0)[self.order]
        self.split = (per_doc > 1)[doc][self.order]  # pieces of documents that were cut
        self.doc = doc[self.order]
        self.chains = [np.arange(a, a + k) for a, k in zip((np.cumsum(per_doc) - per_doc)[per_doc > 1], per_doc[per_doc > 1])]

    def active(self, s: int, upto: int | None = None) -> int:
        """How many of the (sorted) pieces have a token ``s``."""
        return int(np.searchsorted(-self.size[:upto], -s, side="left"))


def transfer(model: Model, sym: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Per piece the matrix of its probability from the state of its first token to that of its last, up to a factor."""
    n, k = len(begin), len(model.start)
    out = np.zeros((n, k, k))
    b = model.ratio[sym[begin]]
    out[:, range(k), range(k)] = b
    for s in range(1, int(size[0]) if n else 0):
        m = int(np.searchsorted(-size, -s, side="left"))
        step = (out[:m].reshape(m * k, k) @ model.trans).reshape(m, k, k)
        step *= model.ratio[sym[begin[:m] + s]][:, None, :]
        if s % 8 == 0:  # ratios lie between FLOOR and 1 / Q: eight of them stay within the range of a double
            step /= step.max((1, 2), keepdims=True)
        out[:m] = step
    return out / out.max((1, 2), keepdims=True) if n else out


def enter_leave(model: Model, sym: np.ndarray, p: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every piece: the state before it as a prediction, the last state of the piece before (zeros
    at a document's start), and the backward probabilities at its end (up to a factor)."""
    k = len(model.start)
    predicted, before, after = np.tile(model.start, (len(p.begin), 1)), np.zeros((len(p.begin), k)), np.ones((len(p.begin), k))
    cut = np.flatnonzero(p.split)
    row = np.full(len(p.begin), -1)
    row[cut] = np.arange(len(cut))
    matrices = transfer(model, sym, p.begin[cut], p.size[cut])
    for chain in p.chains:
        places = p.place[chain]
        v = model.start
        for a, b in zip(places[:-1], places[1:]):
            v = v @ matrices[row[a]]
            v = v / v.sum()
            before[b] = v
            v = v @ model.trans
            predicted[b] = v
        w = np.ones(k)
        for a, b in zip(places[-2::-1], places[:0:-1]):
            w = model.trans @ (matrices[row[b]] @ w)
            w = w / w.max()
            after[a] = w
    return predicted, before, after


def windows(p: Pieces):
    """Ranges of pieces that hold about ``WINDOW`` tokens; pieces don't depend on each other any more."""
    total = np.cumsum(p.size)
    a = 0
    while a < len(total):
        done = total[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(total, done + WINDOW, side="right")))
        yield a, b
        a = b


def forward(model: Model, sym: np.ndarray, begin: np.ndarray, size: np.ndarray, predicted: np.ndarray):
    """Scaled forward recursion: per step the state probabilities and scales of the pieces that have it, and the log10 scale sum per piece."""
    n, pred, logs = len(begin), predicted, np.zeros(len(begin))
    alphas, scales = [], []
    for s in range(int(size[0])):
        m = int(np.searchsorted(-size, -s, side="left"))
        u = pred[:m] * model.ratio[sym[begin[:m] + s]]
        c = u.sum(1)
        u /= c[:, None]
        logs[:m] += np.log10(c)
        alphas.append(u)
        scales.append(c)
        pred = u @ model.trans
    return alphas, scales, logs


def expected(model: Model, sym: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of starts, moves and (symbol, state) of whole documents."""
    k = len(model.start)
    starts, moves, emit = np.zeros(k), np.zeros((k, k)), np.zeros((len(model.ratio), k))
    if not len(lens):
        return starts, moves, emit
    p = Pieces(lens)
    predicted, before, after = enter_leave(model, sym, p)
    for a, b in windows(p):
        begin, size = p.begin[a:b], p.size[a:b]
        alphas, scales, _ = forward(model, sym, begin, size, predicted[a:b])
        where, gammas = [], []
        back = after[a:b].copy()
        for s in range(int(size[0]) - 1, -1, -1):
            alpha = alphas[s]
            m = len(alpha)
            ends = size[:m] == s + 1  # these pieces begin here, from behind; what they hold is known up to a factor
            if ends.any():
                back[:m][ends] /= (alpha[ends] * back[:m][ends]).sum(1, keepdims=True)
            gamma = alpha * back[:m]
            here = sym[begin[:m] + s]
            where.append(here)
            gammas.append(gamma)
            w = model.ratio[here] * back[:m] / scales[s][:, None]
            if s:
                moves += alphas[s - 1][:m].T @ w
                back[:m] = w @ model.trans.T
            else:
                moves += before[a:b].T @ w  # zeros where a document starts
                starts += gamma[p.first[a:b]].sum(0)
        here, gamma = np.concatenate(where), np.concatenate(gammas)
        for j in range(k):
            emit[:, j] += np.bincount(here, weights=gamma[:, j], minlength=len(emit))
    return starts, moves * model.trans, emit


def log10_ratio(model: Model, sym: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """log10 of each document's probability over its unigram product."""
    out = np.zeros(len(lens))
    p = Pieces(lens)
    predicted, _, _ = enter_leave(model, sym, p)
    for a, b in windows(p):
        _, _, logs = forward(model, sym, p.begin[a:b], p.size[a:b], predicted[a:b])
        np.add.at(out, p.doc[a:b], logs)
    return out


def _unpacked(rb: pa.RecordBatch, r: int):
    sym = np.frombuffer(zlib.decompress(rb.column("symbols")[r].as_py()), np.uint16)
    return sym, rb.column("lens")[r].values.to_numpy(), rb.column("held")[r].values.to_numpy(zero_copy_only=False)


def baum_welch(chunked: DataFrame, model: Model, q: np.ndarray) -> Model:
    """One step: expected counts of all training documents, summed per symbol, and the model they give."""
    shared = chunked.sparkSession.sparkContext.broadcast(model.arrays())
    k = len(model.start)
    rows = len(q)

    def run(batches):
        model = Model(*shared.value)
        starts, moves, emit = np.zeros(k), np.zeros((k, k)), np.zeros((rows, k))
        for rb in batches:
            for r in range(rb.num_rows):
                sym, lens, held = _unpacked(rb, r)
                keep = np.repeat(~held, lens)
                for total, part in zip((starts, moves, emit), expected(model, sym[keep], lens[~held])):
                    total += part
        used = np.flatnonzero(emit.any(1))
        at = np.concatenate((used, rows + np.arange(k + 1)))  # behind the symbols: the moves, then the starts
        values = np.concatenate((emit[used], moves, starts[None, :]))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *[pa.array(np.ascontiguousarray(values[:, j])) for j in range(k)]], names=names)

    names = ["at", *[f"s{j}" for j in range(k)]]
    parts = chunked.select("symbols", "lens", "held").mapInArrow(run, "at int, " + ", ".join(f"s{j} double" for j in range(k)))
    sums = parts.groupBy("at").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(k)]).toArrow()  # 2^16 + STATES + 1 rows at most
    total = np.zeros((rows + k + 1, k))
    total[sums["at"].to_numpy()] = np.stack([sums[f"s{j}"].to_numpy() for j in range(k)], 1)
    return Model.fitted(total[-1], total[rows:-1], total[:rows], q)


def fitted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", states: int = STATES, steps: int = STEPS):
    """(chunked symbols, model, N): the corpus as symbols, the trained model, the number of training tokens."""
    parts = stored(chunks(docs, doc_id, text), "hmm-chunks")
    counts = stored(word_counts(parts), "hmm-counts")
    heads = counts.where("head and c > 0")
    n, v = heads.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).collect()[0]
    # at most PROFILES words, since their counts add up to N at most
    often = heads.where((F.col("c") > 1) & (F.col("c") * PROFILES >= n) & (F.octet_length("word") <= MAX_PROFILE_BYTES))
    words = [bytes(r["word"]) for r in often.select("word").orderBy(F.desc("c"), "word").collect()]
    profiled = {w: SHAPES + i for i, w in enumerate(words)}
    chunked = stored(symbols(parts, counts, n, v, profiled), "hmm-symbols")

    # Q: the unigram's mass per symbol; the unknown word belongs to symbol 0
    size = SHAPES + len(words)
    mass = np.zeros(size)
    known = chunked.sparkSession.sparkContext.broadcast(profiled)

    def masses(batches):
        for rb in batches:
            sums = np.zeros(size)
            at = [symbol_of(w, c, known.value) for w, c in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist())]
            np.add.at(sums, np.array(at, np.int64), rb.column(1).to_numpy() + 1.0)
            used = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(sums[used])], names=["at", "m"])

    got = heads.select("word", "c").mapInArrow(masses, "at int, m double").groupBy("at").agg(F.sum("m").alias("m")).toArrow()
    mass[got["at"].to_numpy()] = got["m"].to_numpy()
    mass[0] += 1
    q = mass / (n + v + 1)
    model = Model.first(q, states)
    for _ in range(steps):
        model = baum_welch(chunked, model, q)
    return chunked, model, n


def scores(chunked: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, base_score, score) of every document."""
    shared = chunked.sparkSession.sparkContext.broadcast(model.arrays())
    id_type = chunked.schema["doc_ids"].dataType.elementType
    out = T.StructType([
        T.StructField("doc_id", id_type), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
    ])

    def run(batches):
        model = Model(*shared.value)
        for rb in batches:
            for r in range(rb.num_rows):
                sym, lens, held = _unpacked(rb, r)
                base = rb.column("base")[r].values.to_numpy()
                columns = [rb.column("doc_ids")[r].values, pa.array(held), pa.array(lens.astype(np.int64)), rb.column("n_known")[r].values,
                           pa.array(base), pa.array(base + log10_ratio(model, sym, lens))]
                yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return chunked.mapInArrow(run, out)


def op12_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunked, model, n = fitted(table(spark, sf_dir, "documents"))
    return scores(chunked, model).withColumn("train_tokens", F.lit(n).cast("long"))
