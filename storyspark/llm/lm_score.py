"""Masked pseudo-likelihood of documents under a bidirectional window network.

The network sees ``WINDOW`` words on either side of a position and predicts
the word there: embeddings of the neighbours, one tanh layer, and a three-level
softmax: class of the word, output within the class, word within the output. A
document's score is the sum over all its positions of log p(word | both sides)
(Salazar et al., "Masked Language Model Scoring", 2020).

Vocabulary: exact word counts of the whole corpus (a combining count). The network
has C x C outputs, C the fourth root of the number of distinct words (``CLASSES`` at
least). The most frequent words have outputs of their own; one output in 16 is a bucket
of rarer words by CRC-32. Within a bucket a word has its share of the bucket's count,
looked up by a join with the table of counts, so every word of the corpus has a
probability of its own. Training covers the whole corpus once, in ``ROUNDS`` parts dealt by text
hash. In a round each partition starts from the shared parameters, makes
every position a target (the window never holds its own centre word) and
descends in numpy; the parameters are then averaged, weighted by positions.
What is gathered grows with the corpus: word counts and one parameter
set per partition, summed per parameter by a combining aggregate, so that
neither the driver nor a task holds more than one model (40,000 numbers for a million
words, growing with the root of their number).

Scoring is a scan that emits each document's network score and its rare words; these
meet their counts in a join and are summed per document. The shares of the more frequent of
them, ``KNOWN`` at most whatever the corpus, go to the workers with the vocabulary, so only the others
are moved. Long documents are scored in blocks of positions.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .worker import held

CLASSES = 32                     # of CLASSES outputs each, at least
VOCAB = CLASSES * CLASSES
HASHED = 64                      # of VOCAB outputs, buckets of rarer words
WINDOW = 2
DIM, HIDDEN = 8, 24
ROUNDS = 2
MASKED = 0.2                     # share of positions train_part predicts unless told otherwise
BATCH = 512                      # positions per descent step
RATE = 0.1                       # Adagrad step
BLOCK = 1 << 14                  # positions scored at a time
CHUNK_WORDS = 1 << 18            # words dealt with at a time, but whole documents
SPLIT = 1 << 24                  # characters split into words at a time, but whole documents
KNOWN = 1 << 18                  # rare words whose shares a worker is given, at most
FEW = 8                          # positions up to which the classes of a step are multiplied together
OFFSETS = [d for d in range(-WINDOW, WINDOW + 1) if d]
FIXED = 2.0 ** 32                # shares are summed as whole numbers, so order does not matter
EMITTED = 1 << 16                # rows per Arrow batch of rare words


def classes_for(distinct: int) -> int:
    """Classes of a network for so many distinct words."""
    return max(CLASSES, math.ceil(distinct ** 0.25))


def buckets_of(classes: int) -> int:
    return classes * classes * HASHED // VOCAB


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def split_words(texts: list[str | None]) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Blocks of whole documents: (words per document, all their words), the words of ``words_of``."""
    at = 0
    while at < len(texts):
        block, chars = [], 0
        while at < len(texts) and chars < SPLIT:
            block.append((texts[at] or "").lower().strip())      # an edge of white space would give an empty word
            chars, at = chars + len(block[-1]), at + 1
        lists = pc.utf8_split_whitespace(pa.array([text for text in block if text], pa.string()))
        lengths = np.zeros(len(block), np.int64)
        lengths[[i for i, text in enumerate(block) if text]] = pc.list_value_length(lists).to_numpy()
        yield lengths, lists.flatten()


class Vocabulary:
    """word -> output id; a rare word goes to a bucket. Ids end at ``size``. Rare words whose
    bucket and share are ``given`` (word, bucket, share) have places of their own beyond ``size``."""

    def __init__(self, frequent: list[str], classes: int = CLASSES, given: pa.Table | None = None):
        self.size, self.buckets = classes * classes, buckets_of(classes)      # size is the pad
        self.words, places = pa.array(frequent, pa.string()), np.arange(len(frequent))
        self.outputs, self.shares = np.arange(self.size + 1), np.zeros(self.size + 1, np.int64)
        if given is not None:
            self.words = pa.concat_arrays([self.words, *given.column("word").cast(pa.string()).chunks])
            places = np.concatenate([places, self.size + 1 + np.arange(len(given))])
            self.outputs = np.concatenate([self.outputs, self.size - self.buckets + given.column("bucket").to_numpy()])
            self.shares = np.concatenate([self.shares, given.column("share").to_numpy()])
        self._places = np.append(places, 0).astype(np.int32)                  # the last one for words not found

    def places(self, words: pa.Array) -> np.ndarray:
        """Of many words at a time, as the words to look up are hashed anew by each call."""
        at = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy()
        found, other = self._places.take(at), np.flatnonzero(at < 0)
        if len(other):
            rare = words.take(pa.array(other)).dictionary_encode()
            codes = [zlib.crc32(w.encode()) for w in rare.dictionary.to_numpy(zero_copy_only=False)]
            found[other] = (self.size - self.buckets + np.array(codes) % self.buckets).take(rare.indices.to_numpy())
        return found

    def __getitem__(self, word: str) -> int:
        return int(self.places(pa.array([word], pa.string()))[0])


def shapes(classes: int) -> list[tuple[str, tuple[int, ...]]]:
    """The last row of a matrix of weights is the bias."""
    return [("embed", (classes * classes + 1, DIM)), ("w", (2 * WINDOW * DIM + 1, HIDDEN)), ("cw", (HIDDEN + 1, classes)),
            ("ww", (classes, HIDDEN + 1, classes))]


def size_of(classes: int) -> int:
    return sum(math.prod(s) for _, s in shapes(classes))


SIZE = size_of(CLASSES)


def classes_of(size: int) -> int:
    """The inverse of size_of."""
    a, b = DIM + HIDDEN + 1, HIDDEN + 1
    return round((math.sqrt(b * b + 4 * a * (size - size_of(0))) - b) / (2 * a))


def unpacked(flat: np.ndarray) -> dict[str, np.ndarray]:
    """Views of one flat parameter vector."""
    out, at = {}, 0
    for name, shape in shapes(classes_of(len(flat))):
        out[name] = flat[at:at + math.prod(shape)].reshape(shape)
        at += math.prod(shape)
    return out


def initial(counts: np.ndarray, seed: int = 5) -> np.ndarray:
    """Small random weights; output biases say the words' frequencies."""
    rng = np.random.default_rng(seed)
    classes = math.isqrt(len(counts))
    flat = np.zeros(size_of(classes), np.float32)
    p = unpacked(flat)
    p["embed"][:] = rng.normal(0, 0.3, p["embed"].shape)
    p["w"][:-1] = rng.normal(0, 1 / math.sqrt(2 * WINDOW * DIM), (2 * WINDOW * DIM, HIDDEN))
    share = (counts + 0.5).reshape(classes, classes)
    p["cw"][-1] = np.log(share.sum(1) / share.sum())
    p["ww"][:, -1] = np.log(share / share.sum(1, keepdims=True))
    return flat


def _exp(z: np.ndarray) -> np.ndarray:
    """The sum of each row's exponentials, which overwrite z."""
    np.exp(z, out=z)
    return z @ np.ones(z.shape[1], z.dtype)


def _shifted(z: np.ndarray) -> np.ndarray:
    """z with each row less its greatest, if a sum of exponentials might overflow or vanish else."""
    if z.size and not -80 < z.min() <= z.max() < 80:
        z -= z.max(axis=1, keepdims=True)
    return z


def _softmax(z: np.ndarray, scale: float) -> np.ndarray:
    """Of each row, times ``scale``; z is overwritten."""
    z *= (scale / _exp(_shifted(z)))[:, None]
    return z


def _log_softmax_at(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each row's log-softmax at one place of z, counted through; z is overwritten."""
    picked = _shifted(z).reshape(-1).take(at)
    return picked - np.log(_exp(z))


def _by_class(cls: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that sorts positions by class, each class's size and its start in it."""
    sizes = np.bincount(cls, minlength=classes)
    return np.argsort(cls.astype(np.uint16), kind="stable"), sizes, np.cumsum(sizes) - sizes


def _layers(p: dict[str, np.ndarray], context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Input and hidden layer, with a column of ones for the biases."""
    x = np.ones((len(context), 2 * WINDOW * DIM + 1), p["w"].dtype)
    x[:, :-1] = p["embed"].take(context, axis=0).reshape(len(context), -1)
    hidden = np.ones((len(context), HIDDEN + 1), x.dtype)
    t = x @ p["w"]                               # its tanh is 1 - 2 / (1 + exp(2t)), for float32 the quicker way
    np.minimum(t, 30, out=t)
    t += t
    np.exp(t, out=t)
    t += 1
    np.divide(-2, t, out=t)
    np.add(t, 1, out=hidden[:, :-1])
    return x, hidden


def log_probs(p: dict[str, np.ndarray], context: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log p(target | context) of each row; context holds 2 x WINDOW ids."""
    classes = len(p["ww"])
    order, sizes, starts = _by_class(target // classes, classes)
    target = target.take(order)
    cls, rows = target // classes, classes * np.arange(len(target))
    _, hidden = _layers(p, context.take(order, axis=0))
    z = hidden @ p["cw"]
    logs = _log_softmax_at(z, rows + cls)
    for c in np.flatnonzero(sizes).tolist():
        part = slice(starts[c], starts[c] + sizes[c])
        np.matmul(hidden[part], p["ww"][c], out=z[part])
    logs += _log_softmax_at(z, rows + (target - cls * classes))
    out = np.empty_like(logs)
    out[order] = logs
    return out


def gradient(p: dict[str, np.ndarray], context: np.ndarray, target: np.ndarray,
             into: tuple[np.ndarray, dict[str, np.ndarray]] | None = None) -> np.ndarray:
    """Of the mean negative log-probability, as one flat vector; ``into`` is
    such a vector and its views, to be overwritten."""
    n, classes = len(target), len(p["ww"])
    if into is None:
        flat = np.empty(size_of(classes), p["w"].dtype)
        into = flat, unpacked(flat)
    flat, g = into
    # Rows by class: first the classes of many, one product each; then those of few, each filled up
    # to FEW rows (of zeros, which add nothing) and multiplied in one call
    cls = target // classes
    sizes = np.bincount(cls, minlength=classes)
    many, few = np.flatnonzero(sizes > FEW), np.flatnonzero((sizes > 0) & (sizes <= FEW))
    rank = np.empty(classes, np.uint16)
    rank[many], rank[few] = np.arange(len(many)), np.arange(len(many), len(many) + len(few))
    order = rank.take(cls).argsort(kind="stable")
    context, cls, target = context.take(order, axis=0), cls.take(order), target.take(order)
    rows = classes * np.arange(n)
    x, hidden = _layers(p, context)
    scale = 1 / n
    dz = _softmax(hidden @ p["cw"], scale)
    dz.reshape(-1)[rows + cls] -= scale
    np.matmul(hidden.T, dz, out=g["cw"])
    dh = dz @ p["cw"].T
    ends = sizes[many].cumsum()
    full = int(ends[-1]) if len(many) else 0
    parts = [(c, slice(e - k, e)) for c, e, k in zip(many.tolist(), ends.tolist(), sizes[many].tolist())]
    for c, part in parts:
        np.matmul(hidden[part], p["ww"][c], out=dz[part])
    if len(few):
        k, w, shape = sizes[few], p["ww"].take(few, axis=0), (len(few), FEW, -1)
        place = np.arange(n - full) + (FEW * np.arange(len(few)) - (k.cumsum() - k)).repeat(k)
        h = np.zeros((len(few) * FEW, HIDDEN + 1), x.dtype)
        h[place] = hidden[full:]
        dz[full:] = np.matmul(h.reshape(shape), w).reshape(-1, classes).take(place, axis=0)
    _softmax(dz, scale)
    dz.reshape(-1)[rows + (target - cls * classes)] -= scale
    for c, part in parts:
        np.matmul(hidden[part].T, dz[part], out=g["ww"][c])
        dh[part] += dz[part] @ p["ww"][c].T
    if len(few):
        d = np.zeros((len(few) * FEW, classes), x.dtype)
        d[place] = dz[full:]
        d = d.reshape(shape)
        g["ww"][few] = np.matmul(h.reshape(shape).transpose(0, 2, 1), d)
        dh[full:] += np.matmul(d, w.transpose(0, 2, 1)).reshape(-1, HIDDEN + 1).take(place, axis=0)
    g["ww"][sizes == 0] = 0
    hidden *= hidden
    dh *= np.subtract(1, hidden, out=hidden)     # nothing is left of the ones
    dh = dh[:, :-1]
    np.matmul(x.T, dh, out=g["w"])
    g["embed"][:] = 0
    places = np.arange(g["embed"].size).reshape(-1, DIM).take(context.reshape(-1), axis=0)
    np.add.at(g["embed"].reshape(-1), places.reshape(-1), (dh @ p["w"][:-1].T).reshape(-1))
    return flat


def _flat_ids(texts: list[str | None], vocab: Vocabulary) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
    """Chunks of whole documents: (words per document, the words, their places in the vocabulary
    with WINDOW pads around each document, the positions that hold a word)."""
    for lengths, words in split_words(texts):
        known, ends, padded, at = vocab.places(words), np.cumsum(lengths), np.cumsum(lengths + 2 * WINDOW), 0
        while at < len(lengths):
            first, before = (ends[at - 1], padded[at - 1]) if at else (0, 0)
            to = min(int(np.searchsorted(padded, before + CHUNK_WORDS)) + 1, len(lengths))
            some, here = lengths[at:to], known[first:ends[to - 1]]
            places = np.arange(len(here)) + (WINDOW * np.arange(1, 2 * len(some), 2)).repeat(some)
            flat = np.full(len(here) + 2 * WINDOW * len(some), vocab.size, np.int32)
            flat[places] = here
            yield some, words.slice(first, len(here)), flat, places
            at = to


def train_part(texts: Iterator[list], vocab: Vocabulary, start: np.ndarray, rng: np.random.Generator,
               masked: float = MASKED) -> tuple[np.ndarray, int]:
    """Adagrad over a share of the texts' positions, in random order:
    (parameters, positions). ``train`` takes them all."""
    flat = start.astype(np.float32).copy()
    p, square, seen = unpacked(flat), np.full(len(flat), 1e-3, np.float32), 0
    offsets, g, step = np.array(OFFSETS), np.empty_like(flat), np.empty_like(flat)
    into = g, unpacked(g)
    for batch in texts:
        for _, _, known, places in _flat_ids(batch, vocab):
            ids = vocab.outputs.take(known)
            places = rng.permutation(places if masked >= 1 else places[rng.random(len(places)) < masked])
            for at in range(0, len(places), BATCH):
                some = places[at:at + BATCH]
                gradient(p, ids.take(some[:, None] + offsets), ids.take(some), into)
                np.multiply(g, g, out=step)
                square += step
                np.sqrt(square, out=step)
                np.divide(g, step, out=step)
                step *= RATE * len(some) / BATCH
                flat -= step
            seen += len(places)
    return flat, seen


def score_chunks(texts: list[str | None], vocab: Vocabulary,
                 p: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, Counter]]:
    """Of the texts, some at a time: their words, sums of conditional log-probabilities of
    the outputs, sums of the shares the vocabulary knows, and how often (text of these, word) of the other rare words occurs."""
    offsets = np.array(OFFSETS)
    for lengths, words, known, places in _flat_ids(texts, vocab):
        ids, logs, known = vocab.outputs.take(known), np.empty(len(places)), known.take(places)
        for at in range(0, len(places), BLOCK):
            some = places[at:at + BLOCK]
            logs[at:at + BLOCK] = log_probs(p, ids.take(some[:, None] + offsets), ids.take(some))
        sums, shares = np.concatenate([[0.0], np.cumsum(logs)]), np.concatenate([[0], np.cumsum(vocab.shares.take(known))])
        ends = np.cumsum(lengths)
        starts = ends - lengths
        other = np.flatnonzero((known >= vocab.size - vocab.buckets) & (known < vocab.size))
        text, rare = np.searchsorted(ends, other, side="right"), words.take(pa.array(other)).to_numpy(zero_copy_only=False)
        yield (lengths, sums[ends] - sums[starts], shares[ends] - shares[starts],
               Counter(zip(text.tolist(), rare.tolist())))


def score_texts(texts: list[str | None], vocab: Vocabulary, p: dict[str, np.ndarray]) -> list[tuple[int, float]]:
    """(words, sum of conditional log-probabilities of the outputs) of each text."""
    return [pair for lengths, sums, _, _ in score_chunks(texts, vocab, p) for pair in zip(lengths.tolist(), sums.tolist())]


def count_words(docs: DataFrame) -> DataFrame:
    """``(word, n)`` of all texts: counts per block of texts, then summed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, words in split_words(batch.column(0).to_pylist()):
                found = pa.RecordBatch.from_arrays(words.value_counts().flatten(), ["word", "n"])
                for at in range(0, len(found), EMITTED):
                    yield found.slice(at, EMITTED)

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def word_counts(docs: DataFrame) -> tuple[list[str], np.ndarray, DataFrame]:
    """The most frequent words of all texts; the counts of all outputs, theirs
    and the buckets'; and the table ``(word, bucket, share, known)`` of all other words, the log
    of a word's share of its bucket as a multiple of 1 / FIXED and whether it is one of the ``KNOWN`` most
    frequent. A histogram of the counts finds how frequent a word must be, so the driver is sent
    little more than the words it keeps."""
    counts = cut_lineage(count_words(docs).withColumn("size", F.floor(F.log2("n") * 8).cast("int")))
    sizes = counts.groupBy("size").agg(F.count("*").alias("words")).collect()
    classes = classes_for(sum(r.words for r in sizes))
    buckets = buckets_of(classes)
    kept = classes * classes - buckets
    sizes = sorted(sizes, key=lambda r: -r.size)
    wanted, least = kept, None
    for r in sizes:
        wanted -= r.words
        least = r.size
        if wanted <= 0:
            break
    room, known = kept + KNOWN, None
    for r in sizes:
        room -= r.words
        if room < 0:
            break
        known = r.size
    top = [(r.word, r.n) for r in counts.where(F.col("size") >= F.lit(least)).orderBy(F.desc("n"), "word").limit(kept).collect()]
    word, n = top[-1] if top else ("", 0)
    others = (counts.where((F.col("n") < n) | ((F.col("n") == n) & (F.col("word") > F.lit(word))))
              .withColumn("bucket", (F.crc32(F.col("word").cast("binary")) % buckets).cast("int")))
    totals = others.groupBy("bucket").agg(F.sum("n").alias("total"))
    outputs = np.zeros(classes * classes)
    outputs[:len(top)] = [n for _, n in top]
    for r in totals.collect():
        outputs[kept + r.bucket] = r.total
    shares = others.join(F.broadcast(totals), "bucket").select(
        "word", "bucket", F.round(F.log(F.col("n") / F.col("total")) * FIXED).cast("long").alias("share"),
        (F.lit(False) if known is None else F.col("size") >= F.lit(known)).alias("known"))
    return [w for w, _ in top], outputs, shares


def train(docs: DataFrame) -> tuple[Broadcast, np.ndarray, DataFrame]:
    """(vocabulary for the workers, flat parameters, table of the shares of the rare words not in it)
    learnt from all texts."""
    frequent, counts, shares = word_counts(docs)
    flat, words = initial(counts), sent_words(frequent, shares)
    for r in range(ROUNDS):
        flat, _ = train_round(docs, r, frequent, flat, words)
    return words, flat, shares.where("not known")


def sent_words(frequent: list[str], shares: DataFrame) -> Broadcast:
    """The frequent words and those of known share, under a name."""
    given = shares.where("known").select("word", "bucket", "share").toArrow()
    return shares.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, frequent, given))


def _vocabulary(words: Broadcast, classes: int) -> Vocabulary:
    """The worker's own, kept from task to task."""
    name, frequent, given = words.value
    return held(("lm_score", name), lambda: Vocabulary(frequent, classes, given))


def train_round(docs: DataFrame, r: int, frequent: list[str], flat: np.ndarray, words: Broadcast | None = None) -> tuple[np.ndarray, int]:
    """Round ``r`` over its part of the texts: (parameters, positions descended on)."""
    classes, sc = classes_of(len(flat)), docs.sparkSession.sparkContext
    words = words or sc.broadcast((uuid.uuid4().hex, frequent, None))
    shared = sc.broadcast(flat)

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([r, TaskContext.get().partitionId()])
        found, n = train_part((b.column(0).to_pylist() for b in batches), _vocabulary(words, classes), shared.value, rng, masked=1.0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(found), dtype=np.int32)), pa.array(found.astype(float)),
                                              pa.array(np.full(len(found), float(n)))], ["i", "x", "n"])

    part = docs.select("text").where("text is not null").where(F.pmod(F.xxhash64("text"), F.lit(ROUNDS)) == r)
    mean = (part.mapInArrow(descend, "i int, x double, n double")
            .groupBy("i").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("x"), F.sum("n").alias("n")).collect())
    if not mean:
        return flat, 0
    out = np.zeros(len(flat), np.float32)
    for row in mean:
        out[row.i] = row.x
    return out, int(mean[0].n)


def score(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, log_prob, mean_log_prob)``, one row per input row,
    under a network trained on the same documents.

    A null or empty text has no words, log_prob 0 and a null mean. Equal texts
    score alike: a product of floats depends on its rows' places in a block, so all
    copies of a text (by its MD5) get the smallest of their sums. Other columns are ignored; an
    empty table gives no rows (and trains nothing). The parameters depend on how the rows
    are dealt to partitions: each partition descends in its own order before the
    averages, so scores of two differently split runs differ slightly."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    words, flat, shares = train(docs)
    classes, shared = classes_of(len(flat)), docs.sparkSession.sparkContext.broadcast(flat)
    schema = pa.schema([("row", pa.int64()), ("word", pa.string()), ("times", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64()),
                        ("network", pa.float64()), ("known", pa.int64()), ("key1", pa.int64()), ("key2", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, p, row = _vocabulary(words, classes), unpacked(shared.value), TaskContext.get().partitionId() << 40
        for batch in batches:
            at, keys = 0, np.frombuffer(b"".join(batch.column("text_key").to_pylist()), np.int64).reshape(-1, 2)
            for lengths, sums, known, others in score_chunks(batch.column("text").to_pylist(), vocab, p):
                n, here = len(lengths), slice(at, at + len(lengths))
                # the document's own row goes through the join under a key that is no word
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + n)), pa.array([f" {i}" for i in range(row, row + n)]), pa.array(np.zeros(n, np.int32)),
                     batch.column("doc_id").slice(at, n), pa.array(lengths, pa.int64()), pa.array(sums), pa.array(known),
                     pa.array(keys[here, 0]), pa.array(keys[here, 1])], schema=schema)
                pairs, times = list(others), list(others.values())
                for k in range(0, len(pairs), EMITTED):
                    some = pairs[k:k + EMITTED]
                    mine = [pa.array([row + i for i, _ in some], pa.int64()), pa.array([w for _, w in some], pa.string()),
                            pa.array(times[k:k + EMITTED], pa.int32())]
                    yield pa.RecordBatch.from_arrays(mine + [pa.nulls(len(some), f.type) for f in list(schema)[3:]], schema=schema)
                at, row = at + n, row + n

    keyed = docs.withColumn("text_key", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    rows = keyed.mapInArrow(run, "row long, word string, times int, doc_id long, n_words long, network double, known long, key1 long, key2 long")
    # of these columns a document has one value, and none of them is text: they are summed up by hash
    own = ["doc_id", "n_words", "network", "known", "key1", "key2"]
    sums = cut_lineage(rows.join(shares.select("word", "share"), "word", "left").groupBy("row").agg(
        *[F.max(c).alias(c) for c in own], F.coalesce(F.sum(F.col("times") * F.col("share")), F.lit(0)).alias("rare")))
    alike = sums.groupBy("key1", "key2").agg(F.min("network").alias("of_all"))
    return (sums.join(alike, ["key1", "key2"]).withColumn("log_prob", F.col("of_all") + (F.col("known") + F.col("rare")) / FIXED)
            .select("doc_id", "n_words", "log_prob", F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words")).alias("mean_log_prob")))
