"""Scores of whole texts by a log-bilinear language model, beside smoothed word frequencies.

The model predicts a word from the two before it, in two levels that are both log-bilinear. First it predicts an entry:
one of the most frequent words, the end of a text, or a class of words by their last letters. Matrices for either place
turn the vectors of the two entries before it, of which the farther one is told apart by its last letter or as one of
fewer words, into a prediction, whose product with an entry's vector, plus its bias, is its score. Then it predicts a word of the class: the product of the word's own vector with the prediction from the entry
right before it, plus a bias. The words with vectors are those of the training texts from the count on with which there
are at most WORDS of them; the rarer ones of a class share a vector and have smoothed frequencies among themselves, so
that the probabilities of all texts add up to one.

Both levels are trained in numpy with noise-contrastive estimation on counts over all training texts. For entries, each
of some parts of the counts of triples, dealt by a hash, goes on from the last parameters with sampled noise, and their means, weighted by
tokens, are the next ones. Given those, the words don't depend on each other, and noise is taken in expectation: a task
fits some words from their counts after each entry. For scoring, batched matrix products give the sums over all entries
for each pair of entries, and over all words of a class after each entry, once; so all probabilities are normalised.

What goes to the driver and to all tasks is bounded: the counts of the HEAD most frequent words, and the parameters. Words
beyond the head meet their counts in a join.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.batches import arrays, slices, text_of
from siltstone.llm.words import blocks
from siltstone.session import discard, materialize

#: Words whose counts are sent to all tasks, 24 bytes each, and those of them that have vectors, at most.
HEAD, WORDS = 1 << 20, 1 << 16
#: Entries the model predicts, with classes of words and the end; length of vectors; passes; noise entries for each batch.
ENTRIES, WIDTH, EPOCHS, NOISE = 768, 24, 8, 192
SMOOTH = 0.1
#: Words that a task fits at a time, steps, noise words for each word, and the precision of the vectors' prior.
CHUNK, STEPS, NOISE_WORDS, PRIOR = 256, 24, 25, 2.0
CHUNKS_A_TASK = 8
#: Parts that triples are dealt to by a hash at most, and triples that are learned from at a time.
BUCKETS, LEARNED = 4, 1 << 19
#: Counts that a task adds up before it sends any: of words, and of contexts, which take 8 bytes each with their keys.
HELD_WORDS, HELD_CONTEXTS = 1 << 19, 1 << 22
#: Examples that are held against noise at a time.
STRIP = 256
#: Counts up to which the histogram that finds how many words have a count is exact.
MOST_COUNTED = 100_000

#: Classes by last byte: letters, digits and signs, and bytes of other characters in four groups. Further ones are the most
#: frequent endings of three bytes.
_CLASS = np.full(256, 26, np.int64)
_CLASS[97:123] = np.arange(26)
_CLASS[65:91] = np.arange(26)
_CLASS[[46, 44]] = 27
_CLASS[128:] = 28 + np.arange(128) % 4
BYTE_CLASSES, CLASSES, END = 32, 256, 256
#: What the word before the last one is told apart by: classes by last byte, the end, and the most frequent words.
FAR = 64
_FOLD = np.arange(256)
_FOLD[65:91] += 32


def is_held_out(doc_id):
    """Whether crc32 of doc_id as text has the remainder 0 by 10; a null doc_id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 10 == 0


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case hashes of all words, their rows and their endings, the last three bytes in one number."""
    hashes, docs, endings = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for b in blocks(texts):
        s, e = b.words()
        hashes.append(b.hashes(b.sums(lower=True), s, e))
        docs.append(b.doc[b.segment(s)])
        ending = np.zeros(len(s), np.int64)
        for k in range(3):
            has = e - s > k
            ending |= np.where(has, _FOLD[b.data[np.maximum(e - 1 - k, 0)]], 0) << (8 * k)
        endings.append(ending)
    return np.concatenate(hashes), np.concatenate(docs), np.concatenate(endings)


def _find(table: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where each key is in a sorted table, or -1."""
    if not len(table):
        return np.full(len(key), -1)
    i = np.minimum(np.searchsorted(table, key), len(table) - 1)
    return np.where(table[i] == key, i, -1)


def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and what goes with them, once each, with the sums of their counts."""
    key, extra, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(key)
    key, extra, n = key[order], extra[order], n[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first], extra[first], np.add.reduceat(n, first) if len(first) else n


def _packed(parts: list[np.ndarray], bits: int) -> np.ndarray:
    """Keys of contexts with counts in so many lower bits, once each, with the sums of their counts."""
    both = np.concatenate(parts)
    both.sort()
    key = both >> bits
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    both &= (1 << bits) - 1
    return (key[first] << bits) | np.add.reduceat(both, first) if len(first) else key


def added_up(found, size, merge, most: int):
    """The parts found, in merged ones; each is given away only when more than half of most are left after merging."""
    held: list = []
    total = 0
    for part in found:
        held.append(part)
        total += size(part)
        if total > most:
            held = [merge(held)]
            total = size(held[0])
            if total > most // 2:
                yield held.pop()
                total = 0
    if held:
        yield merge(held)


def _texts(batches):
    """The column text of Arrow batches, some megabytes at a time."""
    for batch in batches:
        for b in slices(batch, "text"):
            yield b.column(b.schema.get_field_index("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """word, a hash, ending and n over all texts of docs."""

    def run(batches):
        found = ((h, ending, np.ones(len(h), np.int64)) for h, _, ending in map(_words, _texts(batches)))
        for key, ending, n in added_up((_merged([x]) for x in found), lambda x: len(x[0]), _merged, HELD_WORDS):
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ending), pa.array(n)], ["word", "ending", "n"])

    rows = docs.select("text").mapInArrow(run, "word long, ending long, n long")
    return rows.groupBy("word", "ending").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """What all tasks know of the training texts. Words of the head are sorted by hash."""

    head: np.ndarray
    head_count: np.ndarray
    #: Entry of each word of the head, and its place among the words with vectors, or -1.
    head_entry: np.ndarray
    head_word: np.ndarray
    #: Class and count of each word with a vector, those of the rarer words of each class at the end.
    word_class: np.ndarray
    word_count: np.ndarray
    #: Sorted endings with classes of their own.
    endings: np.ndarray
    ending_class: np.ndarray
    #: Tokens and distinct words of each class without vectors.
    rare_tokens: np.ndarray
    rare_words: np.ndarray
    tokens: int
    distinct: int
    texts: int

    @cached_property
    def starts(self) -> tuple[np.uint64, np.ndarray]:
        """Bits to shift a hash by, and where the words of the head with each of the numbers left begin: hashes are spread evenly, so few have the same."""
        bits = max(len(self.head).bit_length(), 1)
        shift = np.uint64(64 - bits)
        return shift, np.append(0, np.cumsum(np.bincount((self.head >> shift).astype(np.int64), minlength=1 << bits)))[:-1].astype(np.int32)

    def places(self, h: np.ndarray) -> np.ndarray:
        """Where each hash is in the head, or -1."""
        if not len(self.head):
            return np.full(len(h), -1)
        shift, starts = self.starts
        last = len(self.head) - 1
        i = np.minimum(starts[(h >> shift).astype(np.int64)], last).astype(np.int64)
        found = self.head[i]
        rest = np.flatnonzero((found < h) & (i < last))
        while len(rest):
            i[rest] += 1
            found[rest] = self.head[i[rest]]
            rest = rest[(found[rest] < h[rest]) & (i[rest] < last)]
        return np.where(found == h, i, -1)

    def classes(self, ending: np.ndarray) -> np.ndarray:
        i = _find(self.endings, ending)
        return np.where(i >= 0, self.ending_class[i] if len(self.endings) else 0, _CLASS[ending & 255])

    def sequence(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """Entry, that before, what the one before that is told apart by, and the row of each token with the ends; of the words hash, place in the head, place
        among words with vectors, where those of frequent words mean nothing, and place among the tokens."""
        h, doc, ending = _words(texts)
        at = np.arange(len(h)) + doc
        size = len(h) + len(texts)
        kind = self.classes(ending)
        i = self.places(h)
        word = np.where(i >= 0, self.head_word[i] if len(self.head) else -1, -1)
        word = np.where(word >= 0, word, len(self.word_class) - CLASSES + kind)
        entry = np.full(size, END, np.int64)
        entry[at] = np.where(i >= 0, self.head_entry[i] if len(self.head) else 0, kind)
        row = np.repeat(np.arange(len(texts)), np.bincount(doc, minlength=len(texts)) + 1)
        coarse = np.full(size, BYTE_CLASSES, np.int64)
        coarse[at] = np.where((entry[at] > END) & (entry[at] < END + FAR - BYTE_CLASSES), entry[at] - END + BYTE_CLASSES, _CLASS[ending & 255])
        before = []
        for k, x, none in ((1, entry, ENTRIES), (2, coarse, FAR)):
            before.append(np.full(size, none, np.int64))
            same = row[k:] == row[:-k] if size > k else np.zeros(0, bool)
            before[-1][k:] = np.where(same, x[:-k], none)[: max(size - k, 0)]
        return entry, *before, row, h, i, word, at


def count_step(n):
    """n up to MOST_COUNTED, further on a number for each sixteenth of a doubling; of a column or an array."""
    if isinstance(n, np.ndarray):
        return np.where(n <= MOST_COUNTED, n, MOST_COUNTED + np.ceil(16 * np.log2(np.maximum(n, 1) / MOST_COUNTED))).astype(np.int64)
    return F.when(n <= MOST_COUNTED, n).otherwise(MOST_COUNTED + F.ceil(16 * F.log2(n / MOST_COUNTED)))


def count_from(counts: DataFrame, most: int) -> int:
    """The least count_step from which on there are at most that many words; counts is a written table.

    The histogram has a row for each step, some 100,000 at most.
    """
    found = counts.groupBy(count_step(F.col("n")).alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect()
    total, least = 0, 1 << 62
    for r in found:
        total += r["words"]
        if total > most:
            break
        least = r["step"]
    return least


def vocabulary(counts: DataFrame, texts: int, head: int = HEAD, words: int = WORDS) -> Vocabulary:
    """counts is a written table. Only words of the head, sums by class and the most frequent endings come to the driver."""
    least = count_from(counts, head)
    top = counts.where(count_step(F.col("n")) >= least).select("word", "ending", "n").toArrow()
    word, ending, n = (top.column(i).to_numpy() for i in range(3))
    word = word.view(np.uint64)
    order = np.lexsort((word, -n))
    word, ending, n = word[order], ending[order], n[order]
    ends = counts.groupBy("ending").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "ending").limit(CLASSES - BYTE_CLASSES).collect()
    endings = np.array([r["ending"] for r in ends], np.int64)
    own = np.argsort(endings)
    endings, ending_class = endings[own], BYTE_CLASSES + own
    spark = counts.sparkSession
    named = F.broadcast(spark.createDataFrame([(int(e), int(k)) for e, k in zip(endings, ending_class, strict=True)], "ending long, class long"))
    by_byte = F.element_at(F.array(*(F.lit(int(x)) for x in _CLASS)), (F.col("ending").bitwiseAND(255) + 1).cast("int"))
    classed = counts.join(named, "ending", "left").select(F.coalesce("class", by_byte).alias("class"), "n")
    by_class = {r["class"]: r for r in classed.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect()}
    tokens, distinct = (np.array([by_class[k][c] if k in by_class else 0 for k in range(CLASSES)], np.float64) for c in ("n", "words"))
    out = Vocabulary(word, n, word, word, word, n, endings, ending_class, tokens, distinct, int(tokens.sum()) + texts, int(distinct.sum()) + (texts > 0), texts)
    kind = out.classes(ending)
    lead = min(len(word), ENTRIES - CLASSES - 1)
    with_vector = int((count_step(n) >= max(2, count_from(counts, words + lead))).sum())
    np.subtract.at(tokens, kind[: max(lead, with_vector)], n[: max(lead, with_vector)])
    np.subtract.at(distinct, kind[: max(lead, with_vector)], 1)
    place = np.full(len(word), -1, np.int64)
    place[lead:with_vector] = np.arange(max(with_vector - lead, 0))
    entry = np.concatenate([END + 1 + np.arange(lead), kind[lead:]]).astype(np.int64)
    out.word_class = np.concatenate([kind[lead:with_vector], np.arange(CLASSES)])
    out.word_count = np.concatenate([n[lead:with_vector], tokens + SMOOTH * (distinct + 1)]).astype(np.float64)
    by_hash = np.argsort(word)
    out.head, out.head_count, out.head_entry, out.head_word = word[by_hash], n[by_hash], entry[by_hash], place[by_hash]
    return out


#: Keys of pairs of an entry and a word come after those of triples of entries.
_PAIRS = (ENTRIES + 1) * (FAR + 1) * ENTRIES


def context_counts(docs: DataFrame, shared) -> DataFrame:
    """Counts over all tokens of docs: of triples, with context, the number FAR + 1 times one before plus two before, and entry;
    and of pairs, with context, the one before, and word, its place among those with vectors."""

    words = len(shared.value.word_class)
    bits = 63 - (_PAIRS + (ENTRIES + 1) * words).bit_length()  # 36 for WORDS, 33 if all words of the head have vectors

    def run(batches):
        v = shared.value

        def packed(texts: pa.Array) -> np.ndarray:
            entry, one, two, _, _, _, word, at = v.sequence(texts)
            rare = entry[at] < CLASSES
            keys = np.concatenate([(one * (FAR + 1) + two) * ENTRIES + entry, _PAIRS + one[at[rare]] * len(v.word_class) + word[rare]])
            return _packed([(keys << bits) | 1], bits)

        for both in added_up(map(packed, _texts(batches)), len, lambda parts: _packed(parts, bits), HELD_CONTEXTS):
            yield pa.RecordBatch.from_arrays([pa.array(both >> bits), pa.array(both & ((1 << bits) - 1))], ["key", "n"])

    rows = docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    pair = F.col("key") >= _PAIRS
    context = F.when(pair, F.floor((F.col("key") - _PAIRS) / words)).otherwise(F.floor(F.col("key") / ENTRIES))
    return rows.select(pair.cast("long").alias("pair"), context.alias("context"), F.when(~pair, F.col("key") % ENTRIES).alias("entry"), F.when(pair, (F.col("key") - _PAIRS) % words).alias("word"), "n")


def split_counts(n: np.ndarray, most: float = 1000.0) -> tuple[np.ndarray, np.ndarray]:
    """Places in n, some more than once, and a weight for each, which has up to most times the mean of n.

    The weights of a place add up to its count over the mean.
    """
    weight = n / n.mean()
    parts = np.maximum(np.ceil(weight / most), 1).astype(np.int64)
    return np.repeat(np.arange(len(n)), parts), np.repeat(weight / parts, parts)


def summed(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """The sums of the rows at each place below size."""
    width = rows.shape[1]
    return np.bincount((at[:, None] * width + np.arange(width)).ravel(), weights=rows.ravel(), minlength=size * width).reshape(size, width)


class LogBilinear:
    """Parameters in one array, so that they can be added up: vectors of both contexts and of words, two matrices, biases."""

    shapes = ((ENTRIES + 1, WIDTH), (FAR + 1, WIDTH), (ENTRIES, WIDTH), (WIDTH, WIDTH), (WIDTH, WIDTH), (ENTRIES,))

    def __init__(self, flat: np.ndarray):
        ends = np.cumsum([int(np.prod(s)) for s in self.shapes])
        self.flat = flat
        self.context, self.far, self.word, self.first, self.second, self.bias = (x.reshape(s) for x, s in zip(np.split(flat, ends[:-1]), self.shapes, strict=True))

    @classmethod
    def start(cls, share: np.ndarray, seed: int = 5) -> LogBilinear:
        """Word frequencies as biases, small vectors: at first all contexts predict alike."""
        flat = np.random.default_rng(seed).normal(0, 0.1, sum(int(np.prod(s)) for s in cls.shapes))
        out = cls(flat)
        out.first[:] += np.eye(WIDTH)
        out.second[:] += np.eye(WIDTH)
        out.bias[:] = np.log(share)
        return out

    def train(self, one: np.ndarray, two: np.ndarray, entry: np.ndarray, n: np.ndarray, share: np.ndarray, seed: int, batch: int = 4096, rate: float = 0.08) -> None:
        """One pass of noise-contrastive estimation with Adagrad; noise is drawn from share, for a batch at a time."""
        rng = np.random.default_rng(seed)
        past = LogBilinear(np.full(len(self.flat), 1e-4))
        row, row_weight = split_counts(n)
        order = rng.permutation(len(row))
        prior = np.log(NOISE * share)
        for a in range(0, len(order), batch):
            k = row[order[a : a + batch]]
            i, j, w, weight = one[k], two[k], entry[k], row_weight[order[a : a + batch]] / len(k)
            noise, times = np.unique(rng.choice(ENTRIES, NOISE, p=share), return_counts=True)
            u, v, right = self.context[i], self.far[j], self.word[w]
            q = u @ self.first + v @ self.second
            up = weight / (1 + np.exp(np.clip(np.einsum("ij,ij->i", q, right) + self.bias[w] - prior[w], -30, 30)))
            dq = up[:, None] * right
            wrong = self.word[noise]
            against, shift, often = -wrong.T, prior[noise] - self.bias[noise], wrong * times[:, None]
            pull, total = np.zeros((len(noise), WIDTH)), np.zeros(len(noise))
            for s in range(0, len(k), STRIP):  # few enough that they stay in the processor's cache
                own = slice(s, s + STRIP)
                down = q[own] @ against
                down += shift
                np.clip(down, -30, 30, out=down)
                np.exp(down, out=down)
                down += 1
                np.divide(weight[own, None], down, out=down)
                dq[own] -= down @ often
                pull += down.T @ q[own]
                total += down.sum(0)
            grad = LogBilinear(np.zeros(len(self.flat)))
            grad.word[:] = summed(w, up[:, None] * q, ENTRIES)
            grad.word[noise] -= pull * times[:, None]
            grad.bias[:] = np.bincount(w, weights=up, minlength=ENTRIES)
            grad.bias[noise] -= total * times
            grad.first[:], grad.second[:] = u.T @ dq, v.T @ dq
            grad.context[:] = summed(i, dq, ENTRIES + 1) @ self.first.T
            grad.far[:] = summed(j, dq, FAR + 1) @ self.second.T
            past.flat += grad.flat**2
            self.flat += rate * grad.flat / np.sqrt(past.flat)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of all entries after one entry, with the biases, and after the one before; logs of the sums by pair."""
        near = (self.context @ self.first @ self.word.T + self.bias).astype(np.float32)
        far = (self.far @ self.second @ self.word.T).astype(np.float32)
        total = np.empty((ENTRIES + 1, FAR + 1))
        for i in range(ENTRIES + 1):
            x = far + near[i]
            top = x.max(axis=1, keepdims=True)
            total[i] = np.log(np.exp(x - top).sum(axis=1)) + top[:, 0]
        return near, far, total


def fit_words(before: np.ndarray, count: np.ndarray, after: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Vectors, with biases at the end, of words, by noise-contrastive estimation with noise in expectation.

    before: the prediction of each entry; count: how often a word (column) follows an entry (row); after: how often its
    class does; share: of the word in its class. A word competes with NOISE_WORDS draws from its class's words, of
    which it is itself the share. Adam's steps on the mean gradient of a word's tokens; PRIOR keeps rare words near 0.
    """
    size, words = before.shape[1], count.shape[1]
    total = np.maximum(count.sum(0), 1)
    base = np.concatenate([before, np.ones((len(before), 1))], axis=1).astype(np.float32)
    count, noise = (count / total).astype(np.float32), (NOISE_WORDS * after * share / total).astype(np.float32)
    shift = np.log(NOISE_WORDS).astype(np.float32)  # the bias counts from log share on
    x = np.zeros((words, size + 1), np.float32)
    mean, square = np.zeros_like(x), np.zeros_like(x)
    decay = (np.append(np.full(size, PRIOR), 0.0) / total[:, None]).astype(np.float32)
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(base @ x.T - shift, -30, 30)))
        grad = (count * (1 - p) - noise * p).T @ base - decay * x
        mean, square = 0.9 * mean + 0.1 * grad, 0.98 * square + 0.02 * grad**2
        x = x + 0.15 * (1 - step / (STEPS + 1)) * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.98**step)) + 1e-4)
    x[:, -1] += np.log(share)
    return x


@dataclass
class Words:
    """The prediction of each entry for the words after it, vectors and biases of words, logs of the sums by entry and class."""

    before: np.ndarray
    vector: np.ndarray
    bias: np.ndarray
    total: np.ndarray

    @classmethod
    def of(cls, before: np.ndarray, fitted: np.ndarray, word_class: np.ndarray) -> Words:
        total = np.zeros((ENTRIES + 1, CLASSES))
        order = np.argsort(word_class, kind="stable")
        cuts = np.searchsorted(word_class[order], np.arange(CLASSES + 1))
        for k in range(CLASSES):
            own = fitted[order[cuts[k] : cuts[k + 1]]]
            score = before @ own[:, :-1].T + own[:, -1]
            top = score.max(axis=1, keepdims=True)
            total[:, k] = np.log(np.exp(score - top).sum(axis=1)) + top[:, 0]
        return cls(before, fitted[:, :-1], fitted[:, -1], total)

    def log(self, one: np.ndarray, word: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Logs of the probabilities of words, of these classes, after entries."""
        return np.einsum("ij,ij->i", self.before[one], self.vector[word]).astype(np.float64) + self.bias[word] - self.total[one, kind]


def trained_words(pairs: DataFrame, triples: DataFrame, model: LogBilinear, vocab: Vocabulary) -> Words:
    """pairs and triples are parts of a written table of context_counts.

    A task holds the counts of CHUNK words after each entry. The driver gets a row for each entry and class, and the
    parameters, WORDS + CLASSES rows at most.
    """
    before = (model.context @ model.first).astype(np.float32)
    after = np.zeros((ENTRIES + 1, CLASSES), np.float32)
    one = F.floor(F.col("context") / (FAR + 1)).alias("one")
    seen = triples.where(F.col("entry") < CLASSES).groupBy(one, "entry").agg(F.sum("n").alias("n")).toArrow()
    after[seen.column(0).to_numpy(), seen.column(1).to_numpy()] = seen.column(2).to_numpy()
    in_class = np.bincount(vocab.word_class, weights=vocab.word_count, minlength=CLASSES)
    share = vocab.word_count / in_class[vocab.word_class]
    shared = pairs.sparkSession.sparkContext.broadcast((before, after, vocab.word_class, share))

    def run(batches):
        held: list = []
        chunk = None

        def out():
            before, after, word_class, share = shared.value
            context, word, n = (np.concatenate(x) for x in zip(*held, strict=True))
            first = chunk * CHUNK
            own = slice(first, min(first + CHUNK, len(word_class)))
            count = np.zeros((len(before), own.stop - first), np.float32)
            count[context, word - first] = n
            fitted = fit_words(before, count, after[:, word_class[own]], share[own].astype(np.float32))
            some = np.flatnonzero(count.any(axis=0))
            return pa.RecordBatch.from_arrays([pa.array(some + first), arrays(fitted[some].reshape(-1), np.full(len(some), fitted.shape[1]), pa.float32())], ["word", "fitted"])

        for b in batches:
            context, word, n = (b.column(i).to_numpy() for i in range(3))
            cuts = np.flatnonzero(np.diff(word // CHUNK)) + 1
            for x, y in zip([0, *cuts], [*cuts, len(word)], strict=True):
                if x == y:
                    continue
                if held and word[x] // CHUNK != chunk:
                    yield out()
                    held = []
                chunk = word[x] // CHUNK
                held.append((context[x:y], word[x:y], n[x:y]))
        if held:
            yield out()

    rows = pairs.select("context", "word", "n", F.floor(F.col("word") / CHUNK).alias("chunk"))
    chunks = -(-len(share) // CHUNK)
    rows = rows.repartition(-(-chunks // CHUNKS_A_TASK), "chunk").sortWithinPartitions("chunk")
    found = rows.select("context", "word", "n").mapInArrow(run, "word long, fitted array<float>").toArrow()
    fitted = np.zeros((len(share), WIDTH + 1), np.float32)
    fitted[:, -1] = np.log(share)
    if found.num_rows:
        values = found.column(1).combine_chunks()
        fitted[found.column(0).to_numpy()] = np.asarray(values.flatten() if isinstance(values, pa.ListArray) else values.chunk(0).flatten()).reshape(-1, WIDTH + 1)
    return Words.of(before, fitted, vocab.word_class)


def fit(triples: DataFrame, share: np.ndarray, epochs: int = EPOCHS) -> LogBilinear:
    """Train on the triples of a written table of context_counts. The driver gets the parameters of each pass, whose number is fixed.

    Triples are dealt by a hash to a part for each LEARNED of them, BUCKETS at most, as parts of few triples take too few
    steps before their means are taken; in a part they are in the order of another one, and learned from LEARNED at a time; so the
    parameters are the same however Spark has cut the table. There are as many triples as contexts and entries at most.
    """
    key = F.xxhash64("context", "entry")
    parts = min(BUCKETS, max(1, triples.count() // LEARNED))
    dealt = triples.select("context", "entry", "n", F.pmod(key, F.lit(parts)).cast("int").alias("bucket"))
    dealt = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", F.xxhash64("entry", "context"), "context", "entry")
    dealt = materialize(dealt, "dealt")
    model = LogBilinear.start(share)
    for epoch in range(epochs):
        start = model.flat

        def run(batches, start=start, epoch=epoch):
            own, weight, bucket = None, 0, None
            held: list[np.ndarray] = []

            def learn(rows: np.ndarray) -> None:
                nonlocal weight
                context, entry, n = rows
                own.train(context // (FAR + 1), context % (FAR + 1), entry, n.astype(np.float64), share, epoch)
                weight += int(n.sum())

            def done() -> pa.RecordBatch:
                if (rows := np.concatenate(held, axis=1)).shape[1]:
                    learn(rows)
                return pa.RecordBatch.from_arrays([pa.array(np.full(len(own.flat), bucket)), pa.array(np.arange(len(own.flat))), pa.array(own.flat), pa.array(np.full(len(own.flat), weight))], ["bucket", "i", "v", "w"])

            for b in batches:
                columns = np.array([b.column(i).to_numpy().astype(np.int64) for i in range(4)])
                cuts = np.flatnonzero(np.diff(columns[3])) + 1
                for x, y in zip([0, *cuts], [*cuts, columns.shape[1]], strict=True):
                    if x == y:
                        continue
                    if bucket != columns[3, x]:
                        if bucket is not None:
                            yield done()
                        own, weight, bucket, held = LogBilinear(start.copy()), 0, int(columns[3, x]), []
                    held.append(columns[:3, x:y])
                    while sum(h.shape[1] for h in held) >= LEARNED:
                        rows = np.concatenate(held, axis=1)
                        learn(rows[:, :LEARNED])
                        held = [rows[:, LEARNED:]]
            if bucket is not None:
                yield done()

        rows = dealt.mapInArrow(run, "bucket long, i long, v double, w long")
        each = F.array_sort(F.collect_list(F.struct("bucket", "v", "w")))  # BUCKETS at most, added up in one order
        total = F.aggregate(each, F.struct(F.lit(0.0).alias("v"), F.lit(0).cast("long").alias("w")), lambda a, x: F.struct((a["v"] + x["v"] * x["w"]).alias("v"), (a["w"] + x["w"]).alias("w")))
        mean = rows.groupBy("i").agg(total.alias("t")).select("i", (F.col("t.v") / F.col("t.w")).alias("v")).toArrow()
        if mean.num_rows:
            flat = np.zeros(len(start))
            flat[mean.column(0).to_numpy()] = mean.column(1).to_numpy()
            model = LogBilinear(flat)
    discard(dealt)
    return model


@dataclass
class Model:
    """counts, a written table of all words of the training texts, and what goes to all tasks."""

    counts: DataFrame
    vocab: Vocabulary
    #: LogBilinear.tables() and the words.
    near: np.ndarray
    far: np.ndarray
    total: np.ndarray
    words: Words


def learn(docs: DataFrame, head: int = HEAD, words: int = WORDS) -> Model:
    """The model of all texts of docs; null is empty, and no text or word is left out, however often a row is repeated."""
    training = docs.select(text_of().alias("text"))
    counts = materialize(word_counts(training), "counts")
    vocab = vocabulary(counts, training.count(), head, words)
    contexts = materialize(context_counts(training, docs.sparkSession.sparkContext.broadcast(vocab)), "contexts")
    triples, pairs = contexts.where("pair = 0"), contexts.where("pair = 1")
    seen = np.zeros(ENTRIES)
    for r in triples.groupBy("entry").agg(F.sum("n").alias("n")).collect():  # a row for each entry
        seen[r["entry"]] = r["n"]
    entries = fit(triples, (seen + SMOOTH) / (seen + SMOOTH).sum())
    model = Model(counts, vocab, *entries.tables(), trained_words(pairs, triples, entries, vocab))
    discard(contexts)
    return model


def score(docs: DataFrame, head: int = HEAD, words: int = WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of docs.

    docs has doc_id and text, other columns are left out; a null text is empty and has one token, its end. Scores are
    decimal logarithms. Texts that aren't held out are learned from, however often a row is repeated. Without any, all
    words are unknown. An empty table gives no rows. Texts are taken whole, some megabytes at a time.
    """
    return scored(docs, learn(docs.where(~is_held_out("doc_id")), head, words))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """The scores of docs by a model."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out("doc_id").alias("held_out"), text_of().alias("text"))
    vocab, counts = model.vocab, model.counts
    shared = docs.sparkSession.sparkContext.broadcast((vocab, (model.near, model.far, model.total, model.words)))
    base_log = float(np.log10(vocab.tokens + SMOOTH * (vocab.distinct + 1)))
    rare_log = np.log10(vocab.rare_tokens + SMOOTH * (vocab.rare_words + 1))

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        v, (near, far, total, level) = shared.value
        rows_n = b.num_rows
        entry, one, two, row, h, i, word, at = v.sequence(b.column(2))
        log = (near[one, entry].astype(np.float64) + far[two, entry] - total[one, two]) / np.log(10)
        doc = row[at]
        c = np.where(i >= 0, v.head_count[i] if len(v.head) else 0, 0)
        frequency = np.where(i >= 0, np.log10(c + SMOOTH), 0.0)
        inner = np.flatnonzero(entry[at] < CLASSES)
        kind = entry[at[inner]]
        log[at[inner]] += level.log(one[at[inner]], word[inner], kind) / np.log(10)
        rare = word[inner] >= len(v.word_class) - CLASSES
        log[at[inner[rare]]] += frequency[inner[rare]] - rare_log[kind[rare]]
        base = np.bincount(doc, weights=frequency - base_log, minlength=rows_n) + (np.log10(v.texts + SMOOTH) - base_log)
        known = np.bincount(doc, weights=i >= 0, minlength=rows_n) + (v.texts > 0)
        tail = np.flatnonzero(i < 0)
        ends = np.bincount(doc[tail], minlength=rows_n)
        columns = [b.column(0), b.column(1), pa.array(np.bincount(row, minlength=rows_n)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(np.bincount(row, weights=log, minlength=rows_n)), arrays(h[tail].view(np.int64), ends)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "tail"])

    def run(batches):
        for batch in batches:
            for b in slices(batch, "text"):
                yield work(b)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, tail array<long>"
    parts = materialize(rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "scored")
    tail = parts.select("row", F.explode("tail").alias("word")).groupBy("row", "word").agg(F.count("*").alias("times"))
    found = tail.join(counts.select("word", "n"), "word", "left")
    log = F.log10(F.coalesce(F.col("n"), F.lit(0)) + F.lit(SMOOTH)) * F.col("times")
    sums = found.groupBy("row").agg(F.sum(log).alias("log"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more"))
    more, known = F.coalesce(F.col("log"), F.lit(0.0)), F.coalesce(F.col("more"), F.lit(0))
    out = parts.drop("tail").join(sums, "row", "left")
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + known).alias("n_known"), F.lit(vocab.tokens).cast("long").alias("train_tokens"), (F.col("base_score") + more).alias("base_score"), (F.col("score") + more).alias("score"))
