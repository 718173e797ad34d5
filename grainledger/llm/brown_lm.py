"""Language-model scores of a Brown class-based bigram model.

log P(text) is the sum over its tokens of log P(class | class before) + log P(word | class). The end of a text is a
token and a class of its own, and stands before the first word. Every word of the training texts is assigned to a class
by what the assignment gains the likelihood of the class bigrams:

1. The ``SEEDS`` most frequent words by exchange clustering: rounds in which each word may move to the class that gains
   most, judged on counts that are frozen for the round, until the likelihood hardly rises any more. Words that aren't
   seeds count among their neighbours by their ending.
2. All others, a row for each word, from the classes of their neighbours, to first order of the gain; this goes through
   tasks, sorted by word, and holds the vectors of a few words at a time.
3. With all classes known, texts become class numbers, and these give the counts of class pairs and all scores.

The number of classes grows with the cube root of the vocabulary. Words that the training texts don't have are classed
by ending. What such a class follows and precedes is what words that occur once do, and one of its words has as much
weight as one of those.

Counts are taken over all training texts. What is broadcast has fixed bounds: the ``FREQUENT`` most frequent words with
their classes, and tables of the classes. Rarer words are joined to their occurrences, a row for each document and word.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainledger.llm.common import cut, remainder, stored, table

#: Words of the exchange clustering, words that are broadcast, least number of classes, classes of unknown words.
SEEDS, FREQUENT, CLASSES, TAILS = 8192, 200_000, 32, 24
#: Rounds of exchange at most; parts of the words of which one moves at a time; gain of the likelihood that is worth a round.
ROUNDS, PARTS, WORTH = 9, 3, 1e-3
#: Tasks over the seeds' neighbours: there are at most SEEDS + TAILS + 1 rows, whatever the input's size.
NEAR_PARTS = 12
#: Weight of the class's own frequency among its transitions, and what each word's count is raised by.
PRIOR, RAISED = 20.0, 1.0
#: Distinct words or pairs that a task counts before it hands them on, and neighbours of other words.
HELD_WORDS, HELD_PAIRS, HELD_NEAR = 300_000, 1 << 21, 1 << 23
#: In a text's class numbers: a word that is yet to be looked up.
LATER = 0xFFFF


def classes_for(vocabulary: int) -> int:
    """Classes of so many distinct words."""
    return max(CLASSES, round(vocabulary ** (1 / 3) / 3))


def _words(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case; bytes.split() parts at exactly the six white-space characters."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            yield from zip(*[part.column(i).to_pylist() for i in range(part.num_columns)])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word binary, c long): how often each word occurs in the texts."""

    def give(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for (text,) in _texts(batches):
            held.update(_words(text))
            if len(held) > HELD_WORDS:
                yield give(held)
                held.clear()
        if held:
            yield give(held)

    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _level() -> Column:
    return F.floor(F.log2("c") * 16).cast("int")


def _most_frequent(counts: DataFrame, most: int) -> Column:
    """Which rows (word, c) are among about ``most`` of the most frequent ones, never more.

    Whole levels of frequency are taken while they fit; of the next one as many of its 1024 parts, by a hash of the word.
    """
    total, lowest, edge = 0, 0, None
    for r in sorted(counts.groupBy(_level().alias("level")).count().collect(), reverse=True):
        if total + r["count"] > most:
            edge = r["level"]
            break
        total, lowest = total + r["count"], r["level"]
    whole = (_level() >= lowest) if total else F.lit(False)
    if edge is None:
        return whole
    part, parts = F.pmod(F.xxhash64("word"), F.lit(1024)), 0
    for r in sorted(counts.where(_level() == edge).groupBy(part.alias("part")).count().collect()):
        if total + r["count"] > most:
            break
        total, parts = total + r["count"], r["part"] + 1
    return whole | ((_level() == edge) & (part < parts))


def _tail(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % TAILS


class _Numbers(dict):
    """Numbers of words: of those given, and from there on in the order in which others are met."""

    def __init__(self, known: dict[bytes, int]):
        super().__init__(known)
        self.others: list[bytes] = []
        self.first = len(known)

    def __missing__(self, word: bytes) -> int:
        self[word] = number = self.first + len(self.others)
        self.others.append(word)
        return number


def _grouped(of: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Numbers that have values, ascending, and the values of each as bytes, in their order."""
    order = np.argsort(of, kind="stable")
    of = of[order]
    starts = np.flatnonzero(np.diff(of, prepend=-1))
    ends = (np.append(starts, len(of)) * values.itemsize).astype(np.int32)
    return of[starts], pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(values[order].tobytes())])


def _numbers(packed: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All numbers that an array of bytes holds, and how many each element has."""
    if not len(packed):
        return np.zeros(0, kind), np.zeros(0, np.int64)
    _, ends, data = packed.buffers()
    ends = np.frombuffer(ends, np.int32)[packed.offset : packed.offset + len(packed) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return raw.view(kind), np.diff(ends) // np.dtype(kind).itemsize


def _neighbours(docs: DataFrame, seeds: list[bytes]) -> DataFrame:
    """Two kinds of rows. pair (a, b, n): counts of neighbouring symbols, which are seeds, then endings of other words, then the
    end. (word, near): for other words the symbols before (as they are) and after (raised by their number) each occurrence.
    """
    known = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(seeds)})
    k = len(seeds)
    m = k + TAILS + 1
    # a struct, since the rows of words are many and a null struct takes less room than three null columns
    pair = [pa.field("a", pa.int32()), pa.field("b", pa.int32()), pa.field("n", pa.int64())]
    kinds = [("pair", pa.struct(pair)), ("word", pa.binary()), ("near", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, tails = _Numbers(known.value), np.zeros(0, np.int64)
        lines: list[list[int]] = []
        size, held = 0, (np.zeros(0, np.int64), np.zeros(0, np.int64))
        near: list[tuple[np.ndarray, np.ndarray]] = []

        def row(**columns: pa.Array) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, t)) for c, t in kinds], names=[c for c, _ in kinds])

        def add() -> None:
            nonlocal held, tails, size, lines
            if not lines:
                return
            tails = np.append(tails, np.array([k + _tail(w) for w in number.others[len(tails) :]], np.int64))
            # the end stands before each text and after the last
            flat = np.fromiter(itertools.chain.from_iterable(itertools.chain((-1,), line) for line in lines), np.int64, size)
            flat = np.append(flat, -1)
            symbol = np.where(flat < 0, m - 1, flat)
            other = flat >= k
            symbol[other] = tails[flat[other] - k]
            code, n = np.unique(symbol[:-1] * m + symbol[1:], return_counts=True)
            code, n = np.concatenate([held[0], code]), np.concatenate([held[1], n])
            code, place = np.unique(code, return_inverse=True)
            held = code, np.bincount(place, n).astype(np.int64)
            at = np.flatnonzero(other)
            near.append((np.tile(flat[at] - k, 2), np.concatenate([symbol[at - 1], symbol[at + 1] + m]).astype(np.uint16)))
            lines, size = [], 0

        def give() -> Iterator[pa.RecordBatch]:
            nonlocal held, tails, number
            for at in range(0, len(held[0]), 1 << 17):
                code, n = held[0][at : at + (1 << 17)], held[1][at : at + (1 << 17)]
                yield row(pair=pa.StructArray.from_arrays([pa.array(code // m, pa.int32()), pa.array(code % m, pa.int32()), pa.array(n)], fields=pair))
            if near and number.others:
                met, packed = _grouped(np.concatenate([x for x, _ in near]), np.concatenate([x for _, x in near]))
                words = pa.array(number.others, pa.binary()).take(pa.array(met))
                for at in range(0, len(words), 1 << 16):
                    yield row(word=words[at : at + (1 << 16)], near=packed[at : at + (1 << 16)])
            near.clear()
            held, tails, number = (held[0][:0], held[1][:0]), tails[:0], _Numbers(known.value)

        for (text,) in _texts(batches):
            lines.append(list(map(number.__getitem__, _words(text))))
            size += len(lines[-1]) + 1
            if size > 500_000:
                add()
                if len(held[0]) > HELD_PAIRS or len(number.others) > HELD_WORDS or sum(len(x) for x, _ in near) > HELD_NEAR:
                    yield from give()
        add()
        yield from give()

    return docs.select("text").mapInArrow(run, "pair struct<a: int, b: int, n: long>, word binary, near binary")


def _gain(counts: np.ndarray, left: np.ndarray, right: np.ndarray, own: int, after: np.ndarray, before: np.ndarray, free: int) -> int:
    """The class where a word with these neighbours serves the likelihood best; the word is now in ``own``."""
    x = lambda v: v * np.log(np.maximum(v, 1))
    c, n = counts.astype(float), after.sum()
    c[own] -= after
    c[:, own] -= before
    c = np.maximum(c, 0)
    size_l, size_r = left.astype(float), right.astype(float)
    size_l[own] -= n
    size_r[own] -= n
    f, g = np.flatnonzero(after), np.flatnonzero(before)
    rows, columns = c[:free][:, f], c[g][:, :free]
    score = (x(rows + after[f]) - x(rows)).sum(1) + (x(columns + before[g][:, None]) - x(columns)).sum(0)
    score -= x(size_l[:free] + n) - x(np.maximum(size_l[:free], 0)) + x(size_r[:free] + n) - x(np.maximum(size_r[:free], 0))
    return int(np.argmax(score))


def _likelihood(counts: np.ndarray) -> float:
    """Log likelihood of class pairs, but for a part that the classes don't change."""
    x = lambda v: float((v * np.log(np.maximum(v, 1))).sum())
    return x(counts) - x(counts.sum(0)) - x(counts.sum(1))


def exchange(pairs: DataFrame, k: int, classes: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(class of each symbol, counts of class pairs). Symbols from k on keep classes of their own, after the others."""
    m, free = k + TAILS + 1, min(classes, max(k, 1))
    total = free + TAILS + 1
    of = np.concatenate([np.arange(k) % free, free + np.arange(TAILS + 1)])
    spark = pairs.sparkSession
    # a row for each seed or ending and side, of at most m neighbours each
    sides = pairs.select(F.col("a").alias("w"), F.lit(0).alias("side"), F.col("b").alias("o"), "n").union(pairs.select(F.col("b").alias("w"), F.lit(1).alias("side"), F.col("a").alias("o"), "n"))
    near = sides.groupBy("w", "side").agg(F.collect_list(F.struct("o", "n")).alias("near")).groupBy("w").agg(
        F.max(F.when(F.col("side") == 0, F.col("near"))).alias("after"), F.max(F.when(F.col("side") == 1, F.col("near"))).alias("before")
    )
    near = cut(near.select("w", *[F.col(f"{s}.{f}").alias(f"{s}_{f}") for s in ("after", "before") for f in ("o", "n")]).repartition(NEAR_PARTS))

    def vectors(batch: pa.RecordBatch, of: np.ndarray, side: str) -> Iterator[np.ndarray]:
        o, n = batch.column(f"{side}_o"), batch.column(f"{side}_n")
        for i in range(len(batch)):
            if o[i].is_valid:
                yield np.bincount(of[o[i].values.to_numpy()], n[i].values.to_numpy(), total)
            else:
                yield np.zeros(total)

    def class_pairs(of: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(of)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((total, total), np.int64)
            for batch in batches:
                for w, v in zip(batch.column("w").to_pylist(), vectors(batch, shared.value, "after")):
                    out[shared.value[w]] += v.astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["counts"])

        # a table of total * total numbers from each of NEAR_PARTS tasks
        got = near.select("w", "after_o", "after_n").mapInArrow(run, "counts binary").collect()
        return sum((np.frombuffer(r["counts"], np.int64) for r in got), np.zeros(total * total, np.int64)).reshape(total, total)

    counts, parts = class_pairs(of), PARTS
    best, gains = (_likelihood(counts), of.copy(), counts), []
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast((of, counts))

        def move(batches: Iterator[pa.RecordBatch], turn: int = turn) -> Iterator[pa.RecordBatch]:
            of, counts = shared.value
            left, right = counts.sum(1), counts.sum(0)
            for batch in batches:
                ws, to = batch.column("w").to_pylist(), []
                for w, after, before in zip(ws, vectors(batch, of, "after"), vectors(batch, of, "before")):
                    to.append(_gain(counts, left, right, int(of[w]), after, before, free))
                yield pa.RecordBatch.from_arrays([pa.array(ws, pa.int32()), pa.array(to, pa.int32())], names=["w", "to"])

        # a part of the words moves at a time, so that like words don't swap places
        for r in near.where((F.col("w") < k) & (F.col("w") % parts == turn % parts)).mapInArrow(move, "w int, to int").collect():
            of[r["w"]] = r["to"]
        counts = class_pairs(of)
        if (now := _likelihood(counts)) >= best[0]:
            gains = (gains + [now - best[0]])[-parts:]
            best = (now, of.copy(), counts)
            if len(gains) == parts and sum(gains) < WORTH * abs(now):
                break  # all parts have had their turn and hardly gained
        else:  # too many moved to the same place: back, and on with fewer at a time
            of, counts, parts, gains = best[1].copy(), best[2], parts * 2, []
    return best[1], best[2]


def _assigned(near: DataFrame, of: np.ndarray, counts: np.ndarray) -> DataFrame:
    """(word, c, cls): the class of each word that isn't a seed, by the likelihood of its neighbours' classes."""
    total, free, m = len(counts), len(counts) - TAILS - 1, len(of)
    share = counts + 0.1
    # what one neighbour of a class adds, before the word and after it
    gain = np.log(np.vstack([(share / share.sum(0, keepdims=True))[:, :free], (share / share.sum(1, keepdims=True))[:free].T]))
    shared = near.sparkSession.sparkContext.broadcast((np.concatenate([of, of + total]), gain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, gain = shared.value
        last, vector = None, np.zeros(2 * total)

        def give(words: list[bytes], vectors: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(vectors[:, :total].sum(1).astype(np.int64)), pa.array((vectors @ gain).argmax(1).astype(np.int32))], names=["word", "c", "cls"])

        for batch in batches:
            for low in range(0, len(batch), 2000):
                words, packed = (batch.column(i)[low : low + 2000].to_pylist() for i in (0, 1))
                new = np.array([a != b for a, b in zip(words, [last, *words[:-1]])])
                # rows of one word follow each other; row 0 is the word carried on
                place = np.repeat(np.cumsum(new), [len(x) // 2 for x in packed])
                own = [last] + [w for w, n in zip(words, new) if n]
                vectors = np.bincount(place * 2 * total + to[np.frombuffer(b"".join(packed), np.uint16)], minlength=len(own) * 2 * total).reshape(len(own), -1).astype(float)
                vectors[0] += vector
                if len(own) > 1:
                    first = 0 if last is not None else 1
                    if len(own) - 1 > first:
                        yield give(own[first:-1], vectors[first:-1])
                last, vector = own[-1], vectors[-1]
        if last is not None:
            yield give([last], vector[None, :])

    return near.repartition("word").sortWithinPartitions("word").mapInArrow(run, "word binary, c long, cls int")


def class_model_scores(docs: DataFrame) -> DataFrame:
    """Scores of all documents (columns doc_id, text and held_out), learned from those that aren't held out.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, and ``perplexity``, by token. A null
    or empty text has the end as its only token. Null ids are scored too, and repeated rows each get a row. Words of equal
    count are ordered by a hash, so ties don't depend on how rows are dealt. With nothing to learn from, counts are 0 and
    the model gives what its smoothing gives. Other columns are not read.
    """
    spark, training = docs.sparkSession, docs.where("not held_out")
    counts = cut(word_counts(training))
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    ends = training.count()
    n, v = sums["n"] + ends, sums["v"] + (ends > 0)
    seeds = sorted(((bytes(r["word"]), r["c"]) for r in counts.where(_most_frequent(counts, SEEDS)).collect()), key=lambda x: (-x[1], x[0]))
    k = len(seeds)
    met, forget = stored(_neighbours(training, [w for w, _ in seeds]))
    of, pairs = exchange(cut(met.where("pair is not null").select("pair.*").groupBy("a", "b").agg(F.sum("n").alias("n"))), k, classes_for(v))
    free, total = len(pairs) - TAILS - 1, len(pairs)
    end = total - 1
    others = cut(_assigned(met.where("word is not null").select("word", "near"), of, pairs))
    forget()

    # what is broadcast: seeds and as many others as there is room for
    is_rare = ~_most_frequent(others, FREQUENT - SEEDS)
    frequent = [(w, c, int(of[i])) for i, (w, c) in enumerate(seeds)] + sorted((bytes(r["word"]), r["c"], r["cls"]) for r in others.where(~is_rare).collect())
    cls, c = np.array([x[2] for x in frequent], np.int64), np.array([x[1] for x in frequent], np.int64)
    # of each class its tokens, its words, and its words that occur once, by ending
    size, kinds, once = np.zeros(total, np.int64), np.zeros(total), np.zeros((total, TAILS))
    ending = F.pmod(F.crc32(F.expr("substring(word, -2, 2)")), F.lit(TAILS))
    for r in others.groupBy("cls", ending.alias("t")).agg(F.sum("c").alias("c"), F.count("*").alias("v"), F.count_if(F.col("c") == 1).alias("once")).collect():
        size[r["cls"]] += r["c"]
        kinds[r["cls"]] += r["v"]
        once[r["cls"], r["t"]] += r["once"]
    size += np.bincount(cls[:k], c[:k], total).astype(np.int64)
    kinds += np.bincount(cls[:k], minlength=total)
    for (w, n_), own in zip(seeds, cls):
        once[own, _tail(w)] += n_ == 1
    below = np.log10(np.maximum(size + RAISED * kinds, 1))
    below[free:end] = np.log10(once.sum(0) + 1)

    shared = spark.sparkContext.broadcast((dict(zip([w for w, _, _ in frequent], range(len(frequent)))), np.log10(c + RAISED) - below[cls], np.log10(c + 1), cls))
    of_end = np.log10(ends + 1)
    names = ["row", "word", "places", "doc"]
    fields = [pa.field(*x) for x in (("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("codes", pa.binary()))]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, emits, base, cls = shared.value
        get, row_of = known.get, itertools.count(TaskContext.get().partitionId() << 36)
        rows, own_rows, rare, rare_rows, spots, size = [], [], [], [], [], 0

        def give() -> Iterator[pa.RecordBatch]:
            # a key with a space, which no word has: the row meets no count, and rows spread over tasks
            keys = pa.array([b" %d" % r for r in own_rows], pa.binary())
            whole = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), fields)], fields=fields)
            yield pa.RecordBatch.from_arrays([pa.array(own_rows, pa.int64()), keys, pa.nulls(len(rows), pa.binary()), whole], names=names)
            if rare:
                number = _Numbers({})
                of = np.fromiter(map(number.__getitem__, rare), np.int64, len(rare))
                kinds = len(number.others)
                of, places = _grouped(np.repeat(np.arange(len(spots)), [len(x) for x in spots]) * kinds + of, np.concatenate(spots).astype(np.uint32))
                words = pa.array(number.others, pa.binary()).take(pa.array(of % kinds))
                yield pa.RecordBatch.from_arrays([pa.array(np.array(rare_rows)[of // kinds]), words, places, pa.nulls(len(of), pa.struct(fields))], names=names)

        for doc_id, text, held in _texts(batches):
            own, row = _words(text), next(row_of)
            ids = np.fromiter(map(get, own, itertools.repeat(-1)), np.int64, len(own))
            there = ids >= 0
            at, places = ids[there], np.flatnonzero(~there)
            line = np.full(len(own), LATER, np.uint16)
            line[there] = cls[at]
            own_rows.append(row)
            rows.append((doc_id, held, len(own) + 1, len(at) + (ends > 0), base[at].sum() + of_end, emits[at].sum(), line.tobytes()))
            if len(places):
                rare.extend(map(own.__getitem__, places.tolist()))
                rare_rows.append(row)
                spots.append(places)
            size += len(own) + 100
            if size > 500_000:
                yield from give()
                rows, own_rows, rare, rare_rows, spots, size = [], [], [], [], [], 0
        if rows:
            yield from give()

    seen = docs.select(F.col("doc_id").cast("long"), "text", "held_out").mapInArrow(
        encode, "row long, word binary, places binary, doc struct<doc_id: long, held_out: boolean, n_tokens: long, n_known: long, base: double, score: double, codes: binary>"
    )
    rare = others.where(is_rare).withColumn("emit", F.log10(F.col("c") + RAISED))
    lows = spark.createDataFrame([(i, float(x)) for i, x in enumerate(below)], "cls int, low double")
    rare = rare.join(F.broadcast(lows), "cls").select("word", "c", "cls", (F.col("emit") - F.col("low")).alias("emit"))
    met = seen.join(rare, "word", "left").withColumn("m", F.when(F.col("places").isNotNull(), F.length("places") / 4).otherwise(0).cast("long"))
    met = met.withColumn("cls", F.coalesce("cls", free + ending)).join(F.broadcast(lows.withColumnRenamed("cls", "own")), F.col("own") == F.col("cls"))
    whole = met.groupBy("row").agg(
        F.first("doc", ignorenulls=True).alias("doc"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("m")).otherwise(0)).alias("n_known"),
        F.sum(F.col("m") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("base"),
        F.sum(F.col("m") * F.coalesce("emit", -F.col("low"))).alias("score"),
        F.collect_list(F.when(F.col("places").isNotNull(), F.struct("cls", "places"))).alias("later"),
    )
    sums = [(F.col(f"doc.{x}") + F.col(x)).alias(x) for x in ("n_known", "base", "score")]
    coded = cut(whole.select("doc.doc_id", "doc.held_out", "doc.n_tokens", *sums, "doc.codes", F.col("later.cls").alias("later_cls"), F.col("later.places").alias("later_places")))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """Some rows, their class numbers with the end before each text and after the last, and where each text's begin."""
        for batch in batches:
            for low in range(0, len(batch), 500):
                part = batch.slice(low, 500)
                own, words = _numbers(part.column("codes"), np.uint16)
                starts = np.append(0, np.cumsum(words + 1))
                line = np.full(starts[-1] + 1, end, np.int64)
                line[np.arange(len(own)) + np.repeat(np.arange(1, len(words) + 1), words)] = own
                later = part.column("later_places")
                places, each = _numbers(later.flatten(), np.uint32)
                first = np.repeat(starts[:-1], later.value_lengths().to_numpy()) + 1
                line[np.repeat(first, each) + places] = np.repeat(part.column("later_cls").flatten().to_numpy(), each)
                yield part, line, starts[:-1]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(total * total, np.int64)
        for _, line, _ in parts(batches):
            out += np.bincount(line[:-1] * total + line[1:], minlength=total * total)
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], names=["pair", "n"])

    ids = [F.col(x) for x in ("codes", "later_cls", "later_places")]
    pairs = np.zeros(total * total)
    for r in coded.where("not held_out").select(*ids).mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        pairs[r["pair"]] = r["n"]
    pairs = pairs.reshape(total, total)
    # an unknown word stands where words that occur once do
    part = once / np.maximum(size, 1)[:, None]
    pairs[:, free:end] = pairs @ part
    pairs[free:end] = part.T @ pairs
    share = (pairs.sum(0) + 1) / (pairs.sum() + total)
    step = np.log10((pairs + PRIOR * share) / (pairs.sum(1, keepdims=True) + PRIOR))
    steps = spark.sparkContext.broadcast(step)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, line, starts in parts(batches):
            more = np.add.reduceat(steps.value[line[:-1], line[1:]], starts)
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(5)), pa.array(part.column(5).to_numpy() + more)], names=["doc_id", "held_out", "n_tokens", "n_known", "base", "score"])

    out = coded.select("doc_id", "held_out", "n_tokens", "n_known", "base", "score", *ids).mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double")
    return out.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"),
        "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )


def op1_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_model_scores(table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(remainder("doc_id", 7) == 2, F.lit(False))))
