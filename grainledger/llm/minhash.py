"""Near-duplicate documents by fast similarity sketching, banding and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from grainledger.llm.common import cut, gram_hashes, mix64, table, word_hashes, word_spans
from grainledger.llm.components import components
from grainledger.llm.token_ids import give_back, let_go

BANDS, ROWS = 32, 4
_M32 = np.uint64(0xFFFFFFFF)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str, n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; of the whole sequence if it is shorter."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    starts, ends = word_spans(raw)
    words = word_hashes(raw, starts, ends, lower=True)
    return np.unique(gram_hashes(words, min(n, max(len(words), 1))))


def sketch(hashes: np.ndarray, t: int = BANDS * ROWS) -> np.ndarray:
    """t coordinates; two sets agree in each with the probability of their Jaccard similarity.

    Round i places each element in a bin of its own choice, with a value in [i, i+1); a bin keeps its smallest
    value. Later rounds so only matter to bins that are still empty. From round t on the bin is i - t for all
    elements, so that 2t rounds fill every bin of any set that has elements.
    """
    out = np.zeros(t, np.uint64)
    empty = np.ones(t, bool)
    step = np.uint64(max(1, min(256, 1024 // max(1, len(hashes)))))
    i = np.uint64(0)
    while empty.any():
        rounds = np.arange(i, min(i + step, np.uint64(2 * t)), dtype=np.uint64)
        h = mix64(hashes[None, :] ^ (rounds[:, None] * _GOLD + _GOLD))
        bins = np.where(rounds[:, None] < t, ((h >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32), rounds[:, None] - np.uint64(t) * (rounds[:, None] >= t))
        # of a bin the smallest (round, value) stands first
        key = (bins << np.uint64(40)) | ((rounds[:, None] - i) << np.uint64(32)) | (h & _M32)
        key = np.sort(key, axis=None)
        which = (key >> np.uint64(40)).astype(np.int64)
        first = np.flatnonzero(np.diff(which, prepend=-1))
        new = first[empty[which[first]]]
        out[which[new]] = ((key[new] & np.uint64(0xFFFFFFFFFF)) + (i << np.uint64(32))) + np.uint64(1)
        empty[which[new]] = False
        i += step
    return out


def bands(coordinates: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each run of so many coordinates, different between runs."""
    h = np.arange(1, len(coordinates) // rows + 1, dtype=np.uint64) * _GOLD
    for j in range(rows):
        h = mix64(h ^ coordinates[j::rows])
    return h


#: Coordinates of the finer sketch that candidates get, a byte each.
FINE = 512
#: Candidates whose finer sketches agree in fewer coordinates than this share have a true similarity below the
#: threshold but for a chance of about 1 in 30,000 (four standard deviations).
SLACK = 4.0
#: Members of a bucket that are compared at once with as many others.
BLOCK = 1024
#: Bits of the map of wanted documents, 4 MB; more documents than it can tell apart only cost extra reading.
BITS = 1 << 25

_SKETCHED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("fp0", pa.int64()), ("fp1", pa.int64()), ("bands", pa.list_(pa.int64()))])


def _text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    let_go()
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            yield list(zip(*[part.column(i).to_pylist() for i in range(part.num_columns)]))
    give_back()


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, size of the shingle set, a 128-bit fingerprint of the set, and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[bytes, np.ndarray] = {}
        for rows in _text_rows(batches):
            ids, n, fp, keys = [], [], [], []
            for doc_id, text in rows:
                s = shingles(text or "")
                print_ = np.array([np.sum(mix64(s ^ _GOLD)), np.bitwise_xor.reduce(mix64(s + _GOLD), initial=np.uint64(0))], np.uint64)
                known = last.get(print_.tobytes())
                if known is None:
                    known = bands(sketch(s)).view(np.int64) if len(s) else np.zeros(0, np.int64)
                    if len(last) > 2000:
                        last.clear()
                    last[print_.tobytes()] = known
                ids.append(doc_id)
                n.append(len(s))
                fp.append(print_.view(np.int64))
                keys.append(known)
            fp = np.array(fp).reshape(-1, 2)
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(fp[:, 0]), pa.array(fp[:, 1]), listed], schema=_SKETCHED)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, fp0 long, fp1 long, bands array<long>")


def _slot(column: str):
    return F.pmod(F.xxhash64(column), F.lit(BITS))


def _bitmap(ids: DataFrame, column: str) -> np.ndarray:
    """Bits of the ids' hashes: a fixed 4 MB, however many ids."""
    import pandas as pd

    def bits(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(BITS // 64, np.uint8)
        own[frame["slot"].to_numpy() % (BITS // 64)] = 1
        return pd.DataFrame({"part": [key[0]], "bits": [np.packbits(own).tobytes()]})

    slots = ids.select(_slot(column).alias("slot")).distinct().withColumn("part", F.floor(F.col("slot") / (BITS // 64)).cast("int"))
    out = np.zeros((64, BITS // 512), np.uint8)
    for r in slots.groupBy("part").applyInPandas(bits, "part int, bits binary").collect():
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Shingle sets and finer sketches of the wanted documents (column rep), from their texts read again."""
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted, "rep"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _text_rows(batches):
            ids, sets, fine, keys = [], [], [], []
            for doc_id, text, slot in rows:
                if bits.value[slot >> 3] >> (7 - (slot & 7)) & 1:
                    s = shingles(text or "")
                    if len(s):
                        ids.append(doc_id)
                        sets.append(s.view(np.int64))
                        fine.append((mix64(sketch(s, FINE)) & np.uint64(255)).astype(np.uint8).tobytes())
                        # 32 bits of each band key tell whether two documents share the band
                        keys.append((bands(sketch(s)) & _M32).astype("<u4").tobytes())
            if ids:
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets))), pa.array(fine, pa.binary()), pa.array(keys, pa.binary())], names=["rep", "members", "fine", "bands"])

    read = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", _slot("doc_id").alias("slot"))
    return read.mapInArrow(run, "rep long, members array<long>, fine binary, bands binary").join(wanted, "rep", "left_semi")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    full = sets.select("rep", "members")
    both = pairs.join(full.withColumnsRenamed({"rep": "a", "members": "of_a"}), "a").join(full.withColumnsRenamed({"rep": "b", "members": "of_b"}), "b")
    both = both.withColumn("common", F.size(F.array_intersect("of_a", "of_b")))
    return both.where(100 * F.col("common") >= percent * (F.size("of_a") + F.size("of_b") - F.col("common"))).select("a", "b")


def _close(percent: int):
    """For each two blocks of a bucket, the pairs of different components whose finer sketches agree enough."""
    share = percent / 100
    least = FINE * share - SLACK * (FINE * share * (1 - share)) ** 0.5

    def compare(group: dict) -> list[tuple[int, int]]:
        own = group["block"] == group["left"]
        rows = np.flatnonzero(own)
        columns = rows if group["left"][0] == group["right"][0] else np.flatnonzero(~own)
        fine = np.stack([np.frombuffer(x, np.uint8) for x in group["fine"]])
        keys, out = np.stack([np.frombuffer(x, "<u4") for x in group["bands"]]), []
        sizes = group["n"]
        for i in rows:
            others = columns[(group["component"][columns] != group["component"][i])]
            if columns is rows:
                others = others[others > i]
            others = others[100 * np.minimum(sizes[others], sizes[i]) >= percent * np.maximum(sizes[others], sizes[i])]
            others = others[(fine[others] == fine[i]).sum(1) >= least] if len(others) else others
            for j in others:  # a pair belongs to the first band that it shares
                if int(np.argmax(keys[i] == keys[j])) == group["band"][0]:
                    a, b = int(group["rep"][i]), int(group["rep"][j])
                    out.append((min(a, b), max(a, b)))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            edge = np.stack([batch.column(k).to_numpy() for k in ("key", "left", "right")])
            cuts = np.flatnonzero((np.diff(edge) != 0).any(0)) + 1
            for a, b in zip(np.append(0, cuts), np.append(cuts, len(batch))):
                if b <= a:
                    continue
                name = tuple(edge[:, a])
                if held and name != last:
                    yield from done(held)
                    held = []
                last = name
                held.append(batch.slice(a, b - a))
        if held:
            yield from done(held)

    def done(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(parts)
        group = {c: whole.column(c).to_numpy() for c in ("block", "left", "right", "component", "n", "rep", "band")}
        group["fine"], group["bands"] = whole.column("fine").to_pylist(), whole.column("bands").to_pylist()
        if len(got := compare(group)):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*got)], names=["a", "b"])

    return run


def text_digest(text: str = "text"):
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and own_text of each document.

    Documents with equal sets are one class, by a fingerprint of the set, and only its smallest id goes on. Band
    keys group the classes. In each group the member that meets most others over all its bands is the centre,
    and the others are verified against it on full sets: this links a family of copies in one step. Members that are
    then not in the group's largest component, the strays, are compared with all others of other components by finer
    sketches, in blocks, and pairs that agree enough are verified too. The finer sketches miss a close pair with a chance
    of 1 in 30,000. The members of the largest component aren't compared with one another, so this costs strays times members.

    Null texts and texts without words have an empty set and link with nothing. A null id links with nothing, has a
    null component and is kept. Rows of one id with one set are one document. Rows of one id with different sets are documents of their
    own, which don't link each other: component_id is the smallest id among the rows linked, kept whether it is the row's own, and
    own_text the SHA-256 of the row's text, which together with the id names it; it is null where the id does. An empty table gives
    no rows. Other columns are not read.
    """
    sketches = cut(sketched(docs))
    set_ = F.struct("n", "fp0", "fp1")
    several = cut(sketches.where("doc_id is not null").groupBy("doc_id").agg(F.min(set_).alias("a"), F.max(set_).alias("b")).where("a <> b").select("doc_id"))
    none = F.lit(None).cast("string").alias("own_text")
    if several.isEmpty():
        return _linked(docs, sketches, percent).select("*", none)
    # such rows get numbers below all ids; links are found between these, and the smallest id of a component afterwards
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_digest().alias("own_text"))
    low = min(0, plain.agg(F.min("doc_id")).first()[0]) - 1
    named = cut(plain.join(several, "doc_id").select("doc_id", "own_text").distinct())
    named = cut(named.select("doc_id", "own_text", (F.lit(low) - F.monotonically_increasing_id()).alias("node")))
    renamed = plain.join(named, ["doc_id", "own_text"], "left").select(F.coalesce("node", "doc_id").alias("doc_id"), "text")
    got = cut(_linked(renamed, cut(sketched(renamed)), percent).join(named.select(F.col("node").alias("doc_id"), F.col("doc_id").alias("id"), "own_text"), "doc_id", "left").withColumn("id", F.coalesce("id", "doc_id")))
    least = got.where("component_id is not null").groupBy("component_id").agg(F.min("id").alias("least"))
    met = got.join(least, "component_id", "left")
    return met.select(F.col("id").alias("doc_id"), "n_shingles", F.col("least").alias("component_id"), F.col("id").eqNullSafe(F.col("least")).alias("kept"), "own_text")


def _linked(docs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; rows of one id have one set."""
    some = sketches.where("n > 0 and doc_id is not null")
    classes = cut(some.groupBy("n", "fp0", "fp1").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")))
    keyed = classes.select("rep", "n", F.posexplode("bands").alias("band", "key"))
    several = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = cut(keyed.join(several, "key").select("key", "band", "rep", "n", "size"))
    wanted = cut(members.groupBy("rep").agg(F.sum("size").alias("meets")))
    sets = cut(_sets(docs, wanted))

    met = members.join(wanted, "rep")
    centre = met.groupBy("key").agg(F.max(F.struct("meets", (-F.col("rep")).alias("minus"))).alias("top")).select("key", (-F.col("top.minus")).alias("centre"))
    star = met.join(centre, "key").where("rep != centre").select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")).distinct()
    links = cut(_verified(star, sets, percent))

    first = cut(components(links))
    label = members.join(first.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    # the component that most members of a bucket are in is at home there
    in_key = label.where("size > 2").groupBy("key", "component").agg(F.count("*").alias("n"))
    open_ = in_key.groupBy("key").agg(F.max(F.struct("n", (-F.col("component")).alias("minus"))).alias("top"), F.sum("n").alias("all")).where("top.n < all")
    open_ = open_.select("key", (-F.col("top.minus")).alias("home"), (F.col("all") - F.col("top.n")).alias("strays"))
    rest = label.join(open_, "key").withColumn("stray", F.col("component") != F.col("home"))
    rest = rest.join(sets.select("rep", "fine", "bands"), "rep")
    # a small bucket is one block; else blocks of strays have numbers from 0 up, those of the others from -1 down
    all_ = lambda n: F.sequence(F.lit(0).cast("long"), F.ceil(n / BLOCK) - 1)
    deal = lambda n: F.pmod(F.xxhash64("rep"), F.ceil(n / BLOCK))
    strays, others = F.col("strays"), F.col("size") - F.col("strays")
    small = F.col("size") <= BLOCK
    rest = rest.withColumn("block", F.when(small, F.lit(0)).when(F.col("stray"), deal(strays)).otherwise(-1 - deal(others)))
    pair = lambda left, right: F.struct(left.alias("left"), right.alias("right"))
    own = F.concat(F.transform(all_(strays), lambda o: pair(F.least(o, "block"), F.greatest(o, "block"))), F.transform(all_(others), lambda o: pair(F.col("block"), -1 - o)))
    rest = rest.withColumn("pair", F.explode(F.when(small, F.array(pair(F.col("block"), F.col("block")))).when(F.col("stray"), own).otherwise(F.transform(all_(strays), lambda o: pair(o, F.col("block"))))))
    rest = rest.select("key", "pair.left", "pair.right", "block", "band", "rep", "n", "component", "fine", "bands")
    rest = rest.repartition("key", "left", "right").sortWithinPartitions("key", "left", "right")
    again = rest.mapInArrow(_close(percent), "a long, b long").distinct().join(star, ["a", "b"], "left_anti")
    more = _verified(again, sets, percent)

    # the components that these pairs join, by the smallest id of each
    ends = lambda pairs, x: pairs.join(first.select(F.col("id").alias(x), "component"), x, "left").withColumn(x, F.coalesce("component", x)).drop("component")
    joined = components(ends(ends(more, "a"), "b")).select(F.col("id").alias("component"), F.col("component").alias("to"))
    of_class = classes.join(first.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    of_class = of_class.join(joined, "component", "left").select("n", "fp0", "fp1", F.coalesce("to", "component").alias("component"))
    out = sketches.join(of_class, ["n", "fp0", "fp1"], "left")
    linked = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), linked.alias("component_id"), F.col("doc_id").eqNullSafe(linked).alias("kept"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("own_text")
