"""A prefix trie of conversations by partition refinement.

All conversations start in one class. Each round reads one more turn and splits every active class by it: the parts are
the children of the class's node. A part of one member is retired at once: what is left of that conversation is a
unary chain, emitted from its turns without further rounds. When no class of two or more is left, numbers of leaves and
bytes saved are folded back, level by level, from the deepest classes to the root.

Turns are compared by the SHA-256 of role and text, made where the texts are read: texts are never shuffled. A class is known
by its smallest member, which is unique at a depth. Rounds are as many as turns that two conversations share from the start.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainledger.llm.common import cut, shared_folder, table
from grainledger.llm.turns import numbered

#: Conversations borrow the first turns, up to this number less one, of one whose id is divisible by FAMILY.
SHARES = 9
FAMILY = 5
NOTHING = hashlib.sha256(b"").hexdigest()
#: Levels folded in one plan; then it is cut.
FOLD = 6


def turn_digest(role: Column, text: Column) -> Column:
    """Equal for equal (role, text) only."""
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, digest, bytes, pos): turns in order, nulls first, ties by digest; null role or text is empty.

    Rows with a null conv_id belong to no conversation and are left out.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), turn_digest(role, text).alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    return numbered(plain, "conv_id", ["turn", "digest"]).select("conv_id", "digest", "bytes", "pos")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns of the rebuilt conversations, conv_id and number of turns of each, also those without any).

    Conversation c has the first h turns of conversation c - c % FAMILY, all if it has fewer, then its own from place h on.
    """
    base, h = F.col("conv_id") - F.col("conv_id") % FAMILY, (F.crc32(F.col("conv_id").cast("string")) % SHARES).cast("int")
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", "n", base.alias("base"), h.alias("h"))
    bases = convs.where(F.col("conv_id") == F.col("base")).select(F.col("base").alias("b"), F.col("n").alias("base_n"))
    known = cut(convs.join(bases, F.col("base") == F.col("b"), "left").select("conv_id", "base", "h", "n", F.least("h", F.coalesce("base_n", F.lit(0))).alias("lent")))
    heads = turns.where((F.col("pos") < SHARES) & (F.col("conv_id") % FAMILY == 0)).withColumnRenamed("conv_id", "base")
    lent = known.join(heads, "base").where("pos < h").select("conv_id", "digest", "bytes", "pos")
    own = turns.where(F.col("pos") >= h).join(known.select("conv_id", "h", "lent"), "conv_id").select("conv_id", "digest", "bytes", (F.col("pos") - F.col("h") + F.col("lent")).alias("pos"))
    return lent.unionByName(own), known.select("conv_id", (F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("turns"))


def _ends_digest(ends: DataFrame) -> DataFrame:
    """(depth, node, ends_sha256) from (depth, node, conv_id): SHA-256 of the ids in order, joined by commas.

    Ids that share all but their last 8 bits are joined first, where they meet, so what comes together by node is a row for up
    to 256 ids; a task then reads these in order and keeps only the state of the digest.
    """
    high = F.shiftright("conv_id", 8)
    runs = ends.groupBy("depth", "node", high.alias("high")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for depth, node, ids in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (depth, node) == key:
                    state.update(b",")
                else:
                    if key:
                        done.append((*key, state.hexdigest()))
                    key, state = (depth, node), hashlib.sha256()
                state.update(ids.encode())
            yield rows(done)
        if key:
            yield rows([(*key, state.hexdigest())])

    def rows(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["depth", "node", "ends_sha256"])

    return runs.repartition("depth", "node").sortWithinPartitions("depth", "node", "high").select("depth", "node", "ids").mapInArrow(run, "depth long, node long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row a node of the trie over ``turns`` (conv_id, pos from 0, digest, bytes) of ``convs`` (conv_id, turns).

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. Without
    conversations there is no node, not even the root. A conversation without turns ends at the root.
    """
    spark = turns.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/trie-{uuid.uuid4().hex}"
    # a round reads only the files of its power of two of places
    turns.withColumn("level", F.floor(F.log2(F.col("pos") + 1)).cast("int")).repartition("level", F.pmod(F.xxhash64("conv_id"), F.lit(64))).sortWithinPartitions("level", "pos").write.partitionBy("level").parquet(folder)
    turns = spark.read.schema("conv_id long, digest binary, bytes long, pos long, level int").parquet(folder)
    root = convs.agg(F.min("conv_id").alias("node"), F.count("*").alias("n")).first()
    if not root["n"]:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")

    active = cut(convs.select("conv_id", F.col("turns").cast("long").alias("turns"), F.lit(root["node"]).cast("long").alias("node")))
    levels = [spark.createDataFrame([(root["node"], None, root["n"], 0, 0)], "node long, parent long, n long, bytes long, turns long")]
    ended = []
    while active is not None:
        depth = len(levels) - 1
        ended.append(active.where(F.col("turns") == depth).select(F.lit(depth).cast("long").alias("depth"), "node", "conv_id"))
        here = turns.where((F.col("level") == (depth + 1).bit_length() - 1) & (F.col("pos") == depth)).select("conv_id", "digest", "bytes")
        split = active.where(F.col("turns") > depth).join(here, "conv_id")
        parts = cut(split.groupBy(F.col("node").alias("parent"), "digest").agg(F.min("conv_id").alias("node"), F.count("*").alias("n"), F.max("bytes").alias("bytes"), F.max("turns").alias("turns")))
        levels.append(parts.select("node", "parent", "n", "bytes", "turns"))
        many = parts.where("n > 1").select(F.col("parent").alias("p"), F.col("digest").alias("d"), F.col("node").alias("into"))
        active = None
        if not many.isEmpty():
            active = cut(split.join(many, (F.col("node") == F.col("p")) & (F.col("digest") == F.col("d"))).select("conv_id", "turns", F.col("into").alias("node")))

    # retired classes: one member, and the rest of its turns is a chain
    alone = None
    for depth, parts in enumerate(levels[1:], 1):
        some = parts.where("n = 1").select(F.col("node").alias("conv_id"), F.lit(depth).cast("long").alias("head"), "parent", "turns")
        alone = some if alone is None else alone.unionByName(some)
    depth = F.col("pos") + 1
    last = depth == F.col("turns")
    chains = turns.join(alone, "conv_id").where(depth >= F.col("head")).select(
        "conv_id", depth.alias("depth"), F.when(depth == F.col("head"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(NOTHING).alias("ends_sha256"),
    )

    folded, below = None, None
    for depth in range(len(levels) - 1, -1, -1):
        kept = levels[depth] if depth == 0 else levels[depth].where("n > 1")
        own = (F.col("n") - 1) * F.col("bytes")
        if below is None:
            here = kept.select("node", "parent", "n", F.lit(0).cast("long").alias("children"), F.lit(1).cast("long").alias("leaves"), own.alias("saved"))
        else:
            sums = below.groupBy(F.col("parent").alias("of")).agg(F.count("*").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
            here = kept.join(sums, F.col("node") == F.col("of"), "left").select("node", "parent", "n", F.coalesce("children", F.lit(0)).alias("children"), F.coalesce("leaves", F.lit(1)).alias("leaves"), (own + F.coalesce("saved", F.lit(0))).alias("saved"))
        here = cut(here) if depth % FOLD == 0 else here
        row = here.withColumn("depth", F.lit(depth).cast("long"))
        folded = row if folded is None else folded.unionByName(row)
        ones = levels[depth].where("n = 1").select("parent", F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
        below = here.select("parent", "leaves", "saved").unionByName(ones)
    every = ended[0]
    for some in ended[1:]:
        every = every.unionByName(some)
    digests = _ends_digest(every).select(F.col("depth").alias("end_depth"), F.col("node").alias("end_node"), "ends_sha256")
    branches = folded.join(digests, (F.col("depth") == F.col("end_depth")) & (F.col("node") == F.col("end_node")), "left").select(
        F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
    )
    return branches.unionByName(chains)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*rebuilt(ordered_turns(table(spark, sf_dir, "conversations"))))
