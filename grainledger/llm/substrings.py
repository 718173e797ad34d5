"""Removal of passages that repeat across documents, by sharded Aho-Corasick automata.

A window is 13 consecutive words of one document. A window recurs if its words also start in a document with a
smaller id. Documents are dealt into shards of about 2 MB by a hash of the id, and this one shuffle of the texts
serves all steps.

1. Of the nine 5-word phrases in a window the one with the smallest hash is its anchor, so equal windows have
   equal anchors. Each shard sends the distinct anchors of its windows, and gets back, a bit each, which of them
   occur in two documents or more.
2. Windows with such an anchor may recur. For each distinct one a shard sends a 96-bit hash and its smallest document;
   the shard that holds the smallest of all is told which shards have the window in a later document.
3. That shard sends them the passages: the words of such windows, those that overlap as one run.
4. A shard compiles an automaton of the anchor phrases of the passages it got, and streams all its documents through
   it. Around each occurrence, and nowhere else, windows are compared word by word with those of the passages; where
   one of a smaller document has the same words, they are removed.

So hashes only propose. Different windows under one 64-bit hash are told apart; of windows that share all 96 bits a
document that has another text could be named as the smallest, and the passage then not be found.

What a shard sends holds an anchor, window or passage once, however often its documents have it, so a passage that very
many documents share is no heavier than another.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainledger.llm.common import gram_hashes, parts_for, table, word_hashes, word_spans
from grainledger.llm.token_ids import give_back, let_go

WINDOW, PHRASE = 13, 5
SHARD_BYTES, BUCKET_BYTES = 2 << 20, 24 << 20
_LAST = np.iinfo(np.int64).max


class _Shard:
    """The words of a shard's documents in a row, and what follows from them."""

    def __init__(self, documents: pa.Table, window: int, phrase: int):
        self.window, self.phrase = window, phrase
        ids = documents.column("doc_id").to_pylist()
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in documents.column("text").to_pylist()]
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
        self.rows = order
        self.ids = [ids[i] for i in order]
        raw = np.frombuffer(b" ".join(texts[i] for i in order), np.uint8)
        self.raw = raw
        self.starts, self.ends = word_spans(raw)
        self.words = word_hashes(raw, self.starts, self.ends)
        bounds = np.cumsum([len(texts[i]) + 1 for i in order])
        self.of = np.searchsorted(bounds, self.starts, side="right")
        self.first = np.searchsorted(self.of, np.arange(len(order) + 1))
        self.key = np.array([_LAST if i is None else i for i in self.ids], np.int64)
        self.phrases = gram_hashes(self.words, phrase)
        n = len(self.words) - window + 1
        if n <= 0:
            self.at, self.anchor = np.zeros(0, np.int64), np.zeros(0, np.uint64)
            return
        span, low, width = window - phrase + 1, self.phrases, 1
        while width < span:  # running minimum over the phrases of a window
            step = min(width, span - width)
            low = np.minimum(low[: len(low) - step], low[step:])
            width += step
        self.at = np.flatnonzero(self.of[:n] == self.of[window - 1 :])
        self.anchor = low[self.at]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors in order, and which occur in more than one document here."""
        return _several(self.anchor, self.key[self.of[self.at]])

    def hashes(self, chosen: np.ndarray) -> np.ndarray:
        """The 96-bit hashes of chosen windows, as (64 bits, 32 bits)."""
        out = np.zeros(len(chosen), [("h", "<u8"), ("g", "<u4")])
        out["h"] = gram_hashes(self.words, self.window, 1)[self.at[chosen]]
        out["g"] = (gram_hashes(self.words, self.window, 2)[self.at[chosen]] >> np.uint64(32)).astype(np.uint32)
        return out


def _several(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    k, d = keys[order], docs[order]
    start = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    if not len(k):
        return k, np.zeros(0, bool)
    return k[start], np.minimum.reduceat(d, start) != np.maximum.reduceat(d, start)


def _table(**columns: tuple[list, pa.DataType]) -> pa.Table:
    return pa.table({k: pa.array(v, t) for k, (v, t) in columns.items()})


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _cuts(h: np.ndarray, buckets: int) -> np.ndarray:
    """Hashes in order: where each bucket begins and the last ends."""
    return np.searchsorted(_bucket(h, buckets), np.arange(buckets + 1))


def _ask_anchors(buckets: int, window: int, phrase: int):
    def run(documents: pa.Table) -> pa.Table:
        let_go()
        anchors, several = _Shard(documents, window, phrase).anchors()
        cuts = _cuts(anchors, buckets)
        some = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
        return _table(
            bucket=(some, pa.int32()),
            shard=([documents.column("shard")[0].as_py()] * len(some), pa.int32()),
            keys=([anchors[cuts[b] : cuts[b + 1]].tobytes() for b in some], pa.binary()),
            several=([np.packbits(several[cuts[b] : cuts[b + 1]]).tobytes() for b in some], pa.binary()),
        )

    return run


def _tell_anchors(asked: pa.Table) -> pa.Table:
    """For each shard's keys, in order, which of them are in two documents or more."""
    keys = [np.frombuffer(x, "<u8") for x in asked.column("keys").to_pylist()]
    several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)) for x, k in zip(asked.column("several").to_pylist(), keys)])
    whole = np.concatenate(keys)
    order = np.argsort(whole, kind="stable")
    k = whole[order]
    same = np.concatenate(([False], k[1:] == k[:-1], [False]))
    told = np.zeros(len(whole), bool)
    told[order] = same[1:] | same[:-1]
    told |= several.astype(bool)
    ends = np.cumsum([len(x) for x in keys])
    bits = [np.packbits(told[b - len(x) : b]).tobytes() for x, b in zip(keys, ends)]
    return _table(shard=(asked.column("shard").to_pylist(), pa.int32()), bucket=(asked.column("bucket").to_pylist(), pa.int32()), bits=(bits, pa.binary()))


def _told(answers: pa.Table, keys: np.ndarray, buckets: int) -> np.ndarray:
    """The answers' bits, one for each of the keys in order."""
    out, cuts = np.zeros(len(keys), bool), _cuts(keys, buckets)
    for b, bits in zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist()):
        out[cuts[b] : cuts[b + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=cuts[b + 1] - cuts[b])
    return out


def _classes(shard: _Shard, answers: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct windows whose anchors recur: (hashes in order, smallest document, its first word there, whether a later
    document of this shard has the window too)."""
    anchors, _ = shard.anchors()
    recurs = _told(answers, anchors, buckets)
    which = np.flatnonzero(recurs[np.searchsorted(anchors, shard.anchor)]) if len(anchors) else np.zeros(0, np.int64)
    h, at = shard.hashes(which), shard.at[which]
    doc = shard.key[shard.of[at]]
    order = np.lexsort((at, doc, h["g"], h["h"]))
    h, at, doc = h[order], at[order], doc[order]
    start = np.flatnonzero(np.concatenate((np.ones(min(1, len(h)), bool), (h["h"][1:] != h["h"][:-1]) | (h["g"][1:] != h["g"][:-1]))))
    last = np.append(start[1:], len(h))[: len(start)] - 1
    return h[start], doc[start], at[start], doc[last] > doc[start]


def _ask_windows(buckets: int, window: int, phrase: int):
    def run(documents: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(documents):
            return _table(bucket=([], pa.int32()), shard=([], pa.int32()), keys=([], pa.binary()), more=([], pa.binary()), docs=([], pa.binary()))
        distinct, first, _, _ = _classes(_Shard(documents, window, phrase), answers, buckets)
        cuts = _cuts(distinct["h"], buckets)
        some = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
        part = lambda x: [np.ascontiguousarray(x[cuts[b] : cuts[b + 1]]).tobytes() for b in some]
        return _table(bucket=(some, pa.int32()), shard=([documents.column("shard")[0].as_py()] * len(some), pa.int32()), keys=(part(distinct["h"]), pa.binary()), more=(part(distinct["g"]), pa.binary()), docs=(part(first), pa.binary()))

    return run


def _tell_windows(asked: pa.Table) -> pa.Table:
    """For each shard with the smallest document of a window: which window, by its place in what it sent, and which
    shards have it in a later document."""
    column = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in asked.column(name).to_pylist()])
    h, g, d = column("keys", "<u8"), column("more", "<u4"), column("docs", "<i8")
    each = np.array([len(x) // 8 for x in asked.column("keys").to_pylist()])
    of = np.repeat(asked.column("shard").to_numpy(), each)
    place = np.arange(len(h)) - np.repeat(np.cumsum(each) - each, each)
    order = np.lexsort((of, d, g, h))
    h, g, d, of, place = (x[order] for x in (h, g, d, of, place))
    start = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (g[1:] != g[:-1]))))
    owner = np.repeat(start, np.diff(np.append(start, len(h))))
    later = d > d[owner]
    by, which, to = of[owner[later]], place[owner[later]], of[later]
    order = np.lexsort((which, to, by))
    by, which, to = by[order], which[order], to[order]
    cuts = np.flatnonzero(np.concatenate((np.ones(min(1, len(by)), bool), by[1:] != by[:-1])))
    ends = np.append(cuts[1:], len(by))[: len(cuts)]
    part = lambda x: [x[a:b].astype("<i4").tobytes() for a, b in zip(cuts, ends)]
    return _table(shard=(by[cuts].tolist(), pa.int32()), bucket=([asked.column("bucket")[0].as_py()] * len(cuts), pa.int32()), bits=(part(which), pa.binary()), to=(part(to), pa.binary()))


def _give_passages(buckets: int, window: int, phrase: int):
    def run(documents: pa.Table, told: pa.Table) -> pa.Table:
        out: dict[str, list] = {"shard": [], "docs": [], "texts": []}
        if len(documents):
            shard, own = _Shard(documents, window, phrase), told.column("to").is_null()
            distinct, first, at, later = _classes(shard, told.filter(own), buckets)
            cuts, wanted = _cuts(distinct["h"], buckets), told.filter(pc.invert(own))
            which, to = [np.flatnonzero(later)], [np.full(int(later.sum()), documents.column("shard")[0].as_py())]
            for b, places, shards in zip(*(wanted.column(c).to_pylist() for c in ("bucket", "bits", "to"))):
                which.append(np.frombuffer(places, "<i4") + cuts[b])
                to.append(np.frombuffer(shards, "<i4"))
            which, to = np.concatenate(which), np.concatenate(to)
            order = np.lexsort((at[which], to))
            start, to, doc = at[which[order]], to[order], first[which[order]]
            # windows of one document that overlap or meet are one passage
            new = (to[1:] != to[:-1]) | (shard.of[start[1:]] != shard.of[start[:-1]]) | (start[1:] > start[:-1] + window)
            low = np.flatnonzero(np.concatenate((np.ones(min(1, len(start)), bool), new)))
            high = np.append(low[1:], len(start))[: len(low)] - 1
            raw = shard.raw.tobytes()
            for a, b in zip(low.tolist(), high.tolist()):
                if not out["shard"] or out["shard"][-1] != to[a]:
                    out["shard"].append(int(to[a]))
                    out["docs"].append([])
                    out["texts"].append([])
                out["docs"][-1].append(int(doc[a]))
                out["texts"][-1].append(raw[shard.starts[start[a]] : shard.ends[start[b] + window - 1]].decode("utf-8", "surrogatepass"))
        return _table(shard=(out["shard"], pa.int32()), docs=(out["docs"], pa.list_(pa.int64())), texts=(out["texts"], pa.list_(pa.string())))

    return run


def _located(shard: _Shard, passages: _Shard) -> np.ndarray:
    """For each word whether an anchor phrase of the passages begins there, by streaming all documents through their
    automaton."""
    import ahocorasick

    begins = np.zeros(len(shard.words), bool)
    raw, k = passages.raw.tobytes(), shard.phrase
    automaton = ahocorasick.Automaton()
    for i in np.flatnonzero(np.isin(passages.phrases, passages.anchor)).tolist():
        if passages.of[i] == passages.of[i + k - 1]:
            automaton.add_word(f" {_said(raw, passages, i, i + k)} ", 0)
    if not len(automaton):
        return begins
    automaton.make_automaton()
    raw = shard.raw.tobytes()
    for a, b in zip(shard.first[:-1].tolist(), shard.first[1:].tolist()):
        if b - a < shard.window:
            continue
        text = f" {_said(raw, shard, a, b)} "
        ends = np.array([end for end, _ in automaton.iter(text)], np.int64)
        if len(ends):
            # the space after each word, among characters
            after = np.cumsum(np.array([len(w) + 1 for w in text[1:-1].split(" ")]))
            begins[a + np.searchsorted(after, ends) - k + 1] = True
    return begins


def _said(raw: bytes, shard: _Shard, a: int, b: int) -> str:
    """The words from a to b, joined by one space."""
    return b" ".join(raw[int(shard.starts[a]) : int(shard.ends[b - 1])].split()).decode("utf-8", "surrogatepass")


def _gone(shard: _Shard, passages: _Shard) -> np.ndarray:
    """For each word whether a window covers it whose words a passage of a smaller document has."""
    window, cover = shard.window, np.zeros(len(shard.words) + 1, np.int64)
    if not len(passages.at) or not len(shard.at):
        return cover[:-1] > 0
    count = np.concatenate(([0], np.cumsum(_located(shard, passages))))
    # windows in which one of the phrases located lies
    near = shard.at[count[shard.at + window - shard.phrase + 1] > count[shard.at]]
    number: dict[bytes, int] = {}
    theirs, own = (np.fromiter(map(number.setdefault, s.raw.tobytes().split(), itertools.count(low)), np.int64, len(s.words)) for s, low in ((passages, 0), (shard, len(passages.words))))
    h, key = gram_hashes(passages.words, window)[passages.at], passages.key[passages.of[passages.at]]
    order = np.lexsort((key, h))
    h, key, at = h[order], key[order], passages.at[order]
    want, doc, step = gram_hashes(shard.words, window)[near], shard.key[shard.of[near]], np.arange(window)
    place, open_ = np.searchsorted(h, want), np.arange(len(near))
    while len(open_):  # once more only for windows whose hash another window has
        open_ = open_[place[open_] < len(h)]
        i = place[open_]
        there = (h[i] == want[open_]) & (key[i] < doc[open_])
        open_, i = open_[there], i[there]
        same = (theirs[at[i][:, None] + step] == own[near[open_][:, None] + step]).all(1)
        np.add.at(cover, near[open_[same]], 1)
        np.add.at(cover, near[open_[same]] + window, -1)
        open_ = open_[~same]
        place[open_] += 1
    return np.cumsum(cover[:-1]) > 0


def _remove(window: int, phrase: int, keep: list[str], texts: bool):
    def run(documents: pa.Table, given: pa.Table) -> pa.Table:
        shard = _Shard(documents, window, phrase)
        flat = lambda c, kind: pa.array([x for row in given.column(c).to_pylist() for x in row], kind)
        gone = _gone(shard, _Shard(pa.table({"doc_id": flat("docs", pa.int64()), "text": flat("texts", pa.string())}), window, phrase))
        raw = shard.raw.tobytes()
        whole = documents.column("text").take(pa.array(shard.rows, pa.int64())).to_pylist() if texts else []
        n_words, n_removed, digest, kept = [], [], [], []
        for a, b in zip(shard.first[:-1].tolist(), shard.first[1:].tolist()):
            left = np.flatnonzero(~gone[a:b]) + a
            text = b" ".join([raw[i:j] for i, j in zip(shard.starts[left].tolist(), shard.ends[left].tolist())])
            n_words.append(b - a)
            n_removed.append(b - a - len(left))
            digest.append(hashlib.sha256(text).hexdigest())
            kept.append(None if not texts else text.decode("utf-8", "surrogatepass") if b - a > len(left) else whole[len(kept)])
        out = {"doc_id": pa.array(shard.ids, pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
        if texts:
            out["kept"] = pa.array(kept, pa.string())
        rest = documents.take(pa.array(shard.rows, pa.int64()))
        return pa.table(out | {c: rest.column(f"own_{c}") for c in keep})

    return run


def _then_give_back(task: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The task of a shard, after which the worker keeps nothing that the shard took."""

    def run(documents: pa.Table, told: pa.Table) -> pa.Table:
        try:
            return task(documents, told)
        finally:
            give_back()

    return run


def remove_repeats(docs: DataFrame, keep: list[str] | None = None, texts: bool = False, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each document; with ``texts`` also ``kept``, the text as
    given where nothing is removed, else the words left joined by one space; then the columns named by ``keep``.

    A null or empty text has no words. A null id is larger than any other, and null ids are equal to one another.
    Rows that repeat an id are documents with that id: neither repeats the other. An empty table gives no rows.
    Passages are judged on the input, and texts are read whole; a text of any length is one document of one shard.
    """
    keep = keep or []
    size, _ = parts_for(docs, "text", 1)
    shards, buckets = max(1, -(-size // SHARD_BYTES)), max(1, -(-size // BUCKET_BYTES))
    shard = F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text"))), F.lit(shards)).cast("int")
    dealt = docs.select(shard.alias("shard"), F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.col(c).alias(f"own_{c}") for c in keep])

    ask = dealt.groupBy("shard").applyInArrow(_ask_anchors(buckets, window, phrase), "bucket int, shard int, keys binary, several binary")
    anchors = ask.groupBy("bucket").applyInArrow(_tell_anchors, "shard int, bucket int, bits binary")
    ask = dealt.groupBy("shard").cogroup(anchors.groupBy("shard")).applyInArrow(_then_give_back(_ask_windows(buckets, window, phrase)), "bucket int, shard int, keys binary, more binary, docs binary")
    windows = ask.groupBy("bucket").applyInArrow(_tell_windows, "shard int, bucket int, bits binary, to binary")

    # both kinds of answers side by side
    answers = anchors.select("*", F.lit(None).cast("binary").alias("to")).union(windows)
    passages = dealt.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(_then_give_back(_give_passages(buckets, window, phrase)), "shard int, docs array<long>, texts array<string>")

    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * texts + keep
    kinds = {"doc_id": "long", "n_words": "long", "n_removed": "long", "kept_sha256": "string", "kept": "string"} | {c: docs.schema[c].dataType.simpleString() for c in keep}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names)
    remove = _then_give_back(_remove(window, phrase, keep, texts))
    return dealt.groupBy("shard").cogroup(passages.groupBy("shard")).applyInArrow(lambda documents, given: remove(documents, given).select(names), schema)


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
