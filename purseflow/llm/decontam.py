"""Benchmark decontamination by spaced seeds.

A seed is the hash of six words (of short items, four) at fixed places of a short window; the mask ignores
the window's other words, so a substituted word there does no harm. In any 13 words
of which two are substituted, one of the masks finds six untouched words. The masks
go over every word of every document; a Bloom filter of the benchmark's seeds, of
a size that is bounded by BLOOM_BITS, drops nearly all that can't match, and an
equi-join with the benchmark's seeds finds the hits. Around a hit, the document and
the item are compared word by word: a stretch counts that starts and ends with equal
words, has SIMILARITY of its words equal, and is MIN_WORDS long, or as long as the
item if that is shorter.

Items of 5 to 12 words have masks of four words, which find every overlap that counts
(a test goes through all choices of substituted words). Items under 5 words are no
evidence of contamination, as their words follow each other in clean documents, too;
they are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from purseflow.llm.common import fresh
from purseflow.llm.ngrams import Words, _mix, batches
from purseflow.storage import materialize

#: Fixed masks: places of the words that count. Those after the first LONG_MASKS serve short items only.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7), (0, 1, 4, 7, 8, 9), (0, 1, 2, 3), (0, 1, 3, 4), (0, 1, 2, 4), (0, 2, 3, 4))
LONG_MASKS, SHORT_ITEM, LEAST_WORDS = 3, 13, 5
MIN_WORDS = 13
SIMILARITY = 0.8
BLOOM_BITS = 1 << 27

_ODD = _mix(np.arange(101, 164, dtype=np.uint64)) | np.uint64(1)


def seeds(words: np.ndarray, mask: int) -> np.ndarray:
    """The mask's hash at each place of a sequence of word hashes."""
    places = MASKS[mask]
    n = len(words) - places[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, mask, np.uint64)
    for k, p in enumerate(places):
        total += words[p : p + n] * _ODD[k]
    return _mix(total)


def _word_hashes(texts: list[str | None]):
    """(index, word hashes) of each text, whole."""
    parts: list[np.ndarray] = []
    at = 0
    for index, group in batches(texts):
        words = Words(group)
        for k, i in enumerate(index.tolist()):
            while at < i:
                yield at, np.concatenate(parts)
                parts, at = [], at + 1
            parts.append(words.hash[words.first[k] : words.first[k + 1]])
    if parts:
        yield at, np.concatenate(parts)


def _items(batches_):
    for b in batches_:
        out = {"item_id": [], "words": [], "pos": [], "seed": []}
        ids = b.column("item_id").to_pylist()
        for i, words in _word_hashes(b.column("text").to_pylist()):
            if len(words) < LEAST_WORDS:
                continue
            masks = range(LONG_MASKS, len(MASKS)) if len(words) < SHORT_ITEM else range(LONG_MASKS)
            found = [seeds(words, m) for m in masks]
            out["item_id"].append(ids[i])
            out["words"].append(words.tobytes())
            out["pos"].append(np.concatenate([np.arange(len(s), dtype=np.int32) for s in found]))
            out["seed"].append(np.concatenate(found).view(np.int64))
        kinds = [pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, item, words, pos, seed): each item's word hashes and seeds; ``item`` names its text."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    found = rows.mapInArrow(_items, "item_id long, words binary, pos array<int>, seed array<long>")
    return materialize(found.withColumn("item", F.xxhash64("item_id", "words")), "items").dropDuplicates(["item"])


def _bloom_places(seed: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return seed & mask, (seed >> np.uint64(32)) & mask


def _bloom(bits: int):
    def run(batches_):
        filled = np.zeros(bits, bool)
        for b in batches_:
            seed = b.column("seed").to_numpy(zero_copy_only=False).view(np.uint64)
            for place in _bloom_places(seed, bits):
                filled[place] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(filled, bitorder="little").tobytes()], pa.binary())], names=["bloom"])

    return run


def bloom_filter(seed: DataFrame) -> tuple[bytes, int]:
    """A filter of the seeds: four tasks at most make one each of the same, bounded size."""
    n = max(1, seed.count())
    bits = min(BLOOM_BITS, 1 << max(16, (1024 * n - 1).bit_length()))
    total = np.zeros(bits // 8, np.uint8)
    for row in seed.coalesce(4).mapInArrow(_bloom(bits), "bloom binary").toLocalIterator():
        total |= np.frombuffer(row.bloom, np.uint8)
    return total.tobytes(), bits


def _scan(shared, reach: int, short: bool):
    masks = range(len(MASKS) if short else LONG_MASKS)

    def run(batches_):
        data, bits = shared.value
        bloom = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little").view(bool)
        for b in batches_:
            ids, copies = b.column("doc_id").to_pylist(), b.column("copy").to_pylist()
            out = {"doc_id": [], "copy": [], "at": [], "words": [], "pos": [], "seed": []}
            for i, words in _word_hashes(b.column("text").to_pylist()):
                hits = []
                for m in masks:
                    s = seeds(words, m)
                    first, second = _bloom_places(s, bits)
                    place = np.flatnonzero(bloom[first])
                    place = place[bloom[second[place]]]
                    if len(place):
                        hits.append((place, s[place]))
                if not hits:
                    continue
                place, seed = np.concatenate([p for p, _ in hits]), np.concatenate([s for _, s in hits])
                order = np.argsort(place, kind="stable")
                place, seed = place[order], seed[order]
                ends = np.flatnonzero(np.diff(place) > 2 * reach) + 1
                for k in np.split(np.arange(len(place)), ends):
                    start, end = max(0, place[k[0]] - reach), place[k[-1]] + reach
                    out["doc_id"].append(ids[i])
                    out["copy"].append(copies[i])
                    out["at"].append(int(start))
                    out["words"].append(words[start:end].tobytes())
                    out["pos"].append((place[k] - start).astype(np.int32))
                    out["seed"].append(seed[k].view(np.int64))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))

    return run


def best_overlap(words: np.ndarray, item: np.ndarray, diagonals) -> tuple[int, int, int] | None:
    """(start in words, length, equal words) of the longest stretch that counts; the first one of the longest."""
    best = None
    need = min(MIN_WORDS, len(item))
    for d in sorted(diagonals):
        low, high = max(0, d), min(len(words), d + len(item))
        if high - low < need:
            continue
        same = words[low:high] == item[low - d : high - d]
        place = np.flatnonzero(same)
        total = np.r_[0, np.cumsum(same)]
        for k, s in enumerate(place.tolist()):
            if len(same) - s < need or best and len(same) - s <= best[1]:
                break
            ends = place[k:][::-1] + 1
            length = ends - s
            good = np.flatnonzero((total[ends] - total[s] >= SIMILARITY * length - 1e-9) & (length >= need))
            if len(good) and (best is None or length[good[0]] > best[1]):
                n = int(length[good[0]])
                best = (low + s, n, int(total[s + n] - total[s]))
    return best


def _verify(batches_):
    for b in batches_:
        out = {"doc_id": [], "copy": [], "item_id": [], "start": [], "n_words": [], "n_equal": []}
        cols = [b.column(n).to_pylist() for n in ("doc_id", "copy", "item_id", "at", "words", "item_words", "diagonals")]
        for doc, copy, item, at, words, other, diagonals in zip(*cols):
            found = best_overlap(np.frombuffer(words, np.uint64), np.frombuffer(other, np.uint64), diagonals)
            if found:
                for name, v in zip(out, (doc, copy, item, at + found[0], found[1], found[2])):
                    out[name].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out.values()], names=list(out))


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, copy, item_id, start, n_words, n_equal): the longest overlap of each document
    with each item it holds; ``start`` counts the document's words, ``copy`` is a hash of
    its text (it tells rows of one doc_id apart). Null texts hold nothing, and null ids
    come back as null. Repeated rows give one row. Empty tables give an empty table.
    Other columns are not read."""
    items = benchmark_items(benchmark)
    seed = items.select("item", F.explode(F.arrays_zip("pos", "seed")).alias("z")).select("item", F.col("z.pos").alias("item_pos"), F.col("z.seed").alias("seed"))
    size = items.agg(F.max(F.length("words")).alias("most"), F.min(F.length("words")).alias("least")).first()
    reach, short = (size.most or 8) // 8 + max(m[-1] for m in MASKS), (size.least or 64) // 8 < SHORT_ITEM
    shared = docs.sparkSession.sparkContext.broadcast(bloom_filter(seed.select("seed")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("copy"), F.col("text").cast("string").alias("text"))
    runs = rows.mapInArrow(_scan(shared, reach, short), "doc_id long, copy long, at long, words binary, pos array<int>, seed array<long>")
    runs = materialize(runs.withColumn("run", F.xxhash64("doc_id", "copy", "at")), "runs")
    hits = runs.select("run", F.explode(F.arrays_zip("pos", "seed")).alias("z")).select("run", F.col("z.pos").alias("pos"), F.col("z.seed").alias("seed"))
    pairs = hits.join(seed, "seed").groupBy("run", "item").agg(F.collect_set(F.col("pos") - F.col("item_pos")).alias("diagonals"))
    whole = pairs.join(items.select("item", "item_id", F.col("words").alias("item_words")), "item")
    whole = whole.join(runs.select("run", "doc_id", "copy", "at", "words").dropDuplicates(["run"]), "run")
    found = whole.select("doc_id", "copy", "item_id", "at", "words", "item_words", "diagonals").mapInArrow(_verify, "doc_id long, copy long, item_id long, start long, n_words long, n_equal long")
    best = found.groupBy("doc_id", "copy", "item_id").agg(F.max(F.struct("n_words", "n_equal", (-F.col("start")).alias("back"))).alias("b"))
    return best.select("doc_id", "copy", "item_id", (-F.col("b.back")).alias("start"), "b.n_words", "b.n_equal")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a part of a benchmark item. Null texts and
    null ids stay or go by the same rule, repeated rows alike; empty tables take nothing out.
    All columns come back, of any names."""
    doc, copy = fresh(docs, "__doc", "__copy")
    hit = overlaps(docs.select("doc_id", "text"), benchmark).select(F.col("doc_id").alias(doc), F.col("copy").alias(copy)).distinct()
    return docs.join(hit, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(copy)), "left_anti")
