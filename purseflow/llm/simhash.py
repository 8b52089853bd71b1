"""SimHash near-duplicates, found by covering the fingerprint space with anchors.

A fingerprint has two halves of 32 bits. Two fingerprints within 3 bits differ in
at most one bit in one of the halves. The anchors of a half are the words of the
perfect Hamming code of length 31 (covering radius 1), with the last bit free.
Each fingerprint is at home at its nearest anchor, and is replicated to every
anchor within 1 + 1 = 2 bits: if x is at home at an anchor and y is within one bit
of x, y is one of those replicas. So comparing the homes of an anchor with all
that stands at this anchor finds every link. A fingerprint gets 17 anchors a half
at most, whatever the data, and there are 2^27 anchors in a half.

Equal fingerprints are collapsed beforehand, so copies meet no copy. An anchor with
many homes is split into chunks of homes. A chunk is compared by blocks, and gives
a spanning forest of its links, never all its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from purseflow.llm.common import fresh
from purseflow.operators.components import connected_components
from purseflow.storage import materialize

SEED = 42
SHINGLE = 3
MAX_BITS = 3
HOMES_PER_CHUNK = 512
_STEP = 1 << 16


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text's word shingles (ASCII lower case, repeats counted)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    votes = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _STEP):
        part = words[at : at + _STEP + SHINGLE - 1]
        shingles = map(b" ".join, zip(part, part[1:], part[2:])) if len(words) >= SHINGLE else [b" ".join(words)]
        h = np.fromiter((digest(s, SEED) for s in shingles), np.uint64)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n, bitorder="little").tobytes(), "little")


def _fingerprints(batches):
    for b in batches:
        fp = np.fromiter((fingerprint(t) for t in b.column("text").to_pylist()), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("copy"), pa.array(fp.view(np.int64))], names=["doc_id", "copy", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, copy, fp): one row for each row of ``docs``, ``copy`` a hash of its text; null texts count as empty, fingerprint 0."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("copy"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, copy long, fp long")


_POSITION = np.arange(1, 32, dtype=np.uint64)


def _syndrome(half: np.ndarray) -> np.ndarray:
    """XOR of the positions 1..31 of the set bits; bit 31 is free."""
    s = np.zeros(len(half), np.uint64)
    for p in _POSITION:
        s ^= ((half >> (p - np.uint64(1))) & np.uint64(1)) * p
    return s


def _bit(position: np.ndarray) -> np.ndarray:
    return np.where(position > 0, np.uint64(1) << (np.maximum(position, 1) - 1).astype(np.uint64), np.uint64(0)).astype(np.uint64)


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, row number and whether it is the home, for all replicas of the fingerprints."""
    out = []
    rows = np.arange(len(fp))
    for which in (0, 1):
        half = (fp >> np.uint64(32 * which)) & np.uint64(0xFFFFFFFF)
        s = _syndrome(half)
        mark = np.uint64(which << 40)
        home = half ^ _bit(s)
        out.append((home | mark, rows, True))
        out.append(((home ^ np.uint64(1 << 31)) | mark, rows, False))
        off = np.flatnonzero(s)
        for p in _POSITION:
            q = s[off] ^ p
            ok = (q > p) & (q != 0) & (p != s[off])  # each pair of positions once
            at = off[ok]
            out.append((half[at] ^ _bit(np.full(len(at), p)) ^ _bit(q[ok]) | mark, at, False))
    key = np.concatenate([k for k, _, _ in out])
    return key.astype(np.uint64), np.concatenate([r for _, r, _ in out]), np.concatenate([np.full(len(k), h) for k, _, h in out])


def _replicas(batches):
    for b in batches:
        whole = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(whole), 4096):
            fp = whole[at : at + 4096]
            key, row, home = anchors(fp)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp[row].view(np.int64)), pa.array(home)], names=["anchor", "fp", "home"])


class _Forest:
    """Union-find over the members of one group."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[x] = y
        return x != y


def _large_group(homes: np.ndarray, others: np.ndarray, bits: int):
    """Links that connect what the homes' links connect: no more than members."""
    forest = _Forest(len(homes))
    for i in range(len(homes)):
        for j in np.flatnonzero(np.bitwise_count(homes[i + 1 :] ^ homes[i]) <= bits):
            if forest.join(i, i + 1 + int(j)):
                yield homes[i], homes[i + 1 + int(j)]
    step = max(1, (1 << 20) // len(homes))
    for at in range(0, len(others), step):
        part = others[at : at + step]
        near = np.bitwise_count(part[:, None] ^ homes[None, :]) <= bits
        for k in np.flatnonzero(near.any(axis=1)):
            first, *more = np.flatnonzero(near[k])
            yield part[k], homes[first]
            for j in more:
                if forest.join(int(first), int(j)):
                    yield part[k], homes[j]


def _links_of_groups(group: np.ndarray, fp: np.ndarray, home: np.ndarray, bits: int):
    """Links inside complete groups; the rows of a group are adjacent, its homes first."""
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[start, len(group)])
    homes = np.add.reduceat(home.astype(np.int64), start)
    use = (homes > 0) & (size > 1)
    small = use & (homes * size <= 4096)
    row = np.repeat(start[small], homes[small])
    row = row + (np.arange(len(row)) - np.repeat(np.cumsum(homes[small]) - homes[small], homes[small]))
    left = np.repeat(start[small] + size[small], homes[small]) - row - 1
    a = np.repeat(row, left)
    b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(left) - left, left)
    near = (np.bitwise_count(fp[a] ^ fp[b]) <= bits) & (fp[a] != fp[b])
    found = [(fp[a[near]], fp[b[near]])]
    for g in np.flatnonzero(use & ~small):
        s, h, e = start[g], start[g] + homes[g], start[g] + size[g]
        pairs = list(_large_group(fp[s:h], fp[h:e], bits))
        if pairs:
            found.append((np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs], np.uint64)))
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _compare(bits: int):
    def compare(batches):
        rest = None
        for b in batches:
            anchor, chunk, fp, home = (b.column(n).to_numpy(zero_copy_only=False) for n in ("anchor", "chunk", "fp", "home"))
            now = (anchor, chunk, fp.view(np.uint64), home.astype(bool))
            if rest is not None:
                now = tuple(np.concatenate([x, y]) for x, y in zip(rest, now))
            anchor, chunk, fp, home = now
            change = np.flatnonzero((anchor[1:] != anchor[:-1]) | (chunk[1:] != chunk[:-1])) + 1
            cut = change[-1] if len(change) else 0
            if cut:
                group = np.zeros(cut, np.int64)
                group[change[change < cut]] = 1
                src, dst = _links_of_groups(np.cumsum(group), fp[:cut], home[:cut], bits)
                yield _edges(src, dst)
            rest = tuple(x[cut:] for x in now)
            if len(rest[0]) > 200_000:  # one large group: of it, only the homes are kept
                yield _edges(*_links_of_groups(np.zeros(len(rest[0]), np.int64), rest[2], rest[3], bits))
                rest = tuple(x[rest[3]] for x in rest)
        if rest is not None and len(rest[0]):
            yield _edges(*_links_of_groups(np.zeros(len(rest[0]), np.int64), rest[2], rest[3], bits))

    return compare


def _edges(src: np.ndarray, dst: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(src).view(np.int64)), pa.array(np.ascontiguousarray(dst).view(np.int64))], names=["src", "dst"])


def links(prints: DataFrame, bits: int = MAX_BITS, homes_per_chunk: int = HOMES_PER_CHUNK) -> DataFrame:
    """Links between different fingerprints of ``prints`` (fp), enough to connect all
    that differ in ``bits`` (3 at most) or fewer bits."""
    if bits > 3:
        raise ValueError("the cover is made for at most 3 differing bits")
    rows = prints.select("fp").distinct().mapInArrow(_replicas, "anchor long, fp long, home boolean")
    rows = materialize(rows, "anchors")
    hot = materialize(rows.where("home").groupBy("anchor").count().where(F.col("count") > homes_per_chunk).select("anchor", F.ceil(F.col("count") / homes_per_chunk).alias("chunks")), "hot_anchors")
    if hot.isEmpty():
        rows = rows.withColumn("chunk", F.lit(0).cast("long"))
    else:
        rows = rows.join(hot, "anchor", "left")
        own = F.pmod(F.xxhash64("fp"), F.coalesce("chunks", F.lit(1)))
        every = F.sequence(F.lit(0).cast("long"), F.coalesce("chunks", F.lit(1)) - 1)
        chunks = F.when(F.col("chunks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(every)
        rows = rows.select("anchor", "fp", F.col("home"), own.alias("own"), F.explode(chunks).alias("chunk"))
        rows = rows.select("anchor", "fp", (F.col("home") & (F.col("own") == F.col("chunk"))).alias("home"), "chunk")
    dealt = rows.repartition("anchor", "chunk").sortWithinPartitions("anchor", "chunk", F.desc("home"))
    return dealt.select("anchor", "chunk", "fp", "home").mapInArrow(_compare(bits), "src long, dst long")


def _groups(own: DataFrame, bits: int) -> DataFrame:
    """(fp, root, component_id) of every different fingerprint."""
    classes = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    groups = connected_components(links(classes, bits))
    named = classes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.where("root <> fp").join(ids, "root").select("fp", "root", "component_id").union(ids.select(F.col("root").alias("fp"), "root", "component_id"))


def near_duplicates(docs: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least doc_id that can be reached
    over links of ``bits`` or fewer differing bits, the document's own id included.

    Null and empty texts have fingerprint 0 and are linked like others. Repeated rows
    come back repeated. A null doc_id keeps its row and never is a component's id,
    unless no member has another. An empty table gives an empty table. Other columns
    of ``docs`` are not read.
    """
    own = materialize(fingerprints(docs), "fingerprints")
    return own.join(_groups(own, bits).drop("root"), "fp", "left").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, that of the least
    doc_id, of those with that id the one with the least hash of its text; of repeated
    rows, one is kept. Rows of one doc_id with unlike texts are different documents.
    Rows with a null doc_id stay. All columns come back, of any names; an empty table gives an empty table."""
    own = materialize(fingerprints(docs.where("doc_id is not null")), "fingerprints")
    best = own.join(_groups(own, bits).select("fp", "root"), "fp").groupBy("root").agg(F.min(F.struct("doc_id", "copy")).alias("b")).select("b.doc_id", "b.copy")
    doc, copy = fresh(docs, "__doc", "__copy")
    best = best.select(F.col("doc_id").alias(doc), F.col("copy").alias(copy))
    kept = docs.join(best, (F.col("doc_id").cast("long") == F.col(doc)) & (F.xxhash64("text") == F.col(copy)), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"]).select(docs.columns).union(docs.where("doc_id is null"))
