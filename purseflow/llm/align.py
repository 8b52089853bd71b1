"""Alignment of two tokenizers' ids over the same bytes.

A is a byte-level BPE that reads a space and the text, B a piece BPE with byte fallback that
adds the space itself. Byte offsets where a token of both ends cut a text into groups; the two
tokens that end there are linked. Most groups are one token of A and the one of B with the same
bytes. Those are counted in a vector as long as A's vocabulary, by a map from A's ids to B's that
is made once; only the other links are shuffled as pairs.

No merge of either tokenizer can cross a single space between two characters that aren't white
space or B's space mark (A's pattern starts anew there, and no piece of B has a space mark after
anything else; the latter is checked when the file is read). So a text is cut there, and each different stretch is encoded once for many
texts, which also bounds the memory that a very long text takes. Stretches are remembered up to a
number of characters; that changes the speed, never a result.

Texts that are null or empty, or that either tokenizer doesn't give back byte by byte, have no
tokens. Repeated rows stay repeated, a null id stays null; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from purseflow.llm.bpe import byte_symbols
from purseflow.storage import materialize

#: Characters of stretches that a worker remembers, and of text that it encodes at once.
CACHE_CHARS = 4 << 20
TEXT_AT_ONCE = 1 << 20
#: Pairs up to which the counts of links outside the map are broadcast (24 bytes each); more are joined by a shuffle.
BROADCAST_PAIRS = 1 << 20

_CODED = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, same array<int>, same_n array<int>, odd_a array<int>, odd_b array<int>, odd_n array<int>"
_CUT = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")
_NONE = np.empty(0, np.int32)


class Pair:
    """Both tokenizers, their ids' bytes, and the map from A's ids to B's."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        symbols = byte_symbols()
        vocab = self.a.get_vocab(with_added_tokens=True)
        added = {x.content for x in self.a.get_added_tokens_decoder().values()}
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for text, i in vocab.items():
            self.bytes_a[i] = text.encode() if text in added else bytes(map(symbols.__getitem__, text))
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        #: Whether texts may be cut at single spaces.
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)
        self.size_a, self.size_b = [len(x) for x in self.bytes_a], [len(x) for x in self.bytes_b]
        by_bytes = {x: i for i, x in reversed([*enumerate(self.bytes_b)]) if not self.b.is_byte(i) and not self.b.is_control(i) and not self.b.is_unknown(i)}
        self.same = np.array([by_bytes.get(x, -1) if x else -1 for x in self.bytes_a], np.int32)
        self.map = self.same.tolist()
        #: What a stretch adds to a document: numbers of tokens of A and B, groups as text, ids of A linked by the map, other links. None where a tokenizer doesn't give it back.
        self.known: dict[str, tuple | None] = {}
        self.held = 0

    def _group(self, text: str, a: list[int], b: list[int]) -> tuple | None:
        whole = b" " + text.encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) != whole or b"".join(map(self.bytes_b.__getitem__, b)) != whole:
            return None
        size_a, size_b, known = self.size_a, self.size_b, self.map
        parts, same, odd, p, q, i, j = [], [], [], 0, 0, 1, 1
        end_a, end_b = size_a[a[0]], size_b[b[0]]
        while True:
            if end_a < end_b:
                end_a += size_a[a[i]]
                i += 1
            elif end_b < end_a:
                end_b += size_b[b[j]]
                j += 1
            else:
                x, y = a[i - 1], b[j - 1]
                parts.append(f"{x}|{y}" if i - p == 1 == j - q else ",".join(map(str, a[p:i])) + "|" + ",".join(map(str, b[q:j])))
                if known[x] == y:
                    same.append(x)
                else:
                    odd.append(x << 32 | y)
                if i == len(a):
                    return len(a), len(b), ";".join(parts), tuple(same), tuple(odd)
                p, q = i, j
                end_a += size_a[a[i]]
                end_b += size_b[b[j]]
                i += 1
                j += 1

    def stretches(self, text: str) -> list[str]:
        return _CUT.split(text) if self.cuts else [text]

    def learn(self, texts: set[str]) -> None:
        """Encode those of the texts that aren't remembered. When the cache is full, what these texts don't need is forgotten."""
        new = [t for t in texts if t not in self.known]
        self.held += sum(map(len, new))
        if self.held > CACHE_CHARS:
            self.known = {t: self.known[t] for t in texts if t in self.known}
            self.held = sum(map(len, texts))
        for some in _runs(new, TEXT_AT_ONCE):
            b = self.b.encode(some, num_threads=1)
            if not (self.cuts and self._learn_together(some, b)):
                a = self.a.encode_batch_fast([" " + t for t in some], add_special_tokens=False)
                self.known.update((t, self._group(t, x.ids, y)) for t, x, y in zip(some, a, b))

    def _learn_together(self, some: list[str], b: list[list[int]]) -> bool:
        """The same for all at once: stretches are put together again for A, and grouped as one row
        of bytes. False if that row isn't given back byte by byte; then each is looked at by itself."""
        joined = self.a.encode_batch_fast([" " + " ".join(run) for run in _runs(some, 1_000)], add_special_tokens=False)
        a, b = list(chain.from_iterable(x.ids for x in joined)), list(chain.from_iterable(b))
        raw = [b" " + t.encode() for t in some]
        whole = b"".join(raw)
        if b"".join(map(self.bytes_a.__getitem__, a)) != whole or b"".join(map(self.bytes_b.__getitem__, b)) != whole:
            return False
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        ids_a, ids_b = np.array(a, np.int64), np.array(b, np.int64)
        end_a, end_b = np.cumsum(np.array(self.size_a)[ids_a]), np.cumsum(np.array(self.size_b)[ids_b])
        at = np.searchsorted(end_b, end_a)
        last_a = np.flatnonzero(end_b[at] == end_a)
        last_b = at[last_a]
        cuts = np.searchsorted(end_a[last_a], ends)
        if (end_a[last_a][np.minimum(cuts, len(last_a) - 1)] != ends).any():
            return False
        first_a, first_b = np.r_[0, last_a[:-1] + 1], np.r_[0, last_b[:-1] + 1]
        x, y = ids_a[last_a], ids_b[last_b]
        groups = [f"{p}|{q}" for p, q in zip(x.tolist(), y.tolist())]
        for g in np.flatnonzero((first_a != last_a) | (first_b != last_b)).tolist():
            groups[g] = ",".join(map(str, a[first_a[g] : last_a[g] + 1])) + "|" + ",".join(map(str, b[first_b[g] : last_b[g] + 1]))
        mapped = self.same[x] == y
        same, odd = x[mapped].tolist(), (x << 32 | y)[~mapped].tolist()
        until = cuts + 1
        same_until = np.r_[0, np.cumsum(mapped)][until]
        bounds = [np.r_[0, u].tolist() for u in (last_a[cuts] + 1, last_b[cuts] + 1, until, same_until, until - same_until)]
        rows = zip(some, *[z for u in bounds for z in (u, u[1:])])
        self.known.update((t, (a1 - a0, b1 - b0, ";".join(groups[g0:g1]), tuple(same[s0:s1]), tuple(odd[o0:o1]))) for t, a0, a1, b0, b1, g0, g1, s0, s1, o0, o1 in rows)
        return True

    def document(self, pieces: list[str]) -> tuple | None:
        found = list(map(self.known.__getitem__, pieces))
        if None in found:
            return None
        n_a, n_b, texts, same, odd = zip(*found)
        digest = hashlib.sha256(";".join(texts).encode()).hexdigest()
        same, odd = Counter(chain.from_iterable(same)), Counter(chain.from_iterable(odd))
        keys = np.fromiter(odd, np.int64, len(odd))
        n_groups = same.total() + odd.total()  # each group has one link
        return sum(n_a), sum(n_b), n_groups, digest, list(same), list(same.values()), keys >> 32, keys & 0xFFFFFFFF, list(odd.values())

    def documents(self, texts):
        """Each text's row, with many texts' stretches encoded at once."""
        held, size = [], 0
        for text in texts:
            held.append(self.stretches(text) if text else [])
            size += len(text or "")
            if size > TEXT_AT_ONCE:
                yield from self._flush(held)
                held, size = [], 0
        yield from self._flush(held)

    def _flush(self, held):
        self.learn({s for pieces in held for s in pieces})
        for pieces in held:
            yield (self.document(pieces) if pieces else None) or (0, 0, 0, "", *[_NONE] * 5)


def _runs(texts: list[str], size: int):
    """The texts in runs of a bounded number of characters (or one text)."""
    at, n = 0, 0
    for k, t in enumerate(texts):
        n += len(t)
        if n > size or k + 1 == len(texts):
            yield texts[at : k + 1]
            at, n = k + 1, 0


@lru_cache(maxsize=2)
def pair(path_a: str, path_b: str) -> Pair:
    """One pair for a worker process, kept between tasks."""
    return Pair(path_a, path_b)


def _coded(path_a: str, path_b: str):
    types = [pa.int64()] * 3 + [pa.string()] + [pa.list_(pa.int32())] * 5
    names = [c.split()[0] for c in _CODED.split(", ")]

    def run(batches):
        both = pair(path_a, path_b)
        for b in batches:
            at = 0
            for rows in _some(both.documents(b.column("text").to_pylist()), 512):
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, len(rows)), *columns], names=names)
                at += len(rows)

    return run


def _some(rows, n: int):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == n:
            yield held
            held = []
    if held:
        yield held


def encode(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row for each document: numbers of tokens and groups, the digest of the groups, and the
    different links with how often each occurs: those of the map (``same``, an id of A), and others (``odd_a``, ``odd_b``)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_coded(path_a, path_b), _CODED)


def _vector(n: int):
    def run(batches):
        total = np.zeros(n, np.int64)
        for b in batches:
            ids, counts = b.column("same").flatten().to_numpy(zero_copy_only=False), b.column("same_n").flatten().to_numpy(zero_copy_only=False)
            total += np.bincount(ids, counts, minlength=n).astype(np.int64) if len(ids) else 0
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(total[ids])], names=["a", "n"])

    return run


def link_counts(coded: DataFrame, path_a: str, path_b: str) -> tuple[np.ndarray, DataFrame]:
    """How often each pair of ids is linked in all documents: a vector by A's ids for the pairs
    of the map, and a table (a, b, n) of the others."""
    both = pair(path_a, path_b)
    vector = np.zeros(len(both.same), np.int64)
    sums = coded.select("same", "same_n").mapInArrow(_vector(len(vector)), "a int, n long").groupBy("a").agg(F.sum("n").alias("n"))
    for a, n in sums.collect():  # as many rows as A has ids, at most
        vector[a] = n
    odd = coded.select(F.explode(F.arrays_zip("odd_a", "odd_b", "odd_n")).alias("o"))
    return vector, odd.groupBy(F.col("o.odd_a").alias("a"), F.col("o.odd_b").alias("b")).agg(F.sum("o.odd_n").alias("n"))


def _map_links(state):
    def run(batches):
        count, chosen = state.value
        for b in batches:
            column = b.column("same")
            ids, n = column.flatten().to_numpy(zero_copy_only=False), b.column("same_n").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.r_[0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
            best, total = np.r_[0, np.cumsum(n * chosen[ids])], np.r_[0, np.cumsum(n * count[ids])]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(best[ends[1:]] - best[ends[:-1]]), pa.array(total[ends[1:]] - total[ends[:-1]])], names=["row", "n_best", "count_sum"])

    return run


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document:
    of its links, how many are of the pair that is the most frequent of its id of B in all
    documents (ties included), and the sum of the pairs' counts."""
    spark = docs.sparkSession
    coded = materialize(encode(docs, path_a, path_b).withColumn("row", F.monotonically_increasing_id()), "coded")
    vector, odd = link_counts(coded, path_a, path_b)
    odd = materialize(odd, "odd_links")
    both = pair(path_a, path_b)
    of_map = spark.createDataFrame([(int(both.same[a]), int(vector[a])) for a in np.flatnonzero(vector)], "b int, n long")
    highest = odd.select("b", "n").union(of_map).groupBy("b").agg(F.max("n").alias("highest"))
    top = np.zeros(len(both.bytes_b), np.int64)
    for b, n in highest.collect():  # as many rows as B has ids, at most
        top[b] = n
    chosen = (vector == top[both.same]) & (both.same >= 0)
    own = coded.select("row", "same", "same_n").mapInArrow(_map_links(spark.sparkContext.broadcast((vector, chosen))), "row long, n_best long, count_sum long")
    known = odd.join(F.broadcast(highest), "b").select(F.col("a").alias("odd_a"), F.col("b").alias("odd_b"), "n", (F.col("n") == F.col("highest")).alias("chosen"))
    if odd.count() <= BROADCAST_PAIRS:
        known = F.broadcast(known)
    links = coded.where(F.size("odd_a") > 0).select("row", F.explode(F.arrays_zip("odd_a", "odd_b", "odd_n")).alias("o")).select("row", "o.*")
    others = links.join(known, ["odd_a", "odd_b"]).select("row", F.when(F.col("chosen"), F.col("odd_n")).otherwise(0).cast("long").alias("n_best"), (F.col("odd_n") * F.col("n")).alias("count_sum"))
    sums = own.union(others).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    facts = coded.select("row", "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "groups_sha256")
    return facts.join(sums, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
