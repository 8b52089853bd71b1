"""BPE encoding and decoding with forced boundaries.

A byte pair that occurs inside no vocabulary token can never be merged over: the
place between its two bytes is a certain cut. Words are cut there, the fragments
are encoded independently, all fragments of a batch at once with numpy, and the
ids are concatenated. Pieces met before come from a cache of bounded size; the cache
changes the speed, never a result.

The vocabulary is a public tokenizer file of the kind with word ends: text is
normalised (NFC, white space, lower case) and split to words by a pattern, and a
word's last symbol carries an end mark. Which characters are letters or digits is
Python's Unicode table's to say. A text with a character that this table doesn't have,
or that the pattern's module takes for another kind, is normalised and split by the
tokenizers library itself, whose table may be newer.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE_PIECES = 200_000
PIECES_AT_ONCE = 200_000
#: Control characters that Python's str.split takes for white space and the tokenizer's pattern doesn't.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_WORD_KINDS = {"L": re.compile(r"[^\W\d_]"), "N": re.compile(r"\d"), " ": re.compile(r"\s")}
_KINDS = {"L": regex.compile(r"\p{L}"), "N": regex.compile(r"\p{N}"), " ": regex.compile(r"[^\S\x1c-\x1f]")}


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary: printable
    Latin-1 characters stand for themselves, others follow from U+0100 in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _kind(c: str) -> str:
    """L, N, a space or O (other) by Python's table; of a character that it doesn't have, a question mark."""
    kind = unicodedata.category(c)
    return "?" if kind == "Cn" else kind[0] if kind[0] in "LN" else " " if c.isspace() and not _ODD_SPACE.match(c) else "O"


class _Kinds(dict):
    """How texts with a character are split: ``odd`` by the library, ``hard`` by the regex module, ``plain`` by Python's own."""

    def __missing__(self, c: str) -> str:
        kind = _kind(c)
        if kind != next((k for k, p in _KINDS.items() if p.match(c)), "O"):
            found = "odd"
        else:
            found = "plain" if kind == next((k for k, p in _WORD_KINDS.items() if p.match(c)), "O") else "hard"
        return self.setdefault(c, found)


class WordBpe:
    """A tokenizer file's vocabulary as arrays."""

    def __init__(self, spec: str):
        top = json.loads(spec)
        model = top["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>" or model.get("continuing_subword_prefix"):
            raise ValueError("a BPE vocabulary with word ends is needed")
        self.end = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in top["added_tokens"]}
        self.size = max(*vocab.values(), *self.special.values()) + 1
        self.token = [b""] * self.size
        for text, i in [*vocab.items(), *self.special.items()]:
            self.token[i] = text.encode()
        as_byte = byte_symbols()
        self.inner = np.zeros(256, np.int64)
        self.final = np.zeros(256, np.int64)
        inside = np.zeros((256, 256), bool)
        for text, i in vocab.items():
            body = text.removesuffix(self.end)
            raw = [as_byte[c] for c in body]
            if len(raw) == 1:
                (self.final if body != text else self.inner)[raw[0]] = i
            inside[raw[:-1], raw[1:]] = True
        self.forced = ~inside
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        pair = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(pair, kind="stable")
        self.pair, self.rank, self.made = pair[order], order.astype(np.int64), made[order]
        split = top["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(split).findall
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.spec, self.library, self.as_byte = spec, None, as_byte
        self.kinds = _Kinds()
        # the same pieces by the faster module, for texts without digits beyond decimal ones and without control characters that it takes for white space
        ends = split.split("|[")[0]
        self.ascii_pieces = re.compile(ends + r"|[a-z]+|[0-9]|[^\sa-z0-9]+").findall
        self.word_pieces = re.compile(ends + r"|[^\W\d_]+|\d|(?:[^\s\w]|_)+").findall
        self.known: dict[str, bytes] = {}

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece, as little-endian unsigned 32-bit integers."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        size = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        n = len(data)
        if not n:
            return [b""] * len(pieces)
        last = np.cumsum(size)[size > 0] - 1
        symbol = self.inner[data]
        symbol[last] = self.final[data[last]]
        cut = np.ones(n, bool)  # whether a fragment ends here
        cut[:-1] = self.forced[data[:-1], data[1:]]
        cut[last] = True
        fragment = np.r_[0, np.cumsum(cut)[:-1]]
        place = np.arange(n)
        done_place, done_symbol = [], []
        while len(symbol):
            same = fragment[1:] == fragment[:-1]
            key = symbol[:-1] * self.size + symbol[1:]
            at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            hit = same & (self.pair[at] == key)
            rank = np.where(hit, self.rank[at], np.iinfo(np.int64).max)
            rank = np.append(rank, np.iinfo(np.int64).max)
            start = np.flatnonzero(np.r_[True, ~same])
            least = np.minimum.reduceat(rank, start)
            length = np.diff(np.r_[start, len(symbol)])
            goes_on = np.repeat(least < np.iinfo(np.int64).max, length)
            if not goes_on.all():
                done_place.append(place[~goes_on])
                done_symbol.append(symbol[~goes_on])
            if not goes_on.any():
                break
            merge = goes_on & (rank == np.repeat(least, length))
            # in a run of overlapping pairs, every second one merges, from the left
            run = merge.copy()
            run[1:] &= ~merge[:-1]
            first = np.maximum.accumulate(np.where(run, np.arange(len(merge)), -1))
            merge &= (np.arange(len(merge)) - first) % 2 == 0
            spot = np.flatnonzero(merge)
            symbol = symbol.copy()
            symbol[spot] = self.made[at[spot]]
            keep = goes_on
            keep[spot + 1] = False
            symbol, fragment, place = symbol[keep], fragment[keep], place[keep]
        where = np.concatenate(done_place)
        order = np.argsort(where, kind="stable")
        ids = np.concatenate(done_symbol)[order].astype("<u4").tobytes()
        ends = np.searchsorted(where[order], np.cumsum(size))
        bounds = np.r_[0, ends] * 4
        return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    #: Most pieces that are remembered.
    limit = CACHE_PIECES

    def lookup(self, pieces: list[str]) -> list[bytes]:
        each = set(pieces)
        new = each.difference(self.known)
        if len(self.known) + len(new) > self.limit:
            self.known.clear()
            new = each
        known = self.known if len(new) <= self.limit else {}
        if new:
            new = list(new)
            known.update(zip(new, self.encode_pieces(new)))
        return list(map(known.__getitem__, pieces))

    def split(self, text: str) -> list[str] | bytes:
        """The pieces of a text in normal form; of an odd one, the ids themselves."""
        if text.isascii():
            return (self.pieces if _ODD_SPACE.search(text) else self.ascii_pieces)(text.lower())
        low = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # each character by itself: no final sigma
        kinds = set(map(self.kinds.__getitem__, {*text, *low}))
        if "odd" in kinds:
            return self.by_library(text)
        return (self.pieces if "hard" in kinds else self.word_pieces)(low)

    def by_library(self, text: str) -> bytes:
        """The ids of a text that the library normalises and splits."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.spec)
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return b"".join(self.encode_pieces([bytes(map(self.as_byte.__getitem__, p)).decode() for p, _ in pieces]))

    def parts(self, text: str | None) -> list[list[str] | bytes]:
        """Lists of pieces, with special tokens' ids and those of odd texts between them."""
        text = text or ""
        if self.at_special is None or not self.at_special.search(text):
            return [self.split(text)]
        return [self.special[x].to_bytes(4, "little") if x in self.special else self.split(x) for x in self.at_special.split(text)]

    def encode_batch(self, texts: list[str | None]):
        """Yield each text's ids as bytes, looking pieces up for many texts at once."""
        held: list[list] = []
        n = 0
        for text in texts:
            held.append(self.parts(text))
            n += sum(len(p) for p in held[-1] if isinstance(p, list))
            if n > PIECES_AT_ONCE:
                yield from self._flush(held)
                held, n = [], 0
        yield from self._flush(held)

    def _flush(self, held):
        words = [w for parts in held for p in parts if isinstance(p, list) for w in p]
        ids = []
        for at in range(0, len(words), PIECES_AT_ONCE):
            ids += self.lookup(words[at : at + PIECES_AT_ONCE])
        at = 0
        for parts in held:
            out = []
            for p in parts:
                if isinstance(p, list):
                    out += ids[at : at + len(p)]
                    at += len(p)
                else:
                    out.append(p)
            yield b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The text of ids in UTF-8: this kind of file names no decoder, so tokens are joined by spaces."""
        return b" ".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=4)
def model(spec: str) -> WordBpe:
    """One model for a worker process, kept between tasks."""
    return WordBpe(spec)


def read_spec(path: str) -> str:
    """The tokenizer file's text. It goes to the tasks inside the function; its size is fixed by the vocabulary."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _round_trip(spec, with_ids: bool):
    def run(batches):
        bpe = model(spec.value)
        for b in batches:
            n, ids_sha, text_sha, lists = [], [], [], []
            for ids in bpe.encode_batch(b.column("text").to_pylist()):
                if with_ids:
                    lists.append(np.frombuffer(ids, "<i4"))
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            columns = [b.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            if with_ids:
                columns.append(pa.array(lists, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    return run


def _encode(spec):
    def run(batches):
        bpe = model(spec.value)
        for b in batches:
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in bpe.encode_batch(b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def _decode(spec):
    def run(batches):
        bpe = model(spec.value)
        for b in batches:
            text = [None if x is None else bpe.decode(np.asarray(x, "<u4").tobytes()).decode("utf-8", "replace") for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(text, pa.string())], names=["doc_id", "text"])

    return run


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _shared(docs: DataFrame, path: str):
    return docs.sparkSession.sparkContext.broadcast(read_spec(path))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>) of every text. Null and empty texts give no ids;
    repeated rows stay repeated, null ids of documents stay null."""
    return _input(docs).mapInArrow(_encode(_shared(docs, path)), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give a null text."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(_shared(encoded, path)), "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), and ids if asked for: every text encoded, its ids
    decoded again, in one pass over the documents, without a shuffle. Null texts
    count as empty (no ids, and the digests of nothing)."""
    return _input(docs).mapInArrow(_round_trip(_shared(docs, path), with_ids), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
