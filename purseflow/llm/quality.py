"""A quality classifier by compression.

Two zstandard dictionaries are trained, one from good and one from bad labelled
text. A text is cut to pieces of 512 bytes, and each piece is compressed with
either dictionary. The difference of the two sizes over their sum, and the sizes
over the text's own, are what a logistic regression turns into a calibrated score.
It is fitted on labelled documents that neither dictionary has seen.

Only fitting uses a sample: at most PER_CLASS labelled documents of each class of at
most SAMPLED_BYTES bytes, chosen by a hash of the id, whole. Scoring reads whole texts.
Both dictionaries are trained to one size, which follows the smaller of the two samples.

Null and empty texts are scored as empty ones, repeated rows alike and as often as they
come; an empty table gives an empty one; without documents of both labels every score
is the same. ``keep_good`` hands on the columns of its input, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from purseflow.llm import logistic
from purseflow.llm.common import bounded_sample, fold

PER_CLASS = 2000
SAMPLED_BYTES = 1 << 16  # longer texts are not drawn for fitting
PIECE = 512
DICTIONARY = 112_640
LEVEL = 3
FOLDS, HELD_OUT = 3, 1
_FRAME = 8  # bytes of a frame that say nothing about the text


def _pieces(text: str | None) -> list[bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return [data[at : at + PIECE] for at in range(0, len(data), PIECE)] or [b""]


@dataclass
class QualityModel:
    bad: bytes
    good: bytes
    calibration: tuple
    constant: float | None = None

    def compressors(self):
        out = []
        for data in (self.bad, self.good):
            d = zstandard.ZstdCompressionDict(data)
            d.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out


def _sizes(compressors, text: str | None) -> list[float]:
    pieces = _pieces(text)
    raw = sum(map(len, pieces))
    bad, good = (max(1, sum(map(len, map(c.compress, pieces))) - _FRAME * len(pieces)) for c in compressors)
    difference, share, log = (bad - good) / (bad + good), (bad + good) / (2 * raw + 16), np.log1p(raw)
    return [difference, share, difference * difference, share * share, difference * share, log, share * log]


def _samples(texts: list[str], common: set[str]) -> list[bytes]:
    """Pieces to train on. Lines that several sampled documents share say nothing about the class."""
    return [p for t in texts for p in _pieces("\n".join(x for x in t.split("\n") if x not in common)) if len(p) >= 16]


def train_dictionaries(bad: list[bytes], good: list[bytes]) -> tuple[bytes, bytes]:
    """Two trained dictionaries of one size: an eighth of the smaller sample, DICTIONARY at most,
    and less if the trainer finds no more in it. Samples with too little to train any dictionary
    are cut to shorter and shorter pieces; if even that fails, there is nothing to learn from."""
    for piece in (PIECE, 64, 16):
        cut = [[p[at : at + piece] for p in side for at in range(0, len(p), piece)] for side in (bad, good)]
        size = min(DICTIONARY, min(sum(map(len, side)) for side in cut) // 8)
        while size >= 256:
            try:
                made = [zstandard.train_dictionary(size, side).as_bytes() for side in cut]
            except zstandard.ZstdError:
                size //= 2
                continue
            if len({len(d) for d in made}) == 1:
                return made[0], made[1]
            size = min(map(len, made)) if min(map(len, made)) < size else size // 2
    return b"\n", b"\n"


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> QualityModel:
    """Learn from rows of ``labels`` (doc_id, quality 0 or 1) whose fold isn't held
    out. Null labels and ids are left out; of conflicting labels, 0 counts. Without
    rows of both classes, every score is the share of label 1, or 0.5 without labels."""
    known = labels.where("quality in (0, 1) and doc_id is not null").where(fold("doc_id", FOLDS) != HELD_OUT)
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = {r[0]: r[1] for r in known.groupBy("quality").count().collect()}
    if len(counts) < 2:
        return QualityModel(b"\n", b"\n", (), float(*counts) if counts else 0.5)
    chosen = F.broadcast(bounded_sample(known, "doc_id", "quality", per_class))  # 2 * per_class rows at most
    texts_of = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.octet_length("text") <= SAMPLED_BYTES)
    rows = bounded_sample(texts_of.join(chosen, "doc_id"), "doc_id", "quality", per_class).collect()  # again, as ids may be repeated
    rows.sort(key=lambda r: (r.doc_id, r.text))
    seen = Counter(line for r in rows for line in {*r.text.split("\n")})
    common = {line for line, n in seen.items() if n > 2}
    texts = {q: [r.text for r in rows if r.quality == q] for q in (0, 1)}
    if min(map(len, texts.values())) < 4:
        return QualityModel(b"\n", b"\n", (), counts[1] / sum(counts.values()))
    model = QualityModel(*train_dictionaries(_samples(texts[0][::2], common), _samples(texts[1][::2], common)), ())
    tools = model.compressors()
    x = np.array([_sizes(tools, t) for q in (0, 1) for t in texts[q][1::2]])
    y = np.repeat([0.0, 1.0], [len(texts[0][1::2]), len(texts[1][1::2])])
    weight = np.where(y == 1, counts[1] / y.sum(), counts[0] / (1 - y).sum())
    model.calibration = logistic.fit(x, y, weight / weight.mean())
    return model


def _scores(model: QualityModel, tools, texts: list[str | None]) -> np.ndarray:
    if tools is None:
        return np.full(len(texts), model.constant)
    return logistic.predict(model.calibration, np.array([_sizes(tools, t) for t in texts])) if texts else np.zeros(0)


def _with_tools(shared):
    model: QualityModel = shared.value
    return model, model.compressors() if model.constant is None else None


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, quality_score) for every row and its whole text; null texts count as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        own, tools = _with_tools(shared)
        for b in batches:
            found = _scores(own, tools, b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "quality_score"])

    return rows.mapInArrow(run, "doc_id long, quality_score double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose score is below the threshold; all its columns, of any names."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    at = docs.columns.index("text")

    def run(batches):
        own, tools = _with_tools(shared)
        for b in batches:
            yield b.filter(pa.array(_scores(own, tools, b.column(at).to_pylist()) >= threshold))

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, docs.withColumn("text", F.col("text").cast("string")).schema)
