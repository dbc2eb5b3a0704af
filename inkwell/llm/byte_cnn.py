"""Operator 2: a byte-level convolutional network for document quality, in numpy.

A document's UTF-8 bytes are cut into chunks of CHUNK bytes that overlap by
CHUNK - STRIDE, so every byte is in a chunk.  Each byte is embedded; learned
filters of WIDTH bytes slide over a chunk every HOP bytes (they overlap too);
each filter keeps its maximum per chunk.  A document's vector is the maximum
and the mean of its chunks' vectors, from which a logistic layer makes one
probability.  All weights are learned by back-propagation.

Training reads the whole texts of a bounded sample: at most `per_class`
labelled documents of each label, the only bound there is.  It always takes
STEPS steps of BATCH documents with classes weighted alike; then the share of
each label in the whole table of usable labels (counted, not sampled) becomes
the prior, so a score means the same whatever the sample or the table's size.

Defined results: a null or empty text is scored as one chunk of zero bytes;
repeated rows are scored alike; without any usable label every score is 0.5; a
document's older score (a column of that name in any case) is replaced; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from inkwell.llm import textkit
from inkwell.llm.columns import aside, back
from inkwell.llm.workers import tidy

CHUNK, STRIDE = 512, 448
DIM, WIDTH, HOP, FILTERS = 8, 8, 2, 32
STEPS, BATCH = 350, 32
THRESHOLD = 0.3


@dataclass
class Model:
    embed: np.ndarray  # 256 x DIM
    kernel: np.ndarray  # WIDTH * DIM x FILTERS
    bias: np.ndarray
    dense: np.ndarray  # 2 * FILTERS
    offset: float


def fresh(seed: int) -> Model:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    return Model(draw(256, DIM, scale=0.5), draw(WIDTH * DIM, FILTERS, scale=(WIDTH * DIM) ** -0.5), np.zeros(FILTERS, np.float32), draw(2 * FILTERS, scale=0.1), 0.0)


def _responses(model: Model, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(embedded chunks as HOP-byte rows, filter responses): WIDTH is a few hops, so as many products make a response."""
    hops, places, part = WIDTH // HOP, CHUNK // HOP, HOP * DIM
    rows = model.embed[chunks].reshape(len(chunks), places, part)
    flat, last = rows.reshape(-1, part), places - hops + 1
    out = (flat @ model.kernel[:part]).reshape(len(chunks), places, FILTERS)[:, :last].copy()
    for k in range(1, hops):
        out += (flat @ model.kernel[k * part : (k + 1) * part]).reshape(len(chunks), places, FILTERS)[:, k : k + last]
    return rows, out


def chunk_vectors(model: Model, chunks: np.ndarray) -> np.ndarray:
    out = np.empty((len(chunks), FILTERS), np.float32)
    for i in range(0, len(chunks), 64):
        out[i : i + 64] = np.maximum(_responses(model, chunks[i : i + 64])[1].max(axis=1) + model.bias, 0)
    return out


def _document_vectors(vectors: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Maximum and mean over each document's chunks; first: where each document's chunks begin."""
    sizes = np.diff(np.append(first, len(vectors)))[:, None]
    return np.hstack([np.maximum.reduceat(vectors, first), np.add.reduceat(vectors, first) / sizes])


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chunks, first chunk of each row): overlapping chunks over all bytes of each row, zeros after a row's end."""
    sizes = np.diff(offsets)
    n = np.maximum(1, -(-(sizes - (CHUNK - STRIDE)) // STRIDE))
    first = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), n)
    start = offsets[row] + (np.arange(len(row)) - first[row]) * STRIDE
    length = np.clip(offsets[row + 1] - start, 0, CHUNK)
    padded = np.concatenate([data, np.zeros(CHUNK, np.uint8)])
    chunks = np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[start]
    short = length < CHUNK
    chunks[short] *= (np.arange(CHUNK) < length[short][:, None]).astype(np.uint8)
    return chunks, first


def score_block(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    chunks, first = cut(data, offsets)
    logit = _document_vectors(chunk_vectors(model, chunks), first) @ model.dense + model.offset
    return 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -30, 30)))


def loss_and_slopes(model: Model, chunks: np.ndarray, sizes: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """The mean weighted log loss of some documents (sizes: chunks of each) and its slopes."""
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    best, where = np.empty((len(chunks), FILTERS), np.float32), np.empty((len(chunks), FILTERS), np.int64)
    for i in range(0, len(chunks), 64):
        response = _responses(model, chunks[i : i + 64])[1]
        where[i : i + 64] = at = response.argmax(axis=1)  # the place of each filter's maximum in each chunk
        best[i : i + 64] = np.take_along_axis(response, at[:, None], 1)[:, 0] + model.bias
    vectors = np.maximum(best, 0)
    docs = _document_vectors(vectors, begin)
    p = 1 / (1 + np.exp(-(docs @ model.dense + model.offset)))
    share = weight[labels] / len(labels)
    loss = -float(np.sum(share * np.log(np.clip(np.where(labels == 1, p, 1 - p), 1e-12, 1))))
    slope = ((p - labels) * share).astype(np.float32)
    d_docs = slope[:, None] * model.dense
    is_max = vectors == docs[owner, :FILTERS]
    ties = np.add.reduceat(is_max.astype(np.float32), begin)
    d_vec = is_max * (d_docs[:, :FILTERS] / ties)[owner] + (d_docs[:, FILTERS:] / sizes[:, None])[owner]
    d_vec *= best > 0
    slopes = {"dense": docs.T @ slope, "offset": np.float32(slope.sum()), "bias": d_vec.sum(axis=0)}
    kernel, embed = np.zeros_like(model.kernel), np.zeros_like(model.embed)
    for f in range(FILTERS):  # a maximum sends its slope to the WIDTH bytes it came from
        used = np.flatnonzero(d_vec[:, f])
        byte = chunks[used[:, None], where[used, f, None] * HOP + np.arange(WIDTH)]
        kernel[:, f] = d_vec[used, f] @ model.embed[byte].reshape(len(used), WIDTH * DIM)
        pull = np.zeros((256, WIDTH), np.float32)  # how strongly each byte is met at each place of the filter
        np.add.at(pull, (byte, np.arange(WIDTH)), d_vec[used, f, None])
        embed += pull @ model.kernel[:, f].reshape(WIDTH, DIM)
    return loss, slopes | {"kernel": kernel, "embed": embed}


def fit(chunks: np.ndarray, first: np.ndarray, labels: np.ndarray, counts: tuple[int, int] | None = None, steps: int = STEPS, batch: int = BATCH, rate: float = 4e-3, seed: int = 7) -> Model:
    """Adam over documents; first: where each document's chunks begin; counts: how many documents of each label there are in all."""
    model, rng = fresh(seed), np.random.default_rng(seed)
    last = np.append(first, len(chunks))
    params = {k: np.asarray(getattr(model, k), np.float32) for k in ("embed", "kernel", "bias", "dense", "offset")}
    m1 = {k: np.zeros_like(v) for k, v in params.items()}
    m2 = {k: np.zeros_like(v) for k, v in params.items()}
    weight = (len(labels) / (2 * np.maximum(np.bincount(labels, minlength=2), 1))).astype(np.float32)
    queue = np.empty(0, np.int64)
    for t in range(1, steps + 1):
        while len(queue) < batch:
            queue = np.concatenate([queue, rng.permutation(len(labels))])
        at, queue = queue[:batch], queue[batch:]
        part = chunks[np.concatenate([np.arange(last[i], last[i + 1]) for i in at])]
        _, slopes = loss_and_slopes(model, part, (last[at + 1] - last[at]).astype(np.int64), labels[at], weight)
        for k, g in slopes.items():
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.999 * m2[k] + 0.001 * g * g
            params[k] = (params[k] - rate * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        model = Model(params["embed"], params["kernel"], params["bias"], params["dense"], float(params["offset"]))
    zero, one = counts or np.bincount(labels, minlength=2)
    model.offset += float(np.log(one / zero)) if zero and one else 0.0
    return model


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 700, seed: int = 7) -> Model | None:
    """Learns from rows that are not held out; None if no label can be used."""
    usable = labels.where(~held_out() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    mixed = F.xxhash64(F.lit(seed), F.col("doc_id"))
    # Two top-k sorts with a fixed k: each keeps k rows per task and per class.
    chosen = [usable.where(F.col("label") == y).orderBy(mixed, "doc_id").limit(per_class) for y in (0, 1)]
    sample = chosen[0].unionByName(chosen[1])
    # The sample has at most 2 * per_class rows of two numbers, which bounds this broadcast and the rows that come back.
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    rows = texts.groupBy("doc_id").agg(F.min(F.struct("text", "label")).alias("r")).select("doc_id", "r.*").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: str(r.doc_id))
    counted = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    raw = [r.text.encode() for r in rows]
    chunks, first = cut(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    return fit(chunks, first, np.array([r.label for r in rows]), (counted.get(0, 0), counted.get(1, 0)), seed=seed)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of docs plus score; the model's few thousand weights travel with the task."""
    given, docs = docs, aside(docs, "text")
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [np.full(b - a, 0.5) if model is None else score_block(model, data, offsets) for a, b, data, offsets in textkit.blocks(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(got) if got else np.empty(0))], [*batch.schema.names, "score"])

    scored = docs.mapInArrow(tidy(run), type(schema)([*schema.fields, StructField("score", DoubleType())]))
    return back(scored, given, ("text",), ("score",))
