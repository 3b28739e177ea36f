"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels stand on documents; tokens get theirs from statistics over all labelled
training rows: a word or word beginning that is significantly more frequent among
toxic documents marks its tokens there. The field (two states, hashed features of a
word, its beginnings and its neighbours) is fitted by minibatch gradients on one half
of a bounded sample; a logistic link from the marginals of a document to its label is
fitted on the other half, both in one executor task. Every document is then tagged by
forward-backward over its whole text, however long: a chain is a document.

Chains of any length run side by side in blocks: products of transfer matrices carry
the messages from block to block, and each block then starts from those that enter it.
The marginals are those of the unbroken chain.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, ship, slices, text_buffer
from .wordhash import NOT_ALNUM, Words, mix, spans_hash, words

TABLE = 1 << 18
BLOCK = 64
BEGINNINGS = (4, 5, 6, 7, 8)
_CONTEXT = (-1, 1)


def word_features(w: Words) -> np.ndarray:
    """A 64-bit hash for each (kind, word): the whole word, and its first 4 to 8 bytes; 0 where it is shorter."""
    out = np.zeros((1 + len(BEGINNINGS), len(w.hash)), np.uint64)
    out[0] = w.hash
    for i, k in enumerate(BEGINNINGS, 1):
        long = np.flatnonzero(w.end - w.start >= k)
        out[i, long] = mix(spans_hash(w.data, w.start[long], w.start[long] + k) + np.uint64(i))
    return out


@dataclass
class Model:
    """weight and bias: log-odds of a toxic token, by hashed feature and of any token; step: 2 x 2 log transition scores; link: of the document logistic."""

    weight: np.ndarray
    bias: float
    step: np.ndarray
    link: np.ndarray


def feature_slots(features: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Slot in the weight table of each feature of each token; 0 stands for none and has no weight."""
    n = features.shape[1]
    slots = np.zeros((len(features) + len(_CONTEXT), n), np.int32)
    slots[: len(features)] = (features % np.uint64(TABLE - 1)).astype(np.int32) + 1
    slots[: len(features)][features == 0] = 0
    for i, by in enumerate(_CONTEXT, len(features)):
        a, b = (slice(1, n), slice(0, n - 1)) if by < 0 else (slice(0, n - 1), slice(1, n))
        near = (mix(features[0, b] + np.uint64(100 + i)) % np.uint64(TABLE - 1)).astype(np.int32) + 1
        slots[i, a] = np.where(doc[a] == doc[b], near, 0)
    return slots


def _block_starts(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First token, length and number within its chain of each block of at most BLOCK tokens; `first` holds the chains' first tokens, and the end."""
    size = np.diff(first)
    count = -(-size // BLOCK)
    number = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = np.repeat(first[:-1], count) + BLOCK * number
    return start, np.minimum(BLOCK, np.repeat(first[1:], count) - start), number


def forward_backward(emit: np.ndarray, first: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of state 1 of each token, and expected transitions (2 x 2), of chains that lie end to end.

    emit: log-odds of state 1 by token; first: first token of each chain, and the end;
    step: log scores of transitions.
    """
    if not len(emit):
        return np.zeros(0), np.zeros((2, 2))
    a, odds = np.exp(step), np.exp(np.clip(emit, -30, 30))
    start, size, number = _block_starts(first)
    at = np.minimum(start[None, :] + np.arange(BLOCK)[:, None], len(emit) - 1)
    inside = np.arange(BLOCK)[:, None] < size[None, :]
    e = np.where(inside, odds[at], 1.0)
    n = len(start)

    # What a block makes of a message: emission of its first token, then transition and emission of each other.
    whole = np.zeros((2, 2, n))
    whole[0, 0], whole[1, 1] = 1.0, e[0]
    for t in range(1, BLOCK):
        on = inside[t]
        if not on.any():
            break
        for row in (0, 1):
            x0, x1 = whole[row, 0] * a[0, 0] + whole[row, 1] * a[1, 0], (whole[row, 0] * a[0, 1] + whole[row, 1] * a[1, 1]) * e[t]
            whole[row, 0], whole[row, 1] = np.where(on, x0, whole[row, 0]), np.where(on, x1, whole[row, 1])
        whole /= whole.sum((0, 1))
    enter, leave = np.full((2, n), 0.5), np.full((2, n), 0.5)
    last = np.append(number[1:] == 0, True)
    for k in range(1, int(number.max()) + 1):  # messages from block to block, over all chains at once
        here = np.flatnonzero(number == k)
        x = np.einsum("in,ijn->jn", enter[:, here - 1], whole[:, :, here - 1])
        x = np.einsum("in,ij->jn", x, a)
        enter[:, here] = x / x.sum(0)
    for k in range(int(number.max()) - 1, -1, -1):
        here = np.flatnonzero((number == k) & ~last)
        x = np.einsum("ijn,jn->in", whole[:, :, here + 1], leave[:, here + 1])
        x = np.einsum("ij,jn->in", a, x)
        leave[:, here] = x / x.sum(0)

    fwd, back = np.empty((2, BLOCK, n)), np.empty((2, BLOCK, n))
    x0, x1 = enter[0], enter[1] * e[0]
    fwd[0, 0], fwd[1, 0] = x0 / (x0 + x1), x1 / (x0 + x1)
    for t in range(1, BLOCK):
        x0 = fwd[0, t - 1] * a[0, 0] + fwd[1, t - 1] * a[1, 0]
        x1 = (fwd[0, t - 1] * a[0, 1] + fwd[1, t - 1] * a[1, 1]) * e[t]
        fwd[0, t], fwd[1, t] = x0 / (x0 + x1), x1 / (x0 + x1)
    back[:, BLOCK - 1] = leave
    for t in range(BLOCK - 2, -1, -1):
        y0, y1 = back[0, t + 1], back[1, t + 1] * e[t + 1]
        x0, x1 = a[0, 0] * y0 + a[0, 1] * y1, a[1, 0] * y0 + a[1, 1] * y1
        on = inside[t + 1]  # a block's last token has the message that leaves it
        back[0, t], back[1, t] = np.where(on, x0 / (x0 + x1), leave[0]), np.where(on, x1 / (x0 + x1), leave[1])
    f, b = (x.transpose(0, 2, 1)[:, inside.T] for x in (fwd, back))  # by token
    top = f * b
    p = top[1] / top.sum(0)
    later = np.ones(len(emit), bool)
    later[first[:-1][np.diff(first) > 0]] = False
    later = np.flatnonzero(later)
    pair = np.stack([f[i, later - 1] * a[i, j] * b[j, later] * (odds[later] if j else 1.0) for i in (0, 1) for j in (0, 1)])
    return p, (pair / pair.sum(0)).sum(1).reshape(2, 2)


def marginals(model: Model, w: Words) -> np.ndarray:
    """Probability that each token is toxic."""
    if not len(w.hash):
        return np.zeros(0)
    emit = model.bias + model.weight[feature_slots(word_features(w), w.doc)].sum(0)
    return forward_backward(emit, w.first, model.step)[0]


def document_features(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """What the document logistic sees: of the toxic mass, the highest marginal and the number of words."""
    n = np.diff(first)
    total = np.concatenate([[0.0], np.cumsum(p)])
    mass = total[first[1:]] - total[first[:-1]]
    high = np.zeros(len(n))
    full = np.flatnonzero(n)
    if len(full):
        high[full] = np.maximum.reduceat(p, first[:-1][full])
    rate = np.log((mass + 0.05) / (n + 5))
    return np.stack([np.ones(len(n)), np.log(mass + 0.05), rate, np.minimum(mass, 8) / 8, high, np.log1p(n) / 5], 1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; the first column is the constant."""
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[0] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        change = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w = w + change
        if np.abs(change).max() < 1e-6:
            break
    return w


def fit_field(slots: np.ndarray, first: np.ndarray, toxic: np.ndarray, steps: int = 200, batch: int = 64, rate: float = 0.3, seed: int = 5) -> Model:
    """The field's weights, from token labels: documents with a toxic token and three times as many others, each one chain; six epochs, and `steps` batches at least."""
    y, size = toxic.astype(float), np.diff(first)
    r = np.random.default_rng(seed)
    held = np.concatenate([[0], np.cumsum(toxic)])
    marked = held[first[1:]] > held[first[:-1]]
    with_toxic, rest = np.flatnonzero(marked), np.flatnonzero(~marked & (size > 0))
    use = np.concatenate([with_toxic, r.permutation(rest)[: 3 * len(with_toxic) + 500]])
    weight, step = np.zeros(TABLE), np.zeros((2, 2))
    weight_sq, step_sq = np.full(TABLE, 1e-4), np.full((2, 2), 1e-2)
    bias, bias_sq = -3.0, 1e-2
    for _ in range(max(6, -(-steps * batch // max(1, len(use))))):
        for at in range(0, len(use), batch):
            pick = use[at : at + batch]
            n = size[pick]
            own = np.concatenate([[0], np.cumsum(n)])
            tok = np.arange(own[-1]) + np.repeat(first[pick] - own[:-1], n)
            p, moves = forward_backward(weight[slots[:, tok]].sum(0) + bias, own, step)
            gap, chains = y[tok] - p, max(1.0, own[-1] / BLOCK)
            grad = np.bincount(slots[:, tok].ravel(), np.tile(gap, len(slots)), TABLE) / chains - 1e-5 * weight
            grad[0] = 0
            weight_sq += grad**2
            weight += rate * grad / np.sqrt(weight_sq)
            g = gap.sum() / chains
            bias_sq += g * g
            bias += rate * g / np.sqrt(bias_sq)
            later = np.ones(len(tok), bool)
            later[own[:-1]] = False
            b = np.flatnonzero(later)
            seen = np.bincount((2 * y[tok[b - 1]] + y[tok[b]]).astype(np.int64), minlength=4).reshape(2, 2)
            g2 = (seen - moves) / chains
            step_sq += g2**2
            step += 0.1 * g2 / np.sqrt(step_sq)
        use = r.permutation(use)
    return Model(weight, float(bias), step, np.zeros(0))


def _sliced(texts: list[str | None]) -> Iterator[tuple[int, Words]]:
    """Words of a slice of the texts at a time, with the number of its first text."""
    data, offsets = text_buffer(pa.array(texts, pa.large_string()))
    for i, j in slices(offsets):
        yield i, words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], NOT_ALNUM)


def fit(sample: list[tuple[str | None, int]], marked: np.ndarray, prior: float) -> Model:
    """The model from (text, toxic) rows; marked: sorted hashes of the words and word beginnings that mark toxic tokens."""
    empty = Model(np.zeros(TABLE), -30.0, np.zeros((2, 2)), np.array([np.log((prior + 1e-4) / (1 - prior + 1e-4)), 0, 0, 0, 0, 0]))
    fields, links = sample[::2], sample[1::2]
    if not len(marked) or len({y for _, y in fields}) < 2 or len({y for _, y in links}) < 2:
        return empty
    slots, toxic, sizes = [], [], []
    label = np.array([y for _, y in fields], bool)
    for i, w in _sliced([x for x, _ in fields]):
        features = word_features(w)
        slots.append(feature_slots(features, w.doc))
        toxic.append(label[i + w.doc] & np.isin(features, marked).any(0))
        sizes.append(np.diff(w.first))
    model = fit_field(np.concatenate(slots, 1), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), np.concatenate(toxic))
    seen = np.concatenate([document_features(marginals(model, w), w.first) for _, w in _sliced([x for x, _ in links])])
    link = fit_logistic(seen, np.array([y for _, y in links], float))
    return Model(model.weight.astype(np.float32), model.bias, model.step, link)


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic documents, clean documents) that hold each word or word beginning, summed over a task as far as memory bounds allow."""
    held: list[np.ndarray] = []
    size = 0

    def summed() -> np.ndarray:
        key, at = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
        return np.stack([key, *(np.bincount(at, np.concatenate([x[i] for x in held]).astype(float)).astype(np.uint64) for i in (1, 2))])

    def flush(x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in x], ["feature", "toxic", "clean"])

    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        label = np.asarray(batch.column("toxic"))
        for i, j in slices(offsets):
            w = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], NOT_ALNUM)
            f = word_features(w)
            for d in range(j - i):
                own = np.unique(f[:, w.first[d] : w.first[d + 1]])
                own = own[own != 0]
                yes = np.full(len(own), label[i + d], np.uint64)
                held.append(np.stack([own, yes, np.uint64(1) - yes]))
                size += len(own)
            if size > 2_000_000:
                held = [summed()]
                size = held[0].shape[1]
                if size > 1_000_000:
                    yield flush(held[0])
                    held, size = [], 0
    if held:
        yield flush(summed())


def _fit_in_task(prior: float, most_bytes: int):
    """For one task that gets the sample's texts and labels and the marking features, in any order: the model as one binary row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, str, int]] = []
        marked: list[np.ndarray] = []
        for batch in batches:
            kind, at = batch.column("feature").is_valid().to_numpy(zero_copy_only=False), batch.column("at")
            marked.append(batch.column("feature").drop_null().to_numpy().view(np.uint64))
            for i in np.flatnonzero(~kind).tolist():
                rows.append((at[i].as_py(), batch.column("text")[i].as_py() or "", batch.column("toxic")[i].as_py()))
        rows.sort(key=lambda r: (r[0], r[1]))
        size, sample = 0, []
        for _, text, toxic in rows:
            size += len(text)
            if size > most_bytes and sample:
                break
            sample.append((text, toxic))
        model = fit(sample, np.unique(np.concatenate(marked)) if marked else np.zeros(0, np.uint64), prior)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    return run


def _feature_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct features of the texts of a batch's slice."""
    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        for i, j in slices(offsets):
            own = np.unique(word_features(words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], NOT_ALNUM)))
            yield pa.RecordBatch.from_arrays([pa.array(own[own != 0].view(np.int64))], ["feature"])


def toxicity(
    documents: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    folds: int = 5,
    sample_docs: int = 8000,
    sample_chars: int = 64_000_000,
    broadcast_rows: int = 1_000_000,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row for each row of `documents`: doc_id, held_out, score, predicted, mass, spans, and the columns named in `carry`.

    held_out is crc32(id as text) mod `folds` = 0; labels of such rows are never read.
    score is the probability that the label is 1, predicted is score >= 0.5, mass the
    expected number of toxic tokens, spans the runs of tokens with a marginal of 0.5 or
    more as start:end in code points, comma-joined. Word statistics, and so what marks a
    token, cover all labelled training rows; the fit uses whole texts of at most
    `sample_docs` of them, picked by a hash of their ids, and of no more than
    `sample_chars` together but for the first. Up to `broadcast_rows` training labels
    are broadcast, some 100 MB at most; with more both sides shuffle. Null and empty texts get the score of a
    text without words. Without labels of both kinds every score is the share of label 1
    (0 if there is none). A repeated label counts as toxic if any says so; rows with a
    null id or label are not used; other columns are ignored.
    """
    spark = documents.sparkSession
    ship(spark)
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *carry)
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    train = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    train = train.where(fold != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, n_toxic = train.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()

    # Labels cover a part of the documents and grow with them: few enough are broadcast, so that no text is shuffled.
    labelled = F.broadcast(train) if n <= broadcast_rows else train.hint("merge")
    counts = docs.where("text IS NOT NULL").join(labelled, "doc_id").select("text", "toxic").mapInArrow(_feature_counts, "feature long, toxic long, clean long")
    counts = counts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    share = n_toxic / max(n, 1)
    expected = (F.col("toxic") + F.col("clean")) * share
    odds = (F.col("toxic") + 0.5) / (F.col("clean") + 0.5)
    z = (F.col("toxic") - expected) / F.sqrt(expected + 1e-9)
    strong = counts.where(F.col("toxic") >= 3).where(odds >= 4 * (n_toxic + 0.5) / (n - n_toxic + 0.5)).where(z >= 4).select("feature")

    # Ids of the sample are chosen by a hash before the join, so that only their texts move.
    part = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(max(1, n // sample_docs))) == 0
    rows = docs.where(part).join(train.where(part), "doc_id").select(F.xxhash64("doc_id").alias("at"), "text", "toxic").orderBy("at").limit(sample_docs)
    rows = checkpoint(rows)
    # Of all features that mark tokens the fit needs those of the sample's texts: as bounded as the sample.
    marking = rows.where("toxic = 1").select("text").mapInArrow(_feature_set, "feature long").distinct().join(strong, "feature", "left_semi")
    none = F.lit(None)
    both = rows.select("at", "text", "toxic", none.cast("long").alias("feature")).union(marking.select(none.cast("long"), none.cast("string"), none.cast("int"), "feature"))
    fitted = checkpoint(both.repartition(1).mapInArrow(_fit_in_task(share, sample_chars), "model binary"))
    model = fitted.first()
    shared = spark.sparkContext.broadcast(pickle.loads(model["model"]) if model else fit([], np.zeros(0, np.uint64), share))

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for i, j in slices(offsets):
                w = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], NOT_ALNUM)
                p = marginals(model, w)
                x = document_features(p, w.first)
                score = 1 / (1 + np.exp(-np.clip(x @ model.link, -30, 30)))
                total = np.concatenate([[0.0], np.cumsum(p)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(score), pa.array(np.round(total[w.first[1:]] - total[w.first[:-1]], 6)), pa.array(_spans(w, p, offsets[i : j + 1] - offsets[i]), pa.string()), *(batch.column(c).slice(i, j - i) for c in carry)],
                    ["doc_id", "score", "mass", "spans", *carry],
                )

    out = docs.mapInArrow(tag, ", ".join(["doc_id long, score double, mass double, spans string", *(f"{c} {docs.schema[c].dataType.simpleString()}" for c in carry)]))
    return out.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "mass", "spans", *carry)


def _spans(w: Words, p: np.ndarray, offsets: np.ndarray) -> list[str]:
    """Runs of neighbouring tokens with p >= 0.5, by text, as start:end in code points of the text."""
    out = [""] * (len(offsets) - 1)
    hit = np.flatnonzero(p >= 0.5)
    if not len(hit):
        return out
    points = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
    fresh = np.ones(len(hit), bool)
    fresh[1:] = (np.diff(hit) > 1) | (w.doc[hit[1:]] != w.doc[hit[:-1]])
    a, b = hit[fresh], hit[np.append(np.flatnonzero(fresh)[1:] - 1, len(hit) - 1)]
    base = points[offsets[w.doc[a]]]
    for d, x, y in zip(w.doc[a].tolist(), (points[w.start[a]] - base).tolist(), (points[w.end[b]] - base).tolist(), strict=True):
        out[d] += f",{x}:{y}" if out[d] else f"{x}:{y}"
    return out
