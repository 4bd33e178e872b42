"""Toxic spans by a linear-chain conditional random field, and documents' scores from its marginals.

Labels are of whole documents, so words are labelled first: a word is toxic where it stands in a
toxic document and is found there far oftener than in other documents (a word of few documents:
than in others is its longest beginning that stands in enough of them). Of a document's words only
those near its highest odds count: they explain the label, others may have come along in copies. The field has two states and learns from windows of ``WINDOW`` words; a window
starts after and ends before a harmless state. Forward-backward gives each word's marginal and
each window's exact probability that no word of it is toxic. A document's evidence is the strongest
window, the expected number of toxic words and the length; a logistic fit on labelled documents that
taught neither words nor field turns it into a score. Words of a marginal of a half or more
are the offending spans (code points, neighbours joined).

The classifier is fitted on a bounded sample: per label the ``SAMPLE_DOCS`` documents of the smallest
hashes of their ids (three quarters teach, one quarter calibrates) and ``SAMPLE_WINDOWS`` windows per
state. Counts over the sample are made in tasks, in ``BUCKETS`` hashed features. Every text is then
scored whole, in one pass without a shuffle; of the model's 32 MB (8 bytes a feature) what is not empty is broadcast.

Defined results: a null or empty text has no words and gets the score of that evidence; a null ``doc_id`` is
not held out and never in the sample; of several labels of an id the largest counts, null labels
don't; without toxic or without other labelled documents every score is the toxic share
(0 without labels); repeated rows are scored one by one; an empty table gives an empty result;
``lang``, ``source`` and other columns are not read; those asked for pass through.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.common import per_worker, stored

#: Documents per label that the classifier is fitted on, and windows per state.
SAMPLE_DOCS, SAMPLE_WINDOWS = 8192, 3000
#: Words of a window, hashed features, and words that a worker remembers.
WINDOW, BUCKETS, REMEMBERED = 64, 1 << 22, 400_000
#: A word is labelled by a log odds of that much with that much evidence (twice the log likelihood ratio), and by its
#: beginning if fewer documents hold it.
SURE_ODDS, SURE_EVIDENCE, ENOUGH_DOCS = 1.5, 25.0, 8
#: Log odds that a labelled word may lie below the highest of its document.
MARGIN = 1.5
WORDS = re.compile(r"[^\W\d_]+")


def bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)


def spellings(word: str) -> list[int]:
    """Features of a word as such: itself, its beginnings from long to short, and its end."""
    w = word.lower()
    return [bucket("w" + w), *(bucket("b" + w[:k]) for k in (5, 4, 3) if len(w) >= k), bucket("e" + w[-3:])]


def weighed_odds(toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int) -> np.ndarray:
    """Log odds per feature, shrunk where the evidence is below what is called sure; no number for those of few documents."""
    a, b = toxic.astype(float), other.astype(float)
    odds = np.log((a + 0.5) / (n_toxic + 1)) - np.log((b + 0.5) / (n_other + 1))
    share = n_toxic / (n_toxic + n_other)
    with np.errstate(divide="ignore", invalid="ignore"):
        by_chance = np.nan_to_num(a * np.log(a / ((a + b) * share))) + np.nan_to_num(b * np.log(b / ((a + b) * (1 - share))))
    return np.where(a + b < ENOUGH_DOCS, np.nan, odds * np.clip(2 * by_chance / SURE_EVIDENCE, 0, 1)).astype(np.float32)


@dataclass
class Model:
    odds: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS, np.float32))
    bias: float = -4.0
    #: Scores of going from harmless to toxic, back, and of staying toxic; staying harmless is 0.
    moves: tuple[float, float, float] = (0.0, 0.0, 0.0)
    #: Of the score: constant, strongest window, expected toxic words, length.
    logistic: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def packed(self) -> dict:
        """What is to be sent: of tables that are mostly empty, the rest."""
        odds, weights = np.flatnonzero(~np.isnan(self.odds)).astype(np.uint32), np.flatnonzero(self.weights).astype(np.uint32)
        return vars(self) | {"odds": (odds, self.odds[odds]), "weights": (weights, self.weights[weights])}

    @classmethod
    def unpacked(cls, sent: dict) -> Model:
        odds, weights = np.full(BUCKETS, np.nan, np.float32), np.zeros(BUCKETS, np.float32)
        odds[sent["odds"][0]], weights[sent["weights"][0]] = sent["odds"][1], sent["weights"][1]
        return cls(**sent | {"odds": odds, "weights": weights})

    def own(self, word: str) -> tuple[list[int], float]:
        """A word's features, and its log odds: those of its longest spelling that enough documents hold."""
        ids = spellings(word)
        odds = next((x for x in self.odds[ids[:-1]].tolist() if x == x), 0.0)
        return [*ids, bucket(f"q{int(min(max(odds, -0.5), 6.0) * 2)}")], odds

    def beside(self, word: str) -> tuple[int, int]:
        """Features that a word gives to the next and to the one before."""
        w = word.lower()
        return bucket("p" + w), bucket("n" + w)


def forward_backward(e: np.ndarray, moves: Sequence[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of windows (columns) with the odds ``e`` of their words (rows; 0 beyond the end): marginals, the backward
    odds, and minus the log probability that all are harmless. Odds of the two states are carried, which needs no scaling."""
    to, back, stay = np.exp(moves)
    ahead, nothing = np.zeros_like(e), np.zeros(e.shape[1])
    r = np.zeros(e.shape[1])
    for t in range(len(e)):
        z = 1 + r * back
        nothing += np.log(z)
        r = e[t] * (to + r * stay) / z
        ahead[t] = r
    nothing += np.log1p(r * back)
    b = np.full_like(e, back)
    for t in range(len(e) - 2, -1, -1):
        x = e[t + 1] * b[t + 1]
        b[t] = (back + stay * x) / (1 + to * x)
    odds = ahead * b
    return odds / (1 + odds), b, nothing


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of so many words in a row: the text of each window, the places of its words (a column each), and which are words."""
    n = -(-lengths // WINDOW)
    text = np.repeat(np.arange(len(lengths)), n)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    first = (np.cumsum(lengths) - lengths)[text] + nth * WINDOW
    place = first + np.arange(WINDOW)[:, None]
    real = np.arange(WINDOW)[:, None] < np.minimum(lengths[text] - nth * WINDOW, WINDOW)
    return text, np.where(real, place, 0), real


class Reader:
    """Scores texts; keeps what the model says of words that it has seen."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.told = [array("f") for _ in range(3)]

    def learn(self, word: str) -> int:
        m = self.model
        self.told[0].append(float(m.weights[m.own(word)[0]].sum()) + m.bias)
        for k, f in enumerate(m.beside(word), 1):
            self.told[k].append(float(m.weights[f]))
        return self.place.setdefault(word, len(self.place))

    def read(self, texts: Sequence[str]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        """Evidence (a row per text) and spans."""
        if len(self.place) > REMEMBERED:
            self.forget()
        seen, codes, lengths = self.place.get, [], []
        for text in texts:
            words = WORDS.findall(text)
            found = list(map(seen, words))
            if None in found:
                found = [self.learn(w) if (k := seen(w)) is None else k for w in words]
            codes.append(np.fromiter(found, np.int32, len(found)))
            lengths.append(len(found))
        lengths = np.array(lengths)
        evidence = np.column_stack([np.zeros(len(texts)), np.zeros(len(texts)), lengths])
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        if not lengths.sum():
            return evidence, spans
        own, to_next, to_last = (np.frombuffer(x, np.float32) for x in self.told)
        flat = np.concatenate(codes)
        text, place, real = windows(lengths)
        at = flat[place]
        score = own[at].astype(float)
        score[1:] += to_next[at[:-1]]
        score[:-1] += np.where(real[1:], to_last[at[1:]], 0)
        toxic, _, nothing = forward_backward(np.where(real, np.exp(np.minimum(score, 30)), 0), self.model.moves)
        np.maximum.at(evidence[:, 0], text, nothing)
        np.add.at(evidence[:, 1], text, toxic.sum(0))
        mark = np.zeros(len(flat), bool)
        mark[place[real]] = toxic[real] >= 0.5
        ends = np.cumsum(lengths)
        for k in np.unique(np.searchsorted(ends, np.flatnonzero(mark), "right")):
            hits, last = mark[ends[k] - lengths[k] : ends[k]], -2
            for nth, word in enumerate(WORDS.finditer(texts[k])):
                if hits[nth]:
                    if nth == last + 1:
                        spans[k][-1] = (spans[k][-1][0], word.end())
                    else:
                        spans[k].append(word.span())
                    last = nth
        return evidence, spans


def logistic_inputs(evidence: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(evidence)), np.log(evidence[:, :2] + 1e-4), np.log1p(evidence[:, 2])])


def fit_logistic(evidence: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Weighted logistic regression by Newton steps; few examples leave it near an even mix of both kinds of evidence."""
    x, usual = logistic_inputs(evidence), np.array([0.0, 0.5, 0.5, 0.0])
    beta, ridge = usual.copy(), np.diag([0.1, 1.0, 1.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge
        step = np.linalg.solve(hessian, x.T @ (weight * (y - p)) - ridge @ (beta - usual))
        beta += step * min(1, 2 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, beta))


def fit_field(model: Model, rows: Sequence[tuple[list[str], bytes]], steps: int = 60, rate: float = 0.3, decay: float = 1e-4) -> None:
    """Weights and moves by the likelihood of labelled windows: gradients from forward-backward, steps scaled per feature."""
    known: dict[str, tuple] = {}
    for words, _ in rows:
        for w in words:
            if w not in known:
                known[w] = (model.own(w)[0], *model.beside(w))
    width = 8  # up to six features of its own and two from its neighbours
    n = len(rows)
    ids, y, real = np.full((n, WINDOW, width), BUCKETS, np.int32), np.zeros((n, WINDOW)), np.zeros((n, WINDOW), bool)
    for k, (words, toxic) in enumerate(rows):
        m = len(words)
        real[k, :m], y[k, :m] = True, np.frombuffer(toxic, np.uint8)
        for t, w in enumerate(words):
            own, to_next, to_last = known[w]
            ids[k, t, : len(own)] = own
            if t + 1 < m:
                ids[k, t + 1, 6] = to_next
            if t:
                ids[k, t - 1, 7] = to_last
    ids, y, real = ids.transpose(1, 0, 2), y.T, real.T
    used, where = np.unique(ids, return_inverse=True)
    where, pad = where.reshape(ids.shape), used == BUCKETS
    before = np.vstack([np.zeros((1, n)), y])
    after = np.vstack([y, np.zeros((1, n))])
    seen_moves = np.array([((1 - before) * after).sum(), (before * (1 - after)).sum(), (before * after).sum()])
    theta = np.zeros(len(used) + 4)
    theta[-4] = model.bias
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, moves = np.where(pad, 0, theta[:-4]), theta[-3:]
        e = np.where(real, np.exp(np.minimum(w[where].sum(-1) + theta[-4], 30)), 0)
        p, b, _ = forward_backward(e, moves)
        to, back, stay = np.exp(moves)
        was = np.vstack([np.zeros((1, n)), p])
        x = np.vstack([e * b, np.zeros((1, n))])
        staying = was * stay * x / (back + stay * x)
        made = np.array([((1 - was) * to * x / (1 + to * x)).sum(), (was - staying).sum(), staying.sum()])
        slip = np.where(real, p - y, 0)
        grad = np.concatenate([np.bincount(where.ravel(), np.repeat(slip.ravel(), width), len(used)), [slip.sum()], made - seen_moves]) / n + decay * theta
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        theta -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    real_ids = used[~pad]
    model.weights[real_ids] = theta[:-4][~pad]
    model.bias, model.moves = float(theta[-4]), tuple(map(float, theta[-3:]))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; of a null id null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a task that hold a feature, by label; and, as feature -1, all of them."""
    counts, n, known = np.zeros((2, BUCKETS), np.int32), [0, 0], {}
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            found: set[int] = set()
            for w in set(WORDS.findall(text or "")):
                found.update(known.get(w) or known.setdefault(w, spellings(w)))
            counts[toxic, list(found)] += 1
            n[toxic] += 1
            if len(known) > REMEMBERED:
                known.clear()
    there = np.flatnonzero(counts.sum(0))
    yield pa.RecordBatch.from_pydict({"feature": [-1, *there.tolist()], "toxic": [n[1], *counts[1, there].tolist()], "other": [n[0], *counts[0, there].tolist()]})


def labelled_windows(shared):
    """Windows of a document as words and labels, with the state that they are an example of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, odds = Model.unpacked(shared.value), {}
        for batch in batches:
            out: list[tuple] = []
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                words = WORDS.findall(text or "")
                if len(odds) > REMEMBERED:
                    odds.clear()
                told = [odds[w] if w in odds else odds.setdefault(w, model.own(w)[1]) for w in words] if toxic else [0.0] * len(words)
                least = max(SURE_ODDS, max(told, default=0.0) - MARGIN)
                for at in range(0, len(words), WINDOW):
                    marks = bytes(x >= least for x in told[at : at + WINDOW])
                    out.append((any(marks), words[at : at + WINDOW], marks))
            names = ["example", "words", "marks"]
            columns = list(zip(*out, strict=True)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.bool_(), pa.list_(pa.string()), pa.binary()), strict=True)], names=names)

    return run


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_windows: int = SAMPLE_WINDOWS) -> Model | float:
    """The model, or the toxic share where one of the labels is missing."""
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    taught = stored(known.where(crc_mod(F.col("doc_id"), 5) != 0), "toxic-labels")
    sizes = {r.toxic: r["count"] for r in taught.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return float(1 in sizes)
    ranked = taught.withColumn("h", F.xxhash64(F.col("doc_id").cast("string")))
    drawn = [ranked.where(F.col("toxic") == k).orderBy("h", "doc_id").limit(sample_docs) for k in (0, 1)]
    picked = stored(docs.select("doc_id", "text").join(F.broadcast(drawn[0].unionByName(drawn[1])), "doc_id"), "toxic-sample")  # two times sample_docs ids
    teach, calibrate = picked.where("pmod(h, 4) != 0").select("text", "toxic"), picked.where("pmod(h, 4) = 0").select("text", "toxic")

    counted = teach.mapInArrow(feature_counts, "feature long, toxic long, other long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).where(f"feature < 0 or toxic + other >= {ENOUGH_DOCS}").toPandas()  # BUCKETS rows at most
    total = counted[counted.feature == -1]
    table = np.zeros((2, BUCKETS), np.int32)
    table[:, counted.feature[counted.feature >= 0]] = counted.loc[counted.feature >= 0, ["toxic", "other"]].to_numpy().T
    if not len(total) or not total.toxic.sum() or not total.other.sum():
        return sizes[1] / (sizes[0] + sizes[1])
    model = Model(weighed_odds(table[0], table[1], int(total.toxic.iloc[0]), int(total.other.iloc[0])))

    shared = spark.sparkContext.broadcast(model.packed())
    cut = teach.mapInArrow(labelled_windows(shared), "example boolean, words array<string>, marks binary")
    rank = F.xxhash64("words", "marks")
    rows = [r for k in (True, False) for r in cut.where(F.col("example") == k).orderBy(rank).limit(sample_windows).select("words", "marks").collect()]
    shared.destroy()
    if rows:
        fit_field(model, [(r.words, bytes(r.marks)) for r in rows])

    shared = spark.sparkContext.broadcast(model.packed())
    judged = calibrate.mapInArrow(lambda b: evidence_of(b, shared), "toxic int, strongest double, expected double, n_words double").toPandas()  # under two times sample_docs rows
    shared.destroy()
    y = judged.toxic.to_numpy(float)
    if not 0 < y.sum() < len(y):
        return sizes[1] / (sizes[0] + sizes[1])
    weight = np.where(y > 0, sizes[1] / y.sum(), sizes[0] / (len(y) - y.sum()))
    model.logistic = fit_logistic(judged[["strongest", "expected", "n_words"]].to_numpy(float), y, weight * len(y) / weight.sum())
    return model


def slices(batch: pa.RecordBatch, rows: int = 128) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def evidence_of(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    reader = Reader(Model.unpacked(shared.value))
    for whole in batches:
        for batch in slices(whole):
            e = reader.read([t or "" for t in batch.column("text").to_pylist()])[0]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *(pa.array(c) for c in e.T)], names=["toxic", "strongest", "expected", "n_words"])


def with_toxicity(docs: DataFrame, model: Model | float, text_col: str = "text") -> DataFrame:
    """Add ``score``, ``predicted`` and ``toxic_spans`` to each row; no shuffle."""
    if not isinstance(model, Model):
        none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
        return docs.drop("score", "predicted", "toxic_spans").select("*", F.lit(float(model)).alias("score"), F.lit(int(model >= 0.5)).alias("predicted"), none.alias("toxic_spans"))
    spans_type = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    added = {"score": T.DoubleType(), "predicted": T.IntegerType(), "toxic_spans": spans_type}
    before = [f for f in docs.schema.fields if f.name not in added]
    names = [f.name for f in before]
    shared = docs.sparkSession.sparkContext.broadcast(model.packed())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = per_worker("toxicity", shared.value["name"], lambda: Reader(Model.unpacked(shared.value)))
        for whole in batches:
            for batch in slices(whole):
                evidence, spans = reader.read([t or "" for t in batch.column("__text").to_pylist()])
                score = 1 / (1 + np.exp(-np.clip(logistic_inputs(evidence) @ np.array(reader.model.logistic), -50, 50)))
                marked = pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), marked], names=[*names, *added])

    return docs.select(*names, F.col(text_col).alias("__text")).mapInArrow(run, T.StructType([*before, *(T.StructField(k, t) for k, t in added.items())]))
