"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over all documents that may be learnt from; the regression is
fitted by follow-the-regularised-leader on at most max_train of them, chosen by a hash of their
ids, and its temperature on a part of these that the fit leaves out.

Defined results for odd rows: a null text, or one without a letter, is und with score 0; a null
lang isn't learnt from; a null doc_id counts as not held out and isn't learnt from; with nothing
to learn all are und; repeated rows are judged one by one; of equal scores the first language in
alphabetical order wins; extra columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.blocks import cuts, flat, texts, with_column
from tallyline.llm.ftrl import Ftrl, probabilities, train

ORDERS = (1, 2, 3)
BITS = 16
BINS = 1 << BITS
MAX_TRAIN = 12_000
#: Languages at most: the driver holds a weight for each of them and every bin.
MAX_LANGS = 1000
#: One in so many of the sample is kept for the temperature.
CALIBRATE = 5
TEMPERATURES = np.round(np.geomspace(0.1, 10, 41), 4)
SETTINGS = Ftrl(alpha=0.5, l1=0.05, l2=0.05, rounds=3, shards=4)
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
MIX = np.uint64(0x9E3779B97F4A7C15)


def ngrams(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Offsets of the texts in lower-case characters, and for each order the bin at each character; BINS where a text ends."""
    lower = [t.lower() for t in column.to_pylist()]
    edges = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(t) for t in lower], dtype=np.int64)])
    points = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out, h = [], np.zeros(len(points), np.uint64)
    for k in ORDERS:
        h = h[: len(points) - k + 1] * np.uint64(0x100000001B3) + points[k - 1 :] if len(points) >= k else h[:0]
        bins = np.full(len(points), BINS, np.int64)
        bins[: len(h)] = (((h + np.uint64(k)) * MIX) >> np.uint64(64 - BITS)).astype(np.int64)
        for back in range(1, k):
            at = edges[1:] - back
            bins[at[at >= edges[:-1]]] = BINS
        out.append(bins)
    return edges, out


def document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bin, df) of a partition, and the number of its texts as bin -1."""
    df, total = np.zeros(BINS, np.int64), 0
    for batch in batches:
        column = texts(batch)
        _, offsets = flat(column)
        for i, j in cuts(offsets):
            edges, grams = ngrams(column[i:j])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                seen = np.zeros(BINS + 1, bool)
                for bins in grams:
                    seen[bins[a:b]] = True
                df += seen[:BINS]
        total += batch.num_rows
    used = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(df[used], total))], names=["bin", "df"])


def vectors(idf) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds at and values: the bins of a text and count / sqrt(all its n-grams) x IDF."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = idf.value
        for batch in batches:
            at, values = [], []
            for text in texts(batch).to_pylist():
                _, grams = ngrams(pa.array([text], pa.large_string()))
                bins, counts = np.unique(np.concatenate(grams), return_counts=True)
                bins, counts = bins[bins < BINS], counts[bins < BINS]
                at.append(bins)
                values.append(counts / np.sqrt(max(1, counts.sum())) * weight[bins])
            yield with_column(batch, at=pa.array(at, pa.list_(pa.int64())), values=pa.array(values, pa.list_(pa.float64())))

    return run


@dataclass(frozen=True)
class LanguageModel:
    """Languages in order, TF-IDF weights (bins + 1, languages) and the temperature of their scores."""

    langs: list[str]
    weights: np.ndarray
    temperature: float


def fold(of: Column) -> Column:
    """0 where a document is held out."""
    return F.pmod(F.crc32(of.cast("string")), F.lit(5))


def learn(docs: DataFrame, max_train: int = MAX_TRAIN, settings: Ftrl = SETTINGS) -> LanguageModel | None:
    """Fit on documents that aren't held out and have a lang."""
    from tallyline.session import forget, written

    sc = docs.sparkSession.sparkContext
    usable = docs.where((fold(F.col("doc_id")) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    langs = sorted(r["lang"] for r in usable.select("lang").distinct().limit(MAX_LANGS + 1).collect())
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} values of lang: these are no languages, or MAX_LANGS is to be raised with the driver's memory")
    if not langs:
        return None
    counts = usable.select("text").mapInArrow(document_frequency, "bin bigint, df bigint").groupBy("bin").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(BINS + 1)
    for r in counts:
        df[r["bin"]] = r["df"]  # -1, the last, has the number of texts
    total = df[-1]
    idf = np.append(np.log((total + 1) / (df[:-1] + 1)) + 1, 0.0)
    share = 1 << 30
    cut = share if total <= max_train else int(share * 0.98 * max_train / total)
    shared = sc.broadcast(idf)
    codes = F.array_position(F.lit(langs), F.col("lang")) - 1
    sample = usable.withColumn("key", F.xxhash64("doc_id", F.lit("language"))).where(F.pmod("key", F.lit(share)) < cut).withColumn("y", codes)
    sample = sample.select("key", "y", "text")
    rows = written(
        sample.mapInArrow(vectors(shared), "key bigint, y bigint, text string, at array<bigint>, values array<double>").drop("text"), "language-sample"
    )
    kept_out = F.pmod(F.floor(F.col("key") / 1024), F.lit(CALIBRATE)) == 0
    weights = train(rows.where(~kept_out), len(langs), BINS, settings)
    table = np.vstack([weights.T, np.zeros((1, len(langs)))])
    losses = rows.where(kept_out).mapInArrow(_losses(sc.broadcast(table)), "k bigint, loss double").groupBy("k").agg(F.sum("loss").alias("loss")).collect()
    best = min(losses, key=lambda r: (r["loss"], r["k"]))["k"] if losses else int(np.argmin(np.abs(TEMPERATURES - 1)))
    forget(rows)
    return LanguageModel(langs, (table * idf[:, None]).astype(np.float32), float(TEMPERATURES[best]))


def _losses(weights) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Negative log likelihood of a partition at each temperature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, loss = weights.value, np.zeros(len(TEMPERATURES))
        for batch in batches:
            for y, at, values in zip(*(batch.column(c) for c in ("y", "at", "values")), strict=True):
                scores = values.values.to_numpy() @ w[at.values.to_numpy()]
                p = probabilities(np.append(scores, -1e9)[None, :] / TEMPERATURES[:, None])
                loss -= np.log(np.maximum(p[:, y.as_py()], 1e-12))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(loss)), pa.int64()), pa.array(loss)], names=["k", "loss"])

    return run


def predictor(model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        names = np.array([*m.langs, UNKNOWN], object)
        for batch in batches:
            column = texts(batch)
            _, offsets = flat(column)
            best, score = np.full(batch.num_rows, len(m.langs)), np.zeros(batch.num_rows)
            for i, j in cuts(offsets, 1 << 20):
                some = column[i:j]
                edges, grams = ngrams(some)
                at = edges[:-1][edges[1:] > edges[:-1]]
                full = np.flatnonzero(edges[1:] > edges[:-1])
                if not len(at):
                    continue
                total = sum(np.add.reduceat(m.weights[bins], at, axis=0, dtype=np.float64) for bins in grams)
                n = sum(np.add.reduceat(bins < BINS, at, dtype=np.int64) for bins in grams)
                p = probabilities(np.hstack([total / np.sqrt(np.maximum(n, 1))[:, None] / m.temperature, np.full((len(at), 1), -1e9)]))
                lettered = np.array([LETTER.search(t) is not None for t in some.take(pa.array(full)).to_pylist()])
                best[i + full[lettered]] = p[lettered].argmax(1)
                score[i + full[lettered]] = p[lettered].max(1)
            yield with_column(batch, lang_pred=pa.array(names[best], pa.string()), score=pa.array(np.clip(score, 0, 1)))

    return run


def identified(docs: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """Add held_out, lang_pred and score; a prediction looks at the text alone."""
    model = learn(docs, max_train)
    docs = docs.drop("held_out", "lang_pred", "score")
    held_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    if model is None:
        return docs.withColumns({"held_out": held_out, "lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    return docs.mapInArrow(predictor(shared), schema).withColumn("held_out", held_out)


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    from tallyline.session import let_workers_import, table

    let_workers_import(spark)
    return identified(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")
