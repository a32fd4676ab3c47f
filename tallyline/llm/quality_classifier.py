"""Quality classifier: document evidence combined with hosts' and paths' posteriors by empirical Bayes.

Two logistic models, of low quality and of toxicity, read words and coarse shapes of whole texts.
Their probabilities are summed by host and by path within the host; each path's rate is shrunk
toward its host's and each host's toward the corpus's, the more so the fewer documents it has, and
moves the documents' own log odds. All sums run over all documents; only the two models' fit is
bounded: it uses at most max_train labelled documents, chosen by a hash of their ids. Every text is
scored once: the scores are written, and the sums and the result are made of that table.

The given documents have no URLs. Their source stands for the host, and their language for the path
below it, as sites keep their languages in folders of their own; both are arguments.

Defined results for odd rows: a null or empty text is judged by its shape alone; null hosts and
paths are groups of their own; labels without a document, and null labels, don't count; of several
labels of a document the worse counts; without both classes of a label its rate holds for all;
repeated documents are judged one by one; extra columns pass through, those named like results
are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.blocks import cuts, flat, texts, with_column
from tallyline.llm.decontamination import Words
from tallyline.llm.ftrl import Ftrl, probabilities, train
from tallyline.session import forget, let_workers_import, table, written

#: Labelled documents that the fit uses at most.
MAX_TRAIN = 12_000
#: Bins of hashed words and of their first bytes, and after them those of the shapes.
BITS = 18
SHAPES, STEPS = 7, 24
BINS = (1 << BITS) + SHAPES * STEPS + 1
PREFIXES = (4, 5, 6, 7)
#: Each kind of fault: the label's column and the value that shows it.
FAULTS = {"low": ("quality", 0), "toxic": ("toxic", 1)}
CLIP = 1e-6
SETTINGS = Ftrl(alpha=0.4, l1=1.5, l2=0.2, rounds=6, shards=4)
SIGN = np.isin(np.arange(256), np.frombuffer(b"#*$%&<>", np.uint8))
CAPITAL = np.isin(np.arange(256), np.arange(65, 91))
SALT = np.uint64(0x9E3779B97F4A7C15)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bin) of each distinct feature of a block's texts, sorted: words, their first bytes, shapes in steps, and one that all have."""
    w, n = Words(data, offsets), len(offsets) - 1
    words = np.diff(w.before)
    text = np.repeat(np.arange(n), words)
    mixed = w.hashes + text.astype(np.uint64) * SALT
    order = np.argsort(mixed)
    first = order[np.append(True, np.diff(mixed[order]) != 0)] if len(order) else order
    of, bins = [text[first]], [w.hashes[first] >> np.uint64(64 - BITS)]
    starts, ends = w.starts[first], w.ends[first]
    for k in PREFIXES:
        long = ends - starts > k
        h = w.hasher.of(starts[long], starts[long] + k)
        of.append(text[first][long])
        bins.append((h + np.uint64(k)) * SALT >> np.uint64(64 - BITS))
    raw = data[offsets[0] : offsets[-1]]
    inner = offsets - offsets[0]

    def count(marked: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([np.zeros(1, np.int64), np.cumsum(marked)])[inner])

    some, size = np.maximum(words, 1), np.maximum(np.diff(inner), 1)
    distinct = np.bincount(text[first], minlength=n) / some
    again = np.zeros(len(w.hashes), bool)
    again[1:] = (w.hashes[1:] == w.hashes[:-1]) & (text[1:] == text[:-1])
    shapes = (
        distinct * STEPS, np.bincount(text[again], minlength=n) / some * 2 * STEPS, count(SIGN[raw]) / some * 10, count(raw == 124) / some * 10,
        count(raw == 33) / some * 10, count(CAPITAL[raw]) / size * 40, np.log2(some) * 1.5,
    )
    for k, share in enumerate(shapes):
        # Each step that is reached counts, so that what is learnt of some shares tells of those above them.
        reached = np.minimum(share.astype(np.int64), STEPS - 1) + 1
        each = np.repeat(np.arange(n), reached)
        of.append(each)
        bins.append(((1 << BITS) + k * STEPS + np.arange(len(each)) - np.repeat(np.cumsum(reached) - reached, reached)).astype(np.uint64))
    of.append(np.arange(n))
    bins.append(np.full(n, BINS - 1, np.uint64))
    keys = np.sort(np.concatenate(of).astype(np.uint64) * np.uint64(BINS) + np.concatenate(bins))
    keys = keys[np.append(True, keys[1:] != keys[:-1])]
    return (keys // np.uint64(BINS)).astype(np.int64), (keys % np.uint64(BINS)).astype(np.int64)


def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds at and values for the fit."""
    for batch in batches:
        data, offsets = flat(texts(batch))
        at = []
        for i, j in cuts(offsets):
            of, bins = features(data, offsets[i : j + 1])
            at += np.split(bins, np.searchsorted(of, np.arange(1, j - i)))
        yield with_column(batch, at=pa.array(at, pa.list_(pa.int64())), values=pa.array([np.ones(len(x)) for x in at], pa.list_(pa.float64())))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, settings: Ftrl = SETTINGS) -> np.ndarray:
    """Weights (bins, faults), fitted on labelled documents; the sample of labels is bounded, so it may be broadcast.

    A fault whose labels have one class alone gets their rate as everyone's score.
    """
    worst = [F.max(F.when(F.col(c) == bad, 1).when(F.col(c).isNotNull(), 0)).alias(k) for k, (c, bad) in FAULTS.items()]
    each = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*worst)
    total, share = each.count(), 1 << 30
    cut = share if total <= max_train else int(share * 0.98 * max_train / total)
    sample = each.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) < cut)
    faults = ", ".join(f"{k} int" for k in FAULTS)
    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select(F.xxhash64("doc_id", "text").alias("key"), *FAULTS, "text")
    rows = written(joined.mapInArrow(vectors, f"key bigint, {faults}, text string, at array<bigint>, values array<double>").drop("text"), "quality-sample")
    weights = np.zeros((BINS, len(FAULTS)))
    for i, k in enumerate(FAULTS):
        have = rows.where(F.col(k).isNotNull()).select("key", F.col(k).cast("long").alias("y"), "at", "values")
        n, bad = have.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
        if 0 < bad < n:
            weights[:, i] = train(have, 1, BINS, settings)[0]
        else:
            rate = min(max(bad / max(n, 1), CLIP), 1 - CLIP)
            weights[BINS - 1, i] = np.log(rate / (1 - rate))
    forget(rows)
    return weights.astype(np.float32)


def scorer(weights) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(texts(batch))
            p = np.zeros((batch.num_rows, len(FAULTS)))
            for i, j in cuts(offsets):
                of, bins = features(data, offsets[i : j + 1])
                p[i:j] = np.add.reduceat(weights.value[bins], np.searchsorted(of, np.arange(j - i)), axis=0, dtype=np.float64)
            p = np.clip(probabilities(p[:, :, None])[:, :, 0], CLIP, 1 - CLIP)
            yield with_column(batch, **{f"p_{k}": pa.array(p[:, i]) for i, k in enumerate(FAULTS)})

    return run


def scored(docs: DataFrame, weights: np.ndarray, with_text: bool = True) -> DataFrame:
    """Add p_low and p_toxic, what the text alone says; the text itself stays if asked for."""
    named = docs.withColumns({f"p_{k}": F.lit(0.0) for k in FAULTS})
    out = docs.mapInArrow(scorer(docs.sparkSession.sparkContext.broadcast(weights)), named.schema)
    return out if with_text else out.drop("text")


def strength(rate: float, spread: float, inverse: float) -> float:
    """Pseudo-documents of a beta prior, by moments: what spread of rates is left beyond chance."""
    chance = rate * (1 - rate)
    beyond = spread - chance * inverse
    return min(1e6, max(1.0, chance / beyond - 1)) if beyond > 0 else 1e6


def sites(scores: DataFrame, host: str, path: str) -> DataFrame:
    """Per (host, path): the counts, sums and priors from which each document's site rates follow."""
    sums = [F.sum(f"p_{k}").alias(f"s_{k}") for k in FAULTS]
    paths = written(scores.groupBy(F.col(host).alias("__tl_host"), F.col(path).alias("__tl_path")).agg(F.count(F.lit(1)).alias("n"), *sums), "sites")
    hosts = paths.groupBy("__tl_host").agg(F.sum("n").alias("n_host"), *(F.sum(f"s_{k}").alias(f"h_{k}") for k in FAULTS))
    both = paths.join(hosts.withColumnRenamed("__tl_host", "__tl_h"), F.col("__tl_host").eqNullSafe(F.col("__tl_h"))).drop("__tl_h")
    total = hosts.agg(F.sum("n_host").alias("n"), *(F.sum(f"h_{k}").alias(f"s_{k}") for k in FAULTS)).first()
    if not total["n"]:
        return both.select("*", *(F.lit(0.5).alias(f"{x}_{k}") for k in FAULTS for x in ("rate", "k1", "k2")))
    for k in FAULTS:
        rate = min(max(total[f"s_{k}"] / total["n"], CLIP), 1 - CLIP)
        weight = F.col("n_host") / total["n"]
        by_host = hosts.agg(F.sum(weight * F.pow(F.col(f"h_{k}") / F.col("n_host") - rate, 2)), F.sum(weight / F.col("n_host"))).first()
        part = F.col("n") / total["n"]
        inside = both.agg(F.sum(part * F.pow(F.col(f"s_{k}") / F.col("n") - F.col(f"h_{k}") / F.col("n_host"), 2)), F.sum(part / F.col("n"))).first()
        both = both.withColumns({f"rate_{k}": F.lit(rate), f"k1_{k}": F.lit(strength(rate, *by_host)), f"k2_{k}": F.lit(strength(rate, *inside))})
    return both


def logit(p: Column) -> Column:
    return F.ln(p / (1 - p))


def updated(scores: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """p_low and p_toxic of documents with their sites' evidence, and kept: neither is above one half.

    A document's own probability is taken out of its site's sums before they speak of it.
    """
    columns = [c for c in scores.columns if c not in {f"p_{k}" for k in FAULTS}]
    by_site = sites(scores.select(host, path, *(f"p_{k}" for k in FAULTS)), host, path)
    mine = {c: c if c.startswith("__tl_") else f"__tl_{c}" for c in by_site.columns}  # a document's own columns may have these names
    by_site = by_site.select(*(F.col(c).alias(n) for c, n in mine.items()))
    out = scores.join(by_site, F.col(host).eqNullSafe(F.col("__tl_host")) & F.col(path).eqNullSafe(F.col("__tl_path")), "left")
    posterior = {}
    for k in FAULTS:
        site = {x: F.col(f"__tl_{x}_{k}") for x in ("rate", "k1", "k2", "h", "s")}
        p, rate = F.col(f"p_{k}"), site["rate"]
        host_rate = (site["k1"] * rate + site["h"] - p) / (site["k1"] + F.col("__tl_n_host") - 1)
        site_rate = (site["k2"] * host_rate + site["s"] - p) / (site["k2"] + F.col("__tl_n") - 1)
        site_rate = F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), site_rate))
        posterior[f"p_{k}"] = 1 / (1 + F.exp(-(logit(p) + logit(site_rate) - logit(rate))))
    kept = (F.col("p_low") < 0.5) & (F.col("p_toxic") < 0.5)
    return out.select(*columns, *(c.alias(n) for n, c in posterior.items())).withColumn("kept", kept)


def classified(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", max_train: int = MAX_TRAIN, with_text: bool = True) -> DataFrame:
    """Add p_low, p_toxic and kept to the documents; without the text, where the caller needs none, less is written."""
    docs = docs.drop(*(f"p_{k}" for k in FAULTS), "kept")
    return updated(written(scored(docs, fit(docs, labels, max_train), with_text), "scores"), host, path)


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    let_workers_import(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return classified(docs, table(spark, sf_dir, "labels"), with_text=False).select("doc_id", "p_low", "p_toxic", "kept")
