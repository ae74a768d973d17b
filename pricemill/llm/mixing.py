"""Mix of sources by target weights: soft membership and projected-gradient least squares."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .bpe import DEFAULT_RANKS, _texts, encode_batch

#: Hashed token features of the classifier.
FEATURES = 2048
#: Labelled documents, the first by a hash of doc_id, on which the classifier's strength is calibrated.
CALIBRATION = 2000
#: Buckets of the selection order; the cut is exact, as the bucket that holds it is read row by row.
BUCKETS = 1 << 16


_LISTS = pa.list_(pa.int64())


def _measure(sources: list[str], path: str):
    """Token count of each document, features of the wanted ones, and at a task's end the token table of each labelled source.

    pos and n list a wanted document's features and how often each occurs; other documents have none.
    """
    index = {s: k for k, s in enumerate(sources)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(sources), FEATURES), np.int64)
        names = ["doc_id", "source", "n_tokens", "counts", "pos", "n"]
        id_type = None
        for b in batches:
            id_type, sizes, row, pos, times = b.column(0).type, [], 0, [], []
            label = np.array([index.get(s, -1) for s in b.column(1).to_pylist()], np.int64)
            wanted = b.column(3).to_numpy(zero_copy_only=False)
            for part in _texts(b.column(2)):
                ids, n = encode_batch(path, part)
                of = np.repeat(label[row : row + len(part)], n)
                known = of >= 0
                counts += np.bincount(of[known] * FEATURES + ids[known] % FEATURES, minlength=counts.size).reshape(counts.shape)
                ends = np.concatenate([[0], np.cumsum(n)])
                for k in range(len(part)):
                    seen = np.unique(ids[ends[k] : ends[k + 1]] % FEATURES, return_counts=True) if wanted[row + k] else (None, None)
                    pos.append(seen[0])
                    times.append(seen[1])
                sizes.append(n)
                row += len(part)
            total = np.concatenate(sizes) if sizes else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(total), pa.nulls(b.num_rows, _LISTS), pa.array(pos, _LISTS), pa.array(times, _LISTS)], names=names)
        if counts.any():
            k = len(sources)
            yield pa.RecordBatch.from_arrays([pa.nulls(k, id_type), pa.array(sources, pa.string()), pa.nulls(k, pa.int64()), pa.array(counts.tolist(), _LISTS), pa.nulls(k, _LISTS), pa.nulls(k, _LISTS)], names=names)

    return run


def _prior(table: np.ndarray) -> np.ndarray:
    """Logarithms of the sources' shares of labelled tokens; a source without any can't be recognised."""
    sums = table.sum(1)
    seen = (sums > 0) | (sums.sum() == 0)
    with np.errstate(divide="ignore"):
        return np.log(np.where(seen, sums + 1, 0) / (sums + 1)[seen].sum())


def _posteriors(table: np.ndarray, sources: list[str], strength: float | None):
    """Naive Bayes over token features: member, each source's posterior.

    A document's evidence is the mean of its tokens' log likelihoods times `strength`, as tokens of a document
    are far from independent. Where strength is None, member is that mean, with the document taken out of its
    own source's table, for calibrate(). Posteriors are kept to hundredths, so that documents fall into few classes.
    """
    prior = _prior(table)
    index = {s: k for k, s in enumerate(sources)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = np.log((table + 0.5) / (table + 0.5).sum(1, keepdims=True))
        for b in batches:
            out = []
            for label, total, pos, n in zip(*(b.column(c).to_pylist() for c in ("source", "n_tokens", "pos", "n"))):
                pos, n = np.array(pos, np.int64), np.array(n, np.float64)
                mean = share[:, pos] @ n / max(1, total)
                if strength is None and (k := index.get(label)) is not None:
                    rest = table[k] + 0.5
                    rest[pos] = np.maximum(table[k][pos] - n, 0) + 0.5
                    mean[k] = np.log(rest[pos] / rest.sum()) @ n / max(1, total)
                if strength is not None:
                    p = prior + strength * mean
                    p = np.exp(p - p.max())
                    mean = np.round(p / p.sum(), 2)
                    mean[mean.argmax()] += 1 - mean.sum()
                out.append(mean.tolist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(out, pa.list_(pa.float64()))], names=["doc_id", "source", "member"])

    return run


def calibrate(means: np.ndarray, labels: np.ndarray, shares: np.ndarray) -> float:
    """The strength of evidence that makes the labels likeliest; 0 where texts tell nothing of the source."""
    best, at = -np.inf, 0.0
    with np.errstate(divide="ignore"):
        log = np.log(shares)
    for strength in [0.0, *np.geomspace(0.1, 1000, 25)]:
        s = log + strength * means
        top = s.max(1, keepdims=True)
        score = (s[np.arange(len(labels)), labels] - top[:, 0] - np.log(np.exp(s - top).sum(1))).sum()
        if score > best + 1e-9:
            best, at = score, float(strength)
    return at


def _rate(history: list[list[float]]):
    """A document's rate after the steps so far: a projection onto [0, cap] at each. member and cap are columns."""
    if not history:
        return F.lit(0.0)
    steps = F.array(*(F.array(*(F.lit(float(x)) for x in g)) for g in history))
    dot = lambda g: sum((F.col("member")[k] * g[k] for k in range(len(history[0]))), F.lit(0.0))
    return F.aggregate(steps, F.lit(0.0), lambda r, g: F.least(F.col("cap").cast("double"), F.greatest(F.lit(0.0), r + dot(g))))


def fit_rates(classes: DataFrame, targets: np.ndarray, steps: int = 60, tolerance: float = 1e-7) -> list[list[float]]:
    """Step vectors of projected-gradient least squares: rates in [0, cap] whose expected totals meet targets.

    classes: (member ARRAY<DOUBLE>, cap, tokens), one row for all documents of equal member and cap. A step
    moves each rate along its member vector by the residuals over each source's mass (the gradient in the
    metric that weighs documents by size), then projects. Only len(targets) sums reach the driver a step.
    """
    k = len(targets)
    mass = np.array(classes.agg(*(F.sum(F.col("member")[i] * F.col("tokens")) for i in range(k))).first(), object)
    mass = np.array([float(x or 0) for x in mass])
    history: list[list[float]] = []
    for _ in range(steps):
        r = _rate(history)
        got = np.array([float(x or 0) for x in classes.agg(*(F.sum(r * F.col("member")[i] * F.col("tokens")) for i in range(k))).first()])
        off = targets - got
        if np.abs(off).max() <= tolerance * max(1.0, targets.sum()):
            break
        history.append([float(o / m) if m > 0 else 0.0 for o, m in zip(off, mass)])
    return history


def mix_sources(docs: DataFrame, targets: DataFrame, path: str = DEFAULT_RANKS, sure: float = 0.0) -> DataFrame:
    """(doc_id, source, n_tokens BIGINT, repeats BIGINT, members MAP<STRING, DOUBLE>): the chosen documents.

    members is the document's membership in each source, source the one of which it is most likely.

    docs: doc_id (unique), text, source. targets: source, weight, max_repeats (a small fixed table, read by
    the driver). The total is the largest at which no source needs more than max_repeats of what it has.

    1. One pass, the only one over the texts, counts each document's tokens and, over all labelled documents, the
       token table of each source; it keeps the features of unlabelled documents and of those for calibration.
    2. A recorded source is certain membership. Documents without one get the posterior of a naive Bayes
       classifier over all labelled documents, whose strength is calibrated on CALIBRATION of them, and count in
       the shares that it gives, however unsure it is (`sure` leaves out those whose likeliest source is below it).
       Such a document is used as often as each source it may be of allows. Documents of sources without a
       target, and those without tokens, are never chosen.
    3. Rates of all documents, soft and certain, come from fit_rates(). A rate's whole part is repeated at once. The
       fraction of a soft document is drawn by a hash of doc_id; what each source then lacks, in expected tokens,
       its recorded documents fill, in the order of the hash until the fractions' tokens are filled, so that the
       source's total misses its target by less than one document unless soft ones alone exceed it. No source is
       sorted whole: a histogram over BUCKETS of the hash finds the bucket of the cut, and only that bucket is
       read row by row.

    Null weights or max_repeats count as 0; a source that has no tokens gets none and the others share the
    total by their weights. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    want = {r.source: (float(r.weight or 0), int(r.max_repeats or 0)) for r in targets.select("source", "weight", "max_repeats").collect() if r.source is not None}
    sources = sorted(want)
    id_type = docs.schema["doc_id"].dataType
    lists = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("source", T.StringType()), *(T.StructField(c, t) for c, t in (("n_tokens", T.LongType()), ("counts", lists), ("pos", lists), ("n", lists)))])
    texts = docs.select("doc_id", F.col("source").cast("string").alias("source"), "text")
    # about half as many again as the calibration takes; the count comes from the files' footers
    share = min(1.0, 1.5 * CALIBRATION / max(1, docs.count()))
    wanted = F.col("source").isNull() | (F.col("source").isin(sources) & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int(share * (1 << 40))))
    measured = stored(texts.withColumn("wanted", F.coalesce(wanted, F.lit(False))).mapInArrow(_measure(sources, path), schema), "measured")
    sized = measured.where("counts IS NULL AND n_tokens > 0")

    table = np.zeros((max(1, len(sources)), FEATURES))
    sums = measured.where("counts IS NOT NULL").select("source", F.posexplode("counts")).groupBy("source", "pos").agg(F.sum("col").alias("n"))
    for r in sums.collect():  # len(sources) * FEATURES rows
        table[sources.index(r.source), r.pos] = r.n
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("source", T.StringType()), T.StructField("member", T.ArrayType(T.DoubleType()))])
    found = sized.where("pos IS NOT NULL").select("doc_id", "source", "n_tokens", "pos", "n")
    some = found.where(F.col("source").isin(sources)).orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)), "doc_id").limit(CALIBRATION)
    known = some.mapInArrow(_posteriors(table, sources, None), schema).collect()
    strength = calibrate(np.array([r.member for r in known]), np.array([sources.index(r.source) for r in known]), np.exp(_prior(table))) if known else 0.0
    unlabelled = found.where("source IS NULL").mapInArrow(_posteriors(table, sources, strength), schema).drop("source")
    unlabelled = sized.where("source IS NULL").join(unlabelled.where(F.array_max("member") >= sure), "doc_id")
    one_hot = {s: F.array(*(F.lit(float(s == x)) for x in sources)) for s in sources}
    names = F.array(*(F.lit(s) for s in sources)) if sources else F.array().cast("array<string>")
    caps = F.array(*(F.lit(want[s][1]) for s in sources)).cast("array<int>")
    member = F.lit(None).cast("array<double>")
    for s in sources:
        member = F.when(F.col("source") == s, one_hot[s]).otherwise(member)
    rows = sized.where(F.col("source").isin(sources)).select("doc_id", "source", "n_tokens", member.alias("member"), F.lit(False).alias("soft"))
    rows = rows.unionByName(unlabelled.select("doc_id", F.element_at(names, F.array_position("member", F.array_max("member")).cast("int")).alias("source"), "n_tokens", "member", F.lit(True).alias("soft")))
    cap = F.array_min(F.zip_with("member", caps, lambda m, c: F.when(m > 0, c)))  # of all sources it may be of
    rows = stored(rows.withColumn("cap", cap).withColumn("u", F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 40))), "members")

    classes = stored(rows.groupBy("member", "cap").agg(F.sum("n_tokens").alias("tokens")), "classes")
    have = {r.source: float(r.t) for r in rows.where("NOT soft").groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    use = [s for s in sources if have.get(s) and want[s][0] > 0 and want[s][1] > 0]
    weights = np.array([want[s][0] if s in use else 0.0 for s in sources])
    history, rates = [], dict.fromkeys(sources, 0.0)
    sums = lambda df, times: np.array([float(x or 0) for x in df.agg(*(F.sum(times * F.col("member")[i] * F.col("tokens")) for i in range(len(sources)))).first()])
    if use:
        weights = weights / weights.sum()
        fits = lambda most: min(most[sources.index(s)] / weights[sources.index(s)] for s in use)
        total = fits(sums(classes, F.col("cap")))
        history = fit_rates(classes, weights * total)
    rate = F.round(_rate(history), 9)
    drawn = F.floor(rate) + F.when(F.col("u") / float(1 << 40) < rate - F.floor(rate), 1).otherwise(0)
    soft = rows.where("soft").withColumn("repeats", drawn.cast("long"))
    if use:
        got = sums(soft.withColumnRenamed("n_tokens", "tokens"), F.col("repeats"))
        whole = np.array([want[s][1] * have.get(s, 0.0) for s in sources])
        lack = np.maximum(weights * min(total, fits(got + whole)) - got, 0)
        rates = {s: min(lack[k] / have[s], want[s][1]) if s in use else 0.0 for k, s in enumerate(sources)}

    rate = F.lit(0.0)
    for s in sources:
        rate = F.when(F.col("source") == s, F.lit(round(float(rates[s]), 9))).otherwise(rate)
    rated = rows.where("NOT soft").withColumn("rate", rate).withColumn("base", F.floor("rate")).withColumn("part", F.col("rate") - F.floor("rate"))
    open_ = rated.where("part > 0")
    bucket = F.shiftright(F.col("u"), 24).cast("int")
    histogram = open_.groupBy("source", bucket.alias("bucket")).agg(F.sum("n_tokens").alias("t"), F.sum(F.col("part") * F.col("n_tokens")).alias("q"))
    w = Window.partitionBy("source").orderBy("bucket")  # BUCKETS rows a source at most
    upto = histogram.withColumn("upto", F.sum("t").over(w)).withColumn("quota", F.sum("q").over(Window.partitionBy("source")))
    cut = upto.where("upto >= quota").groupBy("source").agg(F.min("bucket").alias("cut"), F.min_by(F.col("upto") - F.col("t"), "bucket").alias("before"), F.first("quota").alias("quota"))
    open_ = open_.withColumn("bucket", bucket).join(F.broadcast(cut), "source")  # a row a source
    inside = open_.where("bucket = cut").withColumn("sum", F.sum("n_tokens").over(Window.partitionBy("source").orderBy("u", "doc_id")))
    # of the row that crosses the quota, the nearer side
    extra = open_.where("bucket < cut").select("doc_id").unionAll(inside.where("before + sum - n_tokens / 2.0D <= quota").select("doc_id"))
    chosen = rated.join(extra.withColumn("extra", F.lit(1)), "doc_id", "left")
    chosen = chosen.withColumn("repeats", (F.col("base") + F.coalesce("extra", F.lit(0))).cast("long"))
    out = ["doc_id", "source", "n_tokens", "repeats", F.map_filter(F.map_from_arrays(names, "member"), lambda _, m: m > 0).alias("members")]
    return chosen.select(*out).unionAll(soft.select(*out)).where("repeats > 0")


def shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, weight, n_docs, n_tokens, share): what each source of targets got of the mix's tokens.

    A document counts in n_docs for its likeliest source, its tokens for all sources by its membership.
    """
    docs = mix.groupBy("source").agg(F.count("*").alias("n_docs"))
    got = mix.select(F.explode("members").alias("source", "m"), (F.col("n_tokens") * F.col("repeats")).alias("t")).groupBy("source").agg(F.sum(F.col("m") * F.col("t")).alias("got"))
    total = got.agg(F.sum("got")).scalar()
    out = targets.select("source", "weight").join(docs, "source", "left").join(got, "source", "left").withColumn("total", total)
    return out.select("source", "weight", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce(F.round("got").cast("long"), F.lit(0)).alias("n_tokens"), (F.coalesce("got", F.lit(0.0)) / F.col("total")).alias("share"))
