"""Quality by hierarchical empirical Bayes: a document's own evidence, its path and its host, each shrunk to the level above.

The evidence of a text is a logistic model on the frequencies of pairs of character classes.  Of each host (``source``) and each
path of it (``source`` and ``lang``) grouped sums give the posterior share of good documents: a beta prior around the level
above, whose strength comes from the spread between sites (method of moments), so sites of few documents stay near it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from trackloom.llm.common import per_block, settle, texts_of
from trackloom.llm.components import salted_join

#: The model is fitted on at most this many labelled rows, those first in the order of a hash of their id.
TRAIN_ROWS = 20_000
KEEP_FROM = 0.5
#: Character classes; a letter of another script, a mark outside ASCII and every other byte over 127 are one class.
CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\r\n", ".", ",", "!", "?", "|", "#$%&*@^~", "\"'`", "()[]{}", "-_/\\", ":;"]
OTHER = len(CLASSES)
FEATURES = 16 * 16 + 6

TABLE = bytearray([OTHER] * 256)
for _n, _chars in enumerate(CLASSES):
    for _c in _chars.encode():
        TABLE[_c] = _n
TABLE = bytes(TABLE)


def features(text: str) -> np.ndarray:
    """Square roots of the frequencies of class pairs, length, mean length of words, and four measures of repetition.

    These are the shares of lines, words and pairs of words that came before, and of words equal to the one before.
    """
    raw = text.encode("utf-8", "surrogatepass")
    made = np.zeros(FEATURES, np.float32)
    if len(raw) > 1:
        kinds = np.frombuffer(raw.translate(TABLE), np.uint8)
        pairs = np.bincount(kinds[:-1] * np.uint8(16) + kinds[1:], minlength=256)
        made[:256] = np.sqrt(pairs / (len(raw) - 1))
    lines = raw.split(b"\n")
    made[256] = np.log1p(len(raw)) / 10
    made[257] = 1 - len(set(lines)) / len(lines)
    made[258] = np.log1p(len(raw) / (raw.count(b" ") + 1)) / 3
    words = raw.split()
    if len(words) > 1:
        pairs = [*zip(words, words[1:], strict=False)]
        made[259] = 1 - len(set(words)) / len(words)
        made[260] = 1 - len(set(pairs)) / len(pairs)
        made[261] = sum(a == b for a, b in pairs) / len(pairs)
    return made


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Weights and, last, the intercept, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = TRAIN_ROWS) -> DataFrame:
    """text and label (``y``) of at most ``rows`` labels, the first in hash order: the same however the tables are cut.

    The chosen labels are broadcast; there are never more than ``rows``.
    """
    known = labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id is not null and y is not null").distinct()
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "y")


def fit_evidence(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """Weights of the text model and the log odds of a good document among the labelled ones.

    Without labels of both kinds nothing can be learnt: the weights are zero, and every document counts alike.
    """

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [features(t).tobytes() for t in texts_of(batch)]
        return pa.record_batch([pa.array(made, pa.binary()), batch.column("y")], ["x", "y"])

    sample = per_block(labelled_sample(docs, labels, "quality", rows), of, "x binary, y int").toPandas()
    y = sample["y"].to_numpy(np.float64) if len(sample) else np.zeros(0)
    if not 0 < y.sum() < len(y):
        return np.zeros(FEATURES + 1), 0.0
    x = np.frombuffer(b"".join(sample["x"]), np.float32).reshape(len(y), FEATURES)
    return fit_logistic(x, y), float(np.log(y.mean() / (1 - y.mean())))


def evidence(docs: DataFrame, weights: np.ndarray, prior: float) -> DataFrame:
    """All columns but text, and ``llr``, the log likelihood ratio of good to bad by the text alone."""
    return with_evidence(docs, weights, prior).drop("text")


def with_evidence(docs: DataFrame, weights: np.ndarray, prior: float) -> DataFrame:
    schema = StructType([*docs.schema.fields, StructField("llr", DoubleType())])

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([features(t) for t in texts_of(batch)], np.float64)
        llr = np.clip(x @ weights[:-1] + weights[-1] - prior, -20, 20)
        return pa.record_batch([*batch.columns, pa.array(llr)], [*batch.schema.names, "llr"])

    return per_block(docs, of, schema)


def share(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def site_posteriors(rows: DataFrame, prior: float) -> tuple[DataFrame, DataFrame]:
    """(host, host_share, host_rows) and (host, path, path_share, path_rows) from rows of host, path and llr."""
    p = share(F.col("llr") + F.lit(prior))
    paths = settle(rows.groupBy("host", "path").agg(F.sum(p).alias("s"), F.count("*").alias("n")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))

    def strength(sites: DataFrame, around: Column | float) -> float:
        """Documents that the prior counts for: m(1-m) over the spread between sites, less what chance within sites makes."""
        m = F.lit(around) if isinstance(around, float) else around
        got = sites.agg(
            F.sum(m * (1 - m) * F.col("n")).alias("within"), F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - m, 2)).alias("between"),
            F.count("*").alias("k"), F.sum("n").alias("n"),
        ).first()
        if not got["n"] or not got["within"]:
            return 100.0
        excess = (got["between"] - got["k"] * got["within"] / got["n"]) / got["n"]
        return float(np.clip(got["within"] / got["n"] / excess - 1, 2, 1000)) if excess > 0 else 1000.0

    whole = hosts.agg(F.sum("s") / F.sum("n")).first()[0]
    whole = float(np.clip(0.5 if whole is None else whole, 1e-3, 1 - 1e-3))
    k = strength(hosts, whole)
    host_share = hosts.select("host", ((F.col("s") + k * whole) / (F.col("n") + k)).alias("host_share"), F.col("n").alias("host_rows"))
    joined = paths.join(host_share, "host")
    k = strength(joined, F.col("host_share"))
    path_share = joined.select("host", "path", ((F.col("s") + k * F.col("host_share")) / (F.col("n") + k)).alias("path_share"), F.col("n").alias("path_rows"))
    return host_share, path_share


def site_table(docs: DataFrame, weights: np.ndarray, prior: float) -> DataFrame:
    """site, host_share, path_share from the evidence of all documents."""
    sites = docs.select("text", host().alias("host"), F.coalesce("lang", F.lit("")).alias("path"))
    hosts, paths = site_posteriors(settle(evidence(sites, weights, prior), "evidence"), prior)
    site = F.concat_ws("\u0001", "host", "path")
    return settle(paths.join(hosts, "host").select(site.alias("__site"), "host_share", "path_share"), "sites")


def host() -> Column:
    return F.coalesce("source", F.lit(""))


def quality_of(llr: Column) -> Column:
    return share(llr + F.log(F.col("path_share") / (1 - F.col("path_share"))))


def judged(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, llr, host, host_share, path_share, quality (0 to 1), kept, one row per document.

    Null hosts, paths and texts count as empty ones.  Repeated rows count each.  No rows give no rows.
    """
    weights, prior = fit_evidence(docs, labels, train_rows)
    sites = site_table(docs, weights, prior)
    taken = docs.select("doc_id", "text", host().alias("host"), F.concat_ws("\u0001", host(), F.coalesce("lang", F.lit(""))).alias("__site"))
    met = salted_join(evidence(taken, weights, prior), sites, "__site", "doc_id")
    return met.select("doc_id", "llr", "host", "host_share", "path_share", quality_of(F.col("llr")).alias("quality")).withColumn("kept", F.col("quality") >= keep_from)


def good_documents(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The whole rows that ``judged`` keeps."""
    weights, prior = fit_evidence(docs, labels, train_rows)
    sites = site_table(docs, weights, prior)
    taken = docs.withColumn("__site", F.concat_ws("\u0001", host(), F.coalesce("lang", F.lit(""))))
    renamed = with_evidence(taken.withColumnRenamed("llr", "__llr") if "llr" in docs.columns else taken, weights, prior)
    sites = sites.withColumnRenamed("host_share", "__host_share").withColumnRenamed("path_share", "__path_share")
    met = salted_join(renamed, sites, "__site", "doc_id")
    odds = F.col("llr") + F.log(F.col("__path_share") / (1 - F.col("__path_share")))
    kept = met.filter(share(odds) >= keep_from).drop("llr", "__site", "__host_share", "__path_share")
    return (kept.withColumnRenamed("__llr", "llr") if "llr" in docs.columns else kept).select(*docs.columns)
