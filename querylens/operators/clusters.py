"""Clusters and categories: keywords, summaries, agreement, correlation, style categories."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, Normalizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.linalg import VectorUDT
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.text import INITIAL, WORD
from ..shared import drop_table, materialize
from .sampling import hash_sample

#: Fixed value: terms of keywords, whole names included.
TERM = rf"[{INITIAL}][{WORD}'.]*[{WORD}']|[{INITIAL}]"
NUMERIC = ("n_words", "n_chars", "identifier_share", "function_word_share", "symbol_share", "latex_commands")
LOG_SCALED = ("n_words", "n_chars", "latex_commands")
#: Grams that a task counts before it hands the counts on.
MET_GRAMS = 500_000


def term_scores(points: DataFrame, cluster: str = "cluster", text: str = "text") -> DataFrame:
    """(cluster, term, n, score): class-based TF-IDF; noise (below 0) is skipped."""
    pattern = TERM.replace("'", "\\'")
    terms = points.where(F.col(cluster) >= 0).select(F.col(cluster).alias("cluster"), F.explode(F.expr(f"regexp_extract_all({text}, '({pattern.replace(chr(92) + 'p', chr(92) * 2 + 'p')})', 0)")).alias("term"))
    n = terms.groupBy("cluster", "term").agg(F.count(F.lit(1)).alias("n"))
    per = n.groupBy("cluster").agg(F.sum("n").alias("size"))
    total = n.groupBy("term").agg(F.sum("n").alias("all"))
    avg = per.agg(F.avg("size").alias("avg"))
    scored = n.join(per, "cluster").join(total, "term").crossJoin(F.broadcast(avg))
    return scored.select("cluster", "term", "n", F.round(F.col("n") / F.col("size") * F.log(1 + F.col("avg") / F.col("all")), 12).alias("score"))


def keywords(points: DataFrame, k: int = 8, cluster: str = "cluster", text: str = "text") -> DataFrame:
    """(cluster, rank, term, score): the k best terms of each cluster."""
    order = Window.partitionBy("cluster").orderBy(F.desc("score"), "term")
    return term_scores(points, cluster, text).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("cluster", "rank", "term", "score")


def cluster_summary(points: DataFrame) -> DataFrame:
    """One row for each cluster of points (cluster, sources, category, n_words, identifier_share): size, sources, main category, means."""
    mix = points.select("cluster", F.explode("sources").alias("source")).groupBy("cluster", "source").agg(F.count(F.lit(1)).alias("n"))
    mix = mix.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("cluster")))
    mix = mix.groupBy("cluster").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("share")).alias("o"), "source", "share"))), lambda x: F.concat(x["source"], F.lit(" "), F.round(x["share"] * 100, 0).cast("int").cast("string"), F.lit("%"))), ", ").alias("sources"))
    rest = points.groupBy("cluster").agg(F.count(F.lit(1)).alias("queries"), F.expr("mode(category, true)").alias("main_category"), F.median("n_words").alias("median_words"), F.round(F.avg("identifier_share"), 2).alias("identifier_share"))
    return rest.join(mix, "cluster", "left")


def ordered_summary(summary: DataFrame) -> DataFrame:
    """The summary with place: clusters from the largest to the smallest, noise last."""
    order = Window.partitionBy(F.lit(1)).orderBy(F.col("cluster") < 0, F.desc("queries"), "cluster")  # a row for each cluster
    return summary.withColumn("place", F.row_number().over(order).cast("long"))


def jittered(points: DataFrame, columns: list[str], key: str, share: float = 0.01, seed: int = 0) -> DataFrame:
    """Columns moved by uniform noise of up to this share of their range, which follows from the key alone."""
    ranges = points.agg(*(F.min(c).alias(f"_lo_{c}") for c in columns), *(F.max(c).alias(f"_hi_{c}") for c in columns))  # one row
    noise = {c: F.col(c) + (F.pmod(F.xxhash64(F.lit(seed), F.lit(c), key), F.lit(2**31)) / 2.0**30 - 1) * share * (F.col(f"_hi_{c}") - F.col(f"_lo_{c}")) for c in columns}
    return points.crossJoin(F.broadcast(ranges)).withColumns(noise).select(*points.columns)


def share_pivot(cells: DataFrame, rows: str, columns: str, n: str, values: list[str]) -> DataFrame:
    """Shares of each row's total over fixed columns; a row of nothing has zeros."""
    wide = cells.groupBy(rows).pivot(columns, values).agg(F.sum(n)).fillna(0, values)
    total = sum((F.col(f"`{v}`") for v in values), F.lit(0))
    return wide.select(rows, *(F.when(total > 0, F.col(f"`{v}`") / total).otherwise(F.lit(0.0)).alias(v) for v in values))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def rand_index(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the adjusted Rand index of two labelings; 1 where both are trivial."""
    cells = contingency(df, a, b)
    pairs = "sum(cast(n as double) * (n - 1) / 2)"
    both = cells.agg(F.expr(pairs).alias("i"), F.sum("n").alias("n"))
    left = cells.groupBy("a").agg(F.sum("n").alias("n")).agg(F.expr(pairs).alias("l"))
    right = cells.groupBy("b").agg(F.sum("n").alias("n")).agg(F.expr(pairs).alias("r"))
    one = both.crossJoin(left).crossJoin(right).withColumn("e", F.expr("if(n > 1, l * r / (cast(n as double) * (n - 1) / 2), 0D)"))
    return one.select(F.expr("if((l + r) / 2 = e, 1D, (i - e) / ((l + r) / 2 - e))").alias("ari"))


def best_jaccard(df: DataFrame, a: str, b: str) -> DataFrame:
    """(label, jaccard): of each class of a, its best overlap with any class of b."""
    cells = contingency(df, a, b)
    left = cells.groupBy("a").agg(F.sum("n").alias("na"))
    right = cells.groupBy("b").agg(F.sum("n").alias("nb"))
    return cells.join(left, "a").join(right, "b").groupBy(F.col("a").alias("label")).agg(F.max(F.expr("cast(n as double) / (na + nb - n)")).alias("jaccard"))


#: Distinct values that one task ranks.
RANKED_VALUES = 65_536


def average_ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    """Ranks of columns, ties sharing their average, by counts of values: distinct values are sorted within ranges, whose sums say how many come before."""
    for c in columns:
        counts = materialize(df.groupBy(F.col(c).alias("_v")).agg(F.count(F.lit(1)).alias("_n")), "values")
        ranged = materialize(counts.repartitionByRange(-(-counts.count() // RANKED_VALUES) or 1, "_v").withColumn("_range", F.spark_partition_id()), "ranges")
        earlier = Window.partitionBy(F.lit(1)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        start = ranged.groupBy("_range").agg(F.sum("_n").alias("_all")).select("_range", F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_start"))  # a row for each range
        within = Window.partitionBy("_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
        ranks = ranged.withColumn("_before", F.coalesce(F.sum("_n").over(within), F.lit(0))).join(start, "_range").select("_v", (F.col("_start") + F.col("_before") + (F.col("_n") + 1) / 2).alias(f"rank_{c}"))
        df = df.join(ranks, df[c].eqNullSafe(ranks["_v"])).drop("_v")
    return df


def correlations(df: DataFrame, columns: list[str], method: str = "spearman") -> DataFrame:
    """(x, y, r) for all pairs of columns, in one aggregate; Spearman or Pearson."""
    names = columns
    if method == "spearman":
        df, names = average_ranks(df, columns), [f"rank_{c}" for c in columns]
    elif method != "pearson":
        raise ValueError(f"unknown method {method}")
    pairs = [(i, j) for i in range(len(columns)) for j in range(len(columns))]
    one = df.agg(*(F.corr(names[i], names[j]).alias(f"r_{i}_{j}") for i, j in pairs))
    return one.select(F.explode(F.array(*(F.struct(F.lit(columns[i]).alias("x"), F.lit(columns[j]).alias("y"), F.col(f"r_{i}_{j}").alias("r")) for i, j in pairs))).alias("c")).select("c.*")


def _grams(skeleton: str | None) -> list[str]:
    """A skeleton's 1- to 3-grams, repeats included; null has none."""
    t = [x for x in (skeleton or "").split(" ") if x]
    return [*t, *map(" ".join, zip(t, t[1:], strict=False)), *map(" ".join, zip(t, t[1:], t[2:], strict=False))]


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, df): in how many of a task's skeletons each gram is; a gram may come more than once."""
    met: Counter[str] = Counter()

    def flushed() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(met.keys(), pa.string()), pa.array(met.values(), pa.int64())], ["gram", "df"])
        met.clear()
        return out

    for batch in batches:
        for skeleton in batch.column("skeleton"):
            met.update(set(_grams(skeleton.as_py())))
            if len(met) >= MET_GRAMS:
                yield flushed()
    yield flushed()


def skeleton_rows(df: DataFrame, key: str, skeleton: str = "skeleton", min_df: int = 5) -> tuple[DataFrame, list[str]]:
    """((key, i, weight), grams): a row for each skeleton with a gram of the vocabulary, the places of its grams in it and their TF-IDF.

    Counts are sublinear, idf is smoothed, rows have unit length. A row is weighed
    by itself, so only the grams' document counts are exchanged; the vocabulary,
    grams of at least min_df skeletons, goes to the driver and to the tasks.
    """
    rows = materialize(df.select(key, F.col(skeleton).alias("skeleton")), "skeletons")
    n = rows.count()
    counts = rows.select("skeleton").mapInArrow(_seen, "gram string, df long").groupBy("gram").agg(F.sum("df").alias("df"))
    met = {r["gram"]: r["df"] for r in counts.where(F.col("df") >= min(min_df, max(n, 1))).collect()}
    grams = sorted(met)
    place = {g: i for i, g in enumerate(grams)}
    idf = np.array([math.log((1 + n) / (1 + met[g])) + 1 for g in grams])

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, ends, i, times = [], [0], [], []
            for row, skeleton in enumerate(batch.column("skeleton")):
                held = sorted((place[g], c) for g, c in Counter(_grams(skeleton.as_py())).items() if g in place)
                if held:
                    kept.append(row)
                    i += [x for x, _ in held]
                    times += [c for _, c in held]
                    ends.append(len(i))
            if kept:
                w = (1 + np.log(times)) * idf[i]
                w /= np.repeat(np.sqrt(np.add.reduceat(w * w, ends[:-1])), np.diff(ends))
                at = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(kept, pa.int32())), pa.ListArray.from_arrays(at, pa.array(i, pa.int32())), pa.ListArray.from_arrays(at, pa.array(w))], [key, "i", "weight"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(weighed, f"`{key}` {kind}, i array<int>, weight array<double>"), grams


def skeleton_weights(df: DataFrame, key: str, skeleton: str = "skeleton", min_df: int = 5) -> DataFrame:
    """(key, gram, weight): sparse TF-IDF of skeletons' 1- to 3-grams."""
    rows, grams = skeleton_rows(df, key, skeleton, min_df)
    numbered = df.sparkSession.createDataFrame(list(enumerate(grams)), "i int, gram string")
    return rows.select(key, F.explode(F.arrays_zip("i", "weight")).alias("x")).select(key, "x.i", "x.weight").join(F.broadcast(numbered), "i").select(key, "gram", "weight")


def skeleton_components(weights: DataFrame, key: str, k: int = 8) -> DataFrame:
    """(key, components) of sparse weights (key, gram, weight), as row_components() has them."""
    grams = sorted(r["gram"] for r in weights.select("gram").distinct().collect())  # the vocabulary
    numbered = weights.join(F.broadcast(weights.sparkSession.createDataFrame([(g, i) for i, g in enumerate(grams)], "gram string, i int")), "gram")
    held = numbered.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", "weight"))).alias("x"))  # of one row's grams
    return row_components(held.select(key, F.col("x.i").alias("i"), F.col("x.weight").alias("weight")), len(grams), key, k)


def row_components(rows: DataFrame, grams: int, key: str, k: int = 8) -> DataFrame:
    """(key, components): the leading right singular vectors of sparse rows (key, i, weight) over so many grams, times them; no centring.

    Only the vectors go to the driver, as many numbers as there are grams times
    k. Rows are written once as vectors and held while the decomposition passes
    over them. A vector's sign is such that its largest entry is positive. With
    fewer than two grams there is nothing to reduce, and no row.
    """
    if grams < 2:
        return rows.select(key, F.array().cast("array<double>").alias("components")).limit(0)
    parts = F.struct(F.lit(0).cast("byte").alias("type"), F.lit(grams).alias("size"), F.col("i").alias("indices"), F.col("weight").alias("values"))  # a sparse vector as it is stored
    written = materialize(rows.select(key, parts.alias("x")), "vectors")
    vectors = rows.sparkSession.read.schema(StructType([StructField("x", VectorUDT())])).parquet(written._querylens_path).persist()
    v = RowMatrix(vectors).computeSVD(min(k, grams - 1)).V.toArray()
    vectors.unpersist()
    v = v * np.where(np.abs(v).max(axis=0) == v.max(axis=0), 1, -1)

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, w = batch.column("indices"), batch.column("values")
            if len(i):
                start = i.offsets.to_numpy()[:-1] - i.offsets[0].as_py()
                sums = np.add.reduceat(v[i.flatten().to_numpy()] * w.flatten().to_numpy()[:, None], start, axis=0)
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.FixedSizeListArray.from_arrays(pa.array(sums.ravel()), v.shape[1]).cast(pa.list_(pa.float64()))], [key, "components"])

    return written.select(key, "x.indices", "x.values").mapInArrow(reduced, f"`{key}` {written.schema[key].dataType.simpleString()}, components array<double>")


def style_features(df: DataFrame, key: str | None = None, skeleton: str = "skeleton") -> DataFrame:
    """Adds features: the six measures, three of them on a log scale, and with a key the components of the skeletons, all standardised."""
    scaled = df.withColumns({f"_{c}": F.log1p(c) if c in LOG_SCALED else F.col(c).cast("double") for c in NUMERIC})
    names = [f"_{c}" for c in NUMERIC]
    if key is not None:
        rows, grams = skeleton_rows(df.select(key, skeleton), key, skeleton)
        parts = materialize(row_components(rows, len(grams), key), "components")
        n = len((parts.first() or {"components": []})["components"])
        scaled = scaled.join(parts, key, "left").withColumns({f"_c{j}": F.coalesce(F.col("components")[j], F.lit(0.0)) for j in range(n)}).drop("components")
        names += [f"_c{j}" for j in range(n)]
    vectors = VectorAssembler(inputCols=names, outputCol="_raw").transform(scaled)
    return StandardScaler(withMean=True, withStd=True, inputCol="_raw", outputCol="features").fit(vectors).transform(vectors).drop("_raw", *names)


def bic(log_likelihood: float, k: int, dims: int, n: int) -> float:
    return -2 * log_likelihood + (k * (dims + dims * (dims + 1) / 2) + k - 1) * math.log(max(n, 1))


#: Fits that run at once: each is many short jobs, which leave most cores idle when they go one by one.
FITS = 8


def at_once(df: DataFrame, work: list) -> list:
    """The results of functions of no argument, in their order, several running at a time in threads with this thread's local properties."""
    with ThreadPoolExecutor(FITS) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(df.sparkSession)(w)) for w in work]]


#: Fixed values of a mixture's fit: steps at most, the gain of the mean log-likelihood below which it ends, what is added to variances, rows and steps of k-means that it starts from.
STEPS, GAIN, LEAST_VARIANCE, START_POOL, START_STEPS = 100, 1e-3, 1e-6, 1000, 30
#: Rows that a task weighs at once.
WEIGHED_ROWS = 4096


class Fit:
    """A mixture of k Gaussians with full covariances over the rows of one sample, as it is fitted: weights, means, covariances."""

    def __init__(self, sample: int, k: int, seed: int):
        self.sample, self.k, self.seed = sample, k, seed
        self.weights = self.means = self.covariances = None
        self.n, self.log_likelihood, self.steps, self.over = 0.0, -math.inf, 0, False

    def start(self, rows: np.ndarray) -> None:
        """The components of a k-means, from far apart centres, over the given rows."""
        rng, d = np.random.default_rng(self.seed), rows.shape[1]
        self.means = rows[rng.integers(len(rows), size=1)]
        while len(self.means) < self.k:
            far = ((rows[:, None] - self.means) ** 2).sum(axis=2).min(axis=1)
            self.means = np.concatenate([self.means, rows[rng.choice(len(rows), size=1, p=far / far.sum() if far.sum() > 0 else None)]])
        for _ in range(START_STEPS):
            label = ((rows[:, None] - self.means) ** 2).sum(axis=2).argmin(axis=1)
            self.means = np.stack([rows[label == c].mean(axis=0) if (label == c).any() else self.means[c] for c in range(self.k)])
        held = np.bincount(label, minlength=self.k)
        self.weights = np.maximum(held, 1) / np.maximum(held, 1).sum()
        self.covariances = np.stack([(np.cov(rows[label == c].T, bias=True).reshape(d, d) if held[c] > 1 else np.diag(rows.var(axis=0))) + LEAST_VARIANCE * np.eye(d) for c in range(self.k)])

    def coefficients(self) -> np.ndarray:
        """A column for each component: its weighted log-density as a linear function of _products()."""
        d = self.means.shape[1]
        inverse = np.linalg.inv(self.covariances)
        m = np.einsum("kij,kj->ki", inverse, self.means)
        i, j = np.triu_indices(d)
        second = -0.5 * np.where(i == j, 1, 2) * (inverse[:, i, j] + inverse[:, j, i]) / 2
        constant = np.log(np.maximum(self.weights, 1e-300)) - 0.5 * (d * math.log(2 * math.pi) + np.linalg.slogdet(self.covariances)[1] + (m * self.means).sum(axis=1))
        return np.concatenate([second, m, constant[:, None]], axis=1).T

    def step(self, sums: np.ndarray, log_likelihood: float) -> None:
        """The next weights, means and covariances from each component's sums of _products(), weighed by what rows owe to it."""
        d = self.means.shape[1]
        n = sums[:, -1]
        self.n = n.sum()
        gained, self.log_likelihood, self.steps = (log_likelihood - self.log_likelihood) / max(self.n, 1), log_likelihood, self.steps + 1
        if gained < GAIN or self.steps >= STEPS:
            self.over = True  # the likelihood is that of the parameters as they are
            return
        held = np.flatnonzero(n > 1e-9)  # a component that no row owes anything stays where it is
        i, j = np.triu_indices(d)
        means = sums[held, -1 - d : -1] / n[held, None]
        second = np.empty((len(held), d, d))
        second[:, i, j] = second[:, j, i] = sums[held, : len(i)] / n[held, None]
        self.weights, self.means[held] = n / self.n, means
        self.covariances[held] = second - means[:, :, None] * means[:, None] + LEAST_VARIANCE * np.eye(d)


def _products(x: np.ndarray) -> np.ndarray:
    """Of each row the products of two of its elements, its elements, and one."""
    i, j = np.triu_indices(x.shape[1])
    return np.concatenate([x[:, i] * x[:, j], x, np.ones((len(x), 1))], axis=1)


def _owed(products: np.ndarray, coefficients: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each row owes to each component of several mixtures side by side, and the rows' log-likelihoods by mixture."""
    p = products @ coefficients
    top = np.maximum.reduceat(p, ends, axis=1)
    each = np.diff(np.append(ends, p.shape[1]))
    p -= np.repeat(top, each, axis=1)
    np.exp(p, out=p)
    total = np.add.reduceat(p, ends, axis=1)
    p /= np.repeat(total, each, axis=1)
    return p, top + np.log(total)


def _features(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column("x")
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def mixtures(points: DataFrame, key: str, samples: int, asked: list[tuple[int, int, int]]) -> list[Fit]:
    """Fits (sample, k, seed) over points (key, x array<double>, member array<boolean>: in which samples a row is), in their order.

    A step of all fits is one pass over the points: tasks, as many as there are
    cores, return sums of each component, so what goes to the driver does not grow with the rows.
    """
    spark = points.sparkSession
    points = points.coalesce(max(1, spark.sparkContext.defaultParallelism))
    tasks = points.select("x", "member")
    first = {}
    for sample in range(samples):  # a bounded number of rows for the starts, by a hash of their key
        first[sample] = np.array([r["x"] for r in points.where(F.col("member")[sample]).orderBy(F.xxhash64(F.lit(sample), key), key).limit(START_POOL).select("x").collect()])
    fits = [Fit(*a) for a in asked]
    for f in fits:
        f.over = not len(first[f.sample])
        if len(rows := first[0] if f.over else first[f.sample]):
            f.start(rows)
    while going := [k for k, f in enumerate(fits) if not f.over]:
        parts = [(s, ks, np.concatenate([fits[k].coefficients() for k in ks], axis=1), np.cumsum([0, *(fits[k].k for k in ks)])[:-1]) for s in range(samples) if (ks := [k for k in going if fits[k].sample == s])]

        def summed(batches, parts=parts):
            sums, seen = [0.0] * len(parts), [0.0] * len(parts)
            for batch in batches:
                x = _features(batch)
                member = batch.column("member").flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
                for start in range(0, len(x), WEIGHED_ROWS):
                    products, inside = _products(x[start : start + WEIGHED_ROWS]), member[start : start + WEIGHED_ROWS]
                    for at, (sample, _, coefficients, ends) in enumerate(parts):
                        if len(mine := products[inside[:, sample]]):
                            owed, likely = _owed(mine, coefficients, ends)
                            sums[at], seen[at] = sums[at] + owed.T @ mine, seen[at] + likely.sum(axis=0)
            out = [(at, s.ravel(), v) for at, (s, v) in enumerate(zip(sums, seen, strict=True)) if not np.isscalar(s)]
            yield pa.RecordBatch.from_arrays([pa.array([at for at, _, _ in out], pa.int32()), pa.array([s for _, s, _ in out], pa.list_(pa.float64())), pa.array([v for _, _, v in out], pa.list_(pa.float64()))], ["at", "sums", "seen"])

        met = tasks.mapInArrow(summed, "at int, sums array<double>, seen array<double>").toArrow()
        sums, seen = [0.0] * len(parts), [0.0] * len(parts)
        for at, s, v in sorted(zip(met["at"].to_pylist(), (np.array(x.values) for x in met["sums"]), (np.array(x.values) for x in met["seen"]), strict=True), key=lambda r: (r[0], *r[2])):
            sums[at], seen[at] = sums[at] + s, seen[at] + v
        for at, (_, ks, coefficients, ends) in enumerate(parts):
            rows = sums[at].reshape(-1, len(coefficients))
            for i, k in enumerate(ks):
                fits[k].step(rows[ends[i] : ends[i] + fits[k].k], seen[at][i])
    return fits


def best_fits(fits: list[Fit]) -> list[Fit]:
    """Of the fits of each sample and k the likeliest, in the order of their first."""
    best: dict = {}
    for f in fits:
        if (key := (f.sample, f.k)) not in best or f.log_likelihood > best[key].log_likelihood:
            best[key] = f
    return list(best.values())


def classified(points: DataFrame, key: str, fits: list[Fit]) -> DataFrame:
    """(key, labels): of each row the likeliest component in each of the fits."""
    coefficients, ends = np.concatenate([f.coefficients() for f in fits], axis=1), np.cumsum([0, *(f.k for f in fits)])

    def of(batches):
        for batch in batches:
            x = _features(batch)
            p = np.concatenate([(_products(x[s : s + WEIGHED_ROWS]) @ coefficients) for s in range(0, len(x), WEIGHED_ROWS)] or [np.empty((0, ends[-1]))])
            labels = np.stack([p[:, a:b].argmax(axis=1) for a, b in zip(ends, ends[1:], strict=False)], axis=1).astype(np.int32)
            at = pa.array(np.arange(len(x) + 1) * len(fits), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.ListArray.from_arrays(at, pa.array(labels.ravel()))], [key, "labels"])

    return points.select(key, "x").mapInArrow(of, f"`{key}` {points.schema[key].dataType.simpleString()}, labels array<int>")


def subsample(df: DataFrame, key: str, round_: int, share: float = 0.8) -> DataFrame:
    """A fixed number of rows, this share of all, without replacement, by a hash of their key."""
    return hash_sample(df, key, int(df.count() * share), round_)


def agreement(cells: list[tuple[int, int, int]]) -> tuple[float, dict[int, float]]:
    """(adjusted Rand index, each class's best Jaccard overlap) of the cells (a, b, n) of two labelings, as rand_index() and best_jaccard() have them."""
    left, right = Counter(), Counter()
    for a, b, n in cells:
        left[a] += n
        right[b] += n
    pairs = lambda counts: sum(n * (n - 1) / 2 for n in counts)
    n, i, x, y = sum(left.values()), pairs(n for _, _, n in cells), pairs(left.values()), pairs(right.values())
    e = x * y / (n * (n - 1) / 2) if n > 1 else 0.0
    best: dict[int, float] = {}
    for a, b, m in cells:
        best[a] = max(best.get(a, 0.0), m / (left[a] + right[b] - m))
    return 1.0 if (x + y) / 2 == e else (i - e) / ((x + y) / 2 - e), best


def select_classes(df: DataFrame, key: str, most: int = 8, rounds: int = 8, least: float = 0.75, seed: int = 0, restarts: int = 3):
    """(labels (key, label), table (categories, bic, ari, min_jaccard)): the largest number of classes that refits on subsamples find again.

    All sizes, restarts and rounds are fitted side by side, as are those on samples, see mixtures().
    """
    spark, sizes = df.sparkSession, range(2, most + 1)
    plain = materialize(df.select(key, vector_to_array("features").alias("x")), "points")
    n = plain.count()
    dims = len(plain.first()["x"]) if n else 0
    marked = plain.withColumn("member", F.array(F.lit(True)))
    for r in range(rounds):
        taken = hash_sample(plain.select(key), key, int(n * 0.8), r).select(key, F.lit(True).alias("_in"))
        marked = marked.join(taken, key, "left").withColumn("member", F.concat("member", F.array(F.col("_in").isNotNull()))).drop("_in")
    points = materialize(marked.repartition(max(1, spark.sparkContext.defaultParallelism), key), "members")  # a small table too keeps all cores busy
    fits = mixtures(points, key, 1 + rounds, [(0, k, seed + i) for k in sizes for i in range(restarts)] + [(1 + r, k, seed + r) for r in range(rounds) for k in sizes])
    best = best_fits(fits)
    rows, chosen, at = [], None, {(f.sample, f.k): i for i, f in enumerate(best)}
    labels = materialize(classified(points, key, best), "labels") if n else None
    if n:
        pairs = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(r).alias("r"), F.col("labels")[at[0, k]].alias("a"), F.col("labels")[at[1 + r, k]].alias("b")) for k in sizes for r in range(rounds)))
        met: dict = {}
        for c in labels.select(F.explode(pairs).alias("c")).groupBy("c.k", "c.r", "c.a", "c.b").count().collect():
            met.setdefault((c["k"], c["r"]), []).append((c["a"], c["b"], c["count"]))
    for k in sizes if n else ():
        aris, worst = [], {}
        for r in range(rounds):
            ari, overlaps = agreement(met[k, r])
            aris.append(ari)
            for label, jaccard in overlaps.items():
                worst.setdefault(label, []).append(jaccard)
        least_seen = min((sum(v) / len(v) for v in worst.values()), default=0.0)
        rows.append((k, bic(float(best[at[0, k]].log_likelihood), k, dims, n), round(sum(aris) / len(aris), 3), round(least_seen, 3)))
        if least_seen >= least:
            chosen = labels.select(key, F.col("labels")[at[0, k]].alias("label"))
    drop_table(points)
    drop_table(plain)
    chosen = chosen if chosen is not None else df.select(key, F.lit(0).alias("label"))
    return chosen, spark.createDataFrame(rows, "categories int, bic double, ari double, min_jaccard double")


def renumbered(labels: DataFrame, key: str, label: str = "label") -> DataFrame:
    """Labels 1, 2, ... from the largest class to the smallest."""
    sizes = labels.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    numbered = sizes.select(label, F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("n"), label)).alias("number"))
    return labels.join(numbered, label).select(key, F.col("number").cast("string").alias("category"))


def project(df: DataFrame, key: str, vector: str, k: int = 2) -> DataFrame:
    """(key, p0, p1, ...): principal components of unit vectors, centred."""
    v = Normalizer(inputCol="_v", outputCol="_u", p=2.0).transform(df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>"))))
    out = PCA(k=k, inputCol="_u", outputCol="_p").fit(v).transform(v)
    return out.select(key, *(vector_to_array("_p")[i].alias(f"p{i}") for i in range(k)))


#: Below so many distinct queries all are one category; a category of fewer rows is not split again.
LEAST_QUERIES, LEAST_PARENT = 50, 200


def fit_categories(df: DataFrame, key: str, most: int = 8, rounds: int = 8, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(paths (key, category), selection): two levels of stable classes, written as "2" or "2.1"; the level is tagged in the selection."""
    if df.count() < LEAST_QUERIES:
        return df.select(key, F.lit("1").alias("category")), df.sparkSession.createDataFrame([], "level string, categories int, bic double, ari double, min_jaccard double")
    labels, table = select_classes(df, key, most, rounds, seed=seed)
    paths = materialize(renumbered(labels, key), "paths")
    selection = table.withColumn("level", F.lit("top"))
    sizes = [(r["category"], r["n"]) for r in paths.groupBy("category").agg(F.count(F.lit(1)).alias("n")).collect()]  # a handful of classes
    parents = [category for category, n in sorted(sizes) if n >= LEAST_PARENT] if len(sizes) > 1 else []
    split = at_once(df, [lambda c=c: select_classes(df.join(paths.where(F.col("category") == c).select(key), key), key, most, rounds, seed=seed) for c in parents])
    for category, (inner, table) in zip(parents, split, strict=True):
        selection = selection.unionByName(table.withColumn("level", F.lit(category)))
        if inner.select("label").distinct().count() > 1:
            child = renumbered(inner, key).select(key, F.concat_ws(".", F.lit(category), "category").alias("child"))
            paths = paths.join(child, key, "left").select(key, F.coalesce("child", "category").alias("category"))
    return paths, selection


def kendall(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: Kendall's tau-b. Pairs are counted between cells of distinct values, each weighted by its rows, not between rows."""
    cells = df.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("n")).where("x is not null and y is not null")
    w = Window.partitionBy(F.lit(1))
    total = cells.withColumn("all", F.sum("n").over(w))
    a, b = total.alias("a"), cells.alias("b")
    pairs = a.join(b, F.col("a.x") < F.col("b.x")).agg(F.sum(F.col("a.n") * F.col("b.n") * F.signum(F.col("b.y") - F.col("a.y"))).alias("s"))
    n = cells.agg(F.sum("n").alias("n"))
    tx = cells.groupBy("x").agg(F.sum("n").alias("c")).agg(F.sum(F.expr("c * (c - 1) / 2")).alias("tx"))
    ty = cells.groupBy("y").agg(F.sum("n").alias("c")).agg(F.sum(F.expr("c * (c - 1) / 2")).alias("ty"))
    return pairs.crossJoin(n).crossJoin(tx).crossJoin(ty).select(F.expr("s / sqrt((n * (n - 1) / 2 - tx) * (n * (n - 1) / 2 - ty))").alias("tau"))
