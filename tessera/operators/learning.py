"""Scaling, encoding, imputation, log ratios, metrics, splits and models as aggregations, joins and library estimators."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _one_row(df: DataFrame, *stats: Column) -> DataFrame:
    """``df`` with a row of statistics beside every row."""
    return df.crossJoin(F.broadcast(df.agg(*stats)))


def standard_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Population spread; a constant column is only centred."""
    stats = [s for c in columns for s in (F.avg(c).alias(f"__m_{c}"), F.stddev_pop(c).alias(f"__s_{c}"))]
    out = _one_row(df, *stats).withColumns({c: (F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") > 0, F.col(f"__s_{c}")).otherwise(1.0) for c in columns})
    return out.select(*df.columns)


def min_max_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    stats = [s for c in columns for s in (F.min(c).alias(f"__a_{c}"), F.max(c).alias(f"__b_{c}"))]
    out = _one_row(df, *stats).withColumns({c: F.coalesce(F.try_divide(F.col(c) - F.col(f"__a_{c}"), F.col(f"__b_{c}") - F.col(f"__a_{c}")), F.lit(0.0)) for c in columns})
    return out.select(*df.columns)


def max_abs_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    out = _one_row(df, *[F.max(F.abs(c)).alias(f"__a_{c}") for c in columns])
    return out.withColumns({c: F.coalesce(F.try_divide(F.col(c), F.col(f"__a_{c}")), F.lit(0.0)) for c in columns}).select(*df.columns)


def quantiles(df: DataFrame, column: str, points: Sequence[float], name: str = "q") -> DataFrame:
    """One row with ``name``, the exact quantiles between neighbouring ranks; distinct values are counted and summed in ranges, so no task holds them all."""
    from .frame import running_total

    counts = df.select(F.col(column).cast("double").alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    upto = running_total(counts, ["v"], "n", "upto")
    at = upto.crossJoin(F.broadcast(upto.agg(F.max("upto").alias("all"))))
    place = [F.lit(float(p)) * (F.col("all") - 1) for p in points]
    low = [F.min(F.when(F.col("upto") > F.floor(h), F.col("v"))).alias(f"a{i}") for i, h in enumerate(place)]
    high = [F.min(F.when(F.col("upto") > F.ceil(h), F.col("v"))).alias(f"b{i}") for i, h in enumerate(place)]
    between = [F.when(F.col(f"a{i}") == F.col(f"b{i}"), F.col(f"a{i}")).otherwise(F.col(f"a{i}") + (F.col(f"b{i}") - F.col(f"a{i}")) * (h - F.floor(h))) for i, h in enumerate(place)]
    return at.agg(F.max("all").alias("all"), *low, *high).select(F.array(*between).alias(name))


def robust_scale(df: DataFrame, columns: Sequence[str], low: float = 0.25, high: float = 0.75) -> DataFrame:
    q = lambda c, i: F.get(F.col(f"__q_{c}"), F.lit(i))
    out = df
    for c in columns:
        out = out.crossJoin(F.broadcast(quantiles(df, c, (low, 0.5, high), f"__q_{c}")))
    out = out.withColumns({c: (F.col(c) - q(c, 1)) / F.when(q(c, 2) > q(c, 0), q(c, 2) - q(c, 0)).otherwise(1.0) for c in columns})
    return out.select(*df.columns)


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """Each distinct value and its place in their order."""
    from .frame import with_row_id

    return with_row_id(df.select(column).where(F.col(column).isNotNull()).distinct(), [column], "code")


def one_hot(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.withColumns({f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in values})


def quantile_bins(df: DataFrame, column: str, n: int) -> DataFrame:
    """Bins of equal counts."""
    out = df.crossJoin(F.broadcast(quantiles(df, column, [i / n for i in range(1, n)], "__e")))
    code = F.size(F.filter("__e", lambda e: F.col(column) >= e))
    return out.withColumn(f"{column}_bin", F.when(F.col(column).isNotNull(), code)).drop("__e")


def impute(df: DataFrame, columns: Sequence[str], how: str = "mean") -> DataFrame:
    if how == "median":
        out = df
        for c in columns:
            out = out.crossJoin(F.broadcast(quantiles(df, c, [0.5], f"__i_{c}")))
        return out.withColumns({c: F.coalesce(c, F.get(f"__i_{c}", F.lit(0))) for c in columns}).select(*df.columns)
    of = {"mean": F.avg, "most_frequent": F.mode}[how]
    out = _one_row(df, *[of(c).alias(f"__i_{c}") for c in columns])
    return out.withColumns({c: F.coalesce(c, F.col(f"__i_{c}")) for c in columns}).select(*df.columns)


def impute_below_limit(c: Column, limit: Column, share: float = 0.5) -> Column:
    return F.when(c < limit, limit * share).otherwise(c)


def clr(columns: Sequence[str]) -> dict[str, Column]:
    """Log of each part over the geometric mean of all."""
    mean = sum((F.ln(c) for c in columns), F.lit(0.0)) / len(columns)
    return {f"clr_{c}": F.ln(c) - mean for c in columns}


def alr(columns: Sequence[str]) -> dict[str, Column]:
    """Log of each part over the last."""
    return {f"alr_{c}": F.ln(F.col(c) / F.col(columns[-1])) for c in columns[:-1]}


def ilr(columns: Sequence[str]) -> list[Column]:
    """Orthonormal log ratios of each part against the geometric mean of those before it."""
    out = []
    for i in range(1, len(columns)):
        mean = sum((F.ln(c) for c in columns[:i]), F.lit(0.0)) / i
        out.append((F.lit(math.sqrt(i / (i + 1))) * (mean - F.ln(columns[i]))).alias(f"ilr_{i}"))
    return out


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    return df.groupBy(truth, guess).agg(F.count(F.lit(1)).alias("n"))


def binary_metrics(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Accuracy, precision, recall, F1, kappa, correlation and balanced accuracy from four counts."""
    t, g = F.col(truth) == 1, F.col(guess) == 1
    c = df.agg(F.count_if(t & g).cast("double").alias("tp"), F.count_if(~t & g).cast("double").alias("fp"), F.count_if(t & ~g).cast("double").alias("fn"), F.count_if(~t & ~g).cast("double").alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    chance = ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)
    return c.select(
        ((tp + tn) / n).alias("accuracy"), F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"), F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"),
        F.try_divide((tp + tn) / n - chance, 1 - chance).alias("kappa"), F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))).alias("mcc"), ((F.try_divide(tp, tp + fn) + F.try_divide(tn, tn + fp)) / 2).alias("balanced"),
    )


def regression_metrics(df: DataFrame, truth: str, guess: str) -> DataFrame:
    e = F.col(truth) - F.col(guess)
    return df.agg(F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(F.abs(F.try_divide(e, F.col(truth)))).alias("mape"), (1 - F.sum(e * e) / (F.var_pop(truth) * F.count(truth))).alias("r2"), (1 - F.var_pop(e) / F.var_pop(truth)).alias("explained"))


def fold_of(key: Column, folds: int, seed: int = 0) -> Column:
    """The same fold for the same key, whatever the partitions; a group's key keeps it whole."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(folds)).cast("int")


def train_test(df: DataFrame, key: str, share: float, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    test = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000)) < int(share * 1_000_000)
    return df.where(~test), df.where(test)


def linear_fit(df: DataFrame, features: Sequence[str], target: str, ridge: float = 0.0) -> dict[str, float]:
    """Least squares from one aggregation of products; the driver solves a system as large as the features."""
    import numpy as np

    names = ["1", *features]
    c = {n: F.lit(1.0) if n == "1" else F.col(n).cast("double") for n in names}
    sums = [F.sum(c[a] * c[b]) for i, a in enumerate(names) for b in names[i:]] + [F.sum(c[a] * F.col(target)) for a in names]
    row = list(df.dropna(subset=[*features, target]).agg(*[s.alias(str(i)) for i, s in enumerate(sums)]).first())
    k = len(names)
    xx = np.zeros((k, k))
    xx[np.triu_indices(k)] = row[: k * (k + 1) // 2]
    xx = xx + xx.T - np.diag(np.diag(xx))
    xx[np.arange(1, k), np.arange(1, k)] += ridge
    return dict(zip(names, np.linalg.solve(xx, np.array(row[k * (k + 1) // 2 :])).tolist()))


def linear_predict(weights: dict[str, float]) -> Column:
    return sum((F.col(n) * w for n, w in weights.items() if n != "1"), F.lit(weights["1"]))


def cross_validate(df: DataFrame, fold: Column, folds: int, features: Sequence[str], target: str, ridge: float = 0.0) -> DataFrame:
    """``fold, rows, rmse``: each fold predicted by a line fitted to the others. One aggregation a fold, and one for all errors."""
    marked = df.withColumn("__fold", fold)
    error = F.lit(None).cast("double")
    for k in range(folds):
        weights = linear_fit(marked.where(F.col("__fold") != k), features, target, ridge)
        error = F.when(F.col("__fold") == k, F.col(target) - linear_predict(weights)).otherwise(error)
    return marked.withColumn("__e", error).groupBy(F.col("__fold").alias("fold")).agg(F.count("__e").alias("rows"), F.sqrt(F.avg(F.col("__e") * F.col("__e"))).alias("rmse"))


def assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip").transform(df)


def estimator(kind: str, **options):
    """Library estimators by short name."""
    from pyspark.ml import classification, clustering, feature, regression

    table = {
        "logistic": classification.LogisticRegression, "tree": classification.DecisionTreeClassifier, "forest": classification.RandomForestClassifier, "boosting": classification.GBTClassifier, "bayes": classification.NaiveBayes,
        "linear": regression.LinearRegression, "tree_regression": regression.DecisionTreeRegressor, "forest_regression": regression.RandomForestRegressor, "boosting_regression": regression.GBTRegressor,
        "kmeans": clustering.KMeans, "mixture": clustering.GaussianMixture, "pca": feature.PCA,
    }
    return table[kind](**options)


def nearest(queries: DataFrame, library: DataFrame, key: str, vector: str, k: int, block: int = 2048) -> DataFrame:
    """The k other rows with the largest dot product (the least angle between unit vectors), exactly; of equals the larger key.

    Both sides are dealt into blocks of about ``block`` rows by hash; each pair of blocks is one matrix product, and the best of
    all blocks are merged. Rows with a null key, or a null or NaN in the vector, and pairs of unlike lengths, have no product.
    """
    import numpy as np
    import pyarrow as pa

    rows = lambda df: df.select(F.col(key), F.col(vector).cast("array<double>").alias(vector)).where(F.col(key).isNotNull() & F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x))).distinct()
    asked, known = rows(queries), rows(library)
    across, down = (max(1, -(-df.count() // block)) for df in (asked, known))
    place = lambda n: F.pmod(F.xxhash64(key, vector), F.lit(n))
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = asked.select("*", place(across).alias("__i")).select("*", copies(down).alias("__j"))
    known = known.select("*", place(down).alias("__j")).select("*", copies(across).alias("__i"))
    kind = asked.schema[key].dataType.simpleString()

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        q, l, s = [], [], []
        by_length = lambda t: {n: np.flatnonzero(size == n) for size in [np.array(t.column(vector).combine_chunks().value_lengths())] for n in np.unique(size)}
        there = by_length(right)
        for n, own in by_length(left).items():
            if n not in there:
                continue
            parts = [(t.column(key).take(pa.array(at)), np.array(t.column(vector).take(pa.array(at)).combine_chunks().flatten()).reshape(len(at), n)) for t, at in ((left, own), (right, there[n]))]
            (qk, a), (lk, b) = ((np.array(keys.to_pylist()), m) for keys, m in parts)
            near = a @ b.T
            near[qk[:, None] == lk] = -np.inf
            least = np.partition(near, max(0, len(lk) - k), axis=1)[:, max(0, len(lk) - k)]
            # a little below the k-th, so that rounding by the product's layout decides nothing
            r, c = np.nonzero((near >= least[:, None] - 1e-9 * (1 + np.abs(least[:, None]))) & (near > -np.inf))
            exact = (a[r] * b[c]).sum(axis=1)
            order = np.lexsort((lk[c], exact, r))[::-1]
            r, c, exact = r[order], c[order], exact[order]
            top = np.arange(len(r)) - np.searchsorted(-r, -r) < k
            q.append(qk[r[top]]), l.append(lk[c[top]]), s.append(exact[top])
        of = lambda x, t: pa.array(np.concatenate(x).tolist() if x else [], type=t)
        return pa.table({"q": of(q, left.schema.field(key).type), "l": of(l, right.schema.field(key).type), "s": of(s, pa.float64())})

    pairs = asked.groupBy("__i", "__j").cogroup(known.groupBy("__i", "__j")).applyInArrow(best, f"q {kind}, l {kind}, s double")
    best_of_all = pairs.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct("s", "l")), asc=False), 1, k).alias("b"))
    return best_of_all.select("q", F.posexplode("b").alias("rank", "b")).select("q", "rank", F.col("b.l").alias("l"), F.col("b.s").alias("similarity"))
