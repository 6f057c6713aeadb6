"""Classifiers to choose from: feature layouts and losses, selection by macro-F1, choice of a threshold, learning curves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, OneVsRest
from pyspark.ml.feature import IDF, HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querymill.operators.ml import char_grams

#: A block of features: column, kind of n-gram, shortest and longest.
Block = tuple[str, str, int, int]

#: Layouts of an attribute span: itself, its words, the words around it, and the query with all attributes masked.
LAYOUTS: dict[str, list[Block]] = {
    "span": [("span_text", "char", 2, 4)],
    "span+words": [("span_text", "char", 2, 4), ("span_text", "word", 1, 2)],
    "span+context": [("span_text", "char", 2, 4), ("masked_others", "word", 1, 2)],
    "span+masked": [("span_text", "char", 2, 4), ("masked_all", "char", 2, 4)],
}
#: Layouts of a query for its brand.
QUERY_LAYOUTS: dict[str, list[Block]] = {"char": [("text", "char", 2, 4)], "words+char": [("text", "char", 2, 4), ("text", "word", 1, 2)]}


def word_grams(c: Column, low: int, high: int) -> Column:
    """Runs of words by white space, in lower case; null and '' have none."""
    w = F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda x: x != "")
    at = lambda n: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.array(*[at(n) for n in range(low, high + 1)]))


class TextModel:
    """TF-IDF of hashed n-grams of one or more blocks, and a logistic loss over all classes at once or each against the rest."""

    def __init__(self, blocks: list[Block], one_vs_rest: bool = False, balanced: bool = False, features: int = 1 << 11, least: int = 2, rows: int = 50_000, steps: int = 25):
        """``least``: rows in which a feature must occur; ``rows``: at most so many are fitted on; ``balanced``: classes weigh the same."""
        self.blocks, self.one_vs_rest, self.balanced, self.features, self.least, self.rows, self.steps = blocks, one_vs_rest, balanced, features, least, rows, steps

    def _grams(self, df: DataFrame) -> DataFrame:
        grams = {f"g{i}": (char_grams if kind == "char" else word_grams)(F.col(c), low, high) for i, (c, kind, low, high) in enumerate(self.blocks)}
        return df.withColumns(grams)

    def fit(self, train: DataFrame, label: str = "label", weight: str | None = None) -> TextModel:
        """Fitted on at most ``rows`` rows in the order of a digest of their texts."""
        texts = sorted({b[0] for b in self.blocks})
        used = train.where(F.col(label).isNotNull()).orderBy(F.md5(F.concat_ws("|", label, *texts)), label, *texts).limit(self.rows)
        self.labels = [r[0] for r in used.select(label).distinct().orderBy(label).collect()]
        y = F.array_position(F.array(*[F.lit(x) for x in self.labels]), F.col(label)) - 1
        w = F.col(weight) if weight else F.lit(1.0)
        if self.balanced:
            # of a bounded sample
            n = used.groupBy(label).agg(F.count(F.lit(1)).alias("n__"))
            used = used.join(n, label).withColumn("w__", w * F.sum(F.lit(1)).over(Window.partitionBy(F.lit(1))) / (len(self.labels) * F.col("n__")))
        else:
            used = used.withColumn("w__", w)
        stages = []
        for i in range(len(self.blocks)):
            stages += [HashingTF(numFeatures=self.features, inputCol=f"g{i}", outputCol=f"t{i}"), IDF(minDocFreq=self.least, inputCol=f"t{i}", outputCol=f"f{i}")]
        one = LogisticRegression(labelCol="y__", weightCol="w__", maxIter=self.steps, regParam=0.003)
        loss = OneVsRest(classifier=one, labelCol="y__", weightCol="w__", parallelism=4) if self.one_vs_rest else one
        stages += [VectorAssembler(inputCols=[f"f{i}" for i in range(len(self.blocks))], outputCol="features"), loss]
        self.model = Pipeline(stages=stages).fit(self._grams(used.withColumn("y__", y.cast("double"))))
        return self

    def predict(self, df: DataFrame, top: int = 1) -> DataFrame:
        """Adds ``top, p1`` and, with ``top`` above 1, ``ranked``: the ``top`` best (label, p) in order, ties by label."""
        out = self.model.transform(self._grams(df))
        if self.one_vs_rest:
            odds = F.transform(vector_to_array("rawPrediction"), lambda r: 1 / (1 + F.exp(-r)))
            p = F.transform(odds, lambda x: x / F.aggregate(odds, F.lit(0.0), lambda a, b: a + b))
        else:
            p = vector_to_array("probability")
        names = F.array(*[F.lit(x) for x in self.labels])
        order = F.array_sort(F.transform(p, lambda x, i: F.struct((-x).alias("neg"), i.alias("i"))))
        ranked = F.transform(F.slice(order, 1, top), lambda o: F.struct(F.get(names, o["i"]).alias("label"), (-o["neg"]).alias("p")))
        out = out.select(*df.columns, ranked.alias("ranked")).withColumn("top", F.col("ranked")[0]["label"]).withColumn("p1", F.col("ranked")[0]["p"])
        return out if top > 1 else out.drop("ranked")


def macro_f1(df: DataFrame, by: list[str], true: str, pred: str) -> DataFrame:
    """``by, n, accuracy, macro_f1`` over all labels that are true or predicted; one row a pair of labels is gathered."""
    pairs = df.groupBy(*by, F.col(true).alias("t"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("k"))
    side = F.explode(F.array(F.struct(F.col("t").alias("label"), F.col("k").alias("a"), F.lit(0).cast("long").alias("b")), F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("a"), F.col("k").alias("b"))))
    hit = F.when(F.col("t") == F.col("p"), F.col("k")).otherwise(0)
    per = pairs.select(*by, side.alias("x"), hit.alias("h")).groupBy(*by, "x.label").agg(F.sum("x.a").alias("a"), F.sum("x.b").alias("b"), F.sum(F.when(F.col("x.a") > 0, F.col("h")).otherwise(0)).alias("h"))
    return per.groupBy(*by).agg(F.sum("a").alias("n"), F.round(F.sum("h") / F.sum("a"), 6).alias("accuracy"), F.round(F.avg(2 * F.col("h") / (F.col("a") + F.col("b"))), 6).alias("macro_f1"))


def select_model(models: dict[str, TextModel], train: DataFrame, held: DataFrame, label: str = "label") -> tuple[str, DataFrame]:
    """(the name of the best model, report): all are fitted, and compared by macro-F1 on held-out rows, then accuracy, then name.

    The report is ``model, n, accuracy, macro_f1, chosen``.
    """
    all_ = None
    for name, m in models.items():
        p = m.fit(train, label).predict(held).select(F.lit(name).alias("model"), label, "top")
        all_ = p if all_ is None else all_.unionByName(p)
    report = macro_f1(all_, ["model"], label, "top")
    rows = sorted(report.collect(), key=lambda r: (-r["macro_f1"], -r["accuracy"], r["model"]))
    best = rows[0]["model"] if rows else next(iter(models))
    return best, held.sparkSession.createDataFrame([(*r, r["model"] == best) for r in rows], "model string, n long, accuracy double, macro_f1 double, chosen boolean")


#: Thresholds tried, and the least that is taken.
GRID, FLOOR = [round(0.35 + 0.05 * i, 2) for i in range(12)], 0.55


def choose_tau(df: DataFrame, true: str, top: str, p1: str, grid: list[float] | None = None, floor: float = FLOOR) -> DataFrame:
    """``tau, macro_f1, accuracy, coverage, chosen``: rows below a threshold are UNKNOWN; chosen is that of the best macro-F1 from ``floor`` on, then of the greatest coverage, then the smallest."""
    taus = F.explode(F.array(*[F.lit(t) for t in grid or GRID])).alias("tau")
    tried = df.select(F.col(true).alias("y"), F.col(top).alias("top"), F.col(p1).alias("p1"), taus).withColumn("pred", F.when(F.col("p1") >= F.col("tau"), F.col("top")).otherwise("UNKNOWN"))
    cover = tried.groupBy("tau").agg(F.round(F.avg((F.col("pred") != "UNKNOWN").cast("int")), 6).alias("coverage"))
    out = macro_f1(tried, ["tau"], "y", "pred").join(cover, "tau")
    # one row a threshold
    rank = F.row_number().over(Window.partitionBy(F.col("tau") >= floor).orderBy(F.desc("macro_f1"), F.desc("coverage"), "tau"))
    return out.select("tau", "macro_f1", "accuracy", "coverage", ((F.col("tau") >= floor) & (rank == 1)).alias("chosen"))


def learning_curve(fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], train: DataFrame, shares: list[float], key: str) -> list[tuple[float, int, DataFrame]]:
    """(share, rows, what the fitted model makes of the held-out rows) on growing parts of the training rows, each holding the ones before."""
    h = F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit("curve"))), 1, 6), 16, 10).cast("double") / (1 << 24)
    out = []
    for share in shares:
        part = train.where(h < share)
        out.append((share, part.count(), fit(part)))
    return out
