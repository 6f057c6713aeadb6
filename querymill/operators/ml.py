"""Learned operators: TF-IDF similarity, nearest vectors, brand classifier, sequence tagger, relevance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import PCA, HashingTF, VectorAssembler, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querymill.functions.text import jaccard, plain_tokens, word_shape
from querymill.sources.tables import spread, stage


def char_grams(c: Column, low: int, high: int) -> Column:
    """Character n-grams of each word with a space at either end; null and '' have none."""
    words = F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != "")

    def of(w: Column) -> Column:
        p = F.concat(F.lit(" "), w, F.lit(" "))
        at = lambda n: F.when(F.length(p) >= n, F.transform(F.sequence(F.lit(1), F.length(p) - n + 1), lambda i: F.substring(p, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
        return F.flatten(F.array(*[at(n) for n in range(low, high + 1)]))

    return F.flatten(F.transform(words, of))


def tfidf(docs: DataFrame, terms: Column, idf_from: DataFrame | None = None) -> DataFrame:
    """``id, term, w``: term counts times ``ln((1 + n) / (1 + df)) + 1``, of unit length per id."""
    tf = docs.select("id", F.explode(terms).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    if idf_from is None:
        df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        n = tf.agg(F.count_distinct("id").alias("n"))
        idf_from = df.crossJoin(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = tf.join(idf_from, "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "id").select("id", "term", (F.col("w") / F.col("norm")).alias("w"))


def idf(docs: DataFrame, terms: Column) -> DataFrame:
    """``term, idf`` of a collection."""
    tf = docs.select("id", F.explode(F.array_distinct(terms)).alias("term"))
    n = tf.agg(F.count_distinct("id").alias("n"))
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def retrieve(queries: DataFrame, reference: DataFrame, low: int = 2, high: int = 4, digits: int = 5) -> DataFrame:
    """``id, ref_id, score``: for each text (id, text) the entry of the reference list (id, text) of the greatest cosine, ties by ref_id.

    Weights are the reference list's, so texts share a term with an entry only through its inverted index.
    """
    g = char_grams(F.col("text"), low, high)
    weights = idf(reference, g)
    a, b = tfidf(queries, g, weights), tfidf(reference, g, weights).withColumnRenamed("id", "ref_id").withColumnRenamed("w", "v")
    score = a.join(b, "term").groupBy("id", "ref_id").agg(F.round(F.sum(F.col("w") * F.col("v")), digits).alias("score"))
    return score.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("neg"), "ref_id")).alias("m")).select("id", "m.ref_id", (-F.col("m.neg")).alias("score"))


def nearest(vectors: DataFrame, k: int = 10, every: int = 50, block: int = 4096, digits: int = 5) -> DataFrame:
    """``query_id, vec_id, score, rn``: the k nearest by cosine of every vector (vec_id, embedding) whose id is divisible by ``every``, exact.

    The queries are sent in blocks of bounded size, and each block meets all vectors in one matrix product a batch;
    every batch keeps its own k best, which are merged. Null and zero vectors are left out; ties by id.
    """
    usable = vectors.where("embedding IS NOT NULL AND size(embedding) > 0").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    asked = usable.where(F.col("vec_id") % every == 0)
    out, ids, rows = None, [], []

    def over(ids: list[int], rows: list[list[float]]) -> DataFrame:
        q = np.array(rows)
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)

        def best(batches):  # noqa: ANN001, ANN202
            for pdf in batches:
                x = np.array(pdf["e"].tolist())
                norm = np.linalg.norm(x, axis=1)
                x, own = x[norm > 0] / norm[norm > 0, None], pdf["vec_id"].to_numpy()[norm > 0]
                if not len(own):
                    continue
                s = np.round(q @ x.T, digits)
                top = min(k + 1, len(own))
                for i, qid in enumerate(ids):
                    order = np.lexsort((own, -s[i]))[:top]
                    yield pd.DataFrame({"query_id": qid, "vec_id": own[order], "score": s[i][order]})

        return usable.mapInPandas(best, "query_id long, vec_id long, score double").where("query_id <> vec_id")

    for r in asked.toLocalIterator():
        ids.append(r["vec_id"])
        rows.append(r["e"])
        if len(ids) == block:
            part = over(ids, rows)
            out, ids, rows = part if out is None else out.unionByName(part), [], []
    if ids or out is None:
        part = over(ids or [0], rows or [[0.0]])
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


class BrandClassifier:
    """Multinomial logistic regression over hashed character n-grams."""

    def __init__(self, features: int = 1 << 12, rows: int | None = None):
        self.features, self.rows = features, rows

    def _vectors(self, df: DataFrame) -> DataFrame:
        grams = df.withColumn("grams", char_grams(F.col("text"), 2, 4))
        return HashingTF(numFeatures=self.features, inputCol="grams", outputCol="features").transform(grams)

    def fit(self, train: DataFrame) -> BrandClassifier:
        """``train``: text, label (string), weight; equal rows are one of their summed weight. All are fitted on, unless ``rows`` asks for the first so many in a fixed random order."""
        used = train.groupBy("text", "label").agg(F.sum("weight").alias("weight"))
        # staged, as the loss checks labels below a limit too, where some may be of no class drawn
        used = stage(used if self.rows is None else used.orderBy(F.md5("text"), "text", "label").limit(self.rows), "used")
        self.labels = [r[0] for r in used.select("label").distinct().orderBy("label").collect()]
        ids = F.array_position(F.array(*[F.lit(x) for x in self.labels]), F.col("label")) - 1
        self.model = LogisticRegression(maxIter=30, regParam=0.003, weightCol="weight", elasticNetParam=0.0).fit(self._vectors(spread(used).withColumn("label", ids.cast("double"))))
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds ``top, p1, margin``."""
        names = F.array(*[F.lit(x) for x in self.labels])
        p = vector_to_array("probability")
        order = F.reverse(F.array_sort(F.transform(p, lambda x, i: F.struct(x.alias("p"), (-i).alias("i")))))
        out = self.model.transform(self._vectors(df)).withColumn("o", order)
        second = F.coalesce(F.get("o", F.lit(1))["p"], F.lit(0.0))
        return out.select(*df.columns, F.element_at(names, 1 - F.get("o", F.lit(0))["i"]).alias("top"), F.get("o", F.lit(0))["p"].alias("p1"), (F.get("o", F.lit(0))["p"] - second).alias("margin"))


def token_features(t: Column) -> Column:
    """For each token its own features and its neighbours' as strings."""

    def own(x: Column, at: str) -> list[Column]:
        low = F.lower(x)
        return [F.concat(F.lit(f"{at}:"), v) for v in (low, F.substring(low, 1, 3), F.right(low, F.lit(3)), word_shape(x))]

    def of(x: Column, i: Column) -> Column:
        parts = own(x, "0")
        for d in (-2, -1, 1, 2):
            parts += own(F.coalesce(F.when(i + d >= 0, F.get(t, i + d)), F.lit("<edge>")), str(d))[:1]
        return F.array(*parts)

    return F.transform(t, of)


def viterbi(scores: np.ndarray, moves: np.ndarray) -> list[int]:
    """The path of the greatest sum of scores (tokens x tags) and moves (tags x tags)."""
    best, back = scores[0], []
    for s in scores[1:]:
        total = best[:, None] + moves
        back.append(total.argmax(0))
        best = total.max(0) + s
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


class Tagger:
    """Sequence tagger: logistic regression for each token, transitions from counts, Viterbi over both."""

    def __init__(self, features: int = 1 << 13, rows: int | None = None):
        self.features, self.rows = features, rows

    def _tokens(self, df: DataFrame) -> DataFrame:
        t = df.select("id", F.posexplode(F.arrays_zip(token_features(F.col("tokens")).alias("f"), F.col("tags").alias("tag") if "tags" in df.columns else F.transform("tokens", lambda _: F.lit("O")).alias("tag"))).alias("pos", "x")).select("id", "pos", "x.f", "x.tag")
        return HashingTF(numFeatures=self.features, inputCol="f", outputCol="features", binary=True).transform(t)

    def fit(self, train: DataFrame) -> Tagger:
        """``train``: id, tokens, tags; fitted on all sentences, unless ``rows`` asks for the first so many in a fixed random order. An I- may follow only its own kind."""
        used = train.where("size(tokens) > 0").select("id", "tokens", "tags")
        used = stage(used if self.rows is None else used.orderBy(F.md5(F.col("id").cast("string")), "id").limit(self.rows), "used")
        follows = F.arrays_zip(F.col("tags").alias("tag"), F.slice("tags", 2, F.size("tags")).alias("nxt"))
        pairs = used.select(F.explode(follows).alias("x")).groupBy("x.tag", "x.nxt").count().collect()
        self.tags = sorted({r["tag"] for r in pairs})
        names = F.array(*[F.lit(x) for x in self.tags])
        t = self._tokens(spread(used))
        self.model = LogisticRegression(maxIter=30, regParam=0.001).fit(t.withColumn("label", (F.array_position(names, F.col("tag")) - 1).cast("double")))
        n = len(self.tags)
        counts = np.ones((n, n))
        for r in (x for x in pairs if x["nxt"] is not None):
            counts[self.tags.index(r["tag"]), self.tags.index(r["nxt"])] += r["count"]
        self.moves = np.log(counts / counts.sum(1, keepdims=True))
        for j, b in enumerate(self.tags):
            for i, a in enumerate(self.tags):
                if b.startswith("I-") and a[2:] != b[2:]:
                    self.moves[i, j] = -1e9
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        """``id, pred``: the tags of every sentence."""
        tags, moves = self.tags, self.moves

        @F.pandas_udf("array<string>")
        def decode(scores: pd.Series) -> pd.Series:
            return pd.Series([[tags[i] for i in viterbi(np.log(np.maximum(np.array(s.tolist()), 1e-12)), moves)] for s in scores])

        p = self.model.transform(self._tokens(df.where("size(tokens) > 0"))).select("id", "pos", vector_to_array("probability").alias("p"))
        return p.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "p"))).alias("s")).select("id", decode("s.p").alias("pred"))


def relevance(pairs: DataFrame, rows: int = 50_000) -> DataFrame:
    """``n_train, n_test, auc`` of a classifier of clicked pairs (id, query, name, brand, label): shared words, brand in query, sizes; fitted on at most ``rows`` pairs."""
    q, n = plain_tokens(F.col("query")), plain_tokens(F.col("name"))
    x = pairs.where("label IS NOT NULL AND query IS NOT NULL AND name IS NOT NULL").select(
        "id", F.col("label").cast("double").alias("label"), jaccard(q, n).alias("j"), F.coalesce(F.lower("query").contains(F.lower("brand")), F.lit(False)).cast("double").alias("b"), F.size(q).cast("double").alias("s"), F.size(n).cast("double").alias("m")
    )
    v = VectorAssembler(inputCols=["j", "b", "s", "m"], outputCol="features").transform(x).withColumn("h", F.md5(F.col("id").cast("string")))
    train, test = v.where("h >= '4'").orderBy("h").limit(rows), v.where("h < '4'")
    model = LogisticRegression(maxIter=20, regParam=0.01).fit(train)
    auc = BinaryClassificationEvaluator().evaluate(model.transform(test))
    return pairs.sparkSession.createDataFrame([(train.count(), test.count(), float(round(auc, 6)))], "n_train long, n_test long, auc double")


def principal(vectors: DataFrame, k: int = 2) -> DataFrame:
    """``vec_id, x``: vectors on their first k principal components."""
    v = vectors.where("embedding IS NOT NULL").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    return PCA(k=k, inputCol="v", outputCol="p").fit(v).transform(v).select("vec_id", vector_to_array("p").alias("x"))


def word_vectors(texts: DataFrame, size: int = 16, least: int = 5, parts: int = 8) -> DataFrame:
    """``word, vector`` learned from all texts (column ``text``); a word needs ``least`` occurrences in the whole table.

    ``parts`` tasks learn from a share of the texts each, and their vectors are averaged. The words are the same on any
    cluster; the vectors depend on the order in which a task meets its texts.
    """
    t = texts.where("text IS NOT NULL").select(plain_tokens(F.col("text")).alias("t"))
    return Word2Vec(vectorSize=size, minCount=least, seed=42, inputCol="t", outputCol="o", numPartitions=parts).fit(t).getVectors().select("word", vector_to_array("vector").alias("vector"))
