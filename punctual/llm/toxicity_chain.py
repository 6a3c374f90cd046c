"""Toxicity by classifier chain.

One linear model (logistic regression) for each category, in a fixed order. Each sees a document's
marker words, three figures of its writing and the probabilities of the categories before it. While
a later model is trained, earlier probabilities are out of fold: a row's come from a model that was
fitted without its fold. Marker words are those whose presence tells most about some category.

The labels at hand tell no kinds of toxicity, only toxic or not. So the chain of the query has two
links, low quality (whose probability the second one sees) and toxic; the first is no toxicity
category, and the chain shows its worth only with labels for several. It takes any list of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.llm.common import let, unit_hash, written

#: Category by name, as a condition on the labels.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}
FIGURES = ["capitals", "marks", "length"]
#: Lengths of the beginnings of words that count like words.
STEMS = (3, 5, 7)


def words_of(text: Column) -> Column:
    """The different words of letters of a text in lower case, and the beginnings of STEMS letters of longer ones, with a mark: derived forms share these."""
    words = F.array_distinct(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+"), ""))

    def stems(words: Column, n: int) -> Column:
        return F.array_distinct(F.transform(F.filter(words, lambda w: F.length(w) > n), lambda w: F.concat(F.substring(w, 1, n), F.lit("-"))))

    return let(words, lambda w: F.concat(w, *[stems(w, n) for n in STEMS]))


def figures(text: Column) -> list[Column]:
    """Share of capitals, share of marks, and log of the length."""
    t = F.coalesce(text, F.lit(""))
    less = lambda pattern: (F.length(t) - F.length(F.regexp_replace(t, pattern, ""))) / F.greatest(F.length(t), F.lit(1))
    return [less(r"[A-Z]+").alias("capitals"), less(r"[#*$%&|<>!]+").alias("marks"), F.log1p(F.length(t)).alias("length")]


def choose_words(train: DataFrame, categories: list[str], *, most: int = 1500, least_docs: int = 3) -> list[str]:
    """The vocabulary of the models, `most` words at most: those with the largest chi-square against any category, ties by word."""
    totals = train.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in categories]).first()
    n = totals["n"] or 0
    seen = train.select(F.explode("words").alias("word"), *categories).groupBy("word").agg(F.count("*").alias("df"), *[F.sum(c).alias(c) for c in categories])

    def chi(c: str) -> Column:
        good, all_ = float(totals[c] or 0), float(n)
        expect = F.col("df") * good / max(all_, 1.0)
        spread = expect * (1 - good / max(all_, 1.0)) * (1 - F.col("df") / max(all_, 1.0))
        return F.when(spread > 0, (F.col(c) - expect) * (F.col(c) - expect) / spread).otherwise(0.0)

    told = seen.where(F.col("df") >= least_docs).withColumn("tells", F.greatest(*[chi(c) for c in categories], F.lit(0.0)))
    return [r["word"] for r in told.orderBy(F.desc("tells"), "word").limit(most).collect()]


class Chain:
    """Fitted models in order, with the words they look at."""

    def __init__(self, categories: list[str], words: list[str], models: list[LogisticRegressionModel | float]):
        self.categories, self.words, self.models = categories, words, models

    def features(self, df: DataFrame, words: Column) -> DataFrame:
        """`df`, which has FIGURES, with the vector of marker words."""
        marked = df.withColumn("_marks", F.filter(words, lambda w: w.isin(self.words)) if self.words else F.array().cast("array<string>"))
        vector = CountVectorizerModel.from_vocabulary(self.words or ["\0"], inputCol="_marks", outputCol="_words", binary=True)
        return vector.transform(marked).drop("_marks")


def _with_probability(df: DataFrame, model: LogisticRegressionModel | float, inputs: list[str], name: str) -> DataFrame:
    """`df` with the probability `name` by a model, or the constant share where one class was all there was."""
    if isinstance(model, float):
        return df.withColumn(name, F.lit(model))
    assembled = VectorAssembler(inputCols=inputs, outputCol="_x").transform(df)
    return model.transform(assembled).withColumn(name, vector_to_array("_p")[1]).drop("_x", "_p", "_raw", "_label")


def _fit(df: DataFrame, inputs: list[str], category: str) -> LogisticRegressionModel | float:
    share = df.agg(F.avg(category)).first()[0]
    if share is None or share in (0.0, 1.0):
        return float(share or 0.0)
    assembled = VectorAssembler(inputCols=inputs, outputCol="_x").transform(df)
    lr = LogisticRegression(featuresCol="_x", labelCol=category, probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_label", regParam=0.001, maxIter=40)
    return lr.fit(assembled)


def fit(docs: DataFrame, labels: DataFrame, *, categories: dict[str, str] = CATEGORIES, most_rows: int = 6000, folds: int = 3, seed: int = 11) -> Chain:
    """Fit the chain on at most about `most_rows` whole labelled documents of each side of each category.

    Rows are sampled by the hash of their ids; documents without a label teach nothing.
    """
    names = list(categories)
    flags = [F.coalesce(F.expr(rule), F.lit(False)).cast("double").alias(name) for name, rule in categories.items()]
    known = labels.where("doc_id is not null").select(F.col("doc_id").alias("_id"), *flags).groupBy("_id").agg(*[F.max(c).alias(c) for c in names])
    sizes = known.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in names]).first()
    u = unit_hash("_id", F.lit(seed))
    wanted = []
    for c in names:
        yes = sizes[c] or 0.0
        for side, many in ((1.0, yes), (0.0, (sizes["n"] or 0) - yes)):
            wanted.append((F.col(c) == side) & (u < min(1.0, most_rows / max(many, 1.0))))
    # a row is in if its rarest side wants it: the bound is most_rows for each side
    rare = {c: (sizes[c] or 0.0) <= (sizes["n"] or 0) / 2 for c in names}
    picked = reduce(lambda a, b: a | b, [wanted[2 * i if rare[c] else 2 * i + 1] for i, c in enumerate(names)])
    picked = picked | reduce(lambda a, b: a & b, [wanted[2 * i + 1 if rare[c] else 2 * i] for i, c in enumerate(names)])
    sample = F.broadcast(known.where(picked))  # bounded by most_rows and the number of categories
    joined = docs.select(F.col("doc_id").alias("_id"), "text").join(sample, "_id")
    train = written(joined.select("_id", words_of(F.col("text")).alias("words"), *figures(F.col("text")), *names), "chain-sample")
    chain = Chain(names, choose_words(train, names), [])
    ready = chain.features(train.withColumn("fold", F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(folds))), F.col("words")).drop("words")
    ready = written(ready, "chain-features")
    inputs = ["_words", *FIGURES]
    for k, c in enumerate(names):
        chain.models.append(_fit(ready, inputs, c))
        if k < len(names) - 1:
            parts = []
            for f in range(folds):
                model = _fit(ready.where(F.col("fold") != f), inputs, c)
                parts.append(_with_probability(ready.where(F.col("fold") == f), model, inputs, f"p_{c}"))
            ready = written(reduce(DataFrame.unionByName, parts), f"chain-{c}")
            inputs = [*inputs, f"p_{c}"]
    return chain


def predict(docs: DataFrame, chain: Chain, *, threshold: float = 0.5) -> DataFrame:
    """doc_id, p_<category> for each category, and a boolean for each, true from `threshold` on.

    Null and empty texts have no words and are judged by that. Repeated rows have equal results, a
    null id is carried along, other columns are ignored; a probability of just `threshold` counts as true.
    """
    own = docs.select("doc_id", *figures(F.col("text")), words_of(F.col("text")).alias("_all"))
    now = chain.features(own, F.col("_all")).drop("_all")
    inputs = ["_words", *FIGURES]
    for c, model in zip(chain.categories, chain.models, strict=True):
        now = _with_probability(now, model, inputs, f"p_{c}")
        inputs = [*inputs, f"p_{c}"]
    return now.select("doc_id", *[f"p_{c}" for c in chain.categories], *[(F.col(f"p_{c}") >= threshold).alias(c) for c in chain.categories])


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labels and judge every document."""
    return predict(docs, fit(docs, labels))
