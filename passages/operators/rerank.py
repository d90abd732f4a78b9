"""Classification and reranking of the hits of each query."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml import Pipeline as MlPipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from passages.config import OTHER_LABEL
from passages.functions.classify import softmax, threshold_label
from passages.functions.text import preprocess
from passages.session import cut_lineage

#: Weights are added as decimals, so that their order does not show.
WEIGHT = "decimal(18,12)"
TOTAL = "decimal(34,12)"
#: Weights of a model that travel whole; those of rarer words meet the words of the texts in a salted join.
BROADCAST_WORDS = 100_000


def rerank(
    hits: DataFrame,
    score: Column | None = None,
    tag: Column | None = None,
    top: int | None = None,
) -> DataFrame:
    """Order the hits of a query by score (high first), then tag, then their old `pos`.

    A missing score counts as 0 and a missing tag as "". Adds `rank`, from 1; `top` keeps the
    first ranks only. The window holds the hits of one query.
    """
    by_score = F.coalesce(score if score is not None else F.lit(None).cast("double"), F.lit(0.0))
    by_tag = F.coalesce(tag if tag is not None else F.lit(None).cast("string"), F.lit(""))
    order = W.partitionBy("query_id").orderBy(by_score.desc(), by_tag, "pos")
    ranked = hits.withColumn("rank", F.row_number().over(order))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def reranked_indices(reranked: DataFrame, fields: list[str]) -> DataFrame:
    """Old place of each reranked hit; hits that agree in all `fields` share the first place."""
    same = W.partitionBy("query_id", *fields)
    return reranked.withColumn("index", F.min("pos").over(same))


def train_classifier(labelled: DataFrame, features: int = 4096) -> PipelineModel:
    """Word-count logistic regression over (text, label); save and load it as Spark ML does."""
    words = HashingTF(inputCol="words", outputCol="features", numFeatures=features)
    model = LogisticRegression(featuresCol="features", labelCol="label", maxIter=20, regParam=0.01)
    return MlPipeline(stages=[words, model]).fit(_with_words(labelled))


@dataclass
class NaiveBayesTable:
    """Multinomial naive Bayes as a table: weights(term, w_0, w_1, ...) with one weight per class, the
    number of its words, and the weights of the classes themselves. Other words weigh nothing."""

    priors: list[float]
    weights: DataFrame
    words: int

    def write(self, path: str) -> None:
        self.weights.write.mode("overwrite").parquet(f"{path}/weights")
        one = self.weights.sparkSession.createDataFrame([(self.priors, self.words)], "priors array<double>, words long")
        one.coalesce(1).write.mode("overwrite").parquet(f"{path}/model")

    @staticmethod
    def load(spark: SparkSession, path: str) -> NaiveBayesTable:
        model = spark.read.parquet(f"{path}/model").first()
        return NaiveBayesTable(list(model.priors), spark.read.parquet(f"{path}/weights"), model.words)

    def _split(self) -> tuple[DataFrame, DataFrame | None]:
        """The weights that may travel whole, and the others: those of words that are rare in every class."""
        if self.words <= BROADCAST_WORDS:
            return self.weights, None
        weight = F.greatest(*(F.col(f"w_{k}") for k in range(len(self.priors))), F.lit(None).cast(WEIGHT))
        share = 1 - BROADCAST_WORDS / self.words
        edge = self.weights.agg(F.percentile_approx(weight, share, 10_000)).first()[0]
        return self.weights.where(weight > edge), self.weights.where(weight <= edge)

    def score(self, df: DataFrame, salt: int = 8) -> DataFrame:
        """Adds `probabilities`. The words of equal texts are counted together and shared out.

        Weights of the heaviest words travel whole, so their sums are made on the row of the text; only a sum per text
        and its other words are shuffled, and these meet their weights in a salted join.
        """
        keyed = df.withColumn("_key", F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)))
        words = F.coalesce(F.col("words"), F.array().cast("array<string>"))
        names = [f"w_{k}" for k in range(len(self.priors))]
        known, others = self._split()
        nothing = F.lit(0).cast(WEIGHT)
        # A null word per row counts the copies of a text, so no list is empty (which a plain explode would test on a list made twice).
        met = (
            _with_words(keyed.select("_key", "text"))
            .select("_key", F.explode_outer(F.concat(words, F.array(F.lit(None).cast("string")))).alias("term"))
            .join(F.broadcast(known.withColumn("_met", F.lit(True))), "term", "left")
        )
        sums = [F.sum(F.coalesce(F.col(c), nothing)).cast(TOTAL).alias(c) for c in names]
        copies = F.count_if(F.col("term").isNull()).alias("_copies")
        if others is not None:
            # No word holds a space: the sum of a text meets no weight, and is dealt by its text.
            place = F.when(F.col("term").isNull() | F.col("_met"), F.concat(F.lit(" "), F.hex("_key"))).otherwise(F.col("term"))
            counted = met.withColumn("_place", place).groupBy("_key", "_place").agg(
                F.count(F.lit(1)).cast("decimal(18,0)").alias("_tf"), copies, *sums
            )
            dealt = counted.withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(salt)).cast("int"))
            spread = others.select(
                F.col("term").alias("_place"),
                *(F.col(c).alias(f"_{c}") for c in names),
                F.explode(F.sequence(F.lit(0), F.lit(salt - 1))).alias("_salt"),
            )
            met = dealt.join(spread, ["_place", "_salt"], "left")
            part = lambda c: F.col(c) + (F.col("_tf") * F.coalesce(F.col(f"_{c}"), nothing)).cast(TOTAL)
            sums = [F.sum(part(c)).cast(TOTAL).alias(c) for c in names]
            copies = F.sum("_copies").alias("_copies")
        sums = met.groupBy("_key").agg(copies, *sums)
        logits = F.array(*(F.lit(p) + F.col(c).cast("double") / F.col("_copies") for p, c in zip(self.priors, names)))
        return keyed.join(sums.select("_key", softmax(logits).alias("probabilities")), "_key", "left").drop("_key")


def train_naive_bayes(labelled: DataFrame) -> NaiveBayesTable:
    """Multinomial naive Bayes on the counts of all words over (text, label), with one added to every count.

    Labels are 0, 1, ...; only numbers per label meet on the driver, the words stay in a table.
    """
    rows = {int(r.label): r.n for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    labels = range(max(rows, default=-1) + 1)
    counts = (
        # A text has a word at least, if only an empty one.
        _with_words(labelled.where(F.col("text").isNotNull()))
        .select(F.col("label").cast("int").alias("label"), F.explode_outer("words").alias("term"))
        .groupBy("term")
        .agg(*(F.count(F.when(F.col("label") == k, 1)).alias(f"tf_{k}") for k in labels))
    )
    # Read again for the totals, and for the weights of frequent and of rare words.
    counts = cut_lineage(counts)
    found = counts.agg(F.count(F.lit(1)).alias("words"), *(F.sum(f"tf_{k}").alias(f"tf_{k}") for k in labels)).first()
    weights = counts.select(
        "term",
        *(
            (F.log(F.col(f"tf_{k}") + 1.0) - math.log(max(1, (found[f"tf_{k}"] or 0) + found.words))).cast(WEIGHT).alias(f"w_{k}")
            for k in labels
        ),
    )
    return NaiveBayesTable([math.log(rows.get(k, 0) + 1) for k in labels], weights, found.words)


def _with_words(df: DataFrame) -> DataFrame:
    return df.withColumn("words", F.split(preprocess(F.col("text")), " "))


def classify(
    df: DataFrame,
    model: PipelineModel | NaiveBayesTable,
    classes: list[str],
    threshold: float = 0.2,
    other: str = OTHER_LABEL,
) -> DataFrame:
    """Adds `probabilities` and `predicted_tag`."""
    if isinstance(model, NaiveBayesTable):
        scored = model.score(df)
    else:
        scored = model.transform(_with_words(df)).withColumn(
            "probabilities", vector_to_array("probability")
        )
    labels = F.array(*[F.lit(c) for c in classes])
    return scored.withColumn(
        "predicted_tag", threshold_label(F.col("probabilities"), labels, threshold, other)
    ).drop("words", "features", "rawPrediction", "probability", "prediction")
