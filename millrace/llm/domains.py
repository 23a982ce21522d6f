"""Which source a document reads like: posteriors over labelled sources."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.scratch import keep

FEATURES = 1 << 13
LAYOUT_FEATURES = 1 << 10
#: Shares of the labelled rows, by a hash of the content: words, blend, and the rest held out.
FOLDS = 5
WORDS_FOLDS, BLEND_FOLDS = (0, 1), (2, 3)


def layout(text: Column, tokens: Column) -> Column:
    """How a text is laid out, as an array of marks: its size, lines, blocks, line length and how each line begins."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: F.trim(line) != "")
    n = F.greatest(F.size(lines), F.lit(1))
    blocks = F.size(F.split(F.coalesce(text, F.lit("")), r"\n[ \t\r]*\n"))
    step = lambda name, x: F.concat(F.lit(name), F.floor(F.log2(x + 1.0) * 2).cast("int").cast("string"))
    begins = F.transform(lines, lambda line: F.concat(F.lit("begins "), F.regexp_replace(F.regexp_replace(F.substring(F.ltrim(line), 1, 3), r"\p{L}", "a"), r"\p{N}", "9")))
    return F.concat(F.array(step("tokens ", tokens), step("lines ", n), step("blocks ", blocks), step("width ", tokens / n)), begins)


@dataclass
class DomainModel:
    """``posterior`` adds an array of probabilities in the order of ``domains``; ``held_out`` are labelled rows that took no part in the fit."""

    domains: list[str]
    words: Model | None
    blend: Model | None
    labels: list[str]
    prior: dict[str, float]
    held_out: DataFrame

    def posterior(self, rows: DataFrame) -> DataFrame:
        if self.words is None:
            return rows.withColumn("posterior", F.array(*[F.lit(float(self.prior.get(d, 0.0))) for d in self.domains]))
        if self.blend is None:
            scored = self.words.transform(HashingTF(inputCol="words", outputCol="__words", numFeatures=FEATURES).transform(rows)).withColumnRenamed("__p", "__probability")
        else:
            scored = self.blend.transform(_blended(self.words, rows))
        at = {d: i for i, d in enumerate(self.labels)}
        probability = vector_to_array("__probability")
        posterior = F.array(*[probability[at[d]] if d in at else F.lit(0.0) for d in self.domains])
        return scored.withColumn("posterior", posterior).select(*rows.columns, "posterior")

    def quality(self) -> DataFrame:
        """One row on the held-out rows: how many, share right, mean largest posterior, mean log loss, share of the most frequent source."""
        names = F.array(*[F.lit(d) for d in self.domains])
        scored = self.posterior(self.held_out).select("domain", F.array_max("posterior").alias("top"), F.element_at(names, F.array_position("posterior", F.array_max("posterior")).cast("int")).alias("best"), F.get("posterior", (F.array_position(names, F.col("domain")) - 1).cast("int")).alias("own"))
        most = F.lit(max(self.prior.values(), default=None))
        return scored.agg(F.count("*").alias("n"), F.avg((F.col("best") == F.col("domain")).cast("double")).alias("accuracy"), F.avg("top").alias("confidence"), F.avg(-F.log(F.greatest("own", F.lit(1e-12)))).alias("log_loss"), most.alias("largest_share"))


def _blended(words: Model, rows: DataFrame) -> DataFrame:
    """``rows`` with the features of the blend: layout marks and the log odds that the word model gives."""
    hashed = HashingTF(inputCol="words", outputCol="__words", numFeatures=FEATURES).transform(rows)
    hashed = HashingTF(inputCol="layout", outputCol="__layout", numFeatures=LAYOUT_FEATURES).transform(hashed)
    scored = words.transform(hashed)
    raw = vector_to_array("__raw")
    # per token, so that a long text isn't surer than a short one; the mean is taken off
    per = F.transform(raw, lambda x: (x - F.aggregate(raw, F.lit(0.0), lambda s, y: s + y) / F.size(raw)) / F.sqrt(F.size("words") + 1.0))
    scored = scored.withColumn("__odds", array_to_vector(per))
    return VectorAssembler(inputCols=["__layout", "__odds"], outputCol="__features").transform(scored)


def _numbered(rows: DataFrame, seen: list[str]) -> DataFrame:
    return rows.withColumn("__label", (F.array_position(F.array(*[F.lit(d) for d in seen]), F.col("domain")) - 1).cast("double"))


def _fit_words(rows: DataFrame) -> Model:
    hashed = HashingTF(inputCol="words", outputCol="__words", numFeatures=FEATURES).transform(rows).select("__label", "__words", "weight")
    return NaiveBayes(featuresCol="__words", labelCol="__label", weightCol="weight", probabilityCol="__p", rawPredictionCol="__raw", predictionCol="__pred").fit(hashed)


def fit_domains(labelled: DataFrame, domains: list[str], prior: dict[str, float]) -> DomainModel:
    """A classifier of documents into ``domains``.

    ``labelled``: domain, words, layout (arrays of strings), fold (0 .. FOLDS-1,
    by content, so that reposts stay together) and weight (the rows that a
    sampled one stands for).  A multinomial naive Bayes model over hashed words
    is fitted on two fifths; a multinomial logistic regression over layout marks
    and the first model's log odds on two others, which also calibrates the
    posteriors; the last fifth is held out for ``quality``.  A domain without a
    row in the second part gets 0.  Where a part has fewer than two domains
    the first model alone is fitted, on all labelled rows; where there are
    fewer than two domains at all the posterior is ``prior``.
    """
    held_out = labelled.where(F.col("fold") == FOLDS - 1)
    parts = [labelled.where(F.col("fold").isin(list(folds))) for folds in (WORDS_FOLDS, BLEND_FOLDS)]
    seen = [sorted(r[0] for r in p.select("domain").distinct().limit(len(domains) + 1).collect()) for p in parts]
    if min(len(s) for s in seen) < 2:
        every = sorted(r[0] for r in labelled.select("domain").distinct().limit(len(domains) + 1).collect())
        words = _fit_words(_numbered(labelled, every)) if len(every) > 1 else None
        return DomainModel(domains, words, None, every, prior, held_out)
    words = _fit_words(_numbered(parts[0], seen[0]))
    # written once, as the regression makes several passes
    blend_rows = keep(_blended(words, _numbered(parts[1], seen[1])).select("__label", "__features", "weight"), "domain-blend").df
    blend = LogisticRegression(featuresCol="__features", labelCol="__label", weightCol="weight", regParam=0.001, maxIter=20, family="multinomial", probabilityCol="__probability", rawPredictionCol="__raw2", predictionCol="__pred2").fit(blend_rows)
    return DomainModel(domains, words, blend, seen[1], prior, held_out)
