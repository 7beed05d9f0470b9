"""Uplift learners on Spark ML: M1-M16.

* Preprocessing (M1-M3): continuous features are assembled and standard
  scaled (mean and sd learnt on the training split only); categorical
  features are indexed (unseen levels go to the "keep" bucket, which is the
  dropped one-hot slot, so an unseen level encodes as all zeros) and one-hot
  encoded as sparse vectors.
* Learners (M4-M11): L2 logistic regression. S-learner design is
  ``[X, T, X*T]`` (``Interaction``); both potential outcomes come from two
  chained transforms of the same rows (no join). T-learner fits separate
  treated and control models.
* Selection (M12): all candidates score the validation rows in one chain of transforms; one
  long table (candidate, id, score) is sorted once for the areas above random of all of them. The
  first candidate wins ties.
* Evaluation (M13): the chosen model scores the untouched test split once;
  all held-out tables come from one :class:`RankedEvaluation`.
* Plug point (M16): any ``pyspark.ml`` classifier factory can replace the
  default logistic regression, and so can one of objects with ``fit(X, y)`` and ``predict_proba(X)``
  (:class:`LocalClassifier`) or of fitted models with ``predict_proba``; evaluators take any DataFrame with
  ``(id, treatment, outcome, p1, p0)``.

Objective scaling matches the reference's SGD (mean log loss plus
``alpha/2 * ||w||^2``); the solver is L-BFGS, so coefficients differ
slightly while the fitted model is the same optimum.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import (Interaction, OneHotEncoder, StandardScaler, StringIndexer,
                                VectorAssembler)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftlab.operators.ranking import (RankedEvaluation, candidate_auuc, cate_distribution,
                                       clip_probability, log_loss_col, predictive_diagnostics,
                                       rank_auc, rank_rows_counted)
from liftlab.operators.sampling import sample_rows, split_rows
from liftlab.session import small_table
from liftlab.spec import ExperimentSpec

# Fixed values of the modelling design.
REGULARIZATION_CANDIDATES = (1e-5, 1e-4)
DEFAULT_MAX_ITERATIONS = 20
TOLERANCE = 1e-4
PREDICTABILITY_C = 1.0
PREDICTABILITY_MAX_ITERATIONS = 200

#: A number of rows to fit on that leaves none out.
ALL_ROWS = math.inf

#: Rows on which a classifier outside Spark ML is fitted, at most.
LOCAL_FIT_ROWS = 2_000_000

FEATURES = "features"


# ---- M1-M3: preprocessing ------------------------------------------------------

def _scaling(spec: ExperimentSpec) -> list:
    return [VectorAssembler(inputCols=list(spec.continuous), outputCol="_cont"),
            StandardScaler(inputCol="_cont", outputCol="_cont_scaled",
                           withMean=True, withStd=True)] if spec.continuous else []


def build_preprocessor(spec: ExperimentSpec = ExperimentSpec(), output: str = FEATURES) -> Pipeline:
    spec.validate_model_features(list(spec.features))
    stages = _scaling(spec)
    parts = ["_cont_scaled"] if spec.continuous else []
    if spec.categorical:
        idx = [f"_{c}_idx" for c in spec.categorical]
        ohe = [f"_{c}_ohe" for c in spec.categorical]
        stages.append(StringIndexer(inputCols=list(spec.categorical), outputCols=idx,
                                    handleInvalid="keep", stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCols=idx, outputCols=ohe, dropLast=True))
        parts += ohe
    stages.append(VectorAssembler(inputCols=parts, outputCol=output))
    return Pipeline(stages=stages)


class LevelDictionary:
    """M1 for features of any number of levels: a table (feature, level, slot, rows).

    Levels are counted (map-side first), put in order by one range sort and numbered within their
    feature; they never reach the driver, which holds one count per feature. Rows get their slots by
    joins on the level. Levels with more than a :data:`HOT_LEVELS`th of all rows (so at most as many)
    are looked up by broadcast, and their rows, like those without a level, are spread over the join's tasks.
    """

    HOT_LEVELS = 1024
    BROADCAST_LEVELS = 100_000

    def __init__(self, table: DataFrame, sizes: Mapping[str, int], rows: int) -> None:
        self.table, self.sizes, self.rows = table, dict(sizes), rows

    @classmethod
    def fit(cls, train: DataFrame, columns: Sequence[str]) -> "LevelDictionary":
        texts = train.select(*[F.col(c).cast("string").alias(c) for c in columns])
        levels = texts.unpivot([], list(columns), "feature", "level").where(
            F.col("level").isNotNull()).groupBy("feature", "level").agg(F.count(F.lit(1)).alias("rows"))
        ranked, _, _, _ = rank_rows_counted(levels, [F.col("feature").asc(), F.col("level").asc()],
                                            rank_col="_nth")
        found = {r["feature"]: (r["n"], r["rows"]) for r in ranked.groupBy("feature").agg(
            F.count(F.lit(1)).alias("n"), F.sum("rows").alias("rows")).collect()}  # a row per feature
        start, before = {}, 0
        for c in sorted(found):
            start[c], before = before, before + found[c][0]
        first = F.coalesce(*[F.when(F.col("feature") == c, F.lit(n)) for c, n in start.items()], F.lit(0))
        table = ranked.select("feature", "level", (F.col("_nth") - 1 - first).alias("slot"), "rows")
        return cls(table, {c: found.get(c, (0, 0))[0] for c in columns},
                   max((n for _, n in found.values()), default=0))

    def encode(self, df: DataFrame) -> DataFrame:
        """``df`` with ``_<feature>_idx``: the level's slot, or the number of levels if there is none."""
        for i, (c, size) in enumerate(self.sizes.items()):
            mine = self.table.where(F.col("feature") == c).select(
                F.col("level").alias(f"_l{i}"), F.col("slot").alias(f"_s{i}"), "rows")
            level = F.col(f"`{c}`").cast("string")
            if size <= self.BROADCAST_LEVELS:
                df = df.join(F.broadcast(mine.drop("rows")), level == F.col(f"_l{i}"), "left")
                slot = F.col(f"_s{i}")
            else:
                hot = mine.where(F.col("rows") > self.rows / self.HOT_LEVELS).select(
                    F.col(f"_l{i}").alias(f"_h{i}"), F.col(f"_s{i}").alias(f"_hs{i}"))
                df = df.join(F.broadcast(hot), level == F.col(f"_h{i}"), "left")
                found = F.col(f"_hs{i}").isNotNull() | level.isNull()
                # Rows that need no further look-up take keys of their own, so that none is hot.
                key = F.when(found, F.monotonically_increasing_id()).otherwise(F.lit(-1))
                df = df.withColumns({f"_k{i}": key, f"_kl{i}": F.when(~found, level).otherwise(F.lit(""))})
                mine = mine.drop("rows").withColumn(f"_m{i}", F.lit(-1).cast("long"))
                df = df.join(mine, (F.col(f"_kl{i}") == F.col(f"_l{i}")) & (F.col(f"_k{i}") == F.col(f"_m{i}")), "left")
                slot = F.coalesce(f"_hs{i}", f"_s{i}")
                df = df.withColumn(f"_slot{i}", slot).drop(
                    f"_h{i}", f"_hs{i}", f"_k{i}", f"_kl{i}", f"_m{i}", f"_s{i}")
                slot = F.col(f"_slot{i}")
            df = df.withColumn(f"_{c}_idx", F.coalesce(slot, F.lit(size)).cast("double")).drop(
                f"_l{i}", f"_s{i}", f"_slot{i}")
        return df


def _sparse_vector(size: int, entries: Column, out: str) -> Column:
    """Vectors of ``size`` slots from arrays of (slot, value), rising in slot; zeros are left out.

    The column states its size but names no slot: Spark ML's encoder and assembler describe
    every slot in the schema, which the driver holds.
    """
    @F.arrow_udf(VectorUDT())
    def vector(slots: pa.Array, values: pa.Array) -> pa.Array:
        n = len(slots)
        return pa.StructArray.from_arrays(
            [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), slots, values],
            ["type", "size", "indices", "values"])

    kept = F.filter(entries, lambda e: e["value"] != 0.0)
    return vector(F.transform(kept, lambda e: e["slot"].cast("int")),
                  F.transform(kept, lambda e: e["value"])).alias(out, metadata={"ml_attr": {"num_attrs": size}})


def _entry(slot: Column, value: Column) -> Column:
    return F.struct(slot.cast("long").alias("slot"), value.cast("double").alias("value"))


class DictionaryDesign:
    """A fitted preprocessor whose level dictionary is a table."""

    def __init__(self, dictionary: LevelDictionary, scaling, spec: ExperimentSpec) -> None:
        self.dictionary, self.scaling, self.spec = dictionary, scaling, spec

    def transform(self, df: DataFrame) -> DataFrame:
        scaled = self.scaling.transform(df) if self.spec.continuous else df
        found = self.dictionary.encode(scaled)
        at, entries = len(self.spec.continuous), []
        if self.spec.continuous:
            x = vector_to_array("_cont_scaled")
            entries += [_entry(F.lit(i), x[i]) for i in range(at)]
        for c in self.spec.categorical:
            slot, size = F.col(f"_{c}_idx"), self.dictionary.sizes[c]
            # The slot after the last level stands for levels not seen: all zeros.
            entries.append(_entry(slot + F.lit(at), F.when(slot < size, 1.0).otherwise(0.0)))
            at += size
        return found.select(*df.columns, _sparse_vector(at, F.array(*entries), FEATURES))


def fit_preprocessor(train: DataFrame, spec: ExperimentSpec = ExperimentSpec(),
                     level_tables: bool = False):
    """M2: fit scaling and encodings on the training split only.

    ``level_tables`` keeps the levels of categorical features in a distributed table
    instead of the driver; the design is the same, slot by slot.
    """
    if not (level_tables and spec.categorical):
        return build_preprocessor(spec).fit(train)
    spec.validate_model_features(list(spec.features))
    return DictionaryDesign(LevelDictionary.fit(train, spec.categorical),
                            Pipeline(stages=_scaling(spec)).fit(train), spec)


def transform_features(model, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """M3: apply a fitted preprocessor; keep only ``keep`` + features."""
    return model.transform(df).select(*keep, FEATURES)


def design_size(df: DataFrame) -> DataFrame:
    """Rows, columns and non-zeros of the feature matrix.

    Counted row by row from the stored entries; nothing has the design's width.
    """
    v = df.select(F.unwrap_udt(FEATURES).alias("v"))  # sparse vectors have a size, dense ones only values
    return v.agg(F.count("v").alias("rows"),
                 F.max(F.coalesce("v.size", F.size("v.values"))).alias("columns"),
                 F.sum(F.size(F.filter("v.values", lambda x: x != 0.0))).cast("bigint").alias("nonzero_values"))


# ---- M4-M6 ---------------------------------------------------------------------

def logistic(alpha: float, max_iter: int = DEFAULT_MAX_ITERATIONS, tol: float = TOLERANCE,
             features: str = FEATURES, label: str = "label") -> LogisticRegression:
    """M4: L2 logistic regression, mean loss + alpha/2 ||w||^2."""
    return LogisticRegression(featuresCol=features, labelCol=label, regParam=alpha,
                              elasticNetParam=0.0, standardization=False, maxIter=max_iter,
                              tol=tol, family="binomial")


class LocalClassifier:
    """An object with ``fit(X, y)`` and ``predict_proba(X)`` as a learner's classifier.

    It is fitted on the driver on at most ``max_rows`` rows, an exact seeded sample of
    the training rows; every row is scored, in batches on the executors.
    """

    def __init__(self, make: Callable[[], object], max_rows: int = LOCAL_FIT_ROWS, seed: int = 42) -> None:
        self.make, self.max_rows, self.seed = make, max_rows, seed

    def fit(self, df: DataFrame, features: str, label: str):
        keyed = df.select(F.monotonically_increasing_id().alias("_row"), vector_to_array(features).alias("_x"),
                          F.col(label).alias("_y")).persist(StorageLevel.MEMORY_AND_DISK)
        rows = sample_rows(keyed, self.max_rows, self.seed, id_col="_row").orderBy("_row").toPandas()
        keyed.unpersist()
        model = self.make()
        model.fit(np.stack(rows["_x"].to_numpy()), rows["_y"].to_numpy())
        return model


ClassifierFactory = Callable[[float], "Estimator | LocalClassifier"]


def _fit(est: "Estimator | LocalClassifier", df: DataFrame, features: str, label: str):
    started = time.perf_counter()
    if hasattr(est, "featuresCol"):
        model = est.copy({est.featuresCol: features, est.labelCol: label}).fit(df)
    elif hasattr(est, "predict_proba") and not hasattr(est, "fit"):
        model = est  # fitted before
    else:
        model = est.fit(df, features, label)
    return model, time.perf_counter() - started


def _iterations(model) -> int | None:
    try:
        return int(model.summary.totalIterations)
    except Exception:  # classifiers without a training summary
        return None


def _batch_probability(model, df: DataFrame, features: str):
    """P(y=1) of an object with ``predict_proba``: one call per Arrow batch of rows."""
    # As functions are sent, so that classes of a notebook or script come along.
    sent = df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fitted = cloudpickle.loads(sent.value)
        for x in batches:
            p = fitted.predict_proba(np.stack(x.to_numpy())) if len(x) else np.zeros((0, 2))
            yield pd.Series(np.asarray(p, dtype=np.float64)[:, 1])

    return probability(vector_to_array(F.col(features)))


def positive_probability(model, df: DataFrame, features: str, out: str) -> DataFrame:
    """M6: P(y=1) clipped to [1e-7, 1 - 1e-7], appended as ``out``."""
    if hasattr(model, "predict_proba"):
        return df.withColumn(out, clip_probability(_batch_probability(model, df, features)))
    m = model.copy()
    prob, raw, pred = f"_{out}_prob", f"_{out}_raw", f"_{out}_pred"
    m.set(m.featuresCol, features)
    for name, val in (("probabilityCol", prob), ("rawPredictionCol", raw),
                      ("predictionCol", pred)):
        if m.hasParam(name):
            m.set(m.getParam(name), val)
    scored = m.transform(df)
    return scored.withColumn(out, clip_probability(vector_to_array(prob)[1])).drop(prob, raw, pred)


# ---- M7-M11: learners ------------------------------------------------------------

def s_learner_design(df: DataFrame, treatment: Column | None = None,
                     out: str = "_design") -> DataFrame:
    """M7: [X, T, X*T] as one vector (``treatment`` overrides the column)."""
    t = (treatment if treatment is not None else F.col("treatment")).cast("double")
    about = df.schema[FEATURES].metadata.get("ml_attr", {})
    if "attrs" not in about and "num_attrs" in about:  # of level tables: slots without names
        n = about["num_attrs"]
        staged = df.withColumns({"_v": F.unwrap_udt(FEATURES), "_t_design": t})
        x = F.arrays_zip(F.col("_v.indices").alias("slot"), F.col("_v.values").alias("value"))
        design = F.concat(F.transform(x, lambda e: _entry(e["slot"], e["value"])),
                          F.array(_entry(F.lit(n), F.col("_t_design"))),
                          F.transform(x, lambda e: _entry(e["slot"] + F.lit(n + 1), e["value"] * F.col("_t_design"))))
        return staged.select(*df.columns, _sparse_vector(2 * n + 1, design, out))
    staged = df.withColumn("_t_design", t)
    inter = Interaction(inputCols=["_t_design", FEATURES], outputCol="_xt")
    assembled = VectorAssembler(inputCols=[FEATURES, "_t_design", "_xt"], outputCol=out)
    return assembled.transform(inter.transform(staged)).drop("_t_design", "_xt")


@dataclass
class SLearner:
    """One model on [X, T, X*T]; potential outcomes by setting T."""

    model: object
    fit_seconds: float
    iterations: int | None
    max_iterations: int

    @classmethod
    def fit(cls, train: DataFrame, outcome: str, *, alpha: float,
            max_iterations: int = DEFAULT_MAX_ITERATIONS,
            classifier: ClassifierFactory | None = None, treatment: str = "treatment"
            ) -> "SLearner":
        est = (classifier or (lambda a: logistic(a, max_iterations)))(alpha)
        design = s_learner_design(train, F.col(treatment)).withColumn(
            "_label", F.col(outcome).cast("double"))
        model, secs = _fit(est, design, "_design", "_label")
        return cls(model, secs, _iterations(model), max_iterations)

    def predict(self, df: DataFrame) -> DataFrame:
        """M8: append p1 (T=1) and p0 (T=0); two chained transforms."""
        one = s_learner_design(df, F.lit(1.0), "_d1")
        one = positive_probability(self.model, one, "_d1", "p1").drop("_d1")
        zero = s_learner_design(one, F.lit(0.0), "_d0")
        return positive_probability(self.model, zero, "_d0", "p0").drop("_d0")

    def convergence(self) -> dict:
        it = self.iterations
        return {"iterations": it, "maximum_iterations": self.max_iterations,
                "reached_iteration_limit": it is not None and it >= self.max_iterations}


@dataclass
class TLearner:
    """Separate treated and control models."""

    treated_model: object
    control_model: object
    fit_seconds: float
    treated_iterations: int | None
    control_iterations: int | None
    max_iterations: int

    @classmethod
    def fit(cls, train: DataFrame, outcome: str, *, alpha: float,
            max_iterations: int = DEFAULT_MAX_ITERATIONS,
            classifier: ClassifierFactory | None = None, treatment: str = "treatment"
            ) -> "TLearner":
        make = classifier or (lambda a: logistic(a, max_iterations))
        labelled = train.withColumn("_label", F.col(outcome).cast("double"))
        m1, s1 = _fit(make(alpha), labelled.where(F.col(treatment) == 1), FEATURES, "_label")
        m0, s0 = _fit(make(alpha), labelled.where(F.col(treatment) == 0), FEATURES, "_label")
        return cls(m1, m0, s1 + s0, _iterations(m1), _iterations(m0), max_iterations)

    def predict(self, df: DataFrame) -> DataFrame:
        """M9: p1 from the treated model, p0 from the control model."""
        one = positive_probability(self.treated_model, df, FEATURES, "p1")
        return positive_probability(self.control_model, one, FEATURES, "p0")

    def convergence(self) -> dict:
        lim = self.max_iterations
        return {"treatment_iterations": self.treated_iterations,
                "control_iterations": self.control_iterations, "maximum_iterations": lim,
                "treatment_reached_iteration_limit": (self.treated_iterations or 0) >= lim,
                "control_reached_iteration_limit": (self.control_iterations or 0) >= lim}


LEARNERS = {"s_learner": SLearner, "t_learner": TLearner}


def predict_uplift(model, df: DataFrame) -> DataFrame:
    """Potential outcomes and their difference (``cate``)."""
    return model.predict(df).withColumn("cate", F.col("p1") - F.col("p0"))


# ---- M12-M13: selection and held-out evaluation --------------------------------------

@dataclass
class ModelReport:
    learner: str
    outcome: str
    selected_alpha: float | None
    selected_validation_auuc: float
    candidates: list = field(default_factory=list)
    model: object = None
    tables: dict = field(default_factory=dict)
    scored: DataFrame | None = None  # persisted held-out scores
    evaluation: RankedEvaluation | None = None

    def release(self) -> None:
        """Give back the persisted scores and the evaluation's band counts."""
        if self.scored is not None:
            self.scored.unpersist()
        if self.evaluation is not None:
            self.evaluation.release()


Search = tuple[str, str]  # (outcome, learner)


def fit_candidates(searches: Sequence[Search], train: DataFrame, *, spec: ExperimentSpec = ExperimentSpec(),
                   alphas: Sequence[float] = REGULARIZATION_CANDIDATES,
                   max_iterations: int = DEFAULT_MAX_ITERATIONS,
                   classifier: ClassifierFactory | None = None, parallelism: int = 1
                   ) -> dict[tuple[str, str, float], object]:
    """Models of every (outcome, learner, alpha); ``parallelism`` > 1 fits them as concurrent Spark jobs."""
    def trial(key: tuple[str, str, float]):
        outcome, learner, alpha = key
        return LEARNERS[learner].fit(train, outcome, alpha=alpha, max_iterations=max_iterations,
                                     classifier=classifier, treatment=spec.treatment)

    keys = [(o, name, a) for o, name in searches for a in alphas]
    if parallelism > 1 and len(keys) > 1:
        with ThreadPoolExecutor(max_workers=min(parallelism, len(keys))) as pool:
            return dict(zip(keys, pool.map(trial, keys)))
    return {k: trial(k) for k in keys}


def candidate_scores(models: Mapping[tuple[str, str, float], object], rows: DataFrame,
                     spec: ExperimentSpec = ExperimentSpec()) -> DataFrame:
    """(candidate, id, score, outcome, treatment): all models over the same rows, in one pass."""
    keep = list(dict.fromkeys(o for o, _, _ in models))
    wide, cates = rows, []
    for i, model in enumerate(models.values()):
        wide = predict_uplift(model, wide).withColumnRenamed("cate", f"_cate_{i}").drop("p1", "p0")
        cates.append(f"_cate_{i}")
    wide = wide.select(F.col(spec.id).alias("id"), F.col(spec.treatment).alias("treatment"), *keep, *cates)
    each = F.array(*[F.struct(F.lit(i).alias("candidate"), F.col(c).alias("score"),
                              F.col(key[0]).alias("outcome"))
                     for i, (c, key) in enumerate(zip(cates, models))])
    return wide.select("id", "treatment", F.inline(each))


def choose(models: Mapping[tuple[str, str, float], object], validation: DataFrame,
           spec: ExperimentSpec = ExperimentSpec()) -> dict[Search, ModelReport]:
    """The best validation AUUC (strict >) of every (outcome, learner), from one range sort."""
    # Five narrow columns, scored once: the range sort reads them twice.
    scored = candidate_scores(models, validation, spec).persist(StorageLevel.MEMORY_AND_DISK)
    areas = {r["candidate"]: r["auuc_above_random_per_100000"] for r in candidate_auuc(
        scored, propensity=spec.propensity).collect()}
    scored.unpersist()
    reports: dict[Search, ModelReport] = {}
    for i, ((outcome, learner, alpha), m) in enumerate(models.items()):
        rep = reports.setdefault((outcome, learner), ModelReport(learner, outcome, None, float("-inf")))
        rep.candidates.append({"alpha": alpha, "validation_auuc_above_random_per_100000": areas[i],
                               "fit_seconds": m.fit_seconds, "convergence": m.convergence()})
        if areas[i] > rep.selected_validation_auuc:
            rep.model, rep.selected_validation_auuc, rep.selected_alpha = m, areas[i], alpha
    return reports


def select_model(learner: str, train: DataFrame, validation: DataFrame, outcome: str, *,
                 spec: ExperimentSpec = ExperimentSpec(),
                 alphas: Sequence[float] = REGULARIZATION_CANDIDATES,
                 max_iterations: int = DEFAULT_MAX_ITERATIONS,
                 classifier: ClassifierFactory | None = None,
                 parallelism: int = 1) -> ModelReport:
    """M12 for one outcome and learner; results do not depend on ``parallelism``."""
    models = fit_candidates([(outcome, learner)], train, spec=spec, alphas=alphas,
                            max_iterations=max_iterations, classifier=classifier, parallelism=parallelism)
    return choose(models, validation, spec)[(outcome, learner)]


def evaluate_model(report: ModelReport, test: DataFrame, *,
                   spec: ExperimentSpec = ExperimentSpec(),
                   full_benchmark_itt: float | None = None,
                   approximate_quantiles: bool = False) -> ModelReport:
    """Score the untouched test split once; every held-out table.

    ``approximate_quantiles`` takes the CATE quantiles from a sketch with a stated rank error.
    """
    # Without the features: the tables read the scores many times, and nothing else of a row.
    scored = predict_uplift(report.model, test).select(
        spec.id, spec.treatment, report.outcome, "p1", "p0", "cate").persist(StorageLevel.MEMORY_AND_DISK)
    report.scored = scored
    ev = RankedEvaluation(scored, score="cate", outcome=report.outcome,
                          treatment=spec.treatment, id_col=spec.id,
                          propensity=spec.propensity, outcome_name=report.outcome, check_ids=False)
    report.evaluation = ev
    report.tables = {
        "scores": scored,
        "gain_curve": ev.gain_curve(),
        "auuc": ev.auuc(),
        "targeting_policy": ev.targeting_policy(),
        "uplift_deciles": ev.uplift_deciles(),
        "cate_summary": cate_distribution(
            scored, score="cate", outcome=report.outcome, treatment=spec.treatment,
            full_benchmark_itt=full_benchmark_itt) if approximate_quantiles else ev.cate_summary(
                full_benchmark_itt=full_benchmark_itt),
        "predictive_diagnostics": predictive_diagnostics(
            scored, outcome=report.outcome, treatment=spec.treatment, id_col=spec.id),
    }
    return report


def candidates_frame(spark, reports: Sequence[ModelReport]) -> DataFrame:
    """One row per candidate: validation AUUC, fit time, convergence, and the choice."""
    rows = []
    for r in reports:
        for c in r.candidates:
            conv = c["convergence"]
            done = [conv.get(k) for k in ("iterations", "treatment_iterations", "control_iterations")]
            limit = any(v for k, v in conv.items() if k.endswith("iteration_limit"))
            rows.append((r.outcome, r.learner, float(c["alpha"]),
                         float(c["validation_auuc_above_random_per_100000"]), float(c["fit_seconds"]),
                         *done, conv["maximum_iterations"], limit, c["alpha"] == r.selected_alpha))
    return spark.createDataFrame(
        rows, "outcome string, learner string, alpha double, "
              "validation_auuc_above_random_per_100000 double, fit_seconds double, iterations int, "
              "treatment_iterations int, control_iterations int, maximum_iterations int, "
              "reached_iteration_limit boolean, selected boolean")


# ---- M15: treatment predictability ---------------------------------------------------

def treatment_predictability(df: DataFrame, spec: ExperimentSpec = ExperimentSpec(), *,
                             sample_size: float = ALL_ROWS, seed: int = 42,
                             test_share: float = 0.25) -> DataFrame:
    """Randomisation diagnostic: can the features predict assignment?

    75/25 split of all rows, stratified by treatment; L2 logistic regression
    with ``regParam = 1 / (C * n_train)``, fitted with its preprocessing on
    every training row; AUC and log loss on every held-out row, against a
    constant base-rate prediction. A caller may bound the rows to fit by
    ``sample_size`` (an exact seeded sample); ``maximum_training_rows`` is
    that bound, null without one.
    """
    cols = [spec.id, *spec.features, spec.treatment]
    split = split_rows(df.select(*cols), seed, spec=spec, stratum=F.col(spec.treatment).cast("int"),
                       holdout=test_share, second=1.0, names=("train", "unused", "test"))
    split = split.persist(StorageLevel.MEMORY_AND_DISK)
    test = split.where(F.col("split") == "test")
    train = split.where(F.col("split") == "train")
    bound = None if sample_size == ALL_ROWS else sample_size
    if bound is not None:
        train = sample_rows(train, bound, seed, id_col=spec.id)
    y = F.col(spec.treatment)
    stats = train.agg(F.count(F.lit(1)).alias("n"), F.avg(y.cast("double")).alias("base")).first()
    n_train, base = int(stats["n"]), float(stats["base"])
    pre = fit_preprocessor(train, spec)
    tr = transform_features(pre, train, [spec.id, spec.treatment]).withColumn(
        "_label", y.cast("double"))
    te = transform_features(pre, test, [spec.id, spec.treatment])
    lr = logistic(1.0 / (PREDICTABILITY_C * n_train), PREDICTABILITY_MAX_ITERATIONS, TOLERANCE,
                  label="_label")
    model, _ = _fit(lr, tr, FEATURES, "_label")
    scored = positive_probability(model, te, FEATURES, "p").select(
        "p", spec.treatment, F.lit("test").alias("_g")).persist(StorageLevel.MEMORY_AND_DISK)
    auc = rank_auc(scored, "p", spec.treatment, "_g")
    losses = scored.agg(
        F.count(F.lit(1)).alias("test_observations"),
        F.avg(log_loss_col(y, F.col("p"))).alias("log_loss"),
        F.avg(log_loss_col(y, F.lit(base))).alias("baseline_log_loss")).withColumn("_g", F.lit("test"))
    out = losses.join(auc.select("_g", "roc_auc"), "_g").drop("_g")
    result = small_table(out.select(
        F.lit(n_train).cast("bigint").alias("training_observations"), "test_observations",
        "roc_auc", F.lit(0.5).alias("baseline_roc_auc"), "log_loss", "baseline_log_loss",
        (F.col("baseline_log_loss") - F.col("log_loss")).alias("log_loss_improvement"),
        F.lit(_iterations(model)).alias("iterations"),
        F.lit(bound).cast("bigint").alias("maximum_training_rows"),
        F.lit(seed).alias("random_seed")))
    scored.unpersist()
    split.unpersist()
    return result
