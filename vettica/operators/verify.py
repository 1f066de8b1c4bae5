"""Verification: which candidates a scorer sees, and what a score means."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vettica.functions.policy import POLICIES, Policy

NOT_SUPPORTED = "ML_NOT_SUPPORTED"
UNCERTAIN = "UNCERTAIN_NEEDS_REVIEW"
SETTLED = "OK"
DEFAULT_BATCH = 32
ARROW_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
ARROW_BYTES = 16 << 20

Scorer = Callable[[Sequence[str], Sequence[str]], Sequence[float]]


def _setting(lang: Column, policies: tuple[Policy, ...], field: str) -> Column:
    pairs = [F.lit(v) for p in policies for v in (p.lang, float(getattr(p, field)))]
    return F.try_element_at(F.create_map(*pairs), lang)


def is_supported(lang: Column, policies: tuple[Policy, ...] = POLICIES) -> Column:
    return F.coalesce(lang.isin(*[p.lang for p in policies]), F.lit(False))


def route_ml(candidates: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """Mark the candidates that may be scored, by their ``lang``."""
    supported = is_supported(F.col("lang"), policies)
    return candidates.withColumn("supported", supported).withColumn(
        "route", F.when(supported, "SCORE").otherwise(NOT_SUPPORTED)
    )


def softmax_prob(first: Column, second: Column) -> Column:
    """Probability of the second of two classes from their logits."""
    top = F.greatest(first, second)
    return F.exp(second - top) / (F.exp(first - top) + F.exp(second - top))


def verdict_columns(
    lang: Column, score: Column, policies: tuple[Policy, ...] = POLICIES
) -> dict[str, Column]:
    """ml_verified, confidence, label and status of a scored candidate.

    A supported candidate whose score is null or not a number stops the job: it
    must not pass as safe.
    """
    supported = is_supported(lang, policies)
    given = score.cast("double")
    missing = given.isNull() | F.isnan(given)
    value = F.when(
        supported, F.when(missing, F.raise_error(F.lit("score is missing")).cast("double")).otherwise(given)
    )
    threshold, low, high = (_setting(lang, policies, k) for k in ("threshold", "low", "high"))
    return {
        "ml_verified": supported,
        "confidence": value,
        "label": F.when(supported, F.when(value >= threshold, 1).otherwise(0)),
        "status": F.when(~supported, NOT_SUPPORTED)
        .when(value.between(low, high), UNCERTAIN)
        .otherwise(SETTLED),
    }


def classify(scored: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """Add the verdict to rows that carry ``lang`` and ``score``."""
    return scored.withColumns(verdict_columns(F.col("lang"), F.col("score"), policies))


def verify_candidates(
    candidates: DataFrame,
    scores: DataFrame,
    policies: tuple[Policy, ...] = POLICIES,
) -> DataFrame:
    """One verdict per candidate, joined to (candidate_id, score) by key.

    A supported candidate without a score is an error of the caller and stops
    the job: it must not pass as safe.
    """
    joined = candidates.join(scores.select("candidate_id", "score"), "candidate_id", "left")
    checked = F.when(
        is_supported(F.col("lang"), policies) & F.col("score").isNull(),
        F.raise_error(F.concat(F.lit("no score for "), F.col("candidate_id"))).cast("double"),
    ).otherwise(F.col("score"))
    return classify(joined.withColumn("score", checked), policies).drop("score")


def _bounded(candidates: DataFrame) -> DataFrame:
    """The same rows, after the session's Arrow batches are held to ``ARROW_BYTES``:
    a batch of whole functions is then bounded by bytes and not by rows alone."""
    conf = candidates.sparkSession.conf
    if int(conf.get(ARROW_SETTING, str(ARROW_BYTES + 1))) > ARROW_BYTES:
        conf.set(ARROW_SETTING, str(ARROW_BYTES))
    return candidates


def _ordered_scorer(
    load_scorer: Callable[[], Scorer], batch_size: int
) -> Callable[[Sequence[str], Sequence[str]], list[float]]:
    """Scores of any number of snippets, asked for in batches of similar length.

    The scorer is loaded once per worker process and kept for its later tasks; a
    worker keeps the last one.  What is returned travels by value.
    """
    key = uuid.uuid4().hex

    def run(snippets: Sequence[str], langs: Sequence[str]) -> list[float]:
        import sys
        import types

        place = sys.modules.setdefault("_vettica_scorer", types.ModuleType("_vettica_scorer")).__dict__
        if place.get("key") != key:
            place.pop("scorer", None)
            place.update(scorer=load_scorer(), key=key)
        order = sorted(range(len(snippets)), key=lambda i: len(snippets[i] or ""))
        scores: list = [None] * len(order)
        for at in range(0, len(order), batch_size):
            rows = order[at : at + batch_size]
            found = list(place["scorer"]([snippets[i] for i in rows], [langs[i] for i in rows]))
            if len(found) != len(rows):
                raise ValueError("the scorer must return one score per snippet")
            for i, value in zip(rows, found):
                scores[i] = value
        return scores

    return run


def score_batches(
    candidates: DataFrame,
    load_scorer: Callable[[], Scorer],
    batch_size: int = DEFAULT_BATCH,
    policies: tuple[Policy, ...] = POLICIES,
) -> DataFrame:
    """(candidate_id, score) of the supported candidates.

    ``load_scorer`` runs once per worker process and returns a function from a batch
    of snippets and their languages to scores.  Within an Arrow batch rows are asked
    for by length, so that one long snippet does not pad a whole batch.
    """
    score = _ordered_scorer(load_scorer, batch_size)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                values = score(rows["snippet"].tolist(), rows["lang"].tolist())
                yield pd.DataFrame({"candidate_id": rows["candidate_id"].tolist(), "score": values})

    return (
        _bounded(candidates)
        .filter(is_supported(F.col("lang"), policies))
        .select("candidate_id", "snippet", "lang")
        .mapInPandas(run, "candidate_id string, score double")
    )


def score_in_place(
    candidates: DataFrame,
    load_scorer: Callable[[], Scorer],
    batch_size: int = DEFAULT_BATCH,
    policies: tuple[Policy, ...] = POLICIES,
) -> DataFrame:
    """The candidates with a ``score`` column, null where none is supported.

    Same contract as :func:`score_batches`, but only snippet and language travel
    to Python and nothing is joined back or sorted, so streams can use it too.
    """
    score = _ordered_scorer(load_scorer, batch_size)

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for snippets, langs in parts:
            values = pd.Series([None] * len(snippets), dtype="float64")
            wanted = langs.reset_index(drop=True).dropna().index
            if len(wanted):
                values.iloc[wanted] = score(snippets.iloc[wanted].tolist(), langs.iloc[wanted].tolist())
            yield values

    asked = F.when(is_supported(F.col("lang"), policies), F.col("lang"))
    return _bounded(candidates).withColumn("score", run(F.col("snippet"), asked))
