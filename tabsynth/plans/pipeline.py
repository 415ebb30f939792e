"""End-to-end runs (L1-L3): load -> clean -> profile -> recommend -> generate -> clean the
output -> evaluate.  Each step is a DataFrame function; the cleaned and generated tables
are persisted because several later jobs read them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.storagelevel import StorageLevel

from ..operators.clean import clean_dataset
from ..operators.evaluate import build_evaluation_report
from ..operators.generate.fallback import Attempt, generate_with_fallback
from ..operators.profile import build_profile
from ..operators.recommend import recommend_model
from ..operators.sample import sample_random, sample_stratified


@dataclass
class PipelineRun:
    """What each step gave: tables by name, and one record of facts for each step."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    facts: dict[str, object] = field(default_factory=dict)


def _load(spark: SparkSession, source, sep_override, header_override):
    if isinstance(source, DataFrame):
        return source, None
    from ..sources.load import load_dataset

    return load_dataset(spark, source, sep_override=sep_override, header_override=header_override)


def run_full_pipeline(spark: SparkSession, source, model: str | None = None, rows: int | None = None,
                      target_col: str | None = None, time_col: str | None = None, reduce_to: int | None = None,
                      sep_override: str | None = None, header_override: int | None = None, seed: int = 42) -> PipelineRun:
    """L1, L2.  ``source`` is a path (CSV/Excel/Parquet/JSON/ORC, file, glob or folder) or a
    DataFrame.  Without ``model`` the recommended one runs; without ``rows`` as many rows are
    generated as the cleaned table has; ``reduce_to`` samples the cleaned table first."""
    run = PipelineRun()
    run.tables["raw"], run.facts["load"] = _load(spark, source, sep_override, header_override)
    cleaned, run.facts["clean"] = clean_dataset(run.tables["raw"], fill_missing=True)
    if reduce_to:
        cleaned = sample_stratified(cleaned, reduce_to, target_col, seed=seed) if target_col else sample_random(cleaned, reduce_to, seed=seed)
    run.tables["clean"] = cleaned = cleaned.persist(StorageLevel.MEMORY_AND_DISK)
    run.facts["profile"] = profile = build_profile(cleaned)
    run.facts["recommend"] = advice = recommend_model(cleaned, target_col, time_col)
    made = generate_with_fallback(cleaned, model or advice.model, rows or profile.rows, target_col, time_col or advice.detected_time_column, seed=seed)
    run.facts["generate"] = made.attempts
    run.tables["generated"], _ = clean_dataset(made.rows, fill_missing=True)
    run.tables["evaluation"] = build_evaluation_report(cleaned, run.tables["generated"])
    return run


def generate_and_evaluate(df: DataFrame, model: str, n: int, target_col: str | None = None,
                          time_col: str | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame, list[Attempt]]:
    """L3 (batch form of the remote worker): generate, clean the output, evaluate."""
    made = generate_with_fallback(df, model, n, target_col, time_col, seed=seed)
    out, _ = clean_dataset(made.rows, fill_missing=True)
    return out, build_evaluation_report(df, out), made.attempts
