"""Feature reduction before generation and re-injection afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .profile import present
from ..functions import typeclass as tc
from ..functions.columns import ID_TERMS
from ..functions.names import has_any_term
from ..plans.kernels import to_long

HIGH_CARD_RATIO = 0.6
HIGH_CARD_MIN = 50


SKETCH_ERROR = 0.02  # relative standard deviation of the distinct-value sketch


def reduce_features(df: DataFrame, protected: list[str] | None = None,
                    approx: bool = False) -> tuple[DataFrame, list[str]]:
    """Drop constant columns (at most one distinct value, any type), high-cardinality
    text (distinct/rows > 0.6 and distinct > 50) and text whose name contains an id-like
    fragment; protected columns stay.  Dropped names keep schema order.

    One aggregate pass: a column is constant where its smallest value is its largest; text has a
    mergeable sketch of its distinct values.  Only text whose sketch lies within six standard
    deviations of a limit is counted exactly (never with ``approx``)."""
    protected = set(protected or [])
    free = [(i, c) for i, c in enumerate(df.columns) if c not in protected]
    text = set(tc.text_columns(df))
    judged = [(i, c) for i, c in free if c in text and not has_any_term(c, ID_TERMS)]
    row = df.agg(F.count(F.lit(1)).alias("rows"),
                 *[F.min(present(df, c)).eqNullSafe(F.max(present(df, c))).alias(f"same{i}") for i, c in free],
                 *[F.approx_count_distinct(present(df, c), SKETCH_ERROR).alias(f"d{i}") for i, c in judged]).first()
    limit = max(HIGH_CARD_RATIO * max(1, row["rows"]), HIGH_CARD_MIN)
    distinct = {c: row[f"d{i}"] for i, c in judged if not row[f"same{i}"]}
    near = [c for c, n in distinct.items() if abs(n - limit) <= 6 * SKETCH_ERROR * max(n, limit)]
    if near and not approx:
        held = df.select(*[present(df, c).alias(f"v{j}") for j, c in enumerate(near)])
        values = to_long(held, held.columns, "string").where(F.col("value").isNotNull()).distinct()
        exact = {r["column"]: r["n"] for r in values.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
        distinct.update({c: exact[f"v{j}"] for j, c in enumerate(near)})
    dropped = [c for i, c in free if row[f"same{i}"] or (c in text and (c not in distinct or distinct[c] > limit))]
    return df.select(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c not in dropped]), dropped


def reinject_columns(synth: DataFrame, original: DataFrame, dropped: list[str]) -> DataFrame:
    """Add the dropped columns back (text -> ``'NA'``, others -> missing of their
    type) and restore the original column order."""
    types = {f.name: f.dataType for f in original.schema.fields}
    out = synth
    for c in dropped:
        fill = F.lit("NA") if tc.is_text(types[c]) else F.lit(None).cast(types[c])
        out = out.withColumn(c, fill)
    return out.select(*[F.col(f"`{c}`") for c in original.columns])
