"""Which format is each source in?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..parsers import known_formats
from ..parsers.base import ParserSpec

# Sample size, and the score from which a format is settled.
SAMPLE_LINES = 50
PIN_SCORE = 0.6


def score_column(spec: ParserSpec, sampled: Column, line: Column, idx: Column) -> Column:
    """Aggregate score of one format over the rows where `sampled` holds."""
    sample_line, sample_idx = F.when(sampled, line), F.when(sampled, idx)
    if spec.score is not None:
        return F.coalesce(spec.score(sample_line, sample_idx), F.lit(0.0)).cast("double")
    return F.coalesce(F.avg(F.when(sampled, spec.matches(line).cast("int"))), F.lit(0.0))


def score_columns(specs: list[ParserSpec]) -> list[Column]:
    sampled = F.col("idx") < SAMPLE_LINES
    return [
        score_column(spec, sampled, F.col("line"), F.col("idx")).alias(f"score_{place}")
        for place, spec in enumerate(specs)
    ]


def ranked(specs: list[ParserSpec]) -> Column:
    """Formats best first; equal scores keep the order of the table."""
    entries = [
        F.struct((-F.col(f"score_{place}")).alias("key"), F.lit(place).alias("place"), F.lit(spec.id).alias("id"))
        for place, spec in enumerate(specs)
    ]
    return F.array_sort(F.array(*entries))


def detect_format(lines: DataFrame) -> DataFrame:
    """(source, format, score) per source; format is null when nothing scores.

    Only the first lines of a source are looked at, and each partition hands
    on one small partial result per source.
    """
    specs = known_formats()
    scores = lines.filter(F.col("idx") < SAMPLE_LINES).groupBy("source").agg(*score_columns(specs))
    best = F.element_at(ranked(specs), 1)
    return scores.select("source", best.alias("best")).select(
        "source",
        F.when(F.col("best.key") < 0, F.col("best.id")).alias("format"),
        (-F.col("best.key")).alias("score"),
    )
