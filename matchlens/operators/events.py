"""Milestones: age advances, castles, elite upgrades, key technologies, town centers."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlens.functions.barrier import evaluate_once
from matchlens.functions.milestones import milestone_code, milestone_kind
from matchlens.functions.payload import PARSED, text, with_parsed
from matchlens.operators.series import KEY


def important_events(actions: DataFrame, kinds=None) -> DataFrame:
    """First time each player reaches each milestone, optionally of some kinds only.

    The label decides the kind, so the first occurrence is a plain minimum,
    combined on the map side however often a label repeats.
    """
    type_ = F.col("type")
    parsed = with_parsed(
        actions.filter(F.col("player").isNotNull() & type_.isin("RESEARCH", "BUILD"))
    )
    label = F.when(type_ == "RESEARCH", text(F.col(PARSED), "$.technology")).otherwise(
        text(F.col(PARSED), "$.building")
    )
    labelled = evaluate_once(parsed, label=label)
    classified = evaluate_once(labelled, kind=milestone_kind(type_, F.col("label")))
    wanted = F.col("kind").isin(*kinds) if kinds else F.col("kind").isNotNull()
    return (
        classified.filter(wanted)
        .groupBy(*KEY, "label", "kind")
        .agg(F.min("t_us").alias("t_us"))
        .select(
            *KEY,
            "t_us",
            "label",
            "kind",
            milestone_code(F.col("kind"), F.col("label")).alias("code"),
        )
    )


def in_time_order(found: DataFrame) -> DataFrame:
    """Milestones sorted for output: by match, then time."""
    return found.orderBy("match_id", "t_us", "player", "label")
