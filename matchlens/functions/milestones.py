"""Classification of actions as milestones."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Age advances and technologies that count as milestones.
AGES = ("feudal age", "castle age", "imperial age")
KEY_TECHS = (
    "bracer",
    "chemistry",
    "hand cart",
    "wheelbarrow",
    "conscription",
    "ballistics",
    "siege engineers",
    "architecture",
    "thumb ring",
)
KINDS = ("age", "castle", "elite", "tech", "tc")


def milestone_kind(type_: Column, label: Column) -> Column:
    """Kind of milestone, or NULL. ``label`` is the technology or building."""
    low = F.lower(label)
    is_key_tech = F.lit(False)
    for tech in KEY_TECHS:
        is_key_tech = is_key_tech | F.contains(low, F.lit(tech))
    researched = (
        F.when(low.isin(*AGES), "age")
        .when(F.startswith(low, F.lit("elite ")), "elite")
        .when(is_key_tech, "tech")
    )
    built = F.when(low == "castle", "castle").when(low == "town center", "tc")
    return F.when(type_ == "RESEARCH", researched).when(type_ == "BUILD", built)


def milestone_code(kind: Column, label: Column) -> Column:
    """Short marker text of a milestone."""
    low = F.lower(label)
    age = (
        F.when(F.contains(low, F.lit("feudal")), "F")
        .when(F.contains(low, F.lit("castle")), "C")
        .when(F.contains(low, F.lit("imperial")), "I")
        .otherwise("A")
    )
    return (
        F.when(kind == "age", age)
        .when(kind == "castle", "C")
        .when(kind == "elite", "E")
        .when(kind == "tech", "T")
        .when(kind == "tc", "TC")
    )
