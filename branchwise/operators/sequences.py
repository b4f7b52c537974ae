"""Label sequences per branch, the input of the claim models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from branchwise.functions import labels, times
from branchwise.operators import tree

OBS = "array<struct<stance:int,t:double>>"
PART = 4096


def time_folds() -> dict[str, tuple[str, Column]]:
    return {"earliest": ("min", F.col("created")), "latest": ("max", F.col("created"))}


def commenting_folds() -> dict[str, tuple[str, Column]]:
    return {"n_commenting": ("sum", labels.is_commenting(F.col("sdqc")).cast("long"))}


def not_only_commenting() -> Column:
    """Keeps a branch unless every member is labelled commenting."""
    return F.col("n_commenting") < F.col("branch_len")


def observations(members: DataFrame, messages: DataFrame, scaled_time: bool = False) -> DataFrame:
    """One row per branch member with its stance code and time feature.

    ``members`` carries earliest and latest of its branch, so no window over the branch is needed.
    """
    on = [c for c in ("corpus", "source_id", "msg_id") if c in members.columns and c in messages.columns]
    facts = messages.select(*on, "sdqc", "created")
    created = F.col("created")
    time = (times.scaled_time(F.col("earliest"), F.col("latest"), created) if scaled_time
            else times.log_hours(F.col("earliest"), created))
    return (members.join(facts, on)
            .withColumn("stance", labels.stance_code(F.col("sdqc")))
            .withColumn("t", F.when(F.col("branch_len") == 1, F.lit(0.0)).otherwise(time)))


def sequences(observed: DataFrame, sources: DataFrame, branch: list[str], part: int = PART) -> DataFrame:
    """Ordered observations per branch with the claim code of its source.

    A branch of more than ``part`` members is stored in several rows (``part`` 0, 1, …), so that no row
    grows without bound while models are fitted; ``whole`` puts them together again wherever rows are
    results, and ``per_branch`` gives one row per branch wherever rows are counted. Unlabelled members
    are left out, and so are branches in which none is labelled.
    """
    obs = F.array_sort(F.collect_list(F.struct("pos", "stance", "t")))
    keep = [c for c in ("source_id",) if c not in branch]
    grouped = (observed.where("stance is not null")
               .withColumn("part", F.floor(F.col("pos") / part).cast("int"))
               .groupBy(*keep, *branch, "part")
               .agg(F.transform(obs, lambda o: F.struct(o["stance"].alias("stance"), o["t"].alias("t"))).alias("obs")))
    claims = sources.select("source_id", labels.veracity_code(F.col("truth")).alias("veracity"))
    return grouped.join(claims, "source_id")


def whole(seqs: DataFrame) -> DataFrame:
    """One row per branch: its stored parts joined again in order, ``part`` gone."""
    keys = [c for c in seqs.columns if c not in ("part", "obs")]
    parts = F.array_sort(F.collect_list(F.struct("part", "obs")))
    return seqs.groupBy(*keys).agg(F.flatten(F.transform(parts, lambda p: p["obs"])).alias("obs"))


def per_branch(seqs: DataFrame) -> DataFrame:
    """One row per branch without its observations, whichever of its parts are present."""
    return seqs.drop("part", "obs").distinct()


def prepare(seqs: DataFrame, unverified_cast: str = "none", remove_commenting: bool = False) -> DataFrame:
    """Recode unverified claims and, if asked, drop commenting observations and emptied rows."""
    out = seqs.withColumn("veracity", labels.cast_unverified(F.col("veracity"), unverified_cast))
    if remove_commenting:
        out = out.withColumn("obs", labels.without_commenting(F.col("obs")))
    return out.where(F.size("obs") > 0)


def skip_first_branch(df: DataFrame) -> DataFrame:
    """Leave out the first branch of every thread, as the published sequence table does."""
    return df.where(F.col("branch_idx") > 0)


def from_messages(messages: DataFrame, timestamps: bool = True, index: bool = False,
                  skip_first: bool = False, part: int = PART) -> DataFrame:
    """Messages to sequences: source_id, leaf_id (branch_idx), part, obs, veracity."""
    members = tree.branch_members(messages, folds=time_folds(), index=index or skip_first)
    if skip_first:
        members = skip_first_branch(members)
    branch = ["source_id", "leaf_id"] + (["branch_idx"] if "branch_idx" in members.columns else [])
    seqs = sequences(observations(members, messages), messages.where("is_source"), branch, part)
    if not timestamps:
        seqs = seqs.withColumn("obs", F.transform("obs", lambda o: F.struct(
            o["stance"].alias("stance"), F.lit(None).cast("double").alias("t"))))
    return seqs
