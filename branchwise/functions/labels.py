"""Label codes and the rules that turn annotation codes into labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from branchwise.schema import COMMENTING, STANCE_CODES, UNSPECIFIED, VERACITY_CODES

# Response types of the threads corpus and codes of the annotation tool.
RESPONSE_TO_STANCE = {"agreed": "Supporting", "disagreed": "Denying",
                      "appeal-for-more-information": "Querying", "comment": "Commenting"}
TOOL_STANCE = {1: "Supporting", 2: "Denying", 3: "Querying", 4: "Commenting"}
TOOL_TRUTH = {5: "True", 6: "Unverified", 7: "False"}
NON_CLAIM, CLAIM, VERIFIABLE, SUBJECTIVE = 2, 1, 3, 4


def lookup(col: Column, table: dict) -> Column:
    """Value of a small fixed table, NULL when absent."""
    out = None
    for key, value in table.items():
        out = F.when(col == F.lit(key), F.lit(value)) if out is None else out.when(col == F.lit(key), F.lit(value))
    return out


def stance_code(name: Column) -> Column:
    return lookup(name, STANCE_CODES)


def stance_name(code: Column) -> Column:
    return lookup(code, {v: k for k, v in STANCE_CODES.items()})


def veracity_code(name: Column) -> Column:
    return lookup(name, VERACITY_CODES)


def veracity_name(code: Column) -> Column:
    return lookup(code, {v: k for k, v in VERACITY_CODES.items()})


def cast_unverified(code: Column, to: str) -> Column:
    """Count unverified claims as ``true``, as ``false`` or keep them (``none``)."""
    target = {"true": 1, "false": 0, "none": 2}[to]
    return F.when(code == 2, F.lit(target)).otherwise(code)


def source_stance(name: Column) -> Column:
    """Unlabelled sources count as commenting."""
    return F.when(name == UNSPECIFIED, F.lit("Commenting")).otherwise(name)


def or_unspecified(name: Column) -> Column:
    return F.coalesce(name, F.lit(UNSPECIFIED))


def is_commenting(name: Column) -> Column:
    """False for every other label, missing ones included."""
    return F.coalesce(name == "Commenting", F.lit(False))


def without_commenting(obs: Column) -> Column:
    return F.filter(obs, lambda o: o["stance"] != COMMENTING)


def threads_veracity(true_mark: Column, misinformation_mark: Column) -> Column:
    """Claim code from the two marks of a thread annotation file."""
    return (F.when(true_mark == "1", 1).when(misinformation_mark == "1", 0).otherwise(2))


def decode_claim(codes: Column) -> dict[str, Column]:
    """Claim, verifiability and truth from a set of codes; ``label_error`` names a broken rule.

    The codes are hierarchical: claim or not; if a claim, verifiable or subjective; if verifiable,
    one of three truth values. Of several truth values the highest code counts.
    """
    has = lambda code: F.array_contains(codes, code)
    is_claim = has(CLAIM) & ~has(NON_CLAIM)
    checkable = is_claim & has(VERIFIABLE) & ~has(SUBJECTIVE)
    error = (F.when(~(has(CLAIM) | has(NON_CLAIM)), "claim")
             .when(is_claim & ~(has(VERIFIABLE) | has(SUBJECTIVE)), "verifiability")
             .when(checkable & ~(has(5) | has(6) | has(7)), "truth"))
    truth = F.when(has(7), TOOL_TRUTH[7]).when(has(6), TOOL_TRUTH[6]).when(has(5), TOOL_TRUTH[5])
    return {
        "claim": F.when(has(NON_CLAIM), False).when(has(CLAIM), True),
        "verifiability": F.when(is_claim & has(SUBJECTIVE), "Subjective").when(is_claim & has(VERIFIABLE), "Verifiable"),
        "truth": F.when(checkable, truth),
        "label_error": error,
    }


def decode_stance(codes: Column) -> dict[str, Column]:
    """Exactly one code is allowed."""
    one = F.size(codes) == 1
    label = lookup(F.get(codes, F.lit(0)), TOOL_STANCE)
    return {"sdqc": F.when(one, label),
            "label_error": F.when(~one, "count").when(label.isNull(), "code")}
