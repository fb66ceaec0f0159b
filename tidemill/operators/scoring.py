"""Explainable scores from keyword rules, all as Column expressions over title and body.

Matching is by substring and counts list entries. No shuffle: rules are literals in the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import body_of, contains_any, hits, matching, points, title_of
from ..rules import DOWNGRADE, RISK_DEFAULTS, SECTOR_TERMS, Rules


def with_texts(df: DataFrame) -> DataFrame:
    """Adds title and body, the texts that rules are matched against.

    They come out of a generator of one row, so that filters stay above it and each text is normalised once.
    """
    texts = F.struct(title_of("position").alias("title"), body_of("position", "description", "location").alias("body"))
    return df.select("*", F.inline(F.array(texts)))


def reject_reason(rules: Rules) -> Column:
    """The first hard filter that matches, or ''."""
    title, body = F.col("title"), F.col("body")
    return (
        F.when(contains_any(title, rules.hard_title), "title_hard_filter")
        .when(contains_any(body, rules.hard_experience), "experience_hard_filter")
        .when(contains_any(body, rules.hard_visa), "visa_hard_filter")
        .when(contains_any(body, rules.hard_student), "student_status_hard_filter")
        .otherwise("")
    )


def _track_points(rules: Rules) -> Column:
    title, body = F.col("title"), F.col("body")
    raw = [6 * hits(title, t) + 2 * hits(body, b) for t, b in rules.tracks.values()]
    return F.array(*raw) if raw else F.array(F.lit(0))


def _best_track(rules: Rules) -> Column:
    """The first track with the most points, '' with none; expects the array `track_points`."""
    names = F.array(*[F.lit(n) for n in rules.tracks]) if rules.tracks else F.array(F.lit(""))
    most = F.array_max("track_points")
    return F.when(most > 0, F.element_at(names, F.array_position("track_points", most).cast("int"))).otherwise("")


def _group_hits(rules: Rules) -> Column:
    return F.array(*[hits(F.col("body"), k) for k in rules.evidence.values()]) if rules.evidence else F.array(F.lit(0))


def _group_weight(rules: Rules, group: str) -> Column:
    """The weight of a group for best_track: 1 for a track without weights, 0 for a group it does not name."""
    out = F.lit(1.0)
    for track, weights in rules.evidence_weights.items():
        if weights:
            out = F.when(F.col("best_track") == track, float(weights.get(group, 0.0))).otherwise(out)
    return out


def _evidence(rules: Rules) -> tuple[Column, Column]:
    """(score, groups): each group gives up to ten points times its weight, summed in order, half to even."""
    score, named = F.lit(0.0), []
    for i, group in enumerate(rules.evidence):
        n, w = F.get("group_hits", F.lit(i)), _group_weight(rules, group)
        counts = (n > 0) & (w > 0)
        score = score + F.when(counts, F.least(F.lit(10), 3 + 2 * n) * w).otherwise(0.0)
        named.append(F.when(counts, F.lit(group)))
    groups = F.array_compact(F.array(*named)) if named else F.array().cast("array<string>")
    return F.least(F.lit(rules.cap("evidence_skill_fit")), F.bround(score).cast("int")), groups


def _gap_fires(rules: Rules) -> Column:
    body = F.col("body")
    eased = contains_any(body, list(DOWNGRADE))
    return F.array(*[(hits(body, phrases) >= 2) & ~eased for phrases, _ in rules.gaps.values()]) if rules.gaps else F.array(F.lit(False))


def _gaps(rules: Rules) -> tuple[Column, Column]:
    """(penalty, flags) of unsupported stacks; expects the array `gap_fires`."""
    trained = contains_any(F.col("body"), rules.training)
    total, flags = F.lit(0), []
    for i, (gap, (_, penalty)) in enumerate(rules.gaps.items()):
        fires = F.get("gap_fires", F.lit(i))
        less = max(1, round(penalty * rules.reduction))  # half to even
        total = total + F.when(fires, F.when(trained, less).otherwise(penalty)).otherwise(0)
        flags.append(F.when(fires, F.lit(gap)))
    return total, F.array_compact(F.array(*flags)) if flags else F.array().cast("array<string>")


def _visa(rules: Rules) -> Column:
    """Score and bucket; expects `soft_found` and `medium_found`."""
    body, cap = F.col("body"), rules.cap("visa_work_auth_fit")
    pick = lambda v, bucket: F.struct(F.lit(min(cap, v)).alias("score"), F.lit(bucket).alias("bucket"))
    out = pick(rules.visa_neutral, "neutral")
    out = F.when(F.size("soft_found") > 0, pick(rules.visa_soft, "soft_risk")).otherwise(out)
    out = F.when(F.col("medium_found"), pick(rules.visa_medium, "medium_risk")).otherwise(out)
    for phrase, value in reversed(rules.visa_positive):
        out = F.when(F.contains(body, F.lit(phrase)), pick(value, "positive")).otherwise(out)
    return out


def _risk(rules: Rules) -> tuple[Column, Column]:
    """(penalty, flags); expects `soft_found` and `medium_found`."""
    medium, soft = F.col("medium_found"), F.col("soft_found")
    sector = F.exists(soft, lambda h: contains_any(h, list(SECTOR_TERMS)))
    clear, defence, export = ({**RISK_DEFAULTS, **rules.risk}[k] for k in RISK_DEFAULTS)
    penalty = F.when(medium, clear).otherwise(0) + F.when(F.size(soft) == 0, 0).when(sector, defence).otherwise(export)
    kind = F.when(F.size(soft) == 0, F.lit(None)).when(sector, F.lit("defence_security_sector")).otherwise("regulated_or_export_risk")
    return penalty, F.array_compact(F.array(F.when(medium, F.lit("clearance_eligibility_risk")), kind))


def score(df: DataFrame, rules: Rules) -> DataFrame:
    """Adds matching_score and score_breakdown to rows that have title and body."""
    title, body = F.col("title"), F.col("body")
    # what several columns read is searched for once, in a projection of its own
    found = {"gap_fires": _gap_fires(rules), "soft_found": matching(body, rules.soft_risks), "medium_found": contains_any(body, rules.medium_risks)}
    base = df.withColumns({"track_points": _track_points(rules), "group_hits": _group_hits(rules), **found})
    base = base.withColumn("best_track", _best_track(rules))
    evidence, groups = _evidence(rules)
    stack, stack_flags = _gaps(rules)
    risk, risk_flags = _risk(rules)
    seniority = F.greatest(F.lit(0), F.least(F.lit(rules.cap("seniority_training_fit")), points(title, rules.title_points) + points(body, rules.body_points)))
    parts = base.withColumns(
        {
            "role_track_fit": F.least(F.lit(rules.cap("role_track_fit")), F.array_max("track_points")),
            "evidence_skill_fit": evidence, "evidence_groups": groups,
            "seniority_training_fit": seniority,
            "delivery_workflow_fit": F.least(F.lit(rules.cap("delivery_workflow_fit")), points(body, rules.delivery)),
            "visa": _visa(rules),
            "application_effort_bonus": F.when(F.coalesce("easy_apply", F.lit(False)), min(rules.cap("application_effort_bonus"), rules.easy_apply)).otherwise(0),
            "unsupported_stack_penalty": stack, "unsupported_stack_flags": stack_flags,
            "experience_penalty": F.when(contains_any(body, rules.heavy), 15).when(contains_any(body, rules.medium), 8).otherwise(0),
            "risk_penalty": risk, "risk_flags": risk_flags,
        }
    )
    c = F.col
    total = (
        c("role_track_fit") + c("evidence_skill_fit") + c("seniority_training_fit") + c("delivery_workflow_fit") + c("visa.score")
        + c("application_effort_bonus") - c("unsupported_stack_penalty") - c("experience_penalty") - c("risk_penalty")
    )
    breakdown = F.struct(
        "role_track_fit", "best_track", "evidence_skill_fit", "evidence_groups", "seniority_training_fit", "delivery_workflow_fit",
        c("visa.score").alias("visa_work_auth_fit"), c("visa.bucket").alias("visa_bucket"), "application_effort_bonus",
        "unsupported_stack_penalty", "unsupported_stack_flags", "experience_penalty", "risk_penalty", "risk_flags",
    )
    return parts.select(
        *df.columns, F.greatest(F.lit(0), F.least(F.lit(100), total)).cast("int").alias("matching_score"), breakdown.alias("score_breakdown")
    )


def breakdown_text(total: str = "matching_score", breakdown: str = "score_breakdown") -> Column:
    """The breakdown as four lines of fixed wording; '-' stands for nothing, and a missing breakdown leaves the total."""
    b = lambda n: F.col(f"{breakdown}.{n}")
    listed = lambda n: F.coalesce(F.nullif(F.array_join(b(n), ", "), F.lit("")), F.lit("-"))
    label = lambda n: F.coalesce(F.nullif(b(n), F.lit("")), F.lit("-"))
    number = lambda n: F.coalesce(b(n), F.lit(0))
    lines = F.format_string(
        "total=%d\nfit: track=%d (%s), evidence=%d [%s], seniority=%d\n"
        "workflow/visa: delivery=%d, visa=%d (%s), easy_apply_bonus=%d\n"
        "penalties: stack=%d [%s], experience=%d, risk=%d [%s]",
        F.col(total), number("role_track_fit"), label("best_track"), number("evidence_skill_fit"), listed("evidence_groups"),
        number("seniority_training_fit"), number("delivery_workflow_fit"), number("visa_work_auth_fit"), label("visa_bucket"),
        number("application_effort_bonus"), number("unsupported_stack_penalty"), listed("unsupported_stack_flags"),
        number("experience_penalty"), number("risk_penalty"), listed("risk_flags"),
    )
    return F.when(F.col(breakdown).isNull(), F.format_string("total=%d", F.col(total))).otherwise(lines)
