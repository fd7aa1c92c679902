"""Rule cascades that keep a reason for each rejected row.

Rules are Columns, so a whole cascade is one projection: no shuffle, no Python, evaluated
left to right and stopped at the first failing rule.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nestfold.config import FilterConfig
from nestfold.functions import text, vocab
from nestfold.session import broadcast_if_small


@dataclass(frozen=True)
class Rule:
    """A named condition under which a row fails, and what to tell about it."""

    name: str
    fails: Column
    message: Column


def first_failing(rules: list[Rule]) -> Column:
    """``struct(rule, message)`` of the first failing rule, null when all pass."""
    return F.coalesce(
        *[F.when(r.fails, F.struct(F.lit(r.name).alias("rule"), r.message.alias("message"))) for r in rules]
    )


def all_failing(rules: list[Rule]) -> Column:
    """Messages of every failing rule, in rule order."""
    return F.array_compact(F.array(*[F.when(r.fails, r.message) for r in rules]))


def _say(*parts) -> Column:
    return F.concat(
        *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    )


# Messages of the rules below are fixed values: reports show them to users who know them.


def structural_rules(cfg: FilterConfig, as_of: datetime) -> list[Rule]:
    """Price, rooms, surface, floor, lift, age and photo, cheapest knowledge first."""
    c = F.col
    rules = [
        Rule(
            "price",
            (c("price_eur") <= 0) | (c("price_eur") > cfg.price_eur_max),
            _say("price ", c("price_eur"), f"€ > cap {cfg.price_eur_max}€"),
        ),
        Rule(
            "rooms",
            ~c("rooms").between(cfg.rooms_min, cfg.rooms_max),
            _say("rooms ", c("rooms"), f" outside [{cfg.rooms_min}, {cfg.rooms_max}]"),
        ),
        Rule(
            "surface",
            c("m2") < cfg.surface_m2_min,
            _say("surface ", c("m2"), f"m² < {cfg.surface_m2_min}m²"),
        ),
        Rule("floor_unknown", c("floor").isNull(), F.lit("floor unknown")),
        Rule("basement", c("floor") < 0, _say("basement floor (", c("floor"), ")")),
    ]
    if cfg.elevator_required:
        no_lift = (c("floor") > 0) & c("elevator").eqNullSafe(F.lit(False))
        rules.append(Rule("elevator", no_lift, F.lit("no elevator")))
    cutoff = F.lit(as_of) - F.make_dt_interval(F.lit(cfg.freshness_days))
    rules.append(
        Rule("age", c("created_at") < cutoff, F.lit(f"older than {cfg.freshness_days}d"))
    )
    if cfg.photo_required:
        blank = text.full_strip(F.coalesce(c("image_url"), F.lit(""))) == ""
        rules.append(Rule("photo", blank, F.lit("no photo")))
    return rules


def structural_filter(df: DataFrame, cfg: FilterConfig, as_of: datetime) -> DataFrame:
    """Adds ``rule_id`` and ``reject_reason``; both null on rows that pass."""
    verdict = first_failing(structural_rules(cfg, as_of))
    return df.withColumn("_v", verdict).select(
        *df.columns, F.col("_v.rule").alias("rule_id"), F.col("_v.message").alias("reject_reason")
    )


def facts_rules(cfg: FilterConfig) -> tuple[list[Rule], list[Rule]]:
    """Hard and soft rules over structured fields backed by the ``extraction`` struct."""
    c = F.col
    e = c("extraction")
    hard: list[Rule] = []
    soft: list[Rule] = []
    if cfg.pets_required:
        pets = vocab.resolve_tristate(c("pets_allowed"), e["pets_allowed"])
        hard.append(Rule("pets", ~pets, F.lit("pets not allowed")))
    if cfg.dishwasher_required:
        dish = F.when(c("dishwasher"), True).otherwise(e["dishwasher"])
        hard.append(Rule("dishwasher", ~dish, F.lit("no dishwasher")))
        soft.append(Rule("dishwasher", dish.isNull(), F.lit("dishwasher unclear")))
    for name, raw, said, table, allowed in (
        ("heating", "heating_type", "heating_type_confirmed", vocab.HEATING, cfg.heating_allowed),
        ("furnishing", "furnished", "furnishing_confirmed", vocab.FURNISHING, cfg.furnishing_allowed),
    ):
        if not allowed:
            continue
        value = F.coalesce(vocab.canonical(c(raw), table), vocab.canonical(e[said], table))
        hard.append(
            Rule(name, ~value.isin(*allowed), _say(f"{name}=", value, f" not in {list(allowed)}"))
        )
        soft.append(Rule(name, value.isNull(), F.lit(f"{name} unclear")))
    if cfg.max_lease_months:
        lease = e["max_lease_months"]
        hard.append(
            Rule(
                "lease",
                lease > cfg.max_lease_months,
                _say("min lease ", lease, f"mo > {cfg.max_lease_months}mo"),
            )
        )
    return hard, soft


def facts_filter(df: DataFrame, cfg: FilterConfig) -> DataFrame:
    """Adds ``verdict`` (rejected / near_miss / passed), ``fact_rule``, ``hard`` and ``soft``.

    Any hard failure rejects; otherwise any soft one makes a near miss with all its reasons.
    """
    hard, soft = facts_rules(cfg)
    out = (
        df.withColumn("_h", first_failing(hard))
        .withColumn("hard", all_failing(hard))
        .withColumn("soft", all_failing(soft))
    )
    verdict = (
        F.when(F.col("_h").isNotNull(), "rejected")
        .when(F.size("soft") > 0, "near_miss")
        .otherwise("passed")
    )
    return out.withColumn("verdict", verdict).withColumn("fact_rule", F.col("_h.rule")).drop("_h")


def canonicalize_vocab(
    df: DataFrame, col: str, table: "dict[str, str] | DataFrame", out: str = "canonical"
) -> DataFrame:
    """Canonical term of a raw column, by a literal table or by a vocabulary frame
    ``(raw, canonical)``. One common term may be on most rows, so a frame whose counted size
    allows it is broadcast and the rows stay where they are."""
    if isinstance(table, dict):
        return df.withColumn(out, vocab.canonical(F.col(col), table))
    terms = table.select(F.col("raw").alias("_raw"), F.col("canonical").alias(out))
    terms = broadcast_if_small(terms)
    return df.join(terms, F.lower(text.full_strip(F.col(col))) == F.col("_raw"), "left").drop("_raw")


def commute_gate(df: DataFrame, gating: list[str], max_min: int, commute: str = "commute") -> DataFrame:
    """Adds ``gate_reason``: the first gating destination without a walk or with too long a one.

    ``commute`` maps destination to minutes; a missing entry counts like a null one, so a
    walk that could not be computed holds the row back.
    """
    rules = []
    for name in gating:
        walk = F.try_element_at(commute, F.lit(name))
        rules.append(Rule(name, walk.isNull(), F.lit(f"no walking route to {name}")))
        rules.append(Rule(name, walk > max_min, _say(f"{name} ", walk, f"m > {max_min}m walk")))
    reason = first_failing(rules)["message"] if rules else F.lit(None).cast("string")
    return df.withColumn("gate_reason", reason)


def hashtag_filter(df: DataFrame, tag: str, text_col: str = "text") -> DataFrame:
    return df.filter(text.has_hashtag(F.col(text_col), tag))


def post_filter(df: DataFrame, m2_min: float, facts: str = "facts") -> DataFrame:
    """Posts that allow pets and state a surface strictly above the limit."""
    f = F.col(facts)
    return df.filter((f["pets_allowed"] == "yes") & (f["m2"] > m2_min))
