"""Source vocabularies and the three-state resolvers built on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nestfold.functions.space import full_strip

# Raw heating term -> canonical term (fixed values).
HEATING = {
    "district": "centralno",
    "central": "centralno",
    "gas": "etazno",
    "tapec": "TA",
    "centralno": "centralno",
    "etazno": "etazno",
    "etažno": "etazno",
    "podno": "podno",
    "ta": "TA",
    "klima": "klima",
    "klimatizacija": "klima",
    "elektricno": "elektricni",
    "električno": "elektricni",
    "elektricni": "elektricni",
    "podno grejanje": "podno",
    "centralno grejanje": "centralno",
    "etažno grejanje": "etazno",
    "etazno grejanje": "etazno",
}

# Raw furnishing term -> canonical term (fixed values).
FURNISHING = {
    "yes": "furnished",
    "furnished": "furnished",
    "semi": "semi-furnished",
    "semi-furnished": "semi-furnished",
    "partially furnished": "semi-furnished",
    "no": "unfurnished",
    "empty": "unfurnished",
    "unfurnished": "unfurnished",
    "namešten": "furnished",
    "namesten": "furnished",
    "polunamešten": "semi-furnished",
    "polunamesten": "semi-furnished",
    "prazan": "unfurnished",
    "nenamešten": "unfurnished",
    "nenamesten": "unfurnished",
}

# Heating codes of source B, and the order in which one is picked from several (fixed values).
HEATING_CODES = {
    1: "centralno",
    4: "elektricni",
    10: "TA",
    21: "podno",
    26: "klima",
    99: "etazno",
}
HEATING_PRIORITY = ("centralno", "etazno", "podno", "TA", "klima", "elektricni")

# Furnishing codes of source B, and the pet code that counts (fixed values).
FURNISHED_CODES = {1: "yes", 2: "semi", 3: "no"}
PET_CODE = 2

# Preference between sources for the row that stands for a flat (fixed values).
SOURCE_RANK = {"4zida": 0, "cityexpert": 1, "nekretnine": 2, "halooglasi": 3}
OTHER_SOURCE_RANK = 99


def literal_map(table: dict) -> Column:
    """A dict as a literal map: folded into the plan, no join and no broadcast."""
    if all(isinstance(x, str) for kv in table.items() for x in kv):
        # One text literal instead of two per entry keeps plans with many lookups small.
        packed = "\x1e".join(f"{k}\x1f{v}" for k, v in table.items())
        return F.str_to_map(F.lit(packed), F.lit("\x1e"), F.lit("\x1f"))
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def canonical(raw: Column, table: dict[str, str]) -> Column:
    """Canonical term for a raw one, ignoring case and outer white space; unknown gives null."""
    return F.try_element_at(literal_map(table), F.lower(full_strip(raw)))


def yes_no(answer: Column) -> Column:
    """'yes'/'no' to true/false; anything else is unknown."""
    return F.when(answer == "yes", True).when(answer == "no", False)


def resolve_tristate(structured: Column, extracted: Column) -> Column:
    """A structured answer wins; the extracted yes/no only fills the unknown."""
    return F.coalesce(structured, yes_no(extracted))


def pets_state(structured: Column, extracted: Column, view: str = "digest") -> Column:
    """Display state. The archive lets a structured no win over the text; the card does not."""
    if view == "digest":
        said = F.when(structured, "yes").when(~structured, "no")
        return F.coalesce(said, F.nullif(extracted, F.lit("")), F.lit("unknown"))
    known = F.when(extracted.isin("yes", "no", "unknown"), extracted)
    return F.coalesce(
        F.when(structured, "yes"), known, F.when(~structured, "no"), F.lit("unknown")
    )


def source_rank(source: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(SOURCE_RANK), source), F.lit(OTHER_SOURCE_RANK))


def priority_pick(codes: Column, table: dict[int, str], priority: tuple[str, ...]) -> Column:
    """Most important label among an array of codes; unknown and bad codes are passed over."""
    rank = literal_map({c: priority.index(label) for c, label in table.items()})
    order = F.array(*[F.lit(p) for p in priority])
    ranks = F.transform(codes, lambda c: F.try_element_at(rank, c.try_cast("int")))
    return F.get(order, F.array_min(ranks))


def code_present(codes: Column, code: int) -> Column:
    """Whether a code is in the array; null array or any malformed code is unknown."""
    parsed = F.transform(codes, lambda c: c.try_cast("int"))
    malformed = F.exists(parsed, lambda c: c.isNull())
    return F.when(~malformed, F.exists(parsed, lambda c: c == code))


def code_label(code: Column, table: dict[int, str]) -> Column:
    return F.try_element_at(literal_map(table), code.cast("int"))
