"""Facts from text: the rule-based default and the incremental, cached run of any function."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from nestfold import schema
from nestfold.operators.state import cache_lookup, payload_of, split_hits, upsert_snapshot
from nestfold.session import cut, work_folder
from nestfold.sources.captured import file_system

# Phrases that state a fact, first match wins from top to bottom (our own choice; replace freely).
PETS_NO = ["bez ljubimaca", "ljubimci nisu dozvoljeni", "no pets"]
PETS_YES = [
    "ljubimci dozvoljeni",
    "са кућним љубимцима",
    "разрешены животные",
    "pets ok",
    "pets allowed",
]
DISHWASHER = ["sudopera", "mašina za sudove", "dishwasher"]
HEATING_PHRASES = {
    "podno": ["podno grejanje", "underfloor"],
    "etazno": ["etažno grejanje", "etazno grejanje"],
    "TA": ["ta peć", "ta pec"],
    "elektricni": ["električno grejanje", "norveški radijator"],
    "centralno": ["centralno grejanje", "district heating"],
    "klima": ["grejanje na klimu"],
}
FURNISHING_PHRASES = {
    "unfurnished": ["nenamešten", "neopremljen", "prazan stan"],
    "semi-furnished": ["polunamešten", "delimično opremljen"],
    "furnished": ["namešten"],
}
AGENCY_PHRASES = ["agencij", "agency"]
OWNER_PHRASES = ["vlasnik", "owner"]
RED_FLAGS = {
    "students only": ["samo studenti", "students only"],
    "no smoking": ["nepušač", "no smoking"],
    "shared bathroom": ["zajedničko kupatilo", "shared bathroom"],
    "high deposit": ["depozit dva", "depozit 2", "dva depozita", "depozit tri", "two months deposit", "deposit of two"],
    "long lease only": ["dugoročno", "na duži period", "long-term only", "long term only"],
}
LEASE_RE = r"minimum\s+([0-9]+)\s*(?:mesec|month)"
BILLS_RE = r"(?:računi|komunalije|bills)\D{0,12}([0-9]+(?:[.,][0-9]{3}(?![0-9]))*)"
SURFACE_RE = r"([0-9]+(?:[.,][0-9]+)?)\s*(?:m2|m²|кв)"
ADDRESS_RE = r"(?:📍|adresa:|address:)\s*([^\n.;]+)"


def _says(low: Column, phrases: list[str]) -> Column:
    hit = F.lit(False)
    for p in phrases:
        hit = hit | low.contains(p)
    return hit


def _pick(low: Column, table: dict[str, list[str]]) -> Column:
    return F.coalesce(*[F.when(_says(low, ps), F.lit(name)) for name, ps in table.items()])


def _pets(low: Column) -> Column:
    return F.when(_says(low, PETS_NO), "no").when(_says(low, PETS_YES), "yes").otherwise("unknown")


def _number(low: Column, pattern: str) -> Column:
    """The whole number at the pattern's group; marks between thousands are left out."""
    return F.nullif(F.translate(F.regexp_extract(low, pattern, 1), ".,", ""), F.lit("")).try_cast("int")


def text_facts(c: Column) -> Column:
    """Listing facts stated in a text, as the EXTRACTION struct. Silence gives null."""
    low = F.lower(F.coalesce(c, F.lit("")))
    flags = F.array_compact(F.array(*[F.when(_says(low, ps), F.lit(n)) for n, ps in RED_FLAGS.items()]))
    source = F.when(_says(low, AGENCY_PHRASES), "agency").when(_says(low, OWNER_PHRASES), "owner")
    values = {
        "pets_allowed": _pets(low),
        "dishwasher": F.when(_says(low, DISHWASHER), True),
        "elevator_confirmed": F.when(low.rlike(r"\b(?:lift|elevator)\b"), True),
        "heating_type_confirmed": _pick(low, HEATING_PHRASES),
        "furnishing_confirmed": _pick(low, FURNISHING_PHRASES),
        "max_lease_months": _number(low, LEASE_RE),
        "bills_estimate_eur": _number(low, BILLS_RE),
        "agency_or_owner": F.coalesce(source, F.lit("unknown")),
        "red_flags": flags,
    }
    return F.struct(
        *[
            values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.EXTRACTION.fields
        ]
    )


def post_facts(c: Column) -> Column:
    """Facts of a free-form channel post, as the POST_FACTS struct."""
    low = F.lower(F.coalesce(c, F.lit("")))
    surface = F.translate(F.regexp_extract(low, SURFACE_RE, 1), ",", ".")
    address = F.trim(F.regexp_extract(F.coalesce(c, F.lit("")), f"(?iu){ADDRESS_RE}", 1))
    return F.struct(
        F.nullif(surface, F.lit("")).try_cast("double").alias("m2"),
        _pets(low).alias("pets_allowed"),
        F.nullif(address, F.lit("")).alias("address"),
        F.lit(None).cast("string").alias("summary_en"),
    )


# An enrichment function gets (key, text) rows and returns (key, payload) rows, with an ``error``
# where a row has no payload.
EnrichFn = Callable[[pd.DataFrame], pd.DataFrame]


class BudgetExhausted(Exception):
    """Raised by an enrichment function when no further call can succeed; ``answered`` holds its rows so far."""

    def __init__(self, message: str = "budget exhausted", answered: pd.DataFrame | None = None):
        super().__init__(message)
        self.answered = answered


def per_row(call: Callable[[str], str]) -> EnrichFn:
    """An enrichment function from one that answers a single text: a failing row fails alone, and
    nothing is called after the budget is exhausted."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        done: list[tuple] = []
        frame = lambda: pd.DataFrame(done, columns=["key", "payload", "error"])
        for key, text in zip(rows["key"], rows["text"]):
            try:
                done.append((key, call(text), None))
            except BudgetExhausted as e:
                raise BudgetExhausted(str(e), frame()) from e
            except Exception as e:  # noqa: BLE001
                done.append((key, None, str(e) or type(e).__name__))
        return frame()

    return run


class Stop:
    """A stop that all tasks of a run see: a file in the shared folder, looked for before each batch.

    Reached through Arrow's file systems; where the folder lies in another kind of store a stop is known
    in its own task only.
    """

    def __init__(self, path: str):
        self.path = path

    def _place(self) -> tuple[fs.FileSystem, str] | None:
        try:
            return file_system(self.path)
        except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
            return None

    def said(self) -> str | None:
        place = self._place()
        if place is None or place[0].get_file_info(place[1]).type == fs.FileType.NotFound:
            return None
        with place[0].open_input_stream(place[1]) as held:
            return held.read().decode()

    def say(self, why: str) -> None:
        place = self._place()
        if place is not None:
            files, path = place
            files.create_dir(path.rpartition("/")[0])
            made = f"{path}.{uuid.uuid4().hex}"
            with files.open_output_stream(made) as out:
                out.write(why.encode())
            files.move(made, path)


def answering(fn: EnrichFn, key: str, text_col: str, stop: Stop | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Whole rows with ``payload`` and ``error`` behind them. ``fn`` is called once for a batch, and no more after it
    said in any task that its budget is exhausted: another task ends the batch that it is at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent: str | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pd.DataFrame({"key": batch.column(key).to_pylist(), "text": batch.column(text_col).to_pylist()})
            if spent is None and stop is not None:
                spent = stop.said()
            got, error = None, spent
            if spent is None:
                try:
                    got = fn(rows)
                except BudgetExhausted as e:
                    got, error = e.answered, str(e)
                    spent = error
                    if stop is not None:
                        stop.say(error)
                except Exception as e:  # noqa: BLE001
                    error = str(e) or type(e).__name__
            said = {} if got is None else dict(zip(got["key"], got["payload"]))
            failed = dict(zip(got["key"], got["error"])) if got is not None and "error" in got else {}
            payloads = [said.get(k) for k in rows["key"]]
            errors = [None if p is not None else failed.get(k) or error or "no answer" for k, p in zip(rows["key"], payloads)]
            columns = [*batch.columns, pa.array(payloads, pa.string()), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "payload", "error"])

    return run


def incremental_enrich(
    df: DataFrame,
    cache: DataFrame,
    fn: "EnrichFn | Callable[[Column], Column]",
    as_of: datetime,
    budget: int | None = None,
    key: str = "listing_key",
    text_col: str = "description",
    seq: str = "seq",
    as_column: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Facts for every row from the cache or from ``fn``; returns (rows, next cache, failures).

    Only rows without a valid cache entry reach ``fn``: a function of (key, text) rows called in
    Arrow batches, or with ``as_column`` a Column function. Rows pass through with their answer,
    so texts are not joined again. ``budget`` lets only the first so many misses (in arrival
    order) be tried, spread over all cores: the limit is the feature, meant for call-priced
    services. Answers are materialised once, so ``fn`` is not called again when the outputs are
    read. Failed rows keep a null ``extraction``, are not cached and retry next run.
    """
    # The lookup feeds three branches, so its join runs once.
    hits, misses = split_hits(cut(cache_lookup(df, cache, key, text_col)))
    tried, over = misses, None
    if budget is not None:
        cores = df.sparkSession.sparkContext.defaultParallelism
        tried = cut(misses.orderBy(seq).limit(budget).repartition(max(1, min(budget, cores)), seq))
        over = misses.join(tried.select(key), key, "left_anti")
    if as_column:
        answered = tried.withColumn("payload", payload_of(fn(F.col(text_col)))).withColumn("error", F.lit(None).cast("string"))
    else:
        fields = [*tried.schema.fields, StructField("payload", StringType()), StructField("error", StringType())]
        stop = Stop(work_folder(df.sparkSession, "stop"))
        answered = cut(tried.mapInArrow(answering(fn, key, text_col, stop), StructType(fields)))
    filled = answered.withColumn("extraction", F.from_json("payload", schema.EXTRACTION)).drop("payload", "error")
    rows = hits.unionByName(filled)
    failures = answered.filter("payload is null").select(key, "error")
    if over is not None:
        rows = rows.unionByName(over.withColumn("extraction", F.lit(None).cast(schema.EXTRACTION)))
        failures = failures.unionByName(over.select(key, F.lit("over budget").alias("error")))
    stored = answered.filter("payload is not null").select(
        key, "payload", "desc_hash", F.lit(as_of).cast("timestamp").alias("extracted_at")
    )
    new_cache = upsert_snapshot(cache, stored, key, ["payload", "desc_hash", "extracted_at"], "extracted_at")
    return rows, new_cache, failures
