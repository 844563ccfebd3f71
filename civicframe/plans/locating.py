"""Geocoder requests, responses, and rounds of matching against gazetteers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import first_nonempty, first_present, if_else, lenient
from ..functions.text import expand_directions, geocode_request, request_text, row_key
from ..operators.columns import union_distinct
from ..operators.geocoding import (
    MISIDENTIFIED,
    Box,
    Round,
    accepted_locations,
    choose_candidate,
    geocode_join,
    geocode_rounds,
    house_number_agrees,
    prepare_addresses,
    with_zip_and_city,
)
from ..operators.groups import first_per_group, slice_rows
from ..operators.joins import rename_clashes, spread_join
from ..operators.reshape import flatten_candidates
from ..sources.batches import append_batch

# Bounds and reference point of the geocoder calls, as longitude and latitude.
WIDE_BOX = Box(-90.06527, 39.82326, -86.55094, 43.22390)
NARROW_BOX = Box(-88.45017, 41.49624, -87.25895, 42.30971)
NEAR = (-87.68008235783819, 41.87394839029574)
# Nested response fields and the flat names they get.
CANDIDATE_FIELDS = {
    "STREET": "street",
    "CITY": "adminArea5",
    "COUNTY": "adminArea4",
    "STATE": "adminArea3",
    "ZIP": "postalCode",
    "GEO_QUALITY": "geocodeQuality",
    "GEO_QUAL_CODE": "geocodeQualityCode",
    "LAT": "latLng.lat",
    "LON": "latLng.lng",
}


def rewritten_address(full_address: Column | str) -> Column:
    """Full address with the country added and street directions written out."""
    c = F.col(full_address) if isinstance(full_address, str) else full_address
    return expand_directions(F.concat(c, F.lit(", United States")))


def standard_rounds(
    first: DataFrame, second: DataFrame, fallback: DataFrame | None = None, address: str = "address"
) -> list[Round]:
    """Raw address, rewritten address, and, if given, a second provider.

    The gazetteers stand for what each provider knows.
    """
    rounds = [
        Round("raw", F.col("full_address"), first, address, 1, WIDE_BOX, NEAR),
        Round("rewritten", rewritten_address("full_address"), second, address, 3, NARROW_BOX, NEAR),
    ]
    if fallback is not None:
        rounds.append(Round("fallback", F.col("full_address"), fallback, address, 1))
    return rounds


def _accept(strict: bool):
    def accept(given: Column, found: Column) -> Column:
        return house_number_agrees(given, found, strict)

    return accept


def locate_addresses(
    cases: DataFrame, rounds: Sequence[Round], strict: bool = False, from_row: int = 1
) -> DataFrame:
    """Addresses of the cases with the round that placed them and the accepted answers."""
    return geocode_rounds(prepare_addresses(cases, from_row=from_row), rounds, _accept(strict))


def locate_batch(
    cases: DataFrame,
    rounds: Sequence[Round],
    folder: str,
    first: int,
    last: int | None = None,
    strict: bool = False,
) -> bool:
    """Locate addresses ``first`` to ``last`` in order of case and address, and add them to the table in ``folder``.

    Rows are those of ``locate_addresses``; ``batches.batch_rows`` reads what all batches have found. A batch may
    be repeated, and batches may overlap: an address that is in the table is not looked up again. Whether
    there was anything to run.
    """
    key = ["case_no", "full_address"]
    rows = slice_rows(prepare_addresses(cases), key, first, last)
    return append_batch(
        rows, folder, f"{first}-{last or ''}", key, lambda new: geocode_rounds(new, rounds, _accept(strict))
    )


def cleaned_locations(
    worklist: DataFrame, gazetteer: DataFrame, order_by: Sequence[str], address: str = "address"
) -> DataFrame:
    """Locations from a hand-edited worklist: ``case_no, lat, lon, formatted``.

    ``worklist``: case_no, full_address_new, cleaned_address, lat, lon, formatted; the first row
    per case and address counts. Rows with a latitude are taken as they are, the others are
    looked up by their cleaned address, whose house number the answer must hold.
    """
    first = first_per_group(
        worklist,
        ["case_no", "full_address_new"],
        ["cleaned_address", "lat", "lon", "formatted"],
        order_by,
    )
    known = first.filter("lat IS NOT NULL").select("case_no", "lat", "lon", "formatted")
    todo = first.filter("cleaned_address <> '' AND lat IS NULL").select("case_no", "cleaned_address")
    found = geocode_join(todo, gazetteer, "cleaned_address", address, 1, NARROW_BOX, NEAR)
    found = found.filter(house_number_agrees("cleaned_address", "formatted"))
    return union_distinct(known, found.select("case_no", "lat", "lon", "formatted"))


def confirmed_locations(
    cases: DataFrame,
    rounds: Sequence[Round],
    cleaned: DataFrame,
    fallback: Round,
    strict: bool = False,
) -> DataFrame:
    """Accepted answers of the rounds, the cleaned locations, and of the second provider for the rest.

    The second provider is one more round, asked only about cases without a cleaned location, so
    the rounds are worked out once.
    """
    known = cleaned.select("case_no").distinct().withColumn("__cleaned", F.lit(True))
    addresses = spread_join(prepare_addresses(cases), known, "case_no", "left")
    last = replace(fallback, query=F.when(F.col("__cleaned").isNull(), fallback.query))
    located = geocode_rounds(addresses, [*rounds, last], _accept(strict))
    return union_distinct(accepted_locations(located), with_zip_and_city(cleaned))


def address_requests(addresses: DataFrame, template: str) -> DataFrame:
    """Add the row key and the request text; ``addresses``: address, county, state, city."""
    return addresses.withColumn("hash_key", row_key(addresses.columns)).withColumn(
        "request",
        geocode_request(
            template,
            street=request_text("address", "+"),
            county=F.col("county"),
            state=F.col("state"),
            city=F.col("city"),
        ),
    )


def flat_responses(responses: DataFrame) -> DataFrame:
    """Three candidates side by side: 9 fields each, plus the key and the raw address."""
    return flatten_candidates(responses, "candidates", CANDIDATE_FIELDS, 3)


def chosen_locations(flat: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Responses with a chosen candidate, and those left for manual work."""
    chosen = choose_candidate(flat.distinct(), list(CANDIDATE_FIELDS))
    unclear = F.col("LAT_FIN").isNull() | (F.col("LAT_FIN") == MISIDENTIFIED)
    best = chosen.filter(~unclear).select(
        "RAW", *[f + "_FIN" for f in CANDIDATE_FIELDS if not f.startswith("GEO_")]
    )
    return best, chosen.filter(unclear)


def status_rule(loc_type: Column, status: Column) -> Column:
    """Hospitals not marked closed are open, other places have no status."""
    return if_else(
        (loc_type == "HOSPITAL") & (status != "CLOSED"),
        "OPEN",
        if_else(loc_type != "HOSPITAL", "N/A", loc_type),
    )


def merge_manual_fields(cases: DataFrame, manual: DataFrame) -> DataFrame:
    """Let hand-made location fields win where they are neither missing nor empty.

    ``cases``: incident_address, street, city, state, zip, lat, lon. ``manual``: raw and the same
    location fields with ``_fin``, as text.
    """
    cases, manual = rename_clashes(cases, manual, [("incident_address", "raw")], ("_x", "_y"))
    joined = spread_join(cases, manual, [("incident_address", "raw")], "left")
    typed = {"zip": "int", "lat": "double", "lon": "double"}
    fields = {c: first_nonempty(F.upper(c + "_fin"), F.col(c)) for c in ("street", "city", "state")}
    for c, kind in typed.items():
        given = F.col(c + "_fin").cast("string")
        fields[c] = F.when(given != "", lenient(given, kind)).otherwise(F.col(c))
    return joined.withColumns(fields).drop(*[c for c in joined.columns if c.endswith("_fin")])


def merge_location_fields(cases: DataFrame, chosen: DataFrame) -> DataFrame:
    """Let chosen location fields win over the case's own, field by field.

    ``cases``: incident_address, street, city, state, zip, lat, lon, loc_type, status.
    ``chosen``: raw and the same location fields with ``_fin``; the zip code is cut to five
    digits. What one side decides alone is worked out before the join, since an address that many
    cases and many chosen locations share gives a row for each pair of them.
    """
    cases, chosen = rename_clashes(cases, chosen, [("incident_address", "raw")], ("_x", "_y"))
    kind = first_nonempty("loc_type", F.lit("SCENE"))
    cases = cases.withColumns({"loc_type": kind, "status": status_rule(kind, F.col("status"))})
    given = {c + "_fin": F.upper(c + "_fin") for c in ("street", "city", "state")}
    chosen = chosen.withColumns({**given, "zip_fin": lenient(F.substring("zip_fin", 1, 5), "int")})
    joined = spread_join(cases, chosen, [("incident_address", "raw")], "left")
    fields = ("street", "city", "state", "zip", "lat", "lon")
    merged = joined.withColumns({c: first_present(c + "_fin", c) for c in fields})
    return merged.drop(*[c for c in joined.columns if c.endswith("_fin")])
