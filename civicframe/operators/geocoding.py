"""Address preparation, matching against a gazetteer in rounds, and choice among locations."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import distance_km
from ..functions.missing import first_present, if_else, matches, paste
from ..functions.text import address_key, extract_first, parse_city, parse_zip
from .columns import union_distinct
from .fuzzy import near_places
from .groups import slice_rows, top_k_per_key
from .joins import anti_join, spread_join

# Fixed value: the mark of an answer that lies outside the wanted county or state.
MISIDENTIFIED = "MISIDENTIFIED"


@dataclass(frozen=True)
class Box:
    """Bounds that a gazetteer place must lie in."""

    west: float
    south: float
    east: float
    north: float

    def holds(self, lon: Column | str, lat: Column | str) -> Column:
        lon = F.col(lon) if isinstance(lon, str) else lon
        lat = F.col(lat) if isinstance(lat, str) else lat
        return lon.between(self.west, self.east) & lat.between(self.south, self.north)


def usable_address(case_no: Column, address: Column) -> Column:
    """Case number does not start with a digit or punctuation; address is not an unknown."""
    return ~matches(case_no, r"^[0-9\p{Punct}]") & (F.substring(address, 1, 3) != "UNK")


def prepare_addresses(
    cases: DataFrame,
    default_city: str = "CHICAGO",
    from_row: int = 1,
    order_by: Sequence[str] = ("case_no",),
) -> DataFrame:
    """Distinct usable addresses of ``case_no, incident_address, incident_city`` with a full address.

    ``from_row`` leaves out the rows before it in the given order.
    """
    kept = (
        cases.select("case_no", "incident_address", "incident_city")
        .filter(usable_address(F.col("case_no"), F.col("incident_address")))
        .distinct()
    )
    if from_row > 1:
        kept = slice_rows(kept, order_by, from_row)
    city = first_present("incident_city", F.lit(default_city))
    return kept.withColumn("incident_city", city).withColumn(
        "full_address", paste(["incident_address", "incident_city"], ", ")
    )


def house_number_agrees(
    given: Column | str, found: Column | str, strict: bool = False
) -> Column:
    """Whether the found address shows a number and holds the first number of the given one.

    By default one digit, dot, star, comma or brace is enough for the first part; ``strict``
    asks for two digits in a row. Missing when the given address has no number.
    """
    found = F.col(found) if isinstance(found, str) else found
    shown = matches(found, "[0-9]{2}" if strict else "[.*0-9{,}]")
    return shown & F.contains(found, extract_first(given, "[0-9]+"))


def places_by_key(
    gazetteer: DataFrame,
    address: str,
    k: int,
    box: Box | None = None,
    near: tuple[float, float] | None = None,
    tie: str = "place_id",
) -> DataFrame:
    """Up to ``k`` places per normalized address, as an array of structs, nearest first.

    ``gazetteer`` has ``lon``, ``lat``, the address, a unique ``tie`` column and any others.
    """
    inside = gazetteer.filter(box.holds("lon", "lat")) if box else gazetteer
    away = (
        distance_km(F.col("lon"), F.col("lat"), F.lit(near[0]), F.lit(near[1]))
        if near
        else F.lit(0.0)
    )
    keyed = inside.withColumns({"__key": address_key(address), "__km": F.round(away, 6)}).filter(
        F.col("__key").isNotNull()
    )
    best = top_k_per_key(keyed, ["__key"], ["__km", tie], k)
    place = F.struct("__km", *[tie], *[c for c in gazetteer.columns if c != tie])
    return best.groupBy("__key").agg(F.array_sort(F.collect_list(place)).alias("__places"))


def geocode_join(
    addresses: DataFrame,
    gazetteer: DataFrame,
    query: str,
    address: str,
    k: int = 1,
    box: Box | None = None,
    near: tuple[float, float] | None = None,
    tie: str = "place_id",
) -> DataFrame:
    """Match addresses to places with the same normalized address, up to ``k`` each.

    Places are cut to ``k`` per address text first, so a frequent address costs no more than
    ``k`` rows per case. Addresses without a place drop out. Adds ``rank`` from 1.
    """
    places = places_by_key(gazetteer, address, k, box, near, tie)
    keyed = addresses.withColumn("__key", address_key(query))
    joined = spread_join(keyed, places, "__key", "inner")
    names = [c for c in gazetteer.columns]
    exploded = joined.select(
        *addresses.columns, F.posexplode("__places").alias("__at", "__place")
    )
    return exploded.select(
        *addresses.columns,
        (F.col("__at") + 1).alias("rank"),
        *[F.col(f"__place.{c}").alias(c) for c in names],
    )


def fuzzy_geocode_join(
    addresses: DataFrame,
    gazetteer: DataFrame,
    query: str,
    address: str,
    k: int = 1,
    edits: int = 2,
    share: int = 60,
    box: Box | None = None,
    near: tuple[float, float] | None = None,
    tie: str = "place_id",
) -> DataFrame:
    """As ``geocode_join``, for addresses that may be misspelled; adds ``rank`` from 1 and ``edits``.

    Each different text is looked up once, so repeated addresses cost a join row each and no more.
    """
    keyed = addresses.withColumn("__key", address_key(query))
    places = near_places(keyed.select("__key"), places_by_key(gazetteer, address, k, box, near, tie), k, edits, share, tie)
    joined = spread_join(keyed, places, "__key", "inner")
    exploded = joined.select(*addresses.columns, F.posexplode("__places").alias("__at", "__place"))
    return exploded.select(
        *addresses.columns,
        (F.col("__at") + 1).alias("rank"),
        F.col("__place.edits").alias("edits"),
        *[F.col(f"__place.{c}").alias(c) for c in gazetteer.columns],
    )


@dataclass(frozen=True)
class Round:
    """One attempt: which text to look up, where, and how many answers to look at.

    With ``edits`` the look-up is that of ``near_places``, so misspelled texts find places too.
    """

    name: str
    query: Column
    gazetteer: DataFrame
    address: str
    k: int = 1
    box: Box | None = None
    near: tuple[float, float] | None = None
    tie: str = "place_id"
    fields: Sequence[str] = field(default_factory=lambda: ("lat", "lon", "formatted"))
    edits: int | None = None
    share: int = 60


def geocode_rounds(
    addresses: DataFrame,
    rounds: Sequence[Round],
    accept: Callable[[Column, Column], Column],
    given: str = "incident_address",
    formatted: str = "formatted",
) -> DataFrame:
    """Try the rounds in turn, each on the rows no earlier one has an accepted answer for.

    Adds ``round`` and ``found``, the accepted answers of the first successful round as an array
    of ``fields`` structs; both are missing for rows no round could place. ``refused`` has the answers
    that did not pass in the last round that a row was asked in. One join per round,
    so the plan grows with the number of rounds and not with its powers.
    """
    out = addresses.withColumns(
        {"__done": F.lit(False), "round": F.lit(None).cast("string")}
    )
    answers = []
    for i, r in enumerate(rounds):
        places = places_by_key(r.gazetteer, r.address, r.k, r.box, r.near, r.tie)
        key = F.when(~F.col("__done"), address_key(r.query))
        asked = addresses.select(address_key(r.query).alias("__key"))
        if r.edits is not None:
            # Only what is still open is looked up, for which the earlier rounds are worked out once more.
            places = near_places(out.select(key.alias("__key")), places, r.k, r.edits, r.share, r.tie)
        joined = spread_join(
            out.withColumn("__key", key), places, "__key", "left", hot_source=asked
        )
        accepted = F.filter("__places", lambda p: accept(F.col(given), p[formatted]))
        slim = F.transform("__ok", lambda p: F.struct(*[p[f].alias(f) for f in r.fields]))
        bad = F.filter("__places", lambda p: ~F.coalesce(accept(F.col(given), p[formatted]), F.lit(False)))
        bad = F.transform(bad, lambda p: F.struct(*[p[f].alias(f) for f in r.fields]))
        hit = F.coalesce(F.size("__ok") > 0, F.lit(False))
        out = (
            joined.withColumn("__ok", accepted)
            .withColumns(
                {
                    f"__found{i}": F.when(hit, slim),
                    f"__asked{i}": ~F.col("__done"),
                    f"__refused{i}": F.when(~F.col("__done"), bad),
                    "round": F.when(hit, F.lit(r.name)).otherwise(F.col("round")),
                    "__done": F.col("__done") | hit,
                }
            )
            .drop("__places", "__key", "__ok")
        )
        answers.append(f"__found{i}")
    last = F.lit(None)
    for i in range(len(answers)):
        last = F.when(F.col(f"__asked{i}"), F.col(f"__refused{i}")).otherwise(last)
    used = [f"__{n}{i}" for n in ("asked", "refused") for i in range(len(answers))]
    return out.withColumns({"found": F.coalesce(*answers), "refused": last}).drop("__done", *answers, *used)


def with_zip_and_city(found: DataFrame, key: str = "case_no") -> DataFrame:
    """Locations with the zip code and city read from their formatted address; distinct.

    ``found``: the key, lat, lon, formatted.
    """
    return found.select(
        key,
        "lat",
        "lon",
        F.col("formatted").alias("full_address"),
        parse_zip("formatted").alias("zip"),
        parse_city("formatted").alias("city"),
    ).distinct()


def accepted_locations(located: DataFrame, key: str = "case_no") -> DataFrame:
    """The accepted answers of ``geocode_rounds``, one row each."""
    rows = located.filter("round IS NOT NULL").select(key, F.explode("found").alias("__f"))
    return with_zip_and_city(rows.select(key, "__f.*"), key)


def unplaced(located: DataFrame) -> DataFrame:
    """Rows that no round could place."""
    return located.filter("round IS NULL").drop("round", "found", "refused")


def ambiguous(located: DataFrame) -> DataFrame:
    """Rows with more than one accepted answer, for a look by hand."""
    return located.filter(F.size("found") > 1)


def to_check(located: DataFrame) -> DataFrame:
    """Answers for a look by hand, one row each, as ``found_<field>`` beside the row's own columns; distinct.

    These are the answers that did not pass, also those of rows that have a good one, all accepted answers of rows with
    more than one, and a row without an answer for each that no round could place or answer.
    """
    own = [c for c in located.columns if c not in ("round", "found", "refused")]
    fields = located.schema["found"].dataType.elementType.names
    several = F.when(F.size("found") > 1, F.col("found"))
    none = F.array().cast(located.schema["found"].dataType)
    answers = F.concat(F.coalesce("refused", none), F.coalesce(several, none))
    some = located.withColumn("__answers", answers).filter(F.col("round").isNull() | (F.size("__answers") > 0))
    rows = some.select(*own, F.explode_outer("__answers").alias("__f"))
    return rows.select(*own, *[F.col(f"__f.{f}").alias(f"found_{f}") for f in fields]).distinct()


def settle(located: DataFrame, rejected: DataFrame, key: str = "case_no") -> tuple[DataFrame, DataFrame]:
    """Good rows, without the keys that a look by hand has ``rejected``, and the answers to check.

    A rejected key only leaves the good rows: what is to be checked was listed before.
    """
    good = anti_join(located.filter("round IS NOT NULL"), rejected.select(key).distinct(), key)
    return good, to_check(located)


def chosen_index(county: Sequence[Column], state: Sequence[Column], want_county: str, want_state: str):
    """Index of the candidate to take: -1 for none fitting, missing when it cannot be told.

    A first candidate in the county decides alone, by its state. Otherwise the first later one in
    both county and state is taken.
    """
    rest = F.lit(-1)
    for i in range(len(county) - 1, 0, -1):
        rest = if_else((county[i] == want_county) & (state[i] == want_state), i, rest)
    first = if_else(state[0] == want_state, 0, -1)
    return if_else(county[0] != want_county, rest, first)


def choose_candidate(
    flat: DataFrame,
    fields: Sequence[str],
    county: str = "COUNTY",
    state: str = "STATE",
    want_county: str = "Cook",
    want_state: str = "IL",
    k: int = 3,
) -> DataFrame:
    """Add ``<field>_FIN`` of the chosen one of ``k`` flattened candidates, as text.

    ``MISIDENTIFIED`` where none fits, missing where it cannot be told.
    """

    def names(f: str) -> list[str]:
        return [f if i == 0 else f"{f}_{i + 1}" for i in range(k)]

    index = chosen_index(
        [F.col(c) for c in names(county)], [F.col(c) for c in names(state)], want_county, want_state
    )
    picked = flat.withColumn("__index", index)
    final = {}
    for f in fields:
        options = F.array(*[F.col(c).cast("string") for c in names(f)])
        final[f + "_FIN"] = F.when(F.col("__index") < 0, F.lit(MISIDENTIFIED)).otherwise(
            F.get(options, F.col("__index"))
        )
    return picked.withColumns(final).drop("__index")


def prefer_sources(
    preferred: Sequence[DataFrame], other: DataFrame, key: str, present: str
) -> DataFrame:
    """Set union in which a key that occurs more than once loses its rows from ``other``.

    Among the rows left, those of a key that still occurs more than once must have ``present``.
    A key repeated only inside ``other`` loses all its rows.
    """
    flagged = union_distinct(*preferred).withColumn("__own", F.lit(1)).unionByName(
        other.withColumn("__own", F.lit(0))
    )
    cols = [c for c in flagged.columns if c != "__own"]
    rows = flagged.groupBy(*cols).agg(F.max("__own").alias("__own"))
    sizes = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("__all"), F.sum("__own").alias("__owned")
    )
    sized = spread_join(rows, sizes, key, "left")
    left_over = F.when(F.col("__all") == 1, F.lit(1)).otherwise(F.col("__owned"))
    kept = ((F.col("__own") == 1) | (F.col("__all") == 1)) & (
        (left_over <= 1) | F.col(present).isNotNull()
    )
    return sized.filter(kept).select(cols)
