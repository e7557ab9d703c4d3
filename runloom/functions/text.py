"""Structure strings, file and application names, units, run stamps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The run stamp format, in both notations, and the name patterns.
STAMP_FORMAT = "yyyy.MM.dd-HH.mm.ss"
STAMP_STRFTIME = "%Y.%m.%d-%H.%M.%S"
APP_NAME = r"^([^-]*)-[^_-]*_(\d+)[^-]*-[^_-]*_(\d+)[^-]*-[^_-]*_(\d+)"
IMAGE_NAME = r"img(\d+)_channel(\d+)_category(\d+)"
LAYER_PIECE = r"^([0-9]+)([a-zA-Z]+)"


def run_stamp(ts: Column) -> Column:
    return F.date_format(ts, STAMP_FORMAT)


def stamp_time(stamp: Column) -> Column:
    """Stamps carry no zone, so neither does the result."""
    return F.to_timestamp_ntz(stamp, F.lit(STAMP_FORMAT))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_dir(path: Column) -> Column:
    """Everything before the last slash; ``.`` when there is none."""
    cut = F.length(path) - F.length(base_name(path)) - 1
    return F.when(cut > 0, F.substring(path, F.lit(1), cut)).otherwise(F.lit("."))


def app_name_parts(name: Column) -> list[Column]:
    """``name-dsize_N-partition_P-itr_I`` as four columns."""
    part = lambda i: F.regexp_extract(name, APP_NAME, i)
    return [
        part(1).alias("app_name"),
        part(2).cast("long").alias("data_size"),
        part(3).cast("long").alias("num_partition"),
        part(4).cast("long").alias("itr"),
    ]


def image_name_parts(name: Column) -> list[Column]:
    part = lambda i: F.regexp_extract(name, IMAGE_NAME, i).cast("int")
    return [part(1).alias("img"), part(2).alias("channel"), part(3).alias("category")]


def structure_string(input_channels: Column, network: Column) -> Column:
    """``{in}FC_LIN-{n}{type}-...`` from an array of (num_channels, type) structs."""
    pieces = F.transform(network, lambda l: F.concat(l["num_channels"].cast("string"), l["type"]))
    return F.concat_ws("-", F.concat(input_channels.cast("string"), F.lit("FC_LIN")), F.concat_ws("-", pieces))


def parse_structure(structure: Column) -> Column:
    """``15sig-1lin`` as [(15, sig), (1, lin)]."""
    return F.transform(
        F.split(structure, "-"),
        lambda piece: F.struct(
            F.regexp_extract(piece, LAYER_PIECE, 1).cast("int").alias("num_channels"),
            F.regexp_extract(piece, LAYER_PIECE, 2).alias("type"),
        ),
    )


# Time units in seconds, and size units by their first letter, decimal.
TIME_UNITS = {"ms": 0.001, "mS": 0.001, "min": 60.0, "Min": 60.0, "h": 3600.0, "s": 1.0, "S": 1.0}
SIZE_UNITS = {"k": 1000.0, "K": 1000.0, "m": 0.001, "M": 1000000.0, "g": 1000000000.0, "G": 1000000000.0}


def _factor(unit: Column, units: dict[str, float]) -> Column:
    """The factor of a unit, NULL for another."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in units.items() for x in pair]), unit)


def _number_and_unit(text: Column) -> tuple[Column, Column]:
    tokens = F.split(F.trim(text), r"\s+")
    return F.get(tokens, F.lit(0)).try_cast("double"), F.element_at(tokens, -1)


def in_seconds(text: Column) -> Column:
    """Numeric seconds of ``3 ms``, ``2 min`` ...; NULL when the unit is no time unit."""
    number, unit = _number_and_unit(text)
    return number * _factor(unit, TIME_UNITS)


def time_text(text: Column) -> Column:
    """Seconds as text when the unit is a time, otherwise the text unchanged; empty is NULL."""
    return F.when(F.trim(text) != "", F.coalesce(in_seconds(text).cast("string"), text))


def magnitude(text: Column) -> Column:
    """Plain number of a time or size text; sizes are decimal and told by the first letter.

    Only the last token names the unit, so ``2.5 KB / 10`` stays 2.5. Empty is NULL.
    """
    number, unit = _number_and_unit(text)
    sized = number * F.coalesce(_factor(F.substring(unit, 1, 1), SIZE_UNITS), F.lit(1.0))
    return F.when(F.trim(text) != "", F.coalesce(in_seconds(text), sized))
