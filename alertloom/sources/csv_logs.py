"""Lenient reader for activity logs exported as CSV with varying headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import as_col, is_blank, let, strip

# Header spellings (lower-cased) of the typed columns; of several, the leftmost header wins.
COLUMN_ALIASES: list[tuple[str, list[str]]] = [
    ("event_time", ["eventtime", "time"]),
    ("event_name", ["eventname", "event"]),
    ("source_ip", ["sourceipaddress", "sourceip", "ip"]),
    ("user_name", ["useridentityusername", "username", "user"]),
    ("error_code", ["errorcode"]),
    ("error_message", ["errormessage"]),
    ("user_agent", ["useragent"]),
]

# One field with its separator: quoted and bare pieces may alternate inside one field, and an
# unclosed quote runs to the end of the line.
_FIELD = r'(?:"(?:[^"]++|"")*+(?:"|\z)|[^",]++)*+(?:,|\z)'


def normalize_key(name: Column | str) -> Column:
    """Field key: letters and digits only, lower case."""
    return F.lower(F.regexp_replace(as_col(name), r"[^\p{L}\p{Nd}]", ""))


def split_csv_line(line: Column) -> Column:
    """Fields of one CSV line; quotes do not span lines and a doubled quote stands for itself."""
    plain = F.transform(F.split(line, ","), strip)
    return F.when(F.contains(line, F.lit('"')), _split_quoted(line)).otherwise(plain)


def _split_quoted(line: Column) -> Column:
    pieces = F.regexp_extract_all(line, F.lit(_FIELD), F.lit(0))
    # The pattern also matches the empty text at the end of the line; that match is a field only
    # after a separator.
    return let(pieces, lambda ps: F.transform(
        F.when(
            (F.size(ps) > 1) & ~_ends_in_separator(F.get(ps, F.size(ps) - 2)),
            F.slice(ps, F.lit(1), F.size(ps) - 1),
        ).otherwise(ps),
        _unquote,
    ))


def _ends_in_separator(piece: Column) -> Column:
    """True when the last comma is a separator, that is, not inside an unclosed quote."""
    quotes = F.length(piece) - F.length(F.replace(piece, F.lit('"'), F.lit("")))
    return F.endswith(piece, F.lit(",")) & (quotes % 2 == 0)


def _unquote(piece: Column) -> Column:
    body = F.when(
        _ends_in_separator(piece), F.substr(piece, F.lit(1), F.length(piece) - 1)
    ).otherwise(piece)
    # Drop the quotes that delimit, then the doubled ones are left.
    bare = F.regexp_replace(body, r'"((?:[^"]++|"")*+)(?:"|\z)', "$1")
    return strip(F.when(F.contains(body, F.lit('"')), F.replace(bare, F.lit('""'), F.lit('"'))).otherwise(body))


def parse_logs(artifacts: DataFrame) -> DataFrame:
    """Log rows of CSV artifacts given as (artifact_id, raw).

    Lines of one artifact stay in one row until they are exploded; the intake limit of 10 MB bounds it.
    """
    text = F.regexp_replace(F.col("raw"), "\r\n?", "\n")
    lines = F.filter(
        F.transform(F.split(text, "\n"), lambda l, i: F.struct(i.alias("pos"), l.alias("line"))),
        lambda e: ~is_blank(e["line"]),
    )
    headed = artifacts.select(F.col("artifact_id"), lines.alias("lines")).select(
        "artifact_id",
        split_csv_line(F.try_element_at(F.col("lines"), F.lit(1))["line"]).alias("header"),
        F.slice("lines", F.lit(2), F.size("lines")).alias("lines"),
    )
    # What depends on the header alone is worked out once per artifact, not once per line.
    lowered = F.transform("header", lambda h: F.lower(h))
    shaped = headed.select(
        "artifact_id", "lines", field_plan("header").alias("plan"),
        let(lowered, lambda low: F.struct(*[
            _first_position(low, names).alias(column) for column, names in COLUMN_ALIASES
        ])).alias("at"),
    )
    rows = shaped.select("artifact_id", "plan", "at", F.explode("lines").alias("e")).select(
        "artifact_id", "plan", "at",
        F.col("e.pos").cast("long").alias("line_no"),
        split_csv_line(F.col("e.line")).alias("values"),
    )
    typed = [
        F.coalesce(F.get("values", F.col(f"at.{column}")), F.lit("")).alias(column) for column, _ in COLUMN_ALIASES
    ]
    return rows.select("artifact_id", "line_no", *typed, planned_map(F.col("plan"), F.col("values")).alias("fields"))


def _first_position(lowered: Column, names: list[str]) -> Column:
    """0-based position of the first header that is one of ``names``, else -1 (reads as null)."""
    flags = F.transform(lowered, lambda h: h.isin(*names))
    return (F.array_position(flags, F.lit(True)) - 1).cast("int")


def field_plan(header: Column | str) -> Column:
    """array<struct<key, next>>: normalized key of each header and where the same key occurs next."""
    keys = F.transform(as_col(header), normalize_key)
    return let(keys, lambda ks: F.transform(ks, lambda k, i: F.struct(
        k.alias("key"),
        let(F.array_position(F.slice(ks, i + 2, F.size(ks)), k), lambda p: F.when(p > 0, i + p.cast("int")))
        .alias("next"),
    )))


def planned_map(plan: Column, values: Column) -> Column:
    """Map of key to value. Of duplicate keys the last one that the row has a value for wins."""
    n = F.size(values)
    kept = F.filter(
        F.zip_with(plan, values, lambda p, v: F.struct(p["key"].alias("key"), v.alias("value"), p["next"].alias("next"))),
        lambda e: e["value"].isNotNull() & (F.coalesce(e["key"], F.lit("")) != "")
        & (e["next"].isNull() | (e["next"] >= n)),
    )
    return F.map_from_entries(F.transform(kept, lambda e: F.struct(e["key"], e["value"])))


def field_map(header: Column | str, values: Column | str) -> Column:
    """Map of normalized header to value of one row."""
    return planned_map(field_plan(header), as_col(values))
