"""Cell text to typed value. A cell that does not fit is NULL and reported, never guessed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of blank cells, booleans and date formats.
BLANKS = ("", "NULL", "N/A", "#N/A", "-", "<BLANK>")
TRUE_WORDS = ("true", "yes", "y", "t", "1")
FALSE_WORDS = ("false", "no", "n", "f", "0")
ISO_DATETIME = r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2}(Z|[+-]\d{2}:?\d{2})?)?\z"
MONTH_FIRST = "MM/dd/yyyy"
DAY_FIRST = "dd/MM/yyyy"
SLASHED = r"^(\d{1,2})/(\d{1,2})/(\d{4})\z"


def blank_to_null(cell: Column, extra: tuple[str, ...] = ()) -> Column:
    """The trimmed cell, or NULL for an empty cell or one of the agreed blank spellings."""
    text = F.trim(cell)
    words = [*BLANKS, *[w.strip().upper() for w in extra]]
    return F.when(F.upper(text).isin(words), F.lit(None)).otherwise(text)


def to_boolean(cell: Column) -> Column:
    word = F.lower(F.trim(cell))
    return F.when(word.isin(list(TRUE_WORDS)), F.lit(True)).when(
        word.isin(list(FALSE_WORDS)), F.lit(False)
    )


def to_number(cell: Column, decimal: str = ".") -> Column:
    """A double; ``,`` and ``_`` group thousands, or ``.`` does where the decimal sign is a comma."""
    if decimal == ",":
        plain = F.translate(F.translate(F.trim(cell), "._", ""), ",", ".")
    else:
        plain = F.translate(F.trim(cell), ",_", "")
    fits = plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z")
    return F.when(fits, plain.try_cast("double"))


def mixes_decimal_signs(cell: Column) -> Column:
    """Whether a column holds both decimal-comma and decimal-point cells (an aggregate)."""
    comma = F.bool_or(cell.rlike(r"\d,\d{1,2}\s*\z"))
    point = F.bool_or(cell.rlike(r"\d\.\d{1,2}\s*\z"))
    return F.coalesce(comma & point, F.lit(False))


def to_datetime(cell: Column, slashes: Column | str = MONTH_FIRST) -> Column:
    """A timestamp from ISO text, ``yyyy-MM-dd[ HH:mm:ss]`` or a slashed date read as ``slashes``."""
    text = F.trim(cell)
    order = slashes if isinstance(slashes, Column) else F.lit(slashes)
    return F.coalesce(
        F.when(text.rlike(ISO_DATETIME), F.try_to_timestamp(text)),
        F.when(
            text.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\z"),
            F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")),
        ),
        F.when(
            text.rlike(SLASHED) & (order == MONTH_FIRST), F.try_to_timestamp(text, F.lit("M/d/yyyy"))
        ),
        F.when(
            text.rlike(SLASHED) & (order == DAY_FIRST), F.try_to_timestamp(text, F.lit("d/M/yyyy"))
        ),
    )


def from_epoch(cell: Column) -> Column:
    """Epoch seconds, only where the caller asks for them."""
    return F.timestamp_seconds(cell.try_cast("bigint"))


def slash_order(cell: Column) -> Column:
    """Aggregate: which slashed form every cell of a column fits.

    ``ambiguous`` when both do, ``neither`` when no form fits all cells, NULL without slashed cells.
    """
    first = F.max(F.regexp_extract(cell, SLASHED, 1).try_cast("int"))
    second = F.max(F.regexp_extract(cell, SLASHED, 2).try_cast("int"))
    return (
        F.when(first.isNull(), F.lit(None))
        .when((first <= 12) & (second <= 12), F.lit("ambiguous"))
        .when((first <= 12) & (second > 12), F.lit(MONTH_FIRST))
        .when((first > 12) & (second <= 12), F.lit(DAY_FIRST))
        .otherwise(F.lit("neither"))
    )


def to_json_value(cell: Column) -> Column:
    """The parsed value (VARIANT), NULL when the whole text is not one JSON value.

    The parser stops after the first value, so the text is also read as a member and as an element:
    what follows a value cannot close both.
    """
    member = F.try_parse_json(F.concat(F.lit('{"v":'), cell, F.lit("}")))
    element = F.try_parse_json(F.concat(F.lit("["), cell, F.lit("]")))
    return F.when(element.isNotNull(), F.try_variant_get(member, "$.v", "variant"))
