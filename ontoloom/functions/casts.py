"""Scalars from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WHOLE, _NUMBER = "^[+-]?[0-9]+$", "^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(?i:nan|inf|infinity)$"
OBJECT_ID = "^[0-9a-fA-F]{24}$"


def xsd_type(text: Column, hint: Column | None = None) -> Column:
    """The datatype hint where there is one; else the narrowest of boolean, integer, double and string that reads the text."""
    t = F.trim(text)
    guess = F.when(F.lower(t).isin("true", "false"), "boolean").when(F.regexp_like(t, F.lit(_WHOLE)), "integer").when(F.regexp_like(t, F.lit(_NUMBER)), "double").otherwise("string")
    if hint is None:
        return guess
    said = F.regexp_extract(hint, "[^#:/]*$", 0)
    return F.when(F.coalesce(said, F.lit("")) != "", said).otherwise(guess)


def parse_bool(text: Column) -> Column:
    """true and 1, false and 0, in any case; else null."""
    t = F.lower(F.trim(text))
    return F.when(t.isin("true", "1"), True).when(t.isin("false", "0"), False)


def parse_int(text: Column) -> Column:
    """Numbers, cut to whole ones; else null."""
    return F.trim(text).try_cast("double").try_cast("bigint")


def parse_float(text: Column) -> Column:
    return F.trim(text).try_cast("double")


def parse_date(text: Column) -> Column:
    """ISO 8601 with or without time and zone, and year/month/day; UTC where no zone is given; else null."""
    t = F.trim(text)
    return F.coalesce(F.when(F.regexp_like(t, F.lit("^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ].*)?$")), t.try_cast("timestamp")), F.try_to_timestamp(t, F.lit("yyyy/MM/dd")))


def parse_scalar(text: Column, bson: Column) -> Column:
    """The text as the type says, written in JSON's way; the raw text where it can't be read as that type."""
    read = (
        F.when(bson.isin("int", "long"), parse_int(text).cast("string"))
        .when(bson.isin("double", "decimal"), parse_float(text).cast("string"))
        .when(bson == "bool", parse_bool(text).cast("string"))
        .when(bson == "date", F.date_format(parse_date(text), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    )
    return F.coalesce(read, text)


def reads_as(text: Column, bson: Column) -> Column:
    """Whether parse_scalar() reads the text as its type; text of other types always does."""
    return (
        F.when(bson.isin("int", "long"), parse_int(text).isNotNull()).when(bson.isin("double", "decimal"), parse_float(text).isNotNull())
        .when(bson == "bool", parse_bool(text).isNotNull()).when(bson == "date", parse_date(text).isNotNull()).otherwise(F.lit(True))
    )


def object_id(text: Column) -> Column:
    """24 hexadecimal digits in lower case; else null."""
    return F.when(F.regexp_like(text, F.lit(OBJECT_ID)), F.lower(text))


def object_ids(texts: Column) -> Column:
    """All of an array's ids; null if one of them is none."""
    return F.when(F.forall(texts, lambda x: F.coalesce(F.regexp_like(x, F.lit(OBJECT_ID)), F.lit(False))), F.transform(texts, lambda x: F.lower(x)))
