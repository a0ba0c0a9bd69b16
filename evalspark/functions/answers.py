"""Reading a model's answer: fenced or plain JSON text into typed fields and a state."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark.functions.text import strip

FENCE = "```"

OK = "ok"
NOT_OBJECT = "not_object"
PARSE_ERROR = "parse_error"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` worked out once however often it is used.

    A plain column that is used several times is copied into each use when the
    optimizer moves a filter below it; a lambda variable is not.
    """
    return F.transform(F.array(value), body)[0]


def unfenced(raw: Column) -> Column:
    """Answer text without a code fence.

    Inside a fence all leading and trailing back-ticks go, and so does the first
    ``json`` wherever it stands.
    """

    def without_word(bare: Column) -> Column:
        at = F.instr(bare, "json")
        return strip(F.when(at > 0, F.overlay(bare, F.lit(""), at, F.lit(4))).otherwise(bare))

    return let(
        strip(raw),
        lambda text: F.when(text.startswith(FENCE), let(F.btrim(text, F.lit("`")), without_word)).otherwise(text),
    )


def json_in_list(text: Column) -> Column:
    """Variant of the text put into a list; null if that is not JSON."""
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))


def single_value(text: Column, in_list: Column) -> Column:
    """Variant of a text that is exactly one JSON value, else null.

    ``try_parse_json`` reads the first value and ignores what follows. Whether
    anything follows shows when the text stands in a list and in an object: the
    list must hold one element, and both must be read without error.
    """
    in_object = F.try_parse_json(F.concat(F.lit('{"w":'), text, F.lit("}")))
    only_one = in_object.isNotNull() & F.try_variant_get(in_list, "$[1]", "variant").isNull()
    return F.when(only_one, F.try_variant_get(in_list, "$[0]", "variant"))


def parse_state(raw: Column, value: Column) -> Column:
    """``ok`` for an object, ``not_object`` for another JSON value, else ``parse_error``."""
    return (
        F.when(F.coalesce(raw, F.lit("")) == "", PARSE_ERROR)
        .when(value.isNull(), PARSE_ERROR)
        .when(F.schema_of_variant(value).startswith("OBJECT"), OK)
        .otherwise(NOT_OBJECT)
    )


def fields_of(value: Column, fields: Sequence[str]) -> Column:
    """Struct of the named fields as text; a missing field is null."""
    return F.struct(*[F.try_variant_get(value, f"$.{f}", "string").alias(f) for f in fields])


def read_answer(raw: Column, fields: Sequence[str]) -> Column:
    """Struct of ``state`` and ``parsed`` (null unless the state is ``ok``)."""

    def result(value: Column) -> Column:
        return let(
            parse_state(raw, value),
            lambda state: F.struct(state.alias("state"), F.when(state == OK, fields_of(value, fields)).alias("parsed")),
        )

    return let(
        unfenced(raw), lambda text: let(json_in_list(text), lambda in_list: let(single_value(text, in_list), result))
    )
