"""Typed access to untrusted JSON through VARIANT: a value of another type is null, as JSON null is."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def allow_repeated_keys(spark: SparkSession) -> None:
    """Of equal keys in one object the last counts, from now on in this session: Spark reads the setting when a plan runs, and without it such text is no JSON."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def parse(text: Column) -> Column:
    """A variant, or null if the text isn't JSON. See :func:`allow_repeated_keys`."""
    return F.try_parse_json(text)


def kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def string(v: Column, path: str = "$") -> Column:
    found = at(v, path)
    return F.when(kind(found) == "STRING", F.try_variant_get(v, path, "string"))


def boolean(v: Column, path: str) -> Column:
    return F.when(kind(at(v, path)) == "BOOLEAN", F.try_variant_get(v, path, "boolean"))


def count(v: Column, path: str) -> Column:
    """An unsigned number: fractions are cut, negatives and anything else are 0."""
    found = kind(at(v, path))
    number = found.isin("BIGINT", "DOUBLE", "FLOAT") | found.startswith("DECIMAL")
    whole = F.coalesce(F.try_variant_get(v, path, "bigint"), F.try_variant_get(v, path, "double").try_cast("bigint"))
    return F.coalesce(F.when(number, F.greatest(whole, F.lit(0))), F.lit(0)).cast("long")


def items(v: Column, path: str) -> Column:
    """An array's elements as variants; null for anything else."""
    return F.when(kind(at(v, path)).startswith("ARRAY"), F.try_variant_get(v, path, "array<variant>"))


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed and written once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _inside(v: Column) -> Column:
    """The blocks that give a block its text; null if it has a text of its own or none."""
    plain = F.coalesce(string(v, "$.text"), string(v, "$.input_text"), string(v, "$.output_text"))
    follows = let(F.coalesce(string(v, "$.type"), F.lit("")), lambda k: (k == "tool_result") | ((k != "tool_use") & plain.isNull()))
    return F.when(follows, F.try_variant_get(v, "$.content", "array<variant>"))


def _item(v: Column) -> Column:
    """The text of a block without blocks inside."""
    inner = F.coalesce(string(v, "$.content"), string(v, "$.content.text"))
    plain = F.coalesce(string(v, "$.text"), string(v, "$.input_text"), string(v, "$.output_text"))
    tool = F.concat(F.lit("[Tool: "), F.coalesce(string(v, "$.name"), F.lit("unknown")), F.lit("]"))
    return let(F.coalesce(string(v, "$.type"), F.lit("")), lambda k: F.when(k == "tool_use", tool).otherwise(F.coalesce(F.when(k != "tool_result", plain), inner)))


def _leaves(c: Column) -> Column:
    """An array's blocks, each with blocks inside replaced by these, in order and however deep they lie.

    A round opens one level. There are no more levels than keys named content; rounds after the last do nothing.
    """
    state = lambda blocks: F.struct(blocks.alias("blocks"), F.exists(blocks, lambda b: _inside(b).isNotNull()).alias("more"))
    opened = lambda blocks: F.flatten(F.transform(blocks, lambda b: F.coalesce(_inside(b), F.array(b))))

    def all_levels(s: Column) -> Column:
        rounds = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(F.split(c.cast("string"), '"content"', -1)) - 1))
        return F.aggregate(rounds, s, lambda acc, _: F.when(acc["more"], let(opened(acc["blocks"]), state)).otherwise(acc))

    first = let(F.try_variant_get(c, "$", "array<variant>"), state)
    return let(first, lambda s: F.when(s["more"], all_levels(s)).otherwise(s))["blocks"]


def text(content: Column) -> Column:
    """The text of a message's content: a string, an array of blocks, or an object with text.

    Blocks within blocks are followed to any depth. Texts of all levels are joined alike and blank ones left
    out, so that the text is that of the innermost blocks in their order.
    """

    def of(c: Column) -> Column:
        parts = F.transform(_leaves(c), _item)
        joined = F.array_join(F.filter(parts, lambda t: t.isNotNull() & t.rlike(r"\S")), "\n")
        return let(kind(c), lambda k: F.when(k == "STRING", F.try_variant_get(c, "$", "string")).when(k.startswith("ARRAY"), joined).when(k.startswith("OBJECT"), F.coalesce(string(c, "$.text"), F.lit(""))).otherwise(""))

    return let(content, of)
