"""Tagged JSON lines: rows of several kinds in one text file, told apart by a field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TAG = "_t"


def whole_json(text: Column) -> Column:
    """The text where it is one JSON value to its end, else null.

    The parser of variants stops after a first value. Inside an array and inside an object whatever
    follows the value breaks one of the two.
    """
    listed, named = F.concat(F.lit("["), text, F.lit("]")), F.concat(F.lit('{"a":'), text, F.lit("}"))
    return F.when(F.try_parse_json(listed).isNotNull() & F.try_parse_json(named).isNotNull(), text)


def write_lines(parts: dict[str, DataFrame]) -> DataFrame:
    """One column value of JSON lines, with ord and tag: the parts in the given order."""
    out = None
    for n, (tag, df) in enumerate(parts.items()):
        row = df.select(F.lit(n).alias("ord"), F.lit(tag).alias("tag"), F.to_json(F.struct(F.lit(tag).alias(TAG), *df.columns), {"ignoreNullFields": "false"}).alias("value"))
        out = row if out is None else out.unionByName(row)
    return out


def read_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """value with tag: null for blank, broken and untagged lines."""
    return lines.withColumn("tag", F.when(whole_json(F.col(value)).isNotNull(), F.get_json_object(value, f"$.{TAG}")))


def rows_of(tagged: DataFrame, tag: str, schema: str, value: str = "value") -> DataFrame:
    return tagged.filter(F.col("tag") == tag).select(F.from_json(value, schema).alias("r")).select("r.*")


def skipped(tagged: DataFrame, value: str = "value") -> DataFrame:
    """How many lines that aren't blank have no tag."""
    return tagged.agg(F.count_if((F.trim(value) != "") & F.col("tag").isNull()).alias("skipped"))


def first_json(text: Column, most: int = 200) -> Column:
    """The JSON object or array that noisy text ends with: the longest that is one, trying `most` opening brackets at most."""
    gaps = F.split(text, r"[{\[]", -1)
    starts = F.transform(F.slice(F.sequence(F.lit(1), F.greatest(F.size(gaps) - 1, F.lit(1))), 1, most), lambda n: F.length(F.array_join(F.slice(gaps, 1, n), " ")) + 1)
    tried = F.transform(starts, lambda i: whole_json(F.substring(text, i, F.length(text))))
    return F.get(F.filter(tried, lambda t: t.isNotNull()), F.lit(0))


def line_contract(text: Column, field: str = "summary") -> Column:
    """The single line of JSON that a stage must print: text of exactly one line that isn't blank, an object whose field is an object; else null."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda s: F.trim(s) != "")
    one = whole_json(F.trim(F.get(lines, F.lit(0))))
    return F.when((F.size(lines) == 1) & F.startswith(F.schema_of_variant(F.try_variant_get(F.try_parse_json(one), f"$.{field}", "variant")), F.lit("OBJECT")), one)
