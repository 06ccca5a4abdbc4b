"""Tokens as text, JSON and double-colon annotation, and the readers of the last two."""

from __future__ import annotations

from json.encoder import encode_basestring as _quoted

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.cascade import Form

CHART = "array<struct<span:string,type:string,`sem-class`:string,surf:string>>"


def joined(tokens: Column) -> Column:
    """Surfaces with a space between (K6)."""
    return F.array_join(F.transform(tokens, lambda t: t["surf"]), " ")


def span(t: Column) -> Column:
    return F.concat_ws("-", t["start"], t["end"])


def annotation(line_id: Column, snt: Column, tokens: Column) -> Column:
    """One JSON object a line; a null class is left out."""
    chart = F.transform(tokens, lambda t: F.struct(span(t).alias("span"), t["type"].alias("type"), t["sem_class"].alias("sem-class"), t["surf"].alias("surf")))
    return F.to_json(F.struct(line_id.alias("ID"), snt.alias("snt"), chart.alias("chart")))


def double_colon(line_id: Column, snt: Column, tokens: Column) -> Column:
    """The header and a row a token, with line feeds between."""
    head = F.concat(F.lit("::line "), line_id, F.lit(" ::s "), snt)
    rows = F.transform(tokens, lambda t: F.concat(F.lit("::span "), span(t), F.lit(" ::type "), t["type"], F.coalesce(F.concat(F.lit(" ::sem-class "), t["sem_class"]), F.lit("")), F.lit(" ::surf "), t["surf"]))
    return F.concat_ws("\n", F.concat(F.array(head), rows))


def from_annotation(json: Column) -> Column:
    """A JSON object as (ID, snt, chart)."""
    return F.from_json(json, f"ID string, snt string, chart {CHART}")


def annotation_to_double_colon(json: Column) -> Column:
    a = from_annotation(json)
    head = F.concat(F.lit("::line "), a["ID"], F.lit(" ::s "), a["snt"])
    rows = F.transform(a["chart"], lambda t: F.concat(F.lit("::span "), t["span"], F.lit(" ::type "), t["type"], F.coalesce(F.concat(F.lit(" ::sem-class "), t["sem-class"]), F.lit("")), F.lit(" ::surf "), t["surf"]))
    return F.concat_ws("\n", F.concat(F.array(head), rows))


#: annotation() and double_colon() in the tokenizer's worker. Normalized lines have no control characters that JSON's writers escape in different ways.
JSON = Form(
    '{"span":"', lambda t: f'","type":{_quoted(t.type)},' + (f'"sem-class":{_quoted(t.sem_class)},' if t.sem_class is not None else "") + f'"surf":{_quoted(t.surf)}}}', ",",
    lambda i, snt, chart: "{" + (f'"ID":{_quoted(i)},' if i is not None else "") + f'"snt":{_quoted(snt)},"chart":[{chart}]}}',
)
DOUBLE_COLON = Form(
    "::span ", lambda t: f" ::type {t.type}" + (f" ::sem-class {t.sem_class}" if t.sem_class is not None else "") + f" ::surf {t.surf}", "\n",
    lambda i, snt, chart: "\n".join([*([f"::line {i} ::s {snt}"] if i is not None else []), *([chart] if chart else [])]),
)


def blocks(lines: DataFrame, *keys: str) -> DataFrame:
    """Lines of double-colon files (text, line_no) with block: the number of the header before them in their file.

    Without keys the whole table is one file, which is ordered by one task."""
    order = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("block", F.sum(F.col("text").startswith("::line").cast("int")).over(order))


def write_tokens(tokens: DataFrame, path: str, *order: str) -> None:
    """One line of joined surfaces a row, in the given order over all files."""
    tokens.repartitionByRange(*order).sortWithinPartitions(*order).select(joined(F.col("tokens")).alias("value")).write.text(path)
