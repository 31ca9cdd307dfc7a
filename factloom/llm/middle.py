"""Fill-in-the-middle transformation in Spark SQL.

A pattern cuts a text into an array of units; numbers from the hash of the document's id choose two
cuts, the order of the parts and whether the text is changed at all; slices of the array, joined, are prefix,
middle and suffix, which sentinels mark. As a text with a sentinel in it stays plain, and as a sentinel
overlaps no other, the sentinels of an output are exactly those that were put there: cutting at them restores
the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import text_of

#: Patterns of units; each matches every text without a gap.
UNITS = {
    "characters": r"(?s).",
    "words": r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+",
    "lines": r"[^\n]*\n|[^\n]+",
}
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def _number(digest: Column, i: int) -> Column:
    """The i-th group of eight hex digits as a number."""
    return F.conv(F.substring(digest, 8 * i - 7, 8), 16, 10).cast("long")


def _joined(units: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(units, start, length), "")


def restore(output: Column, form: Column) -> Column:
    """The text of an output of the given form."""
    part = F.split(output, "<[PSM]>", -1)  # what is before the first sentinel is empty
    prefix, suffix = F.when(form == "psm", part[1]).otherwise(part[2]), F.when(form == "psm", part[2]).otherwise(part[1])
    return F.when(form == "plain", output).otherwise(F.concat(prefix, part[3], suffix))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "characters", percent: int = 90, spm_percent: int = 20, seed: int = 1) -> DataFrame:
    """The columns of docs as a struct ``row``, with n (units), form, prefix_units, middle_units and output.

    Forms: ``psm`` (prefix, suffix, middle), ``spm`` (suffix, prefix, middle), and ``plain`` where the text is empty
    or contains a sentinel, or for the rest of ``percent``. unit is characters (code points), words or lines.
    Null texts count as empty; a null id counts as an empty one, so rows without an id and with equal texts are
    treated alike, as are all repeated rows. Texts of any length are cut whole: a row's units are in memory at once.
    Further columns only pass through in ``row``, whatever their names. An empty table gives an empty result.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256)
    text = text_of(f"`{text_col}`")
    told = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), text.alias("text"), *(_number(digest, i).alias(f"h{i}") for i in (1, 2, 3, 4)))
    marked = F.lit(False)
    for s in (PREFIX, SUFFIX, MIDDLE):
        marked |= F.contains("text", F.lit(s))
    form = F.when((F.col("text") == "") | marked | (F.col("h3") % 100 >= percent), "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    cut = told.select("row", "text", "h1", "h2", form.alias("form"), F.regexp_extract_all("text", F.lit(UNITS[unit]), F.lit(0)).alias("units"))
    n = F.size("units").cast("long")
    low, high = F.least(F.col("h1") % (n + 1), F.col("h2") % (n + 1)), F.greatest(F.col("h1") % (n + 1), F.col("h2") % (n + 1))
    placed = cut.select("row", "text", "form", "units", n.alias("n"), low.cast("int").alias("low"), high.cast("int").alias("high"))
    prefix = _joined(F.col("units"), F.lit(1), F.col("low"))
    middle = _joined(F.col("units"), F.col("low") + 1, F.col("high") - F.col("low"))
    suffix = _joined(F.col("units"), F.col("high") + 1, F.size("units") - F.col("high"))
    output = (
        F.when(F.col("form") == "plain", F.col("text"))
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    changed = F.col("form") != "plain"
    return placed.select(
        "row", "n", "form",
        F.when(changed, F.col("low").cast("long")).alias("prefix_units"),
        F.when(changed, (F.col("high") - F.col("low")).cast("long")).alias("middle_units"),
        output.alias("output"),
    )
