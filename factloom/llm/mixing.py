"""Mixing sources to target weights, by temperature, with DataFrame functions alone.

A source's natural share p is its share of all words; its weight is p**alpha, normalised. Alpha 1 is
the corpus as it is, alpha 0 gives every source the same. Alpha is bisected for the flattest mixture
that stays within both targets: entropy at most ``entropy`` of the largest possible, and at most
``repeats`` passes over any source. The budget is the least at which every source is read once in
full (passes = weight / share, scaled so that the least repeated source has one pass), so that
mixing repeats small sources and drops nothing.

Weights are realised in blocks: a source's documents are dealt by hash to ``blocks`` blocks; each
pass orders the blocks anew by hash, and the last, partial pass takes blocks in that order until the
budget in words is met. Each block's place in [0, 1) of its source's sequence is its place in the
mixture, so every stretch of the output holds the target weights.

Only sources' word counts, two numbers a source, enter the bisection, which is one SQL expression;
block plans hold ``blocks`` rows a source and pass. Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import SPACE, Stash, text_of

BLOCKS = 256
STEPS = 40
REPEATS = 1.5
ENTROPY = 0.98


def word_count(text: Column) -> Column:
    """Words of a text: runs without white space."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, SPACE))).cast("long")


def spread(name: str, *parts: Column) -> Column:
    """A number in [0, 2**32) from an md5 of parts, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(name), *parts)), 1, 8), 16, 10).cast("long")


def weights(words: DataFrame, repeats: float = REPEATS, entropy: float = ENTROPY, steps: int = STEPS) -> DataFrame:
    """(source, words, share, alpha, weight, passes) from (source, words), one row a source.

    Sources without words have no share: weight 0 and one pass. The bisection runs on the array of
    shares in one row; arrays hold one number for each source.
    """
    named = words.where("words > 0").groupBy().agg(F.sort_array(F.collect_list(F.struct("source", "words"))).alias("s"))
    total = "aggregate(s, 0D, (a, x) -> a + x.words)"
    shares = named.select("s", F.expr(f"transform(s, x -> x.words / {total})").alias("p"))
    m = "((b.low + b.high) / 2)"
    norm = "aggregate(p, 0D, (a, x) -> a + pow(x, {m}))"
    # entropy of q = p**m / z is ln z - m * sum(q ln p)
    bits = f"(ln({norm.format(m=m)}) - {m} * aggregate(p, 0D, (a, x) -> a + pow(x, {m}) * ln(x)) / {norm.format(m=m)})"
    # passes are p**(m - 1), scaled by the largest share's: the most repeated source has the least share
    fits = f"(pow(array_min(p) / array_max(p), {m} - 1) <= {float(repeats)!r}D AND {bits} <= {float(entropy)!r}D * ln(size(p)))"
    bisected = (
        f"aggregate(sequence(1, {steps}), named_struct('low', 0D, 'high', 1D), "
        f"(b, i) -> if({fits}, named_struct('low', b.low, 'high', {m}), named_struct('low', {m}, 'high', b.high)))"
    )
    # high always fits, or is 1: the corpus as it is
    flat = shares.select("s", "p", F.expr(f"{bisected}.high").alias("alpha")).select("s", "p", "alpha", F.expr(norm.format(m="alpha")).alias("z"))
    each = flat.select("alpha", "z", F.expr("array_max(p)").alias("top"), F.explode(F.arrays_zip("s", "p")).alias("e"))
    found = each.select(
        F.col("e.s.source").alias("source"),
        F.col("e.s.words").alias("words"),
        F.col("e.p").alias("share"),
        "alpha",
        (F.pow("e.p", "alpha") / F.col("z")).alias("weight"),
        F.round(F.pow(F.col("e.p") / F.col("top"), F.col("alpha") - 1), 6).alias("passes"),
    )
    none = words.where("words = 0").select("source", "words", F.lit(0.0).alias("share"), F.lit(1.0).alias("alpha"), F.lit(0.0).alias("weight"), F.lit(1.0).alias("passes"))
    return found.unionByName(none)


def plan(blocks: DataFrame, mix: DataFrame, seed: str = "mix") -> DataFrame:
    """(source, block, copy, place, width, weight, passes): each pass over each block that the budget pays for.

    A block lies around its place and is as wide as any other of its source.

    blocks: (source, block, words). Passes before the last are whole; the last, of share f of the
    source's words, takes blocks in hash order while those before it hold fewer than f of them.
    """
    of = mix.select(F.col("source").alias("of_source"), "weight", "passes", F.col("words").alias("of"))
    paid = blocks.join(of, F.col("source").eqNullSafe(F.col("of_source")))
    passes = paid.select("source", "block", "words", "of", "weight", "passes", F.explode(F.expr("sequence(1, cast(ceil(passes) as int))")).alias("copy"))
    name = F.coalesce(F.col("source"), F.lit("\x00"))
    ordered = passes.withColumn("h", spread(seed, name, F.col("copy").cast("string"), F.col("block").cast("string")))
    within = Window.partitionBy("source", "copy").orderBy("h", "block").rowsBetween(Window.unboundedPreceding, -1)
    taken = ordered.withColumn("before", F.coalesce(F.sum("words").over(within), F.lit(0)))
    kept = taken.where((F.col("copy") <= F.floor("passes")) | (F.col("before") < (F.col("passes") - F.floor("passes")) * F.col("of")))
    order = Window.partitionBy("source").orderBy("copy", "h", "block")
    many = F.count("*").over(Window.partitionBy("source"))
    return kept.select("source", "block", "copy", ((F.row_number().over(order) - 0.5) / many).alias("place"), (1 / many).alias("width"), "weight", "passes")


def _parts(docs: DataFrame, id_col: str, text_col: str, source_col: str, blocks: int):
    source = F.col(f"`{source_col}`").cast("string")
    block = F.pmod(spread("block", F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), F.lit(blocks)).cast("int")
    return source, block, word_count(text_of(f"`{text_col}`"))


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", repeats: float = REPEATS, entropy: float = ENTROPY, blocks: int = BLOCKS) -> tuple[DataFrame, DataFrame]:
    """(weights by source, plan by block) of a corpus; see the module's text."""
    source, block, words = _parts(docs, id_col, text_col, source_col, blocks)
    sized = docs.select(source.alias("source"), block.alias("block"), words.alias("words"))
    stash = Stash(docs.sparkSession, "mixing")
    by_block = stash.put(sized.groupBy("source", "block").agg(F.sum("words").alias("words")))
    mix = stash.put(weights(by_block.groupBy("source").agg(F.sum("words").alias("words")), repeats, entropy))
    return mix, stash.put(plan(by_block, mix))


def mix_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """One row for each document and pass: doc_id, source, copy, block, place, weight and passes.

    Every document occurs at least once. Null texts have no words and null sources are a source;
    null ids share a block; repeated rows are repeated as often as single ones; an empty table gives
    an empty result. The block of a hot source holds 1/256 of it, so the join is not skewed.
    """
    blocks = options.get("blocks", BLOCKS)
    _, chosen = mixture(docs, id_col, text_col, source_col, **options)
    source, block, _ = _parts(docs, id_col, text_col, source_col, blocks)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), source.alias("source"), block.alias("block"))
    told = chosen.select(F.col("source").alias("of_source"), F.col("block").alias("of_block"), "copy", "place", "weight", "passes")
    met = rows.join(told, (F.col("block") == F.col("of_block")) & F.col("source").eqNullSafe(F.col("of_source")))
    return met.select("doc_id", "source", "copy", "block", "place", "weight", "passes")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", parts: int | None = None, **options) -> DataFrame:
    """The mixed corpus, with the columns of docs, dealt to partitions and sorted in mixture order.

    Documents of a block are spread over its width by a hash of id and text, so that a source that
    holds most of the corpus fills as many partitions as its share asks for. Nulls, repeated rows and
    empty tables are as in ``mix_ids``; columns keep their names, also where they are ours; long texts
    are moved whole.
    """
    blocks = options.get("blocks", BLOCKS)
    _, chosen = mixture(docs, id_col, text_col, source_col, **options)
    source, block, _ = _parts(docs, id_col, text_col, source_col, blocks)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), source.alias("mix_source"), block.alias("mix_block"))
    met = rows.join(chosen, (F.col("block") == F.col("mix_block")) & F.col("source").eqNullSafe(F.col("mix_source")))
    n = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    within = F.pmod(F.xxhash64(F.col(f"row.`{id_col}`"), F.col(f"row.`{text_col}`"), F.col("copy")), F.lit(1 << 20)) / F.lit(float(1 << 20)) - 0.5
    spot = met.select("row", "copy", (F.col("place") + within * F.col("width")).alias("spot"))
    dealt = spot.repartitionById(n, F.greatest(F.lit(0), F.least(F.floor(F.col("spot") * n), F.lit(n - 1))).cast("int"))
    return dealt.sortWithinPartitions("spot", "copy").select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
