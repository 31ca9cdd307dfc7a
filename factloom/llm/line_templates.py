"""Line dedup by a log-template tree of fixed depth, with DataFrame functions alone.

A line's tokens are read with variable fields masked: a token with a digit is ``<*>``. The tree has
two levels: the number of tokens, then the first ``depth`` tokens; a leaf holds the lines that agree
in both. Within a leaf a token is a constant of its position if lines of at least ``min_docs``
documents have it there, and a variable field otherwise, which is generalised to ``<*>`` as well. A
line's template is its leaf and its constants. Templates of which at least ``similar`` of the tokens
are constant, or which are one masked line with a constant, and that occur in at least ``min_docs``
documents recur, and their lines are dropped, but for those of the document with the least id, so that
of a text with many copies one stays whole. Lines of numbers alone have no constant and stay.

Lines go through as hashes: texts move twice, once for one representative of each masked line that
may recur, once to rebuild the documents. All counts combine before they are shuffled, and all joins
are equi-joins that adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import SPACE, Stash, text_of

DEPTH = 3
MIN_DOCS = 10
SIMILAR = 0.6
_BLANK = " \t\n\x0b\f\r"
_FIELD = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*[0-9][^\x20\x09-\x0D]*"


def masked_tokens(line: Column) -> Column:
    """A line's tokens, those with a digit as <*>; the pattern starts at word starts only, so that
    long words cost no more than their length."""
    trimmed = F.btrim(line, F.lit(_BLANK))
    plain = F.when(trimmed.rlike("[0-9]"), F.regexp_replace(trimmed, _FIELD, "<*>")).otherwise(trimmed)
    return F.split(plain, SPACE)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_key, text): rows that repeat an id are told apart by their texts."""
    text = text_of(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def _lines(rows: DataFrame) -> DataFrame:
    """(doc_id, text_key, pos, leaf, line_key); leaf is null where a line is blank."""
    cut = rows.select("doc_id", "text_key", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    parsed = cut.select("doc_id", "text_key", "pos", masked_tokens(F.col("line")).alias("m"))
    judged = F.element_at("m", 1) != ""
    leaf = F.when(judged, F.xxhash64(F.size("m"), F.slice("m", 1, DEPTH)))
    return parsed.select("doc_id", "text_key", "pos", leaf.alias("leaf"), F.when(judged, F.xxhash64("m", F.lit(1))).alias("line_key"))


def _same(a_id: str, a_key: str, b_id: str, b_key: str) -> Column:
    return F.col(a_id).eqNullSafe(F.col(b_id)) & (F.col(a_key) == F.col(b_key))


def recurring(stash: Stash, rows: DataFrame, lines: DataFrame, min_docs: int, similar: float) -> DataFrame:
    """(leaf, line_key, first_doc) of the masked lines whose template recurs."""
    held = lines.where("leaf IS NOT NULL")
    by_doc = held.groupBy("leaf", "line_key", "doc_id").agg(F.min(F.struct("text_key", "pos")).alias("at"))
    forms = stash.put(
        by_doc.groupBy("leaf", "line_key").agg(F.count("*").alias("docs"), F.min(F.struct("doc_id", "at")).alias("first"))
    )
    # a leaf whose lines have fewer documents in all holds no template of min_docs
    full = forms.groupBy("leaf").agg(F.sum("docs").alias("n")).where(F.col("n") >= min_docs).select("leaf")
    alive = forms.join(full, "leaf").select("leaf", "line_key", "docs", F.col("first.doc_id").alias("doc_id"), F.col("first.at.text_key").alias("text_key"), F.col("first.at.pos").alias("pos"))
    wanted = alive.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("pos", "leaf", "line_key", "docs")).alias("lines"))
    wanted = wanted.select(F.col("doc_id").alias("w_id"), F.col("text_key").alias("w_key"), "lines")
    met = rows.join(wanted, _same("doc_id", "text_key", "w_id", "w_key")).select(F.split("text", "\n", -1).alias("cut"), F.explode("lines").alias("l"))
    tokens = stash.put(
        met.select("l.leaf", "l.line_key", "l.docs", masked_tokens(F.expr("cut[l.pos]")).alias("m")).dropDuplicates(["leaf", "line_key"])
    )
    spelled = tokens.select("leaf", "line_key", "docs", F.size("m").alias("n"), F.posexplode("m").alias("i", "token"))
    often = spelled.where("token != '<*>'").groupBy("leaf", "i", "token").agg(F.sum("docs").alias("s")).where(F.col("s") >= min_docs)
    solid = often.select("leaf", "i", "token", F.lit(True).alias("solid"))
    matched = spelled.join(solid, ["leaf", "i", "token"], "left").select("leaf", "line_key", "docs", "n", F.when(F.col("solid"), F.struct("i", "token")).alias("c"))
    shaped = matched.groupBy("leaf", "line_key").agg(F.first("n").alias("n"), F.first("docs").alias("docs"), F.array_sort(F.collect_list("c")).alias("c"))
    alike = (F.size("c") >= F.col("n") * similar) | ((F.col("docs") >= min_docs) & (F.size("c") > 0))
    likely = stash.put(shaped.where(alike).select("leaf", "line_key", F.xxhash64("leaf", "c").alias("template")))
    of_docs = held.join(likely, ["leaf", "line_key"]).select("template", "doc_id").distinct()
    often = of_docs.groupBy("template").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where(F.col("n") >= min_docs)
    return likely.join(often, "template").select("leaf", "line_key", "first_doc")


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, similar: float = SIMILAR) -> DataFrame:
    """(row, text, n_lines, n_dropped): each row of docs as a struct, and its text without dropped lines.

    Lines are those between newlines; blank lines stay. Null and empty texts have one empty line, so
    a null text becomes empty. Rows without an id count as one document; repeated rows too, and they
    get the same result. Documents that lose all lines stay, with an empty text. Very long texts and
    lines go through whole, at a cost in proportion to their length. Extra columns stay in the row's
    struct, so their names cannot clash. An empty table gives an empty result.
    """
    stash = Stash(docs.sparkSession, "lines")
    rows = _rows(docs, id_col, text_col)
    lines = stash.put(_lines(rows))
    gone = recurring(stash, rows, lines, min_docs, similar)
    told = lines.join(gone, ["leaf", "line_key"]).where(~F.col("doc_id").eqNullSafe(F.col("first_doc"))).select("doc_id", "text_key", "pos")
    hit = told.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("pos")).alias("out"))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_col}`").alias("doc_id"), text_of(f"`{text_col}`").alias("text"))
    keyed = whole.select("row", "doc_id", "text", F.xxhash64("text").alias("text_key"))
    hit = hit.select(F.col("doc_id").alias("h_id"), F.col("text_key").alias("h_key"), "out")
    met = keyed.join(hit, _same("doc_id", "text_key", "h_id", "h_key"), "left").select("row", "text", "out", F.split("text", "\n", -1).alias("cut"))
    # gaps between dropped lines are kept as slices: linear in the lines, however many are dropped
    kept = F.expr(
        "flatten(transform(sequence(0, size(out)), i -> slice(cut, if(i = 0, 1, out[i - 1] + 2), "
        "if(i = size(out), size(cut), out[i]) - if(i = 0, 0, out[i - 1] + 1))))"
    )
    return met.select(
        "row",
        F.when(F.col("out").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.size("cut").cast("long").alias("n_lines"),
        F.coalesce(F.size("out"), F.lit(0)).cast("long").alias("n_dropped"),
    ).withColumn("n_dropped", F.greatest("n_dropped", F.lit(0).cast("long")))


def filter_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with recurring lines removed from the text; all other columns as they are."""
    out = drop_lines(docs, id_col, text_col, **options)
    return out.select(*(F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
