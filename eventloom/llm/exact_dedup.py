"""Exact deduplication by deterministic block naming.

Normalised texts are cut into blocks of a fixed number of bytes.  Distinct blocks are sorted and numbered, then adjacent
names are paired and the distinct pairs numbered in turn, until each document has one name.  Equal documents, and no
others, share ``(levels, name)``: names come from comparing contents, never from trusting a digest.

Defined cases: a null text is empty; the empty text is one empty block.  A null ``doc_id`` takes part in its class but never
stays unless the whole class has none.  Rows that repeat an id with an equal text are copies too: one of them stays.
Other columns are not read, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import SPACE, spare
from eventloom.operators.ordered import global_row_number
from eventloom.session import pin

BLOCK_BYTES = 16_384


def normalise(text: Column) -> Column:
    """White-space runs as one blank; single blanks are left alone, which spares most matches."""
    one = rf"[\x09-\x0D][{SPACE}]*|\x20[{SPACE}]+"
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), one, " ")


def exact_classes(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256, levels, name``.

    The texts are shuffled once, to find distinct blocks (combined before the shuffle, so a hot block is one row per task).
    Everything after works on numbers.
    """
    norm = docs.select("doc_id", normalise(F.col("text")).cast("binary").alias("b"))
    count = F.greatest(F.lit(1), F.ceil(F.length("b") / block_bytes)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(F.col("b"), i * block_bytes + 1, F.lit(block_bytes)))
    blocks = norm.select("doc_id", F.sha2("b", 256).alias("sha"), count.alias("n"), F.posexplode(cut).alias("pos", "block"))
    blocks = blocks.withColumn("h", F.xxhash64("block"))

    distinct = blocks.select("h", "block").distinct()
    shared = pin(distinct.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"))
    if shared.isEmpty():  # every hash stands for one content: the narrow rows are enough
        rows = blocks.drop("block").withColumn("rank", F.lit(0))
    else:
        own = distinct.join(shared.select("h"), "h").groupBy("h").agg(F.array_sort(F.collect_set("block")).alias("all"))
        rows = blocks.join(own, "h", "left").withColumn("rank", F.coalesce(F.array_position("all", F.col("block")), F.lit(0)).cast("int")).drop("block", "all")
    # rows of one (doc_id, sha) are repeated rows: they are counted and handled as one document
    rows = pin(rows.groupBy("doc_id", "sha", "n", "pos", "h", "rank").agg(F.count("*").alias("reps")))

    names = global_row_number(rows.select("h", "rank").distinct(), ["h", "rank"], "name")
    level = pin(rows.join(names, ["h", "rank"]).select("doc_id", "sha", "n", "pos", "reps", "name"))
    done, levels = level.where("n = 1").withColumn("levels", F.lit(0)), 0
    while True:
        open_ = level.where("n > 1")
        if open_.isEmpty():
            break
        levels += 1
        side = lambda k: F.max(F.when(F.pmod("pos", F.lit(2)) == k, F.col("name")))
        half = F.floor(F.col("pos") / 2).cast("int").alias("pos")
        pairs = open_.groupBy("doc_id", "sha", F.ceil(F.col("n") / 2).cast("int").alias("n"), half, "reps").agg(side(0).alias("l"), F.coalesce(side(1), F.lit(0)).alias("r"))
        pairs = pin(pairs)
        names = global_row_number(pairs.select("l", "r").distinct(), ["l", "r"], "name")
        level = pin(pairs.join(names, ["l", "r"]).select("doc_id", "sha", "n", "pos", "reps", "name"))
        done = done.unionByName(level.where("n = 1").withColumn("levels", F.lit(levels)))

    classes = done.groupBy("levels", "name").agg(F.min("doc_id").alias("keep_id"), F.sum("reps").alias("group_size"))
    rows = done.join(classes, ["levels", "name"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("reps"))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"), "levels", "name")


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class of equal texts, all columns as they are.

    Rows that repeat an id are told apart by their text; of rows that share both, the one that is smallest written as JSON stays.
    """
    sha, no, owner, own = spare(docs, "sha", "no", "owner", "own")
    kept = exact_classes(docs).where("kept").select(F.col("doc_id").alias(owner), F.col("text_sha256").alias(own)).distinct()
    tagged = docs.withColumn(sha, F.sha2(normalise(F.col("text")).cast("binary"), 256))
    out = tagged.join(kept, F.col("doc_id").eqNullSafe(F.col(owner)) & (F.col(sha) == F.col(own)), "left_semi")
    twice = out.groupBy("doc_id", sha).agg(F.count("*").alias(no)).where(F.col(no) > 1)
    if not twice.isEmpty():
        row = F.struct(*docs.columns)
        out = out.groupBy("doc_id", sha).agg(F.min_by(row, F.to_json(row)).alias(no)).select(f"{no}.*")
    return out.select(*docs.columns)
