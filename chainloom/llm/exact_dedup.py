"""Exact dedup by content-defined chunk recipes. DataFrame functions only.

Each text is cut into chunks at places that its own content defines; a chunk becomes a 128-bit
identifier; a text becomes its recipe, the ordered list of identifiers. Texts are equal when their
recipes are. One pass over the texts writes recipes and the SHA-256 of each chunk to a table in the shared folder (some 50
bytes a chunk); all else works on that. Identifiers are *verified*: one aggregate over all chunks holds every identifier
against the SHA-256 of the chunks that bear it, and a clash makes the operator change the identifiers' salt.
Only digests and recipes are shuffled: no text is ever moved.

Hot groups: recipes are counted map-side first, and the join that hands the group back to its rows is
plain sort-merge with one row per group on one side, which adaptive execution splits when skewed.

Defined results: a null text counts as empty; empty texts are equal; a null id is smaller than any id;
of rows that repeat both id and text, one stays (they are one row each in the result): where whole rows are kept, the one
whose other columns have the smallest hash. Very long texts are many chunks; ties are broken by nothing but the id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, join_back, store

#: Chunk sizes in characters, and the content that ends a chunk: a consonant, white space, an early letter; in scripts
#: without these, punctuation or white space behind a letter that isn't ASCII.
LEAST, MOST, CUT = 768, 4096, r"(?:[bcdfgkmp][.,!?]*\s(?=[a-e])|[^\x00-\x7F][\p{P}\s])"


def chunks(text: Column, least: int = LEAST, most: int = MOST, cut: str = CUT) -> Column:
    """Pieces that concatenate to the text; where one ends depends on what is near, not on the offset."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{{least},{most - 1}}}?{cut}|.{{1,{most}}}"), F.lit(0))


def _identifier(chunk: Column, salt: str) -> Column:
    return F.array(F.xxhash64(chunk), F.xxhash64(F.lit(f"~{salt}"), chunk))


def digests(df: DataFrame, id_col: str, text_col: str, salt: str, lowercase: bool = True) -> DataFrame:
    """id, chars, recipe, chunk_sha256 (of each chunk), text_sha256, one row per input row; narrow, nothing is shuffled."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    norm = df.select(F.col(id_col).alias("id"), (ascii_lower(text) if lowercase else text).alias("norm"))
    cut = F.transform(chunks(F.col("norm")), lambda c: F.struct(_identifier(c, salt).alias("i"), F.unhex(F.sha2(c, 256)).alias("d")))
    return norm.select("id", F.char_length("norm").alias("chars"), cut.alias("cut"), F.sha2("norm", 256).alias("text_sha256")).select(
        "id", "chars", F.flatten("cut.i").alias("recipe"), F.col("cut.d").alias("chunk_sha256"), "text_sha256"
    )


def clashes(rows: DataFrame) -> DataFrame:
    """Identifiers that stand for two different chunks, of rows of `digests`."""
    c = rows.select("recipe", F.posexplode("chunk_sha256").alias("at", "d"))
    c = c.select(F.col("recipe")[2 * F.col("at")].alias("a"), F.col("recipe")[2 * F.col("at") + 1].alias("b"), "d")
    return c.groupBy("a", "b").agg(F.min("d").alias("first"), F.max("d").alias("last")).where("first <> last")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lowercase: bool = True) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    for salt in "0123":
        rows = store(digests(df, id_col, text_col, salt, lowercase))
        if clashes(rows).isEmpty():
            break
    else:
        raise RuntimeError("chunk identifiers clash under every salt")
    rows = rows.groupBy("id", "chars", "recipe", "text_sha256").agg(F.count(F.lit(1)).alias("n"))
    groups = rows.groupBy("chars", "recipe").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"))
    out = join_back(rows, groups, ["chars", "recipe"]).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    return out.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("i") == 1)).alias("kept"),
        "text_sha256",
    )


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that stay, with all their columns; moves each text once, by id and digest."""

    def key(id_: Column, sha: Column) -> Column:
        return F.concat(F.coalesce(F.concat(F.lit("="), id_.cast("string")), F.lit("")), F.lit(":"), sha).alias("k")

    kept = exact_dedup(df, id_col, text_col).where("kept").select(key(F.col(id_col), F.col("text_sha256")))
    others = [F.col(f"`{c}`") for c in df.columns if c not in (id_col, text_col)]
    rows = df.select(
        key(F.col(id_col), F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256)),
        F.xxhash64(F.to_json(F.struct(*others)) if others else F.lit(0), F.col(text_col)).alias("h"),
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("whole"),
    )
    rows = rows.groupBy("k").agg(F.min_by("whole", "h").alias("whole"))  # rows that repeat id and text
    return rows.join(kept, "k", "left_semi").select("whole.*")


SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
