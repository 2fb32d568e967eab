"""Licence scan: canonical digests of whole texts, looked up among the digests of known licences.

Two texts have one canonical form if they differ only in case, punctuation, white space, copyright
lines and equivalent spellings. The digest of the form is joined to the known digests; a text is
recognised as a whole or not at all. The same is done for each line of a text, as a licence notice
is often one line of a document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeledger.llm.common import picked, same
from lakeledger.runtime import checkpoint

#: Equivalent spellings, British and American and by hyphen, in lower case.
EQUIVALENT = [
    ("licence", "license"),
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("authorise", "authorize"),
    ("favour", "favor"),
    ("fulfilment", "fulfillment"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labour", "labor"),
    ("merchantibility", "merchantability"),
    ("non-commercial", "noncommercial"),
    ("non-infringement", "noninfringement"),
    ("organis", "organiz"),
    ("per cent", "percent"),
    ("recognise", "recognize"),
    ("sub-license", "sublicense"),
    ("utilis", "utiliz"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("copyright owner", "copyright holder"),
    ("https://", "http://"),
    ("&", " and "),
]
#: A line that states a copyright: the word, the sign or (c), then a year or an owner; nothing else before.
COPYRIGHT_LINE = r"(^|\n)[^a-z0-9\n]*(copyright *(\(c\)|©|[0-9]{4}|by )|(\(c\)|©) *(copyright)? *[0-9]{4}|all rights reserved)[^\n]*"
NOT_WORD = r"[^\p{L}\p{N}\n]+"


def canonical_lines(text: Column) -> Column:
    """The canonical form with line ends kept: words with one blank between, no blank around lines."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\r\n?", "\n")
    t = reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), EQUIVALENT, t)
    t = F.regexp_replace(t, COPYRIGHT_LINE, "$1")
    t = F.regexp_replace(t, NOT_WORD, " ")
    return F.trim(F.regexp_replace(t, " *\n[ \n]*", "\n"), F.lit(" \n"))


def digest(canonical: Column) -> Column:
    """SHA-256 of a canonical form, lines joined; null for an empty form, which is no licence."""
    joined = F.regexp_replace(canonical, "\n", " ")
    return F.when(joined != "", F.sha2(joined, 256))


def known_digests(known: DataFrame, licence_col: str = "licence_id", text_col: str = "text") -> DataFrame:
    """``digest, licence``; a digest that several licences share is given to the first by name."""
    rows = picked(known, licence=licence_col, text=text_col)
    d = rows.select(digest(canonical_lines(F.col("text"))).alias("digest"), "licence").filter("digest IS NOT NULL AND licence IS NOT NULL")
    return d.groupBy("digest").agg(F.min("licence").alias("licence"))


def scan(texts: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", licence_col: str = "licence_id", known_text_col: str = "text") -> DataFrame:
    """Licence of every row: ``id_col, digest, licence, notices``.

    ``licence`` is the licence whose text the whole text is, ``notices`` the sorted licences of its
    single lines. Null and empty texts have no digest; rows that repeat are scanned each.
    """
    book = checkpoint(known_digests(known, licence_col, known_text_col))
    rows = picked(texts, id=id_col, lines=canonical_lines(texts[text_col]))
    # rows of equal id and text share a key; lines met are counted once for it
    slim = checkpoint(rows.select("id", digest(F.col("lines")).alias("digest"), F.filter(F.split("lines", "\n"), lambda x: x != "").alias("parts")).withColumn(
        "parts", F.array_distinct(F.transform("parts", lambda x: F.sha2(x, 256)))
    ))
    lines = slim.select("id", "digest", F.explode("parts").alias("part"))
    by_part = book.select(F.col("digest").alias("part"), F.col("licence").alias("notice"))
    met = lines.join(by_part, "part").groupBy("id", "digest").agg(F.sort_array(F.collect_set("notice")).alias("notices"))
    met = checkpoint(met.select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), "notices"))
    whole = book.select(F.col("digest").alias("_whole"), "licence")
    out = slim.drop("parts")
    out = out.join(whole, out["digest"] == whole["_whole"], "left")
    out = out.join(met, same(out, met, {"id": "_id", "digest": "_digest"}), "left")
    return out.select(F.col("id").alias(id_col), "digest", "licence", F.coalesce("notices", F.array().cast("array<string>")).alias("notices"))
