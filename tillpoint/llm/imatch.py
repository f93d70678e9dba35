"""I-Match document fingerprints, by DataFrame functions only.

A corpus pass counts in how many distinct texts each term occurs, so that copies of one
text, however many, count once. The lexicon is the terms of a band of inverse document
frequency: neither too common nor too rare. A document's
kept terms, distinct and sorted, are hashed once for each of several randomised subsets
of the lexicon; subset ``s`` holds a term if a hash of (term, s) falls below the
subset's share. Shares go down in powers of four, so that texts that differ in many
terms still agree in the signatures of some thin subsets. The fingerprint is the list
of signatures; likeness of two is the share of equal ones among the subsets in which
either text has a term.

The lexicon's size is bounded whatever the number N of distinct texts: a kept term
occurs in at least ``min_share * N`` of them, so there are at most (mean distinct terms
per text) / ``min_share`` kept terms. It is broadcast on that bound.

Edge cases: null text is the empty text; a text without kept terms is signed by the
hash of all its terms in every subset (texts without any term are alike); the next
document of the smallest doc_id is the largest; a null doc_id comes after all others;
rows that repeat a doc_id share one place in the order, where the greatest of their
texts (by hash) is the neighbour of others; a table of one document is its own
neighbour; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillpoint.llm.common import id_text, staged
from tillpoint.operators.rank import global_row_number

# Subsets of the lexicon: (share of its terms, number of subsets with that share).
SUBSETS = ((1.0, 1), (1 / 4, 4), (1 / 16, 12), (1 / 64, 12), (1 / 256, 12), (1 / 1024, 12))
NULL_PLACE = -(1 << 63)  # a null doc_id comes after all others


def term_hashes(text: Column) -> Column:
    """Distinct 64-bit hashes of the lower-case words of a text."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, min_share: float, max_share: float) -> DataFrame:
    """Columns ``term``, hashes of the terms whose frequency over the distinct texts is in the
    band, and ``mask``, a bit for each subset that holds the term. A hot text is reduced to
    one row in each map task before it is moved."""
    total = docs.select(F.unhex(F.sha2("text", 256)).alias("digest")).distinct().count()
    counts = (docs.select("text").distinct().select(F.explode(term_hashes(F.col("text"))).alias("term"))
              .groupBy("term").agg(F.count(F.lit(1)).alias("n")))
    band = (F.col("n") >= min_share * total) & (F.col("n") <= max(1.0, max_share * total))
    bits = [F.when(_holds(F.col("term"), number, share), 1 << number).otherwise(0) for number, share in _subsets()]
    return counts.filter(band).select("term", sum(bits).cast("long").alias("mask"))


def _subsets() -> list[tuple[int, float]]:
    return list(enumerate(share for share, count in SUBSETS for _ in range(count)))


def _holds(term: Column, number: int, share: float) -> Column:
    """Whether a subset of a share of the lexicon holds a term."""
    return F.pmod(F.xxhash64(term, F.lit(number)), F.lit(1 << 20)) < int(share * (1 << 20))


def _short(h: Column) -> Column:
    return F.shiftrightunsigned(h, 32).cast("long")


def _in_subsets(kept: Column, numbers: list[int]) -> Column:
    """Those of the kept terms (structs of term and mask) that any of the subsets holds."""
    bits = F.lit(sum(1 << n for n in numbers)).cast("long")
    return F.filter(kept, lambda x: x["mask"].bitwiseAND(bits) != 0)


def with_signatures(df: DataFrame, kept: str, everything: str, out: str) -> DataFrame:
    """Add ``out``: 32-bit signatures of the sorted ``kept`` terms, one a subset; 0 marks a
    subset without a term. A text without kept terms is signed by ``everything``. The terms
    of all subsets of one share are picked first: thin subsets are then cut from few terms."""
    shares: dict[float, list[int]] = {}
    for number, share in _subsets():
        shares.setdefault(share, []).append(number)
    tiers = {share: f"_{out}{at}" for at, share in enumerate(shares)}
    picked = df.withColumns({tiers[share]: _in_subsets(F.col(kept), numbers) for share, numbers in shares.items()})

    def sign(number: int, share: float) -> Column:
        own = _in_subsets(F.col(tiers[share]), [number])
        return F.when(F.size(own) > 0, _short(F.xxhash64(own, F.lit(number)))).otherwise(F.lit(0))

    whole = F.array_repeat(_short(F.xxhash64(everything, F.lit(-1))), len(_subsets()))
    signed = F.when(F.size(kept) > 0, F.array(*[sign(*s) for s in _subsets()])).otherwise(whole)
    return picked.withColumn(out, signed).drop(*tiers.values())


def likeness(a: Column, b: Column) -> Column:
    """Share of equal signatures among the subsets in which either has a term, 0 to 1."""
    pairs = F.zip_with(a, b, lambda x, y: F.when((x == 0) & (y == 0), None).when(x == y, 1.0).otherwise(0.0))
    seen = F.filter(pairs, lambda p: p.isNotNull())
    total = F.aggregate(seen, F.lit(0.0), lambda s, p: s + p)
    return F.when(F.size(seen) > 0, total / F.size(seen)).otherwise(F.lit(1.0))


def as_text(signed: Column) -> Column:
    return F.array_join(F.transform(signed, lambda s: F.lower(F.lpad(F.hex(s), 8, "0"))), "-")


def neighbours(places: DataFrame) -> DataFrame:
    """``places``: distinct ``place`` (long). Adds ``next_place``, the next in descending order
    (after the last: the first). Places are numbered in range partitions, however sparse
    they are, and each is joined with the one numbered after it."""
    numbered = global_row_number(places.select("place"), [F.col("place").desc()], "number", total_out="total")
    before = F.when(F.col("number") == 1, F.col("total")).otherwise(F.col("number") - 1)
    nexts = numbered.select(F.col("place").alias("next_place"), before.alias("number"))
    return numbered.join(nexts, "number").select("place", "next_place")


def with_next_head(docs: DataFrame, links: DataFrame) -> DataFrame:
    """``docs`` (place, text) with ``head``: the beginning of the next document's text, up to a
    third of the longest text at the place. Only these beginnings are moved besides the
    one exchange of the texts by place. ``links``: place, next_place, chars."""
    wants = links.select(F.col("next_place").alias("place"), F.col("place").alias("taker"), "chars")
    heads = (docs.join(wants, "place")
             .select("taker", F.expr("left(text, cast(chars div 3 AS int))").alias("head"),
                     F.xxhash64("text").alias("h"))
             .groupBy("taker").agg(F.max_by("head", "h").alias("head")))
    return docs.join(heads.withColumnRenamed("taker", "place"), "place", "left")


def fingerprints(df: DataFrame, min_share: float = 0.003, max_share: float = 0.2, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next
    for each document and its edited text: the last third of its characters replaced by
    as many of the beginning of the next document (descending doc_id)."""
    docs = id_text(df, id_col, text_col).select(F.coalesce("doc_id", F.lit(NULL_PLACE)).alias("place"), "text")
    places = docs.groupBy("place").agg(F.max(F.char_length("text")).alias("chars"))
    links = staged(neighbours(places.select("place")).join(places, "place"), "neighbours")
    chosen = staged(lexicon(docs, min_share, max_share), "lexicon")

    cut = F.expr("cast(char_length(text) div 3 AS int)")
    edited = F.concat(F.expr("left(text, char_length(text) - cast(char_length(text) div 3 AS int))"),
                      F.left(F.coalesce("head", F.lit("")), cut))
    rows = (with_next_head(docs, links)
            .select("place", F.monotonically_increasing_id().alias("row"), F.xxhash64("text").alias("h"),
                    F.char_length("text").cast("long").alias("n_chars"), "text", edited.alias("edited"))
            .select("place", "row", "h", "n_chars", F.unhex(F.sha2("edited", 256)).alias("sha"),
                    term_hashes(F.col("text")).alias("own"), term_hashes(F.col("edited")).alias("new")))
    everything = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, t: x.bitwiseXOR(F.xxhash64(t)))
    tagged = lambda a, v: F.transform(a, lambda t: F.struct(F.lit(v).alias("v"), t.alias("term")))
    marker = F.array(F.struct(F.lit(2).alias("v"), F.lit(0).cast("long").alias("term")))  # a row for every document
    # The hashes of whole texts first, then one row a term: in one step they would be made again for every term.
    whole = rows.select("place", "row", "h", "n_chars", "sha", everything(F.col("own")).alias("own_all"),
                        everything(F.col("new")).alias("new_all"),
                        F.concat(marker, tagged(F.col("own"), 0), tagged(F.col("new"), 1)).alias("tagged"))
    keys = ["place", "row", "h", "n_chars", "sha", "own_all", "new_all"]
    terms = whole.select(*keys, F.inline("tagged")).join(F.broadcast(chosen), "term", "left").filter("mask IS NOT NULL OR v = 2")
    # The rows of a document come from one partition: its place is already the partitioning.
    listed = lambda v: F.sort_array(F.collect_list(F.when(F.col("v") == v, F.struct("term", "mask"))))
    collected = terms.groupBy(*keys).agg(listed(0).alias("own"), listed(1).alias("new"))
    both = with_signatures(with_signatures(collected, "own", "own_all", "signed"), "new", "new_all", "edited_signed")
    signed = staged(both.select("place", "h", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"),
                                "signed", "edited_signed"), "signatures")
    shown = signed.groupBy("place").agg(F.max_by("signed", "h").alias("next_signed"))
    nexts = (links.select("place", "next_place")
             .join(shown.withColumnRenamed("place", "next_place"), "next_place").drop("next_place"))
    return signed.join(nexts, "place").select(
        F.when(F.col("place") != NULL_PLACE, F.col("place")).alias("doc_id"), "n_chars", "edited_sha256",
        as_text(F.col("signed")).alias("fingerprint"), as_text(F.col("edited_signed")).alias("edited_fingerprint"),
        likeness(F.col("signed"), F.col("edited_signed")).alias("near_edited"),
        likeness(F.col("signed"), F.col("next_signed")).alias("near_next"))
