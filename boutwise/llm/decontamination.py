"""Benchmark decontamination by SimHash windows, multi-index Hamming blocks and exact weighted-shingle similarity; DataFrame functions only.

A text contains an item if it holds at least `threshold` of the item's 5-word shingles, weighted by how often the item has them, wherever they stand: whole, edited,
interrupted or rearranged. An item of under five words has one shingle, its whole sequence, and so has such a text: they meet only as equals.

Windows are as long as the item can be relied on to survive: one shingle, at every place of the text and of the item (a window of the whole item's length
has no useful radius at this threshold, see the README). A window's SimHash is the bitwise majority of its word hashes. Fingerprints
within `radius` = 3 bits agree in one of four 16-bit blocks; pairs that share a block are kept if their distance is within the radius. A shingle that text and item
share has distance 0, so every one of them is found, and a text is a candidate for an item only if at least `threshold` of the item's places
were met. Candidates are then verified on the shingles themselves.

Defined results: null and empty texts, and null or empty items, match nothing; repeated rows of texts are one row of the result; an item id with several texts matches
by the most similar; an empty table gives an empty result; extra columns are ignored; a null document id stays null in the result.

Scale: texts are read twice without a shuffle; only met windows leave the first pass, counted per text, item and place before they are shuffled. A long text is cut
into overlapping parts before its windows are listed, so no row holds all of them. The item index is broadcast only if its counted rows are
few, else it joins by shuffle; so do the candidates on their way back to the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sqltext import SHINGLE, row_key, scratch, shingles, small, word_hashes, words

THRESHOLD = 0.8
RADIUS = 3
BLOCKS = 4
PART = 2_048  # windows a part of a text


def _adder(df: DataFrame, planes: list[str], tag: str) -> tuple[DataFrame, list[str], list[str]]:
    """Full adders over columns of bits: triples become a sum and a carry of twice the weight."""
    add, sums, carries, rest = {}, [], [], planes
    while len(rest) >= 3:
        a, b, c, rest = *(F.col(x) for x in rest[:3]), rest[3:]
        s, r = f"s{tag}_{len(sums)}", f"c{tag}_{len(sums)}"
        half = a.bitwiseXOR(b)
        add[s] = half.bitwiseXOR(c)
        add[r] = a.bitwiseAND(b).bitwiseOR(c.bitwiseAND(half))
        sums.append(s)
        carries.append(r)
    return df.withColumns(add), sums + rest, carries


def simhash(df: DataFrame, planes: list[str], name: str = "fp") -> DataFrame:
    """The bitwise majority of an odd number of hash columns, by carry-save addition of whole 64-bit words."""
    if len(planes) % 2 == 0:
        raise ValueError("an even number of hashes has no majority on a tie")
    keep = [c for c in df.columns if c not in planes]
    half = len(planes) // 2
    level, bits, step = list(planes), [], 0
    # coalesced, as the optimiser would else test the whole majority for null below the join
    df = df.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in planes})
    while level:
        above = []
        while len(level) > 1:
            if len(level) == 2:
                a, b = (F.col(x) for x in level)
                df = df.withColumns({f"s{step}": a.bitwiseXOR(b), f"c{step}": a.bitwiseAND(b)})
                level, carries = [f"s{step}"], [f"c{step}"]
            else:
                df, level, carries = _adder(df, level, str(step))
            above += carries
            step += 1
        bits.append(level[0])
        level = above
    # the number of set bits, lowest place first, is above half
    more = F.lit(0).cast("long")
    for i, c in enumerate(bits):
        more = F.col(c).bitwiseAND(more) if half >> i & 1 else F.col(c).bitwiseOR(more)
    return df.select(*keep, more.alias(name))


def _banded(df: DataFrame) -> DataFrame:
    """A row for each 16-bit block of the fingerprint; key holds its place and value."""
    return df.withColumn("block", F.explode(F.array(*(
        F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF).cast("long")) + F.lit(i << 16).cast("long") for i in range(BLOCKS)))))


def _fingerprints(df: DataFrame, hashes: str, k: int = SHINGLE) -> DataFrame:
    """One row per k-word window, with its first word's place `at` from 1 and its SimHash `fp`. A shorter list is one window, of its whole sequence."""
    n = F.size(hashes)
    rest = [c for c in df.columns if c != hashes]
    none = F.expr("cast(array() as array<int>)")
    parts = F.transform(F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - k, F.lit(0)), F.lit(PART))).otherwise(none),
                        lambda i: F.struct(i.alias("base"), F.slice(F.col(hashes), i + 1, PART + k - 1).alias("p")))
    df = df.select(*rest, F.explode(parts).alias("x")).select(*rest, F.col("x.base").alias("base"), F.col("x.p").alias("p"))
    size = F.size("p")
    planes = [f"p{j}" for j in range(k)]
    each = F.when(size >= k, F.transform(F.sequence(F.lit(0), size - k), lambda i: F.struct(i.alias("i"), *(F.get("p", i + j).alias(c) for j, c in enumerate(planes)))))
    each = each.otherwise(F.array(F.struct(F.lit(0).alias("i"), *(F.xxhash64("p").alias(c) for c in planes))))
    df = df.select(*rest, "base", F.explode(each).alias("x"))
    return simhash(df.select(*rest, (F.col("base") + F.col("x.i") + 1).alias("at"), *(F.col(f"x.{c}").alias(c) for c in planes)), planes)


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
            threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """One row per text row and contained item: row_key, the id, the item, similarity, and the first words (from 1) of the text's first and last window
    that meet one of the item's."""
    if radius >= BLOCKS:
        raise ValueError("the blocks guarantee a radius below their number")
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("rkey", row_key(F.col("id"), F.col("text")))
    items = (items.select(F.col(item_col).alias("item"), word_hashes(words(F.col(item_text_col))).alias("iw")).where(F.size("iw") > 0)
             .select(F.xxhash64("item", "iw").alias("ikey"), "item", "iw").distinct())
    # an item's places that a text must meet; a repeated shingle counts at each of them, so this is never above what the exact test asks
    places = F.greatest(F.size("iw") - SHINGLE + 1, F.lit(1))
    marks = items.select("ikey", F.ceil(places * threshold - 1e-9).cast("int").alias("need"), "iw")
    index = _banded(_fingerprints(marks, "iw")).select("block", F.col("fp").alias("ifp"), "ikey", "need", F.col("at").alias("place"))
    found = _banded(_fingerprints(docs.select("rkey", word_hashes(words(F.col("text"))).alias("dw")), "dw")).join(small(index), "block")
    found = found.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= radius)
    met = found.groupBy("rkey", "ikey", "need", "place").agg(F.min("at").alias("begin"), F.max("at").alias("last"))
    met = met.groupBy("rkey", "ikey", "need").agg(F.count("*").alias("met"), F.min("begin").alias("begin"), F.max("last").alias("last"))
    return verified(docs, scratch(met.where(F.col("met") >= F.col("need")).drop("met", "need")), items, threshold)


def verified(docs: DataFrame, candidates: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """Keeps candidates whose text holds enough of the item: sum of min(count in item, count in text) over the item's shingles."""
    items = items.select("ikey", "item", shingles(F.col("iw")).alias("ish"))
    # exploding a one-element array keeps the optimiser from working the array out again for each use
    once = lambda c: F.explode(F.array(c))
    back = docs.join(small(candidates.select("rkey").distinct()), "rkey", "left_semi").select("rkey", "id", once(word_hashes(words(F.col("text")))).alias("dw"))
    back = back.select("rkey", "id", once(shingles(F.col("dw"))).alias("dsh"))
    kinds = F.array_distinct("ish")
    both = F.array_intersect("ish", "dsh")
    repeated = F.aggregate(
        both, F.lit(0), lambda acc, s: acc + F.least(F.size(F.filter("ish", lambda y: y == s)), F.size(F.filter("dsh", lambda y: y == s))))
    held = F.when(F.size(kinds) == F.size("ish"), F.size(both)).otherwise(repeated)
    return (back.join(candidates.join(small(items), "ikey"), "rkey").withColumn("similarity", held / F.size("ish")).where(F.col("similarity") >= threshold - 1e-9)
            .groupBy("rkey", "id", "item").agg(F.max("similarity").alias("similarity"), F.min("begin").alias("begin"), F.max("last").alias("last"))
            .select(F.col("rkey").alias("row_key"), "id", "item", "similarity", "begin", "last"))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that contain no item, with all their columns."""
    bad = scratch(matches(docs, items, id_col, text_col, **options).select(F.col("row_key").alias("__key")).distinct())
    return docs.withColumn("__key", row_key(F.col(id_col), F.col(text_col))).join(small(bad), "__key", "left_anti").drop("__key")
