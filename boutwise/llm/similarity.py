"""N-gram Jaccard self-join by vertical partitioning, as connected components of documents.

Every text becomes the set of its distinct 5-word shingles (64-bit hashes). Equal sets are one class; classes are joined, copies are never expanded. The global n-gram
order puts the n-grams that many texts share last, so the prefix of a set, of which any set at similarity t or more must share an n-gram,
holds its rare ones. Candidates come from common prefix n-grams under a length and a position filter. Each set also has a signature, a bitmap of its n-grams' leading
bits: bits that differ are n-grams that differ, so a pair with too many of them is no link, and its sets are never sent. The others are verified by vertical
partitioning: the order is cut into fragments, the overlap of two sets is counted fragment by fragment, and the counts are summed per pair.

N-grams in the prefix of few classes give pairs of classes. An n-gram in the prefix of many (`FEW`) gives no pairs: its classes are linked to the smallest of
them, the components of these stars are groups, and a group is compared tile against tile; the fragments are blocks of a 0/1 matrix whose
products are the partial overlaps, and only a spanning forest of the links found leaves the task. So no link is lost, and no pairs within
a large group become rows.

Defined results: null, empty and wordless texts have an empty set and are linked with nothing; a text of one to four words is one shingle; repeated rows and ids are
rows of their own, linked as their texts are; a component's id is its smallest non-null document id; an empty table gives an empty
result; extra columns are ignored. Sets are told apart by 64-bit hashes of their shingles and of the set.

Scale: three passes over the texts, each of which makes their sets anew; they shuffle the prefixes (about a fifth of the n-grams), and the whole sets of candidates only, which a bitmap of at most
2^MAP_BITS bits tells apart. The list of frequent n-grams is bounded by `FREQUENT`; it sets the order only, so its bound costs no result. A tile
holds at most about `TILE` classes and `TILE_GRAMS` n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, forest
from .sqltext import SHINGLE, row_key, scratch, small
from .textops import mix, shingle_hashes, slices, word_hashes, word_table

PERCENT = 80
FREQUENT = 400_000
FEW = 64
FRAGMENTS = 4
TILE = 2_048
TILE_GRAMS = 1_000_000
TILE_RANGE = 100_000  # n-grams of a tile numbered at once, about
MAP_BITS = 26
STRIP = 1 << 17  # bytes of texts whose sets are made at once
MARK_BITS = 22  # leading bits of n-grams by which frequent ones are looked for
DEALT = 256  # parts of a frequent n-gram's entries


def shingle_slices(column: pa.Array, k: int = SHINGLE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sorted distinct shingles of each row one after the other, their number per row) of some rows at once."""
    for first, data, offsets in slices(column, STRIP):
        b, starts, ends, counts = word_table(data, offsets)
        h, per = shingle_hashes(word_hashes(b, starts, ends), counts, k)
        at = 0
        for n in per.tolist():
            h[at:at + n].sort()
            at += n
        begin = np.cumsum(per) - per
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        new[begin[per > 0]] = True
        upto = np.concatenate(([0], np.cumsum(new)))
        yield first, h[new], upto[begin + per] - upto[begin]


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingles) of each row."""
    for first, flat, per in shingle_slices(column, k):
        for i, h in enumerate(np.split(flat, np.cumsum(per)[:-1])):
            yield first + i, h


def set_classes(flat: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Names sets by their content; none is empty."""
    if not len(per):
        return np.empty(0, np.int64)
    begin = np.cumsum(per) - per
    with np.errstate(over="ignore"):
        x = (np.add.reduceat(mix(flat ^ np.uint64(0xC0FFEE)), begin) * np.uint64(0x9E3779B97F4A7C15)
             + np.bitwise_xor.reduceat(mix(flat + np.uint64(0x5BD1E995)), begin) + per.astype(np.uint64))
    return mix(x).view(np.int64)


def set_class(h: np.ndarray) -> int:
    """Names a set by its content."""
    return int(set_classes(h, np.array([len(h)]))[0])


def signatures(flat: np.ndarray, per: np.ndarray) -> list[bytes]:
    """Of each set one bit for the leading bits of each shingle, more bits than shingles."""
    k = np.maximum(6, np.frexp(per)[1]).astype(np.int64)
    ends = np.cumsum(1 << k)
    bits = np.zeros(int(ends[-1]) if len(ends) else 0, bool)
    bits[np.repeat(ends - (1 << k), per) + (flat >> np.repeat(64 - k, per).astype(np.uint64)).astype(np.int64)] = True
    packed = np.packbits(bits).tobytes()
    return [packed[lo:hi] for lo, hi in zip(((ends - (1 << k)) >> 3).tolist(), (ends >> 3).tolist(), strict=True)]


def signature(h: np.ndarray) -> bytes:
    return signatures(h, np.array([len(h)]))[0]


def _fresh(cls: np.ndarray, seen: set[int]) -> np.ndarray:
    """Which of the classes come for the first time."""
    out = np.zeros(len(cls), bool)
    for i, c in enumerate(cls.tolist()):
        if c not in seen:
            seen.add(c)
            out[i] = True
    return out


def least_difference(a: bytes, b: bytes) -> int:
    """Shingles that two sets at least do not share. The longer signature is folded to the shorter one's leading bits."""
    x, y = (np.unpackbits(np.frombuffer(v, np.uint8)) for v in (a, b))
    n = min(len(x), len(y))
    x, y = (v.reshape(n, -1).max(axis=1) for v in (x, y))
    return int(np.count_nonzero(x != y))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 0: a document, its set's size and class. Kind 1: an n-gram that several classes of the batch share, and their number."""
    for batch in batches:
        n, cls, seen, parts = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), set(), []
        signs: list[bytes | None] = [None] * batch.num_rows
        for first, flat, per in shingle_slices(batch.column(1)):
            some = np.flatnonzero(per)
            c = set_classes(flat, per[some])
            n[first:first + len(per)], cls[first + some] = per, c
            # copies in a batch need it once
            new = _fresh(c, seen)
            flat = flat[np.repeat(new, per[some])]
            parts.append(flat)
            for i, sign in zip((first + some[new]).tolist(), signatures(flat, per[some[new]]), strict=True):
                signs[i] = sign
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), batch.column(0), batch.column(2), pa.array(n), pa.array(cls, mask=n == 0),
                                          pa.array(signs, pa.binary())], ["kind", "doc_id", "rkey", "n", "cls", "sign"])
        if seen:
            every = np.concatenate(parts)
            every.sort()
            at = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
            count = np.diff(np.append(at, len(every)))
            keys, count = every[at[count > 1]], count[count > 1]
            none = pa.nulls(len(keys), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(keys), np.int32)), none, none, pa.array(count), pa.array(keys.view(np.int64)), pa.nulls(len(keys), pa.binary())],
                                             ["kind", "doc_id", "rkey", "n", "cls", "sign"])


def prefixes(flat: np.ndarray, per: np.ndarray, times: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, row of each) of the sets' prefixes in the order of (times, n-gram), set by set in that order. A set with enough n-grams of no times needs no sort."""
    row, p, begin = np.repeat(np.arange(len(per)), per), prefix_length(per, percent), np.cumsum(per) - per
    never = times == 0
    upto = np.concatenate(([0], np.cumsum(never)))
    easy = upto[begin + per] - upto[begin] >= p
    at = [np.flatnonzero(never & easy[row] & (upto[:-1] - upto[begin][row] < p[row]))]
    for i in np.flatnonzero(~easy).tolist():
        lo, n = int(begin[i]), int(per[i])
        at.append(lo + np.argsort(times[lo:lo + n], kind="stable")[:p[i]])
    places = np.concatenate(at)
    return places, row[places]


def _prefixes(told, percent: int):
    """Entries of the sets' prefixes: n-gram, class, and size and position as one number; -1 instead for an n-gram known as frequent."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, count = told.value
        # few n-grams share their leading bits with a frequent one, and only these are looked up
        mark = np.zeros(1 << MARK_BITS, bool)
        mark[keys >> np.uint64(64 - MARK_BITS)] = True
        for batch in batches:
            seen, parts = set(), []
            for _, flat, per in shingle_slices(batch.column(0)):
                per = per[per > 0]
                c = set_classes(flat, per)
                new = _fresh(c, seen)
                flat, per, c = flat[np.repeat(new, per)], per[new], c[new]
                if not len(c):
                    continue
                times = np.zeros(len(flat), np.int64)
                if len(keys):
                    maybe = np.flatnonzero(mark[flat >> np.uint64(64 - MARK_BITS)])
                    at = np.minimum(np.searchsorted(keys, flat[maybe]), len(keys) - 1)
                    times[maybe] = np.where(keys[at] == flat[maybe], count[at], 0)
                places, row = prefixes(flat, per, times, percent)
                # the entries of a set are neighbours, in its order
                new = np.ones(len(row), bool)
                new[1:] = row[1:] != row[:-1]
                begin = np.flatnonzero(new)
                position = np.arange(len(row)) - np.repeat(begin, np.diff(np.append(begin, len(row))))
                # size and position share one number, as these rows are the bulk of what is shuffled
                parts.append((flat[places], c[row], np.where(times[places] > 0, -1, per[row] << 32 | position)))
            if parts:
                h, c, at = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c), pa.array(at)], ["h", "cls", "at"])

    return run


def _meet(percent: int):
    """Entries dealt by n-gram: pairs (kind 0) of classes of a small list, stars (kind 1) of a large one. Entries of frequent n-grams, which are dealt by class too, come out once each
    (kind 2: n-gram and class)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        h, c, at = (np.concatenate([b.column(k).to_numpy() for b in got]) for k in range(3))
        order = np.lexsort((c, h))
        h, c, at = h[order], c[order], at[order]
        if (at < 0).any():
            x, y = h[at < 0], c[at < 0]
            new = np.ones(len(x), bool)
            new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(x[new]), pa.array(y[new]), pa.array(np.full(int(new.sum()), 2, np.int32))], ["a", "b", "kind"])
            h, c, at = h[at >= 0], c[at >= 0], at[at >= 0]
            if not len(h):
                return
        n, i = at >> 32, at & 0xFFFFFFFF
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        h, c, n, i = h[new], c[new], n[new], i[new]
        starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        size = np.diff(np.append(starts, len(h)))
        left, right, kind = [], [], []
        place = np.arange(len(h)) - np.repeat(starts, size)
        size_at = np.repeat(size, size)
        # the d-th neighbour in each small list, for all lists at once
        for d in range(1, int(size[size <= FEW].max(initial=1))):
            at = np.flatnonzero((size_at <= FEW) & (place + d < size_at))
            a, b = at, at + d
            low, high = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
            # before the first common n-gram everything differs, and all that differs is at most (100 - t) / (100 + t) of both sizes
            ok = (100 * low >= percent * high) & ((i[a] + i[b]) * (100 + percent) <= (100 - percent) * (n[a] + n[b]))
            left.append(c[a[ok]])
            right.append(c[b[ok]])
            kind.append(np.zeros(int(ok.sum()), np.int32))
        far = np.flatnonzero((size_at > FEW) & (place > 0))
        left.append(c[far])
        right.append(c[np.repeat(starts, size)[far]])
        kind.append(np.ones(len(far), np.int32))
        a, b = np.concatenate(left), np.concatenate(right)
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.concatenate(kind))], ["a", "b", "kind"])

    return run


def _close(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            least = np.array([least_difference(x, y) for x, y in zip(batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True)], np.int64)
            ok = pa.array((100 + percent) * least <= (100 - percent) * (na + nb))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["a", "b"])

    return run


def _bit(cls: np.ndarray, bits: int) -> np.ndarray:
    return (mix(cls.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def _candidate_bits(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_bit(batch.column(0).to_numpy(), bits))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.int64(1) << (at & 63)))], ["word", "bits"])

    return run


def bitmap(classes: DataFrame) -> np.ndarray:
    """One bit for each hash of a class; its size follows their number up to 2^MAP_BITS bits."""
    bits = min(MAP_BITS, max(12, 4 + int(classes.count()).bit_length()))
    words = classes.mapInArrow(_candidate_bits(bits), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out


def _sets(told):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = told.value
        bits = len(words).bit_length() + 5
        for batch in batches:
            found: dict[int, np.ndarray] = {}
            for _, flat, per in shingle_slices(batch.column(0)):
                per = per[per > 0]
                c, ends = set_classes(flat, per), np.cumsum(per)
                at = _bit(c, bits)
                for i in np.flatnonzero(words[at >> 6] >> (at & 63) & 1).tolist():
                    if int(c[i]) not in found:
                        found[int(c[i])] = flat[ends[i] - per[i]:ends[i]].copy()
            for lo in range(0, len(found), 500):
                part = list(found.items())[lo:lo + 500]
                at = np.concatenate(([0], np.cumsum([len(h) for _, h in part]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([h for _, h in part]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in part], pa.int64()), lists], ["cls", "grams"])

    return run


def _verify_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Overlaps counted fragment by fragment, then summed per pair."""
    cut = 1 << 62
    # the hashes' top two bits name the fragment: four ranges of the order
    part = lambda f: F.filter("grams", lambda x: (x >= F.lit((f - 2) * cut)) & (x <= F.lit((f - 1) * cut - 1)))
    pieces = sets.select("cls", F.size("grams").alias("n"), F.posexplode(F.array(*(part(f) for f in range(FRAGMENTS)))).alias("f", "seg"))
    a = pieces.select(F.col("cls").alias("a"), "f", F.col("n").alias("na"), F.col("seg").alias("sa"))
    b = pieces.select(F.col("cls").alias("b"), "f", F.col("n").alias("nb"), F.col("seg").alias("sb"))
    # few pairs are broadcast, so that of the sets only those in a pair are dealt out
    known = small(pairs)
    b = b.join(small(pairs.select("b").distinct()), "b", "left_semi")
    counted = (a.join(known, "a").join(b, ["b", "f"]).select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).cast("long").alias("o"))
               .groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("o")))
    return counted.where(100 * F.col("o") >= percent * (F.col("na") + F.col("nb") - F.col("o"))).select("a", "b")


def tile_links(cls: np.ndarray, grams: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int, fragment: int = 2_048) -> dict[int, int]:
    """A spanning forest of the links between rows `left` and rows `right` (positions in cls): partial overlaps are products of the 0/1 blocks of each fragment.
    The n-grams (each row's in order) are taken range by range, so that only the overlaps of all rows and one range's n-grams are held."""
    sizes = np.array([len(g) for g in grams])
    bits = max(0, int(sizes.sum()) // TILE_RANGE).bit_length()
    edges: list[tuple[int, int]] = []
    place_l, place_r = np.full(len(grams), -1, np.int32), np.full(len(grams), -1, np.int32)
    place_l[left], place_r[right] = np.arange(len(left)), np.arange(len(right))
    overlap = np.zeros((len(left), len(right)), np.float32)
    begin = np.zeros(len(grams), np.int64)
    for r in range(1, (1 << bits) + 1):
        end = sizes if r == 1 << bits else np.array([np.searchsorted(g, np.uint64(r << (64 - bits))) for g in grams])
        _, at, times = np.unique(np.concatenate([g[lo:hi] for g, lo, hi in zip(grams, begin.tolist(), end.tolist(), strict=True)]), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(grams), dtype=np.int32), end - begin)
        begin = end
        common = times > 1
        ok = common[at]
        row, at = row[ok], (np.cumsum(common, dtype=np.int32) - 1)[at[ok]]
        order = np.argsort(at, kind="stable")
        row, at = row[order], at[order]
        width = int(common.sum())
        for lo in range(0, width, fragment):
            s = slice(*np.searchsorted(at, (lo, lo + fragment)))
            a, b = (np.zeros((len(p), min(fragment, width - lo)), np.float32) for p in (left, right))
            for m, place in ((a, place_l), (b, place_r)):
                k = place[row[s]] >= 0
                m[place[row[s]][k], at[s][k] - lo] = 1
            for i in range(0, len(left), 256):
                overlap[i:i + 256] += a[i:i + 256] @ b.T
    for i in range(len(left)):
        o = overlap[i]
        j = np.flatnonzero(100 * o >= percent * (sizes[left[i]] + sizes[right] - o))
        edges += [(int(cls[left[i]]), int(cls[right[x]])) for x in j]
        if len(edges) > 200_000:
            edges = [(x, r) for x, r in forest(iter(edges)).items()]
    return {x: r for x, r in forest(iter(edges)).items() if x != r}


def _tile(percent: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        t, u = key[1].as_py(), key[2].as_py()
        cls = table.column("cls").to_numpy()
        tile = table.column("tile").to_numpy()
        lists = table.column("grams").combine_chunks()
        off, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
        grams = [flat[off[i]:off[i + 1]] for i in range(len(cls))]
        left, right = np.flatnonzero(tile == t), np.flatnonzero(tile == u)
        found = tile_links(cls, grams, left, right, percent) if len(left) and len(right) else {}
        return pa.table({"a": pa.array(list(found), pa.int64()), "b": pa.array(list(found.values()), pa.int64())})

    return run


def _verify_groups(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    found = components(stars)
    groups = scratch(found.select("node", "root").unionByName(found.select(F.col("root").alias("node"), "root").distinct()).select(F.col("node").alias("cls"), F.col("root").alias("grp")))
    member = sets.join(small(groups), "cls")
    many = (member.groupBy("grp").agg(F.count("*").alias("m"), F.sum(F.size("grams").cast("long")).alias("s"))
            .select("grp", F.greatest(F.ceil(F.col("m") / TILE), F.ceil(F.col("s") / TILE_GRAMS)).cast("int").alias("tiles")))
    dealt = member.join(many, "grp").withColumn("tile", F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int"))
    each = dealt.select("grp", "cls", "tile", "grams", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    each = each.select("grp", F.least("tile", "other").alias("t"), F.greatest("tile", "other").alias("u"), "cls", "tile", "grams")
    return each.groupBy("grp", "t", "u").applyInArrow(_tile(percent), "a long, b long")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row, row_key, which names it by id and text, and class_key, which names its group (null without words)."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    src = src.withColumn("rkey", row_key(F.col("doc_id"), F.col("text")))
    text = src.select("text").where("text is not null")
    known = scratch(src.mapInArrow(_classes, "kind int, doc_id long, rkey long, n long, cls long, sign binary"))
    rows = known.where("kind = 0").select("doc_id", "rkey", "n", "cls")
    often = (known.where("kind = 1").groupBy(F.col("cls").alias("h")).agg(F.sum("n").alias("n")).where("n > 2").orderBy(F.desc("n"), "h").limit(FREQUENT).toPandas())
    h, n = often["h"].to_numpy(np.int64).view(np.uint64), often["n"].to_numpy(np.int64)
    order = np.argsort(h)
    told = spark.sparkContext.broadcast((h[order], n[order]))
    entries = text.mapInArrow(_prefixes(told, percent), "h long, cls long, at long")
    # n-grams known as frequent skip the pairing: dealt by class as well, their classes go to the stars, whose smallest class is found by partial sums
    apart = F.when(F.col("at") < 0, F.pmod(F.xxhash64("cls"), F.lit(DEALT))).otherwise(0)
    met = scratch(entries.repartition(F.col("h"), apart).mapInArrow(_meet(percent), "a long, b long, kind int").distinct())
    frequent = met.where("kind = 2").select(F.col("a").alias("h"), F.col("b").alias("cls"))
    least = frequent.groupBy("h").agg(F.min("cls").alias("b"))
    stars = (frequent.join(least, "h").where("cls <> b").select(F.col("cls").alias("a"), "b").unionByName(met.where("kind = 1").select("a", "b"))).distinct()
    stars = scratch(stars)
    signs = known.where("sign is not null").select("cls", "n", "sign").dropDuplicates(["cls"])
    side = lambda c: signs.select(F.col("cls").alias(c), F.col("n").alias(f"n{c}"), F.col("sign").alias(f"s{c}"))
    pairs = met.where("kind = 0").select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "sa", "nb", "sb")
    pairs = scratch(pairs.mapInArrow(_close(percent), "a long, b long"))
    candidates = scratch(pairs.select(F.explode(F.array("a", "b")).alias("cls")).unionByName(stars.select(F.explode(F.array("a", "b")).alias("cls"))).distinct())
    marks = spark.sparkContext.broadcast(bitmap(candidates))
    sets = scratch(text.mapInArrow(_sets(marks), "cls long, grams array<long>").dropDuplicates(["cls"]))
    # of a family of candidates, a spanning forest is verified first; what then is one component needs no more of its pairs
    forest_ = scratch(components(pairs).select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = scratch(_verify_pairs(forest_, sets, percent).unionByName(_verify_groups(stars, sets, percent)))
    so_far = scratch(components(links))
    side = lambda c: so_far.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    apart = (pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
             .where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b").join(forest_.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti"))
    apart = scratch(apart)
    linked = components(links.unionByName(_verify_pairs(apart, sets, percent))) if not apart.isEmpty() else so_far
    # classes of one document without links are their own component
    own = rows.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    named = own.join(linked.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("copies").alias("total"))
    names = scratch(named.join(least.where("total > 1"), "root").select("cls", "component_id", "root"))
    return (rows.join(small(names), "cls", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.col("rkey").alias("row_key"), F.coalesce("root", "cls").alias("class_key")))
