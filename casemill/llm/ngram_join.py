"""N-gram Jaccard join by grouped prefixes, with the components of its links.

1. Every text becomes a set of hashed word shingles. Texts of equal sets are one class (128-bit digest).
2. Shingles whose hash lies in the lowest ``COUNTED`` part of the hash range are counted over all documents:
   blocks of documents send owners their distinct hashes as packed gaps, with a count for each that the block
   repeats, and get back the frequent ones.
3. All shingles are ordered: counted ones by ascending frequency, then the others by hash. Two sets that
   meet the threshold share a shingle among the first n - ceil(threshold * n) + 1 of each; shingles that
   occur once join nothing, so most documents end here. Classes with the same prefix and size form a group.
4. A pair of groups meets at its first common shingle alone and is filtered by sizes, by where that shingle
   stands in either order (what lies before it can't be shared) and by parity masks: a set's shingles each flip
   one of ``PARITY_BITS`` bits, so two sets differ in at least as many shingles as their masks differ in bits; of a
   group the bits count that all its members have alike. No filter loses a link. Pairs that are left are
   expanded to members, filtered by the members' own masks and verified on the sets.

:func:`ngram_links` verifies all pairs. :func:`ngram_components` needs fewer: first each group meets only a few
hubs of its shingles and verified links are merged into components. Where many pairs could still meet, a share of
them, drawn by a hash of the pair, is verified and merged before the rest: of a family of near copies most links then lie
inside a component. The pairs that remain between different components are at last all verified. Pairs inside a component
need no verification, as their link cannot change the result; a group of copies of any size costs its length, and no link
between components is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.llm.components import components
from casemill.llm.shared import give_back, only_possible, remove, ship_package, tidied, text_of, written

#: Part of the hash range whose shingles are counted; any value gives the same result.
COUNTED = 0.4
BLOCK_TOKENS = 500_000
OWNER_TOKENS = 1_000_000
#: Hubs that a group meets before the pairs that are left are taken.
HUBS = 3
#: Meetings of groups for each of their postings, and pairs for each member, beyond which a share of them is merged first.
MEETINGS, OPEN_PAIRS = 32, 2
#: Bits of a set's parity mask, in 64-bit words.
MASK_WORDS = 8
PARITY_BITS = 64 * MASK_WORDS
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; the whole sequence where there are fewer words."""
    found = text.encode().lower().split()  # bytes: A-Z only, ASCII white space only
    if not found:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    width = min(words, len(found))
    count = len(found) - width + 1
    total = np.full(count, width, np.uint64)
    for at in range(width):
        total = (total ^ hashes[at : at + count]) * _ODD
        total = (total ^ (total >> np.uint64(29))) * _MIX
        total ^= total >> np.uint64(32)
    return np.unique(total)


def packed(values: np.ndarray, width: int) -> bytes:
    """Sorted values as gaps, byte plane by byte plane: the high planes are mostly zero and compress away."""
    gaps = np.diff(values.astype("<u8"), prepend=np.uint64(0)).astype("<u8")
    return gaps.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpacked(data: bytes, width: int) -> np.ndarray:
    count = len(data) // width
    gaps = np.zeros((count, 8), np.uint8)
    gaps[:, :width] = np.frombuffer(data, np.uint8).reshape(width, count).T
    return np.cumsum(gaps.view("<u8").ravel(), dtype=np.uint64)


def mask(found: np.ndarray) -> bytes:
    """One bit for each residue of the hashes: whether an odd number of them has it."""
    odd = np.bincount((found % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    return lambda batches: tidied(run(batches))


def _sender(words: int, percent: int, counted: int):
    """Documents to (id, n, sig, block, low, mask): low holds the counted shingles, or the first of the order if they are more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        held = 0
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for text in batch.column(1):
                found = shingles(text.as_py(), words)
                low = (found >> np.uint64(32)).astype(np.uint64)
                n = len(found)
                keep = max(int(np.searchsorted(low, counted)), n - -(-percent * n // 100) + 1) if n else 0
                held += keep
                if held > BLOCK_TOKENS:
                    block, held = block + 1, keep
                sig = xxhash.xxh3_128_digest(found.tobytes()) if n else None
                for column, value in zip(columns, (n, sig, block, packed(low[:keep], 4), mask(found)), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["id", "n", "sig", "block", "low", "mask"])

    return run


def _messages(owners: int, counted: int):
    span = -(-counted // owners)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low: dict[int, list[np.ndarray]] = {}
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                low.setdefault(block, []).append(unpacked(data.as_py(), 4))
            rows = []
            for block, parts in low.items():
                values, counts = np.unique(np.concatenate(parts), return_counts=True)
                cuts = np.searchsorted(values, np.arange(owners + 1, dtype=np.uint64) * np.uint64(span))
                cuts = np.minimum(cuts, np.searchsorted(values, counted))
                for owner in np.flatnonzero(np.diff(cuts)):
                    own = slice(cuts[owner], cuts[owner + 1])
                    again = np.flatnonzero(counts[own] > 1)
                    coded = packed(values[own] - np.uint64(int(owner) * span), 4)
                    rows.append((int(owner), block, coded, again.astype("<u4").tobytes(), counts[own][again].astype("<u4").tobytes()))
            names = ("owner", "block", "coded", "again", "counts")
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            columns = zip(*rows, strict=True) if rows else ([] for _ in names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], list(names))

    return run


def _frequent(owners: int, counted: int):
    span = -(-counted // owners)

    def run(sent: pd.DataFrame) -> pd.DataFrame:
        """One owner's answer: per message its hashes that occur more than once, with their frequencies."""
        base = np.uint64(int(sent["owner"].iloc[0]) * span)
        parts = [unpacked(data, 4) for data in sent["coded"]]
        weights = [np.ones(len(part), np.int64) for part in parts]
        for weight, again, counts in zip(weights, sent["again"], sent["counts"], strict=True):
            weight[np.frombuffer(again, "<u4")] = np.frombuffer(counts, "<u4")
        values, place = np.unique(np.concatenate(parts), return_inverse=True)
        totals = np.bincount(place, np.concatenate(weights), len(values))
        often = np.minimum(totals, 65535).astype("<u2")[place]
        found, frequencies, at = [], [], 0
        for part in parts:
            own = often[at : at + len(part)]
            at += len(part)
            found.append(packed(part[own > 1] + base, 4))
            frequencies.append(own[own > 1].tobytes())
        parts = weights = values = place = totals = often = own = part = None
        give_back()
        return pd.DataFrame({"block": sent["block"], "values": found, "often": frequencies})

    return run


def _prefixes(percent: int, counted: int):
    schema = ["sig", "n", "grp", "toks", "places", "mask"]

    def run(key: tuple, docs: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        """A block's classes with the shared shingles of their prefixes, in their order."""
        docs = docs[docs["n"] > 0].drop_duplicates("sig")
        if not len(docs):
            return pd.DataFrame(columns=schema)
        lows = [unpacked(data, 4) for data in docs["low"]]
        sizes = np.array([len(low) for low in lows])
        values = np.concatenate(lows)
        often = np.ones(len(values), np.int64)
        if len(replies):
            known = np.concatenate([unpacked(data, 4) for data in replies["values"]])
            counts = np.concatenate([np.frombuffer(data, "<u2") for data in replies["often"]])
            known, first = np.unique(known, return_index=True)
            counts = counts[first]
            if len(known):
                at = np.minimum(np.searchsorted(known, values), len(known) - 1)
                often = np.where(known[at] == values, counts[at], 1)
        late = values >= counted
        often = np.where(late, 2, often)
        doc = np.repeat(np.arange(len(docs)), sizes)
        order = np.lexsort((values, often, late, doc))
        place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        n = docs["n"].to_numpy()
        length = n - -(-percent * n // 100) + 1
        wanted = (place < length[doc]) & (often[order] > 1)
        # a value that a set holds twice (shingles of equal 32 bits) counts where it stands first
        wanted[1:] &= (values[order][1:] != values[order][:-1]) | (doc[1:] != doc[:-1])
        chosen, at = values[order[wanted]].astype(np.uint32).view(np.int32), place[wanted].astype(np.int32)
        out, cuts = [], np.searchsorted(doc[wanted], np.arange(len(docs) + 1))
        for row, (sig, size, bits) in enumerate(zip(docs["sig"], n, docs["mask"], strict=True)):
            own = slice(cuts[row], cuts[row + 1])
            if cuts[row] < cuts[row + 1]:
                grp = xxhash.xxh3_128_digest(np.concatenate(([size], chosen[own], at[own])).tobytes())
                out.append((sig, size, grp, chosen[own], at[own], np.frombuffer(bits, ">i8").astype(np.int64)))
        lows = values = often = late = doc = order = place = wanted = chosen = at = None
        give_back()
        return pd.DataFrame(out, columns=schema)

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(0):
                found = shingles(text.as_py(), words)
                if len(found):
                    rows.append({"sig": xxhash.xxh3_128_digest(found.tobytes()), "set": packed(found, 8)})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("sig", pa.binary()), ("set", pa.binary())]))

    return run


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3), strict=True):
                a, b = unpacked(left.as_py(), 8), unpacked(right.as_py(), 8)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


class _Verifier:
    """Checks class pairs on their sets, each pair once."""

    def __init__(self, sets: DataFrame, percent: int):
        self.sets, self.percent, self.tried, self.last = sets, percent, None, None
        self.paths: list[str] = []

    def __call__(self, pairs: DataFrame) -> DataFrame:
        """The linked ones of distinct pairs (a < b)."""
        spark = pairs.sparkSession
        if self.tried is not None:
            pairs = pairs.join(self.tried, ["a", "b"], "left_anti")
        pairs, pairs_path = written(spark, pairs, "pairs")
        self.last = pairs
        self.tried = pairs if self.tried is None else self.tried.unionByName(pairs)
        left = self.sets.select(F.col("sig").alias("a"), F.col("set").alias("left"))
        right = self.sets.select(F.col("sig").alias("b"), F.col("set").alias("right"))
        loaded = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
        links = loaded.mapInArrow(_tidy(_linked(self.percent)), "a binary, b binary")
        links, links_path = written(spark, links, "links")
        self.paths += [pairs_path, links_path]
        return links


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _least_shared(n: Column, other_n: Column, percent: int) -> Column:
    """Shingles that two sets of these sizes must share: ceil(percent * (n + other_n) / (100 + percent))."""
    whole = 100 + percent
    return F.floor((percent * (n + other_n) + whole - 1) / whole)


def _may_link(n: Column, place: Column, other_n: Column, other_place: Column, percent: int) -> Column:
    """Whether two sets whose first common shingle stands at these places of their orders can meet the threshold: all they share stands at or behind it."""
    shared = _least_shared(n, other_n, percent)
    return (n - place >= shared) & (other_n - other_place >= shared) & (100 * F.least(n, other_n) >= percent * F.greatest(n, other_n))


def _alike_enough(differing: list[Column], n: Column, other_n: Column, percent: int) -> Column:
    """Whether the bits in which the masks surely differ are no more than the shingles in which linked sets may differ."""
    bits = sum((F.bit_count(word) for word in differing[1:]), F.bit_count(differing[0]))
    return bits <= n + other_n - 2 * _least_shared(n, other_n, percent)


@dataclass
class _Tables:
    """What both joins start from, all written: one row a document, a class, a group and a posting of a group."""

    classes: DataFrame  # id, n, sig
    members: DataFrame  # sig, n, grp, mask
    groups: DataFrame  # grp, n, ones, mixed: the bits that all members have set, and those in which they differ
    posts: DataFrame  # tok, place, nth, grp, n, rep
    verify: _Verifier
    paths: list[str]  # of all but the classes


def _tables(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> _Tables:
    spark = docs.sparkSession
    ship_package(spark)
    counted = int(COUNTED * (1 << 32))
    id_type = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    rows, rows_path = written(
        spark,
        source.mapInArrow(_tidy(_sender(words, percent, counted)), f"id {id_type}, n long, sig binary, block long, low binary, mask binary"),
        "shingled",
    )
    total = rows.agg(F.sum("n")).first()[0] or 0
    owners = max(spark.sparkContext.defaultParallelism, int(total * COUNTED) // OWNER_TOKENS + 1)
    messages = rows.select("block", "low").mapInArrow(_tidy(_messages(owners, counted)), "owner long, block long, coded binary, again binary, counts binary")
    replies = messages.groupBy("owner").applyInPandas(_frequent(owners, counted), "block long, values binary, often binary")
    prefixes = (
        rows.select("block", "n", "sig", "low", "mask").groupBy("block").cogroup(replies.groupBy("block"))
        .applyInPandas(_prefixes(percent, counted), "sig binary, n long, grp binary, toks array<int>, places array<int>, mask array<long>")
    )
    prefixes, prefix_path = written(spark, prefixes, "prefixes")
    classes, _ = written(spark, rows.select("id", "n", "sig"), "classes")
    remove(spark, rows_path)

    # groups of classes with the same prefix and size; those that can meet nobody go
    # (a class whose copies lie in several blocks comes once for each)
    words_of = range(MASK_WORDS)
    sides = [F.bit_and(F.col("mask")[w]).alias(f"one{w}") for w in words_of] + [F.bit_or(F.col("mask")[w]).alias(f"any{w}") for w in words_of]
    grouped = prefixes.groupBy("grp", "n").agg(F.min("sig").alias("rep"), F.max("sig").alias("last"), F.first(F.struct("toks", "places")).alias("at"), *sides)
    grouped, grouped_path = written(spark, grouped, "grouped")
    posts = grouped.select("grp", "n", "rep", F.posexplode(F.arrays_zip("at.toks", "at.places")).alias("nth", "post"))
    posts = posts.select(F.col("post.toks").alias("tok"), F.col("post.places").alias("place"), "nth", "grp", "n", "rep")
    shared = posts.groupBy("tok").agg(F.min("grp").alias("x"), F.max("grp").alias("y")).where("x <> y").select("tok")
    posts, posts_path = written(spark, posts.join(shared, "tok", "left_semi"), "posts")
    alive = posts.select("grp").unionByName(grouped.where("rep <> last").select("grp")).distinct()
    members, members_path = written(spark, prefixes.select("sig", "n", "grp", "mask").dropDuplicates(["sig"]).join(alive, "grp", "left_semi"), "members")
    groups = grouped.join(alive, "grp", "left_semi").select(
        "grp", "n", F.array(*[f"one{w}" for w in words_of]).alias("ones"),
        F.array(*[F.col(f"one{w}").bitwiseXOR(F.col(f"any{w}")) for w in words_of]).alias("mixed"),
    )
    groups, groups_path = written(spark, groups, "groups")
    remove(spark, prefix_path)
    remove(spark, grouped_path)

    # the sets of the classes that can meet somebody, once for each class
    firsts = classes.where("sig IS NOT NULL").groupBy("sig").agg(F.min("id").alias("wanted"))
    wanted = firsts.join(members.select("sig"), "sig", "left_semi").select("wanted").distinct()
    wanted, wanted_path = written(spark, wanted, "wanted")
    possible = only_possible(source, F.xxhash64("id"), wanted.select(F.xxhash64("wanted")), wanted.count())
    texts = possible.join(wanted, possible["id"].eqNullSafe(wanted["wanted"]), "left_semi").select("text")
    sets = texts.mapInArrow(_tidy(_sets(words)), "sig binary, set binary").groupBy("sig").agg(F.first("set").alias("set"))
    sets, sets_path = written(spark, sets, "sets")
    remove(spark, wanted_path)
    return _Tables(classes, members, groups, posts, _Verifier(sets, percent), [posts_path, members_path, groups_path, sets_path])


def _open_sides(tables: _Tables, rooted: DataFrame) -> DataFrame:
    """Postings (tok, place, grp, n, low, high) of the shingles whose groups have more than one root, with their groups' roots."""
    spark = rooted.sparkSession
    roots = rooted.groupBy("grp").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    sides = tables.posts.select("tok", "place", "grp", "n").join(roots, "grp")
    open_toks = sides.groupBy("tok").agg(F.min("low").alias("x"), F.max("high").alias("y")).where("x <> y").select("tok")
    sides, sides_path = written(spark, sides.join(open_toks, "tok", "left_semi"), "open-sides")
    tables.paths.append(sides_path)
    return sides


def _drawn(a: str, b: str, share: float) -> Column:
    """Whether a pair belongs to this share of all pairs."""
    return F.lit(True) if share >= 1 else F.pmod(F.xxhash64(F.least(a, b), F.greatest(a, b)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1


def _member_pairs(tables: _Tables, rooted: DataFrame, sides: DataFrame, percent: int, share: float = 1.0) -> DataFrame:
    """Pairs (a, b) of members of different roots that may link: groups are paired, filtered, then expanded.

    ``rooted`` has the members (sig, n, grp, mask, root), ``sides`` their open postings. A ``share`` below 1 draws so many of the pairs.
    """
    roots = rooted.groupBy("grp").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    # what pairs of different roots have in common are open shingles: only they can stand before another
    ordered = sides.select("grp", "n", "low", "high", "place", "tok").groupBy("grp", "n", "low", "high").agg(F.array_sort(F.collect_list(F.struct("place", "tok"))).alias("posts"))
    posted = ordered.join(tables.groups.drop("n"), "grp").select(*ordered.columns, "ones", "mixed", F.col("posts.tok").alias("toks"), F.posexplode("posts").alias("nth", "post"))
    posted = posted.select("grp", "n", "low", "high", "ones", "mixed", "post.tok", "post.place", F.slice("toks", F.lit(1), F.col("nth")).alias("before"))
    x, y = posted.alias("x"), posted.alias("y")

    def differing(one: str, ones: str, *mixed: str) -> list[Column]:
        """Bits in which every member of one side differs from every member of the other, word by word."""
        unsure = [[F.col(m)[w] for m in mixed] for w in range(MASK_WORDS)]
        words = [F.col(one)[w].bitwiseXOR(F.col(ones)[w]) for w in range(MASK_WORDS)]
        return [word.bitwiseAND(F.bitwise_not(reduce(Column.bitwiseOR, some))) if some else word for word, some in zip(words, unsure, strict=True)]

    one_root = (F.col("x.low") == F.col("x.high")) & (F.col("y.low") == F.col("y.high")) & (F.col("x.low") == F.col("y.low"))
    met = x.join(y, F.col("x.tok") == F.col("y.tok")).where(
        (F.col("x.grp") < F.col("y.grp")) & _drawn("x.grp", "y.grp", share) & ~one_root
        & _may_link(F.col("x.n"), F.col("x.place"), F.col("y.n"), F.col("y.place"), percent)
        & _alike_enough(differing("x.ones", "y.ones", "x.mixed", "y.mixed"), F.col("x.n"), F.col("y.n"), percent)
        & ~F.arrays_overlap("x.before", "y.before")
    )  # a pair of groups meets once, by its first common shingle
    met = met.select(F.col("x.grp").alias("xg"), F.col("y.grp").alias("yg"), F.col("y.ones").alias("ones"), F.col("y.mixed").alias("mixed"), F.col("y.n").alias("yn"))
    # members of one group may belong to different roots too
    own = tables.groups.join(roots.where("low <> high"), "grp").select(F.col("grp").alias("xg"), F.col("grp").alias("yg"), "ones", "mixed", F.col("n").alias("yn"))
    lefts = rooted.select(F.col("grp").alias("xg"), F.col("root").alias("ar"), F.col("sig").alias("a"), F.col("n").alias("an"), F.col("mask").alias("am"))
    rights = rooted.select(F.col("grp").alias("yg"), F.col("root").alias("br"), F.col("sig").alias("b"), F.col("mask").alias("bm"))
    half = met.unionByName(own).join(lefts, "xg").where(_alike_enough(differing("am", "ones", "mixed"), F.col("an"), F.col("yn"), percent))
    drawn = (F.col("xg") != F.col("yg")) | _drawn("a", "b", share)
    pairs = half.select("a", "ar", "an", "am", "xg", "yg", "yn").join(rights, "yg").where((F.col("ar") != F.col("br")) & drawn & _alike_enough(differing("am", "bm"), F.col("an"), F.col("yn"), percent))
    return pairs.select("a", "b")


def _hub_pairs(posts: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Each member with the representative of the hub that its group shares most shingles with, for each of HUBS seeds."""
    found = []
    for seed in range(HUBS):
        # bands of sizes that can meet; the offset moves their borders from seed to seed
        band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)) + F.lit(seed / HUBS))
        banded = posts.withColumn("band", band)
        # a set that has few shingles rarer than this one is near the middle of its family
        few = F.floor(F.col("place") / 4**seed)
        hub = F.min(F.struct(few.alias("few"), F.xxhash64("grp", F.lit(seed)).alias("h"), "grp", "n", "place", "rep")).alias("hub")
        hubs = banded.groupBy("tok", "band").agg(hub, F.count(F.lit(1)).alias("size")).where("size > 1")
        met = banded.join(hubs, ["tok", "band"]).where(
            (F.col("grp") != F.col("hub.grp")) & _may_link(F.col("n"), F.col("place"), F.col("hub.n"), F.col("hub.place"), percent)
        )
        shared = met.groupBy("grp", F.col("hub.rep").alias("to")).agg(F.count(F.lit(1)).alias("shared"))
        found.append(shared.groupBy("grp").agg(F.max(F.struct("shared", "to")).alias("best")).select("grp", "best.to"))
    best = found[0]
    for other in found[1:]:
        best = best.unionByName(other)
    return members.join(best.distinct(), "grp").select(F.col("sig").alias("a"), F.col("to").alias("b"))


def _next_share(tables: _Tables, rooted: DataFrame, sides: DataFrame, before: float, share: float) -> float:
    """The share of the open pairs to verify next, 1 where they are few; ``share`` is the last one, ``before`` that before it, 0 at first.

    At first the meetings of groups are counted. Later the pairs drawn last tell: those that still lie between different
    roots, divided by the share that they are of all pairs, are about as many as all that are left. Each share is at least
    four times the last, and holds its pairs.
    """
    if not share:
        met = sides.groupBy("tok").agg(F.count(F.lit(1)).alias("groups"))
        posts, meetings = met.agg(F.sum("groups"), F.sum(F.col("groups").cast("double") * (F.col("groups") - 1) / 2)).first()
        wanted = MEETINGS * posts / meetings if meetings else 1.0
    else:
        a, b = (rooted.select(F.col("sig").alias(side), F.col("root").alias(f"{side}r")) for side in "ab")
        apart = tables.verify.last.join(a, "a").join(b, "b").where("ar <> br").count() / (share - before)
        wanted = max(4 * share, OPEN_PAIRS * rooted.count() / apart if apart else 1.0)
    return wanted if wanted < 0.5 else 1.0


def ngram_links(
    docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """All links: pairs (a, b) of class digests, a < b, and the membership (id, n_shingles, class).

    A class is a set of shingles; rows of one class link with each other and with all rows of linked classes, so
    copies are not expanded. Every pair of classes that may meet the threshold is verified. Rows without shingles
    have a null class; null ids, repeated rows, other columns and an empty table as in :func:`ngram_components`.
    """
    tables = _tables(docs, words, percent, id_col, text_col)
    rooted = tables.members.withColumn("root", F.col("sig"))
    links = tables.verify(_ordered(_member_pairs(tables, rooted, _open_sides(tables, rooted), percent)))
    return links, tables.classes.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("sig").alias("class"))


def ngram_components(
    docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: id, n_shingles, component_id (the smallest id reachable by links, its own included).

    Texts link when 100 * intersection >= percent * union of their shingle sets. Null, empty and blank texts
    have no shingles and link with nothing: their component is their own id. Null ids are kept and are never
    a component's smallest id where another exists; rows that repeat an id or a text are each returned; an
    empty table gives no rows; other columns are ignored. Shingles are compared by 64-bit hashes, classes by 128.
    """
    spark = docs.sparkSession
    tables = _tables(docs, words, percent, id_col, text_col)
    members, classes = tables.members, tables.classes

    # members meet the representative of their group, groups meet hubs
    inner = members.groupBy("grp").agg(F.min("sig").alias("b"))
    pairs = members.join(inner, "grp").select(F.col("sig").alias("a"), "b")
    links = tables.verify(_ordered(pairs.unionByName(_hub_pairs(tables.posts, members, percent))))
    roots = components(links)

    # all that remains between different components; of many pairs first a share, whose links are merged
    before = share = 0.0
    while share < 1:
        rooted = members.join(roots.select(F.col("node").alias("sig"), "root"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
        rooted, rooted_path = written(spark, rooted, "rooted")
        tables.paths.append(rooted_path)
        sides = _open_sides(tables, rooted)
        before, share = share, _next_share(tables, rooted, sides, before, share)
        found = tables.verify(_ordered(_member_pairs(tables, rooted, sides, percent, share)))
        if not found.isEmpty():
            links = links.unionByName(found)
            roots = components(links)
    for path in (*tables.paths, *tables.verify.paths):
        remove(spark, path)

    # classes are summed before they meet their roots, and both right sides are written, so that Spark can split the joins
    # of a class or a component that a large part of all rows belongs to
    firsts = classes.where("sig IS NOT NULL").groupBy("sig").agg(F.min("id").alias("first"))
    labelled = firsts.join(roots.select(F.col("node").alias("sig"), "root"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    labelled, labelled_path = written(spark, labelled, "labelled")
    smallest, smallest_path = written(spark, labelled.groupBy("root").agg(F.min("first").alias("component")), "smallest")
    answers, _ = written(spark, labelled.join(smallest, "root").select("sig", "component"), "answers")
    remove(spark, labelled_path)
    remove(spark, smallest_path)
    return classes.join(answers, "sig", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("sig").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id")
    )


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component of links: the one with the smallest id.

    Documents without shingles stay, rows that repeat both id and text leave one, other columns pass through.
    """
    found = ngram_components(docs, words, percent, id_col, text_col)
    chosen = found.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("__kept_id")).distinct()
    kept = docs.join(chosen, docs[id_col].eqNullSafe(chosen["__kept_id"]), "left_semi")
    # of rows that repeat both id and text one stays, whatever their other columns are called
    row = F.struct(*[docs[c] for c in docs.columns])
    whole = kept.select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__hash"), row.alias("__row"))
    return whole.dropDuplicates(["__id", "__hash"]).select("__row.*")
