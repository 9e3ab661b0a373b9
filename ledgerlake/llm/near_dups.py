"""Near duplicates by MinHash and a multi-index Hamming join.

A document's set holds the hashes of its distinct 5-word shingles. Its signature is SYMBOLS
MinHash values of 16 bits each; the distance of two signatures is how many values differ. Two
signatures at distance R or less, cut into CHUNKS chunks, agree in some chunk up to
R // CHUNKS = 1 value (pigeonhole); so each signature is entered once for each chunk and each
value of it left out, and signatures that meet in no bucket are surely farther apart.
Sets of Jaccard similarity 0.85 meet but for a chance of 6e-6, as chunks beyond the guarantee
count too. Links are then confirmed on full sets.

No bucket is paired out. Equal sets are one class. In each bucket every class is held against one
chosen member, its star; the best such pair of each class is confirmed first, then those between
different components. A star and all that its buckets hold are one group, so two signatures that meet are in one group. Where
a group still has several components, its members are described by their differences from its usual
shingles. That tells exactly who can yet be similar to whom (_lists): a group of copies with an edit or two too many
for links among them costs its size, not its square. Who is left is held against the member
nearest to the usual, and that of each list of equal differences; only lists with several components
even then are compared in blocks of bounded size, by signature, set size and full set, in place. There a member's
set is written as its differences, as it stands in many lists and most of the set is the star's usual one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import SpanHasher, by_id, mix64, random_words, slices, staged, table, thrifty, utf8_view, word_spans
from .components import components

SHINGLE = 5
CHUNKS, WIDTH = 8, 6
SYMBOLS = CHUNKS * WIDTH
#: By percent, pairs of larger signature distance are not confirmed: chance 1e-6 at that similarity.
FAR = {85: 21, 80: 24}
PERCENT = 85
BLOCK = 512

_WORD = np.array([not (x == 0x20 or 0x09 <= x <= 0x0D) for x in range(256)])
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)
_HASHER = SpanHasher(31)
_TIMES = random_words(SYMBOLS, 41) | np.uint64(1)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles; of all its words, where they are fewer than SHINGLE; none for null or blank."""
    data, offs = utf8_view(column)
    data = _LOWER[data]
    starts, ends = word_spans(_WORD[data], offs)
    words = _HASHER.spans(data, starts, ends)
    rows = np.searchsorted(offs, starts, "right") - 1
    first = np.searchsorted(rows, np.arange(len(offs)))
    hashes = words[: max(0, len(words) - SHINGLE + 1)].copy()
    for j in range(1, SHINGLE):
        hashes = hashes * _STEP + words[j : j + len(hashes)]
    hashes = mix64(hashes)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= SHINGLE:
            out.append(np.unique(hashes[a : b - SHINGLE + 1]))
        elif b > a:
            h = np.uint64(b - a)
            for w in words[a:b]:
                h = np.uint64((int(h) * int(_STEP) + int(w)) & 0xFFFFFFFFFFFFFFFF)
            out.append(mix64(np.array([h], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(hashes: np.ndarray) -> np.ndarray:
    low = np.full(SYMBOLS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for lo in range(0, len(hashes), 1024):
        np.minimum(low, (hashes[lo : lo + 1024, None] * _TIMES).min(0), out=low)
    return (mix64(low) & np.uint64(0xFFFF)).astype("<u2")


def bucket_keys(signatures: np.ndarray) -> np.ndarray:
    """n x (CHUNKS * WIDTH) keys: for each chunk and each of its values left out, a hash of the other values."""
    s = signatures.reshape(-1, CHUNKS, WIDTH).astype(np.uint64)
    keys = np.empty((len(s), CHUNKS, WIDTH), np.uint64)
    for out in range(WIDTH):
        h = np.broadcast_to(np.arange(CHUNKS, dtype=np.uint64) * np.uint64(WIDTH) + np.uint64(out + 1), s.shape[:2]).copy()
        for k in range(WIDTH):
            if k != out:
                h = mix64(h * _STEP + s[:, :, k])
        keys[:, :, out] = h
    return keys.reshape(len(s), -1).view(np.int64)


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_fp, sig of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch["text"], 1 << 20):
                sets = shingle_sets(batch["text"][lo:hi])
                prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                sigs = [signature(s).tobytes() if len(s) else b"" for s in sets]
                yield pa.RecordBatch.from_arrays([batch["doc_id"][lo:hi], pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "set_fp", "sig"])

    return docs.mapInArrow(thrifty(run), "doc_id long, n_shingles long, set_fp binary, sig binary")


def _keys(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                keys = bucket_keys(np.frombuffer(b"".join(part["sig"].to_pylist()), "<u2").reshape(-1, SYMBOLS))
                slots = np.tile(np.arange(keys.shape[1], dtype=np.int32), len(keys))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(slots), pa.array(np.repeat(part["cid"].to_numpy(), keys.shape[1]))], ["key", "slot", "cid"])

    return classes.select("cid", "sig").mapInArrow(thrifty(run), "key long, slot int, cid long")


def _near(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of pairs a, b those that sizes and signatures allow, with their distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sa, sb = (np.frombuffer(b"".join(batch[c].to_pylist()), "<u2").reshape(-1, SYMBOLS) for c in ("sa", "sb"))
            d = (sa != sb).sum(1)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(d.astype(np.int32))], ["a", "b", "distance"]).filter(pa.array(d <= FAR[percent]))

    for x in "ab":
        pairs = pairs.join(classes.select(F.col("cid").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("sig").alias(f"s{x}")), x)
    fits = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    return pairs.where(fits).select("a", "b", "sa", "sb").mapInArrow(thrifty(run), "a long, b long, distance int").groupBy("a", "b").agg(F.min("distance").alias("distance"))


def _sets(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """cid, set of the documents that wanted (cid) names, made again from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch["text"], 1 << 20):
                yield pa.RecordBatch.from_arrays([batch["doc_id"][lo:hi], pa.array([s.tobytes() for s in shingle_sets(batch["text"][lo:hi])], pa.binary())], ["cid", "set"])

    found = by_id(docs, wanted.distinct(), "left_semi").mapInArrow(thrifty(run), "cid long, set binary")
    return staged(docs.sparkSession, found, "sets")


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs a, b those whose full sets are similar enough. sets: cid, set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            on = [_similar(*(np.frombuffer(z.as_buffer(), np.uint64) for z in both), percent) for both in zip(batch["seta"], batch["setb"])]
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(on, pa.bool_()))

    for x in "ab":
        pairs = pairs.join(sets.select(F.col("cid").alias(x), F.col("set").alias(f"set{x}")), x)
    return pairs.select("a", "b", "seta", "setb").mapInArrow(thrifty(run), "a long, b long").distinct()


def _confirmed(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    return _linked(pairs, _sets(pairs.select(F.col("a").alias("cid")).union(pairs.select("b")), docs), percent)


def _placed(frame: DataFrame, after: DataFrame, column: str, name: str) -> DataFrame:
    """frame with the component of a column's class, which without links is itself, as a further column."""
    return frame.join(after.select(F.col("node").alias("_node"), F.col("component").alias("_component")), F.col(column) == F.col("_node"), "left").withColumn(name, F.coalesce("_component", column)).drop("_node", "_component")


def _divided(frame: DataFrame, *by: str) -> DataFrame:
    """The keys `by` under which frame holds several components, with size, the largest component (main) and how many rows are outside it (others)."""
    per = frame.groupBy(*by, "component").agg(F.count(F.lit(1)).alias("n"))
    per = per.groupBy(*by).agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("size"))
    return per.where("top.n < size").select(*by, F.col("top.component").alias("main"), "size", (F.col("size") - F.col("top.n")).alias("others"))


def _held_by(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """star, size, item, n: how many sets of a batch hold a shingle, by star."""
    for batch in batches:
        sets = [np.frombuffer(x.as_buffer(), np.int64) for x in batch["set"]]
        stars, sizes = (np.repeat(batch[c].to_numpy(), [len(s) for s in sets]) for c in ("star", "size"))
        items = np.concatenate([*sets, np.zeros(0, np.int64)])
        order = np.lexsort((items, stars))
        stars, sizes, items = stars[order], sizes[order], items[order]
        first = np.flatnonzero(np.concatenate(([True], (stars[1:] != stars[:-1]) | (items[1:] != items[:-1])))) if len(items) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(stars[first]), pa.array(sizes[first]), pa.array(items[first]), pa.array(np.diff(np.append(first, len(items))))], ["star", "size", "item", "n"])


def _against_usual(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each member's differences from the usual set of its star: how many usual shingles it lacks (lacks), those of them that others lack too, with how many do, and its unusual ones."""
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for own, usual, holders, size in zip(batch["set"], batch["usual"], batch["holders"], batch["size"].to_pylist()):
            own, usual = np.frombuffer(own.as_buffer(), np.int64), usual.values.to_numpy()
            lacks = ~np.isin(usual, own)
            lackers = size - holders.values.to_numpy()[lacks]
            common = lackers > 1
            for column, x in zip(out, (int(lacks.sum()), len(usual), usual[lacks][common], lackers[common], own[~np.isin(own, usual)])):
                column.append(x)
        kinds = (pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3)
        yield pa.RecordBatch.from_arrays([batch["star"], batch["cid"], batch["component"], *(pa.array(x, t) for x, t in zip(out, kinds))], ["star", "cid", "component", "lacks", "usual", "common", "lackers", "unusual"])


def _level(column: str) -> Column:
    """A number no smaller than the column, one of few."""
    x = F.col(column)
    return F.when(x <= 16, x).otherwise(F.greatest(x, F.ceil(F.pow(F.lit(1.25), F.ceil(F.log(1.25, x))))))


def _similar_by_differences(x: np.ndarray, y: np.ndarray, cost: int, usual: int, percent: int) -> bool:
    """Whether two sets of one star reach percent, by their differences from its usual set; cost is the pair's (_lists)."""
    return (100 + percent) * len(np.intersect1d(x, y, assume_unique=True)) + (100 - percent) * usual >= cost


def _lists(held: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Where two members of a star can be similar. held: star, size (its members), cid, component, of stars with several components; sets: cid, set.

    Take U, the shingles that over half of the star's members hold. A member lacks some of U and holds unusual ones
    beside it; with lacks and more the sums of both numbers over a pair, and o the number of differences that the
    two have in common, similarity reaches percent if and only if
        (100 + percent) o + (100 - percent) |U| >= 100 lacks + percent more  (the pair's cost).
    Pairs for which that holds at o = 0 hold it with the member of least cost too: a comparison with that one will do. All others must
    have o differences in common, of those only that a third member might share; so
      - members that no profile of the star (how many such differences at least, cost at least) could satisfy link with nobody new and go;
      - of a member's differences, rarest in the star first, one of all but the last o - 1 is in such a pair.
    Returns members (star, cid, component, cost, usual: how many usual shingles, items: its differences that a third might share) left, and lists (star, item, cid, component, cost): pairs that differ in
    component and can be similar either have the least cost of the star or share a list.
    """
    spark, slack = held.sparkSession, 100 - percent
    members = held.join(sets, "cid")
    counts = members.select("star", "size", "set").mapInArrow(thrifty(_held_by), "star long, size long, item long, n long")
    counts = staged(spark, counts.groupBy("star", "item").agg(F.first("size").alias("size"), F.sum("n").alias("n")).where("n > 1"), "counts")
    empty = F.array().cast("array<long>")
    usual = counts.where("2 * n > size").groupBy("star").agg(F.sort_array(F.collect_list(F.struct("item", "n"))).alias("u"))
    usual = members.join(usual, "star", "left").select("star", "cid", "component", "set", "size", F.coalesce("u.item", empty).alias("usual"), F.coalesce("u.n", empty).alias("holders"))
    schema = "star long, cid long, component long, lacks long, usual long, common array<long>, lackers array<long>, unusual array<long>"
    against = staged(spark, usual.mapInArrow(thrifty(_against_usual), schema), "against")

    shared = against.select("star", "cid", F.explode("unusual").alias("item")).join(counts.where("2 * n <= size").select("star", "item", "n"), ["star", "item"])
    shared = shared.groupBy("star", "cid").agg(F.sort_array(F.collect_list(F.struct("n", "item"))).alias("more"))
    none = F.array().cast("array<struct<n:long,item:long>>")
    own = against.join(shared, ["star", "cid"], "left").select(
        "star", "cid", "component", "usual", (100 * F.col("lacks") + percent * F.size("unusual")).alias("cost"), F.size("common").alias("x"),
        F.coalesce(F.size("more"), F.lit(0)).alias("y"), F.concat(F.arrays_zip(F.col("lackers").alias("n"), F.col("common").alias("item")), F.coalesce("more", none)).alias("items"),
    )
    own = staged(spark, own, "own")
    profiles = own.groupBy("star", _level("x").alias("x"), _level("y").alias("y")).agg(F.min("cost").alias("cost"))
    profiles = profiles.groupBy("star").agg(F.collect_list(F.struct("x", "y", "cost")).alias("profiles"), F.min("cost").alias("least"))
    able = F.expr(f"exists(profiles, p -> {100 + percent} * (least(x, p.x) + least(y, p.y)) + {slack} * usual >= cost + p.cost)")
    own = own.join(profiles, "star").where(able).drop("profiles")
    own = own.join(_divided(own, "star").select("star"), "star", "left_semi")
    own = staged(spark, own, "able")
    needed = F.greatest(F.lit(1), F.ceil((F.col("cost") + F.col("least") - slack * F.col("usual")) / (100 + percent)))
    reach = F.greatest(F.lit(0), F.col("x") + F.col("y") - needed + 1).cast("int")
    lists = own.select("star", "cid", "component", "cost", F.explode(F.slice(F.sort_array("items"), F.lit(1), reach)).alias("d"))
    return own.select("star", "cid", "component", "cost", "usual", F.col("items.item").alias("items")), staged(spark, lists.select("star", F.col("d.item").alias("item"), "cid", "component", "cost"), "lists")


def _candidates(left: np.ndarray, component: np.ndarray, n: np.ndarray, sig: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of a block, each left member with the right ones of other components that sizes and signatures allow."""
    r = np.flatnonzero(~left)
    for k in np.flatnonzero(left):
        o = r[(component[r] != component[k]) & (np.minimum(n[r], n[k]) * 100 >= np.maximum(n[r], n[k]) * percent)]
        on = (sig[o] != sig[k]).sum(1) <= FAR[percent]
        if on.any():
            yield int(k), o[on]


def _values(column: pa.Array) -> list:
    """Python values of a column, but NumPy arrays of lists of numbers."""
    return [x.values.to_numpy() for x in column] if pa.types.is_list(column.type) else column.to_pylist()


def _each_block(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    """Key and rows of each block; rows of one block follow each other."""
    now, held = None, []
    for batch in batches:
        for star, item, i, j, *rest in zip(*(_values(batch[c]) for c in ("star", "item", "i", "j", *columns))):
            if (star, item, i, j) != now:
                if now and any(r[1] for r in held):
                    yield now, list(zip(*held))
                now, held = (star, item, i, j), []
            held.append(rest)
    if now and any(r[1] for r in held):
        yield now, list(zip(*held))


def _in_blocks(opened: DataFrame, able: DataFrame, percent: int) -> DataFrame:
    """Links a, b between members of one list but different components. opened: star, item, cid, component, n_shingles, sig, main (its largest component), size, others (how many are outside that); able: the members of _lists.

    Members outside main are compared with all, in blocks of about BLOCK x BLOCK. A first pass, over signatures, finds which members of a block have anyone to be compared with; only their differences, which say as much as the full sets, go to the
    second, which confirms pairs in place and returns one link for each two components it joins.
    """
    m = opened.withColumn("minor", F.col("component") != F.col("main"))
    rows, columns = F.expr(f"others div {BLOCK} + 1"), F.expr(f"size div {BLOCK} + 1")
    own_row, own_column = F.pmod(F.xxhash64("cid", F.lit(1)), rows), F.pmod(F.xxhash64("cid", F.lit(2)), columns)
    kept = ["cid", "component", "n_shingles", "sig"]
    zero = F.lit(0).cast("long")
    left = m.where("minor").select("star", "item", own_row.alias("i"), F.explode(F.sequence(zero, columns - 1)).alias("j"), *kept, F.lit(True).alias("left"))
    right = m.select("star", "item", F.explode(F.sequence(zero, rows - 1)).alias("i"), own_column.alias("j"), *kept, F.lit(False).alias("left"))
    names = ["cid", "left", "component", "n_shingles", "sig"]

    def arrays(block: list) -> tuple:
        return *(np.array(x) for x in block[1:4]), np.frombuffer(b"".join(block[4]), "<u2").reshape(-1, SYMBOLS)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, block in _each_block(batches, names):
            on = set()
            for k, others in _candidates(*arrays(block), percent):
                on.add(k)
                on.update(others.tolist())
            if on:
                on, n = sorted(on), len(on)
                same = [pa.array([x] * n, pa.int64()) for x in key]
                own = [pa.array([c[k] for k in on], t) for c, t in zip(block, (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([*same, *own], ["star", "item", "i", "j", *names])

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in _each_block(batches, [*names, "cost", "usual", "items"]):
            cid, (cost, usual, items) = block[0], block[5:]
            up = {c: c for c in block[2]}

            def top(c: int) -> int:
                while up[c] != c:
                    c = up[c]
                return c

            a, b = [], []
            for k, others in _candidates(*arrays(block), percent):
                for o in others.tolist():
                    x, y = top(block[2][k]), top(block[2][o])
                    if x != y and _similar_by_differences(items[k], items[o], cost[k] + cost[o], usual[k], percent):
                        up[x] = y
                        a.append(cid[k])
                        b.append(cid[o])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def dealt(frame: DataFrame) -> DataFrame:
        return frame.repartition("star", "item", "i", "j").sortWithinPartitions("star", "item", "i", "j")

    schema = "star long, item long, i long, j long, cid long, left boolean, component long, n_shingles long, sig binary"
    found = staged(opened.sparkSession, dealt(left.unionByName(right)).mapInArrow(thrifty(find), schema), "found")
    return dealt(found.join(able.select("star", "cid", "cost", "usual", "items"), ["star", "cid"])).mapInArrow(thrifty(confirm), "a long, b long").distinct()


def _beyond_stars(members: DataFrame, links: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """links and those between members (star, cid) of one star that are in different components so far."""
    spark = docs.sparkSession
    held = _placed(members, components(links), "cid", "component")
    held = staged(spark, held.join(_divided(held, "star").select("star", "size"), "star"), "held")
    if held.isEmpty():
        return links
    sets = _sets(held.select("cid"), docs)
    able, lists = _lists(held, sets, percent)

    def to_least(frame: DataFrame, *by: str) -> DataFrame:
        frame = frame.select(*by, "cid", "component", "cost")
        least = frame.groupBy(*by).agg(F.min(F.struct("cost", "cid", "component")).alias("z"))
        return frame.join(least, list(by)).where("component != z.component").select(F.least("cid", "z.cid").alias("a"), F.greatest("cid", "z.cid").alias("b"))

    pairs = staged(spark, _near(to_least(able, "star").union(to_least(lists, "star", "item")).distinct(), classes, percent), "pairs")
    links = staged(spark, links.union(_linked(pairs.select("a", "b"), sets, percent)), "links")
    lists = _placed(lists.drop("component", "cost"), components(links), "cid", "component")
    lists = staged(spark, lists.join(_divided(lists, "star", "item"), ["star", "item"]), "opened")
    if lists.isEmpty():
        return links
    return links.union(_in_blocks(lists.join(classes.select("cid", "n_shingles", "sig"), "cid"), able, percent))


def near_groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept. Texts are linked from a similarity of percent (80 or 85) on.

    component_id is the smallest doc_id that links reach, the document's own included. Texts without
    words, null or not, have n_shingles 0 and no link, equal or not. Rows that repeat a
    doc_id are one document with the links of all of them. A null doc_id takes no part in links:
    component_id null, kept. Texts of any length count whole. Other columns of docs are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    signed = staged(spark, _signed(docs), "signed")
    able = signed.where("n_shingles > 0 and doc_id is not null")
    classes = staged(spark, able.groupBy("set_fp").agg(F.min("doc_id").alias("cid"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig")), "classes")

    keys = staged(spark, _keys(classes), "keys")
    chosen = keys.groupBy("key").agg(F.min_by("cid", F.xxhash64("cid")).alias("star"), F.count(F.lit(1)).alias("size")).where("size > 1").select("key", "star")
    members = staged(spark, keys.join(chosen, "key").where("cid != star").select("star", "cid").distinct(), "members")
    stars = staged(spark, _near(members.select(F.least("star", "cid").alias("a"), F.greatest("star", "cid").alias("b")), classes, percent), "stars")

    best = stars.select(F.col("a").alias("x"), "a", "b", "distance").union(stars.select("b", "a", "b", "distance"))
    best = best.groupBy("x").agg(F.min(F.struct("distance", "a", "b")).alias("p")).select("p.a", "p.b").distinct()
    links = staged(spark, _confirmed(staged(spark, best, "best"), docs, percent), "links")
    after = components(links)
    rest = _placed(_placed(stars, after, "a", "ca"), after, "b", "cb").where("ca != cb").select("a", "b").join(best, ["a", "b"], "left_anti")
    links = staged(spark, links.union(_confirmed(staged(spark, rest, "rest"), docs, percent)), "links")
    links = _beyond_stars(members, links, classes, docs, percent)

    # A doc_id with several texts stands in several classes.
    own = able.join(classes.select("set_fp", "cid"), "set_fp").select("doc_id", "cid")
    several = own.groupBy("doc_id").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi")).where("lo < hi").select("doc_id")
    several = own.join(several, "doc_id").select(F.col("doc_id").alias("a"), F.col("cid").alias("b"))
    after = components(links.union(several))

    cids = _placed(classes.select("set_fp", "cid"), after, "cid", "component").select("set_fp", "component")
    out = signed.join(cids, "set_fp", "left")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs, of each group of linked documents the one with the smallest doc_id."""
    return by_id(docs, near_groups(docs, percent).where("not kept").select("doc_id").distinct(), "left_anti")


def op6_hamming_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))
