"""N-gram Jaccard join: an inverted index of shingles, and T-occurrence search by DivideSkip."""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kondate.llm.common import Scratch, broadcast_if_small, give_back, join_by_key, worker_memory

#: Odd constants of the 64-bit mixing functions.
_K = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)]
PAIRS = "leader long, doc_id long"
#: Distinct words whose hashes a worker keeps.
KNOWN_WORDS = 150_000


class WordHash(dict):
    """64-bit hashes of words; starts anew when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _K[3]
    x = (x ^ (x >> np.uint64(29))) * _K[4]
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, words: WordHash, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of `size` words; the whole sequence if it has fewer, none without words."""
    hashed = np.fromiter(map(words.__getitem__, (text or "").encode("utf-8", "replace").lower().split()), "u8")
    if not len(hashed):
        return hashed
    if len(hashed) < size:
        hashed = np.concatenate([hashed, np.full(size - len(hashed), 1, "u8")])
    n = len(hashed) - size + 1
    out = np.zeros(n, "u8")
    for i in range(size):
        out = (out ^ hashed[i : i + n]) * _K[i % 3] + np.uint64(i + 1)
        out ^= out >> np.uint64(31)
    return np.unique(mix(out))


def prefix_length(n: int, share: int) -> int:
    """How many of a set's elements, the first in any order that all sets use, meet those of every set it links with.

    A linked set has at least `share` percent of the n elements, so it can't miss more than the others.
    """
    return n - -(-share * n // 100) + 1


def zone_end(share: int) -> np.uint64:
    """End of the first zone of the hash range: twice the elements of a prefix or so are in it, of which the rarest count."""
    return np.uint64(min((1 << 64) - 2, (1 << 64) * 22 * (100 - share) // 1000) & ~1)  # even, so that halves compare alike


def least_overlap(n: int, m: int, share: int) -> int:
    """The smallest intersection at which sets of n and m elements link: 100 i >= share (n + m - i)."""
    return -(-share * (n + m) // (100 + share))


class InvertedLists:
    """The inverted lists of a block of sets: for each element the places of the sets that hold it, in order."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = [len(x) for x in sets]
        values = np.concatenate(sets) if sets else np.empty(0, "u8")
        order = np.argsort(values, kind="stable")
        self.owners = np.repeat(np.arange(len(sets)), self.sizes)[order].tolist()
        self.elements, starts = np.unique(values[order], return_index=True)
        self.bounds = np.append(starts, len(values))

    def of(self, query: np.ndarray) -> list[tuple[int, int]]:
        """(begin, end) in `owners` of the lists of a query's elements, shortest first; empty ones are left out."""
        at = np.searchsorted(self.elements, query)
        at = at[at < len(self.elements)]  # the query is sorted, so what goes is its end
        at = at[self.elements[at] == query[: len(at)]]
        begin, end = self.bounds[at], self.bounds[at + 1]
        order = np.argsort(end - begin, kind="stable")
        return list(zip(begin[order].tolist(), end[order].tolist(), strict=True))


def divide_skip(index: InvertedLists, query: np.ndarray, share: int, weight: float = 0.01) -> list[int]:
    """Which of the index's sets link with the query: T-occurrence over the inverted lists of its elements.

    The longest lists, as many as DivideSkip's formula says, are left aside. The short ones are merged by a heap; a set
    that occurs in them often enough to reach its overlap is looked up in the long ones by binary search, until it
    has the overlap or can't reach it any more.
    """
    n = len(query)
    lists = index.of(query)
    least = -(-share * n // 100)  # the overlap with the smallest set that can link
    if not lists or len(lists) < least:
        return []
    longest = lists[-1][1] - lists[-1][0]
    long = min(least - 1, int(least / (weight * math.log2(longest + 1) + 1)), len(lists))
    short, skipped = lists[: len(lists) - long], lists[len(lists) - long :][::-1]
    owners, sizes = index.owners, index.sizes
    found: list[int] = []

    def settle(candidate: int, count: int) -> None:
        need = least_overlap(n, sizes[candidate], share)
        have, left = count, long
        for begin, end in skipped:
            if have >= need or have + left < need:
                break
            i = bisect_left(owners, candidate, begin, end)
            have += i < end and owners[i] == candidate
            left -= 1
        if have >= need:
            found.append(candidate)

    current, count = -1, 0
    for i in heapq.merge(*(owners[begin:end] for begin, end in short)):
        if i == current:
            count += 1
            continue
        if current >= 0:
            settle(current, count)
        current, count = i, 1
    if current >= 0:
        settle(current, count)
    return found


def profiles(documents: DataFrame, size: int, share: int) -> DataFrame:
    """doc_id, n_shingles, first (how many in the first zone), digest (of the set), near (elements to post) of every row.

    near: the elements of the first zone, if a whole prefix is in it, else all, as packed 64-bit integers.
    """

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = worker_memory("words", WordHash), zone_end(share)
        for batch in batches:
            for i in range(0, batch.num_rows, 250):
                part = batch.slice(i, 250)
                counts, firsts, digests, near = [], [], [], []
                for text in part.column("text"):
                    found = shingle_set(text.as_py(), words, size)
                    first = int(np.searchsorted(found, end))
                    counts.append(len(found))
                    firsts.append(first)
                    digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                    near.append((found[:first] if first >= prefix_length(len(found), share) else found).tobytes())
                columns = [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(firsts, pa.int64()), pa.array(digests, pa.binary()), pa.array(near, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "first", "digest", "near"])
            give_back()

    return documents.mapInArrow(profile, "doc_id long, n_shingles long, first long, digest binary, near binary")


#: Documents of a sample that shows which elements are hot, and the most hot elements. Both only steer how rows are dealt.
SAMPLE, HOT = 20_000, 4096
#: Parts into which the list of a hot element is dealt.
HOT_PARTS = 64


def hot_elements(sets: DataFrame, rows: int) -> np.ndarray:
    """Sorted elements that half a percent of a sample of the sets hold, as far as HOT allows."""
    every = max(1, rows // SAMPLE)
    some = sets.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
    many = postings(some, np.empty(0, "i8")).groupBy("element").agg(F.count("*").alias("n")).where(F.col("n") >= max(20, rows // every // 200))
    return np.array(sorted(r["element"] for r in many.orderBy(F.desc("n")).limit(HOT).collect()), "i8")


def postings(sets: DataFrame, hot: np.ndarray) -> DataFrame:
    """element, doc_id, part: the inverted index of sets (doc_id, elements); part is 0 but for hot elements."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, ids, rows = [], [], 0
            for doc_id, packed in zip(batch.column("doc_id").to_pylist(), batch.column("elements"), strict=True):
                held.append(np.frombuffer(packed.as_py(), "i8"))
                ids.append(doc_id)
                rows += len(held[-1])
                if rows > 200_000:
                    yield posted(ids, held)
                    held, ids, rows = [], [], 0
            if held:
                yield posted(ids, held)

    def posted(ids: list[int], held: list[np.ndarray]) -> pa.RecordBatch:
        element, doc_id = np.concatenate(held), np.repeat(np.array(ids, "i8"), [len(h) for h in held])
        part = np.zeros(len(element), "i4")
        if len(hot):
            at = np.minimum(np.searchsorted(hot, element), len(hot) - 1)
            part = np.where(hot[at] == element, 1 + (mix(doc_id.view("u8")) % np.uint64(HOT_PARTS)).astype("i4"), 0).astype("i4")
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (element, doc_id, part)], ["element", "doc_id", "part"])

    return sets.select("doc_id", "elements").mapInArrow(post, "element long, doc_id long, part int")


#: List lengths from here on count as equal in the order of elements.
LONG_LIST = 1 << 16


def shared_elements(posted: DataFrame) -> DataFrame:
    """element, doc_id, length: the inverted lists of two documents or more, with their lengths.

    Rows come sorted by element and are read as a stream; what is held of a list that goes on is bounded, since
    lengths from LONG_LIST on are all the same. The list of a hot element is dealt to several tasks and counts as long.
    """

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_e, held_d, held_p, long = np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0, "i4"), None

        def out(e: np.ndarray, d: np.ndarray, p: np.ndarray, last: bool) -> tuple[pa.RecordBatch, int]:
            nonlocal long
            if not len(e):
                return _lists(e, d, d), 0
            starts = np.flatnonzero((np.diff(e, prepend=~e[0]) != 0) | (np.diff(p, prepend=p[0]) != 0))
            sizes = np.diff(starts, append=len(e))
            sizes = np.minimum(np.where((p[starts] > 0) | (e[starts] == long if long is not None else False), LONG_LIST, sizes), LONG_LIST)
            cut = len(e) if last or sizes[-1] == LONG_LIST else starts[-1]
            if not last:
                long = int(e[-1]) if sizes[-1] == LONG_LIST else None
            length = np.repeat(sizes, np.diff(starts, append=len(e)))
            keep = length[:cut] > 1
            return _lists(e[:cut][keep], d[:cut][keep], length[:cut][keep]), cut

        for batch in batches:
            held_e, held_d, held_p = (np.concatenate([h, batch.column(c).to_numpy()]) for h, c in ((held_e, "element"), (held_d, "doc_id"), (held_p, "part")))
            found, cut = out(held_e, held_d, held_p, False)
            held_e, held_d, held_p = held_e[cut:], held_d[cut:], held_p[cut:]
            yield found
        yield out(held_e, held_d, held_p, True)[0]

    return posted.repartition("element", "part").sortWithinPartitions("element", "part", "doc_id").mapInArrow(lists, "element long, doc_id long, length int")


def _lists(e: np.ndarray, d: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(e, pa.int64()), pa.array(d, pa.int64()), pa.array(n.astype("i4"), pa.int32())], ["element", "doc_id", "length"])


def reached(shared: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """element, doc_id: of each set, the elements of its prefix that any other set has.

    Elements that only one document has come first in its prefix and find nothing. So a document with more of them
    than a linked set may miss has no rows here at all.
    """
    end = int(zone_end(share))
    far = (F.shiftrightunsigned("element", 1) >= end >> 1).cast("int")  # order of unsigned numbers
    window = Window.partitionBy("doc_id", "far")
    known = shared.withColumn("far", far).join(sets, "doc_id")
    ranked = known.withColumn("place", F.row_number().over(window.orderBy("length", "element"))).withColumn("many", F.count("*").over(window))
    spare = F.when(F.col("far") == 0, F.greatest(F.lit(0), F.col("first") - _prefix(share))).otherwise(F.col("n") - _prefix(share))
    return ranked.where(F.col("place") <= F.col("many") - F.coalesce(spare, F.lit(0))).select("element", "doc_id")


def short_lists(shared: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """element, doc_id, n, place: the same from a whole index, with the element's place in its set's order, rarest first.

    The elements of passages that very many share are the long lists, which come last and stay out of the prefixes.
    """
    window = Window.partitionBy("doc_id")
    ranked = shared.join(sets, "doc_id").withColumn("rank", F.row_number().over(window.orderBy("length", "element"))).withColumn("many", F.count("*").over(window))
    place = F.col("n") - F.col("many") + F.col("rank")  # behind the elements that no other set has
    return ranked.withColumn("place", place).where(F.coalesce(F.col("place") <= _prefix(share), F.lit(True))).select("element", "doc_id", "n", "place")


def _prefix(share: int) -> Column:
    return F.col("n") - F.ceil(F.col("n") * share / F.lit(100)) + 1


def _may_link(share: int, n: Column, i: Column, m: Column, j: Column) -> Column:
    """Whether sets of n and m elements can link if an element at places i and j is the first that they share."""
    least = F.ceil((n + m) * share / F.lit(100 + share))
    return F.coalesce((1 + F.least(n - i, m - j) >= least) & (F.least(n, m) >= least), F.lit(True))


def in_lists(index: DataFrame, scratch: Scratch) -> DataFrame:
    """element, doc_id, n, place, and leader, leader_n, leader_place of the list: the first of it in its set's order."""
    first = index.groupBy("element").agg(F.min(F.struct(F.coalesce("place", F.lit(0)).alias("place"), F.col("doc_id").alias("leader"), F.col("n").alias("leader_n"))).alias("x"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("held"))
    heads = first.where("a < b").select("element", "x.leader", "x.leader_n", F.col("x.place").alias("leader_place"), "held")
    return scratch.table(join_by_key(index, scratch.table(heads, "heads"), ["element"], "held"), "in-lists")


def across(lists: DataFrame, labels: DataFrame, share: int, scratch: Scratch, part_rows: int = 4096) -> DataFrame:
    """leader, doc_id: the pairs of a list that may link and are in different components.

    Only documents outside a list's commonest component are joined with the list, so a component of any size isn't
    paired with itself. A long list is dealt in parts of about `part_rows`, which those documents all meet.
    """
    rows = lists.join(labels, "doc_id", "left").select("element", "doc_id", "n", "place", F.coalesce("label", "doc_id").alias("label"))
    rows = scratch.table(rows, "labelled")
    sums = rows.groupBy("element", "label").agg(F.count("*").alias("c"))
    top = sums.groupBy("element").agg(F.max(F.struct("c", "label")).alias("x"), F.count("*").alias("labels"), F.sum("c").alias("held"))
    top = scratch.table(top.where("labels > 1").select("element", F.col("x.label").alias("top"), "held"), "top")
    mixed = join_by_key(rows, top, ["element"], "held").withColumn("parts", F.ceil(F.col("held") / F.lit(part_rows)).cast("int"))
    few = mixed.where("label <> top").select("element", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("doc_id").alias("d2"), F.col("n").alias("n2"), F.col("place").alias("p2"), F.col("label").alias("l2"))
    may = (F.col("label") != F.col("l2")) & _may_link(share, F.col("n"), F.col("place"), F.col("n2"), F.col("p2"))
    met = mixed.withColumn("part", F.pmod(F.xxhash64("doc_id"), "parts").cast("int")).join(few, ["element", "part"]).where(may)
    return met.select(F.least("doc_id", "d2").alias("leader"), F.greatest("doc_id", "d2").alias("doc_id")).distinct()


def sets_of(documents: DataFrame, size: int) -> DataFrame:
    """doc_id, elements: the shingle hashes, sorted, as packed 64-bit integers."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_memory("words", WordHash)
        for batch in batches:
            for i in range(0, batch.num_rows, 250):
                part = batch.slice(i, 250)
                found = [shingle_set(t.as_py(), words, size).tobytes() for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.binary())], ["doc_id", "elements"])
            give_back()

    return documents.mapInArrow(pack, "doc_id long, elements binary")


def linked(pairs: DataFrame, sets: DataFrame, share: int, chunk: int = 128, block: int = 1 << 18) -> DataFrame:
    """Those that link: pairs (leader, doc_id) found among the candidate pairs.

    Leaders and their candidates, in parts of about `chunk`, stream by in order. The candidates of parts that follow
    each other are gathered to about `block` elements, of which one inverted index is built, and every leader of
    those parts is a query to it. So a task holds a block and the sets of its leaders, whatever a leader's candidates.
    """
    many = pairs.groupBy("leader").agg(F.ceil(F.count("*") / F.lit(chunk)).cast("int").alias("parts"))
    dealt = pairs.join(many, "leader").select("leader", "doc_id", F.pmod(F.xxhash64("doc_id"), "parts").alias("part"))
    heads = many.select("leader", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("part")).join(sets.withColumnRenamed("doc_id", "leader"), "leader")
    rows = dealt.join(sets, "doc_id").select("leader", "part", "doc_id", "elements").unionByName(heads.select("leader", "part", F.lit(None).cast("long").alias("doc_id"), "elements"))
    grouped = rows.repartition("leader", "part").sortWithinPartitions("leader", "part", F.asc_nulls_first("doc_id"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, asked, ids, sets_, held = None, [], [], [], 0

        def flush() -> list[tuple[int, int]]:
            index = InvertedLists(sets_)
            return [(leader, ids[i]) for leader, query in asked for i in divide_skip(index, query, share)]

        for batch in batches:
            out = []
            for leader, part, doc_id, elements in (row for i in range(0, batch.num_rows, 64) for row in zip(*(batch.slice(i, 64).column(c).to_pylist() for c in ("leader", "part", "doc_id", "elements")), strict=True)):
                if (leader, part) != key:
                    if held > block:
                        out += flush()
                        asked, ids, sets_, held = [], [], [], 0
                    key = (leader, part)
                if doc_id is None:
                    asked.append((leader, np.frombuffer(elements, "u8")))
                else:
                    ids.append(doc_id)
                    sets_.append(np.frombuffer(elements, "u8"))
                    held += len(sets_[-1])
            yield _pairs(out)
        yield _pairs(flush())

    return grouped.mapInArrow(search, PAIRS)


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[], []]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["leader", "doc_id"])


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """doc_id, label: the smallest doc_id of each connected component, by alternating large and small stars."""
    edges = scratch.table(links.select(F.greatest("leader", "doc_id").alias("u"), F.least("leader", "doc_id").alias("v")).where("u <> v").distinct(), f"{name}-0")
    state, turn = None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = join_by_key(both, scratch.table(least, f"{name}-least-{turn}"), ["u"], "n").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        turn += 1
        edges = scratch.table(small, f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("label"))
        state = now


def link_components(documents: DataFrame, size: int = 3, share: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    Words are what stands between ASCII white space, with A-Z in lower case. Documents link when the Jaccard
    similarity of their sets of `size`-word shingles is at least `share` percent; component_id is the smallest doc_id
    reachable by links. A null or empty text has no shingles and links with nothing. Rows that repeat a doc_id are one
    document: what links with one of its texts links with the other. An empty table gives an empty result.

    Equal sets are linked by their digests. For the others an inverted index from shingles to documents is built and
    sorted by shuffling, first of a part of the hash range that shows which documents can't link with any other, then
    whole for the rest. Each set looks for partners only in the lists of its prefix, the shortest that suffice. In a
    list every document is first a candidate with the one that has the list's element earliest in its order; where
    documents of a list are then still in different components, the pairs across components are candidates as well,
    so that no link is lost, while copies of one text are never paired among themselves. What links is decided by
    T-occurrence: candidates are gathered in blocks, each with inverted lists of its own, which DivideSkip searches
    for the sets of their leaders, merging short lists by a heap and probing long ones.
    """
    scratch = Scratch(documents.sparkSession, "ngram-join")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    narrow = scratch.table(profiles(rows, size, share), "profiles")
    some = narrow.where("n_shingles > 0 and doc_id is not null").drop("near")
    classes = some.groupBy("digest").agg(F.min("doc_id").alias("leader"), F.count("*").alias("copies")).where("copies > 1")
    classes = scratch.table(classes, "classes")
    some = scratch.table(some, "some")
    equal = join_by_key(some, classes, ["digest"], "copies").where("doc_id <> leader").select("leader", "doc_id").distinct()
    equal = scratch.table(equal, "equal")
    leading = join_by_key(some.join(equal, "doc_id", "left_semi"), classes, ["digest"], "copies", "left").where("leader is null or leader = doc_id").select("doc_id")
    gone = scratch.table(equal.select("doc_id").distinct().join(leading, "doc_id", "left_anti"), "gone")
    one = F.min("digest") == F.max("digest")  # else the doc_id has several texts, and all their elements count
    counts = some.groupBy("doc_id").agg(F.when(one, F.max("n_shingles")).alias("n"), F.when(one, F.max("first")).alias("first"))
    away = broadcast_if_small(gone, gone.count())
    alone = narrow.where("n_shingles > 0 and doc_id is not null").select("doc_id", F.col("near").alias("elements")).join(away, "doc_id", "left_anti")
    part = scratch.table(shared_elements(postings(alone, hot_elements(alone, alone.count()))), "part")
    near = scratch.table(reached(part, counts, share), "near")
    scratch.drop("part")
    ends = near.groupBy("element").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("held")).where("a < b").select("element", "held")
    held = scratch.table(join_by_key(near, scratch.table(ends, "ends"), ["element"], "held").select("doc_id").distinct(), "held")
    scratch.drop("near", "ends")
    few = held.count()
    may = rows.where("doc_id is not null").join(away, "doc_id", "left_anti").join(broadcast_if_small(held, few), "doc_id", "left_semi")
    sets = scratch.table(sets_of(may, size), "sets")
    whole = scratch.table(shared_elements(postings(sets, hot_elements(sets, few))), "whole")
    index = scratch.table(short_lists(whole, counts.select("doc_id", "n"), share), "index")
    scratch.drop("whole")
    lists = in_lists(index, scratch)
    scratch.drop("index", "heads")
    fits = (F.col("doc_id") != F.col("leader")) & _may_link(share, F.col("n"), F.col("place"), F.col("leader_n"), F.col("leader_place"))
    star = scratch.table(lists.where(fits).select(F.least("leader", "doc_id").alias("leader"), F.greatest("leader", "doc_id").alias("doc_id")).distinct(), "star")
    links = scratch.table(linked(star, sets, share).unionByName(equal), "links")
    found = components(links, scratch, "stars")
    rest = scratch.table(across(lists, found, share, scratch).join(star, ["leader", "doc_id"], "left_anti"), "rest")
    final = components(links.unionByName(linked(rest, sets, share)), scratch, "all")
    scratch.drop("sets", "in-lists", "labelled")
    out = narrow.select("doc_id", "n_shingles").join(final, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))
