"""N-gram Jaccard join with set-relation skipping.

A text's set holds the 64-bit hashes of its distinct word shingles. Texts with equal sets form one class; only classes are
joined, in three steps.

1. Which sets can link at all. Of a set's elements in the order of their hashes only the first few matter: as many as a
   linked set can lack, and ``SPARE`` of the size more. Two linked sets share at least the spare ones of the smaller among
   these, so a set stays if that many of its first elements occur in other sets. Tasks send such elements packed, five bytes
   and the set's number each, and an element that several of their sets have only once.
2. Index lists over the sets that stay. Elements are ordered by frequency, rare ones first, and each set is listed under
   its first few elements with its size and the element's place. Lists are joined block by block of equal size and place;
   a block pair whose places leave too few elements to share is skipped as a whole.
3. Answers from answers. A set is first compared with one pivot of its lists. What links to a pivot is in its component,
   and two sets of one component are not compared again. For sets similar to the same pivot p the overlap follows from
   what they lack of p and have besides it: ``|x & y| = |p| - |p - x| - |p - y| + |(p - x) & (p - y)| + |(x - p) & (y - p)|``.
   For others it is bounded: ``|x & y| <= min(|x & p|, |y & p|) + min(|x - p|, |y - p|)``.

The filters lose no link, whatever the data: the first by counting, the others by bounds. No list is
collected: pivots are minima, pairs are rows, and long lists shrink by merging and skipping, not by a cap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.tokens import SPACED, U64, find_words, grams, mix, row_count, settled, text_slices

SPARE = 0.1  # part of a set's size by which its first elements exceed what a linked set can lack
BUCKET_BYTES = 32 << 20  # packed elements that one task compares at a time
STAR_ROUNDS = 6  # at most; the rest is compared pair by pair
BROADCAST_ROWS = 1 << 20  # ids (8 bytes each) broadcast at most
FEW = 0.05  # a round that links a smaller share of what it compares is the last one
_I64 = np.int64
_KEY_BITS = 39  # of an element within its bucket; the bit above tells that a task had it in several sets


def spare_of(sizes: np.ndarray) -> np.ndarray:
    """Elements that linked sets of these sizes share at least among their first ones."""
    return np.maximum(1, (sizes * SPARE).astype(_I64))


def first_elements(sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """How many first elements of sets of these sizes matter, and how many of them must occur in other sets.

    Let x and y link, sharing c elements: ``c >= ceil(percent * n / 100)`` for the size n of either. The s-th shared one, for
    any ``s <= c``, has at most ``n - c`` others before it, so it is among the first ``n - ceil(percent * n / 100) + s`` of
    both. The smallest set that links with x has ``ceil(percent * n / 100)`` elements, which gives the least s.
    """
    kept = -(-sizes * percent // 100)
    return np.minimum(sizes, sizes - kept + spare_of(sizes)), spare_of(kept)


def shingle_sets(data: np.ndarray, borders: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts of a slice, with the borders between the texts.

    A text of fewer words has its whole sequence as one shingle; a text without words has none.
    """
    words = find_words(data, borders, SPACED)
    rows = len(borders) - 1
    count = np.bincount(words.row, minlength=rows)
    found = []
    for n in range(1, size + 1):
        value, first = grams(words.hash, words.row, n)
        row = words.row[first]
        if n < size:
            short = count[row] == n
            value, row = value[short], row[short]
        found.append((value, row))
    value, row = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[keep], row[keep]
    return value, np.searchsorted(row, np.arange(rows + 1))


def _set_numbers(value: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """A 64-bit number per set; different sets share one with probability about 2**-64."""
    total = np.zeros(len(value) + 1, U64)
    np.cumsum(mix(value ^ U64(0x1234567)), out=total[1:])
    return mix(total[borders[1:]] - total[borders[:-1]] + np.diff(borders).astype(U64)).view(_I64)


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))


def index_sets(docs: DataFrame, words: int) -> DataFrame:
    """Per text: ``doc_id``, the size of its set and the number of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, borders in text_slices(batch.column("text")):
                value, cut = shingle_sets(data, borders, words)
                columns = [batch.column("doc_id").slice(first, end - first), pa.array(np.diff(cut).astype(_I64)), pa.array(_set_numbers(value, cut))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "set"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, n bigint, `set` bigint")


def _packed(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8")[:, 0]


def _send_elements(docs: DataFrame, words: int, percent: int, buckets: int) -> DataFrame:
    """``known, bucket, keys, sets, need``: packed first elements by bucket, and (``known``) what is counted already.

    In a row that is not ``known``, ``keys`` are elements and ``sets`` the numbers of their sets. In the others, ``sets`` are
    sets of one slice, ``keys`` 32-bit counts of elements that they share within it, and ``need`` how many each must share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, borders in text_slices(batch.column("text")):
                value, cut = shingle_sets(data, borders, words)
                numbers, sizes = _set_numbers(value, cut), np.diff(cut)
                _, some = np.unique(np.where(sizes > 0, numbers, 0), return_index=True)
                some = np.sort(some[sizes[some] > 0])  # equal texts of a slice count once
                if not len(some):
                    continue
                length, need = first_elements(sizes[some], percent)
                own = np.repeat(np.arange(len(some)), length)
                at = np.repeat(cut[some], length) + np.arange(len(own)) - np.repeat(np.cumsum(length) - length, length)
                key = mix(value[at])
                order = np.argsort(key, kind="stable")
                key, own = key[order], own[order]
                begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                members = np.diff(np.append(begin, len(key)))
                shared = np.repeat(members > 1, members)
                counted = np.bincount(own[shared], minlength=len(some))
                several = (members > 1).astype(U64) << U64(_KEY_BITS)
                key, own = key[begin], own[begin]
                bucket = ((key >> U64(40)) % U64(buckets)).astype(np.int32)
                packed = key & U64((1 << _KEY_BITS) - 1) | several
                order = np.argsort(bucket, kind="stable")
                bucket, packed, sets = bucket[order], packed[order], numbers[some][own[order]]
                starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                ends = np.append(starts[1:], len(bucket))
                spread = int(numbers[some[0]]) % buckets
                rows = [(False, int(bucket[a]), _packed(packed[a:b]), sets[a:b].astype("<i8").tobytes(), b"") for a, b in zip(starts.tolist(), ends.tolist())]
                rows.append((True, spread, counted.astype("<i4").tobytes(), numbers[some].astype("<i8").tobytes(), need.astype("<i4").tobytes()))
                kinds = [pa.bool_(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["known", "bucket", "keys", "sets", "need"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "known boolean, bucket int, keys binary, sets binary, need binary")


def _count_bucket(table: pa.Table) -> pa.Table:
    """``set, sent, counted, need`` of one group of :func:`_send_elements`."""
    join = lambda name: b"".join(table.column(name).to_pylist())
    sets = np.frombuffer(join("sets"), "<i8")
    if table.column("known")[0].as_py():
        counted, need = np.frombuffer(join("keys"), "<i4"), np.frombuffer(join("need"), "<i4")
        return pa.table({"set": pa.array(sets), "sent": pa.array(np.zeros(len(sets), _I64)), "counted": pa.array(counted.astype(_I64)), "need": pa.array(need.astype(_I64))})
    packed = _unpacked(join("keys"))
    key, several = packed & U64((1 << _KEY_BITS) - 1), (packed >> U64(_KEY_BITS)).astype(bool)
    order = np.lexsort((sets, key))
    key, several, sets = key[order], several[order], sets[order]
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    sizes = np.diff(np.append(begin, len(key)))
    # an element is shared if a slice had it in several sets or two different sets sent it
    shared = np.logical_or.reduceat(several, begin) | (sets[begin] != sets[begin + sizes - 1])
    fresh = np.append(True, (key[1:] != key[:-1]) | (sets[1:] != sets[:-1]))
    hit, count = np.unique(sets[np.repeat(shared, sizes) & fresh & ~several], return_counts=True)
    return pa.table({"set": pa.array(hit), "sent": pa.array(count.astype(_I64)), "counted": pa.nulls(len(hit), pa.int64()), "need": pa.nulls(len(hit), pa.int64())})


def sets_that_may_link(docs: DataFrame, words: int, percent: int, elements: int) -> DataFrame:
    """Numbers of the sets that share enough of their first elements with other sets; ``elements``: of all sets together."""
    sent = int(elements * ((100 - percent) / 100 + SPARE)) * 13  # bytes
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(2 * tasks, sent // BUCKET_BYTES + 1)
    counts = _send_elements(docs, words, percent, buckets).groupBy("known", "bucket").applyInArrow(_count_bucket, "`set` bigint, sent bigint, counted bigint, need bigint")
    # a set with copies in several slices is counted in each: the largest of these counts is one that is complete with what was sent
    total = counts.groupBy("set").agg(F.sum("sent").alias("sent"), F.max("counted").alias("counted"), F.max("need").alias("need"))
    return total.where("sent + counted >= need").select("set")


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """Per row of ``(set, text)``: the sorted shingle hashes of the text, if it has this set. A null set takes any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, borders in text_slices(batch.column("text")):
                value, cut = shingle_sets(data, borders, words)
                part = batch.slice(first, end - first)
                numbers = _set_numbers(value, cut)
                wanted = part.column("set")
                same = wanted.is_null().to_numpy(zero_copy_only=False) | (wanted.fill_null(0).to_numpy() == numbers)
                counts = np.diff(cut)
                out = pa.RecordBatch.from_arrays(
                    [pa.array(numbers), pa.array(counts.astype(_I64)), _lists(value.view(_I64), counts)],
                    names=["set", "n", "items"],
                )
                yield out.filter(pa.array(same))

    return docs.select("set", F.col("text").cast("string")).mapInArrow(run, "`set` bigint, n bigint, items array<bigint>")


def merge_labels(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from each node of ``edges(a, b)``: ``(node, root)``.

    Each node hooks onto its smallest smaller neighbour, chains are shortened by doubling, and edges between different
    roots go round again; the number of rounds is logarithmic in the longest chain.
    """
    a, b = F.col("a"), F.col("b")
    left = settled(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where(F.col("a") != F.col("b")).distinct(), "edges")
    known = None
    while not left.isEmpty():
        hook = left.groupBy(b.alias("node")).agg(F.min("a").alias("root"))
        while True:
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("above"))
            step = hook.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved"))
            step = settled(step, "hooks")
            hook = step.drop("moved")
            if step.where("moved").isEmpty():
                break
        if known is None:
            known = hook
        else:
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("above"))
            known = known.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root")).unionByName(hook)
        known = settled(known, "roots")
        to = hook.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        tb = hook.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = left.join(to, "a", "left").join(tb, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        left = settled(moved.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if known is None:
        return left.select(a.alias("node"), b.alias("root"))
    return settled(known.unionByName(known.select(F.col("root").alias("node"), "root").distinct()), "labels")


_TRIED = "x bigint, y bigint, nx bigint, ny bigint, common bigint, lacks array<bigint>, extra array<bigint>"


def _compare(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets with their sizes and overlap, and for similar ones what ``x`` lacks of ``y`` and has besides it."""
    x = sets.select(F.col("set").alias("x"), F.col("n").alias("nx"), F.col("items").alias("ix"))
    y = sets.select(F.col("set").alias("y"), F.col("n").alias("ny"), F.col("items").alias("iy"))
    common = F.size(F.array_intersect("ix", "iy")).cast("bigint").alias("common")
    both = pairs.join(x, "x").join(y, "y").select("x", "y", "nx", "ny", common, "ix", "iy")
    total = F.col("nx") + F.col("ny")
    similar = (total - 2 * F.col("common")) * (100 + percent) <= total * 3 * (100 - percent)
    lacks, extra = F.when(similar, F.array_except("iy", "ix")), F.when(similar, F.array_except("ix", "iy"))
    return both.select("x", "y", "nx", "ny", "common", lacks.alias("lacks"), extra.alias("extra"))


def _linked(common, union, percent: int):
    return common * 100 >= union * percent


def prefix_lists(sets: DataFrame, percent: int) -> DataFrame:
    """``key, set, n, at``: the index. Elements in order of their frequency, rare ones first; linked sets share one of the
    first ``n - ceil(percent * n / 100) + 1``. ``at`` is the element's place in the set, ``n`` the set's size."""
    items = sets.select("set", "n", F.explode("items").alias("key"))
    counts = items.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    order = Window.partitionBy("set").orderBy("members", "key")
    placed = items.join(counts, "key").withColumn("nth", F.row_number().over(order)).withColumn("common", F.count(F.lit(1)).over(Window.partitionBy("set")))
    # elements of no other set come before all others and have no list
    at = F.col("n") - F.col("common") + F.col("nth") - 1
    longest = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    return settled(placed.withColumn("at", at).where(F.col("at") < longest).select("key", "set", "n", "at"), "lists")


def _labelled(lists: DataFrame, label: DataFrame) -> DataFrame:
    return lists.join(label.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))


def _open_lists(member: DataFrame) -> DataFrame:
    """``key, members, apart, main``: lists with several components, the pairs between these, and the largest one."""
    parts = member.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    return (
        parts.groupBy("key")
        .agg(
            F.sum("n").alias("members"),
            ((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("apart"),
            F.max(F.struct("n", "root"))["root"].alias("main"),
        )
        .where("apart > 0")
    )


def _joined_blocks(member: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Entries of the lists ``member(key, set, n, at, root, main)`` that meet, as x with the blocks of y to join, and as y.

    Lists are joined block by block of equal size and place; blocks are skipped that cannot share enough from their places
    on. Entries outside the list's largest component are x, all are y, and neither side holds entries of skipped blocks.
    """
    x, y = (member.select("key", "main", *[F.col(c).alias(f"{c}_{s}") for c in ("set", "root", "n", "at")]) for s in "xy")
    x, y = x.where("root_x != main"), y.drop("main")
    most = F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y"))
    blocks = x.select("key", "n_x", "at_x").distinct().join(y.select("key", "n_y", "at_y").distinct(), "key")
    blocks = settled(blocks.where(_linked(most, F.col("n_x") + F.col("n_y") - most, percent)), "blocks")
    return x.join(blocks, ["key", "n_x", "at_x"]), y.join(blocks, ["key", "n_y", "at_y"], "left_semi")


def _link_sets(lists: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(set, root)`` of the sets that link with another one, by the index ``lists(key, set, n, at)``."""
    spark = lists.sparkSession
    union = F.col("nx") + F.col("ny") - F.col("common")
    tried = spark.createDataFrame([], _TRIED)
    label = spark.createDataFrame([], "node bigint, root bigint")
    merged = True
    for turn in range(STAR_ROUNDS):
        member = _labelled(lists, label)
        still = settled(_open_lists(member), "open")
        todo, total = still.agg(F.sum("apart"), F.sum("members")).first()
        if not todo:
            return label.select(F.col("node").alias("set"), "root")
        member = settled(member.join(still.select("key", "main"), "key"), "members")
        lists = member.select("key", "set", "n", "at")
        if todo <= total or not merged:
            break
        # one pivot per list, from its largest component; each other set takes one of the pivots of its lists
        rank = F.xxhash64(F.col("set"), F.lit(turn))
        pivots = (
            member.where("root = main")
            .groupBy("key")
            .agg(F.min(F.struct(rank.alias("rank"), F.col("set").alias("pivot"))).alias("best"))
            .select("key", "best.*")
        )
        offers = member.where("root != main").join(pivots, "key")
        pairs = offers.groupBy("set").agg(F.min(F.struct("rank", "pivot"))["pivot"].alias("y")).select(F.col("set").alias("x"), "y")
        new = settled(_compare(pairs, sets, percent), "compared")
        links = new.where(_linked(F.col("common"), union, percent)).select(F.col("x").alias("a"), F.col("y").alias("b"))
        tried = tried.unionByName(new)
        found = row_count(links)
        merged = found > FEW * row_count(new)
        if found:
            label = merge_labels(links.unionByName(label.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    else:
        member = _labelled(lists, label)
        member = settled(member.join(_open_lists(member).select("key", "main"), "key"), "members")
    # What is left: pairs in different components, one of the two outside the list's largest. What sets lack of a pivot and
    # have besides it outweighs their places in the lists by far, so it goes only with places in blocks that are joined.
    none = F.array().cast("array<bigint>")
    facts = ["common", "lacks", "extra"]
    seen = tried.select(F.col("x").alias("set"), F.col("y").alias("pivot"), F.col("ny").alias("size"), *facts).unionByName(
        tried.groupBy("y").agg(F.max("ny").alias("size")).select(
            F.col("y").alias("set"), F.col("y").alias("pivot"), "size", F.col("size").alias("common"), none.alias("lacks"), none.alias("extra")
        )
    )
    seen = settled(seen.groupBy("set").agg(F.collect_list(F.struct("pivot", "size", *facts)).alias("seen")), "seen")  # one element a round
    x, y = _joined_blocks(member, percent)
    x, y = (side.join(seen.select(F.col("set").alias(f"set_{s}"), F.col("seen").alias(f"seen_{s}")), f"set_{s}", "left") for side, s in ((x, "x"), (y, "y")))

    def excluded(a: Column, b: Column) -> Column:
        """Whether the answers for a common pivot leave no room for a link, or tell the overlap and it is too small."""
        shared = lambda name: F.size(F.array_intersect(a[name], b[name]))
        exact = a["size"] - F.size(a["lacks"]) - F.size(b["lacks"]) + shared("lacks") + shared("extra")
        bound = F.least(a["common"], b["common"]) + F.least(F.col("n_x") - a["common"], F.col("n_y") - b["common"])
        most = F.when(a["lacks"].isNotNull() & b["lacks"].isNotNull(), exact).otherwise(bound)
        return (a["pivot"] == b["pivot"]) & ~_linked(most, F.col("n_x") + F.col("n_y") - most, percent)

    possible = ~F.coalesce(F.exists("seen_x", lambda a: F.exists("seen_y", lambda b: excluded(a, b))), F.lit(False))
    pairs = (
        x.join(y, ["key", "n_y", "at_y"])
        .where((F.col("root_x") != F.col("root_y")) & ((F.col("root_y") == F.col("main")) | (F.col("set_x") < F.col("set_y"))))
        .where(possible)
        .select(F.least("set_x", "set_y").alias("x"), F.greatest("set_x", "set_y").alias("y"))
        .distinct()
    )
    links = _compare(settled(pairs, "pairs"), sets, percent).where(_linked(F.col("common"), union, percent))
    links = links.select(F.col("x").alias("a"), F.col("y").alias("b"))
    label = merge_labels(links.unionByName(label.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    return label.select(F.col("node").alias("set"), "root")


def _chosen_sets(docs: DataFrame, chosen: DataFrame, words: int) -> DataFrame:
    """``set, n, items`` of the chosen sets, each read from one text: that of its smallest id where the id has no other.

    Sets without such an id (rows without an id, ids with several chosen sets) are found by their number among the sets of
    all rows with these ids, so that no row meets more than one of them.
    """
    per_id = chosen.groupBy("first_doc").agg(F.min("set").alias("set"), F.count(F.lit(1)).alias("many"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    single = per_id.where("many = 1 AND first_doc IS NOT NULL").select(F.col("first_doc").alias("doc_id"), "set")
    small = row_count(chosen) <= BROADCAST_ROWS
    found = full_sets(texts.join(F.broadcast(single) if small else single, "doc_id").select("set", "text"), words)
    other = per_id.where("many > 1 OR first_doc IS NULL").select(F.col("first_doc").alias("other_id"))
    if not other.isEmpty():
        same = texts["doc_id"].eqNullSafe(other["other_id"])
        rows = texts.join(F.broadcast(other) if small else other, same, "left_semi").select(F.lit(None).cast("bigint").alias("set"), "text")
        found = found.unionByName(full_sets(rows, words).join(chosen.select("set"), "set", "left_semi"))
    return found.dropDuplicates(["set"])


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Components of texts linked by ``100 * common >= percent * union`` of their sets of word shingles.

    ``docs(doc_id, text)``; other columns are ignored. Returns one row per input row: ``doc_id``, ``n_shingles`` and
    ``component_id``, the smallest doc_id reachable by links. Words stand between ASCII white space, A-Z count as a-z.
    Null and empty texts have no shingles and link with nothing; their component is their own doc_id. Repeated rows link
    with each other. A null doc_id takes part and is never the smallest unless alone. An empty table gives an empty one.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must lie above 50 and be at most 100")
    index = settled(index_sets(docs, words), "sets")
    classes = settled(index.where("n > 0").groupBy("set").agg(F.min("doc_id").alias("first_doc")), "classes")
    elements = index.agg(F.sum("n")).first()[0] or 0
    chosen = settled(sets_that_may_link(docs, words, percent, elements).join(classes, "set"), "chosen")
    sets = settled(_chosen_sets(docs, chosen, words), "items")
    linked = _link_sets(prefix_lists(sets, percent), sets, percent)
    rooted = linked.join(classes.select("set", "first_doc"), "set")
    smallest = rooted.groupBy("root").agg(F.min("first_doc").alias("component"))
    component = rooted.join(smallest, "root").select("set", "component")
    component = classes.join(component, "set", "left").select("set", F.coalesce("component", "first_doc").alias("component"))
    out = index.select("doc_id", F.col("n").alias("n_shingles"), "set").join(component, "set", "left")
    alone = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", alone.alias("component_id"))
