"""N-gram Jaccard join, size-aware: subsets for small sets, inverted lists for large ones.

A document's set holds its distinct five-word shingles (as 64-bit hashes).  Two sets that reach the threshold t share all
but few elements of their larger one, so in any one global order of elements they share

* one element of their prefixes of n - ceil(t n) + 1 elements: **large** sets scan inverted lists of those;
* two elements of prefixes one longer: **small** sets enumerate all 2-subsets of those, which are far rarer keys.

Sets just under the boundary also stand in the inverted lists, as partners of larger ones.  The boundary is the size at
which the rows written for both sides are fewest, by the size histogram of all documents.

The order puts elements found often last (a passage on a third of all documents then is in hardly any prefix) and else
goes by hash.  Often is told by the distinct sets of a fixed share (``watched``) of all hash values, so it does not hang on how
documents are dealt to tasks, nor on copies.  Any choice of "often" gives the same result: it is an order, not a filter.

From keys to components, without all pairs of a group:

1. documents with equal sets are one class (one map-side combined group-by);
2. each key's list is linked to one of its members as a star, hot keys in salted parts that are then linked in turn; of
   a document's star links the likeliest is checked exactly, and links that hold are contracted to components;
3. lists that still hold several components give pairs across components, and these are checked exactly too: a list of at
   most ``list_rows`` sets gives every such pair.  The sets of longer lists are put in order anew, by how often their elements
   are among *these* sets, and give new keys: what made the lists long (a passage that many documents hold) goes last.  A
   pair all of whose lists were long has both its sets here and meets in a new list.  That is repeated while it at least
   halves the sets in long lists; pairs grow with the rows of lists, not with the square of a list.

Step 3 makes the result whole; step 2 makes step 3 small.  Before the exact check, parity sketches (1,024 bits, and 8,192 for
long sets) bound the size of the difference from below, which no pair at the threshold can exceed.

Defined cases: a document without words (or null text) has an empty set and is its own component; fewer than five words
are one shingle; a null id has a null component; rows that repeat an id are one document, which is linked by each of its
texts (where texts of an id differ, the join runs on keys of id and text, and the components that an id stands in are then
connected); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vulnloom.llm import textkit
from vulnloom.llm.common import batches_of, drop_stored, stored
from vulnloom.llm.components import connected

SKETCH, LONGS = 1024, 16
WIDE, WIDE_FROM = 8192, 800


@dataclass(frozen=True)
class JoinOptions:
    """``percent``: the threshold; ``often``: sets that put an element last, ``watched``: of which one in so many is asked;
    ``often_most``: how many such elements the order may name (16 bytes each reach every worker; beyond, only the commonest are);
    ``salt_rows``: rows of a key that one part of it holds; ``ids_most``: ids sent to workers instead of a join;
    ``list_rows``: sets of a list that are paired as they are, longer lists are refined first."""

    percent: int = 80
    shingle: int = 5
    often: int = 24
    watched: int = 8
    often_most: int = 200_000
    salt_rows: int = 2048
    ids_most: int = 1_000_000
    list_rows: int = 64

    def __post_init__(self):
        if not 50 < self.percent <= 100:
            raise ValueError("percent: over 50 (below, sets that reach it need not share two elements), at most 100")


def overlap_needed(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def prefix_size(n: int, percent: int) -> int:
    return n - overlap_needed(n, percent) + 1


# --- per document -------------------------------------------------------------------------------------------------


def _facts(docs: DataFrame, options: JoinOptions) -> DataFrame:
    """(doc_id, n, a, b, s0..s15, wide, some) per document.

    s0 to s15 are the sketch; ``wide`` is the long one of sets of WIDE_FROM elements or more; ``some`` are the elements of
    watched sets that may stand in prefixes.
    """
    names = ["doc_id", "n", "a", "b", *[f"s{k}" for k in range(LONGS)], "wide", "some"]
    lists = pa.list_(pa.int64())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in textkit.blocks(batch.column(1)):
                n = len(block)
                size, one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                sketch = np.zeros((n, SKETCH), np.uint8)
                wide: list[np.ndarray | None] = [None] * n
                some: list[np.ndarray | None] = [None] * n
                for i, h in enumerate(textkit.shingle_sets(block, options.shingle)):
                    size[i] = len(h)
                    if len(h):
                        one[i] = np.bitwise_xor.reduce(textkit.mix(h + np.uint64(1)))
                        two[i] = h.sum(dtype=np.uint64)
                        odd = np.bincount((h >> np.uint64(20)).astype(np.int64) & (WIDE - 1), minlength=WIDE) & 1
                        sketch[i] = np.bitwise_xor.reduce(odd.reshape(-1, SKETCH), axis=0)
                        if len(h) >= WIDE_FROM:
                            wide[i] = np.packbits(odd.astype(np.uint8)).view(np.int64)
                        if int(one[i]) % options.watched == 0:
                            some[i] = textkit.signed(h[: 2 * prefix_size(len(h), options.percent)])
                columns = [size, one, two, *np.packbits(sketch, axis=1).view(np.uint64).T]
                arrays = [pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, n), *arrays, pa.array(wide, lists), pa.array(some, lists)], names=names)

    kinds = ", ".join(f"{x} {'array<long>' if x in ('wide', 'some') else 'long'}" for x in names)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, kinds)


def _often(sets: DataFrame, least: int, options: JoinOptions) -> tuple[np.ndarray, np.ndarray]:
    """The elements (of ``sets``, arrays) that ``least`` of the sets have, by value, and in how many they are."""
    seen = sets.select(F.explode("sets").alias("element")).groupBy("element").agg(F.count("*").alias("seen")).filter(F.col("seen") >= least)
    return _sorted(seen, options)


def _sorted(seen: DataFrame, options: JoinOptions) -> tuple[np.ndarray, np.ndarray]:
    top = seen.orderBy(F.desc("seen"), "element").limit(options.often_most).toPandas()
    top = top.sort_values("element", key=lambda x: x.to_numpy(np.int64).view(np.uint64))
    return top["element"].to_numpy(np.int64).view(np.uint64).copy(), top["seen"].to_numpy(np.int64).copy()


def boundary(histogram: dict[int, int], percent: int) -> int:
    """The set size from which on sets scan lists, so that subsets and list entries are fewest together.

    ``histogram``: number of classes by size.  A subset is worth a third of a list entry, as its list is shorter.
    """

    def cost(bound: int) -> float:
        rows = 0.0
        for n, count in histogram.items():
            p = prefix_size(n, percent)
            if n < bound:
                rows += count * (p + 1) * p / 2 / 3
            if 100 * n >= percent * bound:
                rows += count * p
        return rows

    return min([0, 5, 8, 12, 16, 24, 32, 48, 64, 96, 128], key=cost)


def _own_keys(h: np.ndarray, often: np.ndarray, seen: np.ndarray, bound: int, options: JoinOptions) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, their numbers of parts) of a set: 2-subsets of its prefix if it is small, prefix elements if others may look for it there.

    The order: elements not in ``often`` by hash, then those by how often they were seen (in powers of two), then by hash.
    """
    n, p = len(h), prefix_size(len(h), options.percent)
    spot = np.searchsorted(often, h)
    spot[spot == len(often)] = 0
    common = often[spot] == h if len(often) else np.zeros(n, bool)
    rare = np.flatnonzero(~common)[: p + 1]
    late = np.flatnonzero(common)
    if len(rare) <= p and len(late):
        late = late[np.argsort(np.floor(np.log2(seen[spot[late]])), kind="stable")]
    order = np.concatenate([rare, late[: max(0, p + 1 - len(rare))]])
    count = np.where(common[order], seen[spot[order]] if len(often) else 0, 0)
    parts = 1 + count // options.salt_rows
    if n < bound:
        i, j = np.triu_indices(len(order), 1)
        low, high = np.minimum(h[order[i]], h[order[j]]), np.maximum(h[order[i]], h[order[j]])
        yield textkit.mix(low * np.uint64(0x9E3779B97F4A7C15) + high), np.minimum(parts[i], parts[j])
    if 100 * n >= options.percent * bound:
        yield h[order[:p]], parts[:p]


def _keys(docs: DataFrame, often: np.ndarray, seen: np.ndarray, bound: int, options: JoinOptions) -> DataFrame:
    """(key, doc_id, part, split): the prefix elements and 2-subsets of every document that can have a partner.

    ``split``: the key is in several parts, the same for all its rows.  Within a task, documents with equal sets give
    their keys once, so a part of a split key may be left with a single row.
    """
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((often, seen))
    names = ["key", "doc_id", "part", "split"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, seen = shared.value
        met: set[bytes] = set()
        for batch in batches:
            for block in textkit.blocks(batch.column(1)):
                ids = batch.column(0).slice(block.first, len(block)).to_pylist()
                out: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]] = []
                for doc_id, h in zip(ids, textkit.shingle_sets(block, options.shingle), strict=True):
                    n = len(h)
                    if doc_id is None or 100 * n < options.percent * (n + 1):  # only an equal set can reach the threshold
                        continue
                    digest = textkit.mix(h + np.uint64(1))
                    digest = np.array([np.bitwise_xor.reduce(digest), h.sum(dtype=np.uint64)]).tobytes()
                    if digest in met:
                        continue
                    if len(met) < 200_000:
                        met.add(digest)
                    where = int(textkit.mix(np.array([doc_id], np.int64).view(np.uint64))[0] >> np.uint64(1))
                    out += [(keys, where % parts, parts > 1, doc_id) for keys, parts in _own_keys(h, often, seen, bound, options)]
                if out:
                    sizes = [len(x[0]) for x in out]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate([x[0] for x in out]).view(np.int64)),
                            pa.array(np.repeat(np.array([x[3] for x in out], np.int64), sizes)),
                            pa.array(np.concatenate([x[1] for x in out]).astype(np.int32)),
                            pa.array(np.concatenate([x[2] for x in out])),
                        ],
                        names=names,
                    )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "key long, doc_id long, part int, split boolean")


def _sets(docs: DataFrame, ids: DataFrame, options: JoinOptions) -> DataFrame:
    """(doc_id, elements) of the documents in ``ids`` (doc_id)."""
    sc = docs.sparkSession.sparkContext
    few = ids.limit(options.ids_most + 1).count() <= options.ids_most
    wanted = sc.broadcast(np.sort(ids.toPandas()["doc_id"].to_numpy(np.int64))) if few else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if wanted is not None:
                own = np.asarray(batch.column(0).fill_null(-(1 << 62)).to_numpy(zero_copy_only=False), np.int64)
                spot = np.searchsorted(wanted.value, own)
                spot[spot == len(wanted.value)] = 0
                mask = wanted.value[spot] == own if len(wanted.value) else np.zeros(len(own), bool)
                batch = batch.filter(pa.array(mask))
            for block in textkit.blocks(batch.column(1)):
                sets = [textkit.signed(h) for h in textkit.shingle_sets(block, options.shingle)]
                ends = np.cumsum([0] + [len(h) for h in sets]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, len(block)), lists], names=["doc_id", "elements"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    plain = plain if few else plain.join(ids, "doc_id", "left_semi")
    return plain.mapInArrow(work, "doc_id long, elements array<long>").dropDuplicates(["doc_id"])


def _refined(sets: DataFrame, bound: int, options: JoinOptions) -> DataFrame:
    """(key, rep) of the sets (doc_id, elements), in an order that puts last what tasks see in two of *these* sets or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool: list[np.ndarray] = []
        for batch in batches:
            pool.append(batch.column(0).flatten().to_numpy(zero_copy_only=False).copy())
            if sum(map(len, pool)) > 2_000_000:
                yield tell(pool)
                pool = []
        if pool:
            yield tell(pool)

    def tell(pool: list[np.ndarray]) -> pa.RecordBatch:
        element, seen = np.unique(np.concatenate(pool), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(element[seen > 1]), pa.array(seen[seen > 1], pa.int64())], names=["element", "seen"])

    seen = sets.select("elements").mapInArrow(count, "element long, seen long").groupBy("element").agg(F.sum("seen").alias("seen")).filter("seen >= 8")
    shared = sets.sparkSession.sparkContext.broadcast(_sorted(seen, options))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rep, elements in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = np.sort(elements.values.to_numpy(zero_copy_only=False).view(np.uint64))
                out += [(keys, rep) for keys, _ in _own_keys(h, *shared.value, bound, options)]
            if out:
                reps = np.repeat(np.array([rep for _, rep in out], np.int64), [len(keys) for keys, _ in out])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([keys for keys, _ in out]).view(np.int64)), pa.array(reps)], names=["key", "rep"])

    return sets.select("doc_id", "elements").mapInArrow(work, "key long, rep long")


# --- pairs --------------------------------------------------------------------------------------------------------


def _difference() -> Column:
    """At least so many elements are in one of the sets x and y only."""
    return reduce(add, [F.bit_count(F.col(f"x.s{k}").bitwiseXOR(F.col(f"y.s{k}"))) for k in range(LONGS)])


def _within(difference: Column, percent: int) -> Column:
    """Whether sets that differ in so many elements at least can reach the threshold, by their sizes."""
    n, m = F.col("x.n"), F.col("y.n")
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (difference * (100 + percent) <= (n + m) * (100 - percent))


def _linked(pairs: DataFrame, docs: DataFrame, options: JoinOptions) -> DataFrame:
    """The pairs (u, v) whose sets reach the threshold, stored."""
    ids = pairs.select(F.col("u").alias("doc_id")).union(pairs.select("v")).distinct()
    sets = stored(_sets(docs, ids, options), "sets")
    left = pairs.join(sets.select(F.col("doc_id").alias("u"), F.col("elements").alias("eu")), "u")
    both = left.join(sets.select(F.col("doc_id").alias("v"), F.col("elements").alias("ev")), "v")
    met = both.select("u", "v", (F.size("eu") + F.size("ev")).alias("total"), F.size(F.array_intersect("eu", "ev")).alias("common"))
    linked = stored(met.filter(F.col("common") * 100 >= (F.col("total") - F.col("common")) * options.percent).select("u", "v"), "linked")
    drop_stored(sets)
    return linked


def components(docs: DataFrame, options: JoinOptions = JoinOptions()) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text)."""
    with batches_of(docs.sparkSession, 1000):
        facts = stored(_facts(docs, options), "facts")
        one_set = F.min(F.struct("n", "a", "b")) == F.max(F.struct("n", "a", "b"))
        several = facts.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(one_set.alias("one_set")).filter("NOT one_set")
        if several.isEmpty():
            return _components(docs, facts, options)
        drop_stored(facts)
        return _by_text(docs, options)


def _by_text(docs: DataFrame, options: JoinOptions) -> DataFrame:
    """``components`` where rows of an id differ: each (id, text) is a document to the join, and an id links its own."""
    doc_id = F.col("doc_id").cast("long")
    keyed = docs.select(doc_id.alias("doc_id"), F.when(doc_id.isNotNull(), F.xxhash64(doc_id, "text")).alias("key"), "text")
    rows = keyed.select(F.col("key").alias("doc_id"), "text")
    rows = _components(rows, stored(_facts(rows, options), "facts"), options)
    ids = keyed.filter("key IS NOT NULL").select("key", "doc_id").distinct()
    found = stored(rows.withColumnsRenamed({"doc_id": "key", "component_id": "part"}).join(ids, "key", "left"), "texts")
    placed = found.filter("key IS NOT NULL").select("doc_id", "part").distinct()
    least = placed.groupBy("doc_id").agg(F.min("part").alias("v"))
    label = connected(placed.join(least, "doc_id").select(F.col("part").alias("u"), "v"))
    whole = found.join(label, F.col("part") == F.col("node"), "left").withColumn("whole", F.coalesce("component", "part"))
    whole = stored(whole.select("doc_id", "n_shingles", "whole"), "wholes")
    first = whole.filter("doc_id IS NOT NULL").groupBy("whole").agg(F.min("doc_id").alias("component_id"))
    return whole.join(first, "whole", "left").select("doc_id", "n_shingles", "component_id")


def _components(docs: DataFrame, facts: DataFrame, options: JoinOptions) -> DataFrame:
    """``components`` of documents whose rows of one id have one set; ``facts`` are theirs, stored."""
    percent = options.percent
    tables = [facts]

    def keep(df: DataFrame, name: str) -> DataFrame:
        tables.append(stored(df, name))
        return tables[-1]

    sketch = [f"s{k}" for k in range(LONGS)]
    classes = facts.filter("n > 0 AND doc_id IS NOT NULL").groupBy("n", "a", "b").agg(F.min("doc_id").alias("rep"), *[F.first(s).alias(s) for s in [*sketch, "wide", "some"]])
    classes = keep(classes, "classes")
    often, seen = _often(classes.select(F.col("some").alias("sets")), max(2, options.often // options.watched), options)
    seen = seen * options.watched
    members = facts.select("doc_id", "n", "a", "b").join(classes.select("n", "a", "b", "rep"), ["n", "a", "b"], "left")
    members = keep(members.select("doc_id", F.col("n").alias("n_shingles"), "rep"), "members")
    reps = members.filter("rep IS NOT NULL").groupBy("doc_id").agg(F.min("rep").alias("rep"))

    histogram = {r["n"]: r["count"] for r in classes.filter("n < 200").groupBy("n").count().collect()}
    bound = boundary(histogram, percent)

    # Keys that two documents or more have, with one member as the centre of the key's star (or of its part).
    here = Window.partitionBy("key", "part")
    keyed = _keys(docs, often, seen, bound, options)
    starred = keyed.select("key", "part", "split", "doc_id", F.count("*").over(here).alias("rows"), F.min(F.struct(F.xxhash64("doc_id", "key").alias("h"), "doc_id")).over(here).alias("centre"))
    lists = starred.filter("rows > 1 OR split").select("key", "split", "doc_id", F.col("centre.doc_id").alias("centre"), (F.col("rows") > 2).alias("many"))
    lists = keep(lists, "lists")

    # Stars: members to their part's centre, and centres of a key's parts to the first of them.
    tops = lists.filter("split").select("key", "centre").distinct()
    ring = tops.join(tops.groupBy("key").agg(F.min("centre").alias("first")), "key").select("centre", "first")
    raw = lists.select(F.col("doc_id").alias("u"), F.col("centre").alias("v")).union(ring).filter("u <> v").distinct()
    to = lambda c: reps.select(F.col("doc_id").alias(c), F.col("rep").alias(f"{c}_rep"))
    stars = raw.join(to("u"), "u").join(to("v"), "v").select(F.greatest("u_rep", "v_rep").alias("u"), F.least("u_rep", "v_rep").alias("v")).filter("u <> v").distinct()

    def plausible(pairs: DataFrame) -> DataFrame:
        """(u, v, far): the pairs that sizes and sketches do not rule out; the long sketch is asked where sets are long."""
        one = lambda n: classes.select(F.col("rep"), "n", *sketch).alias(n)
        met = pairs.join(one("x"), F.col("u") == F.col("x.rep")).join(one("y"), F.col("v") == F.col("y.rep"))
        met = met.filter(_within(_difference(), percent)).select("u", "v", F.col("x.n").alias("nx"), F.col("y.n").alias("ny"), (_difference() / (F.col("x.n") + F.col("y.n"))).alias("far"))
        wide = lambda n: classes.filter("wide IS NOT NULL").select(F.col("rep"), "n", "wide").alias(n)
        large = met.filter((F.col("nx") >= WIDE_FROM) & (F.col("ny") >= WIDE_FROM)).join(wide("x"), F.col("u") == F.col("x.rep")).join(wide("y"), F.col("v") == F.col("y.rep"))
        apart = F.aggregate(F.zip_with("x.wide", "y.wide", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda t, k: t + k)
        large = large.filter(_within(apart, percent)).select("u", "v", (apart / (F.col("x.n") + F.col("y.n"))).alias("far"))
        return met.filter((F.col("nx") < WIDE_FROM) | (F.col("ny") < WIDE_FROM)).select("u", "v", "far").union(large)

    likely = keep(plausible(stars), "stars")
    both = likely.select("u", "v", "far").union(likely.select("v", "u", "far"))
    best = both.groupBy("u").agg(F.min(F.struct("far", "v"))["v"].alias("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    best = keep(best, "best")
    links = _linked(best, docs, options)
    label = connected(links)

    # What may still join components: likely star pairs across them, and all other pairs of lists of three and more.
    placed = reps.join(label, F.col("rep") == F.col("node"), "left").select("doc_id", "rep", F.coalesce("component", "rep").alias("component"))
    placed = keep(placed, "placed")
    whole = placed.select("rep", "component").distinct()
    longer = lists.filter("many OR split").select("key", "doc_id")
    named = keep(longer.join(placed, "doc_id").select("key", "rep", "component").distinct(), "named")
    folded = [reduce(lambda p, q: p.bitwiseXOR(q), [F.col(f"s{k + 4 * j}") for j in range(LONGS // 4)]).alias(f"f{k}") for k in range(4)]
    rough = reduce(add, [F.bit_count(F.col(f"x.f{k}").bitwiseXOR(F.col(f"y.f{k}"))) for k in range(4)])

    def pairs(keys: DataFrame) -> DataFrame:
        """(u, v): the pairs across components of the lists of ``keys``."""
        rest = named.join(keys.select("key"), "key", "left_semi").join(classes.select("rep", "n", *folded), "rep")
        one, two = rest.alias("x"), rest.alias("y")
        met = one.join(two, (F.col("x.key") == F.col("y.key")) & (F.col("x.component") < F.col("y.component")) & _within(rough, percent))
        return met.select(F.greatest("x.rep", "y.rep").alias("u"), F.least("x.rep", "y.rep").alias("v")).distinct()

    across, before, sets = [], None, None
    while True:
        mixed = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("rows")).filter("low <> high")
        mixed = keep(mixed.select("key", "rows"), "mixed")
        long = keep(named.join(mixed.filter(F.col("rows") > options.list_rows), "key", "left_semi").select(F.col("rep").alias("doc_id")).distinct(), "long")
        sought = long.count()
        if not sought or before is not None and 2 * sought > before:
            across.append(keep(pairs(mixed), "across"))
            break
        across.append(keep(pairs(mixed.filter(F.col("rows") <= options.list_rows)), "across"))
        sets = keep(_sets(docs, long, options) if sets is None else sets.join(long, "doc_id", "left_semi"), "sets")
        named, before = keep(_refined(sets, bound, options).join(whole, "rep").select("key", "rep", "component"), "named"), sought
    across = reduce(DataFrame.union, across).distinct()
    spot = lambda c: whole.select(F.col("rep").alias(c), F.col("component").alias(f"c_{c}"))
    apart = likely.select("u", "v").join(spot("u"), "u").join(spot("v"), "v").filter("c_u <> c_v").select("u", "v")
    again = plausible(across).select("u", "v").union(apart).distinct().join(best, ["u", "v"], "left_anti")
    more = _linked(keep(again, "again"), docs, options)
    label = connected(links.union(more))

    final = members.join(label, F.col("rep") == F.col("node"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    final = stored(final.select("doc_id", "n_shingles", component.alias("component_id")), "components")
    for table in [*tables, links, more]:
        drop_stored(table)
    return final


def keep_first(docs: DataFrame, options: JoinOptions = JoinOptions()) -> DataFrame:
    """``docs`` without the rows whose component has a smaller id (rows of a null id stay).

    Of rows that repeat an id and are equal in all columns one stays; rows of the id that differ stay, as one document.
    The ids that go are stored, so the join knows their size.
    """
    later = stored(components(docs, options).filter("component_id <> doc_id").select("doc_id").distinct(), "later")
    kept = docs.join(later, "doc_id", "left_anti").select(*docs.columns)
    again = stored(docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "again")
    if again.isEmpty():
        return kept
    once = kept.join(again, "doc_id", "left_semi").select(*docs.columns).distinct()
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(once)
