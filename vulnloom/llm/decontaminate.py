"""Benchmark decontamination by template canonicalisation.

Texts become templates: numbers, names and units turn into typed placeholders, everything else is compared in lower
case without punctuation.  Windows of template tokens are hashed and joined with the windows of the benchmark; the
values in the slots of a match then have to correspond one to one, which tells a re-parameterised question (every 3
became a 7) from an accident.  They have to correspond within one occurrence: a document may hold an item twice, with other
values each time.  An occurrence is a set of matches whose document position less item position is the same, or a
run of such with steps of at most ``shift`` (words put in or left out); all matches of a document together are tried too,
for an item whose pieces stand apart.

A window of few literals (a row of numbers, names and units) would match much as a template, so it is not searched as one.
Items that have such windows, or are short, are searched word by word too: windows of their words as they stand (in lower
case, without punctuation) are hashed and joined, and a verbatim copy is found that way.

The benchmark is a stated query set: its window hashes go to the workers in blocks of ``block`` hashes (8 bytes each), one
scan of the documents a block, so neither side is limited.  A scan shuffles nothing; only hits (document window, hash, slot
values) meet the benchmark's windows in a hash join.  Hits keep their positions, so a window that stands m times in a document and
k times in an item gives m k rows.

Defined cases: a null or empty text has no windows; an item of fewer than ``least_item`` template tokens is searched
verbatim only, one of fewer than ``least_words`` words not at all (it would match ordinary text); one shorter than a window is
searched whole; operators such as + are punctuation; items with equal templates are all
reported; rows that repeat an id are searched each and reported once; an empty table on either side gives an empty
result; a null id is not reported, but a document without id
is removed by its text; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vulnloom.llm import textkit
from vulnloom.llm.common import stored

#: Words that are units after a number.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg gram grams kilogram kilograms oz ounce ounces "
    "lb lbs pound pounds ton tons tonne tonnes ml l liter liters litre litres gallon gallons s sec second seconds min minute "
    "minutes h hr hour hours day days week weeks month months year years dollar dollars euro euros cent cents usd eur percent "
    "degree degrees meter meters metre metres kilometer kilometers kilometre kilometres km2 m2 mph kmh w kw v hz khz mhz ghz"
).split()

NUMBER, NAME, UNIT = (textkit.mix(np.array([k], np.uint64))[0] for k in (11, 12, 13))

_JOINER = np.ones(256, bool)
_JOINER[48:58] = _JOINER[65:91] = _JOINER[97:123] = False
_JOINER[128:] = False
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


@dataclass(frozen=True)
class TemplateOptions:
    """``window`` template tokens, of which ``least_literal`` are no placeholders; a document holds an item if
    ``enough`` of its windows, or ``share`` of them where that is less, are found in one occurrence with slots that
    correspond for ``consistent`` of their values.  ``shift``: template tokens that neighbouring matches of one occurrence may
    be out of step (under ``least_item``, so that copies in a row stay apart).  Items of ``least_words`` words may be
    searched verbatim."""

    window: int = 8
    least_literal: int = 4
    least_item: int = 5
    least_words: int = 3
    enough: int = 6
    share: float = 0.5
    consistent: float = 0.75
    shift: int = 3
    block: int = 1_000_000


@dataclass
class Templates:
    """Template tokens of a block's rows: hash, whether a placeholder, hash of the text behind it; row bounds.

    ``word``, ``word_bounds``: the words as they stand, hashed, and their row bounds.
    """

    token: np.ndarray
    slot: np.ndarray
    value: np.ndarray
    bounds: np.ndarray
    word: np.ndarray
    word_bounds: np.ndarray


def templates(block: textkit.Block) -> Templates:
    data, n = block.data, len(block.data)
    digit = _DIGIT[data]
    joiner = _JOINER[data].copy()
    if n > 2:  # a point or comma between digits belongs to the number
        point = ((data[1:-1] == 46) | (data[1:-1] == 44)) & digit[:-2] & digit[2:]
        joiner[1:-1] &= ~point
        digit[1:-1] |= point
    folded = textkit._LOWER[data]
    upper = (data >= 65) & (data <= 90)
    if n > 1:  # the capitals of Latin-1 in UTF-8
        latin = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        folded[1:] += np.where(latin, 32, 0).astype(np.uint8)
        upper[:-1] |= latin
    # Words are runs of joined bytes, cut where digits and letters meet.
    solid = ~joiner
    edge = np.zeros(n + 1, bool)
    edge[block.offsets] = True
    cut = np.ones(n + 1, bool)
    cut[1:n] = edge[1:n] | ~solid[1:] | ~solid[:-1] | (digit[1:] != digit[:-1])
    starts = np.flatnonzero(solid & cut[:n])
    ends = np.flatnonzero(solid & cut[1:]) + 1
    words = textkit.Words(starts, ends, np.searchsorted(starts, block.offsets))
    literal = textkit.word_hashes(textkit.Block(block.first, folded, block.offsets), words, np.arange(256, dtype=np.uint8))
    number = digit[starts] if n else np.zeros(0, bool)
    # A name is capitalised, not in capitals throughout, and does not begin a sentence or a row.
    total = np.concatenate([[0], np.cumsum(upper)])
    capitals = total[ends] - total[starts]
    first = upper[starts] if n else np.zeros(0, bool)
    stop = np.isin(data, np.frombuffer(b".!?:\n", np.uint8))
    stops = np.concatenate([[0], np.cumsum(stop)])
    begins = np.ones(len(starts), bool)
    begins[1:] = (stops[starts[1:]] - stops[ends[:-1]]) > 0
    begins[words.bounds[:-1][words.bounds[:-1] < len(starts)]] = True
    name = first & ~begins & (capitals == 1)
    after = np.zeros(len(starts), bool)
    after[1:] = number[:-1]
    unit = after & ~number & np.isin(literal, _unit_hashes())
    token = np.where(number, NUMBER, np.where(name, NAME, np.where(unit, UNIT, literal)))
    slot = number | name | unit
    # A name of several words is one slot: later words join the first, whose value gathers theirs.
    later = np.zeros(len(starts), bool)
    later[1:] = name[1:] & name[:-1]
    later[words.bounds[:-1][words.bounds[:-1] < len(starts)]] = False
    keep = np.flatnonzero(~later)
    value = np.add.reduceat(literal * np.uint64(0x9E3779B97F4A7C15), keep) if len(keep) else literal
    return Templates(token[keep], slot[keep], value, np.searchsorted(keep, words.bounds), literal, words.bounds)


def _unit_hashes() -> np.ndarray:
    data = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    block = textkit.Block(0, data, np.array([0, len(data)]))
    return textkit.word_hashes(block, textkit.words_of(block))


def _windows(found: Templates, size: int, options: TemplateOptions) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per row: its number, first token, the hashes of its windows and which of them have enough literals.

    A row shorter than a window is one window of its own length.
    """
    hashes = textkit.window_hashes(found.token, size)
    literals = np.concatenate([[0], np.cumsum(~found.slot)])
    for i, (a, b) in enumerate(zip(found.bounds[:-1].tolist(), found.bounds[1:].tolist(), strict=True)):
        if b - a >= size:
            yield i, a, hashes[a : b - size + 1], (literals[a + size : b + 1] - literals[a : b - size + 1]) >= min(options.least_literal, size)


def _slots(found: Templates, at: int, size: int) -> list[int]:
    span = slice(at, at + size)
    return found.value[span][found.slot[span]].view(np.int64).tolist()


_ROW = pa.schema([("id", pa.int64()), ("size", pa.int32()), ("at", pa.int64()), ("of", pa.int64()), ("hash", pa.int64()), ("slots", pa.list_(pa.int64()))])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_ROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ROW, strict=True)], schema=_ROW)


_DDL = "id long, size int, at long, of long, hash long, slots array<long>"


def item_windows(benchmark: DataFrame, options: TemplateOptions = TemplateOptions()) -> DataFrame:
    """Windows of each item: id, size, at (its number), of (how many the item has), hash, slots.

    Windows of words as they stand have their size negated and no slots.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in textkit.blocks(batch.column(1)):
                found = templates(block)
                ids = batch.column(0).slice(block.first, len(block)).to_pylist()
                lengths = np.diff(found.bounds)
                rows = []
                verbatim = lengths < options.least_item
                for size in {min(options.window, int(x)) for x in lengths if x >= options.least_item}:
                    for i, a, hashes, fit in _windows(found, size, options):
                        if min(options.window, lengths[i]) == size and ids[i] is not None:
                            spots = np.flatnonzero(fit).tolist()
                            verbatim[i] = len(spots) < len(fit)
                            rows += [(ids[i], size, k, len(spots), int(hashes[k].view(np.int64)), _slots(found, a + k, size)) for k in spots]
                words = np.diff(found.word_bounds)
                for i in np.flatnonzero(verbatim & (words >= options.least_words)).tolist():
                    if ids[i] is not None:
                        size = min(options.window, int(words[i]))
                        hashes = textkit.window_hashes(found.word[found.word_bounds[i] : found.word_bounds[i + 1]], size)
                        rows += [(ids[i], -size, k, len(hashes), h, []) for k, h in enumerate(hashes.view(np.int64).tolist())]
                yield _rows(rows)

    return benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(work, _DDL)


def _hits(docs: DataFrame, wanted: dict[int, np.ndarray], options: TemplateOptions) -> DataFrame:
    """Windows of documents whose hash is one of ``wanted`` (sorted hashes by window size); ``of`` tells texts of one id apart."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in textkit.blocks(batch.column(1)):
                found = templates(block)
                ids, texts = (batch.column(k).slice(block.first, len(block)).to_pylist() for k in (0, 2))
                rows = []
                for size, hashes in shared.value.items():
                    tokens, bounds = (found.token, found.bounds) if size > 0 else (found.word, found.word_bounds)
                    own = textkit.window_hashes(tokens, abs(size))
                    spot = np.searchsorted(hashes, own)
                    spot[spot == len(hashes)] = 0
                    hit = np.flatnonzero(hashes[spot] == own)
                    row = np.searchsorted(bounds, hit, "right") - 1
                    inside = hit + abs(size) <= bounds[row + 1]
                    slots = lambda k: _slots(found, k, size) if size > 0 else []  # noqa: E731, B023
                    rows += [(ids[r], size, k - int(bounds[r]), texts[r], int(own[k].view(np.int64)), slots(k)) for k, r in zip(hit[inside].tolist(), row[inside].tolist(), strict=True) if ids[r] is not None]
                if rows:
                    yield _rows(rows)

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text")).mapInArrow(work, _DDL)


def _occurrences(met: DataFrame, options: TemplateOptions) -> DataFrame:
    """``met`` once for each set of matches that may be one occurrence: (kind, text, place) names the set.

    Kind 1 has one place (document position less item position), kind 2 a run of places, kind 0 the whole document, in which
    equal matches count once.
    """
    spot = lambda kind, text, place: F.struct(F.lit(kind).alias("kind"), text.alias("text"), place.alias("place"))
    flat = lambda df, spots: df.withColumn("_spot", spots).select("doc_id", "item_id", "size", "at", "of", "slots", "_spot.*")
    near = Window.partitionBy("doc_id", "item_id", "size", "text").orderBy("place")
    apart = F.coalesce((F.col("place") - F.lag("place").over(near) > options.shift).cast("long"), F.lit(0))
    runs = met.withColumn("_apart", apart).withColumn("_run", F.sum("_apart").over(near))
    aligned = flat(runs, F.explode(F.array(spot(1, F.col("text"), F.col("place")), spot(2, F.col("text"), F.col("_run")))))
    nowhere = F.lit(0).cast("long")
    return aligned.unionByName(flat(met.select("doc_id", "item_id", "size", "at", "of", "slots").distinct(), spot(0, nowhere, nowhere)))


def matches(docs: DataFrame, benchmark: DataFrame, options: TemplateOptions = TemplateOptions()) -> DataFrame:
    """(doc_id, item_id, n_windows, item_windows, coverage, exact) of the items that documents hold.

    Of several occurrences the one with most windows is told; ``exact``: all slot values in the windows found are the item's own.
    """
    items = stored(item_windows(benchmark, options), "item-windows")
    blocks = -(-items.select("hash").distinct().count() // options.block)
    hits = None
    for k in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("hash"), F.lit(blocks)) == k).select("size", "hash").distinct().toPandas()
        wanted = {int(s): np.sort(g["hash"].to_numpy(np.int64).view(np.uint64)) for s, g in rows.groupby("size")}
        part = _hits(docs, wanted, options)
        hits = part if hits is None else hits.unionByName(part)
    if hits is None:
        hits = docs.sparkSession.createDataFrame([], _DDL)
    i, d = items.alias("i"), hits.alias("d")
    met = d.join(i, (F.col("d.hash") == F.col("i.hash")) & (F.col("d.size") == F.col("i.size")) & (F.size("d.slots") == F.size("i.slots")))
    met = met.select(
        F.col("d.id").alias("doc_id"),
        F.col("i.id").alias("item_id"),
        F.col("d.size").alias("size"),
        F.col("d.of").alias("text"),
        F.col("i.at").alias("at"),
        F.col("i.of").alias("of"),
        (F.col("d.at") - F.col("i.at")).alias("place"),
        F.arrays_zip(F.col("i.slots").alias("a"), F.col("d.slots").alias("b")).alias("slots"),
    )
    tried = _occurrences(stored(met, "window-matches"), options)
    key = ["doc_id", "item_id", "size", "kind", "text", "place"]
    # The commonest value that a slot value became, over all windows of the occurrence, against all that it became.
    pairs = tried.select(*key, F.explode("slots").alias("s")).groupBy(*key, "s.a", "s.b").count()
    per_value = pairs.groupBy(*key, "a").agg(F.max("count").alias("most"), F.sum("count").alias("all"), F.sum(F.when(F.col("a") == F.col("b"), F.col("count")).otherwise(0)).alias("own"))
    slots = per_value.groupBy(*key).agg(F.sum("most").alias("most"), F.sum("all").alias("all"), F.sum("own").alias("own"))
    # And the other way: different values of the item must not have become one.
    back = pairs.groupBy(*key, "b").agg(F.max("count").alias("most")).groupBy(*key).agg(F.sum("most").alias("back"))
    counted = tried.groupBy(*key).agg(F.countDistinct("at").alias("n_windows"), F.max("of").alias("item_windows"))
    joined = counted.join(slots, key, "left").join(back, key, "left")
    enough = F.col("n_windows") >= F.least(F.lit(options.enough), F.ceil(F.col("item_windows") * options.share))
    consistent = F.coalesce(F.least("most", "back") >= options.consistent * F.col("all"), F.lit(True))
    exact = F.coalesce(F.col("own") == F.col("all"), F.lit(True))
    best = F.max(F.struct((F.col("n_windows") / F.col("item_windows")).alias("coverage"), exact.alias("exact"), "n_windows", "item_windows"))
    found = joined.filter(enough & consistent).groupBy("doc_id", "item_id").agg(best.alias("best"))
    return found.select("doc_id", "item_id", "best.n_windows", "best.item_windows", "best.coverage", "best.exact")


def contaminated(docs: DataFrame, benchmark: DataFrame, options: TemplateOptions = TemplateOptions()) -> DataFrame:
    """One row per document that holds an item: doc_id, n_items, item_ids, coverage (the best), reparameterised."""
    return matches(docs, benchmark, options).groupBy("doc_id").agg(
        F.count("*").alias("n_items"),
        F.array_sort(F.collect_set("item_id")).alias("item_ids"),
        F.max("coverage").alias("coverage"),
        (~F.bool_or("exact")).alias("reparameterised"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, options: TemplateOptions = TemplateOptions()) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item (their ids are stored, so the join knows their size).

    Documents without an id are known by their text.
    """
    found = stored(contaminated(docs, benchmark, options).select("doc_id"), "contaminated")
    kept = docs.join(found, "doc_id", "left_anti").select(*docs.columns)
    nameless = docs.filter("doc_id IS NULL")
    if nameless.select("doc_id").isEmpty():
        return kept
    text = F.xxhash64("text")
    also = stored(contaminated(nameless.select(text.alias("doc_id"), "text").distinct(), benchmark, options).select(F.col("doc_id").alias("_text")), "contaminated")
    return kept.join(also, F.col("doc_id").isNull() & (text == F.col("_text")), "left_anti").select(*docs.columns)
