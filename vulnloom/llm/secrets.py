"""Secret scans: fixed patterns, and tokens that a character Markov model calls random.

Two first-order Markov models over characters are compared by log-likelihood ratio: one of random strings, one of
ordinary identifiers.  Both are trained from labelled samples: the values that the fixed patterns find label random
strings, and long plain words of a bounded sample of documents label ordinary identifiers.  The model is one array of
63 x 63 log ratios, whatever the size of the input.

All of it is DataFrame functions, evaluated row by row: ``split`` gives the stretches between matches and
``regexp_extract_all`` the matches, and running sums of their lengths give positions in code points, in time linear in
text and matches (a megabyte of hashes takes a second or two).  Applying shuffles nothing.

Defined cases: a null text is an empty one and has no spans; a null id is kept; rows that repeat an id are scanned
each by itself; an empty table gives an empty result, and training on one gives the untrained (uniform) model; other
columns pass through, but ``scan`` replaces those named base, added or spans.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnloom.llm.common import aside, let, running, words

#: The base patterns (kind, expression, shortest accepted length of the value).
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"

#: Characters of the Markov models; any other is the last state.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
STATES = len(ALPHABET) + 1
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
SPAN = "array<struct<start:long,kind:int,stop:long,kind_name:string>>"


@dataclass(frozen=True)
class MarkovLimits:
    """A token is random if the ratio is over ``total`` nats in all and ``mean`` nats a character pair."""

    total: float = 12.0
    mean: float = 0.7
    sample_docs: int = 2000
    min_word: int = 8


def _spans(text: Column, pattern: str, rank: int, kind: str, may: Column, group: int = 0, least: int = 0) -> Column:
    """Array of (start, rank, stop, kind) of a pattern's matches, in order."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})" if not group else pattern), F.lit(0 if group else 1))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("long"))
    sizes = F.transform(found, lambda m: F.length(m).cast("long"))
    steps = F.filter(F.zip_with(gaps, sizes, lambda g, m: F.struct((g + m).alias("step"), m.alias("size"))), lambda x: x["size"].isNotNull())
    ends = let(steps, lambda x: F.zip_with(x, running(F.transform(x, lambda y: y["step"])), lambda y, e: F.struct(y["size"].alias("size"), e.alias("stop"))))
    kept = F.filter(F.zip_with(ends, values, lambda x, v: F.struct(x.alias("x"), F.length(v).alias("value"))), lambda x: x["value"] >= least)
    span = lambda x: F.struct((x["x"]["stop"] - x["x"]["size"]).alias("start"), F.lit(rank).alias("kind"), x["x"]["stop"].alias("stop"), F.lit(kind).alias("kind_name"))
    return F.when(may, F.transform(kept, span)).otherwise(F.array().cast(SPAN))


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base``: spans of the fixed patterns, ordered by start, then kind."""
    text = F.coalesce(docs["text"], F.lit(""))
    folded = F.lower(text)
    named = F.contains(folded, F.lit("passw")) | F.contains(folded, F.lit("secret")) | F.contains(folded, F.lit("token")) | F.contains(folded, F.lit("api"))
    kinds = [
        _spans(text, ASSIGN, 0, "assign", named, group=1, least=8),
        _spans(text, ACCESS, 1, "access", F.contains(text, F.lit("AKIA"))),
        _spans(text, HEX, 2, "hex", text.rlike(HEX)),
    ]
    return docs.withColumn("base", F.sort_array(F.concat(*kinds)))


def _state(char: Column) -> Column:
    """0-based state of a one-character string."""
    at = F.instr(F.lit(ALPHABET), char)
    return F.when(at > 0, at - 1).otherwise(STATES - 1)


def _pair_counts(samples: DataFrame) -> DataFrame:
    """(random, pair, n) from (random boolean, sample string); a pair is first state * STATES + second."""
    spots = F.when(F.length("sample") > 1, F.sequence(F.lit(1), F.length("sample") - 1)).otherwise(F.array().cast("array<int>"))
    exploded = samples.select("random", "sample", F.explode(spots).alias("i"))
    pair = _state(F.substring(F.col("sample"), F.col("i"), F.lit(1))) * STATES + _state(F.substring(F.col("sample"), F.col("i") + 1, F.lit(1)))
    return exploded.groupBy("random", pair.alias("pair")).agg(F.count("*").alias("n"))


def train(docs: DataFrame, limits: MarkovLimits = MarkovLimits()) -> list[float]:
    """Log ratios P(next | this, random) / P(next | this, ordinary), STATES * STATES of them.

    Random samples: every value the base patterns find in ``docs``.  Ordinary samples: words of ``min_word`` letters or
    more of the ``sample_docs`` documents with the smallest hash of their text (the documented bound).  What reaches the
    driver are at most 2 * STATES * STATES counts.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    folded = F.lower(text)
    assigned = docs.filter(F.contains(folded, F.lit("passw")) | F.contains(folded, F.lit("secret")) | F.contains(folded, F.lit("token")) | F.contains(folded, F.lit("api")))
    values = assigned.select(F.explode(F.regexp_extract_all(F.col("text"), F.lit(ASSIGN), F.lit(1))).alias("sample")).filter(F.length("sample") >= 8)
    keys = docs.filter(F.contains(text, F.lit("AKIA"))).select(F.explode(F.regexp_extract_all(F.col("text"), F.lit(f"({ACCESS})"), F.lit(1))).alias("sample"))
    hashed = docs.filter("text IS NOT NULL").select("text", F.xxhash64("text").alias("h"))
    last = hashed.select("h").distinct().orderBy("h").limit(limits.sample_docs).agg(F.max("h")).first()[0]
    some = hashed.filter(F.col("h") <= F.lit(last).cast("long")).groupBy("h").agg(F.first("text").alias("text"))
    plain = some.select(F.explode(words(F.col("text"))).alias("sample")).filter(F.col("sample").rlike(f"^[A-Za-z_]{{{limits.min_word},}}$"))
    samples = values.union(keys).select(F.lit(True).alias("random"), "sample").union(plain.select(F.lit(False).alias("random"), "sample"))
    counts = {(r["random"], r["pair"]): r["n"] for r in _pair_counts(samples).collect()}
    return log_ratios(counts)


def log_ratios(counts: dict[tuple[bool, int], int]) -> list[float]:
    """Add-one smoothed; random strings also get a uniform tenth, as their samples may hold one alphabet only."""
    import math

    ratios = []
    for a in range(STATES):
        total = {r: sum(counts.get((r, a * STATES + b), 0) for b in range(STATES)) + STATES for r in (True, False)}
        for b in range(STATES):
            p, q = ((counts.get((r, a * STATES + b), 0) + 1) / total[r] for r in (True, False))
            ratios.append(round(math.log((0.9 * p + 0.1 / STATES) / q), 6))
    return ratios


def random_spans(docs: DataFrame, ratios: list[float], limits: MarkovLimits = MarkovLimits()) -> DataFrame:
    """``docs`` (with ``base``) with ``added``: tokens that the models call random and that touch no base span."""
    text = F.coalesce(docs["text"], F.lit(""))
    model = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")
    tokens = F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))
    spans = _spans(text, TOKEN, 3, "random", text.rlike(TOKEN))
    found = docs.withColumn("_tokens", F.when(text.rlike(TOKEN), tokens).otherwise(F.array().cast("array<string>"))).withColumn("_spans", spans)

    def ratio(token: Column) -> Column:
        states = F.transform(F.split(token, ""), _state)
        pairs = let(states, lambda x: F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), lambda a, b: F.get(model, a * STATES + b)))
        return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)

    scored = F.zip_with("_spans", F.transform("_tokens", ratio), lambda s, r: F.struct(s.alias("span"), r.alias("ratio")))
    size = lambda x: x["span"]["stop"] - x["span"]["start"] - 1
    random = F.filter(scored, lambda x: (x["ratio"] > limits.total) & (x["ratio"] > limits.mean * size(x)))
    return found.withColumn("added", _apart(F.transform(random, lambda x: x["span"]), F.col("base"))).drop("_tokens", "_spans")


def _apart(spans: Column, base: Column) -> Column:
    """Those of ``spans`` that touch none of ``base``: in order of starts, no base span before reaches in, none begins inside."""
    ordered = F.sort_array(F.concat(spans, base))
    is_base = lambda x: x["kind"] < 3
    reach = lambda x: running(F.transform(x, lambda y: F.when(is_base(y), y["stop"]).otherwise(F.lit(0).cast("long"))), F.greatest)
    following = lambda x: F.reverse(running(F.reverse(F.transform(x, lambda y: F.when(is_base(y), y["start"]).otherwise(F.lit(1 << 62)))), F.least))
    met = let(ordered, lambda x: F.zip_with(F.zip_with(x, reach(x), lambda y, r: F.struct(y.alias("y"), r.alias("r"))), following(x), lambda z, f: F.struct(z["y"].alias("y"), z["r"].alias("r"), f.alias("f"))))
    clear = F.filter(met, lambda z: ~is_base(z["y"]) & (z["r"] <= z["y"]["start"]) & (z["f"] >= z["y"]["stop"]))
    return F.when(F.size(base) == 0, spans).otherwise(F.transform(clear, lambda z: z["y"]))


def scan(docs: DataFrame, ratios: list[float] | None = None, limits: MarkovLimits = MarkovLimits()) -> DataFrame:
    """``docs`` with ``base``, ``added`` and ``spans`` (both, ordered)."""
    ratios = train(docs, limits) if ratios is None else ratios
    scanned = random_spans(base_spans(docs), ratios, limits)
    return scanned.withColumn("spans", F.sort_array(F.concat("base", "added")))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind_name"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(docs: DataFrame, ratios: list[float] | None = None, mark: str = "[SECRET]") -> DataFrame:
    """``docs``' columns, each span of the text replaced by ``mark`` (overlapping spans once)."""
    docs, back = aside(docs, "base", "added", "spans", "_tokens", "_spans", "_pieces")
    step = 1024
    scanned = scan(docs, ratios).withColumn("_pieces", F.regexp_extract_all("text", F.lit(f"(?s)(.{{1,{step}}})"), F.lit(1)))

    def cut(start: Column, stop: Column) -> Column:
        """Characters start to stop, found by the pieces they lie in."""
        first = F.floor(start / step).cast("int")
        held = F.array_join(F.slice("_pieces", first + 1, F.greatest(F.floor((stop - 1) / step).cast("int") - first + 1, F.lit(0))), "")
        return F.when(stop <= start, "").otherwise(F.substring(held, (start % step + 1).cast("int"), (stop - start).cast("int")))

    def done(spans: Column) -> Column:
        reach = let(running(F.transform(spans, lambda s: s["stop"]), F.greatest), lambda r: F.concat(F.array(F.lit(0).cast("long")), r))
        met = F.zip_with(spans, reach, lambda s, r: F.struct(s["start"].alias("start"), r.alias("reach")))
        shown = F.transform(met, lambda x: F.when(x["start"].isNull(), cut(x["reach"], F.length("text").cast("long"))).when(x["start"] >= x["reach"], F.concat(cut(x["reach"], x["start"]), F.lit(mark))).otherwise(""))
        return F.array_join(shown, "")

    return scanned.withColumn("text", F.when(F.size("spans") > 0, done(F.col("spans"))).otherwise(F.col("text"))).select(*docs.columns).withColumnsRenamed(back)
