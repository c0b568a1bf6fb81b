"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree, in DataFrame functions only.

Every source's documents are laid out in hash order on an axis of words, which is cut into blocks; the
source's target says how many blocks it gives, running over the axis again when the target exceeds the
source. A binary tree splits these block quotas among the output shards: at each node the left half's
quota of each source is a hypergeometric draw given what the node still holds, so that the shards are filled as
if all blocks had been shuffled together, and totals stay exact. Sources are split in groups of FAN, whose sums
are split in groups before them, so that no row holds more than FAN sources. Each shard then takes its own run of every source's
permuted blocks, and rows carry a place to shuffle by within the shard.

Draws are exact: by inversion while their standard deviation is at most INVERTED, and by rejection (ratio of uniforms) beyond.

Nulls, ties, repeats: a null text has size 0, a null source is a source of its own and comes last. Documents
of size 0 give no word. Repeated rows are separate documents. An empty table gives an empty result. A source
may hold any share of the rows: its axis is summed over hash buckets first, and no step gathers a source. Equal rows
lie together in one bucket. One row a source is sorted in one task, for the weights go by the sources' order.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pellucid.llm.common import WORD, Scratch

#: Weights by place in code-point order, repeating; the most times that a source may be taken.
WEIGHTS, CAP = (5, 2, 1), 3
#: Words of a block, hash buckets of a source's axis at least and documents for each beyond, output shards (a power of two).
BLOCK, BUCKETS, DOCS, SHARDS = 512, 4096, 20_000, 64
#: Sources that are split at once.
FAN = 64
#: The deviation up to which draws are inverted; trials of a rejection, of which seven in ten succeed.
INVERTED, TRIALS = 64.0, 80
#: Constants of the ratio of uniforms: 2 sqrt(2 / e) and 3 - 2 sqrt(3 / e).
WIDE, SHIFT = 2 * math.sqrt(2 / math.e), 3 - 2 * math.sqrt(3 / math.e)
#: Bytes of the sources' shares that are broadcast at most.
BROADCAST = 16 << 20


def size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A source's name for joins and order: never null, and after all others for null."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def targets(sources: DataFrame) -> DataFrame:
    """sources: key, source_size. Adds target: shares of all words by weight, none above CAP times its size.

    If the k sources with the least CAP * size / weight are capped, the rest fill up to a common level per
    weight; the true level is the highest of these over k.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.row_number().over(Window.orderBy("key"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in WEIGHTS]), F.pmod(place - 1, F.lit(len(WEIGHTS))) + 1)
    t = sources.withColumn("w", w).withColumn("cap", F.col("source_size") * float(CAP)).withColumn("total", F.sum("source_size").over(everything).cast("double")).withColumn("all_w", F.sum("w").over(everything))
    before = Window.orderBy(F.col("cap") / F.col("w"), "key").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    t = t.withColumn("level", F.max("level").over(everything))
    return t.select("key", "source_size", F.least(F.col("cap"), F.col("level") * F.col("w")).alias("target"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _uniform(*keys: Column) -> Column:
    return (F.pmod(F.xxhash64(*keys), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def _rejected(s: Column, u: Column, v: Column) -> Column:
    """A draw by ratio of uniforms (Stadlober 1990). The deviation is large, so every cell of the two by two table is in the thousands at least, and
    Stirling's series is exact to a double's precision; logarithms are of ratios to the mode's cells, so that nothing cancels."""
    pop, good, draws = s["pop"].cast("double"), s["good"].cast("double"), s["draws"].cast("double")
    small = F.struct(pop.alias("pop"), F.least(good, pop - good).alias("k"), F.least(draws, pop - draws).alias("n"), s["sd"].alias("sd"))

    def cells(t: Column) -> Column:
        mode = F.floor((t["n"] + 1) * (t["k"] + 1) / (t["pop"] + 2)).cast("double")
        return _let(F.struct(t.alias("t"), mode.alias("a")), lambda c: tried(F.struct(c["t"].alias("t"), c["a"].alias("a"), (c["t"]["k"] - c["a"]).alias("b"), (c["t"]["n"] - c["a"]).alias("c"), (c["t"]["pop"] - c["t"]["k"] - c["t"]["n"] + c["a"]).alias("e"))))

    def tried(table: Column) -> Column:
        def draw(x: Column) -> Column:
            t, centre = x["t"], x["t"]["n"] * x["t"]["k"] / x["t"]["pop"] + 0.5
            spread = WIDE * F.sqrt(t["sd"] * t["sd"] + 0.5) + SHIFT

            def change(cell: Column, d: Column) -> Column:
                return (cell + d + 0.5) * F.log1p(d / cell) + (1 / (cell + d) - 1 / cell) / 12

            def judged(w: Column) -> Column:
                d = F.floor(w["w"]) - x["a"]
                log = d * F.ln((x["a"] / x["b"]) * (x["e"] / x["c"])) + change(x["a"], d) + change(x["b"], -d) + change(x["c"], -d) + change(x["e"], d)
                return F.when((F.abs(d) <= 16 * t["sd"]) & (2 * F.ln(w["u"]) <= -log), F.floor(w["w"]).cast("long"))

            def trial(got: Column, i: Column) -> Column:
                first, second = _uniform(u, v, i, F.lit(0)), _uniform(u, v, i, F.lit(1))
                once = _let(F.struct(first.alias("u"), (centre + spread * (second - 0.5) / first).alias("w")), judged)
                return F.when(got.isNotNull(), got).otherwise(once)

            return F.coalesce(F.aggregate(F.sequence(F.lit(1), F.lit(TRIALS)), F.lit(None).cast("long"), trial), x["a"].cast("long"))

        return _let(table, draw)

    def whole(z: Column) -> Column:
        of_good = F.when(s["good"] > s["pop"] - s["good"], F.least(s["draws"], s["pop"] - s["draws"]) - z).otherwise(z)
        return F.when(s["draws"] > s["pop"] - s["draws"], s["good"] - of_good).otherwise(of_good)

    return _let(_let(small, cells), whole)


def hypergeometric(population: Column, good: Column, draws: Column, u: Column, v: Column) -> Column:
    """How many of ``draws`` from ``population`` are among ``good``; u and v: uniform numbers."""

    def drawn(s: Column) -> Column:
        # s: pop, good, draws, lo, hi, mean, sd
        def inverted(_: Column) -> Column:
            a = F.greatest(s["lo"], F.floor(s["mean"] - 7 * s["sd"] - 3))
            b = F.least(s["hi"], F.ceil(s["mean"] + 7 * s["sd"] + 3))

            def step(acc: Column, x: Column) -> Column:
                # the log of p(x) / p(a), by the ratio of neighbours
                up = (s["good"] - x + 1).cast("double") * (s["draws"] - x + 1) / (x.cast("double") * (s["pop"] - s["good"] - s["draws"] + x))
                return F.struct((acc["log"] + F.ln(up)).alias("log"), F.concat(acc["logs"], F.array(acc["log"] + F.ln(up))).alias("logs"))

            logs = F.aggregate(F.filter(F.sequence(a, b), lambda x: x > a), F.struct(F.lit(0.0).alias("log"), F.array(F.lit(0.0)).alias("logs")), step)["logs"]

            def pick(ps: Column) -> Column:
                def walk(acc: Column, p: Column) -> Column:
                    more = acc["left"] - p
                    return F.struct(more.alias("left"), (acc["at"] + F.when(more > 0, 1).otherwise(0)).cast("long").alias("at"))

                whole = F.aggregate(ps, F.lit(0.0), lambda acc, p: acc + p)
                return F.aggregate(ps, F.struct((u * whole).alias("left"), F.lit(0).cast("long").alias("at")), walk)["at"]

            scaled = _let(logs, lambda ls: _let(F.array_max(ls), lambda top: F.transform(ls, lambda x: F.exp(x - top))))
            return F.least(b, a + _let(scaled, pick))

        return F.when(s["lo"] == s["hi"], s["lo"]).when(s["sd"] <= INVERTED, inverted(s)).otherwise(_rejected(s, u, v))

    n_, k_, d_ = population.cast("double"), good.cast("double"), draws.cast("double")
    mean = F.when(population > 0, d_ * k_ / F.greatest(n_, F.lit(1.0))).otherwise(0.0)
    var = F.when(population > 1, mean * (1 - k_ / F.greatest(n_, F.lit(1.0))) * (n_ - d_) / F.greatest(n_ - 1, F.lit(1.0))).otherwise(0.0)
    state = F.struct(population.alias("pop"), good.alias("good"), draws.alias("draws"), F.greatest(F.lit(0).cast("long"), draws - (population - good)).alias("lo"), F.least(draws, good).alias("hi"), mean.alias("mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("sd"))
    return _let(state, drawn)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def _dealt(groups: DataFrame, shards: int, seed: int) -> DataFrame:
    """groups: group, ids, quota (of each id) and cols (of each shard, with the quotas' sum). Returns id and counts: its
    blocks in each shard, as if the group's blocks had been dealt to the shards at random."""
    nodes = groups.select("group", F.lit(0).cast("long").alias("node"), "ids", "quota", "cols")
    depth = shards.bit_length() - 1

    def folded(level: int) -> Callable[[Column, Column], Column]:
        def fold(acc: Column, q: Column) -> Column:
            u, v = (_uniform(F.lit(seed), F.lit(level), F.col("group"), F.col("node"), F.size(acc["out"]), F.lit(c)) for c in (0, 1))
            return _let(hypergeometric(acc["pop"], q, acc["draws"], u, v), lambda x: F.struct((acc["pop"] - q).alias("pop"), (acc["draws"] - x).alias("draws"), F.concat(acc["out"], F.array(x)).alias("out")))

        return fold

    for level in range(depth):
        half = shards >> level + 1
        cols = F.slice("cols", 1, half), F.slice("cols", half + 1, half)
        start = F.struct(_total(F.col("quota")).alias("pop"), _total(cols[0]).alias("draws"), F.array().cast("array<bigint>").alias("out"))
        split = nodes.withColumn("left", F.aggregate("quota", start, folded(level))["out"])
        both = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("quota"), cols[0].alias("cols")), F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("quota", "left", lambda q, x: q - x).alias("quota"), cols[1].alias("cols")))
        nodes = split.select("group", "ids", F.explode(both).alias("b")).select("group", "b.node", "ids", "b.quota", "b.cols")
    flat = nodes.select("node", F.explode(F.arrays_zip("ids", "quota")).alias("q")).select(F.col("q.ids").alias("id"), F.struct("node", F.col("q.quota").alias("k")).alias("k"))
    return flat.groupBy("id").agg(F.sort_array(F.collect_list("k"))["k"].alias("counts"))  # as many as there are shards


def split_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """quotas: key, blocks. Returns key and bounds: for each shard, the blocks of that source in it and in all before."""
    ranked = quotas.select("key", "blocks", (F.row_number().over(Window.orderBy("key")) - 1).cast("long").alias("id"))
    n, levels = quotas.count(), [ranked.select("id", "blocks")]
    group = F.floor(F.col("id") / FAN)
    while n > FAN:
        n = -(-n // FAN)
        levels.append(levels[-1].groupBy(group.alias("id")).agg(F.sum("blocks").alias("blocks")))
    # The shards are as large as each other, to one block.
    part = lambda j: F.floor(_total(F.col("quota")) * j / shards)
    cols = None
    for n, level in reversed(list(enumerate(levels))):
        groups = level.groupBy(group.alias("group")).agg(F.sort_array(F.collect_list(F.struct("id", "blocks"))).alias("s"))  # FAN at most
        groups = groups.select("group", F.col("s.id").alias("ids"), F.col("s.blocks").alias("quota"))
        if cols is None:
            groups = groups.withColumn("cols", F.array(*[part(j + 1) - part(j) for j in range(shards)]))
        else:
            groups = groups.join(cols, groups["group"] == cols["of"]).drop("of")
        cols = _dealt(groups, shards, seed + n).select(F.col("id").alias("of"), F.col("counts").alias("cols"))
    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("all"))
    add = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["all"], F.array(acc["sum"] + x)).alias("all"))
    return ranked.join(cols, ranked["id"] == cols["of"]).select("key", F.aggregate("cols", zero, add)["all"].alias("bounds"))


def mix(docs: DataFrame, scratch: Scratch, keep: list[str], seed: int = 11, shards: int = SHARDS, block: int = BLOCK) -> DataFrame:
    """A row for each document: row (a struct of the kept columns), size, source_size, target and pieces.

    pieces: an array of (pass, start, length, block, shard): words of the document that the mix takes.
    """
    rows = docs.select(F.struct(*keep).alias("row"), source_key(F.col("source").cast("string")).alias("key"), size(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"))
    if "text" not in keep:
        rows = scratch.save(rows)  # so that texts are read once
    buckets = max(BUCKETS, docs.count() // DOCS)
    rows = rows.withColumn("bucket", F.pmod(F.shiftright("h", 20), F.lit(buckets)).cast("int"))
    sums = scratch.save(rows.groupBy("key", "bucket").agg(F.sum("size").alias("n")))
    axis = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    plan = targets(sums.groupBy("key").agg(F.sum("n").alias("source_size"))).withColumn("words", F.least(F.floor(F.col("target") + 0.5), CAP * F.col("source_size")))
    plan = scratch.save(plan.withColumn("blocks", F.ceil(F.col("words") / block)))
    plan = scratch.save(plan.drop("blocks").join(split_tree(plan.select("key", "blocks"), shards, seed), "key"))
    placed = scratch.save(sums.withColumn("base", F.coalesce(F.sum("n").over(axis), F.lit(0))).drop("n"))
    inside = Window.partitionBy("key", "bucket").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("run", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    # A source has a row of about 8 * shards bytes. Many sources are joined to the buckets first, whose rows are spread evenly.
    if plan.count() * shards * 8 <= BROADCAST:
        rows = rows.join(placed, ["key", "bucket"]).join(F.broadcast(plan), "key")
    else:
        rows = rows.join(placed.join(plan, "key"), ["key", "bucket"])
    begin = F.col("base") + F.col("run")

    def of_pass(p: int) -> Column:
        lo = begin + p * F.col("source_size")
        hi = F.least(lo + F.col("size"), F.col("words"))

        def piece(b: Column) -> Column:
            start, stop = F.greatest(lo, b * block), F.least(hi, (b + 1) * block)
            return F.struct(F.lit(p).alias("pass"), (start - lo).alias("start"), (stop - start).alias("length"), b.alias("block"), F.size(F.filter("bounds", lambda x: x <= b)).alias("shard"))

        return F.when(hi > lo, F.transform(F.sequence(F.floor(lo / block), F.floor((hi - 1) / block)), piece)).otherwise(F.array().cast("array<struct<pass:int,start:bigint,length:bigint,block:bigint,shard:int>>"))

    return rows.select("row", "size", "source_size", "target", F.flatten(F.array(*[of_pass(p) for p in range(CAP)])).alias("pieces"))


def taken(pieces: Column) -> Column:
    return F.aggregate(pieces, F.lit(0).cast("long"), lambda a, p: a + p["length"])


def shards_of(pieces: Column) -> Column:
    """The shards that a document's pieces go to."""
    return F.array_sort(F.array_distinct(F.transform(pieces, lambda p: p["shard"])))


def apply(docs: DataFrame, scratch: Scratch, seed: int = 11, shards: int = SHARDS) -> DataFrame:
    """The mixed documents with the columns of docs: a row for each time that a document is taken, with its text or,
    where a target ends inside it, the words up to there. A document goes whole to the shard of its first block; rows are grouped by
    shard and shuffled locally."""
    mixed = mix(docs, scratch, docs.columns, seed, shards)
    times = F.transform(F.array_distinct(F.transform("pieces", lambda p: p["pass"])), lambda k: F.struct(k.alias("pass"), F.filter("pieces", lambda p: p["pass"] == k).alias("own")))
    rows = mixed.select("row", "size", F.explode(times).alias("t")).select("row", "size", taken(F.col("t.own")).alias("n"), F.col("t.own")[0]["shard"].alias("shard"), F.col("t.own")[0]["block"].alias("block"), F.col("t.pass").alias("pass"))
    place = F.xxhash64(F.lit(seed), "shard", "block", "pass", F.col("row.doc_id"), F.col("row.text"))
    cells = max(1, docs.count() // (shards * DOCS))
    rows = rows.withColumn("place", place).repartition("shard", F.pmod("place", F.lit(cells))).sortWithinPartitions("shard", "place")
    text = F.when(F.col("n") == F.col("size"), F.col("row.text")).otherwise(F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("n").cast("int")), " "))
    out = rows.select("row", text.alias("mixed_text"))
    return out.select(*[F.col("mixed_text").alias(c) if c == "text" else F.length("mixed_text").cast("long").alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in docs.columns])
