"""Line dedup by an exact set-similarity join, in DataFrame functions only.

A line is the set of its tokens (what stands between blanks).  Two lines match if the Jaccard
similarity of their sets is at least `THRESHOLD`.  A line goes if any earlier line matches it, by
(doc_id, line number), whether or not that one stays.

Tokens are ordered by rarity; only the rarest tokens of a line, its prefix, are joined.  Candidates
pass the length filter, the positional filter and a parity filter (sets that differ in d tokens
differ in d bits of a signature at most) within the join, and are then verified on whole sets.
Equal sets are one entity, so copies never meet in pairs; what a few early tests have decided to go
isn't paired with its like again.  The join runs in ranges of the token space, so that its shuffle
files never lie on disk together.

Lines without a token never match and stay; null texts stay null; null doc_ids rank last; rows of
equal doc_id and different texts are documents of their own, ranked by the hash of the text; of rows
that are equal in both, one is first and the others lose all their lines with tokens; an empty table
gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import aside, discard, few, flag_twins, sweep, table

THRESHOLD = (80, 100)
#: The rarity sketch has 2**BUCKET_BITS buckets; its size is fixed, and any order of tokens gives the same result.
BUCKET_BITS = 17
RANGES = 8
#: The ranges of each join; what the first joins decide isn't paired with its like in the later ones.
JOINS = (((0,),), ((1, 2), (3, 4), (5, 6, 7)))
#: Pairs of neighbouring rarest tokens under which near copies meet before the join, and at which
#: places before itself each one meets there besides the earliest.
KEYS, BEFORE = 5, (1, 2, 4, 16, 64)
#: Sets of more tokens have a signature of 128 bits, others one of 64.
WIDE = 64
LAST = (1 << 63) - 1


def hashes(line: Column) -> Column:
    """The distinct hashes of a line's tokens.

    Below a function with a lambda, `array_distinct` would be evaluated on boxed numbers: a column
    of its own, used more than once, is not.
    """
    return F.array_remove(F.array_distinct(F.transform(F.split(line, " "), lambda t: F.xxhash64(t))), F.xxhash64(F.lit("")))


def rarity(docs: DataFrame) -> str:
    """The logarithm of the number of tokens in each bucket of token hashes, as the upper 8 bits of numbers, as text."""
    tokens = docs.select(F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("t"))
    counts = tokens.groupBy(F.shiftrightunsigned(F.xxhash64("t"), 64 - BUCKET_BITS).alias("b")).agg(F.count("*").alias("n"))
    out = [0] * (1 << BUCKET_BITS)
    for b, n in counts.collect():  # one row a bucket at most
        out[b] = int(math.log2(n) * 2) << 56
    return ",".join(map(str, out))


def ordered_tokens(tokens: Column, levels: str) -> Column:
    """The ids of hashed tokens, rarest first: 56 bits of hash under 8 bits of frequency."""
    table_of = F.split(F.lit(levels), ",").cast("array<bigint>")  # folded to a constant by the optimizer

    def key(h: Column) -> Column:
        level = F.get(table_of, F.shiftrightunsigned(h, 64 - BUCKET_BITS))
        return F.coalesce(level, F.lit(0).cast("bigint")).bitwiseOR(F.shiftrightunsigned(h, 8))  # without nulls, numbers are sorted as such

    return F.sort_array(F.transform(tokens, key))


def parity(tokens: Column) -> tuple[Column, Column]:
    """A signature: every token flips one bit.  Of sets of up to `WIDE` tokens, the second word is null and the first one both XORed."""
    none, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    flip = lambda acc, t: acc.bitwiseXOR(F.call_function("shiftleft", one, t.bitwiseAND(F.lit(63)).cast("int")))
    both = F.aggregate(tokens, none, flip)
    upper = F.aggregate(F.filter(tokens, lambda t: t.bitwiseAND(F.lit(64)) != 0), none, flip)
    second = F.when(F.size(tokens) > WIDE, upper)  # the same expression in both words, outside of branches: evaluated once
    return both.bitwiseXOR(F.coalesce(second, none)), second


def differing(x: str, y: str) -> Column:
    """The differing bits of two signatures; where one is of 64 bits, of both folded to that."""
    x1, x2, y1, y2 = (F.col(f"{side}.{s}") for side in (x, y) for s in ("s1", "s2"))
    none = F.lit(0).cast("bigint")
    narrow = F.bit_count(x1.bitwiseXOR(y1).bitwiseXOR(F.coalesce(x2, none)).bitwiseXOR(F.coalesce(y2, none)))
    return F.coalesce(F.bit_count(x1.bitwiseXOR(y1)) + F.bit_count(x2.bitwiseXOR(y2)), narrow)


def lines_of(docs: DataFrame) -> DataFrame:
    """rank, part, line_no, line of every line."""
    return docs.select("rank", "part", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def prefix_size(n: Column, num: int, den: int) -> Column:
    return (n - F.ceil(n * num / den) + 1).cast("int")


PLACE = ("rank", "part", "line_no")


def ranked(docs: DataFrame) -> DataFrame:
    """`docs` with _rank and _part, the rank of a document, and _twin.

    _rank is the doc_id; _part is the hash of the text where different texts share that, or else 0;
    _twin is true for all but one of the rows that are equal in both.
    """
    text = F.col("text").cast("string")
    rows = docs.withColumns({"_rank": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), "_part": F.coalesce(F.xxhash64(text), F.lit(0))})
    again = rows.groupBy("_rank").agg(F.count("*").alias("n"), F.min("_part").alias("lo"), F.max("_part").alias("hi")).filter("n > 1")
    again = table(again.select("_rank", (F.col("lo") != F.col("hi")).alias("_shared")))
    if again.isEmpty():
        return rows.withColumns({"_part": F.lit(0).cast("long"), "_twin": F.lit(False)})
    rows = rows.join(few(again), "_rank", "left").withColumn("_shared", F.coalesce("_shared", F.lit(False)))
    rows = rows.withColumn("_part", F.when(F.col("_shared"), F.col("_part")).otherwise(F.lit(0))).drop("_shared")
    return flag_twins(rows, "_rank", "_part")


class Dedup:
    def __init__(self, docs: DataFrame, threshold: tuple[int, int] = THRESHOLD):
        """`docs` as `ranked` gives them."""
        self.num, self.den = threshold
        self.spark = docs.sparkSession
        self.docs = docs.filter(~F.col("_twin")).select(F.col("_rank").alias("rank"), F.col("_part").alias("part"), F.col("text").cast("string").alias("text"))

    def sets(self) -> DataFrame:
        """The place of each line, and the hash, size, prefix and signature of its set."""
        rows = lines_of(self.docs).select(*PLACE, hashes(F.col("line")).alias("hs"))
        rows = rows.select(*PLACE, ordered_tokens(F.col("hs"), self.levels).alias("ts"), F.size("hs").alias("n"))
        s1, s2 = parity(F.col("ts"))
        return rows.select(*PLACE, F.xxhash64("ts").alias("ent"), "n", F.slice("ts", F.lit(1), prefix_size(F.col("n"), self.num, self.den)).alias("pre"), s1.alias("s1"), s2.alias("s2"))

    def entities(self) -> None:
        """`lines` (place, ent) and `ents`: the first place, size, prefix and signature of each set."""
        self.levels = rarity(self.docs)
        # computed columns are not filtered before they are written: a filter would compute them twice
        rows = table(self.sets())
        full = rows.filter("n > 0")
        self.lines = table(full.select(*PLACE, "ent"))
        firsts = [F.first(c).alias(c) for c in ("n", "pre", "s1", "s2")]
        self.ents = table(full.groupBy("ent").agg(F.min(F.struct(*PLACE)).alias("at"), *firsts))
        discard(rows)
        sweep(self.spark)

    def near(self, xn: Column, yn: Column, bits: Column) -> Column:
        """Whether sizes and signatures allow the threshold; signatures differ in at most as many bits as the sets in tokens."""
        length = F.least(xn, yn) * self.den >= F.greatest(xn, yn) * self.num
        return length & (bits * (self.num + self.den) <= (xn + yn) * (self.den - self.num))

    def early(self) -> DataFrame:
        """Pairs of each entity and an earlier one with some equal rarest tokens.

        Under each of a few keys an entity meets the earliest entity of the key and the one before
        itself, so that members of large groups of near copies are decided by few tests.
        """
        pairs = F.transform(F.slice("pre", 2, KEYS), lambda t, i: F.xxhash64(F.get("pre", i), t))
        keys = F.when(F.size("pre") > 1, pairs).otherwise(F.slice("pre", 1, 1))
        keyed = self.ents.select(F.explode(keys).alias("k"), "at", F.struct("ent", "n", "s1", "s2", "at").alias("x"))
        order = Window.partitionBy("k").orderBy("at")
        earliest = F.first("x").over(order.rowsBetween(Window.unboundedPreceding, 0))
        met = keyed.select("x", F.array(earliest, *(F.lag("x", d).over(order) for d in BEFORE)).alias("ys"))
        met = met.select("x", F.explode("ys").alias("y")).filter((F.col("y.at") < F.col("x.at")) & self.near(F.col("x.n"), F.col("y.n"), differing("x", "y")))
        return table(met.select(F.col("x.ent").alias("a"), F.col("x.at").alias("at_a"), F.col("y.ent").alias("b"), F.col("y.at").alias("at_b")).distinct())

    def met(self, ranges: tuple[int, ...], shadowed: DataFrame) -> DataFrame:
        """The pairs of entities, the later one first, that pass all filters under tokens of some ranges.

        A pair only matters if the later of the two isn't shadowed yet.
        """
        num, den = self.num, self.den
        ents = self.ents.join(few(shadowed).withColumn("out", F.lit(True)), "ent", "left")  # moves the ids, not the prefixes
        # size and line number share a column, and so do position and whether the entity is open
        size = F.shiftleft(F.col("n").cast("bigint"), 32).bitwiseOR(F.col("at.line_no").cast("bigint")).alias("size")
        flat = ents.select("ent", size, F.col("out").isNull().cast("int").alias("open"), "at.rank", "at.part", "s1", "s2", F.posexplode("pre").alias("pos", "tok"))
        flat = flat.filter(F.col("tok").bitwiseAND(F.lit(RANGES - 1)).isin(*ranges))
        flat = flat.select("tok", "ent", "size", "rank", "part", "s1", "s2", (F.col("pos") * 2 + F.col("open")).alias("pos"))
        n = lambda side: F.shiftright(f"{side}.size", 32)
        pos = lambda side: F.shiftright(f"{side}.pos", 1)
        at = lambda side: F.struct(F.col(f"{side}.rank").alias("rank"), F.col(f"{side}.part").alias("part"), F.col(f"{side}.size").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("line_no"))
        own = F.shiftright("size", 32)
        x, y = flat.alias("x"), flat.filter(F.shiftright("pos", 1) < own - F.ceil(own * (2 * num) / (num + den)) + 1).alias("y")
        smaller = (n("y") < n("x")) | ((n("y") == n("x")) & (F.col("y.ent") < F.col("x.ent")))
        place = F.least(n("x") - pos("x"), n("y") - pos("y")) * (num + den) >= (n("x") + n("y")) * num
        less = lambda a, b: F.col(a) < F.col(b)
        same = lambda a, b: F.col(a) == F.col(b)
        line = lambda side: F.col(f"{side}.size").bitwiseAND(F.lit((1 << 32) - 1))
        x_later = less("y.rank", "x.rank") | (same("x.rank", "y.rank") & (less("y.part", "x.part") | (same("x.part", "y.part") & (line("x") > line("y")))))
        matters = F.when(x_later, F.col("x.pos").bitwiseAND(F.lit(1)) == 1).otherwise(F.col("y.pos").bitwiseAND(F.lit(1)) == 1)
        pairs = x.join(y, (F.col("x.tok") == F.col("y.tok")) & smaller & matters & place & self.near(n("x"), n("y"), differing("x", "y")))
        side = lambda of: F.struct(F.col(f"{of}.ent").alias("ent"), at(of).alias("at"))
        pairs = pairs.select(F.when(x_later, side("x")).otherwise(side("y")).alias("a"), F.when(x_later, side("y")).otherwise(side("x")).alias("b"))
        return table(pairs.select(F.col("a.ent").alias("a"), F.col("a.at").alias("at_a"), F.col("b.ent").alias("b"), F.col("b.at").alias("at_b")).distinct())

    def candidates(self, joins: tuple[tuple[int, ...], ...], shadowed: DataFrame) -> DataFrame:
        """The candidate pairs of some joins; the shuffle files of one are dropped before the next."""
        parts = []
        for ranges in joins:
            parts.append(self.met(ranges, shadowed))
            sweep(self.spark)
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        out = table(out.distinct())
        discard(*parts)
        return out

    def later(self, pairs: DataFrame) -> DataFrame:
        """ent: the later entity of every pair that reaches the threshold."""
        links = self.verified(pairs)
        out = table(links.select(F.col("a").alias("ent")).distinct())
        discard(pairs, links)
        sweep(self.spark)
        return out

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose whole sets reach the threshold."""
        ends = pairs.select(F.col("a").alias("ent"), "at_a.*").unionByName(pairs.select(F.col("b").alias("ent"), "at_b.*"))
        homes = table(ends.distinct())
        docs = self.docs.join(few(table(homes.select("rank", "part").distinct())), ["rank", "part"], "left_semi")
        rows = lines_of(docs).join(few(homes), list(PLACE))
        sets = rows.select("ent", hashes(F.col("line")).alias("ts"))
        sets = table(sets.groupBy("ent").agg(F.first("ts").alias("ts")))
        both = pairs.join(sets.select(F.col("ent").alias("a"), F.col("ts").alias("ta")), "a").join(sets.select(F.col("ent").alias("b"), F.col("ts").alias("tb")), "b")
        both = both.withColumn("c", F.size(F.array_intersect("ta", "tb")))
        out = table(both.filter(F.col("c") * self.den >= (F.size("ta") + F.size("tb") - F.col("c")) * self.num).select("a", "b"))
        discard(sets, homes)
        sweep(self.spark)
        return out

    def removed(self) -> DataFrame:
        """rank, part and gone: for each document the bits, by 64, of the line numbers that go."""
        self.entities()
        shadowed = self.later(self.early())
        for joins in JOINS:
            more = self.later(self.candidates(joins, shadowed))
            both = table(shadowed.unionByName(more).distinct())
            discard(shadowed, more)
            shadowed = both
        out = self.ents.select("ent", "at").join(few(shadowed).withColumn("out", F.lit(True)), "ent", "left")
        gone = self.lines.join(out, "ent").filter(F.col("out").isNotNull() | (F.struct(*PLACE) > F.col("at")))
        words = gone.groupBy("rank", "part", F.shiftright("line_no", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, line_no & 63)")).alias("m"))
        found = table(words.groupBy("rank", "part").agg(F.map_from_entries(F.collect_list(F.struct("w", "m"))).alias("gone")))
        discard(shadowed, self.ents, self.lines)
        sweep(self.spark)
        return found


def with_removed(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """`docs` with _kept (the remaining lines, null for a null text) and _gone (their number of removed lines)."""
    rows = ranked(docs)
    found = few(Dedup(rows, threshold).removed())
    found = found.select(F.col("rank").alias("_rank"), F.col("part").alias("_part"), F.col("gone").alias("_map"))
    text = F.col("text").cast("string")
    rows = rows.join(found, ["_rank", "_part"], "left").withColumn("_lines", F.split(text, "\n"))
    lines = F.col("_lines")

    def stays(_, i: Column) -> Column:
        word = F.coalesce(F.element_at("_map", F.shiftright(i, 6)), F.lit(0).cast("long"))
        return F.call_function("shiftright", word, i.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1)) == 0

    blank = F.filter(lines, lambda x: F.trim(x) == "")
    kept = F.when(F.col("_twin"), blank).when(F.col("_map").isNull(), lines).otherwise(F.filter(lines, stays))
    return rows.withColumn("_kept", kept).withColumn("_gone", F.size(lines) - F.size("_kept")).drop("_rank", "_part", "_map", "_twin", "_lines")


def report(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """doc_id, n_lines, n_removed, text (the lines that stay)."""
    rows = with_removed(docs.select("doc_id", "text"), threshold)
    n = F.coalesce(F.size("_kept") + F.col("_gone"), F.lit(0))
    text = F.when(F.col("_gone") > 0, F.array_join("_kept", "\n")).otherwise(F.col("text").cast("string"))
    return rows.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(n).alias("n_lines"), F.when(F.col("text").isNull(), 0).otherwise(F.col("_gone")).alias("n_removed"), text.alias("text"))


def drop_lines(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """`docs` without the lines that go, and without the documents of which nothing stays."""
    plain, back = aside(docs, "doc_id", "text", "n_chars")
    rows = with_removed(plain, threshold)
    text = F.when(F.col("_gone") > 0, F.array_join("_kept", "\n")).otherwise(F.col("text"))
    rows = rows.filter(F.col("text").isNull() | (F.size("_kept") > 0)).withColumn("text", text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("_gone") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return back(rows)
