"""N-gram Jaccard join by vertical partitioning of the global n-gram order.

The order of shingles is that of their hashes; it is cut into fragments, which are ranges of it.
Two sets of up to h shingles that reach the threshold differ in a bounded number d of shingles, each
of which lies in one fragment; of more than d fragments, at least one is the same in both sets.  So
documents meet under equal fragments, which unrelated documents hardly ever share.  The number of
fragments depends on the size level of a document; near the border of two levels it has both.

Equal sets are one entity, so copies never meet in pairs.  Members of a fragment group are first
tested against one hub of the group.  Then every entity names the members of its groups that are in
other components and whose sketches are close enough, the closest `CLOSEST` first; if any had more,
that is repeated with more on what is still apart, until all are tested.  So no link that joins two
components is lost, although links within a component are not all listed.  Groups are compared in
blocks of bounded size, in place: what leaves a task are only pairs that the sketches let pass.  A
pair is tested by partial overlaps, counted fragment by fragment and summed.

Null texts and texts without words have no shingle and link with nothing; ties and repeated rows
are equal sets; repeated or null doc_ids return one row per input row; an empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import components
from .scratch import aside, bitmap, discard, few, flag_twins, prepare, seen, sweep, table
from .textops import NOT_SPACE, column, mix, part, shingles, slices, utf8

SEED = 8
#: The bits of a sketch at least.
SKETCH = 512
#: Partners that an entity names at once, and how many times more in the next round.
CLOSEST, MORE = 16, 8
#: A block of a group has at most so many entities and 64-bit words of sketches.
BLOCK, BLOCK_WORDS = 4096, 1 << 20
#: Pairs compared at once.
CELLS = 1 << 20
FRAGMENTS = 4
#: Ranges of fragment keys that are grouped one after the other.
RANGES = 4
ROWS = "token long, ent long, n long, doc_id long, tk long, sketch array<long>"


def sets_of(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    return shingles(data, offsets, k, NOT_SPACE, SEED)


def entity(s: np.ndarray) -> int:
    """A 64-bit digest of a set."""
    if not len(s):
        return 0
    a = np.add.reduce(mix(s + np.uint64(1)), keepdims=True)
    b = np.bitwise_xor.reduce(mix(s ^ np.uint64(0x5BD1E995)), keepdims=True)
    return int(mix(a + b + np.uint64(len(s))).view(np.int64)[0])


def parities(s: np.ndarray, size: int) -> np.ndarray:
    return np.bincount((mix(s) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1


def packed(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def sketch(s: np.ndarray) -> np.ndarray:
    """Bit i is the parity of the number of shingles that hash to i.

    Sets that differ in d shingles differ in d bits at most.  There are one to two bits a shingle,
    `SKETCH` at least, in all a power of two; the halves of a sketch, XORed, are the sketch with half the bits.
    """
    return packed(parities(s, max(SKETCH, 1 << int(len(s) - 1).bit_length())))


def folded(sketches: np.ndarray, width: int) -> np.ndarray:
    """Sketches, one a row, with fewer words."""
    while sketches.shape[1] > width:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The number of differing bits of each row of x and each of y."""
    out = np.zeros((len(x), len(y)), np.int32)
    for k in range(x.shape[1]):
        out += np.bitwise_count(x[:, k, None] ^ y[None, :, k])
    return out


def near(n: np.ndarray, comp: np.ndarray, block: np.ndarray, sketches: list[np.ndarray], num: int, den: int):
    """Index pairs and differing bits of the members of two blocks (or one) that may be similar and are in different components."""
    widths = np.array([len(x) for x in sketches])
    sides = []
    for w in np.unique(widths):
        own = np.flatnonzero(widths == w)
        own = own[np.argsort(n[own], kind="stable")]
        sides.append((own, n[own], np.stack([sketches[i] for i in own])))
    two = block.min() != block.max()
    for p, (xs, xn, x) in enumerate(sides):
        for q in range(p, len(sides)):
            ys, yn, y = sides[q]
            y = folded(y, x.shape[1])
            step = max(1, CELLS // len(ys))
            for a in range(0, len(xs), step):
                i, ni = xs[a : a + step], xn[a : a + step]
                lo, hi = np.searchsorted(yn, -(-ni[0] * num // den)), np.searchsorted(yn, ni[-1] * den // num, side="right")
                if p == q:
                    lo = max(lo, a)
                if lo >= hi:
                    continue
                j, nj = ys[lo:hi], yn[lo:hi]
                ok = comp[i][:, None] != comp[j][None, :]
                if two:
                    ok &= block[i][:, None] != block[j][None, :]
                if not ok.any():
                    continue
                ok &= np.minimum(ni[:, None], nj) * den >= np.maximum(ni[:, None], nj) * num
                if p == q:
                    ok &= np.arange(a, a + len(i))[:, None] < np.arange(lo, hi)
                most = (ni[:, None] + nj) * (den - num) // (num + den)
                half = x.shape[1] // 2  # most pairs differ too much in half of their bits already
                bits = differing(x[a : a + step, :half], y[lo:hi, :half])
                r, c = np.nonzero(ok & (bits <= most))
                for at in range(0, len(r), max(1, CELLS // half)):
                    i_, j_ = r[at : at + max(1, CELLS // half)], c[at : at + max(1, CELLS // half)]
                    all_bits = bits[i_, j_] + np.bitwise_count(x[a + i_, half:] ^ y[lo + j_, half:]).sum(axis=1, dtype=np.int32)
                    near_ = all_bits <= most[i_, j_]
                    if near_.any():
                        yield i[i_[near_]], j[j_[near_]], all_bits[near_]


def closest(ents: np.ndarray, comp: np.ndarray, found, most: int):
    """Of the found pairs, those that are among the `most` closest of the end that names them, and whether that end has more.

    The end whose component has fewer members here names the pair, so that a large component
    doesn't name a few strangers again and again.
    """
    _, inverse, size = np.unique(comp, return_inverse=True, return_counts=True)
    size = size[inverse]
    held = []

    def cut(parts):
        who, other, bits = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((ents[other], bits, who))
        who, other, bits = who[order], other[order], bits[order]
        first = np.concatenate([[True], who[1:] != who[:-1]])
        rank = np.arange(len(who)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        keep = rank <= most  # one more than asked for tells that there are more
        return who[keep], other[keep], bits[keep], rank[keep]

    for i, j, bits in found:
        flip = (size[j] < size[i]) | ((size[j] == size[i]) & (ents[j] < ents[i]))
        held.append((np.where(flip, j, i), np.where(flip, i, j), bits))
        if sum(len(x[0]) for x in held) > 4 * CELLS:
            held = [cut(held)[:3]]
    if not held:
        return None
    who, other, bits, rank = cut(held)
    more = np.isin(who, who[rank == most])
    return who[rank < most], other[rank < most], bits[rank < most], more[rank < most]


def partners(num: int, den: int, most: int):
    """Sorted rows of blocks (token, i, j, own, ent, n, comp, sketch) -> named pairs (a, an, b, bn, bits, more)."""
    names = ["token", "i", "j", "own", "ent", "n", "comp"]

    def group(rows):
        n, comp, block, ents = (np.concatenate([r[k] for r in rows]) for k in (5, 6, 3, 4))
        if len(n) < 2 or comp.min() == comp.max():
            return None
        got = closest(ents, comp, near(n, comp, block, [x for r in rows for x in r[7]], num, den), most)
        if got is None:
            return None
        who, other, bits, more = got
        return ents[who], n[who], ents[other], n[other], bits, more

    def batch_of(parts):
        kinds = [pa.int64()] * 4 + [pa.int32(), pa.bool_()]
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["a", "an", "b", "bn", "bits", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            cols = [column(batch, c).to_numpy() for c in names]
            sk = column(batch, "sketch")
            at, words = sk.offsets.to_numpy(), sk.values.to_numpy().view(np.uint64)
            sketches = [words[x:y] for x, y in zip(at, at[1:])]
            keys = np.stack(cols[:3])
            new = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)])) if batch.num_rows else []
            out = []
            for a, b in zip(new, [*new[1:], batch.num_rows]):
                key = tuple(keys[:, a].tolist())
                if key != now:
                    if held and (got := group(held)):
                        out.append(got)
                    held, now = [], key
                held.append([*(c[a:b] for c in cols), sketches[a:b]])
            yield batch_of(out)
        out = [got] if held and (got := group(held)) else []
        yield batch_of(out)

    return run


def levels(n: int, num: int, den: int) -> list[tuple[int, int, int]]:
    """The size levels of a set of n shingles: (level, fragments, spare fragments).

    A level holds the pairs whose larger set has between 2**((level - 1) / 2) and 2**(level / 2)
    shingles.  Of its fragments, at least the spare ones and one more are the same in both sets.
    """
    out = []
    level = max(0, int(np.ceil(2 * np.log2(n) - 1e-9)))
    while 2 ** ((level - 1) / 2) * num <= n * den:  # the larger set of a pair may be on a higher level
        most = int(2 ** (level / 2))
        if most >= n:
            differ = 2 * most * (den - num) // (den + num)
            spare = 2 + differ // 32 if differ else 0
            out.append((level, differ + 1 + spare, spare))
        level += 1
    return out


def fragment_keys(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """Hashes of all fragments of a set: level, place and content."""
    mixed = mix(s)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed)])
    out = []
    for level, fragments, spare in levels(len(s), num, den):
        place = ((s >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)
        edges = np.searchsorted(place, np.arange(fragments + 1, dtype=np.uint64))
        key = mix(sums[edges[1:]] - sums[edges[:-1]] + mix(np.arange(fragments, dtype=np.uint64) * np.uint64(1 << 20) + np.uint64(level)))
        full = edges[1:] > edges[:-1]
        # empty fragments say little; they are needed only where a set has more of them than there are spare ones
        out.append(key if fragments - int(full.sum()) > spare else key[full])
    return np.concatenate(out)


def keyed(k: int, num: int, den: int):
    """Per document a row (token null): doc_id, set size, entity, sketch; per fragment a row with its key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            ids, keys = column(batch, "doc_id").cast(pa.int64()), column(batch, "tk")
            data, offsets = utf8(column(batch, "text"))
            sizes, entities = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            tokens, ents, ns, sketches = [], [], [], [None] * batch.num_rows
            if len(done) > 1_000_000:
                done.clear()
            for i, j in slices(offsets):
                for row, s in enumerate(sets_of(*part(data, offsets, i, j), k), i):
                    n = sizes[row] = len(s)
                    if not n:
                        continue
                    e = entities[row] = entity(s)
                    if e in done:
                        continue
                    done.add(e)
                    tokens.append(fragment_keys(s, num, den))
                    ents.append(np.full(len(tokens[-1]), e))
                    ns.append(np.full(len(tokens[-1]), n))
                    sketches[row] = sketch(s)
            m = sum(map(len, tokens))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.nulls(batch.num_rows, pa.int64()), pa.array(np.concatenate([np.zeros(0, np.uint64), *tokens]).view(np.int64))]),
                    pa.array(np.concatenate([entities, *ents]).astype(np.int64)),
                    pa.array(np.concatenate([sizes, *ns]).astype(np.int64)),
                    pa.concat_arrays([ids, pa.nulls(m, pa.int64())]),
                    pa.concat_arrays([keys, pa.nulls(m, pa.int64())]),
                    pa.concat_arrays([pa.array(sketches, pa.list_(pa.int64())), pa.nulls(m, pa.list_(pa.int64()))]),
                ],
                names=["token", "ent", "n", "doc_id", "tk", "sketch"],
            )

    return run


def segments(k: int, fragments: int, words: np.ndarray):
    """The fragments of the sets of the texts that may be in the bitmap, one set per entity and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = (np.arange(1, fragments, dtype=np.float64) / fragments * 2.0**64).astype(np.uint64)
        done: set[int] = set()
        for batch in batches:
            if len(done) > 1_000_000:
                done.clear()
            batch = batch.filter(pa.array(seen(words, column(batch, "tk").to_numpy())))
            data, offsets = utf8(column(batch, "text"))
            ents, frags, sets = [], [], []
            for i, j in slices(offsets):
                for s in sets_of(*part(data, offsets, i, j), k):
                    e = entity(s) if len(s) else 0
                    if not len(s) or e in done:
                        continue
                    done.add(e)
                    for f, piece in enumerate(np.split(s, np.searchsorted(s, cuts))):
                        if len(piece):
                            ents.append(e)
                            frags.append(f)
                            sets.append(piece.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ents, pa.int64()), pa.array(frags, pa.int32()), pa.array(sets, pa.list_(pa.int64()))], names=["ent", "frag", "seg"]
            )

    return run


class Join:
    """One run of the operator: set size per document, links between entities, components."""

    def __init__(self, docs: DataFrame, k: int, threshold: tuple[int, int]):
        self.spark: SparkSession = docs.sparkSession
        prepare(self.spark)
        self.k, (self.num, self.den) = k, threshold
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.docs = docs.withColumn("tk", F.xxhash64("text"))

    def candidates(self) -> None:
        """Document rows, and the fragment groups of at least two entities, with the entities' sketches."""
        rows = table(self.docs.mapInArrow(keyed(self.k, self.num, self.den), ROWS))
        self.rows = table(rows.filter("token is null").select("doc_id", "tk", "n", "ent"))
        entries = rows.filter("token is not null").select("token", "ent", "n")
        whole = Window.partitionBy("token")
        parts = []
        for r in range(RANGES):  # one range of the keys after the other, so that their shuffle files never lie on disk together
            mine = entries.filter(F.col("token").bitwiseAND(F.lit(RANGES - 1)) == r)
            shared = mine.withColumns({"lo": F.min("ent").over(whole), "hi": F.max("ent").over(whole)}).filter("lo != hi")
            parts.append(table(shared.select("token", "ent", "n").distinct()))
            sweep(self.spark)
        self.groups = parts[0]
        for part_ in parts[1:]:
            self.groups = self.groups.unionByName(part_)
        self.written = parts
        live = self.groups.select("ent").distinct()
        found = rows.filter("sketch is not null").select("ent", "tk", "sketch").join(live, "ent")
        self.sketches = table(found.groupBy("ent").agg(*(F.first(c).alias(c) for c in ("tk", "sketch"))))
        discard(rows)
        sweep(self.spark)

    def fit(self, a: str, b: str):
        """Whether two set sizes allow the threshold."""
        return F.least(a, b) * self.den >= F.greatest(a, b) * self.num

    def sift(self, pairs: DataFrame) -> DataFrame:
        """Drop pairs (a, an, b, bn, ...) whose sketches differ in more bits than the sets may."""
        sa = self.sketches.select(F.col("ent").alias("a"), F.col("sketch").alias("sa"))
        sb = self.sketches.select(F.col("ent").alias("b"), F.col("sketch").alias("sb"))
        both = pairs.join(sa, "a").join(sb, "b")
        # where the sketches' sizes differ, the larger one is folded; sets that may be similar are at most a factor of den / num apart
        ha, hb = F.size("sa"), F.size("sb")

        def fold(x: Column, w: Column) -> Column:
            for _ in range(max(1, math.ceil(math.log2(self.den / self.num)))):
                half = (F.size(x) / 2).cast("int")
                x = F.when(F.size(x) > w, F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))).otherwise(x)
            return x

        left, right = fold(F.col("sa"), hb), fold(F.col("sb"), ha)
        bits = F.aggregate(F.zip_with(left, right, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
        close = bits * (self.num + self.den) <= (F.col("an") + F.col("bn")) * (self.den - self.num)
        return both.filter(close).select(*pairs.columns)

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, an, b, bn) that reach the threshold, by overlaps summed over fragments."""
        ents = pairs.select(F.col("a").alias("ent")).unionByName(pairs.select(F.col("b").alias("ent"))).distinct()
        homes = self.sketches.join(ents, "ent").select("tk")
        words = bitmap(homes, "tk")
        found = self.docs.select("tk", "text").mapInArrow(segments(self.k, FRAGMENTS, words), "ent long, frag int, seg array<long>")
        found = table(found.join(ents, "ent", "left_semi").groupBy("ent", "frag").agg(F.first("seg").alias("seg")))
        sweep(self.spark)
        left = found.select(F.col("ent").alias("a"), "frag", F.col("seg").alias("sa"))
        right = found.select(F.col("ent").alias("b"), "frag", F.col("seg").alias("sb"))
        partial = pairs.join(left, "a").join(right, ["b", "frag"]).select("a", "an", "b", "bn", F.size(F.array_intersect("sa", "sb")).alias("c"))
        total = partial.groupBy("a", "an", "b", "bn").agg(F.sum("c").alias("c"))
        out = table(total.filter(F.col("c") * self.den >= (F.col("an") + F.col("bn") - F.col("c")) * self.num).select("a", "b"))
        discard(found)
        sweep(self.spark)
        return out

    def labelled_groups(self, undecided: DataFrame | None = None) -> DataFrame:
        """The groups (token, ent, n, comp), or those of them that hold an undecided entity, whole."""
        groups = self.groups
        if undecided is not None:
            tokens = table(groups.join(few(undecided), "ent", "left_semi").select("token").distinct())
            groups = groups.join(few(tokens), "token", "left_semi")
        if self.found is None:
            return groups.withColumn("comp", F.col("ent"))
        g = groups.join(self.found.withColumnRenamed("node", "ent"), "ent", "left")
        return table(g.select("token", "ent", "n", F.coalesce("component", "ent").alias("comp")))

    def hub_pairs(self, groups: DataFrame) -> DataFrame:
        """Each entity with the hub of most of its groups.

        The hub of a group is its member of most groups, which is the least changed of near copies.
        """
        groups = groups.join(groups.groupBy("ent").agg((-F.count("*")).alias("rank")), "ent")
        hubs = groups.groupBy("token").agg(F.min(F.struct("rank", "ent", "n", "comp")).alias("hub"))
        met = groups.join(hubs, "token").filter("comp != hub.comp")
        met = met.select(F.col("ent").alias("a"), F.col("n").alias("an"), F.col("hub.ent").alias("b"), F.col("hub.n").alias("bn"))
        met = self.sift(met.filter(self.fit("an", "bn")).groupBy("a", "an", "b", "bn").agg(F.count("*").alias("m")))
        best = met.groupBy("a", "an").agg(F.max(F.struct("m", "b", "bn")).alias("x"))
        return best.select("a", "an", F.col("x.b").alias("b"), F.col("x.bn").alias("bn"))

    def named(self, groups: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
        """Pairs of entities of different components that the sketches let pass, `most` an entity, and the entities that have more.

        Every pair that wasn't named has an end that has more, so groups without such an entity are done.
        """
        words = F.expr(f"greatest({SKETCH // 64}, cast(power(2, length(bin(n - 1)) - 6) as bigint))")  # of a sketch
        sums = [F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m"), F.sum(words).alias("w")]
        sizes = groups.groupBy("token").agg(*sums).filter("lo != hi")
        blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("w") / BLOCK_WORDS)).cast("int")
        thin = groups.join(sizes.select("token", blocks.alias("blocks")), "token").withColumn("own", F.pmod(F.xxhash64("ent"), F.col("blocks")).cast("int"))
        # sketches are joined last, so that they are moved once with their ids and once to their blocks
        rows = thin.join(self.sketches.select("ent", "sketch"), "ent").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "ent", "n", "comp", "sketch")
        rows = rows.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
        found = rows.mapInArrow(partners(self.num, self.den, most), "a long, an long, b long, bn long, bits int, more boolean")
        found = found.groupBy("a", "an", "b", "bn", "bits").agg(F.max("more").alias("more"))
        rank = F.row_number().over(Window.partitionBy("a").orderBy("bits", "b"))
        found = table(found.withColumn("rank", rank))
        more = table(found.filter(F.col("more") | (F.col("rank") > most)).select(F.col("a").alias("ent")).distinct())
        sweep(self.spark)
        return found.filter(F.col("rank") <= most).select("a", "an", "b", "bn"), more

    def test(self, pairs: DataFrame) -> None:
        """Verify pairs that were not tested yet."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.when(F.col("a") < F.col("b"), F.col("an")).otherwise(F.col("bn")).alias("an"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("bn")).otherwise(F.col("an")).alias("bn")).distinct()
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        pairs = table(pairs)
        sweep(self.spark)
        if pairs.isEmpty():
            return
        links, now = self.verify(pairs), pairs.select("a", "b")
        self.tested = now if self.tested is None else self.tested.unionByName(now)
        if not links.isEmpty():
            self.edges = links if self.edges is None else self.edges.unionByName(links)
            self.found = components(self.edges)

    def labels(self) -> DataFrame | None:
        """node (entity), component: only of entities with links."""
        self.candidates()
        self.edges = self.found = self.tested = None
        self.test(self.hub_pairs(self.labelled_groups()))
        most, more = CLOSEST, None
        while more is None or not more.isEmpty():
            pairs, more = self.named(self.labelled_groups(more), most)
            self.test(pairs)
            most *= MORE
        discard(*self.written, self.sketches)
        sweep(self.spark)
        return self.found


def labelled(docs: DataFrame, k: int, threshold: tuple[int, int]) -> DataFrame:
    """doc_id, tk (hash of the text), n (set size), comp, one row per input row."""
    join = Join(docs, k, threshold)
    labels = join.labels()
    rows = join.rows
    if labels is not None:
        rows = rows.join(labels.withColumnRenamed("node", "ent"), "ent", "left")
        return rows.select("doc_id", "tk", "n", F.coalesce("component", "ent").alias("comp"))
    return rows.select("doc_id", "tk", "n", F.col("ent").alias("comp"))


def components_of(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id of the component), one row per input row."""
    rows = labelled(docs, k, threshold)
    full = rows.filter("n > 0")
    least = full.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    linked = full.join(least, "comp").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def keep_one(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """One row of each component: the least by doc_id (null last), then by the hash of its text.

    Of rows that are equal in both, one stays.  Rows without words all stay.
    """
    key = ["_none", "_id", "_tk"]
    full = labelled(docs, k, threshold).filter("n > 0").select("comp", F.struct(F.col("doc_id").isNull().alias("_none"), F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("tk").alias("_tk")).alias("key"))
    least = full.groupBy("comp").agg(F.min("key").alias("least"))
    gone = table(full.join(least, "comp").filter("key != least").select("key.*").distinct())
    plain, back = aside(docs, "doc_id", "text")
    text = F.col("text").cast("string")
    rows = plain.withColumns({"_none": F.col("doc_id").cast("long").isNull(), "_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "_tk": F.xxhash64(text)})
    words = F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    own = rows.filter(words).join(few(gone), key, "left_anti")
    own = flag_twins(own, *key).filter(~F.col("_twin")).drop("_twin")
    return back(own.unionByName(rows.filter(~words)))
