"""N-gram Jaccard join by parity sketches (operator 2).

A document is its set of word shingles, hashed. Shingles flip bits of a sketch, so the Hamming distance of two sketches
is at most the sets' symmetric difference. Sets of like size and similarity j differ in D shingles at most, which touch
D blocks of a sketch at most: of any D + 1 blocks one is equal. Documents meet on equal blocks within bands of set
sizes; a short sketch of the whole sets rejects most false meetings, the rest are verified on the sets themselves.

Equal sets are one class from the start. In a group that shares a block every class is first tested against the
group's least; only groups that are still in several components are compared in full, in tiles: first by sketches,
which tell the rows that have a likely partner in another component, then these by their sets. A tile hands on a row
for each of its members at most, the least one that its links reach, never its pairs.

Nodes of the graph are rows of the input, numbered as their sketches are written, so ids may repeat or be null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import Scratch, map_arrow
from tallyloom.llm.graph import components, deal, lowest, tiles

#: Ratio of the sizes at a band's ends.
BAND = 1.25
#: Bits of the tables that tell documents without a candidate, and keys without a second document, apart: 2 and 8 MB
#: whatever the corpus. A bit set in vain only means that a row takes the exact way, a join.
FILTER_BITS, KEY_BITS = 24, 26
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits (SplitMix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
ODD = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles of width words; of all words where there are fewer.

    Words are runs of characters other than U+0020 and U+0009 to U+000D; A to Z count as a to z.
    """
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    dark = ~SPACE[data]
    if not dark.any():
        return [np.zeros(0, np.uint64)] * len(texts)
    edge = np.flatnonzero(np.diff(dark.astype(np.int8), prepend=0))
    starts, ends = edge[0::2], edge[1::2]
    lens = ends - starts
    first = np.concatenate(([0], np.cumsum(lens)[:-1]))
    place = np.arange(int(lens.sum())) - np.repeat(first, lens)
    powers = np.full(int(lens.max()), ODD)
    powers[0] = 1
    powers = np.cumprod(powers)
    words = mix(np.add.reduceat(BYTES[LOWER[data[dark]]] * powers[place], first) + lens.astype(np.uint64))
    doc_ends = np.cumsum([len(r) + 1 for r in raw])
    cuts = np.searchsorted(starts, doc_ends)
    salts = mix(np.arange(1, width + 1, dtype=np.uint64))
    joined = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        joined += mix(words[k : k + len(joined)] ^ salts[k]) * (ODD + np.uint64(2 * k))
    joined = mix(joined)
    out, at = [], 0
    for cut in cuts.tolist():
        n = cut - at
        if n >= width:
            out.append(np.unique(joined[at : cut - width + 1]))
        elif n:
            few = np.uint64(n)
            total = np.zeros(1, np.uint64)
            for k in range(n):
                total += mix(words[at + k : at + k + 1] ^ salts[k]) * (ODD + np.uint64(2 * k))
            out.append(mix(total + few))
        else:
            out.append(np.zeros(0, np.uint64))
        at = cut
    return out


class Sketch:
    """Bands, blocks and bounds for a similarity of percent / 100."""

    def __init__(self, percent: int):
        self.percent = percent

    def differ(self, a: int, b: int) -> int:
        """The largest symmetric difference of sets of these sizes that are similar enough."""
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    def band(self, n: int) -> int:
        k = int(np.log(n) / np.log(BAND))
        while BAND**k > n:
            k -= 1
        while BAND ** (k + 1) <= n:
            k += 1
        return k

    def cells(self, n: int) -> list[int]:
        """The own band, and every further one with sizes that a set of n may be similar to."""
        most = n * 100 // self.percent
        return list(range(self.band(n), self.band(most) + 1))

    def leading(self, n: int) -> int:
        """Blocks that a set of n has in each of its cells: one of them is equal to that of any similar set.

        A cell has as many as its largest set needs, so enough for each.
        """
        return self.differ(n, n * 100 // self.percent) + 1

    def blocks(self, hashes: np.ndarray, cell: int) -> np.ndarray:
        """The leading blocks: 32 parity bits low, an XOR of 32-bit hashes high."""
        top = int(np.ceil(BAND ** (cell + 1)))
        count = self.differ(top, top * 100 // self.percent) + 1
        h = mix(hashes ^ np.uint64(0x5851F42D4C957F2D * (cell + 1) & (2**64 - 1)))
        block = ((h >> np.uint64(37)) % np.uint64(count)).astype(np.int64)
        bit = np.uint64(1) << ((h >> np.uint64(32)) & np.uint64(31))
        value = bit ^ (h << np.uint64(32))
        order = np.argsort(block, kind="stable")
        found, at = np.unique(block[order], return_index=True)
        out = np.zeros(count, np.uint64)
        out[found] = np.bitwise_xor.reduceat(value[order], at)
        return out[: self.leading(len(hashes))]

    def parity(self, hashes: np.ndarray) -> bytes:
        """A bit for each element or so, flipped by each: the distance of two such sketches bounds the sets' difference."""
        bits = 1 << max(6, int(len(hashes) - 1).bit_length())
        at = (mix(hashes ^ ODD) & np.uint64(bits - 1)).astype(np.int64)
        return np.packbits(np.bincount(at, minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()

    def keys(self, blocks: np.ndarray, cell: int) -> np.ndarray:
        place = np.arange(len(blocks), dtype=np.uint64) + np.uint64(1) + (np.uint64(cell + 1) << np.uint64(32))
        return mix(blocks ^ mix(place)).view(np.int64)


def bit_table(places: DataFrame, bits: int) -> np.ndarray:
    """A table of 2 ** bits bits, as words, with those at places (a column at) set: of one size whatever their number."""
    words = places.select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    table = np.zeros(1 << (bits - 6), np.int64)
    got = words.toArrow()
    table[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return table


def is_set(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((table[at >> 6] >> (at & 63)) & 1).astype(bool)


def place_of(name: str, bits: int) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(1 << bits)).alias("at")


def candidates_filter(ids: DataFrame, name: str) -> np.ndarray:
    return bit_table(ids.select(place_of(name, FILTER_BITS)), FILTER_BITS)


def folded(raw: bytes, size: int) -> np.ndarray:
    """A parity sketch of so many bytes from one of as many or a multiple by a power of two."""
    return np.bitwise_xor.reduce(np.frombuffer(raw, "<u8").reshape(-1, size // 8), axis=0)


def close(n: np.ndarray, parity: np.ndarray, i: int, others: np.ndarray, percent: int) -> np.ndarray:
    """Which others set sizes and the distance of their sketches do not rule out as partners of i."""
    ok = 100 * np.minimum(n[i], n[others]) >= percent * np.maximum(n[i], n[others])
    return ok & (np.bitwise_count(parity[i] ^ parity[others]).sum(1, dtype=np.int64) <= (100 - percent) * (n[i] + n[others]) // (100 + percent))


def parities(column: pa.Array) -> np.ndarray:
    raw = column.to_pylist()
    size = min(map(len, raw))
    return np.array([folded(r, size) for r in raw])


def plausible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that set sizes and the distance of their sketches do not rule out."""
    sketch = Sketch(percent)
    side = lambda k, n, raw: sketches.select(F.col("node").alias(k), F.col("n").alias(n), F.col("parity").alias(raw))

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep = []
            for i, (n, x, m, y) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("n", "x", "m", "y")), strict=True)):
                if 100 * min(n, m) >= percent * max(n, m):
                    size = min(len(x), len(y))
                    if int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum(dtype=np.int64)) <= sketch.differ(n, m):
                        keep.append(i)
            return batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

        return work

    both = pairs.join(side("a", "n", "x"), "a").join(side("b", "m", "y"), "b")
    return map_arrow(both, make, "a long, b long")


def whole(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that tell a set from others, as two signed numbers."""
    if not len(hashes):
        return 0, 0
    two = np.array([np.bitwise_xor.reduce(mix(hashes)), np.add.reduce(mix(hashes ^ ODD))], np.uint64).view(np.int64)
    return int(two[0]), int(two[1])


def sets_of(nodes: DataFrame, slim: DataFrame, rows: DataFrame, width: int, scratch: Scratch, name: str) -> DataFrame:
    """(node, hashes) for each of the nodes, from the texts of rows that have its id and its very set."""
    wanted = scratch.save(nodes.distinct().join(slim.select("node", "id", "h1", "h2"), "node"), f"{name}-wanted")
    table = nodes.sparkSession.sparkContext.broadcast(candidates_filter(wanted, "id"))

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            keep = np.flatnonzero(is_set(table.value, batch.column(1).to_numpy()))
            if not len(keep):
                return None
            sets = shingle_sets([t or "" for t in batch.column(0).take(pa.array(keep)).to_pylist()], width)
            offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            one, two = zip(*map(whole, sets), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.ListArray.from_arrays(offsets, np.concatenate(sets).view(np.int64))], ["h1", "h2", "hashes"])

        return work

    found = map_arrow(rows.select("text", place_of("id", FILTER_BITS)), make, "h1 long, h2 long, hashes array<long>", "text")
    return scratch.save(found.join(wanted.select("h1", "h2", "node"), ["h1", "h2"]).dropDuplicates(["node"]).select("node", "hashes"), f"{name}-sets")


def verified(pairs: DataFrame, slim: DataFrame, rows: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar enough, by the exact sizes of intersection and union."""
    sets = sets_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), slim, rows, width, scratch, "pairs")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - F.col("c")
    return both.withColumn("c", common).where((F.lit(100).cast("long") * F.col("c")) >= F.lit(percent).cast("long") * union).select("a", "b")


def between(groups: DataFrame, slim: DataFrame, rows: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) that join what the groups (key, node, component) hold apart, as many as the rows compared at most.

    In each tile the sketches first tell which rows have a likely partner of another component; only these come back
    with their sets, and of the links found each row hands on the least node that they reach.
    """
    get = lambda batch, c: batch.column(batch.schema.names.index(c))

    def likely(batch: pa.RecordBatch, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch | None:
        comp, n, parity = get(batch, "component").to_numpy(), get(batch, "n").to_numpy(), parities(get(batch, "parity"))
        hit = np.zeros(len(n), bool)
        for i in left.tolist():
            others = right[right > i] if left is right else right
            others = others[comp[others] != comp[i]]
            if len(others):
                found = others[close(n, parity, i, others, percent)]
                hit[found] = True
                hit[i] |= len(found) > 0
        return batch.select(["__tile", "__own", "__same", "node", "component", "n", "parity"]).take(pa.array(np.flatnonzero(hit))) if hit.any() else None

    def linked(batch: pa.RecordBatch, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch | None:
        comp, n, parity, nodes = get(batch, "component").to_numpy(), get(batch, "n").to_numpy(), parities(get(batch, "parity")), get(batch, "node").to_numpy()
        sets, at = [np.asarray(h, np.int64).view(np.uint64) for h in get(batch, "hashes").to_pylist()], comp.copy()
        one, two = [], []
        for i in left.tolist():
            others = right[right > i] if left is right else right
            others = others[at[others] != at[i]]  # not what the tile has linked by now
            others = others[close(n, parity, i, others, percent)] if len(others) else others
            if not len(others):
                continue
            sizes = np.array([len(sets[j]) for j in others.tolist()])
            flat = np.concatenate([sets[j] for j in others.tolist()])
            place = np.minimum(np.searchsorted(sets[i], flat), len(sets[i]) - 1)
            common = np.add.reduceat((sets[i][place] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
            found = others[100 * common >= percent * (n[i] + n[others] - common)]
            if len(found):
                at[np.isin(at, at[found])] = at[i]
                one.append(np.full(len(found), i))
                two.append(found)
        if not one:
            return None
        low = lowest(nodes, np.concatenate(one), np.concatenate(two))
        some = np.flatnonzero(low != nodes)
        return pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(low[some])], ["a", "b"])

    dealt = deal(groups, scratch, "tiles", member="node").join(slim.select("node", "n", "parity"), "node")  # sketches travel once
    hits = scratch.save(tiles(dealt, likely, "__tile long, __own int, __same boolean, node long, component long, n long, parity binary"), "likely")
    sets = sets_of(hits.select("node"), slim, rows, width, scratch, "tiles")
    return tiles(hits.join(sets, "node"), linked, "a long, b long").distinct()


def grouped(docs: DataFrame, width: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """(id, n, h1, h2, text_hash, component, component_id) for each row: component numbers them, null for empty sets."""
    spark = docs.sparkSession
    scratch, sketch = Scratch(spark, "neardup"), Sketch(percent)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = shingle_sets([t or "" for t in batch.column(1).to_pylist()], width)
            words = [b"".join(sketch.blocks(s, c).astype("<u8").tobytes() for c in sketch.cells(len(s))) if len(s) else b"" for s in sets]
            one, two = zip(*map(whole, sets), strict=True)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(words, pa.binary()), pa.array([sketch.parity(s) if len(s) else b"" for s in sets], pa.binary())], ["id", "text_hash", "n", "h1", "h2", "blocks", "parity"])

        return work

    sketched = map_arrow(rows.withColumn("text_hash", F.xxhash64("text")), make, "id long, text_hash long, n long, h1 long, h2 long, blocks binary, parity binary", "text")
    signed = scratch.save(sketched.withColumn("node", F.monotonically_increasing_id()), "sets")
    classes = scratch.save(signed.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("node").alias("node"), F.min("id").alias("id"), F.count("*").alias("rows")), "classes")
    several = classes.where("rows > 1").select("n", "h1", "h2", F.col("node").alias("class"))
    copies = scratch.save(signed.select("node", "n", "h1", "h2").join(several, ["n", "h1", "h2"]).where("node <> class").select("node"), "copies")
    copied = spark.sparkContext.broadcast(candidates_filter(copies, "node"))
    own = signed.where("n > 0").select("node", "n", "blocks", place_of("node", FILTER_BITS))

    def explode(of_keys=None, fresh: bool = False):
        """Rows (key, node) of each block: of rows that are surely no copy, if fresh; of keys whose bit is set, if asked."""

        def make():
            def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
                if fresh:
                    batch = batch.take(pa.array(np.flatnonzero(~is_set(copied.value, batch.column(3).to_numpy()))))
                nodes, keys = [], []
                for i, n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    blocks, size = np.frombuffer(raw, "<u8"), sketch.leading(n)
                    for k, cell in enumerate(sketch.cells(n)):
                        keys.append(sketch.keys(blocks[k * size : (k + 1) * size], cell))
                        nodes.append(np.full(size, i, np.int64))
                if not keys:
                    return None
                keys, nodes = np.concatenate(keys), np.concatenate(nodes)
                if of_keys is not None:
                    keep = is_set(of_keys.value, keys & ((1 << KEY_BITS) - 1))
                    keys, nodes = keys[keep], nodes[keep]
                return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(nodes)], ["key", "node"])

            return work

        return make

    def flagged():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.take(pa.array(np.flatnonzero(is_set(copied.value, batch.column(3).to_numpy()))))

        return work

    unsure = map_arrow(own, flagged, own.schema).join(copies, "node", "left_anti").select(*own.columns)

    def keys_of(of_keys=None) -> DataFrame:
        parts = [map_arrow(own, explode(of_keys, True), "key long, node long", rows=2000), map_arrow(unsure, explode(of_keys), "key long, node long", rows=2000)]
        return parts[0].union(parts[1])

    shared = scratch.save(keys_of().groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub <> last").select("key", "hub"), "shared")
    scratch.tidy()
    met = spark.sparkContext.broadcast(bit_table(shared.select(F.pmod("key", F.lit(1 << KEY_BITS)).alias("at")), KEY_BITS))
    members = scratch.save(keys_of(met).join(shared, "key"), "members")
    slim = scratch.save(signed.drop("blocks"), "slim")
    scratch.drop("sets")
    scratch.tidy()
    tested = members.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    tested = scratch.save(plausible(tested, slim.select("node", "n", "parity"), percent), "tested")
    links = scratch.save(verified(tested, slim, rows, width, percent, scratch), "links")
    found = components(links, scratch, "one")
    scratch.tidy()

    # groups whose classes are still apart, but for those of two: their one pair is tested
    labelled = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    apart = scratch.save(labelled.groupBy("key").agg(F.count("*").alias("size"), F.min("component").alias("least"), F.max("component").alias("most")).where("size > 2 and least <> most").select("key"), "apart")
    open_groups = scratch.save(labelled.where("node <> hub").join(apart, "key").select("key", "node", "component"), "open")

    final = found
    if not open_groups.isEmpty():
        more = scratch.save(between(open_groups, slim, rows, width, percent, scratch), "more")
        if not more.isEmpty():
            stars = found.select(F.col("node").alias("a"), F.col("component").alias("b")).where("a <> b")
            final = components(scratch.save(stars.union(more), "all"), scratch, "two")
    placed = classes.join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("id").alias("component_id"))
    placed = scratch.save(placed.join(least, "component").select("n", "h1", "h2", "component", "component_id"), "placed")
    scratch.drop("classes", "copies", "shared", "members", "open", "apart", "more", "tested", "likely", "pairs-wanted", "pairs-sets", "tiles-wanted", "tiles-sets", "tiles-sizes", "links", "all")
    return slim.drop("parity", "node").join(placed, ["n", "h1", "h2"], "left").withColumn("component_id", F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")))


def join(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs.

    Two documents link when 100 * intersection >= percent * union of their sets; component_id is the least id
    reachable. Ids are whole numbers, cast to long. A text that is null or has no word has an empty set and is its own
    component. Equal texts link, repeated rows too, and rows that share an id are told apart by their texts. A row
    with a null id links like any other; its component is null if no row there has an id.
    """
    return grouped(docs, width, percent, doc_id, text).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component of the join, that of its least id; rows without a word stay.

    Rows are told apart by id and text, so a row whose id repeats goes or stays for its own text: of several texts
    under the least id that of the least hash stays, and of rows equal in both one. A null id comes last.
    """
    scratch = Scratch(docs.sparkSession, "groups")
    groups = scratch.save(grouped(docs, width, percent, doc_id, text).where("n > 0").select("id", "text_hash", "component", "component_id"), "rows")
    key = ["id", "text_hash"]
    leaders = groups.where("id <=> component_id").groupBy("component", *key).count()
    lead = scratch.save(leaders.groupBy("component").agg(F.min("text_hash").alias("lead")), "lead")
    stays = F.col("id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("lead"))
    gone = groups.join(lead, "component").where(~stays).select(*key).distinct()
    repeated = scratch.save(leaders.where("count > 1").join(lead, "component").where("text_hash = lead").select(*key), "repeated")
    named = docs.withColumn("__id", F.col(doc_id).cast("long")).withColumn("__text", F.xxhash64(text))
    mine = lambda rows, t: rows["__id"].eqNullSafe(t["id"]) & (rows["__text"] == t["text_hash"])
    stay = named.join(gone, mine(named, gone), "left_anti")
    if repeated.isEmpty():
        return stay.select(*docs.columns)
    once = stay.join(repeated, mine(stay, repeated), "left_semi").dropDuplicates(["__id", "__text"])
    return stay.join(repeated, mine(stay, repeated), "left_anti").unionByName(once).select(*docs.columns)
