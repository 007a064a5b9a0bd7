"""Near duplicates by SetSketch registers, verified on full shingle sets, grouped by connected components.

A sketch register is the minimum, over a set's shingles, of an exponentially distributed hash, kept as the number of its
exponentially spaced level, truncated to 16 bits; registers of a union are the maxima of the parts' levels. Bands of
registers make candidates, the joint likelihood of two sketches (with the known set sizes) estimates their similarity
and drops pairs far below the threshold, and the full sets decide.

No bucket is expanded into all its pairs. Sets that are equal form a class, and only its smallest document goes on. In
every bucket the smallest member is compared with the others. Verified links join members into components, pairs
that look related into families. What this leaves open are links between components of one family, and between families
that share a bucket. Both are settled in blocks of bounded size: members of a family (or a bucket) are dealt into blocks by
set size, blocks of near sizes meet pair by pair, first with their sketches alone, then with the whole sets of those
members that have a likely partner. Only links that join components are returned, and blocks of one component never meet.

Sets are sets of 64-bit shingle hashes; sets count as equal when size and a 128-bit digest of the sorted hashes agree.

Defined cases: a null text, or one without words, has an empty set and is linked with nothing (n_shingles 0, kept). A
text with fewer words than a shingle has the whole sequence as its one shingle. Rows that repeat a doc_id are copies if
their sets are equal; each row gets the component of its own set, also where one id stands for different texts. Ids may be of
any type with an order. Rows with a null id have a null component and are kept; they link nothing. Very long texts are taken
whole. An empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import count
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import Shared, arrow_map, cut, frame, sized_broadcast, small_batches

BASE, LEVELS = 1.001, 65_534
#: Registers kept for the likelihood, and how many standard errors below the threshold an estimate drops a pair.
KEPT, MARGIN = 128, 5.5
#: Pairs of at least this estimate belong to one family.
KIN = 0.4
#: A block has about so many sets and shingles.
BLOCK_SETS, BLOCK_SHINGLES = 256, 400_000
#: A set that more than this many pairs name as their first is sent to them in several chunks of about that size.
CHUNK_PAIRS = 512
#: A linked pair is a candidate with a probability of at least 1 - MISS.
MISS, MOST_BANDS = 1e-6, 40


@dataclass(frozen=True)
class Sketcher:
    words: int  # a shingle
    percent: int  # least similarity

    @property
    def rows(self) -> int:
        """Registers a band: as many as MOST_BANDS bands allow."""
        return max(r for r in range(1, 16) if self.bands_of(r) <= MOST_BANDS)

    def bands_of(self, rows: int) -> int:
        return math.ceil(math.log(MISS) / math.log(1 - (self.percent / 100) ** rows))

    @property
    def bands(self) -> int:
        return self.bands_of(self.rows)

    def seeds(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(77)
        n = max(KEPT, self.rows * self.bands)
        return rng.integers(0, 1 << 31, (n, 1), np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, (n, 1), np.uint32)

    def registers(self, shingles: np.ndarray) -> np.ndarray:
        """Levels of the minima of -log(1 - u), u uniform: 0 to LEVELS + 1."""
        a, b = self.seeds()
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(a), 0xFFFFFFFF, np.uint32)
        for i in range(0, len(x), 1024):
            np.minimum(least, (x[None, i : i + 1024] * a + b).min(1), out=least)
        h = -np.log1p(-(least.astype(np.float64) + 0.5) / 2**32)
        return np.clip(np.floor(LEVELS / 2 - np.log(h) / math.log(BASE)), 0, LEVELS + 1).astype(np.uint16)

    def keys(self, registers: np.ndarray) -> list[int]:
        used = registers[: self.rows * self.bands].reshape(self.bands, self.rows)
        return [xxhash.xxh3_64_intdigest(row.tobytes(), seed=i + 1) - (1 << 63) for i, row in enumerate(used)]


def mix(v: np.ndarray) -> np.ndarray:
    v = (v ^ (v >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    v = (v ^ (v >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return v ^ (v >> np.uint64(33))


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    tokens = lists.flatten().dictionary_encode()
    table = np.fromiter((xxhash.xxh3_64_intdigest(w.encode().lower()) if w else 0 for w in tokens.dictionary.to_pylist()), np.uint64, len(tokens.dictionary))
    at, hashes = lists.offsets.to_numpy(), table[tokens.indices.to_numpy()]
    for a, b in zip(at[:-1], at[1:], strict=True):
        h = hashes[a:b]
        h = h[h != 0]  # the splitter's empty strings at both ends
        width = min(words, len(h))
        if not width:
            yield h
            continue
        n, v = len(h) - width + 1, np.zeros(len(h) - width + 1, np.uint64)
        for j in range(width):
            v = mix(v * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n] + np.uint64(j + 1))
        yield np.unique(v)


SIGNED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("set_hash", pa.binary()), ("registers", pa.binary()), ("keys", pa.list_(pa.int64()))])


def sign_batches(batches: Iterator[pa.RecordBatch], sketcher: Sketcher) -> Iterator[pa.RecordBatch]:
    for b in small_batches(batches, chars=4_000_000):
        out: dict[str, list] = {f.name: [] for f in SIGNED}
        for key, s in zip(b.column(0).to_pylist(), shingle_sets(b.column(1), sketcher.words), strict=True):
            r = sketcher.registers(s) if len(s) and key is not None else None
            row = (key, len(s), xxhash.xxh3_128_digest(s.tobytes()), b"" if r is None else r[:KEPT].tobytes(), [] if r is None else sketcher.keys(r))
            for name, value in zip(out, row, strict=True):
                out[name].append(value)
        yield frame(out, SIGNED)


def likely_similarity(first: np.ndarray, second: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from how often either sketch's register is larger, given the set sizes."""
    up, down = (first > second).sum(1)[:, None], (first < second).sum(1)[:, None]
    u = (n1 / (n1 + n2))[:, None]
    grid = np.linspace(0, 1, 201)[None] * np.minimum(u / (1 - u), (1 - u) / u)  # the sizes bound the similarity
    chance = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)
    more, less = np.maximum(chance(u - (1 - u) * grid), 1e-9), np.maximum(chance((1 - u) - u * grid), 1e-9)
    same = np.maximum(1 - more - less, 1e-9)
    fit = up * np.log(more) + down * np.log(less) + (first.shape[1] - up - down) * np.log(same)
    return grid[np.arange(len(up)), fit.argmax(1)]


def least_likely(percent: int) -> float:
    """The estimate below which a pair is taken to be under the threshold."""
    t = percent / 100
    return t - MARGIN * math.sqrt(t * (1 - t) / KEPT)


def likely_batches(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """a, b, na, nb, ra, rb: keeps pairs of a family, and tells which of them are not far below the threshold."""
    least = least_likely(percent)
    for whole in batches:
        for b in (whole.slice(i, 2000) for i in range(0, whole.num_rows, 2000)):
            first, second = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint16).reshape(-1, KEPT) for i in (4, 5))
            likely = likely_similarity(first, second, b.column(2).to_numpy().astype(float), b.column(3).to_numpy().astype(float))
            keep = likely >= min(least, KIN)
            ids = b.select([0, 1]).filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([*ids.columns, pa.array(likely[keep] >= least)], names=["a", "b", "likely"])


VERIFIED = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def verify_batches(batches: Iterator[pa.RecordBatch], sketcher: Sketcher) -> Iterator[pa.RecordBatch]:
    """a, first, id, text in order of a, the row of a itself (first) ahead of its partners: keeps the pairs that are linked."""
    head = np.zeros(0, np.uint64)
    for b in small_batches(batches, "text", 2_000_000):
        found: dict[str, list] = {"a": [], "b": []}
        for a, first, other, s in zip(*[b.column(i).to_pylist() for i in range(3)], shingle_sets(b.column(3), sketcher.words), strict=True):
            if first:
                head = s
                continue
            shared = len(np.intersect1d(head, s, assume_unique=True))
            if 100 * shared >= sketcher.percent * (len(head) + len(s) - shared):
                found["a"].append(a)
                found["b"].append(other)
        yield frame(found, VERIFIED)


def linked_in_block(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, component: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between the left and right sets that join different components, one for each join made."""
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    fresh = np.append(True, every[1:] != every[:-1])
    column = np.cumsum(fresh) - 1
    several = np.bincount(column)[column] > 1  # a shingle of one set alone is shared with nothing
    column, owner = np.unique(column[several], return_inverse=True)[1], owner[several]
    shared, width = np.zeros((len(left), len(right)), np.float32), 4096
    row_l, row_r = np.full(len(sets), -1), np.full(len(sets), -1)
    row_l[left], row_r[right] = np.arange(len(left)), np.arange(len(right))
    bounds = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + width, width))
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        if lo == hi:
            continue
        c, o = column[lo:hi] % width, owner[lo:hi]
        m, n = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        m[row_l[o[row_l[o] >= 0]], c[row_l[o] >= 0]] = 1
        n[row_r[o[row_r[o] >= 0]], c[row_r[o] >= 0]] = 1
        shared += m @ n.T
    sizes = np.array([len(s) for s in sets])
    union = sizes[left][:, None] + sizes[right][None] - shared
    found, label = [], {}

    def root(x):
        while label.get(x, x) != x:
            x = label[x]
        return x

    for i, j in zip(*np.nonzero(100 * shared >= percent * union), strict=True):
        a, b = left[i], right[j]
        x, y = root(component[a]), root(component[b])
        if x != y:
            label[max(x, y)] = min(x, y)
            found.append((int(a), int(b)))
    return found


def likely_members(percent: int):
    need = KEPT * least_likely(percent)

    def screen(group: pd.DataFrame) -> pd.DataFrame:
        """Rows of one pair of blocks; those stay whose sketch agrees with one of another component across the pair in as many registers as a link needs."""
        sketches = np.frombuffer(b"".join(group["registers"]), np.uint16).reshape(-1, KEPT)
        side, component = group["side"].to_numpy(), group["component"].to_numpy()
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        a, b = np.ascontiguousarray(sketches[left].T), np.ascontiguousarray(sketches[right].T)
        same = np.zeros((len(left), len(right)), np.uint8)
        for x, y in zip(a, b, strict=True):
            same += x[:, None] == y[None]
        likely = (same >= need) & (component[left][:, None] != component[right][None])
        keep = np.zeros(len(group), bool)
        keep[left] |= likely.any(1)
        keep[right] |= likely.any(0)
        return group.loc[keep, ["grp", "x", "y", "rep", "component", "side"]]

    return screen


def joined_components(percent: int):
    def compare(group: pd.DataFrame) -> pd.DataFrame:
        """Rows of one pair of blocks: rep, component, shingles, side (0: only the first block, 1: only the second; a block with itself: 2)."""
        sets = [np.frombuffer(s, np.uint64) for s in group["shingles"]]
        side, component = group["side"].to_numpy(), group["component"].to_numpy()
        links = linked_in_block(sets, np.flatnonzero(side != 1), np.flatnonzero(side != 0), component, percent)
        return pd.DataFrame({"a": [component[i] for i, _ in links], "b": [component[j] for _, j in links]}, dtype="int64")

    return compare


SETS = pa.schema([("rep", pa.int64()), ("shingles", pa.binary())])


def set_batches(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for b in small_batches(batches, chars=2_000_000):
        yield frame({"rep": b.column(0), "shingles": [s.tobytes() for s in shingle_sets(b.column(1), words)]}, SETS)


def components(edges: DataFrame, shared: Shared, name: str) -> DataFrame:
    """node, component (smallest node reachable) for edges (a, b), without the smallest nodes themselves: alternating large
    and small stars until only stars are left. What a node looks up is written before the join, so that a node with many
    edges is a plain scan on both sides, which adaptive execution splits."""
    state = shared(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), f"{name}_0")
    for step in count(1):
        roles = state.select(F.col("u").alias("x"), F.lit(1).alias("own"), F.lit(0).alias("root")).unionByName(state.select(F.col("v").alias("x"), F.lit(0).alias("own"), F.lit(1).alias("root")))
        if roles.groupBy("x").agg(F.sum("own").alias("own"), F.max("root").alias("root")).filter("own > 1 or (own = 1 and root = 1)").isEmpty():
            return state.select(F.col("u").alias("node"), F.col("v").alias("component"))
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = shared(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}_{step}_least")
        large = shared(both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"{name}_{step}_large")
        least = shared(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}_{step}_lower")
        small = large.join(least, "u").filter("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        state = shared(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), f"{name}_{step}")


def near_dedup(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: doc_id, n_shingles, component_id, kept."""
    sketcher = Sketcher(words, percent)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    with Shared(docs.sparkSession) as shared:
        if rows.schema["doc_id"].dataType.typeName() in ("long", "integer", "short", "byte"):
            signed = shared(sign(rows, sketcher), "signed")
            if signed.filter("doc_id is not null").groupBy("doc_id").agg(F.min("set_hash").alias("a"), F.max("set_hash").alias("b")).filter("a <> b").isEmpty():
                found = linked(signed, rows.withColumn("doc_id", F.col("doc_id").cast("long")), sketcher, shared)
                return cut(found.withColumn("doc_id", F.col("doc_id").cast(rows.schema["doc_id"].dataType)))
        # ids that are no whole numbers, or that stand for different sets: rows get numbers, components their smallest id
        numbered = shared(rows.withColumn("_row", F.monotonically_increasing_id()), "numbered")
        keyed = numbered.filter("doc_id is not null").select(F.col("_row").alias("doc_id"), "text")
        found = shared(linked(shared(sign(keyed, sketcher), "signed_rows"), keyed, sketcher, shared).select(F.col("doc_id").alias("_row"), "n_shingles", F.col("component_id").alias("_component")), "found")
        named = shared(found.join(numbered.select("_row", "doc_id"), "_row"), "named")
        smallest = shared(named.groupBy("_component").agg(F.min("doc_id").alias("component_id")), "smallest")
        result = named.join(smallest, "_component").select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
        unnamed = sign(numbered.filter("doc_id is null").select(F.col("_row").alias("doc_id"), "text"), sketcher)
        nothing = F.lit(None).cast(rows.schema["doc_id"].dataType)
        return cut(result.unionByName(unnamed.select(nothing.alias("doc_id"), F.col("n").alias("n_shingles"), nothing.alias("component_id"), F.lit(True).alias("kept"))))


def sign(rows: DataFrame, sketcher: Sketcher) -> DataFrame:
    """Size, digest, sketch and band keys of each row's set."""
    shape = "doc_id long, n long, set_hash binary, registers binary, keys array<long>"
    return arrow_map(rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), lambda it: sign_batches(it, sketcher), shape)


def linked(signed: DataFrame, rows: DataFrame, sketcher: Sketcher, shared: Shared) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of signed rows; each id stands for one set. rows: doc_id, text."""
    percent = sketcher.percent
    live = signed.filter("n > 0 and doc_id is not null")

    # one representative a class of equal sets
    classes = live.groupBy("set_hash", "n").agg(F.min_by(F.struct("doc_id", "registers", "keys"), "doc_id").alias("r"))
    reps = shared(classes.select("set_hash", "n", F.col("r.doc_id").alias("rep"), F.col("r.registers").alias("registers"), F.col("r.keys").alias("keys")), "reps")
    sketches = reps.select("rep", "n", "registers")

    # buckets with two members or more; every member with its bucket's smallest
    banded = reps.select("rep", "n", F.explode("keys").alias("key"))
    buckets = shared(banded.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high"), F.count(F.lit(1)).alias("members")).filter("low < high").select("key", "low", "members"), "buckets")
    members = shared(banded.join(buckets, "key"), "members")

    def texts_of(ids: DataFrame, name: str) -> DataFrame:
        """The texts of these distinct ids; rows that repeat an id have equal sets, so one of them is taken."""
        ids = shared(ids, f"ids_{name}")
        return rows.join(sized_broadcast(ids, ids.count()), "doc_id", "left_semi").dropDuplicates(["doc_id"])

    def likely_links(pairs: DataFrame, name: str) -> DataFrame:
        """Those of the distinct pairs (a, b) that are kin, and whether their sketches allow a link (likely)."""
        a = sketches.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("registers").alias("ra"))
        b = sketches.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("registers").alias("rb"))
        sized = pairs.join(a, "a").join(b, "b").filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        return shared(arrow_map(sized.select("a", "b", "na", "nb", "ra", "rb"), lambda it: likely_batches(it, percent), "a long, b long, likely boolean"), f"likely_{name}")

    def links(pairs: DataFrame, name: str) -> DataFrame:
        """Those of the likely pairs whose full sets are linked. The text of a is sent once a chunk of its pairs, that of b once a pair."""
        likely = pairs.filter("likely").select("a", "b")
        texts = shared(texts_of(likely.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), name), f"texts_{name}")
        hot = shared(likely.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CHUNK_PAIRS).cast("int").alias("chunks")).filter("chunks > 1"), f"hot_{name}")
        chunk = F.coalesce(F.pmod(F.hash("b"), F.col("chunks")), F.lit(0)).alias("chunk")
        dealt = shared(likely.join(sized_broadcast(hot, hot.count()), "a", "left").select("a", "b", chunk), f"dealt_{name}")
        firsts = dealt.select("a", "chunk").distinct().select("a", "chunk", F.lit(True).alias("first"), F.col("a").alias("id"))
        need = firsts.unionByName(dealt.select("a", "chunk", F.lit(False).alias("first"), F.col("b").alias("id")))
        sent = need.join(texts.withColumnRenamed("doc_id", "id"), "id").repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.desc("first"))
        return shared(arrow_map(sent.select("a", "first", "id", "text"), lambda it: verify_batches(it, sketcher), "a long, b long"), f"links_{name}")

    def meetings(found: DataFrame, name: str) -> DataFrame | None:
        """Pairs of components (a, b) that links join, of rows grp, part, rep, component, n: in every group of three sets or more, sets of different
        parts meet (two have met as a star). None where there is no such group."""
        total = found.groupBy("grp").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count(F.lit(1)).alias("sets"), F.sum("n").alias("shingles")).filter("lo < hi and sets > 2")
        total = shared(total.select("grp", ((F.col("sets") <= BLOCK_SETS) & (F.col("shingles") <= BLOCK_SHINGLES)).alias("whole")), f"groups_{name}")
        if total.isEmpty():
            return None
        # linked sets are of one size class or of neighbouring ones; a group that fits one block needs no classes
        size_class = F.when(F.col("whole"), 0).otherwise(F.floor(F.log("n") / (1.000001 * math.log(100 / percent)))).cast("int") if percent < 100 else F.lit(0)
        dealt = shared(found.join(total, "grp").select("grp", "part", "rep", "component", "n", size_class.alias("class")), f"dealt_{name}")
        cells = shared(dealt.groupBy("grp", "class", "part").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("shingles")), f"cells_{name}")
        large = (F.col("sets") > BLOCK_SETS // 2) | (F.col("shingles") > BLOCK_SHINGLES // 2)
        blocks_for = F.greatest(F.ceil(F.greatest(F.sum("sets") / BLOCK_SETS, F.sum("shingles") / BLOCK_SHINGLES)), F.lit(1)).cast("int")
        # small parts share blocks; a large one has blocks of its own
        own = shared(cells.filter(large).groupBy("grp", "class", "part").agg(blocks_for.alias("own_blocks")), f"own_{name}")
        mixed = shared(cells.filter(~large).groupBy("grp", "class").agg(blocks_for.alias("mixed_blocks")), f"mixed_{name}")
        alone = F.col("own_blocks").isNotNull()
        of_block = F.when(alone, F.pmod(F.hash("rep"), "own_blocks")).otherwise(F.pmod(F.hash("part"), "mixed_blocks"))
        placed = dealt.join(mixed, ["grp", "class"], "left").join(own, ["grp", "class", "part"], "left")
        block = F.struct("class", alone.alias("alone"), F.when(alone, F.col("part")).otherwise(0).alias("part"), of_block.alias("number"))
        placed = shared(placed.select("grp", "rep", "component", block.alias("block")), f"placed_{name}")
        blocks = shared(placed.select("grp", "block").distinct(), f"blocks_{name}")
        near = (F.col("x.class") - F.col("y.class")).between(-1, 1)
        strange = ~F.col("x.alone") | ~F.col("y.alone") | (F.col("x.part") != F.col("y.part"))
        pairs = blocks.withColumnRenamed("block", "x").join(blocks.withColumnRenamed("block", "y"), "grp").filter(near & strange & (F.col("x") <= F.col("y")))
        sides = F.when(F.col("x") == F.col("y"), F.array(F.struct(F.col("x").alias("block"), F.lit(2).alias("side")))).otherwise(F.array(F.struct(F.col("x").alias("block"), F.lit(0).alias("side")), F.struct(F.col("y").alias("block"), F.lit(1).alias("side"))))
        sides = pairs.select("grp", F.xxhash64("x").alias("x"), F.xxhash64("y").alias("y"), F.explode(sides).alias("s")).select("grp", "x", "y", "s.*")
        met = placed.join(sides, ["grp", "block"]).join(sketches.select("rep", "registers"), "rep")
        likely = met.select("grp", "x", "y", "rep", "component", "side", "registers").groupBy("grp", "x", "y").applyInPandas(likely_members(percent), "grp long, x long, y long, rep long, component long, side int")
        likely = shared(likely, f"screened_{name}")
        texts = texts_of(likely.select(F.col("rep").alias("doc_id")).distinct(), name)
        sets = shared(arrow_map(texts, lambda it: set_batches(it, sketcher.words), "rep long, shingles binary"), f"sets_{name}")
        return shared(likely.join(sets, "rep").groupBy("grp", "x", "y").applyInPandas(joined_components(percent), "a long, b long"), f"meetings_{name}")

    def merged(joined: DataFrame, pairs: DataFrame | None, name: str) -> DataFrame:
        """node, component after pairs of components were joined too."""
        if pairs is None or pairs.isEmpty():
            return joined
        more = components(pairs, shared, name)
        moved = joined.join(more.select(F.col("node").alias("component"), F.col("component").alias("now")), "component", "left")
        return shared(moved.select("node", F.coalesce("now", "component").alias("component")).unionByName(more), f"merged_{name}")

    stars = members.filter("rep > low").select(F.col("low").alias("a"), F.col("rep").alias("b")).distinct()
    likely = likely_links(stars, "stars")
    joined = components(links(likely, "stars"), shared, "joined")
    family = components(likely, shared, "family").select("node", F.col("component").alias("family"))
    family = shared(family.unionByName(family.select(F.col("family").alias("node"), "family").distinct()), "families")

    # components of one family
    kin = family.join(joined, "node", "left").select(F.col("family").alias("grp"), F.col("node").alias("rep"), F.coalesce("component", "node").alias("component"))
    kin = shared(kin.join(sketches.select("rep", "n"), "rep").select("grp", F.col("component").alias("part"), "rep", "component", "n"), "kin")
    joined = merged(joined, meetings(kin, "inside"), "inside")

    # families that share a bucket
    placed = members.filter("members > 2").join(joined, F.col("rep") == F.col("node"), "left").drop("node").join(family, F.col("rep") == F.col("node"), "left")
    placed = placed.select(F.col("key").alias("grp"), F.coalesce("family", "rep").alias("part"), "rep", F.coalesce("component", "rep").alias("component"), "n")
    joined = merged(joined, meetings(shared(placed, "apart"), "apart"), "apart")

    # every document gets the component of its class
    of_class = reps.select("set_hash", "n", "rep").join(joined, F.col("rep") == F.col("node"), "left").select("set_hash", "n", F.coalesce("component", "rep").alias("component"))
    found = signed.select("doc_id", "n", "set_hash").join(shared(of_class, "of_class"), ["set_hash", "n"], "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
