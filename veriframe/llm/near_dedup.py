"""Operator 6: near-duplicate groups by an LSH forest over MinHash signatures."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import only, stage, table, unstage
from .components import components
from .shingles import MinHash, common, mix, shingle_set

#: Values of an order that rows of a region share at least; every order starts so many values further on.
STRIDE = 4
#: Depths at which regions of an order may be told apart; a region is deepened until it holds REGION rows at most.
DEPTHS = (STRIDE, 7, 11, 18, 30)
REGION = 1024
#: Neighbours on either side of a row in the sorted order of its region. Up to SMALL rows all are neighbours.
BESIDE, SMALL = 2, 8
#: Chance that a pair just similar enough shares no region of any order, and that it is below floor().
FOREST_MISS, FLOOR_MISS = 5e-7, 1e-7
#: Rows and shingles of a block, the unit in which crowds are compared.
CROWD, CROWD_WORDS = 512, 1 << 21
#: Cells of the table in which a block's sets are counted.
_TABLE = 1 << 25


def trees(percent: int) -> int:
    """Orders of the forest: the fewest that share no region with a chance of FOREST_MISS at most."""
    return ceil(log(FOREST_MISS) / log(1 - min(percent / 100, 0.999) ** STRIDE))


def floor(percent: int) -> int:
    """Signature values in which candidates agree at least: the most that pairs of this similarity miss by FLOOR_MISS at most."""
    p, n, below, least = percent / 100, STRIDE * trees(percent), 0.0, 0
    while least < n:
        below += comb(n, least) * p**least * (1 - p) ** (n - least)
        if below > FLOOR_MISS:
            break
        least += 1
    return least


def _signatures(width: int, values: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("shingles")
        minhash = MinHash(values)
        for batch in batches:
            n, digest, sig = [], [], []
            for text in batch.column("text"):
                s = shingle_set(text.as_py(), width)
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                sig.append(minhash(s).astype("<u4").tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "n", "digest", "sig"])

    return run


def _matrix(column) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<u4").reshape(len(rows), -1)


def turned(sig: np.ndarray, tree: int) -> np.ndarray:
    """The values of signatures in the order of a tree."""
    return np.roll(sig, -tree * STRIDE, axis=1)


def prefix_keys(sig: np.ndarray, tree: int, depths: tuple[int, ...]) -> np.ndarray:
    """Hash of the first values of an order, for every row and depth."""
    values = turned(sig, tree).astype(np.uint64)
    h, out = np.zeros(len(sig), np.uint64), []
    for i in range(max(depths)):
        h = mix(h + values[:, i % values.shape[1]] + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        if i + 1 in depths:
            out.append(h.view(np.int64))
    return np.stack(out, axis=1)


def _shallow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            sig, rep = _matrix(batch.column("sig")), batch.column("rep")
            for tree in range(sig.shape[1] // STRIDE):
                keys = prefix_keys(sig, tree, DEPTHS[:1])[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sig), tree, np.int32)), pa.array(keys), rep], ["tree", "key", "rep"])


def _deep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for every level of rows of crowded regions."""
    for batch in batches:
        if len(batch):
            sig, of, rep = _matrix(batch.column("sig")), batch.column("tree").to_numpy(), batch.column("rep").to_numpy()
            for tree in np.unique(of):
                rows = np.flatnonzero(of == tree)
                keys = prefix_keys(sig[rows], int(tree), DEPTHS)
                level = np.tile(np.arange(len(DEPTHS), dtype=np.int32), len(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(level), tree, np.int32)), pa.array(level), pa.array(keys.ravel()), pa.array(np.repeat(rep[rows], len(DEPTHS)))],
                    ["tree", "level", "key", "rep"],
                )


def groups_of(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The runs of equal keys of a stream sorted by it; one run is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
            if held and keys[lo] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = keys[lo]
    if held:
        yield pa.Table.from_batches(held)


def beside(n: int) -> Iterator[tuple[int, int]]:
    """Places (i, j), i < j, of neighbours among n sorted rows."""
    reach = n - 1 if n <= SMALL else BESIDE
    for step in range(1, reach + 1):
        for i in range(n - step):
            yield i, i + step


def _neighbours(percent: int):
    """Candidate pairs of a region: rows that stand next to each other in its sorted order.

    Next to a row in the order of the turned signature stand those of the longest common prefixes with it.
    Rows that agree in less than floor() values are no candidates, nor are sets whose sizes alone rule the
    similarity out. Pairs of a region with very long sets are dealt to parts of it, along the order.
    """
    least = floor(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_out, b_out, r_out = [], [], []
        for t in groups_of(batches, "region"):
            sig, rep, n = _matrix(t.column("sig")), t.column("rep").to_numpy(), t.column("n").to_numpy()
            order = np.lexsort(turned(sig, t.column("tree")[0].as_py()).T[::-1])
            sig, rep, n = sig[order], rep[order], n[order]
            part = np.cumsum(n) // CROWD_WORDS
            places = np.array(list(beside(len(rep))), np.int64).reshape(-1, 2)
            i, j = places[:, 0], places[:, 1]
            fits = (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & ((sig[i] == sig[j]).sum(1) >= least)
            i, j = i[fits], j[fits]
            a_out += np.minimum(rep[i], rep[j]).tolist()
            b_out += np.maximum(rep[i], rep[j]).tolist()
            r_out += mix(np.full(len(i), t.column("region")[0].as_py(), np.int64).view(np.uint64) + part[i].astype(np.uint64)).view(np.int64).tolist()
            if len(a_out) > 50_000:
                yield pa.RecordBatch.from_pydict({"a": a_out, "b": b_out, "region": r_out})
                a_out, b_out, r_out = [], [], []
        kind = pa.int64()
        yield pa.RecordBatch.from_pydict({"a": pa.array(a_out, kind), "b": pa.array(b_out, kind), "region": pa.array(r_out, kind)})

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), width).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(sets, pa.binary())], ["rep", "words"])

    return run


class Joined:
    """Which rows are joined already."""

    def __init__(self):
        self.root: dict = {}

    def find(self, x):
        root = self.root
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def join(self, a, b) -> None:
        self.root[self.find(a)] = self.find(b)


def _confirm(percent: int):
    """Links of a region that hold on the full sets; pairs that are connected already are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_out, b_out = [], []
        for t in groups_of(batches, "region"):
            sets = {r: np.frombuffer(w, np.uint64) for r, w in zip(t.column("rep").to_pylist(), t.column("words").to_pylist())}
            joined = Joined()
            for a, partners in zip(t.column("rep").to_pylist(), t.column("partners").to_pylist()):
                for b in partners:
                    if joined.find(a) != joined.find(b):
                        both = common(sets[a], sets[b])
                        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                            joined.join(a, b)
                            a_out.append(a)
                            b_out.append(b)
        yield pa.RecordBatch.from_pydict({"a": pa.array(a_out, pa.int64()), "b": pa.array(b_out, pa.int64())})

    return run


def _sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(rep, words) of the wanted rows (rep)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(wanted.distinct().hint("merge"), "rep", "left_semi")
    return texts.mapInArrow(_sets(width), "rep long, words binary")


def _links(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links among staged candidate pairs (a, b, region): each text once, its set once for each region."""
    asked = pairs.groupBy("region", F.col("a").alias("rep")).agg(F.collect_list("b").alias("partners"))
    ends = pairs.select("region", F.col("b").alias("rep"), F.array().cast("array<long>").alias("partners"))
    sides = asked.unionByName(ends).groupBy("region", "rep").agg(F.flatten(F.collect_list("partners")).alias("partners"))
    sets = _sets_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("rep")), width)
    met = sides.join(sets.hint("merge"), "rep").select("region", "rep", "partners", "words")
    return stage(met.repartition("region").sortWithinPartitions("region").mapInArrow(_confirm(percent), "a long, b long"), "confirmed")


class Crowd:
    """A block of a crowd, or two blocks to be compared with each other, and the pairs in it that are still open."""

    def __init__(self, t: pa.Table, percent: int):
        block = t.column("block").to_numpy()
        self.left = np.flatnonzero(block == block.min())
        self.right = np.flatnonzero(block == block.max())
        self.sig, self.group, self.n = _matrix(t.column("sig")), t.column("group").to_numpy(), t.column("n").to_numpy()
        self.open = self._open(t.column("tree")[0].as_py(), percent)

    def _open(self, tree: int, percent: int) -> np.ndarray:
        """Left rows by right rows: candidates of different groups that share no region of an earlier order."""
        a, b = self.sig[self.left], self.sig[self.right]
        m, n = self.n[self.left][:, None], self.n[self.right][None, :]
        fits = (self.group[self.left][:, None] != self.group[self.right][None, :]) & (100 * np.minimum(m, n) >= percent * np.maximum(m, n))
        if not fits.any():
            return fits
        same = np.zeros(fits.shape, np.uint16)
        for order in range(a.shape[1] // STRIDE):
            met = np.zeros(fits.shape, np.uint8)
            for k in range(order * STRIDE, (order + 1) * STRIDE):
                met += a[:, k, None] == b[None, :, k]
            same += met
            if order < tree:
                fits &= met < STRIDE
        fits &= same >= floor(percent)
        if len(self.left) == len(self.right) and (self.left == self.right).all():
            fits = np.triu(fits, 1)
        return fits

    def counts(self, sets: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(left row, right rows it is open with, sizes of the intersections)."""
        of, sought = np.flatnonzero(self.open.any(1)), np.flatnonzero(self.open.any(0))
        if not len(of):
            return
        inverted = None
        words = np.unique(np.concatenate([sets[self.right[j]] for j in sought]))
        if len(words) * len(sought) <= _TABLE:
            inverted = np.zeros((len(words), len(sought)), np.uint8)
            for place, j in enumerate(sought):
                inverted[np.searchsorted(words, sets[self.right[j]]), place] = 1
        for i in of:
            own, partners = sets[self.left[i]], np.flatnonzero(self.open[i])
            if inverted is None:
                both = np.array([common(own, sets[self.right[j]]) for j in partners])
            else:
                at = np.minimum(np.searchsorted(words, own), len(words) - 1)
                both = inverted[at[words[at] == own]].sum(0, dtype=np.int64)[np.searchsorted(sought, partners)]
            yield self.left[i], self.right[partners], both


_ROW = "tree int, key long, rep long, group long, n long"


def _open_rows(percent: int):
    """The rows of a crowd that are still open with another one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups_of(batches, "region"):
            crowd = Crowd(t, percent)
            rows = np.union1d(crowd.left[crowd.open.any(1)], crowd.right[crowd.open.any(0)])
            if len(rows):
                yield from t.select(["tree", "key", "rep", "group", "n"]).take(pa.array(rows)).combine_chunks().to_batches()

    return run


def _crossing(percent: int):
    """Links between different groups of a crowd; pairs that are connected already are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_out, b_out = [], []
        for t in groups_of(batches, "region"):
            crowd, joined = Crowd(t, percent), Joined()
            sets, rep = [np.frombuffer(w, np.uint64) for w in t.column("words").to_pylist()], t.column("rep").to_numpy()
            for i, partners, both in crowd.counts(sets):
                for j in partners[100 * both >= percent * (crowd.n[i] + crowd.n[partners] - both)]:
                    if joined.find(crowd.group[i]) != joined.find(crowd.group[j]):
                        joined.join(crowd.group[i], crowd.group[j])
                        a_out.append(int(rep[i]))
                        b_out.append(int(rep[j]))
        yield pa.RecordBatch.from_pydict({"a": pa.array(a_out, pa.int64()), "b": pa.array(b_out, pa.int64())})

    return run


def _dealt(rows: DataFrame) -> DataFrame:
    """(region, block) added to rows (tree, key, rep, group, n) of crowds with different groups; other crowds are left out.

    A crowd of more than a block becomes a region for every two blocks, save those of its largest group alone.
    """
    at = ["tree", "key"]
    groups = rows.groupBy(*at, "group").agg(F.count("*").alias("members"), F.sum("n").alias("words"))
    stats = groups.groupBy(*at).agg(
        F.count("*").alias("groups"), F.sum("members").alias("members"), F.sum("words").alias("words"), F.max(F.struct("members", "group", "words")).alias("top")
    )
    blocks = lambda members, words: F.greatest(F.ceil(members / F.lit(CROWD)), F.ceil(words / F.lit(CROWD_WORDS))).cast("int")
    stats = stats.where("groups > 1").select(
        *at, F.col("top.group").alias("largest"), blocks(F.col("members"), F.col("words")).alias("whole"),
        blocks(F.col("members") - F.col("top.members"), F.col("words") - F.col("top.words")).alias("seeking"), blocks(F.col("top.members"), F.col("top.words")).alias("sought"),
    )
    hashed = lambda n: F.pmod(F.xxhash64("rep", F.lit(1)), n).cast("int")
    seeks = F.col("group") != F.col("largest")
    block = F.when(F.col("whole") < 2, 0).when(seeks, hashed(F.col("seeking"))).otherwise(F.col("seeking") + hashed(F.col("sought")))
    last = F.when(F.col("whole") < 2, 0).when(seeks, F.col("seeking") + F.col("sought") - 1).otherwise(F.col("seeking") - 1)
    met = rows.join(stats, at).withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return met.select(*rows.columns, F.xxhash64(*at, F.least("block", "other"), F.greatest("block", "other")).alias("region"), "block")


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    Rows with equal shingle sets are one class, known by its smallest doc_id; only one row of a
    class goes on. Each of trees() orders of a class's signature starts at other values. Rows with
    the same first values in an order form a region; a region of over REGION rows is told apart
    further on in its order, region by region. The rows of a region are sorted by the order, and a row's
    neighbours in it, which have the longest prefixes in common with it, are its candidates. Pairs are
    confirmed on the full sets of shingle hashes (64 bits), then joined to components. So candidates are
    in proportion to the rows.

    What neighbours miss is then found exactly: every pair of rows of different components that share a region of
    the first depth, and agree in floor() values, is compared on the full sets, in the first order in which they share one.
    That takes two passes over blocks of CROWD rows, which give back rows or links, never pairs: one over
    signatures alone, for the rows that are open with any other, and one over the sets of those. Neither a crowd
    nor nearer rows keep a pair from being compared; only rows of a region's largest component are not compared among themselves.

    A text of fewer than `width` words is one shingle. Null, empty and blank texts have no shingles
    and are linked with nothing. Rows without a doc_id take the component of their class (null if
    it has none) and are kept only then. Repeated rows share everything. Very long texts are whole sets; blocks are
    bounded by shingles too. An empty table gives an empty result. Only doc_id and text are read.

    Shuffled: signatures by class, one narrow row a tree and class, the signatures of shared
    regions, texts to find those of candidates, and their sets once for each region in
    which a pair of theirs is compared.
    """
    signature = _signatures(width, STRIDE * trees(percent))
    signed = stage(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(signature, "doc_id long, n long, digest binary, sig binary"), "signatures")
    classes = stage(signed.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes")
    reps = classes.where("rep IS NOT NULL").select("rep", "n", "sig")

    shallow = reps.mapInArrow(_shallow, "tree int, key long, rep long")
    crowd = shallow.groupBy("tree", "key").agg(F.count("*").alias("size")).where("size > 1")
    shared = stage(shallow.join(crowd, ["tree", "key"]).select("tree", "key", "rep", "size"), "regions")
    settled = shared.where(F.col("size") <= REGION).select("tree", F.xxhash64("tree", F.lit(0), "key").alias("region"), "rep")
    crowded = shared.where(F.col("size") > REGION).join(reps, "rep").select("tree", "rep", "sig")
    levels = stage(crowded.mapInArrow(_deep, "tree int, level int, key long, rep long"), "levels")
    sizes = stage(levels.groupBy("tree", "level", "key").agg(F.count("*").alias("size")), "sizes")
    sized = levels.join(sizes, ["tree", "level", "key"]).where("size > 1")
    at = F.struct("level", "key", "size")
    chosen = sized.groupBy("tree", "rep").agg(F.min(F.when(F.col("size") <= REGION, at)).alias("fit"), F.max(F.when(F.col("size") > REGION, at)).alias("big"))
    chosen = chosen.select("tree", "rep", F.coalesce("fit", "big").alias("at")).select("tree", "rep", "at.*")
    # What no depth tells apart, or leaves alone, stays in a part of its deepest crowded region, another in every tree.
    part = F.when(F.col("size") > REGION, F.pmod(F.xxhash64("rep", "tree"), F.ceil(2 * F.col("size") / REGION))).otherwise(F.lit(-1))
    told = chosen.select("tree", F.xxhash64("tree", "level", "key", part).alias("region"), "rep")

    sorted_rows = settled.unionByName(told).join(reps, "rep").select("tree", "region", "rep", "n", "sig").repartition("region").sortWithinPartitions("region")
    pairs = sorted_rows.mapInArrow(_neighbours(percent), "a long, b long, region long")
    pairs = stage(pairs.groupBy("a", "b").agg(F.min("region").alias("region")), "pairs")
    links = _links(docs, pairs, width, percent)
    found = stage(components(links), "components")

    crowds = shared.where(F.col("size") > SMALL).join(found, F.col("rep") == F.col("id"), "left")
    crowds = _dealt(crowds.select("tree", "key", "rep", F.coalesce("component", "rep").alias("group"), F.lit(0).cast("long").alias("n")))
    signs = crowds.drop("n").join(reps, "rep").select("region", "block", "tree", "key", "rep", "group", "n", "sig")
    left = stage(signs.repartition("region").sortWithinPartitions("region").mapInArrow(_open_rows(percent), _ROW).distinct(), "open-rows")
    if not left.isEmpty():
        sets = _sets_of(docs, left.select("rep"), width).join(reps.select("rep", "sig"), "rep")
        met = _dealt(left).join(sets.hint("merge"), "rep").select("region", "block", "tree", "group", "rep", "n", "sig", "words")
        crossing = stage(met.repartition("region").sortWithinPartitions("region").mapInArrow(_crossing(percent), "a long, b long"), "crossing")
        joined = stage(components(links.unionByName(crossing)), "components")
        unstage(crossing, found)
        found = joined
    unstage(shared, levels, sizes, pairs, links, left)

    named = classes.select("digest", "rep").join(found, F.col("rep") == F.col("id"), "left").select("digest", F.coalesce("component", "rep").alias("c"))
    out = signed.select("doc_id", "n", "digest").join(named, "digest", "left")
    component = F.when(F.col("n") > 0, F.col("c")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
