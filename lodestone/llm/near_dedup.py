"""Near-duplicate classes by chosen-path set similarity join.

Every set of word shingles is mapped to `WIDTH` minwise tokens.  A tree of the join branches a set by the tokens at
coordinates that the node's own key selects (1 / similarity of them on average, 1 at least), so similar sets keep
meeting and others part.  Independent trees repeat this: as many as find a pair exactly at the threshold with
probability `RECALL` if its node is branched down to `DEPTH` (nodes compared before that find more).  In detail:

* sets that are equal form one class first; only class representatives go on;
* in every first-level node, all members are held against one member (the pivot, drawn per node): linear in the node;
* nodes whose members are still in more than one component are compared exhaustively if they have `LEAF` members at
  most; if they have `LEAF` members at most outside their largest component, these are compared with all, in blocks;
  other nodes are branched further (what is left after `DEPTH` levels is compared in blocks too);
* a node is compared twice: by an estimate from the minwise tokens, five standard errors below the threshold, which
  leaves the members that may be linked to another; then on the full sets of these.  Each block puts out links that
  connect what its pairs connect, never more than it has members, so no step grows with the pairs of a group.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import by_bytes, saved, small_batches, unused
from lodestone.llm.components import components
from lodestone.llm.shingles import mix, sets

#: Minwise tokens per set, members compared exhaustively, levels.
WIDTH, LEAF, DEPTH = 64, 1024, 8
#: Probability that a pair exactly at the threshold meets at the deepest level of some tree.
RECALL = 0.97

_RANDOM = np.random.default_rng(13579)
_ORDER = _RANDOM.integers(0, 1 << 63, WIDTH, np.uint64) * np.uint64(2) + np.uint64(1)


def _second(percent: int) -> float:
    """Probability that a node branches by a second coordinate: 1 / similarity coordinates on average."""
    return 100 / percent - 1


def met(percent: int, trees: int, levels: int) -> float:
    """Probability that a pair exactly at the threshold shares a node `levels` below the roots of some tree."""
    at, two, p = percent / 100, _second(percent), 1.0
    for _ in range(levels + 1):
        once = at * p
        p = (1 - two) * once + two * (1 - (1 - once) ** 2)
    return 1 - (1 - p) ** trees


def _roots(percent: int) -> list[tuple[int, int]]:
    """(tree, coordinate) of the roots of every tree."""
    trees = next(n for n in range(1, 1000) if met(percent, n, DEPTH) >= RECALL)
    rng = np.random.default_rng(24680)
    return [(t, int(c)) for t in range(trees) for c in rng.choice(WIDTH, 1 + int(rng.random() < _second(percent)), replace=False)]


def _sketch(k: int, percent: int):
    roots = _roots(percent)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in by_bytes(batches, "_t"):
            found = sets(texts, k)
            sizes = np.array([len(s) for s in found], np.int64)
            keys = [xxhash.xxh3_128_digest(s) if len(s) else None for s in found]
            tokens = np.zeros((len(texts), WIDTH), np.uint64)
            some = np.flatnonzero(sizes)
            if len(some):
                flat = np.concatenate([found[i] for i in some])
                starts = np.cumsum(sizes[some]) - sizes[some]
                for j in range(WIDTH):
                    tokens[some, j] = np.minimum.reduceat(flat * _ORDER[j], starts)
            tokens = mix(tokens)
            prints = (tokens >> np.uint64(48)).astype("<u2")
            nodes = np.stack([mix(tokens[:, c] + np.uint64(1 + c + WIDTH * t)) for t, c in roots], axis=1).view(np.int64)
            offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(roots))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array([p.tobytes() for p in prints], pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(nodes.ravel()))],
                ["_id", "_q", "_n", "_h", "_s", "_nodes"],
            )

    return run


def _full_sets(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in by_bytes(batches, "_t"):
            found = sets(texts, k)
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s) for s in found], pa.binary()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], ["_h", "_set"])

    return run


def _least_matches(percent: int) -> int:
    p = percent / 100
    return int(np.floor(WIDTH * p - 5 * np.sqrt(WIDTH * p * (1 - p))))


def _likely(percent: int):
    """Pairs whose tokens and sizes leave the threshold possible."""
    least = _least_matches(percent)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, WIDTH) for i in (2, 3))
                batch = batch.filter(pa.array((a == b).sum(axis=1) >= least))
            yield batch.select([0, 1])

    return run


def _values(column: pa.Array) -> list:
    """Values of a column; lists of numbers as arrays."""
    if not pa.types.is_list(column.type):
        return column.to_pylist()
    at, flat = column.offsets.to_numpy(), column.values.to_numpy()
    return [flat[a:b] for a, b in itertools.pairwise(at.tolist())]


def _groups(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with the same first `keys` columns: those, and the rows' other columns."""
    held: list[tuple] = []
    last = None
    for batch in batches:
        for row in zip(*map(_values, batch.columns)):
            if row[:keys] != last:
                if held:
                    yield last, held
                held, last = [], row[:keys]
            held.append(row[keys:])
    if held:
        yield last, held


class _Block:
    """Members of a block: each that asks is held against those that stay, are in another component and are of like size.

    Of two that ask, the one of the lesser key takes the other where that one stays: in one block whatever the order
    of rows, which may differ between blocks.
    """

    def __init__(self, keys: list[bytes], labels: list[bytes], size: list[int], asks: list[bool], stays: list[bool], percent: int):
        self.rank = np.unique(np.frombuffer(b"".join(keys), "S16"), return_inverse=True)[1]
        self.label = np.unique(np.frombuffer(b"".join(labels), "S16"), return_inverse=True)[1]
        self.size, self.asks, self.stays, self.percent = np.array(size), np.array(asks), np.array(stays), percent

    def askers(self) -> np.ndarray:
        return np.flatnonzero(self.asks)

    def others(self, i: int) -> np.ndarray:
        found = self.stays & (self.label != self.label[i]) & (~self.asks | (self.rank > self.rank[i]))
        return np.flatnonzero(found & (100 * np.minimum(self.size, self.size[i]) >= self.percent * np.maximum(self.size, self.size[i])))


def _candidates(percent: int):
    """Rows sorted by (_v, _block): the members whose tokens leave a link to another component possible, and `_sub`, one
    number for members of a block that such pairs connect."""
    least = _least_matches(percent)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (node, at), rows in _groups(batches, 2):
            keys, labels, tokens, size, asks, stays = map(list, zip(*rows))
            block = _Block(keys, labels, size, asks, stays, percent)
            tokens = np.frombuffer(b"".join(tokens), "<u2").reshape(-1, WIDTH)
            sub, paired = np.arange(len(rows)), np.zeros(len(rows), bool)
            for i in block.askers().tolist():
                near = block.others(i)
                near = near[(tokens[near] == tokens[i]).sum(axis=1) >= least]
                if len(near):
                    near = np.append(near, i)
                    paired[near] = True
                    sub[np.isin(sub, sub[near])] = sub[i]
            some = np.flatnonzero(paired).tolist()
            if some:
                columns = [pa.array([node] * len(some), pa.int64()), pa.array([at] * len(some), pa.int32()), pa.array(sub[some], pa.int32())]
                columns += [pa.array([c[i] for i in some], pa.binary()) for c in (keys, labels)]
                columns += [pa.array([c[i] for i in some], pa.bool_()) for c in (asks, stays)]
                yield pa.RecordBatch.from_arrays(columns, ["_v", "_block", "_sub", "_h", "_l", "_asks", "_stays"])

    return run


def _linked(percent: int):
    """Rows sorted by (_v, _block, _sub): links between components, confirmed on the full sets; none between members
    that earlier links of the block connect."""

    def links(rows: list[tuple]) -> Iterator[tuple[bytes, bytes]]:
        keys, labels, asks, stays, sets_ = map(list, zip(*rows))
        size = np.array([len(s) for s in sets_])
        block = _Block(keys, labels, size, asks, stays, percent)
        names, flat = np.unique(np.concatenate(sets_), return_inverse=True)
        starts = np.cumsum(size) - size
        mine = np.zeros(len(names), np.int64)
        for i in block.askers().tolist():
            near = block.others(i)
            if not len(near):
                continue
            own = flat[starts[i] : starts[i] + size[i]]
            mine[own] = 1
            n = size[near]
            ends = np.cumsum(n)
            shared = np.add.reduceat(mine[flat[np.arange(ends[-1]) + np.repeat(starts[near] - ends + n, n)]], ends - n)
            mine[own] = 0
            near = near[100 * shared >= percent * (n + size[i] - shared)]
            if len(near):
                reached, first = np.unique(block.label[near], return_index=True)
                for j in near[first].tolist():
                    yield min(keys[i], keys[j]), max(keys[i], keys[j])
                block.label[np.isin(block.label, reached)] = block.label[i]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, 3):
            found = list(links(rows))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.binary()) for i in (0, 1)], ["_u", "_v"])

    return run


def _sets_of(wanted: DataFrame, reps: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """The full sets of the classes `wanted` (_h)."""
    ids = reps.join(wanted.distinct(), "_h").select("_id").distinct()
    return saved(texts.join(ids, "_id").select("_t").mapInArrow(_full_sets(k), "_h binary, _set array<long>").dropDuplicates(["_h"]), "sets")


def _confirmed(pairs: DataFrame, reps: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (_a, _b) whose full sets reach the threshold, as links."""
    pairs = saved(pairs, "pairs")
    full = _sets_of(pairs.select(F.col("_a").alias("_h")).union(pairs.select("_b")), reps, texts, k)
    both = pairs.join(full.select(F.col("_h").alias("_a"), F.col("_set").alias("_x")), "_a").join(full.select(F.col("_h").alias("_b"), F.col("_set").alias("_y")), "_b")
    shared = both.select("_a", "_b", F.size(F.array_intersect("_x", "_y")).cast("long").alias("_i"), (F.size("_x") + F.size("_y")).cast("long").alias("_n"))
    return saved(shared.where(f"100 * _i >= {percent} * (_n - _i)").select(F.col("_a").alias("_u"), F.col("_b").alias("_v")), "confirmed")


def _branch(members: DataFrame, percent: int) -> DataFrame:
    """Members (_v, _h, _s, ...) of large nodes, moved to the children that their tokens choose."""
    chosen = lambda salt: F.pmod(F.xxhash64(F.col("_v"), F.lit(salt)), F.lit(WIDTH)).cast("int")
    child = lambda salt: F.xxhash64("_v", chosen(salt), F.substring(F.col("_s"), 2 * chosen(salt) + 1, F.lit(2)))
    second = F.pmod(F.xxhash64(F.col("_v"), F.lit(3)), F.lit(1000)) < round(1000 * _second(percent))
    keys = F.when(second & (chosen(1) != chosen(2)), F.array(child(1), child(2))).otherwise(F.array(child(1)))
    return members.withColumn("_v", F.explode(keys))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, percent: int = 85) -> DataFrame:
    """One row per row of `docs`: `_id`, `_n` (size of its shingle set), `_root` (least id reachable by links), `_q`
    (xxhash64 of the text) and `_c` (key of its component, null for an empty set).

    Sets are linked if 100 * intersection >= percent * union.  Texts that are null or without words have empty sets
    and are linked with nothing (`_root` is their own id); so are rows with a null id as far as others can see, but
    they get the root of their class.  Repeated rows get the same answer; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"))
    idtype = texts.schema["_id"].dataType.simpleString()
    rows = saved(texts.withColumn("_q", F.xxhash64("_t")).mapInArrow(_sketch(k, percent), f"_id {idtype}, _q long, _n long, _h binary, _s binary, _nodes array<long>"), "sketches")
    reps = saved(rows.where("_h is not null and _id is not null").groupBy("_h").agg(F.min("_id").alias("_id"), F.first("_n").alias("_n"), F.first("_s").alias("_s"), F.first("_nodes").alias("_nodes")), "classes")

    # First level: each member of a node against the pivot.
    nodes = reps.select("_h", F.explode("_nodes").alias("_v"))
    pivot = F.min(F.struct(F.xxhash64("_h", "_v"), F.col("_h")))["_h"]  # another one in each node, also of the same members
    shared = saved(nodes.groupBy("_v").agg(F.count(F.lit(1)).alias("_m"), pivot.alias("_p")).where("_m > 1"), "nodes")
    members = saved(nodes.join(shared, "_v"), "members")
    side = lambda p: reps.select(F.col("_h").alias(f"_{p}"), F.col("_s").alias(f"_s{p}"), F.col("_n").alias(f"_n{p}"))
    pairs = members.where("_h <> _p").select(F.least("_p", "_h").alias("_a"), F.greatest("_p", "_h").alias("_b")).distinct()
    pairs = pairs.join(side("a"), "_a").join(side("b"), "_b").where(f"100 * least(_na, _nb) >= {percent} * greatest(_na, _nb)")
    likely = pairs.select("_a", "_b", "_sa", "_sb").mapInArrow(_likely(percent), "_a binary, _b binary")
    links = _confirmed(likely, reps, texts, k, percent)
    root = components(links)

    # Nodes that still hold several components: small ones exhaustively, large ones level by level.
    labelled = reps.select("_h", "_s", "_n").join(root.withColumnRenamed("_u", "_h"), "_h", "left").withColumn("_l", F.coalesce("_root", "_h")).drop("_root")
    live = members.select("_v", "_h").join(labelled, "_h")
    asked = []
    for level in range(DEPTH + 1):
        sizes = live.groupBy("_v", "_l").agg(F.count(F.lit(1)).alias("_c"))
        stats = sizes.groupBy("_v").agg(F.sum("_c").alias("_m"), F.max(F.struct("_c", "_l")).alias("_top"), F.count(F.lit(1)).alias("_k")).where("_k > 1")
        stats = saved(stats.select("_v", "_m", F.col("_top._l").alias("_most"), (F.col("_m") - F.col("_top._c")).alias("_out")), "stats")
        live = saved(live.join(stats, "_v"), "mixed")
        asked.append(live.where(F.col("_m") <= LEAF).select("_v", F.lit(0).alias("_block"), "_h", "_l", "_s", "_n", F.lit(True).alias("_asks"), F.lit(True).alias("_stays")))
        large = live.where(F.col("_m") > LEAF)
        asked.append(_blocks(large.where((F.col("_out") <= LEAF) | F.lit(level == DEPTH))))
        large = large.where(F.col("_out") > LEAF).drop("_m", "_most", "_out")
        if level == DEPTH or large.isEmpty():
            break
        live = saved(_branch(large, percent), "branched")
    rest = asked[0]
    for more in asked[1:]:
        rest = rest.unionByName(more)
    marked = "_v long, _block int, _sub int, _h binary, _l binary, _asks boolean, _stays boolean"
    likely = saved(rest.repartition(F.col("_v"), F.col("_block")).sortWithinPartitions("_v", "_block").mapInArrow(_candidates(percent), marked), "likely")
    full = likely.join(_sets_of(likely.select("_h"), reps, texts, k), "_h").select("_v", "_block", "_sub", "_h", "_l", "_asks", "_stays", "_set")
    found = full.repartition(F.col("_v"), F.col("_block"), F.col("_sub")).sortWithinPartitions("_v", "_block", "_sub").mapInArrow(_linked(percent), "_u binary, _v binary")
    links = links.unionByName(saved(found, "confirmed"))
    root = components(links).withColumnRenamed("_u", "_h")
    least = reps.join(root, "_h", "left").withColumn("_root", F.coalesce("_root", "_h"))
    least = saved(least.groupBy("_root").agg(F.min("_id").alias("_least")).join(least.select("_h", "_root"), "_root").select("_h", "_least", F.col("_root").alias("_c")), "roots")
    return rows.select("_id", "_q", "_n", "_h").join(least, "_h", "left").select("_id", "_n", F.when(F.col("_id").isNotNull() | F.col("_least").isNotNull(), F.coalesce("_least", "_id")).alias("_root"), "_q", F.coalesce("_c", "_h").alias("_c"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one row of each near-duplicate class, that of the least id; texts without words all stay, but
    repeated rows (equal id and text) are one.  All columns pass through, whatever their names."""
    found = near_duplicates(docs, id_col, text_col, k, percent)
    key = F.struct(F.col("_id").isNull().alias("_none"), F.col("_id"), F.col("_q"))
    linked = found.where("_c is not null").groupBy("_c").agg(F.min(key).alias("_first")).select("_first._id", "_first._q")
    k_, q_ = unused(docs, "_k", "_q")
    first = linked.unionByName(found.where("_c is null").select("_id", "_q"))
    keep = saved(first.select(F.xxhash64("_id").alias(k_), F.col("_q").alias(q_)).distinct(), "kept")
    keyed = docs.withColumn(k_, F.xxhash64(F.col(id_col))).withColumn(q_, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    return keyed.join(keep, [k_, q_]).dropDuplicates([k_, q_]).drop(k_, q_)


def _blocks(live: DataFrame) -> DataFrame:
    """Nodes with few members outside their largest component, or that no level could split: each member stays in one
    block; those outside ask all blocks."""
    parts = F.ceil(F.col("_m") / LEAF).cast("int")
    asks = F.col("_l") != F.col("_most")
    rows = live.withColumn("_own", F.pmod(F.xxhash64("_h"), parts).cast("int"))
    rows = rows.withColumn("_block", F.explode(F.when(asks, F.sequence(F.lit(0), parts - 1)).otherwise(F.array("_own"))))
    return rows.select("_v", "_block", "_h", "_l", "_s", "_n", asks.alias("_asks"), (F.col("_block") == F.col("_own")).alias("_stays"))
