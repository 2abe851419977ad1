"""Best-fit packing of tokenised documents into sequences by a grouping genetic algorithm.

An individual is a packing: a list of bins. Crossover injects well-filled bins of one parent whole into the other, bins
that now hold an item twice are dissolved, and their items are placed again by best fit, largest first. Items are spread
over blocks of bounded size; each block is evolved by several islands, which start from different packings (one from best
fit decreasing, all from best fit in orders of their own) and send their elites on in a ring between epochs. An island
crosses for one generation at least, and until no packing can have fewer bins. Bins that stay poorly filled are dissolved
once more and packed across blocks.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import Scratch, process_cache, table
from ._tokens import Tokens

CAPACITY = 4096
END_ID = 1
BLOCK_ITEMS = 4096
ISLANDS, EPOCHS, POPULATION, GENERATIONS, ELITES = 3, 3, 4, 12, 2
#: Islands that a task evolves one after the other.
ISLANDS_A_TASK = 4
#: Generations that an island runs even if it has reached the bound.
MIN_GENERATIONS = 1
#: Bins that a new individual tries to fill better by trading items with those to be placed.
TRADES = 60
#: Displaced items that are tried for a bin, and their pairs.
TRADED = 24
PAIRS = np.tril_indices(TRADED, -1)
#: Bins filled less than this share are dissolved and packed across blocks.
POOR = 0.97
#: Characters of texts that are tokenised at once.
CHARS = 1 << 22

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, spread long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(documents: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document; ``spread`` deals pieces out evenly."""

    def cut(batches):
        from pyspark import TaskContext

        tokens = process_cache().setdefault(("tokens", path), None) or Tokens(path)
        process_cache()["tokens", path] = tokens
        seen, task = 0, (TaskContext.get() and TaskContext.get().partitionId() or 0) << 40
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            row = 0
            while row < len(ids):
                some, size = [], 0
                while row + len(some) < len(ids) and size < CHARS:
                    some.append(texts[row + len(some)].as_py() or "")
                    size += len(some[-1])
                out = []
                for doc, got in zip(ids[row:], tokens.encode(some)):
                    got = np.append(got, np.uint32(END_ID)).astype("<u4")
                    for k in range(0, len(got), capacity):
                        x = got[k : k + capacity]
                        out.append((doc, k // capacity, k, len(x), zlib.crc32(x.tobytes()), hash((task, seen))))
                        seen += 1
                types = [pa.int64(), pa.int32(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], [f.split()[0] for f in _PIECES.split(", ")])
                row += len(some)

    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, _PIECES)


def best_fit(order, size, bins: list[list[int]], fill: list[int], capacity: int) -> None:
    """Put the items of ``order`` each into the fullest bin that still takes it; ``mask`` has a bit for every free room."""
    rooms: dict[int, list[int]] = {}
    mask = 0
    for b, f in enumerate(fill):
        rooms.setdefault(capacity - f, []).append(b)
        mask |= 1 << (capacity - f)
    for i in order:
        s = size[i]
        fits = mask >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            b, room = len(bins), capacity
            bins.append([])
            fill.append(0)
        bins[b].append(i)
        fill[b] += s
        rooms.setdefault(room - s, []).append(b)
        mask |= 1 << (room - s)


class Packing:
    def __init__(self, bins: list[list[int]], fill: list[int], capacity: int):
        self.bins, self.fill = bins, fill
        self.cost = (len(bins), -sum((f / capacity) ** 2 for f in fill))


def lower_bound(size: list[int], capacity: int) -> int:
    return max(-(-sum(size) // capacity), sum(2 * s > capacity for s in size))


class Island:
    def __init__(self, size: list[int], capacity: int, seed: int):
        self.size, self.capacity, self.rng = size, capacity, np.random.default_rng(seed)
        self.bound = lower_bound(size, capacity)

    def build(self, order, bins=(), fill=()) -> Packing:
        bins, fill = [list(b) for b in bins], list(fill)
        best_fit(order, self.size, bins, fill, self.capacity)
        return Packing(bins, fill, self.capacity)

    def first(self) -> Packing:
        """Best fit decreasing."""
        return self.build(sorted(range(len(self.size)), key=lambda i: -self.size[i]))

    def another(self) -> Packing:
        """Best fit in an order that is only roughly decreasing."""
        key = np.array(self.size) * self.rng.uniform(0.6, 1, len(self.size))
        return self.build(np.argsort(-key, kind="stable").tolist())

    def rebuild(self, keep: list[int], parent: Packing, extra: list[list[int]] = ()) -> Packing:
        """``extra`` bins whole, then the parent's bins of ``keep`` that share no item with them; the rest by best fit."""
        bins = [list(b) for b in extra]
        fill = [sum([self.size[i] for i in b]) for b in bins]
        used = {i for b in bins for i in b}
        keep = [k for k in keep if used.isdisjoint(parent.bins[k])]
        bins += [list(parent.bins[k]) for k in keep]
        fill += [parent.fill[k] for k in keep]
        used.update(i for k in keep for i in parent.bins[k])
        left = [i for i in range(len(self.size)) if i not in used]
        self.trade(left, bins, fill)
        return self.build(sorted(left, key=lambda i: -self.size[i]), bins, fill)

    def trade(self, left: list[int], bins: list[list[int]], fill: list[int]) -> None:
        """Swap one or two items of a bin for one or two displaced ones where that fills the bin better: what is left to
        place becomes smaller. A bounded number of bins is tried, chosen at random."""
        size = self.size
        for b in self.rng.permutation(len(bins))[:TRADES]:
            room, best = self.capacity - fill[b], None
            if not room or not left:
                continue
            own = bins[b]
            out = [(i,) for i in own] + [(i, j) for x, i in enumerate(own) for j in own[:x]][:40]
            some = left if len(left) <= TRADED else [left[k] for k in self.rng.permutation(len(left))[:TRADED]]
            one = np.array([size[i] for i in some])
            x, y = PAIRS[0][: len(some) * (len(some) - 1) // 2], PAIRS[1][: len(some) * (len(some) - 1) // 2]
            gains = np.concatenate([one, one[x] + one[y]])
            order = np.argsort(gains, kind="stable")
            gains = gains[order]
            lost = [sum([size[i] for i in t]) for t in out]
            for t, s, k in zip(out, lost, (np.searchsorted(gains, np.array(lost) + room, "right") - 1).tolist()):
                if k >= 0 and (gain := int(gains[k]) - s) > 0 and (best is None or gain > best[0]):
                    k = int(order[k]) - len(some)
                    best = gain, t, (some[k],) if k < 0 else (some[x[k]], some[y[k]])
                    if gain == room:
                        break
            if best:
                gain, t, u = best
                bins[b] = [i for i in own if i not in t] + list(u)
                fill[b] += gain
                left[:] = [i for i in left if i not in u] + list(t)

    def cross(self, a: Packing, b: Packing) -> Packing:
        full = np.argsort([-f for f in b.fill], kind="stable")[: max(1, len(b.bins) // 2)]
        chosen = [b.bins[k] for k in full if self.rng.random() < 0.5]
        return self.rebuild(list(range(len(a.bins))), a, chosen)

    def mutate(self, a: Packing) -> Packing:
        poor = set(np.argsort(a.fill, kind="stable")[:2]) | set(self.rng.integers(0, len(a.bins), max(2, len(a.bins) // 20)))
        return self.rebuild([k for k in range(len(a.bins)) if k not in poor], a)

    def evolve(self, group: list[Packing], population: int = POPULATION, generations: int = GENERATIONS) -> list[Packing]:
        """Best first. Stops, after MIN_GENERATIONS, as soon as no packing can have fewer bins."""
        group = list(group)
        while len(group) < population:
            group.append(self.another())
        for k in range(generations):
            group.sort(key=lambda g: g.cost)
            if k >= MIN_GENERATIONS and group[0].cost[0] <= self.bound:
                break
            a, b = self.rng.choice(max(2, population // 2), 2, replace=False)
            group = group[: population - 2] + [self.cross(group[a], group[b]), self.mutate(group[a])]
        return sorted(group, key=lambda g: g.cost)


def _islands(batches, capacity: int, seed: int):
    """One epoch of each row's island: block, island, sizes, packings (each a bin number for every item). In the first epoch
    the first island also tells how many bins best fit decreasing needs."""
    for batch in batches:
        for row in batch.to_pylist():
            size = row["sizes"]
            island = Island(size, capacity, abs(hash((seed, row["block"], row["island"]))))
            arrived = []
            for places in row["packings"]:
                bins: list[list[int]] = [[] for _ in range(max(places) + 1)]
                for i, b in enumerate(places):
                    bins[b].append(i)
                arrived.append(Packing(bins, [sum(size[i] for i in b) for b in bins], capacity))
            base = row["best_fit"]
            if not arrived and row["island"] == 0:
                arrived = [island.first()]
                base = len(arrived[0].bins)
            best = island.evolve(arrived)[:ELITES]
            out = []
            for p in best:
                places = [0] * len(size)
                for b, items in enumerate(p.bins):
                    for i in items:
                        places[i] = b
                out.append(places)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["block"]], pa.int64()), pa.array([row["island"]], pa.int32()), pa.array([size], pa.list_(pa.int32())), pa.array([len(best[0].bins)], pa.int32()), pa.array([best[0].cost[0] <= island.bound]), pa.array([out], pa.list_(pa.list_(pa.int32()))), pa.array([base], pa.int32())],
                ["block", "island", "sizes", "bins", "done", "packings", "best_fit"],
            )


def pack_blocks(scratch: Scratch, items: DataFrame, n: int, capacity: int, tag: str) -> DataFrame:
    """block, bin, offset, fill, gain for every row of ``items`` (which keeps its columns), evolved in blocks; gain: bins of the
    block that best fit decreasing would need more."""
    blocks = max(1, -(-n // BLOCK_ITEMS))
    key = F.pmod(F.xxhash64("spread", F.lit(tag)), F.lit(blocks))
    items = items.withColumn("block", key)
    items = scratch.save(items.withColumn("i", F.row_number().over(W.partitionBy("block").orderBy("spread", "doc_id", "piece")) - 1), f"items-{tag}")
    state = items.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("i", F.col("length").cast("int").alias("length")))).getField("length").alias("sizes"))
    state = state.select("block", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "sizes", F.array().cast("array<array<int>>").alias("packings"), F.lit(None).cast("int").alias("best_fit"))
    schema = "block long, island int, sizes array<int>, bins int, done boolean, packings array<array<int>>, best_fit int"
    parts = -(-blocks * ISLANDS // ISLANDS_A_TASK)
    for epoch in range(EPOCHS):
        if epoch:
            # Elites stay and also move on to the next island of the ring; blocks with an island that can't improve are done.
            finished = state.groupBy("block").agg(F.bool_or("done").alias("over"))
            state = scratch.save(state.drop("done").join(finished.withColumnRenamed("over", "done"), "block"), f"judged-{tag}-{epoch}", batch_rows=4)
            stayed = state.where("not done").select("block", "island", "sizes", "packings", "best_fit")
            moved = stayed.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), "sizes", "packings", F.lit(None).cast("int").alias("best_fit"))
            rest = state.where("done").select(*[f.split()[0] for f in schema.split(", ")])
            state = stayed.unionByName(moved).groupBy("block", "island").agg(F.first("sizes").alias("sizes"), F.flatten(F.collect_list("packings")).alias("packings"), F.max("best_fit").alias("best_fit"))
        # By a hash: with as many partitions as the aggregation above has, Spark would drop this step and join small partitions.
        state = state.repartition(min(parts, 4 * int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))), F.xxhash64("block", "island"))
        state = state.mapInArrow(lambda b, seed=epoch: _islands(b, capacity, seed), schema)
        if epoch:
            state = state.unionByName(rest)
        state = scratch.save(state, f"epoch-{tag}-{epoch}", batch_rows=4)
    best = state.groupBy("block").agg(F.min_by(F.col("packings")[0], F.struct("bins", "island")).alias("places"), (F.max("best_fit") - F.min("bins")).alias("gain"))
    placed = best.select("block", "gain", F.posexplode("places").alias("i", "bin"))
    rows = items.join(placed, ["block", "i"])
    bins = W.partitionBy("block", "bin")
    return rows.withColumn("fill", F.sum("length").over(bins)).withColumn("offset", F.sum("length").over(bins.orderBy("i")) - F.col("length")).drop("i")


def pack(documents: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, fill, gain of every piece; gain as in pack_blocks.

    A null text is an empty one: the end id alone. Only documents above ``capacity`` ids are cut. Null ids and repeated
    rows are packed like any other row; other columns are not read; an empty table gives an empty result. Null-id and
    repeated rows are told apart by a running number of the task that read them.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "packing")
    items = scratch.save(pieces(documents, path or tokenizer_path(), capacity), "pieces")
    first = scratch.save(pack_blocks(scratch, items, items.count(), capacity, "a"), "packed")
    scratch.drop("pieces", "items-a", *(f"{name}-a-{k}" for name in ("epoch", "judged") for k in range(EPOCHS)))
    poor = F.col("fill") < POOR * capacity
    left, old = first.where(poor).agg(F.count("*"), F.count_if(F.col("offset") == 0)).first()
    number = lambda k: F.col("block") * 65536 * 2 + F.col("bin") * 2 + k
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "fill", "gain"]
    done = first.withColumn("sequence_id", number(0))
    if left:
        again = scratch.save(pack_blocks(scratch, first.where(poor).select(*items.columns), left, capacity, "b"), "repacked")
        scratch.drop("items-b", *(f"{name}-b-{k}" for name in ("epoch", "judged") for k in range(EPOCHS)))
        if again.where("offset = 0").count() < old:
            done = done.where(~poor).select(columns).unionByName(again.withColumn("sequence_id", number(1)).select(columns))
    return done.select(columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
