"""Near-duplicate groups by bottom-k sketches of shingle sets.

1. Every document becomes its set of hashed shingles; equal sets are one node.  One hash function gives both a
   shingle's name and its place, and a node retains its ``k`` smallest values.  A set of up to ``k`` is retained whole.
2. Sets that link share at least ``SketchBound.shared`` of the ``k`` smallest values of their union, but for a chance
   of 10^-12 at the threshold itself (sets retained whole: exactly what it asks for).  So they share a value among
   the first ``size - least + 1`` of their sketches in any order that is the same for all; the order is rare values
   first, from a table of counts of fixed size (2^21 slots) over all retained values.  Inverted lists of those values,
   by class of set size, give the groups in which nodes meet.
3. In a group, blocks of ``block`` nodes count overlaps by the inverted lists of all their retained values.  The
   union-sketch estimate filters the pairs, parity maps of the sets (which never part what can link) some more, and
   nodes with a pair left bring their full sets, whose exact Jaccard similarity decides.
4. Round one: every node joins the largest of its lists, large lists are dealt over blocks that share a few leaders.
   In lists whose nodes aren't all in one component, members outside the largest component visit all blocks: first
   in lists that are the largest for most of their nodes, then in those that are still open.  Pairs of one component
   need no test, so thousands of near copies cost about one each, and no list meets in one task.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readlake.llm.components import components
from readlake.llm.jaccard import _group_edges, _whole_groups, can_link, folded, parity_maps, set_nodes, small, text_shingles
from readlake.llm.shared import discard, written
from readlake.llm.textkit import U64, binary_column, slices, text_bytes

_SLOT_BITS, _BLOCK_SLOTS = 21, 1 << 16
_PAD = U64(0xFFFFFFFFFFFFFFFF)
#: Groups of up to so many nodes are tested together, pair by pair.
_FEW = 8
_BY = ["key", "home", "guests"]
_FIELDS = "key long, home int, guests int, node long, comp long, probe boolean"


class SketchBound:
    """What ``k`` retained values must have in common if two sets reach ``percent``.

    The ``k`` smallest values of a union of u elements are a draw without replacement, so the shared ones among them
    are hypergeometric; ``least[u]`` is what they fall short of with a chance of ``miss`` at most, at ``percent`` itself.
    Once all that may differ fits into less than the draw there is no chance in it.
    """

    def __init__(self, k: int, percent: int, miss: float = 1e-12, unions: int = 4096):
        self.k, self.percent = k, percent
        least = np.zeros(unions, np.int64)
        fact = np.array([math.lgamma(x + 1) for x in range(unions + 1)])
        comb = lambda n, r: fact[n] - fact[r] - fact[n - r]
        for u in range(1, unions):
            shared = -(-percent * u // 100)
            draw = min(k, u)
            x = np.arange(max(0, draw - (u - shared)), min(draw, shared) + 1)
            tail = np.cumsum(np.exp(comb(shared, x) + comb(u - shared, draw - x) - comb(u, draw)))
            least[u] = x[np.searchsorted(tail, miss, "right")] if tail[-1] > miss else x[-1]
        # the union is known by an upper bound only; from k on no smaller one asks for less
        least[k:] = np.minimum.accumulate(least[k:])
        p, tail, s = percent / 100, 0.0, -1
        while tail <= miss and s < k:
            s += 1
            tail += math.comb(k, s) * p**s * (1 - p) ** (k - s)
        self.least, self.far = least, min(s, int(least[-1]))

    def shared(self, union: np.ndarray) -> np.ndarray:
        return np.where(union < len(self.least), self.least[np.minimum(union, len(self.least) - 1)], self.far)

    def prefix_length(self, size: np.ndarray) -> np.ndarray:
        """How many of a node's retained values, in the common order, any partner's must meet."""
        whole = -(-self.percent * size // 100)
        by_sketch = self.shared(size * 100 // self.percent)
        # a set that is retained whole may have partners that aren't
        least = np.where(size > self.k, by_sketch, np.where(size * 100 >= self.percent * (self.k + 1), np.minimum(whole, by_sketch), whole))
        return np.minimum(size, self.k) - least + 1

    def may_link(self, values: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the union-sketch estimate leaves a link open; exact where both sets are retained whole."""
        out = np.zeros(len(i), bool)
        for a in range(0, len(i), 8192):
            x, y = i[a : a + 8192], j[a : a + 8192]
            shared, low = estimate(values, x, y, self.k)
            both = size[x] + size[y]
            whole = (size[x] <= self.k) & (size[y] <= self.k)
            out[a : a + 8192] = np.where(whole, 100 * shared >= self.percent * (both - shared), low >= self.shared(both * 100 // (100 + self.percent)))
        # sizes alone can rule a pair out
        return out & (100 * np.minimum(size[i], size[j]) >= self.percent * np.maximum(size[i], size[j]))

    def open_pairs(self, values: np.ndarray, size: np.ndarray, maps: list[bytes], asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ``asked`` pairs of a group that stay open: overlaps by inverted lists of all retained values, parity
        maps, then the union-sketch estimate."""
        n = len(values)
        row, col = np.nonzero(values != _PAD)
        _, code, count = np.unique(values[row, col], return_inverse=True, return_counts=True)
        several = count > 1
        place = np.cumsum(several) - 1
        use = several[code]
        lists = np.zeros((n, int(several.sum())), np.float32)
        lists[row[use], place[code[use]]] = 1
        overlap = lists @ lists.T
        both = size[:, None] + size[None, :]
        whole = (size[:, None] <= self.k) & (size[None, :] <= self.k)
        need = np.where(whole, -(-self.percent * both // (100 + self.percent)), self.shared(both * 100 // (100 + self.percent)))
        i, j = np.nonzero(np.triu((overlap >= need) & asked, 1))
        for test in (lambda: maps_allow(maps, size, i, j, self.percent), lambda: self.may_link(values, size, i, j)):
            keep = test()
            i, j = i[keep], j[keep]
        return i, j


def pairs_asked(comp: np.ndarray, probe: np.ndarray) -> np.ndarray:
    """Pairs of different components, at least one of them a probe."""
    return (comp[:, None] != comp[None, :]) & (probe[:, None] | probe[None, :])


def estimate(values: np.ndarray, i: np.ndarray, j: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of rows of padded sketches: values in both, and those of them among the union's ``k`` smallest."""
    both = np.sort(np.concatenate([values[i], values[j]], axis=1), axis=1)
    twice = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != _PAD)
    place = np.arange(twice.shape[1]) - (np.cumsum(twice, axis=1) - twice)  # in the union
    return twice.sum(axis=1), (twice & (place < k)).sum(axis=1)


def maps_allow(maps: list[bytes], size: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether parity maps leave a link of each pair open: they never differ in more bits than the sets in elements."""
    out = np.zeros(len(i), bool)
    length = np.array([len(m) for m in maps], np.int64)
    shorter = np.minimum(length[i], length[j])
    for n in np.unique(shorter):
        at = np.flatnonzero(shorter == n)
        rows, where = np.unique(np.concatenate([i[at], j[at]]), return_inverse=True)
        bits = folded([maps[r] for r in rows.tolist()], int(n))
        for a in range(0, len(at), 4096):
            part = slice(a, a + 4096)
            x, y = where[: len(at)][part], where[len(at) :][part]
            apart = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1)
            out[at[part]] = can_link(size[i[at[part]]], size[j[at[part]]], apart, percent)
    return out


def padded(sketches: list[bytes], k: int) -> np.ndarray:
    """Sketches as rows of ``k`` values each, ascending, the largest integer after a short one's end."""
    out = np.full((len(sketches), k), _PAD, U64)
    lengths = np.array([len(s) // 8 for s in sketches], np.int64)
    flat = np.frombuffer(b"".join(sketches), U64)
    row = np.repeat(np.arange(len(sketches)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def links_of(sets: list[np.ndarray], maps: list[bytes], comp: np.ndarray, probe: np.ndarray, bound: SketchBound) -> list[tuple[int, int]]:
    """Pairs of sorted ``sets`` that link by their exact Jaccard similarity, none within a component."""
    parent = list(range(len(sets)))
    first: dict[int, int] = {}
    for at, c in enumerate(comp.tolist()):
        parent[at] = first.setdefault(c, at)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    size = np.array([len(s) for s in sets])
    i, j = bound.open_pairs(padded([s[: bound.k].tobytes() for s in sets], bound.k), size, maps, pairs_asked(comp, probe))
    found = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        if find(a) == find(b):
            continue
        one, other = (sets[a], sets[b]) if len(sets[a]) <= len(sets[b]) else (sets[b], sets[a])
        at = np.minimum(np.searchsorted(other, one), len(other) - 1)
        shared = int((other[at] == one).sum())
        if 100 * shared >= bound.percent * (len(one) + len(other) - shared):
            parent[find(a)] = find(b)
            found.append((a, b))
    return found


def sets_of(buf: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node, values in ascending order one row after another, and their number, of each text."""
    n = len(offsets) - 1
    keys, rows, _, _ = text_shingles(buf, offsets, shingle)
    node = set_nodes(keys, rows, n)
    return node, keys[np.lexsort((keys, rows))], np.bincount(rows, minlength=n) if len(rows) else np.zeros(n, np.int64)


def _slot(values: np.ndarray) -> np.ndarray:
    # not the upper bits: retained values are the small ones
    return (values & U64((1 << _SLOT_BITS) - 1)).astype(np.int64)


def _confirmed(members: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int, bound: SketchBound) -> DataFrame:
    """Links (a, b) within each (key, home, guests) of members (…, node, comp, probe)."""

    def hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in _whole_groups(batches, _BY, 5000):
            edges = _group_edges(frame, _BY)
            length = np.diff(edges)
            group = np.repeat(np.arange(len(length)), length)
            node, comp, size, probe = (frame[c].to_numpy() for c in ("node", "comp", "size", "probe"))
            keep = np.zeros(len(frame), bool)

            sketches, maps = frame["sketch"].tolist(), frame["parity"].tolist()

            few = np.flatnonzero(length[group] <= _FEW)
            values, own = padded([sketches[r] for r in few.tolist()], bound.k), group[few]
            for shift in range(1, _FEW):
                left = np.flatnonzero(own[:-shift] == own[shift:]) if len(own) > shift else np.zeros(0, np.int64)
                if not len(left):
                    break
                i, j = few[left], few[left + shift]
                ok = (probe[i] | probe[j]) & (node[i] != node[j]) & (comp[i] != comp[j])
                left = left[ok]
                left = left[maps_allow(maps, size, few[left], few[left + shift], bound.percent)]
                left = left[bound.may_link(values, size[few], left, left + shift)]
                keep[few[left]] = keep[few[left + shift]] = True
            for g in np.flatnonzero(length > _FEW):
                a, b = edges[g], edges[g + 1]
                asked = pairs_asked(comp[a:b], probe[a:b]) & (node[a:b, None] != node[None, a:b])
                i, j = bound.open_pairs(padded(sketches[a:b], bound.k), size[a:b], maps[a:b], asked)
                keep[i + a] = keep[j + a] = True
            yield pa.RecordBatch.from_pandas(frame.loc[keep, [*_BY, "node", "comp", "probe"]], preserve_index=False)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = text_bytes(batch.column("text"))
            for i, j in slices(offsets):
                node, data, size = sets_of(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle)
                rows = batch.slice(i, j - i).drop_columns(["text"]).append_column("keys", binary_column(data.view(np.uint8), size * 8)).append_column("parity", binary_column(*parity_maps(data, size)))
                yield rows.filter(pa.array(node == rows.column("node").to_numpy()))  # an id may repeat with another text

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in _whole_groups(batches, _BY, 2000):
            for a, b in itertools.pairwise(_group_edges(frame, _BY)):
                group = frame.iloc[a:b].sort_values("probe", ascending=False, kind="stable").drop_duplicates("node")
                name = group["node"].tolist()
                pairs = links_of([np.frombuffer(s, U64) for s in group["keys"]], group["parity"].tolist(), group["comp"].to_numpy(), group["probe"].to_numpy(), bound)
                yield pa.RecordBatch.from_arrays([pa.array([name[x] for x, _ in pairs], pa.int64()), pa.array([name[y] for _, y in pairs], pa.int64())], names=["a", "b"])

    sketched = members.join(nodes.select("node", "size", "sketch", "parity", "first_doc").where("first_doc is not null"), "node").select(*_BY, "node", "comp", "probe", "size", "sketch", "parity")
    alike = sketched.repartition(*_BY).sortWithinPartitions(*_BY).mapInArrow(hopeful, _FIELDS)
    placed = written(alike.join(nodes.select("node", F.col("first_doc").alias("doc_id")), "node"))
    with_text = texts.join(small(placed, placed.count()), "doc_id").select(*_BY, "node", "comp", "probe", "text")
    return with_text.mapInArrow(make, f"{_FIELDS}, keys binary, parity binary").repartition(*_BY).sortWithinPartitions(*_BY).mapInArrow(confirm, "a long, b long")


def sketch_groups(docs: DataFrame, shingle: int = 5, percent: int = 85, k: int = 64, block: int = 256, leaders: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row: the smallest doc_id reachable by links of ``percent`` or
    more, and whether that is the row's own.

    Null and empty texts have no shingles and are their own component; texts whose only ids are null link with nothing
    but equal sets, and a null id counts as kept only where no other id is in its component; rows that repeat get the
    same answer.  No rows give no rows.  Only doc_id and text are read.
    """
    spark = docs.sparkSession
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    n_slots, bound = 1 << _SLOT_BITS, SketchBound(k, percent)
    names = ["doc_id", "node", "size", "sketch", "parity", "part", "counts"]

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, done = np.zeros(n_slots, np.uint32), {0}

        def new(node: np.ndarray) -> np.ndarray:
            if len(done) > 1_000_000:  # a sketch written twice does no harm
                done.clear()
                done.add(0)
            return np.array([x not in done and not done.add(x) for x in node.tolist()], bool)

        for batch in batches:
            buf, offsets = text_bytes(batch.column("text"))
            for i, j in slices(offsets):
                n = j - i
                node, keys, size = sets_of(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle)
                fresh = new(node)
                at = np.arange(len(keys)) - np.repeat(np.cumsum(size) - size, size)
                low = keys[(at < k) & np.repeat(fresh, size)]
                np.add.at(counts, _slot(low), 1)
                held = binary_column(low.view(np.uint8), np.where(fresh, np.minimum(size, k), 0) * 8)
                maps, length = parity_maps(keys[np.repeat(fresh, size)], size[fresh])
                widths = np.zeros(n, np.int64)
                widths[fresh] = length
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, n), pa.array(node), pa.array(size), held, binary_column(maps, widths), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        parts = np.minimum(counts, 65535).astype("<u2").reshape(-1, _BLOCK_SLOTS)
        for p in np.flatnonzero(parts.any(axis=1)):
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, pa.int64()) for _ in range(3)), *(pa.nulls(1, pa.binary()) for _ in range(2)), pa.array([p], pa.int32()), pa.array([parts[p].tobytes()], pa.binary())], names=names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                total[part] = total.get(part, 0) + np.frombuffer(counts, "<u2").astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["part", "counts"])

    seen = written(own.mapInArrow(sketches, "doc_id long, node long, size long, sketch binary, parity binary, part int, counts binary"))
    described = seen.where("part is null").select("doc_id", "node", "size")
    counts = np.zeros((n_slots // _BLOCK_SLOTS, _BLOCK_SLOTS), np.float32)
    # 2^21 counts of 4 bytes in all, whatever the input, fetched by one job: an iterator runs one after another for each partition
    for row in seen.where("part is not null").select("part", "counts").repartition("part").mapInArrow(add, "part int, counts binary").toArrow().to_pylist():
        counts[row["part"]] = np.frombuffer(row["counts"], np.float32)
    over = counts.ravel() - 2 * counts.mean()
    order = spark.sparkContext.broadcast(np.round(8 * np.log2(1 + np.maximum(over, 0))).astype(np.uint8))
    del counts, over

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("size").to_numpy()
            data = batch.column("sketch")
            values = np.frombuffer(b"".join(data.to_pylist()), U64)
            held = np.minimum(size, k)
            row = np.repeat(np.arange(len(size)), held)
            by = np.lexsort((values, order.value[_slot(values)], row))  # rare first, then by hash
            at = np.arange(len(values)) - np.repeat(np.cumsum(held) - held, held)
            take = bound.prefix_length(size)
            first = at < np.repeat(take, held)
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("size"), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(take)]), pa.int32()), pa.array(values[by][first].view(np.int64)))], names=["node", "size", "keys"])

    fresh = seen.where("part is null and octet_length(sketch) > 0").select("node", "size", "sketch", "parity")
    listed = written(fresh.select("node", "size", "sketch").mapInArrow(heads, "node long, size long, keys array<long>"))
    # dealt once for the sum and the join: the sum reads each column that the join needs, so both read one shuffle
    lists = listed.select("node", "size", F.explode("keys").alias("key")).repartition("key")
    several = lambda df, also="true": df.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.expr(f"bool_or({also})").alias("also")).where("lo <> hi and also").select("key")
    met = lists.join(several(lists, "size > 0"), "key")
    # sets link only if their sizes are within the bound, so each goes to the cell of its size class and the next
    step = float(np.log(100 / percent)) * 1.001 + 1e-9  # a little wide, so that rounding parts no pair
    cell = F.floor(F.log("size") / step)
    celled = written(met.select("node", F.explode(F.transform(F.array(cell, cell + 1), lambda c: F.xxhash64("key", c))).alias("key")).distinct())
    members = written(celled.join(several(celled), "key"))
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    docs_of = described.where("size > 0").groupBy("node").agg(F.min("doc_id").alias("first_doc"))
    # only nodes that meet others bring their sketches and maps
    meeting = written(members.select("node").distinct())
    nodes = written(docs_of.join(fresh.join(small(meeting, meeting.count()), "node", "left_semi").dropDuplicates(["node"]), "node"))

    own_list = members.join(sizes, "key").groupBy("node").agg(F.max(F.struct("size", "key"))["key"].alias("key"))
    first = own_list.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    dealt = written(own_list.join(first, "key").withColumn("homes", F.ceil(F.col("size") / block).cast("int")))
    residents = dealt.select("key", F.pmod(F.xxhash64("node", "key"), F.col("homes")).cast("int").alias("home"), "node")
    lead = dealt.where(F.pmod(F.xxhash64("node"), F.greatest(F.lit(1), F.col("size") / leaders).cast("long")) == 0).where("homes > 1")
    visiting = lead.select("key", F.explode(F.sequence(F.lit(0), F.col("homes") - 1)).alias("home"), "node")
    round_one = residents.unionByName(visiting).select("key", "home", F.lit(0).alias("guests"), "node", F.col("node").alias("comp"), F.lit(True).alias("probe"))
    confirmed = lambda rows: written(_confirmed(rows, nodes, own, shingle, bound))
    links = confirmed(round_one)
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    home = F.pmod(F.xxhash64("node", "key"), F.col("homes")).cast("int").alias("home")

    def unsettled(stars: DataFrame, settled: DataFrame | None) -> DataFrame:
        """key, size, homes, node, comp of the lists not yet gone through whose nodes aren't in one component; of lists
        with the same nodes, one."""
        left = members if settled is None else members.join(settled, "key", "left_anti")
        placed = written(left.join(stars, "node", "left").select("key", "node", F.coalesce("root", "node").alias("comp")))
        lists = placed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("who")).where("lo <> hi")
        one = lists.groupBy("size", "who").agg(F.min("key").alias("key")).select("key", "size", F.ceil(F.col("size") / block).cast("int").alias("homes"))
        return written(placed.join(one, "key").select("key", "size", "homes", "node", "comp"))

    def gone_through(lists: DataFrame) -> DataFrame:
        """Links of each list: who is outside its largest class visits all blocks.  A class is a component, or the nodes
        that met each other in one list before."""
        classes = F.explode(F.array_compact(F.array(F.struct(F.lit(0).alias("kind"), F.col("comp").alias("id")), F.when(F.col("met").isNotNull(), F.struct(F.lit(1).alias("kind"), F.col("met").alias("id"))))))
        by_class = lists.select("key", classes.alias("class")).groupBy("key", "class").agg(F.count(F.lit(1)).alias("n"))
        largest = by_class.groupBy("key").agg(F.max(F.struct("n", "class")).alias("most")).select("key", "most.class", "most.n")
        both = lists.join(largest, "key").withColumn("halls", F.ceil((F.col("size") - F.col("n")) / block).cast("int"))
        outside = F.when(F.col("class.kind") == 0, F.col("comp") != F.col("class.id")).otherwise(~F.col("met").eqNullSafe(F.col("class.id")))
        hosts = both.select("key", home, "halls", "node", "comp").where("halls > 0").select("key", "home", every(F.col("halls")).alias("guests"), "node", "comp", F.lit(False).alias("probe"))
        hall = F.pmod(F.xxhash64("key", "node"), F.col("halls")).cast("int").alias("guests")
        guests = both.where(outside).select("key", hall, "homes", "node", "comp").select("key", every(F.col("homes")).alias("home"), "guests", "node", "comp", F.lit(True).alias("probe"))
        return confirmed(hosts.unionByName(guests))

    # lists that are the largest open one for most of their nodes come first: they settle most of the others
    stars = components(links)
    at_work = unsettled(stars, None)
    choice = at_work.groupBy("node").agg(F.max(F.struct("size", "key"))["key"].alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("chosen"))
    ahead = written(at_work.join(at_work.select("key", "size").distinct().join(choice, "key").where("2 * chosen > size").select("key"), "key"))
    joined = lambda stars, more: components(stars.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    stars = joined(stars, gone_through(ahead.withColumn("met", F.lit(None).cast("long"))))
    met = ahead.groupBy("node").agg(F.max(F.struct("size", "key"))["key"].alias("met"))
    stars = joined(stars, gone_through(unsettled(stars, ahead.select("key").distinct()).join(met, "node", "left")))
    order.destroy()  # every table that needs the order is written by now
    for done in (listed, celled):
        discard(done)

    named = docs_of.join(stars, "node", "left").select("node", F.col("first_doc").alias("doc_id"), F.coalesce("root", "node").alias("root"))
    lookup = named.select("node", "root").join(named.groupBy("root").agg(F.min("doc_id").alias("least")), "root").select("node", "least")
    found = described.join(lookup, "node", "left").select("doc_id", F.col("size").alias("n_shingles"), F.coalesce(F.when(F.col("size") > 0, F.col("least")), F.col("doc_id")).alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
