"""Exact Jaccard join of n-gram sets by prefix tries, and the groups it links.

1. Every document becomes its set of hashed n-grams.  Equal sets are one node from here on.
2. A global order of n-grams, rare ones first, comes from two count tables of fixed size (2^21 slots each) over all
   documents: what the frequencies of its words let expect of an n-gram, or more if its own slot is far above average.
3. Two sets that link share an n-gram among the first ``n - ceil(t n) + 1`` of each in that order.  Each node lists
   those; lists meet by a shuffle on the n-gram and the class of the set's size; those with one node are gone at once.
4. Round one: every node joins the largest of its n-grams' groups.  A group's sets go into a trie whose paths follow
   the global order, frequent end first, so that near copies share long paths; a traversal carries the overlap
   so far and leaves a subtree when the elements left on either side can't reach the bound, or when all of it is
   linked already.  Groups larger than ``block`` are dealt over blocks, each of which also gets the group's leaders.
   Before sets move at all, members of a group compare small parity maps of their sets: two maps never differ in
   more bits than the sets do in elements, so what differs too much is out, exactly, and only the rest sends its set.
5. Round two, for all other groups whose nodes aren't all in one component yet: members outside the group's largest
   component visit every block of the group.  Pairs inside one component need no test, so no link is lost and
   thousands of near copies cost about one test each.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readlake.llm.components import components
from readlake.llm.shared import give_back, written
from readlake.llm.textkit import LOWER, U64, binary_column, mix, shingle_hashes, slices, span_hashes, text_bytes, word_spans

_SLOT_BITS, _BLOCK_SLOTS = 21, 1 << 16
#: A side of a join of up to so many rows of some 50 bytes is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has ``most`` rows at most."""
    return F.broadcast(df) if rows <= most else df


def text_shingles(buf: np.ndarray, offsets: np.ndarray, k: int, commonness: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ``k``-word shingles of each row, their rows (in order), their words' ``commonness`` summed, and
    all word hashes.  A text of fewer words is one shingle."""
    low = LOWER[buf]
    starts, ends, rows = word_spans(low, offsets)
    words = span_hashes(low, starts, ends)
    keys, first = shingle_hashes(words, rows, k)
    owner = rows[first]
    each = commonness[_slot(words)] if commonness is not None else np.zeros(len(words), np.int32)
    sums = np.concatenate([[0], np.cumsum(each)])
    common = sums[first + k] - sums[first]
    n_words = np.bincount(rows, minlength=len(offsets) - 1)
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    if len(short):
        begin = (np.cumsum(n_words) - n_words)[short]
        extra = np.zeros(len(short), U64)
        for j in range(k - 1):
            has = n_words[short] > j
            extra[has] = mix(extra[has] + words[begin[has] + j])
        keys, owner = np.concatenate([keys, extra]), np.concatenate([owner, short])
        common = np.concatenate([common, sums[begin + n_words[short]] - sums[begin]])
        order = np.argsort(owner, kind="stable")
        keys, owner, common = keys[order], owner[order], common[order]
    if not len(keys):
        return keys, owner, common, words
    codes, unique = pd.factorize(mix(owner.astype(U64) + U64(1)) ^ keys)
    first_at = np.empty(len(unique), np.int64)
    first_at[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    first_at.sort()
    return keys[first_at], owner[first_at], common[first_at], words


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U64(64 - _SLOT_BITS)).astype(np.int64)


def set_nodes(keys: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """A 64-bit name of each row's set: the sum of its mixed keys, mixed again; 0 for an empty set."""
    total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(keys ^ U64(0xA5A5A5A5A5A5A5A5)))])
    size = np.bincount(rows, minlength=n_rows) if len(rows) else np.zeros(n_rows, np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    sums = total[at[1:]] - total[at[:-1]]
    return np.where(size > 0, mix(sums + size.astype(U64)), U64(0)).view(np.int64)


class ShingleOrder:
    """Sorts shingles by 8 bits of expected frequency, then 56 bits of hash.  Two tables of 2^21 slots, of any corpus."""

    def __init__(self, words: np.ndarray, shingles: np.ndarray, k: int):
        self.k, self.total = k, float(words.sum())
        self.commonness = np.round(8 * np.log2(np.maximum(words, 1))).astype(np.uint8)
        over = np.maximum(shingles - 3 * shingles.mean(), 0)
        self.excess = np.round(8 * np.log2(1 + over)).astype(np.uint8)

    def keys(self, shingles: np.ndarray, common: np.ndarray) -> np.ndarray:
        # in eighths of a bit: the words' frequencies, or what the shingle's slot has above the average
        seen = self.excess[_slot(shingles)].astype(np.float64)
        rank = np.maximum(common, np.where(seen > 0, seen + 8 * (self.k - 1) * np.log2(max(self.total, 2)), 0))
        rank = np.clip(rank / 4, 0, 255).astype(U64)
        return rank << U64(56) | shingles >> U64(8)


class TrieJoin:
    """Links between sets of one group, none repeated within a component.

    ``sets`` are sorted by the global order; paths run from its frequent end.  A node is
    [own keys, children by first key, set ids that end here, all set ids below, least and largest size below].
    """

    def __init__(self, sets: list[np.ndarray], groups: list[int], percent: int):
        self.percent, self.paths = percent, [s[::-1] for s in sets]
        roots: dict[int, int] = {}
        self.parent = list(range(len(sets)))
        for k, g in enumerate(groups):
            self.parent[k] = roots.setdefault(g, k)
        self.root = [np.zeros(0, U64), {}, [], [], 1 << 60, 0]
        for k in sorted(range(len(sets)), key=lambda k: len(sets[k])):
            self._insert(k)

    def find(self, k: int) -> int:
        while self.parent[k] != k:
            self.parent[k] = self.parent[self.parent[k]]
            k = self.parent[k]
        return k

    def _insert(self, k: int) -> None:
        path, node, at, size = self.paths[k], self.root, 0, len(self.paths[k])
        while True:
            node[3].append(k)
            node[4], node[5] = min(node[4], size), max(node[5], size)
            if at == size:
                node[2].append(k)
                return
            child = node[1].get(path[at])
            if child is None:
                node[1][path[at]] = [path[at:], {}, [k], [k], size, size]
                return
            own = child[0]
            n = min(len(own), size - at)
            same = own[:n] == path[at : at + n]
            share = n if same.all() else int(np.argmin(same))
            if share < len(own):  # split the child
                lower = [own[share:], *child[1:]]
                child[:] = [own[:share], {own[share]: lower}, [], list(lower[3]), lower[4], lower[5]]
            node, at = child, at + share

    def links(self, probe: int) -> list[int]:
        """Sets outside the probe's component that link with it; each is merged at once."""
        path, out = self.paths[probe], []
        ahead = path[::-1]  # ascending, for searches
        size = len(path)
        need = lambda m: -(-self.percent * (size + m) // (100 + self.percent))  # 100 I >= t (size + m - I)
        stack = [(self.root, 0, 0)]
        while stack:
            node, overlap, depth = stack.pop()
            least, most = node[4], node[5]
            if most * 100 < self.percent * size or least * 100 > 10_000 * size / self.percent:
                continue
            own = node[0]
            if len(own):
                where = np.searchsorted(ahead, own)
                overlap += int((ahead[np.minimum(where, size - 1)] == own).sum())
                depth += len(own)
                left = int(np.searchsorted(ahead, own[-1]))  # elements of the probe below the path's last
                if overlap + min(left, most - depth) < need(max(least, -(-self.percent * size // 100))):
                    continue
            mine = self.find(probe)
            if all(self.find(k) == mine for k in node[3]):
                continue
            for k in node[2]:
                if overlap >= need(len(self.paths[k])) and self.find(k) != self.find(probe):
                    self.parent[self.find(k)] = self.find(probe)
                    out.append(k)
            stack += [(child, overlap, depth) for child in node[1].values()]
        return out


def parity_bits(size: np.ndarray, percent: int = 90) -> np.ndarray:
    """Bits of a set's parity map: a power of two, 512 at least, from half the size up at 90 % and more in proportion
    to what linked sets may differ in.  Unrelated maps differ in about half their bits, twice what sets that link can."""
    wide = np.maximum(size, 1) * (9.5 * (100 - percent) / (100 + percent))
    return 1 << np.maximum(np.ceil(np.log2(wide)), 9).astype(np.int64)


def parity_maps(keys: np.ndarray, size: np.ndarray, percent: int = 90) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the parity maps of rows with ``size`` keys each, one after another, and how many a row has: bit b is
    set when an odd number of the row's shingles hash to b."""
    bits = parity_bits(size, percent)
    begin = np.cumsum(bits) - bits
    at = np.repeat(begin, size) + (keys & (np.repeat(bits, size) - 1).astype(U64)).astype(np.int64)
    odd = (np.bincount(at, minlength=int(bits.sum())) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little"), bits // 8


def folded(maps: list[bytes], length: int) -> np.ndarray:
    """Maps as rows of ``length`` bytes; longer ones are folded: a shorter map is the longer's halves, exclusive-or."""
    out = np.zeros((len(maps), length), np.uint8)
    for k, m in enumerate(maps):
        out[k] = np.bitwise_xor.reduce(np.frombuffer(m, np.uint8).reshape(-1, length), axis=0)
    return out.view(U64)


def can_link(size_a: np.ndarray, size_b: np.ndarray, apart: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes that differ in ``apart`` elements or more can reach the bound."""
    return apart * (100 + percent) <= (100 - percent) * (size_a + size_b)


def _whole_groups(batches: Iterator[pa.RecordBatch], by: list[str], least: int = 20_000) -> Iterator[pd.DataFrame]:
    """Rows that come sorted by ``by``, in frames of whole groups."""
    kept: list[pd.DataFrame] = []
    rows = 0
    for batch in batches:
        kept.append(batch.to_pandas())
        rows += batch.num_rows
        if rows >= least:
            frame = pd.concat(kept, ignore_index=True)
            last = (frame[by] != frame[by].iloc[-1]).any(axis=1).to_numpy().nonzero()[0]
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield frame.iloc[:cut]
            kept, rows = [frame.iloc[cut:]], len(frame) - cut
    if rows:
        yield pd.concat(kept, ignore_index=True)


def _group_edges(frame: pd.DataFrame, by: list[str]) -> np.ndarray:
    new = (frame[by] != frame[by].shift()).any(axis=1).to_numpy()
    return np.append(np.flatnonzero(new), len(frame))


def _join_groups(members: DataFrame, nodes: DataFrame, texts: DataFrame, sets_of, percent: int) -> DataFrame:
    """Links (a, b) within each (key, home, guests): members (…, node, comp, probe) with their sets, tried by trie.

    A node's set is made from its first document's text, where it is needed, and shuffled once.
    """
    by = ["key", "home", "guests"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = text_bytes(batch.column("text"))
            for i, j in slices(offsets):
                node, data, size = sets_of(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                rows = batch.slice(i, j - i).drop_columns(["text"]).append_column("keys", binary_column(data.view(np.uint8), size * 8))
                yield rows.filter(pa.array(node == rows.column("node").to_numpy()))  # an id may repeat with another text
        give_back()

    def promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in _whole_groups(batches, by, 5000):
            edges = _group_edges(frame, by)
            group = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
            node, comp, size, probe = (frame[c].to_numpy() for c in ("node", "comp", "size", "probe"))
            length = np.minimum.reduceat(frame["parity"].str.len().to_numpy(), edges[:-1])[group]  # a group's shortest
            keep = np.zeros(len(frame), bool)
            for n in np.unique(length):
                rows = np.flatnonzero(length == n)
                maps, own = folded(frame["parity"].iloc[rows].tolist(), int(n)), group[rows]
                left, shift = np.arange(len(rows)), 1
                while True:
                    left = left[left + shift < len(rows)]
                    left = left[own[left] == own[left + shift]]
                    if not len(left):
                        break
                    i, j = rows[left], rows[left + shift]
                    ok = (probe[i] | probe[j]) & (node[i] != node[j]) & (comp[i] != comp[j])
                    i, j, m = i[ok], j[ok], left[ok]
                    ok = can_link(size[i], size[j], np.bitwise_count(maps[m] ^ maps[m + shift]).sum(axis=1), percent)
                    keep[i[ok]] = keep[j[ok]] = True
                    shift += 1
            yield pa.RecordBatch.from_pandas(frame.loc[keep, [*by, "node", "comp", "probe"]], preserve_index=False)
        give_back()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = (frame.iloc[a:b] for frame in _whole_groups(batches, by, 2000) for a, b in itertools.pairwise(_group_edges(frame, by)))
        for group in groups:
            group = group.sort_values("probe", ascending=False, kind="stable").drop_duplicates("node")
            trie = TrieJoin([np.frombuffer(s, U64) for s in group["keys"]], group["comp"].tolist(), percent)
            nodes_ = group["node"].tolist()
            found = [(nodes_[p], nodes_[k]) for p in np.flatnonzero(group["probe"].to_numpy()) for k in trie.links(p)]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])
        give_back()

    fields = "key long, home int, guests int, node long, comp long, probe boolean"
    mapped = members.join(nodes.where("first_doc is not null").select("node", "size", "parity"), "node").select(*by, "node", "comp", "probe", "size", "parity")
    alike = mapped.repartition(*by).sortWithinPartitions(*by).mapInArrow(promising, fields)
    placed = written(alike.join(nodes.select("node", F.col("first_doc").alias("doc_id")), "node"))
    with_text = texts.join(small(placed, placed.count()), "doc_id").select(*by, "node", "comp", "probe", "text")
    return with_text.mapInArrow(make, f"{fields}, keys binary").repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "a long, b long")


def shingle_groups(docs: DataFrame, shingle: int = 3, percent: int = 90, block: int = 256, leaders: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id for every row: the smallest doc_id reachable by links of ``percent`` or more.

    ``copy`` is the text's 64-bit hash and ``stays`` marks the rows by which a group is kept: those with its smallest
    id (null ids last) and, of that id's texts, the smallest hash.  Null and empty texts have no shingles, are their
    own component and stay; texts whose only ids are null link with nothing but equal sets; rows that repeat get the
    same answer.  Only doc_id and text are read.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_copy(docs).alias("copy"))
    n_slots = 1 << _SLOT_BITS

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, wait, waiting = np.zeros((2, n_slots), np.uint32), ([], []), 0

        def settle() -> None:
            for k in (0, 1):
                if wait[k]:
                    counts[k] += np.bincount(np.concatenate(wait[k]), minlength=n_slots).astype(np.uint32)
                    wait[k].clear()

        for batch in batches:
            buf, offsets = text_bytes(batch.column("text"))
            for i, j in slices(offsets):
                n = j - i
                keys, rows, _, words = text_shingles(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle)
                wait[0].append(_slot(words).astype(np.int32))
                wait[1].append(_slot(keys).astype(np.int32))
                waiting += len(keys)
                if waiting > n_slots:
                    settle()
                    waiting = 0
                size = np.bincount(rows, minlength=n) if len(rows) else np.zeros(n, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, n), batch.column("copy").slice(i, n), pa.array(set_nodes(keys, rows, n)), pa.array(size), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=["doc_id", "copy", "node", "n_shingles", "part", "counts"])
        settle()
        parts = np.minimum(counts, 65535).astype("<u2").reshape(-1, _BLOCK_SLOTS)
        for k in np.flatnonzero(parts.any(axis=1)):
            empty = pa.nulls(1, pa.int64())
            yield pa.RecordBatch.from_arrays([empty, empty, empty, empty, pa.array([k], pa.int32()), pa.array([parts[k].tobytes()], pa.binary())], names=["doc_id", "copy", "node", "n_shingles", "part", "counts"])
        del counts, parts
        give_back()

    seen = written(own.mapInArrow(summarise, "doc_id long, copy long, node long, n_shingles long, part int, counts binary"))
    described = seen.where("part is null").select("doc_id", "copy", "node", "n_shingles")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                total[part] = total.get(part, 0) + np.frombuffer(counts, "<u2").astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["part", "counts"])

    # 2 x 2^21 counts of 4 bytes in all, whatever the input, fetched by one job: an iterator runs one after another for each partition
    counts = np.zeros((2 * n_slots // _BLOCK_SLOTS, _BLOCK_SLOTS), np.float32)
    for row in seen.where("part is not null").select("part", "counts").repartition("part").mapInArrow(add, "part int, counts binary").toArrow().to_pylist():
        counts[row["part"]] = np.frombuffer(row["counts"], np.float32)
    order = spark.sparkContext.broadcast(ShingleOrder(*counts.reshape(2, -1), shingle))
    del counts

    def sets_of(buf: np.ndarray, offsets: np.ndarray, skip=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Node, shingles in the global order one row after another, and their number, of each row."""
        n = len(offsets) - 1
        keys, rows, common, _ = text_shingles(buf, offsets, shingle, order.value.commonness)
        node = set_nodes(keys, rows, n)
        if skip is not None:
            use = ~skip(node)
            at = use[rows] if len(rows) else np.zeros(0, bool)
            keys, rows, common = keys[at], rows[at], common[at]
        ordered = order.value.keys(keys, common)
        ordered = ordered[np.lexsort((ordered, rows))]
        return node, ordered, np.bincount(rows, minlength=n) if len(rows) else np.zeros(n, np.int64)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = {0}

        def again(node: np.ndarray) -> np.ndarray:
            if len(done) > 1_000_000:
                done.clear()
                done.add(0)
            return np.array([x in done or bool(done.add(x)) for x in node.tolist()], bool)

        for batch in batches:
            buf, offsets = text_bytes(batch.column("text"))
            for i, j in slices(offsets):
                node, keys, size = sets_of(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], again)
                new = size > 0
                take = np.where(new, size - -(-percent * size // 100) + 1, 0)
                at = np.arange(len(keys)) - np.repeat(np.cumsum(size) - size, size)
                head = keys[at < np.repeat(take, size)].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(node[new]), pa.array(size[new]), binary_column(*parity_maps(keys, size[new], percent)), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(take[new])]), pa.int32()), pa.array(head))], names=["node", "size", "parity", "keys"])
        done.clear()
        give_back()

    firsts = written(own.select("doc_id", "text").mapInArrow(prefixes, "node long, size long, parity binary, keys array<long>"))
    heads = firsts.select("node", "size", F.explode("keys").alias("key"))
    several = lambda df: df.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("key")
    meeting = heads.join(several(heads), "key")
    # sets link only if their sizes are within the bound, so each goes to the cell of its size class and the next
    step = float(np.log(100 / percent)) * 1.001 + 1e-9  # a little wide, so that rounding parts no pair
    cell = F.floor(F.log("size") / step)
    celled = meeting.select("node", "key", F.explode(F.array(cell, cell + 1)).alias("cell"))
    celled = written(celled.select("node", F.xxhash64("key", "cell").alias("key")).distinct())
    members = written(celled.join(several(celled), "key"))
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    docs_of = described.where("n_shingles > 0").groupBy("node").agg(F.min(_by_id()).alias("best"), F.min("doc_id").alias("first_doc"))
    # a node's rows in ``firsts`` are equal, one for each task that met it
    nodes = written(docs_of.join(firsts.select("node", "size", "parity").dropDuplicates(["node"]), "node"))

    own_group = members.join(sizes, "key").groupBy("node").agg(F.max(F.struct("size", "key"))["key"].alias("key"))
    first = own_group.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    dealt = written(own_group.join(first, "key").withColumn("homes", F.ceil(F.col("size") / block).cast("int")))
    residents = dealt.select("key", F.pmod(F.xxhash64("node", "key"), F.col("homes")).cast("int").alias("home"), "node")
    lead = dealt.where(F.pmod(F.xxhash64("node"), F.greatest(F.lit(1), F.col("size") / leaders).cast("long")) == 0).where("homes > 1")
    visiting = lead.select("key", F.explode(F.sequence(F.lit(0), F.col("homes") - 1)).alias("home"), "node")
    round_one = residents.unionByName(visiting).select("key", "home", F.lit(0).alias("guests"), "node", F.col("node").alias("comp"), F.lit(True).alias("probe"))
    links = written(_join_groups(round_one, nodes, own, sets_of, percent))
    stars = components(links)

    placed = written(members.join(stars, "node", "left").select("key", "node", F.coalesce("root", "node").alias("comp")))
    open_keys = placed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("who")).where("lo <> hi")
    open_keys = open_keys.groupBy("size", "who").agg(F.min("key").alias("key"))  # keys with the same members are one group
    at_work = written(placed.join(open_keys.select("key"), "key"))
    by_comp = at_work.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    largest = by_comp.groupBy("key").agg(F.max(F.struct("n", "comp"))["comp"].alias("main"), F.sum("n").alias("all"), F.max("n").alias("n"))
    largest = largest.select("key", "main", F.ceil(F.col("all") / block).cast("int").alias("homes"), F.ceil((F.col("all") - F.col("n")) / block).cast("int").alias("halls"))
    second = at_work.join(largest, "key")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    hosts = second.select("key", F.pmod(F.xxhash64("node", "key"), F.col("homes")).cast("int").alias("home"), "halls", "node", "comp").select("key", "home", every(F.col("halls")).alias("guests"), "node", "comp", F.lit(False).alias("probe"))
    guests = second.where("comp <> main").select("key", F.pmod(F.xxhash64("key", "node"), F.col("halls")).cast("int").alias("guests"), "homes", "node", "comp").select("key", every(F.col("homes")).alias("home"), "guests", "node", "comp", F.lit(True).alias("probe"))
    more = _join_groups(hosts.unionByName(guests), nodes, own, sets_of, percent)
    stars = components(stars.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    order.destroy()  # every table that needs the order is written by now

    named = nodes.join(stars, "node", "left").select("node", "best", F.coalesce("root", "node").alias("root"))
    names = named.groupBy("root").agg(F.min("best").alias("best"))
    lookup = named.select("node", "root").join(names, "root").select("node", "best")
    has = F.col("n_shingles") > 0
    return described.join(lookup, "node", "left").select(
        "doc_id", "n_shingles", F.coalesce(F.when(has, F.col("best.doc_id")), F.col("doc_id")).alias("component_id"), "copy", (~has | (_by_id() == F.col("best"))).alias("stays")
    )


def text_copy(docs: DataFrame) -> Column:
    """The hash by which rows with one id are told apart by their texts."""
    return F.xxhash64(docs["text"].cast("string"))


def _by_id() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "copy")


def one_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """One row of ``docs`` for each of ``shingle_groups(docs)``, with its columns.

    The row's own id and text decide, so rows that share an id without being near copies all stay, and a null id is
    like any other.  Of rows that repeat with id and text, one stays; rows without words all do.
    """
    # columns by their table: ``docs`` may have any names
    same = lambda other: [docs["doc_id"].cast("long").eqNullSafe(other["its_id"]), text_copy(docs).eqNullSafe(other["its_copy"])]
    named = lambda df: df.select(F.col("doc_id").alias("its_id"), F.col("copy").alias("its_copy"))
    out = named(groups.where("not stays")).distinct()
    kept = docs.join(small(out, out.count()), same(out), "left_anti")
    twice = named(groups.where("stays and n_shingles > 0").groupBy("doc_id", "copy").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    if twice.isEmpty():
        return kept
    alone = kept.join(twice, same(twice), "left_anti")
    return alone.unionByName(kept.join(twice, same(twice), "left_semi").dropDuplicates(["doc_id", "text"]))


def brute_force_groups(texts: dict[int, str | None], shingle: int, percent: int, words: Callable[[str], list[str]]) -> dict[int, tuple[int, int]]:
    """Size and component of each document by all pairs: for tests on small tables."""
    sets = {}
    for d, t in texts.items():
        w = words(t or "")
        sets[d] = {tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} or ({tuple(w)} if w else set())
    name = {d: d for d in texts}

    def root(d: int) -> int:
        while name[d] != d:
            d = name[d]
        return d

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                lo, hi = sorted((root(a), root(b)))
                name[hi] = lo
    return {d: (len(sets[d]), root(d)) for d in ids}
