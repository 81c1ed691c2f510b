"""Exact Jaccard self-join on word shingles, by pigeonhole over a partitioned universe.

Sets with 100 |x and y| >= 75 |x or y| differ in at most H = (|x| + |y|) // 7 shingles. For the sets of a
size band the universe of shingles is hashed into segments. Differences spread over segments, so of any
allocation of radii t(i) in {-1, 0, 1} with sum of (t(i) + 1) = H + 1, one segment i of x must equal the
partner's segment up to t(i) shingles. A band is joined with itself and the larger sets above it.

1. Every set emits a signature of each of its segments and, in the bands of small sets, of each segment
   less one shingle (the one-deletion neighbourhood). Signatures travel in packed batches to buckets.
2. A bucket reports which signatures are shared, and by how many. A segment that nobody shares costs
   nothing and still pays for its radius; when a set's free segments pay for H + 1, it has no partner
   and is done. This settles nearly every set, popular passages included.
3. The others pay the rest with their cheapest shared segments (cost: the number of sharers). Those are
   their probes, and whoever shares a probe is a candidate.
4. Candidates are verified on the full sets. Only components are wanted, so sets are first verified, in
   a few rounds, against the weightiest set they meet in another component; after that all pairs that
   are left between different components are verified, but for those whose shingles that no other
   component has are more than H together. Where sets meet so often that the meetings outnumber the
   pairs, whole blocks of sets are compared instead.

Signatures and nodes are 64-bit hashes; a false match of signatures only costs a verification. Equal
sets are one node from the start. A set whose segments cannot pay for H + 1 at all (shingles crowded in
few segments; practically never) is compared with all sets, in blocks.

Words are runs of characters other than blank and \\t to \\r, with A-Z in lower case. With fewer words than
the shingle length the whole sequence is the one shingle. A null or wordless text has no shingles and
links with nothing; its component is its own id. Rows are kept one for one; rows of one id are separate
documents. A null id takes no part and has a null component.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.bpe import spread
from tidegauge.llm.common import sliced
from tidegauge.llm.components import components, roots
from tidegauge.llm.language import mixed, powers
from tidegauge.session import cut

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_SEED = np.uint64(0x2545F4914F6CDD1D)
#: Ids that may be sent to every executor at once (8 bytes each); beyond it they are shuffled.
BROADCAST_IDS = 500_000


@dataclass(frozen=True)
class Settings:
    words: int = 5
    #: Sets of up to this size are indexed with their one-deletion neighbourhoods.
    small: int = 64
    growth: float = 1.8
    #: Segments per shingle of a band's largest set, by that size.
    segments: tuple[tuple[int, float], ...] = ((150, 1.0), (400, 0.6), (1 << 62, 0.45))
    #: Signatures that a bucket holds on average.
    bucket: int = 1_000_000
    #: Shingles of the sets that a task compares with another such block.
    block: int = 200_000


class Bands:
    """Sizes L..U of each band and its number of segments."""

    def __init__(self, settings: Settings):
        tops, top = [], 1
        while top < 1 << 40:
            tops.append(top)
            top = max(top + 1, int(top * settings.growth))
        self.tops = np.array(tops, np.int64)
        self.m = np.array(
            [max(1, int(np.ceil(u * next(f for limit, f in settings.segments if u <= limit)))) for u in tops], np.int64
        )
        self.small = self.tops <= settings.small

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.tops, sizes)


def shingles(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingles of all texts, flat and sorted within each, with the count of each text."""
    raw = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    ends_of = offsets[1:] - offsets[0]
    letter = ~_SPACE[data]
    edge = np.ones(len(data), bool)  # words start after white space and at the start of a text
    edge[1:] = ~letter[:-1]
    edge[(offsets[:-1] - offsets[0])[offsets[:-1] < offsets[1:]]] = True
    start = np.flatnonzero(edge & letter)
    sums = np.empty(0, np.uint64)
    if len(start):
        which = np.cumsum(edge & letter) - 1
        inner = np.flatnonzero(letter)
        at = inner - start[which[inner]]
        part = _BYTE[_LOWER[data[inner]]] * powers(int(at.max()) + 1)[at]
        sums = mixed(np.add.reduceat(part, np.searchsorted(inner, start)))
    count = np.diff(np.r_[0, np.searchsorted(start, ends_of)])
    chain = sums[: max(0, len(sums) - words + 1)].copy()
    for k in range(1, words):
        chain = mixed(chain * _SEED + sums[k : len(chain) + k])
    first = np.cumsum(count) - count
    out, sizes = [], np.zeros(len(raw), np.int64)
    for i, (f, c) in enumerate(zip(first.tolist(), count.tolist(), strict=True)):
        if c >= words:
            own = np.unique(chain[f : f + c - words + 1])
        elif c:
            key = np.uint64(c)
            with np.errstate(over="ignore"):
                for w in sums[f : f + c]:
                    key = mixed(np.array([key * _SEED + w], np.uint64))[0]
            own = np.array([key], np.uint64)
        else:
            continue
        out.append(own)
        sizes[i] = len(own)
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), sizes


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64))


def nodes(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit name for each set; 0 for the empty one."""
    out = np.zeros(len(sizes), np.uint64)
    full = sizes > 0
    if len(flat):
        starts = (np.cumsum(sizes) - sizes)[full]
        out[full] = mixed(np.add.reduceat(mixed(flat ^ _SEED), starts) + sizes[full].astype(np.uint64))
    return out.view(np.int64)


# -- signatures ------------------------------------------------------------------------------------

#: What a signature stands for: a segment of one shingle's radius, one of two, or one less a shingle.
ONE, DELETED, TWO = 0, 1, 2


@dataclass
class Signatures:
    """Entries (sig, owner, kind, segment) of the set and band pairs (node, band, spare) they belong to."""

    node: np.ndarray
    band: np.ndarray
    spare: np.ndarray
    sig: np.ndarray
    owner: np.ndarray
    kind: np.ndarray
    segment: np.ndarray


def signatures(flat: np.ndarray, sizes: np.ndarray, names: np.ndarray, bands: Bands) -> Signatures:
    own = bands.of(sizes)
    use = np.flatnonzero(sizes > 0)
    below = use[(own[use] > 0) & (bands.tops[np.maximum(own[use] - 1, 0)] >= -(-3 * sizes[use] // 4))]
    who = np.r_[use, below]
    band = np.r_[own[use], own[below] - 1]
    size = sizes[who]
    other = np.where(band == own[who], 4 * size // 3, bands.tops[band])
    radius = (size + other) // 7
    m = bands.m[band]
    base = np.cumsum(m) - m
    starts = np.cumsum(sizes) - sizes
    element = flat[spread(starts[who], size)]
    owner = np.repeat(np.arange(len(who)), size)
    segment = (mixed(element ^ np.uint64(0x5851F42D4C957F2D)) % m[owner].astype(np.uint64)).astype(np.int64)
    slot = base[owner] + segment
    total = int(m.sum())
    value = mixed(element + np.uint64(0x14057B7EF767814F))
    sums = np.zeros(total, np.uint64)
    np.add.at(sums, slot, value)
    count = np.bincount(slot, minlength=total)
    filled = np.flatnonzero(count)
    slot_owner = np.repeat(np.arange(len(who)), m)
    salt = mixed((band[slot_owner[filled]].astype(np.uint64) << np.uint64(40)) + (filled - base[slot_owner[filled]]).astype(np.uint64) + np.uint64(1))
    salts = np.zeros(total, np.uint64)
    salts[filled] = salt
    small = bands.small[band]
    exact = mixed(sums[filled] ^ salt)
    exact_owner = slot_owner[filled]
    two = small[exact_owner] & (count[filled] >= 2)
    units = np.bincount(exact_owner, 1 + two, minlength=len(who)).astype(np.int64)
    less = np.flatnonzero(small[owner] & (count[slot] >= 2))
    deleted = mixed((sums[slot[less]] - value[less]) ^ salts[slot[less]])
    seg_exact = np.where(small[exact_owner], filled - base[exact_owner], 0)
    return Signatures(
        names[who], band, units - radius - 1,
        np.r_[exact, deleted], np.r_[exact_owner, owner[less]],
        np.r_[np.where(two, TWO, ONE), np.full(len(less), DELETED)].astype(np.uint8),
        np.r_[seg_exact, segment[less]].astype(np.uint8),
    )


_LOW = np.uint64((1 << 40) - 1)
_PACKED = "bucket int, low binary, high binary, owner binary, kind binary, segment binary, node binary, band binary, spare binary"


def _emit(docs: DataFrame, settings: Settings, buckets: int) -> DataFrame:
    """Signatures in packed batches, one row per slice of documents and bucket."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(settings), np.empty(0, np.int64)
        for part in sliced(batches, "text"):
            flat, sizes = shingles(part.column("text"), settings.words)
            names = nodes(flat, sizes)
            # copies met by this task before need not be indexed again
            _, first = np.unique(names, return_index=True)
            fresh = np.zeros(len(names), bool)
            fresh[first] = True
            fresh &= ~np.isin(names, seen)
            seen = np.r_[seen, names[fresh]] if len(seen) < 200_000 else names[fresh]
            keep = np.repeat(fresh, sizes)
            s = signatures(flat[keep], sizes[fresh], names[fresh], bands)
            bucket = ((s.sig >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket.astype(np.uint16) if buckets < 65536 else bucket, kind="stable")
            bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = []
            crowded = np.unique(s.node[s.spare < 0])
            if len(crowded):  # one more bucket carries their names through
                rows.append((buckets, *[b""] * 5, crowded.tobytes(), b"", b""))
            for b in range(buckets):
                own = order[bounds[b] : bounds[b + 1]]
                if not len(own):
                    continue
                part_of = s.owner[own] >> 16  # so that the number of an owner in its row has two bytes
                for some in (own[part_of == x] for x in np.unique(part_of)):
                    there, owner = np.unique(s.owner[some], return_inverse=True)
                    low = s.sig[some] & _LOW
                    rows.append((
                        b, low.astype(np.uint32).tobytes(), (low >> np.uint64(32)).astype(np.uint8).tobytes(),
                        owner.astype(np.uint16).tobytes(), s.kind[some].tobytes(), s.segment[some].tobytes(),
                        s.node[there].tobytes(), s.band[there].astype(np.uint8).tobytes(), s.spare[there].astype(np.int32).tobytes(),
                    ))
            yield _rows(rows, _PACKED)

    return docs.select("text").mapInArrow(run, _PACKED)


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int32() if x.endswith(" int") else pa.binary() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _flat(table: pa.Table, column: str, kind: type) -> np.ndarray:
    """The bytes of all rows of a binary column, one after the other, as numbers; read where they are."""
    parts = []
    for chunk in table.column(column).chunks:
        if len(chunk):
            offsets = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
            raw = chunk.buffers()[2]
            if raw is not None and offsets[-1] > offsets[0]:
                parts.append(np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]])
    whole = parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint8)
    return np.ascontiguousarray(whole).view(kind)


def _owners(table: pa.Table, local: np.ndarray, size: int) -> np.ndarray:
    """Numbers of owners within the group in place of those within a row; ``size`` is bytes per number."""
    nodes_ = pc.binary_length(table.column("node")).to_numpy() // 8
    entries = pc.binary_length(table.column("owner")).to_numpy() // size
    return local.astype(np.int64) + np.repeat(np.cumsum(nodes_) - nodes_, entries)


_SHARED = "place int, owner binary, state binary, segment binary, cost binary, sig binary, node binary, band binary, spare binary"


def _share(packed: DataFrame, buckets: int, places: int) -> DataFrame:
    """Per bucket: the entries with a partner, sent on to the places of their nodes."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        if bucket == buckets:
            names = b"".join(table.column("node").to_pylist())
            return pa.Table.from_batches([_rows([(places, *[b""] * 5, names, b"", b"")], _SHARED)])
        low = _flat(table, "low", np.uint32).astype(np.int64)
        low |= _flat(table, "high", np.uint8).astype(np.int64) << 32
        order = np.argsort(low)
        low = low[order]
        start = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
        size = np.diff(np.r_[start, len(low)])
        many = np.repeat(size > 1, size)
        order, low = order[many], low[many]
        size = size[size > 1]
        owner = _owners(table, _flat(table, "owner", np.uint16), 2)[order]
        kind, segment = _flat(table, "kind", np.uint8)[order], _flat(table, "segment", np.uint8)[order]
        node, band, spare = _flat(table, "node", np.int64), _flat(table, "band", np.uint8), _flat(table, "spare", np.int32)
        start = np.cumsum(size) - size
        rows = []
        if len(size):
            name = node[owner]
            whole = kind != DELETED
            exact = np.add.reduceat(whole.astype(np.int64), start)
            differ = np.minimum.reduceat(name, start) != np.maximum.reduceat(name, start)
            most, least = np.iinfo(np.int64).max, np.iinfo(np.int64).min
            exact_differ = np.minimum.reduceat(np.where(whole, name, most), start) != np.maximum.reduceat(np.where(whole, name, least), start)
            met = np.repeat(differ & (exact > 0), size)
            # state: the kind, and 4 more where the segment itself is shared and not only a neighbour of it
            state = kind + 4 * (np.repeat(exact_differ & (exact > 1), size) & whole).astype(np.uint8)
            owner, state, segment, low = owner[met], state[met], segment[met], low[met]
            cost = np.repeat(size, size)[met].astype(np.int32)
            place = node[owner].view(np.uint64) % np.uint64(places)
            order = np.argsort(place.astype(np.int64), kind="stable")
            bounds = np.searchsorted(place[order].astype(np.int64), np.arange(places + 1))
            for p in range(places):
                own = order[bounds[p] : bounds[p + 1]]
                if len(own):
                    there, local = np.unique(owner[own], return_inverse=True)
                    rows.append((
                        p, local.astype(np.int32).tobytes(), state[own].tobytes(), segment[own].tobytes(), cost[own].tobytes(),
                        (low[own] | (bucket << 40)).tobytes(), node[there].tobytes(), band[there].tobytes(), spare[there].tobytes(),
                    ))
        return pa.Table.from_batches([_rows(rows, _SHARED)])

    return packed.groupBy("bucket").applyInArrow(run, _SHARED)


def _allocate(shared: DataFrame, places: int) -> DataFrame:
    """Entries of the sets that may have a partner; ``probe`` marks those that they pay with, ``weight``
    is how often a set's signatures are shared: in a group of near copies the original has the most.

    A null ``sig`` marks a set whose segments cannot pay for H + 1 even if all were free.
    """

    def run(table: pa.Table) -> pa.Table:
        if table.column("place")[0].as_py() == places:
            names = np.unique(np.frombuffer(b"".join(table.column("node").to_pylist()), np.int64))
            nothing, no = pa.nulls(len(names), pa.int64()), pa.array(np.zeros(len(names), bool))
            return pa.table({"sig": nothing, "node": names, "whole": no, "probe": no, "weight": np.zeros(len(names), np.int64)})
        owner = _owners(table, _flat(table, "owner", np.int32), 4)
        node, band, spare = _flat(table, "node", np.int64), _flat(table, "band", np.uint8), _flat(table, "spare", np.int32)
        state, segment = _flat(table, "state", np.uint8), _flat(table, "segment", np.uint8)
        cost, sig = _flat(table, "cost", np.int32), _flat(table, "sig", np.int64)
        name, level, spare = node[owner], band[owner].astype(np.int64), spare[owner]
        order = np.lexsort((state, sig, segment, level, name))  # copies of a set report the same entries
        name, level, spare, state, segment, cost, sig = (x[order] for x in (name, level, spare, state, segment, cost, sig))
        same = (name[1:] == name[:-1]) & (level[1:] == level[:-1])
        once = np.r_[True, ~(same & (sig[1:] == sig[:-1]) & (state[1:] == state[:-1]))]
        name, level, spare, state, segment, cost, sig = (x[once] for x in (name, level, spare, state, segment, cost, sig))
        # a segment is an entry by itself in the bands of large sets, where no neighbours are indexed
        same = (name[1:] == name[:-1]) & (level[1:] == level[:-1])
        alone = (state == ONE + 4) & (segment == 0)
        new_set = np.r_[True, ~same]
        new_seg = np.r_[True, ~(same & (segment[1:] == segment[:-1]) & ~(alone[1:] | alone[:-1]))] | new_set
        seg_start = np.flatnonzero(new_seg)
        seg_of = np.cumsum(new_seg) - 1
        exact = np.maximum.reduceat((state >= 4).astype(np.int64), seg_start)
        double = np.maximum.reduceat(((state & 3) != ONE).astype(np.int64), seg_start)
        lost = np.where(exact > 0, 1 + double, double)
        price = np.add.reduceat(cost.astype(np.int64), seg_start)
        set_of = (np.cumsum(new_set) - 1)[seg_start]
        spare_of = spare[np.flatnonzero(new_set)]
        total = np.bincount(set_of, lost, minlength=len(spare_of))
        need = total - spare_of
        order = np.lexsort((price, set_of))
        paid = np.cumsum(lost[order])
        first = np.flatnonzero(np.r_[True, set_of[order][1:] != set_of[order][:-1]])
        before = paid - lost[order] - np.repeat((paid - lost[order])[first], np.diff(np.r_[first, len(order)]))
        probe = np.zeros(len(seg_start), bool)
        probe[order] = (before < need[set_of[order]]) & (lost[order] > 0)
        alive = (need > 0)[set_of][seg_of]
        new_name = np.r_[True, name[1:] != name[:-1]]
        weight = np.add.reduceat(cost.astype(np.int64), np.flatnonzero(new_name))[np.cumsum(new_name) - 1]
        return pa.table(
            {
                "sig": sig[alive],
                "node": name[alive],
                "whole": (state[alive] & 3) != DELETED,
                "probe": probe[seg_of][alive],
                "weight": weight[alive],
            }
        )

    return shared.groupBy("place").applyInArrow(run, "sig long, node long, whole boolean, probe boolean, weight long")


# -- candidates and verification -------------------------------------------------------------------


def _sets(docs: DataFrame, named: DataFrame, wanted: DataFrame, settings: Settings) -> DataFrame:
    """``node``, ``n`` and the shingles of the wanted nodes, from one text of each."""
    ids = named.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("id").alias("id"))
    ids = cut(ids, "wanted")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    rows = docs.join(ids, "id").select("node", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "text"):
            flat, sizes = shingles(part.column("text"), settings.words)
            # of several texts with one id only the named one counts
            right = nodes(flat, sizes) == part.column("node").to_numpy()
            offsets = np.r_[0, np.cumsum(sizes)].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))
            batch = pa.RecordBatch.from_arrays([part.column("node"), pa.array(sizes), lists], ["node", "n", "items"])
            yield batch.filter(pa.array(right))

    return cut(rows.mapInArrow(run, "node long, n long, items array<long>"), "sets")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    one = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("items").alias("ia"))
    two = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("items").alias("ib"))
    met = pairs.join(one, "a").join(two, "b")
    met = met.where((F.col("na") * 75 <= F.col("nb") * 100) & (F.col("nb") * 75 <= F.col("na") * 100))
    common = F.size(F.array_intersect("ia", "ib"))
    return met.select("a", "b", common.alias("c"), (F.col("na") + F.col("nb")).alias("s")).where("100 * c >= 75 * (s - c)").select("a", "b")


def _asked(open_: DataFrame) -> DataFrame:
    """One pair per set that still asks: itself and a weighty set of another component.

    ``open_`` has ``root``. Per signature the weightiest holder is the one to meet, or, for sets of
    its own component, the weightiest holder of another; of all those, a set meets the most frequent.
    """
    best = F.max(F.when(F.col("whole"), F.struct("weight", "node", "root")))
    first = open_.groupBy("sig").agg(best.alias("one")).where("one is not null")
    met = open_.join(first.select("sig", F.col("one.node").alias("one"), F.col("one.root").alias("one_root")), "sig")
    other = F.max(F.when(F.col("whole") & (F.col("root") != F.col("one_root")), F.struct("weight", "node")))
    second = open_.join(first.select("sig", F.col("one.root").alias("one_root")), "sig").groupBy("sig").agg(other["node"].alias("two"))
    asks = met.where("probe").join(second, "sig")
    partner = F.when(F.col("root") != F.col("one_root"), F.col("one")).otherwise(F.col("two"))
    often = asks.withColumn("partner", partner).where("partner is not null").groupBy("node", "partner").agg(F.count(F.lit(1)).alias("n"))
    pick = often.groupBy("node").agg(F.max_by("partner", F.struct("n", "partner")).alias("partner"))
    return pick.select(F.least("node", "partner").alias("a"), F.greatest("node", "partner").alias("b")).distinct()


def _still_open(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """Entries of signatures whose holders are in different components and of which one asks."""
    tied = entries.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    held = tied.groupBy("sig").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.max("probe").alias("asked"))
    return cut(tied.join(held.where("x < y and asked").select("sig"), "sig", "left_semi"), "open")


_ITEMS = "bucket int, item binary, owner binary, node binary, root binary"


def _own_items(sets: DataFrame, settings: Settings) -> DataFrame:
    """``node``, ``n`` and ``own``: how many of its shingles no set with another ``root`` has."""
    total = sets.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, round(total / settings.bucket))

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                items = part.column("items").flatten().to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(part.num_rows), part.column("n").to_numpy())
                names, roots = part.column("node").to_numpy(), part.column("root").to_numpy()
                bucket = ((items.view(np.uint64) >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
                rows = []
                for b in range(buckets):
                    own = order[bounds[b] : bounds[b + 1]]
                    if len(own):
                        there, local = np.unique(owner[own], return_inverse=True)
                        rows.append((b, items[own].tobytes(), local.astype(np.uint16).tobytes(), names[there].tobytes(), roots[there].tobytes()))
                yield _rows(rows, _ITEMS)

    def shared(table: pa.Table) -> pa.Table:
        owner = _owners(table, _flat(table, "owner", np.uint16), 2)
        item, node, root = _flat(table, "item", np.int64), _flat(table, "node", np.int64)[owner], _flat(table, "root", np.int64)[owner]
        order = np.argsort(item)
        item, node, root = item[order], node[order], root[order]
        start = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
        size = np.diff(np.r_[start, len(item)])
        many = np.repeat(np.minimum.reduceat(root, start) != np.maximum.reduceat(root, start), size)
        pairs = np.unique(np.stack([node[many], item[many]], 1), axis=0) if many.any() else np.empty((0, 2), np.int64)
        there, count = np.unique(pairs[:, 0], return_counts=True)
        return pa.table({"node": there, "shared": count})

    dealt = sets.select("node", "root", "n", "items").mapInArrow(deal, _ITEMS)
    found = dealt.groupBy("bucket").applyInArrow(shared, "node long, shared long").groupBy("node").agg(F.sum("shared").alias("shared"))
    sizes = sets.groupBy("node").agg(F.max("n").alias("n"))
    return sizes.join(found, "node", "left").select("node", "n", (F.col("n") - F.coalesce("shared", F.lit(0))).alias("own"))


def _links(entries: DataFrame, sets: DataFrame, settings: Settings, rounds: int = 2) -> DataFrame:
    """Edges that connect every component of linked nodes.

    At most ``rounds`` times every asking set meets one weighty set, as long as that links any. Then
    all pairs that are left are verified: those in different components, with a probe in common, whose
    own shingles (which no set of another component has, so they all count as differences) do not
    exceed H already.
    """
    spark = entries.sparkSession
    links = spark.createDataFrame([], "a long, b long")
    open_ = entries.withColumn("root", F.col("node"))
    for _ in range(rounds):
        new = cut(_verified(_asked(open_), sets), "links")
        if not new.take(1):
            break
        links = links.union(new)
        roots = components(links, "a", "b").withColumnRenamed("id", "node")
        open_ = _still_open(open_, roots)
    left = sets.join(open_.select("node", "root").distinct(), "node")
    sized = cut(_own_items(left, settings), "own-items")
    sized = sized.where(3 * F.col("own") <= F.col("n"))  # beyond that no partner of any size is in reach
    rows = cut(open_.select("sig", "node", "whole", "probe", "root").join(sized, "node"), "left")
    held = rows.groupBy("sig").agg(F.min("node").alias("low"), F.count(F.lit(1)).alias("held"), F.sum(F.col("probe").cast("long")).alias("asked"))
    tied = rows.join(held.where("asked > 0 and held > 1"), "sig")
    unit_of = components(tied.select("node", "low").distinct(), "node", "low").withColumnRenamed("root", "unit")
    unit_of = unit_of.union(unit_of.select(F.col("unit").alias("id"), "unit").distinct()).withColumnRenamed("id", "node")
    by_node = rows.groupBy("node").agg(F.first("root").alias("root"), F.first("n").alias("n")).join(unit_of, "node")
    by_sig = held.join(unit_of.withColumnRenamed("node", "low"), "low").groupBy("unit").agg(F.sum(F.col("asked") * F.col("held")).alias("met"))
    units = by_node.groupBy("unit").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("total")).join(by_sig, "unit")
    dense = cut(units.where(F.col("met") > F.col("sets") * F.col("sets") / 2), "dense")
    links = links.union(_within(sets, by_node.join(dense.select("unit", "total"), "unit"), settings))
    # elsewhere sets meet seldom: pair by pair
    rows = rows.join(by_node.join(dense.select("unit"), "unit").select("node"), "node", "left_anti")
    ask, have = rows.where("probe").alias("p"), rows.alias("h")
    apart = 7 * (F.col("p.own") + F.col("h.own")) <= F.col("p.n") + F.col("h.n")
    close = (F.col("p.n") * 75 <= F.col("h.n") * 100) & (F.col("h.n") * 75 <= F.col("p.n") * 100)
    meet = (F.col("p.sig") == F.col("h.sig")) & (F.col("p.root") != F.col("h.root")) & (F.col("p.whole") | F.col("h.whole"))
    rest = ask.join(have, meet & apart & close)
    pairs = rest.select(F.least("p.node", "h.node").alias("a"), F.greatest("p.node", "h.node").alias("b")).distinct()
    return links.union(_verified(pairs, sets))


def _within(sets: DataFrame, members: DataFrame, settings: Settings) -> DataFrame:
    """Edges inside the dense units, where sets meet so often that a unit is compared as a whole.

    A unit is cut into blocks of about ``block`` shingles; a task gets two blocks (or one) and compares
    their sets as bit sets over the shingles that occur twice. Edges span the components found.
    """
    parts = F.greatest(F.lit(1), F.ceil(F.col("total") / settings.block)).cast("int")
    rows = sets.drop("n").join(members.withColumn("parts", parts), "node")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rows = rows.select("unit", "part", "node", "root", "items", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("with"))
    rows = rows.select("unit", F.least("part", "with").alias("one"), F.greatest("part", "with").alias("two"), "node", "root", "items")

    def compare(table: pa.Table) -> pa.Table:
        node, first = np.unique(table.column("node").to_numpy(), return_index=True)
        table = table.take(pa.array(first))
        root, lists = table.column("root").to_numpy(), table.column("items").combine_chunks()
        size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        items = lists.flatten().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(node)), size)
        name, place, times = np.unique(items, return_inverse=True, return_counts=True)
        twice = times > 1
        column = np.cumsum(twice) - 1
        words = -(-int(twice.sum()) // 64) or 1
        bits = np.zeros((len(node), words), np.uint64)
        on = twice[place]
        at = column[place[on]]
        np.bitwise_or.at(bits, (owner[on], at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
        one, two = [], []
        for i in range(len(node) - 1):
            common = np.bitwise_count(bits[i] & bits[i + 1 :]).sum(1).astype(np.int64)
            hit = (100 * common >= 75 * (size[i] + size[i + 1 :] - common)) & (root[i + 1 :] != root[i])
            found = np.flatnonzero(hit) + i + 1
            one += [i] * len(found)
            two += found.tolist()
        label = roots(np.array(one, np.int64), np.array(two, np.int64), node)
        moved = np.flatnonzero(label != node)
        return pa.table({"a": node[moved], "b": label[moved]})

    return rows.groupBy("unit", "one", "two").applyInArrow(compare, "a long, b long")


def _against_all(docs: DataFrame, sets: DataFrame, crowded: DataFrame, settings: Settings, block: int = 200) -> DataFrame:
    """Edges between the crowded sets and any set, by comparing them in blocks with all texts."""
    spark = docs.sparkSession
    names = cut(crowded.withColumn("block", F.row_number().over(Window.orderBy("node")) / block), "crowded")
    out = spark.createDataFrame([], "a long, b long")
    for start in range(0, names.count(), block):
        some = names.where(F.floor((F.col("block") * block - 1) / block) == start // block)
        held = {r["node"]: np.sort(np.array(r["items"], np.int64).view(np.uint64)) for r in sets.join(some, "node").collect()}
        shared = spark.sparkContext.broadcast(held)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for part in sliced(batches, "text"):
                flat, sizes = shingles(part.column("text"), settings.words)
                name, owner = nodes(flat, sizes), np.repeat(np.arange(len(sizes)), sizes)
                found = []
                for one, items in shared.value.items():
                    at = np.minimum(np.searchsorted(items, flat), len(items) - 1)
                    common = np.bincount(owner, items[at] == flat, minlength=len(sizes))
                    hit = (100 * common >= 75 * (len(items) + sizes - common)) & (sizes > 0) & (name != one)
                    found += [(one, x) for x in np.unique(name[hit]).tolist()]
                columns = [pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, ["a", "b"])

        out = out.union(docs.select("text").mapInArrow(run, "a long, b long"))
    return out


def join(df: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings | None = None) -> DataFrame:
    """``key``, ``n_shingles`` and ``component_id`` for every row of ``df``."""
    rows = _placed(df, key, text, settings or Settings())
    return rows.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def _named(rows: DataFrame, settings: Settings) -> DataFrame:
    """All columns but ``text``, which is the last, and ``n`` and ``node``, the size and name of its set."""
    kept = rows.columns[:-1]

    def name(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "text"):
            flat, sizes = shingles(part.column("text"), settings.words)
            columns = [*part.columns[:-1], pa.array(sizes), pa.array(nodes(flat, sizes))]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "n", "node"])

    return rows.mapInArrow(name, rows.drop("text").schema.add("n", "long").add("node", "long"))


def _placed(df: DataFrame, key: str, text: str, settings: Settings) -> DataFrame:
    """``id``, ``n``, ``node``, the name ``root`` of its component and ``component``, its smallest id, of every row."""
    docs = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))

    named = cut(_named(docs, settings), "named")
    there = docs.where(F.col("id").isNotNull())
    own = named.where(F.col("id").isNotNull() & (F.col("n") > 0))
    total = own.agg(F.sum("n")).first()[0]
    if not total:
        return named.withColumns({"root": F.col("node"), "component": F.col("id")})
    buckets = max(1, round(total * 0.65 / settings.bucket))
    places = buckets
    entries = cut(_allocate(_share(_emit(there, settings, buckets), buckets, places), places), "entries")
    sets = _sets(there, own, entries.select("node").distinct(), settings)
    links = _links(entries.where(F.col("sig").isNotNull()), sets, settings)
    crowded = entries.where(F.col("sig").isNull()).select("node").distinct()
    links = links.union(_against_all(there, sets, crowded, settings))
    roots = components(cut(links, "links"), "a", "b").withColumnRenamed("id", "node")
    placed = own.select("id", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = placed.groupBy("root").agg(F.min("id").alias("component"))
    # one row per node again, so that copies meet a narrow table
    by_node = placed.select("node", "root").distinct().join(smallest, "root")
    by_node = by_node.select("node", "root", "component", F.lit(True).alias("has"))
    has = (F.col("n") > 0) & F.col("id").isNotNull()
    rows = named.withColumn("has", has).join(by_node, ["node", "has"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return rows.select("id", "n", "node", "root", component.alias("component"))


def first_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings | None = None) -> DataFrame:
    """One row of each component, with all its columns: of the smallest id, and of its rows the one whose
    set has the smallest name.

    Rows without shingles or without an id stay, as does each row of an id whose text is in a component
    of its own. Of rows with one id and the same set one stays.
    """
    settings = settings or Settings()
    placed = cut(_placed(df, key, text, settings), "placed")
    own = placed.where(F.col("id").isNotNull() & (F.col("n") > 0))
    twice = own.groupBy("id").count().where("count > 1")
    if not twice.take(1):  # then the id says which row it is
        moved = own.where(F.col("id") != F.col("component")).select(F.col("id").alias("__moved"))
        return df.join(moved, F.col(f"`{key}`").cast("long") == F.col("__moved"), "left_anti")
    # the root tells components apart, as one id may be the smallest of several
    first = own.groupBy("root").agg(F.min(F.struct("id", "node")).alias("x")).select("x.id", "x.node", F.lit(True).alias("first"))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    rows = _named(rows, settings).join(first, ["id", "node"], "left")
    free = F.col("id").isNull() | (F.col("n") == 0)
    once = rows.where(~free & F.col("first")).dropDuplicates(["id", "node"])
    return rows.where(free).unionByName(once).select(*[F.col(f"__row.`{c}`") for c in df.columns])
