"""Links between the nodes of banded sketches, exact within buckets, without expanding a bucket into its pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textkit as tk
from .shared import cleaned, components, drop, written


FIRST, MORE, SIEVE = 1, 32, 1 << 25
#: Of a bucket of at most so many nodes, all pairs are compared
FEW = 32
#: The same for buckets of nodes that a round has left: there are few of them, and each further round costs many small steps
FEW_LEFT = 128
#: How many pairs of nodes a task holds at once
PAIRS_A_BATCH = 1 << 20
#: How many keys one task sorts, and how many bytes of texts it compares at once (small enough for a CPU's cache)
KEYS_A_TASK, PAIR_BYTES = 1 << 19, 1 << 18
#: Slots that tell about how often a value occurs, and those of one row of them
SLOTS, SLOTS_A_ROW = 1 << 22, 1 << 14


def _pairs_of(batches: Iterator[pa.RecordBatch], sets: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]):
    """Batches of pairs with text_p and text_x in parts: the part, values and first of its different texts' sets, and each pair's two sets."""
    for batch in batches:
        for part in tk.chunks(batch, "text_p", PAIR_BYTES):
            texts = pa.concat_arrays([pc.fill_null(part.column(c), "") for c in ("text_p", "text_x")]).dictionary_encode()
            a, b = np.split(texts.indices.to_numpy(), 2)
            yield part, *sets(texts.dictionary), a, b


def _shared(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many values rows of x and y share; n: how many they have together."""
    value = np.concatenate((x, y), 1)
    value.sort(axis=1)  # the real values come first in each row; the same one twice is in both sets
    return ((value[:, 1:] == value[:, :-1]) & (np.arange(1, value.shape[1]) < n[:, None])).sum(1)


def comparing(sets: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], percent: int):
    """For mapInArrow: (p, x, open, text_p, text_x) to (p, x, open, both, np, nx, more, less): sizes of the sets and of their intersection, and, where the
    two may belong to one family and are open, what x has more and less than p."""
    least = 3 * percent - 200

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values, first, a, b in _pairs_of(batches, sets):
            na, nb = np.diff(first)[a], np.diff(first)[b]
            open_ = part.column("open").to_numpy(zero_copy_only=False)
            both, more, less = np.zeros(len(na), np.int64), [], []
            for rows, x, y in tk.padded_pairs(values, first, a, b):
                n = na[rows] + nb[rows]
                both[rows] = of_both = _shared(x, y, n)
                near = open_[rows] & (of_both > 0) & (100 * of_both >= least * (n - of_both))
                rows, x, y, n = rows[near], x[near], y[near], n[near]
                value = np.concatenate((x, y), 1)
                order = np.argsort(value, axis=1, kind="stable")
                value, of_x = np.take_along_axis(value, order, 1), order >= x.shape[1]
                own = np.arange(value.shape[1]) < n[:, None]
                same = (value[:, 1:] == value[:, :-1]) & own[:, 1:]
                own[:, 1:] &= ~same
                own[:, :-1] &= ~same
                for out, which in ((more, own & of_x), (less, own & ~of_x)):
                    out.append((rows, which.sum(1), value[which]))
            columns = [tk.gathered(parts, len(na)) for parts in (more, less)]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("p", "x", "open")], *[pa.array(v, pa.int32()) for v in (both, na, nb)], *columns], ["p", "x", "open", "both", "np", "nx", "more", "less"])

    return of


def matching(sets: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], percent: int):
    """For mapInArrow: (p, x, text_p, text_x) to the pairs (p, x) that are similar enough."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values, first, a, b in _pairs_of(batches, sets):
            n = np.diff(first)[a] + np.diff(first)[b]
            alike = np.zeros(len(n), bool)
            for rows, x, y in tk.padded_pairs(values, first, a, b):
                both = _shared(x, y, n[rows])
                alike[rows] = (both > 0) & (100 * both >= percent * (n[rows] - both))
            yield part.select(["p", "x"]).filter(pa.array(alike))

    return of


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (p, x, others) with text_p and text_x; texts has id and text.  Both joins read one shuffle of the texts."""
    one = pairs.join(texts.alias("a"), F.col("p") == F.col("a.id")).select(*pairs.columns, F.col("a.text").alias("text_p"))
    return one.join(texts.alias("b"), F.col("x") == F.col("b.id")).select(*pairs.columns, "text_p", F.col("b.text").alias("text_x"))


def compared(pairs: DataFrame, texts: DataFrame, sets, percent: int) -> DataFrame:
    """comparing() of pairs (p, x, open) of ids; texts has id and text."""
    kind = pairs.schema["p"].dataType.simpleString()
    return _with_texts(pairs, texts).mapInArrow(comparing(sets, percent), f"p {kind}, x {kind}, open boolean, both int, np int, nx int, more array<long>, less array<long>")


def _similar(both: Column, sizes: Column, percent: int) -> Column:
    return 100 * both >= percent * (sizes - both)


def sieve(keys: Column, rows: DataFrame) -> np.ndarray:
    """SIEVE bits of which those of the rows' keys are set.  Its size is fixed; it only spares work: the more keys there are, the more others pass."""
    slot = keys.bitwiseAND(SIEVE - 1)
    bit = F.expr("shiftleft(1L, cast(slot & 31 as int))")
    with cleaned(rows.sparkSession):
        words = rows.select(slot.alias("slot")).groupBy(F.shiftright("slot", 5).cast("int").alias("w")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(SIEVE >> 5, np.uint32)
    out[words["w"].to_numpy()] = words["bits"].to_numpy()
    return out


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = (keys & tk.U(SIEVE - 1)).astype(np.int64)
    return (bits[slot >> 5] >> (slot & 31).astype(np.uint32)) & 1 == 1


def _sifted(bits):
    """For mapInArrow: (id, bands) to a row (key, id) of each band that passes."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands = batch.column("bands")
            keys = bands.flatten().to_numpy().view(tk.U)
            row = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(bands), 0).to_numpy())
            some = passes(bits.value, keys)
            yield pa.RecordBatch.from_arrays([tk.signed(keys[some]), batch.column("id").take(pa.array(row[some]))], ["key", "id"])

    return of


def _bucketed(keys: np.ndarray, nodes: np.ndarray, most: int) -> np.ndarray:
    """Rows (key, node) in the order of the keys: equal ones once, and at most `most` of a key."""
    if not len(keys):
        return np.empty(0, np.int64)
    order = np.argsort(keys)
    k = keys[order]
    new = np.concatenate(([True], k[1:] != k[:-1]))
    shared = np.flatnonzero(~new | ~np.append(new[1:], True))
    some = order[shared]
    order[shared] = some[np.lexsort((nodes[some], keys[some]))]
    v = nodes[order]
    once = new.copy()
    once[1:] |= v[1:] != v[:-1]
    order, start = order[once], np.flatnonzero(new[once])
    return order[np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order)))) < most]


def _dealt(parts: int, few: int):
    """For mapInArrow: (id, bands) to (part, keys, ids): the keys by ranges, each with its nodes.  Of a key no more than few + 1 nodes are
    told at once: as many as say that it has more than few."""

    def sent(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids, bands = (pa.concat_arrays([b.column(c) for b in held]) for c in ("id", "bands"))
        ids = ids.dictionary_encode()
        keys = bands.flatten().to_numpy().view(tk.U)
        nodes = np.repeat(ids.indices.to_numpy(), pc.fill_null(pc.list_value_length(bands), 0).to_numpy())
        order = _bucketed(keys, nodes, few + 1)
        keys, nodes = keys[order], nodes[order]
        first = np.searchsorted((keys >> tk.U(32)) * tk.U(parts) >> tk.U(32), np.arange(parts + 1).astype(tk.U))
        full = np.flatnonzero(first[1:] > first[:-1])
        at = pa.array(np.append(first[full], len(keys)).astype(np.int32))
        columns = [pa.ListArray.from_arrays(at, v) for v in (tk.signed(keys), ids.dictionary.take(pa.array(nodes)))]
        return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *columns], ["part", "keys", "ids"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch.column("bands").flatten())
            if n >= KEYS_A_TASK:
                yield sent(held)
                held, n = [], 0
        if n:
            yield sent(held)

    return of


def _met(few: int):
    """For mapInArrow: all (part, keys, ids) of some parts to the pairs (a, b) of nodes that share a key of at most few nodes, and
    to the keys (key) of more."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        keys, ids = (pa.concat_arrays([b.column(c).flatten() for b in held]) for c in ("keys", "ids"))
        keys, ids = keys.to_numpy().view(tk.U), ids.dictionary_encode()
        nodes = ids.indices.to_numpy()
        order = _bucketed(keys, nodes, few + 1)
        keys, nodes = keys[order], nodes[order]
        start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        size = np.diff(np.append(start, len(keys)))
        large, none = keys[start[size > few]], lambda n: pa.nulls(n, ids.dictionary.type)
        yield pa.RecordBatch.from_arrays([tk.signed(large), none(len(large)), none(len(large))], ["key", "a", "b"])
        # pairs as one number each; those that several buckets have in common are told once, as far as they are held at once
        many, pairs, held_pairs = len(ids.dictionary), [], 0

        def told() -> pa.RecordBatch:
            a, b = (ids.dictionary.take(pa.array(x)) for x in np.divmod(np.unique(np.concatenate(pairs)), many))
            return pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), a, b], ["key", "a", "b"])

        for n in range(2, few + 1):
            at, (i, j) = start[size == n][:, None], np.triu_indices(n, 1)
            step = max(1, PAIRS_A_BATCH // len(i))
            for k in range(0, len(at), step):
                x, y = (nodes[at[k : k + step] + of].reshape(-1).astype(np.int64) for of in (i, j))
                pairs.append(x * many + y)
                held_pairs += len(x)
                if held_pairs >= PAIRS_A_BATCH:
                    yield told()
                    pairs, held_pairs = [], 0
        if pairs:
            yield told()

    return of


def _crowded(nodes: DataFrame, large: DataFrame, few: int) -> DataFrame:
    """(id, key, w) of the nodes in the buckets of large, those of more than few nodes; w is how many a node meets there."""
    kind = nodes.schema["id"].dataType.simpleString()
    bits = nodes.sparkSession.sparkContext.broadcast(sieve(F.col("key"), large))
    shared = written(nodes.mapInArrow(_sifted(bits), f"key long, id {kind}").distinct())
    bits.destroy()
    sizes = shared.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > few)  # the sieve lets others pass
    sized = written(shared.join(sizes, "key"))
    weights = sized.groupBy("id").agg(F.sum("c").alias("w"))
    left = written(sized.join(weights, "id").select("id", "key", "w"))
    drop(shared, sized)
    return left


def _slots(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    return (tk.mix(values ^ tk.mix(of)) & tk.U(SLOTS - 1)).astype(np.int64)


def _flat_lists(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A column of lists: their values, sizes and, of each value, the row's h."""
    size = pc.list_value_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64)
    return batch.column(column).flatten().to_numpy().view(tk.U), size, np.repeat(batch.column("h").to_numpy().view(tk.U), size)


def _slots_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, more) to rows of slots: which of them the values fall into, and how often."""
    for batch in batches:
        values, _, of = _flat_lists(batch, "more")
        slot, often = np.unique(_slots(values, of), return_counts=True)
        row, first = np.unique(slot // SLOTS_A_ROW, return_index=True)
        first = np.append(first, len(slot))
        columns = [tk.lists(v.astype(np.int32), first) for v in (slot % SLOTS_A_ROW, often)]
        yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), *columns], ["row", "at", "often"])


def _slots_summed(rows: pa.Table) -> pa.Table:
    at, often = (rows.column(c).combine_chunks().flatten().to_numpy() for c in ("at", "often"))
    sums = np.bincount(at, often, SLOTS_A_ROW).astype(np.int64)
    return pa.table({"row": rows.column("row")[:1], "sums": pa.array([np.minimum(sums, 0xFFFF).astype("<u2").tobytes()])})


def _counts(rows: DataFrame) -> np.ndarray:
    """About how often each value occurs within one h of rows (h, more): never less than it does (up to 65535), more where others fall into
    its slot.  Fixed in size; which pairs are found doesn't depend on it, only how many are looked at."""
    seen = rows.mapInArrow(_slots_seen, "row int, at array<int>, often array<int>")
    with cleaned(rows.sparkSession):
        sums = seen.groupBy("row").applyInArrow(_slots_summed, "row int, sums binary").toArrow()
    out = np.zeros((SLOTS // SLOTS_A_ROW, SLOTS_A_ROW), np.uint16)
    for row, each in zip(sums["row"].to_pylist(), sums["sums"].to_pylist(), strict=True):
        out[row] = np.frombuffer(each, "<u2")
    return out.reshape(-1)


def _usual(counts):
    """For mapInArrow: (p, h, f, more) to the values (p, t) that most of the f nodes of p have (or seem to, by their slots)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, size, h = _flat_lists(batch, "more")
            f = np.minimum(np.repeat(batch.column("f").to_numpy(), size), 0xFFFF)
            at = np.flatnonzero(2 * counts.value[_slots(values, h)].astype(np.int64) > f)
            _, one = np.unique(np.stack((h[at], values[at])), axis=1, return_index=True) if len(at) else (None, at)
            at = at[one]
            row = np.repeat(np.arange(batch.num_rows), size)[at]
            yield pa.RecordBatch.from_arrays([batch.column("p").take(pa.array(row)), tk.signed(values[at])], ["p", "t"])

    return of


def _rarest(counts, own: list[str]):
    """For mapInArrow: (h, share, more and its own columns) to the own columns and the rarest of `more`, t, with `left`, how many are still to
    come, itself included: so many that two nodes which share `share` values have one of these in common.  Values that no other node has are left out."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, size, h = _flat_lists(batch, "more")
            row = np.repeat(np.arange(batch.num_rows), size)
            often = counts.value[_slots(values, h)]
            order = np.lexsort((values, often, row))
            start = np.cumsum(size) - size
            left = size[row] - (np.arange(len(row)) - start[row])
            some = (left >= batch.column("share").to_numpy()[row]) & (often[order] > 1)
            at, left, row = order[some], left[some], row[some]
            first = np.searchsorted(row, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in own], tk.lists(values[at], first), tk.lists(left.astype(np.int32), first)], [*own, "t", "left"])

    return of


def _sets(sets: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], percent: int):
    """For mapInArrow: (id, text) to (id, h, share, more): the text's set, and how many of its values another one has to have at least."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.chunks(batch):
                values, first = sets(part.column("text"))
                n = np.diff(first)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.zeros(len(n), np.int64)), pa.array(-(-percent * n // 100)), tk.lists(values, first)], ["id", "h", "share", "more"])

    return of


def _by_rarest(left: DataFrame, texts: DataFrame, sets, percent: int) -> DataFrame:
    """(id, bands) of the nodes of left: each one's rarest values, so many that two similar nodes have one of them in common."""
    kind = left.schema["id"].dataType.simpleString()
    chosen = written(texts.join(left.select("id").distinct(), "id", "left_semi").mapInArrow(_sets(sets, percent), f"id {kind}, h long, share long, more array<long>"))
    counts = left.sparkSession.sparkContext.broadcast(_counts(chosen.select("h", "more")))
    out = written(chosen.mapInArrow(_rarest(counts, ["id"]), f"id {kind}, t array<long>, left array<int>").select("id", F.col("t").alias("bands")))
    counts.destroy()
    drop(chosen)
    return out


def _in_buckets(nodes: DataFrame, few: int) -> tuple[DataFrame, DataFrame | None]:
    """(p, x), the pairs of nodes (id, bands) in buckets of at most few; and _crowded() of the others, None if there are none."""
    kind = nodes.schema["id"].dataType.simpleString()
    with cleaned(nodes.sparkSession):
        parts = 1 + (nodes.agg(F.sum(F.size("bands"))).first()[0] or 0) // KEYS_A_TASK
    dealt = nodes.mapInArrow(_dealt(parts, few), f"part int, keys array<long>, ids array<{kind}>")
    met = written(dealt.repartitionById(parts, "part").mapInArrow(_met(few), f"key long, a {kind}, b {kind}"))
    pairs = written(met.where("key is null").select(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("x")).distinct())
    large = met.where("key is not null").select("key")
    left = _crowded(nodes, large, few) if large.take(1) else None
    drop(met)
    return pairs, left


def linked(nodes: DataFrame, texts_of: Callable[[DataFrame], DataFrame], sets, percent: int) -> DataFrame:
    """(id, component) of every node that has a link; nodes has id and bands, the keys of its buckets (rows may repeat),
    texts_of joins their text to (id, crowded), and sets makes the sets of texts.

    Of a bucket of at most FEW nodes all pairs are compared.  The others take rounds: in each, a bucket's nodes are compared with some of
    them, its pivots: those that meet most others in all
    such buckets; among copies of one original that is the original.  As Jaccard distance is a metric, with t = 1 - percent
    a node within 2t of the pivot can only be linked with nodes within 3t of it; those links are found from what each has more and less than the pivot (see
    _within), and the node is settled, as are pivots.  The others go to the next round; a bucket ends when they are connected.
    So every link within a bucket is found.

    The nodes that a round leaves are unlike their pivots, and mostly each other, so they are dealt out anew, into buckets by their rarest values (see
    _by_rarest): two nodes that are linked have one of these in common.  Buckets of at most FEW_LEFT are compared at once, those still large take the next round.
    The first two rounds have FIRST pivots, and a further one MORE times as many as the one before.
    Rounds deal with the texts and labels of nodes that are left only; all others are contracted twice, before and after the rounds.
    """
    kind = nodes.schema["id"].dataType.simpleString()
    nodes = nodes.select("id", "bands")
    pairs, left = _in_buckets(nodes, FEW)
    ids = pairs.select(F.explode(F.array("p", "x")).alias("id"), F.lit(False).alias("crowded"))
    ids = ids if left is None else ids.union(left.select("id", F.lit(True)))
    ids = written(ids.groupBy("id").agg(F.max("crowded").alias("crowded")))
    texts = written(texts_of(ids))
    matched = lambda pairs, texts: written(_with_texts(pairs, texts).mapInArrow(matching(sets, percent), f"p {kind}, x {kind}"))
    links = matched(pairs, texts)
    label, turn = components(links.toDF("a", "b")), 0
    drop(pairs, ids, links)
    if left is None:
        drop(texts)
        return label
    few = written(texts.where("crowded").select("id", "text"))
    drop(texts)
    found = [label]
    while left is not None:
        # the label of the nodes that are left; what is found beyond it is put together at the end
        near = written(found[-1].join(left.select("id").distinct(), "id", "left_semi"))
        near, rest = _round(left, near, FIRST * MORE ** max(0, turn - 1), few, sets, percent)
        drop(left)
        left, turn = None, turn + 1
        if rest.take(1):
            nodes = _by_rarest(rest, few, sets, percent)
            pairs, left = _in_buckets(nodes, FEW_LEFT)
            links = matched(pairs, few)
            near = _added(near, links.toDF("a", "b"))
            drop(nodes, pairs, links)
        found.append(near)
        drop(rest)
    label = components(reduce(DataFrame.union, found).toDF("a", "b"))
    drop(few, *found)
    return label


def _round(left: DataFrame, label: DataFrame, many: int, texts: DataFrame, sets, percent: int) -> tuple[DataFrame, DataFrame]:
    """label with the links that a round with `many` pivots finds, and what is left for the next one."""
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("w"), F.desc("id")))
    pivots = written(left.select("key", F.col("id").alias("p"), rank.alias("i")).where(F.col("i") <= many))
    rest = left.join(pivots.select("key", F.col("p").alias("id"), F.col("i").alias("own")), ["key", "id"], "left")
    # of two pivots the first is the second's
    led = written(rest.join(pivots, "key").where("own is null or own > i").select("key", "id", "w", "p", F.col("own").isNotNull().alias("done")))
    open_ = led.where("not done").groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("key", F.lit(True).alias("open"))
    # pairs of buckets in which nodes are left that aren't compared with each other
    pairs = led.join(open_, "key", "left").groupBy("p", F.col("id").alias("x")).agg(F.max(F.coalesce("open", F.lit(False))).alias("open"))
    tried = written(compared(pairs, texts, sets, percent))
    label = _added(label, tried.where(_similar(F.col("both"), F.col("np") + F.col("nx"), percent)).select(F.col("p").alias("a"), F.col("x").alias("b")))
    label = _within(tried.where("open"), label, percent)
    near = tried.select("p", F.col("x").alias("id"), _similar(F.col("both"), F.col("np") + F.col("nx"), 2 * percent - 100).alias("settled"))
    rest = led.where("not done").join(near, ["p", "id"]).groupBy("key", "id", "w").agg(F.max("settled").alias("settled")).where("not settled").drop("settled")
    named = rest.join(label, "id", "left").withColumn("c", F.coalesce("component", "id"))
    open_ = named.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    next_ = written(rest.join(open_, "key"))
    drop(led, tried, pivots)
    return label, next_


def _added(label: DataFrame, links: DataFrame) -> DataFrame:
    """The components of label (id, component) and links (a, b) together: label's stars stand for the links it was made from."""
    new = components(links.union(label.toDF("a", "b")))
    drop(label)
    return new


def _within(tried: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """label with the links between nodes that were compared with one pivot and are in different components; one of the two is
    within 2t of the pivot.

    What most of a pivot's nodes have and it has not is counted as the pivot's, too.  Two nodes that share nothing beyond that can only be
    linked if each has enough of it.  Two others have to share so much of what they have more that it's enough to look at the rarest
    of it (a prefix in the order of how many of the family have it).  Sizes of intersections follow from what the nodes have more and less.
    First all of a family are compared with the node that has most of the pivot: that joins most of those that are linked with each other anyway.
    """
    # components and families are found on rows without arrays
    named = tried.where(F.size("more") + F.size("less") > 0).select("p", "x", _similar(F.col("both"), F.col("np") + F.col("nx"), 2 * percent - 100).alias("close"))
    c = label.select(F.col("id").alias("x"), F.col("component").alias("c"))
    # only families with a close node and several components have anything to find; the close node may be of the pivot's own
    named = named.join(named.where("close").select("p").distinct(), "p", "left_semi").join(c, "x", "left").withColumn("c", F.coalesce("c", "x"))
    several = written(named.groupBy("p").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("f")).where("lo <> hi").select("p", "f"))
    if not several.take(1):
        drop(several)
        return label
    named = written(named.join(several, "p"))
    kind = tried.schema["p"].dataType.simpleString()
    near = written(tried.join(named, ["p", "x"]).withColumn("h", F.xxhash64("p")))
    counts = tried.sparkSession.sparkContext.broadcast(_counts(near.select("h", "more")))
    usual = near.select("p", "h", "f", "more").mapInArrow(_usual(counts), f"p {kind}, t long").groupBy("p").agg(F.collect_set("t").alias("usual"))
    with_usual = near.join(usual, "p", "left").withColumn("usual", F.coalesce("usual", F.array().cast("array<bigint>")))
    far = F.array_except("more", "usual")
    family = written(
        with_usual.select("p", "x", "h", "c", "nx", far.alias("more"), F.array_union("less", F.array_except("usual", "more")).alias("less"), (F.col("both") + F.size("more") - F.size(far)).alias("m"), (F.col("np") + F.size("usual")).alias("q"), "close")
    )
    top = family.where("close").groupBy("p").agg(F.max_by("x", F.struct(2 * F.col("m") - F.col("nx"), "x")).alias("x"))
    top = written(family.join(top, ["p", "x"]).select("p", F.col("c").alias("cx"), "x", "nx", F.col("more").alias("more_x"), F.col("less").alias("less_x")))
    star = written(_verified(_renamed(family).join(top, "p").where("cx <> cy"), percent))
    label, before = _added(label, star), family
    c = label.select(F.col("id").alias("x"), F.col("component").alias("now"))
    now = before.select("p", "x", "c").join(c, "x", "left").select("p", "x", F.coalesce("now", "c").alias("c"))
    apart_still = now.groupBy("p").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("p")
    family = written(before.drop("c").join(now.join(apart_still, "p"), ["p", "x"]))
    x = family.where("close").select("p", "x", F.col("c").alias("cx"), F.col("nx"), F.col("m").alias("mx"), F.col("more").alias("more_x"), F.col("less").alias("less_x"))
    y = _renamed(family)
    apart = f"cx <> cy and 100 * least(nx, ny) >= {percent} * greatest(nx, ny)"
    # of its `more`, a node has to share percent of its size less what it has of the pivot, at least
    share = F.greatest(F.lit(1), F.ceil(F.expr(f"{percent} * nx / 100 - m")).cast("int"))
    own = ["p", "x", "c", "nx", "m", "close"]
    kinds = f"p {kind}, x {kind}, c {kind}, nx int, m int, close boolean, t array<long>, left array<int>"
    # left: how many are still to come, this one included; the first one that two nodes share leaves enough of them for both
    some = family.select(*own, "h", share.alias("share"), "more").mapInArrow(_rarest(counts, own), kinds)
    some = written(some.select(*own, F.explode(F.arrays_zip("t", "left")).alias("one")).select(*own, "one.t", "one.left"))
    counts.destroy()
    of_x = some.where("close").select("p", "t", "x", F.col("c").alias("cx"), "nx", F.col("m").alias("mx"), F.col("left").alias("lx"))
    of_y = some.select("p", "t", F.col("x").alias("y"), F.col("c").alias("cy"), F.col("nx").alias("ny"), F.col("m").alias("my"), F.col("left").alias("ly"))
    enough = f"{100 + percent} * (least(lx, ly) + least(mx, my)) >= {percent} * (nx + ny)"
    by_token = of_x.join(of_y, ["p", "t"]).where(f"{apart} and {enough}").select("p", "x", "y")
    full = lambda df, m, n: df.where(f"100 * {m} >= {percent} * {n}")
    by_size = full(x, "mx", "nx").select("p", "x", "cx", "nx", "mx").join(full(y, "my", "ny").select("p", "y", "cy", "ny", "my"), "p").where(f"{apart} and {100 + percent} * least(mx, my) >= {percent} * (nx + ny)").select("p", "x", "y")
    pairs = written(by_token.union(by_size).distinct())
    links = written(_verified(pairs.join(x, ["p", "x"]).join(y, ["p", "y"]), percent))
    label = _added(label, links)
    drop(several, named, near, top, star, before, family, some, pairs, links)
    return label


def _renamed(family: DataFrame) -> DataFrame:
    return family.select("p", F.col("x").alias("y"), F.col("c").alias("cy"), F.col("nx").alias("ny"), F.col("m").alias("my"), F.col("more").alias("more_y"), F.col("less").alias("less_y"), "q")


def _verified(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs of a family that are similar enough."""
    both = F.size(F.array_intersect("more_x", "more_y")) + F.col("q") - F.size(F.array_union("less_x", "less_y"))
    return pairs.where(_similar(both, F.col("nx") + F.col("ny"), percent)).select(F.col("x").alias("a"), F.col("y").alias("b"))
