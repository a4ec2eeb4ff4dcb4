"""Similarity join of documents on their sets of word shingles, by parity sketches.

Each shingle hash is XORed into one of m segments.  Two sets whose symmetric
difference is at most D leave, of any D + 1 segments, at least one
untouched, so its XOR is equal in both (pigeonhole); D follows from the size
band and the wanted Jaccard similarity.  A set names the D + 1 segments that hold
most of its shingles, and all that hold as many as the last of these.  Of two linked sets take the
one whose last count is larger: one of the segments it names is untouched, and as the other set has as many shingles
there, it names it too.  So few shingles seldom propose a link, and none is lost, for sets of every size.  A set that has to
name empty segments joins each of these with its keys by another division, as two linked sets agree there too.
A parity sketch (each shingle flips one bit), of more bits for larger sets, then bounds
the symmetric difference from below by its Hamming distance, and what is left is
verified on the sets themselves.

A segment may be equal by chance or because
of a passage that many documents share.  A bucket with many classes that don't link is
therefore split by a second, independent division into segments, of
which a linked pair again leaves one untouched, and so on: no link is lost,
and what meets by chance is parted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peaklight.llm._base import Stage, blocks, documents, id_filter, join_counted, maybe, n_parts
from peaklight.llm._words import U, mix, shingle_sets
from peaklight.llm.components import connected_components

#: Least bits of a parity sketch, and least bits for each member that two linked sets may differ in; sizes are powers of two.
SKETCH_BITS, SPREAD = 512, 4
#: Segments for each of the D + 1 that a set names at least; levels of division that empty segments are followed into.
SLACK, DEEP = 1.25, 12
#: Ratio of the upper to the lower end of a size band.
BAND_RATIO = 1.3
#: Rounds in which each bucket links its classes to one centre only, before pairs of classes left are compared.
ROUNDS = 3
#: A bucket of more nodes than LIGHT times the segments of its band is split by a further division, at most so many times while
#: that halves what its rows meet.  In a smaller one a node meets at most LIGHT times as many others as it has keys, so comparing all follows the input.
LIGHT, SPLITS = 8, 8
#: Keys that a task gathers before it sends them off (64 for each range at least), and bytes of text it works on at once.
GATHER, BLOCK = 1 << 18, 1 << 19
#: The size band of a key stands in its highest bits.
LOW = U((1 << 56) - 1)


def max_difference(total, num: int, den: int):
    """The largest symmetric difference of two sets with ``total`` members together and Jaccard >= num/den."""
    return total * (den - num) // (den + num)


def band_starts(most: int) -> np.ndarray:
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, int(np.ceil(out[-1] * BAND_RATIO))))
    return np.array(out)


BANDS = band_starts(1 << 40)


def signatures(tokens: np.ndarray, sizes: np.ndarray, num: int, den: int, level: int = 0, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The pigeonhole keys of many sets and the number of the set of each key.

    tokens: the sets one after the other, each sorted; sizes: their numbers of
    tokens.  A set has keys for its own size band and for the next ones as far
    as a set of theirs can match; ``only`` names one band for each set instead.
    Levels other than 0 divide by other hashes.
    """
    keys, owners = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    own = np.arange(len(sizes))
    if level:
        tokens = mix(tokens ^ mix(U([level]))[0])
        tokens = tokens[np.lexsort((tokens, np.repeat(own, sizes)))]
    starts = np.cumsum(sizes) - sizes
    first = np.searchsorted(BANDS, sizes, "right") - 1
    for step in range(1 if only is not None else len(BANDS)):
        band = only if only is not None else np.minimum(first + step, len(BANDS) - 2)
        most = max_difference(2 * (BANDS[band + 1] - 1), num, den)
        fits = (BANDS[band] <= sizes * den // num) & (sizes > 0)
        if not fits.any():
            break
        at = np.flatnonzero(fits & (most > 0))
        if not len(at):
            continue
        most, n = most[at], sizes[at]
        m = np.ceil((most + 1) * SLACK).astype(np.int64)
        base = np.cumsum(m) - m
        # Sorted tokens fall in ascending segments, so each segment is one run.
        inside = np.repeat(starts[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        token = tokens[inside]
        segment = ((token >> U(32)) * np.repeat(m, n).astype(U) >> U(32)).astype(np.int64) + np.repeat(base, n)
        runs = np.flatnonzero(np.diff(segment, prepend=-1))
        parity, count = np.zeros(int(m.sum()), U), np.bincount(segment, minlength=int(m.sum()))
        parity[segment[runs]] = np.bitwise_xor.reduceat(token, runs)
        which = np.repeat(np.arange(len(at)), m)
        falling = count[np.lexsort((-count, which))]
        named = np.flatnonzero(count >= falling[base + most][which])
        set_of, parity, count = which[named], parity[named], count[named]
        owner = at[set_of]
        name = (named - base[set_of]).astype(U) + (band[owner].astype(U) << U(32))
        key = ((mix(parity + mix(name) + mix(count.astype(U))) + U(level)) & LOW) | (band[owner].astype(U) << U(56))
        # (Bands of more segments leave too few of them empty for that to matter.)
        bare = np.flatnonzero((count == 0) & (m[set_of] <= 64))
        if len(bare) and level < DEEP:
            # Both of two linked sets may have nothing in common but empty segments: there the keys of another division count too.
            few, place = np.unique(set_of[bare], return_inverse=True)
            picked = np.isin(np.repeat(np.arange(len(at)), n), few)
            more, of = signatures(token[picked], n[few], num, den, level + 1, band[at[few]])
            more = more[np.argsort(of, kind="stable")]
            each = np.bincount(of, minlength=len(few))
            times = each[place]
            spot = np.repeat((np.cumsum(each) - each)[place] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            refined = (mix(np.repeat(key[bare], times) + mix(more[spot])) & LOW) | (np.repeat(key[bare], times) & ~LOW)
            keys.append(refined)
            owners.append(np.repeat(owner[bare], times))
            kept = np.ones(len(key), bool)
            kept[bare] = False
            key, owner = key[kept], owner[kept]
        keys.append(key)
        owners.append(owner)
    return np.concatenate(keys), np.concatenate(owners)


def sketch(tokens: np.ndarray, num: int = 80, den: int = 100) -> np.ndarray:
    """The parity sketch as words of 64 bits; half as long a one is its first half XOR its second."""
    size = max(SKETCH_BITS, 1 << int(SPREAD * max_difference(2 * len(tokens), num, den)).bit_length())
    bits = np.bincount((tokens >> U(17)).astype(np.int64) & (size - 1), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def node_of(tokens: np.ndarray) -> int:
    """A number for the whole set."""
    parts = np.array([np.bitwise_xor.reduce(mix(tokens + U(1))), tokens.sum(dtype=U), len(tokens)], U)
    return int(mix(parts * np.array([3, 5, 7], U)).sum(dtype=U, keepdims=True).view(np.int64)[0])


def _meeting(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, node) in order of the key, and where the key has several nodes."""
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    key, node = key[new], node[new]
    same = key[1:] == key[:-1]
    several = np.zeros(len(key), bool)
    several[1:] |= same
    several[:-1] |= same
    return key, node, several


EMITTED = "part int, doc_id long, n_shingles long, node long, sketch array<long>, key long, keys binary, nodes binary"
TABLE = "doc_id long, n_shingles long, node long, sketch array<long>, key long"


def _emit(k: int, num: int, den: int, parts: int):
    """One row per document, and the keys of its set, packed for each range of keys.

    Keys that several sets of a task have are members of buckets for certain;
    these are given at once, and one of them goes on to meet those of other tasks.
    So a range gets one row per key and task at most, however many sets share it.
    """

    def none(n: int, kind: pa.DataType) -> pa.Array:
        return pa.nulls(n, kind)

    def rows(part, doc_id=None, n_shingles=None, node=None, sketches=None, key=None, keys=None, nodes=None) -> pa.RecordBatch:
        n = len(part)
        columns = [
            pa.array(part, pa.int32()),
            none(n, pa.int64()) if doc_id is None else doc_id,
            none(n, pa.int64()) if n_shingles is None else n_shingles,
            none(n, pa.int64()) if node is None else node,
            none(n, pa.list_(pa.int64())) if sketches is None else sketches,
            none(n, pa.int64()) if key is None else key,
            none(n, pa.binary()) if keys is None else keys,
            none(n, pa.binary()) if nodes is None else nodes,
        ]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in EMITTED.split(", ")])

    def part_of(key: np.ndarray) -> np.ndarray:
        return ((mix(key) >> U(32)) * U(parts) >> U(32)).astype(np.int32)

    def send(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        key, node, several = _meeting(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
        if several.any():
            yield rows(part_of(node[several].view(U)), node=pa.array(node[several]), key=pa.array(key[several].view(np.int64)))
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        key, node = key[first], node[first]
        part = part_of(key)
        order = np.lexsort((node, part))
        key, node, part = key[order], node[order], part[order]
        cut = np.flatnonzero(np.diff(part, prepend=-1))
        ends = [*cut[1:].tolist(), len(part)][: len(cut)]
        pieces = list(zip(cut.tolist(), ends, strict=True))
        yield rows(part[cut], keys=pa.array([key[a:b].tobytes() for a, b in pieces], pa.binary()), nodes=pa.array([node[a:b].tobytes() for a, b in pieces], pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for i, j, data, off in blocks(batch.column("text"), BLOCK):
                sets = shingle_sets(data, off, k)
                sizes = np.array([len(x) for x in sets], np.int64)
                nodes = np.array([node_of(x) if len(x) else 0 for x in sets], np.int64)
                docs = batch.column("doc_id").slice(i, j - i)
                spread = part_of(np.arange(len(sets), dtype=U) + U(1 + n + i))
                yield rows(spread, docs, pa.array(sizes), pa.array(nodes, mask=sizes == 0), pa.array([sketch(x, num, den) for x in sets], pa.list_(pa.int64())))
                key, owner = signatures(np.concatenate(sets), sizes, num, den)
                held.append((key, nodes[owner]))
                n += len(key)
                if n >= max(GATHER, 64 * parts):
                    yield from send(held)
                    held, n = [], 0
        if held:
            yield from send(held)

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents and of members as they are; of the keys of a range those that several sets have."""
    keys, nodes = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    names = [c.split()[0] for c in TABLE.split(", ")]
    for batch in batches:
        packed = batch.column("keys").is_valid()
        own = batch.filter(packed)
        keys += [np.frombuffer(x.as_buffer(), U) for x in own.column("keys")]
        nodes += [np.frombuffer(x.as_buffer(), np.int64) for x in own.column("nodes")]
        yield batch.select(names).filter(pc.invert(packed))
    key, node, several = _meeting(np.concatenate(keys), np.concatenate(nodes))
    key, node = key[several].view(np.int64), node[several]
    for at in range(0, len(key), 100_000):
        a, b = key[at : at + 100_000], node[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int64()), pa.array(b), pa.nulls(len(a), pa.list_(pa.int64())), pa.array(a)], names=names)


def _split(level: int, num: int, den: int):
    """The buckets of (key, node, label, tokens), each divided further by the keys of one more level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column("tokens")
            sizes = np.diff(tokens.offsets.to_numpy()).astype(np.int64)
            at, weight = 0, np.cumsum(sizes)
            while at < len(sizes):
                to = max(at + 1, int(np.searchsorted(weight, weight[at] + (1 << 18), "right")))
                flat = tokens.slice(at, to - at).flatten().to_numpy().view(U)
                old = batch.column("key").slice(at, to - at).to_numpy().view(U)
                key, owner = signatures(flat, sizes[at:to], num, den, level, (old >> U(56)).astype(np.int64))
                new = (mix(old[owner] + mix(key)) & LOW) | (old[owner] & ~LOW)
                columns = [pa.array(new.view(np.int64)), *(batch.column(c).slice(at, to - at).take(pa.array(owner)) for c in ("node", "label"))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "node", "label"])
                at = to

    return run


def _sets(k: int, known):
    """Token sets of the texts whose doc_id may be in the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = known.value
        for batch in batches:
            batch = batch.filter(pa.array(maybe(words, batch.column("doc_id").fill_null(-(2**63)).to_numpy())))
            for _, _, data, off in blocks(batch.column("text"), BLOCK):
                sets = [s for s in shingle_sets(data, off, k) if len(s)]
                yield pa.RecordBatch.from_pydict({"node": pa.array([node_of(s) for s in sets], pa.int64()), "tokens": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))})

    return run


def jaccard_classes(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per document: doc_id, n_shingles and component_id, the smallest doc_id that links reach.

    Two documents link when den * |A & B| >= num * |A | B| for their sets of word
    shingles.  Documents with equal sets form a class that joins as one; so exact
    copies cost nothing, however many there are.  Rows that share a doc_id count as one document whose links are those of any of
    its rows, and each keeps its own row.  A null, empty or blank text has no
    shingles and no links: its component_id is its own doc_id.  A null doc_id
    stands behind all others as a component_id.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "jaccard")
    parts = 2 * n_parts(docs)
    docs = documents(docs)
    # Keys move once, packed; those without a partner end there.
    met = docs.mapInArrow(_emit(k, num, den, parts), EMITTED).repartitionById(parts, F.col("part")).mapInArrow(_meet, TABLE)
    met = stage(met, "sets")
    table, members = met.where("key is null").drop("key"), met.where("key is not null").select("key", "node")

    each = stage(table.where("node is not null").groupBy("node").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("size"), F.first("sketch").alias("sketch")), "each")
    info = stage(each.join(members.select("node").distinct(), "node", "left_semi").select("node", F.col("size").alias("n"), "sketch", "doc_id"), "nodes")

    def sets_of(nodes: DataFrame) -> DataFrame:
        """node, tokens of some nodes.  Texts stay where they are: only these sets move, not those of all that share a key."""
        wanted = stage(info.select("node", "doc_id").join(nodes.distinct(), "node", "left_semi"), "wanted")
        known = spark.sparkContext.broadcast(id_filter(wanted.select("doc_id")))
        out = stage(docs.mapInArrow(_sets(k, known), "node long, tokens array<long>").join(wanted.select("node"), "node").dropDuplicates(["node"]), "tokens")
        known.destroy()
        stage.drop(wanted)
        return out

    def near(a: str, b: str) -> str:
        def fold(own: str, other: str) -> str:
            half = f"size({other}.sketch)"
            return f"if(size({own}.sketch) > {half}, zip_with(slice({own}.sketch, 1, {half}), slice({own}.sketch, 1 + {half}, {half}), (p, q) -> p ^ q), {own}.sketch)"

        distance = f"aggregate(zip_with({fold(a, b)}, {fold(b, a)}, (p, q) -> bit_count(p ^ q)), 0, (s, x) -> s + x)"
        # Sizes of linked sets are near each other, so one sketch is twice as long as the other at most.
        return f"{den} * least({a}.n, {b}.n) >= {num} * greatest({a}.n, {b}.n) AND {distance} <= (({a}.n + {b}.n) * {den - num}) div {den + num}"

    def verified(pairs: DataFrame) -> DataFrame:
        """The links among pairs that the sketches leave."""
        pairs = stage(pairs, "close")
        if pairs.isEmpty():
            return pairs
        sets = sets_of(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))))
        x = pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta")), "a").join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb")), "b")
        x = x.select("a", "b", F.size(F.array_intersect("ta", "tb")).cast("long").alias("both"), (F.size("ta") + F.size("tb")).cast("long").alias("total"))
        found = stage(x.where(f"{den} * both >= {num} * (total - both)").select("a", "b"), "found")
        stage.drop(pairs, sets)
        return found

    def labels(links: DataFrame) -> DataFrame:
        """node, label: the components so far; nodes without links have no row."""
        return stage(connected_components(links, stage).select("node", F.col("comp").alias("label")), "labels")

    def several(rows: DataFrame) -> DataFrame:
        """The rows of buckets that hold more than one class, with the bucket's number of rows."""
        left = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size")).where("lo < hi").select("key", "size")
        # A merge join whatever the size: AQE splits what a hot key gathers.
        return rows.join(left.hint("merge"), "key")

    def different(rows: DataFrame) -> DataFrame:
        """As several(), but of buckets of one band with the same members one: the others would only give the same pairs again.

        The members of a bucket are told by their number, sums of both halves of their hashes, and least and largest label.
        """
        hashed = F.xxhash64("node", F.lit(1))
        sums = [F.sum(F.shiftright(hashed, 32)).alias("x"), F.sum(hashed.bitwiseAND(F.lit((1 << 32) - 1))).alias("y")]
        each = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size"), *sums).where("lo < hi")
        one = each.groupBy(F.shiftrightunsigned("key", 56), "size", "x", "y", "lo", "hi").agg(F.min("key").alias("key")).select("key", "size")
        return rows.join(one.hint("merge"), "key")

    def open_buckets(label: DataFrame | None) -> DataFrame:
        """Members of the buckets that hold more than one class so far."""
        if label is None:
            return members.withColumn("label", F.col("node"))
        return several(members.join(label, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))).drop("size")

    label, tried, links = None, None, None
    for turn in range(ROUNDS):
        left = open_buckets(label)
        # First one centre for all buckets of a group of copies; then other pairs in each bucket, against its largest class.
        salt = f"{turn}, key" if turn else "0"
        one = left.groupBy("key", "label").agg(F.expr(f"min_by(node, xxhash64(node, {salt}))").alias("node"), F.count("*").alias("size"))
        centre = one.groupBy("key").agg(F.expr(f"max_by(node, struct(size, xxhash64(label, {salt})))").alias("centre"))
        pairs = stage(one.join(centre, "key").where("node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct(), "pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        close = pairs.alias("p").join(info.alias("x"), F.expr("p.a = x.node")).join(info.alias("y"), F.expr("p.b = y.node")).where(near("x", "y")).select("a", "b")
        found = verified(close)
        if label is not None and found.isEmpty():
            break
        links = found if links is None else links.unionByName(found)
        label = labels(links)

    # What is left: large buckets are divided until they are small; then every pair of different classes in a bucket,
    # cut down by the sketches inside the join.
    widths = F.array(*(F.lit(LIGHT * (max_difference(2 * (b - 1), num, den) + 1)) for b in BANDS[1:].tolist()))
    few = F.col("size") <= F.element_at(widths, (F.shiftrightunsigned("key", 56) + 1).cast("int"))
    left = stage(different(open_buckets(label).distinct()), "left")
    ready = left.where(few)
    for level in range(1, SPLITS + 1):
        heavy = left.where(~few)
        before = heavy.agg(F.sum("size")).first()[0]
        if not before:
            break
        sets = sets_of(heavy.select("node"))
        divided = stage(different(heavy.join(sets, "node").mapInArrow(_split(level, num, den), "key long, node long, label long")), "left")
        stage.drop(sets)
        # Each row of a bucket meets ``size`` others.  Near copies stay together in every division, and it only repeats them.
        if (divided.agg(F.sum("size")).first()[0] or 0) > before / 2:
            stage.drop(divided)
            break
        left = divided
        ready = ready.unionByName(left.where(few))
    ready = ready.unionByName(left.where(~few)).drop("size")
    ready = stage(ready.join(info.select("node", "n", "sketch"), "node"), "ready")
    pairs = ready.alias("x").join(ready.alias("y"), F.expr(f"x.key = y.key AND x.label < y.label AND {near('x', 'y')}"))
    pairs = pairs.select(F.expr("least(x.node, y.node)").alias("a"), F.expr("greatest(x.node, y.node)").alias("b")).distinct()
    found = verified(pairs.join(tried, ["a", "b"], "left_anti"))

    # Join the components that the last pass has linked; most have no links to others by now.
    ends = found.join(label.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left").join(label.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left")
    comp = connected_components(ends.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")), stage).select(F.col("node").alias("label"), "comp")
    single = found.select(F.col("a").alias("node")).union(found.select(F.col("b").alias("node"))).distinct()
    label = label.unionByName(single.join(label, "node", "left_anti").select("node", F.col("node").alias("label")))
    sizes = label.groupBy("label").agg(F.count("*").alias("n"))
    comp = stage(join_counted(label, sizes.join(comp, "label", "left").select("label", F.coalesce("comp", "label").alias("comp"), "n"), "label").select("node", "comp"), "comp")

    # Rows that share a doc_id hang together, and with them their classes.
    shared = stage(table.where("doc_id is not null and node is not null").groupBy("doc_id").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("doc_id", "lo", "n"), "shared")
    if not shared.isEmpty():
        more = join_counted(table.select("doc_id", "node"), shared, "doc_id").select(F.col("node").alias("a"), F.col("lo").alias("b"))
        both = comp.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(more)
        comp = connected_components(both.unionByName(more.select("a", F.col("a").alias("b"))), stage).select("node", "comp")
    nodes = stage(each.select("node", "n", "doc_id").join(comp, "node", "left").where("n > 1 or comp is not null").select("node", "n", "doc_id", F.coalesce("comp", "node").alias("comp")), "classes")
    least = nodes.groupBy("comp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    least = stage(join_counted(nodes.select("node", "comp", F.col("n").alias("rows")), least, "comp").select("node", "least", F.col("rows").alias("n")), "least")
    stage.keep_only(met, least)
    return join_counted(table.select("doc_id", "n_shingles", "node"), least, "node", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents without those that are near copies of one with a smaller doc_id in their component.

    Documents without shingles have no copies and stay; all columns stay as they are.
    """
    kept = jaccard_classes(docs, k, num, den).where("doc_id <=> component_id").select("doc_id").distinct()
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["doc_id"]), "left_semi")
