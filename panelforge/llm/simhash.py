"""SimHash near-duplicates: segment-popcount embedding, grid range join, exact verification.

A fingerprint's 64 bits are 32 segments of 2; the bits set in each segment are a point whose
Manhattan distance to another point is at most the fingerprints' Hamming distance. Within RADIUS 3
at least one half (16 segments) is at distance 0 or 1, so each half is a grid over popcount vectors:
a fingerprint stands in its own cell and asks in the cells one step up. What meets in a cell is
verified bit by bit. A half's popcounts carry 24 bits of entropy (16 with segments of 4), so a cell of
evenly spread fingerprints stays small up to billions of them. Cells emit a spanning forest of their links, not all pairs; a cell with many
fingerprints is cut into chunks whose pairs are dealt to different tasks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.components import components
from panelforge.llm.shared import id_and_text, partitions, release, sliced, small_batches, written

RADIUS = 3
SHINGLE = 3
SEED = 42
SEGMENT_BITS, HALF_SEGMENTS = 2, 16
#: A cell is a half and two bits a segment; above them stands the seed.
SEED_SHIFT = 40
#: Rows of a cell that one task compares at once; larger cells are cut into chunks of about so many.
CELL_ROWS = 4096


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """Majority of the shingles' XXH64 bits; ASCII letters lower-cased, words split at ASCII white space."""
    words = text.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    grams = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) >= size else [b" ".join(words)]
    h = np.array([digest(g, SEED) for g in grams], "<u8")
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 15):
        part = h[i : i + (1 << 15)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number; null texts have fingerprint zero."""

    def run(batches):
        release()
        for whole in batches:
            for b in sliced(whole):
                fp = np.array([fingerprint(t) for t in b.column(1).cast(pa.binary()).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, fp long")


def word_fingerprints(text: bytes, seeds: int) -> list[int]:
    """One fingerprint a seed over the text's distinct words: copies that differ in a few words stay within a few bits."""
    words = set(text.lower().split())
    if not words:
        return [0] * seeds
    h = np.array([xxhash.xxh64_intdigest(w, SEED) for w in words], np.uint64)
    out = []
    for k in range(seeds):
        x = h * np.uint64(2 * k * 0x9E3779B97F4A7C1 + 1)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        counts = np.zeros(64, np.int64)
        for i in range(0, len(x), 1 << 15):
            counts += np.unpackbits(x[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * counts > len(x), bitorder="little").view("<u8")[0]))
    return out


def places(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, asks, row) entries: each fingerprint in its own cell of both halves, and asking in every cell one step up."""
    x = fp.view(np.uint64)
    rows = np.arange(len(fp))
    cell, asks, who = [], [], []
    for half in range(2):
        counts = [np.bitwise_count((x >> np.uint64(SEGMENT_BITS * (half * HALF_SEGMENTS + s))) & np.uint64((1 << SEGMENT_BITS) - 1)).astype(np.int64) for s in range(HALF_SEGMENTS)]
        own = np.full(len(x), half, np.int64)
        for c in counts:
            own = own << 2 | c
        cell.append(own)
        asks.append(np.zeros(len(x), bool))
        who.append(rows)
        for s, c in enumerate(counts):
            up = c < SEGMENT_BITS
            cell.append(own[up] + (1 << (2 * (HALF_SEGMENTS - 1 - s))))
            asks.append(np.ones(int(up.sum()), bool))
            who.append(rows[up])
    return np.concatenate(cell), np.concatenate(asks), np.concatenate(who)


def cells(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, asks, fp) of the places of each fingerprint."""
    cell, asks, row = places(fp)
    return cell, asks, fp[row]


def forest(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least members after links a-b are added to what `label` (the least member of each, so far) connects."""
    a, b = label[a], label[b]
    apart = a != b
    if not apart.any():
        return label
    pairs = np.unique(np.stack([np.minimum(a, b)[apart], np.maximum(a, b)[apart]], axis=1), axis=0)
    a, b, root = pairs[:, 0], pairs[:, 1], np.arange(len(label))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root[label]
        root = new


def links(fp: np.ndarray, asks: np.ndarray, chunk: np.ndarray, crossing: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links in one cell: owners against owners and askers; in a crossing block only between chunks.

    256 owners at a time; of a dense cell's links only those that join what is apart yet are kept.
    """
    x = fp.view(np.uint64)
    owners = np.flatnonzero(~asks)
    if not len(owners) or len(x) < 2:
        return fp[:0], fp[:0]
    label = np.arange(len(fp))
    for i in range(0, len(owners), 256):
        o = owners[i : i + 256]
        near = np.bitwise_count(x[o][:, None] ^ x[None]) <= radius
        if crossing:
            near &= chunk[o][:, None] != chunk[None]
        near &= label[o][:, None] != label[None]
        a, b = np.nonzero(near)
        label = forest(label, o[a], b)
    linked = np.flatnonzero(fp[label] != fp)
    return fp[linked], fp[label[linked]]


def near_links(distinct: DataFrame, radius: int = RADIUS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(u, v) links that connect all distinct fingerprints within `radius` bits (3 at most), over cells of the popcount grid.

    With a column `seed`, fingerprints of one seed meet only each other and the links carry it: (seed, u, v).
    """
    if radius > 3:
        raise ValueError("the half-grids cover a radius of at most 3")
    n = partitions(distinct.sparkSession)

    def spread(batches):
        for b in batches:
            cell, asks, who = cells(b.column(0).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(asks), pa.array(who)], names=["cell", "asks", "fp"])

    def spread_seeds(batches):
        for b in batches:
            fp, seed = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for k in np.unique(seed):
                cell, asks, who = cells(fp[seed == k])
                yield pa.RecordBatch.from_arrays([pa.array(cell + (int(k) << SEED_SHIFT)), pa.array(asks), pa.array(who)], names=["cell", "asks", "fp"])

    placed = distinct.select("fp").mapInArrow(spread, "cell long, asks boolean, fp long") if "seed" not in distinct.columns else distinct.select("fp", "seed").mapInArrow(spread_seeds, "cell long, asks boolean, fp long")
    large = placed.groupBy("cell").count().filter(F.col("count") > cell_rows).select("cell", F.ceil(F.col("count") / cell_rows).cast("int").alias("chunks"))
    cut = placed.join(large, "cell", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    blocks = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("cell", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "asks", "fp", "chunk")

    def compare(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            key = np.stack([t.column(c).to_numpy() for c in ("cell", "i", "j")], axis=1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            if len(cuts):
                yield from done(t.slice(0, int(cuts[-1])), np.r_[0, cuts])
                t = t.slice(int(cuts[-1]))
            held = t.combine_chunks()
        if held is not None and held.num_rows:
            yield from done(held, np.array([0, held.num_rows]))

    def done(t, bounds):
        fp, asks, chunk = (t.column(c).to_numpy() for c in ("fp", "asks", "chunk"))
        i, j = t.column("i").to_numpy(), t.column("j").to_numpy()
        cell = t.column("cell").to_numpy()
        us, vs, seeds = [fp[:0]], [fp[:0]], [fp[:0]]
        for a, b in zip(bounds, bounds[1:]):
            if b - a > 1:
                u, v = links(fp[a:b], asks[a:b], chunk[a:b], bool(i[a] != j[a]), radius)
                us.append(u)
                vs.append(v)
                seeds.append(np.full(len(u), cell[a] >> SEED_SHIFT))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(seeds).astype(np.int32)), pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["seed", "u", "v"])

    found = blocks.repartition(n, "cell", "i", "j").sortWithinPartitions("cell", "i", "j").mapInArrow(compare, "seed int, u long, v long")
    return found if "seed" in distinct.columns else found.select("u", "v")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id): component_id is the least doc_id reachable over fingerprints within `radius` bits.

    Null, empty and white texts share fingerprint zero and link like any other; equal texts are one
    fingerprint, so copies cost one grid row however many they are; texts of any length count whole;
    rows with one doc_id get a row each; a null doc_id is never the least of others; an empty table gives no rows; other columns are ignored.
    """
    with small_batches(docs.sparkSession):
        of = written(fingerprints(docs), "simhash")
    classes = written(of.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    stars = components(near_links(classes, radius))
    member = stars.select(F.col("u").alias("fp"), F.col("v").alias("root")).unionByName(stars.select(F.col("v").alias("fp"), F.col("v").alias("root")).distinct())
    known = member.join(classes, "fp")
    root = known.groupBy("root").agg(F.min("least").alias("component"))
    merged = known.join(root, "root").select("fp", "component")
    # written, so that the last join has a shuffle on either side and a fingerprint with very many documents can be split
    each = written(classes.join(merged, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id")), "components")
    return of.join(each, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Fingerprints a text for near copies; at five-word similarity 0.8 one of six lies within RADIUS for about 99 of 100 pairs.
COPY_SEEDS = 6
#: Words of a shingle, and the least share (numerator, denominator) of common shingles that makes two texts copies.
COPY_SHINGLE, COPY_SHARE = 5, (4, 5)


def shingle_set(text: bytes, size: int = COPY_SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's runs of `size` words; a shorter text is one run, one without words none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.int64)
    h = np.array([xxhash.xxh64_intdigest(w, SEED) for w in words], np.uint64)
    size = min(size, len(h))
    x = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[i : i + len(x)]
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return np.unique((x ^ (x >> np.uint64(30))).view(np.int64))


def mark_of(shingles: np.ndarray) -> int:
    """One 64-bit number of a shingle set."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


#: Bytes of a shingle set's bitmap.
BITMAP = 128


def bitmap_of(shingles: np.ndarray) -> bytes:
    """The bits that the shingles' hashes set."""
    out = np.zeros(8 * BITMAP, np.uint8)
    out[shingles.view(np.uint64) % np.uint64(8 * BITMAP)] = 1
    return np.packbits(out).tobytes()


def may_be_copies(bits: np.ndarray, size: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Which pairs of sets the bitmaps allow to reach COPY_SHARE. Each bit that only one set has stands for a shingle that the other lacks,
    so what a pair has in common is at most a set's size less such bits: no pair that reaches the share is left out."""
    least, whole = COPY_SHARE
    out = np.zeros(len(p), bool)
    for i in range(0, len(p), 1 << 15):
        a, b = p[i : i + (1 << 15)], q[i : i + (1 << 15)]
        both = np.minimum(size[a] - np.bitwise_count(bits[a] & ~bits[b]).sum(axis=1, dtype=np.int64), size[b] - np.bitwise_count(bits[b] & ~bits[a]).sum(axis=1, dtype=np.int64))
        out[i : i + (1 << 15)] = (least + whole) * both >= least * (size[a] + size[b])
    return out


def copy_pairs(entries: DataFrame, radius: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(u, v) marks, u < v, of all pairs within `radius` bits of one seed whose labels differ and whose sizes and bitmaps allow COPY_SHARE.

    entries: seed, fp, mark, label, size, bits.
    """
    n = partitions(entries.sparkSession)
    kinds = "cell long, asks boolean, fp long, mark long, label long, size int, bits binary"

    def spread(batches):
        for b in batches:
            seed, fp = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            cell, asks, row = places(fp)
            yield pa.RecordBatch.from_arrays([pa.array(cell + (seed[row].astype(np.int64) << SEED_SHIFT)), pa.array(asks), *(b.column(i).take(pa.array(row)) for i in (1, 2, 3, 4, 5))], names=["cell", "asks", "fp", "mark", "label", "size", "bits"])

    def compare(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            key = np.stack([t.column(c).to_numpy() for c in ("cell", "i", "j")], axis=1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            if len(cuts):
                yield from done(t.slice(0, int(cuts[-1])), np.r_[0, cuts])
                t = t.slice(int(cuts[-1]))
            held = t.combine_chunks()
        if held is not None and held.num_rows:
            yield from done(held, np.array([0, held.num_rows]))

    def done(t, bounds):
        fp, asks, mark, label, size, chunk, i, j = (t.column(c).to_numpy() for c in ("fp", "asks", "mark", "label", "size", "chunk", "i", "j"))
        x, size = fp.view(np.uint64), size.astype(np.int64)
        bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint64).reshape(-1, BITMAP // 8)
        for a, z in zip(bounds, bounds[1:]):
            owners = np.flatnonzero(~asks[a:z]) + a
            for k in range(0, len(owners) if z - a > 1 else 0, 256):
                o = owners[k : k + 256]
                near = (np.bitwise_count(x[o][:, None] ^ x[None, a:z]) <= radius) & (label[o][:, None] != label[None, a:z])
                if i[a] != j[a]:
                    near &= chunk[o][:, None] != chunk[None, a:z]
                p, q = np.nonzero(near)
                p, q = o[p], a + q
                ok = may_be_copies(bits, size, p, q)
                if ok.any():
                    p, q = mark[p[ok]], mark[q[ok]]
                    both = np.unique(np.stack([np.minimum(p, q), np.maximum(p, q)], axis=1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["u", "v"])

    placed = entries.select("seed", "fp", "mark", "label", "size", "bits").mapInArrow(spread, kinds)
    large = placed.groupBy("cell").count().filter(F.col("count") > cell_rows).select("cell", F.ceil(F.col("count") / cell_rows).cast("int").alias("chunks"))
    cut = placed.join(large, "cell", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("chunk", F.pmod(F.xxhash64("mark"), F.col("chunks")).cast("int"))
    blocks = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("cell", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "asks", "fp", "mark", "label", "size", "bits", "chunk")
    return blocks.repartition(n, "cell", "i", "j").sortWithinPartitions("cell", "i", "j").mapInArrow(compare, "u long, v long").distinct()


def copies_of(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (u, v) whose shingle sets have a Jaccard similarity of COPY_SHARE or more; sets: mark, shingles."""
    least, whole = COPY_SHARE
    left, right = (sets.select(F.col("mark").alias(c), F.col("shingles").alias(f"s{c}")) for c in "uv")
    common = F.size(F.array_intersect("su", "sv"))
    return pairs.join(left, "u").join(right, "v").filter((least + whole) * common >= least * (F.size("su") + F.size("sv"))).select("u", "v")


def copy_groups(docs: DataFrame, seeds: int = COPY_SEEDS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, component_id) of exact and near copies: texts are linked where the Jaccard similarity of their
    five-word shingles is COPY_SHARE or more; component_id is the least doc_id reachable over such links.

    Candidates are texts of which any of `seeds` fingerprints over their distinct words lies within `radius`
    bits; each is tested on the whole shingle sets (as 64-bit hashes). The candidates' spanning forest is
    tested first, so that members of one large group are joined by few tests; then all candidate pairs that
    are not connected yet and whose bitmaps leave the similarity open. Texts of equal shingle sets are one node, so many copies cost no more than one;
    null, empty and white texts are copies of each other; an empty table gives no rows.
    """

    def run(batches):
        release()
        for whole in batches:
            for b in sliced(whole):
                texts = b.column(1).cast(pa.binary()).to_pylist()
                sets = [shingle_set(t) for t in texts]
                fps = np.array([word_fingerprints(t, seeds) for t in texts], np.uint64).reshape(-1, seeds).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([mark_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([bitmap_of(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(len(fps) + 1) * seeds, pa.int32()), pa.array(fps.reshape(-1)))], names=["doc_id", "mark", "size", "bits", "fps"])

    def shingled(batches):
        for whole in batches:
            for b in sliced(whole):
                sets = [shingle_set(t) for t in b.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([mark_of(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["mark", "shingles"])

    texts = id_and_text(docs)
    with small_batches(docs.sparkSession):
        of = written(texts.mapInArrow(run, "doc_id long, mark long, size int, bits binary, fps array<long>"), "words")
    classes = written(of.groupBy("mark").agg(F.min("doc_id").alias("least"), F.first("size").alias("size"), F.first("bits").alias("bits"), F.first("fps").alias("fps")), "classes")
    each = classes.select("mark", "size", F.posexplode("fps").alias("seed", "fp"))
    held = written(each.groupBy("seed", "fp").agg(F.min("mark").alias("least"), F.max("mark").alias("most")), "fingerprints")
    near = written(near_links(held, radius).distinct(), "near")
    met = held.filter("most > least").select("seed", "fp").unionByName(near.select("seed", F.col("u").alias("fp"))).unionByName(near.select("seed", F.col("v").alias("fp"))).distinct()
    entries = written(each.join(met, ["seed", "fp"]).select("seed", "fp", "mark", "size"), "entries")
    wanted = written(entries.select("mark").distinct().join(classes.select("mark", "least"), "mark"), "wanted")
    sets = texts.join(wanted.select(F.col("least").alias("doc_id")).distinct(), "doc_id", "left_semi").mapInArrow(shingled, "mark long, shingles array<long>")
    with small_batches(docs.sparkSession):
        sets = written(sets.dropDuplicates(["mark"]).join(wanted.select("mark"), "mark", "left_semi"), "shingles")

    same = entries.join(held.filter("most > least"), ["seed", "fp"]).filter("mark > least").select(F.col("mark").alias("u"), F.col("least").alias("v"))
    left, right = (held.select("seed", F.col("fp").alias(c), F.col("least").alias(f"n{c}")) for c in "uv")
    across = near.join(left, ["seed", "u"]).join(right, ["seed", "v"]).select(F.col("nu").alias("u"), F.col("nv").alias("v"))
    first = same.unionByName(across).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u < v").distinct()
    linked = written(copies_of(first, sets), "copies")
    labels = components(linked).select(F.col("u").alias("mark"), F.col("v").alias("label"))
    open_pairs = copy_pairs(entries.join(classes.select("mark", "bits"), "mark").join(labels, "mark", "left").withColumn("label", F.coalesce("label", "mark")), radius)
    more = written(copies_of(open_pairs, sets), "copies")

    roots = components(linked.unionByName(more)).select(F.col("u").alias("mark"), F.col("v").alias("root"))
    rooted = classes.select("mark", "least").join(roots, "mark", "left").withColumn("root", F.coalesce("root", "mark"))
    group = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return of.select("doc_id", "mark").join(rooted.select("mark", "root").join(group, "root").select("mark", "component_id"), "mark").select("doc_id", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents that are the least doc_id of their copy group; columns stay, whatever their names.

    Rows with one doc_id count as one document, rows without a doc_id too: it stays where any of them is
    the least of its group. Null, empty and white texts are one group; an empty table stays empty.
    """
    kept = copy_groups(docs).filter("doc_id <=> component_id").select(F.col("doc_id").alias("kept")).distinct()
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["kept"]), "left_semi")
