"""SimHash near-duplicates by anchor-point covering.

A text's fingerprint has 64 bits: those set in more than half of its shingles' XXH64 values.  Two fingerprints link at
``threshold`` differing bits or fewer.

The 64 bits are dealt to ``blocks`` blocks, so that linked fingerprints differ in at most ``threshold // blocks`` bits of some block.
In a block, the words of a covering code are the anchors: the direct product of a (shortened) Hamming code on up to 15
bits, whose covering radius is one, and all values of the other bits.  A fingerprint's home is its nearest anchor; it is
replicated to every anchor within the covering radius plus the block's threshold.  Two linked fingerprints therefore meet at the
home anchor of either (triangle inequality), and all comparisons are made anchor by anchor, with no candidate left out.

Equal fingerprints are one row before replication, whatever the number of copies.  An anchor emits a minimum spanning
forest of its links, not its pairs; where only groups are sought, the groups that its links join.  An anchor with more than ``crowd`` rows is dealt out to pairs of its shares.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.llm.anchors import distinct_texts, mix, text_key
from barflow.llm.common import kind, map_batches, settle, text_of
from barflow.llm.components import components

SEED = 42
# How similar texts are found for a wanted share of common shingles: four fingerprints, links of 29 of the first two's 128 bits (a pair with similarity 0.8
# differs in 19 on average, in more than 29 once in a hundred times), anchors of the 16 blocks of all four, one of which may differ in one bit (one pair in
# two hundred at 0.8 has none such).  Links are then checked exactly.
SIMILAR = {"threshold": 29, "blocks": 4, "block_threshold": 1}
BITS = 64
WORDS = ("fp", "fp2", "fp3", "fp4")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 of every ``width``-word shingle (A-Z lower-cased, joined by one space); fewer words: of them all; none: empty."""
    words = text.encode().translate(_LOWER).split(None) if text else []
    if not words:
        return np.zeros(0, np.uint64)
    line = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()[min(width, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, len(ends))  # noqa: B905


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes, as an unsigned integer."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and the fingerprint ``fp`` (its 64 bits as a signed long) of every whole text, one row for each input row.

    Null, empty and blank texts have fingerprint zero.  Ids may be null or repeat; other columns are not carried.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(shingle_hashes(t, width)) for t in batch.column(1).to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], [id_col, "fp"])

    return map_batches(docs.select(F.col(id_col), text_of(text_col).alias("text")), run, f"`{id_col}` {kind(docs, id_col)}, fp bigint")


def set_fingerprints(docs: DataFrame, width: int, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep``, ``tk`` (hash of the text), ``fp`` to ``fp4`` (64 bits each) of the set of shingles of every whole text."""
    n = len(keep)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.unique(shingle_hashes(t, width)) for t in batch.column(n + 1).to_pylist()]
        words = []
        for _ in WORDS:
            words.append(np.array([fingerprint(h) for h in sets], np.uint64).view(np.int64))
            sets = [mix(h) for h in sets]
        return pa.RecordBatch.from_arrays([*batch.columns[: n + 1], *map(pa.array, words)], [*keep, "tk", *WORDS])

    fields = ", ".join([*(f"`{c}` {kind(docs, c)}" for c in keep), "tk bigint", *(f"{c} bigint" for c in WORDS)])
    return map_batches(docs.select(*keep, text_key(text_col).alias("tk"), text_of(text_col).alias("_text")), run, fields)


class BlockCode:
    """Anchors of one block of ``width`` bits, ``shift`` bits up: a Hamming code on its low bits times all values of the rest."""

    def __init__(self, width: int, shift: int, radius: int):
        self.width, self.shift = width, shift
        checks = next(r for r in range(1, 8) if 2**r - 1 >= min(width, 15))
        self.columns = [i + 1 if i < 15 else 0 for i in range(width)]  # syndrome of each single bit
        # Error patterns of at most ``radius`` bits by their syndrome: anchors within the radius of a value are value ^ pattern.
        patterns: dict[int, list[int]] = {s: [] for s in range(2**checks)}

        def grow(first: int, left: int, pattern: int, syndrome: int) -> None:
            patterns[syndrome].append(pattern)
            if left:
                for i in range(first, width):
                    grow(i + 1, left - 1, pattern | 1 << i, syndrome ^ self.columns[i])

        grow(0, radius, 0, 0)
        self.sizes = np.array([len(p) for p in patterns.values()])
        self.firsts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.array([x for p in patterns.values() for x in p], np.int64)
        self.parity = [sum(1 << i for i in range(width) if self.columns[i] >> b & 1) for b in range(checks)]

    def anchors(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, anchor, whether it is the row's home) of every replica."""
        value = ((fps >> np.uint64(self.shift)) & np.uint64(2**self.width - 1)).astype(np.int64)
        syndrome = sum((np.bitwise_count(value & p).astype(np.int64) & 1) << b for b, p in enumerate(self.parity))
        n = self.sizes[syndrome]
        row = np.repeat(np.arange(len(fps)), n)
        pattern = self.flat[np.repeat(self.firsts[syndrome], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        # the home is the coset leader: no bit, or the one bit with this syndrome
        leader = np.where(syndrome == 0, 0, np.int64(1) << np.maximum(syndrome - 1, 0))
        return row, value[row] ^ pattern, pattern == leader[row]


def block_codes(threshold: int, blocks: int) -> list[BlockCode]:
    """Codes whose anchors bring any two fingerprints within ``threshold`` together in some block."""
    widths = [BITS // blocks + (i < BITS % blocks) for i in range(blocks)]
    if min(widths) < 15:
        raise ValueError("blocks narrower than 15 bits have no Hamming anchors")
    return [BlockCode(w, sum(widths[:i]), 1 + threshold // blocks) for i, w in enumerate(widths)]


def _distance(rows: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Differing bits between fingerprints (in 64-bit words) and one of them, or pairwise by broadcasting."""
    return np.bitwise_count(rows ^ one).sum(axis=-1, dtype=np.int16)


def _forest(fps: np.ndarray, home: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (positions) of a minimum spanning forest of the links among home rows and what they link to, nearest links first."""
    homes = np.flatnonzero(home)
    involved = np.zeros(len(fps), bool)
    step = max(1, 1_000_000 // len(fps))
    for at in range(0, len(homes), step):  # rows without a link, nearly all of them, end here
        part = homes[at : at + step]
        bits = np.bitwise_count(fps[part, None, 0] ^ fps[None, :, 0])
        for word in range(1, fps.shape[1]):
            bits += np.bitwise_count(fps[part, None, word] ^ fps[None, :, word])
        near = bits <= threshold
        np.put_along_axis(near, part[:, None], False, axis=1)
        x, y = np.nonzero(near)
        involved[part[x]] = involved[y] = True
    rows = np.flatnonzero(involved)
    if not len(rows):
        return rows, rows
    points, far = fps[rows], threshold + 1
    nearest, parent = np.full(len(rows), far, np.int16), np.zeros(len(rows), np.int64)
    done = np.int16(2 * far)
    a, b, at = [], [], 0
    for _ in range(len(rows)):
        if nearest[at] < far:
            a.append(parent[at])
            b.append(at)
        nearest[at] = done
        now = _distance(points, points[at])
        better = (now < nearest) & (nearest <= far)
        nearest[better], parent[better] = now[better], at
        at = int(np.argmin(nearest))
    return rows[np.array(a, int)], rows[np.array(b, int)]


def _joined(fps: np.ndarray, home: np.ndarray, roots: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the roots that links among home rows and what they link to bring together: the smallest of them and each other one."""
    order = np.lexsort(roots.T[::-1])
    new = np.r_[True, (roots[order[1:]] != roots[order[:-1]]).any(axis=1)]
    own = np.empty(len(roots), np.int64)
    own[order] = np.cumsum(new) - 1
    label, homes = own.copy(), np.flatnonzero(home)
    step = max(1, 1_000_000 // len(fps))
    for at in range(0, len(homes) if own.any() else 0, step):
        part = homes[at : at + step]
        bits = np.bitwise_count(fps[part, None, 0] ^ fps[None, :, 0])
        for word in range(1, fps.shape[1]):
            bits += np.bitwise_count(fps[part, None, word] ^ fps[None, :, word])
        near = bits <= threshold
        for i in np.flatnonzero((near & (label[part, None] != label[None, :])).any(axis=1)).tolist():
            met = np.unique(label[near[i]])
            if len(met) > 1:  # not joined by a row before
                label[np.isin(label, met)] = met[0]
    first = roots[order[new]]
    moved = np.unique(np.stack([label, own], axis=1)[label != own], axis=0)
    return first[moved[:, 0]], first[moved[:, 1]]


def links(distinct: DataFrame, threshold: int = 4, blocks: int = 3, block_threshold: int | None = None, crowd: int = 4096, stars: bool = False) -> DataFrame:
    """Links ``a, b`` (a < b) between the distinct rows of the columns ``fp``, ``fp2`` (64 bits each) within ``threshold`` bits.

    They are minimum spanning forests of the links at each anchor, so they connect all that the links connect and hold every
    link of a minimum spanning forest of them all.  Blocks of ``fp`` to ``fp4``, as far as there are such columns, have anchors.  Without
    ``block_threshold`` (bits that may differ in a block) no link of ``fp`` alone is missed.  ``a`` and ``b`` are structs of the fingerprint columns, or plain longs if there is one.

    With ``stars`` the pairs connect the same, but need not be links: first rows meet at their own home anchors of at most four blocks only, and what is linked
    there gets one root; then all anchors tell only which roots their links join, each with the smallest of them.  So a group is told once, not at each of its anchors.
    """
    anchored = [c for c in WORDS if c in distinct.columns]
    names = anchored[:2]
    codes = block_codes(threshold if block_threshold is None else block_threshold * blocks, blocks)
    distinct = distinct.select(*anchored)
    if not stars:
        return _meet(distinct, anchored, [], codes, threshold, crowd)
    roots = [f"root_{c}" for c in names]
    alone = distinct.select(*anchored, *[F.col(c).alias(r) for c, r in zip(names, roots, strict=True)])
    first = settle(_meet(alone, anchored, roots, codes, threshold, crowd, homes_only=True), "first")
    grouped, end = components(first), _end(names)
    found = [F.col("root")] if len(names) == 1 else [F.col("root")[c] for c in names]
    rooted = distinct.join(grouped, end == F.col("node"), "left").select(*anchored, *[F.coalesce(x, c).alias(r) for x, c, r in zip(found, names, roots, strict=True)])
    return first.union(_meet(settle(rooted, "rooted"), anchored, roots, codes, threshold, crowd)).distinct()


def _end(columns: list[str], names: list[str] | None = None) -> Column:
    """Fingerprint columns as one end of a link."""
    return F.struct(*[F.col(c).alias(name) for c, name in zip(columns, names or columns, strict=True)]) if len(columns) > 1 else F.col(columns[0])


def _meet(distinct: DataFrame, anchored: list[str], roots: list[str], codes: list[BlockCode], threshold: int, crowd: int, homes_only: bool = False) -> DataFrame:
    """What meets at the anchors: links ``a, b`` between fingerprints (a forest an anchor), or, with ``roots`` (columns), pairs of roots that links join.

    With ``homes_only`` rows go to their home anchors of at most four blocks, and a crowded anchor's shares do not meet each other.
    """
    names = anchored[:2]
    kept = [*names, *roots]
    width, n = len(names), len(kept)
    blocks = [(c, code) for c in range(len(anchored)) for code in codes]
    if homes_only:
        blocks = blocks[:: -(-len(blocks) // 4)]

    def replicate(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [code.anchors(batch.column(c).to_numpy().view(np.uint64)) for c, code in blocks]
        if homes_only:
            parts = [(r[h], a[h], h[h]) for r, a, h in parts]
        row = pa.array(np.concatenate([r for r, _, _ in parts]))
        anchor = np.concatenate([a + (np.int64(i) << 32) for i, (_, a, _) in enumerate(parts)])
        columns = [*batch.columns[:width], *batch.columns[len(anchored) :]]
        return pa.RecordBatch.from_arrays([pa.array(anchor), *[c.take(row) for c in columns], pa.array(np.concatenate([h for _, _, h in parts]))], ["anchor", *kept, "home"])

    fields = ", ".join(f"{c} bigint" for c in kept)
    spread = map_batches(distinct.select(*anchored, *roots), replicate, f"anchor bigint, {fields}, home boolean", 2048)
    crowded = spread.groupBy("anchor").agg(F.ceil(F.count("*") / F.lit(crowd)).cast("int").alias("shares")).where("shares > 1")
    shares = settle(crowded, "crowded")  # written first, so that its size decides how it is joined
    share = F.pmod(F.xxhash64("fp"), F.col("shares")).cast("int")
    others = F.sequence(F.lit(0), F.col("shares") - 1)
    # a row in share s meets every share t in the cell (min, max)
    cells = F.array(share) if homes_only else F.transform(others, lambda t: F.least(t, share) * F.col("shares") + F.greatest(t, share))
    dealt = (
        spread.join(shares, "anchor", "left")
        .select("anchor", F.explode(F.when(F.col("shares").isNull(), F.array(F.lit(-1))).otherwise(cells)).alias("cell"), *kept, "home")
        .repartition("anchor", "cell").sortWithinPartitions("anchor", "cell")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def edges(group: np.ndarray) -> Iterator[pa.RecordBatch]:
            cuts = np.flatnonzero(np.r_[True, (group[1:, 0] != group[:-1, 0]) | (group[1:, 1] != group[:-1, 1])])
            found = []
            for lo, hi in zip(cuts, np.r_[cuts[1:], len(group)], strict=True):
                home = group[lo:hi, -1].astype(bool)
                if hi - lo > 1 and home.any():
                    ends = group[lo:hi, 2 : 2 + width]
                    fps = np.ascontiguousarray(ends).view(np.uint64)
                    if roots:
                        one, other = _joined(fps, home, group[lo:hi, 2 + width : 2 + n], threshold)
                    else:
                        x, y = _forest(fps, home, threshold)
                        one, other = ends[x], ends[y]
                    if len(one):
                        found.append(np.concatenate([one, other], axis=1))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(found).T], [f"{s}{i}" for s in "ab" for i in range(width)])

        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
            if not len(rows):
                continue
            last = np.flatnonzero((rows[:, 0] != rows[-1, 0]) | (rows[:, 1] != rows[-1, 1]))
            cut = last[-1] + 1 if len(last) else 0  # the last group may go on in the next batch
            if cut or held and (held[-1][-1, :2] != rows[0, :2]).any():
                yield from edges(np.concatenate([*held, rows[:cut]]))
                held = []
            held.append(rows[cut:])
        if held:
            yield from edges(np.concatenate(held))

    ends = [_end([f"{s}{i}" for i in range(width)], names) for s in "ab"]
    pairs = dealt.mapInArrow(compare, ", ".join(f"{s}{i} bigint" for s in "ab" for i in range(width)))
    return pairs.select(F.least(*ends).alias("a"), F.greatest(*ends).alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 4, threshold: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, fp, component_id`` of every row: the smallest id that links of ``threshold`` bits reach, itself included.

    Ids may repeat (each row is returned) or be null (never a component's id unless all ids in it are null).
    """
    rows = settle(fingerprints(docs, width, id_col, text_col), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min(id_col).alias("first"))
    found = components(settle(links(distinct, threshold), "links"), "a", "b")
    classes = distinct.join(found, distinct.fp == found.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(classes.join(smallest, "root").select("fp", "component_id"), "fp").select(id_col, "fp", "component_id")


def similarity(a: str, b: str, width: int) -> float:
    """Share of common shingles among all of two texts (Jaccard); two texts without words are equal."""
    x, y = (set(shingle_hashes(t, width).tolist()) for t in (a, b))
    return len(x & y) / len(x | y) if x or y else 1.0


def _verified(sets: list[np.ndarray], width_bits: int, least: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose exact similarity is ``least`` or more, the nearest fingerprints tested first.

    Pairs that are already connected need no test.  Fingerprints further apart than ``width_bits`` of 128 are not tested.
    """
    n = len(sets)
    fps = np.array([[fingerprint(h), fingerprint(mix(h))] for h in sets], np.uint64)
    label, edges = np.arange(n), []
    x, y = np.triu_indices(n, 1)
    bits = np.concatenate([_distance(fps[i + 1 :], fps[i]) for i in range(n)]) if n > 1 else np.zeros(0, np.int16)
    near = np.flatnonzero(bits <= width_bits)
    x, y, bits = x[near], y[near], bits[near]
    for level in np.unique(bits):
        here = np.flatnonzero(bits == level)
        here = here[label[x[here]] != label[y[here]]]
        for i, j in zip(x[here].tolist(), y[here].tolist(), strict=True):
            if label[i] != label[j]:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                union = len(sets[i]) + len(sets[j]) - both
                if not union or both >= least * union:
                    edges.append((i, j))
                    label[label == label[j]] = label[i]
    return edges


def similar_groups(docs: DataFrame, width: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text", share: int = 1000) -> DataFrame:
    """``id_col, tk, root`` of every row: rows have one ``root`` if links of ``least`` similarity or more (exact, of shingle sets) connect their texts.

    Candidates are the fingerprint links of ``SIMILAR``; texts that these connect are brought together, a group of more than ``share`` texts in pairs of
    its shares, and checked exactly.  ``tk`` is the hash of the text.  Null and blank texts are alike.
    """
    rows = settle(set_fingerprints(docs, width, [id_col], text_col), "fingerprints")
    texts = rows.select("tk", *WORDS).distinct()
    heads = texts.groupBy("fp", "fp2").agg(F.min("tk").alias("head"), *[F.min_by(c, "tk").alias(c) for c in WORDS[2:]])
    same = texts.join(heads, ["fp", "fp2"]).where("tk <> head").select(F.col("head").alias("a"), F.col("tk").alias("b"))
    found = settle(links(heads, **SIMILAR, stars=True), "links")
    ends = [heads.select(F.struct("fp", "fp2").alias(s), F.col("head").alias(f"{s}_head")) for s in "ab"]
    far = found.join(ends[0], "a").join(ends[1], "b").select(F.col("a_head").alias("a"), F.col("b_head").alias("b"))
    loose = components(same.union(far))
    members = settle(loose.union(loose.select(F.col("root").alias("node"), "root")).distinct(), "members")
    shares = settle(members.groupBy("root").agg(F.ceil(F.count("*") / F.lit(share)).cast("int").alias("shares")).where("shares > 1"), "shares")
    own = F.pmod(F.col("node"), F.col("shares")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("shares") - 1), lambda t: F.least(t, own) * F.col("shares") + F.greatest(t, own))
    places = members.join(shares, "root", "left").select("root", "node", F.explode(F.when(F.col("shares").isNull(), F.array(F.lit(-1))).otherwise(cells)).alias("cell"))
    together = places.join(distinct_texts(docs, text_col), F.col("node") == F.col("tk")).select("root", "cell", "tk", "text")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, key = {}, None

        def edges() -> pa.RecordBatch:
            keys = list(group)
            pairs = _verified(list(group.values()), SIMILAR["threshold"] + 7, least)
            return pa.RecordBatch.from_arrays([pa.array([keys[i] for i, _ in pairs], pa.int64()), pa.array([keys[j] for _, j in pairs], pa.int64())], ["a", "b"])

        for batch in batches:
            for root, cell, tk, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (root, cell):
                    if len(group) > 1:
                        yield edges()
                    group, key = {}, (root, cell)
                if tk not in group:  # copies of a text
                    group[tk] = np.unique(shingle_hashes(text, width))
        if len(group) > 1:
            yield edges()

    checked = together.repartition("root", "cell").sortWithinPartitions("root", "cell").mapInArrow(check, "a bigint, b bigint")
    roots = components(settle(checked, "checked"))
    return rows.join(roots, rows.tk == roots.node, "left").select(id_col, "tk", F.coalesce("root", "tk").alias("root"))


def keep_one(docs: DataFrame, width: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` without near-duplicates: of each group of :func:`similar_groups` the one with the smallest id stays (a null id is smallest)."""
    groups = settle(similar_groups(docs, width, least, id_col, text_col), "groups")
    chosen = groups.groupBy("root").agg(F.min(F.struct(id_col, "tk")).alias("k")).select(F.col("k")[id_col].alias("_id"), F.col("k.tk").alias("_tk"))
    kept = docs.join(chosen, docs[id_col].eqNullSafe(F.col("_id")) & (text_key(text_col) == F.col("_tk")), "left_semi")
    repeated = groups.groupBy(id_col, "tk").count().where("count > 1")
    # rows that are repeated as they are have one key: one of them stays
    return kept.dropDuplicates([id_col, text_col]) if repeated.limit(1).count() else kept
