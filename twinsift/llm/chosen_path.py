"""Near-duplicate documents by a chosen-path set similarity join over minwise tokens.

A document is the set of its distinct word shingles. Rows with equal sets are one class and take part
once. A class carries a sketch: the least hash of its set under each of many hash functions (its
minwise tokens) and a bit of each packed into two long integers, whose differing bits estimate the
similarity.

Each of ``TREES`` independent trees starts with all classes in its root and sends a class to the child
named by one minwise token. Two sets of similarity s meet in a child with probability s, and sets that
share little part at once. Nodes whose classes are already known to belong together need no
comparison. A node is small when at most ``SMALL`` of its classes lie outside its largest known group:
those are compared with each other and, in blocks, with every class of that group. Larger nodes branch
again on further tokens, picked by the node's name; whatever is still large at the last level is cut
into runs that are all compared with each other, so no candidate is cut off.

A block is compared in two steps inside a task. The bits name the classes that may reach the threshold
with a class of another group; for those the ``DEPTH`` least hashes of their sets are fetched, which
are the whole sets but for long texts. Going from the most similar pair down, a pair is handed on only
if its groups are not yet joined in the block, so a block hands on a spanning forest of its links and
not its pairs. Every pair handed on is confirmed on the full sets.

To keep blocks few in a group of copies, first every class is compared with the leader of each of its
nodes (the class of least rank there), and the links found make the known groups.

Recall: a pair at the threshold misses one tree's first level with probability 1/4, so 24 trees miss
it with 4e-15. Where nodes stay large and branch on, the odds rise with the level, more so as trees
share their tokens: in a simulation of pairs at the threshold 8e-5 were missed after four levels,
1.3e-3 after six and 1e-2 at the last one. That concerns pairs in groups of very many texts that are
alike, but below the threshold. A pair passes the test on bits with all but 1e-8, and the one on the least hashes of a long
text with all but 1e-6.

Texts without words (null, empty) have empty sets: they link with nothing. Rows with one ``doc_id``
are one document, so they belong to one component; rows without ``doc_id`` stay alone, with a null
component, and are kept. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinsift.llm.session import give_back, map_batches, string
from twinsift.llm.words import SOLID, blocks, find_words, mix, windows
from twinsift.operators.components import connected_components
from twinsift.operators.storage import stage, stage_measured

SHINGLE = 5
# Linked when 100 * |intersection| >= PERCENT * |union|.
PERCENT = 75
TREES = 24
COORDINATES = 128
# A node with at most so many classes outside its largest known group is compared exhaustively, in
# blocks of those and as many of the group.
SMALL = 768
LEVELS = 10
# Least hashes of a set that are compared inside a block; all of them for sets up to this size.
DEPTH = 2_048
# What a pair must reach inside a block to be confirmed, and from where on it surely joins its groups:
# for whole sets only a collision of hashes can be wrong, for the others five standard errors.
WHOLE = (0.745, 0.755)
PARTS = (0.70, 0.80)
# Differing bits of two sketches. At similarity 0.75 the mean is 16 of 128 with a deviation of 3.7.
MOST_BITS = 40

_SKETCH = [
    T.StructField("__n", T.LongType()),
    T.StructField("__k1", T.LongType()),
    T.StructField("__k2", T.LongType()),
    T.StructField("__b1", T.LongType()),
    T.StructField("__b2", T.LongType()),
    T.StructField("__tokens", T.ArrayType(T.IntegerType())),
]
_FACTORS = np.random.default_rng(19990517).integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_RUN = 1 << 16
# Shingles of sets that stay at hand while pairs are confirmed.
HELD = 20_000


def _sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text and their offsets. A shorter text is one shingle, an empty one none."""
    words = find_words(data, offsets, SOLID)
    counts = np.diff(words.offsets)
    hashes, bounds = windows(words.hashes, words.offsets, shingle)
    sizes = np.diff(bounds)
    text = np.repeat(np.arange(len(counts)), sizes)
    for i in np.flatnonzero((counts > 0) & (counts < shingle)):
        first, last = words.offsets[i : i + 2]
        whole = np.uint64(last - first)
        for h in words.hashes[first:last]:
            whole = whole * np.uint64(0xD6E8FEB86659FD93) + h
        hashes, text = np.append(hashes, mix(np.array([whole]))), np.append(text, i)
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    hashes, text = hashes[fresh], text[fresh]
    return hashes, np.searchsorted(text, np.arange(len(counts) + 1))


def _minima(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The least 32 upper bits of every set under each function, sets by functions."""
    out = np.full((len(starts), COORDINATES), 0xFFFFFFFF, np.uint32)
    bounds = np.append(starts, len(hashes))
    first = 0
    while first < len(starts):
        last = int(np.searchsorted(bounds, bounds[first] + _RUN, side="right")) - 1
        last = min(max(last, first + 1), len(starts))
        part = hashes[bounds[first] : bounds[last]]
        at = bounds[first:last] - bounds[first]
        for j, factor in enumerate(_FACTORS):
            upper = ((part * factor) >> np.uint64(32)).astype(np.uint32)
            out[first:last, j] = np.minimum.reduceat(upper, at)
        first = last
    return out


def _sketch(shingle: int):
    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        text = batch.column(batch.schema.get_field_index("text"))
        sizes, k1, k2, bits, tokens = [], [], [], [], []
        for _, _, data, offsets in blocks(text):
            with np.errstate(over="ignore"):
                hashes, bounds = _sets(data, offsets, shingle)
                size = np.diff(bounds)
                some = size > 0
                minima = np.zeros((len(size), COORDINATES), np.uint32)
                minima[some] = _minima(hashes, bounds[:-1][some])
                keys = []
                for salt in (0x51ED270B, 0x2545F491):
                    sums = np.concatenate([[0], np.cumsum(mix(hashes + np.uint64(salt)))]).astype(np.uint64)
                    keys.append(sums[bounds[1:]] - sums[bounds[:-1]])
                spread = mix(minima.astype(np.uint64)) & np.uint64(1)
            sizes.append(size)
            k1.append(keys[0].view(np.int64))
            k2.append(keys[1].view(np.int64))
            bits.append(np.packbits(spread.astype(np.uint8), axis=1).view(np.int64))
            tokens.append(minima.view(np.int32))
        join = lambda parts: pa.array(np.concatenate(parts))
        pair = np.concatenate(bits)
        flat = np.concatenate(tokens)
        lists = pa.ListArray.from_arrays(np.arange(len(flat) + 1, dtype=np.int32) * COORDINATES, pa.array(flat.ravel()))
        return [join(sizes).cast(pa.int64()), join(k1), join(k2), pa.array(pair[:, 0]), pa.array(pair[:, 1]), lists]

    return compute


def _close(a: str, b: str) -> Column:
    """Whether two sketched classes, struct columns ``a`` and ``b``, may reach the threshold."""
    differing = F.bit_count(F.col(f"{a}.b1").bitwiseXOR(F.col(f"{b}.b1"))) + F.bit_count(
        F.col(f"{a}.b2").bitwiseXOR(F.col(f"{b}.b2"))
    )
    small, large = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    return (100 * small >= PERCENT * large) & (differing <= MOST_BITS)


def _confirm(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """The pairs ``(a, b)`` of classes whose full sets reach the threshold. ``texts``: one text per class."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    needed = texts.join(ends, "rep", "left_semi")
    a = needed.select(F.col("rep").alias("a"), F.col("text").alias("text_a"))
    b = needed.select(F.col("rep").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b").join(a, "a").join(b, "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, set] = {}
        size = 0
        for batch in batches:
            a, b, text_a, text_b = (batch.column(batch.schema.get_field_index(c)) for c in ("a", "b", "text_a", "text_b"))
            keep = []
            for i in range(batch.num_rows):
                sets = []
                for text in (text_a[i].as_py(), text_b[i].as_py()):
                    if text not in held:
                        if size > HELD:
                            held.clear()
                            size = 0
                        held[text] = shingle_set(text, shingle)
                        size += len(held[text])
                    sets.append(held[text])
                common = len(sets[0] & sets[1])
                keep.append(100 * common >= PERCENT * (len(sets[0]) + len(sets[1]) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])
        held.clear()
        give_back()

    return both.select("a", "b", "text_a", "text_b").mapInArrow(check, "a bigint, b bigint")


_SMALL_LETTERS = {c: c + 32 for c in range(65, 91)}


def shingle_set(text: str, shingle: int = SHINGLE) -> set[tuple[str, ...]]:
    """The exact set of a text, as tuples of words."""
    for space in "\t\n\v\f\r":
        text = text.replace(space, " ")
    words = [w for w in text.translate(_SMALL_LETTERS).split(" ") if w]
    if len(words) < shingle:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(shingle))))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id``, ``n_shingles``, ``component_id``, ``kept`` per row."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), string("text").alias("text"))
    rows = map_batches(docs, _sketch(shingle), _SKETCH).drop("text")
    rows = stage(rows, "sketches")
    named = rows.where(F.col("doc_id").isNotNull() & (F.col("__n") > 0))
    least = F.min(F.struct("doc_id", "__n", "__b1", "__b2", "__tokens"))
    classes = named.groupBy("__k1", "__k2").agg(least.alias("_c"))
    item = F.struct(F.col("_c.doc_id").alias("rep"), F.col("_c.__n").alias("n"), F.col("_c.__b1").alias("b1"), F.col("_c.__b2").alias("b2"))
    classes = classes.select("__k1", "__k2", item.alias("item"), F.col("_c.__tokens").alias("tokens"))
    classes = stage(classes, "classes")
    keyed = classes.select("__k1", "__k2", F.col("item.rep").alias("rep"))
    # A class is named after a document. If that has several texts, each may link the class.
    texts = docs.join(classes.select(F.col("item.rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    texts = texts.select(F.col("doc_id").alias("rep"), "text")

    nodes = _roots(classes)
    links = stage(_confirm(_leader_pairs(nodes), texts, shingle), "links")
    pairs, seen = stage_measured(_crossing_pairs(nodes, _first_groups(links), texts, shingle), "pairs", rows=F.count(F.lit(1)))
    if seen["rows"]:
        links = links.unionByName(_confirm(pairs, texts, shingle))
    known = connected_components(links)

    label = F.coalesce(F.col("component"), F.col("rep"))
    grouped = keyed.join(known.select(F.col("node").alias("rep"), "component"), "rep", "left").select(
        "__k1", "__k2", "rep", label.alias("component")
    )
    least = grouped.groupBy("component").agg(F.min("rep").alias("component_id"))
    # One row per class; classes that stand alone keep their own name.
    labelled = grouped.join(least, "component").select("__k1", "__k2", "component_id")
    out = rows.select("doc_id", "__n", "__k1", "__k2").join(labelled, ["__k1", "__k2"], "left")
    own = F.when((F.col("__n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id",
        F.col("__n").alias("n_shingles"),
        own.alias("component_id"),
        F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"),
    )


def _roots(classes: DataFrame) -> DataFrame:
    """First level of all trees: ``node``, ``item``, ``path`` for every node that holds more than one class.

    ``path`` holds the tokens that name the class's children at the further levels of the tree.
    """
    first = classes.select("item", "tokens", F.posexplode(F.slice("tokens", 1, TREES)).alias("tree", "token"))
    at = lambda k: F.pmod(F.col("tree") + k * TREES, F.lit(COORDINATES)).cast("int")
    path = F.array(*[F.get("tokens", at(k)) for k in range(1, LEVELS)])
    rows = first.select(F.xxhash64("tree", "token").alias("node"), "item", path.alias("path"))
    return stage(_shared(rows), "nodes")


def _shared(rows: DataFrame) -> DataFrame:
    """The rows of nodes with more than one class. Written first, the short side leaves a hot node's rows free to be split."""
    several = rows.groupBy("node").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select("node")
    return rows.join(stage(several, "shared"), "node")


def _leader_pairs(nodes: DataFrame) -> DataFrame:
    """Every class with the leader of each of its nodes, as far as their sketches agree. One ranking, so leaders recur."""
    nodes = nodes.select("node", "item")
    leaders = nodes.groupBy("node").agg(F.min_by("item", F.xxhash64("item.rep")).alias("leader"))
    leaders = stage(leaders, "leaders")
    pairs = nodes.join(leaders, "node").where((F.col("item.rep") != F.col("leader.rep")) & _close("item", "leader"))
    return _ordered(pairs, "item", "leader")


def _first_groups(links: DataFrame) -> DataFrame:
    """Known groups after the leaders: each linked class goes with the class of least rank within one link.

    Classes of one group are surely of one component. The converse need not hold yet: classes that are
    not known to belong together are only compared once more.
    """
    ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")
    near = links.select(ends).select(F.col("e.a").alias("node"), F.col("e.b").alias("other"))
    rank = lambda c: F.xxhash64(F.col(c))
    best = near.groupBy("node").agg(F.min_by("other", rank("other")).alias("least"))
    group = F.when(rank("least") < rank("node"), F.col("least")).otherwise(F.col("node"))
    return best.select("node", group.alias("component"))


def _ordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
    low, high = F.least(f"{a}.rep", f"{b}.rep"), F.greatest(f"{a}.rep", f"{b}.rep")
    return pairs.select(low.alias("a"), high.alias("b")).distinct()


def _crossing_pairs(nodes: DataFrame, known: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """Likely links between different known groups, from the small nodes of all levels."""
    groups = known.select(F.col("node").alias("_rep"), "component")
    rows = nodes.join(groups, F.col("item.rep") == F.col("_rep"), "left").select(
        "node", "item", "path", F.coalesce("component", F.col("item.rep")).alias("group")
    )
    found: list[DataFrame] = []
    for level in range(LEVELS):
        rows = stage(rows.join(stage(_sizes(rows), "sizes"), "node"), "open")
        if level == LEVELS - 1:
            found.append(_blocks(rows))
            break
        found.append(_blocks(rows.where(F.col("outside") <= SMALL)))
        large = rows.where(F.col("outside") > SMALL)
        rows, seen = stage_measured(_branch(large, level), "branches", rows=F.count(F.lit(1)))
        if not seen["rows"]:
            break
    blocks = found[0]
    for more in found[1:]:
        blocks = blocks.unionByName(more)
    likely = blocks.groupBy("block").agg(F.collect_list(F.struct("item", "group", "side")).alias("rows"))
    likely = stage(likely.mapInArrow(_likely_rows, _LIKELY), "likely")

    needed = texts.join(likely.select("rep").distinct(), "rep", "left_semi")
    least = map_batches(needed, _least_hashes(shingle), [T.StructField("set", T.BinaryType())]).drop("text")
    met = likely.join(stage(least, "sets"), "rep")
    member = F.struct("rep", "n", "b1", "b2", "group", "side", "set")
    return met.groupBy("block").agg(F.collect_list(member).alias("rows")).mapInArrow(_forest, "a bigint, b bigint").distinct()


def _blocks(rows: DataFrame) -> DataFrame:
    """Cut each node into blocks: a run of the classes outside the main group with a run of all classes.

    ``side`` 0: outside, 1: main group, 2: outside classes of another run, compared with those of side 0.
    Small nodes have one run of outside classes, so their rows are repeated once per run of the main group.
    """
    runs = lambda n: F.greatest(F.ceil(n / SMALL), F.lit(1)).cast("int")
    main, out = runs(F.col("total") - F.col("outside")), runs(F.col("outside"))
    own = lambda n: F.pmod(F.xxhash64("item.rep", F.lit(7)), n).cast("int")
    is_out = F.col("group") != F.col("main")
    place = lambda x, kind, y, side: F.struct(x.alias("x"), F.lit(kind).alias("kind"), y.alias("y"), F.lit(side).alias("side"))
    with_main = F.transform(F.sequence(F.lit(0), main - 1), lambda j: place(own(out), 0, j, 0))
    with_out = F.transform(F.sequence(own(out), out - 1), lambda j: place(own(out), 1, j, 0))
    under = F.transform(F.filter(F.sequence(F.lit(0), own(out)), lambda i: i < own(out)), lambda i: place(i, 1, own(out), 2))
    from_main = F.transform(F.sequence(F.lit(0), out - 1), lambda i: place(i, 0, own(main), 1))
    places = F.when(is_out, F.concat(with_main, F.when(out > 1, F.concat(F.slice(with_out, 2, 1 << 30), under)).otherwise(F.array()))).otherwise(from_main)
    spread = rows.select("node", "item", "group", F.explode(places).alias("p"))
    return spread.select(F.xxhash64("node", "p.x", "p.kind", "p.y").alias("block"), "item", "group", F.col("p.side").alias("side"))


_LIKELY = "block bigint, rep bigint, n bigint, b1 bigint, b2 bigint, group bigint, side int"


def _near_bits(x: int, n: np.ndarray, bits: np.ndarray) -> np.ndarray:
    differing = np.bitwise_count(bits ^ bits[x]).sum(axis=1)
    return (differing <= MOST_BITS) & (100 * np.minimum(n, n[x]) >= PERCENT * np.maximum(n, n[x]))


def _partners(x: int, side: np.ndarray) -> np.ndarray:
    """Rows that class ``x`` of side 0 is compared with: later ones of its own side and all of the others."""
    return (side > 0) | (np.arange(len(side)) > x)


def _likely_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each block whose bits allow a link to a class of another group."""
    names = ["rep", "n", "b1", "b2", "group", "side"]
    for batch in batches:
        for block, rows in zip(batch.column(0).to_pylist(), batch.column(1)):
            flat = rows.values.flatten()
            item = dict(zip([f.name for f in rows.values.type.field(0).type], flat[0].flatten()))
            columns = [*(item[name].to_numpy() for name in names[:4]), flat[1].to_numpy(), flat[2].to_numpy()]
            rep, n, b1, b2, group, side = columns
            bits = np.column_stack([b1, b2]).view(np.uint64)
            keep = np.zeros(len(rep), bool)
            for x in np.flatnonzero(side == 0):
                met = _near_bits(x, n, bits) & (group != group[x]) & _partners(x, side)
                if met.any():
                    keep |= met
                    keep[x] = True
            if keep.any():
                out = [np.full(int(keep.sum()), block), *(c[keep] for c in columns)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["block", *names])
    give_back()


def _least_hashes(shingle: int):
    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        out = []
        for _, _, data, offsets in blocks(batch.column(batch.schema.get_field_index("text"))):
            hashes, bounds = _sets(data, offsets, shingle)
            short = (hashes >> np.uint64(32)).astype(np.uint32)
            # Hashes are in order inside a set, and so are their upper halves.
            out += [short[a : min(b, a + DEPTH)].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
        return [pa.array(out, pa.binary())]

    return compute


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a block that may be links, without those whose groups the surer ones already join."""
    for batch in batches:
        for rows in batch.column(1):
            pairs = _block_links(rows.values)
            if pairs:
                low, high = zip(*[(min(p), max(p)) for p in pairs])
                yield pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=["a", "b"])
    give_back()


def _block_links(rows: pa.StructArray) -> list[tuple[int, int]]:
    rep, n, b1, b2, group, side = (rows.field(k).to_numpy() for k in range(6))
    sets = [np.frombuffer(v.as_buffer(), np.uint32) for v in rows.field(6)]
    bits = np.column_stack([b1, b2]).view(np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, value = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(value, kind="stable")
    postings, heads = owner[order], np.append(np.searchsorted(value[order], np.arange(value.max() + 1)), len(value))
    ends = np.cumsum([len(s) for s in sets])
    xs, ys, shares, sures = [], [], [], []
    for x in np.flatnonzero(side == 0):
        met = np.flatnonzero(_near_bits(x, n, bits) & (group != group[x]) & _partners(x, side))
        if not len(met):
            continue
        own = value[ends[x] - len(sets[x]) : ends[x]]
        size = heads[own + 1] - heads[own]
        at = np.repeat(heads[own] - np.cumsum(size) + size, size) + np.arange(size.sum())
        common = np.bincount(postings[at], minlength=len(sets))[met]
        share = common / (n[x] + n[met] - common)
        low, sure = np.full(len(met), WHOLE[0]), np.full(len(met), WHOLE[1])
        for k in np.flatnonzero(np.maximum(n[x], n[met]) > DEPTH):
            share[k], (low[k], sure[k]) = _share_of_parts(sets[x], sets[met[k]]), PARTS
        likely = share >= low
        xs.append(np.full(int(likely.sum()), x))
        ys.append(met[likely])
        shares.append(share[likely])
        sures.append(share[likely] >= sure[likely])
    if not xs:
        return []
    xs, ys, shares, sures = (np.concatenate(part) for part in (xs, ys, shares, sures))
    root: dict[int, int] = {}

    def top(g: int) -> int:
        while root.get(g, g) != g:
            root[g] = root.get(root[g], root[g])
            g = root[g]
        return g

    pairs = []
    for k in np.argsort(-shares, kind="stable"):
        x, y = xs[k], ys[k]
        g, h = top(int(group[x])), top(int(group[y]))
        if g != h:
            pairs.append((int(rep[x]), int(rep[y])))
            if sures[k]:
                root[g] = h
    return pairs


def _share_of_parts(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sets below the hash up to which both are known."""
    limits = [s[-1] for s in (a, b) if len(s) == DEPTH]
    a, b = (s[s <= min(limits)] for s in (a, b))
    common = len(np.intersect1d(a, b))
    return common / max(1, len(a) + len(b) - common)


def _sizes(rows: DataFrame) -> DataFrame:
    """Nodes that hold more than one group: the largest group and how many classes lie outside it."""
    per_group = rows.groupBy("node", "group").agg(F.count(F.lit(1)).alias("_n"))
    per_node = per_group.groupBy("node").agg(
        F.max_by("group", F.struct("_n", "group")).alias("main"),
        F.sum("_n").alias("total"),
        (F.sum("_n") - F.max("_n")).alias("outside"),
    )
    return per_node.where(F.col("outside") > 0)


def _branch(rows: DataFrame, level: int) -> DataFrame:
    """Send every class of a large node to the child its token names; a third of the nodes have two tokens.

    The second token is one that the tree uses half its levels later, under a name of its own.
    """
    rows = rows.select("node", "item", "path", "group")
    child = lambda k, salt: F.xxhash64("node", F.lit(salt), F.get("path", F.lit(k))).alias("node")
    twice = F.pmod(F.xxhash64("node", F.lit(level)), F.lit(3)) == 0
    rest = ["item", "path", "group"]
    second = rows.where(twice).select(child((level + LEVELS // 2) % (LEVELS - 1), 1), *rest)
    return _shared(rows.select(child(level, 0), *rest).unionByName(second))


def keep_one(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with only the first document of each component; rows without words all stay. Columns stay."""
    dropped = near_duplicates(docs, shingle).where(~F.col("kept")).select(F.col("doc_id").alias("__dropped")).distinct()
    return docs.join(dropped, docs["doc_id"] == F.col("__dropped"), "left_anti")
