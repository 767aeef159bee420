"""Near-duplicate classes by Order MinHash and banded alignment.

Words are maximal runs without white space, A-Z in lower case. Texts with equal words are one node from the start, so copies
cost nothing later. A text's shingles are its 5-word windows (fewer words: one shingle), labelled with their occurrence number.
Each of ``BANDS`` x ``ROWS`` sketches takes the ``PICK`` shingles with the smallest hashes and keeps them in text order; a band of
sketches is one key, and nodes with a common key are candidates. A pair of long texts of multiset similarity 0.8 is missed in 0.2 % of
cases, one of 0.85 in 0.01 %. Sketches of few shingles agree less often, so texts of up to ``SHORT`` shingles also get their rarest
shingles as keys, as many as two texts of similarity 0.8 can't differ in (a prefix filter): no pair with a text of under 50 is missed.

Candidates are never expanded into rows of all pairs of a bucket. Each bucket has a centre, the node with the most bucket mates
overall, and each node is first checked against the best centre of its buckets, which joins most of a group of any size. In buckets
whose nodes are in several classes then, those outside the bucket's largest class are compared with the whole bucket in
blocks of ``BLOCK`` by ``BLOCK`` nodes: a task holds two blocks, counts common shingles through an index of them, and returns links
only. So no link between candidates is lost, and rows exchanged are in proportion to the bucket. A pair is linked if the share of common
occurrence-labelled shingles is 0.8 or more, which bounds the edits from above, and if the alignment in the band that
this bound allows keeps matching 5-word windows in order for 0.8 or more of their union. Classes are the components of the links.

Defined results: null and empty texts have no words and form one class; null ids are never a class's id unless it
has no other; repeated rows are copies; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from quarry.llm import textscan as ts
from quarry.llm.common import broadcast_if_small, stored
from quarry.llm.components import components

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS, PICK = 20, 2, 3
BLOCK = 500
#: The most shingles a text may have that is linked to one of under 50.
SHORT = int(49 / SIMILARITY)

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_MULTIPLIERS = ts.mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * ts.GOLDEN) | np.uint64(1)


def labelled(doc: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Hashes that also hold which occurrence in its text an item is."""
    key = ts.mix64(hashes ^ (doc.astype(np.uint64) + np.uint64(1)) * ts.GOLDEN)
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    begin = np.flatnonzero(fresh)
    nth = np.empty(len(key), np.uint64)
    nth[order] = (np.arange(len(key)) - np.repeat(begin, np.diff(np.append(begin, len(key))))).astype(np.uint64)
    return ts.mix64(hashes + nth * ts.BASE)


def shingles(words: ts.Tokens) -> tuple[np.ndarray, np.ndarray]:
    """(doc, occurrence-labelled hash) of all 5-word windows; texts of one to four words have one shingle."""
    hashes, doc = words.hash, words.doc
    window = ts.windows(hashes, WIDTH)
    whole = np.flatnonzero(doc[: len(window)] == doc[WIDTH - 1 :]) if len(window) else np.zeros(0, np.int64)
    sizes = np.diff(words.first)
    short = np.flatnonzero((sizes > 0) & (sizes < WIDTH))
    extra = np.array([int(ts.mix64(hashes[words.first[i] : words.first[i + 1]] * np.arange(1, sizes[i] + 1, dtype=np.uint64)).sum(dtype=np.uint64)) for i in short], np.uint64)
    docs = np.concatenate([doc[whole], short])
    order = np.argsort(docs, kind="stable")
    docs, values = docs[order], np.concatenate([window[whole], extra])[order]
    return docs, labelled(docs, values)


def digests_of(texts: pa.Array) -> list[bytes]:
    """The digest of each text's words."""
    out: list[bytes] = []
    for _, _, data, offsets in ts.pieces(texts):
        out += _digests(ts.words(_FOLD[data], offsets))
    return out


def _digests(words: ts.Tokens) -> list[bytes]:
    raw = words.hash.tobytes()
    return [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(words.first[:-1], words.first[1:], strict=True)]


def sketch(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray, list[np.ndarray]]:
    """(digest of the words, number of shingles, BANDS keys, shingles) of each text; under PICK shingles keys are 0, over SHORT shingles are left out."""
    digests, counts, keys, few = [], [], [], []
    for _, _, data, offsets in ts.pieces(texts):
        n = len(offsets) - 1
        words = ts.words(_FOLD[data], offsets)
        digests += _digests(words)
        doc, value = shingles(words)
        size = np.bincount(doc, minlength=n)
        ends = np.cumsum(size)
        few += [value[e - k : e] if k <= SHORT else value[:0] for k, e in zip(size, ends, strict=True)]
        out = np.zeros((n, BANDS), np.uint64)
        able = np.flatnonzero(size >= PICK)
        mine = size[doc] >= PICK
        value = value[mine]
        each = size[able]
        if len(able):
            start = np.cumsum(each) - each
            for j, multiplier in enumerate(_MULTIPLIERS):
                ranked = value * multiplier
                picks = np.empty((PICK, len(able)), np.int64)
                for p in range(PICK):
                    least = np.minimum.reduceat(ranked, start)
                    at = np.flatnonzero(ranked == np.repeat(least, each))
                    # equal hashes in a text would give two places: the first stands
                    picks[p] = at[np.searchsorted(at, start)]
                    ranked[at] = np.iinfo(np.uint64).max
                picks.sort(axis=0)
                band = out[able, j // ROWS]
                for p in range(PICK):
                    band = ts.mix64(band * ts.BASE + value[picks[p]] + np.uint64(j // ROWS))
                out[able, j // ROWS] = band
        counts.append(size)
        keys.append(out)
    return digests, np.concatenate([np.zeros(0, np.int64), *counts]), np.concatenate([np.zeros((0, BANDS), np.uint64), *keys]), few


def text_words(text: str | None) -> np.ndarray:
    data = _FOLD[np.frombuffer((text or "").encode(), np.uint8)]
    return ts.words(data, np.array([0, len(data)])).hash


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Sorted occurrence-labelled shingles of one text."""
    n = len(words)
    tokens = ts.Tokens(np.arange(n), np.ones(n, np.int64), words, np.zeros(n, np.int64), np.array([0, n]))
    return np.sort(shingles(tokens)[1])


def aligned_windows(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Matching 5-word windows, in order, in the best alignment with at most ``most`` insertions and deletions; -1 if there is none.

    Furthest-reaching points on the 2 * ``most`` + 1 diagonals around the main one: the band never grows beyond the edits made so far.
    """
    n, m = len(a), len(b)

    def slide(x: int, y: int) -> int:
        length, step = 0, 16
        while x + length < n and y + length < m:
            k = min(step, n - x - length, m - y - length)
            differ = np.flatnonzero(a[x + length : x + length + k] != b[y + length : y + length + k])
            if len(differ):
                return length + int(differ[0])
            length, step = length + k, step * 4
        return length

    reach, history = {1: 0}, []
    for d in range(most + 1):
        now = {}
        for k in range(-d, d + 1, 2):
            down = k == -d or (k != d and reach.get(k - 1, -1) < reach.get(k + 1, -1))
            x = reach.get(k + 1, 0) if down else reach[k - 1] + 1
            y = x - k
            if x > n or y > m or y < 0:
                now[k] = x
                continue
            now[k] = x + slide(x, y)
            if now[k] >= n and now[k] - k >= m:
                history.append(now)
                return _matched(history, n, m)
        history.append(now)
        reach = now
    return -1


def _matched(history: list[dict], n: int, m: int) -> int:
    """Windows in the diagonal runs of the path that ends at (n, m)."""
    x, y, total, run = n, m, 0, 0
    for d in range(len(history) - 1, -1, -1):
        k = x - y
        if d:
            before = history[d - 1]
            down = k == -d or (k != d and before.get(k - 1, -1) < before.get(k + 1, -1))
            start_x = before.get(k + 1, 0) if down else before[k - 1]
            begin = start_x if down else start_x + 1
        else:
            begin = 0
        run = x - begin
        total += max(0, run - WIDTH + 1)
        if d:
            x, y = start_x, start_x - (k + 1 if down else k - 1)
    return total


def similar(a: np.ndarray, b: np.ndarray, sa: np.ndarray, sb: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether two texts, given as words and sorted shingles, are linked."""
    if not len(sa) or not len(sb) or min(len(sa), len(sb)) < least * max(len(sa), len(sb)):
        return len(sa) == len(sb) == 0
    common = len(np.intersect1d(sa, sb, assume_unique=True))
    if common < least * (len(sa) + len(sb) - common):
        return False
    if len(a) < WIDTH or len(b) < WIDTH:
        return bool(len(a) == len(b) and (a == b).all())
    # m matching windows of the union: least / (1 + least) of both together; an edited word costs a window or more
    needed = least / (1 + least) * (len(sa) + len(sb))
    found = aligned_windows(a, b, int(len(sa) + len(sb) - 2 * needed) + 2 * WIDTH)
    return found >= needed - 1e-9


def sketched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, node, keys, few) stored: node is the digest of the words, keys the bands, few the shingles of a short text."""

    def scan(batches):
        for batch in batches:
            digests, size, keys, few = sketch(batch.column("text"))
            rows = [k.view(np.int64) if s >= PICK else np.zeros(0, np.int64) for s, k in zip(size, keys, strict=True)]
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (rows, [f.view(np.int64) for f in few])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(digests, pa.binary()), *lists], names=["doc_id", "node", "keys", "few"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return stored(
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scan, f"doc_id {id_type}, node binary, keys array<long>, few array<long>"),
        "sketches",
    )


def rarest(nodes: DataFrame) -> DataFrame:
    """(node, key): of each text's n shingles ``few`` the n - ceil(SIMILARITY * n) + 1 rarest, without those that no other text has."""
    items = stored(nodes.where("size(few) > 1").select("node", F.size("few").alias("size"), F.explode("few").alias("key")), "shingles")
    common = stored(items.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "common-shingles")
    ordered = items.join(broadcast_if_small(common), "key").groupBy("node", "size").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("o"))
    own = F.col("size") - F.size("o")  # shingles of this text alone come first
    most = F.col("size") - F.ceil(SIMILARITY * F.col("size") - 1e-9) + 1
    return ordered.select("node", F.explode(F.slice("o.key", F.lit(1), F.greatest(most - own, F.lit(0)).cast("int"))).alias("key"))


def node_texts(docs: DataFrame, text_col: str, nodes: DataFrame) -> DataFrame:
    """(node, text) stored: one text for each of ``nodes``."""

    def scan(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(digests_of(batch.column("text")), pa.binary()), batch.column("text")], names=["node", "text"])

    texts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(scan, "node binary, text string")
    return stored(texts.join(broadcast_if_small(nodes), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")), "texts")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked, stored."""

    def check(batches):
        seen: dict[bytes, tuple] = {}

        def of(node, text):
            if node not in seen:
                if len(seen) >= 64:
                    seen.pop(next(iter(seen)))
                words = text_words(text)
                seen[node] = words, shingle_set(words)
            return seen[node]

        for batch in batches:
            keep = []
            for i, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)):
                wa, sa = of(a, batch.column("text_a")[i].as_py())
                wb, sb = of(b, batch.column("text_b")[i].as_py())
                if similar(wa, wb, sa, sb):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    joined = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b"
    )
    return stored(joined.select("a", "b", "text_a", "text_b").mapInArrow(check, "a binary, b binary"), "verified")


def block_links(nodes: list[bytes], classes: list[bytes], left: np.ndarray, right: np.ndarray, texts: list[str]) -> list[tuple[bytes, bytes]]:
    """Links between nodes of ``left`` and of ``right`` (places in the lists) in different classes: one for each left node and class it reaches."""
    words = [text_words(t) for t in texts]
    sets = [shingle_set(w) for w in words]
    size = np.array([len(x) for x in sets])
    _, shingle = np.unique(np.concatenate([sets[i] for i in right]), return_inverse=True)
    owner = np.repeat(np.arange(len(right)), size[right])
    order = np.argsort(shingle, kind="stable")
    owner = owner[order]
    values = np.sort(np.concatenate([sets[i] for i in right]))
    found = []
    for i in left:
        begin, end = np.searchsorted(values, sets[i]), np.searchsorted(values, sets[i], side="right")
        many = end - begin
        at = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin, many)
        common = np.bincount(owner[at], minlength=len(right))
        union = size[i] + size[right] - common
        near = np.flatnonzero(common >= SIMILARITY * union)
        reached = {classes[i]}
        for j in near[np.argsort(-common[near] / union[near], kind="stable")]:
            other = int(right[j])
            if classes[other] not in reached and similar(words[i], words[other], sets[i], sets[other]):
                reached.add(classes[other])
                found.append((nodes[i], nodes[other]))
    return found


def linked_in_blocks(members: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """The links (a, b), stored, that buckets (key, node) hold beyond what ``classes`` (node, component) knows."""
    # Bands often hold the same nodes: of buckets with equal members, by number and two sums of hashes, one is looked at.
    same = [F.count(F.lit(1)), *[F.sum(F.xxhash64("node", F.lit(seed)).cast("decimal(38,0)")) for seed in (1, 2)]]
    signed = members.groupBy("key").agg(*[c.alias(f"s{i}") for i, c in enumerate(same)])
    distinct = signed.groupBy("s0", "s1", "s2").agg(F.min("key").alias("key")).select("key")
    placed = stored(members.join(distinct, "key").join(classes, "node", "left").withColumn("component", F.coalesce("component", "node")), "placed")
    shares = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    main = stored(
        shares.groupBy("key").agg(F.max(F.struct("n", "component")).alias("m"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("classes")).where("classes > 1")
        .select("key", F.col("m.component").alias("main"), F.ceil(F.col("n") / BLOCK).cast("int").alias("rights"), F.ceil((F.col("n") - F.col("m.n")) / BLOCK).cast("int").alias("lefts")),
        "open",
    )
    rows = placed.join(main, "key").withColumn("is_left", F.col("component") != F.col("main"))
    spread_over = lambda n: F.sequence(F.lit(0), n - 1)
    block = lambda n: F.pmod(F.xxhash64("node", "key"), n).cast("int")
    right = rows.select("key", "node", "component", F.explode(spread_over(F.col("lefts"))).alias("l"), block(F.col("rights")).alias("r"), F.lit(False).alias("is_left"))
    left = rows.where("is_left").select("key", "node", "component", block(F.col("lefts")).alias("l"), F.explode(spread_over(F.col("rights"))).alias("r"), "is_left")
    blocks = left.unionByName(right).join(texts, "node")

    def compare(_key, table):
        is_left = np.array(table.column("is_left").to_pylist(), bool)
        found = []
        if is_left.any() and not is_left.all():
            found = block_links(table.column("node").to_pylist(), table.column("component").to_pylist(), np.flatnonzero(is_left), np.flatnonzero(~is_left), table.column("text").to_pylist())
        return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})

    return stored(blocks.groupBy("key", "l", "r").applyInArrow(compare, "a binary, b binary").distinct(), "block-links")


def placed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, node, component) stored, a row for each row of ``docs``: node is its words' digest, component the least node of its class."""
    rows = sketched(docs, id_col, text_col)
    nodes = stored(rows.groupBy("node").agg(F.first("keys").alias("keys"), F.first("few").alias("few")), "nodes")
    members = stored(nodes.select("node", F.explode("keys").alias("key")).union(rarest(nodes)), "members")
    shared = stored(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    members = stored(members.join(shared, "key"), "mates")
    weight = members.groupBy("node").agg(F.sum("n").alias("weight"))
    members = stored(members.join(weight, "node"), "weighted")
    centres = members.groupBy("key").agg(F.max(F.struct("weight", "node")).alias("centre"))
    texts = node_texts(docs, text_col, stored(members.select("node").distinct(), "candidates"))

    best = members.join(centres, "key").groupBy("node").agg(F.max("centre").alias("centre"))
    links = verified(best.where("node <> centre.node").select(F.col("node").alias("a"), F.col("centre.node").alias("b")), texts)
    links = links.union(linked_in_blocks(members.select("key", "node"), components(links), texts))
    classes = components(links)
    placed = rows.select("doc_id", "node").join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return stored(placed.select("doc_id", "node", "component"), "classed")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, class_size, n_texts, kept), a row for each row of ``docs``.

    ``class_id`` is the least id of the class, ``n_texts`` how many different texts it has, ``kept`` whether the row has that id.
    """
    placed = placed_rows(docs, id_col, text_col)
    per_node = placed.groupBy("component", "node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    per_class = per_node.groupBy("component").agg(
        F.min("least").alias("class_id"), F.sum("n").alias("class_size"), F.count(F.lit(1)).alias("n_texts")
    )
    return placed.join(per_class, "component").select(
        "doc_id", "class_id", "class_size", "n_texts", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, with all its columns: the one with the least id; of repeated rows one."""
    placed = placed_rows(docs, id_col, text_col)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node")
    winners = stored(placed.groupBy("component", "node").agg(F.min(order).alias("w")).groupBy("component").agg(F.min("w").alias("w")).select("w.node", F.col("w.doc_id").alias("winner")), "winners")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    schema = StructType([*rows.schema.fields, StructField("node", BinaryType())])

    def scan(batches):
        for batch in batches:
            row = batch.column("row")
            yield pa.RecordBatch.from_arrays([row, pa.array(digests_of(row.field(row.type.get_field_index(text_col)).cast(pa.large_string())), pa.binary())], names=["row", "node"])

    return (
        rows.mapInArrow(scan, schema).join(winners, "node").where(F.col("row")[id_col].eqNullSafe(F.col("winner")))
        .groupBy("node").agg(F.first("row").alias("row")).select("row.*")
    )


def op3_near_dedup(spark, sf_dir):
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
