"""N-gram Jaccard join by vertical partitioning.

Every text becomes its set of distinct 5-word shingles (64-bit hashes).  Two
texts link when ``100 * |A n B| >= 75 * |A u B|``; the result names the
connected component of every document.

1.  One scan gives each document its set's size and a 128-bit digest; equal
    sets fall together by a plain aggregation, so copies cost nothing later.
2.  The global shingle order is cut into fragments (ranges of the hash).  A
    second scan deals every set's shingles to the fragments, packed in one row
    per block and fragment.  A fragment counts in how many different sets each
    of its shingles stands and passes on those in two sets or more.  Hot
    shingles are set aside: the scan counts, in every partition, the shingles that
    stand twice in some block of texts, Spark sums the counts of all partitions,
    and those in ``HOT_SHARE`` of all texts or more count as shared without being
    counted and come last in the order.  So no fragment gets a hot shingle's
    whole list.
3.  A linked set shares at least 75 % of its shingles.  Summing the fragments'
    partial counts per set drops all others, without loss.
4.  Sets that share a shingle of their prefixes (rarest first: any linked pair
    does) are chained to candidate groups.  A group is cut into blocks of
    bounded size by set size and hash; a cell holds two blocks (or one, or many
    small groups), and blocks whose sizes rule a link out never meet.  A cell
    cuts the shingle order into ``RANGES`` fragments, counts every pair's partial
    overlap in each fragment by itself through an inverted index, sums the
    partial overlaps per pair, and only then applies the threshold.  It hands on
    each set's number of linked documents and a spanning forest of the links,
    never the pairs.

``n_links`` is the number of other rows that a row is linked with, copies included.

Defined cases: null or empty texts and texts without words have size 0, link
with nothing and are their own component.  Equal texts (also under one id
repeated) link.  A row whose id is null is kept; it lends no name to its
component, and has a null component if all members' ids are null.  An empty
table gives an empty result.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .common import components, on_batches, on_group, saved, scope, small_or_shuffled

#: Bytes of text handled at once.
BLOCK = 4_000_000
#: Shingles of one fragment, and of one block of a candidate group, at most (about; 8 bytes each), and sets of such a block.
FRAGMENT, CELL, MEMBERS = 5_000_000, 1_000_000, 1024
#: Fragments of a cell; queries and additions handled at once.
RANGES, QUERIES, STEP = 8, 256, 2_000_000
#: A shingle is dense in a cell from one in so many sets on.
DENSE = 32
#: A shingle is hot from this share of all texts on, and this many; partitions tell their counts from LOCAL on.
HOT_SHARE, HOT_LEAST, LOCAL = 0.0005, 24, 6
#: Entries of a partition's table of counts at which its rare ones are dropped.
TABLE = 2_000_000
_HOT_DF = np.uint32(2**31)
_OVER = {"over": "ignore"}


def _sets(column: pa.Array, k: int):
    """Distinct shingles of each text of a block, with offsets and two digests."""
    w = wh.words(column)
    values, at = wh.shingle_hashes(w.hashes(), w.first, k)
    values, at = wh.distinct_by_text(values, at)
    n = np.diff(at)
    sums = []
    for salt in (0x51ED270B, 0x2545F491):
        run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(wh.mix(values ^ np.uint64(salt)))))
        sums.append(wh.mix((run[at[1:]] - run[at[:-1]]) + n.astype(np.uint64)).view(np.int64))
    return values, at, n, sums[0], sums[1]


def _merged(values: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    v, c = np.concatenate(values), np.concatenate(counts)
    order = np.argsort(v, kind="stable")
    v, c = v[order], c[order]
    head = np.flatnonzero(np.r_[True, v[1:] != v[:-1]]) if len(v) else np.zeros(0, int)
    return v[head], np.add.reduceat(c, head) if len(v) else c


def _scan(batches, k: int):
    """Rows of kind 0: a document's id, set size and digest; of kind 1: a shingle and in how many texts it was counted."""
    names = ["doc_id", "n", "k1", "k2", "hot", "texts"]
    held, counts, least = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 1
    with np.errstate(**_OVER):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i, j in wh.slices(texts, BLOCK):
                values, _, n, k1, k2 = _sets(texts.slice(i, j - i), k)
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(n), pa.array(k1), pa.array(k2), pa.nulls(j - i, pa.int64()), pa.nulls(j - i, pa.int64())], names)
                values.sort()
                twice = np.unique(values[1:][values[1:] == values[:-1]])
                held.append(twice)
                counts.append(np.searchsorted(values, twice, "right") - np.searchsorted(values, twice, "left"))
                if sum(map(len, held)) > TABLE:
                    v, c = _merged(held, counts)
                    while np.count_nonzero(c > least) > TABLE // 2:
                        least += 1
                    held, counts = [v[c > least]], [c[c > least]]
        v, c = _merged(held, counts)
        v, c = v[c >= LOCAL], c[c >= LOCAL]
        empty = pa.nulls(len(v), pa.int64())
        yield pa.RecordBatch.from_arrays([empty, empty, empty, empty, pa.array(v.view(np.int64)), pa.array(c)], names)


def _bytes(parts: list[np.ndarray]) -> pa.Array:
    return pa.array([p.tobytes() for p in parts], pa.binary())


def _array(column: pa.ChunkedArray, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_buffer().to_pybytes() for x in column), dtype=dtype)


def _deal(batches, k: int, fragments: int, hot: np.ndarray):
    """Deal each set's shingles to the fragments; a block's copies go once."""
    with np.errstate(**_OVER):
        for batch in batches:
            for i, j in wh.slices(batch.column(0), BLOCK):
                values, at, n, k1, _ = _sets(batch.column(0).slice(i, j - i), k)
                # Sets of one or two shingles link with equal ones alone (three of four reach the threshold).
                _, first = np.unique(k1, return_index=True)
                use = np.zeros(len(n), dtype=bool)
                use[first] = True
                use &= n > 2
                owner = np.repeat(np.arange(len(n)), n)
                keep = use[owner]
                values, owner = values[keep], owner[keep]
                if not len(values):
                    continue
                to = ((values >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)
                if len(hot):
                    pos = np.minimum(np.searchsorted(hot, values), len(hot) - 1)
                    is_hot = hot[pos] == values
                    to[is_hot] = fragments + (k1[owner[is_hot]].view(np.uint64) % np.uint64(fragments)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                values, owner, to = values[order], owner[order], to[order]
                cut = np.concatenate((np.flatnonzero(np.r_[True, to[1:] != to[:-1]]), [len(to)]))
                rows = {x: [] for x in ("dest", "keys", "sizes", "counts", "shingles")}
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    o = owner[a:b]
                    head = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
                    rows["dest"].append(int(to[a]))
                    rows["keys"].append(k1[o[head]])
                    rows["sizes"].append(n[o[head]].astype(np.int32))
                    rows["counts"].append(np.diff(np.r_[head, b - a]).astype(np.int32))
                    v = values[a:b]
                    # The fragment implies the first byte.
                    rows["shingles"].append(v if to[a] >= fragments else np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8)[:, :7]))
                yield pa.RecordBatch.from_arrays([pa.array(rows["dest"], pa.int64()), *(_bytes(rows[x]) for x in ("keys", "sizes", "counts", "shingles"))], list(rows))


def _shared(group: pa.Table, fragments: int, homes: int) -> pa.Table:
    """A fragment's shingles that stand in two sets or more, dealt to their sets' homes."""
    dest = group.column("dest")[0].as_py()
    keys, sizes, counts = (_array(group.column(x), t) for x, t in (("keys", np.int64), ("sizes", np.int32), ("counts", np.int32)))
    owner = np.repeat(np.arange(len(keys), dtype=np.int32), counts)
    if dest >= fragments:
        values = _array(group.column("shingles"), np.uint64).copy()
        # A hot set may come from several blocks.
        order = np.lexsort((values, keys[owner]))
        values, owner = values[order], owner[order]
        own = keys[owner]
        fresh = np.r_[True, (values[1:] != values[:-1]) | (own[1:] != own[:-1])] if len(values) else np.zeros(0, bool)
        values, owner = values[fresh], owner[fresh]
        df = np.full(len(values), _HOT_DF)
    else:
        raw = _array(group.column("shingles"), np.uint8).reshape(-1, 7)
        wide = np.full((len(raw), 8), dest * 256 // fragments % 256, dtype=np.uint8)
        wide[:, :7] = raw
        values = wide.reshape(-1).view(np.uint64)
        del raw, wide
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        del order
        same = values[1:] == values[:-1]
        many = np.r_[False, same] | np.r_[same, False]
        values, owner = values[many], owner[many]
        own = keys[owner]
        order = np.lexsort((own, values))
        values, owner, own = values[order], owner[order], own[order]
        fresh = np.r_[True, (values[1:] != values[:-1]) | (own[1:] != own[:-1])] if len(values) else np.zeros(0, bool)
        values, owner = values[fresh], owner[fresh]
        head = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, int)
        each = np.diff(np.r_[head, len(values)])
        df = np.repeat(each, each).astype(np.uint32)
        values, owner, df = values[df > 1], owner[df > 1], df[df > 1]
    own = keys[owner]
    home = (own.view(np.uint64) % np.uint64(homes)).astype(np.int64)
    order = np.lexsort((own, home))
    values, owner, df, own, home = (x[order] for x in (values, owner, df, own, home))
    cut = np.concatenate((np.flatnonzero(np.r_[True, home[1:] != home[:-1]]), [len(home)])) if len(home) else np.zeros(1, int)
    rows = {x: [] for x in ("home", "keys", "sizes", "counts", "shingles", "dfs")}
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        o = own[a:b]
        head = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
        rows["home"].append(int(home[a]))
        rows["keys"].append(o[head])
        rows["sizes"].append(sizes[owner[a:b][head]])
        rows["counts"].append(np.diff(np.r_[head, b - a]).astype(np.int32))
        rows["shingles"].append(values[a:b])
        rows["dfs"].append(df[a:b])
    return pa.table([pa.array(rows["home"], pa.int64()), *(_bytes(rows[x]) for x in list(rows)[1:])], names=list(rows))


def _survivors(group: pa.Table, num: int, den: int) -> pa.Table:
    """Sets that share enough shingles, each with those and its prefix (rarest first)."""
    keys, sizes, counts = (_array(group.column(x), t) for x, t in (("keys", np.int64), ("sizes", np.int32), ("counts", np.int32)))
    values, df = _array(group.column("shingles"), np.uint64), _array(group.column("dfs"), np.uint32)
    own, n = np.repeat(keys, counts), np.repeat(sizes, counts)
    order = np.lexsort((values, own))
    own, n, values, df = own[order], n[order], values[order], df[order]
    head = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, int)
    tail = np.r_[head[1:], len(own)] if len(own) else head
    out = {x: [] for x in ("key", "n", "shingles", "prefix")}
    for a, b in zip(head.tolist(), tail.tolist(), strict=True):
        size = int(n[a])
        need = -(-num * size // den)
        if b - a >= need:
            out["key"].append(int(own[a]))
            out["n"].append(size)
            out["shingles"].append(values[a:b])
            out["prefix"].append(values[a:b][np.lexsort((values[a:b], df[a:b]))[: b - a - need + 1]])
    return pa.table([pa.array(out["key"], pa.int64()), pa.array(out["n"], pa.int32()), _bytes(out["shingles"]), _bytes(out["prefix"])], names=list(out))


def _postings(batches):
    for batch in batches:
        size = np.array([len(x) // 8 for x in batch.column("prefix").to_pylist()], dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(_array(batch.column("prefix"), np.int64)), pa.array(np.repeat(batch.column("key").to_numpy(), size))], ["shingle", "key"])


def _partial(total: np.ndarray, owner: np.ndarray, post: np.ndarray, head: np.ndarray, each: np.ndarray, ask: np.ndarray, number: np.ndarray) -> None:
    """Add one fragment's overlaps: entries ``owner`` (sets) by shingle ``post``, whose list begins at ``head`` and has ``each`` entries.

    Shingles that stand in a good part of the cell's sets are counted as a product of incidence matrices, others by their lists.
    """
    width = total.shape[1]
    dense = each[post] * DENSE >= max(width, 2 * DENSE)
    at, code = np.unique(post[dense], return_inverse=True)
    sets = owner[dense]
    for c in range(0, len(at), 1024):
        some = (code >= c) & (code < c + 1024)
        m = np.zeros((min(1024, len(at) - c), width), np.float32)
        m[code[some] - c, sets[some]] = 1
        total += (m[:, ask].T @ m).astype(np.int32)
    # Entries of queries whose shingle stands in another set too, by query.
    e = np.flatnonzero((number[owner] >= 0) & (each[post] > 1) & ~dense)
    e = e[np.argsort(number[owner[e]], kind="stable")]
    asks = number[owner[e]]
    for q in range(0, len(ask), QUERIES):
        rows = total[q : q + QUERIES].ravel()
        some = e[np.searchsorted(asks, q) : np.searchsorted(asks, q + QUERIES)]
        size = each[post[some]]
        ends = np.cumsum(size)
        i = 0
        while i < len(some):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + STEP, "right")))
            t, s = some[i:j], size[i:j]
            entry = np.repeat(head[post[t]] - (np.cumsum(s) - s), s) + np.arange(int(s.sum()))
            pair = np.repeat((number[owner[t]] - q) * width, s) + owner[entry]
            if len(pair) * 4 > len(rows):
                rows += np.bincount(pair, minlength=len(rows)).astype(np.int32)
            else:
                np.add.at(rows, pair, 1)
            i = j


def _overlaps(group: pa.Table, num: int, den: int) -> pa.Table:
    """A cell's links: rows ``(u, v, null)`` of a spanning forest, and ``(u, null, documents linked with u here)``."""
    order = pc.sort_indices(group, [("key", "ascending")])
    group = group.take(order)
    key, n, copies = (group.column(x).to_numpy().astype(np.int64) for x in ("key", "n", "copies"))
    mine = group.column("own").to_numpy(zero_copy_only=False)  # of the cell's first block
    within = group.column("within")[0].as_py()
    count = np.array([len(x) // 8 for x in group.column("shingles").to_pylist()], dtype=np.int64)
    values = wh.mix(_array(group.column("shingles"), np.uint64))
    owner = np.repeat(np.arange(len(key)), count)
    # Inverted index: the sets of each shingle, in the (mixed) order of shingles, so a fragment is a stretch of it.
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    head = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, int)
    tail = np.r_[head[1:], len(values)] if len(values) else head
    post = np.repeat(np.arange(len(head)), tail - head)  # the shingle of every entry
    each = tail - head
    cuts = np.searchsorted(values, [np.uint64(((1 << 64) - 1) // RANGES * i) for i in range(RANGES)], "left").tolist() + [len(values)]
    ask = np.flatnonzero(mine)
    number = np.full(len(key), -1)
    number[ask] = np.arange(len(ask))
    width = len(key)
    total = np.zeros((len(ask), width), dtype=np.int32)  # overlaps, summed over the fragments
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        _partial(total, owner[a:b], post[a:b], head - a, each, ask, number)
    parent = list(range(len(key)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    linked = np.zeros(len(key), np.int64)
    left, right = [], []
    for q in range(0, len(ask), QUERIES):
        rows = total[q : q + QUERIES].ravel()
        hit = np.flatnonzero(rows)
        x, y = ask[q + hit // width], hit % width
        ok = (den + num) * rows[hit].astype(np.int64) >= num * (n[x] + n[y])
        # Inside one block every pair is met twice; a set is no partner of its own.
        ok &= (x < y) if within else ~mine[y]
        x, y = x[ok], y[ok]
        np.add.at(linked, x, copies[y])
        np.add.at(linked, y, copies[x])
        for u, v in zip(x.tolist(), y.tolist(), strict=True):
            if (a := root(u)) != (c := root(v)):
                parent[max(a, c)] = min(a, c)
                left.append(key[u]), right.append(key[v])
    some = np.flatnonzero(linked)
    u = np.concatenate((np.array(left, np.int64), key[some]))
    v = pa.array([*right, *[None] * len(some)], pa.int64())
    return pa.table([pa.array(u), v, pa.array([*[None] * len(left), *linked[some].tolist()], pa.int64())], names=["u", "v", "docs"])


def _cells(joined: DataFrame, num: int, den: int) -> DataFrame:
    """Sets with the cells they go to, and whether they are of a cell's first block.

    A set's class is the power of ``den / num`` that its size lies in, so linked sets are of one class or of neighbouring
    ones; the sets of a group's class are cut into blocks by hash.  A group of one small block in all is put with others.
    """
    step = math.log(den / num)
    sized = joined.withColumn("class", F.floor(F.log(F.col("n").cast("double")) / step + 1e-9))
    groups = joined.groupBy("root").agg(F.count("*").alias("members"), F.sum("size").alias("total")).withColumn("small", (F.col("members") <= MEMBERS) & (F.col("total") <= CELL))
    # A row a group, and a row a class of a large group: broadcast where small, so that a large group's sets are not dealt by it.
    groups = small_or_shuffled(groups, "groups")
    members, total = groups.where("small").agg(F.coalesce(F.sum("members"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    buckets = max(4, math.ceil(members / (MEMBERS / 2)), math.ceil(total / (CELL / 2)))
    columns = ["key", "n", "copies", "shingles"]
    tagged = sized.join(groups.select("root", "small"), "root")
    small = tagged.where("small").select(F.concat(F.lit("s"), F.pmod(F.xxhash64("root"), F.lit(buckets)).cast("string")).alias("cell"), F.lit(True).alias("own"), F.lit(True).alias("within"), *columns)
    large = tagged.where("NOT small")
    blocks = large.groupBy("root", "class").agg(F.greatest(F.ceil(F.count("*") / (MEMBERS / 2)), F.ceil(F.sum("size") / (CELL / 2))).cast("long").alias("blocks"))
    blocks = small_or_shuffled(blocks, "blocks")
    large = large.join(blocks, ["root", "class"]).withColumn("b", F.pmod(F.xxhash64("key"), F.col("blocks")))
    # Both sides of a cell are named by class and block, the smaller name first; a set meets all blocks of its own and the neighbouring classes.
    other = blocks.select("root", F.col("class").alias("c"), F.col("blocks").alias("n_c"))
    met = large.withColumn("c", F.explode(F.expr("array(class - 1, class, class + 1)"))).join(other, ["root", "c"]).withColumn("o", F.explode(F.expr("sequence(0L, n_c - 1)")))
    own, far = F.struct(F.col("class").alias("c"), F.col("b").alias("o")), F.struct("c", "o")
    name = lambda x: F.concat_ws(".", x["c"].cast("string"), x["o"].cast("string"))
    first, second = F.when(own <= far, name(own)).otherwise(name(far)), F.when(own <= far, name(far)).otherwise(name(own))
    met = met.select(F.concat_ws(":", "root", first, second).alias("cell"), (own <= far).alias("own"), (own == far).alias("within"), *columns)
    return small.union(met)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 3, den: int = 4) -> DataFrame:
    """``(doc_id, n_shingles, component_id, n_links)`` for every row of ``docs``; links at ``|A n B| / |A u B| >= num / den``.

    Eager: intermediate tables go to the shared folder.  ``docs`` is read twice.
    """
    spark = docs.sparkSession
    # Of the tables written on the way only the two that the result reads are kept.
    with scope(spark) as made:
        base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        scan, scan_path = saved(base.mapInArrow(on_batches(_scan, k=k), "doc_id long, n long, k1 long, k2 long, hot long, texts long"), "sets")
        sets = scan.where("n is not null").select("doc_id", "n", "k1", "k2")
        rows, total = sets.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        # The size bound: shingles in a share of all texts; their number is below the mean set's size divided by that share.
        found = scan.where("hot is not null").groupBy("hot").agg(F.sum("texts").alias("c")).where(F.col("c") >= max(HOT_LEAST, rows * HOT_SHARE)).select("hot")
        hot = np.sort(found.toArrow().column("hot").to_numpy().view(np.uint64))
        cuts = max(4, math.ceil(total / FRAGMENT))
        dealt = base.select("text").mapInArrow(on_batches(_deal, k=k, fragments=cuts, hot=hot), "dest long, keys binary, sizes binary, counts binary, shingles binary")
        shared = dealt.groupBy("dest").applyInArrow(on_group(_shared, fragments=cuts, homes=cuts), "home long, keys binary, sizes binary, counts binary, shingles binary, dfs binary")
        alive, _ = saved(shared.groupBy("home").applyInArrow(on_group(_survivors, num=num, den=den), "key long, n int, shingles binary, prefix binary"), "alive")

        posts, _ = saved(alive.select("key", "prefix").mapInArrow(on_batches(_postings), "shingle long, key long"), "prefix")
        least = posts.groupBy("shingle").agg(F.min("key").alias("m"), F.max("key").alias("top")).where("m < top").select("shingle", "m")
        chained = posts.join(least, "shingle").select(F.col("key").alias("u"), F.col("m").alias("v"))
        groups = components(chained)
        classes, _ = saved(sets.where("n > 0").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
        joined = alive.select("key", "n", "shingles", (F.length("shingles") / 8).cast("long").alias("size")).join(groups.withColumnRenamed("node", "key"), "key")
        joined = joined.join(classes.groupBy(F.col("k1").alias("key")).agg(F.sum("copies").alias("copies")), "key")
        links, _ = saved(_cells(joined, num, den).groupBy("cell").applyInArrow(on_group(_overlaps, num=num, den=den), "u long, v long, docs long"), "links")
        degrees = links.where("v is null").groupBy(F.col("u").alias("k1")).agg(F.sum("docs").alias("docs"))

        roots = components(links.where("v is not null").select("u", "v")).withColumnRenamed("node", "k1")
        named = classes.join(roots, "k1", "left").join(degrees, "k1", "left").withColumn("root", F.coalesce("root", "k1"))
        least_id = small_or_shuffled(named.groupBy("root").agg(F.min("rep").alias("component_id")), "roots")
        named, named_path = saved(named.join(least_id, "root").select("n", "k1", "k2", "component_id", (F.coalesce("docs", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "named")
        made.remove(scan_path)
        made.remove(named_path)
    full = sets.where("n > 0").join(named, ["n", "k1", "k2"], "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")
    return full.union(sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links")))
