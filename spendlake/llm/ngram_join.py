"""Near-duplicate join on word n-gram Jaccard similarity with adaptive multi-match prefixes.

Shingles are ordered by an estimate of their frequency, rare ones first. Two documents of similarity t share at least
l shingles among the first ``n - ceil(t n) + l`` of each, for every l. A document whose prefix is expected to meet
many others takes a larger l: its prefix grows by one shingle per step, and so does what it must share.

Documents with one and the same set are one class. Posting lists of prefix shingles give the candidates: documents
that meet often share a block of bounded size. First every block is compared with itself and with the leader of its
family, so the text of a near copy travels once and a family of any size becomes one component. What is linked then
need not meet again: a document is compared with a further block only if the shingles it shares with members of other
components there reach the matches its prefix asks for. No pairs are listed; a task gets the documents of two blocks at
most, counts all their intersections by matrix products, and returns links that span what it found.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlake.llm.bloom import held, may_hold
from spendlake.llm.common import arrow_map, spread_join, staged, tuned
from spendlake.llm.components import components
from spendlake.llm.words import WordHasher, mix, shingle_sets

SIZE, PERCENT = 5, 75
#: Counters of the frequency estimate (its size and that of its broadcast are fixed by this, in bytes).
CELLS = 1 << 23
BLOCK = 1 << 15
#: Cost of verifying a candidate in posting-list entries, and how fast candidates fall with the share of a set asked for.
VERIFY_COST, FALL = 200.0, 3.0

_NULL = -(1 << 63)
_SKETCH = pa.schema([("block", pa.int32()), ("counts", pa.binary())])
_LISTS = pa.schema([("doc", pa.int64()), ("digest", pa.binary()), ("n", pa.int32()), ("ell", pa.int32()), ("level", pa.int32()), ("last", pa.int64()), ("bits", pa.binary()), ("prefix", pa.list_(pa.int64()))])


def least_overlap(a, b, percent: int):
    """Smallest intersection of sets of sizes a and b with 100 * intersection >= percent * union."""
    return -((-percent * (a + b)) // (100 + percent))


def base_prefix(n, percent: int):
    """Shingles of a set of n that any linked set shares one with (0 for an empty set)."""
    return n - (-((-percent * n) // 100)) + (n > 0)


def _texts(batches, size):
    hasher = WordHasher()
    for batch in batches:
        ids = batch.column(0).fill_null(_NULL).to_numpy(zero_copy_only=False)
        yield ids, batch, shingle_sets(hasher, batch.column(1), size)


def _sketch(batches, size):
    cells, shift = np.zeros(CELLS, dtype=np.uint32), np.uint64(64 - CELLS.bit_length() + 1)
    for _, _, sets in _texts(batches, size):
        held, length = [], 0
        for s in sets:
            held.append(s)
            length += len(s)
            if length > 1 << 18:
                np.add.at(cells, (np.concatenate(held) >> shift).astype(np.int64), 1)
                held, length = [], 0
        if held:
            np.add.at(cells, (np.concatenate(held) >> shift).astype(np.int64), 1)
    if not cells.any():
        return
    parts = [zlib.compress(cells[k : k + BLOCK].tobytes(), 1) for k in range(0, CELLS, BLOCK)]
    yield pa.RecordBatch.from_pydict({"block": list(range(len(parts))), "counts": parts}, schema=_SKETCH)


def _add_sketches(batches):
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
            add = np.frombuffer(zlib.decompress(counts), dtype=np.uint32).astype(np.uint64)
            sums[block] = sums[block] + add if block in sums else add
    if sums:
        # Eighths of a power of two: what the order needs in one byte.
        levels = [np.minimum(255, np.round(8 * np.log2(1 + v.astype(np.float64)))).astype(np.uint8).tobytes() for v in sums.values()]
        yield pa.RecordBatch.from_pydict({"block": list(sums), "counts": levels}, schema=_SKETCH)


def frequency_levels(docs: DataFrame, size: int = SIZE) -> np.ndarray:
    """Log-scaled frequency estimate per cell over the distinct shingles of all documents; CELLS bytes."""
    parts = arrow_map(docs, partial(_sketch, size=size), "block int, counts binary").repartition("block")
    sums = arrow_map(parts, _add_sketches, "block int, counts binary")
    levels = np.zeros(CELLS, dtype=np.uint8)
    for row in sums.collect():
        levels[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = np.frombuffer(row["counts"], dtype=np.uint8)
    return levels


def _ordered(s: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles by estimated frequency, then by hash, and their levels."""
    own = levels[(s >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)]
    order = np.argsort(own, kind="stable")
    return s[order], own[order]


def matches_for(own: np.ndarray, base: int, noise: float) -> int:
    """Matches to ask for: least cost of reading the lists of the prefix and of verifying what still meets them.

    A list is as long as the estimate beyond the noise of its cell. Matches double up to the whole set.
    """
    n = len(own)
    lengths = np.maximum(0.0, np.exp2(own.astype(np.float64) / 8) - 1 - 1.5 * noise)
    read, best, cost, ell = lengths.cumsum(), 1, None, 1
    met = lengths[:base].max()
    while met > 16:
        c = read[base + ell - 2] + VERIFY_COST * met * np.exp(-FALL * (ell - 1) / n)
        if cost is None or c < cost:
            best, cost = ell, c
        if ell == n - base + 1:
            break
        ell = min(2 * ell, n - base + 1)
    return best


def bitmap(s: np.ndarray) -> bytes:
    """A bit per hash of a set, in two to four times as many bits as it has members (a power of two, 64 at least)."""
    width = 1 << max(6, (4 * len(s)).bit_length() - 1)
    bits = np.zeros(width, dtype=np.uint8)
    bits[(s & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def may_link(docs: np.ndarray, sizes: np.ndarray, maps: list[bytes], percent: int) -> np.ndarray:
    """Which documents may link with another one of these.

    A member that only one of two sets has changes one bit at most, so the bits that differ bound the members that do,
    and these the overlap. A larger bitmap folds to a smaller one; sets whose bitmaps differ by more than one fold
    differ too much in size.
    """
    ok = np.zeros(len(docs), dtype=bool)
    widths = np.array([len(m) for m in maps])
    for width in np.unique(widths):
        own = np.flatnonzero(widths == width)
        a = np.stack([np.frombuffer(maps[i], dtype=np.uint64) for i in own])
        wide = np.flatnonzero(widths == 2 * width)
        folded = [np.frombuffer(maps[i], dtype=np.uint64).reshape(2, -1) for i in wide]
        other = np.concatenate([a, *[(f[0] | f[1])[None, :] for f in folded]])
        at = np.concatenate([own, wide])
        for row, i in enumerate(own):
            differ = np.bitwise_count(a[row] ^ other[row:]).sum(axis=1, dtype=np.int64)
            j = at[row:]
            most = (sizes[i] + sizes[j] - differ) // 2
            met = (docs[j] != docs[i]) & (most >= least_overlap(sizes[i], sizes[j], percent))
            if met.any():
                ok[i] = True
                ok[j[met]] = True
    return ok


_ASKED = pa.schema([("key", pa.int64()), ("doc", pa.int64())])


def _plausible(batches, percent):
    """Rows (key, doc, n, bits) sorted by key: those that may link with another document of their key."""
    key, held = None, []

    def close():
        docs = np.array([h[0] for h in held], dtype=np.int64)
        ok = may_link(docs, np.array([h[1] for h in held], dtype=np.int64), [h[2] for h in held], percent)
        keep = np.unique(docs[ok])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keep), key)), pa.array(keep)], schema=_ASKED) if len(keep) else None

    for batch in batches:
        for own, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "doc", "n", "bits"))):
            if own != key:
                if len(held) > 1 and (out := close()) is not None:
                    yield out
                key, held = own, []
            held.append(row)
    if len(held) > 1 and (out := close()) is not None:
        yield out


def _prefixes(batches, size, percent, levels):
    known = levels.value
    used = known[known > 0]
    noise = float(np.exp2(np.median(used) / 8)) if len(used) else 0.0
    for ids, batch, sets in _texts(batches, size):
        rows = {f.name: [] for f in _LISTS}
        for doc, s in zip(ids.tolist(), sets):
            n = len(s)
            ordered, own = _ordered(s, known)
            base = int(base_prefix(n, percent))
            ell = matches_for(own, base, noise) if n else 1
            digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
            end = base + ell - 2
            # Where the prefix ends in the order; the hash is shifted, since the order takes it without a sign.
            level, last = (int(own[end]), int(ordered[end]) + _NULL) if n else (0, 0)
            for k, v in zip(rows, (doc, digest, n, ell, level, last, bitmap(s), ordered[: end + 1].view(np.int64) if n else [])):
                rows[k].append(v)
        yield pa.RecordBatch.from_pydict({k: pa.array(v, _LISTS.field(k).type) for k, v in rows.items()}, schema=_LISTS)


_LIST = pa.schema([("sig", pa.int64()), ("docs", pa.list_(pa.int64())), ("first", pa.int64()), ("long", pa.int32())])


def _shared_lists(batches):
    """Of postings sorted by token and document, the lists of tokens that several documents have.

    A list of at most PIECE documents is one row, signed by its content; a longer one is several rows signed by its token.
    """
    token, first, held, long_ = None, None, [], 0
    rows, size = {f.name: [] for f in _LIST}, 0

    def put(sig, docs, first, long_):
        nonlocal size
        for k, v in zip(rows, (sig, docs, first, long_)):
            rows[k].append(v)
        size += len(docs)

    def short(docs):
        digest = hashlib.blake2b(docs.tobytes(), digest_size=8).digest()
        put(int.from_bytes(digest, "little", signed=True), docs, docs[0], 0)

    def close():
        if held:
            docs = np.concatenate(held)
            if long_ or len(docs) > PIECE:
                put(token, docs, first, 1)
            elif docs[0] != docs[-1]:
                short(docs)

    def batch_of():
        nonlocal size
        out = pa.RecordBatch.from_pydict({k: pa.array(v, _LIST.field(k).type) for k, v in rows.items()}, schema=_LIST)
        for v in rows.values():
            v.clear()
        size = 0
        return out

    for batch in batches:
        t, d = batch.column("token").to_numpy(), batch.column("doc").to_numpy()
        if not len(t):
            continue
        start = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        end = np.r_[start[1:], len(t)]
        begin = 0
        if t[0] == token:
            held.append(d[: end[0]])
            if sum(map(len, held)) > PIECE:
                put(token, np.concatenate(held), first, 1)
                held, long_ = [], 1
            begin = 1
        if begin < len(start):
            close()
            last = len(start) - 1
            for i in begin + np.flatnonzero(d[start[begin:last]] != d[end[begin:last] - 1]):
                docs = d[start[i] : end[i]]
                if len(docs) > PIECE:
                    put(int(t[start[i]]), docs, docs[0], 1)
                else:
                    short(docs)
            token, held, long_ = int(t[start[last]]), [d[start[last] :]], 0
            first = held[0][0]
        if size > 50_000:
            yield batch_of()
    close()
    if rows["sig"]:
        yield batch_of()


#: Members of one piece of a posting list; longer lists are cut, and every two pieces meet as a list of their own.
PIECE = 1024
_RUN = pa.schema(
    [("sig", pa.int64()), ("doc", pa.list_(pa.int64())), ("n", pa.list_(pa.int32())), ("ell", pa.list_(pa.int32())),
     ("most", pa.list_(pa.int32())), ("block", pa.list_(pa.int64())), ("root", pa.list_(pa.int64())),
     ("home", pa.list_(pa.int64())), ("met", pa.list_(pa.int32())), ("piece", pa.list_(pa.int32())), ("cross", pa.int32()),
     ("weight", pa.int64())]
)
_MEMBER = ("doc", "n", "ell", "most", "block", "root", "home", "met", "piece")


def _runs(batches):
    """Lists, sorted by token, by their two pieces and by where prefixes end, as rows; equal lists get equal signatures.

    ``cross`` is 1 where a list is two pieces of a longer one: members of one piece meet elsewhere.
    """
    rows, size, key, weight, held = {f.name: [] for f in _RUN}, 0, None, 0, []

    def close():
        nonlocal size
        cols = [np.concatenate(c) for c in zip(*held)]
        if len(cols[0]) > 1:
            cross = int(key[1] != key[2])
            sig = hashlib.blake2b(b"".join(c.tobytes() for c in cols) + bytes([cross]), digest_size=8).digest()
            for k, v in zip(rows, (int.from_bytes(sig, "little", signed=True), *cols, cross, weight)):
                rows[k].append(v)
            size += len(cols[0])

    def batch_of():
        nonlocal size
        out = pa.RecordBatch.from_pydict({k: pa.array(v, _RUN.field(k).type) for k, v in rows.items()}, schema=_RUN)
        for v in rows.values():
            v.clear()
        size = 0
        return out

    for batch in batches:
        names = [batch.column(k).to_numpy() for k in ("token", "lo", "hi")]
        cols, weights = [batch.column(k).to_numpy() for k in _MEMBER], batch.column("weight").to_numpy()
        change = np.zeros(max(len(names[0]) - 1, 0), dtype=bool)
        for c in names:
            change |= np.diff(c) != 0
        cut = np.flatnonzero(change) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(names[0])]):
            if a == b:
                continue
            if (own := tuple(int(c[a]) for c in names)) != key:
                if held:
                    close()
                key, weight, held = own, int(weights[a]), []
            held.append([v[a:b] for v in cols])
        if size > 50_000:
            yield batch_of()
    if held:
        close()
    if rows["sig"]:
        yield batch_of()


_MEET = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("need", pa.int32()), ("shared", pa.int64())])


def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number for an unordered pair of blocks."""
    a, b = a.astype(np.uint64), b.astype(np.uint64)
    with np.errstate(over="ignore"):
        return mix(mix(np.minimum(a, b)) * np.uint64(3) + np.maximum(a, b)).astype(np.int64)


def _meetings(batches, percent):
    """Per run and member the blocks that hold a possible partner, and the least matches a partner there asks for.

    Members of one root are linked already, and members of one home that both met meet without lists.
    """
    for batch in batches:
        columns, out = [batch.column(k) for k in _MEMBER], []
        for row, (cross, weight) in enumerate(zip(batch.column("cross").to_pylist(), batch.column("weight").to_pylist())):
            doc, n, ell, most, block, root, home, met, piece = (np.asarray(c[row].values).astype(np.int64) for c in columns)
            alpha = least_overlap(n[:, None], n[None, :], percent)
            # The prefix that ends first is that of the earlier member; only its document's bound holds.
            first = np.minimum(np.arange(len(doc))[:, None], np.arange(len(doc))[None, :])
            ok = (root[:, None] != root[None, :]) & (alpha <= most[first])
            ok &= (home[:, None] != home[None, :]) | (met[:, None] & met[None, :] == 0)
            if cross:
                ok &= piece[:, None] != piece[None, :]
            # What two prefixes share, and all that stands behind the one that ends first, bounds the overlap.
            behind = -(-percent * n // 100) - ell
            need = np.where(ok, alpha - behind[first], np.iinfo(np.int32).max)
            names, at = np.unique(block, return_inverse=True)
            order = np.argsort(at, kind="stable")
            least = np.minimum.reduceat(need[:, order], np.searchsorted(at[order], np.arange(len(names))), axis=1)
            d, b = np.nonzero(least < np.iinfo(np.int32).max)
            if len(d):
                out.append((_key(block[d], names[b]), doc[d], least[d, b], np.full(len(d), weight)))
        if out:
            yield _summed(out)


def _summed(found):
    key, doc, need, shared = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((doc, key))
    key, doc, need, shared = key[order], doc[order], need[order], shared[order]
    first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
    return pa.RecordBatch.from_arrays(
        [pa.array(key[first]), pa.array(doc[first]), pa.array(np.minimum.reduceat(need, first), pa.int32()),
         pa.array(np.add.reduceat(shared, first), pa.int64())],
        schema=_MEET,
    )


def _held(batches, bits):
    for batch in batches:
        ok = held(bits.value, batch.column(0).fill_null(_NULL).to_numpy(zero_copy_only=False))
        if ok.any():
            yield batch.filter(pa.array(ok))


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def overlaps(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0/1 matrices over the shingles that repeat."""
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    token, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(v) for v in sets])
    again = count[place] > 1
    number = (count > 1).cumsum() - 1
    owner, place = owner[again], number[place[again]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    for start in range(0, int((count > 1).sum()), columns):
        a, b = np.searchsorted(place, (start, start + columns))
        part = np.zeros((len(sets), columns), dtype=np.float32)
        part[owner[a:b], place[a:b] - start] = 1
        out += part @ part.T
    return out


def _spanning(docs: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links among a key's documents, without those that connect what is connected. Rows may share an id."""
    sizes = np.array([len(v) for v in sets])
    shared = overlaps(sets)
    linked = (100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)) & (shared > 0)
    up: dict[int, int] = {}

    def top(v):
        while (w := up.get(v, v)) != v:
            up[v] = up.get(w, w)
            v = w
        return v

    out = []
    for i, j in zip(*np.nonzero(np.triu(linked, 1))):
        a, b = top(docs[i]), top(docs[j])
        if a != b:
            up[a] = b
            out.append((docs[i], docs[j]))
    return out


def _verify(batches, size, percent):
    """Rows (key, doc, text) sorted by key: the links found among the documents of each key."""
    hasher, key, docs, sets = WordHasher(), None, [], []
    found: list[tuple[int, int]] = []
    for batch in batches:
        for own, doc, s in zip(batch.column("key").to_pylist(), batch.column("doc").to_pylist(), shingle_sets(hasher, batch.column("text"), size)):
            if own != key:
                if len(docs) > 1:
                    found += _spanning(docs, sets, percent)
                key, docs, sets = own, [], []
            docs.append(doc)
            sets.append(s)
    if len(docs) > 1:
        found += _spanning(docs, sets, percent)
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*found)], schema=_LINK)


#: Documents of one block, about; two blocks at most meet in a task.
BLOCK_DOCS = 192


def blocks(postings: DataFrame, asks: DataFrame) -> DataFrame:
    """``doc, block, leader, met``: documents that most often share a list's first document share a block of bounded size.

    That first document leads the family and all its blocks. ``met`` is 1 for documents that share as many shingles
    with their leader as their prefix asks for (``asks``: doc, ell): these are worth comparing at once.
    """
    met = postings.groupBy("doc", "first").agg(F.sum("weight").alias("c"))
    family = met.groupBy("doc").agg(F.max(F.struct("c", "first")).alias("f")).join(asks, "doc")
    family = family.select("doc", F.col("f.first").alias("leader"), (F.col("f.c") >= F.col("ell")).cast("int").alias("met"))
    parts = family.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS).alias("parts"))
    rows = spread_join(family, parts, ["leader"], F.xxhash64("doc"), "inner")
    part = F.xxhash64("leader", F.pmod(F.xxhash64("doc"), F.col("parts")))
    return rows.select("doc", part.alias("block"), "leader", "met")


def _compared(slim: DataFrame, listed: DataFrame, asked: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links that span what the documents of each key of ``asked`` (``key, doc``) have, and the rows that may have any.

    Bitmaps meet first, at a tenth of the bytes; texts are fetched for documents that may link with one of their key.
    """
    maps = listed.select("doc", "n", "bits").join(asked, "doc").select("key", "doc", "n", "bits")
    maps = maps.repartition("key").sortWithinPartitions("key", "doc")
    asked = staged(arrow_map(maps, partial(_plausible, percent=percent), "key long, doc long"), "near-plausible")
    bits = slim.sparkSession.sparkContext.broadcast(may_hold(asked.select("doc").distinct()))
    texts = arrow_map(slim, partial(_held, bits=bits), "doc long, text string")
    rows = texts.join(asked, "doc").select("key", "doc", "text").repartition("key").sortWithinPartitions("key", "doc")
    return staged(arrow_map(rows, partial(_verify, size=size, percent=percent), "a long, b long"), "near-links"), asked


#: A family is close where one in so many of its members may link with another member of its block.
CLOSE = 8


def _close_families(homes: DataFrame, plausible: DataFrame, roots: DataFrame) -> DataFrame:
    """``doc, block, met, root, home``: members within one ``home`` that both met need no list to meet.

    That is a block, or a whole family of several blocks if it is close: its lists would hold all its members. A close family
    counts members that have not met as met, unless they outnumber the others: ``_rest_of_families`` compares them with every
    block, while a few of them in each list would keep all the family's lists open.
    """
    met = F.col("met") == 1
    hopeful = homes.join(plausible.select("doc").distinct().withColumn("hopeful", F.lit(1)), "doc", "left")
    close = hopeful.groupBy("leader").agg(
        F.count_if(met).alias("c"), F.count(F.when(met, F.col("hopeful"))).alias("h"), F.count(F.lit(1)).alias("members"),
        F.min(F.when(met, F.col("block"))).alias("low"), F.max(F.when(met, F.col("block"))).alias("high"),
    ).where((F.col("low") != F.col("high")) & (CLOSE * F.col("h") >= F.col("c")))
    close = close.select("leader", F.lit(True).alias("close"), (F.col("members") <= 2 * F.col("c")).alias("whole"))
    placed = homes.join(roots.withColumnRenamed("node", "doc"), "doc", "left").withColumn("root", F.coalesce("root", "doc"))
    placed = spread_join(placed, close, ["leader"], F.xxhash64("doc"), "left")
    placed = placed.withColumn("met", F.when(F.col("whole"), F.lit(1)).otherwise(F.col("met")))
    home = F.when(F.col("close"), F.xxhash64("leader", F.lit("family"))).otherwise(F.col("block"))
    return placed.select("doc", "leader", "block", "met", "root", "close", home.alias("home"))


def _rest_of_families(placed: DataFrame) -> DataFrame:
    """``key, doc`` of close families: members outside the family's largest component meet every block.

    Members of that component are linked already, so a family that one leader has linked is not compared again.
    """
    members = placed.where("met = 1 AND close")
    main = members.groupBy("leader", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("leader").agg(F.max(F.struct("c", "root"))["root"].alias("main"))
    members = staged(spread_join(members, main, ["leader"], F.xxhash64("doc"), "inner").select("doc", "leader", "block", F.expr("root <> main").alias("open")), "near-families")
    parts = members.where("open").groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS).cast("int").alias("parts"))
    known = spread_join(members, parts, ["leader"], F.xxhash64("doc"), "inner")
    key = lambda part: F.xxhash64(F.lit("rest"), "block", part)
    all_ = known.select("block", "doc", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    open_ = known.where("open").select("leader", "doc", F.pmod(F.xxhash64("doc", F.lit("part")), F.col("parts")).cast("int").alias("part"))
    blocks_ = members.select("leader", "block").distinct()
    met = open_.join(blocks_, "leader").select("block", "doc", "part")
    return all_.unionByName(met).select(key(F.col("part")).alias("key"), "doc").distinct()


def _is_copied(batches, bits, copied):
    """Rows whose digest may be one of several documents, or those whose digest cannot."""
    for batch in batches:
        ok = held(bits.value, batch.column("h").to_numpy()) == copied
        if ok.any():
            yield batch.filter(pa.array(ok)).drop_columns(["h"])


def _classes(listed: DataFrame) -> DataFrame:
    """``doc, n, ell, prefix`` of one document per set, the one with the smallest id.

    Only sets that may have copies are shuffled with their prefixes.
    """
    key = F.xxhash64("digest")
    copied = listed.groupBy("digest").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    bits = listed.sparkSession.sparkContext.broadcast(may_hold(copied.select(key.alias("h"))))
    rows = listed.select(key.alias("h"), "digest", "doc", "n", "ell", "prefix")
    schema = "digest binary, doc long, n int, ell int, prefix array<long>"
    alone = arrow_map(rows, partial(_is_copied, bits=bits, copied=False), schema)
    several = arrow_map(rows, partial(_is_copied, bits=bits, copied=True), schema)
    first = several.groupBy("digest").agg(F.min(F.struct("doc", "n", "ell", "prefix")).alias("r"))
    return alone.select("doc", "n", "ell", "prefix").unionByName(first.select("r.*"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``.

    Words are maximal runs without space, tab and line controls, A-Z lower-cased; a set holds the distinct runs of
    ``size`` words, or the whole text if it has fewer. Two sets link when 100 * intersection >= percent * union.
    ``component_id`` is the smallest id reachable by links. Null, empty and wordless texts have no shingles and link
    with nothing. Rows that share an id are one node of the graph; a null id gets a null component.
    Other columns are not read; an empty table gives an empty result.
    """
    spark = tuned(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    levels = spark.sparkContext.broadcast(frequency_levels(slim, size))
    listed = staged(
        arrow_map(slim, partial(_prefixes, size=size, percent=percent, levels=levels), "doc long, digest binary, n int, ell int, level int, last long, bits binary, prefix array<long>"),
        "near-prefixes",
    )
    # One class per set: its smallest id stands for it, and copies are folded before they travel.
    named = (F.col("n") > 0) & (F.col("doc") != _NULL)
    sets = _classes(listed.where(named))
    postings = sets.select(F.explode("prefix").alias("token"), "doc").repartition("token").sortWithinPartitions("token", "doc")
    lists = staged(arrow_map(postings, _shared_lists, "sig long, docs array<long>, first long, long int"), "near-lists")
    # The shingles of a shared passage have equal lists: one of them stands for all, with their number as its weight.
    equal = lists.where("long = 0").groupBy("sig").agg(
        F.first("docs").alias("docs"), F.first("first").alias("first"), F.count(F.lit(1)).alias("weight")
    )
    apart = lists.where("long = 1").select("sig", "docs", "first", F.lit(1).cast("long").alias("weight"))
    shared = equal.unionByName(apart).select(F.col("sig").alias("token"), "first", "weight", F.explode("docs").alias("doc"))
    shared = staged(shared, "near-postings")
    # Families first: a text travels once, to its block, where it meets the leader of its family.
    homes = staged(blocks(shared, listed.where(named).groupBy("doc").agg(F.max("ell").alias("ell"))), "near-blocks")
    at_home = homes.where("met = 1").select(F.col("block").alias("key"), "doc")
    leaders = homes.where("met = 1").select(F.col("block").alias("key"), F.col("leader").alias("doc"))
    at_home = staged(at_home.unionByName(leaders).distinct(), "near-homes")
    links, plausible = _compared(slim, listed, at_home, size, percent)
    # What is linked need not meet again: only lists with documents of several roots are looked at.
    placed = staged(_close_families(homes, plausible, components(links)), "near-places")
    facts = _bounds(shared, listed.where(named), percent).join(placed.drop("leader", "close"), "doc")
    lists = shared.drop("first").join(facts, "doc")
    open_ = lists.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("c"),
                                         F.min("home").alias("from"), F.max("home").alias("to"), F.min("met").alias("met"))
    open_ = open_.where("low <> high AND (from <> to OR met = 0)").select("token", F.ceil(F.col("c") / PIECE).cast("int").alias("pieces"))
    lists = lists.join(open_, "token")
    lists = lists.withColumn("piece", F.pmod(F.xxhash64("doc"), F.col("pieces")).cast("int"))
    lists = lists.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    lists = lists.withColumn("lo", F.least("piece", "other")).withColumn("hi", F.greatest("piece", "other")).select(
        "token", "lo", "hi", "level", "last", "weight", *_MEMBER
    )
    runs = arrow_map(
        lists.repartition("token", "lo", "hi").sortWithinPartitions("token", "lo", "hi", "level", "last", "doc"), _runs,
        "sig long, doc array<long>, n array<int>, ell array<int>, most array<int>, block array<long>, root array<long>, "
        "home array<long>, met array<int>, piece array<int>, cross int, weight long",
    )
    # Near copies share many shingles whose lists are equal: one row stands for all of them.
    merged = runs.groupBy("sig").agg(
        *[F.first(c).alias(c) for c in (*_MEMBER, "cross")], F.sum("weight").alias("weight")
    )
    meet = arrow_map(merged, partial(_meetings, percent=percent), "key long, doc long, need int, shared long")
    meet = meet.groupBy("key", "doc").agg(F.sum("shared").alias("shared"), F.min("need").alias("need")).where("shared >= need")
    meet = staged(meet.select("key", "doc").unionByName(_rest_of_families(placed)), "near-meetings")
    links = links.unionByName(_compared(slim, listed, meet, size, percent)[0])
    return _labelled(listed, components(links))


def _bounds(lists: DataFrame, listed: DataFrame, percent: int) -> DataFrame:
    """Per document of the lists its size, its matches, where its prefix ends (``level, last``) and ``most``.

    A prefix shingle that no other prefix holds is in no document whose prefix ends later, but one whose prefix ends
    earlier may hold it behind that. So ``most``, which leaves such shingles out, bounds the overlap with the former only.
    Of rows that share an id each has a bound, over the lists of all of them.
    """
    held = lists.groupBy("doc").agg(F.sum("weight").alias("c"))
    variants = listed.select("doc", "n", "ell", "level", "last").distinct()
    # A prefix has n - least + ell shingles; behind it are least - ell.
    most = F.ceil(F.col("n") * percent / 100) - F.col("ell") + F.col("c")
    return variants.join(held, "doc").select("doc", "n", "ell", most.cast("int").alias("most"), "level", "last")


def _labelled(listed: DataFrame, comp: DataFrame) -> DataFrame:
    """Every row with its component; rows of one set share the set's smallest id before the graph is asked."""
    classes = listed.where((F.col("n") > 0) & (F.col("doc") != _NULL)).groupBy("digest").agg(F.min("doc").alias("class"), F.count(F.lit(1)).alias("copies"))
    rooted = classes.join(comp.withColumnRenamed("node", "class"), "class", "left").where("copies > 1 OR root IS NOT NULL")
    rooted = rooted.select("digest", F.coalesce("root", "class").alias("root"))
    rows = spread_join(listed.select("doc", "digest", F.col("n").cast("long").alias("n_shingles")), rooted, ["digest"], F.xxhash64("doc"))
    return rows.select(
        F.nullif("doc", F.lit(_NULL)).alias("doc_id"), "n_shingles",
        F.when(F.col("doc") != _NULL, F.coalesce("root", "doc")).alias("component_id"),
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The document with the smallest id of each component, with all its columns.

    Documents without words or without an id all stay.
    """
    groups = near_groups(docs).where("component_id <> doc_id").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(groups, docs["doc_id"] == groups["gone"], "left_anti")
