"""N-gram Jaccard join with a token-group matrix.

Documents are sets of hashed word shingles; two link when their Jaccard
similarity reaches a threshold (exact integers: 100 * intersection >=
percent * union).  The result is the connected component of each document.

The method: similar documents form groups, each group keeps the union of its
tokens, and the token-group matrix says which groups hold a token.  A document
Q can only link into a group that holds at least ``percent`` % of Q's tokens,
so the matrix bounds the overlap with all members of a group at once, and only
groups that qualify are opened.

1. ``sets``: first every document is a group of its own.  The matrix's rows
   (tokens) are dealt over shards as packed arrays, each task having combined
   equal tokens before; a shard tells which tokens stand in two groups or more.
   A document with too few such tokens qualifies for no group and is done.
   That leaves near copies and little else.
2. Groups grow: each document is compared with one member of each of its
   min-hash buckets, the one that shares most of its tokens with others (an
   original among its copies), and linked documents become one group.
3. ``crossing``: the matrix again, now with these groups.  A document with too
   few tokens that stand in two groups or more qualifies for no foreign group:
   a group of thousands of copies is closed as a whole, without comparing its
   members.
4. What is still open: documents with the same crossing tokens form a class.
   Within a class, and between two classes, the overlap of all pairs is the
   same number, so sizes alone decide which documents link, and links with the
   smallest member keep all that the pairs would connect.  Classes meet through
   their rarest tokens (an upper bound of the overlap from the matrix's rows),
   and only those that qualify are intersected.

No link between different texts is lost: steps 1, 3 and 4 use necessary
conditions only, and step 2 only adds links that are checked.  Tokens are whole
64-bit hashes throughout; a shard's rows leave out only the bits that are its
own number, so the result does not depend on the number of shards.

Defined results: a null or empty text, or one without words, has no tokens and
links with nothing; fewer words than the shingle width are one shingle; copies
and repeated rows share a component; rows with a null id take part and get the
component's smallest id (null if there is none); other columns are not read.
Memory: a task holds about ``CHUNK_TOKENS`` tokens, a shard its part of the
matrix.  There are two shards for each shuffle partition (256 at least), and a
chunk sends each shard one row: with many terabytes raise both the partitions
and ``CHUNK_TOKENS``, so that a row still holds some hundred tokens.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import _text as T
from .components import smallest_reachable

CHUNK_TOKENS = 1 << 20
ODD_ROWS = 1 << 19                   # ids to leave out (9 bytes each) that may be sent to every task
PROBES = 2                           # rare tokens that a class is tried with beyond those it needs
SEEDS = (1, 2, 3, 4)                 # min-hash functions of step 2
_SINGLE, _SHARED, _KNOWN, _META, _TIMES = range(5)
_NAMES = ["shard", "chunk", "kind", "a", "b", "c", "middle", "top"]
_PIECE = "shard int, chunk long, kind int, a binary, b binary, c binary, middle binary, top binary"
_REPLY = "chunk long, kind int, a binary, b binary, c binary"


def _shards(spark: SparkSession) -> int:
    n = max(256, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    return 1 << (n - 1).bit_length()


def _packed(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Binary values: the bytes of values[cuts[i]:cuts[i + 1]]."""
    values = np.ascontiguousarray(values)
    size = values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [
        None, pa.py_buffer(np.ascontiguousarray(cuts.astype(np.int64) * size)), pa.py_buffer(values.tobytes())
    ]).cast(pa.binary())


def _joined(column: pa.ChunkedArray, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """(all values, how many each row holds) of a column of packed arrays."""
    data, offsets = T.buffers(column)
    return np.frombuffer(data.tobytes(), dtype), np.diff(offsets) // np.dtype(dtype).itemsize


def _below(shards: int) -> int:
    """How many bits of a token lie below its shard's number (56 at most)."""
    return 64 - (shards.bit_length() - 1)


def _shard_tokens(pieces: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(tokens without their shard's number, how many each row holds); their bytes lie apart, as they compress so."""
    low, count = _joined(pieces["a"], "<u4")
    middle, top = _joined(pieces["middle"], "<u2")[0], _joined(pieces["top"], "u1")[0]
    return low.astype(np.uint64) | middle.astype(np.uint64) << np.uint64(32) | top.astype(np.uint64) << np.uint64(48), count


def _pieces(number: int, shards: int, tokens: np.ndarray, owner: np.ndarray, group: np.ndarray | None, meta: list):
    """A chunk's rows for the shards and for itself.

    ``tokens`` are sorted; ``group`` is each entry's group, or None when every
    document (``owner``) is one.  Tokens that two groups of the chunk hold are
    known to be shared: a shard gets each of them once, with the number of its
    documents instead of these.
    """
    start = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, int)
    length = np.diff(np.concatenate([start, [len(tokens)]]))
    own = owner if group is None else group
    several = np.minimum.reduceat(own, start) != np.maximum.reduceat(own, start) if len(start) else np.zeros(0, bool)
    shared = np.repeat(several, length)
    shard = (tokens >> np.uint64(_below(shards))).astype(np.int64)
    low = tokens & np.uint64((1 << _below(shards)) - 1)

    def rows(kind, at, b, c):
        bounds = np.searchsorted(shard[at], np.arange(shards + 1))
        full = np.flatnonzero(np.diff(bounds))
        cuts = np.concatenate([bounds[full], bounds[-1:]])
        planes = [(low[at] >> np.uint64(k)).astype(t) for k, t in ((0, np.uint32), (32, np.uint16), (48, np.uint8))]
        blobs = [pa.nulls(len(full), pa.binary()) if x is None else _packed(x, cuts) for x in (planes[0], b, c, *planes[1:])]
        return pa.record_batch([
            pa.array(full.astype(np.int32)), pa.array(np.full(len(full), number, np.int64)),
            pa.array(np.full(len(full), kind, np.int32)), *blobs], names=_NAMES)

    at = np.flatnonzero(~shared)
    yield rows(_SINGLE, at, owner[at], None if group is None else group[at])
    yield rows(_SHARED, start[several], None if group is None else length[several].astype(np.uint32), None)
    home = number * 2654435761 % shards
    yield pa.record_batch([
        pa.array([home, home], pa.int32()), pa.array([number, number], pa.int64()), pa.array([_KNOWN, _META], pa.int32()),
        pa.array([tokens[shared].tobytes(), meta[0]], pa.binary()),
        pa.array([owner[shared].tobytes(), meta[1]], pa.binary()), pa.array([None, meta[2]], pa.binary()),
        pa.nulls(2, pa.binary()), pa.nulls(2, pa.binary())], names=_NAMES)


class _Texts:
    """Documents of a task, collected until they hold enough tokens."""

    def __init__(self, width: int):
        self.width, self.tokens, self.owner, self.ids, self.n = width, [], [], [], 0

    def add(self, part, data: np.ndarray, offsets: np.ndarray) -> None:
        lower = T.LOWER[data]
        starts, ends, first = T.spans(lower, offsets, ~T.SPACE)
        tokens, owner = T.shingles(T.word_hashes(lower, starts, ends), first, self.width)
        self.tokens.append(tokens)
        self.owner.append(owner + len(self.ids))
        self.ids.extend(part.column(0).to_pylist())
        self.n += len(tokens)

    def pieces(self, number: int, shards: int):
        tokens, owner = np.concatenate(self.tokens), np.concatenate(self.owner).astype(np.uint16)
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        fresh = np.ones(len(tokens), bool)                       # the first of equal tokens of a document
        fresh[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
        tokens, owner = tokens[fresh], owner[fresh]
        sizes = np.bincount(owner, minlength=len(self.ids))
        marks = np.zeros((2, len(self.ids)), np.uint64)          # an order-free digest of each set
        for row, seed in zip(marks, (0xA5A5, 0x5A5A)):
            np.add.at(row, owner, T.mix64(tokens ^ np.uint64(seed)))
        ids = np.array([0 if i is None else i for i in self.ids], np.int64).tobytes() + bytes(i is not None for i in self.ids)
        yield from _pieces(number, shards, tokens, owner, None, [ids, sizes.astype(np.int64).tobytes(), marks.tobytes()])


def _deal(width: int, shards: int):
    def run(batches):
        task, seq = TaskContext.get().partitionId(), 0
        chunk = _Texts(width)
        for part, data, offsets in T.doc_batches(batches):
            for lo in range(0, part.num_rows, 32768):            # a chunk numbers its documents with 16 bits
                rows = part.slice(lo, 32768)
                hi = lo + rows.num_rows
                if chunk.ids and (chunk.n >= CHUNK_TOKENS or len(chunk.ids) + rows.num_rows > 65535):
                    yield from chunk.pieces(task << 20 | seq, shards)
                    chunk, seq = _Texts(width), seq + 1
                chunk.add(rows, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
        if chunk.ids:
            yield from chunk.pieces(task << 20 | seq, shards)
    return run


def _deal_sets(shards: int):
    """The same for (uid, comp, n, tokens): the groups are given."""
    def run(batches):
        task, seq = TaskContext.get().partitionId(), 0
        for b in batches:
            held = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(b.column(3))))])
            lo = 0
            while lo < b.num_rows:
                hi = min(max(lo + 1, int(np.searchsorted(held, held[lo] + CHUNK_TOKENS, "right")) - 1), lo + 65535, b.num_rows)
                part = b.slice(lo, hi - lo)
                uid, comp, n = (np.asarray(part.column(k), np.int64) for k in range(3))
                tokens = np.asarray(part.column(3).flatten()).astype(np.uint64)
                owner = np.repeat(np.arange(hi - lo), np.diff(held[lo:hi + 1])).astype(np.uint16)
                order = np.argsort(tokens, kind="stable")
                yield from _pieces(task << 20 | seq, shards, tokens[order], owner[order], comp[owner[order]],
                                   [uid.tobytes(), n.tobytes(), comp.tobytes()])
                lo, seq = hi, seq + 1
    return run


def _match(shards: int):
    def run(key: tuple[pa.Scalar, ...], pieces: pa.Table) -> pa.Table:
        """A shard: of the single tokens, those that another group holds too; the rest goes on to its chunk.

        With given groups the replies say how many documents hold a token.
        """
        top = np.uint64(key[0].as_py() << _below(shards))
        kind = pieces["kind"].to_numpy()
        single, marked = pieces.filter(pa.array(kind == _SINGLE)), pieces.filter(pa.array(kind == _SHARED))
        tokens, count = _shard_tokens(single)
        owner, _ = _joined(single["b"], "<u2")
        group, _ = _joined(single["c"], "<i8")
        others, marks = _shard_tokens(marked)
        times, _ = _joined(marked["b"], "<u4")
        if not len(group):                                           # every row's tokens are of documents of its own
            group = np.repeat(np.arange(len(count)), count)
        order = np.argsort(tokens, kind="stable")
        ranked, group = tokens[order], group[order]
        start = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, int)
        length = np.diff(np.concatenate([start, [len(ranked)]]))
        several, known = np.zeros(len(start), bool), ranked[start]
        held = length.astype(np.int64)
        if len(start):
            several = (np.minimum.reduceat(group, start) != np.maximum.reduceat(group, start)) | np.isin(known, others)
        # documents of each marked token, in all chunks that marked it and in single ones
        distinct, inverse = np.unique(others, return_inverse=True)
        total = np.bincount(inverse, times, len(distinct)).astype(np.int64) if len(times) else np.zeros(len(distinct), np.int64)
        spot = np.searchsorted(known, distinct)
        both = (spot < len(known)) & (known[np.minimum(spot, max(0, len(known) - 1))] == distinct) if len(known) else np.zeros(len(distinct), bool)
        total[both] += held[spot[both]]
        held[spot[both]] = total[both]

        again, df = np.zeros(len(tokens), bool), np.zeros(len(tokens), np.int64)
        again[order], df[order] = np.repeat(several, length), np.repeat(held, length)
        row = np.repeat(np.arange(len(count)), count)[again]
        at = np.searchsorted(row, np.arange(len(count) + 1))
        full = np.flatnonzero(np.diff(at))
        cuts = np.concatenate([at[full], at[-1:]])
        chunks = single["chunk"].to_numpy()
        out = [_reply(chunks[full] if len(full) else np.zeros(0, np.int64), _KNOWN, tokens[again] | top,
                      owner[again], df[again].astype(np.uint32), cuts)]
        if len(times):
            out.append(_reply(marked["chunk"].to_numpy(), _TIMES, others | top, None,
                              total[inverse].astype(np.uint32), np.concatenate([[0], np.cumsum(marks)])))
        rest = pieces.filter(pa.array(kind >= _KNOWN)).select(_NAMES[1:6])
        return pa.concat_tables([*out, rest.cast(out[0].schema)])
    return run


def _reply(chunks: np.ndarray, kind: int, a: np.ndarray, b: np.ndarray | None, c: np.ndarray, cuts: np.ndarray) -> pa.Table:
    n = len(chunks)
    return pa.table({"chunk": pa.array(chunks, pa.int64()), "kind": pa.array(np.full(n, kind, np.int32)),
                     "a": _packed(a, cuts), "b": pa.nulls(n, pa.binary()) if b is None else _packed(b, cuts),
                     "c": _packed(c, cuts)})


def _chunk_tokens(pieces: pa.Table, ranked: bool = False) -> tuple[dict, np.ndarray, np.ndarray]:
    """(meta row, shared tokens, their documents), sorted by document and token, or by document, rarity and token."""
    kind = pieces["kind"].to_numpy()
    meta = pieces.filter(pa.array(kind == _META)).to_pylist()[0]
    known = pieces.filter(pa.array(kind == _KNOWN))
    tokens, count = _joined(known["a"], "<u8")
    owner = _joined(known["b"], "<u2")[0]
    if not ranked:
        order = np.lexsort((tokens, owner))
        return meta, tokens[order], owner[order]
    told, df = np.repeat(known["c"].is_valid().to_numpy(), count), np.zeros(len(tokens), np.int64)
    df[told] = _joined(known["c"], "<u4")[0]
    times = pieces.filter(pa.array(kind == _TIMES))
    names, total = _joined(times["a"], "<u8")[0], _joined(times["c"], "<u4")[0]
    by = np.argsort(names)
    df[~told] = total[by[np.searchsorted(names, tokens[~told], sorter=by)]]
    order = np.lexsort((tokens, df, owner))
    return meta, tokens[order], owner[order]


def _gather(percent: int):
    def run(key: tuple[pa.Scalar, ...], pieces: pa.Table) -> pa.Table:
        """A chunk: its documents with their shared tokens, if they hold enough of them."""
        meta, tokens, owner = _chunk_tokens(pieces)
        sizes, marks = np.frombuffer(meta["b"], np.int64), np.frombuffer(meta["c"], np.uint64).reshape(2, -1)
        n = len(sizes)
        ids, there = np.frombuffer(meta["a"][:8 * n], np.int64), np.frombuffer(meta["a"][8 * n:], bool)
        at = np.searchsorted(owner, np.arange(n + 1))
        held = np.diff(at)
        uid = key[0].as_py() * 65536 + np.arange(n)
        # equal sets within the chunk: the first carries the tokens for all
        order = np.lexsort((np.arange(n), marks[1], marks[0], sizes))
        head = np.ones(n, bool)
        head[1:] = (sizes[order][1:] != sizes[order][:-1]) | (marks[:, order][:, 1:] != marks[:, order][:, :-1]).any(0)
        rep = np.empty(n, np.int64)
        rep[order] = uid[order][np.maximum.accumulate(np.where(head, np.arange(n), 0))]
        alive = (sizes > 0) & (100 * held >= percent * sizes)
        lists = [tokens[at[i]:at[i + 1]].astype(np.int64) if alive[i] and rep[i] == uid[i] else None for i in range(n)]
        return pa.table({"uid": pa.array(uid), "doc_id": pa.array(ids, mask=~there), "n": pa.array(sizes),
                         "rep": pa.array(np.where(alive, rep, uid)), "tokens": pa.array(lists, pa.list_(pa.int64()))})
    return run


def _gather_sets(percent: int):
    def run(key: tuple[pa.Scalar, ...], pieces: pa.Table) -> pa.Table:
        """A chunk of sets: those that hold enough crossing tokens, with these, rare ones first."""
        meta, tokens, owner = _chunk_tokens(pieces, True)
        uid, n, comp = (np.frombuffer(meta[k], np.int64) for k in "abc")
        at = np.searchsorted(owner, np.arange(len(n) + 1))
        keep = np.flatnonzero(100 * np.diff(at) >= percent * n)
        lists = [tokens[at[i]:at[i + 1]].astype(np.int64) for i in keep]
        return pa.table({"uid": pa.array(uid[keep]), "comp": pa.array(comp[keep]), "n": pa.array(n[keep]),
                         "tokens": pa.array(lists, pa.list_(pa.int64()))})
    return run


def sets(docs: DataFrame, width: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """(uid, doc_id, n, rep, tokens): a row per document; tokens only of those that may link, once per chunk."""
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    shards = _shards(docs.sparkSession)
    dealt = src.mapInArrow(T.tidy(_deal(width, shards)), _PIECE)
    return dealt.groupBy("shard").applyInArrow(T.tidy_group(_match(shards)), _REPLY).groupBy("chunk").applyInArrow(
        T.tidy_group(_gather(percent)), "uid long, doc_id long, n long, rep long, tokens array<long>")


def crossing(verts: DataFrame, percent: int) -> DataFrame:
    """Of (uid, comp, n, tokens) those that hold enough tokens of foreign groups; tokens: the crossing ones, rare first."""
    shards = _shards(verts.sparkSession)
    dealt = verts.select("uid", "comp", "n", "tokens").mapInArrow(T.tidy(_deal_sets(shards)), _PIECE)
    return dealt.groupBy("shard").applyInArrow(T.tidy_group(_match(shards)), _REPLY).groupBy("chunk").applyInArrow(
        T.tidy_group(_gather_sets(percent)), "uid long, comp long, n long, tokens array<long>")


def _bucket_links(verts: DataFrame, percent: int) -> DataFrame:
    """Checked links of each vertex (uid, n, tokens) with the most typical member of its min-hash buckets."""
    def keys(batches):
        for b in batches:
            uid, n, tokens = b.column(0), np.asarray(b.column(1), np.int64), b.column(2)
            flat = np.asarray(tokens.flatten()).view(np.uint64)
            held = np.asarray(pc.list_value_length(tokens))
            at = np.concatenate([[0], np.cumsum(held)])
            full = np.flatnonzero(held)
            if not len(full):
                continue
            for seed in SEEDS:
                low = np.minimum.reduceat(T.mix64(flat ^ T.mix64(np.array([seed], np.uint64))), at[full])
                yield pa.record_batch([uid.take(pa.array(full)), pa.array((low ^ np.uint64(seed)).view(np.int64)),
                                       pa.array(held[full] / n[full])], names=["uid", "bucket", "share"])

    dealt = verts.select("uid", "n", "tokens").mapInArrow(T.tidy(keys), "uid long, bucket long, share double")
    typical = dealt.groupBy("bucket").agg(F.max(F.struct("share", "uid")).alias("m"), F.count("*").alias("rows"))
    pairs = (dealt.join(typical.filter("rows > 1"), "bucket").select("uid", F.col("m.uid").alias("other"))
             .filter("uid <> other")
             .select(F.least("uid", "other").alias("a"), F.greatest("uid", "other").alias("b")).distinct())
    one = verts.select(F.col("uid").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    two = verts.select(F.col("uid").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    met = pairs.join(one, "a").join(two, "b").filter(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    return (met.withColumn("both", F.size(F.array_intersect("ta", "tb")))
            .filter(f"100 * both >= {percent} * (na + nb - both)").select("a", "b"))


def _class_links(rest: DataFrame, percent: int, path: str) -> DataFrame:
    """All links that connect the open documents (uid, comp, n, tokens), through classes of equal crossing tokens."""
    spark = rest.sparkSession
    # crossing among the open ones only
    (crossing(rest, percent)
     .withColumn("class", F.unhex(F.md5(F.concat_ws(",", F.col("tokens").cast("array<string>")))))
     .write.parquet(f"{path}/open"))
    docs = spark.read.parquet(f"{path}/open")
    # the smallest member stands for its class: whatever links with the class links with it
    (docs.groupBy("class").agg(F.min(F.struct("n", "uid")).alias("m"), F.min("comp").alias("x"), F.max("comp").alias("y"),
                               F.count("*").alias("members"))
     .select("class", F.col("m.uid").alias("least"), F.col("m.n").alias("small"), "x", "y", "members")
     .write.parquet(f"{path}/classes"))
    classes = spark.read.parquet(f"{path}/classes")
    # 100 * o >= percent * (n + m - o): with an overlap o, sizes n + m up to o * (100 + percent) / percent link
    room = f"({{}} * (100 + {percent})) div {percent}"
    inside = (docs.join(classes.filter("members > 1"), "class")
              .filter(f"uid <> least and n + small <= {room.format('size(tokens)')}").select(F.col("least").alias("a"), F.col("uid").alias("b")))

    need = f"cast(({percent} * n + 99) div 100 as int)"
    heads = (classes.join(docs.select(F.col("uid").alias("least"), "n", "tokens"), "least")
             .withColumn("need", F.expr(need)).withColumn("held", F.size("tokens"))
             .withColumn("tried", F.expr(f"least(held, held - need + 1 + {PROBES})"))
             # classes whose documents are all of one group stay together; any other class is a group of its own
             .withColumn("group", F.expr("if(x = y, x, - least - 1)")))
    probe = heads.select("least", "group", "n", "held", "need",
                         F.posexplode(F.expr("slice(tokens, 1, tried)")).alias("place", "token")).withColumn("m", F.col("n"))
    # a class of n that holds too few crossing tokens for the smallest other one at a token has no use for it;
    # a token that only one group is left with is no use to anyone (thrice: what went was the smallest at some tokens)
    for _ in range(3):
        smallest = probe.groupBy("token").agg(F.min("n").alias("m"), F.min("group").alias("lo"), F.max("group").alias("hi"))
        probe = (probe.drop("m").join(smallest.filter("lo < hi"), "token")
                 .filter(f"{percent} * (n + m) <= held * (100 + {percent})").drop("lo", "hi"))
    probe.write.parquet(f"{path}/probe")
    probe = spark.read.parquet(f"{path}/probe")
    # none that a class can meet is smaller than these: it needs more than percent of its own size, and tries less
    partner = probe.groupBy("least").agg(F.min("m").alias("partner"))
    probe = (probe.join(partner, "least")
             .withColumn("need", F.expr(f"greatest(need, cast(({percent} * (n + partner) + 99 + {percent}) div (100 + {percent}) as int))"))
             .withColumn("tried", F.expr(f"least(held, held - need + 1 + {PROBES})"))
             .filter("need <= held and place < tried").withColumn("hits", F.expr("need - (held - tried)")))
    probe.select("least", "group", "n", "held", "hits", "token").write.parquet(f"{path}/tried")
    probe = spark.read.parquet(f"{path}/tried")
    heads_left = probe.select("least", "group", "n", "held", "hits").distinct()
    several = (probe.groupBy("token").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).filter("lo < hi")
               .select("token"))
    # the smaller group's classes look for the larger group: a group of thousands is one row of the matrix for each token
    # and it goes by its sizes: some member may be small enough, and hold enough, for the class
    weights = heads_left.groupBy("group").agg(
        F.count("*").alias("weight"), F.min("hits").alias("fewest"), F.min("n").alias("small"),
        F.max("n").alias("large"), F.max("held").alias("most"))
    probe = probe.join(several, "token", "left_semi").join(weights, "group")
    matrix = probe.select("token", *[F.col(c).alias(f"{c}2") for c in weights.columns]).distinct()
    (probe.join(matrix, "token")
     .filter("(weight < weight2 or (weight = weight2 and group < group2))"
             f" and {percent} * (n + small2) <= least(held, most2) * (100 + {percent})"
             f" and 100 * n >= {percent} * small2 and 100 * large2 >= {percent} * n")
     .groupBy("least", "group2").agg(F.count("*").alias("found"), F.first("hits").alias("hits"), F.first("fewest2").alias("fewest"))
     # of the tokens tried at most held - tried are missing: fewer hits than this bound the overlap below the need
     .filter("found >= least(hits, fewest)").select("least", F.col("group2").alias("group"))
     .write.parquet(f"{path}/qualified"))
    # only the groups that qualify are opened
    one = heads_left.select("least", "n", "held")
    two = heads_left.select("group", *[F.col(c).alias(f"{c}2") for c in ("least", "n", "held")])
    met = (spark.read.parquet(f"{path}/qualified").join(one, "least").join(two, "group")
           .filter(f"100 * least(n, n2) >= {percent} * greatest(n, n2)"
                   f" and {percent} * (n + n2) <= least(held, held2) * (100 + {percent})").select("least", "least2"))
    sides = heads.select("least", "class", "n", "tokens")
    theirs = sides.select(*[F.col(c).alias(f"{c}2") for c in sides.columns])
    (met.join(sides, "least").join(theirs, "least2")
     .withColumn("room", F.expr(room.format("size(array_intersect(tokens, tokens2))")))
     .filter("n + n2 <= room").select("least", "class", "n", "least2", "class2", "n2", "room")
     .write.parquet(f"{path}/pairs"))
    pairs = spark.read.parquet(f"{path}/pairs")
    both = pairs.select("class", F.col("least2").alias("to"), (F.col("room") - F.col("n2")).alias("slack")).unionByName(
        pairs.select(F.col("class2").alias("class"), F.col("least").alias("to"), (F.col("room") - F.col("n")).alias("slack")))
    # a member that links with any other class links with the one that leaves most room
    widest = both.groupBy("class").agg(F.max(F.struct("slack", "to")).alias("w"))
    outside = (docs.select("uid", "n", "class").join(widest, "class").filter("n <= w.slack")
               .select(F.col("uid").alias("a"), F.col("w.to").alias("b")))
    return inside.unionByName(outside).unionByName(pairs.select(F.col("least").alias("a"), F.col("least2").alias("b")))


def components(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): a row per document."""
    spark = docs.sparkSession
    path = scratch_path(spark, "jaccard")
    sets(docs, width, percent, doc_id, text).write.parquet(f"{path}/sets")
    all_docs = spark.read.parquet(f"{path}/sets")
    verts = all_docs.filter("tokens is not null").select("uid", "n", "tokens")
    _bucket_links(verts, percent).write.parquet(f"{path}/links")
    links = spark.read.parquet(f"{path}/links")
    roots = smallest_reachable(spark, links)
    grouped = verts.join(roots, F.col("uid") == F.col("v"), "left").select(
        "uid", F.coalesce("root", "uid").alias("comp"), "n", "tokens")
    crossing(grouped, percent).write.parquet(f"{path}/crossing")
    rest = spark.read.parquet(f"{path}/crossing")
    _class_links(rest, percent, path).write.parquet(f"{path}/more")
    more = spark.read.parquet(f"{path}/more")
    if more.limit(1).count():
        roots = smallest_reachable(spark, links.unionByName(more))
    placed = (all_docs.select("doc_id", "n", "rep").join(roots, F.col("rep") == F.col("v"), "left")
              .select("doc_id", "n", F.coalesce("root", "rep").alias("comp")))
    lowest = placed.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return placed.join(lowest, "comp").select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id; all columns stay.

    Documents are known by their id: rows that repeat an id stay or go with it,
    and one row of them stays.  Rows with a null id stay.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "jaccard-kept")
    components(docs, width, percent, doc_id, text).write.parquet(path)
    found = spark.read.parquet(path).filter("doc_id is not null")
    # rows to leave out, and ids that stand in several rows
    seen = found.groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("component_id").alias("component_id"))
    name, once = T.free_name(docs.columns, "_odd"), T.free_name(docs.columns, "_once")
    odd = seen.filter("component_id <> doc_id or rows > 1").select(
        F.col("doc_id").alias(name), (F.col("component_id") == F.col("doc_id")).alias(once))
    # its rows are counted first: the texts are shuffled only beyond the bound
    odd = F.broadcast(odd) if odd.count() <= ODD_ROWS else odd
    marked = docs.join(odd, F.col(doc_id).cast("long") == F.col(name), "left")
    kept = marked.filter(F.col(name).isNull()).select(*docs.columns)
    if not odd.filter(F.col(once)).limit(1).count():
        return kept
    return kept.unionByName(marked.filter(F.col(once)).dropDuplicates([name]).select(*docs.columns))
