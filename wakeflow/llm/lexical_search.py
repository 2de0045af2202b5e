"""Ranked lexical search: document-at-a-time over compressed postings, shard by shard.

:func:`build` writes an inverted index where the texts stand: each task cuts its rows into
shards of at most ``SHARD_BYTES`` of text (or one longer text), orders a shard's documents
by doc_id, and writes the postings of each term as blocks of up to ``BLOCK`` documents,
gaps and occurrences as variable-length bytes. Nothing is shuffled for it. The row of the
empty term holds a shard's ids and lengths.

:func:`search` joins the terms of the items with the index, once for the number of
documents of each term and once for the postings; these meet by shard. There each item is
a merge of its terms' cursors by a heap keyed by their next document: all cursors that
stand before a horizon of ``RUN`` documents are taken from the heap, add their part to the
scores of these documents, and go back with the next document after it. A heap bounded to
``k`` entries, keyed by score and then by doc_id, keeps the best of a shard; the shards'
best are merged by item, first within tasks.

Scores are 64-bit integers as the contract of the query says; only a term's weight uses a
logarithm in doubles.

Defined cases: null and empty texts have no term; rows that repeat a doc_id are documents
of their own; a null doc_id comes after all others; rows that repeat an item_id are one
item with all their terms; items without a term, or of which no document has one, have no
rows; an empty table on either side gives an empty result; other columns are ignored.

Scale: an index is about a third of its texts. Items pass in slabs of about ``SLAB_BYTES``
of text (or one longer item), each written before the next; a slab's distinct terms, no
longer than its text, with their items are broadcast to the index. A shard's hot
terms are bounded by its documents, and a hot term of the corpus is spread over all shards.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeflow.llm import textbytes as tb
from wakeflow.llm.common import written

SHARD_BYTES = 32 << 20
BLOCK = 4096
RUN = 1 << 14
SLAB_BYTES = 8 << 20
INDEX = "shard long, term string, block int, n long, ids binary, counts binary"


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of 0 or more as bytes of 7 bits, low bits first, the last without its high bit; and where each begins, with the end."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 10):
        size += v >= np.uint64(1 << (7 * k))
    at = np.zeros(len(v) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    out = np.zeros(int(at[-1]), np.uint8)
    for k in range(int(size.max()) if len(v) else 0):
        more = size > k
        out[at[:-1][more] + k] = ((v[more] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | np.where(size[more] > k + 1, 128, 0).astype(np.uint8)
    return out, at


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    end = np.flatnonzero(raw < 128)
    begin = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
    size, out = end - begin + 1, np.zeros(len(end), np.uint64)
    for k in range(int(size.max()) if len(end) else 0):
        more = size > k
        out[more] |= (raw[begin[more] + k] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * k)
    return out.astype(np.int64)


class _Shard:
    """Documents as they come, and their distinct terms."""

    def __init__(self):
        self.bytes, self.docs = 0, 0
        self.ids, self.lengths, self.doc, self.times, self.terms = [], [], [], [], []

    def add(self, ids: pa.Array, data: np.ndarray, offsets: np.ndarray) -> None:
        doc, code, times, terms, length = tb.term_counts(data, offsets, tb.LETTERS_DIGITS)
        self.ids.append(ids)
        self.lengths.append(length)
        self.doc.append(doc + self.docs)
        self.times.append(times)
        self.terms.append(pa.DictionaryArray.from_arrays(pa.array(code.astype(np.int32)), terms))
        self.docs += len(ids)
        self.bytes += len(data)

    def rows(self, number: int) -> pa.RecordBatch:
        ids = pa.concat_arrays(self.ids)
        valid = ids.is_valid().to_numpy(zero_copy_only=False)
        plain = ids.fill_null(0).to_numpy()
        order = np.lexsort((plain, ~valid))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        merged = pa.chunked_array(self.terms).unify_dictionaries()
        code = np.concatenate([c.indices.to_numpy() for c in merged.chunks]).astype(np.int64)
        doc, times = place[np.concatenate(self.doc)], np.concatenate(self.times)
        by = np.lexsort((doc, code))
        code, doc, times = code[by], doc[by], times[by]
        # a block begins with each term and after each BLOCK postings of one
        new = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
        within = np.arange(len(code)) - np.repeat(new, np.diff(np.append(new, len(code))))
        begin = np.flatnonzero(within % BLOCK == 0)
        gaps = np.diff(doc, prepend=0)
        gaps[begin] = doc[begin]
        edges = np.append(begin, len(code))
        blobs = []
        for values in (gaps, times):
            data, at = pack(values)
            cuts = pa.py_buffer(at[edges].astype(np.int32))
            blobs.append(pa.Array.from_buffers(pa.binary(), len(begin), [None, cuts, pa.py_buffer(data)]))
        # the shard's own row: ids that are not null, as steps from the lowest, and all lengths
        own = plain[order][: valid.sum()]
        low = int(own[0]) if len(own) else 0
        steps = np.diff(own.astype(np.uint64), prepend=np.uint64(low & ((1 << 64) - 1)))
        head = [pa.array([pack(steps)[0].tobytes()], pa.binary()), pa.array([pack(np.concatenate(self.lengths)[order])[0].tobytes()], pa.binary())]
        dictionary = merged.chunk(0).dictionary.cast(pa.string()) if len(code) else pa.array([], pa.string())
        n = len(begin) + 1
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n, number, np.int64)),
                pa.concat_arrays([pa.array([""], pa.string()), dictionary.take(pa.array(code[begin]))]),
                pa.array(np.append(0, within[begin] // BLOCK).astype(np.int32)),
                pa.array(np.append(low, np.diff(edges))),
                pa.concat_arrays([head[0], blobs[0]]),
                pa.concat_arrays([head[1], blobs[1]]),
            ],
            ["shard", "term", "block", "n", "ids", "counts"],
        )


def build(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The written index of ``docs`` (doc_id, text): a row for each block of postings, and for each shard one of the empty term, whose n is its lowest id."""

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        shard = _Shard()
        for batch in batches:
            for lo, hi, data, offsets in tb.chunks(batch.column("text"), min(shard_bytes, 4 << 20)):
                if shard.docs and shard.bytes + len(data) > shard_bytes:
                    yield shard.rows(number)
                    shard, number = _Shard(), number + 1
                shard.add(batch.column("doc_id")[lo:hi], data, offsets)
        if shard.docs:
            yield shard.rows(number)

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, INDEX))


def statistics(index: DataFrame) -> tuple[int, int]:
    """N, the documents with a term, and L, all their terms."""

    def count(batches):
        for batch in batches:
            sizes = [unpack(x.as_py()) for x in batch.column("counts")]
            yield pa.RecordBatch.from_arrays([pa.array([int((x > 0).sum()) for x in sizes], pa.int64()), pa.array([int(x.sum()) for x in sizes], pa.int64())], ["n", "l"])

    total = index.filter("term = ''").select("counts").mapInArrow(count, "n long, l long").agg(F.sum("n"), F.sum("l")).first()
    return int(total[0] or 0), int(total[1] or 0)


def item_terms(items: DataFrame, slabs: int) -> DataFrame:
    """item_id, term, slab: the distinct terms of each item."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in tb.chunks(batch.column("text"), 4 << 20):
                doc, code, _, terms, _ = tb.term_counts(data, offsets, tb.LETTERS_DIGITS)
                yield pa.RecordBatch.from_arrays([batch.column("item_id")[lo:hi].take(pa.array(doc)), terms.take(pa.array(code)).cast(pa.string())], ["item_id", "term"])

    found = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "item_id long, term string")
    return found.distinct().withColumn("slab", F.pmod(F.xxhash64(F.coalesce("item_id", F.lit(0))), F.lit(slabs)).cast("int"))


def best_of(cursors: list[tuple[np.ndarray, np.ndarray]], k: int, run: int = RUN) -> list[tuple[int, int]]:
    """(score, document) of the k best documents: cursors are (documents ascending, what each adds), merged document by document in runs."""
    heap = [(int(docs[0]), c, 0) for c, (docs, _) in enumerate(cursors) if len(docs)]
    heapq.heapify(heap)
    best: list[tuple[int, int]] = []
    while heap:
        low = heap[0][0]
        score = np.zeros(run, np.int64)
        while heap and heap[0][0] < low + run:
            _, c, at = heapq.heappop(heap)
            docs, adds = cursors[c]
            end = int(np.searchsorted(docs, low + run))
            score[docs[at:end] - low] += adds[at:end]
            if end < len(docs):
                heapq.heappush(heap, (int(docs[end]), c, end))
        # documents come in order, so that one of equal score never displaces an earlier one
        found = np.flatnonzero(score > (best[0][0] if len(best) == k else 0))
        if len(found) > k:
            found = found[np.lexsort((found, -score[found]))[:k]]
        for d in found.tolist():
            entry = (int(score[d]), -(low + d))
            if len(best) < k:
                heapq.heappush(best, entry)
            elif entry > best[0]:
                heapq.heapreplace(best, entry)
    return [(s, -d) for s, d in sorted(best, reverse=True)]


def _search_shard(table: pa.Table, n: int, total: int, k: int) -> pa.Table:
    """The best documents of one shard for each item: table has the shard's own row and the postings of the items' terms."""
    terms = table.column("term").to_pylist()
    own = terms.index("")
    ids, lengths = unpack(table.column("ids")[own].as_py()), unpack(table.column("counts")[own].as_py())
    ids = np.cumsum(ids.astype(np.uint64), dtype=np.uint64) + np.uint64(table.column("n")[own].as_py() & ((1 << 64) - 1))
    ids = ids.astype(np.int64)
    if len(lengths) and 50 * int(lengths.max()) * n >= 1 << 63:
        m = np.array([50 + 50 * x * n // total for x in lengths.tolist()], np.int64)
    else:
        m = 50 + 50 * lengths * n // max(1, total)
    blocks: dict[str, list[int]] = {}
    for i, t in enumerate(terms):
        if t:
            blocks.setdefault(t, []).append(i)
    of_item: dict[int | None, list[tuple[np.ndarray, np.ndarray]]] = {}
    order, weight = table.column("block").to_pylist(), table.column("weight").to_pylist()
    for rows in blocks.values():
        rows.sort(key=order.__getitem__)
        docs = np.concatenate([np.cumsum(unpack(table.column("ids")[i].as_py())) for i in rows])
        times = np.concatenate([unpack(table.column("counts")[i].as_py()) for i in rows])
        cursor = (docs, weight[rows[0]] * (1_000_000_000 * times // (1000 * times + 20 * m[docs])))
        for item in table.column("items")[rows[0]].as_py():
            of_item.setdefault(item, []).append(cursor)
    found = [(item, int(ids[d]) if d < len(ids) else None, s) for item, cursors in of_item.items() for s, d in best_of(cursors, k)]
    cols = list(zip(*found, strict=True)) if found else [[], [], []]
    return pa.table({"item_id": pa.array(cols[0], pa.int64()), "doc_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.int64())})


def search(index: DataFrame, items: DataFrame, k: int = 50, slab_bytes: int = SLAB_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of ``index`` for each item (item_id, text)."""
    n, total = statistics(index)
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slabs = max(1, -(-int(size) // slab_bytes))
    terms = written(item_terms(items, slabs))
    shards = index.filter("term = ''").withColumns({"weight": F.lit(0).cast("long"), "items": F.array().cast("array<bigint>")})
    out = None
    for slab in range(slabs):
        own = terms.filter(F.col("slab") == slab)
        df = index.select("term", "n").join(F.broadcast(own.select("term").distinct()), "term").groupBy("term").agg(F.sum("n").alias("df"))
        weight = F.floor(1000 * F.log((2.0 * n + 2) / (2 * F.col("df") + 1))).cast("long")
        asked = own.join(df.select("term", weight.alias("weight")), "term").filter("weight > 0").groupBy("term").agg(F.first("weight").alias("weight"), F.collect_list(F.struct("item_id")).alias("items"))
        postings = index.join(F.broadcast(asked.withColumn("items", F.transform("items", lambda x: x["item_id"]))), "term").select(*shards.columns)
        best = postings.unionByName(shards).groupBy("shard").applyInArrow(lambda t: _search_shard(t, n, total, k), "item_id long, doc_id long, score long")
        best = written(_ranked(best, k))
        out = best if out is None else out.unionByName(best)
    return out


def _ranked(best: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
