"""Ranked lexical search over whole documents, best documents first.

One pass over the texts writes an index in shards: for the terms of the searched items, each term's
posting list in the order of the shard's documents, with counts and document lengths. Corpus counts are
summed from it. A second pass over the index searches every shard. A sparse table over the impacts of the
postings answers where a list is largest within any interval of documents. The search keeps intervals of
documents, each with the sum of its terms' largest impacts, which bounds every score inside; it takes the
intervals with the highest bounds, scores the document where the largest impact lies, and splits the
interval there. Intervals that cannot reach an item's k-th score are dropped, and the search of an item
ends when none is left. Items walk side by side, several intervals at a time.

What a task holds is bounded by a shard and a group of items. Each task sends at most k rows an item;
those lists are merged in two levels. Items are taken in blocks of a bounded number of items and bytes,
so that what is broadcast is bounded as well.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tierwatch.functions.shared import stage
from tierwatch.llm import texts, wordtable
from tierwatch.llm.spans import TERM_BYTES, class_spans

SHARD_BYTES = 16 << 20
BLOCK_ITEMS = 4096
BLOCK_BYTES = 8 << 20
GROUP_ITEMS = 32
FIRST_TAKE = 8
MERGE_PARTS = 64
NO_ID = np.iinfo(np.int64).max


def item_terms(text: bytes) -> list[bytes]:
    """The distinct terms of one text, in the order in which they come."""
    data = texts.lower_ascii(np.frombuffer(text, np.uint8))
    starts, ends, _ = class_spans(data, np.array([0, len(data)]), TERM_BYTES)
    raw = data.tobytes()
    return list(dict.fromkeys(raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())))


class Terms:
    """The terms of a block of items, found in texts by hash and then byte by byte."""

    def __init__(self, terms: list[bytes]):
        self.n = len(terms)
        lengths = np.array([len(t) for t in terms], np.int64)
        self.bytes = np.frombuffer(b"".join(terms), np.uint8)
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        hashes = texts.span_hashes(self.bytes, self.starts, self.ends)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which spans are terms, and which terms those are."""
        if not self.n or not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hashes = texts.span_hashes(data, starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, hashes), self.n - 1)
        hit = np.flatnonzero(self.hashes[at] == hashes)
        term = self.order[at[hit]]
        size = ends[hit] - starts[hit]
        same = size == self.ends[term] - self.starts[term]
        hit, term, size = hit[same], term[same], size[same]
        if not len(hit):
            return hit, term
        heads = np.cumsum(size) - size
        place = np.arange(size.sum()) - np.repeat(heads, size)
        equal = data[np.repeat(starts[hit], size) + place] == self.bytes[np.repeat(self.starts[term], size) + place]
        whole = np.logical_and.reduceat(equal, heads)
        return hit[whole], term[whole]


INDEX = (
    "shard long, n_docs long, n_tokens long, terms array<int>, df array<int>, doc_ids binary, lengths binary, "
    "docs binary, counts binary"
)


def index(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """Posting lists of `terms` over all rows of `docs`, one row a shard.

    n_docs and n_tokens count all documents with a term of any kind. Only documents that hold one of
    `terms` are listed, by ascending doc_id, nulls last.
    """
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def build(batches) -> Iterator[pa.RecordBatch]:
        known = Terms(shared.value)
        numbers = wordtable.block_numbers()
        for table in wordtable.gathered(batches, SHARD_BYTES):
            ids = table.column(0).combine_chunks()
            order = pa.compute.sort_indices(ids, null_placement="at_end").to_numpy()
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            lengths, keys, base = np.zeros(len(ids), np.int64), [np.zeros(0, np.int64)], 0
            for first, end, data, offsets in texts.slices(table.column(1).combine_chunks()):
                data = texts.lower_ascii(data)
                starts, ends, owner = class_spans(data, offsets, TERM_BYTES)
                owner = rank[owner + first]
                lengths += np.bincount(owner, minlength=len(ids))
                hit, term = known.find(data, starts, ends)
                keys.append(term * len(ids) + owner[hit])
            pairs, counts = np.unique(np.concatenate(keys), return_counts=True)
            term, doc = np.divmod(pairs, max(len(ids), 1))
            listed = np.unique(doc)
            own, df = np.unique(term, return_counts=True)
            filled = pa.compute.fill_null(ids, NO_ID).to_numpy()[order]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([next(numbers)], pa.int64()),
                    pa.array([int((lengths > 0).sum())], pa.int64()),
                    pa.array([int(lengths.sum())], pa.int64()),
                    pa.array([own.tolist()], pa.list_(pa.int32())),
                    pa.array([df.tolist()], pa.list_(pa.int32())),
                    pa.array([filled[listed].astype("<i8").tobytes()], pa.binary()),
                    pa.array([lengths[listed].astype("<i8").tobytes()], pa.binary()),
                    pa.array([np.searchsorted(listed, doc).astype("<i4").tobytes()], pa.binary()),
                    pa.array([counts.astype("<i4").tobytes()], pa.binary()),
                ],
                [part.split()[0] for part in INDEX.split(", ")],
            )

    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return whole.mapInArrow(build, INDEX)


class Postings:
    """The lists of one shard, laid end to end, with impacts and a sparse table of where they are largest."""

    def __init__(self, terms, df, docs, impacts, n_docs: int, n_terms: int):
        self.n = n_docs
        self.docs, self.impacts = docs, impacts
        ends = np.cumsum(df)
        # Lists of terms that the shard lacks are empty.
        self.first = np.zeros(n_terms, np.int64)
        self.end = np.zeros(n_terms, np.int64)
        self.first[terms], self.end[terms] = ends - df, ends
        self.keys = np.repeat(np.arange(len(df)), df) * n_docs + docs
        self.slot = np.zeros(n_terms, np.int64)
        self.slot[terms] = np.arange(len(terms))
        levels = [np.arange(len(docs), dtype=np.int32)]
        span = 1
        # Levels are as deep as the longest list; an interval never leaves its list.
        while 2 * span <= int(df.max(initial=0)):
            left, right = levels[-1][: -span or None], levels[-1][span:]
            level = levels[-1].copy()
            level[: len(left)] = np.where(impacts[left] >= impacts[right], left, right)
            levels.append(level)
            span *= 2
        self.levels = np.stack(levels)

    def largest(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position and value of the largest impact in each interval [a, b) of positions; 0 where it is empty."""
        full = b > a
        level = np.frexp(np.maximum(b - a, 1))[1] - 1
        left = self.levels[level, np.where(full, a, 0)]
        right = self.levels[level, np.where(full, b - (1 << level), 0)]
        at = np.where(self.impacts[left] >= self.impacts[right], left, right)
        return at, np.where(full, self.impacts[at], 0)

    def position(self, terms: np.ndarray, doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Where `doc` stands, or would stand, in the part [a, b) of each term's list."""
        return np.clip(np.searchsorted(self.keys, self.slot[terms] * self.n + doc), a, b)


class Best:
    """The k best (score, doc_id) of every item, kept from shard to shard."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.scores = np.zeros((items, k), np.int64)
        self.ids = np.full((items, k), NO_ID, np.int64)

    def add(self, item: np.ndarray, score: np.ndarray, doc_id: np.ndarray) -> None:
        touched = np.unique(item)
        item = np.concatenate([item, np.repeat(touched, self.k)])
        score = np.concatenate([score, self.scores[touched].ravel()])
        doc_id = np.concatenate([doc_id, self.ids[touched].ravel()])
        order = np.lexsort((doc_id, -score, item))
        heads = np.searchsorted(item[order], touched)
        chosen = order[heads[:, None] + np.arange(self.k)]
        self.scores[touched], self.ids[touched] = score[chosen], doc_id[chosen]


def search_shard(postings: Postings, doc_ids: np.ndarray, items: np.ndarray, terms: np.ndarray, used: np.ndarray, best: Best) -> None:
    """Bring `best` up to date with one shard for `items`; `terms` (items, widest) are their terms, `used` which are real."""
    a = np.where(used, postings.first[terms], 0)
    b = np.where(used, postings.end[terms], 0)
    at, value = postings.largest(a, b)
    # A node is an interval of documents: its item, where it lies in every list, its bound, its top document.
    node_item, bound = np.arange(len(items)), value.sum(axis=1)
    top = postings.docs[at[np.arange(len(items)), value.argmax(axis=1)]] if len(postings.docs) else np.zeros(len(items), np.int64)
    low = np.zeros(len(items), np.int64)
    take = FIRST_TAKE
    while True:
        least, last = best.scores[items, -1], best.ids[items, -1]
        floor, own = least[node_item], bound
        alive = (own > floor) | ((own == floor) & (own > 0) & (doc_ids[np.minimum(low, len(doc_ids) - 1)] < last[node_item]))
        node_item, a, b, bound, top, low = (x[alive] for x in (node_item, a, b, bound, top, low))
        if not len(node_item):
            return
        order = np.lexsort((low, -bound, node_item))
        nth = np.arange(len(order)) - np.searchsorted(node_item[order], node_item[order])
        taken = order[nth < take]
        who, own, left, right, doc = node_item[taken], terms[node_item[taken]], a[taken], b[taken], top[taken]
        position = postings.position(own, doc[:, None], left, right)
        there = position < right
        there &= postings.docs[np.minimum(position, len(postings.docs) - 1)] == doc[:, None]
        score = np.where(there, postings.impacts[np.minimum(position, len(postings.docs) - 1)], 0).sum(axis=1)
        best.add(items[who], score, doc_ids[doc])
        rest = np.ones(len(node_item), bool)
        rest[taken] = False
        halves = ((left, position, low[taken]), (position + there, right, doc + 1))
        parts = [(node_item[rest], a[rest], b[rest], bound[rest], top[rest], low[rest])]
        for one, two, begin in halves:
            at, value = postings.largest(one, two)
            widest = value.argmax(axis=1)
            rows = np.arange(len(who))
            parts.append((who, one, two, value.sum(axis=1), postings.docs[at[rows, widest]], begin))
        node_item, a, b, bound, top, low = (np.concatenate(x) for x in zip(*parts))
        take = min(2 * take, 1024)


def term_weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def impacts(weight: np.ndarray, tf: np.ndarray, length: np.ndarray, n_docs: int, n_tokens: int) -> np.ndarray:
    m = 10 + (90 * length * n_docs) // n_tokens
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def _search_block(docs: DataFrame, items: list[tuple], k: int) -> DataFrame:
    """The k best documents of the items (item_id, text bytes) of one block."""
    spark = docs.sparkSession
    wanted = [item_terms(text) for _, text in items]
    terms = sorted({t for own in wanted for t in own})
    slot = {t: i for i, t in enumerate(terms)}
    shards = stage(index(docs, terms), "lexical-index", codec="zstd")
    counts = shards.agg(F.sum("n_docs").alias("docs"), F.sum("n_tokens").alias("tokens")).first()
    n_docs, n_tokens = counts["docs"] or 0, counts["tokens"] or 0
    pairs = shards.select(F.explode(F.arrays_zip("terms", "df")).alias("p")).select("p.terms", F.col("p.df").cast("long").alias("df"))
    found = pairs.groupBy("terms").agg(F.sum("df").alias("df")).toArrow()  # at most one row for each term of the block
    weight = np.zeros(len(terms), np.int64)
    weight[found.column("terms").to_numpy()] = term_weights(found.column("df").to_numpy(), n_docs)
    own = [[s for t in words if weight[s := slot[t]] > 0] for words in wanted]
    widest = max([len(x) for x in own], default=0)
    table = np.zeros((len(items), widest), np.int32)
    used = np.zeros((len(items), widest), bool)
    for i, x in enumerate(own):
        table[i, : len(x)], used[i, : len(x)] = x, True
    shared = spark.sparkContext.broadcast((table, used, weight))

    def look_up(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table, used, weight = shared.value
        best = Best(len(table), k)
        for batch in batches:
            for row in range(batch.num_rows):
                named = lambda name, kind, row=row, batch=batch: np.frombuffer(batch.column(name)[row].as_py(), kind)
                doc_ids = named("doc_ids", "<i8")
                if not len(doc_ids) or not table.shape[1]:
                    continue
                here, df = (np.array(batch.column(name)[row].as_py(), np.int64) for name in ("terms", "df"))
                list_docs, tf, length = named("docs", "<i4").astype(np.int64), named("counts", "<i4").astype(np.int64), named("lengths", "<i8")
                value = impacts(np.repeat(weight[here], df), tf, length[list_docs], n_docs, n_tokens)
                postings = Postings(here, df, list_docs, value, len(doc_ids), len(weight))
                for first in range(0, len(table), GROUP_ITEMS):
                    some = np.arange(first, min(first + GROUP_ITEMS, len(table)))
                    search_shard(postings, doc_ids, some, table[some], used[some], best)
        item, place = np.nonzero(best.scores > 0)
        ids = best.ids[item, place]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(item, pa.int32()),
                pa.array(ids, pa.int64(), mask=ids == NO_ID),
                pa.array(best.scores[item, place], pa.int64()),
                pa.array(np.full(len(item), TaskContext.get().partitionId() % MERGE_PARTS), pa.int32()),
            ],
            ["item", "doc_id", "score", "part"],
        )

    lists = shards.drop("shard", "n_docs", "n_tokens").mapInArrow(look_up, "item int, doc_id long, score long, part int")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for by in (["item", "part"], ["item"]):
        nth = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        lists = lists.withColumn("rank", nth).where(F.col("rank") <= k)
    names = spark.createDataFrame(
        pa.table([pa.array(range(len(items)), pa.int32()), pa.array([i for i, _ in items], pa.int64())], ["item", "item_id"])
    )
    # At most BLOCK_ITEMS rows.
    return lists.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The k highest-scoring rows of `docs` (doc_id, text) for each row of `items` (item_id, text):
    item_id, rank, doc_id, score.

    Terms are runs of ASCII letters, digits and all characters beyond ASCII, A-Z in lower case; each
    distinct term of an item counts once. Equal scores go by ascending doc_id, null ids last. Scores are
    above 0. Null and empty texts have no terms: such documents are not counted and such items have no
    rows. Rows that repeat a doc_id are documents of their own; rows that repeat an item_id are items of
    their own, each with ranks from 1. Other columns are ignored; an empty table on either side gives an
    empty result.
    """
    asked = items.select(
        F.col("item_id").cast("long").alias("item_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    asked = stage(asked.withColumn("nth", F.monotonically_increasing_id()), "items", codec="zstd")
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    blocks = max(math.ceil(size["n"] / BLOCK_ITEMS), math.ceil((size["bytes"] or 0) / BLOCK_BYTES), 1)
    out = None
    for block in range(blocks):
        some = asked.where(F.pmod(F.col("nth"), F.lit(blocks)) == block).select("item_id", "text").toArrow()
        rows = list(zip(some.column("item_id").to_pylist(), some.column("text").to_pylist()))
        found = _search_block(docs, rows, k)
        out = found if out is None else out.unionByName(found)
    return out
