"""Language-model scores by a probabilistic suffix tree over characters.

A text is its words in lower case, each followed by a blank or the end. Every byte is a symbol of its
own. Contexts of up to `DEPTH` symbols that occur at least `LEAST_COUNT` times are candidates, and a
candidate stays if the distribution of its next symbol diverges enough from that of
the context without its oldest symbol, or if a longer one stays. Distributions are smoothed towards
the shorter context; a symbol is scored in the state of the longest context that ends before it.

The tree is a table that grows with the corpus and never leaves Spark: one row per context and next
symbol that occurs in any document. Every block of documents brings its distinct rows and gets their
probabilities back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tierwatch.functions.shared import join_shuffled, stage
from tierwatch.llm import texts, wordtable
from tierwatch.llm.folds import held_out

DEPTH = 5
LEAST_COUNT = 2  # a context seen once has no distribution
SYMBOLS = 257  # the end and all bytes
BITS = 9
SMOOTHING = 8.0
END = 0
BLOCK_BYTES = 16 << 20
COUNT_BYTES = 1 << 20
MERGE_GRAMS = 1 << 19  # counted grams that are held before equal ones are added up


def symbol_table() -> np.ndarray:
    """The symbol of each byte; the end of a text is symbol 0."""
    return np.arange(1, 257, dtype=np.uint16)


@dataclass(frozen=True)
class SuffixTree:
    """The contexts that stay, and log10 probabilities of symbols after them and of bytes in a symbol.

    For a corpus that fits one process; `gram_scores` gives the same numbers as a table."""

    contexts: list[tuple[int, int]]  # (length, code), shorter ones first
    log_symbols: np.ndarray
    log_bytes: np.ndarray

    def tables(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """The codes of each length from 1 on, sorted, and their states."""
        length, code = (np.array(x, np.int64) for x in zip(*self.contexts))
        found = []
        for size in range(1, DEPTH + 1):
            state = np.flatnonzero(length == size)
            state = state[np.argsort(code[state])]
            found.append((code[state], state))
        return found

    def states(self, code: np.ndarray, tables: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The longest context that stays at the end of each code of `DEPTH` symbols."""
        state = np.zeros(len(code), np.int64)
        for size, (codes, states) in enumerate(tables, 1):
            if len(codes):
                own = code & ((1 << BITS * size) - 1)
                at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
                state = np.where(codes[at] == own, states[at], state)
        return state

    def scores(self, data: np.ndarray, offsets: np.ndarray, tables: list) -> np.ndarray:
        """log10 of the probability of each normalised text."""
        symbols, lengths = padded(data, offsets)
        logs = self.log_symbols[self.states(context_codes(symbols), tables), symbols[DEPTH:]]
        heads = np.concatenate([[0], np.cumsum(lengths + 1 + DEPTH)])[:-1]
        # The padding before each text is not part of it.
        sums = np.concatenate([[0.0], np.cumsum(logs, dtype=np.float64)])
        spelled = np.concatenate([[0.0], np.cumsum(self.log_bytes[data], dtype=np.float64)])
        return sums[heads + lengths + 1] - sums[heads] + spelled[offsets[1:]] - spelled[offsets[:-1]]


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of each text after `DEPTH` ends, and an end after it; and the lengths of the texts."""
    lengths = np.diff(offsets)
    place = np.arange(len(data)) + np.repeat(np.arange(1, len(lengths) + 1) * DEPTH + np.arange(len(lengths)), lengths)
    symbols = np.full(len(data) + len(lengths) * (DEPTH + 1), END, np.uint16)
    symbols[place] = symbol_table()[data]
    return symbols, lengths


def context_codes(symbols: np.ndarray) -> np.ndarray:
    """The code of the `DEPTH` symbols before each position from `DEPTH` on; the newest is the lowest."""
    n = len(symbols) - DEPTH
    code = np.zeros(n, np.int64)
    for back in range(DEPTH, 0, -1):
        code = code << BITS | symbols[DEPTH - back : DEPTH - back + n]
    return code


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Texts with one blank between words, their offsets, all words, and the words before each text."""
    data = texts.lower_ascii(data)
    starts, ends, owner = texts.word_spans(data, offsets)
    words = texts.take_spans(data, starts, ends)
    before = np.searchsorted(owner, np.arange(len(offsets)))
    last = np.zeros(len(starts), bool)
    last[before[1:][np.diff(before) > 0] - 1] = True
    size = (ends - starts) + ~last
    cuts = np.concatenate([[0], np.cumsum(size)])
    clean = np.full(int(cuts[-1]), 32, np.uint8)
    length = ends - starts
    flat, cut = texts.byte_view(words)
    clean[np.arange(len(flat)) + np.repeat(cuts[:-1] - cut[:-1], length)] = flat
    return clean, cuts[before], words, before


ROWS = "kind string, block long, doc_id long, learned boolean, place long, n long, payload binary, words binary"
KINDS = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]


def _gram_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each symbol of normalised texts with the `DEPTH` before it, as one code, and the cuts between texts."""
    symbols, lengths = padded(data, offsets)
    grams = context_codes(symbols) << BITS | symbols[DEPTH:]
    heads = np.concatenate([[0], np.cumsum(lengths + 1 + DEPTH)])
    inside = np.ones(len(grams), bool)
    for back in range(1, DEPTH + 1):
        inside[heads[1:-1] - back] = False  # the padding before each text is not part of it
    return grams[inside], np.concatenate([[0], np.cumsum(lengths + 1)])


def _heads(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def _counted(grams: np.ndarray, learned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams in order, and how many of each are of training documents.

    The flag is the lowest bit of a gram, so that one sort in place does it, with no table beside it."""
    coded = grams << 1 | learned
    coded.sort()
    first = _heads(coded >> 1)
    return coded[first] >> 1, np.add.reduceat(coded & 1, first) if len(first) else first


def _summed(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    key = np.concatenate(keys)
    order = np.argsort(key)
    key = key[order]
    first = _heads(key)
    return key[first], np.add.reduceat(np.concatenate(times)[order], first) if len(first) else first


def _blocks(batches) -> Iterator[pa.RecordBatch]:
    """For every block its documents (normalised text, positions of the words), and its words and its
    contexts with the next symbol, each with the times that training documents have them."""
    numbers = wordtable.block_numbers()
    names = [part.split()[0] for part in ROWS.split(", ")]
    for table in wordtable.gathered(batches, BLOCK_BYTES, "text"):
        block = next(numbers)
        coded, ids, learned, text, counts = [], [], [], [], []
        keys, seen = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        flags = table.column("learned").to_numpy().astype(bool)
        held = 0
        for first, end, data, offsets in texts.slices(table.column("text").combine_chunks(), COUNT_BYTES):
            clean, cuts, words, before = normalised(data, offsets)
            coded.append(words.dictionary_encode())
            counts.append(np.diff(before))
            cell = cuts.tolist()
            raw = clean.tobytes()
            text += [raw[a:b] for a, b in zip(cell, cell[1:])]
            for low, high in _runs(cuts):
                grams, ends = _gram_codes(clean[cuts[low] : cuts[high]], cuts[low : high + 1] - cuts[low])
                found, times = _counted(grams, np.repeat(flags[first + low : first + high], np.diff(ends)))
                keys.append(found)
                seen.append(times)
                held += len(found)
                if held >= MERGE_GRAMS + len(keys[0]):
                    found, times = _summed(keys, seen)
                    keys, seen, held = [found], [times], len(found)
        counts = np.concatenate(counts)
        index, dictionary = wordtable.frequent_first(pa.chunked_array(coded).unify_dictionaries().combine_chunks())
        times = np.bincount(index[np.repeat(flags, counts)], minlength=len(dictionary))
        cuts = np.concatenate([[0], np.cumsum(counts)]).tolist()
        packed = [wordtable.pack_positions(index[a:b]) for a, b in zip(cuts, cuts[1:])]

        def rows(kind, n, doc_id=None, learned=None, place=None, count=None, payload=None, words=None, block=block):
            columns = [np.repeat(kind, n), np.full(n, block), doc_id, learned, place, count, payload, words]
            return pa.RecordBatch.from_arrays(
                [pa.nulls(n, k) if c is None else (c.cast(k) if isinstance(c, pa.Array) else pa.array(c, k))
                 for c, k in zip(columns, KINDS)], names
            )

        documents = rows(
            "doc", len(text), table.column("doc_id").combine_chunks(), flags, count=counts, payload=text, words=packed
        )
        for first in range(0, len(text), 2000):
            yield documents.slice(first, 2000)
        entries = rows("word", len(dictionary), place=np.arange(len(dictionary)), count=times, payload=dictionary)
        for first in range(0, len(dictionary), 50_000):
            yield entries.slice(first, 50_000)
        grams, times = _summed(keys, seen)
        entries = rows("gram", len(grams), place=grams, count=times)
        for first in range(0, len(grams), 50_000):
            yield entries.slice(first, 50_000)
        pa.default_memory_pool().release_unused()


def _runs(cuts: np.ndarray, limit: int = COUNT_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts of about `limit` bytes, at least one text each."""
    first, n = 0, len(cuts) - 1
    while first < n:
        end = min(max(int(np.searchsorted(cuts, cuts[first] + limit, "right")) - 1, first + 1), n)
        yield first, end
        first = end


def _count(batches) -> Iterator[pa.RecordBatch]:
    """Contexts of `DEPTH` symbols with the next one, and how often."""
    for batch in batches:
        for _, _, data, offsets in texts.slices(batch.column(0), COUNT_BYTES):
            grams, _ = _gram_codes(data, offsets)
            found, times = np.unique(grams, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(times)], ["gram", "n"])


def newest(code: Column, length: int) -> Column:
    """The code of the newest `length` symbols."""
    return code.bitwiseAND((1 << BITS * length) - 1)


def context_levels(grams: DataFrame) -> tuple[list[DataFrame], list[DataFrame | None]]:
    """For each length the rows (code, symbol, n, whole) of all contexts, and the codes of those that stay.

    `grams` (gram, n) holds every gram once, also those that no training document has, with n = 0.
    """
    symbol = F.col("gram").bitwiseAND((1 << BITS) - 1).cast("int")
    cells = [grams.select(F.shiftright("gram", BITS).alias("code"), symbol.alias("symbol"), "n")]
    for length in reversed(range(DEPTH)):
        shorter = cells[0].groupBy(newest(F.col("code"), length).alias("code"), "symbol").agg(F.sum("n").alias("n"))
        cells.insert(0, stage(shorter, f"cells-{length}", codec="zstd"))
    total = cells[0].agg(F.sum("n")).first()[0] or 0
    context = Window.partitionBy("code")  # at most SYMBOLS rows each
    levels, diverged = [cells[0].withColumn("whole", F.lit(total).cast("long"))], [None]
    for length in range(1, DEPTH + 1):
        parent = levels[-1].select(F.col("code").alias("short"), "symbol", (F.col("n") / F.greatest("whole", F.lit(1))).alias("p"))
        gain = F.when(F.col("n") > 0, F.col("n") * F.log(F.col("n") / F.col("p"))).otherwise(0.0)
        level = (
            cells[length].withColumn("short", newest(F.col("code"), length - 1))
            .transform(lambda level, parent=parent: join_shuffled(level, parent, ["short", "symbol"]))
            .withColumn("whole", F.sum("n").over(context))
            .withColumn("kinds", F.count_if(F.col("n") > 0).over(context))
            .withColumn("gain", F.sum(gain).over(context) - F.col("whole") * F.log(F.greatest("whole", F.lit(1))))
            .withColumn("apart", (F.col("whole") >= LEAST_COUNT) & (F.col("gain") > 0.5 * F.col("kinds") * float(np.log(max(total, 1)))))
        )
        level = stage(level.select("code", "symbol", "n", "whole", "apart"), f"level-{length}", codec="zstd")
        levels.append(level.drop("apart"))
        diverged.append(level.where("apart").select("code").distinct())
    stay: list[DataFrame | None] = [None] * (DEPTH + 1)
    for length in reversed(range(1, DEPTH + 1)):
        own = diverged[length]
        if length < DEPTH:  # a context brings all its shorter ones
            own = own.union(stay[length + 1].select(newest(F.col("code"), length).alias("code"))).distinct()
        stay[length] = stage(own, f"stay-{length}", codec="zstd")
    return levels, stay


def gram_scores(grams: DataFrame) -> DataFrame:
    """(gram, log): log10 of the smoothed probability of the symbol after the longest context that stays."""
    levels, stay = context_levels(grams)
    smooth = levels[0].select("code", "symbol", ((F.col("n") + 0.5) / (F.col("whole") + 0.5 * SYMBOLS)).alias("p"))
    for length in range(1, DEPTH + 1):
        above = smooth.select(F.col("code").alias("short"), "symbol", F.col("p").alias("above"))
        own = (F.col("n") + SMOOTHING * F.col("above")) / (F.col("whole") + SMOOTHING)
        smooth = (
            join_shuffled(levels[length], stay[length].withColumn("stays", F.lit(True)), "code", "left")
            .withColumn("short", newest(F.col("code"), length - 1))
            .transform(lambda level, above=above: join_shuffled(level, above, ["short", "symbol"]))
            .select("code", "symbol", F.when(F.col("stays"), own).otherwise(F.col("above")).alias("p"))
        )
        smooth = stage(smooth, f"smooth-{length}", codec="zstd")
    gram = F.shiftleft("code", BITS).bitwiseOR(F.col("symbol").cast("long"))
    return smooth.select(gram.alias("gram"), F.log10("p").alias("log"))


def grow(documents: DataFrame) -> tuple[list[tuple[int, int]], np.ndarray]:
    """The contexts that stay, shorter ones first, and the smoothed distributions of the next symbol.

    On the driver: for a corpus that fits one process. `corpus_scores` does not use it."""
    counted = documents.mapInArrow(_count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    levels, stay = context_levels(stage(counted, "grams", codec="zstd"))
    rows = [(0, r["code"], r["symbol"], r["n"]) for r in levels[0].collect()]
    for size in range(1, DEPTH + 1):
        own = levels[size].join(stay[size], "code", "left_semi").collect()
        rows += [(size, r["code"], r["symbol"], r["n"]) for r in own]
    if not rows:
        return [(0, 0)], np.full((1, SYMBOLS), 1.0 / SYMBOLS)
    contexts = sorted({r[:2] for r in rows})
    number = {c: i for i, c in enumerate(contexts)}
    counts = np.zeros((len(contexts), SYMBOLS))
    for size, code, symbol, n in rows:
        counts[number[size, code], symbol] = n
    smooth = np.empty_like(counts)
    for i, (size, code) in enumerate(contexts):
        if not size:
            smooth[i] = (counts[i] + 0.5) / (counts[i].sum() + 0.5 * SYMBOLS)
            continue
        above = smooth[number[size - 1, code & ((1 << BITS * (size - 1)) - 1)]]
        smooth[i] = (counts[i] + SMOOTHING * above) / (counts[i].sum() + SMOOTHING)
    return contexts, smooth


def byte_shares(counts: np.ndarray) -> np.ndarray:
    """The share of each byte in its symbol, smoothed."""
    table = symbol_table()
    filled = counts + 0.5
    sums = np.bincount(table, filled, SYMBOLS)
    return filled / sums[table]


def corpus_scores(docs: DataFrame, modulus: int = 5, remainder: int = 1) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Both scores are log10 probabilities of the lower-cased words and the end: `base_score` by the
    shares of the tokens in the training documents, `score` by the suffix tree. Null texts are empty:
    an end alone. A null doc_id counts as held out; repeated ids are scored row by row. Without
    training documents every count is 0. Other columns are ignored; an empty table gives an empty
    result.
    """
    learned = ~held_out(F.col("doc_id"), modulus, remainder)
    whole = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), learned.alias("learned"), F.col("text").cast("string").alias("text")
    )
    rows = wordtable.staged_by_block(whole.mapInArrow(_blocks, ROWS), "corpus")
    documents = rows.where("kind = 'doc'")
    words = rows.where("kind = 'word'").select("block", "place", "n", "payload")
    word = Window.partitionBy("payload")  # one row per block at most
    counted = words.withColumn("c", F.sum("n").over(word)).withColumn(
        "first", F.row_number().over(word.orderBy("block")) == 1
    )
    counted = stage(counted.select("block", "place", "n", "c", "first"), "counts", codec="zstd")
    sums = counted.agg(F.sum("n").alias("n"), F.count_if(F.col("first") & (F.col("c") > 0)).alias("v")).first()
    ends = documents.where("learned").count()
    train_tokens, distinct = (sums["n"] or 0) + ends, sums["v"] + (ends > 0)
    grams = rows.where("kind = 'gram'").select("block", F.col("place").alias("gram"), "n")
    logs_of = gram_scores(stage(grams.groupBy("gram").agg(F.sum("n").alias("n")), "grams", codec="zstd"))
    scale = train_tokens + 0.5 * (distinct + 1)

    def score(found, entries):
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        names = ["doc_id", "learned", "n_tokens", "n_known", "base_score", "score"]
        if not found.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names)
        is_word = entries.column("word").to_numpy()
        keys, values = entries.column("key").to_numpy(), entries.column("value").to_numpy()
        place, c = keys[is_word], values[is_word].astype(np.int64)
        order = np.argsort(keys[~is_word])
        known_grams, gram_logs = keys[~is_word][order], values[~is_word][order]
        times = np.zeros(int(place.max(initial=-1)) + 1, np.int64)
        times[place] = c
        logs = np.log10((times + 0.5) / scale)
        end = np.log10((ends + 0.5) / scale)
        base, known = [], []
        for packed in found.column("words"):
            index = wordtable.unpack_positions(packed.as_py())
            base.append(float(logs[index].sum() + end))
            known.append(int((times[index] > 0).sum()) + (ends > 0))
        model = []
        for _, _, data, offsets in texts.slices(found.column("payload").combine_chunks(), COUNT_BYTES):
            codes, cuts = _gram_codes(data, offsets)
            codes, place = np.unique(codes, return_inverse=True)
            log = gram_logs[np.searchsorted(known_grams, codes)]
            total = np.concatenate([[0.0], np.cumsum(log[place])])
            model.append(np.diff(total[cuts]))
        columns = [
            found.column("doc_id"), found.column("learned"), np.asarray(found.column("n").to_numpy()) + 1, known,
            base, np.concatenate(model),
        ]
        pa.default_memory_pool().release_unused()
        return pa.table(columns, names)

    own = documents.select("block", "doc_id", "learned", "n", "payload", "words")
    words_back = counted.select("block", F.lit(True).alias("word"), F.col("place").alias("key"), F.col("c").cast("double").alias("value"))
    grams_back = join_shuffled(grams, logs_of, "gram").select("block", F.lit(False).alias("word"), F.col("gram").alias("key"), F.col("log").alias("value"))
    result = (
        own.groupBy("block")
        .cogroup(words_back.unionByName(grams_back).groupBy("block"))
        .applyInArrow(
            score, "doc_id long, learned boolean, n_tokens long, n_known long, base_score double, score double"
        )
    )
    return result.select(
        "doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known",
        F.lit(int(train_tokens)).cast("long").alias("train_tokens"), "base_score", "score",
    )
