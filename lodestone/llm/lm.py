"""Language-model scores of texts by online logistic context mixing, learned from the corpus.

Words and one end are a text's tokens. Counts of all training words are grouped over the corpus; the most frequent
`head` words, a bounded table, go to every task, all others stay distributed and are joined to the texts' rare words.
A token is guessed from the two words before it; a token that is not is coded as a symbol and then as a word of its
symbol (see `mixer`). What follows which two words is as much as the corpus holds, whatever the words' rank. It stays
distributed: blocks of texts send their distinct (two words, follower) pairs, dealt by a hash of the two words into
buckets whose number grows with the tokens, and within a bucket 40 bits of the hash are compared, so that collisions do
not become more frequent as the corpus grows. Each pair gets back a byte: what the counts of all training texts guess
there, and whether it is right; a training token's own count is taken off. Word groups come from co-occurrence counts
over every training text. Weights, refinement and the guess's tables are learned online in a pass over every training
text: each task goes through its blocks, then the tasks' parameters are averaged and scoring holds them fixed. A rare
word costs its share among rare words, and any unknown word costs the share that Good-Turing gives to all unknown words,
so that the probabilities of all tokens sum to at most one, as the base's do.

Bounds: `head` words. Tables of symbols have the size of their alphabets (`mixer.SLOTS`).
Blocks follow the partitions of the input, so that scores of the same rows dealt otherwise differ slightly.
Defined results: a null or empty text is the end alone; a row without an id is training text; repeated rows count and
score each; without training text every base score is 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import mixer
from lodestone.llm._common import checkpoint, fold

FOLDS, HELD_OUT = 7, 2
ANCHORS = 32
_FAN, _PART = 64, 1 << 16
_HELD_WORDS, _BLOCK_TOKENS, _BUCKET_PAIRS, _CONTEXT_BITS = 400_000, 1 << 18, 1 << 21, 32
#: The parts that words are dealt into, at least and at most.
_PARTS = (16, 4096)
#: A partition has fewer blocks, and a block fewer texts, than 2 to this power.
_BLOCK_BITS = 18
_BLOCKS = "block long, ids array<bigint>, train array<boolean>, sizes array<int>, bytes array<bigint>, words binary"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def squeezed(a: np.ndarray) -> bytes:
    """An array's bytes, compressed plane by plane."""
    return pa.compress(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes(), codec="zstd", asbytes=True) if len(a) else b""


def restored(data: bytes, dtype, n: int) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    if not n:
        return np.zeros(0, dtype)
    planes = np.frombuffer(pa.decompress(data, decompressed_size=n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(dtype).ravel()


def _batch(schema: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), [c.split()[0] for c in schema.split(", ")])


def packed(words: list[bytes]) -> bytes:
    """Words in one compressed piece; sorted ones take little."""
    joined = b" ".join(words)
    return len(joined).to_bytes(8, "little") + pa.compress(joined, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> list[bytes]:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True).split()


def dealt(words: list[bytes], parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, places) of the words by a hash."""
    part = np.fromiter(map(crc32, words), np.uint32, len(words)) % np.uint32(parts)
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.append(True, part[order][1:] != part[order][:-1])) if len(order) else []
    for places in np.split(order, cuts[1:]) if len(order) else ():
        yield int(part[places[0]]), places


def word_counts(train: DataFrame, parts: int, tasks: int) -> DataFrame:
    """(part, task, words binary, counts binary): every word of the training texts and its count, dealt by a hash.

    Tasks count before the shuffle; a part of all tasks is put together in steps.
    """
    schema = "part long, task long, words binary, counts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            words = sorted(held)
            counts = np.fromiter(map(held.__getitem__, words), np.int64, len(words))
            rows = [(p, packed([words[i] for i in at.tolist()]), squeezed(counts[at])) for p, at in dealt(words, parts)]
            held.clear()
            return _batch("part, words, counts", *(pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))))

        for b in batches:
            for t in b.column(0).cast(pa.binary()):
                held.update(words_of(t.as_py()))
                if len(held) >= _HELD_WORDS:
                    yield flush()
        if held:
            yield flush()

    def together(pdf):
        words = [unpacked(x) for x in pdf["words"]]
        counts = np.concatenate([restored(x, np.int64, len(w)) for x, w in zip(pdf["counts"], words)])
        table = pa.table({"w": pa.array([w for some in words for w in some], pa.binary()), "c": counts})
        table = table.group_by("w").aggregate([("c", "sum")]).sort_by("w")
        return pdf.iloc[:1].assign(words=[packed(table["w"].to_pylist())], counts=[squeezed(table["c_sum"].to_numpy())])[["part", "task", "words", "counts"]]

    return _in_steps(train.select("text").mapInArrow(run, "part long, words binary, counts binary"), tasks, ["part"], together, schema)


def count_classes(counts: np.ndarray) -> np.ndarray:
    """Classes of counts, at most 16,384, in their order; a count of one is alone in the first."""
    return np.floor(np.log2(counts) * 256).astype(np.int64)


def _counted(row) -> tuple[list[bytes], np.ndarray]:
    words = unpacked(row["words"])
    return words, restored(row["counts"], np.int64, len(words))


def class_sizes(counts: DataFrame) -> DataFrame:
    """(k, n, s): how many words each class of counts has, and the sum of their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                c = _counted(row)[1]
                k, at, n = np.unique(count_classes(c), return_inverse=True, return_counts=True)
                yield _batch("k, n, s", pa.array(k), pa.array(n), pa.array(np.bincount(at, weights=c).astype(np.int64)))

    return counts.mapInArrow(run, "k long, n long, s long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def top_words(counts: DataFrame, least: int, head: int) -> DataFrame:
    """(w, c): the `head` most frequent words, all of which are of class `least` or above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                words, c = _counted(row)
                at = np.flatnonzero(count_classes(c) >= least)
                yield _batch("w, c", pa.array([words[i] for i in at.tolist()], pa.binary()), pa.array(c[at]))

    return counts.mapInArrow(run, "w binary, c long").orderBy(F.desc("c"), "w").limit(head)


def tail_counts(blocks: DataFrame, counts: DataFrame, parts: int, asked: int) -> DataFrame:
    """(block, part, n, times): the counts of each block's distinct words that are not in the head (0: none).

    A part's words of all blocks meet its counts; where they are many the blocks are dealt into salted groups.
    """
    salts = max(1, asked // parts // _BUCKET_PAIRS)
    sent = "part long, salt long, block long, words binary"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, rare in zip(b.column(0).to_pylist(), b.column(1)):
                words = sorted(set(unpacked(rare.as_py())))
                rows = [(p, block // _FAN % salts, block, packed([words[i] for i in at.tolist()])) for p, at in dealt(words, parts)]
                if rows:
                    yield _batch(sent, *(pa.array(x, t) for x, t in zip(zip(*rows), (*[pa.int64()] * 3, pa.binary()))))

    def answer(asks, counted):
        words = [unpacked(x) for x in asks["words"]]
        known = [_counted(r) for r in counted.to_dict("records")]
        place = pc.index_in(pa.array([w for some in words for w in some], pa.binary()), value_set=pa.array([w for some, _ in known for w in some], pa.binary()))
        counts = np.append(np.concatenate([np.zeros(0, np.int64), *(c for _, c in known)]), 0)
        got = counts[np.asarray(place.fill_null(len(counts) - 1))]
        n = np.array([len(some) for some in words], np.int64)
        ends = np.cumsum(n)
        return asks[["block", "part"]].assign(n=n, times=[squeezed(got[e - k : e]) for k, e in zip(n, ends)])

    asks = blocks.select("block", "rare").mapInArrow(ask, sent).groupBy("part", "salt")
    copies = counts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))).groupBy("part", "salt")
    return asks.cogroup(copies).applyInPandas(answer, "block long, part long, n long, times binary")


class Head:
    """Numbers of words: a head word's rank, then `size` for the end, then hashes of all other words."""

    def __init__(self, words: list[bytes]):
        self.words, self.size = words, len(words)
        self._rank = dict(zip(words, range(self.size)))
        self.others = (1 << mixer.WORD_BITS) - self.size - 1

    def __getstate__(self) -> list[bytes]:
        return self.words

    def __setstate__(self, words: list[bytes]) -> None:
        self.__init__(words)

    def numbers(self, words: list[bytes | None]) -> tuple[np.ndarray, list[bytes]]:
        """The words' numbers (None is an end) and the words that are not in the head."""
        found = np.fromiter(map(self._rank.get, words, repeat(-1)), np.int32, len(words))
        missed = np.flatnonzero(found < 0)
        rare = [w for w in map(words.__getitem__, missed.tolist()) if w is not None]
        ends = np.fromiter((words[i] is None for i in missed.tolist()), bool, len(missed))
        found[missed[ends]] = self.size
        found[missed[~ends]] = np.fromiter(map(xxhash.xxh32_intdigest, rare), np.int64, len(rare)) % self.others + self.size + 1
        return found, rare


class Block:
    """A row of the block table: texts of about so many tokens, one after another."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        cell = lambda name: batch.column(name)[i]
        self.number, self.ids, self.bytes = cell("block").as_py(), cell("ids").values, cell("bytes").values
        self.sizes = np.asarray(cell("sizes").values)
        self.words = restored(cell("words").as_py(), np.int32, int(self.sizes.sum()))
        self.starts = np.cumsum(self.sizes) - self.sizes
        first = np.zeros(len(self.words), bool)
        first[self.starts] = True
        self.since = mixer.since_start(first)
        self.train = np.repeat(cell("train").values.to_numpy(zero_copy_only=False), self.sizes)

    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)

    def ranks(self, size: int) -> np.ndarray:
        """Ranks of head words; `size` stands for all other words, and one more for the end."""
        return np.where(self.words < size, self.words, np.where(self.words == size, size + 1, size))

    def asked(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each token's bucket (of 2^bits), its pair with a last bit for training tokens, and the order of both."""
        context = mixer.word_contexts(self.words, self.since)
        bucket = (context >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
        inside = (context << np.uint64(bits)) >> np.uint64(64 - _CONTEXT_BITS) << np.uint64(mixer.WORD_BITS + 1)
        key = inside | (self.words.astype(np.uint64) << np.uint64(1)) | self.train
        order = np.argsort(key)
        return bucket, key, order[np.argsort(bucket[order], kind="stable")]


def _opens(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Where, in this order, a run of equal keys begins."""
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    return new


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for b in batches:
        for i in range(b.num_rows):
            yield Block(b, i)


def text_blocks(rows: DataFrame, head) -> DataFrame:
    """The texts (doc_id, text, train) as blocks of numbers, with the words that are not in the head as `rare`, written
    to the checkpoint folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, finder, made = TaskContext.get().partitionId() << _BLOCK_BITS, head.value, 0
        ids, train, sizes, size, words = [], [], [], [], []

        def flush() -> pa.RecordBatch:
            nonlocal made
            numbers, rare = finder.numbers(words)
            out = _batch(_BLOCKS + ", rare", *(pa.array([x], t) for x, t in zip((base + made, ids, train, sizes, size, squeezed(numbers), packed(rare)), types)))
            made += 1
            for x in (ids, train, sizes, size, words):
                x.clear()
            return out

        for b in batches:
            for doc_id, t, learn in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), b.column(2).to_pylist()):
                raw = t.as_py()
                some = words_of(raw)
                words += some
                words.append(None)
                for x, v in ((ids, doc_id), (train, learn), (sizes, len(some) + 1), (size, len(raw))):
                    x.append(v)
                if len(words) >= _BLOCK_TOKENS:
                    yield flush()
        if ids:
            yield flush()

    long, binary = pa.list_(pa.int64()), pa.binary()
    types = [pa.int64(), long, pa.list_(pa.bool_()), pa.list_(pa.int32()), long, binary, binary]
    return checkpoint(rows.mapInArrow(run, _BLOCKS + ", rare binary"))


def _in_steps(rows: DataFrame, tasks: int, key: list[str], add, schema: str) -> DataFrame:
    """Rows that tasks sent, put together by `add` in groups of at most `_FAN` until one is left for each key."""
    rows = rows.withColumn("task", F.spark_partition_id().cast("long"))
    while True:
        tasks = -(-tasks // _FAN)
        rows = rows.withColumn("task", F.floor(F.col("task") / _FAN)).groupBy(*key, "task").applyInPandas(add, schema)
        if tasks <= 1:
            return rows


def summed(blocks: DataFrame, tasks: int, size: int, add, out: np.ndarray) -> np.ndarray:
    """The table of a bounded `size` that `add(block, into)` fills, over all blocks, written into `out`. Tasks send what
    is not zero of their sums, which fit 32 bits: a partition has fewer than 2^31 tokens."""
    schema = "part long, task long, n long, sums binary"

    def sent(flat: np.ndarray) -> tuple[int, bytes]:
        at = np.flatnonzero(flat)
        return len(at), squeezed(np.stack((at, flat[at])).ravel().astype(np.int64)) if len(at) else b""

    def dense(n: int, data: bytes) -> np.ndarray:
        at, v = restored(data, np.int64, 2 * n).reshape(2, n)
        flat = np.zeros(_PART, np.int64)
        flat[at] = v
        return flat

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into = np.zeros(size, np.int32)
        for block in _blocks_of(batches):
            add(block, into)
        for k in range(0, size, _PART):
            n, data = sent(into[k : k + _PART])
            if n:
                yield _batch("part, n, sums", pa.array([k // _PART]), pa.array([n]), pa.array([data], pa.binary()))

    def adder(pdf):
        total = np.zeros(_PART, np.int64)
        for n, x in zip(pdf["n"], pdf["sums"]):
            total += dense(n, x)
        n, data = sent(total)
        return pdf.iloc[:1].assign(n=[n], sums=[data])[["part", "task", "n", "sums"]]

    parts = _in_steps(blocks.mapInArrow(run, "part long, n long, sums binary"), tasks, ["part"], adder, schema)
    for row in parts.toLocalIterator():  # as many rows as the table has parts
        k = row["part"] * _PART
        out[k : k + _PART] = dense(row["n"], row["sums"])[: min(_PART, size - k)]
    return out


def with_codes(blocks: DataFrame, tails: DataFrame, parts: int, tokens: int) -> DataFrame:
    """The blocks with `codes`, what every token's two words before it guess over all training texts
    (`mixer.guess_codes`), and with `times`, the count of each word that is not in the head.

    A block sends a distinct pair once, so that a very common one costs its bucket a row for each block.
    """
    bits = max(3, (tokens // _BUCKET_PAIRS).bit_length())
    sent = "bucket long, block long, n long, contexts binary, words binary, counts binary"
    low = np.uint64((1 << mixer.WORD_BITS + 1) - 1)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks_of(batches):
            bucket, key, order = block.asked(bits)
            starts = np.flatnonzero(_opens(order, bucket, key))
            count = np.diff(np.append(starts, len(order))).astype(np.uint32)
            bucket, key = bucket[order[starts]], key[order[starts]]
            cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            rows = [(int(bucket[a]), e - a, squeezed(np.diff(key[a:e] >> np.uint64(mixer.WORD_BITS + 1), prepend=np.uint64(0))), squeezed((key[a:e] & low).astype(np.uint32)), squeezed(count[a:e])) for a, e in zip(cuts.tolist(), np.append(cuts[1:], len(key)).tolist())]
            for k in range(0, len(rows), 1024):
                b, n, c, w, t = zip(*rows[k : k + 1024])
                yield _batch(sent, pa.array(b, pa.int64()), pa.array([block.number] * len(b), pa.int64()), pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in (c, w, t)))

    def answer(pdf):
        n = pdf["n"].to_numpy()
        contexts = np.concatenate([np.cumsum(restored(x, np.uint64, k), dtype=np.uint64) for x, k in zip(pdf["contexts"], n)])
        words, counts = (np.concatenate([restored(x, np.uint32, k) for x, k in zip(pdf[c], n)]) for c in ("words", "counts"))
        codes = mixer.guess_codes(contexts << np.uint64(mixer.WORD_BITS) | words >> np.uint32(1), counts, (words & np.uint32(1)) == 1)
        ends = np.cumsum(n)
        return pdf[["bucket", "block", "n"]].assign(codes=[squeezed(codes[e - k : e]) for k, e in zip(n, ends)])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, times, n_rare = [], [], []
            for i in range(b.num_rows):
                block = Block(b, i)
                bucket, key, order = block.asked(bits)
                which = np.cumsum(_opens(order, bucket, key)) - 1
                got = np.concatenate([np.zeros(0, np.uint8), *(restored(x["codes"], np.uint8, x["n"]) for x in b.column("found")[i].as_py())])
                own = np.empty(len(order), np.uint8)
                own[order] = got[which]
                codes.append(squeezed(own))
                rare = unpacked(b.column("rare")[i].as_py())
                words, of = sorted(set(rare)), {}
                answers = {x["part"]: restored(x["times"], np.int64, x["n"]) for x in b.column("tails")[i].as_py() or ()}
                for p, at in dealt(words, parts):
                    of |= zip((words[k] for k in at.tolist()), answers[p].tolist())
                times.append(squeezed(np.fromiter(map(of.__getitem__, rare), np.int64, len(rare))))
                n_rare.append(len(rare))
            kept = b.drop_columns(["found", "tails", "rare"])
            yield kept.append_column("n_rare", pa.array(n_rare, pa.int64())).append_column("times", pa.array(times, pa.binary())).append_column("codes", pa.array(codes, pa.binary()))

    got = blocks.mapInArrow(ask, sent).groupBy("bucket").applyInPandas(answer, "bucket long, block long, n long, codes binary")
    found = got.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bucket", "n", "codes"))).alias("found"))  # in order of the bucket
    tails = tails.groupBy("block").agg(F.collect_list(F.struct("part", "n", "times")).alias("tails"))
    joined = blocks.join(found, "block").join(tails, "block", "left")
    return checkpoint(joined.mapInArrow(spread, _BLOCKS + ", n_rare long, times binary, codes binary"))


def _coded(batches: Iterator[pa.RecordBatch], symbols: np.ndarray, group_of: np.ndarray, class_of: np.ndarray) -> Iterator[tuple]:
    """Each block, its ranks, symbols, contexts and codes, and the counts of words that are not in the head."""
    for b in batches:
        for i in range(b.num_rows):
            block = Block(b, i)
            ranks = block.ranks(len(symbols) - 2)
            s, times = symbols.take(ranks), restored(b.column("times")[i].as_py(), np.int64, b.column("n_rare")[i].as_py())
            yield block, ranks, s, mixer.contexts(s, block.since, group_of, class_of), restored(b.column("codes")[i].as_py(), np.uint8, len(s)), times


def learned(blocks: DataFrame, tasks: int, model: mixer.Mixer, table) -> mixer.Mixer:
    """The model after a pass over all training texts; the tasks' parameters are averaged by their tokens."""
    schema = "part long, task long, n long, sums binary"
    start = blocks.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = start.value.with_parameters(start.value.parameters()), 0
        for block, _, symbols, places, codes, _ in _coded(batches, *table.value):
            if block.train.any():
                own.learn(symbols, places, codes, block.since, block.train)
                n += int(block.train.sum())
        if n:
            yield _batch("part, n, sums", pa.array([0]), pa.array([n]), pa.array([(own.parameters() * n).tobytes()], pa.binary()))

    def adder(pdf):
        pdf = pdf.sort_values("n")
        total = sum(np.frombuffer(x) for x in pdf["sums"])
        return pdf.iloc[:1].assign(n=[pdf["n"].sum()], sums=[total.tobytes()])[["part", "task", "n", "sums"]]

    got = _in_steps(blocks.mapInArrow(run, "part long, n long, sums binary"), tasks, ["part"], adder, schema).first()  # one row
    return model if got is None else model.with_parameters(np.frombuffer(got["sums"]) / got["n"])


def score(docs: DataFrame, head: int = 1 << 18) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for every row."""
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    held = F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text")).select("doc_id", "text", (~held).alias("train"))
    train = rows.where("train")

    tasks = max(1, rows.rdd.getNumPartitions())
    parts = min(_PARTS[1], max(_PARTS[0], tasks))
    counts = checkpoint(word_counts(train, parts, tasks))
    classes = {r["k"]: r for r in class_sizes(counts).collect()}  # 16,384 rows at most
    all_words, distinct, once = sum(r["s"] for r in classes.values()), sum(r["n"] for r in classes.values()), classes[0]["n"] if 0 in classes else 0
    left, least = head, 0
    for least in sorted(classes, reverse=True):
        left -= classes[least]["n"]
        if left <= 0:
            break
    top = top_words(counts, least, head).toArrow()  # `head` rows at most
    words, c = top["w"].to_pylist(), np.asarray(top["c"], np.float64)
    n_head = len(words)
    finder = Head(words)
    crowd = 1 + max(0, distinct - n_head) / finder.others  # words that share a number beyond the head
    blocks = text_blocks(rows, share(finder))
    del words, top, finder
    ends = blocks.agg(F.coalesce(F.sum(F.expr("size(filter(train, x -> x))")), F.lit(0))).first()[0]
    total, kinds = all_words + ends, distinct + (ends > 0)
    base_over = np.log10(total + kinds + 1)
    rare = all_words - int(c.sum())
    unknown = (once - int((c == 1).sum()) + 1) / (rare + 2)

    size = max(1, n_head) * ANCHORS

    def add_near(block: Block, into: np.ndarray) -> None:
        mixer.near_words(block.words[block.train], block.text()[block.train], n_head, min(ANCHORS, n_head), into)

    near = summed(blocks, tasks, size, add_near, np.zeros(size, np.float32))
    groups = mixer.word_groups(near[: n_head * min(ANCHORS, n_head)].reshape(n_head, -1)) if n_head else np.zeros(0, np.int64)
    del near
    table = share((mixer.symbol_table(groups), *mixer.symbol_groups(groups)))
    symbols = table.value[0]

    def add_symbols(block: Block, into: np.ndarray) -> None:
        s = table.value[0][block.ranks(n_head)]
        mixer.count(s[block.train], mixer.contexts(s, block.since, *table.value[1:])[:, block.train], into)

    model = mixer.Mixer(summed(blocks, tasks, mixer.SLOTS, add_symbols, np.zeros(mixer.SLOTS, np.int64)))
    coded = with_codes(blocks, tail_counts(blocks, counts, parts, rare), parts, int(total))
    model = learned(coded, max(1, coded.rdd.getNumPartitions()), model, table)

    mass = np.bincount(symbols[: len(c)], weights=c, minlength=mixer.SYMBOLS)
    inside = np.append(np.log10(c / mass[symbols[: len(c)]]), [0.0, 0.0])
    base = np.append(np.log10(c + 1) - base_over, [0.0, np.log10(ends + 1) - base_over])
    fixed = share((model, inside, base))
    new, old = float(np.log10(unknown)), float(np.log10(max(1e-9, 1 - unknown)) - np.log10(max(1, rare)))
    shape = "doc_id long, n_tokens long, n_known long, base_score double, score double, bytes long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, inside, base = fixed.value
        for block, ranks, symbols, places, code, times in _coded(batches, *table.value):
            is_rare, hit = ranks == n_head, code >= mixer.HIT
            word, known = inside.take(ranks), np.where(ranks == n_head + 1, ends > 0, True)
            word[is_rare], known[is_rare] = np.where(times == 0, new, np.log10(np.maximum(times, 1)) + old), times > 0
            plain = base.take(ranks)
            plain[is_rare] = np.log10(times + 1) - base_over
            word += model.log10(symbols, places)
            guess = model.guess_chance(code, block.since)
            got = word + np.log10(1 - guess)
            at = np.flatnonzero(hit)
            shared = np.where(is_rare[at], crowd, 1)
            got[at] = np.log10(guess[at] / shared + (1 - guess[at]) * 10 ** word[at])
            sums = [np.add.reduceat(x, block.starts) for x in (known.astype(np.int64), plain, got)]
            yield _batch(shape, block.ids, pa.array(block.sizes, pa.int64()), *map(pa.array, sums), block.bytes)

    out = coded.mapInArrow(run, shape)
    columns = ["doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score"]
    return out.select(*columns, (-F.col("score") * float(np.log2(10)) / F.greatest("bytes", F.lit(1))).alias("bits_per_byte"))
