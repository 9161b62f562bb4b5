"""Scores of texts by a causal self-attention model, and by add-one word frequencies.

1. Every text is normalised (ASCII lower case, words parted by one space) and
   encoded word by word, each distinct word of a part once; ids are kept in a
   written table in slices of about SLICE bytes.  Counts of ids and of pairs of ids are summed by slice, then over
   all training text.
2. Words, and pairs of ids of which one is rarer, are hashed to 63 bits (the
   last bit tells which); each slice tells how often its distinct ones come in
   training text.  One window over the hash sums these, so each slice gets the
   counts of its own words and pairs back, and no task or driver holds all of
   them.  A word has at most one row for each slice.
3. Classes and the network's first tables come from sums over pairs that are
   bounded whatever the input: by compact numbers (KNOWN**2 rows of 12 bytes,
   50 MB) and by previous id and class (ids times CLASSES rows of 18 bytes,
   101 MB).  Only these reach the driver, where ``fit_docs`` training texts chosen by the hash of their id
   give the network its start.  From there each task learns from all its
   training texts, and the tasks' weights are averaged by ids: all training
   text reaches the network, whose weights depend a little on how the texts
   lie in tasks.
4. Slices meet their counts in a cogroup, which scores all texts.

Defined cases: a null, empty or white text has its end alone; rows that repeat
a doc_id are scored and counted each; a null id is not held out; without
training text every id is equally likely within its class; an empty table
gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .attention_lm import KNOWN, AttentionModel, place_ids
from .shared import materialize, release_memory, table, tidy
from .subwords import _BLANKS, gather, slices, vocabulary
from .vectorwords import P, hash_of, powers, span_hashes

SLICE = 20 << 20
FIT_DOCS = 600
LEARN_IDS = 1 << 17
_WORD = np.uint64((1 << 64) - 2)  # hashes of words are even, of pairs of ids odd
_END = hash_of("\0end") & int(_WORD)  # no word: the end of a text, counted as a token


class Pieces:
    """A byte-level vocabulary of ranks: ids of texts, which ids open a word, and numbers for hashing them."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end_id = max(ranks.values()) + 1
        words = [b""] * (self.end_id + 1)
        for word, i in ranks.items():
            words[i] = word
        self.opens = np.array([w[:1] == b" " for w in words])
        self.values = np.random.default_rng(17).integers(1, 1 << 63, len(words), dtype=np.uint64)
        self.width = np.array([len(w) for w in words])

    def _each(self, words: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """(ids, how many each has) of " " + word, for words that end in no white space: their ids are the same when they are joined."""
        ids, lengths, sizes = [], [], pc.binary_length(words).to_numpy() + 1
        for at in range(0, len(words), 1 << 14):
            text = pc.binary_join(pa.ListArray.from_arrays([0, min(1 << 14, len(words) - at)], words[at : at + (1 << 14)]), " ")[0].as_py()
            ids.append(self.encoding.encode_to_numpy(" " + text).astype(np.uint16))
            ends = np.cumsum(sizes[at : at + (1 << 14)])
            lengths.append(np.diff(np.searchsorted(np.cumsum(self.width[ids[-1]]), ends) + 1, prepend=0))
        return ids, lengths

    def encode(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text).astype(np.uint16) if text else np.zeros(0, np.uint16)

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of texts as ``normalised`` gives them, word by word; each distinct word is encoded once."""
        parts = pc.split_pattern(texts, " ")
        cuts, coded = np.asarray(parts.offsets, np.int64), parts.flatten().dictionary_encode()
        words = coded.dictionary
        alone = pc.match_substring_regex(words, f"[{_BLANKS}]$").to_numpy(zero_copy_only=False)
        joined = ~alone & (pc.binary_length(words).to_numpy() > 0)  # what stands before a text's first space is empty
        pool, counts = self._each(words.filter(pa.array(joined)))
        pool += [np.array(self.encoding.encode_ordinary(" " + w), np.uint16) for w in words.filter(pa.array(alone)).to_pylist()]
        counts.append(np.array([len(p) for p in pool[len(counts) :]], np.int64))
        lengths = np.zeros(len(words), np.int64)
        order = np.r_[np.flatnonzero(joined), np.flatnonzero(alone)]
        lengths[order] = np.concatenate(counts)
        starts = np.zeros(len(words), np.int64)
        starts[order] = np.cumsum(lengths[order]) - lengths[order]
        at = np.asarray(coded.indices)
        sums = np.concatenate([[0], np.cumsum(lengths[at])])
        return gather(np.concatenate([np.zeros(0, np.uint16), *pool]), starts[at], lengths[at]), sums[cuts - cuts[0]]


_pieces: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


def normalised(texts: pa.Array) -> pa.Array:
    """" " before each word, words in ASCII lower case, nothing else."""
    words = pc.ascii_lower(pc.fill_null(texts, ""))
    for blank in "\t\n\x0b\x0c\r":
        words = pc.replace_substring(words, blank, " ")
    double = pc.match_substring(words, "  ")
    if pc.any(double).as_py():
        words = pc.if_else(double, pc.replace_substring_regex(pc.if_else(double, words, ""), " +", " "), words)
    words = pc.ascii_trim(words, " ")
    return pc.if_else(pc.equal(words, ""), "", pc.binary_join_element_wise(pa.scalar(""), words, pa.scalar(" ")))


def _encode(path: str):
    """Rows (slice, doc_id, held_out, ids); a row with a null held_out holds counts of a slice's training text instead."""

    def run(batches):
        model, k = pieces(path), TaskContext.get().partitionId() << 32
        held_bytes, single, pair = 0, [], []

        def counts():
            if not single:
                return None
            rows = []
            for kind, parts in ((0, single), (1, pair)):
                code, inverse = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
                n = np.bincount(inverse, np.concatenate([n for _, n in parts])).astype(np.int64)
                rows.append(np.stack([np.full(len(code), kind), code, n]).astype("<i8").tobytes())
            single.clear()
            pair.clear()
            return pa.RecordBatch.from_arrays([pa.array([k, k], pa.int64()), pa.array([None, None], pa.int64()), pa.array([None, None], pa.bool_()), pa.array(rows, pa.binary())], ["slice", "doc_id", "held_out", "ids"])

        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                every, cuts = model.encode_all(normalised(part.column("text")))
                ids = np.split(every, cuts[1:-1]) if len(cuts) > 1 else []
                train = [i for i, h in zip(ids, part.column("held_out").to_pylist()) if not h]
                if train:
                    end = np.array([model.end_id])
                    own = np.concatenate([x for i in train for x in (end, i)] + [end]).astype(np.uint32)
                    single.append(np.unique(own[1:], return_counts=True))
                    code, n = np.unique((own[:-1] << 16) | own[1:], return_counts=True)
                    pair.append((code.astype(np.int64) >> 16 << 32 | (code & 0xFFFF), n))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), k)), part.column("doc_id"), part.column("held_out"), pa.array([i.tobytes() for i in ids], pa.binary())], ["slice", "doc_id", "held_out", "ids"])
                held_bytes += part.column("text").nbytes
                if held_bytes >= SLICE:
                    if (rows := counts()) is not None:
                        yield rows
                    held_bytes, k = 0, k + 1
        if (rows := counts()) is not None:
            yield rows

    return run


def _id_counts(batches):
    for batch in batches:
        for blob in batch.column("ids").to_pylist():
            kind, code, n = np.frombuffer(blob, "<i8").reshape(3, -1)
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(code), pa.array(n)], ["kind", "code", "n"])


def _ids_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of a column of packed ids, in place."""
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data.view(np.uint16), (offsets - offsets[0]) // 2


def _parts(offsets: np.ndarray, limit: int = 1 << 20):
    """(start, stop) of runs of texts with about ``limit`` ids, so that arrays over them stay small."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, min(to, n)
        at = to


def _hashed(model: Pieces, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, of): the words' hashes, over their ids, and the first word of each text.

    A word's ids follow from the word alone, as the pre-tokenizer parts at
    every space, and its first id is the one whose bytes begin with a space.
    """
    starts = np.flatnonzero(model.opens[ids])
    sums = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum(model.values[ids] * powers(P, len(ids)), out=sums[1:])
    return span_hashes(sums, starts, np.r_[starts[1:], len(ids)]) & _WORD, np.searchsorted(starts, offsets)


def _pair_hash(code: np.ndarray) -> np.ndarray:
    """Odd hashes of pairs (previous id << 16 | id); different pairs differ."""
    x = code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(32) << np.uint64(1))) | np.uint64(1)


def _far_pairs(rarer: np.ndarray, end: int, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text) of the pairs with a rarer id, in texts that stand between end ids."""
    n = np.diff(offsets) + 1
    first = np.cumsum(n) - n
    stream = np.full(int(n.sum()) + 1, end, np.int64)
    own = np.ones(len(stream), bool)
    own[first] = own[-1] = False
    stream[own] = ids
    odd = rarer[stream]
    odd = np.flatnonzero(odd[:-1] | odd[1:])
    return _pair_hash((stream[odd] << 16) | stream[odd + 1]), np.searchsorted(first, odd, side="right") - 1


def _words(path: str, rarer: np.ndarray):
    """Rows (slice, h, n): the distinct words, and pairs with a rarer id, of a part of a slice and how often they come in its training texts."""

    def run(batches):
        model, part, size = pieces(path), {}, 0

        def count(hashes, n):
            code, words = pd.factorize(hashes)
            return words, np.bincount(code, n, len(words))

        def flush():
            for k, counted in part.items():
                words, n = count(*(np.concatenate(c) for c in zip(*counted)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), k)), pa.array(words.view(np.int64)), pa.array(n.astype(np.int64))], ["slice", "h", "n"])
            part.clear()

        for batch in batches:
            slice_of, (ids, offsets) = batch.column("slice").to_numpy(), _ids_of(batch.column("ids"))
            train = ~batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            cuts = np.flatnonzero(np.r_[True, slice_of[1:] != slice_of[:-1], True])
            for first, last in zip(cuts[:-1], cuts[1:]):
                own = part.setdefault(int(slice_of[first]), [])
                for a, b in _parts(offsets[first : last + 1]):
                    cut = offsets[first + a : first + b + 1]
                    hashes, of = _hashed(model, ids[cut[0] : cut[-1]], cut - cut[0])
                    far, text = _far_pairs(rarer, model.end_id, ids[cut[0] : cut[-1]], cut - cut[0])
                    mine = train[first + a : first + b]
                    own.append(count(np.r_[hashes, np.full(b - a, _END, np.uint64), far], np.r_[np.repeat(mine, np.diff(of)), mine, mine[text]]))
                    size += len(own[-1][0])
                if len(part) > 1 or size > SLICE // 8:
                    yield from flush()
                    size = 0
        yield from flush()

    return run


class PairTable:
    """``Pairs`` over a table (before, after, n): only sums bounded by the vocabulary reach the driver."""

    def __init__(self, pairs: DataFrame):
        self.pairs = pairs

    def _numbered(self, **numbers) -> DataFrame:
        """The pairs with a number of an id beside each; the numbers are one row an id of the vocabulary."""
        out = self.pairs
        for side, values in numbers.items():
            of = pa.table({side: pa.array(np.arange(len(values)), pa.int32()), side + "_as": pa.array(values, pa.int16())})
            out = out.join(F.broadcast(out.sparkSession.createDataFrame(of)), side)
        return out

    def near(self, known):
        found = self._numbered(before=known, after=known).groupBy("before_as", "after_as").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros((KNOWN, KNOWN))
        out[found["before_as"].to_numpy(), found["after_as"].to_numpy()] = found["n"].to_numpy()
        return out

    def cells(self, label):
        found = self._numbered(after=label).groupBy("before", "after_as").agg(F.sum("n").alias("n"), F.count("*").cast("int").alias("kinds")).toArrow()
        return tuple(found[c].to_numpy().astype(np.int64) for c in ("before", "after_as", "n", "kinds"))

    def after_rarer(self, known):
        found = self._numbered(before=known).where(F.col("before_as") == KNOWN - 1).groupBy("after").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros(len(known), np.int64)
        out[found["after"].to_numpy()] = found["n"].to_numpy()
        return out

    def lookup(self, known):
        return None  # the slices bring the counts of their own pairs


def _learn(model: AttentionModel):
    """One row (part, ids, weights): the network after all training texts of a task."""

    def run(batches):
        own, part = model.learner(), TaskContext.get().partitionId()

        def texts():
            held, size = [], 0
            for batch in batches:
                ids, offsets = _ids_of(batch.column("ids"))
                for k in np.flatnonzero(~batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)):
                    held.append(ids[offsets[k] : offsets[k + 1]].astype(np.int64))
                    size += len(held[-1]) + 1
                    if size >= LEARN_IDS:
                        yield held
                        held, size = [], 0
            if held:
                yield held

        n = own.learn(texts(), rate=0.002, warm=True)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([part % 32]), pa.array([n]), pa.array([np.concatenate([w.ravel() for w in own.w.values()]).astype("<f8").tobytes()], pa.binary())], ["part", "n", "w"])

    return run


def _average(found: pa.Table) -> pa.Table:
    n = found["n"].to_numpy()
    total = sum(np.frombuffer(w.as_buffer(), "<f8") * k for w, k in zip(found["w"], n)) / n.sum()
    return pa.table({"part": found["part"][:1], "n": pa.array([int(n.sum())]), "w": pa.array([total.tobytes()], pa.binary())})


def _learn_all(model: AttentionModel, texts: DataFrame) -> AttentionModel:
    """The model with its weights learned further from all training texts, task by task."""
    schema = "part long, n long, w binary"
    learned = texts.where("not held_out").select("held_out", "ids").mapInArrow(tidy(_learn(model.learner())), schema)
    found = learned.groupBy("part").applyInArrow(_average, schema).toArrow()
    if found.num_rows:
        flat = np.frombuffer(_average(found)["w"][0].as_py(), "<f8")
        cuts = np.cumsum([w.size for w in model.w.values()])[:-1]
        model.w = {k: part.reshape(w.shape).astype(np.float32) for (k, w), part in zip(model.w.items(), np.split(flat, cuts))}
    return model.finish()


def _score(path: str, model: AttentionModel, total: int, distinct: int):
    floor = -np.log10(total + distinct + 1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        own = pieces(path)
        docs = left.num_rows
        h, c = right["h"].to_numpy().view(np.uint64), right["c"].to_numpy()
        order = np.argsort(h)
        h, c = h[order], c[order]

        def counts(words):
            if not len(h):
                return np.zeros(len(words), np.int64)
            at = np.minimum(np.searchsorted(h, words), len(h) - 1)
            return np.where(h[at] == words, c[at], 0)

        end = counts(np.array([_END], np.uint64))[0]
        base, known, n_words, score = np.zeros(docs), np.zeros(docs, np.int64), np.zeros(docs, np.int64), np.zeros(docs)
        every, places = _ids_of(left["ids"].combine_chunks()) if docs else (np.zeros(0, np.uint16), np.zeros(1, np.int64))
        for at, to in _parts(places):
            cut = places[at : to + 1]
            ids, offsets = every[cut[0] : cut[-1]].astype(np.int64), cut - cut[0]
            hashes, of = _hashed(own, ids, offsets)
            code, words = pd.factorize(hashes)
            count = counts(words)
            sums = np.bincount(np.repeat(np.arange(to - at), np.diff(of)), np.log10(count + 1.0)[code], to - at)
            seen = np.concatenate([[0], np.cumsum((count > 0)[code])])
            n_words[at:to] = np.diff(of)
            base[at:to] = sums + np.log10(end + 1.0) + (np.diff(of) + 1) * floor
            known[at:to] = np.diff(seen[of]) + (end > 0)
            score[at:to] = model.score(ids, offsets, far=lambda code: counts(_pair_hash(code)))
        release_memory()
        return pa.table({"doc_id": left["doc_id"], "held_out": left["held_out"], "n_tokens": n_words + 1, "n_known": known, "base_score": base, "score": score})

    return run


def score_texts(docs: DataFrame, held_out, path: str, fit_docs: int = FIT_DOCS, id_col="doc_id", text_col="text") -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learned from rows that are not held out."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    coded = materialize(rows.mapInArrow(tidy(_encode(path)), "slice long, doc_id long, held_out boolean, ids binary"), "ids")
    texts = coded.where("held_out is not null")
    counts = coded.where("held_out is null").select("ids").mapInArrow(_id_counts, "kind long, code long, n long").groupBy("kind", "code").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "counts")
    vocab = pieces(path)
    ids = np.zeros(vocab.end_id + 1, np.int64)
    found = counts.where("kind = 0").toArrow()  # a row for each id of the vocabulary
    ids[found["code"].to_numpy()] = found["n"].to_numpy()
    pairs = counts.where("kind = 1").select(F.shiftright("code", 32).cast("int").alias("before"), F.col("code").bitwiseAND(0xFFFFFFFF).cast("int").alias("after"), "n")

    by_hash = Window.partitionBy("h").orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.row_number().over(Window.partitionBy("h").orderBy("slice"))
    counted = texts.mapInArrow(tidy(_words(path, place_ids(ids)[0] == KNOWN - 1)), "slice long, h long, n long").select("slice", "h", "n", F.sum("n").over(by_hash).alias("c"), (place == 1).alias("first"))
    counted = materialize(counted.where("c > 0"), "counted")
    total, distinct = counted.where(F.col("h").bitwiseAND(1) == 0).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if("first")).first()

    sample = texts.where("not held_out").orderBy(F.xxhash64("doc_id"), "doc_id").select("ids").limit(fit_docs).toArrow()["ids"].to_pylist()
    model = AttentionModel(ids, PairTable(pairs), vocab.end_id).fit([np.frombuffer(b, np.uint16).astype(np.int64) for b in sample])
    model = _learn_all(model, texts)
    # As many partitions as there are slices, or a task would hold more of them the larger the input is.
    parts = max(2 * texts.select("slice").distinct().count(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    left, right = texts.repartition(parts, "slice"), counted.select("slice", "h", "c").repartition(parts, "slice")
    scored = left.groupBy("slice").cogroup(right.groupBy("slice")).applyInArrow(_score(path, model, total, distinct), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(total).cast("long"))


def lm_query(spark, sf_dir) -> DataFrame:
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    out = score_texts(table(spark, sf_dir, "documents"), held_out, vocabulary("byte_bpe_50k.tiktoken"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
