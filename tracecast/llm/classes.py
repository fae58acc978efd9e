"""Brown class-based bigrams: exchange clustering of words, then P(class | class before) * P(word | class).

Words are runs of bytes other than ASCII blanks, A-Z in lower case; every text has one end token more, which is also what
stands before its first word. Texts are written once as blocks of about ``block_bytes``: a dictionary and the
numbers of its words. A round of exchange clustering counts, for every word of a block, the classes before and after it;
these profiles are summed by word, and each word goes to the class in which the likelihood of the class bigrams is
greatest (its own class without its own counts), word after word in small groups, with the task's copy of the class
bigrams following the moves. The new classes go back to the blocks packed, and the class bigrams are counted anew; the
round with the greatest likelihood is kept. The end token has a class of its own.

Probabilities are smoothed so that they sum to one over the known words, the end and one unknown word:
``P(c) = (n(c) + d |c|) / (N + d (V + 1))``, ``P(w | c) = (n(w) + d) / (n(c) + d |c|)``, ``P(c | b) = (n(b, c) + m P(c)) / (n(b) + m)``;
the unknown word is a class of its own that nothing was counted for. ``P(c) P(w | c)`` is the smoothed unigram model, the base.

Counts are over all training texts, in every block and of every word; what is gathered grows with the input. A word has one
row per block, so that its rows are few beside a block's words; their profiles are added as they are read, and 12 bytes for each
block are held until its class is known. A null text is empty (its end is its only token). Without training texts every word is unknown
and has probability one. Repeated rows and ids count as often as they stand there; ties keep the class, then take the lowest;
a text longer than a block is a block of its own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracecast.llm.common import SLICE_BYTES, raw_bytes, released, slices
from tracecast.storage import materialize, passing_shuffles

END = 0


@dataclass(frozen=True)
class ClassSettings:
    #: Classes of words with that of the end token, 64 at most.
    classes: int = 64
    rounds: int = 2
    smoothing: float = 0.1
    #: Counts that the class unigrams are worth as a prior of the class bigrams.
    prior: float = 20.0
    block_bytes: int = 16 << 20
    #: Words that are moved together, and the counts of their profiles.
    group: int = 1024
    group_counts: int = 1 << 13


def _binary(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def _numbers(packed: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), kind)


BLOCK = "train array<boolean>, ends array<int>, tokens binary, words array<string>"


def _blocks(settings: ClassSettings):
    """Blocks of whole texts: word 0 is the end token, which closes every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        known, ids, train, tokens, size = {b"": END}, [], [], [], 0

        def block() -> pa.RecordBatch:
            ends = np.cumsum([len(t) for t in tokens], dtype=np.int32)
            lists = [pa.array([v], pa.list_(k)) for v, k in ((train, pa.bool_()), (ends, pa.int32()))]
            number = pa.array([first], pa.int64())
            whole = pa.ListArray.from_arrays(pa.array([0, len(tokens)], pa.int32()), pa.concat_arrays(ids))
            words = pa.array([[w.decode() for w in known]], pa.list_(pa.string()))
            return pa.RecordBatch.from_arrays([number, whole, *lists, pa.array([_binary(np.concatenate(tokens))], pa.binary()), words], ["block", "doc_ids", "train", "ends", "tokens", "words"])

        for part in slices(batches, SLICE_BYTES):
            for i, (text, is_train) in enumerate(zip(part.column("text").to_pylist(), part.column("train").to_pylist())):
                text = (text or "").encode()
                if size and size + len(text) > settings.block_bytes:
                    yield block()
                    known, ids, train, tokens, size, first = {b"": END}, [], [], [], 0, first + 1
                tokens.append(np.array([known.setdefault(w, len(known)) for w in text.lower().split()] + [END], np.int32))
                ids.append(part.column("doc_id").slice(i, 1))
                train.append(is_train)
                size += len(text) + 1
        if tokens:
            yield block()

    return released(run)


def first_class(word: str, classes: int) -> int:
    """Class that a word is in before the first round, by its ending; the end token's is 0."""
    return 1 + crc32(word[-2:].encode()) % (classes - 1) if word and classes > 1 else 0


@dataclass
class _Pairs:
    """Neighbours in the training texts of a block, and the classes of its words (-1: not known)."""

    before: np.ndarray
    after: np.ndarray
    classes: np.ndarray

    @staticmethod
    def of(row: dict, settings: ClassSettings, words: pa.Array | None) -> _Pairs:
        tokens = _numbers(row["tokens"], np.int32).astype(np.int64)
        ends = np.array(row["ends"], np.int64)
        taught = np.repeat(np.array(row["train"], bool), np.diff(np.concatenate([[0], ends])))
        before = np.concatenate([[END], tokens[:-1]])
        if row.get("packed") is None:
            classes = np.array([first_class(w, settings.classes) for w in words.to_pylist()], np.int64)
        else:
            classes = _unpacked(row["packed"], "class", np.int8)
        return _Pairs(before[taught], tokens[taught], classes)


def _unpacked(packed: list[dict], column: str, kind: type) -> np.ndarray:
    """Values by word number from the pieces that the exchange has sent to a block."""
    places = np.concatenate([_numbers(p["pos"], np.int32) for p in packed])
    out = np.zeros(len(places), np.int64)
    out[places] = np.concatenate([_numbers(p[column], kind) for p in packed])
    return out


def _bigrams(settings: ClassSettings):
    """Class bigrams of the training texts, summed in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = settings.classes
        total = np.zeros(k * k, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                words = batch.column("words")[i].values if "words" in batch.schema.names else None
                pairs = _Pairs.of(batch.select([n for n in batch.schema.names if n != "words"]).slice(i, 1).to_pylist()[0], settings, words)
                total += np.bincount(pairs.classes[pairs.before] * k + pairs.classes[pairs.after], minlength=k * k)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((met // k).astype(np.int32)), pa.array((met % k).astype(np.int32)), pa.array(total[met])], ["a", "b", "n"])

    return released(run)


def _profiles(settings: ClassSettings):
    """One row per word of a block: how often each class follows it (features from 0) and precedes it (from 64).

    A count is given by its base-64 digits, 16 bits each: feature, place of the digit, digit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words, row = batch.column("words")[i].values, batch.select([n for n in batch.schema.names if n != "words"]).slice(i, 1).to_pylist()[0]
                pairs = _Pairs.of(row, settings, words)
                late = np.unique(pairs.before * 128 + pairs.classes[pairs.after], return_counts=True)
                early = np.unique(pairs.after * 128 + 64 + pairs.classes[pairs.before], return_counts=True)
                key, count = (np.concatenate(x) for x in zip(late, early))
                del late, early
                owner, piece = [], []
                for place in range(8):
                    digit = (count >> (6 * place)) & 63
                    met = digit > 0
                    owner.append(key[met] >> 7)
                    piece.append(((key[met] & 127) | place << 7 | digit[met] << 10).astype(np.uint16))
                order = np.argsort(owner := np.concatenate(owner), kind="stable")
                pieces, sizes = np.concatenate(piece)[order], np.bincount(owner, minlength=len(words))
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                for low in range(0, len(words), 50_000):
                    high = min(len(words), low + 50_000)
                    offsets = (2 * (bounds[low : high + 1] - bounds[low])).astype(np.int32)
                    profile = pa.Array.from_buffers(pa.binary(), high - low, [None, pa.py_buffer(offsets), pa.py_buffer(pieces[bounds[low] : bounds[high]].tobytes())])
                    where = [pa.array(np.full(high - low, row["block"])), pa.array(np.arange(low, high, dtype=np.int32)), pa.array(pairs.classes[low:high].astype(np.int16))]
                    yield pa.RecordBatch.from_arrays([words.slice(low, high - low), *where, profile], ["word", "block", "pos", "class", "profile"])

    return released(run)


def _log(x: np.ndarray) -> np.ndarray:
    """``x log x``."""
    return x * np.log(np.maximum(x, 1.0))


def exchanged(profile: np.ndarray, own: np.ndarray, bigrams: np.ndarray) -> np.ndarray:
    """Best class of each word by its ``profile`` (classes after it, then before it), the class bigrams and its own class."""
    k = len(bigrams)
    count = profile[:, :k].sum(1)
    cell = np.concatenate([bigrams.T, bigrams])  # of each feature in each class
    log_cell, once = _log(cell), profile == 1
    gain = once.astype(float) @ (_log(cell + 1) - log_cell)
    word, feature = np.nonzero(profile)
    value = profile[word, feature]
    mine = cell[feature, own[word]]
    stay = np.bincount(word, _log(mine) - _log(np.maximum(mine - value, 0)), len(own))
    often = value > 1
    word, feature, value = word[often], feature[often], value[often]
    if len(word):
        starts = np.flatnonzero(np.concatenate([[True], np.diff(word) > 0]))
        gain[word[starts]] += np.add.reduceat(_log(cell[feature] + value[:, None]) - log_cell[feature], starts, axis=0)
    size = bigrams.sum(1)
    gain -= 2 * (_log(size + count[:, None]) - _log(size))
    stay -= 2 * (_log(size[own]) - _log(np.maximum(size[own] - count, 0)))
    rows = np.arange(len(own))
    gain[rows, own] = stay
    gain[:, END] = -np.inf  # kept for the end token
    best = gain.argmax(1)
    return np.where(gain[rows, best] > stay + 1e-9, best, own)


MOVES = "block long, pos binary, class binary, count binary, sizes array<long>"


def _exchange(bigrams: np.ndarray, settings: ClassSettings, held_rows: int = 200_000):
    """From all rows of each word: its class and training count, packed by block; at the task's end the words in each class (``block`` null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, local = len(bigrams), bigrams.astype(float)
        sizes, done = np.zeros(k, np.int64), []
        carry: list | None = None  # the word that is being read: name, profile, class, blocks, places

        def moved(profile: np.ndarray, own: np.ndarray, is_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            count = profile[:, :k].sum(1)
            new = own.copy()
            movable = np.flatnonzero((count > 0) & ~is_end)
            filled = np.cumsum((profile[movable] > 0).sum(1))
            cuts = np.flatnonzero(np.diff(np.arange(len(movable)) // settings.group + filled // settings.group_counts)) + 1
            for part in np.split(movable, cuts) if len(movable) else ():
                new[part] = exchanged(profile[part], own[part], local)
                went = part[new[part] != own[part]]
                shift = np.zeros((k, len(went)))
                shift[new[went], np.arange(len(went))] += 1
                shift[own[went], np.arange(len(went))] -= 1
                local[:] = np.maximum(local + shift @ profile[went, :k] + (shift @ profile[went, k:]).T, 0)
            new[count == 0] = -1
            np.add.at(sizes, new[count > 0], 1)
            return new, count.astype(np.int64)

        def packed() -> pa.RecordBatch:
            block, pos, new, count = (np.concatenate(x) for x in zip(*done))
            done.clear()
            order = np.argsort(block, kind="stable")
            block, pos, new, count = (x[order] for x in (block, pos, new, count))
            cuts = np.append(np.flatnonzero(np.concatenate([[True], np.diff(block) != 0])), len(block))
            pieces = [[_binary(x[a:b].astype(t)) for a, b in zip(cuts, cuts[1:])] for x, t in ((pos, np.int32), (new, np.int8), (count, np.int64))]
            nothing = pa.nulls(len(cuts) - 1, pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(block[cuts[:-1]]), *(pa.array(p, pa.binary()) for p in pieces), nothing], ["block", "pos", "class", "count", "sizes"])

        def closed() -> None:
            name, profile, own, blocks, places = carry
            new, count = moved(profile[None], np.array([own]), np.array([name == ""]))
            blocks, places = np.concatenate(blocks), np.concatenate(places)
            done.append((blocks, places, np.full(len(blocks), new[0]), np.full(len(blocks), count[0])))

        for batch in batches:
            if not batch.num_rows:
                continue
            words = batch.column("word")
            new_word = np.concatenate([[True], pc.not_equal(words.slice(1), words.slice(0, len(words) - 1)).to_numpy(zero_copy_only=False)])
            starts, group = np.flatnonzero(new_word), np.cumsum(new_word) - 1
            block, pos, own = (batch.column(n).to_numpy() for n in ("block", "pos", "class"))
            packed_profiles, bounds = raw_bytes(batch.column("profile"))
            length, pieces = np.diff(bounds) // 2, np.frombuffer(packed_profiles.tobytes(), np.uint16).astype(np.int64)
            feature, value = pieces & 127, (pieces >> 10) << (6 * ((pieces >> 7) & 7))
            feature = np.where(feature >= 64, feature - 64 + k, feature)
            profile = np.bincount(np.repeat(group, length) * 2 * k + feature, value, len(starts) * 2 * k).reshape(-1, 2 * k)
            if carry and carry[0] == words[0].as_py():
                profile[0] += carry[1]
                carry[3].append(block[: np.append(starts, len(block))[1]])
                carry[4].append(pos[: np.append(starts, len(block))[1]])
                carry[1] = profile[0]
                skip = 1
            else:
                skip = 0
            if len(starts) > skip and carry:  # the word read before has ended
                closed()
                carry = None
            if len(starts) > skip:
                last = starts[-1]
                inner = slice(skip, len(starts) - 1)
                if len(starts) - 1 > skip:
                    at = starts[inner]
                    new, count = moved(profile[inner], own[at].astype(np.int64), np.array([w == "" for w in words.take(pa.array(at)).to_pylist()]))
                    rows = slice(starts[skip], last)
                    done.append((block[rows], pos[rows], new[group[rows] - skip], count[group[rows] - skip]))
                carry = [words[int(last)].as_py(), profile[-1].copy(), int(own[last]), [block[last:].copy()], [pos[last:].copy()]]
            if sum(len(d[0]) for d in done) >= held_rows:
                yield packed()
        if carry:
            closed()
        if done:
            yield packed()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), *(pa.nulls(1, pa.binary()) for _ in range(3)), pa.array([sizes], pa.list_(pa.int64()))], ["block", "pos", "class", "count", "sizes"])

    return released(run)


def likelihood(bigrams: np.ndarray) -> float:
    """What the classes add to the log-likelihood of the training texts."""
    return float(_log(bigrams.astype(float)).sum() - _log(bigrams.sum(1).astype(float)).sum() - _log(bigrams.sum(0).astype(float)).sum())


@dataclass(frozen=True)
class ClassModel:
    settings: ClassSettings
    #: The texts, and the classes and counts of their words by block.
    blocks: DataFrame
    moves: DataFrame
    #: Counts of a class after a class, and the words in each.
    bigrams: np.ndarray
    sizes: np.ndarray
    #: Likelihood after each round, of the first classes to begin with.
    likelihoods: tuple[float, ...]

    def logarithms(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 of: class given class before (the unknown word's last), class, and what a word's count is divided by in its class."""
        s, k = self.settings, self.settings.classes
        counts = np.append(self.bigrams.sum(0), 0).astype(float)
        sizes = np.append(self.sizes, 0).astype(float)
        unigram = (counts + s.smoothing * sizes) / (counts.sum() + s.smoothing * (sizes.sum() + 1))
        unigram[k] = s.smoothing / (counts.sum() + s.smoothing * (sizes.sum() + 1))
        given = np.zeros((k + 1, k + 1))
        given[:k, :k] = self.bigrams
        given = (given + s.prior * unigram) / (given.sum(1, keepdims=True) + s.prior)
        within = counts + s.smoothing * sizes
        within[k] = 1
        with np.errstate(divide="ignore"):
            return np.log10(given), np.log10(unigram), np.log10(within)


def _with_classes(blocks: DataFrame, moves: DataFrame | None) -> DataFrame:
    if moves is None:
        return blocks
    pieces = moves.where("block is not null").groupBy(F.col("block").alias("of")).agg(F.collect_list(F.struct("pos", "class", "count")).alias("packed"))  # of one block's words
    return blocks.join(pieces, F.col("block") == F.col("of")).drop("of")


def _counted(blocks: DataFrame, moves: DataFrame | None, settings: ClassSettings) -> np.ndarray:
    read = _with_classes(blocks.select("block", "train", "ends", "tokens", *([] if moves is not None else ["words"])), moves)
    out = np.zeros((settings.classes, settings.classes), np.int64)
    with passing_shuffles(blocks.sparkSession):
        counts = read.mapInArrow(_bigrams(settings), "a int, b int, n long").groupBy("a", "b").agg(F.sum("n")).collect()
    for a, b, n in counts:
        out[a, b] = n
    return out


def fit(docs: DataFrame, train: Column, settings: ClassSettings = ClassSettings()) -> ClassModel:
    """Classes of the words of the rows for which ``train`` holds; all rows are kept for :func:`score`."""
    if not 2 <= settings.classes <= 64:
        raise ValueError("2 to 64 classes")
    rows = docs.select("doc_id", "text", F.coalesce(train, F.lit(False)).alias("train"))
    blocks = materialize(rows.mapInArrow(_blocks(settings), f"block long, doc_ids array<{dict(rows.dtypes)['doc_id']}>, {BLOCK}"), "text-blocks")
    moves, bigrams, kept, likelihoods = None, _counted(blocks, None, settings), None, []
    likelihoods.append(likelihood(bigrams))
    for _ in range(max(1, settings.rounds)):
        profiles = _with_classes(blocks.select("block", "train", "ends", "tokens", "words"), moves).mapInArrow(_profiles(settings), "word string, block long, pos int, class short, profile binary")
        moves = materialize(profiles.repartition("word").sortWithinPartitions("word").mapInArrow(_exchange(bigrams, settings), MOVES), "class-moves")
        bigrams = _counted(blocks, moves, settings)
        likelihoods.append(likelihood(bigrams))
        if kept is None or likelihoods[-1] > kept[0]:
            kept = (likelihoods[-1], moves, bigrams)
    _, moves, bigrams = kept
    sizes = np.zeros(settings.classes, np.int64)
    for place, n in moves.where("block is null").select(F.posexplode("sizes").alias("class", "n")).groupBy("class").agg(F.sum("n")).collect():
        sizes[place] = n
    return ClassModel(settings, blocks, moves, bigrams, sizes, tuple(likelihoods))


def _scored(model_logs: tuple[np.ndarray, np.ndarray, np.ndarray], settings: ClassSettings):
    given, unigram, within = model_logs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.select(["ends", "tokens", "packed", "train"]).slice(i, 1).to_pylist()[0]
                classes, counts = _unpacked(row["packed"], "class", np.int8), _unpacked(row["packed"], "count", np.int64)
                classes = np.where(classes < 0, settings.classes, classes)
                within_class = np.where(counts > 0, np.log10(counts + settings.smoothing) - within[classes], 0.0)
                tokens, ends = _numbers(row["tokens"], np.int32), np.array(row["ends"], np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                of = classes[tokens]
                before = np.concatenate([[classes[END]], of[:-1]])
                before[starts] = classes[END]
                base = np.add.reduceat((unigram[classes] + within_class)[tokens], starts)
                score = np.add.reduceat(given[before, of] + within_class[tokens], starts)
                columns = [batch.column("doc_ids").slice(i, 1).flatten(), pa.array(row["train"], pa.bool_()), pa.array(ends - starts), pa.array(np.add.reduceat((counts[tokens] > 0).astype(np.int64), starts))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(base), pa.array(score)], ["doc_id", "train", "n_tokens", "n_known", "base_score", "score"])

    return released(run)


def score(model: ClassModel) -> DataFrame:
    """``doc_id, train, n_tokens, n_known, base_score, score, perplexity`` of every row given to :func:`fit`; scores are log10 of the text's probability."""
    kind = dict(model.blocks.dtypes)["doc_ids"][len("array<") : -1]
    read = _with_classes(model.blocks.select("block", "doc_ids", "train", "ends", "tokens"), model.moves)
    scored = read.mapInArrow(_scored(model.logarithms(), model.settings), f"doc_id {kind}, train boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def _worded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.select(["words", "packed"]).to_pylist():
            classes, counts = _unpacked(row["packed"], "class", np.int8), _unpacked(row["packed"], "count", np.int64)
            met = np.flatnonzero(counts > 0)
            words = pa.array(row["words"], pa.string()).take(pa.array(met))
            yield pa.RecordBatch.from_arrays([words, pa.array(classes[met].astype(np.int32)), pa.array(counts[met])], ["word", "class", "n"])


def word_classes(model: ClassModel) -> DataFrame:
    """``word, class, n`` of every word of the training texts; the end token is the empty word."""
    read = _with_classes(model.blocks.select("block", "words"), model.moves)
    return read.mapInArrow(_worded, "word string, class int, n long").groupBy("word").agg(F.first("class").alias("class"), F.first("n").alias("n"))
