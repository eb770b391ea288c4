"""Phrase collocations by prefix-free parsing.

Texts are parsed into chunks: a chunk begins where a piece begins or where the hash of the next ``overlap`` words hits a
trigger, and ends after the trigger words of its successor, so neighbours overlap by ``overlap`` words and no chunk is a
proper prefix of another that ends alike. The distinct chunks with their frequencies are the dictionary: copied text is
counted once from there on. N-grams are counted inside distinct chunks, weighted with the chunk's frequency; an n-gram
belongs to the chunk in which it begins before the overlap, so overlaps count once.

Which n-grams may be frequent is first told from counts of their hashes, and only where both (n-1)-grams may be. Bit
filters of bounded size hold the answer; what they let through wrongly is counted by its words and found too rare, so
counts and results do not depend on hashes or filters.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedback_engine.llm.common import join_counted
from feedback_engine.llm.shingles import _mix
from feedback_engine.llm.words import joined_bytes, scan, slices, windows
from feedback_engine.session import materialize

#: A chunk holds about so many words before the next trigger.
TRIGGER = 24
#: Entries of a task's table of chunks or n-grams before it is handed on.
HELD = 200_000
#: 64-bit words of the filter at most: 32 MB.
FILTER_WORDS = 1 << 22
#: Rows of a group that meet in one task when the best are chosen, in multiples of their number.
SPREAD = 20

# pieces end at . , ; : ! ? and 0x0A-0x0D; words are split by blanks and tabs
_ENDS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")
# a chunk's key ends with 0x0A where the piece ends with it, else with 0x0D
_PIECE_END, _GOES_ON = 0x0A, 0x0D
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, _PIECE_END, _GOES_ON]] = True


def _rows(counts: dict[str, Counter]) -> pa.RecordBatch:
    langs = [lang for lang, of in counts.items() for _ in of]
    return pa.record_batch(
        [
            pa.array(langs, pa.string()),
            pa.array([key for of in counts.values() for key in of], pa.binary()).cast(pa.string()),
            pa.array([n for of in counts.values() for n in of.values()], pa.int64()),
        ],
        ["lang", "key", "times"],
    )


def _slices(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, rows.num_rows, HELD):
        yield rows.slice(at, HELD)


def parse(data: bytes, overlap: int, trigger: int) -> Iterator[bytes]:
    """Keys of the chunks of a buffer of pieces (each ends with 0x0A, all blanks are single).

    Words of a chunk are joined by one blank; the key of a piece's last chunk ends with 0x0A, others with 0x0D.
    """
    starts, ends, hashes = scan(data, _BLANK)
    if not len(starts):
        return
    piece = np.cumsum(np.frombuffer(data, np.uint8) == 0x0A)[starts]
    n, width = len(starts), max(overlap, 1)
    begins = np.ones(n, bool)
    begins[1:] = piece[1:] != piece[:-1]
    hit = np.zeros(n, bool)
    window = windows(hashes, width)
    whole = piece[: len(window)] == piece[width - 1 : width - 1 + len(window)]
    hit[: len(window)] = whole & (window % np.uint64(trigger) == 0)
    firsts = np.flatnonzero(begins | hit)
    nexts = np.append(firsts[1:], n)
    tail = np.append(begins[firsts[1:]], True)
    stops = ends[np.where(tail, nexts, nexts + overlap) - 1]
    for start, stop, last in zip(starts[firsts].tolist(), stops.tolist(), tail.tolist(), strict=True):
        yield data[start:stop] + (b"\n" if last else b"\r")


def _single_blanks(data: bytes) -> bytes:
    while b"  " in data:
        data = data.replace(b"  ", b" ")
    return data


def dictionary(docs: DataFrame, lang: Column, text: Column, overlap: int = 2, trigger: int = TRIGGER) -> DataFrame:
    """(lang, key, times): the distinct chunks of each language and how often the parses hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in batches:
            for part in slices(batch, 1):
                texts: dict[str, list[bytes]] = {}
                for code, body in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    texts.setdefault(code, []).append(body.encode())
                for code, bodies in texts.items():
                    data = _single_blanks(b"\n".join(bodies).lower().translate(_ENDS) + b"\n")
                    counts.setdefault(code, Counter()).update(parse(data, overlap, trigger))
                if sum(map(len, counts.values())) > HELD:
                    yield _rows(counts)
                    counts = {}
        yield _rows(counts)

    narrow = docs.select(F.coalesce(lang, F.lit("und")).alias("lang"), F.coalesce(text, F.lit("")).alias("text"))
    parsed = narrow.mapInArrow(run, "lang string, key string, times long")
    return parsed.groupBy("lang", "key").agg(F.sum("times").alias("times"))


def _lang_seed(lang: str) -> int:
    return int(_mix(np.array([int.from_bytes(lang.encode()[i : i + 8], "little") + i for i in range(0, len(lang.encode()) or 1, 8)],
                             np.uint64)).sum(dtype=np.uint64))


def _bits(hashes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Word of the filter, and the mask of three bits in it."""
    one = np.uint64(1)
    mask = np.zeros(len(hashes), np.uint64)
    for shift in (46, 52, 58):
        mask |= one << (hashes >> np.uint64(shift) & np.uint64(63))
    return (hashes & np.uint64((1 << 40) - 1)) % np.uint64(words), mask


def phrase_filter(hashes: DataFrame, n_hashes: int) -> np.ndarray:
    """Bit filter of the distinct values of column ``h``; its size follows their number up to FILTER_WORDS."""
    words = int(min(FILTER_WORDS, max(1, n_hashes // 4)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, mask = _bits(batch.column(0).to_numpy().view(np.uint64), words)
            yield pa.record_batch([pa.array(at.view(np.int64)), pa.array(mask.view(np.int64))], ["at", "mask"])

    rows = hashes.select("h").mapInArrow(run, "at long, mask long")
    out = np.zeros(words, np.uint64)
    for row in rows.groupBy("at").agg(F.bit_or("mask").alias("mask")).collect():  # at most ``words`` rows
        out[row["at"]] = row["mask"] & ((1 << 64) - 1)
    return out


class _Chunks:
    """Words of a slice of the dictionary: places, hashes, and which n-grams begin where."""

    def __init__(self, part: pa.RecordBatch, overlap: int):
        langs = part.column(0).dictionary_encode()
        self.langs = langs.dictionary.to_pylist()
        self.data = joined_bytes(part.column(1))
        self.starts, self.ends, self.hashes = scan(self.data, _BLANK)
        raw = np.frombuffer(self.data, np.uint8)
        marks = np.flatnonzero((raw == _PIECE_END) | (raw == _GOES_ON))
        self.chunk = np.searchsorted(marks, self.starts)
        tail = raw[marks] == _PIECE_END
        sizes = np.bincount(self.chunk, minlength=len(marks))
        at = np.arange(len(self.starts)) - (np.cumsum(sizes) - sizes)[self.chunk]
        self.begins = at < np.where(tail, sizes, sizes - overlap)[self.chunk]
        self.after = sizes[self.chunk] - at  # words from here to the chunk's end
        self.times = part.column(2).to_numpy()[self.chunk]
        self.lang = langs.indices.to_numpy()[self.chunk]  # place of each word's language
        self.seed = np.array([_lang_seed(x) for x in self.langs], np.uint64)[self.lang]

    def grams(self, n: int) -> np.ndarray:
        """Hash of the n words from each place on that has as many words after it in the buffer."""
        return windows(self.hashes, n, self.seed[: max(0, len(self.hashes) - n + 1)])

    def places(self, n: int, known: np.ndarray | None) -> np.ndarray:
        """Where n-grams begin that this chunk owns; with ``known`` only where both (n-1)-grams may be frequent."""
        ok = self.begins & (self.after >= n)
        if known is not None:
            shorter = _held(known, self.grams(n - 1))
            ok[: max(0, len(shorter) - 1)] &= shorter[:-1] & shorter[1:]
            ok[max(0, len(shorter) - 1) :] = False
        return np.flatnonzero(ok)


def _held(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at, mask = _bits(hashes, len(known))
    return known[at] & mask == mask


def hashed_grams(chunks: DataFrame, n: int, overlap: int, known: np.ndarray | None) -> DataFrame:
    """(h, times): hashes of the n-grams of the dictionary with their frequency in the corpus."""
    shared = None if known is None else chunks.sparkSession.sparkContext.broadcast(known)

    def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        hashes, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return hashes, np.bincount(back, np.concatenate([p[1] for p in parts]), len(hashes)).astype(np.int64)

    def rows(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        hashes, times = summed(parts)
        return pa.record_batch([pa.array(hashes.view(np.int64)), pa.array(times)], ["h", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for part in slices(batch, 1):
                own = _Chunks(part, overlap)
                at = own.places(n, None if shared is None else shared.value)
                held.append((own.grams(n)[at], own.times[at]))
                if sum(len(h) for h, _ in held) > HELD * 8:
                    held = [summed(held)]
                    if len(held[0][0]) > HELD * 4:
                        yield rows(held)
                        held = []
        if held:
            yield rows(held)

    found = chunks.select("lang", "key", "times").mapInArrow(run, "h long, times long")
    return found.groupBy("h").agg(F.sum("times").alias("times"))


def counted_grams(chunks: DataFrame, most_words: int, known: list[np.ndarray]) -> DataFrame:
    """(lang, key, times): n-grams of 1 to ``most_words`` words with their frequency, but for many rare ones.

    ``known[n - 1]`` is the filter of the frequent n-grams, for each n below ``most_words``.
    """
    shared = chunks.sparkSession.sparkContext.broadcast(known)
    overlap = most_words - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in batches:
            for part in slices(batch, 1):
                own = _Chunks(part, overlap)
                for n in range(1, most_words + 1):
                    at = own.places(n, shared.value[n - 2] if n == most_words and n > 1 else None)
                    if n < most_words:
                        at = at[_held(shared.value[n - 1], own.grams(n)[at])]
                    for i, lang in enumerate(own.langs):
                        to = counts.setdefault(lang, Counter())
                        for once in (True, False):
                            mine = at[(own.lang[at] == i) & ((own.times[at] == 1) == once)]
                            pairs = zip(own.starts[mine].tolist(), own.ends[mine + n - 1].tolist(), strict=True)
                            found = [own.data[start:end] for start, end in pairs]
                            if once:
                                to.update(found)
                            else:
                                for gram, k in zip(found, own.times[mine].tolist(), strict=True):
                                    to[gram] += k
                if sum(map(len, counts.values())) > HELD * 6:  # what is frequent then leaves a task once or twice
                    yield from _slices(_rows(counts))
                    counts = {}
        yield from _slices(_rows(counts))

    found = chunks.select("lang", "key", "times").mapInArrow(run, "lang string, key string, times long")
    return found.groupBy("lang", "key").agg(F.sum("times").alias("times"))


def best_rows(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group with ``rank`` from 1; ``order`` is total.

    Rows are dealt over salts that each keep ``n``, until what is left of a group fits one task: a third of all
    rows in one group is no more than many small sorts.
    """
    left, salts = rows, -(-rows.count() // (SPREAD * n))
    while salts > 1:
        dealt = Window.partitionBy(group, "__salt").orderBy(*order)
        salted = left.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)))
        left = materialize(salted.withColumn("rank", F.row_number().over(dealt)).where(F.col("rank") <= n).drop("rank", "__salt"), "best")
        salts = -(-salts // SPREAD) if salts > SPREAD else 1
    ranked = left.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.where(F.col("rank") <= n)


def _join(first: Column, at: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice(first, at, length), " ")


def _with_part(cuts: DataFrame, frequent: DataFrame, part: str, name: str) -> DataFrame:
    """Adds the frequency of ``part``; a part may be that of a third of all cuts (a very common word)."""
    members = cuts.groupBy("lang", part).agg(F.count("*").alias("members"))
    groups = members.join(frequent.select("lang", F.col("key").alias(part), F.col("times").alias(name)), ["lang", part])
    groups = materialize(groups, "parts")
    joined = join_counted(cuts, groups, ["lang", part], "members", cuts.count(), F.xxhash64("phrase", "k"))
    return materialize(joined.drop("members"), "cuts")


def collocations(
    docs: DataFrame, most_words: int = 3, least: int = 10, share: int = 50, first: int = 2000,
    lang_col: str = "lang", text_col: str = "text",
) -> DataFrame:
    """The first ``first`` collocations of each language: lang, rank, phrase, a, l, r, n, score.

    A-Z are lower-cased, texts are split at ``.,;:!?`` and line ends into pieces, these at blanks and tabs into words.
    A candidate has 2 to ``most_words`` words and a frequency a >= ``least``. Its score is the lowest of
    floor(10^6 a^2 / (l r)) over its cuts in two (ties: the smallest cut), l and r the frequencies of the parts, in exact
    decimals. Candidates within a longer one of at least ``share`` percent of their frequency go. Order: score and a
    descending, phrase by bytes. Null texts are empty, a null language is ``und`` (as the language of that name).
    Repeated rows count as often as they stand. Empty tables give empty results; other columns are not read.
    """
    overlap = most_words - 1
    chunks = materialize(dictionary(docs, F.col(f"`{lang_col}`"), F.col(f"`{text_col}`"), overlap), "chunks")
    words = F.size(F.split("key", " ")) - F.when(F.col("key").endswith("\n"), 0).otherwise(overlap)
    totals = chunks.groupBy("lang").agg(F.sum(F.col("times") * words).alias("n"))
    known: list[np.ndarray] = []
    for n in range(1, most_words):
        hashes = hashed_grams(chunks, n, overlap, known[-1] if known else None).where(F.col("times") >= least)
        hashes = materialize(hashes.select("h"), f"frequent-{n}")
        known.append(phrase_filter(hashes, hashes.count()))
    frequent = counted_grams(chunks, most_words, known).where(F.col("times") >= least)
    frequent = materialize(frequent.withColumn("n_words", F.size(F.split("key", " "))), "frequent")

    candidates = frequent.where("n_words > 1").select("lang", F.col("key").alias("phrase"), F.col("times").alias("a"), "n_words")
    words = F.split("phrase", " ")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1))).select(
        "lang", "phrase", "a", "n_words", "k", _join(words, 1, F.col("k")).alias("head"),
        _join(words, F.col("k") + 1, F.col("n_words") - F.col("k")).alias("rest"),
    )
    cuts = materialize(cuts, "cuts")
    cuts = _with_part(_with_part(cuts, frequent, "head", "l"), frequent, "rest", "r")
    exact = "decimal(38,0)"
    score = F.expr(f"(cast(1000000 as {exact}) * cast(a as {exact}) * cast(a as {exact})) div (cast(l as {exact}) * cast(r as {exact}))")
    scored = cuts.withColumn("score", score.cast("long")).groupBy("lang", "phrase", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut")
    )

    inner = candidates.where("n_words > 2").select(
        "lang", "a", "phrase", F.explode(F.sequence(F.lit(2), F.col("n_words") - 1)).alias("m"), "n_words"
    )
    inner = inner.select("lang", "a", "m", "phrase", F.explode(F.sequence(F.lit(1), F.col("n_words") - F.col("m") + 1)).alias("at"))
    covered = inner.select("lang", F.col("a").alias("longer"), _join(words, F.col("at"), F.col("m")).alias("phrase")).groupBy(
        "lang", "phrase"
    ).agg(F.max("longer").alias("longer"))
    kept = scored.join(covered, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share)
    )
    kept = materialize(kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"), "collocations")
    best = best_rows(kept, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], first)
    return best.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
