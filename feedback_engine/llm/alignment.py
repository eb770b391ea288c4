"""Alignment of two tokenizers by sparse products of token and byte incidence.

Each text is encoded by both tokenizers; their tokens cover the same bytes. With the incidence matrices A and B of tokens
and bytes in compressed rows, the product A B^T links the tokens that overlap, by the number of shared bytes. Tokens chained
by overlaps are a group: a group ends at a byte offset where tokens of both end. With the incidence matrices of tokens and
groups, the product links all tokens that share a group. Both products are formed a bounded number of terms at a time.

How many documents hold a linked pair of ids is counted over blocks of documents: a block lists each of its pairs once, so
a pair that every document holds makes one row a block, and looks its count up once a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedback_engine.llm import bpe
from feedback_engine.llm.csr import Csr, product
from feedback_engine.llm.words import slices
from feedback_engine.session import materialize

#: Bytes of text that a task aligns at a time.
BLOCK_BYTES = 1_000_000


@dataclass(frozen=True)
class Tokenizers:
    """Paths a task reads them from: ranks and pattern of a byte-level BPE (A), model of a piece BPE (B)."""

    ranks_path: str
    pattern: str
    model_path: str


def public_tokenizers() -> Tokenizers:
    import public_tokenizers as public

    return Tokenizers(public.path("byte_bpe_50k.tiktoken"), public.PATTERN, public.path("piece_bpe_32k.model"))


class _Coders:
    """Both tokenizers, the bytes of their tokens, and the decimal ids with the signs that follow them."""

    def __init__(self, paths: Tokenizers):
        import base64

        import sentencepiece

        self.a = bpe.load(paths.ranks_path, paths.pattern)
        with open(paths.ranks_path, "rb") as lines:
            ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
        self.bytes_a = [ranks.get(i, b"") for i in range(max(ranks) + 1)]
        self.b = sentencepiece.SentencePieceProcessor(model_file=paths.model_path)
        self.bytes_b = [
            bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()
            for i, piece in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))
        ]
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        # by id and whether the token ends its group's part
        self.written_a = np.array([f"{i}{end}".encode() for i in range(len(self.bytes_a)) for end in ",|"], object)
        self.written_b = np.array([f"{i}{end}".encode() for i in range(len(self.bytes_b)) for end in ",;"], object)

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both, or None where a text is null, empty or not given back by the tokens' bytes."""
        encoded = iter(self.b.encode([t for t in texts if t], num_threads=1))
        out: list[tuple[np.ndarray, np.ndarray] | None] = []
        for text in texts:
            if not text:
                out.append(None)
                continue
            whole = b" " + text.encode()
            ids_a, list_b = np.frombuffer(self.a.ids(" " + text), np.uint32).astype(np.int64), next(encoded)
            same = (
                b"".join(map(self.bytes_b.__getitem__, list_b)) == whole
                and b"".join(map(self.bytes_a.__getitem__, ids_a.tolist())) == whole
            )
            out.append((ids_a, np.array(list_b, np.int64)) if same else None)
        return out


@lru_cache(maxsize=1)
def _coders(paths: Tokenizers) -> _Coders:
    return _Coders(paths)


@dataclass(frozen=True)
class Aligned:
    """Tokens of several texts one after the other: ids, text and group of each, and the overlap links."""

    ids_a: np.ndarray
    ids_b: np.ndarray
    text_a: np.ndarray
    text_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    n_groups: int
    overlap_a: np.ndarray
    overlap_b: np.ndarray
    overlap_bytes: np.ndarray

    def group_links(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(A token, B token) of each pair that shares a group, a bounded number at a time."""
        of_a = Csr.of_labels(self.group_a, self.n_groups)
        of_b = Csr.of_labels(self.group_b, self.n_groups).transposed()
        for first, rows in product(of_a, of_b):
            yield first + rows.rows(), rows.indices


def align(encoded: list[tuple[np.ndarray, np.ndarray] | None], sizes_a: np.ndarray, sizes_b: np.ndarray) -> Aligned:
    """Overlap links and groups of encoded texts; texts without tokens have none."""
    nothing = np.zeros(0, np.int64)
    pairs = [(i, *e) for i, e in enumerate(encoded) if e is not None]
    ids_a = np.concatenate([nothing, *[p[1] for p in pairs]])
    ids_b = np.concatenate([nothing, *[p[2] for p in pairs]])
    text_a = np.repeat([p[0] for p in pairs], [len(p[1]) for p in pairs]) if pairs else nothing
    text_b = np.repeat([p[0] for p in pairs], [len(p[2]) for p in pairs]) if pairs else nothing
    a, b = Csr.of_runs(sizes_a[ids_a]), Csr.of_runs(sizes_b[ids_b])
    parts = [(first + rows.rows(), rows.indices, rows.data) for first, rows in product(a, b.transposed())]
    links_a, links_b, shared = (np.concatenate([nothing, *column]) for column in zip(*parts, strict=True)) if parts else [nothing] * 3
    # rows of the product are runs of columns: a group goes on while a row begins with the column the last one ended with
    ends = np.flatnonzero(np.append(links_a[1:] != links_a[:-1], True)) if len(links_a) else nothing
    begins = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else nothing
    new = np.concatenate([[0], links_b[begins[1:]] > links_b[ends[:-1]]]).astype(np.int64) if len(ends) else nothing
    group_a = np.cumsum(new)
    group_b = np.zeros(len(ids_b), np.int64)
    group_b[links_b] = group_a[links_a]
    n_groups = int(group_a[-1]) + 1 if len(group_a) else 0
    return Aligned(ids_a, ids_b, text_a, text_b, group_a, group_b, n_groups, links_a, links_b, shared)


def _digests(found: Aligned, coders: _Coders, n_texts: int) -> list[str]:
    """sha256 of ``a1,a2|b1;a3|b2,b3`` of each text; empty without tokens."""
    in_a = np.bincount(found.group_a, minlength=found.n_groups)
    in_b = np.bincount(found.group_b, minlength=found.n_groups)
    last_a, last_b = (np.append(g[1:] != g[:-1], True)[: len(g)].astype(np.int64) for g in (found.group_a, found.group_b))
    written = np.empty(len(found.ids_a) + len(found.ids_b), object)
    at_a = np.arange(len(found.ids_a)) + (np.cumsum(in_b) - in_b)[found.group_a]
    at_b = np.arange(len(found.ids_b)) + np.cumsum(in_a)[found.group_b]
    written[at_a] = coders.written_a[found.ids_a * 2 + last_a]
    written[at_b] = coders.written_b[found.ids_b * 2 + last_b]
    sizes = np.bincount(found.text_a, minlength=n_texts) + np.bincount(found.text_b, minlength=n_texts)
    ends = np.cumsum(sizes)
    return [
        hashlib.sha256(b"".join(written[end - size : end].tolist())[:-1]).hexdigest() if size else ""
        for end, size in zip(ends.tolist(), sizes.tolist(), strict=True)
    ]


_BLOCKS = pa.schema(
    [("block", pa.int64()), ("id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_overlaps", pa.int64()),
     ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("places", pa.list_(pa.int32())),
     ("times", pa.list_(pa.int32())), ("codes", pa.list_(pa.int64())), ("docs", pa.list_(pa.int32()))]
)
_BLOCK_COLUMNS = (
    "block long, id long, n_a long, n_b long, n_overlaps long, n_groups long, n_links long, groups_sha256 string, "
    "places array<int>, times array<int>, codes array<long>, docs array<int>"
)


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))


def _block(number: int, ids: pa.Array, texts: list[str | None], coders: _Coders) -> pa.RecordBatch:
    """A row for each text, with its linked id pairs as places in the block's list; then a row with that list."""
    n = len(texts)
    found = align(coders.encode(texts), coders.sizes_a, coders.sizes_b)
    n_codes = len(coders.bytes_a) * len(coders.bytes_b)
    keys, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
    n_links = np.zeros(n, np.int64)
    for a, b in found.group_links():
        n_links += np.bincount(found.text_a[a], minlength=n)
        code = found.ids_a[a] * len(coders.bytes_b) + found.ids_b[b]
        key, count = np.unique(found.text_a[a] * n_codes + code, return_counts=True)
        keys, times = np.concatenate([keys, key]), np.concatenate([times, count])
    keys, back = np.unique(keys, return_inverse=True)  # a text may lie in two parts
    times = np.bincount(back, times, len(keys)).astype(np.int64)
    codes, places, docs = np.unique(keys % n_codes, return_inverse=True, return_counts=True)
    of_text = np.bincount(keys // n_codes, minlength=n)
    groups = np.zeros(n, np.int64)
    if found.n_groups:
        groups += np.bincount(found.text_a[np.flatnonzero(np.append(found.group_a[1:] != found.group_a[:-1], True))], minlength=n)
    rows = [
        pa.array(np.full(n, number)), ids.cast(pa.int64()), pa.array(np.bincount(found.text_a, minlength=n)),
        pa.array(np.bincount(found.text_b, minlength=n)), pa.array(np.bincount(found.text_a[found.overlap_a], minlength=n)),
        pa.array(groups), pa.array(n_links), pa.array(_digests(found, coders, n)), _lists(places, of_text),
        _lists(times, of_text), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int32())),
    ]
    listing = [pa.array([number]), *[pa.nulls(1, f.type) for f in list(_BLOCKS)[1:10]],
               pa.array([codes], pa.list_(pa.int64())), pa.array([docs.astype(np.int32)], pa.list_(pa.int32()))]
    return pa.record_batch([pa.concat_arrays([x.cast(f.type), y]) for x, y, f in zip(rows, listing, _BLOCKS, strict=True)], _BLOCKS)


def aligned(docs: DataFrame, paths: Tokenizers, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_overlaps.

    Texts are encoded without special tokens, A with a blank before the text. Links are all A-B token occurrences of one
    group. An id pair's count is the number of rows that hold it linked; ``n_best`` counts the links whose count
    is the highest of their A id (ties included), ``count_sum`` adds up the counts of all links. Null and empty texts, and
    those whose tokens do not give back the text, have zeros and an empty digest. Repeated rows are documents of
    their own; a null id stays null. An empty table gives an empty table. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders, number = _coders(paths), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, 1, BLOCK_BYTES):
                yield _block(number, part.column(0), part.column(1).to_pylist(), coders)
                number += 1

    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    blocks = materialize(narrow.mapInArrow(run, _BLOCK_COLUMNS), "alignment-blocks")
    listed = blocks.where("codes is not null").select("block", F.posexplode(F.arrays_zip("codes", "docs")).alias("place", "of"))
    listed = listed.select("block", "place", F.col("of.codes").alias("code"), F.col("of.docs").alias("docs"))
    counts = materialize(listed.groupBy("code").agg(F.sum("docs").alias("held")), "pair-counts")
    counts = counts.withColumn("a", F.expr(f"code div {_n_pieces(paths)}"))
    best = counts.groupBy("a").agg(F.max("held").alias("top"))
    looked = counts.join(best, "a").select("code", "held", (F.col("held") == F.col("top")).alias("best"))
    pairs = listed.select("block", "place", "code").join(looked, "code").select(
        F.col("block").alias("of_block"), "place", "held", "best"
    )
    rows = blocks.where("codes is null").drop("codes", "docs")
    out = "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, n_overlaps long"

    def summed(texts: pa.Table, counted: pa.Table) -> pa.Table:
        held, top = np.zeros(len(counted), np.int64), np.zeros(len(counted), np.int64)
        place = counted["place"].to_numpy()
        held[place], top[place] = counted["held"].to_numpy(), counted["best"].to_numpy()
        of, times = texts["places"].combine_chunks(), texts["times"].combine_chunks().flatten().to_numpy().astype(np.int64)
        text = np.repeat(np.arange(len(texts)), pc.list_value_length(of).to_numpy())
        at = of.flatten().to_numpy()
        sums = np.zeros((2, len(texts)), np.int64)
        np.add.at(sums[0], text, times * top[at])
        np.add.at(sums[1], text, times * held[at])
        added = {"n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1])}
        return pa.table({name: added[name] if name in added else texts[name] for name in [c.split()[0] for c in out.split(", ")]})

    result = rows.groupBy("block").cogroup(pairs.groupBy("of_block")).applyInArrow(summed, out)
    return result.withColumnRenamed("id", id_col)


def _n_pieces(paths: Tokenizers) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=paths.model_path).get_piece_size()


def token_links(
    docs: DataFrame, paths: Tokenizers, kind: str = "overlap", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per link: id, a and b (places of the tokens in the text, from 0), a_id, b_id, shared_bytes.

    ``kind`` is ``overlap`` or ``group``; tokens of one group that do not overlap share 0 bytes. Texts without tokens (see
    ``aligned``) give no rows.
    """
    if kind not in ("overlap", "group"):
        raise ValueError(f"no links of kind {kind!r}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = _coders(paths)
        for batch in batches:
            for part in slices(batch, 1, BLOCK_BYTES):
                found = align(coders.encode(part.column(1).to_pylist()), coders.sizes_a, coders.sizes_b)
                first_a = np.searchsorted(found.text_a, np.arange(len(part)))
                first_b = np.searchsorted(found.text_b, np.arange(len(part)))
                n_b = max(1, len(found.ids_b))
                overlaps = found.overlap_a * n_b + found.overlap_b  # sorted
                for a, b in found.group_links() if kind == "group" else [(found.overlap_a, found.overlap_b)]:
                    if not len(a):
                        continue
                    at = np.minimum(np.searchsorted(overlaps, a * n_b + b), len(overlaps) - 1)
                    shared = np.where(overlaps[at] == a * n_b + b, found.overlap_bytes[at], 0)
                    text = found.text_a[a]
                    yield pa.record_batch(
                        [part.column(0).cast(pa.int64()).take(pa.array(text)), pa.array(a - first_a[text]),
                         pa.array(b - first_b[text]), pa.array(found.ids_a[a]), pa.array(found.ids_b[b]), pa.array(shared)],
                        ["id", "a", "b", "a_id", "b_id", "shared_bytes"],
                    )

    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    found = narrow.mapInArrow(run, "id long, a long, b long, a_id long, b_id long, shared_bytes long")
    return found.withColumnRenamed("id", id_col)
