"""Tokenizer alignment against a brute-force version, and the sparse product against dense matrices."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest

from feedback_engine.llm import alignment
from feedback_engine.llm import queries as Q
from feedback_engine.llm.common import ship_code
from feedback_engine.llm.csr import Csr, product

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def _byte_table() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@pytest.fixture(scope="module")
def coders():
    import public_tokenizers as public
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))


def brute_force(rows, coders):
    """rows: (doc_id, text) -> the contract's columns, token by token."""
    a, b = coders
    alphabet = _byte_table()
    entries = {i: bytes(alphabet[c] for c in t) for t, i in a.get_vocab().items() if all(c in alphabet for c in t)}
    out, links, held = [], [], Counter()
    for doc_id, text in rows:
        groups = []
        if text:
            whole = b" " + text.encode()
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            bytes_a = [entries[i] for i in ids_a]
            bytes_b = [
                bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
                for i in ids_b
            ]
            if b"".join(bytes_a) == whole == b"".join(bytes_b):
                ends_a, ends_b = (np.cumsum([len(x) for x in t]).tolist() for t in (bytes_a, bytes_b))
                both, i, j = sorted(set(ends_a) & set(ends_b)), 0, 0
                for end in both:
                    i2, j2 = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
                    groups.append((ids_a[i:i2], ids_b[j:j2]))
                    i, j = i2, j2
        own = Counter((x, y) for ga, gb in groups for x in ga for y in gb)
        held.update(own.keys())
        links.append(own)
        said = ";".join(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}" for ga, gb in groups)
        out.append([doc_id, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(own.values()),
                    hashlib.sha256(said.encode()).hexdigest() if groups else ""])
    top = Counter()
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    done = []
    for row, own in zip(out, links, strict=True):
        n_best = sum(k for (x, y), k in own.items() if held[x, y] == top[x])
        done.append((*row[:5], n_best, sum(k * held[p] for p, k in own.items()), row[5]))
    return sorted(done, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def test_driver_documents(spark, sf_dir, coders):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert rows_of(Q.QUERIES["op12_tokenizer_alignment"](spark, sf_dir)) == brute_force([tuple(r) for r in docs], coders)


def test_odd_texts(spark, coders):
    ship_code(spark)
    texts = [
        None, "", " ", "\n\t ", "a", "tokenization  of   words", "tokenization  of   words", "a<|endoftext|>b </s><s> <unk> <0x41>",
        "▁ lower block", "Ωμέγα привет 你好 한국어 \U0001F642‍\U0001F9D1", "é   　 ﬁ ½", "x" * 5000,
        "中" * 3000, "word " * 30_000, "\x00 nul", "\r\n\r\n",
    ]
    rows = [(i if i else None, t, "en", "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, N_A string, block string").repartition(3)
    found = rows_of(alignment.aligned(docs, alignment.public_tokenizers()))
    assert found == brute_force([r[:2] for r in rows], coders)
    assert dict((r[0], r[1]) for r in found)[8] == 0  # its block sign comes back as a blank
    assert alignment.aligned(docs.where("false"), alignment.public_tokenizers()).count() == 0


def test_token_links(spark):
    ship_code(spark)
    docs = spark.createDataFrame([(1, "unbelievable tokenizers"), (2, None), (3, "you")], "doc_id long, text string")
    overlap, group = (alignment.token_links(docs, alignment.public_tokenizers(), kind).toPandas() for kind in ("overlap", "group"))
    assert overlap.groupby("doc_id").shared_bytes.sum().to_dict() == {1: 24, 3: 4}
    assert (overlap.shared_bytes > 0).all()
    both = group.merge(overlap, on=["doc_id", "a", "b"], suffixes=("", "_o"), how="left")
    assert len(group) >= len(overlap) and (both.shared_bytes == both.shared_bytes_o.fillna(0)).all()
    with pytest.raises(ValueError):
        alignment.token_links(docs, alignment.public_tokenizers(), "other")


@pytest.mark.parametrize("most", [1, 7, 10_000])
def test_product_against_dense(most):
    rng = np.random.default_rng(3)
    for n, k, m in ((0, 3, 2), (1, 1, 1), (7, 5, 9), (20, 30, 10)):
        dense = [rng.integers(-2, 3, shape) * (rng.random(shape) < 0.4) for shape in ((n, k), (k, m))]
        a, b = (
            Csr(np.concatenate([[0], np.cumsum((d != 0).sum(axis=1))]).astype(np.int64), np.nonzero(d)[1], d[np.nonzero(d)], d.shape[1])
            for d in dense
        )
        out = np.zeros((n, m), np.int64)
        for first, rows in product(a, b, most):
            out[first + rows.rows(), rows.indices] += rows.data
        assert (out == dense[0] @ dense[1]).all()
        back = a.transposed()
        assert (back.transposed().indices == a.indices).all() and back.n_rows == k
