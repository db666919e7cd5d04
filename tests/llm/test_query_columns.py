"""Columns of the registered queries against plain versions on the smallest tables, and that all of them are registered."""

import hashlib
import struct
import zlib

import numpy as np
import public_tokenizers
import xxhash

import __spark_entry__
from arcweave.llm import byte_bpe, quality, queries

SF = "/root/testdata/sf0.001"


def texts(spark):
    return sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())


def test_all_are_registered():
    """A missing module would take all of them away without a word."""
    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()} == {f"op{k}" for k in range(1, 14)} and "pipeline" in names
    assert {"op1_line_dedup", "op5_substring_dedup", "op6_url_filter", "op8_warc", "op12_fill_in_middle", "op13_centroid_clustering"} <= set(__spark_entry__.oracle_sql())


def test_byte_bpe_columns(spark):
    enc = byte_bpe.encoding(queries.BYTE_RANKS, public_tokenizers.PATTERN)
    want = []
    for i, t in texts(spark):
        ids = enc.encode_ordinary(t)
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = queries.op3_byte_bpe(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == want


def test_token_output_columns(spark):
    from tokenizers import Tokenizer

    library, at, want = Tokenizer.from_file(queries.WORD_BPE), 0, []
    for i, t in texts(spark):
        ids = [*library.encode(t, add_special_tokens=False).ids, queries.END_ID]
        want.append((i, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    assert sorted(map(tuple, queries.op10_token_output(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == want


def test_simhash_columns(spark):
    lower = {c: c + 32 for c in range(65, 91)}
    prints = {}
    for i, t in texts(spark):
        words = t.translate(lower).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ")
        words = [w for w in words if w]
        shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = {i: i for i in prints}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= 3:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    got = queries.op7_simhash(spark, SF).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got)) == [(i, f"{prints[i]:016x}", top(i)) for i in ids]


def all_pairs(x, y, l2):
    """Bradley-Terry over every pair of an accepted and a rejected row, by plain gradient steps of Newton's method."""
    z = np.clip((x - x.mean(0)) / (x.std(0) + 1e-6), -6, 6)
    d = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, x.shape[1])
    w = np.zeros(x.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-d @ w))
        w -= 0.5 * np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + l2 * np.eye(len(w)), d.T @ (p - 1) / len(d) + l2 * w)
    return w


def test_fit_against_all_pairs():
    rng = np.random.default_rng(3)
    y = np.arange(60) % 2
    x = rng.normal(size=(60, 6)) + 0.6 * y[:, None] * np.array([1, -1, 0.5, 0, 0, 0])
    want = all_pairs(x, y, 0.05)
    got = quality.fit(x, y, pairs=200_000, l2=0.05)
    assert np.abs(got.weights - want).max() < 0.02 * np.abs(want).max()
    s = got.raw(x)
    assert (s >= got.at).sum() == (y == 1).sum()  # the cut lies at the share of rejected labels
