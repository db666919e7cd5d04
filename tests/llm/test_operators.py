"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and the edge cases of its docstring."""

import hashlib
import itertools
import random
import re
import struct
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from arcweave.llm import byte_bpe, decontaminate, fingerprints, line_dedup, near_copies, quality, queries, simhash, substring_dedup, token_output, url_filter, warc
from arcweave.llm.common import components, work_folder

SF = "/root/testdata/sf0.001"
#: Names that the operators use inside: they must not clash with an input's own columns.
CLASHING = {"id": 1, "th": 2, "row": 3, "kept": 4, "fp": 5, "tile": 6, "lines": 7, "left": 8, "starts": 9, "val": 10}


def documents(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    return df.withColumns({k: F.lit(v) for k, v in CLASHING.items()}) if extra else df


WORDS = "the of and erth onin hea ting ble st nd over inly sh ou wh tion ea re ha es".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared passages, nulls, empty and long texts, ties, repeated rows, a null id."""
    rng = random.Random(1)
    base, passage = prose(rng, 60), "\n".join(prose(rng, 8) for _ in range(5))
    rows = [(i, prose(rng, rng.randrange(1, 80))) for i in range(40)]
    rows += [(100 + i, base) for i in range(4)] + [(110 + i, base.replace(" ", "  ", 1).upper() if i % 2 else base + " tail" + str(i)) for i in range(4)]
    rows += [(120 + i, prose(rng, 20) + "\n" + passage + "\n" + prose(rng, 20)) for i in range(6)]
    rows += [(130, None), (131, ""), (132, "   \n\t "), (133, "one"), (134, "two words"), (135, "\n\n\n\n\n")]
    rows += [(140, "ÄRGER ﬁne  Straße Ⅳ"), (141, "ärger fine strasse iv"), (142, "A\u030a b"), (143, "å b")]
    rows += [(150, prose(rng, 9000)), (151, "x" * 30_000), (100, base), (None, base), (160, "a b c\r\nd\x0be\x1cf\u00a0g <|endoftext|>")]
    return rows


def texts_in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


# --- 1 line dedup


def test_line_dedup(spark, corpus):
    got = line_dedup.without_repeats(documents(spark, corpus))
    assert got.columns == documents(spark, corpus).columns
    seen, want = {}, {}
    distinct = sorted({(i, t or "") for i, t in corpus}, key=lambda r: (r[0] is not None, r[0] or 0))
    for i, t in distinct:
        lines = t.split("\n")
        gone = set()
        for k in range(len(lines) - 2):
            if seen.setdefault(tuple(lines[k : k + 3]), (i, k)) != (i, k):
                gone |= {k, k + 1, k + 2}
        want[i, t] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    rows = got.collect()
    assert len(rows) == len(corpus)
    assert sorted(str((r.doc_id, r.text)) for r in rows) == sorted(str((i, want[i, t or ""])) for i, t in corpus)
    assert all(r.n_chars == len(r.text) and r.val == 10 for r in rows)
    assert line_dedup.dedup_lines(documents(spark, []), "doc_id").count() == 0


def colliding_lines(seed=42):
    """Two printable lines of 64 characters with one XXH64: a lane's second word makes up for a change of its first."""
    p1, p2, full = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, (1 << 64) - 1
    turned = lambda v: ((v << 31) | (v >> 33)) & full
    lane = lambda word: turned((seed + p1 + p2 + word * p2) & full) * p1 & full
    rng = random.Random(0)
    line = bytes(rng.choice(b"abcdefghijklmnopqrstuvwxyz") for _ in range(64))
    a, b = int.from_bytes(line[:8], "little"), int.from_bytes(line[32:40], "little")
    while True:
        first = bytes(rng.choice(b"abcdefghijklmnopqrstuvwxyz") for _ in range(8))
        second = (b + (lane(a) - lane(int.from_bytes(first, "little"))) * pow(p2, -1, 1 << 64)) & full
        second = second.to_bytes(8, "little")
        if all(32 <= c < 127 for c in second):
            return line.decode(), (first + line[8:32] + second + line[40:]).decode()


def test_line_dedup_of_lines_built_to_collide(spark):
    x, y = colliding_lines()
    assert x != y and xxhash.xxh64_intdigest(x, 42) == xxhash.xxh64_intdigest(y, 42)
    rows = [(1, f"{x}\nsecond\nthird"), (2, f"{y}\nsecond\nthird"), (3, f"{x}\nsecond\nthird\nfourth"), (4, f"second\n{x}\nthird")]
    got = {r.row.doc_id: (r.n_removed, r.kept) for r in line_dedup.dedup_lines(documents(spark, rows)).collect()}
    assert got == {1: (0, rows[0][1]), 2: (0, rows[1][1]), 3: (3, "fourth"), 4: (0, rows[3][1])}


# --- 2 quality


def test_quality_held_out(spark):
    out = queries.op2_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (out.predicted == out.quality).mean() > 0.95
    good, bad = out.score[out.quality == 1].to_numpy(), out.score[out.quality == 0].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.98
    assert all(zlib.crc32(str(i).encode()) % 4 == 2 for i in out.doc_id)


def test_quality_edges(spark, corpus):
    docs = documents(spark, corpus)
    none = spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, none)
    assert quality.keep_good(docs, model).count() == len(corpus)
    labels = spark.createDataFrame([(i, int(i < 20), 0) for i in range(40)], "doc_id long, quality int, toxic int")
    scores = docs.select(quality.score_column(quality.train(docs, labels), F.col("text")).alias("s")).toPandas().s
    assert scores.between(0, 1).all()
    x = np.random.default_rng(0).normal(size=(200, 3))
    m = quality.fit(x, (x[:, 0] > 0).astype(int))
    assert ((m.score(x) >= 0.7) == (x[:, 0] > 0)).mean() > 0.97


def test_threshold_covers_all_labelled_rows(spark):
    """A fit on 40 rows; the cut lies where the share of rejected labels of all rows ends, ids repeated and null included."""
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("abcdefgh \n!?12"), rng.integers(20, 200))) for _ in range(600)]
    docs = spark.createDataFrame([(None if i % 50 == 0 else i - i % 3 // 2, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(len(t) > 60)) for i, t in enumerate(texts)], "doc_id long, quality int")
    model, raw = quality.ranked(docs, labels, fit_rows=40)
    rows = raw.join(labels, raw.id == labels.doc_id).toPandas()
    rejected = int((rows.quality == 0).sum())
    ordered = np.sort(rows.raw.to_numpy())
    assert 0 < rejected < len(rows) and raw.count() == len(texts)
    assert model.at == pytest.approx((ordered[rejected - 1] + ordered[rejected]) / 2, abs=1e-12)
    assert model.spread == pytest.approx(rows.raw.std(ddof=0) / 2)
    placed = raw.select(quality.placed(model, F.col("raw")).alias("s")).toPandas().s
    whole = docs.select(quality.score_column(model, F.col("text")).alias("s")).toPandas().s
    assert np.allclose(np.sort(placed), np.sort(whole))


# --- 3 byte-level BPE


def test_byte_bpe(spark, corpus):
    enc = byte_bpe.encoding(queries.BYTE_RANKS, public_tokenizers.PATTERN)
    got = byte_bpe.encode_decode(documents(spark, corpus), queries.BYTE_RANKS, public_tokenizers.PATTERN).collect()
    want = sorted(str((i, enc.encode_ordinary(t or ""), (t or "").encode())) for i, t in corpus)
    assert sorted(str((r.doc_id, list(struct.unpack(f"<{r.n_tokens}I", r.ids)), bytes(r.decoded))) for r in got) == want


def test_safe_chunks():
    enc = byte_bpe.encoding(queries.BYTE_RANKS, public_tokenizers.PATTERN)
    rng = random.Random(2)
    for _ in range(200):
        t = "".join(rng.choice(["a", "é", " ", "  ", "\n", "'s", "1", "!", "\u3000", "\x85", "漢"]) for _ in range(300))
        cut = list(byte_bpe.safe_chunks(t, 20))
        assert "".join(cut) == t
        assert [i for p in cut for i in enc.encode_ordinary(p)] == enc.encode_ordinary(t)


#: Each match of the pattern by itself, found by another engine (with the Unicode properties, and possessive runs).
MATCHES = regex.compile(public_tokenizers.PATTERN.replace("|\\s+(?!\\S)|\\s+", f"|[{byte_bpe.BLANK}]+(?![^{byte_bpe.BLANK}])|[{byte_bpe.BLANK}]+").replace("[^\\s", f"[^{byte_bpe.BLANK}"))


def long_blanks(n):
    rng = random.Random(9)
    yield from (" " * n, "\n" * n, "\t " * n, "word" + " " * n, "word" + " " * n + "word", "\u3000" * n + "!", "!" + "\n " * n + "'s", "\x85" * n + "\x1c" + " " * n + "1")
    yield "".join(rng.choice([" ", "\n", "\t", "\u00a0"]) for _ in range(n)) + "end " + " " * n + " x" + "\r\n" * n


def test_byte_bpe_of_long_blanks():
    """Match by match, where the library's own expression still copes and where it does not."""
    enc = byte_bpe.encoding(queries.BYTE_RANKS, public_tokenizers.PATTERN)
    for n in (999, 1000, 1001, 17_000):
        for t in long_blanks(n):
            assert byte_bpe.encode_text(t, queries.BYTE_RANKS, public_tokenizers.PATTERN) == enc.encode_ordinary(t)
    for t in long_blanks(1_100_000):
        got = byte_bpe.encode_text(t, queries.BYTE_RANKS, public_tokenizers.PATTERN)
        assert enc.decode_bytes(got) == t.encode()
    t = "good " + " " * 2_000_000 + "word"
    want = [i for m in MATCHES.finditer(t) for i in enc._encode_single_piece(m.group())]
    assert byte_bpe.encode_text(t, queries.BYTE_RANKS, public_tokenizers.PATTERN) == want


def test_tables_with_long_blanks(spark, tmp_path):
    """One such text fails no table: byte-level BPE, and the word tokenizer's files."""
    rows = [(1, "a good row"), (2, " " * 1_100_000), (3, "x" + "\t\n" * 600_000 + "y"), (4, "\u3000" * 300_000)]
    got = byte_bpe.encode_decode(documents(spark, rows), queries.BYTE_RANKS, public_tokenizers.PATTERN).collect()
    assert {r.doc_id: bytes(r.decoded).decode() for r in got} == dict(rows)
    token_output.write_ids(documents(spark, rows), f"file://{tmp_path}/ids", queries.WORD_BPE, queries.END_ID)
    counts = {r.doc_id: r.n_tokens for r in token_output.checksums(token_output.read_ids(spark, f"file://{tmp_path}/ids")).collect()}
    assert counts[2] == counts[4] == 1 and counts[3] == 3


# --- 4 fingerprints


def canonical(t):
    nfkc = lambda x: unicodedata.normalize("NFKC", x)
    # Unicode white space: Python's also counts the separators 1C to 1F
    return re.sub(r"[^\S\x1c-\x1f]+", " ", nfkc(nfkc(t).casefold())).strip(" ")


def test_fingerprints(spark, corpus):
    docs = documents(spark, corpus)
    prints = fingerprints.fingerprints(docs)
    rows = sorted({(i, t or "") for i, t in corpus}, key=lambda r: (r[0] is not None, r[0] or 0))
    got = {(r.id, r.text): r for r in fingerprints.edited(docs, prints).collect()}
    first = {}
    for i, t in rows:
        if i is not None:
            first.setdefault(canonical(t), i)
    for k, (i, t) in enumerate(rows):
        r, after = got[i, t], rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        assert r.edited == t[: len(t) - q] + after[:q] and r.n_chars == len(t)
        lane = xxhash.xxh64_intdigest(b"second lane", 42)  # the second lane starts from the hash of its name
        assert r.fingerprint == f"{xxhash.xxh64_intdigest(canonical(t).encode(), 42):016x}{xxhash.xxh64_intdigest(canonical(t).encode(), lane):016x}"
        assert (r.fingerprint == r.next_print) == (canonical(t) == canonical(after))
    classes = {r.group_id for r in fingerprints.groups(prints).collect()}
    assert classes == set(first.values()) | {None} or classes == set(first.values())
    assert fingerprints.fingerprints(documents(spark, [])).count() == 0


def test_fingerprint_collisions(spark):
    """Texts that are given one digest are told apart by their bytes."""
    rows = [(1, "a"), (2, "b"), (3, "A"), (4, "c")]
    texts = fingerprints.keyed(documents(spark, rows))
    forged = texts.select("id", "th", F.when(F.col("id") < 4, "same").otherwise("other").alias("digest"))
    odd = fingerprints.collisions(texts, forged)
    assert [r.digest for r in odd.collect()] == ["same"]
    rows = texts.withColumn("canon", fingerprints.canonical(F.col("text"))).join(forged.select("id", "digest"), "id")
    got = {r.id: r.fp for r in fingerprints.told_apart(rows, F.col("canon"), "digest", odd, "fp").collect()}
    assert got[1] == got[3] != got[2] and got[4] == "other" and got[1].startswith("same:")


@pytest.mark.parametrize("ids", [[-(2**62), 7, 2**62 + 5], [0, 5, 9 * 10**18], [*range(10_000), 2**62], [None, 3]], ids=["wide", "one far", "outlier", "null"])
def test_successors_of_any_ids(spark, ids):
    prints = spark.createDataFrame([(i, k, f"p{i}") for k, i in enumerate(ids)], "id long, th long, fingerprint string")
    got = {r.id: r.nid for r in fingerprints.successors(prints).collect()}
    order = sorted(ids, key=lambda i: (i is not None, i or 0))
    assert got == dict(zip(order, order[1:] + order[:1]))


# --- 5 substring dedup


def removed_words(rows, n=13):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - n + 1):
            key, at = tuple(w[k : k + n]), -(2**63) if i is None else i
            first[key] = min(first.get(key, at), at)
    out = []
    for i, t in rows:
        w, gone, at = (t or "").encode().split(), set(), -(2**63) if i is None else i
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < at:
                gone |= set(range(k, k + n))
        out.append(str((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())))
    return sorted(out)


@pytest.mark.parametrize("tile,block", [(4 << 20, 16 << 20), (2_000, 3_000)])
def test_substring_dedup(spark, corpus, monkeypatch, tile, block):
    """The small sizes deal the same documents to many tiles and blocks."""
    for name, x in (("TILE_CHARS", tile), ("BLOCK_CHARS", block)):
        monkeypatch.setattr(substring_dedup, name, x)
    got = substring_dedup.parse(documents(spark, corpus)).collect()
    assert sorted(str((r.id, r.n_words, r.n_removed, r.kept)) for r in got) == removed_words(corpus)
    for r in got:
        covered = set(itertools.chain.from_iterable(range(f.start, f.start + f.length) for f in r.factors))
        assert len(covered) == r.n_removed and all(f.length >= 13 for f in r.factors)
    assert substring_dedup.parse(documents(spark, [])).count() == 0


def thue_morse(n, flip):
    return "".join("ab"[(bin(k).count("1") + flip) % 2] for k in range(n))


@pytest.mark.parametrize("tile", [4 << 20, 500])
def test_substring_dedup_of_texts_built_to_collide(spark, monkeypatch, tile):
    """Complementary Thue-Morse words have equal polynomial hashes modulo 2**64 for every odd base."""
    monkeypatch.setattr(substring_dedup, "TILE_CHARS", tile)
    rest = " ".join(f"w{k}" for k in range(12))
    for n in (1024, 2048):
        rows = [(1, f"{thue_morse(n, 0)} {rest}"), (2, f"{thue_morse(n, 1)} {rest}"), (3, f"x {thue_morse(n, 1)} {rest}")]
        got = {r.id: r.n_removed for r in substring_dedup.parse(documents(spark, rows)).collect()}
        assert got == {1: 0, 2: 0, 3: 13}


def test_equal_hashes_are_compared_by_words(monkeypatch):
    """With hashes that say nothing every window meets every other, and only words decide."""
    monkeypatch.setattr(substring_dedup, "local", lambda codes: np.zeros(max(0, len(codes) - 12), np.uint64))
    shared, other = [f"s{k}" for k in range(20)], [f"o{k}" for k in range(20)]
    block = substring_dedup.Tile(pa.table({"id": [1, 2, 9], "text": [" ".join(other), " ".join(["x", *shared]), " ".join(shared)]}))
    phrase = " ".join(["y", *shared[3:], *other[:15]]).encode()
    found = substring_dedup.factors_in(block, [phrase, phrase, phrase], [9, 2, 1])
    assert found == [[(1, 17, 2), (18, 15, 1)], [(18, 15, 1)], []]


def test_greedy_factors_and_windows_across_their_ends():
    """The first factor takes as many words as agree; the next begins among the windows that cross its end."""
    a, b = [f"a{k}" for k in range(20)], [f"b{k}" for k in range(20)]
    block = substring_dedup.Tile(pa.table({"id": [1, 2, 3], "text": [" ".join(a), " ".join(a[10:] + b), " ".join(b)]}))
    (found,) = substring_dedup.factors_in(block, [" ".join(a + b).encode()], [4])
    assert found == [(0, 20, 1), (10, 30, 2)]
    rng = random.Random(5)
    for _ in range(200):
        docs = [[rng.choice("uv") for _ in range(rng.randrange(60))] for _ in range(4)]
        phrase, limit = [rng.choice("uv") for _ in range(rng.randrange(1, 60))], rng.randrange(1, 6)
        if rng.random() < 0.8:
            phrase[10:10] = docs[0][5:45] + docs[1][:30]
        block = substring_dedup.Tile(pa.table({"id": [1, 2, 3, 4], "text": [" ".join(d) for d in docs]}))
        (found,) = substring_dedup.factors_in(block, [" ".join(phrase).encode()], [limit])
        held = {tuple(d[k : k + 13]) for i, d in enumerate(docs, 1) if i < limit for k in range(len(d) - 12)}
        want = {k for k in range(len(phrase) - 12) if tuple(phrase[k : k + 13]) in held}
        assert {k for at, n, _ in found for k in range(at, at + n - 12)} == want


# --- 6 URL filter


def test_url_parts_and_rules(spark):
    urls = {
        "http://A.Example.COM/en/x?q#f": ("a.example.com", "/en/x", "example.com/en/"),
        "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/"),
        "ftp://b.net/es/1": ("b.net", "/es/1", "net/es/"),
        "http://net/fr/": ("net", "/fr/", "net/fr/"),
        "http://xnet/fr/": ("xnet", "/fr/", None),
        "http://a.com": ("a.com", "", None),
        "http://a.com?x=/y": ("a.com", "", None),
        "x://y://z/p": ("y:", "//z/p", None),
        "no scheme": ("", "", None),
        None: ("", "", None),
        "http:///p": ("", "/p", None),
        "http://ÄB.com/": ("Äb.com", "/", "com/"),
        "http://a.com/\nb?c": ("a.com", "/\nb", "com/"),
    }
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"host": F.lit(1), "rule": F.lit(2), "h": F.lit(3)})
    got = url_filter.judge(pages, spark.createDataFrame([], "host string, bad int"), queries.URL_RULES).collect()
    assert {list(urls)[r.page_id]: (r.host, r.path, r.rule) for r in got} == urls
    assert {r.verdict for r in got if r.rule is None} == {"allow"}


def test_reputation(spark):
    """Few pages are held near their domain, many speak for themselves."""
    rows = [("bad.a.com", 1)] * 60 + [("good.a.com", 0)] * 60 + [("new.a.com", 1)] + [(f"h{i}.b.com", i % 5 == 0) for i in range(100)]
    out = spark.createDataFrame([(h, int(b)) for h, b in rows], "host string, bad int")
    rep = {r.h: r for r in url_filter.reputation(out).collect()}
    mean = lambda r: r.a_h / (r.a_h + r.b_h)
    assert mean(rep["bad.a.com"]) > 0.9 and mean(rep["good.a.com"]) < 0.1
    assert mean(rep["good.a.com"]) < mean(rep["new.a.com"]) < mean(rep["bad.a.com"])
    assert {r.h for r in url_filter.blocked_hosts(out).collect()} == {"bad.a.com"}
    # without the method all would be allowed
    pages = spark.createDataFrame([(1, "http://bad.a.com/"), (2, "http://good.a.com/"), (3, "http://other.org/")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in url_filter.judge(pages, out, []).collect()} == {1: "block", 2: "allow", 3: "allow"}


def test_levels_of_hosts(spark):
    hosts = ["a.b.example.com", "x.shop.co.uk:80", "u@h.net", "10.0.0.1", "localhost", ""]
    df = spark.createDataFrame([(h,) for h in hosts], "host string").select("host", *[c.alias(k) for k, c in url_filter.levels(F.col("host")).items()])
    assert [(r.h, r.d, r.s) for r in df.collect()] == [
        ("a.b.example.com", "example.com", "com"), ("x.shop.co.uk", "shop.co.uk", "co.uk"), ("h.net", "h.net", "net"), ("10.0.0.1", "10.0.0.1", "10.0.0.1"), ("localhost", "localhost", "localhost"), ("", "", "")
    ]


# --- 7 SimHash


def brute_fingerprint(text, size):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))] if words else []
    h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """prints: (id, fingerprint) -> component (least id) of each row."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(prints)), 2):
        if (prints[a][1] ^ prints[b][1]).bit_count() <= 3:
            root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(prints):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [least.get(find(k)) for k in range(len(prints))]


@pytest.mark.parametrize("size", [3, 5])
def test_simhash(spark, corpus, size):
    prints = [(i, brute_fingerprint(t, size)) for i, t in corpus]
    want = sorted(str((i, fp, c)) for (i, fp), c in zip(prints, brute_components(prints)))
    docs = documents(spark, corpus)
    got = simhash.clusters(docs, size).collect()
    assert sorted(str((r.id, r.fp % 2**64, r.component_id)) for r in got) == want
    kept = simhash.one_of_each(docs, size)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    groups = {}
    for (i, _), c in zip(prints, brute_components(prints)):
        groups.setdefault(c, []).append(i)
    assert len(ids) == len(groups)
    assert simhash.clusters(documents(spark, []), 3).count() == 0


def test_one_of_each_keeps_unlinked_texts_that_share_an_id(spark):
    rng = random.Random(12)
    a, b, c, d = (prose(rng, 40) for _ in range(4))
    docs = spark.createDataFrame([(None, a), (None, b), (7, c), (7, d), (8, c)], "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in simhash.one_of_each(docs, 5).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [(None, a), (None, b), (7, c), (7, d)]))


@pytest.mark.parametrize("dense", [0, 4, 256])
def test_multi_index_finds_every_link(spark, dense):
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(150)}
    for p in list(prints)[:40]:
        for _ in range(6):
            for b in rng.sample(range(64), rng.randrange(1, 5)):
                prints.add(p ^ (1 << b))
            prints.add(p ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5))))
    prints = sorted(prints)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    got = {tuple(sorted((r.a % 2**64, r.b % 2**64))) for r in simhash.links(df, dense).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(prints, 2) if (a ^ b).bit_count() <= 3}


def jaccard_groups(rows, size):
    """(id, text) -> number of each row's group, by all pairs."""
    sets, root = [set(simhash.shingle_hashes(t or "", size).tolist()) for _, t in rows], list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if len(sets[a] & sets[b]) >= near_copies.SIMILAR * len(sets[a] | sets[b]):
            root = [root[a] if x == root[b] else x for x in root]
    return root


def test_near_copies(spark, corpus):
    """Near copies of similarity 0.7 to 1, chains of them, and sets that share buckets with several groups."""
    rng, rows = random.Random(13), list(corpus)
    for k in range(8):
        words = prose(rng, 300).split()
        for j in range(10):
            for _ in range(1 if k < 4 else rng.randrange(1, 9)):
                words[rng.randrange(300)] = "new" + str(rng.randrange(10**6))
            rows.append((1000 + 20 * k + j, " ".join(words)))  # each an edit of the one before
    for k in range(3):  # one family of edits, ends cut off and ends put on, around no common text
        words = prose(rng, 150).split()
        for j in range(24):
            own = list(words)
            for _ in range(rng.randrange(1, 8)):
                at = rng.randrange(len(own))
                own[at : at + rng.randrange(3)] = ["new" + str(rng.randrange(10**6))] * rng.randrange(2)
            rows.append((2000 + 30 * k + j, " ".join(own[: rng.choice((150, 150, 125, 118))]) + rng.choice(("", "", " " + prose(rng, 15)))))
    rows += [(None, prose(rng, 40)), (None, prose(rng, 40))]
    docs = documents(spark, rows)
    want = {}
    for (i, t), g in zip(rows, jaccard_groups(rows, 5)):
        want.setdefault(g, set()).add(str((i, t)))
    kept = near_copies.one_of_each(docs, 5)
    assert kept.columns == docs.columns
    kept = [str((r.doc_id, r.text)) for r in kept.collect()]
    assert len(kept) == len(want) and all(len(g.intersection(kept)) == 1 for g in want.values())
    old = simhash.one_of_each(docs, 5).count()
    assert old > len(kept)  # what three bits of 64 leave
    assert near_copies.one_of_each(documents(spark, []), 5).count() == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)] + [(None, 3), (7, 7)]
    root = {x: x for e in edges for x in e if x is not None}
    for _ in range(200):
        for a, b in edges:
            if a is not None and b is not None:
                root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(root[k] == v for k, v in got.items()) and {a for a, b in edges if a is not None and a != b} <= set(got)


# --- 8 WARC


def test_warc(spark):
    pages = [(1, "http://a/", "<p>x</p>"), (2, "http://b/\r\nc", "<p>x</p>"), (3, None, None), (4, "u", ""), (5, "v", "é" * 200_000), (5, "v", "é" * 200_000), (6, "w", "<p>x</p>\r\n\r\nWARC/1.1"), (None, "n", "<p>x</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"id": F.lit(1), "d": F.lit(2), "n": F.lit(3), "owner": F.lit(4)})
    folder = work_folder(spark, "warc-test")
    got = warc.read_archives(warc.write_archives(df, folder), folder).collect()
    want = []
    for i, _, h in pages:
        raw = (h or "").encode()
        owner = max((j for j, _, g in pages if (g or "").encode() == raw and j is not None), default=None)
        again = i is not None and i < owner
        want.append(str((i, len(raw), warc.payload_digest(raw), "revisit" if again else "response", owner if again else None, None if again else raw)))
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload))) for r in got) == sorted(want)
    assert all(r.digest_ok for r in got)
    records = warc.read_archives(warc.write_archives(df, folder + "-2"), folder + "-2")
    assert all(r.digest_ok for r in warc.verified(records).collect())
    lost = records.where("not (page_id = 6 or page_id = 2)")  # 2 is what 1 revisits
    assert {r.page_id for r in warc.verified(lost).where("not digest_ok").collect()} == {1}
    empty = work_folder(spark, "warc-test")
    assert warc.read_archives(warc.write_archives(df.limit(0), empty), empty).count() == 0


def test_warc_reader_finds_damage():
    import io

    record = warc.record_bytes(1, "u", b"abc" * 1000, warc.payload_digest(b"abc" * 1000))
    assert len(list(warc.WarcReader(io.BytesIO(record * 3)))) == 3
    for broken in (record[:-30], record[:40] + b"\x00\x01" + record[42:], b"no archive"):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.WarcReader(io.BytesIO(broken)))


# --- 9 decontamination


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_closest_against_the_matrix():
    rng = random.Random(6)
    for _ in range(60):
        a, t = ("".join(rng.choice("abc") for _ in range(rng.randrange(1, n))) for n in (12, 25))
        best = min(edit_distance(a, t[i:j]) for i in range(len(t) + 1) for j in range(i, len(t) + 1))
        assert decontaminate.closest(a, t)[0] == best


def test_decontamination(spark):
    rng = random.Random(7)
    items = [(k, prose(rng, rng.randrange(8, 40))) for k in range(25)] + [(90, "too short"), (91, None), (92, "")]
    gen = np.random.default_rng(8)
    docs, want = [], set()
    for k, (i, s) in enumerate(items[:25]):
        s = decontaminate.normal(s)
        for j, share in enumerate((0, 0.03, 0.07, 0.1)):
            doc = 10 * k + j
            text = prose(rng, 30) + "\n" + decontaminate.edited(s, int(len(s) * share), gen).upper().replace(" ", "  ") + "\n" + prose(rng, 30)
            docs.append((doc, text))
            want.add((doc, i))
    docs += [(1000 + k, prose(rng, 200)) for k in range(60)] + [(2000, None), (2001, ""), (None, items[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = documents(spark, docs)
    got = decontaminate.leaks(frame, bench).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    by_id = dict(items)
    text = dict(docs)
    for r in got:
        item, body = decontaminate.normal(by_id[r.item_id]), decontaminate.normal(text[r.doc_id])
        assert edit_distance(item, body[r.start : r.start + r.length]) == r.distance <= len(item) // 10
    assert len(found & want) >= 0.98 * len(want)
    assert found <= want | {(None, 0)}  # nothing else: every other document and item is prose of its own
    assert (None, 0) in found
    kept = decontaminate.without_leaks(frame, bench)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in found}
    assert decontaminate.leaks(frame, bench.limit(0)).count() == 0 and decontaminate.without_leaks(frame, bench.limit(0)).count() == len(docs)
    assert decontaminate.leaks(documents(spark, []), bench).count() == 0


def test_long_items_edited_to_the_limit():
    """Lengths at which the tables alone miss many."""
    rng, gen = random.Random(14), np.random.default_rng(15)
    items = [(k, decontaminate.normal(prose(rng, 3 * n))[:n].strip()) for k, n in enumerate([1_000, 1_600, 2_600, 4_000])]
    texts, want = [], []
    for i, s in items:
        for _ in range(5):
            texts.append(decontaminate.normal(prose(rng, 60) + " " + decontaminate.edited(s, len(s) // 10, gen) + " " + prose(rng, 60)))
            want.append(i)
    texts.append(decontaminate.normal(prose(rng, 3000)))
    found = decontaminate.Finder(tuple(items), 0.1, 0.98).find(texts)
    assert [[f[0] for f in x] for x in found] == [[i] for i in want] + [[]]
    for x, text in zip(found[:2], texts):
        (i, start, length, distance), item = x[0], items[x[0][0]][1]
        assert edit_distance(item, text[start : start + length]) == distance <= len(item) // 10


def test_item_ids_of_any_kind(spark):
    rng = random.Random(16)
    items = [(None, prose(rng, 12)), (None, prose(rng, 12)), ("x/7", prose(rng, 12)), ("8", prose(rng, 12))]
    docs = documents(spark, [(k, prose(rng, 5) + " " + s) for k, (_, s) in enumerate(items)] + [(9, prose(rng, 50))])
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = decontaminate.leaks(docs, bench).collect()
    assert sorted((r.doc_id, str(r.item_id)) for r in got) == [(k, str(i)) for k, (i, _) in enumerate(items)]
    assert [r.doc_id for r in decontaminate.without_leaks(docs, bench).collect()] == [9]


def test_items_in_a_script_without_blanks():
    rng = random.Random(17)
    hanzi = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))
    items = [(0, hanzi(20)), (1, hanzi(120)), (2, "two words")]
    texts = [hanzi(50) + s + hanzi(50) for _, s in items]
    found = decontaminate.Finder(tuple(items), 0.1, 0.98).find(texts)
    assert [[f[0] for f in x] for x in found] == [[0], [1], [2]]


def test_short_items(spark):
    """Whole words only, of one to four words; null and empty items are held by nothing."""
    items = [(1, "Erth"), (None, "tion  sea"), (3, "漢字"), (4, "a b c d"), (5, None), (6, " "), (1, "Erth")]
    docs = [(0, "the ERTH."), (1, "merth erths"), (2, "a tion\nSEA b"), (3, "x漢字y"), (4, "a b c d e"), (5, ""), (6, None), (7, "za b c d")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.leaks(documents(spark, docs), bench).collect()
    assert sorted((r.doc_id, str(r.item_id), r.distance) for r in got) == [(0, "1", 0), (0, "1", 0), (2, "None", 0), (3, "3", 0), (4, "4", 0)]
    assert sorted(r.doc_id for r in decontaminate.without_leaks(documents(spark, docs), bench).collect()) == [1, 5, 6, 7]


def plain_words(item, text, most):
    """The least distance of a stretch of whole words, by trying them all."""
    bounds = [(a, b) for a in range(len(text)) for b in range(a + 1, min(len(text), a + len(item) + most) + 1) if decontaminate.whole_word(text, a, b)]
    return min((decontaminate.distance_of(item, text[a:b]) for a, b in bounds), default=99)


def test_items_of_ten_to_nineteen_characters():
    """One edit is allowed from 10 characters on, below 10 none; whole words either way."""
    rng = random.Random(12)
    items = ["quantum entangled", "ninechars", "ten chars!", "a b c d e f", "nineteen characters", "漢字漢字漢字漢字漢字"]
    texts = ["the quantum entangled pair", "the quantum entangeld pair", "a quentum entangled pair", "quantum entangleds", "xquantum entangled", "quantumentangled", "quantum entangled",
             "ninechars", "nine chars", "ten chars", "ten charz!", "x a b c d f f y", "a b d e f", "nineteen charaters", "nineteen xcharacterz", "字漢字漢字漢字漢X漢字漢", ""]
    texts += [decontaminate.normal("so " + decontaminate.edited(rng.choice(items), rng.randrange(3), np.random.default_rng(k)) + " it") for k in range(150)]
    found = decontaminate.Finder(tuple(enumerate(items)), 0.1, 0.98).find(texts)
    for text, rows in zip(texts, found):
        got = {i: distance for i, _, _, distance in rows}
        want = {i: plain_words(s, text, len(s) // 10) for i, s in enumerate(items)}
        assert got == {i: d for i, d in want.items() if d <= len(items[i]) // 10}, text
        assert all(decontaminate.distance_of(items[i], text[a : a + n]) == d for i, a, n, d in rows)


def test_items_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(decontaminate.item_blocks, "__defaults__", (200,))
    rng = random.Random(9)
    items = [(k, prose(rng, 12)) for k in range(8)]
    docs = [(k, prose(rng, 5) + " " + s) for k, s in items]
    got = decontaminate.leaks(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(k, k) for k, _ in items}


# --- 10 token output


def library_ids(text):
    """What the library itself gives, as the file has it."""
    from tokenizers import Tokenizer

    return library_ids.__dict__.setdefault("t", Tokenizer.from_file(queries.WORD_BPE)).encode(text or "", add_special_tokens=False).ids


def test_token_output(spark, corpus):
    rows = [*corpus, (170, "a <|endoftext|> b"), (171, "<|startoftext|>x<|endoftext|>")]
    folder = work_folder(spark, "ids-test")
    token_output.write_ids(documents(spark, rows), folder, queries.WORD_BPE, 2)
    ids = token_output.read_ids(spark, folder)
    got = token_output.offsets(token_output.checksums(ids)).join(ids.select("part", "seq", "ids"), ["part", "seq"]).orderBy("start").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    at = 0
    assert len(got) == len(order)
    for r, (i, text) in zip(got, order):
        want = [*library_ids(text), 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (i, at, len(want), want)
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(want)}I", *want))
        at += len(want)
    assert ids.where("doc_id = 120").count() == 1
    assert [i for r in got if r.doc_id == 170 for i in r.ids] == [320, 49407, 321, 2]
    empty = work_folder(spark, "ids-test")
    token_output.write_ids(documents(spark, []), empty, queries.WORD_BPE, 2)
    assert token_output.offsets(token_output.checksums(token_output.read_ids(spark, empty))).count() == 0


def test_token_files_have_stripes_indexes_and_blooms(spark):
    """A look-up by id reads a small part of the file, and the file's own footer lists a Bloom filter for doc_id."""
    from pyarrow import orc

    rng = random.Random(18)
    docs = spark.createDataFrame([(2 * k, prose(rng, 40)) for k in range(12_000)], "doc_id long, text string").coalesce(1)
    folder = work_folder(spark, "ids-test")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        token_output.write_ids(docs, folder, queries.WORD_BPE, 2)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    ids = token_output.read_ids(spark, folder)
    path = ids.inputFiles()[0].removeprefix("file://").removeprefix("file:")
    f = orc.ORCFile(path)
    assert f.nrows == 12_000 and f.row_index_stride == token_output.ROW_INDEX_STRIDE

    def rows_read(df):
        plan = df._jdf.queryExecution().executedPlan()
        assert df.collect() is not None
        found, todo = [], [plan]
        while todo:
            p = todo.pop()
            if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
                todo.append(p.executedPlan())
            if p.getClass().getSimpleName() == "FileSourceScanExec":
                found.append(p.metrics().apply("numOutputRows").value())
            for k in range(p.children().size()):
                todo.append(p.children().apply(k))
        return sum(found)

    assert rows_read(ids.select("doc_id", "n_tokens")) == 12_000
    assert rows_read(ids.where("doc_id = 5000").select("doc_id", "n_tokens")) <= 2 * token_output.ROW_INDEX_STRIDE
    # an odd id is within the ranges of the row index: the Bloom filter alone can rule its rows out
    assert rows_read(ids.where("doc_id = 5001").select("doc_id", "n_tokens")) < token_output.ROW_INDEX_STRIDE


def test_word_cache_against_the_library(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_output, "CACHE_ENTRIES", 50)
    e, rng = token_output.WordEncoder(queries.WORD_BPE), random.Random(10)
    parts = ["the", "Erth", "É", "ß", "'s", "'", "1", "½", ".", ",", "...", "!!", " ", "  ", "\n", "\t", "\u00a0", "\x1c", "Σ", "İ", "漢", "e\u0301", "<|endoftext|>", "<|", "a.", "b, "]
    for k in range(30):
        few = parts if k % 2 else parts[:16] + parts[23:]
        texts = ["".join(rng.choice(few) for _ in range(60)) for _ in range(10)] + [""]
        got = e.encode_column(pa.array(texts))
        assert [list(struct.unpack(f"<{len(x.as_py()) // 4}I", x.as_py())) for x in got] == [library_ids(x) for x in texts]


# --- the contracts of the queries


def test_digests_of_small_tables(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.op4_fingerprints(spark, SF).collect():
        keys = sorted(rows)
        after = rows[keys[(keys.index(r.doc_id) + 1) % len(keys)]]
        q = len(rows[r.doc_id]) // 4
        edited = rows[r.doc_id][: len(rows[r.doc_id]) - q] + after[:q]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == float(canonical(edited) == canonical(rows[r.doc_id]))
