"""Quality rules, exact dedup, SimHash, BPE and the language model against plain Python."""

import hashlib
import math
import random
import re
import sys
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from arcwright.llm import bpe, exact_dedup, lines, lm, mixture, neardup, quality, simhash
from arcwright.llm import trie as trie_module
from arcwright.llm.trie import PatriciaOwners

WS = "[\x20\x09-\x0d]+"


def words(text):
    return [w for w in re.split(WS, text or "") if w]


def normal(text):
    return re.sub(WS, " ", text or "")


def test_quality_counts(odd, odd_rows, none):
    got = Counter(
        (r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
        for r in quality.score_quality(odd).collect()
    )
    want = Counter()
    for i, text, _ in odd_rows:
        w, t = words(text), text or ""
        windows = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k + d for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if words(x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed] += 1
    assert got == want
    assert quality.score_quality(none).count() == 0


def test_quality_verdicts_follow_the_table(spark):
    good = " ".join(f"the word{k} of" for k in range(40))
    bad = {1: good, 2: " ".join(f"word{k}" for k in range(90)), 3: good + " ###" * 70, 4: " ".join(f"the {'x' * 60}{k}" for k in range(60))}
    df = spark.createDataFrame(list(bad.items()), "doc_id long, text string")
    scored = quality.score_quality(df)
    assert {r["doc_id"]: r["kept"] for r in scored.filter("kept OR NOT kept").collect()} == {1: True, 2: False, 3: False, 4: False}


def test_exact_dedup(odd, odd_rows, none):
    groups = {}
    for i, text, _ in odd_rows:
        groups.setdefault(normal(text), []).append(i)
    want = Counter()
    for i, text, _ in odd_rows:
        ids = groups[normal(text)]
        keep = min((x for x in ids if x is not None), default=None)
        want[i, keep, len(ids), i == keep, hashlib.sha256(normal(text).encode()).hexdigest()] += 1
    out = exact_dedup.exact_dedup(odd)
    assert Counter(tuple(r) for r in out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()) == want
    assert exact_dedup.exact_dedup(none).count() == 0


def test_repeated_windows_with_one_hash(spark, monkeypatch):
    """With every hash equal, windows are told apart by their words alone; the order by position puts others between."""
    rng = np.random.default_rng(5)
    texts = ["p q r x y z p q r", "a b c a b d a b c", *(" ".join(rng.choice(list("abc"), rng.integers(3, 40))) for _ in range(40))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = {}
    for i, text in enumerate(texts):
        w = text.split()
        windows = Counter(zip(w, w[1:], w[2:], strict=False))
        plain[i] = len({k + d for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for d in range(3)})
    assert {r["doc_id"]: r["n_repeat_words"] for r in quality.score_quality(docs).collect()} == plain
    monkeypatch.setattr(quality, "_window_hash", lambda *three: F.lit(7).cast("long"))
    assert {r["doc_id"]: r["n_repeat_words"] for r in quality.score_quality(docs).collect()} == plain


def test_clashing_names(odd):
    """Columns called as operators' own helpers keep their values."""
    names = ["_text", "_words", "_id", "_digest", "_whole", "whole", "_t", "_i", "_key", "_shard", "_quota", "_in0", "doc", "pos", "node", "a", "Kept"]
    docs = odd.select("doc_id", "text", "source", *[F.lit(f"mine {name}").alias(name) for name in names])
    results = {
        "exact": exact_dedup.exact_dedup(docs), "quality": quality.score_quality(docs), "simhash": simhash.simhash_dedup(docs),
        "bpe": bpe.bpe_encode(docs, bpe.default_vocabulary()), "mix": mixture.mix(docs), "mixed": mixture.mix_documents(docs),
        "near": neardup.near_dedup(docs), "lines": lines.line_dedup(docs),
    }
    for operator, out in results.items():
        rows = out.collect()
        assert len(rows) >= 10, operator
        for name in names:
            if name != "Kept" or operator not in ("exact", "quality"):
                assert {r[name] for r in rows} == {f"mine {name}"}, (operator, name)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=6), st.integers(0, 50)), max_size=60), st.sampled_from([1, 900, 1 << 40]))
def test_trie_owners(rows, budget):
    trie = PatriciaOwners(budget)
    want = {}
    for key, i in rows:
        trie.insert(key, i, 1, key)
        low, n = want.get(key, (i, 0))
        want[key] = (min(low, i), n + 1)
    assert {key: (i, n) for i, n, key in trie.owners()} == want
    assert budget > 1 or not rows or trie.spilled or all(not k for k, _ in rows)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 9)), min_size=1, max_size=80), st.integers(1, 60_000))
def test_trie_spills_keys_with_a_long_shared_prefix(rows, budget):
    """Whatever the prefix, a key is written by its subtree and once more when the file is dealt."""
    head, written = b"h" * 6000, Counter()
    trie = PatriciaOwners(budget)
    want = {}
    add = trie_module._Spill.add

    def counting(self, key, *rest):
        written[key] += 1
        add(self, key, *rest)

    trie_module._Spill.add = counting
    try:
        for tail, i in rows:
            key = head + b"t" * tail  # each key is a prefix of the longer ones
            trie.insert(key, i, 1, key)
            low, n = want.get(key, (i, 0))
            want[key] = (min(low, i), n + 1)
        assert {key: (i, n) for i, n, key in trie.owners()} == want
    finally:
        trie_module._Spill.add = add
    assert all(times <= 2 * want[key][1] for key, times in written.items())


def plain_fingerprint(text, width):
    w = [x.encode() for x in words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    if not w:
        return 0
    shingles = [b" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(odd_rows):
    for _, text, _ in odd_rows:
        for width in (4, 5):
            assert simhash.fingerprint((text or "").encode(), width) == plain_fingerprint(text, width)


def closure(fps, bits):
    """Component of each fingerprint by breadth-first search over all pairs."""
    left, out = set(fps), {}
    while left:
        seed = left.pop()
        front, group = [seed], {seed}
        while front:
            x = front.pop()
            near = {y for y in left if (x ^ y).bit_count() <= bits}
            left -= near
            group |= near
            front += near
        for x in group:
            out[x] = frozenset(group)
    return out


def test_simhash_components(odd, odd_rows, none):
    fps = [plain_fingerprint(t, 4) for _, t, _ in odd_rows]
    groups = closure(fps, 4)
    want = Counter()
    for (i, _, _), fp in zip(odd_rows, fps, strict=True):
        ids = [j for (j, _, _), other in zip(odd_rows, fps, strict=True) if other in groups[fp] and j is not None]
        want[i, f"{fp:016x}", min(ids, default=None)] += 1
    for out in (simhash.simhash_components(odd), simhash.simhash_dedup(odd)):
        assert Counter(tuple(r) for r in out.select("doc_id", "fingerprint", "component_id").collect()) == want
    assert simhash.simhash_components(none).count() == 0


@pytest.mark.parametrize("bits", [3, 4, 6])
def test_pigeonring_loses_no_link(spark, bits, monkeypatch):
    monkeypatch.setattr(simhash, "REFINE_ABOVE", 20)
    rng = np.random.default_rng(bits)
    fps = {0, (1 << 64) - 1}
    for seed in rng.integers(0, 1 << 63, 12).tolist():
        for _ in range(12):
            fps.add(seed)
            seed ^= sum(1 << int(b) for b in rng.choice(64, rng.integers(1, bits + 2), replace=False))
    rows = [(k, fp - (1 << 64) if fp >> 63 else fp) for k, fp in enumerate(sorted(fps))]
    number = {fp: k for k, fp in enumerate(sorted(fps))}
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, _fp long"), max_bits=bits)
    got = {r["_fp"] % (1 << 64): r["component_id"] for r in out.collect()}
    assert got == {fp: min(number[x] for x in group) for fp, group in closure(fps, bits).items()}


def test_simhash_null_bridge_and_repeated_id(spark):
    """Fingerprints 0, 15, 255: the middle one's ids are all null. Id 7 is on 1 << 40 and 1 << 50 | 255 << 50."""
    rows = [(1, 0), (None, 15), (2, 255), (7, 1 << 40), (7, 1023 << 52), (None, 1023 << 40)]
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, _fp long"))
    got = {r["_fp"]: r["component_id"] for r in out.collect()}
    assert got == {0: 1, 15: 1, 255: 1, 1 << 40: 1, 1023 << 52: 7, 1023 << 40: None}


def test_large_bucket_is_refined(monkeypatch):
    monkeypatch.setattr(simhash, "REFINE_ABOVE", 50)
    rng = np.random.default_rng(1)
    start, mask = simhash.index_keys(4)[0]
    fps = np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64) & np.uint64(~mask & (1 << 64) - 1))
    fps = np.unique(np.concatenate([fps, fps[:200] ^ np.uint64(1 << 60)]))
    chain = simhash._chains(4)[start]
    number = {int(fp): k for k, fp in enumerate(fps)}
    links, whole = (
        [(number[int(a)], number[int(b)]) for a, b in found]
        for found in (simhash._spanning(fps, chain), simhash._forest(fps, chain))
    )

    def parts(edges):
        root = list(range(len(fps)))
        for _ in range(len(fps)):
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert parts(links) == parts(whole)


@pytest.fixture(scope="module")
def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(bpe.default_vocabulary())


def test_bpe_table(odd, odd_rows, none, tokenizer):
    out = bpe.bpe_encode(odd, bpe.default_vocabulary())
    want = Counter()
    for i, text, _ in odd_rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        back = tokenizer.decode(ids, skip_special_tokens=False)
        packed = np.array(ids, "<u4").tobytes()
        want[i, tuple(ids), len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
    rows = out.select("doc_id", "token_ids", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert Counter((r[0], tuple(r[1]), *r[2:]) for r in rows) == want
    assert bpe.bpe_encode(none, bpe.default_vocabulary()).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abethin \n\t\x1c\x85\xa0é中🙂19'sre!.<|Z²\x00"), max_size=40))
def test_bpe_equals_the_library(tokenizer, text):
    mine = bpe.encoder(bpe.default_vocabulary())
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(mine.encode(text), "<u4").tolist() == ids
    assert mine.decode(mine.encode(text)) == tokenizer.decode(ids, skip_special_tokens=False)


def test_bpe_long_words(tokenizer):
    """Words above and below the length that a trie takes give the library's ids, in time that grows with the length."""
    mine = bpe.TrieEncoder(bpe.default_vocabulary())
    for text in ("ab" * 40_000, "x" * 257, "\xe9t\xe9" * 300, " " * 5000, "7" * 3000, "the" * 85 + " " + "the" * 86):
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == ids
    took = []
    for n in (100_000, 400_000):
        began = time.process_time()
        mine.encode("abcd" * (n // 4))
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0]


def test_bpe_tables_start_anew(tokenizer, monkeypatch, odd_rows):
    monkeypatch.setattr(bpe, "KEEP_WORDS", 5)
    monkeypatch.setattr(bpe, "KEEP_PAIRS", 50)
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 300)
    monkeypatch.setattr(bpe, "TRIE_BYTES", 64)
    texts = [(t or "")[:2000] for _, t, _ in odd_rows] * 2
    mine = bpe.TrieEncoder(bpe.default_vocabulary())
    got = [np.frombuffer(p, "<u4").tolist() for p in mine.encode_many(texts)]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_bpe_tables_are_bounded_in_bytes(tokenizer, monkeypatch):
    """Words of any length take no more than the bound, one block of texts aside, and frequent ones stay."""
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 20_000)
    monkeypatch.setattr(bpe, "KEEP_BYTES", 200_000, raising=False)
    rng = random.Random(5)
    texts = [" often " + " ".join("".join(rng.choices("abcdeé", k=rng.choice((9, 200, 2000)))) for _ in range(20)) for _ in range(200)]
    mine, most = bpe.TrieEncoder(bpe.default_vocabulary()), 0
    for text, packed in zip(texts, mine.encode_many(texts), strict=True):
        assert np.frombuffer(packed, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        held = [x for table in (mine._words, getattr(mine, "_before", {})) for pair in table.items() for x in pair]
        most = max(most, sum(map(sys.getsizeof, held)))
    assert most < 500_000 and " often" in mine._words


def test_bpe_takes_batches_in_parts(monkeypatch):
    """Texts of a batch are taken up to BLOCK_CHARS bytes at a time, each row once and in order."""
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 100)
    sizes = [0, 0, 60, 40, 1, 99, 1, 500, 0, 30, 101, 7, 0]
    for kind in (pa.string(), pa.large_string()):
        whole = pa.RecordBatch.from_arrays([pa.array(range(len(sizes))), pa.array(["x" * n for n in sizes], kind)], ["id", "whole"])
        parts = list(bpe.parts([whole.slice(0, 0), whole, whole.slice(2, 5)]))
        assert pa.Table.from_batches(parts) == pa.Table.from_batches([whole, whole.slice(2, 5)])
        taken = [[len(t) for t in part.column(1).to_pylist()] for part in parts]
        assert all(sum(part) <= 100 or len(part) == 1 for part in taken)
        assert taken[:3] == [[0, 0, 60, 40], [1, 99], [1]]


def test_lm_holds_rare_bigrams_of_a_large_corpus(spark):
    """Seen once among more than 2**24 training tokens, a bigram still scores above its words alone."""
    held = [k for k in range(0, 4096 * 60, 4096) if zlib.crc32(str(k).encode()) % 5 == 1][0]
    ids = [k for k in range(0, 4096 * 60, 4096) if zlib.crc32(str(k).encode()) % 5 != 1][:20]
    big = spark.createDataFrame([(k,) for k in ids[2:]], "doc_id long").repartition(8).selectExpr("doc_id", "repeat('a ', 1000000) AS text")
    texts = [(ids[0], "p q r s t"), (ids[1], "f g h i j k f g h i j k"), (held, "p q r s t")]
    rare = spark.createDataFrame(texts, "doc_id long, text string")
    rows = {r["doc_id"]: r for r in lm.lm_scores(big.union(rare)).collect()}
    assert rows[held]["held_out"] and rows[held]["train_tokens"] > 1 << 24
    assert rows[held]["score"] > rows[held]["base_score"] + 5


def test_lm_base(odd, odd_rows, none):
    tokens = [[w.encode() for w in words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))] + [b""] for _, t, _ in odd_rows]
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1 for i, _, _ in odd_rows]
    c = Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    n, v = sum(c.values()), len(c)
    rows = {r["doc_id"]: r for r in lm.lm_scores(odd).collect() if r["doc_id"] not in (None, 32)}
    assert len(rows) == len(odd_rows) - 4
    for (i, _, _), t, h in zip(odd_rows, tokens, held, strict=True):
        if i in rows:
            r = rows[i]
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (h, len(t), sum(c[w] > 0 for w in t), n)
            assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel=1e-9)
            assert r["score"] <= 0
    # A copy of a training text is likelier than its words alone.
    assert rows[20]["score"] > rows[20]["base_score"]
    assert lm.lm_scores(none).count() == 0


def plain_bigram_scores(tokens, held):
    """Quantised counts, absolute discounting and add-half unigrams, by dictionaries."""
    one = Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    two = Counter(p for t, h in zip(tokens, held, strict=True) if not h for p in zip([b"", *t], t, strict=False))
    n, v = sum(one.values()), len(one)
    once, twice = (sum(x == k for x in two.values()) for k in (1, 2))
    discount = once / (once + 2 * twice) if once + twice else 0.5
    steps = sorted({(2 + k % 2) * 2 ** (k // 2) // 2 for k in range(60)} | {1})
    entered = {p: max(x for x in steps if x <= c) for p, c in two.items()}
    used = Counter()
    for (a, _), c in entered.items():
        used[a] += c - discount

    def probability(a, b):
        p1 = (one[b] + 0.5) / (n + 0.5 * (v + 1))
        if not one[a]:
            return p1
        return max(entered.get((a, b), 0) - discount, 0) / one[a] + min(max(1 - used[a] / one[a], 1e-3), 1) * p1

    return [sum(math.log10(min(probability(a, b), 1)) for a, b in zip([b"", *t], t, strict=False)) for t in tokens], one, probability


def test_lm_score_equals_a_plain_bigram_model(odd, odd_rows):
    tokens = [[w.encode() for w in words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))] + [b""] for _, t, _ in odd_rows]
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1 for i, _, _ in odd_rows]
    want, one, probability = plain_bigram_scores(tokens, held)
    got = {r["doc_id"]: r["score"] for r in lm.lm_scores(odd).collect()}
    off = []
    for (i, _, _), score, t in zip(odd_rows, want, tokens, strict=True):
        if i is not None:
            off.append(abs(got[i] - score) / len(t))
    # A false positive of the filter may raise a count; it is rare, and raises few.
    assert sum(x > 1e-9 for x in off) <= len(off) // 4 and max(off) < 0.05
    # Over all words and the unknown one, the probabilities after a context sum to one.
    for a in [b"", *list(one)[:20]]:
        assert sum(probability(a, b) for b in [*one, b"\xff"]) == pytest.approx(1, abs=1e-3)


def test_lm_does_not_depend_on_the_chunks(odd, monkeypatch):
    whole = {tuple(r)[:6] for r in lm.lm_scores(odd).collect()}
    import pyarrow as pa

    monkeypatch.setattr(lm, "CHUNK_BYTES", 700)
    monkeypatch.setattr(lm, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": staticmethod(lambda: 3)}))}))
    rows = odd.selectExpr("cast(coalesce(text, '') as binary) t", "false h", "doc_id").toArrow()
    chunks = pa.Table.from_batches(list(lm._chunks(rows.to_batches())))
    assert chunks.num_rows > 10 and len(set(chunks["chunk"].to_pylist())) == chunks.num_rows
    for words_, stream, marks in zip(*(chunks[c].to_pylist() for c in ("words", "stream", "marks")), strict=True):
        chunk = lm.Chunk.of(words_, stream)
        keys, at, some, cuts = chunk.pairs(5)
        assert (keys[at] == lm._bigram_keys(chunk.h, chunk.stream[:-1], chunk.stream[1:])).all()
        assert (np.repeat(some, np.diff(cuts)) == lm._segment(keys, 5)).all()
        assert lm._unpack(marks, np.int64).reshape(-1, 4)[:, 3].sum() == len(chunk.stream) - 1
    assert len(whole) >= 25


def test_filter_counts_and_false_positives():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64))
    counts = rng.geometric(0.4, len(keys))
    bloom = lm.Filter(keys, counts)
    quantised = np.searchsorted(lm.LEVELS, counts, side="right")
    got = bloom.level(keys)
    assert (got >= quantised).all() and (got != quantised).mean() < 0.01
    strangers = rng.integers(1 << 63, (1 << 64) - 1, 20_000, dtype=np.uint64)
    assert (bloom.level(strangers) > 0).mean() < 0.01
    assert (lm.Filter(keys[:0], counts[:0]).level(keys) == 0).all()


def test_levels_rise():
    assert lm.LEVELS[:7].tolist() == [1, 2, 3, 4, 6, 8, 12] and len(lm.LEVELS) < 256
    assert np.diff(lm.LEVELS).min() > 0
