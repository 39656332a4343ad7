"""Line and substring dedup, chat, mixing, WARC and the pipeline against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from arcwright.llm import bpe, chat, lines, mixture, neardup, quality, simhash, substring, warc

SPACES = " \t\n\x0b\x0c\r"


def edit(rng, text, times):
    chars = list(text)
    for _ in range(times):
        kind, at = rng.randint(0, 2), rng.randint(0, len(chars))
        if kind == 0 or at == len(chars):
            chars.insert(at, rng.choice("abcé "))
        elif kind == 1:
            chars.pop(at)
        else:
            chars[at] = rng.choice("abcé ")
    return "".join(chars)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_verification(spark, edits):
    rng = random.Random(edits)
    rows = [(k, a := "".join(rng.choice("abcé") for _ in range(rng.randint(0, 25))), edit(rng, a, rng.randint(0, 4))) for k in range(250)]
    df = spark.createDataFrame([(k, list(a), list(b)) for k, a, b in rows], "i long, a array<string>, b array<string>")
    got = {r["i"] for r in lines.within_edits(df, "a", "b", edits, edits).collect()}
    assert got == {k for k, a, b in rows if distance(a, b) <= edits}


@pytest.fixture(scope="module")
def line_rows():
    """Lines of 3 to 60 words, each some word edits from its stem; some stems are common."""
    rng = random.Random(5)
    stems = [[rng.choice("abcdefghij") + str(rng.randint(0, 3)) for _ in range(n)] for n in (3, 5, 6, 7, 9, 11, 12, 13, 20, 39, 40, 60) * 2]

    def changed(stem):
        line = list(stem)
        for _ in range(rng.choice([0, 0, 1, 2, 3, 4])):
            at = rng.randrange(len(line) + 1)
            line[at : at + rng.choice([0, 1, 1])] = [rng.choice("xyz")] * rng.choice([0, 1, 1])
        return rng.choice([" ", " ", "  ", "\t"]).join(line)

    rows = [(k, "\n".join(changed(rng.choice(stems[:8] if k % 2 else stems)) for _ in range(rng.randint(0, 7)))) for k in range(60)]
    return rows + [(70, None), (71, ""), (72, " \n\t\n"), (73, "short"), (74, "shore"), (75, rows[0][1]), (75, rows[0][1]), (None, rows[1][1])]


def words_of(line):
    return re.split("[\x20\x09-\x0d]+", line)


def may_differ(a, b):
    n = min(len(words_of(a)), len(words_of(b)))
    return max([t for least, t in lines.CLASSES if n >= least], default=0)


def test_line_classes(spark, line_rows):
    places = [(i, p, x.strip(SPACES)) for i, t in line_rows for p, x in enumerate((t or "").split("\n")) if x.strip(SPACES)]
    distinct = sorted({x for _, _, x in places})
    root = {x: x for x in distinct}
    for a in distinct:
        for b in distinct:
            if a < b and may_differ(a, b) and distance(words_of(a), words_of(b)) <= may_differ(a, b):
                ra, rb = root[a], root[b]
                root = {x: (min(ra, rb) if r in (ra, rb) else r) for x, r in root.items()}
    groups = defaultdict(list)
    for place in places:
        groups[root[place[2]]].append(place)
    want = Counter()
    for members in groups.values():
        first = min(members, key=lambda m: (m[0] is not None, m[0] or 0, m[1]))
        for i, p, x in members:
            want[i, p, x != first[2], (i, p) == first[:2]] += 1
    df = spark.createDataFrame(line_rows, "doc_id long, text string").withColumn("lid", F.lit(1)).withColumn("pos", F.lit(2))
    got = Counter(tuple(r) for r in lines.line_classes(df).select("doc", "pos", "near", "kept").collect())
    assert got == want
    assert len(groups) < 0.7 * len(distinct)


def test_many_copies_around_one_line_make_one_link_each(spark):
    rng = random.Random(1)
    stem = [f"w{k}" for k in range(30)]
    copies = {" ".join([*stem[:k], f"x{rng.randint(0, 999)}", *stem[k + 1 :]]) for k in range(30) for _ in range(6)}
    rows = [(k, " ".join(stem)) for k in range(5)] + [(10 + k, x) for k, x in enumerate(sorted(copies))]
    split = lines._split_lines(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    links, _ = lines.similar_lines(lines._keyed_lines(split))
    assert links.distinct().count() == len(copies)


def test_line_dedup_text(spark):
    line = "a line that is long enough to have copies"
    rows = [(1, f"{line}\n\nmine"), (2, f"x\n{line}s\n\ny"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r[0]: r[1] for r in lines.line_dedup(df).collect()} == {1: f"{line}\n\nmine", 2: "x\n\ny", 3: None}
    assert lines.line_classes(df.limit(0)).count() == 0


def test_line_query_gives_classes_links_and_cleaned_texts(spark, tmp_path, line_rows):
    a, b, c = (" ".join(f"{x}{k}" for k in range(9)) for x in "abc")
    texts = {1: f"{a}\n\nmine", 2: f"{b}\n{a} more", 3: f"x {b[3:]}\n{c}\n{c}", 4: "alone", 5: None, 6: "\n \n"}
    df = spark.createDataFrame([*texts.items(), (None, f"{c}\nno id")], "doc_id long, text string")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = lines.line_query(spark, f"file://{tmp_path}")
    got = {r["doc_id"]: tuple(r)[1:] for r in out.collect()}
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    assert out.columns[1:] == [*lines.REPORT, "text_sha256"]
    assert got == {
        1: (2, 0, 0, 2, 1, 0, digest(f"{a}\n\nmine")),
        2: (2, 0, 1, 1, 1, 1, digest(b)),
        3: (3, 2, 1, 0, 1, 1, digest("")),
        4: (1, 0, 0, 1, 4, 0, digest("alone")),
        5: (0, 0, 0, 0, 5, 0, digest("")),
        6: (0, 0, 0, 0, 6, 0, digest("\n \n")),
        None: (2, 0, 0, 2, None, 0, digest(f"{c}\nno id")),
    }
    df = spark.createDataFrame(line_rows, "doc_id long, text string")
    kept = Counter((r["doc_id"], r["text"]) for r in lines.line_dedup(df).collect())
    assert kept == Counter((r["doc_id"], r["text"]) for r in lines.line_report(df).collect())
    assert lines.line_report(df.limit(0)).count() == 0


def test_no_substring_is_missed(spark, odd, odd_rows, none):
    words = {i: (t or "").lower().split() for i, t, _ in odd_rows if i is not None}
    owner = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 50):
            owner.setdefault(tuple(words[i][k : k + 51]), i)
    rows = {r["doc_id"]: r for r in substring.substring_dedup(odd).collect()}
    assert set(rows) == {i for i, _, _ in odd_rows}
    for i, w in words.items():
        shared = {owner[tuple(w[k : k + 51])] for k in range(len(w) - 50)} - {i}
        assert bool(rows[i]["spans"]) >= bool(shared)
        assert rows[i]["dup_words"] == sum(s["stop"] - s["start"] for s in rows[i]["spans"])
    # 29 holds the passage inside a line, 30 as a line of its own.
    (span,) = rows[30]["spans"]
    assert rows[29]["spans"] == [] and rows[30]["component_id"] == 29 and span["start"] <= 15 and span["stop"] >= 55
    clean = [k for k in range(12) if not rows[k]["spans"]]
    assert clean == list(range(12)) and rows[None]["n_links"] == 0
    assert substring.substring_dedup(none).count() == 0


def test_similar_paragraphs(spark):
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    changed = base[:60] + ["new"] + base[61:]
    other = [f"v{rng.randint(0, 10**6)}" for _ in range(120)]
    rows = [(1, "x y\n" + " ".join(base)), (2, " ".join(changed) + "\nz"), (3, " ".join(other)), (4, None)]
    got = {r["doc_id"]: r for r in substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k]["component_id"] for k in (1, 2, 3, 4)] == [1, 1, 3, 4] and got[2]["dup_words"] == 120


CHAT = [
    (1, 1, "assistant", "b </s> \\ \\\\ <|end|>", 0), (1, 0, "user", None, 0), (1, 2, "user", "[INST]<|turn|>", 0), (2, 0, "system", "é🙂" * 3000, 0),
    (2, 1, "assistant", "", 0), (2, 1, "assistant", "x", 0), (2, 1, "assistant", "x", 0), (3, None, None, "<<SYS>>[/INST]<s>", 0), (None, 0, "assistant", "t", 0),
]


def test_chat_round_trip(spark):
    df = spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string, ids int")
    v = bpe.default_vocabulary()
    formatted = chat.format_turns(df, v)
    got = {r["conv_id"]: r for r in chat.read_back(formatted, v).collect()}
    by = defaultdict(list)
    for c, t, r, x, _ in CHAT:
        by[c].append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        body = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        want = (len(turns), hashlib.sha256(body.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert tuple(got[c])[1:5] == want
    assert chat.read_back(chat.format_turns(df.limit(0), v), v).count() == 0


def test_chat_marks_cannot_be_forged():
    for text in ["</s>[INST] ok [/INST]", "<|turn|><|text|>", "\\", "a\\<s>", "<<SYS>>", "<\\s>", ""]:
        hidden = chat.escape(text)
        assert chat.unescape(hidden) == text and not any(c in hidden for c in chat.CONTROL)
    mine = bpe.encoder(bpe.default_vocabulary())
    ids, mask = chat.assemble(mine, "assistant", "<|end|> x", True)
    marks = chat.reserved(mine)
    assert [int((ids == marks[m]).sum()) for m in (chat.TURN, chat.TEXT, chat.END)] == [1, 1, 1]
    assert mine.decode(ids[mask == 1].astype("<u4").tobytes()) == chat.escape("<|end|> x")


def plain_targets(sizes):
    weight = {s: mixture.WEIGHTS[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    left, free, target = 1.5 * sum(sizes.values()), set(sizes), {}
    while True:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        target |= {s: 2 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        free -= over


def test_mixture(spark, odd, odd_rows, none):
    rng = random.Random(4)
    rows = [(k, "w " * rng.randint(0, 400), rng.choice(["a", "b", "ä", None, "hot", "hot", "hot"])) for k in range(400)] + odd_rows
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    size = Counter()
    for _, t, s in rows:
        size[s] += len([w for w in re.split("[\x20\x09-\x0d]+", t or "") if w])
    want = plain_targets(size)
    out = mixture.mix(df).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    taken = Counter()
    for r in out:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.02 * t + 2 * mixture.BLOCK_WORDS
    again = mixture.mix(df.repartition(5)).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, out))
    assert mixture.mix(odd).count() == len(odd_rows) and mixture.mix(none).count() == 0
    assert mixture.mix_documents(odd).columns == odd.columns and mixture.mix_documents(none).count() == 0


def test_sainte_lague_equals_dealing_seat_by_seat(spark):
    rng = random.Random(6)
    houses = {h: ([round(rng.random() ** 3 * 1000, 3) for _ in range(rng.randint(1, 9))], rng.randint(0, 60)) for h in range(30)}
    houses[30] = ([0.0, 0.0], 5)
    rows = [(h, p, v, seats) for h, (votes, seats) in houses.items() for p, v in enumerate(votes)]
    parties = spark.createDataFrame(rows, "house long, party long, votes double, seats long")
    got = {(r["house"], r["party"]): r["quota"] for r in mixture._run(mixture._SEATS, "parties", parties).collect()}
    for h, (votes, seats) in houses.items():
        dealt = [0] * len(votes)
        for _ in range(seats if any(votes) else 0):
            best = max(range(len(votes)), key=lambda p: (votes[p] / (2 * dealt[p] + 1), -p))
            dealt[best] += 1
        assert [got[h, p] for p in range(len(votes))] == dealt


PAGES = [
    (1, "http://a/1", "x" * 2000), (2, "http://a/\r\n2", "x" * 2000), (3, None, "x" * 2000), (3, None, "x" * 2000), (4, "u", "y" * 999), (5, "u", "y" * 999),
    (6, "u", None), (7, "u", ""), (8, "u", "é" * 500), (9, "u", "é" * 500), (None, "u", "x" * 2000), (10, "u", "WARC/1.1\r\n\r\n" * 200), (11, "u", "z" * 200_000),
]


def test_warc(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    records = warc.read_archive(spark, warc.write_archive(df, f"file://{tmp_path}/a"))
    want = Counter()
    for i, _, html in PAGES:
        raw = (html or "").encode()
        owner = max(j for j, _, h in PAGES if (h or "") == (html or "") and j is not None)
        revisit = len(raw) >= 1000 and i != owner
        want[i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", owner if revisit else None] += 1
    rows = records.collect()
    assert Counter(tuple(r)[:5] for r in rows) == want
    assert len({r["record_id"] for r in rows}) == len(rows)
    for r in rows:
        refers = re.search(rb"WARC-Refers-To: (<[^>]*>)", bytes(r["record"]))
        if refers:
            (target,) = [o for o in rows if o["record_id"] == refers[1].decode()]
            assert (target["record_type"], target["payload"], target["page_id"]) == ("response", r["payload"], r["refers_to"])
    assert spark.read.parquet(f"file://{tmp_path}/a/payloads").count() == len({(h or "") for _, _, h in PAGES})
    for r in rows:
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        length = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert head.startswith(b"WARC/1.1\r\n") and rest[length:] == b"\r\n\r\n"
        body = rest[:length].partition(b"\r\n\r\n")[2]
        assert body == (bytes(r["payload"]) if r["record_type"] == "response" else b"")
    warc.export_warc(records, f"file://{tmp_path}/files")
    read = warc.read_warc(spark, f"file://{tmp_path}/files").collect()
    assert Counter(bytes(r["header"]) + bytes(r["block"]) + b"\r\n\r\n" for r in read) == Counter(bytes(r["record"]) for r in rows)
    empty = warc.write_archive(df.limit(0), f"file://{tmp_path}/none")
    assert warc.read_archive(spark, empty).count() == 0


def test_changed_payload_is_noticed(spark, tmp_path):
    path = warc.write_archive(spark.createDataFrame(PAGES[:1], "page_id long, url string, html string"), f"file://{tmp_path}/a")
    stored = spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit(b"other")).collect()
    spark.createDataFrame(stored, "digest string, payload binary").write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="does not have its digest"):
        warc.read_archive(spark, path).collect()


def test_changed_header_is_noticed(spark, tmp_path):
    path = warc.write_archive(spark.createDataFrame(PAGES[:3], "page_id long, url string, html string"), f"file://{tmp_path}/a")
    for change in ("'sha1:.', 'sha1:g'", "'Content-Length: (\\\\d+)', 'Content-Length: 1$1'"):
        headers = spark.read.parquet(f"{path}/headers")
        bad = headers.withColumn("header", F.expr(f"cast(regexp_replace(cast(header as string), {change}) as binary)")).collect()
        spark.createDataFrame(bad, headers.schema).write.mode("overwrite").parquet(f"{tmp_path}/b/headers")
        spark.read.parquet(f"{path}/payloads").write.mode("overwrite").parquet(f"{tmp_path}/b/payloads")
        with pytest.raises(Exception, match="is not what its header declares"):
            warc.read_archive(spark, f"file://{tmp_path}/b").collect()


def test_near_stage_against_brute_force(spark):
    """Edited copies at similarities around 0.8: nearly all true groups are found, and nothing else goes."""
    rng = random.Random(5)
    rows = []
    for k in range(80):
        base = [f"w{rng.randint(0, 9999)}" for _ in range(rng.choice([20, 60, 150, 400]))]
        rows.append((k, "\n".join(" ".join(base[i : i + 9]) for i in range(0, len(base), 9))))
        for copy in range(2):
            other = list(base)
            for _ in range(rng.randint(1, max(1, len(base) // 40))):
                other[rng.randrange(len(other))] = f"x{rng.randint(0, 9999)}"
            rows.append((1000 + 2 * k + copy, " ".join(other)))
    rows += [(5000, "two words"), (5001, "Two  WORDS"), (5002, "two"), (5003, ""), (5004, None)]

    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = {i: shingles(t) for i, t in rows}
    owner = {i: i for i in sets}

    def top(i):
        return i if owner[i] == i else top(owner[i])

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                owner[y] = x
    gone = {i for i in sets if top(i) != i}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = {r["doc_id"] for r in corpus_pipeline.near_stage(spark, docs, "").collect()}
    found = set(sets) - kept
    assert len(gone) > 60 and {5001, 5004} <= found
    assert found <= gone and len(found) >= 0.98 * len(gone)


def test_near_candidates_come_from_simhash(monkeypatch):
    """Fingerprints are plain SimHash; of sets at Jaccard 0.8 nearly all meet, strangers never do."""
    rng = np.random.default_rng(8)

    def draw(n):
        return rng.integers(0, 1 << 63, n, dtype=np.uint64)

    pairs = []
    for k in range(300):
        n = (18, 63, 900)[k % 3]  # divisible by 9: 8 of 9 in common are 0.8
        common = draw(n * 8 // 9)
        pairs += [np.concatenate([common, draw(n // 9)]), np.concatenate([common, draw(n // 9)])]
    prints = neardup.fingerprints(pairs)
    for x, got in zip(pairs[:6], prints, strict=False):
        for w in range(neardup.WORDS):
            votes = [int(v) for v in neardup._mix(x * neardup._VOTES[0, w] + neardup._VOTES[1, w])]
            assert int(got[w]) == sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in votes) > len(votes))
    columns = [pa.array(np.full(600, -1)), pa.array(np.arange(600)), pa.array(list(prints.view(np.int64)), pa.list_(pa.int64()))]
    dealt = pa.Table.from_batches(neardup._buckets([pa.RecordBatch.from_arrays(columns, ["rare", "key", "bands"])]))
    dealt = dealt.sort_by([("band", "ascending"), ("key", "ascending")])
    found = []
    for many in (256, 1):
        monkeypatch.setattr(neardup, "MANY", many)
        rows = [r for b in neardup._meetings(dealt.to_batches(max_chunksize=7)) for r in b.to_pylist()]
        found.append({(r["key"], r["centre"]) for r in rows if r["key"] != r["centre"]})
    assert found[0] == found[1] and all(a == b + 1 and b % 2 == 0 for a, b in found[0])
    assert len(found[0]) >= 290


def test_pipeline_stages(spark, odd_rows):
    rng = random.Random(2)
    good = lambda: " ".join(f"the w{rng.randint(0, 9999)} of" for _ in range(60))
    texts = [good() for _ in range(30)]
    rows = [(k, t, "en", f"s{k % 2}", len(t)) for k, t in enumerate(texts)]
    rows += [(100, texts[0], "en", "s0", 1), (101, texts[1].replace(" ", " \t"), "en", "s1", 1), (102, "junk", "en", "s0", 4), (103, None, None, None, None)]
    rows += [(200 + k, t, "en", s, None) for k, (_, t, s) in enumerate(odd_rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.quality_stage(spark, docs, "")
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert set(range(30)) | {100, 101} <= ids and not {102, 103} & ids
    kept = corpus_pipeline.exact_stage(spark, kept, "")
    ids = {r["doc_id"] for r in kept.collect()}
    assert set(range(30)) <= ids and not {100, 101} & ids and kept.columns == docs.columns
    near = corpus_pipeline.near_stage(spark, kept, "")
    assert near.columns == docs.columns and set(range(30)) <= {r["doc_id"] for r in near.collect()}
    mixed = corpus_pipeline.mixing_stage(spark, near, "")
    assert mixed.columns == docs.columns and mixed.count() > 0
    last = corpus_pipeline.bpe_stage(spark, mixed, "")
    assert last.count() == mixed.count()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "exact dedup", "simhash near-dedup", "source mixing", "bpe"]
    nothing = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, nothing, "")
        assert nothing.count() == 0


def test_native_plans_have_no_python(spark, odd):
    plans = [quality.score_quality(odd), mixture.mix(odd), lines.line_classes(odd)]
    for df in plans:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
    assert "Arrow" in simhash.simhash_dedup(odd)._jdf.queryExecution().executedPlan().toString()


def test_paragraph_classes_equal_all_pairs(spark):
    rng = random.Random(12)
    texts = []
    for _ in range(3):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(110)]
        texts += [" ".join(base)] * 3
        for _ in range(25):
            words = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                words[rng.randrange(len(words))] = f"n{rng.randint(0, 10**6)}"
            texts.append(" ".join(words))
    sets = [frozenset(zip(*(t.split()[k:] for k in range(5)), strict=False)) for t in texts]
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((group[a], group[b]))
                group = [x if g == y else g for g in group]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = df.select(F.col("text").cast("binary").alias("_t"), F.col("doc_id").alias("_i"))
    units = rows.mapInArrow(substring._find_units, substring._UNITS)
    pairs = {tuple(r) for r in substring._similar_lines(units, rows).collect()}
    key = {r["doc"]: r["key"] for r in units.filter("kind = 1").collect()}
    root = {k: k for k in key.values()}
    for a, b in pairs:
        x, y = root[a], root[b]
        root = {k: (x if r == y else r) for k, r in root.items()}
    mine = [root[key[k]] for k in range(len(texts))]
    same = [(group[a] == group[b], mine[a] == mine[b]) for a in range(len(texts)) for b in range(a)]
    assert not any(found and not true for true, found in same)
    assert sum(true and found for true, found in same) >= 0.97 * sum(true for true, _ in same)
