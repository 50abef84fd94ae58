import hashlib
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest

from pointloom.llm import decontaminate, huffman, langid, neardup, packing, sharding, suffixes, textkit, tokens, topk, toxicity, urls, work

DOCS = "doc_id long, text string, lang string, depth int, host string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, 7, "clash") for i, t in rows], DOCS)


def words(n, seed):
    r = random.Random(seed)
    return ["".join(r.choices("abcdefghij", k=5)) for _ in range(n)]


ODD = [(1, None), (2, ""), (3, "  \n"), (4, "one"), (4, "one"), (None, "no id here"), (5, "x " * 20000), (6, "É l'été 3.5!")]


# near-duplicates


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    low = {k: min(rows[i][0] for i in range(len(rows)) if label[i] == k) for k in set(label)}
    return [(rows[i][0], len(sets[i]), low[label[i]]) for i in range(len(rows))]


def near_copies():
    rows, r, n = [], random.Random(5), 0
    for g in range(12):
        base = words(60 + 20 * g, g)
        for _ in range(r.randint(1, 8)):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = "zz" + str(r.random())
            rows.append((100 + n, " ".join(w)))
            n += 1
    return rows + [(1, ""), (2, "a b"), (3, "A  b"), (50, rows[0][1])]


def test_near_duplicates(spark):
    rows = near_copies()
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(frame(spark, rows)).collect()}
    assert got == set(brute_components(rows))


@pytest.mark.parametrize("node,weight", [(4, 1 << 20), (128, 300), (4, 300)])
def test_near_duplicates_large_nodes_and_clusters(spark, monkeypatch, node, weight):
    monkeypatch.setattr(neardup, "NODE", node)
    monkeypatch.setattr(neardup, "WEIGHT", weight)
    rows = near_copies()
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(frame(spark, rows)).collect()}
    assert got == set(brute_components(rows))


def test_near_duplicates_odd(spark):
    got = neardup.near_duplicates(frame(spark, ODD)).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert by[1].component_id == 1 and by[2].component_id == 2 and by[4].kept and not by[None].kept and by[5].n_shingles == 1
    assert neardup.near_duplicates(frame(spark, [])).count() == 0


def test_deduplicated_rows(spark):
    """Copies under null and repeated ids go too; columns may have any name."""
    t, u = " ".join(words(40, 1)), " ".join(words(40, 2))
    rows = [(None, t), (None, t), (1, t), (2, t), (2, u), (2, u), (None, u.upper()), (None, " ".join(words(30, 3))), (7, ""), (7, ""), (None, None), (8, "a b"), (9, "A  b")]
    df = spark.createDataFrame([(i, x, 3, "y", "z") for i, x in rows], "doc_id long, text string, version int, `a.b` string, __key string")
    got = neardup.deduplicated(df)
    assert got.columns == df.columns
    want = [(1, t), (2, u), (None, " ".join(words(30, 3))), (7, ""), (7, ""), (None, None), (8, "a b")]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)
    assert neardup.deduplicated(df.limit(0)).count() == 0


def test_recall_of_large_nodes_at_every_depth():
    """Pairs of similarity 0.75 still share a node after all rounds of branching of large nodes (over 0.9999, here 1000 pairs)."""
    import pyarrow as pa

    r, n, lost = np.random.default_rng(5), neardup.COORDINATES, 0
    for _ in range(1000):
        x = r.integers(0, 256, n, dtype=np.uint8)
        y = np.where(r.random(n) < 0.75, x, r.integers(0, 256, n, dtype=np.uint8))
        node = np.intersect1d(neardup.leaves(x.astype(np.uint64)), neardup.leaves(y.astype(np.uint64)))
        for _ in range(neardup.ROUNDS - 1):
            node = node[:20]  # fewer can only lose more
            sides = [next(neardup.branch([pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(np.zeros(len(node), np.int64)), pa.array([s.tobytes()] * len(node), pa.binary())], ["node", "id", "sig"])]), None) if len(node) else None for s in (x, y)]
            node = np.intersect1d(*(s.column(0).to_numpy().view(np.uint64) for s in sides)) if sides[0] is not None else node
        lost += not len(node)
    assert lost <= 1


def test_near_duplicates_under_a_hot_template(spark, monkeypatch):
    """A template that all sets share keeps nodes large for several rounds; pairs that only it surrounds are found, against brute force."""
    monkeypatch.setattr(neardup, "NODE", 8)
    template, rows = words(95, 1), []
    for i in range(150):
        own = words(105, 5000 + i)
        rows += [(2 * i, " ".join(template + own)), (2 * i + 1, " ".join(template + own[:78] + words(27, 9000 + i)))]
    got = {(x.doc_id, x.n_shingles, x.component_id) for x in neardup.near_duplicates(frame(spark, rows)).collect()}
    assert got == set(brute_components(rows))


# repeated passages


def test_passages(spark):
    p, q = words(80, 1), words(55, 2)
    rows = [(1, " ".join(words(70, 3) + p + words(40, 4))), (2, " ".join(p)), (3, " ".join(words(30, 5) + p + q)), (4, " ".join(q + words(90, 6))), (5, " ".join(words(120, 7))), (6, " ".join(words(60, 8) + words(49, 1)[:49] + words(60, 9))), (7, None), (8, "a b c"), (9, " ".join(["x"] * 400))]
    got = {r.doc_id: r for r in suffixes.passages(frame(spark, rows)).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert [(s.start, s.end) for s in got[1].repeats] == [(70, 150)] and not got[1].cuts
    assert [(s.start, s.end) for s in got[2].cuts] == [(0, 80)]
    assert [(s.start, s.end) for s in got[3].repeats] == [(30, 165)] and [(s.start, s.end) for s in got[3].cuts] == [(30, 110)]
    assert [(s.start, s.end) for s in got[4].cuts] == [(0, 55)]
    cut = {r.doc_id: r.text for r in suffixes.cut_passages(frame(spark, rows)).collect()}
    assert 2 not in cut and cut[3] == " ".join(words(30, 5) + q) and cut[4] == " ".join(words(90, 6)) and cut[5] == rows[4][1] and cut[7] is None


def test_passages_match_windows(spark):
    """Against all windows of 50 words that another document holds."""
    r, base, rows = random.Random(1), words(600, 11), []
    for i in range(40):
        a = r.randrange(500)
        rows.append((i, " ".join(words(r.randint(0, 60), 100 + i) + base[a : a + r.randint(20, 100)] + words(r.randint(0, 60), 200 + i))))
    seen = {}
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - 49):
            seen.setdefault(tuple(w[k : k + 50]), set()).add(i)
    want = {}
    for i, t in rows:
        w = t.split()
        want[i] = {x for k in range(len(w) - 49) if len(seen[tuple(w[k : k + 50])]) > 1 for x in range(k, k + 50)}
    got = {x.doc_id: {y for s in x.repeats for y in range(s.start, s.end)} for x in suffixes.passages(frame(spark, rows)).collect()}
    assert got == {i: x for i, x in want.items() if x}


def test_passages_odd(spark):
    assert suffixes.passages(frame(spark, ODD)).count() == 0
    assert suffixes.passages(frame(spark, [])).count() == 0
    kept = suffixes.cut_passages(frame(spark, ODD))
    assert kept.count() == len(ODD) and kept.columns == frame(spark, ODD).columns


def repeated_words(rows):
    """By brute force: words of each document inside a 50-word window that another document holds."""
    seen, want = windows_of(rows), {}
    for i, t in rows:
        w = (t or "").lower().split()
        if hit := {x for k in range(len(w) - 49) if len(seen[tuple(w[k : k + 50])]) > 1 for x in range(k, k + 50)}:
            want[i] = want.get(i, set()) | hit
    return want


@pytest.mark.parametrize("size,a,b", [(60, 12, 12), (120, 12, 12), (120, 12, 3)])
def test_passages_of_a_block_many_times_in_a_row(spark, size, a, b):
    block = words(size, 1)
    rows = [(1, " ".join(words(9, 2) + block * a)), (2, " ".join(block * b + words(9, 3)))]
    got = {x.doc_id: {y for s in x.repeats for y in range(s.start, s.end)} for x in suffixes.passages(frame(spark, rows)).collect()}
    assert got == repeated_words(rows) and len(got[1]) == size * a


@pytest.mark.parametrize("held", [100_000, 5])
def test_passages_over_many_partitions(spark, monkeypatch, held):
    """A run that a third of the documents holds goes over the ends of partitions of the sort."""
    monkeypatch.setattr(suffixes, "HELD", held)
    hot, rows = words(70, 1), []
    rows = [(i, " ".join(words(i % 23, 100 + i) + (hot if i % 3 else words(55, 900 + i % 40)) + words(20, 500 + i))) for i in range(200)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "37")
        found = suffixes.passages(frame(spark, rows).repartition(9)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {x.doc_id: {y for s in x.repeats for y in range(s.start, s.end)} for x in found} == repeated_words(rows)
    assert not next(x for x in found if x.doc_id == 1).cuts and all(x.cuts for x in found if x.doc_id % 3 and x.doc_id > 1)


def test_passages_of_rows_that_repeat_a_doc_id(spark):
    """Each row is cut by its own text; columns may be called as those used inside."""
    p, own, short = words(60, 1), words(80, 2), words(5, 3)
    rows = [(1, " ".join(p)), (2, " ".join(words(30, 4) + p)), (2, " ".join(own)), (2, " ".join(short)), (2, " ".join(words(30, 4) + p))]
    df = spark.createDataFrame([(i, t, 7, "x", len(t)) for i, t in rows], "doc_id long, text string, cuts int, `__row` string, n_chars int")
    got = suffixes.cut_passages(df)
    assert got.columns == df.columns
    cut = " ".join(words(30, 4))
    want = [(1, rows[0][1]), (2, cut), (2, rows[2][1]), (2, rows[3][1]), (2, cut)]
    assert sorted((r.doc_id, r.text, r.cuts, r["__row"], r.n_chars) for r in got.collect()) == sorted((i, t, 7, "x", len(t)) for i, t in want)


def windows_of(rows):
    """Windows of 50 words: the documents that hold each."""
    seen = {}
    for i, t in rows:
        w = (t or "").lower().split()
        for k in range(len(w) - 49):
            seen.setdefault(tuple(w[k : k + 50]), set()).add(i)
    return seen


def test_passages_that_one_document_holds_often(spark):
    """Occurrences in one document, or in rows without doc_id, hide none from another; many partners with one run hide no pair."""
    p, hot, x, y = words(60, 1), words(26, 2), words(24, 3), words(24, 4)
    rows = [(1, " ".join(words(30, 5) + p)), (2, " ".join(v for i in range(40) for v in p + words(9, 100 + i)))]
    rows += [(None, " ".join(words(20, 200 + i) + p)) for i in range(9)]
    rows += [(10 + i, " ".join(words(24 - i % 25, 300 + i) + x[len(x) - i % 25 :] + hot + y[: i * 7 % 25] + words(24, 400 + i))) for i in range(60)]
    rows += [(100, " ".join(["a"] * 90 + words(45, 9))), (101, " ".join(words(30, 10) + ["a"] * 30 + words(45, 9)))]
    seen, want = windows_of(rows), {}
    for i, t in rows:
        w = t.split()
        if hit := {x for k in range(len(w) - 49) if len(seen[tuple(w[k : k + 50])]) > 1 for x in range(k, k + 50)}:
            want[i] = want.get(i, set()) | hit
    got = {x.doc_id: {y for s in x.repeats for y in range(s.start, s.end)} for x in suffixes.passages(frame(spark, rows)).collect()}
    want[suffixes.NONE] = want.pop(None)
    assert got == want


def test_each_word_of_a_passage_stays(spark):
    """A line of 26 to 49 words in document 1 takes nothing from the longer passage around it that 2 and 3 share."""
    r, rows = random.Random(3), []
    for i in range(40):
        line, a, b = words(r.randint(26, 49), 1000 + i), words(40, 2000 + i), words(40, 3000 + i)
        rows += [(3 * i, " ".join(words(40, 4000 + i) + line + words(40, 5000 + i))), (3 * i + 1, " ".join(words(20, 6000 + i) + a + line + b)), (3 * i + 2, " ".join(a + line + b + words(20, 7000 + i)))]
    left = [(x.doc_id, x.text) for x in suffixes.cut_passages(frame(spark, rows)).select("doc_id", "text").collect()]
    before, after = windows_of(rows), windows_of(left)
    assert all(w in after for w, d in before.items() if len(d) > 1)
    assert not [w for w, d in after.items() if len(d) > 1]


# decontamination


def brute_hits(docs, items):
    split = lambda t: [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
    wins = []
    for i, t in items:
        w = split(t)
        wins += [(i, w[k : k + 10]) for k in range(max(1, len(w) - 9))] if w else []
    out = []
    for d, t in docs:
        w, hit, named = split(t), set(), set()
        for i, x in wins:
            for k in range(len(w) - len(x) + 1):
                if w[k : k + len(x)] == x:
                    hit |= set(range(k, k + len(x)))
                    named.add(str(i))
        out.append((d, len(w), len(hit), len(named), tuple(sorted(named))))
    return sorted(out, key=str)


def test_decontamination(spark):
    a, b, c = words(14, 1), words(25, 2), "É été àB ß × ÷ Ünd ñ 中文 µ Ŀ".split()
    items = [(15, " ".join(c)), (1, " ".join(a)), (2, " ".join(b)), (10, "just three words"), (11, ""), (12, None), (13, "a a a a a a a a a a a"), (14, " ".join(a))]
    docs = [(1, "Pre " + ", ".join(a).upper() + " post"), (2, " ".join(b[:9])), (3, " ".join(b[3:20] + words(5, 4) + b[:10])), (4, "there are JUST three-words here"), (5, "a " * 30), (6, None), (7, ""), (7, ""), (8, " ".join(words(50, 9))), (9, "--É ÀB xé " + " ".join(c) + " "), (10, "- ")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(frame(spark, docs), bench).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, tuple(r["items"])) for r in got), key=str) == brute_hits(docs, items)
    kept = decontaminate.remove_contaminated(frame(spark, docs), bench)
    assert {r.doc_id for r in kept.collect()} == {2, 6, 7, 8, 10} and kept.columns == frame(spark, docs).columns
    none = bench.limit(0)
    assert decontaminate.contamination(frame(spark, docs), none).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(frame(spark, []), bench).count() == 0
    assert decontaminate.contamination(frame(spark, ODD), bench).count() == len(ODD)


def test_decontamination_shuffled(spark, monkeypatch):
    monkeypatch.setattr(work, "BROADCAST_BYTES", 0)
    test_decontamination(spark)


def test_contaminated_rows_that_repeat_and_clash(spark):
    a = words(12, 1)
    bench = spark.createDataFrame([(1, " ".join(a))], "item_id long, text string")
    rows = [(1, " ".join(a)), (1, " ".join(words(9, 2))), (None, " ".join(words(3, 3) + a)), (None, "clean"), (2, None), (1, " ".join(a))]
    df = spark.createDataFrame([(i, t, 5, "k", 6) for i, t in rows], "doc_id long, text string, n_hit int, __key string, `a.b` int")
    for most in (0.0, 0.5):
        left = decontaminate.remove_contaminated(df, bench, most_hit=most)
        assert left.columns == df.columns and sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([rows[1], rows[3], rows[4]], key=str)
    assert decontaminate.remove_contaminated(df.limit(0), bench).count() == 0


def test_proximity(spark):
    """Against all spans of words: items whose three rarest terms stand within 20 words."""
    r, terms = random.Random(4), [f"t{i}" for i in range(30)]
    items = [(i, " ".join(r.sample(terms, r.randint(1, 6)))) for i in range(12)] + [(50, None), (51, "absent t1 t2")]
    docs = [(i, " ".join(r.choices(terms + ["x"] * 40, k=r.randint(0, 60)))) for i in range(60)]
    counts = pd.Series([w for _, t in docs for w in t.split()]).value_counts()
    want = {}
    for d, t in docs:
        w = t.split()
        for i, x in items:
            rare = sorted({(int(counts.get(v, 0)), v) for v in (x or "").split()})[:3]
            want[d] = want.get(d, 0) + bool(rare and any({v for _, v in rare} <= set(w[k : k + 20]) for k in range(max(1, len(w)))))
    got = decontaminate.contamination(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {x.doc_id: x.n_near for x in got} == want


# tokens, packing, Huffman


def alike_words(n=1024):
    """A Thue-Morse string of a and b, and the same with both exchanged: the two are equal under any polynomial hash modulo 2**64."""
    s = "a"
    while len(s) < n:
        s += s.translate({97: 98, 98: 97})
    return s, s.translate({97: 98, 98: 97})


def test_words_that_polynomials_mix_up(spark):
    from tokenizers import Tokenizer

    rows = list(enumerate([*alike_words(), *(" ".join(x) for x in alike_words()), *alike_words(64)]))
    t = Tokenizer.from_file(tokens.vocabulary_path())
    ids = [t.encode(x, add_special_tokens=False).ids for _, x in rows]
    want = {i: zlib.crc32(np.array([*x, 0], "<u4").tobytes()) for i, x in enumerate(ids)}
    assert {r.doc_id: r.ids_crc32 for r in packing.pack(frame(spark, rows)).collect()} == want
    path = work.table_path(spark, "alike")
    huffman.write_ids(frame(spark, rows), path)
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in huffman.read_ids(spark, path).collect()} == {i: [*x, 1] for i, x in enumerate(ids)}
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(frame(spark, rows)).collect()}
    assert got == set(brute_components(rows))


def test_words_that_share_a_key_are_asked_of_the_tokenizer(monkeypatch):
    import pyarrow as pa

    plain = textkit.hashes
    monkeypatch.setattr(textkit, "hashes", lambda b, start, end, seed=0: plain(b, start, end, seed) if seed else plain(b, start, end) % np.uint64(7))
    coder, texts = tokens.WordCoder(tokens.vocabulary_path()), ["one two three four five six seven eight nine ten", "", "eleven one"]
    for text in texts:
        data, offs = textkit.text_buffers(pa.array([text]))
        assert coder.encode(data, offs)[0].tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids


def test_word_coder_matches_the_library(spark):
    from tokenizers import Tokenizer

    import pyarrow as pa

    path = tokens.vocabulary_path()
    t, r = Tokenizer.from_file(path), random.Random(3)
    parts = list("aBc1'2!.,|<>{}- \t\n\x01 éÉß×“”ñ̸=́sTΣς中🙂") + ["<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'LL", "don't"]
    texts = ["".join(r.choices(parts, k=r.randint(0, 25))) for _ in range(3000)] + ["", None]
    want = [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    got = []
    for _, _, ids, sizes in tokens.encode_documents(pa.array(texts), path, 1):
        got += [list(map(int, x[:-1])) for x in np.split(ids, np.cumsum(sizes)[:-1])]
    assert got == want


def test_huffman_round_trip(spark, tmp_path):
    docs = [(i, " ".join(words(40 * i, i))) for i in range(12, 0, -1)] + ODD
    huffman.write_ids(frame(spark, docs), f"file://{tmp_path}/f", block_ids=200)
    got = huffman.read_ids(spark, f"file://{tmp_path}/f").orderBy("start").collect()
    ids = [r.doc_id for r in got]
    assert len(got) == len(docs) and ids == sorted(ids)
    from tokenizers import Tokenizer

    t, at = Tokenizer.from_file(tokens.vocabulary_path()), 0
    want = {}
    for d, x in docs:
        want.setdefault(d if d is not None else -(1 << 63), []).append(np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4").tobytes())
    for r in got:
        assert r.start == at and bytes(r.ids) in want[r.doc_id] and r.ids_crc32 == zlib.crc32(bytes(r.ids)) and 4 * r.n_tokens == len(r.ids)
        at += r.n_tokens
    huffman.write_ids(frame(spark, []), f"file://{tmp_path}/e")
    assert huffman.read_ids(spark, f"file://{tmp_path}/e").count() == 0


def test_damaged_block():
    lengths = huffman.code_lengths(np.array([5, 3, 1]))
    image = huffman.write_block(np.array([7]), np.array([3]), np.array([0, 1, 2], np.uint32), huffman.canonical(lengths), lengths)
    assert huffman.read_block(image, huffman.decode_table(lengths))[2].tolist() == [0, 1, 2]
    for bad in (image[:-1] + bytes([image[-1] ^ 64]), b"XXXX" + image[4:]):
        with pytest.raises(ValueError):
            huffman.read_block(bad, huffman.decode_table(lengths))


@pytest.mark.parametrize("limit", [4, 5, 18])
def test_code_lengths(limit):
    counts = np.array([1000, 500, 3, 2, 1, 1, 0, 90, 40, 7])
    n = huffman.code_lengths(counts, limit).astype(int)
    assert n.max() <= limit and (n[counts == 0] == 0).all() and abs(sum(2.0 ** -x for x in n if x) - 1) < 1e-12
    if limit == 18:
        import heapq

        heap, cost = [int(c) for c in counts if c], 0
        heapq.heapify(heap)
        while len(heap) > 1:
            s = heapq.heappop(heap) + heapq.heappop(heap)
            cost += s
            heapq.heappush(heap, s)
        assert (n * counts).sum() == cost


def test_pack_and_unpack():
    r = np.random.default_rng(0)
    for n in (0, 1, 511, 512, 513, 5000):
        ids = np.minimum(r.geometric(0.01, n), 3000).astype(np.uint32)
        counts = np.bincount(ids, minlength=3001) if n else np.eye(1, 3001, 5, dtype=int)[0]
        lengths = huffman.code_lengths(counts)
        data, marks = huffman.pack(ids, huffman.canonical(lengths), lengths)
        assert (huffman.unpack(data, marks, n, huffman.decode_table(lengths)) == ids).all()


def test_packing(spark):
    docs = [(100 + i, " ".join(words(r, i))) for i, r in enumerate([5, 9, 700, 1500, 3, 3, 3, 40, 300, 333, 90, 2000])] + ODD
    got = packing.pack(frame(spark, docs), capacity=512).toPandas()
    assert (got.groupby("sequence_id")["length"].sum() <= 512).all()
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"] == g["length"].cumsum() - g["length"]).all()
    for _, g in got.dropna().groupby("doc_id"):
        if g["doc_id"].iloc[0] not in (4,):
            assert (g.sort_values("piece")["start"] == g.sort_values("piece")["length"].cumsum() - g.sort_values("piece")["length"]).all()
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 512) + 1
    assert packing.pack(frame(spark, [])).count() == 0


def test_plan_is_optimal_on_small_instances():
    def best(items, cap):
        items, found = sorted(items, reverse=True), [len(items)]

        def go(i, bins):
            if len(bins) >= found[0]:
                return
            if i == len(items):
                found[0] = len(bins)
                return
            for k in sorted(set(range(len(bins))), key=lambda k: bins[k]):
                if bins[k] >= items[i]:
                    bins[k] -= items[i]
                    go(i + 1, bins)
                    bins[k] += items[i]
            go(i + 1, bins + [cap - items[i]])

        go(0, [])
        return found[0]

    r, worse = random.Random(2), 0
    for _ in range(60):
        cap = 20
        items = [r.randint(1, cap) for _ in range(r.randint(1, 9))]
        bins = packing.plan(np.bincount(items, minlength=cap + 1), cap)
        assert sorted(n for parts, m in bins for n, k in parts for _ in range(m * k)) == sorted(items)
        assert all(sum(n * k for n, k in parts) <= cap for parts, _ in bins)
        worse += sum(m for _, m in bins) - best(items, cap)
    assert worse <= 2


# the rest


def test_shards(spark):
    docs = [(i, "x" * (i % 90)) for i in range(400)] + [(999, "y" * 70)] * 30 + [(None, None), (1000, "z" * 500)]
    rows = frame(spark, docs)
    from pyspark.sql import functions as F

    got = sharding.shard(rows, "doc_id", F.octet_length("text"), 400).toPandas()
    assert len(got) == len(docs)
    per = got.groupby(["depth", "prefix", "page"])["bytes"].agg(["sum", "count"])
    assert ((per["sum"] <= 400) | (per["count"] == 1)).all()
    # a bucket splits only if the one above is over the limit
    sizes = got.groupby(["depth", "prefix"])["bytes"].sum()
    h = {d: int(hashlib.md5(str(d).encode()).hexdigest()[:15], 16) for d, _ in docs if d is not None}
    for (depth, prefix), _ in sizes.items():
        if depth:
            up = sum(len(t or "") for d, t in docs if d is not None and h[d] >> (sharding.BITS - depth + 1) == prefix >> 1)
            assert up > 400
    assert sharding.shard(frame(spark, []), "doc_id", F.octet_length("text")).count() == 0
    assert sharding.shard(frame(spark, ODD), "doc_id", F.octet_length("text")).count() == len(ODD)


def test_directory_entries(spark):
    from pyspark.sql import functions as F

    docs = frame(spark, [(i, "x" * 50) for i in range(200)])
    leaves, _ = work.store(sharding.directory(docs.select(sharding.hash_bits(F.col("doc_id")).alias("hash"), F.octet_length("text").cast("long").alias("bytes")), 900), "leaves")
    deep = max(r.depth for r in leaves.collect())
    at = {r.entry: (r.depth, r.prefix) for r in sharding.entries(leaves).collect()}
    assert sorted(at) == list(range(1 << deep)) and all(e >> (deep - d) == p for e, (d, p) in at.items())


def test_pages_of_one_key(spark):
    """Against a walk over the rows in order; a hot key goes over many partitions, and a row over the limit troubles no other."""
    from pyspark.sql import functions as F

    r = random.Random(1)
    rows = [(5, "y" * r.randint(0, 90)) for _ in range(300)] + [(5, "z" * n) for n in (51, 100, 101, 500)] + [(6, "w" * 60)] * 5 + [(7, "v" * 20)]
    got = sharding.shard(frame(spark, rows).select("doc_id", F.octet_length("text").alias("n"), F.lit("k").alias("a.b")), "doc_id", F.col("n"), 100).toPandas()
    want = []
    for key in (5, 6, 7):
        sizes, at, big = sorted(len(t) for d, t in rows if d == key), 0, 0
        for n in sizes:
            if sum(sizes) <= 100:
                want.append((key, n, 0))
            elif 2 * n > 100:
                big += 1
                want.append((key, n, -big))
            else:
                want.append((key, n, at // 50))
                at += n
    assert sorted((a.doc_id, a.n, a.page) for a in got.itertuples()) == sorted(want)
    per = got.groupby(["depth", "prefix", "page"])["bytes"].agg(["sum", "count"])
    assert ((per["sum"] <= 100) | (per["count"] == 1)).all()


def test_language(spark):
    r, rows = random.Random(0), []
    alphabets = {"aa": "aeiourstln", "bb": "bcdfgaeiouw", "cc": "éèàçlmnae"}
    for i in range(300):
        lang = list(alphabets)[i % 3]
        rows.append((i, " ".join("".join(r.choices(alphabets[lang], k=4)) for _ in range(60)), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    from pyspark.sql import functions as F

    out = langid.held_out(F.col("doc_id"), 4, 2)
    model = langid.train(docs, ~out)
    got = langid.predict(docs.select("doc_id", "text"), model).join(docs.withColumn("held", out), "doc_id").where("held").toPandas()
    assert len(got) > 40 and (got["lang_pred"] == got["lang"]).mean() > 0.97 and got["score"].between(0, 1).all()
    odd = {r.doc_id: r for r in langid.predict(frame(spark, ODD + [(70, "12 34 !!")]), model).collect()}
    assert odd[1].lang_pred == odd[2].lang_pred == odd[3].lang_pred == odd[70].lang_pred == "und" and odd[4].lang_pred != "und"
    assert langid.predict(frame(spark, []), model).count() == 0
    empty = langid.train(docs.limit(0), ~out)
    assert {r.lang_pred for r in langid.predict(docs.select("doc_id", "text").limit(3), empty).collect()} == {"und"}


def test_language_vectors_against_brute_force(spark):
    """Bind, bundle and compare letter by letter."""
    base, r = langid.letters()[langid.GRAM - 1].astype(int), random.Random(5)
    code = lambda ch: 1 + ord(ch.lower()[0]) % (langid.SYMBOLS - 1) if ch.isalpha() else 0

    def unit(text):
        s = [0]
        for x in [*map(code, text), 0]:
            if x or s[-1]:
                s.append(x)
        total = np.zeros(langid.DIMENSIONS, int)
        for i in range(len(s) - 2):
            total += np.roll(base[s[i]], 2) * np.roll(base[s[i + 1]], 1) * base[s[i + 2]]
        return total / np.linalg.norm(total)

    texts = [("aa", "".join(r.choices("aeiou rst ", k=80)) + "a") for _ in range(6)] + [("bb", "".join(r.choices("BCDFG äé 12", k=90)) + "b") for _ in range(6)]
    docs = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(texts)], "doc_id long, text string, lang string")
    from pyspark.sql import functions as F

    model = langid.train(docs, F.lit(True))
    want = {x: sum(unit(t) for y, t in texts if y == x) for x in ("aa", "bb")}
    want = {x: v / np.linalg.norm(v) for x, v in want.items()}
    assert model.languages == ["aa", "bb"] and np.allclose(model.prototypes, [want["aa"], want["bb"]], atol=1e-5)
    for row in langid.predict(docs.select("doc_id", "text"), model).collect():
        cosine = {x: float(unit(texts[row.doc_id][1]) @ v) for x, v in want.items()}
        best = max(cosine, key=cosine.get)
        assert row.lang_pred == best and abs(row.score - (1 + cosine[best]) / 2) < 1e-5


def test_chain_likelihood_and_gradient():
    """Against the sum over all taggings and finite differences."""
    r = np.random.default_rng(0)
    x, y = r.integers(-1, 4, (5, 6, 2)), r.integers(0, 2, (5, 6))
    x[:, :, 1] = np.where(x[:, :, 0] > 0, x[:, :, 1], -1)
    x[x == 0] = -1
    x[3, 4:], y[3, 4:] = -2, 0
    weight, theta = r.integers(1, 4, 5).astype(float), r.normal(0, 0.5, 6)
    value, grad = toxicity.likelihood(theta, x, y, weight)

    def score(row, tags):
        total, before = 0.0, 0
        for t, tag in zip(row, tags):
            total += tag * (theta[0] + sum(theta[f] for f in t if f > 0) + theta[-2 + before])
            before = tag
        return total

    want = -0.025 * float(theta @ theta)
    for row, tags, w in zip(x, y, weight):
        n = int((row[:, 0] >= -1).sum())
        every = [score(row[:n], [(m >> i) & 1 for i in range(n)]) for m in range(1 << n)]
        want += w * (score(row[:n], tags[:n]) - np.log(np.exp(every).sum()))
    assert abs(value - want) < 1e-9
    for i in range(len(theta)):
        step = np.eye(len(theta))[i] * 1e-6
        assert abs((toxicity.likelihood(theta + step, x, y, weight)[0] - toxicity.likelihood(theta - step, x, y, weight)[0]) / 2e-6 - grad[i]) < 1e-5


def test_toxicity(spark):
    r, rows, labels = random.Random(0), [], []
    for i in range(500):
        w = words(80, 1000 + i)
        toxic = i % 3 == 0
        if toxic:
            for _ in range(4):
                w.insert(r.randrange(len(w)), r.choice(["badword", "worseword", "uglyword"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    labels += [(None, 1), (3, None)]
    docs, lab = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, lab)
    got = toxicity.tag(docs, model).toPandas().sort_values("doc_id")
    assert ((got["score"] >= 0.5) == (got["doc_id"] % 3 == 0)).mean() > 0.98
    hit = got[got["doc_id"] == 0].iloc[0]
    assert {rows[0][1][s["start"] : s["end"]] for s in hit["spans"]} <= {"badword", "worseword", "uglyword"} and len(hit["spans"]) == 4
    odd = toxicity.tag(frame(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= x.score < 0.5 for x in odd)
    kept = toxicity.drop_toxic(docs, lab)
    assert kept.columns == docs.columns and abs(kept.count() - 333) <= 6
    assert toxicity.tag(frame(spark, []), model).count() == 0
    none = toxicity.train(docs, lab.limit(0))
    assert all(abs(x.score - 1 / 3) < 1e-9 for x in toxicity.tag(docs.limit(3), none).collect())
    assert toxicity.drop_toxic(docs, lab.limit(0)).count() == docs.count()


def test_chain_marginals_match_brute_force():
    c = toxicity.Chain({"bad": 4.0, "odd": 1.0}, -2.0, (-0.5, 1.0), (1.0, 0.0), 0.0)
    text = "a a a a a a bad a a odd bad a a a a a".split()
    n, total, on = len(text), 0.0, np.zeros(len(text))
    for m in range(1 << n):
        tags = [(m >> i) & 1 for i in range(n)]
        w, before = 1.0, 0
        for x, t in zip(text, tags):
            w *= np.exp(c.move[before] + (c.other + c.weights.get(x, 0.0))) if t else 1.0
            before = t
        total += w
        on += w * np.array(tags)
    near, p = c.marginals(text)
    assert np.allclose(p, (on / total)[near])


def test_urls(spark):
    rows = [(1, None, "h"), (2, "no scheme", "h"), (3, "http://A.example.NET/en/x?q#f", "h"), (4, "http://x.net", "h"), (5, "http://x.net/", "h"), (6, "https://www.example.com/de/1", "h"), (7, "http://org/fr/", "h"), (8, "http://notorg/fr/", "h"), (9, "http://big-casino.example.com/poker/1", "h"), (9, "http://city-library.example.org/history/page", "h"), (10, "x://h?a://b/net/", "h")]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, host string")).orderBy("page_id", "verdict").collect()
    by = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in got]
    assert by[0][1:4] == ("", "", None) and by[1][1:4] == ("", "", None)
    assert by[2][1:] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert by[3][1:4] == ("x.net", "", None) and by[4][3:] == ("net/", "block") and by[5][3:] == ("example.com/de/", "block") and by[6][3:] == ("org/fr/", "allow") and by[7][3] is None
    assert [x[4] for x in by[8:10]] == ["allow", "block"] and by[10][1:3] == ("h", "")


def test_url_scores_against_brute_force(spark):
    """Hashed n-grams taken one by one give the scores; those of a small table with another one held out."""
    m = urls.train()
    rows = [("a.example.net", "/en/x"), ("", ""), ("é.example", "/ü/" + "long" * 50), ("casino.example", "")]
    mask, mul = (1 << 64) - 1, lambda x, k: (x * k) & ((1 << 64) - 1)

    def mix(x):
        x ^= x >> 31
        x = mul(x, 0x7FB5D329728EA185)
        x ^= x >> 27
        x = mul(x, 0x81DADEF4BC2DD44D)
        return x ^ (x >> 33)

    for host, path in rows:
        found = set()
        for seed, x in ((1, f"^{host}$"), (2, f"^{path}$")):
            for n in (3, 4, 5):
                for i in range(len(x) - n + 1):
                    h = seed
                    for ch in x[i : i + n]:
                        h = mix(h ^ ord(ch))
                    found.add(mix((h + n) & mask) % len(m.weights))
        z = m.bias + m.weights[sorted(found)].sum() / max(1, len(found)) ** 0.5
        assert abs(m.scores([host], [path])[0] - 1 / (1 + np.exp(-z))) < 1e-9


def test_url_model_on_urls_held_out():
    """Each fifth of the labelled table is judged by a model of the other four."""
    t = urls.labelled_urls()
    fold, right = np.random.default_rng(0).permutation(len(t)) % 5, 0
    for k in range(5):
        held = t[fold == k]
        s = urls.train(t[fold != k]).scores(*map(list, zip(*map(urls._split, held["url"]))))
        right += int(((s >= 0.5) == (held["label"] == 1)).sum())
    assert right / len(t) >= 0.85


@pytest.mark.parametrize("name", ["sf0.001"])
def test_url_rules_match_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '/root/testdata/{name}/pages.parquet'")
    want = {tuple(None if x != x else x for x in r) for r in c.sql(urls.RULES_SQL).df().itertuples(index=False)}
    got = urls.op2_url_filter(spark, f"/root/testdata/{name}").collect()
    model = urls.train()
    for r in got:
        said = next((w[4] for w in want if w[:4] == (r.page_id, r.host, r.path, r.rule)), "none")
        assert said != "none" and r.verdict == (said or ("block" if model.scores([r.host], [r.path])[0] >= 0.5 else "allow"))
    assert len(got) == len(c.sql("SELECT page_id FROM pages").df())


def test_top_k(spark):
    r = np.random.default_rng(0)
    rows = [(i, [float(x) for x in r.normal(0, 0.3, 8)], "x") for i in range(300)]
    rows += [(20, rows[3][1], "x"), (301, None, "x"), (320, [float("nan")] * 8, "x"), (340, [None] * 8, "x"), (360, rows[5][1], "x"), (361, rows[5][1], "x"), (None, rows[5][1], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = {}
    for x in topk.top_k(df, k=7, query_block=5, candidate_block=64).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    good = [(i, np.floor(64.0 * np.float32(v).astype(float))) for i, v, _ in rows if i is not None and v is not None and all(y is not None and np.isfinite(y) for y in v)]
    for q in {i for i, _ in good if i % 20 == 0}:
        hits = []
        for v in [v for i, v in good if i == q]:
            hits.append([(j + 1, i, int(s)) for j, (s, i) in enumerate(sorted(((-(v @ c), i) for i, c in good if i != q))[:7])])
        hits = [[(j, i, -s) for j, i, s in h] for h in hits]
        assert sorted(got[q]) in hits
    assert set(got) == {i for i, _ in good if i % 20 == 0}
    assert topk.top_k(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1.0, 1e3, 1e5, 1e6, 1e8, 1e17])
def test_top_k_of_large_components(spark, size):
    """Scores are exact at any size; those beyond a long are held at its ends."""
    r = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in r.normal(0, size, 4)]) for i in range(60)] + [(100 + i, [7e4 + i, 7e4, -7e4, 7e4]) for i in range(40)]
    got = {}
    for x in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5, query_block=4, candidate_block=16).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    whole = [(i, [math.floor(64.0 * x) for x in v]) for i, v in rows]
    for q, v in whole:
        if q % 20 == 0:
            best = sorted(((-min(max(sum(a * b for a, b in zip(v, c)), -(2**63)), 2**63 - 1), i) for i, c in whole if i != q))[:5]
            if size < 1e8:
                assert sorted(got[q]) == [(j + 1, i, -s) for j, (s, i) in enumerate(best)]
            else:  # scores at the ends of long: which of those beyond it come first is open
                assert [s for _, _, s in sorted(got[q])] == [-s for s, _ in best]
    assert set(got) == {i for i, _ in rows if i % 20 == 0}


def test_pivots_eliminate_clustered_candidates():
    r = np.random.default_rng(2)
    centres = r.normal(0, 40, (20, 16))
    c = np.floor(centres[np.arange(4000) % 20] + r.normal(0, 1, (4000, 16)))
    pivots = c[:16]
    d = np.sqrt(((c[:, None] - pivots[None]) ** 2).sum(2))
    read = 0
    for j in range(0, 4000, 200):
        hits, n = topk.exact_block(c[j], d[j], float(c[j] @ c[j]), c, np.ascontiguousarray(d.T), (c * c).sum(1) / 2, np.arange(4000), j, 20, first=64)
        want = sorted((-int(c[j] @ x), i) for i, x in enumerate(c) if i != j)[:20]
        assert [(-s, i) for s, i in hits] == want
        read += n
    assert read < 0.35 * 20 * 4000


def test_components(spark):
    from pointloom.llm import graph

    r = random.Random(0)
    for n, m in ((40, 30), (30, 60), (50, 49)):
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)] if m != 49 else [(i, i + 1) for i in range(49)]
        label = {x: x for e in edges for x in e if e[0] != e[1]}
        for _ in range(n):
            for a, b in edges:
                if a != b:
                    label[a] = label[b] = min(label[a], label[b])
        got = graph.components(spark.createDataFrame(edges, "a long, b long"))
        assert {(x.id, x.root) for x in got.collect()} == set(label.items())
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
