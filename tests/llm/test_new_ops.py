"""Spelling variants, conversation tries and mixture-controlled packing against brute force."""

import collections
import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.llm import mixture, tokens, trie, variants

# spelling variants


def brute_variants(docs, every=199, least=6, often=5, ratio=5):
    counts = collections.Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({k: k + 32 for k in range(65, 91)})
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least and n >= often}
    near = collections.defaultdict(set)
    for a in words:
        for b in words:
            if a != b and one_edit(a, b):
                near[a].add(b)
    out = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form = best if best is not None and words[best] >= ratio * n else None
        out[w] = [form, None, n, len(near[w]), words[form] if form else None]
    for w in out:
        end = w
        while out[end][0]:
            end = out[end][0]
        out[w][1] = end
    return {(w, *v) for w, v in out.items()}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def rows_of(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_neighbours_are_all_and_distinct():
    alphabet = "abcéÿ"
    letters = np.frombuffer(alphabet.encode("latin-1"), np.uint8)
    for word in ("aabbca", "aaaaaa", "céaééb", "a"):
        want = {word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + c + word[i + d :] for i in range(len(word) + 1) for c in alphabet for d in (0, 1) if i + d <= len(word)}
        want -= {word}
        x = np.frombuffer(word.encode("latin-1"), np.uint8).reshape(1, -1)
        got = []
        for kind, _, at, letter, sums in variants.neighbours(x, letters):
            for i, c, a, b in zip(at.tolist(), letter.tolist(), *sums, strict=True):
                w = word[:i] + ("" if kind == "delete" else chr(c)) + word[i + (kind != "insert") :]
                got.append(w)
                assert [a, b] == [s[0] for s in variants.word_sums([w])]
        assert len(got) == len(set(got)) and set(got) == want


def test_variants_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    base = ["garden", "gardens", "harden", "Gartené", "Étoiles", "running", "runing", "rrunning", "aaaaaaa", "aaaaaaaa", "short"]
    docs = []
    for i in range(60):
        words = [w for w in base for _ in range(rng.choice((0, 1, 1, 9)) if w in ("garden", "running", "aaaaaaa") else rng.choice((0, 0, 1)))]
        rng.shuffle(words)
        docs.append((i, "1x".join(words) + " cafés×÷ z"))
    docs += [(None, "garden running garden"), (7, None), (8, ""), (9, "1234 !? 中文")] + [(3, "gardeni gardeni gardeni")] * 3
    want = brute_variants(docs, 7)
    df = spark.createDataFrame([(i, t, "x", 1, t) for i, t in docs], "doc_id long, text string, word string, n int, form string")
    assert rows_of(variants.variants(df, 7)) == want and any(x[1] for x in want) and any(x[4] > 1 for x in want)
    monkeypatch.setattr(variants, "HELD_WORDS", 3)  # emitted in many parts
    monkeypatch.setattr(variants, "BLOCK", 40)
    monkeypatch.setattr(variants, "MOST_BITS", 12)  # a bitmap that lets most through
    assert rows_of(variants.variants(df.repartition(5), 7)) == want
    assert variants.variants(df.limit(0)).count() == 0 and variants.variants(df.select("doc_id", F.lit("12").alias("text"))).count() == 0


def test_variants_follow_forms_and_ties(spark):
    text = "aaaaaab " * 5 + "aaaaaac " * 25 + "aaaaadc " * 125 + "aaaaaad " * 25 + "zzzzzz " * 5
    got = {r.word: r for r in variants.variants(spark.createDataFrame([(1, text)], "doc_id long, text string"), 10**9).collect()}
    assert got["aaaaaab"].form == "aaaaaac" and got["aaaaaab"].root == "aaaaadc" and got["aaaaaab"].form_n == 25  # of two with 25, the smaller
    assert got["zzzzzz"].root == "zzzzzz" and got["zzzzzz"].n_near == 0 and got["zzzzzz"].form is None


def test_variants_of_very_long_runs(spark):
    a = "".join(random.Random(1).choice("abcdefgé") for _ in range(20_000))
    b = a[:9_000] + "z" + a[9_000:]
    docs = [(i, f"{a} {b} {a[:-1]}") for i in range(5)]
    got = {r.word: r.n_near for r in variants.variants(spark.createDataFrame(docs, "doc_id long, text string"), 10**9).collect()}
    assert got == {a: 2, b: 1, a[:-1]: 1}


def test_crcs_of_runs():
    texts = ["", "a", "héllo", "x" * 500]
    b = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.cumsum([len(t.encode()) for t in texts])
    starts = ends - [len(t.encode()) for t in texts]
    got = variants.run_crcs(b, starts, ends, np.full(len(texts), zlib.crc32(b"17:"), np.uint32))
    assert got.tolist() == [zlib.crc32(f"17:{t}".encode()) for t in texts]


# conversation tries


def rebuilt(rows, block=5, most=9):
    """The rebuilt conversations, turn by turn."""
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, trie_digest(role, text), role or "", text or ""))
    convs = {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % most
        base = int(c - np.fmod(c, block))
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def trie_digest(role, text):
    return hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()


def brute_trie(convs):
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return {(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], sha(p)) for p, m in members.items()}


def trie_rows(made):
    digests = trie.end_digests(made.ends)
    out = made.nodes.join(digests, ["conv_id", "depth"], "left").collect()
    none = hashlib.sha256(b"").hexdigest()
    return {(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.sha256 or none) for r in out}


SCHEMA = "conv_id long, turn long, role string, text string"


def test_trie_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    rows = []
    for c in [*range(60), -7, -3, 10**12]:
        for t in range(rng.choice((1, 2, 3, 8, 12))):
            rows.append((c, t if rng.random() < 0.95 else None, rng.choice(("user", None)), rng.choice(("a", "b", "éè", None, ""))))
    rows += rng.choices(rows, k=30) + [(None, 1, "user", "lost"), (4, 0, "a:1", "b"), (4, 0, "a", "1b")]
    want = brute_trie(rebuilt(rows))
    df = spark.createDataFrame([(*r, 1, "x", 0) for r in rows], SCHEMA + ", depth int, ids string, part int")
    turns = trie.turn_digests(df)
    monkeypatch.setattr(trie, "CHUNK", 2)  # end lists in many chunks, several tables a part, three rounds of merging
    monkeypatch.setattr(trie, "HELD_ROWS", 7)
    monkeypatch.setattr(trie, "FAN", 2)
    monkeypatch.setattr(trie, "parts_of", lambda spark: 5)
    made = trie.prefix_trie(trie.rebuilt(turns))
    assert trie_rows(made) == want and made.ends.where("size(ids) > 2").count() == 0
    texts = {(r.conv_id, r.depth): (r.role, r.text) for r in trie.with_texts(made.nodes, df).collect()}
    convs = rebuilt(rows)
    assert all(texts[c, d] == (convs[c][d - 1] if d else (None, None)) for c, d in texts)


def test_trie_of_a_conversation_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(trie, "parts_of", lambda spark: 5)
    rows = [(5, t, "user", f"t{t % 3}") for t in range(300)] + [(7, t, "user", f"t{t % 3}") for t in range(150)] + [(8, 0, "user", "t0")] * 200
    df = spark.createDataFrame(rows, SCHEMA)
    got = trie_rows(trie.prefix_trie(trie.paths(trie.turn_digests(df))))
    want = brute_trie(rebuilt(rows, 1, 1))
    assert got == want


def test_trie_of_no_rows_and_of_turnless_conversations(spark):
    empty = spark.createDataFrame([], SCHEMA)
    made = trie.prefix_trie(trie.rebuilt(trie.turn_digests(empty)))
    assert made.nodes.count() == 0 and made.ends.count() == 0
    c = next(c for c in range(1, 5) if zlib.crc32(str(c).encode()) % 9 > 1)  # its only turn is replaced by the none of conversation 0
    one = spark.createDataFrame([(c, 0, "user", "x")], SCHEMA)
    got = trie_rows(trie.prefix_trie(trie.rebuilt(trie.turn_digests(one))))
    assert got == {(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())}


# mixture-controlled packing


def pieces_of(df):
    return sorted(df.collect(), key=lambda r: (r.sequence_id, r.offset))


def check_pieces(got, docs, window, closing=2):
    """Each id of each row in one piece, sequences gapless, nothing padded; the sizes of the sequences."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary_path())
    ids = {d: [*t.encode(x or "", add_special_tokens=False).ids, closing] for d, x, _ in docs}
    seen, size = collections.defaultdict(list), collections.Counter()
    for r in got:
        assert r.offset == size[r.sequence_id] and r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        size[r.sequence_id] += r.length
        seen[r.doc_id].append((r.start, r.length))
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    for d, want in ids.items():
        at = 0
        for start, n in sorted(seen[d]):
            assert start == at
            at += n
        assert at == len(want)
    assert all(n == window or n & (n - 1) == 0 for n in size.values())
    return size


def mixed_docs(n=120):
    rng = random.Random(9)
    source = lambda: rng.choice(("web", "web", "web", "books", None, "code"))
    docs = [(i, " ".join(rng.choice(("alpha", "beta", "gamma,", "delta's")) for _ in range(rng.choice((0, 3, 40, 300)))), source()) for i in range(n)]
    return docs + [(n, None, "web"), (n + 1, "", "rare"), (n + 2, "word " * 5000, "books")]


def test_windows_mirror_the_corpus(spark):
    docs = mixed_docs()
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("queue", F.lit("x")).withColumn("at", F.lit(1)).repartition(5)
    got = pieces_of(mixture.pack(df, window=256))
    size = check_pieces(got, docs, 256)
    total, per = sum(size.values()), collections.Counter()
    share = collections.Counter()
    for r in got:
        share[r.source] += r.length
        per[r.sequence_id, r.source] += r.length
    full = [s for s, n in size.items() if n == 256]
    assert len(full) == total // 256
    assert max(abs(per[s, k] - 256 * share[k] / total) for s in full for k in share) < 2


def test_targets_hold_until_a_source_runs_dry(spark):
    docs = mixed_docs()
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3)
    targets = {"web": 0.5, "books": 0.2, "code": 0.3}
    got = pieces_of(mixture.pack(df, targets, window=128))
    size = check_pieces(got, docs, 128)
    per = collections.Counter()
    for r in got:
        per[r.sequence_id, r.source] += r.length
    share = lambda s: {k: per[s, k] for k in ("web", "books", "code", None)}
    first = [share(s) for s in sorted(size)[:20]]
    assert all(abs(x["web"] - 64) <= 2 and abs(x["books"] - 25.6) <= 2 and abs(x["code"] - 38.4) <= 2 and not x[None] for x in first)
    last = {r.source for r in got if r.sequence_id >= max(size) - 3}
    assert last <= {None, "rare", "web", "books", "code"} and any(r.source is None for r in got)


def test_sources_beyond_the_queues_share_one(spark):
    docs = [(i, "some words " * (i % 7), f"s{i % 23}") for i in range(92)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4)
    check_pieces(pieces_of(mixture.pack(df, window=64, most=4)), docs, 64)


def test_mixture_of_none_one_and_repeated_rows(spark):
    schema = "doc_id long, text string, source string"
    assert mixture.pack(spark.createDataFrame([], schema)).count() == 0
    one = mixture.pack(spark.createDataFrame([(1, None, None)], schema)).first()
    assert (one.start, one.length, one.offset, one.doc_tokens, one.ids_crc32) == (0, 1, 0, 1, zlib.crc32(b"\x02\0\0\0"))
    same = mixture.pack(spark.createDataFrame([(None, "a b c", "w")] * 50, schema), window=16).collect()
    assert sum(r.length for r in same) == 200 and len({(r.sequence_id, r.offset) for r in same}) == len(same)


@pytest.mark.parametrize("weights", [None, [0.6, 0.1, 0.3, 0.0]])
def test_plan_uses_up_all_queues(weights):
    totals = np.array([40_000_123, 7, 9_999_999, 1234])
    phases = mixture.plan(totals, None if weights is None else np.array(weights), 4096)
    assert (sum(p.per * p.cycles for p in phases) == totals).all()
    assert all((p.grants >= 0).all() and (p.grants.sum(1) == p.size).all() for p in phases) and len(phases) < 60
    small = [p.size for p in phases if p.size < 4096]
    assert sum(small) == totals.sum() % 4096 and len(set(small)) == len(small) and all(n & (n - 1) == 0 for n in small)


def test_deficits_return_to_zero():
    quotas = np.array([1, 5, 300, 719 * 4 - 306 + 0])
    quotas[-1] = 64 * 50 - quotas[:-1].sum()
    grants = mixture.deficit_round_robin(quotas, 50, 64)
    assert (grants.sum(0) == quotas).all() and (grants.sum(1) == 64).all()
    assert np.abs(np.cumsum(grants, 0) - np.outer(np.arange(1, 51), quotas / 50)).max() < 1.5


def test_contracts_of_the_new_queries(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "source").collect()
    got = mixture.op13_mixture_packing(spark, d)
    assert got.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    check_pieces(pieces_of(got), [tuple(r) for r in docs], 4096)
    words = variants.op11_spelling_variants(spark, d)
    assert rows_of(words) == brute_variants([(r.doc_id, r.text) for r in docs]) and [t for _, t in words.dtypes] == ["string"] * 3 + ["bigint"] * 3
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = trie.op12_conversation_trie(spark, d)
    assert {tuple(r) for r in got.collect()} == brute_trie(rebuilt(rows)) and json.loads(got.schema.json())["fields"][0]["type"] == "long"
