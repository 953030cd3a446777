"""Every operator against a brute-force version, on texts with all the odd cases."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelspark.llm import (
    arc_warc, decontaminate, fingerprints, language_model, mixing, near_dedup, quality_gam, suffix_dedup, token_counts,
    toxicity)
from panelspark.llm.components import components
from panelspark.llm.textscan import ALNUM, NON_SPACE, Words, flat, window_hashes
from panelspark.session import scratch_path
from tests.llm.conftest import frame

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def item_words(t):
    return ITEM.findall((t or "").translate(LOWER))


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def test_words_are_those_of_the_patterns(odd_rows):
    texts = [t for _, t in odd_rows]
    for table, find in ((ALNUM, item_words), (NON_SPACE, words)):
        w = Words(*flat(pa.array(texts, pa.string())), table)
        got = [[w.key(i, 1).decode() for i in range(a, b)] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        assert got == [find(t) for t in texts]
    w = Words(*flat(pa.array(["a b c", "x a b c"])), NON_SPACE)
    h = window_hashes(w.hashes(), 3)
    assert h[0] == h[-1] and len(set(h.tolist())) == len(h) - 1


# 1 -----------------------------------------------------------------------------------------

ITEMS = [(1, "Alpha beta, gamma delta epsilon zeta eta theta iota kappa LAMBDA"), (2, "one"), (3, ""), (4, None), (None, "c d e"),
         (5, "one"), (11, "xi omicron pi rho sigma tau alpha beta gamma delta")]


def brute_hits(text, items, n=10):
    w = item_words(text)
    hit, ids = set(), set()
    for item, t in items:
        q = item_words(t)
        size = min(n, len(q))
        for a in range(len(q) - size + 1 if q else 0):
            for i in range(len(w) - size + 1):
                if w[i:i + size] == q[a:a + size]:
                    hit.update(range(i, i + size))
                    if item is not None:
                        ids.add(str(item))
    return len(w), len(hit), sorted(ids)


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 200])
def test_decontamination(spark, odd_rows, block_bytes):
    rows = [r for r in odd_rows if not r[1] or len(r[1]) < 5000]
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = frame(spark, rows)
    found, name = decontaminate.find(docs, bench, block_bytes=block_bytes)
    assert name != "hits" and found.columns == [*docs.columns, name]
    got = sorted((str(r.doc_id), str(r.text), r[name].n_words, r[name].n_hit, r[name]["items"]) for r in found.collect())
    assert got == sorted((str(i), str(t), *brute_hits(t, ITEMS)) for i, t in rows)


def test_decontamination_removes_spans_or_documents(spark, odd_rows):
    rows = [r for r in odd_rows if not r[1] or len(r[1]) < 5000]
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = frame(spark, rows)
    kept = decontaminate.remove_documents(docs, bench)
    assert kept.columns == docs.columns
    clean = [str(t) for _, t in rows if not brute_hits(t, ITEMS)[1]]
    assert sorted(str(r.text) for r in kept.collect()) == sorted(clean)
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(docs, bench).collect() if r.doc_id is not None}
    assert cut[6] == "" and cut[1] == " mu nu xi omicron pi rho sigma tau" and cut[3] is None and cut[10].startswith("日本語")
    assert decontaminate.remove_documents(docs, bench.limit(0)).count() == len(rows)
    assert decontaminate.remove_documents(docs.limit(0), bench).count() == 0


# 2 -----------------------------------------------------------------------------------------

def fill(sizes, weights, cap=3):
    """Targets by bisection on the level."""
    total, lo, hi = sum(sizes), 0.0, 1.0
    while sum(min(cap * s, w * hi) for s, w in zip(sizes, weights, strict=True)) < total:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(cap * s, w * mid) for s, w in zip(sizes, weights, strict=True)) < total else (lo, mid)
    return [min(cap * s, w * hi) for s, w in zip(sizes, weights, strict=True)]


def test_mixing(spark, odd_rows):
    docs = frame(spark, odd_rows)
    got = mixing.taken(mixing.mix(docs)).collect()
    assert len(got) == len(odd_rows)
    size = defaultdict(int)
    for r in docs.collect():
        size[r.source] += len(WORD.findall(r.text or ""))
    order = sorted(size, key=lambda s: (s is None, s))
    want = dict(zip(order, fill([size[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))]), strict=True))
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == size[r.source] and math.isclose(r.target, want[r.source], abs_tol=1e-6)
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in order)
    again = mixing.taken(mixing.mix(docs.repartition(5))).collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in got) == Counter((r.doc_id, r.size, r.taken) for r in again)
    # Positions: the mix's words one after the other, by finish time.
    entries = sorted((r for r in mixing.mix(docs).collect() if r.words), key=lambda r: r.position)
    at = 0
    for r in entries:
        assert r.position == at
        at += r.words
    assert [r.finish for r in entries] == sorted(r.finish for r in entries)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixed_documents_match_rows_one_to_one(spark, odd_rows):
    docs = frame(spark, odd_rows)
    out = mixing.mixed_documents(docs)
    struct = out.columns[-1]
    assert out.columns[:-1] == docs.columns and struct not in docs.columns
    want = Counter((r.doc_id, r.taken) for r in mixing.taken(mixing.mix(docs)).collect() if r.taken)
    assert Counter((r.doc_id, r[struct].taken) for r in out.collect()) == want


def test_mixed_documents_of_equal_rows_in_several_sources(spark):
    # The same null-id texts in every source, once or twice: each row gets what its own source takes.
    rows = [(None, f"text {k} " * (k % 4 + 1), s) for k in range(40) for s in ("a", "b", None) for _ in range(1 + (k == 7))]
    for docs in (spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3),
                 spark.createDataFrame(dict.fromkeys(rows), "doc_id long, text string, source string").repartition(3)):
        entries = mixing.taken(mixing.mix(docs, max_copies=2)).collect()
        want = Counter((r.source, r.key, r.taken) for r in entries if r.taken)
        assert len({(r.source, r.taken) for r in entries}) > 3
        got = mixing.mixed_documents(docs, max_copies=2).withColumn("key", mixing.shuffle_key("doc_id", "text")).collect()
        assert Counter((r.source, r.key, r.mix.taken) for r in got) == want


def test_mixing_native_running_totals_over_many_buckets(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(id % 7 as int))").alias("text"),
                                      F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"))
    got = mixing.taken(mixing.mix(docs)).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("x")).collect()
    assert all(abs(r.t - r.x) <= 1 for r in got)


# 3, 9 --------------------------------------------------------------------------------------

def labelled(spark, n=800):
    rows, labels = [], []
    for i in range(n):
        bad, toxic = i % 5 == 0, i % 7 == 0
        text = " ".join(f"{'word' if k % 3 else 'the'}{(i * 31 + k * 17) % 211}" for k in range(40 + i % 30)) + ". End."
        if bad:
            text = "".join(f"{w}%%% " for w in text.split())
        if toxic:
            text += " you " + ("vequ" + "abcdefghij"[i % 10] if i % 2 else "idiot")
        rows.append((i, text))
        if i % 4:
            labels.append((i, 0 if bad else 1, int(toxic)))
    docs = spark.createDataFrame([*rows, (None, None), (n, ""), (n + 1, None)], "doc_id long, text string")
    return docs, spark.createDataFrame([*labels, (3, None, None), (10**9, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_quality_model_separates_held_out_rows(spark):
    docs, labels = labelled(spark)
    scored, q = quality_gam.score(docs.withColumn("quality", F.lit(1)), quality_gam.train(docs, labels))
    assert q == "quality_"
    got = {r.doc_id: r[q].score for r in scored.collect()}
    assert len(got) == 803 and all(0 <= s <= 1 for s in got.values())
    held = [i for i in range(800) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.3) == (i % 5 > 0) for i in held]) > 0.97
    empty = quality_gam.train(docs, labels.limit(0))
    assert empty.score(np.zeros((1, 16)))[0] == pytest.approx(0.5)
    kept = quality_gam.keep_good(docs, labels)
    assert kept.columns == docs.columns and 600 < kept.count() < 680
    assert quality_gam.score(docs.limit(0), empty)[0].count() == 0


def test_additive_model_needs_its_pairs():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)          # nothing but an interaction
    model = quality_gam.fit(x, y)
    assert {frozenset(p[:2]) for p in model.pairs} >= {frozenset((0, 1))}
    assert ((model.score(x) > 0.5) == y).mean() > 0.9


def test_toxicity_chain(spark):
    docs, labels = labelled(spark)
    chain = toxicity.train(docs, labels)
    assert chain.names == ["insult", "demeaning", "toxic"]
    assert [len(m.chain) for m in chain.models] == [0, 1, 2]
    scored, t = toxicity.score(docs.withColumn("toxicity", F.lit(1)), chain)
    got = {r.doc_id: r[t] for r in scored.collect()}
    held = [i for i in range(800) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i].toxic >= 0.5) == (i % 7 == 0) for i in held]) > 0.97
    assert got[14].insult > 0.5 > got[7].insult                   # 7 is toxic by a word that no list has
    none = toxicity.train(docs, labels.limit(0))
    assert all(r["toxicity"].toxic < 1e-9 for r in toxicity.score(docs, none)[0].collect())
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns


# 4 -----------------------------------------------------------------------------------------

def brute_groups(rows, size, percent=80):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append(frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1)) or ({tuple(w)} if w else frozenset()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i, s in enumerate(sets):
        groups[find(i) if s else ("lone", i)].append(i)
    out = {}
    for number, g in enumerate(groups.values()):
        ids = [rows[i][0] for i in g if rows[i][0] is not None]
        for i in g:
            out[i] = (rows[i][0], len(sets[i]), min(ids) if ids else None, number)
    return out


@pytest.mark.parametrize("size", [2, 5])
def test_near_groups(spark, odd_rows, size):
    rng = np.random.default_rng(size)
    base = [f"v{k}" for k in rng.integers(0, 400, 60)]
    rows = list(odd_rows)
    for i in range(60):                                   # a chain of drifting copies, and strangers
        base = list(base)
        base[rng.integers(0, 60)] = f"n{i}"
        rows.append((100 + i, " ".join(base)))
        rows.append((200 + i, " ".join(f"u{k}" for k in rng.integers(0, 5000, 30))))
    got = near_dedup.near_groups(frame(spark, rows), shingle=size).collect()
    want = Counter(x[:3] for x in brute_groups(rows, size).values())
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_one_of_each_group_stays(spark, odd_rows):
    docs = frame(spark, odd_rows)
    kept = near_dedup.keep_one(docs, shingle=2)
    assert kept.columns == docs.columns
    rows = kept.collect()
    blank = [r for r in rows if not words(r.text)]
    assert len(blank) == sum(not words(t) for _, t in odd_rows)
    groups = brute_groups(odd_rows, 2)
    n_groups = len({number for _, n, _, number in groups.values() if n})
    assert len(rows) - len(blank) == n_groups
    assert near_dedup.keep_one(docs.limit(0)).count() == 0


def test_posterior_bound_and_parity_bound(spark):
    least = near_dedup.least_matches(0.8)
    assert least == sorted(least) and least[-1] < 0.8 * near_dedup.ROWS * near_dedup.BANDS
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 300, dtype=np.uint64)
    b = np.concatenate([a[40:], rng.integers(0, 2**63, 25, dtype=np.uint64)])
    p = near_dedup._parity(np.concatenate([a, b]), np.array([300, 285])).view(np.uint64)
    ones = sum(int(x).bit_count() for x in p[0] ^ p[1])
    assert ones <= 65 and (65 - ones) % 2 == 0


def test_components_of_paths_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 150)] + [(500, 500)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in range(100, 150)} == {100} and 500 not in got
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


# 5 -----------------------------------------------------------------------------------------

def brute_cut(rows, length):
    last = 2**63 - 1
    unique = sorted({(last if i is None else i, t or "") for i, t in rows})
    seen, out = set(), {}
    for key in unique:
        raw = key[1].encode()
        cover = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            s = raw[p:p + length]
            if s in seen:
                cover[p:p + length] = b"\1" * length
            seen.add(s)
        out[key] = (len(raw), sum(cover), len([x for x in bytes(cover).split(b"\0") if x]),
                    hashlib.sha256(bytes(c for c, m in zip(raw, cover, strict=True) if not m)).hexdigest())
    return [(i, *out[(last if i is None else i, t or "")]) for i, t in rows]


@pytest.mark.parametrize("length", [100, 40])
def test_repeated_strings(spark, odd_rows, length):
    rows = [r for r in odd_rows if r[0] != 16 and r[1] != ""]      # equal ids with other texts: see below
    rng = np.random.default_rng(3)
    pool = ["".join(rng.choice(list("abé "), 70)) for _ in range(12)]
    rows += [(1000 + i, "".join(pool[k] for k in rng.integers(0, 12, 5))) for i in range(60)]
    docs = frame(spark, rows)
    made, name = suffix_dedup.cut_repeats(docs, length=length)
    assert made.columns == [*docs.columns, name]
    got = [(r.doc_id, r[name].n_bytes, r[name].n_removed, r[name].n_spans, r[name].kept_sha256) for r in made.collect()]
    assert Counter(got) == Counter(brute_cut(rows, length))


@pytest.mark.parametrize("small", [suffix_dedup.SMALL_ROWS, 0])
def test_repeated_rows_are_one_document(spark, monkeypatch, small):
    monkeypatch.setattr(suffix_dedup, "SMALL_ROWS", small)
    alone = {c: " ".join(f"{c}{i * i}" for i in range(60)) for c in "pqrs"}      # over 100 bytes, in no other document
    line = "a line of forty bytes and some in both, "
    rows = [(1, alone["p"]), (1, alone["p"]), (None, alone["q"]), (None, alone["q"]), (2, alone["r"] + line + alone["r"]),
            (3, line.join(alone["s"][k:k + 70] for k in (0, 70))), (3, line.join(alone["s"][k:k + 70] for k in (0, 70))),
            (4, alone["p"][50:250]), (5, None), (5, None), (None, "")]
    for parts in (1, 4):
        made, name = suffix_dedup.cut_repeats(frame(spark, rows).repartition(parts))
        got = [(r.doc_id, r[name].n_bytes, r[name].n_removed, r[name].n_spans, r[name].kept_sha256) for r in made.collect()]
        assert Counter(got) == Counter(brute_cut(rows, 100))
    assert {r[0] for r in got if r[2]} == {2, 4}


def test_repeated_strings_leave_valid_text(spark, odd_rows):
    docs = frame(spark, odd_rows)
    out = suffix_dedup.remove_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(odd_rows)
    assert sum(r.text is None for r in out.collect()) == sum(t is None for _, t in odd_rows)
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


# 6 -----------------------------------------------------------------------------------------

def test_token_counts(spark, odd_rows):
    from tokenizers import Tokenizer

    import public_tokenizers

    tok = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    made, name = token_counts.count_tokens(frame(spark, odd_rows), "byte_bpe_50k.json", table_size=50)
    got = Counter((r.doc_id, r[name].n_bytes, r[name].n_tokens) for r in made.collect())
    assert got == Counter((i, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in odd_rows)
    assert token_counts.count_tokens(frame(spark, odd_rows).limit(0), "byte_bpe_50k.json")[0].count() == 0


def test_pieces_join_to_the_tokenizers_counts():
    encode, opens = token_counts.encoder(token_counts.resolve("byte_bpe_50k.json"))
    rng = np.random.default_rng(5)
    parts = [" ", "  ", "\n", "\t", "\x1c", "\x85", "a", "é", "1", "!", "'s", "<|endoftext|>", "Ġ", "\x00", "日本", "\r\n"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 14))) for _ in range(5000)]
    small = token_counts.PieceLengths(encode, opens, {}, cache_size=100)
    assert small.counts(texts) == [len(encode(t)) for t in texts]


# 7 -----------------------------------------------------------------------------------------

def test_fingerprints(spark, odd_rows):
    rows = [r for r in odd_rows if r[0] is not None and r[0] != 16]
    got = fingerprints.fingerprint_documents(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    text = {i: t or "" for i, t in rows}
    ids = sorted(text, reverse=True)
    nxt = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    cut = re.compile(fingerprints.PARAGRAPH)
    same = {}
    for r in got:
        a, b = text[r.doc_id], text[nxt[r.doc_id]]
        k = len(a) // 3
        e = a[:len(a) - k] + b[:k]
        u, v, w = (set(cut.split(x)) - {""} for x in (a, e, b))
        assert (r.n_chars, r.next_id, r.edited_sha256) == (len(a), nxt[r.doc_id], hashlib.sha256(e.encode()).hexdigest())
        for near, p in ((r.near_edited, v), (r.near_next, w)):
            assert near == pytest.approx(len(u & p) / len(u | p) if u | p else 1.0)
        assert same.setdefault(a, r.fingerprint) == r.fingerprint
    assert fingerprints.fingerprint_documents(frame(spark, odd_rows)).count() == len(odd_rows)      # null ids, equal ids
    assert fingerprints.fingerprint_documents(frame(spark, rows).limit(0)).count() == 0


def test_fingerprints_retry_larger(spark):
    many = [(i, "\n".join(f"line {i} {k}" for k in range(400))) for i in range(3)]
    got = fingerprints.fingerprint_documents(spark.createDataFrame(many, "doc_id long, text string"), part=2).collect()
    assert all(r.near_next == 0.0 and 0.4 < r.near_edited < 0.6 for r in got)


# 8 -----------------------------------------------------------------------------------------

def backoff(rows, order):
    """The model as dictionaries: (texts, held, n-gram counts, states' counts, back, weight)."""
    held = [zlib.crc32(("null" if i is None else str(i)).encode()) % 5 == 1 for i, _ in rows]
    texts = [["<s>", *words(t), "</s>"] for _, t in rows]
    count = Counter()
    for w, h in zip(texts, held, strict=True):
        if not h:
            count.update(tuple(w[i - k + 1: i + 1]) for i in range(1, len(w)) for k in range(1, min(order, i + 1) + 1))
    n = sum(c for g, c in count.items() if len(g) == 1)
    v = sum(len(g) == 1 for g in count)
    starts = held.count(False)
    states = {(): None}
    for g in count:
        if len(g) > 1:
            states[g[:-1]] = starts if g[:-1] == ("<s>",) else count[g[:-1]]

    def back(h):
        return language_model.STRENGTH * states[h] ** language_model.POWER

    def weight(h, w):
        if not h:
            return (count[w,] + 0.5) / (n + 0.5 * (v + 1))
        if h not in states:
            return weight(h[1:], w)
        return (count[*h, w] + back(h) * weight(h[1:], w)) / (states[h] + back(h))

    return texts, held, count, states, back, weight


def read_by_states(rows, order):
    """The automaton walked token by token: the sums of each text."""
    texts, held, count, states, back, weight = backoff(rows, order)
    n = sum(c for g, c in count.items() if len(g) == 1)

    def longest(h):
        while h not in states:
            h = h[1:]
        return h

    out = []
    for w, h in zip(texts, held, strict=True):
        state, total = longest(("<s>",) if order > 1 else ()), 0.0
        for x in w[1:]:
            while state and not count[*state, x]:
                total += math.log10(back(state) / (states[state] + back(state)))
                state = longest(state[1:])
            total += math.log10(weight(state, x))
            state = longest((*state, x)[-(order - 1):] if order > 1 else ())
        out.append((h, len(w) - 1, sum(count[x,] > 0 for x in w[1:]), n, sum(math.log10(weight((), x)) for x in w[1:]), total))
    return out


@pytest.mark.parametrize(("order", "block_bytes", "fan_bits"), [
    (1, 500, 6), (2, language_model.BLOCK_BYTES, 6), (2, 300, 1), (3, language_model.BLOCK_BYTES, 6), (3, 300, 1), (4, 2000, 2)])
def test_language_model(spark, odd_rows, order, block_bytes, fan_bits):
    rng = np.random.default_rng(order)
    rows = [*odd_rows, *((100 + i, " ".join(f"w{x}" for x in rng.zipf(1.5, 30) % 40)) for i in range(60))]
    docs = frame(spark, rows).repartition(3)
    got = language_model.score(docs, order=order, block_bytes=block_bytes, fan_bits=fan_bits).collect()
    want = Counter((i, *r[:4], round(r[4], 4), round(r[5], 4))
                   for (i, _), r in zip(rows, read_by_states(rows, order), strict=True))
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4))
                   for r in got) == want


def test_language_model_sums_to_one():
    """Over the vocabulary, the end and one unknown word, in every state of the model that the tests compare with."""
    rows = [(i, t) for i, t in enumerate(["a b a b c", "a b d", "b c a b", "c c c", "", "a"] * 2, 2)]
    _, held, count, states, _, weight = backoff(rows, 3)
    assert any(held) and not all(held) and {len(h) for h in states} == {0, 1, 2}
    words_ = [g[0] for g in count if len(g) == 1]
    for h in [*states, ("never",), ("never", "a")]:
        assert sum(weight(h, w) for w in [*words_, "unknown"]) == pytest.approx(1.0)


def test_language_model_refuses_order_zero(spark, odd_rows):
    with pytest.raises(ValueError, match="order"):
        language_model.score(frame(spark, odd_rows), order=0)


def test_language_model_of_nothing(spark, odd_rows):
    assert language_model.score(frame(spark, odd_rows).limit(0)).count() == 0


# 10 ----------------------------------------------------------------------------------------

PAGES = [(5, "http://a.example/x y", "<p>" + "é" * 80), (3, None, "<p>" + "é" * 80), (4, "http://b.example/\n", "tiny"), (1, "u", "tiny"),
         (2, "http://c.example/?q=日本", None), (6, "http://d.example", ""), (None, "http://e.example", "<p>" + "é" * 80),
         (7, "http://f.example", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9), (8, "http://g", "z" * 300_000), (7, "http://h", "z" * 300_000)]


def test_arc_to_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(arc_warc, "FILE_RECORDS", 2)             # many files, of both versions
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    arc_warc.write_arc(pages.coalesce(2), arc)
    arc_warc.convert(spark, arc, warc)
    records = arc_warc.read_warc(spark, warc, with_payload=True)
    got = {(r.page_id, r.payload_digest): r for r in records.collect()}
    assert len(got) == len(PAGES)
    first = {}
    for page, _, html in PAGES:
        raw = (html or "").encode()
        if len(raw) >= 100 and page is not None:
            first[html] = min(first.get(html, page), page)
    for page, url, html in PAGES:
        raw = (html or "").encode()
        r = got[(page, hashlib.sha256(raw).hexdigest())]
        revisit = len(raw) >= 100 and page != first[html]
        assert (r.record_type, r.payload_bytes) == ("revisit" if revisit else "response", len(raw))
        assert r.payload == (None if revisit else html or "")
        assert r.url.isascii() and not re.search(r"\s", r.url) and r.date == "2024-01-01T00:00:00Z"
    rows = {(r.page_id, r.payload_digest): r.refers_to for r in arc_warc.page_records(records).collect()}
    z = hashlib.sha256(b"z" * 300_000).hexdigest()
    assert rows[(8, z)] == 7 and rows[(7, z)] is None and rows[(None, hashlib.sha256(("<p>" + "é" * 80).encode()).hexdigest())] == 3


def test_arc_versions_and_errors(spark):
    import gzip

    for version in (1, 2):
        head = "HTTP/1.1 200 OK\r\nX-Page-Id: 9\r\n\r\n"
        raw = (arc_warc._arc_file_header(version, "f", arc_warc.DATE) + "\n"
               + arc_warc._arc_line(version, "http://x", arc_warc.DATE, "text/html", len(head) + 2, "f") + head + "hi\n").encode()
        (name, number, fields, _, payload), = arc_warc.parse_arc(gzip.compress(raw), "p")
        assert (name, number, fields["URL"], payload) == ("f", 0, "http://x", b"hi")
        with pytest.raises(ValueError, match="not"):
            list(arc_warc.parse_arc(gzip.compress(raw[:-2]), "p"))
    with pytest.raises(ValueError, match="unknown ARC version"):
        list(arc_warc.parse_arc(gzip.compress(b"filedesc://f 0.0.0.0 1 text/plain 9\n7 0 x\nURL"), "p"))


def test_no_pages(spark):
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    arc_warc.write_arc(spark.createDataFrame([], "page_id long, url string, html string"), arc)
    arc_warc.convert(spark, arc, warc)
    assert arc_warc.page_records(arc_warc.read_warc(spark, warc)).count() == 0
