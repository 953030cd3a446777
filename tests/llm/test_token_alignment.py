"""Token alignment against whole-text encodings by both libraries and all overlapping byte ranges."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import queries as Q
from panelspark.llm import token_alignment as A
from tests.llm.conftest import frame

JSON, MODEL = "byte_bpe_50k.json", "piece_bpe_32k.model"
ODD = ["a  b", " lead", "trail ", "trail   ", "  ", " ", "\n", "a\n\n b\tc \t d", "x▁y and more", "<|endoftext|> <s> <0x0A> <unk>",
       " a   b", "tab\t x", "I'll we've  it's", "\x00 nul \x1c x", "ﬁ ① ½", "日本語 テキスト　全角", " a   b", "é é",
       "🙂🙂 👩‍👩‍👧 x", "aaaaaaaaaa" * 50, "1234567890 " * 20, "a.\nB c\r\nD", "  \n  x", "word\n", "﻿ bom", "a​ b", "　"]


@pytest.fixture(scope="module")
def sides():
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(str(public_tokenizers.path(JSON)))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=str(public_tokenizers.path(MODEL)))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in plain}
    for k, x in enumerate(x for x in range(256) if x not in plain):
        letters[chr(256 + k)] = x

    def a_tokens(text):
        ids = a.encode(" " + text, add_special_tokens=False).ids
        return [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in ids]

    def b_tokens(text):
        out = []
        for i in b.encode(text):
            p = b.id_to_piece(i)
            out.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
        return out

    return a_tokens, b_tokens


def brute(text, sides):
    """(a ids, b ids, groups text, links) or None."""
    if not text:
        return None
    a, b = (f(text) for f in sides)
    want = (" " + text).encode()
    if b"".join(t for _, t in a) != want or b"".join(t for _, t in b) != want:
        return None

    def ranges(tokens):
        at, out = 0, []
        for i, t in tokens:
            out.append((i, at, at + len(t)))
            at += len(t)
        return out

    ra, rb = ranges(a), ranges(b)
    common = {e for _, _, e in ra} & {e for _, _, e in rb}
    groups, ga, gb, k = [], [], [], 0
    for i, _, e in ra:
        ga.append(i)
        if e in common:
            while True:
                gb.append(rb[k][0])
                k += 1
                if rb[k - 1][2] == e:
                    break
            groups.append(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}")
            ga, gb = [], []
    links, lo = [], 0
    for i, s, e in ra:
        while lo < len(rb) and rb[lo][2] <= s:
            lo += 1
        j = lo
        while j < len(rb) and rb[j][1] < e:
            links.append((i, rb[j][0]))
            j += 1
    return [i for i, _ in a], [i for i, _ in b], ";".join(groups), links


def expected(texts, sides):
    found = [brute(t, sides) for t in texts]
    count = Counter(p for f in found if f for p in f[3])
    top = Counter()
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    out = []
    for f in found:
        if not f:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = f
        out.append((len(a), len(b), groups.count(";") + 1, len(links), sum(count[p] == top[p[1]] for p in links),
                    sum(count[p] for p in links), hashlib.sha256(groups.encode()).hexdigest()))
    return out


def odd_texts(odd_rows):
    rng = random.Random(5)
    chars = "ab e'sé. \n\t   漢1.,!🙂　\x1c"
    made = ["".join(rng.choice(chars) for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    return [t for _, t in odd_rows] + ODD + made


@pytest.mark.parametrize(("table", "store"), [(A.TABLE_SIZE, A.STORE_PIECES), (40, 200), (0, 1)])
def test_counts_and_groups_match_whole_encodings(spark, odd_rows, sides, table, store):
    texts = odd_texts(odd_rows)
    docs = frame(spark, list(enumerate(texts))).withColumn("row", F.lit("x")).withColumn("alignment", F.lit(3)).repartition(3)
    scored, t = A.score_links(docs, JSON, MODEL, table_size=table, store_pieces=store, with_groups=True)
    assert t != "alignment" and scored.columns == [*docs.columns, t]
    rows = sorted(scored.collect(), key=lambda r: r["doc_id"])
    got = [tuple(r[t])[:7] for r in rows]
    want = expected(texts, sides)
    assert [(texts[i], g, w) for i, (g, w) in enumerate(zip(got, want, strict=True)) if g != w] == []
    assert sum(w[0] == 0 for w in want) >= 4
    for r, text in zip(rows, texts, strict=True):
        f = brute(text, sides)
        assert r[t]["groups"] == (f[2] if f else "")


def worked(a_ids, b_ids, a_len, b_len):
    to_a, to_b, la, lb = (x.tolist() for x in A.align(np.array(a_len), np.array(b_len)))
    groups = [(a_ids[i:j], b_ids[k:m]) for i, j, k, m in zip([0, *to_a], to_a, [0, *to_b], to_b, strict=False)]
    return groups, [(a_ids[i], b_ids[j]) for i, j in zip(la, lb, strict=True)]


def test_groups_of_a_worked_case():
    groups, links = worked([1, 2, 3], [7, 8], [2, 3, 1], [4, 2])
    assert groups == [([1, 2, 3], [7, 8])] and links == [(1, 7), (2, 7), (2, 8), (3, 8)]
    groups, links = worked([1, 2, 3], [7, 8, 9], [2, 3, 1], [2, 1, 3])
    assert groups == [([1], [7]), ([2, 3], [8, 9])] and links == [(1, 7), (2, 8), (2, 9), (3, 9)]


def test_a_vocabulary_that_crosses_spaces_is_refused(monkeypatch):
    import sentencepiece

    class Crossing:
        def __init__(self, model_file):
            pass

        def get_piece_size(self):
            return 1

        def id_to_piece(self, i):
            return "of▁the"

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Crossing)
    with pytest.raises(ValueError):
        A.sentence_piece(MODEL)


def test_empty_table_and_rows_without_tokens(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert A.score_links(docs, JSON, MODEL)[0].count() == 0
    docs = spark.createDataFrame([(1, None), (1, ""), (None, "▁")], "doc_id long, text string")
    scored, t = A.score_links(docs, JSON, MODEL)
    assert {tuple(r[t]) for r in scored.collect()} == {(0, 0, 0, 0, 0, 0, "", None)}


def test_query_on_the_smallest_tables(spark, sides):
    df = Q.op13_token_alignment(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want = [(r["doc_id"], *w) for r, w in zip(docs, expected([r["text"] for r in docs], sides), strict=True)]
    cols = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert df.columns == cols and [d for _, d in df.dtypes] == ["bigint"] * 7 + ["string"]
    assert [tuple(r) for r in df.orderBy("doc_id").collect()] == want
