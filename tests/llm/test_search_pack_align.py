"""Alignment, impact search and packing against brute force, with odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from fieldloom.llm import alignment, chunks, impact_index, packing, queries

A, B, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))
SF = "/root/testdata/sf0.001"
ODD = [None, "", "", " ", "a ", "  a", "x\n\n y", "a▁b", "é é  ﬁ   　x", "<|endoftext|> <0x41> <s>", "a" * 3000, "tab\tx \t y ", " \n \n", "  a", "don't  stop ", "\x00 \x01", "日本語 テスト。 다", "é ́x", "😀 😀😀", "x\xa0 y\x85 z", "Ab <|endoftext|>c", "ÀΣ Σ they'LL 123 ½", "w " * 2600]
#: Columns named like those that the operators use inside or return.
CLASH = "doc_id long, text string, block long, pair long, term string, n long, c0 int, ids int, rank int, part int, length int, score long"


def odd(spark):
    rows = [(k if k != 3 else None, t, 1, 2, "t", 3, 4, 5, 6, 7, 8, 9) for k, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[9], rows[9]], CLASH)


def rows_by_text(df, columns):
    return sorted((repr(tuple(r[c] for c in columns)) for r in df.collect()))


# --- helpers
def test_expand_and_sums():
    assert chunks.expand(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]
    assert chunks.sums(np.array([1, 2, 3, 4]), np.array([0, 3, 0, 1])).tolist() == [0, 6, 0, 4]


def test_chunks_start_anew(monkeypatch):
    monkeypatch.setattr(chunks, "REMEMBERED", 2)
    known = chunks.Chunks(lambda ws: [[len(w)] * len(w) for w in ws])
    for lists in ([["a", "bb"], [], ["bb"]], [["ccc", "dddd"]], [["bb", "a"], ["e"]]):
        ((ids, n),) = known(pa.array(lists, pa.list_(pa.string())))
        assert ids.tolist() == [len(w) for ws in lists for w in ws for _ in w] and n.tolist() == [sum(map(len, ws)) for ws in lists]


# --- 11 alignment
def aligned(texts):
    t, s = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    t.encode_special_tokens = True
    names = {i: x for x, i in t.get_vocab().items()}
    symbol = alignment.byte_symbols()
    found, count = [], Counter()
    for text in texts:
        a, b = (t.encode(" " + text, add_special_tokens=False).ids, s.encode(text)) if text else ([], [])
        ab = [bytes(symbol[c] for c in names[i]) for i in a]
        bb = [bytes([int(s.id_to_piece(i)[3:5], 16)]) if s.is_byte(i) else s.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if text and not b"".join(ab) == b"".join(bb) == (" " + text).encode():
            a = b = ab = bb = []
        ends = [np.cumsum([len(x) for x in side]).tolist() for side in (ab, bb)]
        both, groups, at = sorted(set(ends[0]) & set(ends[1])), [], 0
        for cut in both:
            groups.append("|".join(",".join(str(i) for i, e in zip(ids, es, strict=True) if at < e <= cut) for ids, es in ((a, ends[0]), (b, ends[1]))))
            at = cut
        starts = [[0, *e[:-1]] for e in ends]
        links, j = [], 0
        for i, x in enumerate(a):
            while j < len(b) and ends[1][j] <= starts[0][i]:
                j += 1
            k = j
            while k < len(b) and starts[1][k] < ends[0][i]:
                links.append((x, b[k]))
                k += 1
        found.append((len(a), len(b), groups, links))
        count.update(links)
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    digest = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return [(na, nb, len(g), len(ls), sum(count[x] == best[x[1]] for x in ls), sum(count[x] for x in ls), digest(g)) for na, nb, g, ls in found]


@pytest.mark.parametrize("block", [alignment.BLOCK, 200])
def test_alignment(spark, block):
    df = odd(spark)
    texts = [*ODD, ODD[9], ODD[9]]
    want = sorted(repr((k, *r)) for k, r in zip([*(k if k != 3 else None for k in range(len(ODD))), 9, 9], aligned(texts), strict=True))
    got = alignment.align(df, A, B, groups=True, block=block)
    assert rows_by_text(got, ("doc_id", *alignment.RESULTS)) == want
    assert [c for c in got.columns if c not in (*alignment.RESULTS, "a_ids", "b_ids", "group_a", "group_b")] == [c for c in df.columns if c != "text"]
    row = got.where("doc_id = 14").first()
    assert (row["n"], row["pair"], row["term"]) == (3, 2, "t")
    text, t = " " + ODD[14], Tokenizer.from_file(A)
    assert row["a_ids"] == t.encode(text, add_special_tokens=False).ids and row["group_a"][-1] == row["n_a"] and row["group_b"][-1] == row["n_b"]


def test_alignment_empty(spark):
    assert alignment.align(odd(spark).where("false"), A, B).count() == 0
    assert alignment.align(odd(spark).where("text is null"), A, B).select("n_a", "count_sum", "groups_sha256").collect() == [(0, 0, "")]


def test_op11(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = sorted(repr((r["doc_id"], *x)) for r, x in zip(docs, aligned([r["text"] for r in docs]), strict=True))
    assert rows_by_text(queries.op11_alignment(spark, SF), ("doc_id", *alignment.RESULTS)) == want


# --- 12 impact search
def ranked(docs, items, k):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    texts = [(i, Counter(cut(t)), len(cut(t))) for i, t in docs]
    n_docs, terms = sum(n > 0 for *_, n in texts), sum(n for *_, n in texts)
    df = Counter(t for _, c, _ in texts for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in texts:
            m = 50 + (50 * n * n_docs) // max(terms, 1)
            scores.append((sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(cut(text)) if t in c), i))
        scores = sorted((s for s in scores if s[0] > 0), key=lambda s: (-s[0], s[1] is None, s[1] or 0))[:k]
        out += [(item, r + 1, i, s) for r, (s, i) in enumerate(scores)]
    return sorted(map(repr, out))


@pytest.mark.parametrize(("docs_", "occurrences", "items", "terms", "k"), [(8192, 10**6, 512, 1024, 50), (64, 40, 2, 3, 3)])
def test_impact_search(spark, monkeypatch, docs_, occurrences, items, terms, k):
    for name, value in (("DOCS", docs_), ("OCCURRENCES", occurrences), ("ITEMS", items), ("TERMS", terms)):
        monkeypatch.setattr(impact_index, name, value)
    rng = np.random.default_rng(3)
    texts = [" ".join(f"T{w}" for w in rng.zipf(1.4, rng.integers(0, 60)) % 90) for _ in range(300)] + ["same words here"] * 90 + ODD
    docs = [(None if i == 7 else i, t) for i, t in enumerate(texts)]
    asked = [(1, "t1 T2 t3"), (2, "same"), (3, None), (4, ""), (5, "nowhere"), (6, " ".join(f"t{i}" for i in range(80))), (None, "words t5 t5"), (7, "日本語 é")]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, block long").repartition(3)
    index = impact_index.build(df)
    got = impact_index.search(index, spark.createDataFrame(asked, "item_id long, text string"), k=k)
    # rows without an id and equal scores come last in any order, so ids of ties are compared only where they decide
    assert rows_by_text(got, ("item_id", "rank", "doc_id", "score")) == ranked(docs, asked, k)


def test_impact_search_empty(spark):
    docs, items = spark.createDataFrame([(1, None)], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert impact_index.search(impact_index.build(docs), items).count() == 0
    assert impact_index.search(impact_index.build(docs.where("false")), items).count() == 0
    some = impact_index.build(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))
    assert impact_index.search(some, items.where("false")).collect() == []
    assert [tuple(r)[:3] for r in impact_index.search(some, items).collect()] == [(1, 1, 1)]


def test_op12(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES["op12_impact_search"](spark, SF)
    names = sorted(df.columns)
    want = con.sql(f"select {', '.join(names)} from ({queries.ORACLES['op12_impact_search']})").fetchall()
    assert want and sorted(map(tuple, df.select(*names).collect())) == sorted(want)


def test_slices_add_with_carry():
    rng = np.random.default_rng(1)
    n = rng.integers(1, 60, 40)
    values = [rng.integers(0, 1 << impact_index.SLICES, k) for k in n]
    places = [np.sort(rng.choice(64, k, replace=False)).astype(np.uint16) for k in n]
    weights = rng.integers(1, 20_000, 40)
    packed, width = impact_index.sliced(np.concatenate(values), n)
    ends = np.cumsum(width)
    dense = impact_index.spread([p.tobytes() for p in places], [packed[e - w : e].tobytes() for e, w in zip(ends, width, strict=True)], n, weights, 1, 36)
    total = np.zeros((45, 1, 1), np.uint64)
    want = np.zeros(64, np.int64)
    for t in range(40):
        impact_index.add(total, (s[[t]] for s in dense), np.array([0]))
        want[places[t]] += values[t] * weights[t]
    row, place, value = impact_index.best(total, 10)
    order = sorted(range(64), key=lambda i: (-want[i], i))[:10]
    assert place.tolist() == order and value.tolist() == want[order].tolist() and not row.any()


# --- 13 packing
def check_packing(rows, texts, window, end_id=1):
    """rows: (key, start, length, ids, doc_tokens, sequence, offset); texts: key -> text, each key once."""
    t = Tokenizer.from_file(WORDS)
    by_doc, by_sequence = {}, {}
    for key, start, length, ids, total, sequence, offset in rows:
        by_doc.setdefault(key, []).append((start, length, ids, total))
        by_sequence.setdefault(sequence, []).append((offset, length))
    assert by_doc.keys() == texts.keys()
    for key, parts in by_doc.items():
        want = np.array([*t.encode(texts[key] or "", add_special_tokens=False).ids, end_id], "<u4")
        assert b"".join(p[2] for p in sorted(parts)) == want.tobytes()
        at = 0
        for start, length, ids, total in sorted(parts):
            assert (start, total, len(ids)) == (at, len(want), 4 * length) and length > 0
            at += length
    full = 0
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window and at & (at - 1) == 0
        full += at == window
    return full, len(by_sequence)


@pytest.mark.parametrize("window", [2048, 64])
def test_packing(spark, window):
    df = spark.createDataFrame([(k, t, 1, 2, 3) for k, t in enumerate(ODD)], "doc_id long, text string, part int, length int, nth int").repartition(3)
    got = packing.pack(df, WORDS, window=window)
    assert got.columns == ["doc_id", "part", "nth", *packing.RESULTS]
    check_packing([(r["doc_id"], *(r[c] for c in packing.RESULTS)) for r in got.collect()], dict(enumerate(ODD)), window)


def test_packing_odd_rows(spark):
    rows = packing.pack(odd(spark), WORDS).collect()
    assert sum(r["start"] == 0 for r in rows) == len(ODD) + 2 and {r["doc_tokens"] for r in rows if r["doc_id"] in (0, 1, 2)} == {1}
    assert packing.pack(odd(spark).where("false"), WORDS).collect() == []


def test_op13(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    df = packing.pack(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), WORDS)
    rows = df.collect()
    full, sequences = check_packing([(r["doc_id"], *(r[c] for c in packing.RESULTS)) for r in rows], docs, 2048)
    assert sequences - full <= 11
    got = {(r["doc_id"], r["start"]): (r["length"], r["ids_crc32"], r["doc_tokens"]) for r in queries.op13_packing(spark, SF).collect()}
    assert got == {(r["doc_id"], r["start"]): (r["length"], zlib.crc32(r["ids"]), r["doc_tokens"]) for r in rows}


def test_words_are_the_library_s():
    t, rng = Tokenizer.from_file(WORDS), np.random.default_rng(8)
    letters = [chr(c) for c in (*range(33, 127), *range(0x80, 0x530), 0x1E9E, 0x2019, 0x20AC, 0x3042, 0x4E2D, 0xFB01, 0x1F600)]
    words = ["".join(rng.choice(letters, rng.integers(1, 9))) for _ in range(20_000)] + ["ΣΑΣ", "İx", "e\u0301", "\u0374\u037e", "<|endoftext|>", "a<|endoftext|>b", "I'LL'S", "x\xa0y", "\x85", "½²", "'sé's", ""]
    found = packing.Words(t)
    assert found.plain and found(words) == [e.ids for e in t.encode_batch_fast(words, add_special_tokens=False)]
    assert packing.Words(Tokenizer.from_file(A)).plain is False


def test_combinations_are_all():
    want = {(a, b, c) for a in range(21) for b in range(a + 1) for c in range(b + 1) if a + b + c == 20}
    assert set(map(tuple, packing.combinations(np.arange(1, 21), 20).tolist())) == want
    assert packing.combinations(np.array([3]), 20).shape == (0, 3)


def test_repeats_are_least_squares():
    rng = np.random.default_rng(5)
    counts = rng.integers(0, 60, 25)
    counts[0] = 0
    combos = packing.combinations(np.flatnonzero(counts), 24)
    held, x = packing.repeats(combos, counts)
    a = np.zeros((25, len(combos)))
    for k in range(3):
        np.add.at(a, (combos[:, k], np.arange(len(combos))), 1.0)
    a[0] = 0
    full = np.zeros(len(combos))
    full[held] = x
    gradient = a.T @ (counts - a @ full)
    assert (x > 0).all() and np.abs(gradient[held]).max() < 1e-4 and gradient.max() < 1e-4  # the conditions of the least sum


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, (3, 50, 1, 400)[seed], 129) * (rng.random(129) < (1, 0.3, 0.05, 1)[seed])
    counts[0] = 0
    plan = packing.plan(counts, 128)
    length = np.repeat(np.arange(129), counts)
    rank = np.concatenate([np.arange(n) for n in counts]).astype(np.int64)
    order = rng.permutation(len(length))
    piece, start, n, sequence, offset = plan.place(length[order], rank[order])
    assert (np.bincount(piece, weights=n, minlength=len(order)) == length[order]).all()
    seen = {}
    for s, o, k in zip(sequence, offset, n, strict=True):
        seen.setdefault(s, []).append((o, k))
    short = 0
    for parts in seen.values():
        at = 0
        for o, k in sorted(parts):
            assert o == at
            at += k
        short += at < 128
        assert at == 128 or at & (at - 1) == 0
    assert short <= 7 and sorted(seen) == list(range(len(seen)))
