"""Aligned tokenizers, packed sequences and ranked search against brute force over small sets of documents."""

import hashlib
import math
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import public_tokenizers
from tessera.llm import fp_tree, packing, pair_bitmaps

BYTE, PIECE, WORD = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))
ODD = [(80, " two  spaces "), (81, "tab\tand\nline \r\n end"), (82, "a▁b mark"), (83, "<|endoftext|> <s> <|startoftext|>x"), (84, "\x00\x1c\x85 \xa0 nul"), (85, "ﬁ Å é é İΣ ΑΣ ς"),
       (86, "x" * 5000), (87, "word " * 3000), (88, "日本語のテキスト " * 50), (89, "don't I'LL 12345 $%^ ...    x"), (90, " "), (91, "\n")]


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


# -- operator 11


@lru_cache
def libraries():
    a, b = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    a.encode_special_tokens = True
    return a, b


def aligned(rows):
    a, b = libraries()
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}
    out, links_of, documents = [], [], Counter()
    for key, text in rows:
        text = text or ""
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ids_b)]
        whole = (" " + text).encode()
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            out.append((key, 0, 0, 0, 0, ""))
            links_of.append([])
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]), np.cumsum([len(x) for x in bytes_b])
        begins_a, begins_b = ends_a - [len(x) for x in bytes_a], ends_b - [len(x) for x in bytes_b]
        cuts = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
        low, groups = 0, []
        for cut in cuts:
            inside = lambda ids, ends: ",".join(str(i) for i, e in zip(ids, ends) if low < e <= cut)  # noqa: E731, B023
            groups.append(f"{inside(ids_a, ends_a)}|{inside(ids_b, ends_b)}")
            low = cut
        links = [(x, y) for x, s, e in zip(ids_a, begins_a, ends_a) for y, t, f in zip(ids_b, begins_b, ends_b) if s < f and t < e]
        out.append((key, len(ids_a), len(ids_b), len(groups), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        links_of.append(links)
        documents.update(set(links))
    best = {}
    for (x, _), n in documents.items():
        best[x] = max(best.get(x, 0), n)
    return [(*o[:5], sum(documents[p] == best[p[0]] for p in ls), sum(documents[p] for p in ls), o[5]) for o, ls in zip(out, links_of)]


@pytest.mark.parametrize("hold", [pair_bitmaps.HOLD, 500])
def test_aligned_documents(docs_of, small, monkeypatch, hold):
    rows = [(k, x if x is None or len(x) < 4000 else x[:4000]) for k, x in small + ODD]
    monkeypatch.setattr(pair_bitmaps, "HOLD", hold)
    got = pair_bitmaps.align_documents(docs_of(rows), BYTE, PIECE).collect()
    same(map(tuple, got), aligned(rows))


def test_aligned_nothing(docs_of):
    assert pair_bitmaps.align_documents(docs_of([]), BYTE, PIECE).collect() == []
    got = pair_bitmaps.align_documents(docs_of([(1, None), (1, None)]), BYTE, PIECE).collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 0, 0, 0, 0, "")] * 2


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="abst  \n\t.,''é▁日\x1c\xa0A1<>|İɏ", max_size=40))
def test_pieces_align_as_texts_do(text):
    align = test_pieces_align_as_texts_do.align
    if not text:
        return
    facts, hashes, postings, extra = pair_bitmaps.documents(align, [text], 3)
    want = aligned([(0, text)])[0]
    assert (*(facts[0].tolist()), hashes[0]) == (*want[1:5], want[7])
    assert int(len(postings) + extra.sum()) == want[4]


test_pieces_align_as_texts_do.align = pair_bitmaps.Aligner(open(BYTE, encoding="utf-8").read(), open(PIECE, "rb").read())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 65535), st.integers(0, 300)), max_size=300))
def test_bitmaps_give_back_postings(rows):
    import pyarrow as pa
    rows = sorted({(p, d): x for p, d, x in rows}.items())
    postings = np.array([p << 16 | d for (p, d), _ in rows], np.int64)
    back = Counter()
    for plane, pairs, maps in pair_bitmaps.compress(postings, np.array([x for _, x in rows], np.uint32)):
        column = pa.array(maps, pa.binary())
        places, sizes = pair_bitmaps.places_of(column)
        assert sizes.tolist() == pair_bitmaps.popcounts(column).tolist()
        for p, d in zip(np.repeat(pairs, sizes).tolist(), places.tolist()):
            back[p, d] += 1 << max(plane, 0)
    assert back == {k: x + 1 for k, x in rows}


# -- operator 12


def check_packing(rows, got, size):
    library = Tokenizer.from_file(WORD)
    want = []
    for key, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), size)):
            part = ids[start:start + size]
            want.append((key, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    same([tuple(r)[:5] for r in got], want)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= size
    lengths = np.bincount([w[3] for w in want], minlength=size + 1)
    return len(sequences), lengths


@pytest.mark.parametrize("size", [64, 2048])
def test_packed_documents(docs_of, small, size):
    rows = small + ODD
    got = packing.pack(docs_of(rows), WORD, size=size).collect()
    n, lengths = check_packing(rows, got, size)
    assert packing.lower_bound(lengths) <= n <= sum(c for _, c in packing.best_fit(lengths))


def test_packed_nothing(docs_of):
    assert packing.pack(docs_of([]), WORD).collect() == []
    assert [tuple(r)[1:4] for r in packing.pack(docs_of([(None, None)]), WORD).collect()] == [(0, 0, 1)]


def optimum(items, size):
    best = len(items)

    def put(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= items[i] and rooms[j] not in rooms[:j]:
                put(i + 1, [*rooms[:j], rooms[j] - items[i], *rooms[j + 1:]])
        put(i + 1, [*rooms, size - items[i]])

    put(0, [])
    return best


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=11))
def test_search_against_the_optimum(items):
    items = sorted(items, reverse=True)
    counts = np.bincount(items, minlength=31).astype(np.int64)
    found = [packing.search(counts, b, 3000, 400) for b in range(4)]
    least = optimum(items, 30)
    assert packing.lower_bound(counts) <= least
    assert min(n for n, _ in found) == least
    for n, plan in found:
        got = np.zeros(31, np.int64)
        for filling, copies in plan:
            assert sum(x * t for x, t in filling) <= 30
            for x, t in filling:
                got[x] += t * copies
        assert (got == counts).all() and sum(c for _, c in plan) == n


def test_search_beats_best_fit():
    """Lengths for which best fit decreasing needs a sequence more than there must be."""
    counts = np.bincount([6, 6, 5, 5, 4, 4], minlength=16).astype(np.int64)
    counts = counts + np.bincount([7, 4, 4, 8, 7], minlength=16)
    assert min(packing.search(counts, b, 2000, 400)[0] for b in range(4)) <= sum(c for _, c in packing.best_fit(counts))
    hard = np.bincount([44, 24, 24, 22, 21, 17, 8, 8, 6, 6], minlength=61).astype(np.int64)
    assert sum(c for _, c in packing.best_fit(hard)) == 4 and min(packing.search(hard, b, 4000, 400)[0] for b in range(4)) == 3


# -- operator 13


def terms_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def ranked(docs, items, k):
    words = [(key, Counter(terms_of(x))) for key, x in docs]
    full = [c for _, c in words if c]
    n_docs, n_words = len(full), sum(c.total() for c in full)
    df = Counter(t for c in full for t in c)
    out = []
    for item, text in items:
        scores = []
        for key, c in words:
            m = 25 + 75 * c.total() * n_docs // max(n_words, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms_of(text) if t in c)
            if score > 0:
                scores.append((-score, key is None, key or 0, key))
        out += [(item, i + 1, key, -s) for i, (s, _, _, key) in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return out


ITEMS = [(1, "w17 w3 w4 w4 w950"), (2, None), (3, ""), (4, "nothing_at_all"), (5, "One a b ÉTÉ été 日本"), (5, "w1 w2"), (None, "x y z w12 w12 w12 W12")]


@pytest.mark.parametrize("rows", [fp_tree.TREE_ROWS, 5])
def test_ranked_search(docs_of, small, monkeypatch, rows):
    monkeypatch.setattr(fp_tree, "TREE_ROWS", rows)
    monkeypatch.setattr(fp_tree, "LEAF", 2)
    docs = small + ODD + [(100 + i, " ".join(f"w{(i * j) % 37}" for j in range(1, 1 + i % 23))) for i in range(150)]
    items = ITEMS + [(10 + i, f"w{i} w{i + 1} w{3 * i % 37} w{i}") for i in range(30)]
    table = docs_of([])
    queries = table.sparkSession.createDataFrame([(k, x, "clash") for k, x in items], "item_id long, text string, doc_id string")
    got = fp_tree.ranked_search(docs_of(docs), queries, k=7).collect()
    same([(r.item_id, r["rank"], r.doc_id, r.score) for r in got], ranked(docs, items, 7))


def test_trees_of_equal_documents_and_of_prefixes():
    paths = [[0, 1, 2]] * 400 + [[0, 1]] * 300 + [[0]] * 50 + [[0, 1, 2, 3]] * 60 + [[0, 1, 2, 3, i] for i in range(4, 40)] + [[5]]
    sizes = np.array([len(p) for p in paths])
    ranks = np.array([r for p in paths for r in p])
    m = np.arange(len(paths)) % 90 + 30
    tree = fp_tree.build(ranks, np.ones(len(ranks), np.int64), sizes, m, 40)
    leaves = [(int(a), int(b)) for a, b, c in zip(tree.low, tree.high, tree.children) if c == (0, 0)]
    assert sorted(leaves)[0][0] == 0 and all(a[1] == b[0] for a, b in zip(sorted(leaves), sorted(leaves)[1:])) and max(b for _, b in leaves) == len(paths)
    assert max(b - a for a, b in leaves) <= fp_tree.LEAF
    found = fp_tree.descend(tree, np.array([2, 3]), np.array([5, 9]), np.zeros(40, np.int64), np.arange(len(paths)), 20, 0)
    score = [sum(w * (1_000_000_000 // (1000 + 8 * m[i])) for t, w in ((2, 5), (3, 9)) if t in p) for i, p in enumerate(paths)]
    assert sorted(((s, k) for s, k, _ in found.rows), reverse=True) == sorted(((int(s), -i) for i, s in enumerate(score)), reverse=True)[:20]


def test_ranked_search_in_blocks(docs_of, small, monkeypatch):
    monkeypatch.setattr(fp_tree, "BLOCK", 20)
    queries = docs_of([]).sparkSession.createDataFrame(ITEMS, "item_id long, text string")
    got = fp_tree.ranked_search(docs_of(small), queries, k=3).collect()
    same([(r.item_id, r["rank"], r.doc_id, r.score) for r in got], ranked(small, ITEMS, 3))


def test_ranked_search_of_nothing(docs_of, small):
    spark = docs_of([]).sparkSession
    assert fp_tree.ranked_search(docs_of([]), spark.createDataFrame(ITEMS, "item_id long, text string")).collect() == []
    assert fp_tree.ranked_search(docs_of(small), spark.createDataFrame([], "item_id long, text string")).collect() == []


def test_bounds_leave_documents_out():
    """With a selective query most documents are not scored, and the rows are those of a full scan."""
    rng = np.random.default_rng(5)
    n, vocabulary = 4000, 300
    sizes = rng.integers(5, 40, n)
    ranks = np.concatenate([np.sort(rng.choice(vocabulary, s, replace=False, p=(p := 1 / np.arange(1, vocabulary + 1)) / p.sum())) for s in sizes])
    tfs, m = rng.integers(1, 6, len(ranks)), rng.integers(30, 300, n)
    tree = fp_tree.build(ranks, tfs, sizes, m, vocabulary)
    owner = np.repeat(np.arange(n), sizes)
    dense = np.zeros(vocabulary, np.int64)
    scored = 0
    for q in range(40):
        terms = rng.choice(vocabulary, 4, replace=False)
        weights = (100 * np.log(2 + terms)).astype(np.int64)
        found = fp_tree.descend(tree, terms, weights, dense, np.arange(n), 10, 0)
        w = np.zeros(vocabulary, np.int64)
        w[terms] = weights
        scores = np.bincount(owner, w[ranks] * fp_tree.saturation(tfs, np.repeat(m, sizes)), n).astype(np.int64)
        want = sorted(((int(s), -i) for i, s in enumerate(scores) if s > 0), reverse=True)[:10]
        assert sorted(((s, k) for s, k, _ in found.rows), reverse=True) == want
        scored += found.scored
    assert scored < 0.5 * 40 * n


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="abSTst' \n\t.,1²½ªéÀɏ̱İ日\x1c\x85\xa0<|>", max_size=40) | st.text(max_size=30), min_size=1, max_size=4), st.booleans())
def test_word_ids_are_those_of_the_library(texts, restart):
    import pyarrow as pa
    from tessera.llm import words
    ids = test_word_ids_are_those_of_the_library.ids
    if restart:
        ids.restart()
    texts = [x.encode("utf-8", "ignore").decode() for x in texts]
    texts += [texts[0] + "<|endoftext|>" + texts[0], "x" * 200 + " " + texts[-1]]
    flat, n = ids(*words.utf8(pa.array(texts)))
    ends = n.cumsum()
    for x, a, b in zip(texts, ends - n, ends):
        assert flat[a:b].tolist() == ids.library.encode(x, add_special_tokens=False).ids


test_word_ids_are_those_of_the_library.ids = packing.WordIds(open(WORD, encoding="utf-8").read())
