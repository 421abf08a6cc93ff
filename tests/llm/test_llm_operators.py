"""Operators on training data against plain versions of their rules, and on odd input."""

import collections
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpus_catalog.llm import (
    decontaminate, html_text, lattice_lm, licenses, near_dups, packing, quality, sharding, shingles, substrings,
    token_counts,
)

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, rep long, h long, t string, line int"
WORDS = [f"w{i}" for i in range(400)]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def edited(text, seed, n):
    r, w = random.Random(seed), text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"x{r.random()}"
    return " ".join(w)


def make(spark, texts):
    """Documents with further columns whose names clash with the operators' own."""
    rows = [(i, t, "en", "s", 0, "x", 1, 2, "y", 3) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


BASE = prose(1, 120)
ODD = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "a b c d"), (6, "a b c d"), (7, BASE), (7, BASE), (None, BASE), (None, None),
    (8, BASE), (9, edited(BASE, 1, 2)), (10, prose(2, 3000) + "\n" + BASE), (11, "é 日本 🙂 " + "z" * 5000),
]


def word_list(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_set(text):
    w = word_list(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def grouped(sets, similar):
    """Smallest key reachable over similar sets, by comparing all."""
    up = {k: k for k in sets}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if similar(sets[a], sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {k: root(k) for k in keys}


def jaccard(share):
    return lambda a, b: bool(a and b) and 100 * len(a & b) >= share * len(a | b)


def corpus():
    texts = [prose(s, 80) for s in range(12)]
    rows = [(i, t) for i, t in enumerate(texts)]
    for i in range(60):
        rows.append((100 + i, edited(texts[i % 3], i, i % 9)))
    rows += [(200 + i, texts[0]) for i in range(5)]
    rows += [(300 + i, texts[4 + i % 2] + "\n" + edited(texts[9], i, i % 5) + "\n" + prose(50 + i, 60)) for i in range(12)]
    return rows


# --- 9, 4 ----------------------------------------------------------------------------


def test_near_duplicates_equal_brute_force(spark):
    rows = corpus()
    found = near_dups.near_duplicates(make(spark, rows), threshold=0.85).collect()
    sets = {i: shingle_set(t) for i, t in rows}
    wanted = grouped(sets, jaccard(85))
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == {
        i: (len(sets[i]), wanted[i], wanted[i] == i) for i, _ in rows
    }


def test_near_duplicates_odd(spark):
    found = near_dups.near_duplicates(make(spark, ODD)).collect()
    assert len(found) == len(ODD)
    by = {r.doc_id: r for r in found if r.doc_id}
    assert [by[i].n_shingles for i in (1, 2, 3, 4, 5)] == [0, 0, 0, 1, 1] and all(by[i].kept for i in (1, 2, 3, 4, 5))
    assert (by[6].component_id, by[6].kept) == (5, False)
    assert [by[i].component_id for i in (7, 8, 9, 10)] == [7, 7, 7, 10]
    assert all(r.component_id is None and r.kept for r in found if r.doc_id is None)


def plain_spans(rows, min_words=substrings.MIN_WORDS):
    """The rule on whole lists: all pairs of paragraphs compared, each text cut by itself."""
    texts = {i: word_list(t) for i, t in rows}
    sets, sizes = {}, {}
    for i, t in rows:
        _, _, value = shingles.words(np.frombuffer((t or "").encode(), np.uint8))
        begin = substrings.cuts(value, np.zeros(len(value), int)).tolist() if len(value) else []
        for n, (first, stop) in enumerate(zip(begin, [*begin[1:], len(value)])):
            if stop - first >= 5:
                sets[i, first, n] = shingle_set(" ".join(texts[i][first:stop]))
                sizes[i, first, n] = stop - first
    label = grouped(sets, jaccard(80))
    found, goes = [], sorted((i, n, first) for i, first, n in label if label[i, first, n] != (i, first, n))
    for at, (i, n, first) in enumerate(goes):
        if at and goes[at - 1][:2] == (i, n - 1):
            found[-1].append((i, first, n))
        else:
            found.append([(i, first, n)])
    spans = set()
    for span in found:
        (i, first, _), (_, last, _) = span[0], span[-1]
        a, b = label[span[0]], label[span[-1]]
        mine, begin, stop = texts[i], first, last + sizes[span[-1]]
        reach = substrings.LONGEST + substrings.REACH
        while first - begin < reach and begin and begin - first + a[1] > 0 and mine[begin - 1] == texts[a[0]][begin - first + a[1] - 1]:
            begin -= 1
        on = 0
        while on < reach and last + on < len(mine) and b[1] + on < len(texts[b[0]]) and mine[last + on] == texts[b[0]][b[1] + on]:
            on += 1
        if a[0] == i and a[1] < first:
            begin = max(begin, a[1] + 1)
        if max(stop, last + on) - begin >= min_words:
            spans.add((i, begin, max(stop, last + on) - begin, a[0], a[1]))
    return spans


def passages():
    """Texts with passages that others hold: on a line, in a line, over short lines, repeated inside one, edited, and copies."""
    r, rows = random.Random(21), [(i, prose(1000 + i, 60 + 7 * i)) for i in range(40)]
    for p in range(12):
        shared = prose(2000 + p, 50 + 3 * p).split()
        for i in r.sample(range(40), 3):
            own = rows[i][1].split()
            at = r.randrange(len(own))
            wrapped = [f"{w}\n" if p % 3 == 1 and k % 9 == 8 else f"{w} " for k, w in enumerate(shared)]
            middle = "".join(wrapped) if p % 3 else "\n" + " ".join(shared) + "\n"
            rows[i] = (i, " ".join(own[:at]) + " " + middle + " ".join(own[at:]))
    twice = prose(3000, 70)
    rows += [(50, f"{twice} x y z {twice}"), (51, "one word " * 200), (52, rows[3][1]), (53, edited(rows[4][1], 5, 4)), (54, twice)]
    return rows


def test_repeated_passages_equal_brute_force(spark):
    rows = corpus() + [(i + 10_000, t) for i, t in passages()]
    found = substrings.repeated_paragraphs(make(spark, rows)).collect()
    assert {(r.id, r["first"], r["size"], r.first_id, r.first_first) for r in found} == plain_spans(rows)
    assert len(found) == len({tuple(r) for r in found})


def runs_of_50(rows):
    """Texts of each run of 50 words."""
    seen = collections.defaultdict(set)
    for i, t in rows:
        w = word_list(t)
        for k in range(len(w) - 49):
            seen[tuple(w[k : k + 50])].add((i, k))
    return {k: v for k, v in seen.items() if len(v) > 1}


def test_planted_passages_are_removed(spark):
    """Of 300 passages of 51 to 90 words, each in three texts at any place and wrapped at random, at most a few stay."""
    r = random.Random(4)
    rows = [[i, prose(5000 + i, r.randint(20, 300)).split()] for i in range(300)]
    planted = [prose(9000 + p, r.randint(51, 90)).split() for p in range(300)]
    for shared in planted:
        for i in r.sample(range(300), 3):
            at = r.randrange(len(rows[i][1]))
            rows[i][1][at:at] = shared
    texts = [(i, "".join(x + r.choice("     \n") for x in w)) for i, w in rows]
    docs = make(spark, texts)
    left = substrings.without_repeats(docs, substrings.repeated_paragraphs(docs)).collect()
    text = {row.doc_id: f" {' '.join(word_list(row.text))} " for row in left}
    before = {i: f" {' '.join(word_list(t))} " for i, t in texts}
    # Planting one inside another breaks some.
    whole = [s for p in planted if sum((s := f" {' '.join(p)} ") in t for t in before.values()) > 1]
    caught = [sum(s in t for t in text.values()) <= 1 for s in whole]
    assert len(whole) > 200 and sum(caught) >= 0.99 * len(whole)
    assert len(runs_of_50([(i, t) for i, t in text.items()])) <= 0.01 * len(runs_of_50(texts))
    # What was removed is still somewhere, five words at a time, but for joints between paragraphs whose first copies lie in
    # different texts, which happens where one passage was planted inside another.
    kept = {g for t in text.values() for g in shingle_set(t)}
    held = {g for p in planted for g in shingle_set(" ".join(p)) if any(f" {' '.join(g)} " in t for t in before.values())}
    assert len(held - kept) <= 0.015 * len(held)


def test_paragraphs_do_not_depend_on_what_is_around():
    shared, starts = prose(1, 200), []
    for seed in range(6):
        text = prose(100 + seed, 30 + seed) + " " + shared + " " + prose(200 + seed, 25)
        _, _, value = shingles.words(np.frombuffer(text.encode(), np.uint8))
        own = substrings.cuts(value, np.zeros(len(value), int)) - 30 - seed
        starts.append([x for x in own.tolist() if substrings.REACH <= x < 200 - substrings.REACH - 2])
    assert len(starts[0]) > 8 and all(s == starts[0] for s in starts)
    joined = np.repeat([0, 1], 300)
    value = np.random.default_rng(0).integers(1, 2**63, 600, dtype=np.uint64)
    apart = [substrings.cuts(value[:300], joined[:300]), substrings.cuts(value[300:], joined[:300]) + 300]
    assert substrings.cuts(value, joined).tolist() == np.concatenate(apart).tolist()
    assert np.diff(substrings.cuts(np.ones(500, np.uint64), np.zeros(500, int))).tolist() == [substrings.LONGEST] * 10


def test_repeats_are_removed(spark):
    docs = make(spark, ODD)
    repeats = substrings.repeated_paragraphs(docs)
    left = substrings.without_repeats(docs, repeats)
    assert left.columns == docs.columns
    texts = collections.Counter((r.doc_id, r.text) for r in left.collect())
    # The first copy stays, in both rows of its id; a row without an id is left alone.
    assert texts[7, BASE] == 2 and texts[None, BASE] == 1 and texts[None, None] == 1
    assert not any(i == 8 for i, _ in texts) and texts[10, prose(2, 3000)] == 1
    assert texts[1, None] == texts[2, ""] == texts[3, " \t\n "] == 1


def test_clashing_names_of_removed_passages(spark):
    names = ["spans_id", "spans", "left_text", "id", "first", "size", "_id", "_gone", "_key", "place"]
    docs = make(spark, [(1, BASE), (2, f"{prose(8, 40)}\n{BASE}\n{prose(9, 40)}")]).drop("id").select("*", *(F.lit(n).alias(n) for n in names))
    left = substrings.without_repeats(docs, substrings.repeated_paragraphs(docs))
    assert left.columns == docs.columns and {tuple(r[n] for n in names) for r in left.collect()} == {tuple(names)}
    assert {r.doc_id: r.text for r in left.collect()} == {1: BASE, 2: f"{prose(8, 40)}\n{prose(9, 40)}"}


# --- 8 ---------------------------------------------------------------------------------


def test_leaks(spark):
    items = [(1, prose(70, 30)), (2, prose(71, 200)), (3, "too short"), (4, None), (None, prose(72, 20)), (5, prose(73, 9))]
    table = spark.createDataFrame(items, "item_id long, text string")
    rows = [
        (1, prose(1, 4000) + " " + items[0][1] + "\n" + prose(2, 3000)), (2, prose(3, 50) + " " + edited(items[1][1], 1, 4)),
        (3, items[0][1].upper()), (4, prose(4, 300)), (5, None), (6, ""), (None, items[0][1]), (7, items[5][1]), (3, items[0][1]),
        (8, items[0][1][:60]),
    ]
    found = decontaminate.leaks(make(spark, rows), table).collect()
    wanted = set()
    for i, t in rows:
        for j, q in items:
            a, b = shingle_set(t), shingle_set(q)
            if i is not None and j is not None and len(word_list(q)) >= 5 and 10 * len(a & b) >= 8 * len(b):
                wanted.add((i, j, len(a & b), len(b)))
    assert {tuple(r) for r in found} == wanted and len(found) == 4


# --- 7 -----------------------------------------------------------------------------------


def test_quality(spark):
    clean = [(i, prose(i, 200) + "\nAnd a second line here.") for i in range(400)]
    junk = [(1000 + i, re.sub(" ", "*** ", prose(i, 100))) for i in range(8)] + [(1100 + i, prose(i, 100).upper()) for i in range(8)]
    repeated = [(2000, "again and again " * 60), (2001, None), (2002, ""), (2003, prose(5, 49)), (None, prose(6, 200))]
    found = quality.quality(make(spark, clean + junk + repeated)).collect()
    kept = {r.doc_id for r in found if r.kept}
    assert kept == {i for i, _ in clean} | {None}
    by = {r.doc_id: r for r in found}
    assert [by[i].base_failed for i in (1000, 2000, 2001, 2002, 2003)] == [False, True, True, True, True]
    for i, t in clean[:20] + junk + repeated:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        three = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        often = collections.Counter(three)
        inside = {k + j for k, x in enumerate(three) if often[x] > 1 for j in range(3)}
        assert (by[i].n_words, by[i].word_chars, by[i].n_repeat_words) == (len(w), sum(map(len, w)), len(inside))


def test_quality_survives_a_third_of_junk(spark):
    clean = [(i, prose(i, 200) + "\nAnd a second line here.") for i in range(260)]
    junk = [(1000 + i, re.sub(" ", "*** ", prose(500 + i, 100))) for i in range(140)]
    found = {r.doc_id: r for r in quality.quality(make(spark, clean + junk)).collect()}
    assert not any(found[i].base_failed or found[i].kept for i, _ in junk)
    assert all(found[i].kept for i, _ in clean)


def test_quality_rejects_one_odd_statistic(spark):
    clean = [(i, prose(i, 200) + "\nAnd a second line here.") for i in range(300)]
    lines = "\n".join(f"{prose(900 + i, 10)}\nw7" for i in range(20))
    block = prose(951, 45)
    words = f"{prose(950, 110)} {block} {block}"
    once = f"{prose(952, 100)}\nThe same line.\n{prose(953, 100)}\nThe same line."
    found = {r.doc_id: r for r in quality.quality(make(spark, clean + [(1000, lines), (1001, words), (1002, once)])).collect()}
    assert not found[1000].base_failed and not found[1001].base_failed
    assert not found[1000].kept and not found[1001].kept
    assert found[1002].kept and all(found[i].kept for i, _ in clean)


# --- 1 -------------------------------------------------------------------------------------


def test_packing(spark):
    tokens = Tokenizer.from_file(BPE)
    found = packing.pack(make(spark, ODD), BPE, length=256, keep_ids=True).collect()
    wanted = collections.Counter()
    for i, t in ODD:
        ids = [*tokens.encode(t or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % 256 or 256, len(ids) + 1, 256)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
            wanted[i, n, a, b - a, np.array(ids[a:b], "<u4").tobytes()] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in found) == wanted
    assert all(r.ids_crc32 == zlib.crc32(r.ids) for r in found)
    sequences = collections.defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        ends = np.cumsum([0] + [n for _, n in sorted(places)])
        assert [o for o, _ in sorted(places)] == ends[:-1].tolist() and ends[-1] <= 256


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_plan_is_best_fit_decreasing(sizes):
    runs = packing.plan(dict(collections.Counter(sizes)), 40)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    left, bins = [], 0
    for s in sorted(sizes, reverse=True):  # plain best fit
        fit = min((x for x in left if x >= s), default=None)
        if fit is None:
            bins += 1
            left.append(40 - s)
        else:
            left.remove(fit)
            left.append(fit - s)
    ranks, length = collections.Counter(), np.array(sorted(sizes, reverse=True), np.int64)
    rank = np.array([ranks.update([s]) or ranks[s] - 1 for s in length.tolist()], np.int64)
    if sizes:
        at, offset = packing.place(runs, length, rank)
        used = collections.defaultdict(list)
        for b, o, s in zip(at.tolist(), offset.tolist(), length.tolist()):
            used[b].append((o, s))
        assert len(used) == bins
        assert sorted(40 - sum(s for _, s in u) for u in used.values()) == sorted(left)
        assert all(o == sum(s for p, s in u if p < o) for u in used.values() for o, _ in u)


@settings(max_examples=150, deadline=None)
@given(st.text())
def test_byte_encoder_equals_library(text):
    assert packing.byte_encoder(BPE)(text).tolist() == Tokenizer.from_file(BPE).encode(text, add_special_tokens=False).ids if len(
        text
    ) else True


# --- 3 ---------------------------------------------------------------------------------------


def test_spliced_counts_equal_whole():
    own, r = token_counts.Encoder(PIECES), random.Random(3)
    texts = ["a" * 3000, " " * 2000, "日本語" * 500, "x \n\t" * 500, "🙂é" * 400, "".join(r.choice("ab \n日é🙂<s>") for _ in range(4000))]
    for text in texts + [prose(1, 900)]:
        for chunk, overlap in ((64, 4), (300, 16), (1000, 64)):
            assert own.count(text, chunk, overlap) == len(own.model.encode(text))


def test_token_counts(spark):
    own = token_counts.Encoder(PIECES).model
    found = token_counts.token_counts(make(spark, ODD), PIECES, chunk=2000, overlap=32).collect()
    wanted = collections.Counter((i, len((t or "").encode()), len(own.encode(t or ""))) for i, t in ODD)
    assert collections.Counter(map(tuple, found)) == wanted


# --- 5 -----------------------------------------------------------------------------------------


def test_shards(spark):
    rows = [(i if i % 50 else None, prose(i % 90, 5), "en", None if i % 9 == 0 else f"s{min(i % 7, 3)}") for i in range(1003)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = sharding.shard(docs, 8, seed=4).collect()
    sizes = collections.Counter(r.shard for r in found)
    assert len(found) == 1003 and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in found if r.shard == s) == list(range(n))
    mixture = collections.Counter((r.source, r.shard) for r in found)
    for source in {r.source for r in found}:
        counts = [mixture[source, s] for s in range(8)]
        assert max(counts) - min(counts) <= 2
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in found) == collections.Counter(
        (i, len(t) + 1, zlib.crc32(t.encode())) for i, t, _, _ in rows
    )


# --- 6 -------------------------------------------------------------------------------------------


def all_segmentations(word, p):
    if not word:
        return 1.0
    return sum(p[word[:k]] * all_segmentations(word[k:], p) for k in range(1, len(word) + 1) if word[:k] in p)


def test_lattice_equals_sum_over_segmentations():
    pieces = lattice_lm.vocabulary(PIECES)
    p, logp = dict(zip(pieces.names, pieces.prior)), np.log(pieces.prior)
    words = [b"thing", b"stations", "é日".encode(), b"\xff\x00", b"q" * 90]
    found, expected = lattice_lm._each(pieces, logp, words, np.array([1, 2, 3, 4, 5]))
    for w, x in zip(words[:4], found):
        assert np.isclose(np.exp(x), all_segmentations(b" " + w, p), rtol=1e-9)
    long, counts = np.zeros(len(words)), 0
    for k, w in enumerate(words):
        long[k], more = lattice_lm.long_word(pieces, logp, b" " + w, k + 1.0)
        counts = counts + more
    assert np.allclose(found, long) and np.allclose(expected, counts)


@pytest.mark.parametrize("top", [2, 1 << 18])
def test_scores(spark, top):
    rows = [(i, prose(i % 15, 30)) for i in range(80)] + ODD
    found = lattice_lm.score(make(spark, rows), PIECES, top=top).collect()
    tokens = [[*word_list(t), None] for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    known = collections.Counter(w for x, h in zip(tokens, held) if not h for w in x)
    n, v = sum(known.values()), len(known)
    wanted = sorted(
        (i or 0, h, len(x), sum(known[w] > 0 for w in x), n, round(sum(np.log10((known[w] + 1) / (n + v + 1)) for w in x), 6))
        for (i, _), x, h in zip(rows, tokens, held)
    )
    assert sorted((r.doc_id or 0, *r[1:5], round(r.base_score, 6)) for r in found) == wanted
    assert all(r.score < 0 for r in found)


# --- 10 --------------------------------------------------------------------------------------------


def test_licenses(spark):
    rows = [
        (1, "Licensed under the GNU Lesser General Public License, version 2.1 or later."), (2, "CC BY-NC-SA 4.0; cc by cc by."),
        (3, "Copyright 2020. All rights reserved. No rights reserved"), (4, "The quick license of mitten"), (5, "Apache License 2.0"),
    ]
    by = {r.doc_id: r for r in licenses.scan(make(spark, rows + [(None, "MIT License"), (None, "MIT License"), (6, None), (7, "")])).collect()}
    assert by[1].labels == "gpl,lgpl-2.1,licensed" and by[1].base_labels == "gpl" and by[1].first_word == 5
    assert (by[2].labels, by[2].n_base, by[2].first_word, by[2].last_word) == ("cc-by,cc-by-nc-sa-4.0", 3, 0, 8)
    assert by[3].labels == "copyright,reserved,some-rights" and by[4].labels == "" and by[4].score == 0
    assert (by[5].labels, by[5].score, by[None].labels) == ("apache-2.0", 1.0, "mit")
    assert by[6].n_words == by[7].n_words == 0 and by[6].first_word is None
    assert len(licenses.rules()) > 200


# --- 2 -----------------------------------------------------------------------------------------------


def test_main_text(spark):
    p = "The quick brown fox jumps over a lazy dog while the sun shines on the hills. It is a long paragraph."
    pages = [
        (1, "u", f"<nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>{p}<p>Two&nbsp; three<br>four</article><footer>Foot &copy;</footer>"),
        (2, "u", f"<body><main><p>{p}</p><div class=comments><p>{p}</p></div></main><aside><p>{p}</p></aside><script>if(a<b)x</script></body>"),
        (3, None, None), (4, "u", ""), (None, "u", f"<div><p>{p}</p><p>{p}</p></div>"), (5, "u", "<p" * 20000), (6, "u", "<a href='" * 20000),
    ]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    by = {r.page_id: r for r in html_text.main_text(table, html_text.train(table)).collect()}
    assert by[1].text == f"A & B\n{p}\nTwo three\nfour" and by[2].text == p and by[None].text == f"{p}\n{p}"
    assert by[3].text == by[4].text == "" and by[3].n_chars == 0 and by[1].n_chars == len(by[1].text) and len(by) == 7


def test_messages_equal_enumeration():
    nodes = html_text.parse("<div><p>One two three.</p><ul><li><a href=1>x</a></li></ul></div>")
    model = html_text.fit([])
    own, n = html_text.features(nodes) @ model.weights, len(nodes)
    weight = np.zeros((n, 2))
    for labels in np.ndindex(*[2] * n):
        score = sum(own[i] for i in range(n) if labels[i]) + sum(model.pairs[labels[nodes[i].parent]][labels[i]] for i in range(1, n))
        for i in range(n):
            weight[i, labels[i]] += np.exp(score)
    assert np.allclose(model.marginals(nodes), weight[:, 1] / weight.sum(1))


# --- all ----------------------------------------------------------------------------------------------


def test_empty_tables(spark):
    docs = make(spark, [])
    items = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for frame in (
        near_dups.near_duplicates(docs), substrings.repeated_paragraphs(docs), quality.quality(docs), decontaminate.leaks(docs, items),
        packing.pack(docs, BPE), token_counts.token_counts(docs, PIECES), sharding.shard(docs, 8), lattice_lm.score(docs, PIECES),
        licenses.scan(docs), html_text.main_text(pages, html_text.train(pages)),
    ):
        assert frame.count() == 0
