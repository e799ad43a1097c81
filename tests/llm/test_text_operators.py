"""Encoding, near-dedup, line dedup and the rules, against brute force and edge cases."""

import collections
import itertools
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge.llm import components, linededup, minhash, quality, sentencepiece
from tests.llm.helpers import ODD, docs, prose, words

sp = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def codec():
    with open(sentencepiece.DEFAULT_MODEL, "rb") as file:
        data = file.read()
    return sentencepiece.Codec(sentencepiece.Model(data)), sp.SentencePieceProcessor(model_proto=data), data


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\tabehinorst-=*.,é日🙂▁", max_size=80) | st.text(max_size=40))
def test_ids_are_the_librarys(codec, text):
    ours, theirs, _ = codec
    text = text.encode("utf-8", "ignore").decode().replace("\0", "")
    ids = ours.encode(text).tolist()
    assert ids == theirs.encode(text)
    assert ours.decode(ids) == text.replace("▁", " ")


def test_long_stretches_stay_in_a_window(codec):
    ours, theirs, _ = codec
    for text in ("ab" * 5000, "-" * 3001, "internationalization" * 300, "日本" * 2000):
        assert ours.encode(text).tolist() == theirs.encode(text)
    assert ours.widest <= 8 * ours.model.longest  # of stretches of thousands of characters


def test_unigram_reading_takes_the_best_path(codec):
    """The same vocabulary read as a unigram model: held against a full Viterbi table."""
    _, _, data = codec
    ours = sentencepiece.Codec(sentencepiece.Model(data, kind=sentencepiece.UNIGRAM))
    model = ours.model
    for seed in range(5):
        text = prose(seed, 6).replace(" ", sentencepiece.MARK)
        best = [(0.0, None)] + [None] * len(text)
        for j in range(len(text)):
            for k in range(j + 1, min(len(text), j + model.longest) + 1):
                piece = model.ids.get(text[j:k])
                value = best[j][0] + (model.scores[piece] if piece is not None else model.unseen if k == j + 1 else -1e18)
                if best[k] is None or value > best[k][0]:
                    best[k] = (value, j)
        total = sum(model.scores[p] if p >= 0 else model.unseen for _, p in ours._steps(text))
        assert total == pytest.approx(best[-1][0])


def test_encode_keeps_rows_and_replaces_names(spark):
    df = docs(spark, ODD).withColumn("ids", F.lit("old")).withColumn("_n", F.lit(1))
    out = sentencepiece.encode(df)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "_n", "ids", "n_ids"] and out.count() == len(ODD)
    assert out.filter("doc_id <= 2").agg(F.sum("n_ids")).first()[0] == 0
    query = sentencepiece.encode_query(docs(spark, ODD))
    assert query.filter("not round_trip").count() == 0
    assert sentencepiece.encode(df.limit(0)).count() == 0


def brute_components(rows):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        union = len(sets[a] | sets[b])
        if union and 100 * len(sets[a] & sets[b]) >= 75 * union:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies():
    rng = random.Random(5)
    rows = []
    for group in range(4):
        base = prose(group, 90).split()
        for _ in range(12):  # a chain: each copy changes a little of the one before
            base = list(base)
            base[rng.randrange(len(base))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows) + 10, " ".join(base), "en", "a"))
    shared = prose(99, 60)
    rows += [(200 + k, f"{shared} {prose(300 + k, 60)}", "en", "a") for k in range(30)]  # one passage, different texts
    rows += [(400, "Two words", "en", "a"), (401, "two WORDS", "en", "a"), (402, "", "en", "a"), (403, None, "en", "a"), (404, " \n", "en", "a")]
    rows += [(500 + k, rows[0][1], "en", "b") for k in range(20)]
    return rows


@pytest.mark.parametrize("few,rounds", [(4, 2), (0, 2), (0, 0)])
def test_components_are_the_brute_force_ones(spark, few, rounds):
    rows = near_copies()
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs(spark, rows), rounds=rounds, few=few).collect()}
    assert found == brute_components(rows)


@pytest.mark.parametrize("seed", range(3))
def test_ids_that_stand_for_several_texts_lose_no_link(spark, seed):
    """An id with two texts of unlike sizes, each with near copies; all rows of linked ids are one component."""
    rng = random.Random(seed)
    texts = [prose(40 + seed * 10 + k, n).split() for k, n in enumerate((60, 200, 120, 90))]
    change = lambda t: " ".join([*t[:20], f"x{rng.randrange(10**6)}", *t[21:]])
    rows = [(9, " ".join(texts[0]), "en", "a"), (9, " ".join(texts[1]), "en", "a"), (3, change(texts[0]), "en", "a"), (4, change(texts[1]), "en", "a")]
    rows += [(1, change(texts[2]), "en", "a"), (20, change(texts[2]), "en", "a"), (20, " ".join(texts[3]), "en", "b"), (21, " ".join(texts[3]), "en", "b"), (30, prose(999, 50), "en", "a")]
    rng.shuffle(rows)
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(spark, rows)).collect()}
    assert found == {9: 3, 3: 3, 4: 3, 1: 1, 20: 1, 21: 1, 30: 30}


def test_hubs_of_many_copies_and_clashing_columns(spark):
    base = prose(3, 80).split()
    rows = [(k, " ".join([*base[:k], f"y{k}", *base[k + 1 :]]), "en", "a") for k in range(80)]
    frame = docs(spark, rows).selectExpr("*", "1 as node", "2 as a", "3 as b", "4 as text_hash", "5 as root")
    assert [r.doc_id for r in minhash.keep_one(frame).collect()] == [0]
    values = spark.createDataFrame([(k, f"v{k}") for k in range(50)], "node long, v string")
    pairs = spark.createDataFrame([(k, 0) for k in range(1, 50)] + [(7, 3)], "a long, b long")
    both = {(r.a, r.b): (r.va, r.vb) for r in components.with_both(pairs, values, "v", most=4).collect()}
    assert both == {(a, b): (f"v{a}", f"v{b}") for a, b in [(k, 0) for k in range(1, 50)] + [(7, 3)]}


def test_minhash_edge_cases(spark):
    out = minhash.minhash_query(docs(spark, ODD)).collect()
    assert len(out) == len(ODD)
    found = {r.doc_id: (r.component_id, r.kept) for r in out if r.doc_id is not None}
    assert found == {1: (1, True), 2: (2, True), 3: (3, True), 4: (4, True), 5: (5, True), 6: (6, True), 7: (6, False)}
    assert minhash.minhash_query(docs(spark, ODD).limit(0)).count() == 0
    assert minhash.keep_one(docs(spark, ODD).withColumn("component_id", F.lit(1))).count() == 7


def test_circulant_estimate():
    import numpy as np

    a, b = minhash.shingles(prose(1, 2000)), None
    b = np.unique(np.concatenate([a[: len(a) * 8 // 10], minhash.shingles(prose(2, 400))]))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((minhash.signature(a) == minhash.signature(b)).mean() - true) < 0.08


def test_chain_of_links_is_one_component(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(100, 101)], "a long, b long")
    found = {r.node: r.root for r in components.components(links).collect()}
    assert found == {k: 0 for k in range(51)} | {100: 100, 101: 100}


def test_repeated_chunks_go_but_the_first(spark):
    passage = "\n".join(f"shared line number {k} of a passage" for k in range(12))
    long = prose(7, 60)
    rows = [(k, f"own start {k}\n{prose(k, 8)}\n{passage}\n{prose(50 + k, 9)}\nown end {k}", "en", "a") for k in range(4)]
    rows += [(10 + k, f"head {k}\n{long}\ntail {k}", "en", "b") for k in range(3)] + [(20, "alone\nand clean", "en", "a"), (21, None, "en", "a"), (22, "", "en", "a")]
    out = {r.doc_id: r for r in linededup.dedup(docs(spark, rows)).collect()}
    text = {i: t for i, t, *_ in rows}
    for i in (0, 10, 20, 21, 22):
        assert out[i].text == text[i] and out[i]._removed == 0
    for i in (1, 2, 3):
        left = out[i].text.split("\n")
        assert len(left) < len(text[i].split("\n")) and out[i].n_chars == len(out[i].text)
        assert [x for x in left if "shared" not in x] == [x for x in text[i].split("\n") if "shared" not in x]
    assert out[11].text == "head 1\ntail 1" and out[12].text == "head 2\ntail 2"


def brute_dedup(rows):
    """Lines removed of each (doc_id, text), from the definition: rolling hashes, pairs of lines, first occurrences."""
    import struct

    import xxhash

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    of_text = lambda t: signed(xxhash.xxh64_intdigest(t.encode(), 42))
    places = {}
    for i, text in {(i, t) for i, t in rows if t is not None}:
        lines = text.split("\n")
        h, big = [of_text(x) for x in lines], [x.count(" ") >= linededup.LONG - 1 for x in lines]
        units, start = set(), 0
        for k in range(len(lines)):
            rolling = 42
            for x in (h[k], h[max(k - 1, 0)]):
                rolling = xxhash.xxh64_intdigest(struct.pack("<q", x), rolling)
            nxt = min(k + 1, len(lines) - 1)
            if k == len(lines) - 1 or big[k] or big[nxt] or signed(rolling) % linededup.DIVISOR == 0:
                if big[k] or sum(x.strip(" ") != "" for x in lines[start : k + 1]) >= 2:
                    units.add((start, k))
                start = k + 1
        units |= {(k, k + 1) for k in range(len(lines) - 1) if lines[k].strip(" ") and lines[k + 1].strip(" ")}
        for a, b in units:
            places.setdefault("\n".join(lines[a : b + 1]), []).append((i, of_text(text), a, b, text))
    gone = {}
    for found in places.values():
        for i, _, a, b, text in sorted(found, key=lambda x: (x[0] is not None, x[0] or 0, *x[1:4]))[1:]:
            gone.setdefault((i, text), set()).update(range(a, b + 1))
    return gone


def test_line_dedup_is_the_brute_force_one_and_finds_what_repeats(spark, monkeypatch):
    monkeypatch.setattr(linededup, "HOT", 3)  # chunks with many copies in several parts
    rng = random.Random(8)
    passages = [[prose(900 + p, rng.randint(3, 12)) for _ in range(n)] for p, n in enumerate((1, 2, 2, 3, 5, 8, 12))] + [[prose(950, 70)]]
    rows = []
    for k in range(60):
        lines = [prose(k * 100 + j, rng.randint(1, 9)) if rng.random() > 0.1 else "" for j in range(rng.randint(0, 9))]
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(lines))
            lines[at:at] = rng.choice(passages)
        rows.append((k, "\n".join(lines)))
    rows += [(3, rows[3][1]), (70, None), (None, "\n".join(passages[4])), (71, "x" * 200_000 + "\n" + "y " * 100), (72, "\n" * 500)]
    out = linededup.dedup(docs(spark, [(i, t, "en", "a") for i, t in rows])).collect()
    gone = brute_dedup(rows)
    want = sorted((i is not None, i or 0, "" if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get((i, t), ()))) for i, t in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in out) == want
    # Of repeated pairs of lines, all go but the first: what is left of them is one each.
    pairs = collections.Counter(p for i, t in {(i, t) for i, _, t in want} for p in set(zip(t.split("\n"), t.split("\n")[1:])) if all(x.strip() for x in p))
    planted = [p for passage in passages for p in zip(passage, passage[1:])]
    assert len(planted) > 20 and sum(pairs[p] > 1 for p in planted) == 0


def test_chunks_are_whole_and_resist_shifts(spark):
    lines = [f"line {k} {k * k}" for k in range(200)]
    chunk = linededup._chunks(linededup.WINDOW, linededup.DIVISOR, linededup.LONG)
    df = spark.createDataFrame([("\n".join(lines),), ("\n".join(["new", *lines]),)], "text string").select(F.expr(chunk).alias("c"))
    first, second = ([x.text for x in r.c] for r in df.collect())
    assert "\n".join(first) == "\n".join(lines) and first[1:] == second[-len(first) + 1 :]


def test_line_dedup_edge_cases(spark):
    same = "a b\nc d\ne f\ng h\ni j\nk l"
    df = docs(spark, [*ODD, (30, same, "en", "a"), (30, same, "en", "a")]).withColumn("gone", F.lit(1))
    out = linededup.dedup(df)
    assert out.columns == [*df.columns, "_removed"] and out.count() == len(ODD) + 2
    assert out.filter("doc_id = 30").agg(F.sum("_removed")).first()[0] == 0  # rows alike share one decision
    assert linededup.dedup(df.limit(0)).count() == 0


def brute_counts(text):
    w, text = words(text), text or ""
    windows = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered)


def test_counts_are_the_brute_force_ones(spark):
    rng = random.Random(3)
    rows = ODD + [(100 + k, "".join(rng.choice(["a", "b", " ", " ", "\n", "\t", "#", "é", "🙂", "\x0b", " "]) for _ in range(rng.randint(0, 120))), "en", "a") for k in range(60)]
    rows += [(300, "a b c " * 50, "en", "a"), (301, prose(1, 20000), "en", "a")]
    out = quality.quality_query(docs(spark, rows)).collect()
    ours = sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out)
    assert ours == sorted((i or -1, *brute_counts(t)) for i, t, *_ in rows)
    for r in out:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_outliers_go_and_clean_prose_stays(spark):
    rows = [(k, prose(k, 200), "en", f"s{k % 2}") for k in range(120)]
    rows += [(500 + k, " | ".join(prose(k, 150).split()), "en", "s0") for k in range(8)]
    kept = {r.doc_id for r in quality.keep(docs(spark, rows)).collect()}
    assert kept == set(range(120))


def test_quality_edge_cases(spark):
    df = docs(spark, ODD).withColumn("_kept", F.lit("x"))
    assert quality.keep(df).count() == 0 and quality.keep(df).columns == df.columns
    assert quality.quality_query(docs(spark, ODD).limit(0)).count() == 0
    assert quality.chi_square_below(quality.chi_square_quantile(0.05, 4), 4) == pytest.approx(0.95)
