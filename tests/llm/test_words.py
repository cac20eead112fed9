"""Spelling variants, language by compression and periodic runs against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import brute
from tetragrid.llm import language_id, periodic_runs, spelling

SCHEMA = "doc_id long, text string, lang string, source string, word string, n long, key long, h long, id long, runs string"


def table(spark, rows, langs=None):
    langs = langs or [None] * len(rows)
    return spark.createDataFrame([(i, t, lang, "s", "w", 1, 2, 3, 4, "r") for (i, t), lang in zip(rows, langs, strict=True)], SCHEMA)


def brute_runs(w, least=12):
    out = {}
    for p in range(1, len(w)):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j - i >= p and j - i + p >= least:
                out.setdefault((i, j + p - i), p)  # smaller periods come first
            i = max(j, i + 1)
    return sorted((a, n, p) for (a, n), p in out.items())


def lines(rng):
    for size in (0, 1, 5, 11, 12, 13, 24, 60):
        for letters in (1, 2, 3):
            yield [rng.randrange(letters) for _ in range(size)]
    for _ in range(250):
        w = []
        for _ in range(rng.randrange(1, 6)):
            base = [rng.randrange(rng.choice((2, 3, 9))) for _ in range(rng.randrange(1, 14))]
            w += (base * rng.randrange(1, 9))[: rng.randrange(1, 50)] + [rng.randrange(12) for _ in range(rng.randrange(4))]
        yield w
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 300:
        fib.append(fib[-1] + fib[-2])
    yield fib[-1]
    yield [bin(i).count("1") % 2 for i in range(300)]
    yield [7] * 200
    yield ([0] * 6 + [1]) * 30


def test_runs_equal_brute_force():
    for least in (12, 2, 5):
        for w in lines(random.Random(least)):
            assert periodic_runs.runs_of(np.array(w, np.int64), least) == brute_runs(w, least), (w, least)


def test_z_function():
    rng = random.Random(2)
    for n in (1, 2, 40, 400):
        for letters in (1, 2, 5):
            t = [rng.randrange(letters) for _ in range(n)]
            want = [0] + [next((k for k in range(n - i) if t[k] != t[i + k]), n - i) for i in range(1, n)]
            assert periodic_runs.z_function(np.array(t, np.int64)).tolist() == want


def plain_row(doc_id, text):
    words = brute.WORD.findall(text or "")
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    dropped = {i for a, m, p in runs for i in range(a + p, a + m)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    return (doc_id, len(runs), *top, runs and 1000 * top[1] // top[2] or None, hashlib.sha256("".join(f"{a},{m},{p}\n" for a, m, p in runs).encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def run_texts():
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(("a", "b", "cé", "d")) for _ in range(rng.randrange(60)))) for i in range(60)]
    rows += [(100 + i, " ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(200)))) for i in range(60)]
    return [*rows, (None, "x y z " * 9), (None, None), (3, "same id " * 10), (3, "same id " * 10), (200, ""), (201, " \n\t"), (202, "é\x0bb\x0cc\x1f d " * 4), (203, "line one is here\n" * 5), (-10, "neg " * 30)]


def test_run_query_equals_brute_force(spark):
    rows = run_texts()
    got = periodic_runs.run_digests(periodic_runs.periodic_runs(periodic_runs.planted(table(spark, rows))))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((plain_row(*r) for r in rows), key=repr)
    assert sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows) >= 5
    assert periodic_runs.run_digests(periodic_runs.periodic_runs(periodic_runs.planted(table(spark, [])))).collect() == []


def test_runs_of_long_texts(spark):
    n = 200_000
    rows = [(1, "word " * n), (2, " ".join(map(str, range(n)))), (3, ("a " * 6 + "b ") * (n // 7)), (4, "tick tock " * (n // 2) + "end")]
    got = {r.doc_id: r for r in periodic_runs.periodic_runs(table(spark, rows)).collect()}
    assert got[1].runs == [(0, n, 1)] and got[1].collapsed == "word" and got[2].runs == []
    assert got[2].collapsed == rows[1][1] and got[3].runs == [(0, n // 7 * 7, 7)] and got[4].collapsed == "tick tock end"


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_counts(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = brute.lower_ascii(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def plain_variants(n, ratio=10):
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        top = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = top if top and n[top] >= ratio * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def spelling_texts():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdeéèÀ×ÿz") for _ in range(rng.randrange(6, 13))) for _ in range(40)]
    rows = []
    for i in range(250):
        own = []
        for _ in range(40):
            w = rng.choice(words[:4]) if rng.random() < 0.6 else rng.choice(words)
            if rng.random() < 0.08:
                j = rng.randrange(len(w))
                w = rng.choice((w[:j] + w[j + 1 :], w[:j] + "q" + w[j:], w[:j] + "x" + w[j + 1 :]))
            own.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i if i % 50 else None, rng.choice((" ", ", ", "1")).join(own)))
    chain = [("chainword", 2), ("chainworda", 20), ("chainwordab", 200), ("chainwordabc", 2000)]
    rows += [(1000 + j, " ".join([w] * n)) for j, (w, n) in enumerate(chain)]
    return [*rows, (5, None), (6, ""), (7, "İstanbul İstanbul ĀĀĀĀĀĀĀĀ"), (8, "z" * 5000), (9, "z" * 5000), (9, "z" * 4999)]


def test_variants_equal_brute_force(spark):
    rows = spelling_texts()
    counts = spelling.count_words(table(spark, rows))
    want = plain_counts(rows)
    assert {r.word: r.n for r in counts.collect()} == want
    got = spelling.spelling_variants(counts)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == plain_variants(want)
    by = {r.word: r for r in got.collect()}
    assert by["chainword"].root == by["chainworda"].root == by["chainwordabc"].word and by["z" * 4999 if "z" * 4999 in by else "z" * 5000].n >= 2
    assert spelling.spelling_variants(spelling.count_words(table(spark, []))).collect() == []


def test_variants_of_dense_words(spark):
    rng = random.Random(3)
    n = {"".join(rng.choice("ab") for _ in range(rng.randrange(7, 10))): rng.choice((2, 3, 30, 300, 4000)) for _ in range(700)} | {"": 5, "é": 50, "e": 5, "ab": 900}
    rows = spark.createDataFrame([*n.items(), (None, 4)], "word string, n long")
    assert sorted(map(tuple, spelling.spelling_variants(rows).collect())) == plain_variants(n)
    with pytest.raises(ValueError):
        spelling.spelling_variants(rows, ratio=1)


SYLLABLES = {"xx": "ka lo mi tan rue sol".split(), "yy": "sch pf ung ein tz au".split(), "zz": "ção não lhe ém qu is".split()}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_language_by_compression(spark):
    rng = random.Random(4)
    langs = [rng.choice(("xx", "xx", "xx", "yy", "zz")) for _ in range(400)]
    rows = [(i, prose(rng, lang, rng.randrange(20, 200))) for i, lang in enumerate(langs)]
    odd = [(400, None), (401, ""), (402, "12 34 -- ²"), (None, prose(rng, "yy", 50)), (3, rows[3][1]), (403, prose(rng, "zz", 60_000)), (404, "İ")]
    got = language_id.language_id(table(spark, rows + odd, [*langs, "xx", None, "yy", None, "xx", None, None])).collect()
    assert len(got) == len(rows) + len(odd)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) and 0 <= r.score <= 1
    kept = [(i, lang) for i, lang in enumerate(langs) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(kept) > 50 and sum(by[i][0].lang_pred == lang for i, lang in kept) >= 0.98 * len(kept)
    assert sum(by[i][0].accepted for i, _ in kept) >= 0.95 * len(kept)
    assert [by[i][0].lang_pred for i in (400, 401, 402, None, 403)] == ["und", "und", "und", "yy", "zz"]
    assert by[404][0].lang_pred in SYLLABLES and by[3][0].lang_pred == by[3][1].lang_pred


def test_mixed_text_is_not_accepted(spark):
    rng = random.Random(6)
    learned = language_id.learn(table(spark, [(i, prose(rng, lang, 90)) for i, lang in enumerate(["xx", "yy"] * 60)], ["xx", "yy"] * 60), id_col="doc_id", text_col="text", lang_col="lang")
    assert sorted(learned) == ["xx", "yy"] and all(len(d) <= language_id.DICTIONARY_BYTES for d in learned.values())
    judge = language_id.Judge(learned)
    assert judge.of(prose(rng, "xx", 80))[3] and judge.of("").count(None) == 0
    margins = [judge.of(prose(rng, "xx", 40) + " " + prose(rng, "yy", 40))[2] for _ in range(20)]
    assert sum(margins) / 20 < judge.of(prose(rng, "yy", 80))[2] / 2


def test_nothing_is_learned_from_held_out_rows_ids_or_sources(spark):
    rng = random.Random(7)
    rows = [(i, prose(rng, ("xx", "yy")[i % 2], 40)) for i in range(100)]
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    plain = {r.doc_id: r[2:] for r in language_id.language_id(table(spark, rows, ["xx", "yy"] * 50)).collect()}
    wrong = ["other" if i in held else ("xx", "yy")[i % 2] for i in range(100)]
    assert {r.doc_id: r[2:] for r in language_id.language_id(table(spark, rows, wrong)).collect()} == plain
    assert {r.lang_pred for r in language_id.language_id(table(spark, rows)).collect()} == {"und"}
    assert language_id.language_id(table(spark, [])).collect() == []
