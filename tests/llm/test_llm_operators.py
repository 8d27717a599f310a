"""Brute force, round trips, held-out accuracy and odd rows for the ten operators."""

from __future__ import annotations

import hashlib
import random
import re
import time
import unicodedata
from collections import Counter
from html.parser import HTMLParser
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from loomwire.llm import decontaminate, fingerprint, jaccard_join, language_id, mixing, packing, quality, token_counts, url_filter, warc
from loomwire.llm.bytescan import doc_words
from loomwire.llm.common import table
from loomwire.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one two three four"), (6, "One two THREE four"), (7, LONG), (8, LONG), (9, "Ünïcode — ‘quotes’ 東京 5 km"), (None, "no id at all here now"), (4, "One"), (10, "1234 5678 !!")]
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def odd(spark):
    """Documents with nulls, empty and very long texts, repeated rows and clashing extra columns."""
    names = "doc_id long, text string"
    return spark.createDataFrame(ODD, names).withColumns({"lang": F.lit("en"), "source": F.when(F.col("doc_id") > 5, "s").otherwise(F.lit(None)), "n_chars": F.length("text").cast("long"), "score": F.lit("clash"), "size": F.lit("clash"), "point": F.lit("clash"), "h1": F.lit("clash"), "n": F.lit("clash"), "first": F.lit("clash"), "pos": F.lit("clash"), "held_out": F.lit("clash")})


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def test_word_hashes_do_not_depend_on_batches():
    texts = ["a b  c", None, "", "Straße straße A", "x" * 3_000_000 + " y"]
    got = {r: h.tolist() for r, h in doc_words(pa.array(texts))}
    assert len(got[0]) == 3 and got[1] == got[2] == [] and got[3][0] == got[3][1] and got[3][2] == got[0][0] and len(got[4]) == 2
    assert {r: h.tolist() for r, h in doc_words(pa.array(texts[3:]))} == {0: got[3], 1: got[4]}


# 1


def test_quality_held_out(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = quality.score(docs, quality.fit(docs, labels)).join(labels, "doc_id").filter("held_out").select("quality", "predicted", "score").collect()
    assert len(got) > 80 and np.mean([r.quality == r.predicted for r in got]) > 0.95
    assert all(0 <= r.score <= 1 and (r.score >= 0.5) == (r.predicted == 1) for r in got)


def test_quality_odd_rows(spark):
    docs = odd(spark)
    labels = spark.createDataFrame([(5, 1), (7, 1), (10, 0), (2, 0), (6, None), (None, 1), (99, 1), (5, 1)], "doc_id long, quality int")
    for model in (quality.fit(docs, labels), quality.fit(docs, labels.limit(0)), quality.fit(docs.limit(0), labels)):
        got = quality.score(docs, model).collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
        by = {}
        for r in got:
            assert by.setdefault(r.text, r.score) == r.score
    assert quality.score(empty(spark), None).count() == 0
    assert quality.accepted(docs, None).columns == docs.columns and quality.accepted(empty(spark), None).count() == 0
    model = quality.fit(docs, labels)
    kept = quality.accepted(docs, model).collect()
    assert {(r.score, r.held_out) for r in kept} == {("clash", "clash")}
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(r.doc_id) for r in quality.score(docs, model).collect() if r.predicted == 1)


def test_pairs_learn_the_order():
    x = np.random.default_rng(0).normal(size=(400, 3))
    good = x[:, 0] - x[:, 1] > 0.5
    m = quality.rank(x, good, pairs=5000)
    assert np.mean((quality.strengths(x, m) >= m.threshold) == good) > 0.98
    assert quality.rank(x, np.ones(400, bool)) is None


def brute_features(t):
    b = t.encode()
    words = re.findall(rb"[^\x20\x09-\x0d]+", bytes(c + 32 if 65 <= c <= 90 else c for c in b))
    n, size = max(1, len(words)), max(1, len(b))
    of = lambda f: sum(map(f, b))
    letters = max(1, of(lambda c: 65 <= c <= 90 or 97 <= c <= 122 or c > 127))
    lines, pairs = b.split(b"\n"), list(zip(words, words[1:], strict=False))
    odd = of(lambda c: 33 <= c < 48 or 58 <= c < 65 or 91 <= c < 97 or 123 <= c < 127)
    entropy = -sum(b.count(bytes([c])) / size * np.log2(b.count(bytes([c])) / size) for c in set(b))
    out = [np.sqrt(b.count(bytes([c])) / n) for c in quality.PUNCTUATION]
    out += [np.log1p(len(b)), np.log1p(len(words)), np.log1p(size / n), of(lambda c: 65 <= c <= 90) / letters, of(lambda c: 48 <= c <= 57) / size, of(lambda c: c > 127) / size, of(lambda c: c in b" \t\n\v\f\r") / size, of(lambda c: c < 32) / size]
    out += [len(set(lines)) / len(lines), np.log1p(len(lines) / n), len(set(words)) / n, len(set(pairs)) / max(1, len(pairs)), entropy, np.sqrt(odd / size), float(len(words) < 5)]
    return out


def test_quality_scores_against_loops(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = quality.fit(docs, labels)
    some = docs.filter("doc_id % 9 = 0 AND n_chars < 20000")
    for r in quality.score(some, model).collect():
        z = np.clip((np.array(brute_features(r.text or "")) - model.mean) / model.scale, -8, 8)
        strength = sum(a * w for a, w in zip(z, model.weight, strict=True))
        assert abs(r.score - 1 / (1 + np.exp(-np.clip(4 * (strength - model.threshold) / model.spread, -500, 500)))) < 1e-6


# 2


def shingle_set(t):
    w = WORD.findall(ascii_lower(t or ""))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def brute_components(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and rows[a][0] is not None and rows[b][0] is not None and 100 * both >= 80 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    low: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d is None, d or 0, len(s), low[find(i)] if d is not None else None) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def near_copies(seed):
    """Groups of near copies at every distance around the threshold, chains, shared passages, tiny texts."""
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    texts = []
    for _ in range(8):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 20, 60, 150]))]
        for _ in range(rng.choice([1, 2, 9])):
            t = list(base)
            for _ in range(rng.randrange(4)):
                i = rng.randrange(len(t) + 1)
                t[i : i + rng.randrange(3)] = [rng.choice(vocabulary) for _ in range(rng.randrange(3))]
            texts.append(t)
            base = t if rng.random() < 0.5 else base
    texts += [passage + [rng.choice(vocabulary) for _ in range(rng.randrange(25))] for _ in range(12)]
    rng.shuffle(texts)
    return [(i * 3, " ".join(t)) for i, t in enumerate(texts)]


def components_by(spark, rows, **options):
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **options).collect()
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in got)


@pytest.mark.parametrize(("seed", "most", "leaf"), [(1, 64, 64), (2, 1, 2), (3, 3, 2)])
def test_jaccard_join_is_exact(spark, monkeypatch, seed, most, leaf):
    monkeypatch.setattr(jaccard_join, "LEAF", leaf)
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    monkeypatch.setattr(jaccard_join, "PART", 4)
    monkeypatch.setattr(jaccard_join, "PICKS", 2)
    rows = near_copies(seed) + [(1000 + (d or 0), t) if d is not None else (d, t) for d, t in ODD]
    assert components_by(spark, rows, most=most) == brute_components(rows)


def families(seed, n, edits, shared=60, own=40):
    """Families of near copies that all hold one passage, so that one region has them all."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**9)}"
    passage, texts = [word() for _ in range(shared)], []
    for size in n:
        base = passage + [word() for _ in range(own)]
        for _ in range(size):
            t = list(base)
            for _ in range(rng.randrange(edits)):
                t[rng.randrange(len(t))] = word()
            texts.append(t)
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("seed", "n", "edits", "most"), [(1, [40] * 8, 3, 10**9), (2, [300], 7, 64), (3, [130, 1, 1, 90, 2, 1], 6, 10**9)])
def test_large_open_regions_with_the_own_parameters(spark, seed, n, edits, most):
    rows = families(seed, n, edits)
    assert components_by(spark, rows, most=most) == brute_components(rows)


def test_a_dense_group_meets_its_pivots_in_a_trial_only(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 100)
    monkeypatch.setattr(jaccard_join, "PART", 40)
    against, met = jaccard_join._against, Counter()

    def counted(members, picks, docs, named, name):
        out = against(members, picks, docs, named, name)
        met[name] = max(met[name], *(r["count"] for r in out.groupBy("region").count().collect()), 0)
        return out

    monkeypatch.setattr(jaccard_join, "_against", counted)
    rows = families(4, [400], 40)
    assert components_by(spark, rows, most=10**9) == brute_components(rows)
    assert 0 < met["jaccard-trial"] < 2 * 40 * jaccard_join.PICKS and not met["jaccard-met"]  # of a region, however large


def test_parted_regions(spark):
    sizes = spark.createDataFrame([(1, 10), (2, 10), (3, 4)], "region long, of long")
    cells = spark.createDataFrame([(1, i % 2, i) for i in range(10)] + [(2, 5, i) for i in range(8)] + [(3, 6, 1), (3, 6, 2), (3, 7, 2)], "region long, cell long, point long")
    assert {r.region for r in jaccard_join._parted(sizes, cells).collect()} == {1, 3}


def test_a_forest_joins_what_its_links_join():
    x, y = np.array([1, 2, 1, 5, 7, 6, 3]), np.array([2, 3, 3, 6, 7, 5, 1])
    assert jaccard_join._forest(x, y).tolist() == [0, 1, 3]
    assert jaccard_join._forest(x[:0], y[:0]).tolist() == []


def test_voronoi_regions_hold_all_linked_pairs(spark):
    """Every two members within r of each other share a cell, unless one is a pick."""
    rng = random.Random(9)
    at = [(rng.random(), rng.random()) for _ in range(150)]
    dist = lambda i, j: min(1.0, ((at[i][0] - at[j][0]) ** 2 + (at[i][1] - at[j][1]) ** 2) ** 0.5 * 1.4)
    picks = [3, 50, 149]
    met = spark.createDataFrame([(7, i, p, dist(i, p), dist(i, p) <= 0.2) for i in range(150) for p in picks if p != i], "region long, point long, pick long, distance double, linked boolean")
    cells: dict = {}
    for r in jaccard_join._cells(met, spark.createDataFrame([(7, p) for p in picks], "region long, point long")).collect():
        cells.setdefault(r.point, set()).add(r.cell)
    assert not set(cells) & set(picks) and len(set().union(*cells.values())) > 2
    assert all(cells[i] & cells[j] for i, j in combinations(cells, 2) if dist(i, j) <= 0.2)


def stock_phrases(seed):
    """Near copies that hold common shingles only, each of which is in many texts that have a rare one besides, some without an id."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**9)}"
    phrases = [[word() for _ in range(9)] for _ in range(4)]
    carriers = [" ".join([word(), *p[i : i + 5]]) for p in phrases for i in range(5) for _ in range(40)]
    near = [" ".join(p[:k]) for p in phrases for k in (8, 9)]
    return [(i if i % 3 else None, t) for i, t in enumerate(carriers)] + [(1000 + i, t) for i, t in enumerate(near)]


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join_finds_near_copies_of_common_shingles(spark, seed):
    rows = stock_phrases(seed)
    assert components_by(spark, rows, most=3) == brute_components(rows)


@pytest.mark.parametrize("block", [5, 512])
def test_thinning_keeps_every_member_with_a_link(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng = random.Random(block)
    sets = []
    for _ in range(12):  # groups of near copies of many sizes, which all share a passage of five values
        base = list(range(5)) + [rng.randrange(5, 10**6) for _ in range(rng.choice([4, 20, 60, 200]))]
        sets += [base] + [base[: len(base) - rng.randrange(len(base) // 3)] + [rng.randrange(5, 10**6) for _ in range(rng.randrange(1 + len(base) // 6))] for _ in range(3)]
    sets += [[*range(5), *(rng.randrange(5, 10**6) for _ in range(40 + 30 * i))] for i in range(9)]  # these share the passage alone
    sets = [sorted(set(s)) for s in sets]
    windows = [s[: len(s) // 5 + 1] for s in sets]
    often = Counter(k for w in windows for k in w)
    known = spark.createDataFrame([(i, len(s), [k for k in w if often[k] > 1]) for i, (s, w) in enumerate(zip(sets, windows, strict=True))], "point long, n long, keys array<long>")
    members = spark.createDataFrame([(7, i, i, len(sets)) for i in range(len(sets))], "region long, point long, part long, of long")
    got = {r.point for r in jaccard_join._plausible(members, known).collect()}
    near = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j and 100 * len({*a} & {*b}) >= 80 * len({*a} | {*b})}
    assert near and {i for i, _ in near} <= got
    beyond = lambda n: n - n // 5 - 1
    most = lambda a, b, v, w: min(len({*v} & {*w}) + max(beyond(len(a)), beyond(len(b))), len(a), len(b))
    may = {i for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j and 9 * most(a, b, windows[i], windows[j]) >= 4 * (len(a) + len(b))}
    assert got == may
    assert len(may) < len(sets)
    one = members.withColumn("part", F.lit(1).cast("long"))
    assert jaccard_join._plausible(one, known).count() == 0


def test_jaccard_join_odd_rows(spark):
    docs = odd(spark)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join(docs).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 5), (6, 1, 5), (7, 59996, 7), (8, 59996, 7), (None, 2, None)} <= got
    assert jaccard_join.join(empty(spark)).count() == 0
    one = jaccard_join.one_each(docs)
    assert one.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in one.select("doc_id").collect()) == [0, 1, 2, 3, 4, 5, 7, 9, 10]


def test_unlike_texts_of_one_id_are_judged_each(spark):
    words = lambda k: " ".join(f"x{k}y{i}" for i in range(30))
    rows = [(4, words(1)), (4, words(2)), (4, words(1).upper()), (2, words(2) + " end"), (7, words(3)), (7, words(1)), (9, None), (9, ""), (9, words(5))]
    kept = jaccard_join.one_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted([(4, words(1).upper()), (2, words(2) + " end"), (7, words(3)), (9, ""), (9, words(5))])


# 3


def test_shift_and_agrees_with_regular_expressions():
    globs = ["*.com/**", "a*b", "*", "**", "abc", "*ab**ba*", "", "x*/y**", "*.www.example.com/en/**"] + [f"*{'q' * k}z" for k in range(1, 40)]
    rng = random.Random(4)
    texts = ["".join(rng.choice("abxy/.comqz") for _ in range(rng.randrange(14))) for _ in range(400)] + [".www.example.com/en/1", "q" * 40 + "z", "é/y", ""]
    like = [re.compile("".join({"**": ".*", "*": "[^/]*"}.get(p, re.escape(p)) for p in re.split(r"(\*\*|\*)", g)), re.S) for g in globs]
    got = url_filter.ShiftAnd(globs).match([t.encode() for t in texts])
    assert url_filter.ShiftAnd(globs).words > 1
    assert got.tolist() == [[bool(r.fullmatch(t)) for r in like] for t in texts]


def test_url_filter_odd_rows(spark):
    urls = {None: ("", "", None, "allow"), "": ("", "", None, "allow"), "no scheme": ("", "", None, "allow"), "HTTP://WWW.Example.COM/en/x?y": ("www.example.com", "/en/x", "www.example.com/en/", "allow"), "http://a.example.com/en/": ("a.example.com", "/en/", "example.com/en/", "block"), "http://example.com/EN/": ("example.com", "/EN/", "com/", "allow"), "http://net/fr/": ("net", "/fr/", "net/fr/", "block"), "http://xnet/fr/": ("xnet", "/fr/", None, "allow"), "x://a.com?b://c.net/fr/": ("a.com", "", None, "allow"), "x://my-spam.org/net/fr/": ("my-spam.org", "/net/fr/", None, "block"), "x://h.org/a/b.zip?c": ("h.org", "/a/b.zip", None, "block"), "x://h.org/login": ("h.org", "/login", None, "block"), "x://h.org/logins": ("h.org", "/logins", None, "allow"), "x://h/" + "y" * 100_000: ("h", "/" + "y" * 100_000, None, "allow")}
    df = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(urls)] + [(0, None, "clash", "clash")], "page_id long, url string, rule string, _hit string")
    got = url_filter.filter_urls(df).collect()
    assert len(got) == len(urls) + 1
    assert {r.url: (r.host, r.path, r.rule, r.verdict) for r in got} == urls
    assert all(r._hit == "clash" for r in got) and url_filter.filter_urls(df.limit(0)).count() == 0


# 4


def test_language_held_out(spark):
    docs = table(spark, SF, "documents")
    got = language_id.identify(docs, language_id.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 150 and np.mean([r.lang == r.lang_pred for r in got]) > 0.97


def test_language_odd_rows(spark):
    docs = odd(spark)
    got = language_id.identify(docs, language_id.fit(docs)).collect()
    assert len(got) == len(ODD)
    assert {r.doc_id: r.lang_pred for r in got} == {1: "und", 2: "und", 3: "und", 4: "en", 5: "en", 6: "en", 7: "en", 8: "en", 9: "en", 10: "und", None: "en"}
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in language_id.identify(docs, language_id.fit(docs.withColumn("lang", F.lit(None).cast("string")))).collect()} == {"und"}
    assert language_id.identify(empty(spark), language_id.fit(empty(spark))).count() == 0


def test_languages_against_loops(spark):
    docs = table(spark, SF, "documents")
    model = language_id.fit(docs)
    some = docs.filter("doc_id % 17 = 0 AND n_chars < 5000")
    for r in language_id.identify(some, model).join(some.select("doc_id", "text"), "doc_id").collect():
        if not any(map(str.isalpha, r.text or "")):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        c = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in r.text.lower().encode() + b" "]
        counts: dict = {}
        for x, y, z in zip(c, c[1:], c[2:], strict=False):
            code = (x * 0x9E3779B1 + y * 0x85EBCA77 + z * 0xC2B2AE3D) % 2**32
            code = (((code ^ (code >> 15)) * 0x2C1B3C6D) % 2**32) >> 21
            if not x == y == 32 and code != language_id.DIM - 1:
                counts[code] = counts.get(code, 0) + 1
        weights = {k: np.log1p(n) * model.idf[k] for k, n in counts.items()}
        norm = sum(w * w for w in weights.values()) ** 0.5
        cosines = [sum(w * v[k] for k, w in weights.items()) / norm for v in model.vectors]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        assert abs(r.score - min(1, max(0, cosines[best]))) < 1e-4
        assert r.lang_pred == model.languages[model.owner[best]] or sorted(cosines)[-1] - sorted(cosines)[-2] < 1e-5


# 5


def canonical(t):
    c = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())
    return re.sub(r"[\s\x85]+", " ", c).strip(" ")


def test_fingerprints_against_brute_force(spark):
    rows = [(5, "Café  au\tlait"), (2, "CAFE\u0301 au lait "), (9, "ﬁne"), (1, "FINE"), (7, None), (8, ""), (12, "漢字𝒳 text"), (20, "unlike"), (21, "Café au lait!"), (22, LONG)]
    got = {r.doc_id: r for r in fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    order = sorted(rows)
    prints: dict = {}
    for k, (d, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        for text, f in ((t, r.fingerprint), (edited, r.edited_fingerprint)):
            assert prints.setdefault(canonical(text), f) == f
        assert r.near_edited == float(canonical(edited) == canonical(t)) and r.near_next == float(canonical(after) == canonical(t))
    assert len(set(prints.values())) == len(prints)


def test_fingerprint_bins_are_seamless(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "BIN_DOCS", 3)
    rows = [(i * i, f"text number {i} of some") for i in range(25)]
    got = {r.doc_id: r.edited_sha256 for r in fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    for k, (d, t) in enumerate(rows):
        half = len(t) // 2
        assert got[d] == hashlib.sha256((t[: len(t) - half] + rows[(k + 1) % 25][1][:half]).encode()).hexdigest()


@pytest.mark.parametrize("kind", ["long", "string"])
def test_fingerprint_bins_of_any_ids(spark, monkeypatch, kind):
    """Outliers, gaps, and ids that aren't numbers; more bounds than are compared at a time."""
    monkeypatch.setattr(fingerprint, "BIN_DOCS", 2)
    monkeypatch.setattr(fingerprint, "STEP", 4)
    monkeypatch.setattr(fingerprint, "SAMPLE", 16)
    ids = [-(2**62), 2**62, *range(1000, 1040), *(i * 10**9 for i in range(1, 6))]
    rows = sorted((i if kind == "long" else f"id-{i}", f"text number {i} of some") for i in ids)
    got = {r.doc_id: r.edited_sha256 for r in fingerprint.fingerprints(spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(4)).collect()}
    for k, (d, t) in enumerate(rows):
        half = len(t) // 2
        assert got[d] == hashlib.sha256((t[: len(t) - half] + rows[(k + 1) % len(rows)][1][:half]).encode()).hexdigest()


def test_fingerprint_bytes_are_compared(spark, monkeypatch):
    """With hashes that are all equal, only the bytes can tell texts apart."""
    monkeypatch.setattr(fingerprint, "hashes", lambda c, a, b: [F.lit(1).cast("long").alias(a), F.lit(2).cast("long").alias(b)])
    monkeypatch.setattr(fingerprint, "PART_DOCS", 2)
    rows = [(i, t) for i, t in enumerate(["a", "b", "A ", "c", "c", "b", "a"])]
    got = {r.doc_id: r for r in fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    prints = {i: r.fingerprint for i, r in got.items()}
    assert prints[0] == prints[2] == prints[6] and prints[1] == prints[5] and prints[3] == prints[4] and len(set(prints.values())) == 3
    assert [got[i].near_next for i in range(7)] == [0, 0, 0, 1, 0, 0, 1] and all(r.near_edited == (i != 2) for i, r in got.items())


def test_fingerprint_odd_rows(spark):
    got = fingerprint.fingerprints(odd(spark)).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r.fingerprint for r in got}
    assert by[1] == by[2] == by[3] and by[5] == fingerprint.fingerprints(spark.createDataFrame([(1, "ONE two three\nfour")], "doc_id long, text string")).first().fingerprint and by[7] == by[8]
    assert fingerprint.fingerprints(empty(spark)).count() == 0
    alone = fingerprint.fingerprints(spark.createDataFrame([(3, "abcd")], "doc_id long, text string")).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and alone.near_next == 1.0


# 6


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in capped]
        left, all_ = total - sum(capped.values()), sum(w[s] for s in rest)
        over = [s for s in rest if left * w[s] / all_ > 2 * sizes[s] + 1e-9]
        if not over:
            return capped | {s: left * w[s] / all_ for s in rest}
        capped |= {s: 2 * sizes[s] for s in over}


def test_mixing_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randrange(60)), rng.choices(["a", "b", "c", None, "é"], [8, 1, 1, 2, 1])[0]) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a = mixing.plan(docs, block_docs=32).collect()
    b = mixing.plan(docs.repartition(5), block_docs=32).collect()
    assert sorted(map(repr, a)) == sorted(map(repr, b))
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = brute_targets(sizes)
    for s in sizes:
        own = [r for r in a if r.source == s]
        assert own[0].source_size == sizes[s] and abs(own[0].target - want[s]) < 1e-6
        assert 0 <= want[s] - sum(r.taken for r in own) < 1
    assert all(r.taken <= 2 * r.size and (r.shard >= 0) == (r.taken_first > 0) for r in a)
    blocks = {r.shard for r in a if r.shard >= 0}
    assert len(blocks) > 10 and max(blocks) < 64


def test_quotas_are_split_exactly(spark):
    """Each node halves its blocks; a source's share of a node follows the hypergeometric law, in the mean its share of all."""
    passes = spark.createDataFrame([(s, b, p) for s, n in (("a", 60), ("b", 30), (None, 10)) for b in range(n) for p in (0, 1)], "source string, block long, pass int")
    sums: dict = {}
    for seed in range(6):
        got = mixing._quotas(passes, 3, f"s{seed}").collect()
        shards: dict = {}
        for r in got:
            shards[r.shard] = shards.get(r.shard, 0) + r.n
            sums[r.source, r.shard] = sums.get((r.source, r.shard), 0) + r.n
        assert shards == dict.fromkeys(range(8), 25)
    assert all(abs(sums["a", k] / 6 - 15) < 3.5 and abs(sums.get((None, k), 0) / 6 - 2.5) < 2 for k in range(8))
    dealt = mixing._tree(passes, 3, "s0").collect()
    want = {(r.source, r["pass"], r.shard): r.n for r in mixing._quotas(passes, 3, "s0").collect()}
    have: dict = {}
    for r in dealt:
        have[r.source, r["pass"], r.shard] = have.get((r.source, r["pass"], r.shard), 0) + 1
    assert have == want and len({(r.source, r.block, r["pass"]) for r in dealt}) == 200


def test_mixing_odd_rows(spark):
    got = mixing.plan(odd(spark)).collect()
    assert len(got) == len(ODD) and {r.size for r in got if r.doc_id in (1, 2, 3)} == {0}
    total = sum(r.size for r in got)
    assert abs(sum(r.taken for r in got) - 1.5 * total) < 2
    assert mixing.plan(empty(spark)).count() == 0
    docs = odd(spark)
    assert mixing.mixed(docs).columns == docs.columns and mixing.mixed(empty(spark)).count() == 0


def test_mix_repeats_whole_documents(spark):
    docs = spark.createDataFrame([(i, "one two three", "abc"[i % 3]) for i in range(90)], "doc_id long, text string, source string")
    took = {r.doc_id: r.taken for r in mixing.plan(docs).collect()}
    got: dict = {}
    for r in mixing.mixed(docs).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert all(abs(3 * got.get(d, 0) - n) <= 1 for d, n in took.items())


# 7


def test_warc_links_digests_and_round_trip(spark, tmp_path):
    page = '<html lang="en"><head><title>A &amp; B</title><script>x</script></head><body><p>Héllo</p><p>two  words<br>three</p><a href="/l">link</a><!-- no --></body></html>'
    pages = spark.createDataFrame([(1, "http://x/1", page, "clash"), (2, None, None, "clash"), (3, "http://x/3\r\nEvil: 1", "", "clash"), (1, "http://x/1", page, "clash")], "page_id long, url string, html string, block string")
    source = warc.responses(pages)
    made = warc.derive(source).collect()
    assert len(made) == 8
    by = {(r.page_id, r.record_type): r for r in made}
    origin = {r.page_id: r for r in source.collect()}
    for (p, kind), r in by.items():
        assert r.refers_to == origin[p].record_id and r.payload_digest == origin[p].payload_digest and r.target_uri == origin[p].target_uri
        assert r.block_digest == warc.digest(bytes(r.block)) and r.content_length == len(r.block)
        assert warc.header(r.headers, "WARC-Type") == kind and warc.header(r.headers, "Evil") is None
    assert bytes(by[1, "conversion"].block).decode() == "Héllo\ntwo words\nthree\nlink"
    m = by[1, "metadata"]
    fields = bytes(m.block).decode()
    assert warc.header(fields, "title") == "A & B" and warc.header(fields, "outlink") == "/l" and warc.header(fields, "source-http-content-type") == "text/html; charset=utf-8"
    assert warc.header(m.headers, "WARC-Concurrent-To") == by[1, "conversion"].record_id
    assert by[2, "conversion"].block == b"" and warc.header(by[2, "conversion"].headers, "WARC-Target-URI") is None
    warc.write_warc(source, str(tmp_path / "w"))
    again = warc.derive(warc.read_warc(spark, str(tmp_path / "w"))).collect()
    key = lambda r: (r.record_id, r.headers, bytes(r.block))
    assert sorted(map(key, again)) == sorted(map(key, made))
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0


def brute_plain_text(page):
    """By the standard library's own parser; pages without unclosed comments and elements."""
    out, hidden = [], []

    class Reader(HTMLParser):
        def handle_starttag(self, tag, attrs):
            if tag in warc._DROPPED:
                hidden.append(tag)
            elif tag in warc._BREAKS and not hidden:
                out.append("\n")

        def handle_startendtag(self, tag, attrs):
            if tag in warc._BREAKS and not hidden:
                out.append("\n")

        def handle_endtag(self, tag):
            if hidden and tag == hidden[-1]:
                hidden.pop()
                out.append(" " if not hidden else "")
            elif tag in warc._BREAKS and not hidden:
                out.append("\n")

        def handle_data(self, data):
            out.append("" if hidden else data)

        def handle_comment(self, data):
            out.append("" if hidden else " ")

    reader = Reader(convert_charrefs=True)
    reader.feed(page)
    reader.close()
    return re.sub(r" ?\n[ \n]*", "\n", re.sub(r"[ \t\r\f\v\xa0]+", " ", "".join(out))).strip()


def test_warc_conversions_against_a_parser(spark):
    pages = table(spark, SF, "pages").collect()
    got = {r.page_id: bytes(r.block).decode() for r in QUERIES["op7_warc_derivatives"](spark, SF).filter("record_type = 'conversion'").collect()}
    assert len(got) == len(pages) > 100
    assert [p.page_id for p in pages if got[p.page_id] != brute_plain_text(p.html or "")] == []


def test_broken_pages_cost_their_length():
    for part in ("<svg>", "<head>", "<!--", "<", "<a ", "<title>", "<title", "<html ", "<a href", "<script", "</svg   ", "<p", "<!-- <svg>"):
        began = time.perf_counter()
        page = part * 100_000
        warc.read_page(page), warc.title_and_language(page)
        assert time.perf_counter() - began < 3, part
    assert warc.plain_text("a<!--b") == "a<!--b" and warc.plain_text("a<svg>b") == "ab" and warc.plain_text("a<script>b") == "a"


def test_warc_keeps_bytes_that_are_not_utf8():
    body = "<p>caf\xe9</p>".encode("latin-1")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1\r\n\r\n" + body
    made = list(warc.derivatives(1, "response", "<urn:x>", None, warc.DATE, None, "", block))
    assert [r[7] for r in made] == [warc.digest(body)] * 2 and made[1][11].decode() == "caf\xe9"


# 8


def test_counts_agree_with_the_tokenizer(spark):
    from tokenizers.models import Unigram

    v = token_counts.Vocabulary.load()
    exact = Unigram([("<unk>", min(v.scores))] + list(zip(v.pieces, v.scores, strict=True)) + [(f"<0x{i:02X}>", min(v.scores)) for i in range(256)], 0, True)
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").orderBy("doc_id").limit(120).collect()]
    rows += [(10_000 + i, t) for i, t in enumerate(["a  b   c", " lead", "trail ", "\n\tx", "東京 🙂 é", "▁mark▁▁s", "x" * 500, "a", " ", "ab" * 200 + " c"])]
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), v).collect()}
    assert got == {d: len(exact.tokenize("▁" + t.replace(" ", "▁"))) for d, t in rows}


def test_ties_keep_the_earliest_start():
    v = token_counts.Vocabulary(["a", "aa", "aaa", "▁"], [-1.0, -2.0, -3.0, -1.0], False)
    s = token_counts.Viterbi(v)
    assert s.solve("aaa") == (-3.0, 1) and s.solve("aaaa") == (-4.0, 2) and s.solve("ab") == (-1.0 - 13.0, 2)
    rng = random.Random(1)
    for _ in range(200):
        t = "".join(rng.choice("ab▁") for _ in range(9))
        ways = [(0.0, 0)] + [None] * len(t)
        for i in range(len(t)):
            for n in (1, 2, 3):
                piece = t[i : i + n]
                score = dict(zip(v.pieces, v.scores, strict=True)).get(piece, -13.0 if n == 1 else None)
                if len(piece) == n and score is not None:
                    c = (ways[i][0] + score, ways[i][1] + 1)
                    if ways[i + n] is None or c[0] > ways[i + n][0]:
                        ways[i + n] = c
        assert s.solve(t) == ways[-1]


def test_crossing_pieces_are_solved_whole():
    v = token_counts.Vocabulary(["a", "▁", "a▁a", "▁a"], [-2.0, -2.0, -1.0, -2.0], False)
    s = token_counts.Viterbi(v)
    assert not s.by_word and s.count("a a") == (-3.0, 2)


def test_counts_of_odd_rows(spark):
    v = token_counts.Vocabulary.load()
    got = token_counts.count_tokens(odd(spark), v).collect()
    assert len(got) == len(ODD) and {r.n_tokens for r in got if r.doc_id in (1, 2)} == {0}
    assert token_counts.count_tokens(empty(spark), v).count() == 0


# 9


def test_best_fit_decreasing_is_best_fit():
    rng = random.Random(2)
    for _ in range(50):
        sizes = [rng.randrange(1, 33) for _ in range(rng.randrange(60))]
        room: list[int] = []
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            fits = [(r, k) for k, r in enumerate(room) if r >= sizes[i]]
            if fits:
                room[min(fits)[1]] -= sizes[i]
            else:
                room.append(32 - sizes[i])
        rows = packing.best_fit_decreasing(sizes, 32)
        assert sorted(i for r in rows for i in r) == list(range(len(sizes)))
        assert sorted(32 - sum(sizes[i] for i in r) for r in rows) == sorted(room)


def test_packing_round_trip(spark):
    with open(packing.RANKS, "rb") as f:
        encoder = packing.Encoder(f.read())
    whole = encoder.bpe.encode_ordinary
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").orderBy("doc_id").limit(150).collect()]
    rows += [(10_000 + i, t) for i, t in enumerate(["", None, "a\n\n b  c \u3000d\u2028e", " \x1c x\x1f\x1fy ", "it's  'll ", "\n", LONG, "x" * 3000, "東京 🙂"])]
    packed = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), length=256, window=20_000).collect()
    assert packing.unpack(packed) == {d: whole(t or "") for d, t in rows}
    assert len({r.pack_id for r in packed}) == len(packed)
    for r in packed:
        assert len(r.ids) == 512 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] <= 256 and len(r.doc_ids) == len(r.doc_offsets) == len(r.cu_seqlens) - 1
        p = packing.position_ids(r.reset_at, 256)
        assert all(p[a] == 0 and p[b - 1] == b - a - 1 for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:], strict=False))
    assert sum(r.cu_seqlens[-1] for r in packed) / (256 * len(packed)) > 0.95


def test_packing_odd_rows(spark):
    got = packing.pack(odd(spark)).collect()
    assert sum(d is None for r in got for d in r.doc_ids) >= 1
    assert sum(o == 0 for r in got for o in r.doc_offsets) == len(ODD)
    assert packing.pack(empty(spark)).count() == 0


# 10

NAME, NUMBER, UNIT = decontaminate.NAME, decontaminate.NUMBER, decontaminate.UNIT


def brute_templates(t):
    """Words and values of the plain and of the named template, by loops."""
    plain = []
    for m in regex.finditer(r"\p{Nd}[\p{Nd}.,]*|%|[\p{L}\p{M}]+|[^\p{L}\p{M}\p{Nd}]", t):
        w = m[0]
        behind = t[: m.start()]
        after_number = regex.search(r"\p{Nd}[\p{Nd}.,]* ?\Z", behind) is not None
        if regex.match(r"\p{Nd}", w):
            plain.append((NUMBER, w.rstrip(".,"), False))
        elif after_number and (w == "%" or w.lower() in decontaminate.UNITS):
            plain.append((UNIT, w.lower(), False))
        elif regex.match(r"[\p{L}\p{M}]", w):
            plain.append((w.lower(), w.lower(), regex.match(r"\p{Lu}\p{Ll}", w) is not None))
    named = [(NAME if c else w, v) for k, (w, v, c) in enumerate(plain) if not (c and k + 1 < len(plain) and plain[k + 1][2])]
    return [(w, v) for w, v, _ in plain], named


def brute_windows(form):
    words = [w for w, _ in form]
    all_ = [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []
    return {(i, g) for i, g in enumerate(all_) if set(g) - {NAME, NUMBER, UNIT}}


def brute_contaminated(docs, items):
    out = {}
    own = [(i, k, f, brute_windows(f)) for i, t in items if i is not None and t for k, f in enumerate(brute_templates(t))]
    for d, t in docs:
        if d is None or not t:
            continue
        for k, form in enumerate(brute_templates(t)):
            at: dict = {}
            for p, g in brute_windows(form):
                at.setdefault(g, []).append(p)
            for i, kind, f, w in own:
                n, got = len({g for _, g in w}), {g for _, g in w if g in at}
                if kind != k or not n or len(got) < 0.8 * n:
                    continue
                shifts: dict = {}
                for p, g in w:
                    for q in at.get(g, ()):
                        shifts.setdefault(q - p, set()).add(p)
                shift = min(shifts, key=lambda s: (-len(shifts[s]), s))
                votes: dict = {}
                for p, (word, v) in enumerate(f):
                    if word in (NAME, NUMBER, UNIT) and 0 <= p + shift < len(form) and form[p + shift][0] == word:
                        said = votes.setdefault((word, v), [])
                        said.append(form[p + shift][1])
                slots, same = sum(map(len, votes.values())), sum(max(map(v.count, v)) for v in votes.values())
                if same >= 0.8 * slots:
                    best = (len(got) / n, k == 0, n, len(got), slots, same)
                    out[d, i] = max(out.get((d, i), best), best)
    return {(d, i, *b[2:]) for (d, i), b in out.items()}


def figures(df):
    return {(r.doc_id, r.item_id, r.n_windows, r.n_found, r.n_slots, r.n_consistent) for r in df.collect()}


ITEM = "A train leaves with Anna Smith at 30 mph and after 4 hours Anna Smith has gone how many miles, if 30 of them were slow"
STARTS = "Anna has 12 apples. Bob gives Anna 5 more apples. Anna then eats 3 apples. How many apples does Anna have left now?"
WAGES = "Weng earns 12 dollars an hour. \"Weng also walked dogs\", said Lee. Weng did 50 minutes of it. How much did she earn?"
CASES = {
    1: ("Intro text here. " + ITEM + " and more text.", True),
    2: ("A train leaves with Bob Jones at 55 mph and after 7 hours Bob Jones has gone how many miles, if 55 of them were slow", True),
    3: ("A train leaves with Bob at 55 mph and after 7 days Cid has gone how many miles, if 9 of them were slow", False),
    4: ("A train leaves the town and nothing else of the question is here at all, not even a number", False),
    5: (None, False),
    6: ("", False),
    7: (LONG, False),
    8: (ITEM.upper(), True),
    9: (ITEM.lower(), True),
    10: ("a train leaves with anna smith at 55 mph and after 7 hours anna smith has gone how many miles, if 55 of them were slow", True),
}


def test_templates(spark):
    texts = [t for t, _ in CASES.values() if t and t is not LONG] + [STARTS, WAGES, "5% of 7kg, 12.5 % or 3 Days. Zoë Åberg (Émile) met H2O; 1,000. \n5\n%", "x"]
    for r in decontaminate.templates(spark.createDataFrame([(t, t) for t in texts], "t string, text string")).collect():
        plain, named = brute_templates(r.t)
        assert r.plain == [w for w, _ in plain] and r.named == [w for w, _ in named]


def test_decontamination_finds_other_parameters(spark):
    docs = spark.createDataFrame([(k, t, "clash", 1) for k, (t, _) in CASES.items()] + [(None, ITEM, "clash", 1), (1, CASES[1][0], "clash", 1)], "doc_id long, text string, item_id string, h int")
    items = spark.createDataFrame([(1, ITEM, "clash"), (2, None, "x"), (3, "", "x"), (4, "Too short", "x"), (None, ITEM, "x"), (5, "7 8 9 10 11 12", "x")], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(k, 1) for k, (_, bad) in CASES.items() if bad}
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 3, 4, 5, 6, 7]
    assert decontaminate.contaminated(docs.limit(0), items).count() == 0 and decontaminate.contaminated(docs, items.limit(0)).count() == 0


def test_decontamination_of_names_at_the_beginning_of_sentences(spark):
    other = lambda t: regex.sub(r"\d+", lambda m: str(int(m[0]) + 17), t.replace("Anna", "Mary Ann").replace("Bob", "Jim").replace("Weng", "Tamsin").replace("Lee", "Kit"))
    docs = [(k, t) for k, t in enumerate([STARTS, WAGES, other(STARTS), other(WAGES), "So: " + other(STARTS) + " Tell me.", STARTS.upper(), WAGES.lower(), "Anna has a dog. Bob has a cat."])]
    items = [(0, STARTS), (1, WAGES)]
    df = lambda rows, key: spark.createDataFrame(rows, f"{key} long, text string")
    got = figures(decontaminate.contaminated(df(docs, "doc_id"), df(items, "item_id")))
    assert {(d, i) for d, i, *_ in got} == {(0, 0), (1, 1), (2, 0), (3, 1), (4, 0), (5, 0), (6, 1)}
    assert got == brute_contaminated(docs, items)


def test_decontamination_of_long_runs(spark):
    """Runs of names, numbers and units that a recursing pattern wouldn't survive; two texts under one id."""
    runs = ["Anna " * 200_000, "12 " * 200_000, "12 km " * 100_000, "1,2." * 200_000, "a" * 1_000_000, "Zz" * 500_000, "% " * 200_000]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(runs)] + [(50, ITEM), (50, "nothing of the kind"), (51, "Anna " * 100_000 + ITEM)], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.contaminated(docs, items).collect()} == {50, 51}
    assert sorted((r.doc_id, len(r.text)) for r in decontaminate.clean(docs, items).collect()) == sorted([(k, len(t)) for k, t in enumerate(runs)] + [(50, 19)])


def test_decontamination_reads_digits_and_signs_of_all_scripts(spark):
    def ask(zero, a, b, sign):
        a, b = ("".join(chr(ord(zero) + int(c)) for c in str(n)) for n in (a, b))
        return f"{a} boxes hold {b} pens each{sign} and {a} more boxes hold {b} cups each{sign} so how many things are there"

    zeros = "0٠०０"
    docs = spark.createDataFrame([(i, ask(z, 37, 58, s)) for i, (z, s) in enumerate((z, s) for z in zeros for s in "،؟।−🙂")], "doc_id long, text string")
    items = spark.createDataFrame([(i, ask(z, 12, 4, ",")) for i, z in enumerate(zeros)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(d, i) for d in range(20) for i in range(4)}


def test_decontamination_against_brute_force(spark):
    docs, items = ([(r[0], r.text) for r in table(spark, SF, n).collect()] for n in ("documents", "benchmark"))
    got = figures(QUERIES["op10_template_decontamination"](spark, SF))
    assert len(got) > 20 and got == brute_contaminated(docs, items)


def test_decontamination_sql_on_slots(spark):
    import duckdb
    import pandas as pd

    docs = [(k, t) for k, (t, _) in CASES.items() if k != 7] + [(11, STARTS.replace("Anna", "Zoë")), (12, "٣٤ boxes hold 5% of it each، so how many more are there")]
    items = [(1, ITEM), (4, "Too short"), (5, STARTS), (6, "12 boxes hold 7 % of it each, so how many more are there")]
    c = duckdb.connect()
    c.register("d", pd.DataFrame(docs, columns=["doc_id", "text"]))
    c.register("b", pd.DataFrame(items, columns=["item_id", "text"]))
    c.sql("CREATE TABLE documents AS SELECT * FROM d")
    c.sql("CREATE TABLE benchmark AS SELECT * FROM b")
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    theirs = c.sql(decontaminate.oracle_sql())
    order = sorted(got.columns)
    assert sorted(tuple(r[n] for n in order) for r in got.collect()) == sorted(theirs.select(*order).fetchall())
    assert any(r.n_slots > 4 for r in got.collect()) and {11, 12} <= {r.doc_id for r in got.collect()}
