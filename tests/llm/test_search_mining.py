"""License scan, phrase mining and reversed search against plain Python and SQL, with odd rows."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from covercost.llm import collocations, lexical_search, license_scan

from .conftest import ODD, duck, rows

DOCS = "doc_id long, text string, lang string, source string"


def random_docs(spark, seed, n, words, length):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        text = "".join(f"{w}{e}" for w, e in zip(rng.choice(words, length), rng.choice([" ", " ", " ", " \t", ". ", "\n"], length), strict=True))
        out.append((k, text, ["en", "de", None, "und"][k % 4], "a"))
    passage = " ".join(f"p{k % 23}q{k // 7}" for k in range(60))
    return [*out, *((1000 + k, f"{words[k % 3]} {passage} {words[0]}", "en", "a") for k in range(5))]


def phrases(docs, least, top):
    """The contract of the phrase query, counted phrase by phrase."""
    f, n = {}, Counter()
    for _, text, lang, *_ in docs:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang, Counter())[tuple(w[i:i + k])] += 1
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in cand.items()):
                continue
            score, _, l, r = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("seed", "least", "top"), [(1, 3, 50), (2, 2, 2000)])
def test_phrases(spark, seed, least, top):
    docs = random_docs(spark, seed, 40, ["a", "B", "cé", "É", "d'e", "x", "y-", "ö"], 60)
    got = rows(collocations.collocations(spark, spark.createDataFrame(docs, DOCS), least, top))
    want = phrases(docs, least, top)
    assert got == want and any(r[2].startswith("p") for r in want)


def test_shared_slots_change_nothing(spark, monkeypatch):
    """With far too few slots, rare words and pairs pass the sieve; the counts stay the same."""
    docs = random_docs(spark, 5, 30, ["a", "b", "c", "d"], 40)
    monkeypatch.setattr(collocations, "LEAST_SLOTS", 1 << 3)
    monkeypatch.setattr(collocations, "MOST_SLOTS", 1 << 3)
    monkeypatch.setattr(collocations, "BLOCK", 1 << 3)
    assert rows(collocations.collocations(spark, spark.createDataFrame(docs, DOCS), 4, 100)) == phrases(docs, 4, 100)


def test_unary_paths(spark):
    """A passage that only ever stands whole is one path of its words; a node where it forks ends one."""
    same = " ".join(f"w{k}" for k in range(30))
    docs = [(k, f"{same} {'left' if k % 2 else 'right'} tail end here", "en", "a") for k in range(6)]
    levels = None
    bits = spark.sparkContext.broadcast(np.full(1 << 13, 255, np.uint8))
    grams = collocations.longest_grams(spark.createDataFrame(docs, DOCS).select("text", "lang"), bits).cache()
    levels = collocations.counts(grams)
    got = {tuple(r.words): r.n for r in collocations.paths(spark, levels[3], levels[2]).collect()}
    words = same.split()
    assert got == {tuple(words): 6, (*words[-3:], "left", "tail", "end", "here"): 3, (*words[-3:], "right", "tail", "end", "here"): 3}


def test_phrases_of_odd_rows(spark, odd, none):
    names, want = duck({"documents": odd}, collocations.oracle())
    assert rows(collocations.collocations(spark, odd).select(names)) == want and want
    assert rows(collocations.collocations(spark, none)) == []


def test_scores_past_64_bits(spark):
    big = 9 * 10**18
    got = spark.sql(f"select cast(2000000 as decimal(10,0)) * cast({big} as decimal(19,0)) div (cast({big} as decimal(19,0)) + cast({big - 1} as decimal(19,0))) s").first().s
    assert got == 2000000 * big // (2 * big - 1)


def ranked(docs, items, top):
    """The contract of the search query, document by document."""
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    split = lambda t: term.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    held = [(d, Counter(split(t))) for d, t, *_ in docs]
    held = [(d, c, c.total()) for d, c in held if c]
    n, total, out = len(held), sum(x for *_, x in held), []
    wanted = {}
    for i, t, *_ in items:
        wanted.setdefault(i, set()).update(split(t))
    for i, terms in wanted.items():
        w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in c for _, c, _ in held) + 1))) for t in terms}
        scores = [(-sum(w[t] * (1000000000 * c[t] // (1000 * c[t] + 8 * (10 + 90 * size * n // total))) for t in terms if t in c), d is None, d) for d, c, size in held]
        out += [(i, k, d, -s) for k, (s, _, d) in enumerate(sorted((x for x in scores if x[0] < 0), key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return sorted(out, key=repr)


ITEMS = [(1, "a b CÉ", 0), (2, None, 0), (3, "", 0), (4, "nowhere", 0), (5, "same words here", 0), (5, "x same", 0), (None, "word the", 0), (6, "a a a", 0)]


@pytest.mark.parametrize("cells", [1 << 21, 16])
def test_search(spark, odd, none, monkeypatch, cells):
    monkeypatch.setattr(lexical_search, "CELLS", cells)
    items = spark.createDataFrame(ITEMS, "item_id long, text string, doc_id int")
    for docs in (random_docs(spark, 3, 50, ["a", "B", "cé", "CÉ", "d'e", "x", "same"], 20), [r[:4] for r in ODD]):
        got = rows(lexical_search.search(spark, spark.createDataFrame(docs, DOCS), items))
        assert got == ranked(docs, ITEMS, 10) and got
    assert rows(lexical_search.search(spark, none, items)) == [] and rows(lexical_search.search(spark, odd, items.limit(0))) == []


def test_search_in_chunks(spark, monkeypatch):
    """Items that don't fit one index take several; the ranks are the same."""
    monkeypatch.setattr(lexical_search, "CHUNK_POSTINGS", 3)
    docs = random_docs(spark, 4, 30, ["a", "b", "cé", "x", "same"], 20)
    items = spark.createDataFrame(ITEMS, "item_id long, text string, doc_id int")
    assert rows(lexical_search.search(spark, spark.createDataFrame(docs, DOCS), items)) == ranked(docs, ITEMS, 10)


def test_terms_of_one_hash_are_told_apart(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(lexical_search, "span_hashes", lambda prefix, starts, ends: np.full(len(starts), 7, np.uint64))
    index = lexical_search.Index(pa.table({"item_id": [1, 2], "term": ["ab", "cd"]}))
    (_, _, part, _, hashes, starts, ends), = lexical_search.terms_of(pa.array(["cd xx ab cd abc"]))
    at, term = index.find(part, hashes, starts, ends)
    assert sorted(zip(at.tolist(), index.terms.take(pa.array(term)).to_pylist(), strict=True)) == [(0, "cd"), (2, "ab"), (3, "cd")]


MIT = license_scan.NOTICES[0][0]
EDITED = MIT.replace("free of charge", "without any charge").replace("restriction", "restrictions").replace("copy, modify, merge", "copy, modify and also merge")
LICENSES = [
    (1, "Released under the MIT License.", "mit", "mit", 1, 1.0), (2, "mit\tLICENSE mit license, general PUBLIC license", "gpl,mit", "gpl,mit", 3, 1.0),
    (3, "submit license, MIT-licensed, MITé license, mİt license, mit liİcense, mit licensé", "", "", 0, 0.0),
    (4, f"some words before {EDITED} and after", "", "mit", 0, None), (5, "Permission is hereby granted, free of charge, to any reader", "", "", 0, 0.0),
    (6, license_scan.NOTICES[1][0] + " x " + license_scan.NOTICES[3][0], "apache", "apache,bsd", 1, 1.0), (7, None, "", "", 0, 0.0), (8, "...", "", "", 0, 0.0),
    (9, "mit license " * 3000, "mit", "mit", 3000, 1.0), (1, "Released under the MIT License.", "mit", "mit", 1, 1.0), (None, "apache license", "apache", "apache", 1, 1.0),
    (10, license_scan.NOTICES[2][0] + "\n" + license_scan.NOTICES[2][0], "gpl", "gpl", 2, 1.0), (11, "apache mit license general license", "mit", "mit", 1, 1.0),
    (12, "general public Key general public license", "gpl", "gpl", 1, 1.0),
]


def test_licenses(spark, odd, none):
    docs = spark.createDataFrame([(i, t, 7) for i, t, *_ in LICENSES], "doc_id long, text string, label int")
    got = license_scan.scan(spark, docs)
    names, want = duck({"documents": docs}, license_scan.oracle())
    assert rows(got.select(names)) == want
    assert rows(got, ["doc_id", "base_labels", "labels", "n_base"]) == sorted(((i, b, m, n) for i, _, b, m, n, _ in LICENSES), key=repr)
    by = {r.doc_id: r for r in got.collect()}
    assert 0.6 <= by[4].score < 1 and all(by[i].score == s for i, *_, s in LICENSES if s is not None)
    assert (by[2].first_word, by[2].last_word, by[7].first_word, by[9].last_word) == (0, 4, None, 5998)
    names, want = duck({"documents": odd}, license_scan.oracle())
    assert rows(license_scan.scan(spark, odd).select(names)) == want and len(want) == len(ODD)
    assert rows(license_scan.scan(spark, none)) == []


def test_license_plan_starts_no_python(spark, odd):
    plan = license_scan.scan(spark, odd)._jdf.queryExecution().toString()
    scan = plan[plan.index("== Physical Plan =="):]
    assert "Python" not in scan and "ArrowEval" not in scan and "MapIn" not in scan and "CartesianProduct" not in scan


def test_places_are_merged_across_diagonals(spark):
    docs = spark.createDataFrame([(1, f"one two {EDITED} then {MIT}", 7)], "doc_id long, text string, place int")
    found = license_scan.places(spark, docs).where("not phrase and template >= 0").collect()
    starts = sorted((r.first_word, round(r.score, 2)) for r in found)
    assert len(starts) == 2 and starts[0][0] in range(0, 4) and starts[1][1] == 1.0
