"""Operators against brute force, exact round trips, SQL and held-out accuracy."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
import public_tokenizers
from covercost.llm import byte_bpe, decontamination, language_id, minhash_dedup, pii, quality_ranking, quality_rules, queries, suffix_dedup, toxicity, warc
from covercost.llm.base import stage, table

from .conftest import duck, rows

SMALL, MEDIUM, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1"
PIECES = st.lists(st.sampled_from(["'", "s", "t", "re", "ll", " ", "  ", "\n", "1", "é", "A", "!", "　", "ß", "中", "_", "'d", "²", "\x1c"]), max_size=25).map("".join)


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.vocabulary(), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(PIECES)
def test_pretokens(text):
    points = np.array([ord(c) for c in text], np.uint32)
    begins = byte_bpe.pretokens(points, np.array([0, len(text)])).tolist()
    text = text.replace("\x1c", "\x01")  # the Rust pattern doesn't count it as white space
    assert begins == [m.start() for m in regex.finditer(public_tokenizers.PATTERN, text)]


def test_bpe(encoding):
    rng = np.random.default_rng(3)
    texts = [None, "", "a" * 3000, "x'll 'll", *("".join(rng.choice(list("abcdefgh"), n)) for n in (70, 300, 700)), "abcabcab" * 40, "naïve 中文 \U0001F600"]
    for text, (n, ids, raw) in zip(texts, byte_bpe.Coder(byte_bpe.vocabulary()).texts(pa.array(texts)), strict=True):
        want = encoding.encode_ordinary(text or "")
        assert (n, ids.tobytes().decode(), raw.tobytes().decode()) == (len(want), " ".join(map(str, want)), text or "")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(2, 5), max_size=80))
def test_suffix_array(values):
    s = np.array([*values, 0])
    raw = bytes(s.astype(np.uint8))
    assert suffix_dedup.suffix_array(s).tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])


@pytest.mark.parametrize("most", [1024, 2])
def test_repeats(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST_SEGMENTS", most)
    docs = table(spark, SMALL, "documents")
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    seen: dict[bytes, int] = {}
    for t in texts.values():
        for i in range(len(t) - 199):
            seen[t[i:i + 200]] = seen.get(t[i:i + 200], 0) + 1
    for r in suffix_dedup.remove_repeats(spark, docs).collect():
        t = texts[r.doc_id]
        hide = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if seen[t[i:i + 200]] > 1:
                hide[i:i + 200] = True
        assert bytes(r.kept) == np.frombuffer(t, np.uint8)[~hide].tobytes() and r.n_removed == hide.sum()


def test_large_groups_of_repeats_are_cut_finer(spark, monkeypatch):
    """A large group's different pieces are compared in a few parts each, not by a row for each of their 41 strings."""
    monkeypatch.setattr(suffix_dedup, "MOST_SEGMENTS", 8)
    staged = []

    def counted(*args):
        out = stage(*args)
        staged.append((args[2], out.count()))
        return out

    monkeypatch.setattr(suffix_dedup, "stage", counted)
    rng = np.random.default_rng(7)

    def letters(n):
        return "".join(rng.choice(list("abcdefgh"), n))

    passage = letters(230)
    texts = {k: letters(120) + passage[:230 - k % 3 * 25] + letters(120) for k in range(60)}  # every third is cut to 205, every third to 180 bytes
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(spark, spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    seen = Counter(t[i:i + 200] for t in texts.values() for i in range(len(t) - 199))
    for k, t in texts.items():
        hide = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            hide[i:i + 200] |= seen[t[i:i + 200]] > 1
        assert bytes(got[k].kept) == np.frombuffer(t.encode(), np.uint8)[~hide].tobytes() and got[k].n_removed == hide.sum()
        assert (got[k].n_removed > 0) == (k % 3 < 2)
    kinds = next(n for name, n in staged if name == "repeat-kinds")
    assert kinds > 60 and sum(n for name, n in staged if name in ("repeat-strings", "finer-pieces")) < 20 * kinds


def test_minhash_is_unbiased():
    rng = np.random.default_rng(5)
    both = rng.integers(0, 2**63, 400).astype(np.uint64)
    a, b = np.unique(both[:350]), np.unique(both[50:])
    sig = minhash_dedup.superminhash(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
    assert abs((sig[0] == sig[1]).mean() - 0.75) < 0.12


def test_estimates_lose_less_than_bands():
    n, p = minhash_dedup.SLOTS, minhash_dedup.PERCENT / 100
    below = sum(math.comb(n, k) * p**k * (1 - p)**(n - k) for k in range(n + 1) if k / n < minhash_dedup.LEAST_ESTIMATE)
    assert below < (1 - p**minhash_dedup.ROWS)**minhash_dedup.BANDS


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    tables = {t: table(spark, SMALL, t) for t in ("documents", "pages", "benchmark")}
    names, want = duck(tables, queries.ORACLES[name])
    assert rows(queries.QUERIES[name](spark, SMALL).select(names)) == want


def test_alignment_of_edited_copies(spark):
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    item = [word() for _ in range(40)]
    edited = [word() if k % 9 == 4 else w for k, w in enumerate(item) if k % 13 != 5]
    docs = [(1, " ".join([word() for _ in range(300)] + edited + [word() for _ in range(300)])), (2, " ".join(word() for _ in range(600))), (3, " ".join(item).upper())]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r.doc_id: r.score for r in decontamination.contaminated(spark, docs, spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")).collect()}
    assert set(found) == {1, 3} and found[3] == 1.0 and found[1] > 0.6


def test_every_copy_that_aligns_is_found(spark):
    """Lone copies with every n-th word replaced, left out or doubled, against the alignment of all pairs."""
    rng = np.random.default_rng(10)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    items = {k: [word() for _ in range(n)] for k, n in enumerate((15, 24, 30, 37, 45, 59) * 4)}
    texts = {}
    for k, item in items.items():
        for every in (3, 4, 5, 6):
            kinds = (lambda w: [word()], lambda w: [], lambda w: [w, word()])
            edited = [x for j, w in enumerate(item) for x in (kinds[k % 3](w) if j % every == every - 1 else [w])]
            texts[len(texts)] = [word() for _ in range(80)] + edited + [word() for _ in range(80)]
    words = lambda t: next(decontamination.tokens(pa.array([" ".join(t)])))[1]
    own, want = [words(x) for x in items.values()], set()
    for d, t in texts.items():
        for k, (s, _, _) in enumerate(decontamination.align(own, [words(t)] * len(own))):
            if s >= decontamination.LEAST_SCORE * decontamination.MATCH * len(own[k]):
                want.add((d, k, s / (decontamination.MATCH * len(own[k]))))
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in texts.items()], "doc_id long, text string")
    found = decontamination.contaminated(spark, docs, spark.createDataFrame([(k, " ".join(x)) for k, x in items.items()], "item_id long, text string"))
    assert len(want) >= 90 and {(r.doc_id, r.item_id, r.score) for r in found.collect()} == want


def accuracy(df, labels, column):
    return [(r.predicted == r[column]) for r in df.where("held_out").join(labels.where(f"{column} is not null"), "doc_id").collect()]


def test_held_out(spark):
    docs, labels = table(spark, MEDIUM, "documents"), table(spark, MEDIUM, "labels")
    assert np.mean(accuracy(quality_ranking.score(spark, docs, labels), labels, "quality")) > 0.9
    got = language_id.identify(spark, docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.97
    docs, labels = table(spark, LARGE, "documents"), table(spark, LARGE, "labels")  # the smaller table has some 30 toxic texts to learn from
    t = toxicity.score(spark, docs, labels).where("held_out").join(labels, "doc_id").collect()
    bad, fine = [r.score for r in t if r.toxic == 1], [r.score for r in t if r.toxic == 0]
    assert np.mean([b > f for b in bad for f in fine]) > 0.9


def test_language_models_are_whole_in_shards(spark, monkeypatch):
    docs = table(spark, SMALL, "documents")
    few = docs.where("lang is not null").limit(1).selectExpr("doc_id * 0 + 3 doc_id", "'qq' lang", "'ʘǃ ʘǂǃ ǁǀ ʘǃ ʘǂǃ' text")  # a small language of its own letters
    docs = docs.select("doc_id", "lang", "text").union(few)
    columns = ["doc_id", "lang_pred", "score", "cross_entropy", "rejected"]
    whole = rows(language_id.identify(spark, docs), columns)
    found = language_id.stage(spark, language_id.counts(docs.where("lang is not null and text is not null").select("lang", "text")), "char-grams")
    langs = sorted(r.lang for r in found.select("lang").distinct().collect())
    monkeypatch.setattr(language_id, "MODEL_CELLS", len(langs) * found.count() // 5)
    assert len(list(language_id.shards(found, langs))) > 3
    cut = rows(language_id.identify(spark, docs), columns)
    assert [(r[0], r[1], r[4]) for r in cut] == [(r[0], r[1], r[4]) for r in whole] and any(r[1] == "qq" for r in cut)
    assert np.allclose([r[2:4] for r in cut], [r[2:4] for r in whole], equal_nan=True)


def test_pipeline(spark, encoding):
    """run() against the stages done one by one, each by SQL or brute force."""
    docs, benchmark = table(spark, SMALL, "documents"), table(spark, SMALL, "benchmark")
    names, judged = duck({"documents": docs}, quality_rules.oracle())
    keep = {r[names.index("doc_id")] for r in judged if r[names.index("kept")]}
    stage1 = docs.where(docs.doc_id.isin(list(keep)))
    names, groups = duck({"documents": stage1}, minhash_dedup.oracle())
    keep = {r[names.index("doc_id")] for r in groups if r[names.index("kept")]}
    words = lambda t: [w for _, w, *_ in decontamination.tokens(pa.array([t]))]
    items = [x[0] for r in benchmark.collect() if (x := words(r.text)) and len(x[0]) >= decontamination.SEED]
    texts = {}
    for r in stage1.collect():
        if r.doc_id in keep:
            own = words(r.text)[0]
            scores = [s / (2 * len(i)) for i, (s, _, _) in zip(items, decontamination.align(items, [own] * len(items)), strict=True)]
            if max(scores) < decontamination.LEAST_SCORE:
                texts[r.doc_id] = r.text
    model = pii.train(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert set(got) == set(texts)
    for doc_id, text in texts.items():
        emails = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        base, spans = pii.find([text], model)[0]
        assert [(a, b) for a, b, k in base if k == "email"] == emails
        out, done = "", 0
        for a, b, kind in spans:
            out += text[done:a] + f"<{kind.upper()}>" if a >= done else ""
            done = max(done, b)
        out += text[done:]
        assert list(got[doc_id].ids) == encoding.encode_ordinary(out) and got[doc_id].decoded_sha256 == hashlib.sha256(out.encode()).hexdigest()


def test_index_has_two_levels(spark, tmp_path):
    pages = table(spark, SMALL, "pages")
    names, want = duck({"pages": pages}, warc.oracle())
    assert rows(warc.round_trip(spark, pages, f"file://{tmp_path}/w", block_lines=3).select(names)) == want
    assert any(p.suffix == ".directory" and len(p.read_text().splitlines()) > 1 for p in (tmp_path / "w").iterdir())


def test_toxicity_models_are_kneser_ney(spark):
    """Evidence of short texts against a plain dictionary form of the models."""
    rng = np.random.default_rng(12)
    text = lambda n: " ".join(rng.choice(list("abcdefghijklm"), n))
    train = [(text(9), k % 2) for k in range(40)] + [("A a, a", 0), ("", 1), (None, 0)]
    found = toxicity.class_counts(spark.createDataFrame(train, "text string, y int")).toArrow()
    before, word = (found.column(c).to_numpy().view(np.uint64) for c in ("before", "word"))
    counts = toxicity.Counts(before, word, [found.column(f"n{c}").to_numpy() for c in (0, 1)])
    own = lambda t: re.findall("[a-z]+", (t or "").lower())
    pairs = lambda t: list(zip(["^", *own(t)], own(t), strict=False))
    n = [{}, {}]
    for t, y in train:
        for p in set(pairs(t)):
            n[y][p] = n[y].get(p, 0) + 1
    words = sorted({w for c in n for _, w in c})
    hashes = dict(zip(words, next(toxicity.tokens(pa.array([" ".join(words)])))[3].tolist(), strict=True))
    share = {w: (k + 1) / 200 for k, w in enumerate(words)}
    shared = np.array([share[next(w for w in words if hashes[w] == h)] for h in counts.words.tolist()])

    def cut(values):
        once, twice = sum(v == 1 for v in values), sum(v == 2 for v in values)
        return once / (once + 2 * twice) if once and twice else 0.75

    def p(c, v, w, a, b):
        kinds = {x: sum(q[1] == x for q in n[c]) for x in words}
        total, d, e = sum(kinds.values()), cut(kinds.values()), cut(n[c].values())
        low = (max(kinds[w] - d, 0) + (sum(min(k, d) for k in kinds.values()) + a * total) * share[w]) / (total * (1 + a))
        after = [k for q, k in n[c].items() if q[0] == v]
        size = sum(after) + b * total
        return (low, low) if not size else (low, max(n[c].get((v, w), 0) - e, 0) / size + (sum(min(k, e) for k in after) + b * total) / size * low)

    texts = [text(k) for k in (1, 2, 7, 30)] + ["", None, "a"]
    for a, b in ((0.0, 0.0), (1.0, 0.5), (10.0, 100.0)):
        want = []
        for t in texts:
            score, usual, weight = 0.0, 0.0, 1e-9
            for v, w in pairs(t):
                score += math.log(p(1, v, w, a, b)[1] / p(0, v, w, a, b)[1]) / len(own(t))
                after = [(x, n[0].get((v, x), 0) + n[1].get((v, x), 0)) for x in words]
                seen = sum(k for _, k in after)
                if seen:
                    norm = sum(k * math.log(p(1, v, x, a, b)[0] / p(0, v, x, a, b)[0]) for x, k in after if k) / seen
                    usual, weight = usual + norm * seen / (seen + toxicity.SURE), weight + seen / (seen + toxicity.SURE)
            want.append(score - usual / weight)
        assert np.allclose(counts.ratios(shared, a, b).evidence(pa.array(texts)), want, atol=1e-4)


def test_distinct_predecessors_are_estimated(spark):
    """Bitmaps tell how many words stand before a word, however often and in whatever batch they do."""
    docs = spark.createDataFrame([(" ".join(f"x{k % n} word{n}" for k in range(2 * n)),) for n in (1, 5, 40, 300, 3000, 30000)] * 2, "text string")
    hashes = {n: int(next(toxicity.tokens(pa.array([f"word{n}"])))[3].view(np.int64)[0]) for n in (1, 5, 40, 300, 3000, 30000)}
    got = {r.word: r.n for r in toxicity.corpus_counts(docs).collect()}
    assert abs(got[hashes[1]] - 1) < 0.1 and all(0.5 * n < got[h] < 1.6 * n for n, h in hashes.items())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "B.", "@", "x-y", ".de", " ", "-", "+", "1", "25", "256", "4", "0", "(", ")", ".", "4111", "1111", "@@", "é"]), max_size=30).map("".join))
def test_base_spans(text):
    """All four kinds against the plain patterns."""
    digits = lambda t: [int(c) for c in t if c in "0123456789"]
    luhn = lambda d: sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(d[::-1])) % 10 == 0
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(x) <= 255 for x in t.split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda t: 14 <= len(digits(t)) <= 19 and luhn(digits(t))),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 10 <= len(digits(t)) <= 15)]
    want = sorted((m.start(), k, m.end(), name) for k, (name, pattern, valid) in enumerate(kinds) for m in re.finditer(pattern, text) if valid(m[0]))
    assert pii.base_spans(text) == [(a, b, name) for a, _, b, name in want]
