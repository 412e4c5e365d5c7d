"""Defined results for nulls, blanks, ties, repeated rows, long texts, clashing columns and empty tables."""

import hashlib

from covercost.llm import byte_bpe, decontamination, language_id, minhash_dedup, pii, quality_ranking, quality_rules, suffix_dedup, toxicity, warc

from .conftest import ODD, duck, rows


def test_quality_rules(spark, odd, none):
    names, want = duck({"documents": odd}, quality_rules.oracle())
    assert rows(quality_rules.judge(spark, odd).select(names)) == want
    assert rows(quality_rules.judge(spark, none)) == []


def test_lines_of_f_and_form_feed(spark):
    body = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, f"{body}\nf\nf\n f f\n f f\n", "en", "a"), (2, f"{body}\n\f\n\f\n\f \v\r\n", "en", "a")], "doc_id long, text string, lang string, source string")
    names, want = duck({"documents": docs}, quality_rules.oracle())
    assert rows(quality_rules.judge(spark, docs).select(names)) == want
    assert rows(quality_rules.judge(spark, docs), ["doc_id", "n_dup_lines"]) == [(1, 2), (2, 0)]


def test_near_duplicates(spark, odd, none):
    got = {r.doc_id: r for r in minhash_dedup.near_duplicates(spark, odd).collect()}
    assert minhash_dedup.near_duplicates(spark, odd).count() == len(ODD)
    assert got[1].n_shingles == got[2].n_shingles == got[3].n_shingles == 0 and got[3].kept
    assert got[8].component_id == 7 and not got[8].kept and got[5].n_shingles == 1
    assert got[None].component_id is None and got[None].kept
    assert rows(minhash_dedup.near_duplicates(spark, none)) == []
    stay = minhash_dedup.one_of_each(spark, odd)
    assert stay.columns == odd.columns and sorted(r.doc_id or 0 for r in stay.collect()) == [0, 1, 2, 3, 5, 6, 7, 9, 10, 11, 12]


def test_repeats(spark, odd, none):
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(spark, odd).collect()}
    assert got[1].n_bytes == 0 and got[1].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[10].n_removed == 30_000 and got[10].n_spans == 1 and got[7].n_removed == got[7].n_bytes and got[11].n_removed == 0
    assert rows(suffix_dedup.remove_repeats(spark, none)) == []


def test_tokens(spark, odd, none):
    got = {r.doc_id: r for r in byte_bpe.encode_decode(spark, odd, ids=True, decoded=True).collect()}
    assert got[1].n_tokens == 0 and got[1].ids == [] and bytes(got[12].decoded).decode() == ODD[-1][1] and got[10].n_tokens == len(got[10].ids)
    assert rows(byte_bpe.encode_decode(spark, none)) == []


def test_personal_data(spark, odd, none):
    got = {r.doc_id: r for r in pii.detect(spark, odd).collect()}
    assert (got[12].n_email, got[12].n_phone, got[1].n_email, got[1].spans) == (1, 1, 0, "")
    clean = {r.doc_id: r for r in pii.redact(spark, odd).collect()}
    assert clean[12].text == "ßéñ 中文 \U0001F600 mail <EMAIL> <PHONE>" and clean[1].text is None and clean[12].kept == 7
    assert rows(pii.detect(spark, none)) == []


def test_decontamination(spark, odd, none):
    items = spark.createDataFrame([(1, "w100 w101 w102 w103 w104 w105 w106 w107 w108", 0), (1, None, 0), (2, "", 0), (3, "word", 0), (None, "a b c d", 0)], "item_id long, text string, doc_id int")
    assert rows(decontamination.contaminated(spark, odd, items), ["doc_id", "item_id", "score"]) == [(11, 1, 1.0)]
    left = decontamination.without_contaminated(spark, odd, items)
    assert left.columns == odd.columns and left.count() == len(ODD) - 1
    assert rows(decontamination.contaminated(spark, none, items)) == [] and rows(decontamination.contaminated(spark, odd, items.limit(0))) == []


def test_scores(spark, odd, none, labels):
    for module in (toxicity, quality_ranking):
        got = module.score(spark, odd, labels)
        assert got.count() == len(ODD) and all(0 <= r.score <= 1 for r in got.collect())
        assert rows(module.score(spark, none, labels)) == [] and rows(module.score(spark, odd, labels.limit(0)), ["predicted"]) == [(0,)] * len(ODD)


def test_language(spark, odd, none):
    got = {r.doc_id: r for r in language_id.identify(spark, odd).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == "und" and got[1].score == 0
    assert got[11].lang_pred in ("de", "en", "xx") and rows(language_id.identify(spark, none)) == []


def test_archives(spark):
    big = "<p>" + "text " * 50
    data = [(1, "http://a.b.c/x?y=1#z", big, 0), (2, None, big, 0), (2, None, big, 0), (1, "http://a.b.c/x", big, 0), (3, "odd url\n", None, 0), (4, "http://u@B.c:8/", "", 0),
            (5, "x", "short", 0), (6, "x", "short", 0), (7, "http://ü.de/ñ", "é" * 60, 0)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, key int")
    names, want = duck({"pages": pages}, warc.oracle())
    assert rows(warc.round_trip(spark, pages).select(names)) == want
    assert rows(warc.round_trip(spark, pages.limit(0))) == []


def test_a_worker_at_rest_holds_no_database(spark):
    docs = spark.createDataFrame([(k, f"words of document {k}") for k in range(40)], "doc_id long, text string").repartition(4)
    first = rows(byte_bpe.encode_decode(spark, docs, ids=True))

    def held(batches):
        import pyarrow as pa

        from covercost.llm import byte_bpe

        for batch in batches:
            yield pa.record_batch([pa.array([sum(c.db is not None for c in byte_bpe._coders.values())])], names=["n"])

    assert spark.range(0, 40, 1, 4).mapInArrow(held, "n long").agg({"n": "max"}).first()[0] == 0
    assert rows(byte_bpe.encode_decode(spark, docs, ids=True)) == first  # and opens it again
