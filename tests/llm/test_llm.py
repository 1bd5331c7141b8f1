"""Corpus operators against brute force, exact round trips and held-out labels, on small fixtures."""

import collections
import hashlib
import inspect
import os
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from forktrack.llm import bpe, chroma, dart, decontam, labelled, lines, near, orc_tokens, quality, queries, runtime, secrets, textops, toxicity, warc

P = pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, label string, node string"
ODD = [None, "", " ", "\n\n", "a", "it's we'll  \t x y", "é中文 ǅ", "x" * 5000, "word " * 3000, "!!! ???", "''s 're\n't"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and ids, a null id, and columns whose names clash."""
    rows = [(i, t, None, "s", None, 0.5, "z", "n") for i, t in enumerate(ODD)] + [(4, "a", "en", None, 1, None, None, None), (4, "a", "en", None, 1, None, None, None), (None, "null id", None, None, None, None, None, None), (4, "other", None, None, 2, 0.1, "q", "m")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# Text primitives


def test_pretokens_match_the_pattern():
    import regex

    pattern, r = regex.compile(P.PATTERN), random.Random(1)
    texts = ["".join(r.choice(" \n\t'  strevmldaZé9½ 　.!$中́") for _ in range(r.randrange(30))) for _ in range(3000)] + [t or "" for t in ODD]
    texts.append("ab cd\n" * 60_000)
    got = [[] for _ in texts]
    for cp, seg, owner in textops.chunks(texts):
        s, e = textops.pretokens(cp)
        for a, b, o in zip(s, e, textops.owners(s, seg, owner)):
            got[o].append(cp[a:b].tobytes().decode("utf-32-le"))
    assert got == [pattern.findall(t) for t in texts]


def test_span_hashes_depend_on_characters_alone():
    cp = np.frombuffer("abc xabc abd".encode("utf-32-le"), "<u4")
    h = textops.span_hashes(cp, np.array([0, 5, 9]), np.array([3, 8, 12]))
    assert h[0] == h[1] != h[2]


# 1: byte-level BPE


def expected_ids(text):
    import tiktoken

    path = bpe.default_ranks()
    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={}).encode_ordinary(text or "")


def test_bpe_round_trip(spark, odd, none):
    path = bpe.default_ranks()
    got = bpe.encode_documents(odd, path, batch_chars=3000)
    texts = collections.Counter((r.doc_id, tuple(expected_ids(r.text))) for r in odd.collect())
    assert collections.Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got.collect()) == texts
    back = collections.Counter((r.doc_id, bytes(r.data).decode()) for r in bpe.decode(got, path).collect())
    assert back == collections.Counter((r.doc_id, r.text or "") for r in odd.collect())
    digest = {r.doc_id: r for r in bpe.encode_documents(odd, path, digest=True).collect()}
    assert digest[5].ids_sha256 == hashlib.sha256(" ".join(map(str, expected_ids(ODD[5]))).encode()).hexdigest()
    assert digest[0].decoded_sha256 == hashlib.sha256(b"").hexdigest() and digest[0].n_tokens == 0
    assert bpe.encode_documents(none, path, digest=True).count() == 0


def test_merge_rule_agrees_with_the_library():
    path = bpe.default_ranks()
    ranks, encode = bpe.load_ranks(path), bpe._encoder(path)
    for word in (b" retributionally", "éé中".encode(), b"!!!!", b"a"):
        assert bpe.merge_word(word, ranks) == list(encode(word))


@pytest.mark.parametrize("words", [10, 300_000, 3_000_000])
def test_codes_pack_and_unpack(words):
    codes = np.random.default_rng(0).integers(0, words, 4000).astype(np.uint32)
    assert np.array_equal(bpe.unpack_codes(bpe.pack_codes(codes, words), len(codes), words), codes)


def thue_morse(n):
    """Two words of n letters that any polynomial hash modulo 2 ** 64 takes for one."""
    one = "".join("ab"[bin(k).count("1") % 2] for k in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 2048])
def test_words_of_one_hash_are_told_apart(spark, n):
    from tokenizers import Tokenizer

    one, two = thue_morse(n)
    cp = np.frombuffer((one + two).encode("utf-32-le"), "<u4")
    assert np.unique(textops.span_hashes(cp, np.array([0, n]), np.array([n, 2 * n]))).size == 1
    texts = [one, two, f"{two} {one}", one]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for frame in (docs.coalesce(1), docs.repartition(4)):
        got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in bpe.encode_documents(frame, bpe.default_ranks()).collect()}
        assert got == {i: expected_ids(t) for i, t in enumerate(texts)}
    path = orc_tokens.default_tokenizer()
    t = Tokenizer.from_file(path)
    want = [t.encode(x, add_special_tokens=False).ids + [0] for x in texts]
    assert [x.tolist() for x in orc_tokens.encode_texts(texts, path)] == want
    assert [orc_tokens.encode_texts([x], path)[0].tolist() for x in texts] == want
    assert len(set(dart.node_ids([one, two]))) == 2


# 2: WARC in ZIP


def test_warc_round_trip(spark):
    big = "<p>" + "é" * 300
    rows = [(1, "u1", big), (2, None, big), (3, "a\r\nb", None), (4, "u", "x"), (5, "u", "x"), (0, "z", big + "!"), (7, "u", big), (1, "u1", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    packages = warc.write(pages, runtime.fresh_path(spark, "warc"))
    got = sorted((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.read(spark, packages).collect())
    size, digest = len(big.encode()), hashlib.sha256(big.encode()).hexdigest()
    assert [g[:4] for g in got] == [(0, "response", None, size + 1), (1, "response", None, size), (1, "response", None, size), (2, "revisit", 1, size), (3, "response", None, 0), (4, "response", None, 1), (5, "response", None, 1), (7, "revisit", 1, size)]
    assert {g[4] for g in got if g[3] == size} == {digest}
    assert warc.write(pages.where("false"), runtime.fresh_path(spark, "warc")).count() == 0


def test_zip64_directory_and_ranges(tmp_path):
    import zipfile

    path = tmp_path / "x.zip"
    with open(path, "wb") as f:
        n = warc.package(f, iter([("1", warc.record(1, "u", b"abc", "d")), ("2", warc.record(2, "u", b"", "e", 1, True))]))
    assert n == 2 and zipfile.ZipFile(path).testzip() is None
    with open(path, "rb") as f:
        assert [m.name for m in warc.members(f)] == [warc.DATA, warc.INDEX]
        (_, at, size), (_, at2, size2) = warc.locate(f)
        assert warc.parse(zlib.decompress(warc._range(f, at, size), 31))["payload"] == b"abc"
        assert warc.parse(zlib.decompress(warc._range(f, at2, size2), 31))["headers"]["warc-type"] == "revisit"
    # A directory whose 32-bit fields are full: sizes and offsets come from ZIP64 fields.
    many = tmp_path / "many.zip"
    with zipfile.ZipFile(many, "w") as z:
        for i in range(70_000):
            z.writestr(zipfile.ZipInfo(f"{i}"), b"")
    with open(many, "rb") as f:
        assert len(warc.members(f)) == 70_000
    with zipfile.ZipFile(tmp_path / "deflated.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"b" * 100)
    with open(tmp_path / "deflated.zip", "rb") as f, pytest.raises(ValueError):
        warc.data_start(f, warc.members(f)[0])


# 3: decontamination


def sentence(r, n, words):
    return " ".join(r.choice(words) for _ in range(n))


def test_leaks_are_found_and_clean_documents_left(spark, odd, none):
    r = random.Random(2)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(3, 8))) for _ in range(3000)]
    items = [sentence(r, 30, words) + ". " + sentence(r, 6, words) + "." for _ in range(12)]
    docs, leaked = [], {}
    for d in range(200):
        text = sentence(r, 150, words)
        if d % 10 == 0:
            i = d // 10 % 12
            item = items[i].split()
            if d % 20 == 10:  # a paraphrase: three in ten of the words before the answer replaced
                for k in r.sample(range(30), 9):
                    item[k] = r.choice(words)
            text = sentence(r, 70, words) + " " + " ".join(item) + " " + sentence(r, 60, words)
            leaked[d] = i
        docs.append((d, text))
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(list(enumerate(items)) + [(98, None), (99, "")], "item_id long, text string")
    found = decontam.leaks(table.drop("item_id"), bench, sample_windows=400, rank=40)
    assert {r.doc_id: r.item_id for r in found.collect()} == leaked
    assert decontam.without_leaks(table, bench).count() == 200 - len(leaked)
    assert decontam.leaks(odd.select("doc_id", "text"), bench).count() == 0
    assert decontam.leaks(none, bench).count() == 0 and decontam.leaks(table, bench.where("false")).count() == 0
    assert decontam.covered(np.array([1, 2, 3, 4]), np.array([9, 1, 3, 2, 4]), np.ones(4)) == 0.75


# 4: secrets


def brute_spans(text):
    out = []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secret_spans(spark, odd, none):
    r = random.Random(3)
    pieces = ["password", "TOKEN", " = ", ":", "'", '"', "AKIA", "ABCDEFGH1234567890", "deadbeef" * 4, " ", "\n", "x", "api_key", "secret", "abcdef1", "=", "é"]
    for _ in range(1500):
        text = "".join(r.choice(pieces) for _ in range(r.randrange(25)))
        assert secrets.base_spans(text) == brute_spans(text), text
    code = 'k = "Zx9!fQ27pLm_w8"\ndb_pwd = k\nclientSecretValue: str = \'q7#Ht0Zr55\'\ntitle = "Hello there friend"\nport = 5432\npwd = "changeme"'
    base, every = secrets.scan_text(code)
    assert base == [] and [code[s:e] for s, _, e in every] == ["Zx9!fQ27pLm_w8", "q7#Ht0Zr55"]
    rows = {r.doc_id: r for r in secrets.scan_documents(odd).collect()}
    assert rows[0].base_sha256 == hashlib.sha256(b"").hexdigest() and rows[0].spans == ""
    assert secrets.scan_documents(odd).count() == odd.count() and secrets.scan_documents(none).count() == 0


def test_operators_in_linear_time():
    r, plain = random.Random(13), re.compile(r"[:=!<>+*/|&^%-]*[:=]>?")
    for _ in range(5000):
        text = "".join(r.choice(":=!<>+-a ") for _ in range(r.randrange(14)))
        assert list(secrets.operators(text)) == [m.span() for m in plain.finditer(text)], text
    assert secrets.scan_text("-" * 2_000_000 + " password = 'Zx9!fQ27pLm_w8'")[1]


# 5 and 7: classifiers


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_classifiers_hold_out(spark):
    d = "/root/testdata/sf0.01"
    for name, label, folds, out in (("op5_quality_neighbours", "quality", 4, 2), ("op7_toxicity_ftrl", "toxic", 3, 1)):
        rows = {r.doc_id: r for r in queries.queries()[name](spark, d).collect()}
        assert all(r.held_out == (zlib.crc32(str(i).encode()) % folds == out) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in rows.items())
        held = [(x[label], rows[x.doc_id].predicted) for x in spark.read.parquet(f"{d}/labels.parquet").collect() if rows[x.doc_id].held_out]
        right = np.mean([a == b for a, b in held])
        assert right >= 0.9, (name, right)


def test_classifiers_take_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(11)] + [(None, 1, 1), (3, None, None), (4, 1, 0)], "doc_id long, quality int, toxic int")
    for mod, name in ((quality, "quality"), (toxicity, "toxic")):
        for train_docs, train_labels in ((odd, labels), (none, labels), (odd, labels.where("false"))):
            model = mod.train(train_docs, train_labels)
            scores = [r.s for r in odd.select(mod.score(F.col("text"), model).alias("s")).collect()]
            assert len(scores) == odd.count() and all(0 <= s <= 1 for s in scores), name
    assert labelled.fold_of(12, 4) == zlib.crc32(b"12") % 4


def test_ftrl_learns_and_stays_sparse():
    r = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    texts, marks = [], []
    for i in range(400):
        w = [r.choice(words) for _ in range(40)]
        if i % 4 == 0:
            w[r.randrange(40)] = "scoundrel"
        texts.append(" ".join(w))
        marks.append(int(i % 4 == 0))
    model = toxicity.fit(texts, marks)
    p = toxicity.score_texts(model, texts)
    assert ((p >= 0.5).astype(int) == marks).all() and 0 < len(model.features) < 200


def test_all_labelled_rows_train(spark):
    """Each shard has words that no other has; all of them count, and one shard is the plain fit."""
    r = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    rows = spark.createDataFrame([(i, i % 3 // 2) for i in range(1500)], "doc_id long, toxic int")
    shards = {x.doc_id: x.s for x in rows.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(5)).alias("s")).collect()}
    texts = [" ".join([r.choice(words) for _ in range(30)] + [f"scoundrel{shards[i]}"] * (i % 3 == 2)) for i in range(1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    used = [i for i in range(1500) if labelled.fold_of(i, 3) != 1]
    model = toxicity.train(docs, rows, shard_rows=-(-len(used) // 5))
    known = set(toxicity.features([f"scoundrel{k}" for k in range(5)])[1].tolist()) & set(model.features.tolist())
    assert {int(textops.hashed_words([f"scoundrel{k}"])[0][0]) for k in range(5)} <= known and (np.diff(model.features.astype(float)) > 0).all()
    place = {x.doc_id: x.draw for x in labelled.known(rows, "toxic", 3, 1).withColumnRenamed("_id", "doc_id").collect()}
    order = sorted(used, key=place.get)
    plain, one = toxicity.fit([texts[i] for i in order], [i % 3 // 2 for i in order]), toxicity.train(docs, rows)
    assert np.array_equal(plain.features, one.features) and np.allclose(plain.weights, one.weights) and one.bias == pytest.approx(plain.bias)


def exact_space(texts):
    """A latent space with an axis for each word of the texts, all of one weight; it loses nothing."""
    slots = np.unique(decontam._buckets(textops.hashed_words(texts)[0]))
    basis = np.zeros((decontam.BUCKETS, len(slots)), np.float32)
    basis[slots, np.arange(len(slots))] = 1
    return decontam.Space(np.ones(decontam.BUCKETS), basis)


def found_by_default(docs, items):
    limits = {k: inspect.signature(decontam.leaks).parameters[k].default for k in ("cosine", "cover", "paraphrase")}
    space, hashed = exact_space(docs + items), textops.hashed_words(docs)
    return {(t, i): part for t, i, _, _, part in decontam.search(hashed, decontam.window_vectors(*hashed, space), space, decontam._item_block([(i, x, None) for i, x in enumerate(items)], space), **limits)}


def test_a_short_item_is_found_in_a_window_of_other_words():
    words = [f"w{k}" for k in range(64)]
    assert (0, 0) in found_by_default([" ".join(words)], [" ".join(words[20:35])])


@pytest.mark.parametrize("n", [65, 240, 400, 1000])
@pytest.mark.parametrize("before", [0, 51, 300])
def test_long_items_are_found_whole(n, before):
    item, other = [f"w{k}" for k in range(n)], [f"o{k}" for k in range(400)]
    docs = [" ".join([*other[:before], *item, *other[before:]]), " ".join(other), " ".join(item)]
    got = found_by_default(docs, ["x y z", " ".join(item), "u v"])
    assert set(got) == {(0, 1), (2, 1)} and min(got.values()) > 0.999


def test_blocks_of_items_are_bounded_in_words():
    sizes = lambda most, *n: [len(b) for b in decontam._item_blocks([(k, "w " * x, None) for k, x in enumerate(n)], most)]
    assert sizes(2, 10, 10, 10, 10, 10) == [2, 2, 1] and sizes(2, 500, 10, 10, 200) == [1, 2, 1] and sizes(2) == []


def test_of_equally_covering_windows_the_first_is_given():
    item, other = [f"w{k}" for k in range(30)], [f"o{k}" for k in range(200)]
    docs = [" ".join(other + item + other + item + other)]
    space, hashed = exact_space(docs), textops.hashed_words(docs)
    found, = decontam.search(hashed, decontam.window_vectors(*hashed, space), space, decontam._item_block([(7, " ".join(item), None)], space), 0.45, 0.6, 0.4)
    assert 100 < found[2] <= 230 and found[4] > 0.999


def dense_windows(texts, idf):
    rows = []
    for words in decontam._split(*textops.hashed_words(texts)):
        for at in range(0, max(1, len(words) - decontam.BLOCK), decontam.BLOCK) if len(words) else ():
            slot, value = decontam._sparse_window(words[at:at + 2 * decontam.BLOCK], idf)
            rows.append(np.zeros(decontam.BUCKETS))
            rows[-1][slot] = value
    return np.array(rows)


def test_products_of_all_windows():
    r = random.Random(4)
    texts = [None, "", "one", "a a a b", *(" ".join(r.choice("abcdefgh") for _ in range(n)) for n in (31, 32, 33, 64, 65, 97, 400)), " ".join(f"w{k}" for k in range(2000))]
    rng = np.random.default_rng(1)
    idf, sent, image = rng.random(decontam.BUCKETS) * 5, rng.standard_normal((decontam.BUCKETS, 9)).astype(np.float32), np.zeros((decontam.BUCKETS, 9))
    for part in (texts[:5], texts[5:], []):
        decontam.add_products(image, *textops.hashed_words(part), idf, sent * idf[:, None].astype(np.float32))
    rows = dense_windows(texts, idf)
    want = rows.T @ (rows @ sent)
    assert np.abs(image * idf[:, None] - want).max() < 1e-4 * np.abs(want).max()
    turned = np.linalg.qr(sent)[0]
    space = decontam.nystrom(turned, rows.T @ (rows @ turned), 5)
    assert np.abs(space.T @ space - np.eye(5)).max() < 1e-3 and not decontam.nystrom(turned, np.zeros_like(image), 5).any()


def test_products_are_added_up_over_lots_of_texts(monkeypatch):
    r = random.Random(5)
    texts = ["the " * 3000 + " ".join(f"w{k % 700}" for k in range(2000)), "", *(" ".join(r.choice(["the", "of", "a", "b", f"x{k}"]) for _ in range(90)) for k in range(40)), None]
    rng = np.random.default_rng(2)
    idf, sent = rng.random(decontam.BUCKETS), rng.standard_normal((decontam.BUCKETS, 5)).astype(np.float32)
    rows = dense_windows(texts, idf)
    want = rows.T @ (rows @ sent)
    for most in (1, 60, 1 << 15):
        monkeypatch.setattr(decontam, "SUMMED_BLOCKS", most)
        image = np.zeros((decontam.BUCKETS, 5))
        products = decontam.Products(image, idf, sent * idf[:, None].astype(np.float32))
        for at in range(0, len(texts), 7):
            products.add(*textops.hashed_words(texts[at:at + 7]))
            assert products.blocks < most
        products.end()
        assert np.abs(image * idf[:, None] - want).max() < 1e-4 * np.abs(want).max()


def plain_cover(item, passage, weight):
    best = np.zeros(len(passage) + 1)
    for w, v in zip(item, weight):
        step = best.copy()
        hit = np.flatnonzero(passage == w)
        step[hit + 1] = np.maximum(step[hit + 1], best[hit] + v)
        best = np.maximum.accumulate(step)
    return float(best[-1]) / float(weight.sum()) if weight.sum() else 0.0


@pytest.mark.parametrize("vocabulary, items, n", [(3, 4, 20), (40, 5, 130), (2000, 40, 60), (30000, 60, 600)])
def test_shares_and_covers_against_plain_ones(vocabulary, items, n):
    r, rng = random.Random(vocabulary), np.random.default_rng(vocabulary)
    words = [f"w{k}" for k in range(vocabulary)]
    docs = [sentence(r, r.randint(0, 900), words) + " other " for _ in range(8)]
    texts = [sentence(r, r.randint(1, n), words) for _ in range(items)] + ["", None, "nowhere"]
    space = decontam.Space(rng.random(decontam.BUCKETS), rng.standard_normal((decontam.BUCKETS, 4)).astype(np.float32))
    own = decontam._item_block([(i, t, None) for i, t in enumerate(texts)], space)
    h, bounds = textops.hashed_words(docs)
    known = decontam._known(h, own)
    place = {w: k for k, w in enumerate(own.vocabulary.tolist())}
    assert known.tolist() == [place.get(w, -1) for w in h.tolist()]
    item = rng.integers(len(texts), size=300)
    first = np.sort(rng.integers(len(h), size=300))
    last = np.minimum(len(h), first + rng.integers(0, 200, size=300))
    got = decontam._reach(item, first, last, known, own)
    for i, lo, hi, part in zip(item.tolist(), first.tolist(), last.tolist(), got.tolist()):
        weight = space.idf[decontam._buckets(own.words[i])]
        there = np.isin(own.words[i], h[lo:hi])
        assert part == pytest.approx(weight[there].sum() / weight.sum() if len(weight) else 0, abs=1e-6)
        assert decontam.covered(own.words[i], h[lo:hi], weight) == plain_cover(own.words[i], h[lo:hi], weight)
        assert decontam.covered(own.words[i], h[lo:hi], weight) <= part + 1e-6


def test_candidates_cost_little():
    """Over fifteen candidates a window, refused by their words; in time that hashing the texts takes."""
    r, rng = random.Random(3), np.random.default_rng(0)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(4, 8))) for _ in range(3000)]
    docs = [sentence(r, 400, words) for _ in range(300)]
    space = decontam.Space(np.ones(decontam.BUCKETS), rng.standard_normal((decontam.BUCKETS, 8)).astype(np.float32))
    own = decontam._item_block([(i, sentence(r, 36, words), None) for i in range(200)], space)
    hashed = textops.hashed_words(docs)
    windows = decontam.window_vectors(*hashed, space)
    assert (windows[2] @ own.vectors.T >= 0.45).sum() > 15 * len(windows[2])

    def least(run):
        took = []
        for _ in range(5):
            began = time.thread_time()
            run()
            took.append(time.thread_time() - began)
        return min(took)

    assert least(lambda: decontam.search(hashed, windows, space, own, 0.45, 0.6, 0.4)) < 9 * least(lambda: textops.hashed_words(docs))


def test_the_space_is_that_of_all_windows(spark):
    """Forty topics, of which a start on about five windows can know only a few; against the best space of the rank."""
    r = random.Random(8)
    topics = [["".join(r.choice("abcdefgh") for _ in range(7)) for _ in range(12)] for _ in range(40)]
    texts = [sentence(r, 60, topics[k % 40]) for k in range(400)]
    docs, items = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame([(sentence(r, 20, topics[0]),)], "text string")
    runtime.prepare(spark)
    idf, path = decontam.fit(docs, items, "doc_id", "text", 40, 5, 2)
    rows, basis = dense_windows(texts, idf), decontam._get(path) / np.where(idf > 0, idf, 1)[:, None]
    best = np.linalg.eigvalsh(rows @ rows.T)[-40:].sum()
    share = ((rows @ basis) ** 2).sum() / best
    assert share > 0.9


def longest_common(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        held = 0
        for k, y in enumerate(b, 1):
            held, best[k] = best[k], held + 1 if x == y else max(best[k], best[k - 1])
    return best[-1]


def test_recall_against_exhaustive_subsequences(spark):
    """Production parameters but the sample's size; every (document, item) pair by an unweighted subsequence."""
    r = random.Random(12)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(4, 8))) for _ in range(3000)]
    items = [sentence(r, r.randint(12, 40), words) + ". " + sentence(r, 5, words) + "." for _ in range(30)]
    items += [sentence(r, n, words) + ". " + sentence(r, 5, words) + "." for n in (240, 400)]
    docs = []
    for d in range(160):
        item = items[r.randrange(len(items))].split()
        for k in r.sample(range(len(item) - 5), int((len(item) - 5) * r.choice([0, 0.15, 0.3, 0.45]))):
            item[k] = r.choice(words)
        docs.append((d, " ".join([sentence(r, r.randint(0, 200), words), *(item if d % 2 else []), sentence(r, r.randint(1, 200), words)])))
    plain = [t.replace(".", "").split() for t in items]
    passages = {d: t.replace(".", "").split() for d, t in docs}
    want = set()
    for d, own in passages.items():
        for i, item in enumerate(plain):
            part = longest_common(item, own) / len(item)
            said = any(own[k:k + 5] == item[-5:] for k in range(len(own) - 4))
            # Well within either rule: weights and passage bounds settle what lies between.
            if part >= 0.7 or part >= 0.5 and said:
                want.add((d, i))
    found = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    got = {(x.doc_id, x.item_id) for x in found.collect()}
    assert len(want) > 50 and len(got & want) >= 0.95 * len(want)
    assert all(d % 2 for d, _ in got)


# 6 and 8: near-duplicates


def groups_of(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return {n: root(n) for n in nodes}


def edited(r, words, n, vocabulary):
    out = list(words)
    for k in r.sample(range(len(out)), n):
        out[k] = r.choice(vocabulary)
    return out


def test_near_duplicate_classes_match_brute_force(spark, odd, none):
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(800)]
    texts = []
    for _ in range(25):
        base = [r.choice(vocabulary) for _ in range(r.randint(40, 120))]
        texts += [" ".join(edited(r, base, r.choice([0, 0, 1, 2, 4]), vocabulary)) for _ in range(r.randint(1, 6))]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    shingles = [collections.Counter(tuple(t.split()[k:k + 5]) for k in range(len(t.split()) - 4)) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if (shingles[a] & shingles[b]).total() >= 0.8 * (shingles[a] | shingles[b]).total()]
    got = {x.doc_id: x.class_id for x in dart.classes(table).collect()}
    want = groups_of(links, range(len(texts)))
    assert links and np.mean([got[i] == want[i] for i in want]) >= 0.99
    assert dart.keep_one(table).count() == len(set(got.values()))
    rows = dart.classes(odd).collect()
    assert len(rows) == odd.count() and all(x.class_id == x.doc_id for x in rows if x.doc_id in (0, 1, 2, 3, 9))
    kept = dart.keep_one(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 4").count() == 2 and kept.where("doc_id is null").count() == 1
    assert dart.classes(none).count() == 0 and dart.keep_one(none).count() == 0


def test_darts_estimate_weighted_similarity():
    owner, element = np.repeat([0, 1], 300), np.tile(np.arange(300), 2).astype(np.uint64)
    weight = np.random.default_rng(6).uniform(0.2, 4, 600)
    s = dart.dart_signature(2, owner, element, weight, 4096)
    truth = np.minimum(weight[:300], weight[300:]).sum() / np.maximum(weight[:300], weight[300:]).sum()
    assert (s[0] == s[1]).mean() == pytest.approx(truth, abs=0.03)


def test_sketches_let_similar_pairs_through(spark):
    import pyarrow as pa

    r = random.Random(7)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(3000)]
    for mod, lengths in ((dart, (3, 40, 300, 700, 5000)), (lines, (1, 5, 30, 200, 1200))):
        texts = []
        for n in lengths:
            base = [r.choice(vocabulary) for _ in range(n)]
            texts += [" ".join(base)] + [" ".join(edited(r, base, min(k, n), vocabulary)) for k in (1, 2, 5, 9, 30, 60)]
        left = spark.createDataFrame(near.sketches(pa.array(range(len(texts)), pa.int64()), *mod.elements(texts), mod.ODD).to_pylist(), near.SKETCH)
        assert {x.rate for x in left.collect()} == {None, 1, near.RATE}
        right = left.select(*[F.col(c).alias(f"other_{c}") for c in left.columns])
        passed = {(x.node, x.other_node) for x in left.crossJoin(right).where(near.could_be_similar(0.8, mod.ODD)).select("node", "other_node").collect()}
        pairs = [(a, b) for a in range(len(texts)) for b in range(len(texts))]
        alike = {p for p in pairs if mod.similarity([texts[p[0]]], [texts[p[1]]])[0] >= 0.8}
        assert len(alike) > len(texts) and alike <= passed and len(passed) < len(pairs) / 3


def test_distinct_and_folded_sketches(spark):
    rng = np.random.default_rng(3)
    for n in (0, 1, 50):
        x = rng.integers(0, 9, n).astype(np.uint64)
        assert textops.distinct(x).tolist() == sorted(set(x.tolist()))
    a, b = (rng.integers(-(2**63), 2**63 - 1, 64).tolist() for _ in range(2))
    df = spark.createDataFrame([(a, b), (None, b)], "l array<long>, r array<long>")
    got = [r[0] for r in df.select(near._differing_folded("l", "r")).collect()]
    assert got == [sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(a, b)), None]


def test_jaccard_counts_or_sets():
    left = (np.array([0, 0, 0, 2]), np.array([1 << 40, 1 << 40, 2 << 40, 5 << 40], np.uint64))
    right = (np.array([0, 2, 2]), np.array([1 << 40, 5 << 40, 6 << 40], np.uint64))
    assert near.jaccard(3, left, right, True).tolist() == [1 / 3, 0, 0.5] and near.jaccard(3, left, right, False).tolist() == [0.5, 0, 0.5]


def test_union_find_within_and_across_chunks(spark, monkeypatch):
    r = random.Random(8)
    edges = [(r.randrange(150), r.randrange(150)) for _ in range(110)] + [(i, i + 1) for i in range(500, 530)]
    want = groups_of([(a, b) for a, b in edges if a != b], {x for e in edges for x in e if e[0] != e[1]})
    for size in (40, 10_000):
        monkeypatch.setattr(near, "CHUNK_EDGES", size)
        assert {x.node: x.root for x in near.components(spark.createDataFrame(edges, "a long, b long")).collect()} == want
    assert near.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_two_nodes_of_a_value_are_compared_however_often_they_occur(spark):
    fresh = iter(range(1000, 10_000))
    rows = []  # (node, its four band values)
    x, y = 100, 50
    shared, own = [1, 2, 3], [11, 12, 13]
    rows += [(x, [9, *own])] * 2 + [(y, [9, *shared])]
    rows += [(next(fresh), [v, *(next(fresh) for _ in range(3))]) for v in own for _ in range(8)]
    for hub, v in zip((1, 2, 3), shared):  # three hubs of higher degree than x share crowded values with y
        wide = [next(fresh) for _ in range(3)]
        rows += [(hub, [v, *wide])] + [(next(fresh), [v, *(next(fresh) for _ in range(3))]) for _ in range(4)]
        rows += [(next(fresh), [next(fresh), *wide]) for _ in range(20)]
    together = [rows]
    apart = [[(x, [9, *own])], [(x, [9, *own])], rows[2:]]  # y's batch lacks x, which two others have
    for batches in (together, apart):
        blocks = [b for part in batches for b in near.pack(np.array([v for _, v in part], np.uint64), np.array([n for n, _ in part], np.uint64), 2).to_pylist()]
        table = spark.createDataFrame([(b["bucket"], bytearray(b["entries"]), bytearray(b["links"])) for b in blocks], near.BLOCKS)
        found = near.first_compared(near.candidates(table)).collect()
        assert (x, y) in {(max(r.a, r.b), min(r.a, r.b)) for r in found}


def test_fuzzy_lines_match_brute_force(spark, odd, none):
    r = random.Random(9)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 9))) for _ in range(2000)]
    pool = [" ".join(r.choice(vocabulary) for _ in range(r.randint(3, 25))) for _ in range(60)]
    docs = []
    for d in range(60):
        own = []
        for _ in range(r.randint(1, 8)):
            line = r.choice(pool)
            if r.random() < 0.3:
                k = r.randrange(len(line))
                line = line[:k] + "Q" + line[k + 1:]
            own.append(r.choice([line, line.upper(), f"  {line}", "", "ab"]))
        docs.append((d, "\n".join(own)))
    place = collections.defaultdict(list)
    for d, text in docs:
        for k, line in enumerate(lines.split(text)):
            if line:
                place[line].append((d, k))
    keys = list(place)
    sets = [{x[i:i + 5] for i in range(max(1, len(x) - 4))} for x in keys]
    links = [(a, b) for a in range(len(keys)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    parts = collections.defaultdict(list)
    for i, root in groups_of(links, range(len(keys))).items():
        parts[root] += place[keys[i]]
    gone = {p for own in parts.values() for p in sorted(own)[1:]}
    got = {x.doc_id: x.text for x in lines.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert links and got == {d: "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone) for d, t in docs}
    cleaned = lines.dedup(odd)
    assert cleaned.columns == odd.columns and cleaned.count() == odd.count() and cleaned.where("doc_id = 0 and text is not null").count() == 0
    assert lines.dedup(none).count() == 0


CLASHES = ("_node", "_kept", "_lost", "_lost_id", "_bad", "_score", "_class", "node", "id", "text_", "lost_id", "lost_lines", "leaking", "stays", "lines", "want", "root", "class_id", "known", "line", "draw", "label")


def test_columns_of_any_name_are_left_alone(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, f"{text}\nalone here"), (2, f"{text}\nother line"), (3, text), (4, "something else of its own that stays as it is")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    table = table.select("*", *[F.concat(F.lit(c), F.col("doc_id")).alias(c) for c in CLASHES])
    bench = spark.createDataFrame([(1, "something else of its own that stays as it is")], "item_id long, text string")
    for got, ids in ((lines.dedup(table), {1, 2, 3, 4}), (dart.keep_one(table), {1, 2, 3, 4}), (decontam.without_leaks(table, bench), {1, 2, 3})):
        found = got.collect()
        assert got.columns == table.columns and {r.doc_id for r in found} == ids
        assert all(r[c] == f"{c}{r.doc_id}" for r in found for c in CLASHES)


# 9: chroma fingerprints


def test_recordings_align(spark):
    r = np.random.default_rng(10)
    notes = [r.integers(0, 24, 64).astype(float) for _ in range(6)]
    waves = [chroma.tone_wav(n) for n in notes]
    rate, x = chroma.decode_wav(waves[0])
    noisy = chroma.fingerprint(chroma.chroma(rate, x[512 * 7:] + r.normal(0, 0.03, len(x) - 512 * 7)))
    index = chroma.Index([1, 2], [chroma.fingerprint(chroma.chroma(*chroma.decode_wav(w))) for w in waves[:2]])
    (who, offset, error), = index.align(noisy, 4, 16, 0.2)
    assert (who, offset) == (0, 7) and error < 0.1
    shifted = chroma.tone_wav(np.concatenate([notes[0][9:], r.integers(0, 24, 9)]))
    rows = [(0, waves[0]), (20, waves[1]), (21, waves[0]), (22, shifted), (23, None), (24, b"junk"), (25, b""), (40, waves[1]), (41, waves[2]), (None, waves[3])]
    got = {x.id: x for x in chroma.aligned(spark.createDataFrame(rows, "id long, audio binary"), "id", "audio").collect()}
    assert len(got) == len(rows)
    assert (got[21].class_id, got[40].class_id, got[23].class_id, got[23].n_frames) == (0, 20, 23, 0)
    assert got[22].n_links == 1 and got[41].n_links == 0 and got[0].n_links == 0
    assert chroma.aligned(spark.createDataFrame([], "id long, audio binary"), "id", "audio").count() == 0
    assert chroma.decode_wav(waves[0])[0] == 4000 and len(x) == 64 * 512


def test_alignment_recall_against_brute_force():
    r = np.random.default_rng(11)
    prints = [chroma.fingerprint(chroma.chroma(*chroma.decode_wav(chroma.tone_wav(r.integers(0, 24, 48).astype(float))))) for _ in range(20)]
    near_copies = []
    for p in prints:
        q = p.copy()
        q[r.random(len(q)) < 0.4] ^= np.uint32(1) << r.integers(0, 32, dtype=np.uint32)
        near_copies.append(q[3:])
    index = chroma.Index(list(range(20)), prints)
    found = want = 0
    for i, q in enumerate(near_copies):
        best = min((np.bitwise_count(q[max(0, -s):len(p) - s] ^ p[max(0, s):][: len(q)]).mean() / 32, k) for k, p in enumerate(prints) for s in (3,))
        want += best[0] <= 0.2
        found += best[0] <= 0.2 and any(w == best[1] and s == 3 for w, s, _ in index.align(q, 4, 16, 0.2))
    assert want >= 15 and found >= 0.9 * want


def test_offset_counts_against_every_pair():
    """Held tones and silence: integers that all frames share, by correlation, and rare ones, pair by pair."""
    r = np.random.default_rng(12)
    for n, m, kinds in ((1, 1, 1), (300, 500, 2), (700, 40, 3), (200, 200, 150), (900, 800, 5)):
        own, other = (r.integers(0, kinds, k).astype(np.uint32) for k in (n, m))
        want = [int((own[max(0, -s):min(n, m - s)] == other[max(0, -s) + s:min(n, m - s) + s]).sum()) for s in range(1 - n, m)]
        assert chroma.offset_counts(own, other).tolist() == want


def test_alignment_of_held_tones_against_every_pair(monkeypatch):
    r = np.random.default_rng(13)
    prints = [r.integers(0, kinds, n).astype(np.uint32) for n, kinds in ((400, 1), (600, 2), (30, 50), (80, 40), (500, 3), (300, 300), (16, 2))]

    def brute(own):
        for w, other in enumerate(prints):
            n, m = len(own), len(other)
            count, s = max((int((own[max(0, -s):min(n, m - s)] == other[max(0, -s) + s:min(n, m - s) + s]).sum()), -s) for s in range(1 - n, m))
            a, b = max(0, s), min(n, m + s)
            error = np.bitwise_count(own[a:b] ^ other[a - s:b - s]).sum() / (32 * (b - a))
            if count >= 4 and b - a >= 16 and error <= 0.2:
                yield w, -s, float(error)

    index = chroma.Index(list(range(len(prints))), prints)
    for expand in (1, 1000, 1 << 20):
        monkeypatch.setattr(chroma, "EXPAND", expand)
        for own in prints:
            assert index.align(own, 4, 16, 0.2) == list(brute(own))


def test_recordings_in_blocks(spark):
    """Blocks of one recording give what one block gives; an id may name two recordings, or none."""
    r = np.random.default_rng(14)
    notes = [r.integers(0, 24, 40).astype(float) for _ in range(4)]
    rows = [(20 * k, chroma.tone_wav(np.concatenate([notes[k % 4][k:], notes[(k + 1) % 4][:k]]))) for k in range(10)]
    rows += [(20, rows[5][1]), (None, rows[0][1]), (None, chroma.tone_wav(notes[2][3:])), (7, chroma.tone_wav(np.zeros(60))), (40, chroma.tone_wav(np.zeros(90)))]
    table = spark.createDataFrame(rows, "id long, audio binary")
    got = [sorted(map(str, chroma.aligned(table, "id", "audio", block_frames=n).collect())) for n in (1, 100, 1 << 20)]
    assert got[0] == got[1] == got[2] and len(got[0]) == len(rows)


# 10: ORC token files


def test_orc_tokens(spark, odd, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(orc_tokens.default_tokenizer())
    path = runtime.fresh_path(spark, "tokens")
    orc_tokens.write(odd, path, orc_tokens.default_tokenizer())
    rows = orc_tokens.read(spark, path).orderBy("start").collect()
    want = sorted(((r.doc_id, r.text) for r in odd.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    at = 0
    for got, (doc, text) in zip(rows, want, strict=True):
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        assert (got.doc_id, got.start, got.n_tokens, got.ids) == (doc, at, len(ids), ids)
        at += len(ids)
    crc = {r.start: r.ids_crc32 for r in orc_tokens.checksums(orc_tokens.read(spark, path)).collect()}
    assert all(crc[r.start] == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in rows)
    assert {r.doc_id for r in orc_tokens.find(spark, path, [3, 5, 77]).collect()} == {3, 5}
    empty = runtime.fresh_path(spark, "tokens")
    orc_tokens.write(none, empty, orc_tokens.default_tokenizer())
    assert orc_tokens.read(spark, empty).count() == 0


def test_words_are_remembered_as_arrays(monkeypatch):
    """Each word is asked for once until the memory is full, then again; odd letters, surrogates and words of one hash."""
    from tokenizers import Tokenizer

    path = orc_tokens.default_tokenizer()
    t, memo = Tokenizer.from_file(path), orc_tokens.WordIds(path)
    monkeypatch.setattr(orc_tokens, "_word_ids", lambda _: memo)
    r = random.Random(3)
    words = ["".join(r.choice("abcdé\u4e2d\U0001f600 '\u00ad\u0301\t\n9") for _ in range(r.randint(1, 9))) for _ in range(400)]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 40))) for _ in range(60)] + [None, "", " ", *thue_morse(1024), " ".join(thue_morse(1024))]
    want = [t.encode(x or "", add_special_tokens=False).ids + [0] for x in texts]
    for _ in range(2):
        ids, ends = orc_tokens.encode_batch(texts, path)
        assert ids.tolist() == sum(want, []) and ends.tolist() == np.cumsum([len(x) for x in want]).tolist()
    held = memo.first.n
    orc_tokens.encode_batch(texts[:60], path)
    assert memo.first.n == held  # nothing was asked for again
    monkeypatch.setattr(orc_tokens, "MEMO_WORDS", 100)
    assert [x.tolist() for k in range(len(texts)) for x in orc_tokens.encode_texts(texts[k:k + 1], path)] == want
    assert memo.first.n < held and orc_tokens.encode_texts([], path) == []


def test_orc_files_have_indexes_and_bloom_filters(spark):
    path = runtime.fresh_path(spark, "tokens")
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    orc_tokens.write(docs, path, orc_tokens.default_tokenizer())
    local = path.removeprefix("file://")
    data = [open(os.path.join(local, f), "rb").read() for f in os.listdir(local) if f.endswith(".orc")]
    assert data and all(d[:3] == b"ORC" for d in data)
    from pyarrow import orc

    first = orc.ORCFile(os.path.join(local, min(f for f in os.listdir(local) if f.endswith(".orc"))))
    assert first.row_index_stride == 1000 and first.nstripes >= 1


# Pipeline


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = runtime.stored(stage(spark, docs, DATA), "stage")
        assert after.columns == columns and after.count() <= before
        if name == "line dedup":
            assert after.count() == before
        docs, before = after, after.count()
    final = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    got = {r.doc_id: r for r in final.collect()}
    assert len(got) == before
    for r in docs.limit(20).collect():
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
