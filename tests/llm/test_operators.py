"""Each operator against a plain computation, on rows with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomgene.llm import decontaminate, langid, licenses, lm, mixing, quality, sharding, simhash, textcore, tokens, urls
from loomgene.llm.store import written

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, shard string, contamination string, _text string"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def plain_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def alnum_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeÉßüno") for _ in range(rng.randint(1, 7)))
    out = [(0, None, None, None), (1, "", "en", "a"), (2, " \t\n\x0b", "fr", None), (3, "One Two", "de", "b"), (4, "word " * 300, "en", "a"), (None, "no id here at all", "en", "a")]
    for i in range(5, 60):
        out.append((i, " ".join(word() for _ in range(rng.randint(1, 120))) + rng.choice(["", "\n", ".\nEnd!"]), rng.choice(["en", "de", None]), rng.choice(["a", "a", "b", "c", None])))
    out += [(60, out[10][1], "en", "a"), (61, (out[10][1] or "") + " tail", "en", "a"), (7, out[12][1], "xx", "zz")]
    out += [out[8], out[8]]
    out.append((70, " ".join(word() for _ in range(200_000)), "en", "a"))
    return [(*r, 1, 5, "x", "y", "z") for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_match_the_patterns(rows):
    texts = [r[1] for r in rows]
    raw = [t.encode() if t is not None else None for t in texts]
    for classes, fold, split in ((textcore.SPACE_CLASS, True, lambda t: plain_words(lower(t))), (textcore.ALNUM_CLASS, True, alnum_words)):
        w = textcore.scan(raw, classes, fold)
        hashes: dict = {}
        for t, a, b in zip(texts, w.at, w.at[1:]):
            want = split(t)
            assert [lower(w.data[s:e].decode()) for s, e in zip(w.starts[a:b], w.ends[a:b])] == want
            for x, h in zip(want, w.hashes[a:b].tolist()):
                assert hashes.setdefault(x, h) == h
        assert len(set(hashes.values())) == len(hashes)
    x = np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64)
    assert (textcore.unmix(textcore.mix(x)) == x).all()


def plain_fingerprint(t):
    w = plain_words(lower(t))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(values, radius):
    """Of each value the least index of its component."""
    a, root = np.array(values, np.uint64), list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= radius):
            x, y = find(i), find(int(j))
            root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(a))]


def test_simhash(docs, rows, empty):
    got = simhash.near_duplicates(docs.limit(10_000)).collect()
    assert len(got) == len(rows)
    fps = {r.doc: r.fp % (1 << 64) for r in got if r.doc != 7}
    short = [r for r in rows if r[0] != 70]
    for r in short:
        if r[0] != 7:
            assert fps[r[0]] == plain_fingerprint(r[1])
    values = [plain_fingerprint(r[1]) if r[0] != 70 else fps[70] for r in rows]
    roots = closure(values, 2)
    by_root: dict = {}
    for r, k in zip(rows, roots):
        by_root.setdefault(k, []).append(r[0])
    want = Counter((r[0], min((x for x in by_root[k] if x is not None), default=None)) for r, k in zip(rows, roots))
    assert Counter((r.doc, r.component) for r in got) == want
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(by_root)
    assert simhash.near_duplicates(empty).count() == simhash.drop_near_duplicates(empty).count() == 0


@pytest.mark.parametrize("dear,parts,radius", [(0, None, 2), (60, None, 2), (1e9, None, 2), (1e9, 2, 2), (100, 4, 2), (0, None, 1), (0, None, 3), (300, 2, 3)])
def test_simhash_links_lose_nothing(spark, dear, parts, radius):
    rng = random.Random(3)
    fps = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(25):  # chains and balls around a point
            fps.add(base)
            base ^= 1 << rng.randrange(64)
            if rng.random() < 0.6:
                base ^= 1 << rng.randrange(64)
    hub = rng.getrandbits(64)
    fps |= {hub ^ 1 << i for i in range(64)} | {0, (1 << 64) - 1}
    fps = sorted(fps)
    distinct = spark.createDataFrame([(f - (1 << 64) if f >= 1 << 63 else f,) for f in fps], "fp long")
    edges = simhash.links(distinct, radius, parts, dear)
    for a, b in edges.collect():
        assert ((a ^ b) % (1 << 64)).bit_count() <= radius
    roots = {r.node % (1 << 64): r.root for r in simhash.components(edges).collect()}
    want = closure(fps, radius)
    got: dict = {}
    for f, k in zip(fps, want):
        got.setdefault(k, set()).add(roots.get(f, f"alone {f}"))
    assert all(len(s) == 1 for s in got.values()) and len(set.union(*got.values())) == len(got)


def test_pigeonhole_thresholds_sum_up():
    sizes = np.array([[5.0, 1, 1], [1, 1e6, 1e6], [1e6, 1e6, 2]])
    balls = [np.array([0, 1.0, 20.0])] * 3
    t, cost = simhash.allocate(sizes, balls, [21, 21, 22], 2)
    assert (t.sum(1) == 0).all() and t[0].tolist() == [0, 0, 0] and t[1].tolist() == [2, -1, -1] and (cost > 0).all()


def test_language_codes_and_accuracy(spark):
    for n in (2, 3, 4, 7, 8, 20):
        assert langid.code(n).shape[0] == n
    rng = random.Random(2)
    sets = {"aa": "the of and ing tion ".split(), "bb": "der die und ung keit".split(), "cc": "le les eau eux ment".split()}
    data = [(i, " ".join(rng.choice(sets[k]) + rng.choice(sets[k]) for _ in range(rng.randint(3, 40))), k) for i, k in enumerate(["aa", "bb", "cc"] * 40)]
    data += [(200, None, "aa"), (201, "", "bb"), (202, "12 34 !?", None), (203, "word " * 400_000, None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    train, rest = df.where("doc_id % 4 <> 2 and doc_id < 200"), df
    model = langid.train(train)
    assert model.languages == ["aa", "bb", "cc"]
    got = {r.doc_id: r.language for r in langid.predict(rest.drop("lang"), model).collect()}
    assert len(got) == len(data)
    for i, _, k in data[:120]:
        assert got[i].lang == k and 0 <= got[i].score <= 1
    assert all(got[i].lang == "und" and got[i].score == 0 and got[i].ambiguous for i in (200, 201, 202))
    none = langid.train(df.limit(0))
    assert {r.language.lang for r in langid.predict(df, none).collect()} == {"und"}
    assert langid.predict(df.limit(0), model).count() == 0


def test_language_decoding_against_a_plain_version(spark):
    """Counts, weights, losses and shares computed n-gram by n-gram."""
    rng = random.Random(6)
    data = [(i, "".join(rng.choice("abc de"[k:] + "xyz"[:k]) for _ in range(rng.randint(1, 60))), "pqr"[k]) for i in range(150) for k in [rng.randrange(3)]]
    data += [(900, "É" * 5, "q"), (901, "Ab", "p"), (901, "Ab", "p"), (902, None, "p"), (903, "abc", None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "text"), F.lit(langid.FOLDS)) == 0)
    fold = {r.text: r.fold for r in df.collect()}

    def grams(t):
        raw, out = lower(t).encode(), []
        for i in range(len(raw)):
            h = 0
            for k in range(min(3, len(raw) - i)):
                h = (h * 0x01000193 + raw[i + k] + k + 1) % (1 << 32)
                out.append(((h ^ h >> 15) * 0x2C1B3C6D) % (1 << 32) >> 17)
        return out

    def ratios(rows):
        n = {k: Counter(g for _, t, x in rows if x == k and t for g in grams(t)) for k in "pqr"}
        p = {k: lambda g, c=c, s=sum(c.values()): (c[g] + 0.5) / (s + 0.5 * langid.BUCKETS) for k, c in n.items()}
        side = lambda b, g, sign: [p[k](g) for i, k in enumerate("pqr") if code[i][b] == sign]
        return lambda b, g: math.log(sum(side(b, g, 1)) / len(side(b, g, 1))) - math.log(sum(side(b, g, -1)) / len(side(b, g, -1)))

    code = langid.code(3)
    bits = range(code.shape[1])
    margin = lambda ratio, t, b: sum(ratio(b, g) for g in grams(t)) / max(1, len(grams(t)))
    known = [r for r in data if r[1] is not None and r[2] is not None]
    first, full = ratios([r for r in known if not fold[r[1]]]), ratios(known)
    held = [r for r in known if fold[r[1]]]
    right = [sum(margin(first, t, b) * code["pqr".index(k)][b] > 0 for _, t, k in held) for b in bits]
    odds = [max(1e-3, math.log((x + 1) / (len(held) - x + 1))) for x in right]
    weight = [o / (sum(odds) / len(odds)) for o in odds]
    model = langid.train(df)
    assert len(held) > 10 and np.allclose(model.weights, weight)
    for r in langid.predict(df, model).collect():
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.language.lang, r.language.score) == ("und", 0.0)
            continue
        loss = [sum(w * math.log1p(math.exp(-langid.SHARPNESS * margin(full, r.text, b) * code[i][b])) for b, w in zip(bits, weight)) for i in range(3)]
        share = [math.exp(min(loss) - x) / sum(math.exp(min(loss) - y) for y in loss) for x in loss]
        assert r.language.lang == "pqr"[share.index(max(share))] and r.language.score == pytest.approx(max(share), abs=1e-4)


def test_language_bits_correct_errors():
    model = langid.Model(["a", "b", "c", "d"], np.ones((4, langid.BUCKETS)))
    for k, word in enumerate(model.code):
        for b in range(len(word)):
            flipped = word.copy()
            flipped[b] = -flipped[b]
            assert model.decode(flipped[None])[0][0] == k


def test_shuffle(spark, docs, rows, empty):
    got = sharding.shuffle(docs, bucket_bytes=20_000)
    assert got.columns[:-2] == docs.columns and got.columns[-2:] == ["_shard", "slot"]
    out = got.collect()
    assert Counter(tuple(r[:-2]) for r in out) == Counter(rows)
    for k in range(8):
        slots = sorted(r.slot for r in out if r._shard == k)
        assert slots == list(range(len(slots)))
    sizes = Counter(r._shard for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    key = lambda r: (r._shard, r.slot)
    again = sharding.shuffle(docs.repartition(7), bucket_bytes=20_000).collect()
    assert [tuple(r) for r in sorted(again, key=key)] == [tuple(r) for r in sorted(out, key=key)]
    assert sharding.shuffle(empty).count() == 0


def test_shuffle_spreads_equal_rows_and_mixes(spark, tmp_path):
    df = spark.createDataFrame([(1, "x" * 200)] * 500 + [(i, "t") for i in range(1000)], "doc_id long, text string")
    out = sharding.shuffle(df, bucket_bytes=5_000)
    got = out.collect()
    assert len(got) == 1500 and len({(r.shard, r.slot) for r in got}) == 1500
    places = [r.slot * 8 + r.shard for r in got if r.text == "t"]
    ids = [r.doc_id for r in got if r.text == "t"]
    assert abs(np.corrcoef(places, ids)[0, 1]) < 0.12
    sharding.write_shards(out, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 1500


def test_licenses(spark, docs, rows, empty):
    more = [(100, "x CC-BY  cc by\nGeneral Public   License", None), (101, "All rights. Reserved all rights reserved", None), (102, "Licensed under the Apache License, Version 2.0.", None), (103, "filler " * 2000 + "released under the mit license " + "filler " * 2000, None), (104, "all rights", None), (105, None, "reserved")]
    df = spark.createDataFrame([(r[0], r[1], r[2]) for r in rows] + more, "doc_id long, text string, licenses string")
    out = licenses.find(df)
    assert out.columns == ["doc_id", "text", "licenses", "_licenses"]
    sets = [(label, set(w), licenses.step_of(w)) for label, w in ((label, alnum_words(t)) for label, t in licenses.ALL_TEMPLATES)]
    got = out.collect()
    assert len(got) == len(rows) + len(more)
    for r in got:
        w, g = alnum_words(r.text), r._licenses
        at = [(i, label) for p, label in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        met = [(label, len(b & s) / len(s)) for label, s, n in sets for b in (set(w[k : k + 2 * n]) for k in range(0, len(w), n)) if len(b & s) >= math.ceil(licenses.THRESHOLD * len(s) - 1e-9)]
        assert (g.n_words, g.n_base, g.first_word, g.last_word) == (len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None))
        assert g.base_labels == sorted({x for _, x in at}) and g.labels == sorted({x for _, x in at} | {x for x, _ in met})
        assert g.score == (1.0 if at else max((c for _, c in met), default=0.0))
    by_id = {r.doc_id: r._licenses for r in got}
    assert by_id[102].labels == ["apache-2.0"] and by_id[103].labels == ["mit"] and by_id[100].base_labels == ["cc-by", "gpl"]
    assert licenses.find(empty).count() == 0


def test_license_templates_of_any_length(spark):
    """A template of 300 words from a table, whole and with a tenth of its words gone, anywhere in a text; and the whole texts."""
    rng = random.Random(4)
    long_ = [f"{rng.choice('abcdefgh')}{i}" for i in range(300)]
    table = spark.createDataFrame([("own", " ".join(long_).upper()), ("tiny", "One!"), (None, "x"), ("empty", " ")], "label string, text string")
    templates = licenses.templates_of(table)
    assert [x for x, _ in templates] == ["own", "tiny"]
    filler = lambda n: [rng.choice(["lorem", "ipsum", "b2", "ones_"]) for _ in range(n)]
    cut = [x for i, x in enumerate(long_) if i % 11]
    rows = [(1, " ".join(long_)), (2, " ".join(filler(777) + long_ + filler(50))), (3, " ".join(filler(5000) + cut)), (4, " ".join(long_[:250])), (5, " ".join(filler(5000)) + " one"), (6, " ".join(x + " pad pad pad pad pad" for x in long_))]
    got = {r.doc_id: r.licenses for r in licenses.find(spark.createDataFrame(rows, "doc_id long, text string"), templates=templates).collect()}
    assert [got[i].labels for i in range(1, 7)] == [["own"], ["own"], ["own"], [], ["tiny"], []]
    assert got[1].score == 1.0 and 0.9 <= got[3].score < 1
    full = spark.createDataFrame([(i, " ".join(filler(60 * i)) + t + " end") for i, (_, t) in enumerate(licenses.FULL_TEXTS)], "doc_id long, text string")
    for r in licenses.find(full).collect():
        assert licenses.FULL_TEXTS[r.doc_id][0] in r.licenses.labels


def test_token_histogram(spark, docs, rows, empty):
    n = np.array([len(tokens.encoder().encode_ordinary(r[1] or "")) for r in rows])
    got = tokens.token_counts(docs).collect()
    assert sorted(r.n_tokens for r in got) == sorted(set(n.tolist()))
    for r in got:
        length = r.n_tokens
        assert (r.docs, r.docs_at_least, r.tokens_at_least, r.truncated_total, r.total) == ((n == length).sum(), (n >= length).sum(), n[n >= length].sum(), np.minimum(n, length).sum(), n.sum())
        assert r.quantile == (n <= length).mean()
    asked = [0, 1, 50, 127, 128, 200, 5_000, int(n.max()) - 1, int(n.max()), 10**7]
    limits = spark.createDataFrame([(x,) for x in asked], "limit long")
    answers = tokens.at_limits(tokens.token_counts(docs), limits).collect()
    assert sorted(r.limit for r in answers) == asked
    for r in answers:
        assert (r.docs_longer, r.truncated_total) == ((n > r.limit).sum(), np.minimum(n, r.limit).sum())
    assert tokens.token_counts(empty).count() == 0


def test_tokens_of_texts_that_are_cut(monkeypatch):
    monkeypatch.setattr(tokens, "PIECE", 7)
    monkeypatch.setattr(tokens, "_LONG", re.compile(f"[{tokens.BLANK}]{{3,}}"))
    rng = random.Random(8)
    parts = ["a", "Word", "it's", "'", "12", "#!", "é", "語", " ", "  ", "   ", "\n", "\n\n\n", "\t ", "\u00a0", "\u2003 ", "\x1c", "     \n"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert tokens.encoded_length(t) == len(tokens.encoder().encode_ordinary(t)), repr(t)
        assert "".join(x for x, _ in tokens._pieces(t)) == t


@pytest.mark.parametrize("text", [" " * 10_000_000 + "x", "\n" * 3_000_000, "x" * 3_000_000, "word " * 2_000_000, " \u00a0" * 500_000 + "end"])
def test_tokens_of_very_long_texts(text):
    assert tokens.encoded_length(text) > 0


def test_urls(spark):
    urls_ = [None, "", "no scheme", "http://A.Example.COM:80/en/7?x", "https://example.com/en/71#a/b", "http://xcom/en/1", "http://com/en/", "//x", "http://", "http://x.net/de/8", "http://example.net/de/8", "x://y?z://w/en/", "http://ok.org/fr/free-betsy", "http://ok.org/fr/free-bets", "http://h.org/CHEAP/pills", "http://h.org/cheap/cheap", "http://spam-farm.org/es/", "http://É.com/en"]
    df = spark.createDataFrame([(i, u, "k") for i, u in enumerate(urls_)] + [(0, None, "k")], "page_id long, url string, url_verdict string")
    got = urls.judge(df)
    assert got.columns == ["page_id", "url", "url_verdict", "_url_verdict"]
    for r in got.collect():
        m = re.match(r"^(.*?)://([^/?#]*)([^?#]*)", r.url or "", re.S)
        host, path = (lower(m[2]), m[3]) if m else ("", "")
        fit = [x for x in urls.RULES if (host == x[1] or host.endswith("." + x[1])) and path.startswith(x[2])]
        rule = max(fit, key=lambda x: len(x[1] + x[2]), default=None)
        low = lower(r.url)
        count = lambda t: len(re.findall(rf"(?<![a-z0-9]){t}(?![a-z0-9])", low))
        bad = sum(map(count, urls.STRICT)) > 0 or sum(count(t) > 0 for t in urls.SOFT) >= urls.SOFT_LIMIT
        v = r._url_verdict
        assert (v.host, v.path, v.rule) == (host, path, rule and rule[1] + rule[2])
        assert v.verdict == (rule[0] if rule else "block" if bad else "allow"), r.url
    assert urls.judge(df.limit(0)).count() == 0


def hits(w, phrases):
    covered, items = set(), set()
    for item, p in phrases:
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                covered.update(range(i, i + len(p)))
                items.add(item)
    return covered, items


def test_decontamination_passes_one_after_another(spark):
    df = spark.createDataFrame([(i, f"w{i} " * 20 + "x") for i in range(30)], "doc_id long, text string")
    items = spark.createDataFrame([(i, f"w{i} " * 15) for i in range(0, 30, 3)], "item_id long, text string")
    found = decontaminate.find(df, items, block_bytes=200)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert {r.doc_id for r in found.where("contamination.contaminated").collect()} == set(range(0, 30, 3))


def test_window_classes():
    rng = np.random.default_rng(3)
    words = rng.integers(2, 5, 300)
    for size in (1, 2, 3, 5, 8, 13):
        got = decontaminate.window_classes(words, size)
        want = [tuple(words[i : i + size]) for i in range(300 - size + 1)]
        assert len(got) == len(want) and len(set(zip(got.tolist(), want))) == len(set(want)) == len(set(got.tolist()))


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_decontamination(spark, rows, block_bytes):
    short = [r[:2] for r in rows if r[0] != 70]
    w = [alnum_words(r[1]) for r in short]
    long_ = [x for x in w if len(x) > 40]
    bench = [(1, " ".join(long_[0][3:30])), (2, " ".join(long_[1][5:9])), (3, None), (4, ""), (5, "!!"), (10, " ".join(long_[0][20:38]).upper()), (6, "One,  two"), (None, " ".join(long_[2][:14])), (1, " ".join(long_[0][3:30]))]
    items = spark.createDataFrame(bench, "item_id long, text string")
    extra = [(500, " ".join(long_[0] * 2)), (501, ("pad " * 999 + " ".join(long_[0][3:16]) + " pad ") * 3)]
    df = spark.createDataFrame(short + extra, "doc_id long, text string")
    phrases = []
    for item, t in bench:
        x = alnum_words(t)
        n = min(13, len(x))
        phrases += [("" if item is None else str(item), x[i : i + n]) for i in range(len(x) - n + 1 if n else 0)]
    found = decontaminate.find(df, items, block_bytes=block_bytes)
    for r in found.collect():
        words = alnum_words(r.text)
        covered, own = hits(words, phrases)
        c = r.contamination
        assert (c.n_words, c.n_hit, c.items) == (len(words), len(covered), sorted(own))
        assert c.contaminated == (len(covered) > 0 and 20 * len(covered) >= len(words))
        assert {i for s in c.spans for i in range(s.first_word, s.end_word)} == covered
        raw = (r.text or "").encode()
        for s in c.spans:
            assert alnum_words(raw[s.first_byte : s.end_byte].decode()) == words[s.first_word : s.end_word]
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(found).collect()}
    assert alnum_words(cut[501]) == ["pad"] * 3000
    whole = {r.doc_id: r.contamination for r in found.collect()}
    for r in df.collect():
        if r.doc_id != 7:  # an id that occurs twice
            gone = {i for x in whole[r.doc_id].spans for i in range(x.first_word, x.end_word)}
            assert alnum_words(cut[r.doc_id]) == [x for i, x in enumerate(alnum_words(r.text)) if i not in gone]
    kept = decontaminate.drop_contaminated(df, items)
    assert kept.columns == df.columns and kept.count() == found.where("not contamination.contaminated").count()
    assert decontaminate.find(df, items.limit(0)).where("contamination.n_hit > 0").count() == 0
    assert decontaminate.find(df.limit(0), items).count() == 0


def test_fm_index():
    rng = np.random.default_rng(4)
    for n, most in ((1, 1), (50, 2), (400, 3), (400, 200)):
        text = rng.integers(1, most + 1, n)
        index = decontaminate.FMIndex(text, 5)
        for length in (1, 2, 4):
            patterns = np.array([text[i : i + length] for i in range(0, n - length + 1, 7)] + [rng.integers(1, most + 2, length) for _ in range(5)])
            lo, hi = index.search(patterns.ravel(), np.arange(len(patterns)) * length, length)
            for p, a, b in zip(patterns, lo, hi):
                want = [i for i in range(n - length + 1) if (text[i : i + length] == p).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_quality_signals_and_verdicts(docs, rows, empty):
    own = quality.signals(docs, "text", ["doc_id"])
    got = Counter((r.doc_id, tuple(r.sig)[:5]) for r in own.collect())
    want = Counter()
    for r in rows:
        t, w = r[1] or "", plain_words(r[1])
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if plain_words(x)]
        want[(r[0], (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)))] += 1
    assert got == want
    kept = quality.drop_low_quality(docs)
    assert kept.columns == docs.columns
    assert all(len(plain_words(r.text)) >= 50 for r in kept.collect())
    assert quality.drop_low_quality(empty).count() == 0


def test_quality_thresholds_adapt_per_group(spark):
    rng = random.Random(1)
    text = lambda bad: " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 8))) + ("***" if rng.random() < bad else "") for _ in range(rng.randint(60, 120)))
    data = [(i, text(0), "en", "clean") for i in range(150)] + [(200 + i, text(0.9), "en", "clean") for i in range(5)] + [(300 + i, text(0.9), "en", "starry") for i in range(150)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality.drop_low_quality(df).collect()}
    assert kept == set(range(150)) | set(range(300, 450))


def test_quality_bounds_a_group_by_its_language(spark):
    """A source of which a third is junk would allow it by its own quantiles; those of its language do not."""
    rng = random.Random(2)
    text = lambda bad: " ".join("word" + rng.choice("abc") * rng.randint(1, 9) + "#" * bad for _ in range(rng.randint(60, 120)))
    data = [(i, text(0), "en", f"s{i % 8}") for i in range(800)] + [(1000 + i, text(0 if i % 3 else 2), "en", "mixed") for i in range(90)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    gone = {i for i, *_ in data} - {r.doc_id for r in quality.drop_low_quality(df).collect()}
    assert gone >= {1000 + i for i in range(0, 90, 3)} and len(gone - {1000 + i for i in range(0, 90, 3)}) < 9


def test_quality_verdicts_come_from_the_groups(spark):
    """Fences differ between groups, and for some rates no single cutoff gives the groups' verdicts."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    sig = written(quality.signals(docs, "text", ["lang", "source"]), "signals")
    fences = written(quality.thresholds(sig), "fences")
    groups = fences.collect()
    values = [r[f"hi_{k}"] for r in groups for k in quality.RATES]
    assert Counter(values).most_common(1)[0][1] < len(values) / 10
    rates = sig.select("lang", "source", quality.base_failed().alias("failed"), *[v.alias(k) for k, v in quality.rates().items()])
    own = rates.where("not failed").join(fences, (F.col("lang") == F.col("g_lang")) & (F.col("source") == F.col("g_source")))
    r = own.agg(*[x.alias(f"{n}_{k}") for k in quality.RATES for n, x in (("kept", F.max(F.when(F.col(k) <= F.col(f"hi_{k}"), F.col(k)))), ("gone", F.min(F.when(F.col(k) > F.col(f"hi_{k}"), F.col(k)))))]).first()
    mixed = [k for k in quality.RATES if r[f"gone_{k}"] is not None and r[f"kept_{k}"] > r[f"gone_{k}"]]
    assert {"symbol_rate", "repeat_rate"} <= set(mixed), mixed
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    verdict = quality.drop_low_quality(docs).select("doc_id").withColumn("kept", F.lit(1))
    base = quality.signals(docs, "text", ["doc_id"]).select("doc_id", quality.base_failed().alias("failed"))
    share = {x.quality: x.share for x in base.where("not failed").join(labels, "doc_id").join(verdict, "doc_id", "left").groupBy("quality").agg((F.count("kept") / F.count("*")).alias("share")).collect()}
    assert share[1] > 0.99 and share[0] < 0.05, share


def test_mixing(spark, docs, rows, empty):
    got = mixing.mix_sizes(docs).collect()
    assert len(got) == len(rows)
    size = Counter()
    for r in rows:
        size[r[3]] += len(plain_words(r[1]))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    goal, open_ = {}, set(order)
    left = 1.5 * sum(size.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * size[s]}
        if not over:
            goal |= {s: level * weight[s] for s in open_}
            break
        goal |= {s: 2.0 * size[s] for s in over}
        left -= sum(goal[s] for s in over)
        open_ -= over
    largest = max(len(plain_words(r[1])) for r in rows)
    by_id = {r[0]: r for r in rows if r[0] != 7}
    taken = Counter()
    for r in got:
        if r.doc in by_id:
            s = by_id[r.doc][3]
            assert r.size == len(plain_words(by_id[r.doc][1])) and r.source_size == size[s] and abs(r.target - goal[s]) < 1e-6
            taken[s] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    for s in order:
        assert abs(taken[s] - goal[s]) <= largest
    out = mixing.mix(docs)
    assert out.columns == docs.columns and out.count() == sum(r.times for r in got)
    assert mixing.mix_sizes(empty).count() == mixing.mix(empty).count() == 0


def test_language_model(spark, rows, empty):
    df = spark.createDataFrame([(r[0], r[1], "x") for r in rows], "doc_id long, text string, lm string")
    train = df.where("doc_id is not null and doc_id < 50")
    model = lm.train(train, bucket_bytes=2000)
    tok = [plain_words(lower(r[1])) + [0] for r in rows]
    uni, bi = Counter(), Counter()
    for r, t in zip(rows, tok):
        if r[0] is not None and r[0] < 50:
            uni.update(t)
            bi.update(zip([1, *t], t))
    n, v = sum(uni.values()), len(uni)
    assert (model.tokens, model.words, model.pairs) == (n, v, len(bi))

    def discounts(c):
        k = [sum(1 for x in c.values() if x == i) for i in (1, 2, 3, 4)]
        if min(k) == 0:
            return [0, 0.75, 0.75, 0.75]
        y = k[0] / (k[0] + 2 * k[1])
        return [0] + [min(max(i + 1 - (i + 2) * y * k[i + 1] / k[i], 0.05), i + 1) for i in range(3)]

    before, total, kinds = Counter(w for _, w in bi), Counter(), {}
    for (a, _), c in bi.items():
        total[a] += c
        kinds.setdefault(a, [0] * 4)[min(c, 3)] += 1
    d, e = discounts(bi), discounts(before)
    left = sum(e[min(c, 3)] for c in before.values()) / len(bi)

    def p(a, w):
        low = (before[w] - e[min(before[w], 3)]) / len(bi) + left / (v + 1)
        if a not in total:
            return low
        c = bi[(a, w)]
        return (c - d[min(c, 3)]) / total[a] + sum(d[k] * kinds[a][k] for k in (1, 2, 3)) / total[a] * low

    for a in [1, *list(total)[:5], "unseen"]:  # sums to one over known words and one unknown
        assert abs(sum(p(a, w) for w in uni) + p(a, "never seen") - 1) < 1e-9
    got = lm.score(df, model)
    assert got.columns == ["doc_id", "text", "lm", "_lm"]
    found = Counter((r.doc_id, r._lm.n_tokens, r._lm.n_known, round(r._lm.base_score, 5), round(r._lm.score, 5)) for r in got.collect())
    want = Counter((r[0], len(t), sum(w in uni for w in t), round(sum(math.log10((uni[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 5), round(sum(math.log10(p(a, w)) for a, w in zip([1, *t], t)), 5)) for r, t in zip(rows, tok))
    near = lambda c: sorted((str(x[:3]), x[3], x[4]) for x in c.elements())
    for x, y in zip(near(found), near(want), strict=True):
        assert x[0] == y[0] and abs(x[1] - y[1]) < 1e-4 + 1e-9 * abs(y[1]) and abs(x[2] - y[2]) < 1e-4 + 1e-9 * abs(y[2])
    nothing = lm.train(empty)
    assert {(r.lm.score, r.lm.base_score) for r in lm.score(df.drop("lm"), nothing).collect()} == {(0.0, 0.0)}
    assert lm.score(empty, model).count() == 0


@pytest.mark.parametrize("order", [3, 4])
def test_language_model_of_higher_order(spark, order):
    rng = np.random.default_rng(order)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 12, rng.integers(0, 30)) * rng.integers(0, 2)) for _ in range(300)] + ["a b " * 300, ""]
    model = lm.train(spark.createDataFrame([(t,) for t in texts], "text string"), bucket_bytes=200, order=order)
    c = [Counter() for _ in range(order + 1)]
    for t in texts:
        seq = [1, *t.split(), 0]
        for o in range(1, order + 1):
            c[o].update(tuple(seq[i - o + 1 : i + 1]) for i in range(max(1, o - 1), len(seq)))
    used = [Counter() for _ in range(order)] + [c[order]]
    for o in range(1, order):
        used[o] = Counter(g[1:] for g in c[o + 1])
        used[o].update({g: n for g, n in c[o].items() if g not in used[o]})

    def discounts(counts):
        k = [sum(1 for x in counts.values() if x == i) for i in (1, 2, 3, 4)]
        if min(k) == 0:
            return [0, 0.75, 0.75, 0.75]
        y = k[0] / (k[0] + 2 * k[1])
        return [0] + [min(max(i + 1 - (i + 2) * y * k[i + 1] / k[i], 0.05), i + 1) for i in range(3)]

    d = [None, *(discounts(used[o]) for o in range(1, order + 1))]
    follow = {}
    for o in range(1, order + 1):
        for g, n in used[o].items():
            follow.setdefault(g[:-1], []).append((n, d[o][min(n, 3)]))

    def p(context, w):
        low = 1 / (len(c[1]) + 1) if not context else p(context[1:], w)
        if context not in follow:
            return low
        o, total = len(context) + 1, sum(n for n, _ in follow[context])
        n = used[o][(*context, w)]
        return (n - d[o][min(n, 3)] + sum(x for _, x in follow[context]) * low) / total

    assert abs(sum(p(("w3", "w5")[: order - 1], w) for (w,) in c[1]) + p(("w3", "w5"), "unseen") - 1) < 1e-9
    tries = [*texts[:20], "a b a b", "w1 unseen w3 w4 w5", "unseen", ""]
    want = []
    for t in tries:
        seq = [1, *t.split(), 0]
        want.append(sum(math.log10(p(tuple(seq[max(0, i - order + 1) : i]), seq[i])) for i in range(1, len(seq))))
    got = lm.log_probabilities(model, [t.encode() for t in tries])[3]
    assert np.allclose(got, want, atol=1e-9)
    pair = lm.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert lm.log_probabilities(pair, [b"a b a b"])[3][0] != got[20]


def test_language_model_of_many_buckets_keeps_few_files(spark):
    """2 ** 14 buckets: the same scores as with few, in a few large files, and no descriptor stays open."""
    import os
    from pathlib import Path

    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randint(0, 400)}" for _ in range(rng.randint(1, 12))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    few, many = lm.train(df, order=3), lm.train(df, bucket_bytes=sum(map(len, texts)) / (1 << 14), order=3)
    assert (few.bits, many.bits) == (4, 14)
    raw = [t.encode() for t in texts]
    before = len(os.listdir("/proc/self/fd"))
    assert all(np.allclose(x, y) for x, y in zip(lm.log_probabilities(few, raw), lm.log_probabilities(many, raw)))
    assert len(os.listdir("/proc/self/fd")) <= before + 2
    files = [x for x in Path(many.uri.removeprefix("file://")).rglob("*") if x.is_file()]
    assert len(files) <= 2 * 64 * len(many.files) and not any(".part" in str(x) for x in files)


def test_language_model_reads_each_word_once_and_leaves_no_shuffles(spark, monkeypatch):
    texts = ["a b a b c", "b a", "", "c c c c"]
    cleaned, asked, gone = [], [], lm.put_together
    monkeypatch.setattr(lm, "put_together", lambda *a: (cleaned.append(spark.conf.get(lm.CLEANUP)), gone(*a)))
    before = spark.conf.get(lm.CLEANUP, None)
    model = lm.train(spark.createDataFrame([(t,) for t in texts], "text string"), order=3)
    assert set(cleaned) == {"true"} and spark.conf.get(lm.CLEANUP, None) == before
    read = lm.word_stats
    monkeypatch.setattr(lm, "word_stats", lambda m, numbers: (asked.extend(numbers.tolist()), read(m, numbers))[1])
    lm.log_probabilities(model, [t.encode() for t in texts])
    assert len(asked) == len(set(asked)) == 5  # three words, begin and end
    first = np.array([0, 3, 6])
    assert lm._each(first, np.array([4, -1, 0, 4, 5]), lambda b, at: first[b] + at).tolist() == [4, 0, 0, 4, 5]


def test_language_model_large_counts(spark):
    model = lm.train(spark.createDataFrame([("a b " * 700,), ("c",)], "text string"))
    _, known, _, score = lm.log_probabilities(model, [b"a b", b"b a", b"zz"])
    assert known.tolist() == [3, 3, 1] and np.isfinite(score).all()
    n = lm.word_numbers(model, lm.sequences([b"a b"])[0])
    assert lm.pair_counts(model, lm.pair_keys(n[:-1], n[1:])).tolist() == [1, 700, 1]


def test_remainders_match_zlib(spark):
    from loomgene.llm.queries import _remainder

    for r in spark.range(50).selectExpr("id as doc_id").withColumn("m", _remainder(5)).collect():
        assert r.m == zlib.crc32(str(r.doc_id).encode()) % 5


def test_items_digest():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_extra_columns_of_any_name_and_type(spark):
    """A struct with fields that are no identifiers, a map and an array ride along through all operators that return rows."""
    extra = ["named_struct('content-type', 'a b', 'x.y', 1) as `odd col`", "map('k', 1) as `_r0`", "array(1, 2) as `fp`"]
    docs = spark.range(1, 90).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 60), x -> concat('w', (x * id) % 97, if(x % 9 = 0, '\\n', '')))) as text", "'en' as lang", "'s' as source", "concat('http://a.com/', id) as url", *extra)
    rows = Counter(str(r) for r in docs.collect())
    items = spark.createDataFrame([(1, "w1 w2 w3")], "item_id long, text string")
    for out in (quality.drop_low_quality(docs), simhash.drop_near_duplicates(docs), decontaminate.drop_contaminated(docs, items), mixing.mix(docs)):
        assert out.columns == docs.columns and set(str(r) for r in out.collect()) <= set(rows)
    model, grams = langid.train(docs), lm.train(docs)
    for out in (sharding.shuffle(docs), licenses.find(docs), urls.judge(docs), decontaminate.find(docs, items), langid.predict(docs, model), lm.score(docs, grams)):
        assert out.columns[: len(docs.columns)] == docs.columns
        assert Counter(str(r) for r in out.select(*[F.col(f"`{c}`") for c in docs.columns]).collect()) == rows
    assert tokens.histogram(docs).agg(F.sum("docs")).first()[0] == 89


def test_very_long_texts_in_all_operators(spark):
    """10 MB without a break, of blanks, and of words: judged whole, with the values that plain code gives."""
    texts = ["x" * 10_000_000, " " * 10_000_000 + "x", "ab cd\n" * 1_700_000]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").repartition(3)
    items = spark.createDataFrame([(1, "cd ab cd")], "item_id long, text string")
    assert {r.doc_id: r.sig.n_words for r in quality.signals(docs, "text", ["doc_id"]).collect()} == {0: 1, 1: 1, 2: 3_400_000}
    fps = {r.doc_id: r.fp % (1 << 64) for r in simhash.fingerprints(docs, "text", ["doc_id"]).collect()}
    assert fps == {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    found = {r.doc_id: r.contamination for r in decontaminate.find(docs, items).collect()}
    assert [found[i].n_hit for i in range(3)] == [0, 0, 3_399_999] and len(found[2].spans) == 1
    assert {r.doc_id: r.licenses.n_words for r in licenses.find(docs).collect()} == {0: 1, 1: 1, 2: 3_400_000}
    assert sharding.shuffle(docs).count() == 3 and mixing.mix_sizes(docs).agg(F.sum("size")).first()[0] == 3_400_002
    model, grams = langid.train(docs), lm.train(docs)
    assert {r.language.lang for r in langid.predict(docs, model).collect()} == {"en"}
    assert {r.doc_id: r.lm.n_tokens for r in lm.score(docs, grams).collect()} == {0: 2, 1: 2, 2: 3_400_001}
    assert tokens.histogram(docs).count() == 3
