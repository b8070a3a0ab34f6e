"""The document operators against plain Python, and on odd tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

from docloom.llm import decontaminate, jaccard, language, licenses, mixing, quality, repeats, rules, suffixes, tokens, toxicity

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _bits int, key string, row string, h string, _measures string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed, n=120, vocabulary=400):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{k}" for k in rng.integers(0, vocabulary, n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blanks, short and long texts, exact and near copies, repeated rows, odd characters."""
    base = prose(1)
    rows = [
        (1, base, "en", "b"),
        (2, base, "en", None),
        (3, base.replace("w5 ", "x ", 1) + " end", "fr", "a"),
        (4, None, None, "a"),
        (5, "", "en", "a"),
        (6, " \n\t ", "en", "c"),
        (7, "one two", "de", "a"),
        (8, "one two", "de", "a"),
        (8, "one two", "de", "a"),
        (None, prose(2), "en", "b"),
        (None, None, None, None),
        (9, "a " * 3000, "en", "b"),
        (10, "é 日本 語 ☃ <|endoftext|> ![] " + prose(3, 4000), "fr", "c"),
        (11, prose(4, 30), None, ""),
    ]
    return spark.createDataFrame([(k, t, g, s, 1, 2, "x", "y", "z", "m") for k, t, g, s in rows], COLUMNS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def counted(found):
    return collections.Counter(found)


# quality rules


def test_repeated_words_by_counting():
    rng = np.random.default_rng(0)
    for n in (0, 3, 7, 8, 9, 30, 200):
        words = [f"{k}".encode() for k in rng.integers(0, 2, n)]
        windows = [tuple(words[i : i + 8]) for i in range(n - 7)]
        often = collections.Counter(windows)
        expected = len({k for i, w in enumerate(windows) if often[w] > 1 for k in range(i, i + 8)})
        assert rules.repeated_words(words) == expected


def test_ledger_of_odd_rows(odd, none):
    found = rules.apply_policy(rules.ledger(odd))
    assert found.count() == odd.count()
    by = {r.doc_id: r for r in found.collect() if r.doc_id is not None}
    assert (by[4].n_words, by[4].fail_bits, by[4].kept) == (0, rules.BITS["few_words"], False)
    assert by[9].base_failed and by[9].n_repeat_words == 3000
    assert by[1].kept and by[11].kept
    assert rules.ledger(none).count() == 0 and rules.keep_good(none).count() == 0
    kept = rules.keep_good(odd)
    assert kept.columns == odd.columns
    assert counted(rows(kept, "doc_id")) == counted(rows(found.where("kept"), "doc_id"))


def test_ablations_by_counting(docs):
    ledger = rules.ledger(docs).cache()
    bits = [r.fail_bits for r in ledger.collect()]
    for r in rules.ablations(ledger).collect():
        mask = next(p.mask for p in rules.POLICIES if (p.name, p.version) == (r.policy, r.version))
        bit = rules.BITS[r.rule]
        assert r.rejected == sum(b & mask != 0 for b in bits)
        assert r.failing == sum(b & bit != 0 for b in bits)
        assert r.only_this == sum(b & mask == bit for b in bits)


# mixing


def test_mix_of_odd_rows(odd, none):
    found = mixing.mix(odd)
    assert found.count() == odd.count()
    sums = {}
    for r, source in zip(found.collect(), [None] * found.count()):
        assert 0 <= r.taken <= 2 * r["size"] and r.target <= 2 * r.source_size
        sums.setdefault((r.source_size, r.target), []).append((r["size"], r.taken))
    for (size, target), own in sums.items():
        assert abs(sum(t for _, t in own) - target) <= max((s for s, _ in own), default=0)
    assert mixing.mix(none).count() == 0 and mixing.take_mix(none).count() == 0


def test_taken_rows_follow_the_mix(docs):
    wanted = {r.doc_id: r.copies for r in mixing.mix(docs).collect() if r.copies}
    found = mixing.take_mix(docs)
    assert found.columns == docs.columns
    assert counted(r.doc_id for r in found.collect()) == wanted
    assert counted(r.doc_id for r in mixing.take_mix(docs.repartition(3)).collect()) == wanted


# token ids


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 31, 32])
def test_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 777).astype("<u4")
    payload = tokens.pack(ids, bits)
    assert len(payload) == -(-777 * bits // 8)
    assert (tokens.unpack(payload, bits, 777) == ids).all()
    assert (tokens.unpack(payload, bits, 100, 501) == ids[501:601]).all()


def test_encoder_agrees_with_the_tokenizer(docs):
    encode = tokens.encoder(tokens.VOCABULARY)
    texts = [r.text for r in docs.limit(40).collect()]
    texts += ["  a  b", "a \n b", " lead", "trail ", "", "x", "it's  'll don't", "日本 語　です", "t\tx \x1c y", "  a", "a<|endoftext|> b"]
    plain = [encode.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids.tolist() for ids in encode.encode(texts)] == plain
    assert [encode.encode([t])[0].tolist() for t in texts] == plain


def test_token_file_of_odd_rows(spark, odd, none, tmp_path):
    path = str(tmp_path / "ids")
    tokens.write_ids(odd, path, block_ids=500)
    found = tokens.read_documents(spark, path).orderBy("start").collect()
    encode = tokens.encoder(tokens.VOCABULARY).tokenizer
    stream = []
    expected = []
    for r in sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        ids = encode.encode(r.text or "", add_special_tokens=False).ids + [tokens.END_ID]
        expected.append((r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        stream.append(ids)
    assert counted((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == counted(expected)
    assert [r.doc_id or 0 for r in found] == sorted(r.doc_id or 0 for r in found)
    assert [r.start for r in found] == np.cumsum([0] + [r.n_tokens for r in found])[:-1].tolist()
    tail = [i for ids in stream[2:] for i in ids][:700]  # after the null ids
    at = sum(len(ids) for ids in stream[:2])
    assert [r.id for r in tokens.ids_at(spark, path, at, 700).orderBy("place").collect()] == tail
    assert tokens.encode_corpus(none).count() == 0


# n-gram Jaccard join


def components_by_hand(given):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for key, text in given:
        w = WORD.findall((text or "").translate(low))
        grams = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
        sets[key] = grams
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in keys}


def test_jaccard_components_by_hand(spark, docs):
    given = [(r.doc_id, r.text) for r in docs.limit(120).collect()]
    rng = np.random.default_rng(5)
    base = prose(9, 300, 5000).split()
    for k in range(60):  # a chain-like family of near copies around the limit
        words = list(base)
        for at in rng.integers(0, 300, 5):
            words[at] = f"n{rng.integers(1000)}"
        given.append((10_000 + k, " ".join(words)))
    given += [(20_000, "A b"), (20_001, "a B"), (20_002, "a"), (20_003, None), (20_004, "  ")]
    found = jaccard.link(spark.createDataFrame(given, "doc_id long, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == components_by_hand(given)


def test_jaccard_with_split_parts(spark, docs, monkeypatch):
    given = [(r.doc_id, r.text) for r in docs.limit(60).collect()]
    base = prose(9, 60, 5000)
    given += [(1000 + k, f"{base} tail{k}") for k in range(40)]
    monkeypatch.setattr(jaccard, "PART_ROWS", 4)
    found = jaccard.link(spark.createDataFrame(given, "doc_id long, text string").repartition(4))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == components_by_hand(given)


def test_jaccard_of_odd_rows(odd, none):
    found = counted(rows(jaccard.link(odd), "doc_id", "component_id"))
    assert found[(8, 7)] == 2 and found[(2, 1)] == found[(3, 1)] == 1
    assert found[(4, 4)] == found[(5, 5)] == 1 and found[(None, None)] == 2
    kept = jaccard.keep_first(odd)
    assert kept.columns == odd.columns
    assert counted(rows(kept, "doc_id")) == counted([(k,) for k in (1, 4, 5, 6, 7, None, None, 9, 10, 11)])
    assert jaccard.link(none).count() == 0 and jaccard.keep_first(none).count() == 0


# decontamination


def edit_distance_in(item, text):
    above = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        row = [i + 1]
        for j, d in enumerate(text):
            row.append(min(above[j] + (c != d), above[j + 1] + 1, row[j] + 1))
        above = row
    return min(above)


def test_nearest_by_dynamic_programming():
    rng = np.random.default_rng(0)
    for _ in range(200):
        item = bytes(rng.integers(97, 100, rng.integers(1, 70)).tolist())
        text = bytes(rng.integers(97, 100, rng.integers(0, 90)).tolist())
        distance, end = decontaminate.nearest(item, text)
        assert distance == edit_distance_in(item, text)
        assert 0 <= end <= len(text)


def test_decontamination_by_brute_force(spark):
    rng = np.random.default_rng(3)
    items = [(k, prose(100 + k, 12)) for k in range(6)] + [(6, "too short"), (7, None), (8, " .,! "), (2, prose(102, 12))]
    docs = []
    for k in range(40):
        text = prose(k, 30)
        if k % 2:
            item = list(items[k % 6][1].upper() if k % 3 else items[k % 6][1])
            for _ in range(k % 5):
                item[rng.integers(len(item))] = "z"
            text = f"{text}, \n{''.join(item)}!  {text}"
        docs.append((k, text))
    docs += [(90, None), (91, ""), (92, "Too... short!"), (93, "far too short")]
    found = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_bytes=300)
    expected = {}
    for key, text in docs:
        data = decontaminate.normalised(text)
        for item, words in items:
            form = decontaminate.normalised(words)
            if not form or not data:
                continue
            if len(form) < decontaminate.MIN_BYTES:
                if form == data:
                    expected[key, item] = 0
            elif (d := edit_distance_in(form, data)) <= int(len(form) * decontaminate.RATE):
                expected[key, item] = d
    got = found.collect()
    assert {(r.doc_id, r.item_id): r.distance for r in got} == expected
    assert counted((r.doc_id, r.item_id) for r in got)[1, 1] == 1
    assert all(r.start < r.end for r in got)
    clean = decontaminate.keep_clean(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_bytes=300)
    assert {r.doc_id for r in clean.collect()} == {k for k, _ in docs} - {k for k, _ in expected}


def test_decontamination_of_odd_rows(spark, odd, none):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.matches(odd, items).count() == 0
    assert decontaminate.keep_clean(odd, items).count() == odd.count()
    one = spark.createDataFrame([(1, prose(1)), (None, prose(3))], "item_id long, text string")
    assert decontaminate.matches(none, one).count() == 0
    hits = counted(rows(decontaminate.matches(odd, one), "doc_id", "item_id"))
    assert hits == counted([(1, 1), (2, 1), (3, 1), (10, None)]) or hits[(1, 1)] == hits[(2, 1)] == 1


# suffix arrays and repeated strings


def test_suffix_array_by_sorting():
    rng = np.random.default_rng(0)
    for _ in range(500):
        text = np.append(rng.integers(1, 1 + rng.integers(1, 5), rng.integers(1, 40)), 0)
        assert suffixes.suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())


def stripped_by_hand(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = counted(b[p : p + length] for b in data for p in range(len(b) - length + 1))
    out = []
    for b in data:
        cover = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                cover[p : p + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~cover])
        runs = int(np.count_nonzero(np.diff(np.concatenate([[0], cover.astype(int)])) == 1))
        out.append((len(b), int(cover.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("crowd", [repeats.CROWD, 1])
def test_repeats_by_hand(spark, odd, none, crowd, monkeypatch):
    monkeypatch.setattr(repeats.spans, "__defaults__", (repeats.LENGTH, repeats.GRAM, crowd))
    passage, other = prose(50, 130), prose(51, 90)
    extra = [passage + prose(60, 40), prose(61, 50) + passage[:450], passage[30:] + other, "zz" + passage[30:500] + other, "q" * 1500, "é" * 250]
    given = [(r.doc_id, r.text) for r in odd.collect()] + [(100 + k, t) for k, t in enumerate(extra)] + [(100, other + passage)]
    found = repeats.strip(spark.createDataFrame(given, "doc_id long, text string"))
    expected = counted((k, *x) for (k, _), x in zip(given, stripped_by_hand([t for _, t in given], repeats.LENGTH), strict=True))
    assert counted(rows(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) == expected
    assert repeats.strip(none).count() == 0


def test_repeats_of_the_corpus(docs):
    given = [(r.doc_id, r.text) for r in docs.collect()]
    expected = counted((k, *x) for (k, _), x in zip(given, stripped_by_hand([t for _, t in given], repeats.LENGTH), strict=True))
    assert counted(rows(repeats.strip(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) == expected


# licences


def test_licence_texts_and_notices(spark, odd, none):
    mit = licenses.TEXTS["MIT"]
    given = [
        (1, "MIT License\n\n" + mit),
        (2, f"Copyright (c) 2019 Someone\nAll rights reserved.\n\n{mit.replace('AUTHORS OR ', '').lower()}"),
        (3, mit.replace('"', "“").replace("sublicense", "sub-license").replace("\n", "  ")),
        (4, "prose\nReleased under the MIT Licence.\nAll rights reserved."),
        (4, "prose\nReleased under the MIT License."),
        (5, "licensed under nothing"),
    ]
    found = {(r.doc_id, r.license, r.notices) for r in licenses.scan(spark.createDataFrame(given, "doc_id long, text string")).collect()}
    assert found == {(1, "MIT", ""), (2, "MIT", "all-rights-reserved"), (3, "MIT", ""), (4, None, "MIT,all-rights-reserved"), (4, None, "MIT"), (5, None, "")}
    assert licenses.scan(odd).count() == odd.count() and licenses.scan(none).count() == 0


# classifiers


def test_language_accuracy(spark, docs, odd, none):
    found = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in found]) > 0.9
    assert all(0 <= r.score <= 1 for r in found)
    got = rows(language.identify(odd), "doc_id", "lang_pred")
    assert counted(k for k, _ in got) == counted(r.doc_id for r in odd.collect())
    assert {p for k, p in got if k in (4, 5, 6)} == {"und"}
    assert language.identify(none).count() == 0


def test_quality_posteriors(spark, docs, sf, odd, none):
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    found = quality.score(docs).join(labels, "doc_id").collect()
    good = [r.kept for r in found if r.quality == 1]
    assert np.mean(good) > 0.95
    assert quality.score(odd).count() == odd.count() and quality.score(none).count() == 0


def test_labellers_accuracies_are_found():
    rng = np.random.default_rng(0)
    good = rng.random(20_000) < 0.8
    votes = np.full((len(good), len(quality.LABELLERS)), quality.SILENT)
    for k in range(votes.shape[1]):
        right = np.where(good, rng.random(len(good)) < 0.995, rng.random(len(good)) < 0.6)
        votes[:, k] = np.where(right, good, ~good)
    codes, n = np.unique(votes @ 3 ** np.arange(votes.shape[1]), return_counts=True)
    prior, right = quality.estimate(codes, n.astype(float))
    assert abs(prior - 0.8) < 0.02 and np.abs(right[:, quality.BAD] - 0.6).max() < 0.05


def test_toxicity_finds_held_out_words(spark, odd, none):
    rng = np.random.default_rng(1)
    rows_, labels = [], []
    for k in range(900):
        words = [f"{a}{b}" for a, b in zip(rng.choice(["ba", "lo", "mi", "ter"], 60), rng.choice(["na", "ro", "si", "ken"], 60), strict=True)]
        toxic = k % 4 == 0
        for at in rng.integers(0, 60, 4 if toxic else 0):
            words[at] = "gruzz" + rng.choice(["a", "o", "en"])
        rows_.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    labels += [(None, 1), (3, None), (5000, 1)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string")
    found = toxicity.score(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [r for r in found if r.held_out]
    assert len(found) == 900 and {r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found} == {True}
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.97
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.score(odd, empty).collect()} == {0}
    assert toxicity.score(none, empty).count() == 0
