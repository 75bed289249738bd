"""Operators against brute force on a small corpus with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
from collections import Counter

import pytest

from blockloom.llm import bpe, chat, counts, exact, licenses, mixing, pii, quality, shingles, simhash, suffix

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    rng = random.Random(5)
    words = ["ab", "The", "é", "日本", "thing", "of", "x1", "and", "river", "stone", "blue", "walks", "far", "home", "light", "over", "under"]
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n)) + "."
    base = [prose(rng.randrange(5, 160)) for _ in range(30)]
    texts = [None, "", " \t\n ", "one", "Two words", *base, *base[:6], base[3], base[3], base[0].replace(" ", "  ", 3), base[1] + " tail", base[2][:-40] + "changed end",
             "Home | About | Contact | Help\n" + prose(80), "##$$ %% && ||\n" * 30, base[5] + "\nAll rights reserved.", "x" * 900, "ab " * 500,
             "Licensed under CC BY-NC 4.0.\n" + base[6], "This work is licensed under the GNU General Public License, version 3.", base[7] + "\n" + base[7] + "\n" + base[7],
             "call +1 (555) 555-5657 or 4225039295678253, a.b@c.example.com, 10.1.2.3 on 2024-02-29", "<|endoftext|>x<|endoftext|>", "a\x00b\x1c\x85 c", prose(3000)]
    rows = [(i, t, "en", ["a", "b", None, "c"][i % 4], len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[8], rows[9], (None, base[8], None, None, None), (None, base[9], None, "b", 3)]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(corpus(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


def rows_of(df, *names):
    key = lambda r: tuple((x is None, str(type(x)), x) for x in r)
    return sorted((tuple(r) for r in (df.select(*names) if names else df).collect()), key=key)


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x) for x in r))


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


ALL = {
    "suffix": suffix.remove_repeats, "exact": exact.classes, "bpe": bpe.encode, "counts": counts.count_tokens, "licenses": licenses.scan, "quality": quality.quality,
    "mixing": mixing.copies, "pii": lambda d: pii.redact(d, "k"), "simhash": simhash.groups, "keep_good": quality.keep_good, "drop_copies": exact.drop_copies, "keep_one": simhash.keep_one, "links": shingles.links, "mix": mixing.mix,
}


@pytest.mark.parametrize("name", ALL)
def test_empty_table(empty, name):
    assert ALL[name](empty).count() == 0


@pytest.mark.parametrize("name", ALL)
def test_clashing_columns(spark, docs, name, tmp_path):
    extra = ["row", "digest", "n_words", "kept", "key", "size", "fp", "component_id", "copies", "p", "block", "target", "_row", "doc", "clean_text", "q"]
    few = docs.limit(12).selectExpr("*", *(f"'z' as {c}" for c in extra))
    few.write.parquet(str(tmp_path / "t"))
    few = spark.read.parquet(str(tmp_path / "t"))
    out = ALL[name](few)
    assert name == "links" or out.count() >= 1  # the few are unlike
    if name in ("keep_good", "drop_copies", "keep_one", "mix"):
        assert out.columns == few.columns


def repeats(texts, size):
    """For each text the runs of bytes that strings of `size` bytes cover that start elsewhere too."""
    seen, out = Counter(b[s : s + size] for b in texts for s in range(len(b) - size + 1)), []
    for b in texts:
        gone = bytearray(len(b))
        for s in range(len(b) - size + 1):
            if seen[b[s : s + size]] > 1:
                gone[s : s + size] = b"\1" * size
        out.append([m.span() for m in re.finditer(b"\1+", gone)])
    return out


def suffix_expected(texts):
    """n_bytes to passage_words of each text, by brute force."""
    out = []
    for b, gone, short in zip(texts, repeats(texts, suffix.LENGTH), repeats(texts, suffix.SHORT)):
        kept = bytes(x for k, x in enumerate(b) if not any(lo <= k < hi for lo, hi in gone))
        words = [n for lo, hi in short if (n := len(b[lo:hi].split())) >= suffix.WORDS]
        out.append((len(b), len(b) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), len(words), sum(words)))
    return out


def test_suffix(docs):
    expected = suffix_expected([(t or "").encode() for _, t, *_ in corpus()])
    assert rows_of(suffix.remove_repeats(docs)) == ordered([(r[0], *x) for r, x in zip(corpus(), expected)])
    kept = suffix.remove_repeats(docs, with_text=True).collect()
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in kept)


def test_suffix_passages_under_400_bytes(spark, tmp_path):
    """Shared strings of every length around both sizes, many members of a class, with what is before and after them alike or not."""
    rng = random.Random(2)
    prose = lambda n: " ".join(rng.choice(["ab", "the", "of", "river", "stone"]) + str(rng.randrange(90)) for _ in range(n))
    shared = [prose(90)[:n] for n in (250, 256, 257, 300, 390, 399, 400, 401, 430)]
    texts = [prose(rng.randrange(30, 90)) + p + prose(rng.randrange(30, 90)) for p in shared for _ in range(2)]
    hot = prose(70)
    texts += [prose(rng.randrange(0, 25)) + hot[rng.randrange(60) :] + prose(rng.randrange(25)) for _ in range(40)] + [hot[:280], hot[:280], hot[:300], "z " * 150]
    path = str(tmp_path / "p.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(path)
    expected = suffix_expected([t.encode() for t in texts])
    assert [tuple(r)[1:] for r in suffix.remove_repeats(spark.read.parquet(path)).orderBy("doc_id").collect()] == expected
    assert sum(p > 0 and n == 0 for _, n, _, _, p, _ in expected) >= 6


def test_suffix_across_many_buckets(spark, docs):
    one = rows_of(suffix.remove_repeats(docs))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        assert rows_of(suffix.remove_repeats(docs)) == one
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_suffix_across_parts_of_a_text(spark, tmp_path, monkeypatch):
    """Repeats whose two places are in different parts of one long text; also without repeats, and with a part's end within one."""
    rng = random.Random(11)
    noise = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    once, edge = noise(430), noise(430)
    texts = [noise(1500) + once + noise(6000) + once + noise(900), noise(9000), noise(3900) + edge + noise(5000) + edge + noise(10), noise(300)]
    path = str(tmp_path / "long.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(path)
    expected = suffix_expected([t.encode() for t in texts])
    monkeypatch.setattr(suffix, "SEGMENT", 2048)
    got = [tuple(r)[1:] for r in suffix.remove_repeats(spark.read.parquet(path)).orderBy("doc_id").collect()]
    assert got == expected and [x[1] > 800 for x in got] == [True, False, True, False]


def test_multikey_quicksort():
    import numpy as np

    w = np.random.default_rng(1).integers(0, 4, (700, 6)).astype(np.uint64)
    order = suffix.multikey_quicksort(w)
    assert [tuple(r) for r in w[order].tolist()] == sorted(tuple(r) for r in w.tolist())


def test_chat(spark):
    said = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "yes"), (3, 2, None, None),
            (4, 0, "user", "hi"), (4, 1, "assistant", "yes"), (4, 2, None, None), (5, 0, "user", ""), (6, 0, "user", None), (None, 0, "user", "lone"), (7, 0, "x", "r"), (7, 0, "x", "r")]
    conv = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.format_chats(conv).collect()}
    assert set(out) == {3, 5, 6, 7, None}
    assert out[3].n_same == 2 and out[3].n_turns == 3 and out[7].n_turns == 2
    assert out[3].rendered.startswith("<|user|>\nhi\n<|end|>\n<|assistant|>\nyes\n<|end|>\n")
    assert chat.format_chats(conv.limit(0)).count() == 0
    assert chat.format_chats(conv.selectExpr("*", "1 as turns", "2 as digest", "3 as h")).count() == 5


@pytest.mark.parametrize("counters", [1, 4, 2048])
def test_exact(docs, counters):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t, *_ in corpus():
        groups.setdefault(norm(t), []).append(i)
    first = lambda g: min((i is None, i or 0) for i in g)
    expected = [(i, None if first(g)[0] else first(g)[1], len(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for i in g]
    out = exact.classes(docs, counters)
    assert rows_of(out, "doc_id", "keep_id", "group_size", "text_sha256") == ordered(expected)
    kept = out.filter("kept")
    assert kept.count() == len(groups) and kept.filter("doc_id <=> keep_id").count() == len(groups)
    assert exact.drop_copies(docs).count() == len(groups)


def test_misra_gries_finds_heavy(spark):
    rows = spark.range(3000).selectExpr("case when id % 3 = 0 then 'hot' else cast(id as string) end as digest").repartition(7)
    assert [r.digest for r in exact.heavy_digests(rows, 8).collect()] == ["hot"]


def test_bpe(docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.vocabulary_path("byte_bpe_50k.json"))
    expected = []
    for i, t, *_ in corpus():
        ids = lib.encode(t or "", add_special_tokens=False).ids
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        expected.append((i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert rows_of(bpe.encode(docs, with_ids=False)) == ordered(expected)
    for r in bpe.encode(docs).collect():
        assert len(r.ids) == r.n_tokens


def test_bpe_random_words():
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path("byte_bpe_50k.json")
    lib, own, rng = Tokenizer.from_file(path), bpe.Encoder(path), random.Random(2)
    bits = ["a", "aa", "e", " ", "  ", "\n", "the", "in", "ing", "é", "日本", "😀", "1", "234", "'s", "!!", "<|endoftext|>", "h", "he", "ation"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(50))) for _ in range(3000)] + ["a" * k for k in range(60)] + ["x" * 20000]
    texts += ["".join(chr(rng.randrange(97, 106)) for _ in range(rng.randrange(30))) for _ in range(3000)]
    for t, e in zip(texts, lib.encode_batch(texts, add_special_tokens=False)):
        got = own.encode(t)
        assert [int.from_bytes(got[k : k + 4], "little") for k in range(0, len(got), 4)] == e.ids, t
        assert own.decode(got) == lib.decode(e.ids, skip_special_tokens=False)


@pytest.mark.parametrize("chunk,overlap", [(16384, 256), (64, 4), (300, 20)])
def test_counts(docs, chunk, overlap):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=bpe.vocabulary_path("piece_bpe_32k.model"))
    expected = [(i, len((t or "").encode()), n := len(lib.encode(t or "")), n > 100) for i, t, *_ in corpus()]
    assert rows_of(counts.count_tokens(docs, limit=100, chunk=chunk, overlap=overlap)) == ordered(expected)


def test_counts_without_stable_places():
    import sentencepiece

    path = bpe.vocabulary_path("piece_bpe_32k.model")
    lib, own = sentencepiece.SentencePieceProcessor(model_file=path), counts.Counter(path, 32, 4)
    for t in ("e" * 5000, "ab" * 3000, " " * 4000, "e" * 300 + " " + "t" * 500, "日本" * 900):
        assert own.count(t) == len(lib.encode(t))


def test_licenses(docs):
    expected = []
    for i, t, *_ in corpus():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
        at = [(k, label) for phrase, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        starts = [k for k, _ in at]
        base = {x for _, x in at}
        blocks = (t or "").split("\n") + [p for p in re.split(r"\n[\x20\x09-\x0D]*\n", t or "") if "\n" in p]
        score, labels = 0.0, set(base)
        for b in blocks:
            have = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(b)))
            for label, text in licenses.TEMPLATES:
                want = set(text.split())
                if len(want & have) >= 0.8 * len(want) - 1e-9:
                    labels.add(label)
                    score = max(score, len(want & have) / len(want))
        expected.append((i, len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score))
    assert rows_of(licenses.scan(docs)) == ordered(expected)


def test_licenses_with_hundreds_of_templates(spark):
    """Blocks and templates of the same words, many close to the threshold, against every pair."""
    rng = random.Random(3)
    words = ["w%d" % k for k in range(150)] + ["the", "of", "and"] * 10
    templates = [("t%d" % (k % 200), " ".join(rng.choice(words) for _ in range(rng.choice([3, 6, 12, 30, 60])))) for k in range(300)]
    rows = []
    for i in range(160):
        lines = []
        for _ in range(rng.randrange(4)):
            t = rng.choice(templates)[1].split()
            lines.append(" ".join(rng.sample(t, max(1, int(len(t) * rng.choice([0.7, 0.79, 0.8, 0.85, 1])))) + [rng.choice(words) for _ in range(rng.randrange(9))]))
        rows.append((i, rng.choice(["\n", "\n\n"]).join(lines)))
    for threshold in (0.8, 1.0, 0.5):
        expected = {}
        for i, t in rows:
            blocks = [set(b.split()) for b in [*t.split("\n"), *(p for p in re.split(r"\n\s*\n", t) if "\n" in p)]]
            met = [(label, len(b & want) / len(want)) for b in blocks for label, text in templates if 1000 * len(b & (want := set(text.split()))) >= round(threshold * 1000) * len(want)]
            expected[i] = (",".join(sorted({x for x, _ in met})), max((c for _, c in met), default=0.0))
        out = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates, threshold)
        assert {r.doc_id: (r.labels, r.score) for r in out.collect()} == expected
    assert licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), []).agg({"score": "max"}).first()[0] == 0


def test_long_chats(spark):
    """Snapshots of one conversation of thousands of turns, and one that leaves it midway."""
    said = [("user" if k % 2 else "assistant", "t%d" % (k % 7)) for k in range(6000)]
    logs = {1: said[:5000], 2: said, 3: said[:1], 4: said[:3000] + [("user", "other")], 5: said}
    rows = [(c, k, *t) for c, turns in logs.items() for k, t in enumerate(turns)]
    out = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(out) == {2, 4} and out[2].n_same == 2 and out[2].n_turns == 6000 and out[4].rendered.count("<|end|>") == 3001


def test_quality(docs):
    expected = []
    for i, t, *_ in corpus():
        t = t or ""
        w = WORD.findall(t)
        n = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {j for k in range(len(w) - 7) if n[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        expected.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed))
    assert rows_of(quality.quality(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == ordered(expected)
    by = {r.text: r for r in docs.join(quality.quality(docs), "doc_id").collect()}
    junk = next(r for t, r in by.items() if t and t.startswith("##$$"))
    nav = next(r for t, r in by.items() if t and t.startswith("Home |"))
    assert not junk.kept and nav.kept and nav.clean_text == nav.text.split("\n", 1)[1]
    assert all(r.clean_text == (t or "") for t, r in by.items() if r.kept and t != nav.text)


def test_mixing(spark, docs):
    out = mixing.copies(docs).collect()
    again = mixing.copies(docs.repartition(5)).collect()
    strip = lambda rows: Counter((r.doc_id, r.size, r.source, r.copies) for r in rows)
    assert strip(out) == strip(again) and len(out) == len(corpus())
    assert all(0 <= r.copies <= 3 for r in out)
    assert mixing.mix(docs).count() == sum(r.copies for r in out)


def test_mixing_targets(spark):
    sizes = spark.createDataFrame([("a", 100, 5), ("b", 100, 5), ("c", 1, 1), (None, 799, 9)], "source string, source_size long, n_docs long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    # weights 1, 2, 3, 1: c is bounded at 3, then b at 300; 697 are left for a and null alike, of which a takes 300 at most.
    assert got["c"] == pytest.approx(3.0) and got["b"] == pytest.approx(300.0) and got["a"] == pytest.approx(300.0) and got[None] == pytest.approx(397.0)


def test_cube_balances():
    import numpy as np

    rng = np.random.default_rng(8)
    for size in (np.sort(rng.lognormal(5, 1.5, 500).astype(int).astype(float))[::-1], np.full(60, 7.0), np.array([9000.0] + [5.0] * 40), np.r_[np.full(30, 4.0), np.zeros(30)]):
        start = rng.uniform(0.05, 0.95, len(size)) if len(size) == 500 else np.full(len(size), 0.4)
        p = mixing.flight(start, size, rng.random(len(size)))
        open_ = np.flatnonzero((p > 0) & (p < 1))
        assert len(open_) <= 2 and p.sum() == pytest.approx(start.sum()) and p @ size == pytest.approx(start @ size)
        done = mixing.land(p, size)
        assert set(done) <= {0.0, 1.0} and abs((done - start) @ size) <= size[open_].sum() + 1e-6
        assert abs(done.sum() - start.sum()) <= 2 or size.max() == 9000


def test_cube_keeps_each_chance():
    import numpy as np

    rng = np.random.default_rng(21)
    size = np.sort(rng.lognormal(4, 1.2, 40))[::-1]
    start = rng.uniform(0.1, 0.9, 40)
    mean = np.mean([mixing.flight(start, size, rng.random(40)) for _ in range(4000)], axis=0)
    assert np.abs(mean - start).max() < 0.04  # about five standard errors


def test_mix_balances_words_and_documents(spark, tmp_path):
    """Against the sums over whole sources, over seeds: words and documents within what two small documents hold; blocks of several rounds."""
    rng = random.Random(6)
    rows = [(k, "w " * max(1, int(rng.lognormvariate(4, 1.3))), "en", rng.choice("aaaaaabc"), None) for k in range(1500)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    for seed in (1, 2):
        by = {}
        for r in mixing.copies(docs, block=100, seed=seed).collect():
            x = by.setdefault(r.source, [r.target, r.source_size, 0, 0, 0])
            x[2] += 1
            x[3] += r.copies
            x[4] += r.copies * r.size
        assert len(by) == 3
        for target, whole, n, taken, words in by.values():
            assert abs(words - target) <= 0.002 * target + 10 and abs(taken - n * target / whole) <= 6


def test_pii(spark, docs):
    out = {r.doc_id: r for r in pii.redact(docs.filter("doc_id is not null").dropDuplicates(["doc_id"]), "k").collect()}
    texts = {i: t for i, t, *_ in corpus() if i is not None}
    for i, r in out.items():
        if r.n_found == 0:
            assert r.text == texts[i]
    found = next(r for r in out.values() if r.n_found >= 5)
    assert found.kinds == "card,email,ip,iso_date,phone"
    for value in ("555-5657", "4225039295678253", "a.b@c.example.com", "10.1.2.3", "2024-02-29"):
        assert value not in found.text
    same = spark.createDataFrame([(1, "x 2024-02-29 y"), (2, "2024-02-29"), (3, "2024-02-30"), (4, "4225039295678254"), (5, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(same, "k").collect()}
    assert got[1] == f"x {got[2]} y" and got[3] == "2024-02-30" and got[4] == "4225039295678254" and got[5] is None


def luhn(d):
    return sum(x if k % 2 == 0 else x * 2 - 9 * (x > 4) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def test_pseudonyms_are_one_to_one_valid_and_linked(spark):
    """Many values of each kind against what the formats allow."""
    rng = random.Random(12)
    day = lambda: (rng.randrange(1900, 2100), rng.randrange(1, 13), rng.randrange(1, 29))
    days = [day() for _ in range(600)]
    card = lambda d: next(d + str(c) for c in range(10) if luhn(d + str(c)))
    name = lambda: "".join(rng.choice("abcXYZ019._-") for _ in range(rng.choice([1, 2, 5, 17, 40, 90])))
    values = {
        "iso_date": ["%04d-%02d-%02d" % d for d in days], "dot_date": ["%02d.%02d.%04d" % d[::-1] for d in days],
        "slash_date": ["%02d/%02d/%04d" % (d[1], d[2], d[0]) for d in days] + ["%02d/%02d/%04d" % (d[2], d[1], d[0]) for d in days if d[2] > 12],
        "ssn": ["%03d-%02d-%04d" % (rng.choice([*range(1, 666), *range(667, 900)]), rng.randrange(1, 100), rng.randrange(1, 10000)) for _ in range(800)],
        "phone": ["+1 %03d %03d %04d" % (rng.randrange(200, 1000), rng.randrange(200, 1000), rng.randrange(10000)) for _ in range(500)] + ["+49 030 123 %04d" % k for k in range(300)],
        "card": [card("".join(rng.choice("0123456789") for _ in range(rng.randrange(12, 19)))) for _ in range(300)],
        "email": [name() + "@a%d.example.com" % rng.randrange(3) for _ in range(400)],
        "ip": [".".join(str(rng.randrange(256)) for _ in range(4)) for _ in range(300)],
        "secret": ["".join(rng.choice("0123456789abcdef") for _ in range(rng.randrange(32, 65))) + "" for _ in range(300)],
    }
    shape = {
        "iso_date": r"\d{4}-\d\d-\d\d", "dot_date": r"\d\d\.\d\d\.\d{4}", "slash_date": r"\d\d/\d\d/\d{4}", "ssn": r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}",
        "card": r"\d{13,19}", "ip": r"\d+(\.\d+){3}", "secret": r"[0-9a-f]{32,64}", "email": r".+@a\d\.example\.com", "phone": r"\+\d+ \d{3} \d{3} \d{4}",
    }
    rows = [(k, v) for k in values for v in sorted(set(values[k]))]
    new = dict(zip(rows, [(r.kinds, r.text) for r in pii.redact(spark.createDataFrame([(i, v) for i, (_, v) in enumerate(rows)], "doc_id long, text string").repartition(8), "k").orderBy("doc_id").collect()]))
    for kind in values:
        own = [(v, t) for (k, v), (found, t) in new.items() if k == kind]
        assert all(new[kind, v][0] == kind for v, _ in own), kind
        assert len({t for _, t in own}) == len(own), kind
        assert all(re.fullmatch(shape[kind], t) and len(t) == len(v) or kind == "ip" for v, t in own), kind
    assert all(luhn(t) for (k, _), (_, t) in new.items() if k == "card")
    assert all(re.match(r"\+1 [2-9]\d\d [2-9]", t) for (k, v), (_, t) in new.items() if k == "phone" and v.startswith("+1 "))
    assert all((v > "12") == (t > "12") or v[:2] == "12" or t[:2] == "12" for (k, v), (_, t) in new.items() if k == "slash_date")
    for y, m, d in days:
        one = new["iso_date", "%04d-%02d-%02d" % (y, m, d)][1]
        assert one.split("-")[::-1] == new["dot_date", "%02d.%02d.%04d" % (d, m, y)][1].split(".")
    pair = [r.text for r in pii.redact(spark.createDataFrame([(1, "+1 555 223 4567"), (2, "(555) 223-4567"), (3, "x" * 3_000_000 + " (555) 223-4567")], "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    assert re.sub(r"\D", "", pair[0])[1:] == re.sub(r"\D", "", pair[1]) and pair[2].endswith(pair[1])


def test_cards_beside_other_digits(spark):
    card = "4111 1111 1111 1111"
    texts = [f"card {card} so", f"card {card} 12/25", f"{card.replace(' ', '-')} 123", f"7 {card}", "card 4111 1111 1111 1112 12/25"]
    got = [(r.n_found, r.kinds, r.text) for r in pii.redact(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    new = got[0][2][5:24]
    assert new != card and len(got[0][2]) == len(texts[0])
    assert got == [(1, "card", f"card {new} so"), (1, "card", f"card {new} 12/25"), (1, "card", f"{new.replace(' ', '-')} 123"), (1, "card", f"7 {new}"), (0, "", texts[4])]


def test_feistel_is_a_permutation(spark):
    from pyspark.sql import functions as F

    x = spark.range(1000).select(pii.permute_digits(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "t").alias("d"))
    assert sorted(r.d for r in x.collect()) == [f"{k:03d}" for k in range(1000)]


def fingerprint(t, width=3):
    import xxhash

    w = WORD.findall(lower(t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64(" ".join(w[k : k + width]).encode(), seed=42).intdigest() for k in range(max(1, len(w) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_of(rows, linked):
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if linked(rows[a], rows[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in range(len(rows))]


def test_simhash_crowded_anchors(spark):
    """Anchors whose rows are dealt to cells lose no link: the components are those of brute force."""
    import numpy as np

    rng = np.random.default_rng(11)
    base = int(rng.integers(0, 1 << 62))
    prints = {base}
    for _ in range(400):  # one word of the code takes them all: the low half hardly differs
        prints.add(base ^ (1 << int(rng.integers(0, 32))) ^ (int(rng.integers(0, 1 << 20)) << 32) * int(rng.integers(0, 2)) ^ (1 << int(rng.integers(32, 62))))
    values = sorted(prints)
    root = {v: v for v in values}

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[max(top(a), top(b))] = min(top(a), top(b))
    expected = {v: top(v) for v in values}
    assert 3 < len(set(expected.values())) < len(values) - 50
    distinct = spark.createDataFrame([(v,) for v in values], "fp long")
    for crowd in (16, 1 << 15):
        got = {r.node: r.root for r in simhash.components(simhash.links(distinct, 3, crowd)).collect()}
        assert {v: got.get(v, v) for v in values} == expected


def test_simhash(docs):
    rows = [(i, fingerprint(t)) for i, t, *_ in corpus()]
    comp = components_of(rows, lambda a, b: (a[1] ^ b[1]).bit_count() <= 3)
    least = {c: min((rows[k][0] for k in range(len(rows)) if comp[k] == c and rows[k][0] is not None), default=None) for c in set(comp)}
    expected = [(i, fp - (1 << 64) if fp >> 63 else fp, least[comp[k]]) for k, (i, fp) in enumerate(rows)]
    assert rows_of(simhash.groups(docs)) == ordered(expected)


def shingle_set(t):
    w = WORD.findall(lower(t or ""))
    return frozenset(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def alike(a, b):
    return bool(a) and 20 * len(a & b) >= 8 * (len(a) + len(b))


@pytest.mark.parametrize("cell", [1024, 3])
def test_shingle_links(spark, monkeypatch, cell):
    """Edited copies, some within the threshold and some outside it; also with bands dealt to small cells."""
    import random

    monkeypatch.setattr(shingles, "CELL", cell)
    rng = random.Random(5)
    word = lambda: "w%d" % rng.randrange(4000)
    rows = [(1, None), (2, ""), (3, " \t"), (None, "a b c"), (4, "A b\nc"), (5, "a b c"), (6, "a b c d")]
    for g in range(30):
        base = [word() for _ in range(rng.choice([30, 200, 900]))]
        for _ in range(6):
            t = list(base)
            for _ in range(int(len(t) * rng.choice([0, 0.005, 0.01, 0.03, 0.2]))):
                t[rng.randrange(len(t))] = word()
            rows.append((len(rows) + 10, " ".join(t)))
    rows.append(rows[-1])
    named = sorted({r for r in rows if r[0] is not None})
    sets = [(i, shingle_set(t)) for i, t in named]
    comp = components_of(sets, lambda a, b: alike(a[1], b[1]))
    found = [(r.u, r.v) for r in shingles.links(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()]
    of = {i: s for i, s in sets}
    root = {i: i for i in of}
    for u, v in found:
        old, new = max(root[u], root[v]), min(root[u], root[v])
        root = {i: new if r == old else r for i, r in root.items()}
    if cell == 1024:
        assert all(u < v for u, v in found)
    assert {i: root[i] for i in of} == {sets[k][0]: sets[comp[k]][0] for k in range(len(sets))}


def test_links_between_cells(spark, monkeypatch):
    """Large bands of two groups joined by a single link, between members that are no heads; and unlike texts in the same bands."""
    monkeypatch.setattr(shingles, "CELL", 8)
    monkeypatch.setattr(shingles, "bands", lambda hashes: [len(hashes)])
    rng = random.Random(9)
    fresh = lambda n: ["w%d" % rng.randrange(1 << 40) for _ in range(n)]
    rows = []
    for g in range(6):
        front, end, (x, y, z, x2, y2, z2) = fresh(150), fresh(8 + 10 * g), (fresh(14) for _ in range(6))
        ways = [x + y + z, x2 + y2 + z2]  # alike to one of those of the bridge each, and only these are to one another
        texts = [front + way + end[:-2] + fresh(2) for _ in range(40) for way in ways]
        texts += [front[:100] + fresh(92 + len(end)) for _ in range(12)] + [front + x2 + y + z + end, front + x2 + y2 + z + end]
        rows += [(len(rows) + k, " ".join(t)) for k, t in enumerate(texts)]
    sets = [(i, shingle_set(t)) for i, t in rows]
    comp = components_of(sets, lambda a, b: alike(a[1], b[1]))
    assert len({comp[i] for i in range(94)}) == 13
    root = list(range(len(rows)))
    for r in shingles.links(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        old, new = max(root[r.u], root[r.v]), min(root[r.u], root[r.v])
        root = [new if x == old else x for x in root]
    assert root == [sets[c][0] for c in comp]


def test_long_texts_are_judged_on_whole_sets(spark):
    """Pairs of some 6000 shingles close to the threshold, as whole sets tell."""
    rng = random.Random(13)
    rows, near = [], set()
    for k in range(40):
        base = ["w%d" % rng.randrange(1 << 40) for _ in range(6000)]
        n = 1185 + (k % 2) * 30  # words of the tail that differ: similarities about 0.802 and 0.797
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[:-n] + ["v%d" % rng.randrange(1 << 40) for _ in range(n)]))]
        if alike(shingle_set(rows[-2][1]), shingle_set(rows[-1][1])):
            near.add((2 * k, 2 * k + 1))
    assert len(near) == 20
    assert {(r.u, r.v) for r in shingles.links(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == near


def test_recall_of_edited_copies():
    """Pairs at and above the threshold share a band nearly always."""
    import numpy as np

    rng = np.random.default_rng(4)
    met = 0
    for _ in range(300):
        x = rng.integers(0, 1 << 63, 240, dtype=np.uint64) * np.uint64(2)
        a, b = x[:200], x[40:240]  # 160 of 200 shared: 0.8
        met += bool({*shingles.bands(np.sort(a))} & {*shingles.bands(np.sort(b))})
    assert met >= 297


def test_keep_one_row_of_a_repeated_id(spark, tmp_path):
    """Near texts under one id, null ids and no ids at all: rows are kept, not ids."""
    words = ["w%d" % k for k in range(300)]
    near = " ".join(words[:-2] + ["x", "y"])
    rows = [(7, " ".join(words)), (7, near), (None, near), (9, "far " * 30), (None, "own text of a null id"), (3, None), (2, " ")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "t"))
    out = simhash.keep_one(spark.read.parquet(str(tmp_path / "t"))).collect()
    assert sorted((r.doc_id or 0, (r.text or "")[:3]) for r in out) == [(0, "own"), (2, " "), (7, "w0 "), (9, "far")]


def test_cover_finds_all_within_three_bits():
    import numpy as np

    rng = np.random.default_rng(7)
    x = rng.integers(-(1 << 63), 1 << 63, 4000, dtype=np.int64)
    y = x.copy()
    for k in range(3):
        y ^= np.where(rng.random(4000) < 0.9, np.left_shift(np.int64(1), rng.integers(0, 64, 4000)), 0)
    a, fp, home = simhash.cover(np.unique(np.r_[x, y]))
    order = np.argsort(a, kind="stable")
    u, v = simhash.compare_sorted(a[order], fp[order], home[order], 3)
    seen = simhash.Forest(len(values := np.unique(np.r_[x, y])))
    seen.union(np.searchsorted(values, u), np.searchsorted(values, v))
    assert (seen.find(np.searchsorted(values, x)) == seen.find(np.searchsorted(values, y))).all()


@pytest.mark.parametrize("name", ["suffix", "drop_copies", "keep_one", "mix"])
def test_frames_that_are_no_stored_tables(spark, docs, name):
    """Rows of a shuffled frame have other places each time; the results are those of a table."""
    from blockloom.llm import common

    shuffled = docs.repartition(7).unionByName(docs.limit(0))
    assert common.stored(docs) is docs and common.stored(shuffled) is not shuffled
    assert rows_of(ALL[name](shuffled).drop("source")) == rows_of(ALL[name](docs).drop("source"))


def test_components_of_a_long_path(spark):
    edges = [(k, k + 1) for k in range(0, 300)] + [(1000, 1001), (1001, 1002), (1000, 1002)] + [(5000, k) for k in range(5001, 5200)]
    out = simhash.components(spark.createDataFrame(edges, "u long, v long"))
    roots = {r.node: r.root for r in out.collect()}
    assert len({roots[k] for k in range(301)}) == 1 and len({roots[k] for k in range(1000, 1003)}) == 1 and len({roots[k] for k in range(5000, 5200)}) == 1
    assert len(set(roots.values())) == 3


def test_pipeline(spark, docs, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    q = quality.quality(docs).collect()
    kept = {r.doc_id: r.clean_text for r in q if r.kept and r.doc_id is not None}
    now = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, now = now, stage(spark, now, str(tmp_path))
        if k < 4:
            assert now.columns == docs.columns
            now.write.parquet(str(tmp_path / str(k)))
            now = spark.read.parquet(str(tmp_path / str(k)))
        rows = [(r.doc_id, r.text) for r in before.collect()] if k else []
        if k == 0:
            assert {r.doc_id: r.text for r in now.collect() if r.doc_id is not None} == kept
        elif k == 1:
            assert Counter(re.sub(r"[\x20\x09-\x0D]+", " ", r.text) for r in now.collect()) == Counter({re.sub(r"[\x20\x09-\x0D]+", " ", t) for _, t in rows})
        elif k == 2:
            ids = sorted((i is None, i or 0, fingerprint(t), shingle_set(t)) for i, t in rows)
            comp = components_of(ids, lambda a, b: (a[2] ^ b[2]).bit_count() <= 3 or alike(a[3], b[3]))
            assert sorted(r.doc_id or 0 for r in now.collect()) == sorted(ids[c][1] for c in set(comp))
        elif k == 3:
            assert {r.doc_id for r in now.collect()} <= {i for i, _ in rows}
        else:
            assert rows_of(now, "n_tokens", "ids_sha256") == rows_of(bpe.encode(before), "n_tokens", "ids_sha256")
    assert rows_of(corpus_pipeline.run(spark, str(tmp_path)), "doc_id", "n_tokens", "ids_sha256") == rows_of(now, "doc_id", "n_tokens", "ids_sha256")
