"""Operators against brute force on the smallest table and on odd rows."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tissueflow.llm import decontaminate, lzprint, packing, pii, quality, repeats, simhash, tokens, toxicity, warc
from tissueflow.llm.components import components


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


@pytest.fixture(params=["docs", "odd", "none"])
def table(request):
    return request.getfixturevalue(request.param)


def test_repeats(table):
    rows = [(d, t.encode()) for d, t in texts(table)]
    n = repeats.LENGTH
    seen = collections.Counter(t[i : i + n] for _, t in rows for i in range(len(t) - n + 1))
    expected = []
    for d, t in rows:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone[:-1]])
        expected.append((d, len(t), int(gone.sum()), int((gone[:-1] & ~np.concatenate([[False], gone[:-1]])[: len(t)]).sum()), hashlib.sha256(kept).hexdigest()))
    got = [tuple(r)[:5] for r in repeats.without_repeats(table).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_simhash(table):
    rows = texts(table)
    prints = [simhash.fingerprint(t.encode()) for _, t in rows]
    value = np.array(prints, np.uint64)
    root = np.arange(len(rows))
    while True:
        new = np.array([root[np.bitwise_count(value ^ v) <= 2].min() for v in value], int) if len(rows) else root
        if (new == root).all():
            break
        root = new
    least = {r: min((d for (d, _), x in zip(rows, root, strict=True) if x == r and d is not None), default=None) for r in set(root.tolist())}
    got = [(r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_components(table).collect()]
    assert sorted(got, key=str) == sorted(((d, p, least[r]) for (d, _), p, r in zip(rows, prints, root.tolist(), strict=True)), key=str)


def alike(texts):
    """By brute force: the first text that each reaches over shingle sets at least 0.8 alike or fingerprints two bits apart."""
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for t in texts]
    value = np.array([simhash.fingerprint(t.encode(), 5) for t in texts], np.uint64)
    near = [[j for j in range(len(texts)) if len(a & sets[j]) >= 0.8 * max(1, len(a | sets[j])) or (value[i] ^ value[j]).bit_count() <= 2] for i, a in enumerate(sets)]
    root = list(range(len(texts)))
    while (new := [min(root[j] for j in n) for n in near]) != root:
        root = new
    return root


def test_one_of_each(table):
    rows = texts(table)
    kept = simhash.one_of_each(table)
    assert kept.columns == table.columns
    assert kept.count() == len(set(alike([t for _, t in rows])))


def test_one_of_each_in_large_groups(spark):
    """Two bases with 150 copies each, a few words changed in every one, and texts that share only a half."""
    rng = np.random.default_rng(4)
    rows = []
    for b in range(2):
        base = [f"w{x}" for x in rng.integers(0, 500, 200)]
        for c in range(150):
            copy = list(base)
            for at in rng.integers(0, 200, c % 4):
                copy[at] = f"new{rng.integers(1 << 30)}"
            rows.append(" ".join(copy))
        rows += [" ".join(base[:100] + [f"v{x}" for x in rng.integers(0, 500, 100)]) for _ in range(20)]
    found = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert found == set(alike(rows))


@pytest.mark.parametrize("groups, copies, changed", [(60, 12, (3, 9)), (2, 170, (4, 10))])
def test_one_of_each_near_the_limit(spark, groups, copies, changed):
    """Copies about as similar as the limit, where an estimate errs: links must not hang on the pairs it prefers."""
    rng = np.random.default_rng(7)
    rows = []
    for _ in range(groups):
        base = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        for _ in range(copies):
            copy = list(base)
            for at in rng.integers(0, 300, rng.integers(*changed)):
                copy[at] = f"new{rng.integers(1 << 30)}"
            rows.append(" ".join(copy))
    found = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert found == set(alike(rows))


def test_fingerprint_by_definition():
    import xxhash

    text = b"One  two\tTHREE four\x0bfive one two three"
    words = text.lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)]
    assert simhash.fingerprint(text) == sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))
    assert simhash.fingerprint(b" ") == 0


def test_crowded_bucket_loses_no_link(spark):
    rng = np.random.default_rng(1)
    base = int(rng.integers(1 << 62))
    values = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in rng.integers(30, 60, (900, 3))})
    links = simhash.near_links(spark.createDataFrame([(v,) for v in values], "fp long"))
    got = {r.node: r.root for r in components(links).collect()}
    v = np.array(values, np.uint64)
    root = np.arange(len(v))
    while True:
        new = np.array([root[np.bitwise_count(v ^ x) <= 2].min() for x in v])
        if (new == root).all():
            break
        root = new
    assert [got.get(x, x) for x in values] == [values[r] for r in root]


def test_pii(table):
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]

    def good(kind, m):
        d = re.sub("[^0-9]", "", m)
        luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")), "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[kind]

    def brute(t):
        return ",".join(x for _, _, x in sorted((m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, p) in enumerate(kinds) for m in re.finditer(p, t) if good(k, m[0])))

    got = pii.find_pii(table).select("doc_id", pii.joined(F.filter("pii_spans", lambda x: x["kind"] != "iban")).alias("s")).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(((d, brute(t)) for d, t in texts(table)), key=str)


def test_pii_edges(spark):
    rows = ["a@b.c-d%e@f.g x@y@z.w é 1.2.3.4.5 256.1.1.1 00000255.1.1.1", "4111 1111 1111 1111 and +1 (555) 123-4567.", "account GB82 WEST 1234 5698 7654 32 end", "9" * 20000, "a.a" * 9000 + "@" + "b.c" * 9000]
    found = [[(x.kind, x.start, x.end) for x in r.pii_spans] for r in pii.find_pii(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").coalesce(1)).collect()]
    assert found[0] == [("email", 0, 7), ("email", 7, 13), ("email", 16, 21), ("ip", 24, 31), ("ip", 44, 58)]
    assert found[1] == [("card", 0, 19), ("phone", 24, 41)]
    assert found[2] == [("iban", 8, 35)]
    assert found[3] == [] and found[4] == [("email", 0, 54001)]


def test_iban_followed_by_capitals_and_context(spark):
    rows = ["GB82 WEST 1234 5698 7654 32 OK", "GB82 WEST 1234 5698 7654 32 2024 DE89370400440532013000 NEXT", "GB82 WEST 1234 5698 7654 33", "GB8 2WEST 12 345698765432", "see GB82WEST 12 345698765432 now", "account GB82WEST 12 345698765432 now"]
    found = [[(x.start, x.end) for x in r.pii_spans if x.kind == "iban"] for r in pii.find_pii(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").coalesce(1)).collect()]
    assert found == [[(0, 27)], [(0, 27), (33, 55)], [], [], [], [(8, 32)]]


def test_masked(spark, odd):
    df = spark.createDataFrame([(1, "é mail a.b@c.de or 1.2.3.4!", 27, "x"), (2, None, 0, "y")], "doc_id long, text string, n_chars long, __spans string")
    assert [tuple(r) for r in pii.masked(df).orderBy("doc_id").collect()] == [(1, "é mail <email> or <ip>!", 23, "x"), (2, None, 0, "y")]
    assert pii.masked(odd).columns == odd.columns and pii.masked(odd).count() == odd.count()


def test_tokens(table, spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary_path())
    path = str(tmp_path / "ids")
    tokens.write_token_files(table, path)
    got = tokens.token_digests(spark, path).orderBy("start").collect()
    at, expected = 0, []
    for d, x in sorted(texts(table), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4")
        expected.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == expected


@pytest.mark.parametrize("pieces, groups", [(600_000, 400_000), (40, 20)])
def test_encoder_on_odd_strings(monkeypatch, pieces, groups):
    """Also with tables so small that they forget all the time."""
    import random

    monkeypatch.setattr(tokens, "PIECES", pieces)
    monkeypatch.setattr(tokens, "GROUPS", groups)
    e = tokens.Encoder(tokens.vocabulary_path())
    assert e.cuts
    rng = random.Random(3)
    parts = ["a", "B", " ", "  ", "\n", ".", ",", "'s", "'", "é", "ß", "Ⅷ", "²", "9", "#", "\t", "<|endoftext|>", "word", "日本", " ", "\x1c", "-", "_", "́", "\0"]
    for _ in range(2000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        ids, ends = e.encode([s, "a", s])
        own = [*e.tokenizer.encode(s, add_special_tokens=False).ids, tokens.END]
        assert ids.tolist() == [*own, *e.encode(["a"])[0].tolist(), *own] and ends.tolist() == [len(own), len(own) + 2, 2 * len(own) + 2], s


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_of_other_vocabularies(name):
    """Where a vocabulary isn't of the plain byte-level kind, whole texts go to the tokenizer."""
    e = tokens.Encoder(tokens.vocabulary_path(name))
    texts = ["One two,  three.", "", " x", "don't Stop é"]
    assert e.encode(texts)[0].tolist() == [i for t in texts for i in [*e.tokenizer.encode(t, add_special_tokens=False).ids, 0]]


def test_token_files_allow_selective_reads(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    docs, path = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), str(tmp_path / "ids")
    tokens.write_token_files(docs, path, row_group_bytes=1 << 14, page_bytes=1 << 12)
    groups = 0
    for f in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            groups += 1
            assert all(c.has_column_index and c.has_offset_index for c in columns.values())
            assert any("DICTIONARY" in e for e in columns["ids.list.element"].encodings)
            assert all("DELTA_BINARY_PACKED" in columns[c].encodings for c in ("part", "local_start", "doc_id", "n_tokens"))
    assert groups > 8
    wanted = [r.doc_id for r in docs.select("doc_id").orderBy("doc_id").limit(50).collect()][10:12]
    some = tokens.read_documents(spark, path, F.col("doc_id").between(*wanted))
    plan = some._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id" in plan and "local_start" not in plan.split("== Physical Plan ==")[1]
    e = tokens.Encoder(tokens.vocabulary_path())
    texts_of = dict(texts(docs))
    assert {r.doc_id: r.ids for r in some.collect()} == {d: e.encode([texts_of[d]])[0].tolist() for d in wanted}
    assert "ids:array" not in tokens.read_metadata(spark, path)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_packing_fills_windows(spark):
    """No padding: every sequence is full or a power of two; the best neighbour by plain BM25 follows its seed."""
    rng = np.random.default_rng(3)
    idf = rng.random(300).astype(np.float32)
    tails = [rng.integers(0, 300, int(n)).astype("<u2") for n in rng.integers(1, 900, 60)]
    shard = packing.Shard(tails, idf, float(np.mean([len(t) for t in tails])))
    length = collections.Counter()
    held = collections.defaultdict(list)
    for doc, before, n, sequence, offset in shard.pack():
        assert offset == length[sequence]
        length[sequence] += n
        held[doc].append((before, n))
    assert all(n == packing.LENGTH or n & (n - 1) == 0 for n in length.values())
    for doc, parts in held.items():
        at = 0
        for before, n in sorted(parts):
            assert before == at
            at += n
        assert at == len(tails[doc])
    average = np.mean([len(t) for t in tails])
    for seed in range(len(tails)):
        asked = sorted(set(tails[seed].tolist()), key=lambda t: (-idf[t], t))[: packing.QUERY_TERMS]
        plain = []
        for i, t in enumerate(tails):
            count = collections.Counter(t.tolist())
            plain.append(sum(float(idf[q]) * count[q] * (packing.K1 + 1) / (count[q] + packing.K1 * (1 - packing.B + packing.B * len(t) / average)) for q in asked if count[q]))
        used = np.zeros(len(tails), bool)
        used[seed] = True
        got = shard.neighbours(seed, used)
        assert set(got.tolist()) == {i for i, x in enumerate(plain) if x > 0 and i != seed}
        assert np.all(np.diff([plain[i] for i in got]) < 1e-4)


def test_packing(table):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary_path())
    got = packing.pack(table).collect()
    pieces, sequences = collections.Counter(), collections.defaultdict(list)
    for r in got:
        pieces[r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        assert [o for o, _ in sorted(s)] == list(np.cumsum([0, *(n for _, n in sorted(s))])[:-1]) and sum(n for _, n in s) <= packing.LENGTH
    whole = collections.Counter()
    for d, x in texts(table):
        whole[d, len(t.encode(x, add_special_tokens=False).ids) + 1] += 1
    total = collections.Counter()
    for (d, start, length, crc, n), k in pieces.items():
        total[d, n] += length * k
    assert total == {(d, n): n * k for (d, n), k in whole.items()}
    for d, x in texts(table):
        ids = np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4")
        own = [p for p in pieces if p[0] == d and p[4] == len(ids)]
        assert all(p[3] == zlib.crc32(ids[p[1] : p[1] + p[2]].tobytes()) for p in own) or whole[d, len(ids)] > 1 or d is None


def test_lzprint(table):
    order = sorted(texts(table), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    expected = []
    for i, (d, t) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        e = lzprint.edited(t, after)
        a, b, c = map(lzprint.signature, (t, e, after))
        expected.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), a.hex(), b.hex(), lzprint.likeness(a, b), lzprint.likeness(a, c)))
    got = [tuple(r) for r in lzprint.lz_fingerprints(table).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_decontaminate(table, spark):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(table, bench).collect()}
    assert got == {(d, i) for d, t in texts(table) for i, x in items if x in t}


def test_decontaminate_templates(spark):
    bench = spark.createDataFrame([(1, "A shop sells 12 apples to Maria for 3 dollars each, how much does Maria pay in all?"), (2, None), (3, "too short")], "item_id long, text string")
    rows = [(1, "Then a shop sells 40 apples to Peter for 9 dollars each, how much does Peter pay in all? Yes."), (2, "Now a shop sells 40 apples to Peter for 9 dollars each, how much does Clara pay in all?"), (3, "A shop opens at nine and sells fruit to all."), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()] == [(1, 1)]
    assert sorted(r.doc_id for r in decontaminate.without_leaks(docs, bench).collect()) == [2, 3, 4]


def test_decontaminate_changed_items(spark):
    """Words changed, put in and left out, names of another word count, items of numbers, and a name that comes first."""
    long = "a farmer keeps brown hens in three red barns near the river and sells every egg at the town market where each buyer pays the same price so how many coins does the farmer bring home on sunday night"
    short = "the old train leaves the north station at dawn and reaches the harbour before noon"
    named = "the baker sold twelve loaves to Maria before lunch and gave Maria two more"
    bench = spark.createDataFrame([(1, long), (2, short), (3, named), (4, "What is 15 + 27 - 8 * 3?"), (5, "Maria has many green apples"), (6, "11 12 13 14 15 16")], "item_id long, text string")
    w = long.split()
    rows = [" ".join([*w[:12], "x", *w[13:25], "y", *w[26:]]), " ".join([*w[:19], "really", *w[19:]]), " ".join([*w[:18], *w[19:]]), short.replace("station at", "station sharp at"), named.replace("Maria", "Anna Lopez")]
    rows += ["compute: What is 15 + 27 - 8 * 3?", "then Peter has many green apples", "11 12 13 14 15 16", "21 22 23 24 25 26", "the old train leaves at nine, and the harbour is closed before noon", named.replace("Maria", "Anna Lopez", 1)]
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), bench).collect()}
    assert got == {(0, 1), (1, 1), (2, 1), (3, 2), (4, 3), (5, 4), (6, 5), (7, 6)}


def test_quality_held_out(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    got = quality.quality_scores(docs, labels)
    assert got.count() == docs.count()
    held = got.filter("held_out").join(labels, "doc_id").filter("quality IS NOT NULL").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in held)
    assert np.mean([(r.score >= 0.5) == (r.quality == 1) for r in held]) > 0.95
    kept = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    assert np.mean([r.doc_id in kept for r in held if r.quality == 1]) > 0.97


@pytest.mark.parametrize("scores, label", [(quality.quality_scores, "quality"), (toxicity.toxicity_scores, "toxic")])
def test_classifiers_on_odd_rows(spark, odd, none, scores, label):
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)] + [(3, None), (None, 1)], f"doc_id long, {label} int")
    got = scores(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert scores(none, labels).count() == 0
    assert {round(r.score, 6) for r in scores(odd, labels.filter("false")).collect()} == {0.5}


def test_toxicity_lengths_and_dictionaries():
    rng = np.random.default_rng(5)
    vocabulary = [bytes(rng.integers(97, 123, rng.integers(2, 9)).astype(np.uint8)) for _ in range(400)]
    text = lambda bad: b" ".join([vocabulary[i] for i in rng.integers(0, 400, 120)] + [b"zzscoundrel"] * bad)
    samples = [(i % 2, text(i % 2)) for i in range(120)]
    ordinary, toxic, weights = toxicity.fit(samples, 0.0)
    assert b"zzsco" in toxic and b"zzsco" not in ordinary and len(ordinary) == len(toxic)
    for data in (b"", b"x", text(1), text(0) * 9, "é".encode() * 400):
        parts = toxicity.windows(data)
        assert b"".join(parts) == data and all(len(p) <= toxicity.WINDOW for p in parts)
        plain = [len(toxicity.compressor(ordinary).compress(p)) - len(toxicity.compressor(toxic).compress(p)) for p in parts]
        assert toxicity.gains((toxicity.compressor(ordinary), toxicity.compressor(toxic)), data).tolist() == plain
    again = toxicity.fit(samples, 0.0)
    assert again[:2] == (ordinary, toxic) and np.allclose(again[2], weights)


def test_toxicity_finds_words(spark):
    rng = np.random.default_rng(5)
    words = [f"word{i}" for i in range(400)]
    rows = []
    for i in range(600):
        text = [words[j] for j in rng.integers(400, size=120)]
        if i % 3 == 0:
            for at in rng.integers(120, size=6):
                text[at] = ("horrible", "disgrace", "loathsome")[at % 3]
        rows.append((i, " ".join(text), int(i % 3 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    held = toxicity.toxicity_scores(df.select("doc_id", "text"), df.select("doc_id", "toxic")).filter("held_out").join(df.select("doc_id", "toxic"), "doc_id").collect()
    assert np.mean([(r.score >= 0.5) == r.toxic for r in held]) > 0.95


def test_warc(spark):
    rows = [(1, "http://a/b", '<html lang="en"><head><title> T </title></head><body><!-- x --><p>One &amp; two<br>3</p><script>no</script><a href="/c">go</a></body></html>'), (2, None, None), (None, "u", "")]
    got = warc.derivatives(spark.createDataFrame(rows, "page_id long, url string, html string"))
    r = {(x.page_id, x.record_type): x for x in got.collect()}
    assert len(r) == 9 and r[1, "conversion"].block == "One & two\n3\ngo" and r[1, "conversion"].refers_to == r[1, "response"].record_id
    assert r[1, "metadata"].block == "title: T\r\nlanguage: en\r\noutlink: /c L a/@href\r\n"
    assert r[1, "conversion"].block_digest == "sha256:" + hashlib.sha256(b"One & two\n3\ngo").hexdigest()
    one = warc.serialised(got).filter("page_id = 1").collect()
    for x in one:
        head, _, rest = x.warc.partition("\r\n\r\n")
        assert head.startswith("WARC/1.1\r\n") and len(rest.encode()) == int(re.search(r"Content-Length: (\d+)", head)[1]) + 4


def test_warc_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.001/pages.parquet'")
    df = warc.warc_query(spark, "/root/testdata/sf0.001")
    expected = con.execute(f"SELECT {', '.join(df.columns)} FROM ({warc.WARC_SQL}) t").fetchall()
    assert sorted(map(str, expected)) == sorted(str(tuple(r)) for r in df.collect())


def test_components(spark):
    edges = [(5, 4), (4, 3), (9, 8), (3, 5), (7, 7), *((100 + i, 101 + i) for i in range(40))]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {5: 3, 4: 3, 3: 3, 9: 8, 8: 8, **{100 + i: 100 for i in range(41)}}


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == docs.columns, name
        assert 0 < after.count() <= docs.count()
    assert corpus_pipeline.run(spark, sf).count() > 0
