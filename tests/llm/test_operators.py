import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkloom.llm import components, decontaminate, language, lines, packing, quality, simhash, substrings, toxicity, urls, warc
from sparkloom.llm.suffix import Workspace, sort_suffixes

VOCAB = [a + b for a in ("th", "er", "on", "an", "ti", "re", "st", "ing") for b in ("", "a", "e", "ou", "ble", "nd", "shre")]


def prose(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """(doc_id, text): prose with exact and near copies, shared passages and lines, and odd cases."""
    rng = random.Random(5)
    passage = prose(rng, 70)
    line = prose(rng, 30)
    rows = [(k, "\n".join(prose(rng, rng.randrange(8, 60)) for _ in range(rng.randrange(1, 6)))) for k in range(60)]
    for k in range(60, 72):
        rows.append((k, prose(rng, 15) + " " + passage + " " + prose(rng, 9)))
    for k in range(72, 80):
        words = line.split()
        words[rng.randrange(30)] = "changed"
        rows.append((k, prose(rng, 12) + "\n" + " ".join(words) + "\n" + line))
    for k in range(80, 90):
        words = rows[3][1].split(" ")
        words[rng.randrange(len(words))] = "other"
        rows.append((k, " ".join(words)))
    rows += [(90, rows[3][1]), (91, rows[3][1]), (92, None), (93, ""), (94, " \n\t "), (95, "ab " * 400), (96, "x" * 900), (97, "É é 漢字かな " * 60), (98, rows[1][1]), (98, rows[1][1])]
    return rows


@pytest.fixture
def docs(spark, corpus):
    """With extra columns whose names clash with the operators' own."""
    names = ("id", "key", "h", "score", "n", "_n_words", "fp", "doc", "_removed", "th")
    return spark.createDataFrame(corpus, "doc_id long, text string").repartition(3).withColumns({c: F.lit("extra") for c in names})


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_suffix_array(tmp_path):
    rng = np.random.default_rng(0)
    for k in range(120):
        t = rng.integers(1, rng.integers(2, 5), rng.integers(1, 50))
        t = np.append(np.tile(t, 3) if k % 3 == 0 else t, 0)
        with Workspace(1500 if k % 2 else 1 << 20, str(tmp_path)) as space:  # the small budget goes to disk
            space.base, space.block = 0 if k % 5 else 1000, (2, 3, 4, 7, 256)[k % 5]
            sa, lcp = sort_suffixes(t, space)
        s = t.tolist()
        want = sorted(range(len(s)), key=lambda i: s[i:])
        assert sa.tolist() == want
        for a, b, n in zip(want, want[1:], lcp.tolist()[1:], strict=False):
            assert s[a : a + n] == s[b : b + n] and s[a : a + n + 1] != s[b : b + n + 1]
    assert not list(tmp_path.iterdir())


@pytest.mark.parametrize("symbols", [4, 250, 1 << 20])
def test_suffix_array_beyond_memory(tmp_path, symbols):
    """A budget of a twentieth of the text: at most twice as much is held, the rest goes through files, and recursion goes on there."""
    import tracemalloc

    rng = np.random.default_rng(symbols)
    n = 1_000_000
    with Workspace(1500, str(tmp_path)) as space:  # what is imported on the way is not counted
        sort_suffixes(np.append(rng.integers(1, 9, 3000), 0), space)
    t = np.memmap(tmp_path / "text", np.int64, "w+", shape=(n,))
    t[:-1] = rng.integers(1, symbols, n - 1)
    t[400_000:700_000] = t[:300_000]  # a long repeat
    t[800_000:810_000] = t[799_999]  # and a run
    t[-1] = 0
    budget = t.nbytes // 20
    tracemalloc.start()
    with Workspace(budget, str(tmp_path / "work")) as space:
        sa, lcp = sort_suffixes(t, space)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak <= 2 * budget and space.spilled > budget and space.deepest >= (1 if symbols < 1 << 20 else 0)
        assert len(np.unique(sa)) == n and not lcp[0]
        some = np.concatenate([rng.integers(1, n, 20_000), np.flatnonzero(lcp > 5000)[:50]])
        a, b, same = sa[some - 1], sa[some], lcp[some]
        assert (t[a + same] < t[b + same]).all()
        for k in range(20):
            here = same > k
            assert (t[a[here] + k] == t[b[here] + k]).all()
        for x, y, k in zip(a[-50:], b[-50:], same[-50:], strict=True):
            assert (t[x : x + k] == t[y : y + k]).all()


def brute_substrings(rows, length):
    count = Counter()
    raws = [(i, (t or "").encode()) for i, t in rows]
    for _, b in raws:
        count.update(b[k : k + length] for k in range(len(b) - length + 1))
    out = []
    for i, b in raws:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), len(b) - len(kept), sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("group,rows", [(20_000, 1_500_000), (2, 1_500_000), (20_000, 0)])
def test_substrings(docs, corpus, group, rows):
    """Also with groups counted window by window, and with shuffles in place of broadcasts."""
    got = substrings.deduplicate_substrings(docs, substrings.SubstringOptions(group=group, broadcast_rows=rows))
    assert sorted(map(tuple, got.collect())) == brute_substrings(corpus, 200)


@pytest.mark.parametrize("length", [60, 306, 400])
def test_substrings_of_other_lengths(docs, corpus, length):
    got = substrings.deduplicate_substrings(docs, substrings.SubstringOptions(length=length))
    assert sorted(map(tuple, got.collect())) == brute_substrings(corpus, length)
    with pytest.raises(ValueError):
        substrings.SubstringOptions(length=40)


def test_substrings_sort_on_disk(docs, corpus, monkeypatch):
    """With the production shard and a budget that it exceeds, queues spill and results are the same."""
    spilled = []
    rng = random.Random(3)
    n, o = 40_000, substrings.SubstringOptions()
    ck = np.array([rng.randrange(9_000) for _ in range(n)])
    a = np.array([rng.randrange(16) for _ in range(n)])
    w = a + 1
    left, right = (np.array(rng.choices(range(97, 100), k=int(k.sum())), np.uint8) for k in (a, w - a + o.chunk - 2))
    import tempfile

    flags = []
    for parent in (tempfile.mkdtemp(), None):
        with substrings.Workspace(o.memory, parent) as space:
            flags.append(substrings.repeated_windows(ck, left, right, a, w, o, space))
            spilled.append((space.spilled, space.deepest))
    assert all((x == y).all() for x, y in zip(*flags, strict=True)) and spilled[0][0] > 0 and spilled[0][1] > 0 and spilled[1][0] == 0


def test_anchors_of_texts_in_a_row():
    """Many short texts are worked on together, and each has the anchors that it has alone."""
    import pyarrow as pa

    rng = random.Random(8)
    o = substrings.SubstringOptions(length=60, gram=20)
    texts = [bytes(rng.choices(b"abc", k=rng.choice([60, 61, 90, 400]))) for _ in range(300)] + [b"a" * 150, b"ab" * 100, b"a" * 150]

    def found(raws):
        end = np.cumsum([len(x) for x in raws])
        begin = end - [len(x) for x in raws]
        own, gram, *places = substrings._anchors(substrings._Hashes(np.frombuffer(b"".join(raws), np.uint8)), begin, end, o)
        return own.tolist(), list(zip(gram.tolist(), *((x - begin[own]).tolist() for x in places), strict=True))

    own, got = found(texts)
    alone = [found([x])[1] for x in texts]
    assert got == [x for each in alone for x in each] and own == [k for k, each in enumerate(alone) for _ in each]
    for text, each in zip(texts, alone, strict=True):  # each window has an owner
        owned = {s for _, _, first, last in each for s in range(first, last + 1)}
        assert owned == set(range(len(text) - o.length + 1))
    calls = []
    each = substrings._each(lambda raw, begin, end, n: calls.append(len(begin)) or (end - begin, n.to_numpy()), ["size", "n"])
    batch = pa.RecordBatch.from_pydict({"text": [x.decode() for x in texts], "n": [len(x) for x in texts]}).slice(1)
    out = pa.Table.from_batches(each(iter([batch])))
    assert out["size"].to_pylist() == out["n"].to_pylist() == [len(x) for x in texts[1:]] and len(calls) < 10


def test_names_are_sorted_without_common_prefixes(monkeypatch, tmp_path):
    """What only names the strings between LMS places takes no minima: each suffix has one at most."""
    from sparkloom.llm import suffix

    asked, least = [], suffix._range_min
    monkeypatch.setattr(suffix, "_range_min", lambda a, lo, hi: asked.append(len(lo)) or least(a, lo, hi))
    t = np.append(np.random.default_rng(2).integers(1, 30, 50_000), 0)
    with Workspace(1 << 25, str(tmp_path)) as space:
        sort_suffixes(t, space)
    assert 0 < sum(asked) <= len(t)


def test_substrings_empty(empty):
    assert substrings.deduplicate_substrings(empty).count() == 0


def brute_decontaminate(rows, items, n):
    fold = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    split = lambda t: "".join(c if c.isascii() and c.isalnum() or ord(c) >= 128 else " " for c in fold(t)).split(" ")
    words = lambda t: [w for w in split(t) if w]
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            v = words(text)
            size = min(n, len(v))
            for k in range(len(v) - size + 1 if size else 0):
                for j in range(len(w) - size + 1):
                    if w[j : j + size] == v[k : k + size]:
                        hit |= set(range(j, j + size))
                        found.add(str(item))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("bound,rows", [(64 << 20, 500_000), (600, 500_000), (600, -1)])
def test_decontaminate(spark, docs, corpus, bound, rows):
    """In one block and in many, which come back by a broadcast or a lookup."""
    items = [(10, corpus[60][1].split(" ", 15)[1][:80]), (2, corpus[5][1].upper()), (3, "漢字かな é"), (4, ""), (5, None), (9, corpus[5][1]), (11, "anou thble")]
    bench = spark.createDataFrame(items, "item_id int, text string")
    found = decontaminate.decontaminate(docs, bench, max_set_bytes=bound, max_broadcast_rows=rows)
    assert sorted(map(tuple, decontaminate.contamination_digest(found).collect()), key=str) == brute_decontaminate(corpus, items, 10)
    clean = decontaminate.decontaminate(docs, bench, action="remove_documents", max_set_bytes=bound)
    assert clean.columns == docs.columns and {r._n_words for r in clean.collect()} == {"extra"}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in found.collect() if not r._spans}
    cut = decontaminate.decontaminate(docs, bench, action="remove_spans", max_set_bytes=bound)
    assert cut.columns == docs.columns
    assert decontaminate.contamination_digest(decontaminate.decontaminate(cut, bench)).where("contaminated").isEmpty()


def test_decontaminate_blocks_bound_the_sets():
    """Ten blocks of a benchmark take a worker a tenth of what one takes, and no more than the estimate says."""
    import tracemalloc

    rng = random.Random(6)
    items = [(str(k), " ".join(f"w{rng.randrange(10**6)}" for _ in range(100))) for k in range(1000)]
    peaks = []
    for part in (items, items[:100]):
        tracemalloc.start()
        held = decontaminate.NgramSet(part, 10)
        peaks.append(tracemalloc.get_traced_memory()[0])
        tracemalloc.stop()
        assert held.scan([part[5][1]])[0][2] == {part[5][0]}
    assert peaks[0] <= 100_000 * (4 * 10 + 170) and peaks[1] <= 0.15 * peaks[0]


def test_packing_round_trip(docs, corpus):
    rows = packing.pack(docs, size=64, with_ids=True).collect()
    encode = packing.encoder(packing.default_path()).tokenizer
    want = Counter((i, tuple(encode.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in corpus)
    parts, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        parts[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    for i, ids in want:
        own = sorted(parts[i], key=lambda r: r.start)
        copies = want[i, ids]
        assert sum(r.length for r in own) == len(ids) * copies and all(r.doc_tokens == len(ids) for r in own)
        assert all(tuple(r.ids) == ids[r.start : r.start + r.length] for r in own)
    padding = 0
    for w in windows.values():
        at = 0
        for r in sorted(w, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
        padding += 0 if at & (at - 1) == 0 else 64 - at
    assert padding == 0


def test_squares_choice():
    p = packing.SquaresPacker(8)
    steps = []
    for k, n in enumerate((3, 3, 5, 2)):  # joins the first, as 0 < 3; needs a window of its own; fills the first up, as -1 < 1
        steps.append([[x[0] for x in w] for w in p.add(k, bytes(4 * n), n)])
    assert steps == [[], [], [], [[0, 1, 3]]] and p.count[5] == 1 and p.count.sum() == 1


def test_open_windows_have_a_bound(monkeypatch):
    """Beyond it windows are cut as at the end; each id still lies in one piece, and only the end is not full."""
    monkeypatch.setattr(packing, "MAX_OPEN", 5)
    rng, p, windows = random.Random(2), packing.SquaresPacker(64), []
    sizes = [rng.randrange(33, 60) for _ in range(300)]
    for k, n in enumerate(sizes):
        windows += list(p.add(k, bytes([k % 256]) * (4 * n), n))
        assert p.windows == sum(map(len, p.open)) == p.count.sum() <= 6
    windows += list(p.rest())
    got = Counter()
    for w in windows:
        for doc, start, ids, total in w:
            assert total == sizes[doc] and start + len(ids) // 4 <= total
            got[doc] += len(ids) // 4
    assert dict(got) == dict(enumerate(sizes))
    filled = [sum(len(x[2]) // 4 for x in w) for w in windows]
    assert all(n & (n - 1) == 0 for n in filled) and sum(n < 64 for n in filled) <= 6


def test_word_encoder():
    texts = ["", "a.", "É.,b ", "x<|endoftext|>y", "İstanbul I'LL'S don't. d'.,  \t\x0b ź", "a" * 500 + " b" * 10, "a.b, c,, d.. '.", "４.5, ½."]
    e = packing.WordEncoder(packing.default_path())
    assert e(texts) == [np.array(x.ids, "<u4").tobytes() for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_warc_round_trip(spark, tmp_path):
    body = "<p>\r\n\r\nWARC/1.1\r\n\r\n\r\n"
    pages = [(5, "http://a/1", body), (2, "http://a/2", body), (9, None, body), (3, "http://b\r\n/x", None), (4, "u", ""), (7, "u", "漢 é"), (None, "n", body), (8, "u", "漢 é\r\n")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("extra"))
    warc.write_archives(df, str(tmp_path / "a"))
    got = {r.page_id: r for r in warc.read_archives(spark, str(tmp_path / "a"), payloads=True).collect()}
    first = {body: 2, "": 3, "漢 é": 7, "漢 é\r\n": 8}
    for i, _, html in pages:
        raw = (html or "").encode()
        r, kind = got[i], "response" if first[html or ""] == i else "revisit"
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), kind, None if kind == "response" else first[html or ""])
        assert kind == "revisit" or bytes(r.payload) == raw
    warc.write_archives(df, str(tmp_path / "b"), min_payload=10)
    assert {r.page_id for r in warc.read_archives(spark, str(tmp_path / "b")).where("record_type = 'revisit'").collect()} == {5, 9, None}
    warc.deduplicate_archives(spark, str(tmp_path / "a"), str(tmp_path / "c"))
    again = {r.page_id: (r.record_type, r.payload_digest, r.refers_to) for r in warc.read_archives(spark, str(tmp_path / "c")).collect()}
    assert again == {i: (r.record_type, r.payload_digest, r.refers_to) for i, r in got.items()}
    warc.write_archives(df.limit(0), str(tmp_path / "d"))
    assert warc.read_archives(spark, str(tmp_path / "d")).count() == 0


def test_warc_ties_and_members(spark, tmp_path):
    """Of rows that repeat one is the response; record ids differ; each record is a gzip member of its own after a warcinfo."""
    long = "".join(map(chr, random.Random(1).choices(range(0x4E00, 0x9FA5), k=6_000_000)))  # a record of over 16 MB
    pages = [(1, "u", "same")] * 3 + [(1, "t", "same"), (2, "u", "same"), (None, "u", "same"), (None, None, "same")] + [(None, "n", "lone")] * 2 + [(7, "x", "")] * 2 + [(8, "y", long)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    for name, least in (("a", 0), ("b", 4), ("c", 5)):
        warc.write_archives(df, str(tmp_path / name), min_payload=least)
        got = warc.read_archives(spark, str(tmp_path / name)).collect()
        assert len(got) == len(pages) == len({r.record_id for r in got})
        assert Counter((r.page_id, r.url, r.payload_bytes) for r in got) == Counter((i, u, len(t.encode())) for i, u, t in pages)
        for text, size in (("same", 4), ("lone", 4), ("", 0)):
            own = [r for r in got if r.payload_digest == base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()]
            responses = [r for r in own if r.record_type == "response"]
            if size < least:
                assert len(responses) == len(own)
                continue
            smallest = min((i for i, _, t in pages if t == text and i is not None), default=None)
            assert len(responses) == 1 and responses[0].page_id == smallest and responses[0].refers_to is None
            assert all(r.refers_to == smallest for r in own if r.record_type == "revisit")
    import zlib as z

    kinds = []
    for f in sorted((tmp_path / "a").glob("*.warc.gz")):
        data = f.read_bytes()
        first = True
        while data:
            d = z.decompressobj(31)
            raw = d.decompress(data)
            assert d.eof
            data = d.unused_data
            if raw:
                kinds.append(raw.split(b"\r\n")[1].decode())
                assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n") and (kinds[-1] == "WARC-Type: warcinfo") == first
                first = False
    assert Counter(kinds)["WARC-Type: response"] + Counter(kinds)["WARC-Type: revisit"] == len(pages)
    warc.deduplicate_archives(spark, str(tmp_path / "c"), str(tmp_path / "d"))
    again = lambda x: Counter(map(tuple, warc.read_archives(spark, str(tmp_path / x)).select("page_id", "url", "payload_digest", "record_type", "refers_to").collect()))
    assert again("d") == again("a") != again("c")


def test_language(spark, empty):
    model = language.estimate({"en": {b" the": 50, b" house": 9, b" and": 30}, "de": {b" der": 50, b" haus": 9, b" und": 30}}, language.default_path())
    assert [x for x, _ in model.predict(["The house and the", "und das Haus", None, "12 .", ""])] == ["en", "de", "und", "und", "und"]
    assert all(0 <= s <= 1 for _, s in model.predict(["the", "xyz" * 100]))
    nothing = language.fit(empty.withColumn("lang", F.lit(None).cast("string")))
    assert language.identify(spark.createDataFrame([(1, "word")], "doc_id long, text string"), nothing).first().lang_pred == "und"


def segmentations(w, pieces):
    return [[]] if not w else [[w[:j], *more] for j in range(1, len(w) + 1) if w[:j] in pieces for more in segmentations(w[j:], pieces)]


def test_language_sums_over_segmentations():
    """Forward, forward-backward, the fit's EM and the prediction against an enumeration of all segmentations."""
    path = language.default_path()
    pieces = language.vocabulary(path)
    assert len(pieces) >= 50_256
    rng = np.random.default_rng(3)
    p = rng.random(len(pieces))
    p /= p.sum()
    some = [b" the", b" ab", " 漢é".encode(), b" information", b" a"]
    cost = lambda s, p: float(np.prod([p[pieces[x]] for x in s]))
    lattice = language.Lattice(some, path)
    brute = [sum(cost(s, p) for s in segmentations(w, pieces)) for w in some]
    assert np.exp(lattice.log_likelihood(np.log(p))) == pytest.approx(brute)

    def expected(p, counts):
        use = np.zeros(len(pieces))
        for w, n in zip(some, counts, strict=True):
            each = segmentations(w, pieces)
            total = sum(cost(s, p) for s in each)
            for s in each:
                for x in s:
                    use[pieces[x]] += n * cost(s, p) / total
        return use

    counts = [5.0, 2.0, 1.0, 3.0, 0.5]
    assert lattice.expected(np.log(p), np.array(counts)) == pytest.approx(expected(p, counts))
    q = np.array([float(len(x)) for x in pieces])
    q /= q.sum()
    for _ in range(2):
        q = expected(q, [5, 2, 1, 3, 4]) + 1e-9
        q /= q.sum()
    model = language.estimate({"xx": dict(zip(some, [5, 2, 1, 3, 4], strict=True)), "yy": {b" zu": 3}}, path, rounds=2, smoothing=0.0)
    assert model.probabilities[0] == pytest.approx(q)
    model = language.estimate({"xx": {b" the": 3, b" house": 2}, "yy": {b" der": 3, b" baum": 2}}, path)
    for text in ("the baum", "der der house", "thd"):
        logs = np.array([sum(np.log(sum(cost(s, row) for s in segmentations(w, pieces))) for w in language.words(text)) for row in model.probabilities]) / np.sqrt(len(text.split()))
        posterior = np.exp(logs - logs.max()) / np.exp(logs - logs.max()).sum()
        assert model.predict([text])[0] == (model.languages[int(np.argmax(posterior))], pytest.approx(posterior.max(), abs=1e-5))


def test_language_reads_words_of_any_length(monkeypatch):
    """No word is cut, none falls to probability 0, and long ones score alike in a lattice and streamed."""
    path = language.default_path()
    model = language.estimate({"aa": {b" abc": 5, b" bca": 2}, "bb": {b" xyz": 5}}, path)
    assert model.predict(["xyz" * 4000, "abc" * 30, "漢字かな" * 500])[:2] == [("bb", pytest.approx(1.0)), ("aa", pytest.approx(1.0))]
    logp, some = np.log(model.probabilities).T, [b" " + b"abcxyz" * k for k in (1, 3, 9)] + [b" " + bytes(range(128, 256))]
    whole = language.log_likelihoods(some, logp, path)
    assert np.isfinite(whole).all() and (whole[3] < -690).all() and whole[0] != pytest.approx(whole[1])
    monkeypatch.setattr(language, "CELLS", 64)
    assert language.log_likelihoods(some, logp, path) == pytest.approx(whole)
    parts = language._parts(" 漢字かな".encode() * 300, 1024)
    assert b"".join(parts) == " 漢字かな".encode() * 300 and all(len(x) <= 1024 and x.decode() for x in parts)


def test_language_words_are_shared_out(spark, monkeypatch):
    assert language.word_share([5, 100, 80], 65) == 30 and language.word_share([5, 9], 20) == 9 and language.word_share([], 9) == 0
    seen = {}
    monkeypatch.setattr(language, "FIT_WORDS", 30)
    monkeypatch.setattr(language, "estimate", lambda counts, path: seen.update(counts))
    word = lambda k: chr(97 + k // 26) + chr(97 + k % 26) + "q"
    rows = [(k, " ".join(word(j) for j in range(60)), "aa") for k in range(4)] + [(9, " ".join(word(j) for j in range(90)), "zz"), (10, "one two three", "mm")]
    language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), held_out_fold=None)
    sizes = {k: len(v) for k, v in seen.items()}
    assert sizes["mm"] == 3 and sizes["aa"] == sizes["zz"] == 13


@pytest.mark.parametrize("query,column,least", [("op5_language", "lang", 0.95)])
def test_language_held_out(spark, query, column, least):
    from sparkloom.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    got = QUERIES[query](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= least


def test_urls(spark):
    rules = [urls.Rule("block", "net/"), urls.Rule("allow", "example.net/en/"), urls.Rule("block", "example.com/de/"), urls.Rule("allow", "org/fr/")]
    pages = [(1, "http://WWW.Example.net/en/1?x"), (2, "https://example.net/fr"), (3, "http://a.example.com/de/#t"), (4, "x://fake.org/fr/2"), (5, "http://myexample.com/de/"), (6, None), (7, "no scheme"), (8, "http://net"), (9, "http://É.net/")]
    pages += [(100 + k, f"http://spam.example.org/buy/item{k}/x") for k in range(40)] + [(200 + k, f"http://spam.example.org/news/{k}") for k in range(40)]
    labels = [(100 + k, 0) for k in range(0, 40, 2)] + [(200 + k, 1) for k in range(0, 40, 2)] + [(None, 1)]
    found = urls.filter_urls(spark.createDataFrame(pages, "page_id long, url string").withColumn("label", F.lit(3)), spark.createDataFrame(labels, "doc_id long, quality int"), rules)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found.collect()}
    assert got[1] == ("www.example.net", "/en/1", "example.net/en/", "allow")
    assert got[2] == ("example.net", "/fr", "net/", "block")
    assert got[3] == ("a.example.com", "/de/", "example.com/de/", "block")
    assert got[4] == ("fake.org", "/fr/2", "org/fr/", "allow")
    assert got[5][2] is None and got[6][:3] == ("", "", None) and got[7][:3] == ("", "", None)
    assert got[8] == ("net", "", None, got[8][3]) and got[9][0] == "É.net"
    assert all(got[100 + k][3] == "block" and got[200 + k][3] == "allow" for k in range(40))


def brute_templates(rows, o):
    """The tree of (host, path, label) as nested loops: template and purity of every (host, path)."""
    import re

    def kind(x):
        stem, ext = re.match(r"(?s)^(.*?)(\.[A-Za-z][A-Za-z0-9]{0,4})?$", x).groups()
        return "" if x == "" else next((v for p, v in urls.KINDS if re.search(p, stem)), "{w}") + (ext or "").lower()

    at = {(h, p): "" for h, p, _ in rows}
    segments = {p: re.sub("^/", "", p).split("/") for _, p, _ in rows}
    for depth in range(o.max_depth):
        branches = defaultdict(lambda: defaultdict(list))
        for h, p, y in rows:
            if len(segments[p]) > depth:
                token = segments[p][depth]
                branches[h, at[h, p]][token].append(("/".join(map(kind, segments[p][depth + 1 :])), y, (h, p)))
        for (_, prefix), children in branches.items():
            total = sum(map(len, children.values()))
            for token, own in children.items():
                group = [x for t, xs in children.items() if kind(t) == kind(token) for x in xs]
                n, all_n = len(own), len(group)
                below, pool = Counter(r for r, _, _ in own), Counter(r for r, _, _ in group)
                alike = n == all_n
                if not alike:
                    square = sum((below[r] - n * c / all_n) ** 2 / (n * c / all_n) for r, c in pool.items()) / (1 - n / all_n)
                    alike = square <= len(pool) - 1 + o.similar_z * (2 * (len(pool) - 1)) ** 0.5 + 1e-6
                mine, every = [y for _, y, _ in own if y is not None], [y for _, y, _ in group if y is not None]
                k, m = len(mine), len(every) - len(mine)
                rate = (sum(every) + 1) / (len(every) + 2)
                error = (rate * (1 - rate) * (1 / max(k, 1) + 1 / max(m, 1))) ** 0.5
                same = not k or not m or abs(sum(mine) / k - (sum(every) - sum(mine)) / m) <= o.similar_z * error
                merged = n < o.min_pages or n < o.min_share * total or (n < all_n and alike and same)
                for _, _, key in own:
                    at[key] = prefix + "/" + (kind(token) if merged else token)
    for h, p in at:
        if len(segments[p]) > o.max_depth:
            at[h, p] += "/" + "/".join(map(kind, segments[p][o.max_depth :]))
    known = [(h, at[h, p], y) for h, p, y in rows if y is not None]
    rate = (sum(y for _, _, y in known) + 1) / (len(known) + 2)
    purity = {}
    for key in at:
        on_host = [y for h, _, y in known if h == key[0]]
        in_leaf = [y for h, t, y in known if (h, t) == (key[0], at[key])]
        host_rate = (sum(on_host) + o.prior_weight * rate) / (len(on_host) + o.prior_weight)
        purity[key] = (sum(in_leaf) + o.prior_weight * host_rate) / (len(in_leaf) + o.prior_weight)
    return at, purity


def test_url_tree(spark, empty):
    """Against nested loops, over hosts whose branches differ in labels, in what stands below them, or not at all."""
    rng = random.Random(12)
    rows = [("", "", None), ("a.b", "", 1), ("a.b", "/", 0), ("a.b", "/x\ny/z", None), ("deep", "/" + "/".join(map(str, range(12))), 1)]
    for host in ("one", "two", "three"):
        for k in range(150):
            lang = rng.choice(("en", "de", "fr"))
            path = rng.choice((f"/{lang}/{k}", f"/{lang}/{k}.HTML", f"/{lang}/{k}/", f"/blog/2024-01-{k % 28 + 1:02}/title-{k}", f"/{lang}/tag/{rng.choice('abc')}"))
            path = f"/shop/{lang}/item{k}/{'0123456789abcdef' * 2}" if host == "two" and lang == "fr" else path
            bad = host == "three" and path.startswith("/de") or rng.random() < 0.05
            rows.append((host, path, None if rng.random() < 0.3 else int(not bad)))
    rows += [("one", "/en/1", 1)] * 3
    df = spark.createDataFrame(rows, "host string, path string, label int")
    for o in (urls.TreeOptions(), urls.TreeOptions(max_depth=2, min_share=0.1, similar_z=0.5)):
        want, purity = brute_templates(rows, o)
        got = {(r.host, r.path): r for r in urls.templates(df, o).collect()}
        assert {k: r.template for k, r in got.items()} == want
        assert {k: r.purity for k, r in got.items()} == {k: pytest.approx(v) for k, v in purity.items()}
        assert all(r.rejected == (purity[k] < o.min_purity) for k, r in got.items())
    by_host = defaultdict(set)
    for (h, _), t in brute_templates(rows, urls.TreeOptions())[0].items():
        by_host[h].add(t)
    assert {"/de/{n}", "/de/{n}.html", "/de/{n}/", "/blog/{date}/{w}"} <= by_host["one"] and len(by_host["two"]) > 3 and any(t.startswith("/de/") for t in by_host["three"])
    pages = empty.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"))
    assert urls.filter_urls(pages, empty.select("doc_id", F.lit(1).alias("quality")), []).count() == 0


def test_toxicity():
    rng = random.Random(2)
    make = lambda toxic: [prose(rng, 9).encode().split() + ([b"idiot"] if toxic and k == 1 else []) for k in range(4)]
    labels = [k % 4 == 0 for k in range(400)]
    model = toxicity.train([make(t) for t in labels], [int(t) for t in labels])
    text = prose(rng, 9) + ". " + prose(rng, 5) + " Idiot! " + prose(rng, 9)
    assert model.score(text) > 0.5 and model.score(prose(rng, 30)) < 0.5 and 0 <= model.score(None) <= 1 and 0 <= model.score("") <= 1
    (a, b, _), = model.offending(text)
    assert "Idiot" in text[a:b] and "!" not in text[a:b]
    assert toxicity.train([], []).score("x") == pytest.approx(0.5, abs=0.01)


def test_toxicity_is_noisy_or_and_its_gradient_is_right():
    """Scores against the product over sentences, the gradient against finite differences."""
    model = toxicity.ToxicityModel({b"bad": 3.0, b"worse": 5.0, b"mild": 0.5}, -4.0)
    rng = np.random.default_rng(1)
    for _ in range(30):
        found = [rng.choice(["bad", "worse", "mild", "fine", "good"], rng.integers(1, 5)).tolist() for _ in range(rng.integers(1, 6))]
        clean = 1.0
        for s in found:
            clean *= 1 - 1 / (1 + np.exp(4.0 - sum({"bad": 3.0, "worse": 5.0, "mild": 0.5}.get(w, 0.0) for w in set(s))))
        assert model.score(". ".join(map(" ".join, found))) == pytest.approx(1 - clean)
    y, plain = rng.integers(0, 2, 12).astype(float), rng.integers(0, 4, 12).astype(float)
    doc_of = np.sort(rng.integers(0, 12, 20))
    sent_of, word_of = (np.array(x) for x in zip(*sorted({(int(a), int(b)) for a, b in zip(rng.integers(0, 20, 40), rng.integers(0, 5, 40), strict=True)}), strict=True))
    theta = rng.normal(0, 1, 6)
    loss, grad = toxicity._gradient(theta, y, plain, doc_of, sent_of, word_of, 0.01)
    for k in range(6):
        step = np.zeros(6)
        step[k] = 1e-6
        ends = [toxicity._gradient(theta + d * step, y, plain, doc_of, sent_of, word_of, 0.01)[0] for d in (1, -1)]
        assert grad[k] == pytest.approx((ends[0] - ends[1]) / 2e-6, rel=1e-4, abs=1e-7)


def test_toxicity_fits_training_fold_only(spark):
    rows = [(k, f"word{k % 7} thing. idiot there" if k % 3 == 0 else f"word{k % 7} thing. nice there") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0) if zlib.crc32(str(k).encode()) % 5 else int(k % 3 != 0)) for k in range(300)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert all(r.predicted == int(r.doc_id % 3 == 0) for r in got)


def brute_statistics(text):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    found = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    hit = {j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(k, k + 5)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(found) - len(set(found)), len(hit)]


def test_quality_counts(corpus):
    more = ["a b c d e a b c d e f", "x\nx\n\n\nx y", "##&& a|b <c>", "a b c d e f", "é \u00a0 \u2003 b", "a\rb\x0bc"]
    for text in [t for _, t in corpus] + more:
        assert quality.statistics(text)[0] == brute_statistics(text)
    assert quality.base_failed([9, 0, 0, 0, 0]) and quality.base_failed([100, 0, 0, 0, 21]) and not quality.base_failed([100, 0, 0, 0, 20])


def test_trees_are_monotonic():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3))
    y = ((x[:, 0] < 0.6) & (x[:, 1] > 0.3) ^ (rng.random(3000) < 0.05)).astype(float)
    trees = quality.fit_trees(x, y, [-1, 1, 0])
    assert ((trees.score(x) >= 0.5) == (y > 0)).mean() > 0.9
    for j, sign in ((0, -1), (1, 1)):
        probe = np.repeat(rng.random((50, 3)), 40, 0)
        probe[:, j] = np.tile(np.linspace(0, 1, 40), 50)
        steps = np.diff(trees.score(probe).reshape(50, 40), axis=1) * sign
        assert steps.min() >= -1e-12
    assert quality.fit_trees(np.zeros((0, 3)), np.zeros(0), [0, 0, 0]).score(np.zeros((1, 3)))[0] == pytest.approx(0.5, abs=0.01)


def test_tree_arrays_equal_a_walk():
    rng = np.random.default_rng(7)
    x = np.round(rng.random((400, 4)), 2)
    trees = quality.fit_trees(x, ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float), [0, 1, 0, -1], trees=12)

    def walk(row):
        total = trees.start
        for t in range(len(trees.feature)):
            node = 0
            while trees.left[t, node] != node:
                node = trees.left[t, node] if row[trees.feature[t, node]] < trees.threshold[t, node] else trees.right[t, node]
            total += trees.value[t, node]
        return 1 / (1 + np.exp(-total))

    assert trees.score(x) == pytest.approx([walk(r) for r in x])


def test_quality_on_documents(spark, docs, empty):
    labels = spark.createDataFrame([(k, 1) for k in range(60)] + [(95, 0), (96, 0)], "doc_id long, quality int")
    trees = quality.fit(docs, labels)
    got = {r.doc_id: r for r in quality.judge(docs, trees).collect()}
    assert not got[92].kept and not got[93].kept and got[95].base_failed and got[92].n_words == 0
    assert {r.doc_id for r in quality.keep_good(docs, trees).collect()} == {k for k, r in got.items() if r.kept}
    assert quality.judge(empty, quality.fit(empty, labels.limit(0))).count() == 0


def brute_components(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [find(k) for k in range(n)]


def line_shingles(x, width=8):
    return {x[k : k + width] for k in range(max(1, len(x) - width + 1))}


def test_lines(docs, corpus):
    o = lines.LineOptions(bands=40, rows=2)  # so many bands that no similar pair is missed
    seen = [(i, p, x) for i, t in dict(corpus).items() for p, x in enumerate((t or "").split("\n")) if x.strip()]
    distinct = sorted({x for _, _, x in seen})
    sets = {x: line_shingles(x) for x in distinct}

    def linked(a, b):
        x, y = distinct[a], distinct[b]
        return len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y])

    of = dict(zip(distinct, brute_components(len(distinct), linked), strict=True))
    assert len(set(of.values())) < len(of)
    first = {}
    for i, p, x in sorted(seen):
        first.setdefault(of[x], (i, p))
    want = {i: [p for j, p, x in sorted(seen) if j == i and first[of[x]] != (i, p)] for i, _ in corpus}
    got = lines.remove_duplicate_lines(docs, o, report=True).collect()
    assert len(got) == len(corpus) and {r.doc_id: r._removed or [] for r in got} == want
    texts = dict(corpus)
    assert all(r.text == (texts[r.doc_id] if not want[r.doc_id] else "\n".join(x for p, x in enumerate(texts[r.doc_id].split("\n")) if p not in want[r.doc_id])) for r in got)


def test_lines_without_broadcast(docs, empty):
    rows = lambda df: sorted(map(str, df.select("doc_id", "text").collect()))
    assert rows(lines.remove_duplicate_lines(docs, lines.LineOptions(broadcast_rows=-1))) == rows(lines.remove_duplicate_lines(docs))
    assert lines.remove_duplicate_lines(empty).count() == 0


def test_lines_of_rows_that_share_an_id(spark):
    """Texts under one id are documents of their own; rows that agree in both come out alike; null ids take no part."""
    a, b, c = "first line of the one text\nand its second line", "a line that occurs once\nfirst line of the one text", "漢字 and 😀 beyond the basic plane, once"
    rows = [(2, a), (2, b), (2, b), (3, a), (3, c), (None, a), (4, None), (4, ""), (4, " \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({x: F.lit("own") for x in ("_removed", "doc", "own", "h", "__x")})
    got = lines.remove_duplicate_lines(docs).collect()
    assert len(got) == len(rows) and all(r._removed == r.own == r.doc == "own" for r in got)
    texts = Counter((r.doc_id, r.text) for r in got)
    assert texts[2, "a line that occurs once"] in (0, 2) and texts[3, c] == 1 and texts[None, a] == 1 and texts[4, None] == 1 and texts[4, ""] == 1 and texts[4, " \n"] == 1
    left = {x for (i, t) in texts if i for x in (t or "").split("\n")}
    assert {*a.split("\n"), *b.split("\n"), c} <= left
    one = lines.remove_duplicate_lines(spark.createDataFrame([("y", a), ("x", a)], "doc_id string, text string"))
    assert {(r.doc_id, r.text) for r in one.collect()} == {("x", a), ("y", "")}


def test_lines_of_a_very_long_text(spark):
    """60,000 lines that differ in numbers alone, one line of a million characters, and a near copy of it."""
    rng = random.Random(9)
    many = "\n".join(f"{rng.getrandbits(60):x} {k} {rng.getrandbits(60):x}" for k in range(20_000))
    long = "".join(rng.choices("abcdefghij ", k=1_000_000))
    rows = [(1, "\n".join([many] * 3)), (2, long), (3, long[:500_000] + "#" + long[500_000:]), (4, many.split("\n", 1)[0])]
    got = {r.doc_id: r.text for r in lines.remove_duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: many, 2: long, 3: "", 4: ""}


def removed_lines(spark, texts, o=None):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = lines.remove_duplicate_lines(rows, o or lines.LineOptions(), report=True).collect()
    return {r.doc_id for r in got if r._removed}


def test_lines_read_every_character(spark):
    other = ["Temperature 17 Precipitation 23 Humidity 55 Pressure 12 Visibility 10", "Temperature 94 Precipitation 61 Humidity 38 Pressure 77 Visibility 42"]
    same = "it was so on a day of old, and he and I sat by the sea to see if it is as big as we had all said it was to be, or not"
    assert removed_lines(spark, [*other, same, same[:-2] + "t?"]) == {3}


def test_lines_recall_at_the_threshold(spark):
    """Bands of the production parameters against brute force, over pairs of lines just above the similarity."""
    rng, o, pairs = random.Random(11), lines.LineOptions(), []
    while len(pairs) < 1500:
        kind = len(pairs) % 3  # letters with the end changed; short words with one changed; numbers with one changed
        if kind == 0:
            a = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.choice((75, 90, 110))))
            b = a[: len(a) - rng.randrange(8, 13)] + "".join(rng.choices("0123456789", k=rng.randrange(0, 9)))
        else:
            words = ["".join(rng.choices("0123456789" if kind == 2 else "aeinorst", k=rng.randrange(1, 4))) for _ in range(rng.randrange(20, 120))]
            a = " ".join(words)
            for _ in range(rng.randrange(1, 6)):
                words[rng.randrange(len(words))] = "xy"
            b = " ".join(words)
        x, y = line_shingles(a), line_shingles(b)
        if 0.8 <= len(x & y) / len(x | y) < 0.85:
            pairs.append((a, b))
    rows = [(2 * k + s, x) for k, pair in enumerate(pairs) for s, x in enumerate(pair)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    of = defaultdict(set)
    known = lines.signatures(lines.occurrences(docs), o)
    for r in lines.bands(known, o).collect():
        of[r.h].add(r.band)
    assert {r.size for r in known.collect()} == {max(1, len(x) - 7) for _, x in rows}
    hashes = {r.doc: r.h for r in lines.occurrences(docs).select("doc", "h").collect()}
    found = sum(bool(of[hashes[2 * k]] & of[hashes[2 * k + 1]]) for k in range(len(pairs))) / len(pairs)
    assert found >= 0.985
    gone = {r.doc_id for r in lines.remove_duplicate_lines(docs, o, report=True).collect() if r._removed}
    assert len(gone) >= 0.985 * len(pairs) and all(k % 2 for k in gone)  # none but the second of a pair


def test_lines_that_are_short(spark):
    """Every similar pair of short lines is found, as by brute force, with no bands to help."""
    rng = random.Random(3)
    texts = ["Accept all cookies and continue reading", "Accept all cookies and continue reading!", "abcdefghijk", "abcdefghijkl", "a" * 9, "a" * 20, "tiny", "tiny!"]
    for _ in range(60):
        base = "".join(rng.choices("abcd", k=rng.randrange(9, 31)))
        texts += [base, base + "e", "e" + base[: rng.randrange(6, 40)], base[:-1] + "f", base[2:]]
    texts = sorted({x for x in texts if len(x) < 32})
    shingles = [{x[k : k + 8] for k in range(max(1, len(x) - 7))} for x in texts]
    linked = lambda a, b: len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])
    of = brute_components(len(texts), linked)
    assert len(set(of)) < len(texts) - 50
    keys = lines.short_keys(lines.occurrences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("h", "line"), lines.LineOptions()).collect()
    named = {r.h: r.doc for r in lines.occurrences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    share = defaultdict(set)
    for r in keys:
        share[named[r.h]].add(r.band)
    assert all(share[a] & share[b] for a in range(len(texts)) for b in range(a) if linked(a, b))
    assert removed_lines(spark, texts) == {k for k, c in enumerate(of) if c != k}
    assert removed_lines(spark, ["Accept all cookies and continue reading", "Accept all cookies and continue reading!"]) == {1}


def brute_fingerprint(text):
    w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c.lower() if "A" <= c <= "Z" else c for c in text or "").split(" ") if x]
    s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, corpus, empty):
    prints = [brute_fingerprint(t) for _, t in corpus]
    assert [int(x) for x in simhash.fingerprints_of([t for _, t in corpus])] == prints
    root = brute_components(len(corpus), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    least = {}
    for (i, _), r in zip(corpus, root, strict=True):
        least[r] = min(i, least.get(r, i))
    want = sorted((i, p, least[r]) for (i, _), p, r in zip(corpus, prints, root, strict=True))
    for bucket in (4096, 2):  # the small bucket splits and splits again
        got = simhash.near_duplicates(docs, bucket=bucket).collect()
        assert sorted((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got) == want
    assert simhash.near_duplicates(empty).count() == 0


def brute_near_documents(rows):
    """Ids that stay: the smallest of each component at a similarity of 0.8 of five-word shingles."""
    ids, sets = [], []
    for i, t in sorted(rows):
        w = (t or "").split()
        ids.append(i)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)})
    of = brute_components(len(ids), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    return sorted(ids[k] for k, c in enumerate(of) if c == k)


def near_copies(rng):
    """Texts and copies of them with some words replaced: similarities on both sides of 0.8."""
    rows = []
    for _ in range(12):
        base = [rng.choice(VOCAB) for _ in range(rng.choice((60, 300, 500)))]
        rows.append(" ".join(base))
        for n in (1, 2, 5, 40):
            words = list(base)
            for at in rng.sample(range(len(base)), max(1, n * len(base) // 300)):
                words[at] = "other"
            rows.append(" ".join(words))
    return list(enumerate([*rows, rows[0], "", None, "only four words here", "only four words here"]))


def test_line_dedup_stage(spark):
    import corpus_pipeline

    rng = random.Random(4)
    base = [prose(rng, n) for n in (3, 5, 12, 30, 30, 60)]
    changed = [x[:k] + "#" + x[k + 1 :] for x in base for k in rng.sample(range(len(x)), 2)] + [x + "!" for x in base]
    texts = ["\n".join(base), *["\n".join(rng.sample(base + changed, 5)) for _ in range(8)]]
    seen = [(i, p, x) for i, t in enumerate(texts) for p, x in enumerate(t.split("\n"))]
    distinct = sorted({x for _, _, x in seen})
    sets = [{x[k : k + 8] for k in range(max(1, len(x) - 7))} for x in distinct]
    of = dict(zip(distinct, brute_components(len(distinct), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])), strict=True))
    first = {}
    for i, p, x in seen:
        first.setdefault(of[x], (i, p))
    want = ["\n".join(x for j, p, x in seen if j == i and first[of[x]] == (i, p)) for i in range(len(texts))]
    assert want != texts and len(set(of.values())) < len(of)
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    got = corpus_pipeline.line_dedup(spark, docs, "").orderBy("doc_id").collect()
    assert [r.text for r in got] == want and [r.n_chars for r in got] == list(map(len, want))


@pytest.mark.parametrize("block,rows", [(4096, 500_000), (2, -1)])
def test_near_documents(spark, block, rows):
    """Against brute force; also with buckets dealt out in small blocks and without broadcasts."""
    texts = near_copies(random.Random(8))
    docs = spark.createDataFrame([*texts, (None, "x"), (None, "x")], "doc_id long, text string").withColumns({c: F.lit("own") for c in ("id", "own", "h", "fp", "component", "__id")})
    kept = simhash.keep_one(docs, simhash.NearOptions(block=block, broadcast_rows=rows))
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x)) == [*brute_near_documents(texts), None, None]


def test_near_documents_that_share_an_id(spark):
    """No unique text goes; of equal rows one stays."""
    rng = random.Random(1)
    s, unique, other = prose(rng, 90), prose(rng, 90), prose(rng, 90)
    rows = [(1, s), (5, s), (5, unique), (7, other), (7, other), (8, None), (9, "")]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(1, s), (5, unique), (7, other), (8, None)]
    named = spark.createDataFrame([("b", s), ("a", s)], "doc_id string, text string")
    assert [r.doc_id for r in simhash.keep_one(named).collect()] == ["a"]
    assert simhash.keep_one(named.limit(0)).count() == 0


def test_near_documents_recall_at_the_threshold():
    """Bands and radius of the production parameters over pairs just above the similarity."""
    rng, o, found, near, n = random.Random(2), simhash.NearOptions(), 0, 0, 0
    while n < 600:
        words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(rng.choice((60, 200, 600)))]
        a = simhash.shingle_set(" ".join(words), 5, 42)
        for at in rng.sample(range(len(words)), max(1, len(words) // 46)):
            words[at] = "x"
        b = simhash.shingle_set(" ".join(words), 5, 42)
        both = len(np.intersect1d(a, b))
        if 0.8 <= both / (len(a) + len(b) - both) < 0.85:
            n += 1
            found += bool({*simhash.band_keys(a, o.bands, o.rows).tolist()} & {*simhash.band_keys(b, o.bands, o.rows).tolist()})
            x, y = simhash.prints_of([a, b]).tolist()
            near += (x ^ y).bit_count() <= o.radius
    assert found >= 0.985 * n and near >= 0.995 * n


def test_near_dedup_stage(spark):
    import corpus_pipeline

    rows = near_copies(random.Random(8))
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame([*rows, (None, "x")], "doc_id long, text string"), "")
    got = sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x))
    assert got == [*brute_near_documents(rows), None]


def test_bit_sliced_links():
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(30)]
    group = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) & (1 << 64) - 1 for b in base for _ in range(9)})
    for radius in (0, 1, 2, 3, 7, 20, 63):
        a, b = simhash.bit_sliced_links([np.array(group, np.uint64), np.array(group[:3], np.uint64)], radius)
        want = {(x, y) for x in group for y in group if x > y and (x ^ y).bit_count() <= radius}
        assert {tuple(sorted(p, reverse=True)) for p in zip(a.tolist(), b.tolist(), strict=True)} == want


def test_links_split_large_buckets(spark):
    base = 0x0123456789ABCDEF
    prints = sorted({base ^ (1 << a) ^ (1 << b) for a in range(32) for b in range(32)})
    df = spark.createDataFrame([(x,) for x in prints], "fp long")
    for bucket in (4096, 20):
        found = components.connected_components(simhash.links(df, 2, bucket)).collect()
        assert len(found) == len(prints) and len({r.component for r in found}) == 1


def test_components(spark):
    chain = [(k, k + 1) for k in range(200)] + [(1000, k) for k in range(1001, 1100)] + [(5000, 5000), (None, 3)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert got == {k: 0 for k in range(201)} | {k: 1000 for k in range(1000, 1100)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = []
    for name, stage in corpus_pipeline.STAGES:
        names.append(name)
        before, docs = docs, stage(spark, docs, sf)
        if name != "packing":
            assert docs.schema.names == before.schema.names and 0 < docs.count() <= before.count()
    assert names == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "packing"]
    want = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, docs.select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(map(tuple, want.select("doc_id", "start", "length", "ids_crc32").collect()))


def test_line_comparison_takes_numbers(spark):
    """Sketches come of the distinct shingles of generated code, sizes too; no text of a shingle is compared with another."""
    from sparkloom.llm import lines

    o = lines.LineOptions()
    texts = ["abcdefghabcdefghabcdefgh", "short", "é𝄞 " * 40 + "tail", "x" * 300, "a longer line of words that do not repeat at all, or hardly"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "h long, line string")
    sets = lines.LineSets(df, df, o, "h", "line")
    sets.texts, sets.sketches = df, None
    plain = df.select("h").withColumn("label", F.col("h"))
    held = {r.h: r for r in sets._sketched(plain).collect()}
    for k, x in enumerate(texts):
        shingles = line_shingles(x)
        bits = sum(bin(held[k][f"k{w}"] & (2**64 - 1)).count("1") for w in range(lines.SKETCH))
        assert held[k]["size"] == len(shingles) and bits <= len(shingles) and (bits - len(shingles)) % 2 == 0
    kind = df.select(lines._shingles(F.col("line"), o).alias("s"))
    assert kind.schema["s"].dataType.simpleString() == "array<bigint>"
    assert [len(set(r.s)) for r in kind.collect()] == [len(line_shingles(x)) for x in texts]


def test_lines_have_one_hash_of_a_shingle(spark):
    """Comparisons and sketches take the hashes that signatures are made of; sketches hold a row for each line, not for each shingle."""
    from sparkloom.llm import lines

    o = lines.LineOptions()
    texts = ["abcdefghabcdefghabcdefgh", "short", "é𝄞 " * 40 + "tail", "exactly8", "漢字かな" * 9, "a longer line of words that do not repeat at all, or hardly"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "h long, line string")
    each = defaultdict(list)
    for r in lines._hashed(df, o).collect():
        each[r.h].append((r.k, r.x))
    for r in df.select("h", lines._shingles(F.col("line"), o).alias("s")).collect():
        assert r.s == [x for _, x in sorted(each[r.h])]
        assert [x & (2**64 - 1) for x in r.s] == [xxhash.xxh64(texts[r.h][k : k + o.width].encode("utf-32-be"), seed=42).intdigest() for k in range(max(1, len(texts[r.h]) - o.width + 1))]


def test_line_minima_are_folded_under_filters(spark):
    """A shingle is held against the minimum of its own bin alone, and the minima are those of its bins' hashes."""
    from sparkloom.llm import lines

    o = lines.LineOptions()
    texts = ["short", "é𝄞 " * 40 + "tail", " ".join(f"word{k} of a long line" for k in range(60)), "a longer line of words that do not repeat at all, or hardly"]
    df = spark.createDataFrame([(k, k, x) for k, x in enumerate(texts)], "doc long, h long, line string")
    got = lines.signatures(df, o)
    assert "FILTER (WHERE (bin" in got._jdf.queryExecution().executedPlan().toString()
    least = defaultdict(dict)
    for r in lines._hashed(df.select("h", "line"), o, bound=o.sure * o.bins).collect():
        bin_, y = ((r.x & 0xFFFFFF) * o.bins) >> 24, (r.x & (2**64 - 1)) >> 33
        least[r.h][bin_] = min(y, least[r.h].get(bin_, y))
    for r in got.collect():
        minima = [r[f"m{j}"] for j in range(o.bins)]
        assert all(minima[j] == y for j, y in least[r.h].items()) and set(minima) == set(least[r.h].values())
        assert r.n == 1 and r.size == max(1, len(texts[r.h]) - 7)


def test_line_shingles_are_hashed_once(spark):
    """A shingle that is held isn't cut and hashed a second time behind the filter, and what is held is what the bound says."""
    from sparkloom.llm import lines

    o = lines.LineOptions()
    texts = ["short", "x" * 300, "é𝄞 " * 40 + "tail", "y" * 126 + "z", " ".join(f"word{k} of a long line" for k in range(60))]
    df = spark.createDataFrame([(k, k, x) for k, x in enumerate(texts)], "doc long, h long, line string")
    plan = lines.signatures(df, o)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64(substring(") == 1
    every = defaultdict(list)
    for r in lines._hashed(df.select("h", "line"), o).collect():
        every[r.h].append((r.k, r.x))
    held = defaultdict(list)
    for r in lines._hashed(df.select("h", "line"), o, bound=o.sure * o.bins).collect():
        held[r.h].append((r.k, r.x))
    for h, each in every.items():
        most = o.sure * o.bins * 2**63 / len(each)
        assert sorted(held[h]) == sorted((k, x) for k, x in each if k == 0 or (x & (2**64 - 1)) >> 1 < most)
    assert len(held[4]) < len(every[4]) and all(len(held[h]) == len(every[h]) for h in (0, 3))


def test_line_pairs_are_compared_exactly(spark):
    """Lines of repeated shingles, pairs on and around the similarity, and pairs that their number of shingles alone rules out."""
    from sparkloom.llm import lines

    rng, o, pairs = random.Random(5), lines.LineOptions(), [("a" * 60, "a" * 9), ("ab" * 40, "ba" * 9), ("short", "short!"), ("abcdefgh" * 9, "abcdefgh" * 3 + "x"), ("é𝄞 " * 30, "é𝄞 " * 12)]
    for k in range(300):
        a = "".join(rng.choices("ab" if k % 3 == 0 else "abcdefgh ", k=rng.randrange(8, 150)))
        at = rng.randrange(len(a))
        pairs.append((a, a[:at] + rng.choice(("", "q", a[:30])) + a[at + rng.randrange(12) :] + a[: rng.choice((0, 0, 40))]))
    known = {x: n for n, x in enumerate(sorted({x for pair in pairs for x in pair}))}
    sets = lines.LineSets(None, None, o, "h", "line")
    sets.texts = spark.createDataFrame([(n, x) for x, n in known.items()], "h long, line string")
    asked = spark.createDataFrame([(known[a], known[b], k) for k, (a, b) in enumerate(pairs)], "a long, b long, k long")
    alike = lambda x, y: len(x & y) >= 0.8 * len(x | y) - 1e-9
    want = {k for k, (a, b) in enumerate(pairs) if alike(line_shingles(a), line_shingles(b))}
    found = sets.similar(asked)
    assert found.columns == ["a", "b", "k"] and {r.k for r in found.collect()} == want and 20 < len(want) < len(pairs) - 20
