import base64
import hashlib
import math
import random
import re
import textwrap
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("fleetroll.llm")
import public_tokenizers as P  # noqa: E402

from fleetroll.llm import bpe, licences, lines, minhash, neighbours, packing, quality, shards, substrings, warc  # noqa: E402

from .cases import documents, frame, lower, words  # noqa: E402

ROWS = documents()


def collected(df):
    return [r.asDict() for r in df.collect()]


def sha(b):
    return hashlib.sha256(b).hexdigest()


# ------------------------------------------------------------------ quality


def repeat_words(w):
    g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(g)
    return len({i + k for i, x in enumerate(g) if n[x] > 1 for k in range(3)})


def test_quality_measures(spark):
    rows = [*ROWS, (900, "a b c a b c d\na b c"), (901, "x\nx\n\n \nx\n"), (902, "one two"), (903, "# * $ %a & | < >")]
    got = collected(quality.ledger(frame(spark, rows)))
    assert len(got) == len(rows)
    for r in got:
        t = r["text"] or ""
        w = words(t)
        own = [x for x in t.split("\n") if words(x)]
        assert r["n_words"] == len(w) and r["word_chars"] == sum(map(len, w))
        assert r["n_symbols"] == sum(t.count(c) for c in "#*$%&|<>")
        assert r["n_dup_lines"] == len(own) - len(set(own))
        assert r["n_repeat_words"] == repeat_words(w)
        assert bool(r["fail_bits"] & 1) == (len(w) < 50)


def test_quality_filter_and_ablation(spark):
    docs = frame(spark, ROWS)
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns and {r["n_words"] for r in kept.collect()} <= {7}
    led = collected(quality.ledger(docs))
    for r in collected(quality.ablations(quality.ledger(docs))):
        mask = quality.POLICIES[r["policy"]].mask
        bit = next(1 << b for b, name, _ in quality.RULES if name == r["rule"])
        assert r["failing"] == sum(bool(x["fail_bits"] & bit) for x in led)
        assert r["failing_alone"] == sum(x["fail_bits"] & mask == bit for x in led)
        assert r["kept_without"] == sum(x["fail_bits"] & mask & ~bit == 0 for x in led)


# ------------------------------------------------------------------ near duplicates


def classes(rows, n, percent):
    sets = []
    for _, t in rows:
        w = words(lower(t))
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    low = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        low[root(i)].append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [x for x in low[root(i)] if x is not None]
        comp = (min(ids) if ids else None) if sets[i] else d
        out.append((d, len(sets[i]), comp, comp == d))
    return out


@pytest.mark.parametrize("n,percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, n, percent):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in collected(minhash.near_duplicates(frame(spark, ROWS), n, percent))]
    assert Counter(got) == Counter(classes(ROWS, n, percent))


def test_links_near_the_threshold(spark):
    """Pairs of similarity 0.85 to 0.87: none of 3,000 links is lost to the signature."""
    rng = random.Random(11)
    rows = []
    for i in range(3000):
        base = [f"w{rng.getrandbits(40):x}" for _ in range(400)]
        swap = list(base)
        for p in range(5, 400, 400 // 10)[: rng.randint(9, 10)]:
            swap[p] = f"v{rng.getrandbits(40):x}"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(swap))]
    want = {}
    for (a, t), (b, u) in zip(rows[::2], rows[1::2]):
        x, y = ({tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (t.split(), u.split()))
        want[b] = a if 100 * len(x & y) >= 85 * len(x | y) else b
    got = {r["doc_id"]: r["component_id"] for r in collected(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85))}
    assert sum(want[b] != b for b in want) > 2500
    assert all(got[b] == a for b, a in want.items())


def test_clashing_columns_stay(spark):
    docs = spark.createDataFrame([(1, "a b c", "p", 3, "q"), (2, "a b c", "r", 4, "s"), (3, None, "t", 5, "u")], "doc_id long, text string, _id string, own int, `n lines` string")
    got = {r["doc_id"]: r for r in collected(minhash.drop_near_duplicates(docs))}
    assert {d: (r["_id"], r["own"], r["n lines"]) for d, r in got.items()} == {1: ("p", 3, "q"), 3: ("t", 5, "u")}
    for df in (lines.dedup_lines(docs), substrings.dedup_substrings(docs), shards.lpt_shards(docs, 2), quality.ledger(docs), licences.scan(docs)):
        assert df.columns[:5] == docs.columns
        assert {r["doc_id"]: (r["_id"], r["own"], r["n lines"]) for r in df.collect()} == {1: ("p", 3, "q"), 2: ("r", 4, "s"), 3: ("t", 5, "u")}


def test_pigeonhole_covers_every_allowed_pair():
    k = 64
    distance = minhash.allowed_distance(k, 85, 4.0)
    chunks = minhash.chunks_of(k, distance)
    rng = np.random.default_rng(0)
    for _ in range(300):
        wrong = set(rng.choice(k, distance, replace=False).tolist())
        assert min(len(wrong & set(c.tolist())) for c in chunks) <= 1


# ------------------------------------------------------------------ substrings


def removed(rows, window):
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - window + 1):
            if d is not None:
                key = tuple(w[i : i + window])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, t in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone |= set(range(i, i + window))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize("window,hot", [(50, 2000), (50, 1), (20, 2000)])
def test_substrings(spark, window, hot):
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in collected(substrings.dedup_substrings(frame(spark, ROWS), window, hot))]
    want = removed(ROWS, window)
    assert sum(x[2] for x in want) > 500
    assert Counter(got) == Counter(want)


def test_substrings_with_hot_keys(spark):
    """One passage in most documents, and one anchor with many variants: their rows are dealt over salts."""
    rng = random.Random(4)
    word = lambda: f"x{rng.getrandbits(30):x}"
    shared = [word() for _ in range(70)]
    rows = [(i, " ".join([word() for _ in range(5)] + shared[: 52 + i % 18] + [word()])) for i in range(400)]
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in collected(substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), 50))]
    assert Counter(got) == Counter(removed(rows, 50))


def test_fm_index_counts():
    rng = np.random.default_rng(1)
    seqs = [rng.integers(0, 3, n) for n in (30, 8, 17, 5, 2)]
    fm = substrings.FMIndex(seqs, np.array([3, 1, 2, 0, 4]), 4)
    value = [3, 1, 2, 0, 4]
    for s, got in zip(seqs, fm.windows(seqs)):
        for i, v in enumerate(got):
            own = s[i : i + 4].tolist()
            assert v == min(x for x, o in zip(value, seqs) if any(o[j : j + 4].tolist() == own for j in range(len(o) - 3)))


# ------------------------------------------------------------------ lines


def test_lines(spark):
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in collected(lines.dedup_lines(frame(spark, ROWS), 20, 3))]
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for d, t in ROWS:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                holders[key(x)].add(-1 if d is None else d)
    want = []
    for d, t in ROWS:
        own = (t or "").split("\n")
        kept = [x for x in own if len(holders.get(key(x), ())) < 3 or max(holders[key(x)]) == (-1 if d is None else d)]
        want.append((d, len(own), len(own) - len(kept), "\n".join(kept)))
    assert sum(x[2] for x in want) > 5
    assert Counter(got) == Counter(want)


def test_lines_of_a_long_text(spark):
    """Work grows with the lines, not with their square; and a line that all documents have is dealt over salts."""
    long = "\n".join(["a line of more than twenty characters"] * 200_000)
    rows = [(i, long if i < 3 else "A line of more than twenty characters\nb") for i in range(300)]
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_text"]) for r in collected(lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert got[0] == got[2] == (200_000, 200_000, "") and got[3] == (2, 1, "b")
    assert got[299] == (2, 0, rows[299][1])


# ------------------------------------------------------------------ tokens


def test_bpe_as_tiktoken(spark):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    rows = [*ROWS, (800, "don't  stop\n\n 12345 <|endoftext|> 汉字 " + "z" * 3000), (801, "\x1c \x85 a b " + " " * 700), (802, "😀" * 50 + " ab" * 20)]
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for d, t in rows:
        ids = enc.encode_ordinary(t or "")
        want[d, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())] += 1
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in collected(bpe.round_trip(frame(spark, rows), path, P.PATTERN)))
    assert got == want
    ids = bpe.encode(frame(spark, rows).withColumn("decoded", F.lit(1)), path, P.PATTERN)
    assert all(r["decoded"].decode() == (r["text"] or "") for r in bpe.decode(ids, path).collect())


def test_bpe_of_long_words():
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    own = bpe.Bpe(path)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    rng = random.Random(6)
    some = bpe.Chunked(P.PATTERN, own.encode_pieces, most=20_000)  # emptied time and again
    for n, letters in [(511, "ab"), (513, "ab"), (4000, "a"), (200_000, "abcdefghijklmnopqrstuvwxyz"), (3000, "汉字语言")]:
        t = " \0b b" + "".join(rng.choice(letters) for _ in range(n)) + " " + " ".join("".join(rng.choice("etaoin") for _ in range(9)) for _ in range(300))
        assert some.encode([t])[0] == np.array(enc.encode_ordinary(t), "<u4").tobytes()
    assert some.held <= 20_000
    camel = bpe.Chunked(r"\p{Lu}?\p{Ll}+|.", own.encode_pieces)
    assert own.decode(camel.encode(["helloWorld  it is"])[0]) == b"helloWorld  it is"
    assert camel.encode(["helloWorld"])[0] == b"".join(own.encode_pieces([b"hello", b"World"]))


def test_ranks_encode_as_the_tokenizer_file():
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    tok, encode = Tokenizer.from_file(path), packing._tokenizer(path, P.PATTERN)
    rng = random.Random(8)
    letters = ["ab", "a", "aA", "the ", "ing", "=-", "é", "汉字", "0 1", "\n ", "  a", "'sdt ", "abcdefghijklmnopqrstuvwxyz "]
    texts = ["".join(rng.choice(rng.choice(letters)) for _ in range(rng.randint(1, 80))) for _ in range(20_000)] + ["a<|endoftext|> b"]
    assert encode(texts) == [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_packing(spark):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    cap = 64
    rows = [*ROWS, (800, "a  <|endoftext|> b<|endoftext|>")]
    got = collected(packing.pack_documents(frame(spark, rows), path, P.PATTERN, cap))
    want = Counter()
    total = 0
    for d, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        lo, hi, k = 0, len(ids) % cap or cap, 0
        hi = min(hi, len(ids))
        while lo < len(ids):
            want[d, k, lo, hi - lo, zlib.crc32(np.array(ids[lo:hi], "<u4").tobytes())] += 1
            lo, hi, k = hi, hi + cap, k + 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    seqs = defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in seqs.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= cap
    assert len(seqs) <= math.ceil(total / cap) + 1


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(3)
    sums = packing.Sums(np.array([2, 3, 7]), 12)
    assert sums.single(7) and not sums.single(5) and sums.pairs(10).tolist() == [7] and sums.pairs(6).tolist() == [3] and sums.triples(12).tolist() == [7] and sums.triples(8).tolist() == [3]
    counts = dict(Counter((rng.gamma(1.5, 150, 5000).astype(int) % 512 + 1).tolist()))
    used, n = Counter(), 0
    for pattern, m in packing.plan(counts, 512):
        assert sum(a * b for a, b in pattern) <= 512
        n += m
        for a, b in pattern:
            used[a] += b * m
    assert used == counts and n <= math.ceil(sum(a * b for a, b in counts.items()) / 512) + 1


# ------------------------------------------------------------------ shards


def test_shards(spark):
    got = collected(shards.lpt_shards(frame(spark, ROWS), 5))
    assert len(got) == len(ROWS)
    of, load, slots = {}, Counter(), defaultdict(list)
    for r in got:
        t = (r["text"] or "").encode()
        assert r["size"] == len(t) + 16 and r["text_crc32"] == zlib.crc32(t)
        assert of.setdefault(t, r["shard"]) == r["shard"]
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = Counter()
    for _, t in ROWS:
        groups[(t or "").encode()] += len((t or "").encode()) + 16
    want = [0] * 5
    for n in sorted(groups.values(), reverse=True):
        want[want.index(min(want))] += n
    assert sorted(load.values()) == sorted(want)


def test_shards_with_large_groups(spark):
    """Sizes above 16 KB are placed one by one; with fewer exact classes than such sizes the loads stay close."""
    rng = random.Random(9)
    rows = [(i, "x" * rng.choice([20, 300, 17_000 + 13 * i, 40_000 + i]) + str(i)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = [0] * 7
    for n in sorted((len(t) + 16 for _, t in rows), reverse=True):
        want[want.index(min(want))] += n
    for largest in (shards.LARGEST, 3):
        load = Counter()
        for r in collected(shards.lpt_shards(docs, 7, largest=largest)):
            load[r["shard"]] += r["size"]
        if largest > 3:
            assert sorted(load.values()) == sorted(want)
        assert max(load.values()) <= 1.01 * max(want)


def test_schedule_is_that_of_one_pop_a_group():
    rng = np.random.default_rng(0)
    counts = Counter(rng.integers(1, 30, 20_000).tolist())
    cls, rank, shard = shards.schedule([(s, n, s * n) for s, n in counts.items()], 7)
    load = np.zeros(7)
    for c, n in counts.items():
        own = cls == c
        ends = np.append(rank[own][1:], n)
        np.add.at(load, shard[own], (ends - rank[own]) * c)
    assert load.max() - load.min() <= 1


# ------------------------------------------------------------------ licences, WARC, neighbours


def test_licences(spark):
    rows = [(1, "x\nReleased under the MIT License.\n"), (2, "Licensed under CC BY-NC 4.0"), (3, None), (4, ""), (5, "word " * 5000), (6, "released   under THE mit licence"), (None, "Released under the MIT License.")]
    got = {r["doc_id"]: (r["licence"], r["line"], r["n_found"] > 0) for r in collected(licences.scan(frame(spark, rows)))}
    assert got[1][:2] == ("MIT", 2) and got[2][:2] == ("CC-BY-NC-4.0", 1) and got[None][:2] == ("MIT", 1)
    assert got[3] == got[4] == got[5] == got[6] == (None, None, False)


def test_licences_repeated_notice(spark):
    notice = "Released under the MIT License. "
    rows = [(1, notice * 74), (2, notice * 75), (3, notice * 90), (4, "\n".join([notice] * 90)), (5, notice * 3000)]
    got = {r["doc_id"]: r for r in collected(licences.scan(frame(spark, rows)))}
    assert all(got[d]["licence"] == "MIT" and got[d]["line"] == 1 and got[d]["dice"] >= round(8 / 9, 6) for d in (1, 2, 3, 5))
    assert all(got[d]["n_found"] == 1 for d in (1, 2, 3, 5))
    assert (got[4]["licence"], got[4]["line"], got[4]["dice"], got[4]["n_found"]) == ("MIT", 1, 1.0, 91)


def licence_by_brute_force(text, templates, percent=80):
    norm = lambda x: re.sub(r"[\W_]+", " ", x.lower()).split()
    grams = lambda w: set(zip(w, w[1:]))
    own = [norm(x) for x in (text or "").split("\n")]
    w, at = [x for o in own for x in o], [i for i, o in enumerate(own, 1) for _ in o]
    found, n = [], 0
    for t, (_, body) in enumerate(templates):
        b = norm(body)
        g = grams(b)

        def dice(unit):
            u = grams(unit)
            d = 2.0 * len(u & g) / (len(u) + len(g)) if u else 0.0
            return d if d * 100 >= percent else None

        units = [(dice(o), -i, -t) for i, o in enumerate(own, 1)] + ([(dice(w), 0, -t)] if len(own) > 1 else [])
        units = [x for x in units if x[0] is not None]
        runs = [(dice(w[i : i + len(b)]), i) for i in range(len(w) - len(b) + 1)] if len(w) > len(b) else []
        runs = sorted((-d, i) for d, i in runs if d is not None)
        found += units + [(-d, -at[i], -t) for d, i in runs]
        n += len(units)
        full = {-x[1] for x in units}
        taken = {i for i in range(len(w)) if at[i] in full or 0 in full}
        for _, i in runs:
            if taken.isdisjoint(range(i, i + len(b))):
                taken |= set(range(i, i + len(b)))
                n += 1
    d, line, t = max(found, default=(None, None, None))
    return (None, None, None, 0) if d is None else (templates[-t][0], round(d, 6), -line, n)


def test_licence_runs_of_words(spark):
    rng = random.Random(5)
    prose = lambda k: " ".join(rng.choice("of the licence in a to any copy software word and work".split()) for _ in range(k))
    notice = next(b for a, b in licences.NOTICES if a == "MIT" and len(b) > 100)
    texts = dict(licences.TEXTS)
    wrapped = "\n".join(textwrap.wrap(notice, 70))
    rows = [(1, f"{prose(300)}\n{wrapped}\n{prose(300)}"), (2, "# " + wrapped.replace("\n", "\n# ") + "\ndef f():\n" + "    x = 1\n" * 200), (3, texts["MIT"]), (4, prose(50) + "\n" + texts["ISC"] + prose(50) + "\n" + texts["BSD-3-Clause"])]
    rows += [(5, "\n".join([wrapped] * 3)), (6, "Released\nunder the\nMIT License. " * 40), (7, prose(40) + " Released under the MIT License. " + prose(40)), (8, texts["Apache-2.0"]), (9, None), (10, "")]
    short = [x for x in licences.NOTICES + licences.TEXTS if len(x[1]) < 2000]
    for i in range(20, 60):
        parts = [rng.choice([prose(rng.randint(0, 40)), rng.choice(short)[1]]).split() for _ in range(rng.randint(1, 4))]
        w = [x for p in parts for x in p if rng.random() > 0.03]
        rows.append((i, "".join(x + rng.choice(["\n", " ", " ", " "]) for x in w)))
    got = {r["doc_id"]: (r["licence"], r["dice"], r["line"], r["n_found"]) for r in collected(licences.scan(frame(spark, rows), short))}
    assert got == {d: licence_by_brute_force(t, short) for d, t in rows}
    every = {r["doc_id"]: r for r in collected(licences.scan(frame(spark, rows)))}
    assert [every[d]["licence"] for d in (1, 2, 3, 7, 8)] == ["MIT", "MIT", "MIT", "MIT", "Apache-2.0"]
    assert every[1]["line"] == 2 and every[1]["dice"] > 0.98 and every[4]["licence"] in ("ISC", "BSD-3-Clause")
    for name, text in licences.TEXTS:
        one = collected(licences.scan(frame(spark, [(1, prose(80) + "\n" + "\n".join(textwrap.wrap(text, 60)) + "\n" + prose(80))])))[0]
        assert one["licence"] == name and one["dice"] > 0.98


def test_warc(spark):
    html = '<!DOCTYPE html><html lang="fr"><head><title>T &amp; U</title><script>var x="<p>";</script></head><body><p>One<br>two &lt;3<a href="/x">y</a></p><!-- no --></body></html>'
    pages = spark.createDataFrame([(1, "http://a/", html), (2, None, None), (3, "http://b/", ""), (3, "http://b/", "")], "page_id long, url string, html string")
    got = collected(warc.derivatives(warc.responses(pages)))
    assert len(got) == 4
    one = next(r for r in got if r["page_id"] == 1)
    assert one["text"] == "T & U\nOne\ntwo <3y" and one["lang"] == "fr" and one["n_links"] == 1
    for r in got:
        for kind in ("conversion", "metadata"):
            head, _, body = r[f"{kind}_record"].partition("\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.split("\r\n")[1:])
            block = body[: -len("\r\n\r\n")].encode()
            assert fields["WARC-Type"] == kind and fields["WARC-Refers-To"] == r["record_id"]
            assert int(fields["Content-Length"]) == len(block) and fields["WARC-Block-Digest"] == f"sha256:{sha(block)}"
        assert f"source-payload-digest: sha256:{sha(r['payload'].encode())}" in r["metadata"]


def test_warc_null_payload_and_attributes(spark):
    resp = spark.createDataFrame(
        [("r1", "u", "d", None, "HTTP/1.1 200 OK\r\nA: b | c\r\n", None, "own"), ("r2", None, None, "sha256:x", None, "x" * 100_000 + '<p title="a>b" id=c>t<br class=\'d>e\'>u &lt;</p> 1 < 2 <a href="q>', "own")],
        "record_id string, target_uri string, warc_date string, payload_digest string, http_headers string, payload string, _lang string",
    )
    one, two = sorted(collected(warc.derivatives(resp)), key=lambda r: r["record_id"])
    assert one["text"] == "" and one["payload"] is None and one["_lang"] == "own" and "Content-Length: 0\r\n" in one["conversion_record"]
    assert one["metadata"].split("\r\n")[:3] == ["source-length: 0", "source-http-status: HTTP/1.1 200 OK", "source-http-header: A: b | c"]
    assert "source-http" not in two["metadata"] and "WARC-Source-Payload-Digest: sha256:x" in two["conversion_record"] and "WARC-Target-URI" not in two["metadata_record"]
    assert two["text"].endswith("x\nt\nu <\n1 < 2")


def test_warc_openers_that_never_close(spark):
    """40,000 of a kind on one page: each takes the rest of the page, in time linear in its length."""
    openers = ["<script ", "<!-- ", '<a b="c ', "<p ", "<html ", "<a href=", "<style>", "</p ", "<!x ", "<a href='", '="', "<template", "</script "]
    pages = [(i, "u", f"before <b>it</b> {x * 40_000}") for i, x in enumerate(openers)]
    began = time.time()
    got = {r["page_id"]: r for r in warc.derivatives(warc.responses(spark.createDataFrame(pages, "page_id int, url string, html string"))).select("page_id", "text", "n_links").collect()}
    assert time.time() - began < 60
    assert [got[i]["text"] for i in range(10)] == ["before it"] * 10 and got[10]["text"].startswith('before it ="=') and got[12]["text"] == "before it"
    assert (got[5]["n_links"], got[9]["n_links"], got[0]["n_links"]) == (1, 1, 0)


def test_warc_references(spark):
    from html import unescape
    from html.entities import html5

    rng = random.Random(2)
    known = [f"&{k}" for k in html5] + [f"&#{n}{e}" for n in (9, 39, 65, 128, 150, 160, 233, 8217, 0xD7FF, 0xD800, 0xDFFF, 0x1F600, 0x10FFFF - 2, 0x110000, 10**30, 0) for e in (";", "", " ")]
    known += ["&#x2019;", "&#X1f600;", "&#x00000041", "&#x110000;", "&#xD800;", "&#xfffffffffff;", "&#000000000000065;", "&amp;copy;", "&amp;#39;", "&amp;amp;lt;", "&copyright", "&notit;", "&nosuch;", "&", "&&", "&;", "&#;", "&#x;", "&#xg", "& amp;", "&AMP", "&ampamp;", "a & b", "&é;", "&#-1;"]
    texts = [*known, *("x".join(rng.choice(known) for _ in range(6)) for _ in range(300))]
    want = [unescape(t).replace("\xa0", " ") for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", warc.unescaped(F.col("t")).alias("u"))
    wrong = [(texts[r["i"]], r["u"], want[r["i"]]) for r in df.collect() if r["u"] != want[r["i"]]]
    assert not wrong
    html = "<p>caf&eacute; &middot; it&#8217;s &copy; 2024 &amp;copy; &lt;b&gt;&nbsp;&#xA0;end</p>"
    pages = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    assert collected(warc.derivatives(warc.responses(pages)))[0]["text"] == "café · it’s © 2024 &copy; <b> end"


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((1500, 64)) + 2 * rng.standard_normal((10, 64))[rng.integers(0, 10, 1500)]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2020, [0.0] * 64), (2040, [float("nan")] * 64), (2060, [None] * 64), (None, x[0].tolist()), (2080, x[7].tolist()), (7, x[7].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = defaultdict(list)
    for r in collected(neighbours.nearest(df)):
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    ids = np.append(np.arange(1500), 2080)
    y = np.vstack([x, x[7]])
    want = [i for i in ids.tolist() if i % 20 == 0]
    assert set(got) == set(want)
    right = 0
    for q in want:
        own = sorted(got[q])
        s = y @ y[ids.tolist().index(q)]
        s[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]]
        assert [r for r, _, _ in own] == list(range(1, 21)) and q not in [v for _, v, _ in own]
        assert all(abs(score - s[ids.tolist().index(v)]) < 1e-9 for _, v, score in own)
        right += len(set(best.tolist()) & {v for _, v, _ in own})
    assert right >= 0.9 * 20 * len(want)


def test_neighbours_of_repeated_ids_and_short_vectors(spark):
    """A shorter vector is nil beyond its length; an id with two vectors is two rows, each near the other; copies of a row are one; ties."""
    rows = [(0, [1.0, 0.0, 0.0]), (0, [0.9, 0.1, 0.0]), (0, [0.9, 0.1, 0.0]), (20, [2.0]), (3, [0.5, 0.5]), (4, [0.5, 0.5]), (5, [0.0, 0.0, 7.0])]
    got = {(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    own = {0: [rows[0], rows[1]], 20: [rows[3]]}
    want = set()
    for q, queries in own.items():
        for query in queries:
            others = [r for i, r in enumerate(rows) if i != 2 and r is not query]
            dot = lambda r: sum(a * b for a, b in zip(r[1], query[1]))
            want |= {(q, i, r[0], round(dot(r), 9)) for i, r in enumerate(sorted(others, key=lambda r: (-dot(r), r[0])), 1)}
    assert got == want


def test_empty_tables(spark):
    docs = frame(spark, ROWS).limit(0)
    path = P.path("byte_bpe_multi_50k.tiktoken")
    for df in (
        quality.ledger(docs),
        minhash.near_duplicates(docs),
        substrings.dedup_substrings(docs),
        lines.dedup_lines(docs),
        bpe.round_trip(docs, path, P.PATTERN),
        packing.pack_documents(docs, P.path("byte_bpe_50k.json"), P.PATTERN),
        shards.lpt_shards(docs),
        licences.scan(docs),
        neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")),
        warc.derivatives(warc.responses(spark.createDataFrame([], "page_id long, url string, html string"))),
    ):
        assert df.collect() == []
